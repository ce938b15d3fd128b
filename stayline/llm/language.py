"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1. A binary classifier per bit (regularised least squares
on hashed character 1- to 3-grams, square-rooted and of unit length) predicts it; decoding takes the language
whose codeword has the smallest weighted squared-hinge loss, each bit weighted by its accuracy on left-out
rows. The score is the softmax of the losses; a document is ambiguous if the two smallest losses are close.

A null text, or one without a letter, is `und` with score 0. Whole texts are read, of any length. Rows with a
null language are not learned from; without any learnable row every document is `und`. Equal texts have equal
predictions; ties of losses go to the language first in order. Other columns are left as they are.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from stayline.llm.common import slices, texts_of

BITS = 12  # of the hashed n-gram space
#: learned rows per language: an expected number, drawn by a hash of the id
SAMPLE = 400
RIDGE = 0.02
#: documents are measured in groups of at most so many, or of so many characters
GROUP_DOCS, GROUP_CHARS = 256, 1 << 20
SHARPNESS = 8.0
CLOSE = 0.05


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def groups(texts: list[str]):
    """Index ranges of consecutive texts that are measured together."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and (i - at == GROUP_DOCS or size + len(text) > GROUP_CHARS):
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length (and a constant), and whether each text has a letter."""
    space, width = len(texts), 1 << BITS
    # two blanks before each text: n-grams at its end meet these, never the next text
    low = ["  " + t.lower() for t in texts]
    codes = np.frombuffer(("".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.int32)
    lengths = np.array([len(t) for t in low], np.int64)
    starts = np.cumsum(lengths) - lengths
    is_letter = letters()[codes]
    has = np.logical_or.reduceat(is_letter[:-2], starts) if space else np.zeros(0, bool)
    c = np.where(is_letter, codes, 32).astype(np.uint32)
    c *= np.uint32(2654435761)  # n-grams are sums of these, turned for their place
    pair = c[:-1] + (c[1:] << np.uint32(7))
    triple = pair[:-1] + (c[2:] << np.uint32(14)) + np.uint32(668265263)
    row = np.repeat(np.arange(space) * width, lengths)
    counts = np.zeros(space * width, np.int64)
    for grams in (c[: len(row)], pair[: len(row)], triple):
        counts += np.bincount(row + (grams * np.uint32(2246822519) >> np.uint32(32 - BITS)), minlength=space * width)
    x = np.ones((space, width + 1), np.float32)
    np.sqrt(counts.reshape(space, width), out=x[:, :width], casting="unsafe")
    x[:, :width] /= np.sqrt(np.maximum(3 * lengths, 1))[:, None]  # the root of what the row counts
    return x, has


def codewords(k: int) -> np.ndarray:
    """k codewords: all splits of the languages if these are few, else the best of some random codes."""
    if k <= 7:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, k - 1)) if -1 in rest]
        return np.array(bits, np.float64).reshape(len(bits), k).T
    width = int(np.ceil(10 * np.log2(k)))
    tries = [np.random.default_rng(seed).choice([1.0, -1.0], (k, width)) for seed in range(50)]
    tries = [m[:, np.abs(m.sum(0)) < k] for m in tries]
    return max(tries, key=lambda m: min(np.sum(a != b) for a, b in itertools.combinations(m, 2)))


def fit(texts: list[str], langs: list[str]) -> dict:
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return {"names": names, "code": code}
    x = np.vstack([features(texts[a:b])[0] for a, b in groups(texts)]).astype(np.float64)
    y = code[[names.index(s) for s in langs]]
    inverse = np.linalg.inv(x @ x.T + RIDGE * np.eye(len(x)))
    alpha = inverse @ y
    left_out = y - alpha / np.diag(inverse)[:, None]  # predictions without the row itself
    error = np.clip((left_out * y <= 0).mean(0), 0.5 / len(x), 0.499)
    weight = np.log((1 - error) / error)
    return {"names": names, "code": code, "w": (x.T @ alpha).astype(np.float32), "weight": weight / weight.sum()}


def decode(model: dict, texts: list[str]) -> pd.DataFrame:
    out = []
    for a, b in groups(texts):
        x, has = features(texts[a:b])
        names = model["names"]
        if len(names) >= 2:
            f = (x @ model["w"]).astype(np.float64)
            gap = np.maximum(0, 1 - f[:, None, :] * model["code"][None])
            loss = (gap * gap) @ model["weight"]
        else:
            loss = np.zeros((b - a, max(1, len(names))))
        order = np.argsort(loss, axis=1, kind="stable")
        best = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        p = np.exp(-SHARPNESS * (loss - best[:, None]))
        close = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - best < CLOSE if loss.shape[1] > 1 else np.zeros(b - a, bool)
        known = has & (len(names) > 0)
        out.append(
            pd.DataFrame(
                {
                    "lang_pred": [names[i] if k else "und" for i, k in zip(order[:, 0], known)],
                    "score": np.where(known, 1 / p.sum(1), 0.0),
                    "ambiguous": known & close,
                    "loss": best,
                }
            )
        )
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["lang_pred", "score", "ambiguous", "loss"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from (doc_id, text, lang); about `sample` rows per language are read, chosen by a hash of doc_id."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], [])
    share = F.create_map(*[F.lit(v) for s, n in sorted(sizes.items()) for v in (s, int(min(1.0, sample / n) * (1 << 20)))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")]).toPandas()
    drawn = drawn.sort_values(["doc_id", "lang"], kind="stable")
    return fit(drawn["text"].tolist(), drawn["lang"].tolist())


def identify(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns to keep of docs, with lang_pred, score, ambiguous and loss of its column text, or of the field of
    that name in its struct `row`, so that no text is sent twice."""
    alone = "text" in docs.columns

    def rows(batches):
        for batch in slices(batches):
            texts = texts_of(batch) if alone else [t or "" for t in batch.column("row").field("text").to_pylist()]
            found = decode(model, texts)
            columns = [batch.column(c) for c in keep] + [pa.array(found[c]) for c in found.columns]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *found.columns])

    kinds = StructType([docs.schema[c] for c in keep])
    for name, kind in (("lang_pred", StringType()), ("score", DoubleType()), ("ambiguous", BooleanType()), ("loss", DoubleType())):
        kinds.add(name, kind)
    return docs.select(*dict.fromkeys([*keep, "text" if alone else "row"])).mapInArrow(rows, kinds)


def not_held_out(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.where(F.expr("crc32(cast(doc_id AS string)) % 3 <> 1"))
