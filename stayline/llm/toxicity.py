"""Toxicity by a support vector machine on a gapped subsequence kernel with Nystroem landmarks.

A text is read as symbols: letters in lower case, a run of anything else as one separator. The kernel of two strings
sums, over the three-symbol subsequences they share, decay to the power of the gaps (at most one symbol between
neighbours), so inserted characters weaken a match and don't break it. Such subsequences are counted in a hashed
table, in which the kernel is a scalar product. Landmarks are words that tell the labels of training sentences apart
and frequent clean words; the machine learns (squared hinge) in the space they span, and what it learns folds back into
one weight per hashed subsequence. A text's score is that of its worst window of WINDOW symbols, through a
logistic curve fitted on the training documents.

Training reads a bounded sample of labelled documents; its sentences are the negatives if the document is clean, and the
positives if it is toxic and they hold a telling word. Null and empty texts have the score of a text without letters.
Whole texts of any length are read. Equal texts have equal scores. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import maybe_broadcast, reliable, slices, texts_of
from stayline.llm.language import groups, letters

BITS = 16
DECAY = 0.85
WINDOW = 14
#: windows with hardly a subsequence are not scaled up further
LEAST_NORM = 2.0
#: labelled documents of each kind that training reads (an expected number, drawn by a hash of the id)
SAMPLE = 2500
LANDMARKS, CLEAN_LANDMARKS = 160, 60
NEGATIVES = 10_000
#: rounds in which the clean windows that look worst join the negatives, and how many
MINED, MINED_EACH = 4, 1200
WORD = re.compile(r"[^\W\d_]{3,}")
GAPS = [(1, 1), (1, 2), (2, 1), (2, 2)]
WEIGHTS = np.array([DECAY ** (a + b - 2) for a, b in GAPS], np.float32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (0: separator), each text followed by WINDOW zeros, and where each text starts."""
    pad = "\0" * WINDOW
    low = [t.lower().replace("\0", " ") for t in texts]
    codes = np.frombuffer((pad.join([" " + t for t in low]) + pad).encode("utf-32-le", "surrogatepass"), np.int32)
    lengths = np.array([len(t) + 1 + WINDOW for t in low], np.int64)
    letter = letters()[codes]
    between = ~letter & (codes != 0)
    keep = ~(between & np.concatenate([[False], between[:-1]]))
    starts = np.cumsum(lengths) - lengths
    starts = np.concatenate([[0], np.cumsum(keep)])[starts]
    s, gap = np.where(letter, codes, 0)[keep].astype(np.uint32), between[keep]
    # letters on their own in a row ("b a d") are read as one word: the separators between them go
    lone = np.zeros(len(s), bool)
    if len(s) > 4:
        lone[2:-2] = gap[2:-2] & (s[1:-3] != 0) & (s[3:-1] != 0) & (s[:-4] == 0) & (s[4:] == 0)
    return s[~lone], starts - np.concatenate([[0], np.cumsum(lone)])[starts]


def hashed_subsequences(s: np.ndarray) -> np.ndarray:
    """Row per symbol: the hash of the subsequence that starts there, for each kind of gaps; 0 stands for none."""
    x = np.concatenate([s * np.uint32(2654435761), np.zeros(4, np.uint32)])
    there = np.concatenate([s != 0, np.zeros(4, bool)])
    n = len(s)
    out = np.zeros((n, len(GAPS)), np.int64)
    for k, (a, b) in enumerate(GAPS):
        h = x[:n] + (x[a : n + a] << np.uint32(9)) + (x[a + b : n + a + b] << np.uint32(18)) + np.uint32(374761393)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        h = (h >> np.uint32(32 - BITS)).astype(np.int64)
        count = there[:n].astype(np.int8) + there[a : n + a] + there[a + b : n + a + b]
        # a separator may stand at one end of three neighbours: it marks the edge of a word
        out[:, k] = np.where((count == 3) | ((a + b == 2) & (count == 2) & there[1 : n + 1]), np.maximum(h, 1), 0)
    return out


def window_features(strings: list[str]) -> np.ndarray:
    """Row per string, its subsequences within one window: WINDOW * len(GAPS) hashes."""
    out = np.zeros((len(strings), WINDOW * len(GAPS)), np.int64)
    for a in range(0, len(strings), 2000):
        s, starts = symbols(strings[a : a + 2000])
        # every text ends in WINDOW zeros, so no window reaches into the next text
        out[a : a + 2000] = hashed_subsequences(s)[starts[:, None] + np.arange(WINDOW)].reshape(len(starts), -1)
    return out


def kernel(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of windows (rows of hashes) with landmarks (table: hashes by landmarks), both of unit length."""
    weight = np.tile(WEIGHTS, WINDOW)[None] * (rows > 0)
    out = np.zeros((len(rows), table.shape[1]), np.float64)
    for at in range(0, len(rows), 500):
        part = slice(at, at + 500)
        out[part] = np.einsum("nf,nfm->nm", weight[part], table[rows[part]])
    return out / np.sqrt(np.maximum((weight * weight).sum(1), LEAST_NORM))[:, None]


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    penal = ridge * np.eye(len(w)) * weight.sum() / len(w)
    penal[-1, -1] = 1e-9
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        a, c = x[active], weight[active][:, None]
        w = np.linalg.solve(a.T @ (a * c) + penal, a.T @ (c[:, 0] * y[active]))
        new = y * (x @ w) < 1
        if (new == active).all():
            break
        active = new
    return w[:-1], float(w[-1])


def telling_words(docs: list[str], toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Words that occur in toxic documents and hardly in clean ones; words frequent in clean ones."""
    seen = [Counter(), Counter()]
    for text, label in zip(docs, toxic):
        seen[int(label)].update(set(WORD.findall(text.lower())))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = {w: np.log((c + 0.1) / n1) - np.log((seen[0][w] + 0.1) / n0) for w, c in seen[1].items() if c >= 3}
    worst = sorted((w for w in odds if odds[w] > 3.0), key=lambda w: (-seen[1][w] * odds[w], w))
    return worst[: LANDMARKS - CLEAN_LANDMARKS], [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[:CLEAN_LANDMARKS]]


def fit(docs: list[str], labels: list[int]) -> dict:
    toxic = np.array(labels, bool)
    worst, plain = telling_words(docs, toxic)
    if not worst or not plain:
        return {"u": np.zeros(1 << BITS, np.float32), "b": 0.0, "slope": 0.0, "shift": -1e3}
    rng = np.random.default_rng(5)
    known, positives, negatives = set(worst), [], []
    for text, label in zip(docs, toxic):
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            if label:
                for m in WORD.finditer(sentence):
                    if m.group() in known:
                        at = max(0, m.start() - int(rng.integers(1, 3)))
                        word = sentence[at : at + WINDOW]
                        positives.append(word)
                        # the same with one character put in, and with one between all its letters
                        k = int(rng.integers(1, max(2, m.end() - at - 1)))
                        positives.append(word[: k + 1] + str(rng.choice(list("abeiou.-*x"))) + word[k + 1 :])
                        if len(positives) % 2:
                            positives.append(" " + str(rng.choice(list(" .-*"))).join(m.group()))
            elif sentence:
                at = int(rng.integers(0, len(sentence)))
                negatives.append(" " + sentence[at : at + WINDOW])
    negatives = [negatives[i] for i in rng.permutation(len(negatives))[:NEGATIVES]]
    positives = [positives[i] for i in rng.permutation(len(positives))[:NEGATIVES]]
    marks = window_features(worst + plain)
    table = np.zeros((1 << BITS, len(marks)), np.float32)
    for j, row in enumerate(marks):
        np.add.at(table[:, j], row, np.tile(WEIGHTS, WINDOW))
    table[0] = 0
    table /= np.linalg.norm(table, axis=0, keepdims=True)
    values, axes = np.linalg.eigh((table.T @ table).astype(np.float64))
    used = values > 1e-4 * values.max()
    root = axes[:, used] / np.sqrt(values[used])
    model = {}
    z = kernel(window_features(positives + negatives), table) @ root
    for step in range(MINED + 1):
        y = np.where(np.arange(len(z)) < len(positives), 1.0, -1.0)
        weight = np.where(y > 0, 1 / max(1, len(positives)), 1 / max(1, len(z) - len(positives)))
        w, b = svm(z, y, weight * len(y))
        model = {"u": (table @ (root @ w)).astype(np.float32), "b": b, "slope": 1.0, "shift": 0.0}
        if step < MINED:  # clean windows that look worst join the negatives
            clean = [t for t, label in zip(docs, toxic) if not label]
            top, where = worst_windows(model, clean)
            mined = window_features([where[i] for i in np.argsort(-top)[:MINED_EACH]])
            z = np.vstack([z, kernel(mined, table) @ root])
    top, _ = worst_windows(model, docs)
    x, t = np.stack([top, np.ones(len(top))], 1), toxic.astype(float)
    share = toxic.mean()
    coef = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        hess = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        coef = coef + np.linalg.solve(hess, x.T @ (t - p) - 1e-3 * coef)
    return model | {"slope": float(coef[0]), "shift": float(coef[1]), "share": float(share)}


def window_scores(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, starts = symbols(texts)
    h = hashed_subsequences(s)
    each, square = np.zeros(len(s)), np.zeros(len(s))
    for k, weight in enumerate(WEIGHTS.astype(np.float64)):
        each += weight * model["u"][h[:, k]]
        square += weight * weight * (h[:, k] > 0)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (each, square)]
    end = np.minimum(np.arange(len(s)) + WINDOW, len(s))
    dot, norm = (v[end] - v[:-1] for v in sums)
    return np.round(dot / np.sqrt(np.maximum(norm, LEAST_NORM)) + model["b"], 7), s, starts


def worst_windows(model: dict, texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Of each text, the score of its worst window, and the window."""
    tops, where = [], []
    for a, b in groups(texts):
        score, s, starts = window_scores(model, texts[a:b])
        tops.append(np.maximum.reduceat(score, starts))
        for i, top in zip(starts, tops[-1]):
            at = i + int(np.argmax(score[i:] >= top))
            where.append("".join(chr(c) if c else " " for c in s[at : at + WINDOW]))
    return np.concatenate(tops) if tops else np.zeros(0), where


def scores(model: dict, texts: list[str]) -> np.ndarray:
    if not model["slope"]:
        return np.zeros(len(texts))
    out = [np.zeros(0)]
    for a, b in groups(texts):
        score, _, starts = window_scores(model, texts[a:b])
        out.append(np.maximum.reduceat(score, starts))
    top = np.concatenate(out)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * top + model["shift"], -50, 50)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from (doc_id, text) and (doc_id, toxic), of about `sample` labels of each kind, chosen by a hash of doc_id.

    The labels are drawn first, so that no text is shuffled: what is drawn is bounded, and broadcast if it is as small as it should be.
    """
    rows = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return fit([], [])
    part = {k: int(min(1.0, sample / n) * (1 << 20)) for k, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, part[1]).otherwise(part[0])
    drawn = reliable(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit))
    read = docs.where("text IS NOT NULL").select("doc_id", "text").join(maybe_broadcast(drawn, 16), "doc_id").toPandas()
    read = read.sort_values(["doc_id", "toxic"], kind="stable")
    return fit(read["text"].tolist(), read["toxic"].tolist())


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document."""

    def rows(batches):
        for batch in slices(batches):
            found = scores(model, texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double")
