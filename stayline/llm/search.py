"""Ranked lexical search by dense blocked BLAS multiplication.

Terms are the maximal runs of letters, digits and characters beyond ASCII, with A-Z in lower case. N documents hold a
term, L terms in all; a document of n terms has m = 100 - 75 + (75 n N) div L. A term that df documents hold weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))); in a document with tf of it its impact is (10^9 tf) div (1000 tf + 8 m).
A document's score for an item is the sum of w times impact over the item's terms, repeats included.

Two passes read all documents, whole: the first counts N, L and each df, the second scores. Items go in blocks of
ITEM_BYTES of text at most, each block against all documents; only a block's vocabulary, weights and counts
are on the driver and broadcast. In a task, BLOCK documents at a time become a matrix of impacts, and ITEMS items of
a block a matrix of weights times repeats, over the compact vocabulary of these items alone; their product scores
all of them. Both hold whole numbers in float64, and the columns are cut where the sum of weights times the highest
impact (10^6) could pass 2^53, so that partial sums are exact, and add up in 64 bits.

Each task keeps the best documents of each item, by score and then by doc_id, so ties are kept or dropped alike
wherever a document lies; a last ranking merges the tasks' best. Documents that score 0 are not returned.

Null texts have no terms. Each row of documents is a document and each row of items an item, also with repeated
or null ids; a null doc_id comes after all others. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stayline.llm.common import reliable, slices

TOP = 10
#: documents and items of a product, and columns of a part of it
BLOCK, ITEMS, COLUMNS = 256, 32, 4096
#: bytes of text of the items that are held at once
ITEM_BYTES = 8 << 20
#: fixed values of the score
SCALE, SLOPE, MASS, FAST = 1_000_000_000, 75, 8, 1000
#: the highest sum of weights whose products with the highest impact stay below 2^53
MOST = ((1 << 53) - 1) // (SCALE // FAST)
NO_ID = (1 << 63) - 1

#: bytes of a text in UTF-8: letters in lower case, digits and bytes beyond ASCII stay, all else splits
_WORDS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def item_blocks(items: DataFrame):
    """The items as lists of (item_id, Counter of terms), a block at a time, each of a bounded size."""
    sized = items.select("item_id", F.col("text").cast("binary").alias("text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 64)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = 2 * total // ITEM_BYTES + 1  # half full on average
    for b in range(parts):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b) if parts > 1 else sized
        yield [(r["item_id"], Counter(terms_of(r["text"]))) for r in part.select("item_id", "text").collect()]


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each term of the vocabulary, counted over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        df, n, total = np.zeros(len(known), np.int64), 0, 0
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                terms = terms_of(text)
                n, total = n + bool(terms), total + len(terms)
                df[[known[t] for t in known.keys() & set(terms)]] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *met.tolist()], pa.int64()), pa.array([n, total, *df[met].tolist()], pa.int64())], names=["term", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    got = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block's items
    counts = {r["term"]: r["n"] for r in got}
    df = np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.int64)
    return counts.get(-1, 0), counts.get(-2, 0), df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def tiles_of(items: list[Counter], vocabulary: dict[bytes, int], weights: list[int], columns: int = COLUMNS) -> list[tuple[range, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each tile of items: their numbers, and for each part of their compact vocabulary its terms and matrix."""
    out = []
    for at in range(0, len(items), ITEMS):
        mine = items[at : at + ITEMS]
        terms = sorted({vocabulary[t] for item in mine for t in item})
        where = {t: i for i, t in enumerate(terms)}
        matrix = np.zeros((len(terms), len(mine)))
        for j, item in enumerate(mine):
            for t, repeats in item.items():
                matrix[where[vocabulary[t]], j] = repeats * weights[vocabulary[t]]
        parts, start, mass = [], 0, np.zeros(len(mine))
        for i in np.flatnonzero(matrix.max(1, initial=0) > MOST).tolist():  # a term that an item repeats very often
            while (matrix[i] > MOST).any():
                parts.append((np.array(terms[i : i + 1], np.int64), np.minimum(matrix[i : i + 1], MOST)))
                matrix[i] -= parts[-1][1][0]
        for i in range(len(terms) + 1):
            full = i < len(terms) and (i - start >= columns or (mass + matrix[i] > MOST).any())
            if i > start and (full or i == len(terms)):
                parts.append((np.array(terms[start:i], np.int64), matrix[start:i]))
                start, mass = i, np.zeros(len(mine))
            if i < len(terms):
                mass += matrix[i]
        out.append((range(at, at + len(mine)), parts))
    return out


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` highest scores above 0, equal ones by id, all rows of an id being equal."""
    met = np.flatnonzero(scores > 0)
    if len(met) > top:
        least = np.partition(scores[met], len(met) - top)[len(met) - top]
        met = met[scores[met] >= least]
    return met[np.lexsort((ids[met], -scores[met]))][:top]


def scored(docs: DataFrame, items: list[Counter], top: int = TOP) -> DataFrame:
    """(item, doc_id, missing, score): the best documents of each task for each item, by its place in the list."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in items for t in item}))}
    n_docs, n_terms, df = statistics(docs, vocabulary)
    weights = [weight(n_docs, int(d)) for d in df]
    shared = spark.sparkContext.broadcast((vocabulary, tiles_of(items, vocabulary, weights)))

    def score(batches):
        known, tiles = shared.value
        column = np.full(len(known), -1, np.int64)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for part in slices(batches, BLOCK):
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            size = np.zeros(len(ids), np.int64)
            rows, terms, counts = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                own = Counter(terms_of(text))
                size[i] = own.total()
                for t in known.keys() & own.keys():
                    rows.append(i)
                    terms.append(known[t])
                    counts.append(own[t])
            if not rows:
                continue
            rows, terms, counts = (np.array(x, np.int64) for x in (rows, terms, counts))
            m = 100 - SLOPE + (SLOPE * size * n_docs) // n_terms
            impact = (SCALE * counts) // (FAST * counts + MASS * m[rows])
            for numbers, parts in tiles:
                total = np.zeros((len(ids), len(numbers)), np.int64)
                for wanted, matrix in parts:
                    column[wanted] = np.arange(len(wanted))
                    at = column[terms]
                    mine = at >= 0
                    column[wanted] = -1
                    dense = np.zeros((len(ids), len(wanted)))
                    dense[rows[mine], at[mine]] = impact[mine]
                    total += (dense @ matrix).astype(np.int64)
                for j, number in enumerate(numbers):
                    scores, names = held[number]
                    new = np.flatnonzero(total[:, j] >= (scores[-1] if len(scores) >= top else 1))
                    if len(new):
                        scores, names = np.concatenate([scores, total[new, j]]), np.concatenate([names, ids[new]])
                        first = best(scores, names, top)
                        held[number] = scores[first], names[first]
        number = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
        if len(number):
            scores, names = (np.concatenate(x) for x in zip(*held))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (number, names, scores)], names=["item", "doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its `top` best documents."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    out = None
    for block in item_blocks(items):
        if not any(terms for _, terms in block):
            continue
        found = scored(docs, [terms for _, terms in block], top)
        order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        ranked = found.withColumn("rank", order).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item long, item_id {kind}")
        got = ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
        out = got if out is None else reliable(out).union(got)
    return spark.createDataFrame([], schema) if out is None else out
