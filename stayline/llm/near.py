"""MinHash near-dedup by fast similarity sketching: rounds of hashed bin placement, banding, exact verification.

A document's set is its distinct 5-word shingles (the whole sequence if it has fewer words), as 64-bit hashes.
The sketch has t bins. In round r < t each shingle falls into a hashed bin with value r plus a hashed fraction; in
round t + b all fall into bin b; a bin keeps its least value, and a document stops after the round in which no bin
is empty. So every coordinate fills, and the share of equal coordinates concentrates around the similarity.

Documents with equal sets form a class, and classes are sketched once. Bands of coordinates give buckets; buckets
with the same members count once. The sets of a bucket meet in one task, which verifies 100 |A and B| >= alike
|A or B| until its members are connected as all true links connect them. A large bucket is dealt to tasks by pairs of
chunks, so memory is bounded and no pair is left out. Links become components by star contraction.

Null or empty texts and texts without a word have an empty set: linked with nothing, kept. Rows with equal doc_id
share a component. Whole texts are read. Columns other than doc_id and text are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import components, maybe_broadcast, reliable, slices, texts_of

WORDS = 5
#: similarity as a fraction of 100; at 80 the bands miss a pair with probability (1 - 0.8 ** 4) ** 20, 3 in 100,000
ALIKE = 85
BANDS, ROWS = 20, 4
SEED = 0x9E3779B97F4A7C15
#: documents of one bucket that a task compares; larger buckets are compared by pairs of chunks
CHUNK = 1500
GROUP_BYTES = 4 << 20

U = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (fixed constants of splitmix)."""
    x = x + U((salt * SEED + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mixed(np.arange(256, dtype=U), 1)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at, size = 0, 0
    for i in range(len(raw) + 1):
        if i == len(raw) or (i > at and size + len(raw[i]) > GROUP_BYTES):
            out += _sets(raw[at:i], words)
            at, size = i, 0
        if i < len(raw):
            size += len(raw[i])
    return out


def _sets(raw: list[bytes], words: int) -> list[np.ndarray]:
    if not raw:
        return []
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[data]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    none = np.zeros(0, U)
    if not len(start):
        return [none] * len(raw)
    stop = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    # a word's hash: bytes times powers of an odd number, counted from the word's start
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    longest = int((stop - start).max())
    power = np.cumprod(np.full(longest + 1, SEED | 1, U))
    value = _BYTE[data] * power[np.minimum(place, longest)]
    value[blank] = 0
    word = mixed(np.add.reduceat(value, start) + (stop - start).astype(U), 2)
    per = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))  # words of each text
    n = len(word)
    shingle = np.zeros(n, U)
    for j in range(words):
        shingle[: max(0, n - j)] += mixed(word[j:], 10 + j)
    shingle = mixed(shingle, 3)
    first = np.cumsum(per) - per
    out = []
    for a, k in zip(first.tolist(), per.tolist()):
        if k >= words:
            out.append(np.unique(shingle[a : a + k - words + 1]))
        elif k:
            out.append(mixed(sum(mixed(word[a + j : a + j + 1], 10 + j) for j in range(k)) + U(k), 4))
        else:
            out.append(none)
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t 64-bit coordinates per set; sets must not be empty."""
    n = len(sets)
    bins = np.full(n * t, ~U(0))
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    todo = np.ones(n, bool)
    for r in range(2 * t):
        live = todo[row]
        row, items = row[live], items[live]
        if not len(row):
            break
        h = mixed(items, 100 + r)
        b = h % U(t) if r < t else np.full(len(h), r - t, U)
        np.minimum.at(bins, row * t + b.astype(np.int64), (U(r) << U(55)) + (mixed(h) >> U(9)))
        todo = (bins.reshape(n, t) == ~U(0)).any(1)
    return bins.reshape(n, t)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([np.bitwise_xor.reduce(mixed(s, 7)), mixed(s, 8).sum(dtype=U)]).tobytes() if len(s) else b""


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, same, bands): the size, key and band hashes of each document's set."""

    def rows(batches):
        for batch in slices(batches):
            sets = shingle_sets(texts_of(batch))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                got = sketches([sets[i] for i in full], BANDS * ROWS).reshape(len(full), BANDS, ROWS)
                key = np.zeros((len(full), BANDS), U)
                for k in range(ROWS):
                    key = mixed(key + got[:, :, k], 20 + k)
                key = mixed(key + np.arange(BANDS, dtype=U), 30).view(np.int64)
                for i, k in zip(full, key):
                    bands[i] = k
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "same", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_shingles long, same binary, bands array<long>")


def linked(ids: np.ndarray, sets: list[np.ndarray], alike: int = ALIKE) -> list[tuple[int, int]]:
    """Edges that connect the documents of one task as all their true links do.

    Documents are tried against all others by one pass over the joined sets, and no pair inside a found
    component is tried again.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    start = np.cumsum(sizes) - sizes
    group, edges = np.arange(n), []
    seen = np.zeros(len(values), np.int64)
    for i in range(n - 1):
        if (group == group[i]).all():
            break
        mine = code[start[i] : start[i] + sizes[i]]
        seen[mine] = 1
        both = np.bincount(owner, seen[code], n)
        seen[mine] = 0
        link = (100 * both >= alike * (sizes + sizes[i] - both)) & (group != group[i])
        for j in np.flatnonzero(link).tolist():
            if group[j] != group[i]:
                edges.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return edges


def bucket_members(classes: DataFrame) -> DataFrame:
    """(task, doc_id): documents to compare with each other; buckets with equal members once, large ones by chunk pairs."""
    rows = classes.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(doc_id))").alias("a"), F.expr("sum(xxhash64('s', doc_id) % 1000000007)").alias("b")
    )
    once = sizes.where("m > 1").groupBy("m", "a", "b").agg(F.min("bucket").alias("bucket"))
    held = rows.join(once.select("bucket", "m"), "bucket")
    chunks = F.ceil(F.col("m") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("c"), "doc_id"), chunks).cast("int")
    pair = lambda k: F.xxhash64("bucket", F.least(k, F.col("own")), F.greatest(k, F.col("own")))
    return (
        held.withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("doc_id", F.explode(F.when(F.col("chunks") == 1, F.array("bucket")).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), pair))).alias("task"))
    )


def verified(docs: DataFrame, members: DataFrame, alike: int = ALIKE) -> DataFrame:
    """(a, b): links between members of a task, enough to connect what all links connect."""
    names = maybe_broadcast(reliable(members.select("doc_id").distinct()), 16)

    def sets(batches):
        for batch in slices(batches):
            found = [s.tobytes() for s in shingle_sets(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "items"])

    few = docs.select(F.col("doc_id").cast("long"), "text").join(names, "doc_id").dropDuplicates(["doc_id"])
    held = few.mapInArrow(sets, "doc_id long, items binary").join(members, "doc_id")

    def compare(pdf):
        pdf = pdf.sort_values("doc_id")
        found = linked(pdf["doc_id"].to_numpy(), [np.frombuffer(b, U) for b in pdf["items"]], alike)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return held.select("task", "doc_id", "items").groupBy("task").applyInPandas(compare, "a long, b long")


def near_classes(docs: DataFrame, alike: int = ALIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    got = reliable(measured(docs))
    classes = got.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    members = reliable(bucket_members(classes.select(F.col("rep").alias("doc_id"), "bands")))
    found = components(verified(docs, members, alike))
    reps = got.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("rep"))
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("component"))
    rest = got.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return got.where("n_shingles > 0").join(named, "same").select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(rest)


def keep_first(docs: DataFrame, alike: int = ALIKE) -> DataFrame:
    """docs without the rows that are not the first of their component; columns as given."""
    gone = reliable(near_classes(docs, alike).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(maybe_broadcast(gone, 16), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
