"""Exact substring dedup by blockwise suffix sorting with a difference cover.

A byte goes if a string of `depth` bytes that covers it also starts in a document with a smaller doc_id; strings are judged
on the input and never cross documents. Rows with equal doc_id are one document here: they never remove each other.

1. Documents equal to an earlier one go as a whole and are not looked at again.
2. The bucket of a suffix is the least hash of the GRAM-byte strings in its first `depth` bytes, so equal strings are in one
   bucket, and neighbouring suffixes mostly share theirs. Runs of suffixes of one bucket are counted by packed bucket
   numbers, without text; only buckets that occur in two documents go on.
3. Of these the text of each run is sent to its bucket's task. Runs equal within a slice of documents are sent once.
4. A task sorts one block of suffixes at a time by their first and last COVER bytes. Longer ties are resolved by ranks of a
   cover sample, the positions whose remainder by COVER is in COVER_SET: any two suffixes have a common offset at which both are in the
   sample, and the sample's ranks, of strings of depth - COVER bytes, were computed once beforehand. So memory is that of
   the task's text and its sample, whatever the ties.

Null texts are empty. Texts shorter than `depth` keep all. Whole texts are read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import maybe_broadcast, reliable, slices, texts_of

DEPTH = 50
GRAM = 24
#: a perfect difference cover: every difference by 13 is one of two members
COVER, COVER_SET = 13, (0, 1, 3, 9)
#: bytes of all text per group that counts buckets, and per group that sorts suffixes; suffixes sorted at a time
COUNT_BYTES, SORT_BYTES, BLOCK = 8 << 20, 1 << 20, 1 << 16
#: documents whose runs are sent together, and bytes whose suffixes are hashed together
SLICE, PART_BYTES = 1000, 1 << 18
#: bytes of a packed bucket number; numbers meet only those of one group that counts, so four tell a million apart (equal
#: numbers of two buckets would cost work, not results)
BUCKET_BYTES = 4

U = np.uint64


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as a number; data must end in 64 spare bytes."""
    return np.ndarray((len(data) - 8,), "<u8", data.tobytes(), 0, (1,))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15) + U(salt)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def buckets(raw: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes of one bucket: document index, bucket number, first start in the document, number of starts."""
    found, at, size = [], 0, 0
    for i in range(len(raw) + 1):
        if i == len(raw) or (i > at and size + len(raw[i]) > PART_BYTES):
            doc, *rest = _buckets(raw[at:i], depth)
            found.append((doc + at, *rest))
            at, size = i, 0
        if i < len(raw):
            size += len(raw[i])
    return tuple(np.concatenate(x) for x in zip(*found))


def _buckets(raw: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(raw) + bytes(64 + depth), np.uint8)
    w = words(data)
    n = len(data) - 64
    least = mixed(w[:n], 1)
    for at in range(8, GRAM - 7, 8):
        least = mixed(least ^ w[at : at + n], at)
    span, reach = 1, depth - GRAM + 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    lengths = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(lengths) - lengths
    starts = np.maximum(0, lengths - depth + 1)
    doc = np.repeat(np.arange(len(raw)), starts)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
    value = least[np.repeat(begin, starts) + inside]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], inside[at], np.diff(np.append(at, len(doc)))


def task_of(values: np.ndarray, tasks: int) -> np.ndarray:
    """One of `tasks` (below 2**31) groups. Bucket numbers are minima, so they are hashed once more to spread evenly."""
    return ((mixed(values, 77) >> U(32)) * U(tasks) >> U(32)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """The low BUCKET_BYTES of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BUCKET_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BUCKET_BYTES, 8), np.uint8)
    out[:, :BUCKET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BUCKET_BYTES)
    return out.view("<u8")[:, 0]


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by several keys, equal rows equal."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def names(*keys: np.ndarray) -> np.ndarray:
    """Numbers of rows by several keys, equal rows and only these equal: sorted by one hash, compared by the keys."""
    h = np.zeros(len(keys[0]), U)
    for k in keys:
        h = mixed(h ^ k.astype(U), 5)
    order = np.argsort(h)
    h, new = h[order], np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    if (new[1:] & (h[1:] == h[:-1])).any():
        return dense(*keys)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def piece(w: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers that hold `size` bytes from each position."""
    out = [w[at + s] for s in range(0, size - 7, 8)]
    if size % 8:
        out.append(w[at + size - size % 8] & U((1 << 8 * (size % 8)) - 1))
    return out


def cover_ranks(w: np.ndarray, n: int, size: int, starts: np.ndarray) -> np.ndarray:
    """Per position, the rank of its `size` bytes among the cover sample (-1 outside of it), near the starts.

    Ranks need only tell equal strings from others. A string's rank comes from those of its parts of COVER bytes.
    """
    near = np.zeros(n + size + 1, np.int32)
    np.add.at(near, starts, 1)
    np.add.at(near, starts + COVER, -1)
    wanted = np.resize(np.isin(np.arange(COVER), COVER_SET), n) & (np.cumsum(near, dtype=np.int32)[:n] > 0)
    steps = range(0, size - COVER + 1, COVER)
    short = np.full(n + size, -1, np.int32)
    parts = np.zeros(n + size, bool)
    for s in steps:  # the sample repeats after COVER positions
        parts[s : s + n] |= wanted
    at = np.flatnonzero(parts)
    short[at] = names(*piece(w, at, COVER))
    at = np.flatnonzero(wanted)
    out = np.full(n, -1, np.int32)
    rest = piece(w, at + size - size % COVER, size % COVER) if size % COVER else []
    out[at] = names(*[short[at + s] for s in steps], *rest)
    return out


def first_documents(text: bytes, starts: np.ndarray, docs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Of each start, the smallest document with the same `depth` bytes at one of the starts."""
    n = len(text)
    w = words(np.frombuffer(text + bytes(128 + 3 * depth), np.uint8))
    ranks = cover_ranks(w, n + COVER, depth - COVER, starts)
    out = docs.copy()
    block = np.argsort(w[starts] & U(0xFFFF), kind="stable")
    head = (w[starts[block]] & U(0xFFFF)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    edges = np.append(edges, len(block))
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK, "right")) - 1)
        some = block[edges[at] : edges[to]]
        at = to
        p = starts[some]
        tie = dense(*piece(w, p, COVER), *piece(w, p + depth - COVER, COVER))
        often = np.bincount(tie)[tie] > 1
        some, p, tie = some[often], p[often], tie[often]
        if not len(p):
            continue
        who, keys = [], []
        for step in range(COVER):
            rank = ranks[p + step]
            have = np.flatnonzero(rank >= 0)
            who.append(have)
            keys.append(((tie[have] << 4 | step) << 40) | rank[have].astype(np.int64))  # fewer than 2**19 ties, 2**40 ranks
        who = np.concatenate(who)
        same = dense(np.concatenate(keys))
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, docs[some][who])
        found = out[some]
        np.minimum.at(found, who, least[same])
        out[some] = found
    return out


def joined_runs(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
    """(document, packed (start, count) pairs), one row a document."""
    order = np.lexsort((starts, docs))
    docs, pairs = docs[order], np.stack([starts[order], counts[order]], 1).astype("<i4")
    cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else []
    return [(int(docs[a]), pairs[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(docs)])]


def _bytes(batch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed one by one, a third less to shuffle than Spark's own blocks of them."""

    def rows(batches):
        for batch in slices(batches):
            found = pa.array([zlib.compress(t, 1) for t in _bytes(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, packed binary")


def _unsqueezed(batch) -> list[bytes]:
    return [zlib.decompress(p) for p in batch.column("packed").to_pylist()]


def run_buckets(docs: DataFrame, tasks: int, depth: int) -> DataFrame:
    """(task, docs, counts, numbers): packed bucket numbers of each slice of documents, by task."""

    def rows(batches):
        for batch in slices(batches, SLICE):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            doc, value, _, _ = buckets(_bytes(batch), depth)
            task = task_of(value, tasks)
            order = np.lexsort((doc, task))
            doc, value, task = doc[order], value[order], task[order]
            out = []
            for t, a, b in zip(*_cuts(task)):
                d, c = np.unique(doc[a:b], return_counts=True)
                out.append((t, ids[d].tolist(), c.tolist(), packed(value[a:b])))
            if out:
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["task", "docs", "counts", "numbers"])

    return docs.mapInArrow(rows, "task int, docs array<bigint>, counts array<int>, numbers binary")


def _cuts(sorted_keys: np.ndarray) -> tuple[list, list, list]:
    if not len(sorted_keys):
        return [], [], []
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_keys)]


def shared_buckets(docs: DataFrame, tasks: int, depth: int) -> DataFrame:
    """(doc_id, shared): packed numbers of a document's buckets that another document has too."""

    def rows(pdf):
        number = np.concatenate([unpacked(b) for b in pdf["numbers"]])
        doc = np.concatenate([np.repeat(np.array(d, np.int64), np.array(c, np.int64)) for d, c in zip(pdf["docs"], pdf["counts"])])
        order = np.lexsort((doc, number))
        number, doc = number[order], doc[order]
        new = np.concatenate([[True], (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])])
        number, doc = number[new], doc[new]
        same = np.concatenate([[False], number[1:] == number[:-1], [False]])
        often = same[1:] | same[:-1]
        number, doc = number[often], doc[often]
        order = np.argsort(doc, kind="stable")
        number, doc = number[order], doc[order]
        return pd.DataFrame([(d, packed(number[a:b])) for d, a, b in zip(*_cuts(doc))], columns=["doc_id", "shared"])

    found = run_buckets(docs, tasks, depth).groupBy("task").applyInPandas(rows, "doc_id long, shared binary")
    return found.groupBy("doc_id").agg(F.collect_list("shared").alias("shared"))


def suffix_runs(docs: DataFrame, tasks: int, depth: int) -> DataFrame:
    """(task, docs, starts, lengths, text): the runs of shared buckets; and, with task -1, runs equal to an earlier one of the slice."""

    def rows(batches):
        for batch in slices(batches, SLICE):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            raw = _unsqueezed(batch)
            raw = [raw[i] for i in order]
            shared = batch.column("shared").to_pylist()
            mask = U((1 << 8 * BUCKET_BYTES) - 1)
            doc, value, start, count = buckets(raw, depth)
            low, keep = value & mask, np.zeros(len(doc), bool)
            for d, a, b in zip(*_cuts(doc)):
                keep[a:b] = np.isin(low[a:b], np.concatenate([unpacked(s) for s in shared[order[d]]]))
            doc, value, start, count = doc[keep], value[keep], start[keep], count[keep]
            pieces = [raw[d][s : s + c + depth - 1] for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist())]
            seen: dict[bytes, int] = {}
            first = np.array([seen.setdefault(hashlib.md5(p).digest(), d) for p, d in zip(pieces, ids[doc].tolist())], np.int64)
            again = (first < ids[doc]) if len(doc) else np.zeros(0, bool)
            task = np.where(again, -1, task_of(value, tasks))
            by = np.argsort(task, kind="stable")
            out = []
            for t, a, b in zip(*_cuts(task[by])):
                some = by[a:b]
                text = b"" if t < 0 else b"".join([pieces[i] for i in some.tolist()])
                out.append((t, ids[doc[some]].tolist(), start[some].tolist(), count[some].tolist(), text))
            if out:
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["task", "docs", "starts", "counts", "text"])

    return docs.select("doc_id", "packed", "shared").mapInArrow(rows, "task int, docs array<bigint>, starts array<int>, counts array<int>, text binary")


def repeated_starts(runs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, runs): starts of strings that also start in a smaller document, as packed (start, count) pairs."""

    def sort(pdf):
        doc = np.concatenate([np.array(d, np.int64) for d in pdf["docs"]])
        start, count = (np.concatenate([np.array(s, np.int64) for s in pdf[c]]) for c in ("starts", "counts"))
        text = b"".join(pdf["text"])
        size = count + depth - 1
        begin = np.cumsum(size) - size
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        docs = np.repeat(doc, count)
        gone = first_documents(text, np.repeat(begin, count) + within, docs, depth) < docs
        place = (np.repeat(start, count) + within)[gone]
        docs = docs[gone]
        order = np.lexsort((place, docs))
        docs, place = docs[order], place[order]
        new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (place[1:] != place[:-1] + 1)]) if len(docs) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return pd.DataFrame(joined_runs(docs[at], place[at], np.diff(np.append(at, len(docs)))), columns=["doc_id", "runs"])

    def known(batches):
        for batch in batches:
            for docs, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("docs", "starts", "counts"))):
                got = joined_runs(np.array(docs, np.int64), np.array(starts), np.array(counts))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([r for _, r in got], pa.binary())], names=["doc_id", "runs"])

    kind = "doc_id long, runs binary"
    sorted_ = runs.where("task >= 0").groupBy("task").applyInPandas(sort, kind)
    return sorted_.union(runs.where("task < 0").mapInArrow(known, kind)).groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))


def kept_text(raw: bytes, runs: list[bytes], depth: int) -> tuple[int, int, str, bytes]:
    """Removed bytes, removed spans, hash of the rest, and the rest."""
    n = len(raw)
    pairs = np.concatenate([np.frombuffer(r, "<i4").reshape(-1, 2) for r in runs])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] + depth - 1, -1)
    gone = np.cumsum(change[:n]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest


def drop_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counting, sorting = (min((1 << 31) - 1, 8 + int(size // b)) for b in (COUNT_BYTES, SORT_BYTES))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    equal = own.select("doc_id", digest.alias("d")).groupBy("d").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = equal.where("least < most").select("d", "least")
    copies = own.select("doc_id", digest.alias("d")).join(least, "d").where("doc_id > least").select("doc_id").distinct()
    copies = reliable(copies)
    once = own.join(maybe_broadcast(copies, 16), "doc_id", "left_anti")
    shared = reliable(shared_buckets(once, counting, depth))
    some = maybe_broadcast(shared.select("doc_id"), 16)
    # copies have no shared buckets, so the join with these leaves them out
    tight = squeezed(own)
    runs = suffix_runs(tight.join(some, "doc_id", "left_semi").join(shared, "doc_id"), sorting, depth)
    gone = reliable(repeated_starts(runs, depth))
    hit = maybe_broadcast(gone.select("doc_id"), 16)

    def rows(batches):
        for batch in slices(batches):
            raw = _unsqueezed(batch)
            got = [kept_text(r, g, depth) for r, g in zip(raw, batch.column("runs").to_pylist())]
            columns = [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = tight.join(hit, "doc_id", "left_semi").join(gone, "doc_id").select("doc_id", "packed", "runs")
    cut = cut.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # the others lose nothing or, as copies, all: their sizes and digests are enough, no text is shuffled
    sizes = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("d")).join(hit, "doc_id", "left_anti")
    whole = sizes.join(maybe_broadcast(copies.withColumn("copy", F.lit(True)), 16), "doc_id", "left")
    all_gone = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= depth)
    whole = whole.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        all_gone.cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.col("d")).alias("kept_sha256"),
    )
    return cut.unionByName(whole)
