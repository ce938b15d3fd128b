"""Best-fit packing of tokenized documents by bin completion over the table of lengths.

What decides a packing is how many pieces there are of each length, at most `capacity` numbers
whatever the corpus. The driver packs this table: best-fit decreasing gives the incumbent, and bin
completion (enumerate the undominated fillings around the largest piece, prune by the waste that a
better packing may have) improves it while it exceeds the lower bound. The answer is a short list of
fillings, each with how often it is used; Spark deals the pieces to them by length and rank.

Ranks follow md5, or an order of the documents if one is given. Then the uses of each filling are spread evenly over
the order, so that a sequence gets pieces from about the same part of it, and sequences are numbered by their first piece
in the order. The number of sequences is the same; a length that occurs once goes where its filling needs it.

Nulls and empty texts are one end token. Equal rows are packed each on its own. Columns other than
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stayline.llm.common import ordered_rank, reliable, slices, spread_rank, texts_of

CAPACITY = 2048
#: steps of the search for a packing better than the incumbent, and fillings kept around one piece
STEPS = 40_000
FILLINGS = 50
#: parts of an order among which the uses of a filling are spread
PARTS = 64
#: distinct words whose ids a Python worker keeps
WORDS_KEPT = 100_000
#: texts divided into words at once
TEXTS = 100
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: how byte-level vocabularies of this kind divide a text (fixed value), and the id of a newline there
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEWLINE_ID = 198

_kept: dict[str, tuple] = {}
_AFTER_BLANK = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones as they are, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tuple:
    """The worker's encoder of a tokenizer file, its table of words seen, the tokenizer, and its special tokens' texts.

    The vocabulary is read by tokenizers; its ids, which are the merge order, go to the faster merge loop of
    tiktoken, which gives the same ids (the tests compare both).
    """
    if path not in _kept:
        import tiktoken
        from tokenizers import Tokenizer

        of = byte_letters()
        tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        words = {w: i for w, i in tokenizer.get_vocab().items() if w not in special}
        ranks = {bytes(of[c] for c in w): i for w, i in words.items()}
        _kept[path] = (tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {}, tokenizer, sorted(special))
    return _kept[path]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    Byte-level pre-tokenization never joins what a space after a non-blank divides, so a text's ids
    are its words' ids in a row; words are looked up, and new ones of all texts encoded together. A text that spells
    out a special token goes to the tokenizer itself, which gives that token's id.
    """
    enc, known, tokenizer, special = encoder(path)
    spelled = [any(s in text for s in special) for text in texts]
    if any(spelled):
        usual = iter(token_bytes([t for t, s in zip(texts, spelled) if not s], path))
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if s else next(usual) for t, s in zip(texts, spelled)]
    if len(known) > WORDS_KEPT:
        known.clear()
    split = []
    for text in texts:
        if _AFTER_BLANK.search(text) or text[:1] == " ":
            split.append([text])  # runs of blanks: as a whole
        else:
            split.append(text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text])
    whole: dict[str, bytes] = {}
    new = {w for parts in split for w in parts}.difference(known)
    plain = [w for w in new if "\n" not in w and w[:1] == " " and 1 < len(w) < 64]
    ids = np.array(enc.encode_ordinary("\n".join(plain)), "<u4")
    cut = np.flatnonzero(ids == NEWLINE_ID)
    if len(cut) == len(plain) - 1:
        raw = ids.tobytes()
        for w, a, b in zip(plain, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)]):
            known[w] = raw[4 * a : 4 * b]
    for w in new.difference(known):
        (known if len(w) < 64 else whole)[w] = np.array(enc.encode_ordinary(w), "<u4").tobytes()
    return [b"".join([known[w] if w in known else whole[w] for w in parts]) for parts in split]


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens; only the first piece may be shorter than full."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _order): each document with an end token, cut to capacity."""

    def rows(batches):
        for batch in slices(batches, TEXTS):
            out = []
            for doc, at, raw in zip(batch.column("doc_id").to_pylist(), batch.column("_order").to_pylist(), token_bytes(texts_of(batch), path)):
                raw += b"\0\0\0\0"
                for k, (start, length) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                    out.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), at))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "_order"])

    at = F.lit(None) if order is None else order
    return docs.select(F.col("doc_id").cast("long"), "text", at.cast("long").alias("_order")).mapInArrow(rows, f"{PIECE}, _order long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a table of lengths: fillings and how often each is used."""
    full: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # room left in open bins, ascending
    opened: dict[int, list] = {}

    def put(filling: tuple[int, ...], times: int, room: int) -> None:
        if not room:
            full.append((filling, times))
            return
        if room not in opened:
            rooms.insert(bisect_left(rooms, room), room)
        opened.setdefault(room, []).append((filling, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                k = capacity // size
                if left >= k:
                    put((size,) * k, left // k, capacity - k * size)
                if left % k:
                    put((size,) * (left % k), 1, capacity - left % k * size)
                break
            room = rooms[i]
            filling, times = opened[room].pop()
            if not opened[room]:
                del opened[room], rooms[i]
            used = min(times, left)
            if times > used:
                put(filling, times - used, room)
            put((*filling, size), used, room - size)
            left -= used
    return full + [x for some in opened.values() for x in some]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the best of the bounds with pieces over capacity - k on their own."""
    n = np.zeros(capacity + 2, np.int64)
    for size, times in counts.items():
        n[size] = times
    number, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half, ks = capacity // 2, np.arange(capacity // 2 + 1)
    large = number[capacity] - number[half]  # each in a bin of its own
    room = (number[capacity - ks] - number[half]) * capacity - (volume[capacity - ks] - volume[half])
    rest = volume[half] - volume[np.maximum(ks - 1, 0)]
    return int(max(-(-volume[capacity] // capacity), (large + np.maximum(0, -((room - rest) // capacity))).max()))


def completions(counts: dict[int, int], first: int, capacity: int, waste: int, steps: list[int]) -> list[tuple[int, ...]]:
    """Undominated fillings around `first` that waste no more than `waste`, the least waste first.

    A filling is dominated if another piece still fits, or if one of its pieces can be exchanged for a
    larger one at hand. Each step of the search takes one from `steps`; at 0 it returns what it has.
    """
    sizes = sorted((s for s in counts if counts[s] - (s == first) > 0), reverse=True)
    spare = {s: counts[s] - (s == first) for s in sizes}
    rising = sizes[::-1]
    found: list[tuple[int, tuple[int, ...]]] = []
    stack = [(capacity - first, 0, (first,))]
    while stack and steps[0] > 0 and len(found) < FILLINGS:
        steps[0] -= 1
        room, i, filling = stack.pop()
        while i < len(sizes) and (sizes[i] > room or filling[1:].count(sizes[i]) >= spare[sizes[i]]):
            i += 1
        if i < len(sizes):
            stack.append((room, i + 1, filling))
            stack.append((room - sizes[i], i, (*filling, sizes[i])))
            continue
        if room > waste:
            continue
        fits = lambda b: next((s for s in rising[bisect_right(rising, b) :] if spare[s] > filling[1:].count(s)), capacity)
        if not any(fits(b) <= b + room for b in (0, *filling[1:])):
            found.append((room, filling))
    return [f for _, f in sorted(found, key=lambda x: (x[0], -len(x[1])))]


def plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with the times each is used; uses every piece once. Bounded by the number of lengths."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    least, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    stack, budget = [(counts, 0, 0, [])], [steps]
    while stack and bins > least and budget[0] > 0:
        left, used, wasted, done = stack.pop()
        if not left:
            if used < bins:
                best, bins = done, used
            continue
        allowed = (bins - 1) * capacity - total - wasted  # waste that a better packing may still have
        volume = sum(s * n for s, n in left.items())
        if allowed < 0 or used - -volume // capacity >= bins:
            continue
        for filling in reversed(completions(left, max(left), capacity, allowed, budget)):
            times = min(left[s] // filling.count(s) for s in set(filling))
            lost = capacity - sum(filling)
            if lost:
                times = max(1, min(times, allowed // lost))
            rest = {s: n - times * filling.count(s) for s, n in left.items()}
            stack.append(({s: n for s, n in rest.items() if n}, used + times, wasted + times * lost, [*done, (filling, times)]))
    return best


def spread(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """The fillings with their uses in up to PARTS parts each, in turn; fillings used once are spread as well."""
    out = []
    for i, (filling, times) in enumerate(fillings):
        parts = min(times, PARTS)
        shift = (i + 1) * 0.6180339887498949 % 1  # the golden ratio spreads any number of them evenly
        out += [((j + shift) / parts, i, filling, (j + 1) * times // parts - j * times // parts) for j in range(parts)]
    return [(filling, times) for _, _, filling, times in sorted(out)]


def shares(fillings: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, per sequence, offset), ordered: who gets which pieces of a length."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            each = filling.count(size)
            out.append((size, taken.get(size, 0), sequence, each, offset))
            taken[size] = taken.get(size, 0) + each * times
            offset += each * size
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, order: Column | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; see the module text.

    `order` is a whole number from 0 on the rows of docs, another one for each row.
    """
    cut = reliable(pieces(docs, path, capacity, order))
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if order is None:
        deal = shares(plan(lengths, capacity))
        ranked = spread_rank(cut, "length", F.concat_ws("_", "doc_id", "piece", "ids_crc32"))
    else:
        deal = shares(spread(plan(lengths, capacity)))
        ranked = ordered_rank(cut, "length", "_order", "piece")

    def rows(batches):
        edges = deal[:, 0] * (1 << 45) + deal[:, 1]
        for pdf in batches:
            size, rank = pdf["length"].to_numpy(np.int64), pdf.pop("_rank").to_numpy(np.int64)
            got = deal[np.searchsorted(edges, size * (1 << 45) + rank, "right") - 1]
            place = rank - got[:, 1]
            pdf["sequence_id"] = got[:, 2] + place // got[:, 3]
            pdf["offset"] = got[:, 4] + place % got[:, 3] * size
            yield pdf

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if order is None:
        return ranked.select(*names, "_rank").mapInPandas(rows, f"{PIECE}, sequence_id long, offset long")
    placed = reliable(ranked.select(*names, "_order", "_rank").mapInPandas(rows, f"{PIECE}, _order long, sequence_id long, offset long"))
    heads = placed.groupBy("sequence_id").agg(F.min(F.struct("_order", "piece")).alias("_head"))
    heads = ordered_rank(heads.select("sequence_id", "_head.*", F.lit(0).alias("_all")), "_all", "_order", "piece")
    return placed.join(heads.select("sequence_id", "_rank"), "sequence_id").select(*names, F.col("_rank").alias("sequence_id"), "offset")
