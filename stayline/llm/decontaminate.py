"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations alone.

Words are the maximal runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A window is a
run of `window` consecutive item words (a shorter item is one window), and as a set it holds its shingles of five
words (a shorter window is one shingle). All of them must occur where the window does, so one is a sufficient
prefix: the shingles of all windows are counted over all documents, each window keeps its rarest one, and a
window with a shingle that never occurs is out. Documents meet the prefix shingles only. A match at a place of
the document fixes where the window would start; it must start and end inside the document (positional and
length bounds), and the words of that item-sized window of the document must equal the window's own.

The tables of shingles and windows are broadcast in blocks of BROADCAST_BYTES at most, each block against all
documents, so a benchmark of any size is matched whole and no text is shuffled. A row for each document, and one
for each occurrence, is all that is grouped.

Rows of documents are told apart by doc_id and two hashes of the text; equal rows give equal results, as often as
they occur. Null texts have no words. Items with a null item_id mark words but are not named. Items of equal
item_id are one item. Other columns are ignored. Texts of any length are read whole. Empty tables give empty
results, documents without benchmark come out clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stayline.llm import common
from stayline.llm.common import reliable

WINDOW = 10
SHINGLE = 5
#: what a place holds that stands for the whole document
WHOLE = -1


def _classes() -> tuple[str, str]:
    """ASCII characters that split words or change, and what replaces them."""
    said = [chr(c) for c in range(128) if not (chr(c).isdigit() or "a" <= chr(c) <= "z")]
    return "".join(said), "".join(c.lower() if "A" <= c <= "Z" else " " for c in said)


def words_of(text: Column) -> Column:
    """The words of a text as an array, empty for a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), *_classes()), " "), "")


def shingle_key(hashes: Column, at: Column, k: int) -> Column:
    """One hash for the k words from a place on; null if the text ends before."""
    inside = at + k <= F.size(hashes)
    return F.when(inside, F.xxhash64(F.lit(k), *[F.get(hashes, at + j) for j in range(k)]))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(words, size, items): each distinct window with the ids, as sorted strings, of the items that hold it."""
    held = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    cut = held.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = cut.select("item", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("size", F.size("words"))


def window_shingles(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Each window once for each of its shingles: `offset` in the window and `key`."""
    kind = F.least(F.col("size"), F.lit(SHINGLE))
    placed = windows.withColumn("hashes", hashes_of(F.col("words"))).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - kind)))
    key = F.coalesce(*[F.when(kind == k, shingle_key(F.col("hashes"), F.col("offset"), k)) for k in lengths])
    return placed.withColumn("key", key).drop("hashes")


def blocks_of(df: DataFrame, size: Column, by: Column) -> list[DataFrame]:
    """A checkpointed table in parts that may be broadcast: the bytes are summed first, hashes deal the rows."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = 2 * total // common.BROADCAST_BYTES + 1  # half full on average, so that none is over
    return [df.where(F.pmod(F.xxhash64(by), F.lit(parts)) == b) if parts > 1 else df for b in range(parts)]


def document_places(docs: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """A row for each place of a document and shingle length; with `whole` also one at WHOLE for the document."""
    text = F.col("text")
    told = docs.select(
        "doc_id", F.xxhash64(text).alias("h"), F.xxhash64(F.lit("g"), text).alias("g"), words_of(text).alias("all")
    ).withColumn("hashes", hashes_of(F.col("all")))
    last = F.size("all") - 1
    places = F.sequence(F.lit(WHOLE), last) if whole else F.when(last >= 0, F.sequence(F.lit(0), last))
    placed = told.select("*", F.explode(places).alias("at"))
    at = F.col("at")
    if len(lengths) == 1:
        return placed.withColumn("key", F.when(at >= 0, shingle_key(F.col("hashes"), at, lengths[0])))
    keys = F.array(*[shingle_key(F.col("hashes"), at, k) for k in lengths])
    return placed.select("*", F.explode(F.when(at >= 0, keys).otherwise(F.array(F.lit(None).cast("long")))).alias("key"))


def prefixes(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Each window that may occur, with the key and offset of its rarest shingle in all documents."""
    shingled = window_shingles(windows, lengths)
    keys = reliable(shingled.select("key").distinct())
    counted = [
        document_places(docs, lengths, whole=False).select("key").join(F.broadcast(part), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        for part in blocks_of(keys, F.lit(16), F.col("key"))
    ]
    counts = reduce(DataFrame.union, counted)
    rarest = F.min(F.when(F.col("n") > 0, F.struct("n", "key", "offset")))
    return (
        shingled.join(counts, "key", "left")
        .groupBy("words", "size", "items")
        .agg(rarest.alias("rarest"), F.count("n").alias("met"), F.count(F.lit(1)).alias("of"))
        .where("met = of")
        .select("words", "size", "items", "rarest.key", "rarest.offset")
    )


def occurrences(docs: DataFrame, windows: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """(doc_id, h, g, n_words, start, size, items): where the broadcast windows occur; start is null in a document's own row."""
    places = document_places(docs, lengths, whole)
    marks = F.broadcast(windows)
    if whole:
        places = places.withColumn("key", F.coalesce("key", F.lit(0)))
        empty = windows.sparkSession.range(1).selectExpr("cast(null AS array<string>) AS words", "cast(null AS int) AS size", "cast(null AS array<string>) AS items", "0L AS key", "0 AS offset")
        marks = F.broadcast(windows.select("words", "size", "items", "key", "offset").union(empty))
    start = F.col("at") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("size") <= F.size("all"))
    exact = bounds & (F.slice("all", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col("size"), F.lit(0))) == F.col("words"))
    mine = F.col("words").isNull() & (F.col("at") == WHOLE)
    fits = F.when(F.col("words").isNull(), mine).otherwise((F.col("at") >= 0) & exact)
    return places.join(marks, "key").where(fits).select(
        "doc_id", "h", "g", F.size("all").cast("long").alias("n_words"), F.when(F.col("at") >= 0, start).alias("start"), "size", "items"
    )


def covered(spans: Column) -> Column:
    """How many places a sorted array of (start, stop) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(done: Column, span: Column) -> Column:
        more = F.greatest(span["stop"] - F.greatest(span["start"], done["end"]), F.lit(0))
        return F.struct((done["n"] + more).alias("n"), F.greatest(done["end"], span["stop"]).alias("end"))

    return F.aggregate(spans, zero, add, lambda done: done["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (start and stop of each occurring window, in words), n_hit, items."""
    windows = reliable(item_windows(items, window))
    lengths = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # five at most
    marks = reliable(prefixes(docs, windows, lengths))
    room = F.length(F.concat_ws(" ", "words")) + F.length(F.concat_ws(" ", "items")) + 32 * F.col("size") + 32 * F.size("items") + 64
    parts = blocks_of(marks, room, F.concat_ws(" ", "words"))
    found = reduce(DataFrame.union, [occurrences(docs, part, lengths, whole=b == 0) for b, part in enumerate(parts)])
    span = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("stop")))
    per = found.groupBy("doc_id", "h", "g").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.collect_set("items").alias("sets"),
        F.count_if(F.col("start").isNull()).alias("rows"),
    )
    per = per.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return per.select("doc_id", "n_words", "spans", covered(F.col("spans")).alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"))
