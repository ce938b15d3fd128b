"""Line dedup by a deletion-neighbourhood join, with DataFrame operations alone.

A line goes if the same line, or one within one edit (a character inserted, deleted or replaced), first
occurs at an earlier place, a place being (doc_id, text, line number). Places are judged on the input, so the
result does not depend on an order of removal.

Lines become hashes at once; repeated lines meet map-side. Two lines within one edit are equal outside a piece that
holds the edit, whatever the pieces are, so a line emits variants only for pieces whose rest it shares: first the
halves, then halves of the shared ones, and so on down to LAST characters, each time by the hash of the whole rest.
Pieces are cut by the length of the shorter line. What is left emits each deletion in its piece as a hashed key.
Lines of equal length that share the variant of one position differ there alone; a variant that equals a whole line
is one deletion away from it. So the earliest line of a key is all that the others need, however many share it, and
edit distance is verified on the texts of these pairs.

Null texts have no lines; blank lines stay and are never counted as copies. Lines under `shortest` characters
only go as equal copies. Rows are told apart by doc_id and text: rows equal in both are one document, whose lines
are not copies of each other; rows with equal doc_id and different texts are two, in the order of a hash of the text.
A null doc_id comes before all others. Texts and lines of any length are read whole. Columns of docs may have any
name; drop_lines replaces those that it adds. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayline.llm.common import maybe_broadcast, reliable

#: lines of fewer characters are too short for one edit to mean little
SHORTEST = 16
#: pieces of at most this many characters emit their deletions
LAST = 4
FIRST_ID = -(1 << 63)
#: what a line may be: of equal length, the shorter or the longer of two
EQUAL, SHORTER, LONGER = 0, 1, 2


def told() -> list[Column]:
    """What tells the rows of docs apart, `doc` and `mark`, and their text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), F.xxhash64("text").alias("mark"), F.col("text").alias("text")]


def line_places(docs: DataFrame) -> DataFrame:
    """(doc, mark, pos, line): every line that is not blank."""
    return docs.select(*told()).select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))


def hashed(places: DataFrame) -> DataFrame:
    """Add two independent hashes of the line."""
    return places.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit("g"), F.col("line")))


def sharing_halves(places: DataFrame, shortest: int) -> DataFrame:
    """(h, mask): lines, by their first hash, that share a half with another; mask says which and as what.

    A half's key holds its side, its hash and the length of the line it halves: the own length, or (as the longer
    of two) one less. The own half of one line equal to that of another: equal lengths, a character may be replaced
    (1 left, 2 right). Equal to one cut as the longer: a character may be missing (4 left, 8 right the shorter; 16
    left, 32 right the longer).
    """
    n = F.length("line")
    half = lambda length: F.floor(length / 2).cast("int")
    right = lambda length: F.xxhash64(F.substring(F.col("line"), n - (length - half(length)) + 1, n))
    left = lambda length: F.xxhash64(F.substring(F.col("line"), F.lit(1), half(length)))
    lines = (
        places.where(n >= shortest)
        .select(F.xxhash64("line").alias("h"), n.alias("n"), left(n).alias("x"), right(n).alias("y"), left(n - 1).alias("x1"), right(n - 1).alias("y1"))
        .dropDuplicates(["h"])
    )
    key = lambda side, of, length: F.xxhash64(F.lit(side), F.col(of), F.expr(length))
    keys = [
        F.struct(key(side, of, length).alias("key"), F.lit(role).cast("tinyint").alias("role"))
        for role, (side, of, length) in enumerate([("x", "x", "n"), ("y", "y", "n"), ("x", "x1", "n - 1"), ("y", "y1", "n - 1")])
    ]
    rows = lines.select("h", F.inline(F.array(*keys)))
    own = F.when(F.col("role") < 2, F.col("h"))
    shared = (
        rows.groupBy("key")
        .agg(F.min(own).alias("a"), F.max(own).alias("b"), F.max("role").alias("high"))
        .where("a <> b OR (a IS NOT NULL AND high > 1)")
        .select("key", F.expr("a <> b").alias("equal"), (F.col("high") > 1).alias("unequal"))
    )
    role = F.col("role")
    side = F.when(role % 2 == 0, 1).otherwise(2)
    bit = F.when(role > 1, side * 16).otherwise(F.when(F.col("equal"), side).otherwise(0) + F.when(F.col("unequal"), side * 4).otherwise(0))
    return rows.join(shared, "key").select("h", bit.cast("int").alias("bit")).groupBy("h").agg(F.bit_or("bit").alias("mask"))


def bounds(level: int) -> tuple[Column, Column]:
    """Where piece `p` of 2 ** level starts and stops; m is the length of the shorter line."""
    cut = lambda p: F.floor(F.col("m") * p / (1 << level)).cast("int")
    return cut(F.col("p")), cut(F.col("p") + 1)


def pieces(texts: DataFrame) -> DataFrame:
    """(h, g, first, line, n, kind, m, p): a row for each half of a line in which an edit may be, the other being shared."""
    of = lambda bit, kind, m, p: F.when(
        F.col("mask").bitwiseAND(bit) > 0, F.struct(F.lit(kind).alias("kind"), F.expr(m).alias("m"), F.lit(p).cast("long").alias("p"))
    )
    found = F.array(
        of(1, EQUAL, "n", 1), of(2, EQUAL, "n", 0), of(4, SHORTER, "n", 1), of(8, SHORTER, "n", 0), of(16, LONGER, "n - 1", 1), of(32, LONGER, "n - 1", 0)
    )
    return texts.select("h", "g", "first", "line", "n", F.inline(F.array_compact(found)))


def halved(live: DataFrame, level: int) -> DataFrame:
    """Each piece's two halves, those whose rest of the line is that of another line in the same role."""
    a, b = bounds(level)
    longer = (F.col("kind") == LONGER).cast("int")
    rest = [F.substring(F.col("line"), F.lit(1), a), F.substring(F.col("line"), b + longer + 1, F.col("n"))]
    key = F.xxhash64(F.col("kind") == EQUAL, F.col("m"), F.col("p"), *rest)
    halves = [live.withColumn("p", F.col("p") * 2 + side).withColumn("key", key) for side in (0, 1)]
    both = halves[0].union(halves[1])
    alike = F.when(F.col("kind") == EQUAL, F.col("h"))
    shared = both.groupBy("key").agg(F.min(alike).alias("x"), F.max(alike).alias("y"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    shared = shared.where(f"x <> y OR (low = {SHORTER} AND high = {LONGER})").select("key")
    return both.join(shared, "key", "left_semi").drop("key")


def narrowed(live: DataFrame, longest: int) -> list[tuple[int, DataFrame]]:
    """(level, pieces of it) once they are at most LAST characters long; each level is checkpointed."""
    out, level = [], 1
    while True:
        short = F.col("m") <= LAST * (1 << level)
        out.append((level, live.where(short)))
        if longest <= LAST * (1 << level):
            return out
        level += 1
        live = reliable(halved(live.where(~short), level))
        if live.isEmpty():
            return out


def without(i: Column) -> Column:
    """The line without its character at i (from 0)."""
    return F.concat(F.substring(F.col("line"), F.lit(1), i), F.substring(F.col("line"), i + 2, F.col("n")))


def variants(live: DataFrame, level: int) -> DataFrame:
    """(key, role, h, g, first): the deletions of each line in its pieces, and a shorter line itself."""
    a, b = bounds(level)
    kind = F.col("kind")
    at = F.when(kind == LONGER, F.sequence(a, b)).when(kind == SHORTER, F.array(F.lit(-1))).when(b > a, F.sequence(a, b - 1))
    i = F.col("i")
    key = F.when(kind == EQUAL, F.xxhash64(F.lit("S"), F.col("n"), i, without(i))).otherwise(F.xxhash64(F.lit("D"), F.when(kind == LONGER, without(i)).otherwise(F.col("line"))))
    return live.select("*", F.explode(at).alias("i")).select(key.alias("key"), kind.alias("role"), "h", "g", "first")


def near_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(h, g): lines that have an earlier line within one edit."""
    places = line_places(docs)
    wanted = maybe_broadcast(reliable(sharing_halves(places, shortest)), 24)
    texts = reliable(
        hashed(places)
        .join(wanted, "h")
        .groupBy("h", "g", "mask")
        .agg(F.min(F.struct("doc", "mark", "pos")).alias("first"), F.any_value("line").alias("line"))
        .withColumn("n", F.length("line"))
    )
    longest = texts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = None
    for level, live in narrowed(pieces(texts), longest):
        some = variants(live, level)
        rows = some if rows is None else rows.union(some)
    rows = rows.dropDuplicates(["key", "role", "h", "g"])
    who = F.struct(F.col("first"), F.col("h"), F.col("g"))
    earliest = rows.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, who)).alias(f"m{r}") for r in (EQUAL, SHORTER, LONGER)])
    partner = F.when(F.col("role") == EQUAL, F.col("m0")).when(F.col("role") == SHORTER, F.col("m2")).otherwise(F.col("m1"))
    pairs = (
        rows.join(earliest, "key")
        .withColumn("m", partner)
        .where(F.col("m.first") < F.col("first"))
        .groupBy("h", "g")
        .agg(F.min("m").alias("m"))
        .select("h", "g", F.col("m.h").alias("h2"), F.col("m.g").alias("g2"))
    )
    own = texts.select("h", "g", "line")
    other = texts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("line2"))
    return pairs.join(own, ["h", "g"]).join(other, ["h2", "g2"]).where(F.levenshtein("line", "line2", 1) >= 0).select("h", "g")


def dropped_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc, mark, gone): the numbers of the lines that each document loses, checkpointed."""
    places = hashed(line_places(docs)).drop("line")
    near = reliable(near_lines(docs, shortest).withColumn("near", F.lit(True)))
    place = F.struct("doc", "mark", "pos")
    repeated = places.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first").drop("last")
    losing = repeated.join(near, ["h", "g"], "full").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    losing = maybe_broadcast(reliable(losing), 56)
    gone = places.join(losing, ["h", "g"]).where(F.col("near") | (place > F.col("first")))
    return reliable(gone.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone")))


def drop_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """docs with `_kept`, the text without the lines that go, `_n_lines` and `_n_dropped`."""
    gone = dropped_lines(docs, shortest)
    entries = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    if 32 * gone.count() + 4 * entries <= 32 << 20:
        gone = F.broadcast(gone)  # counted just now; else a shuffle by document
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *told())
    split = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone"), lambda i: F.get(split, i))
    added = {
        "_kept": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "_n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)),
        "_n_dropped": F.coalesce(F.size("gone"), F.lit(0)),
    }
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return rows.join(gone, ["doc", "mark"], "left").select(*own, *[c.alias(name) for name, c in added.items()])
