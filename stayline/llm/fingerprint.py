"""Document fingerprints by one-permutation MinHash, with DataFrame operations alone.

Each 5-word shingle is hashed once; the top byte of the hash is its bin, and a bin keeps its least hash. An
empty bin takes the value of another: it probes hashed bins, the same for all documents, until it meets a full
one (after PROBES attempts, the full bin that comes first in a hashed order of its own), so each empty bin
chooses among the full ones at random and equally for documents alike. The low 4 bits of each of the 256
values are packed into 16 numbers, 256 hex digits as text. The share of equal digits, corrected for digits that
agree by chance, estimates the similarity of the shingle sets.

Words are split at blanks of the text in lower case; fewer than five make one shingle. Null texts are empty;
without a word the fingerprint is an empty string, alike to another empty one (1) and to nothing else (0).
Equal texts have equal fingerprints. Whole texts are read, of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayline.llm.common import BLANKS

BINS, DIGITS = 256, 16
PROBES = 16
WORDS = 5
LOW = (1 << 56) - 1
#: ranges of ids inside which the next document is looked up; each is one sort
MOST_RANGES = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingles(text: Column) -> Column:
    """Hashes of the shingles of a text, repeated ones included."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= WORDS, each).otherwise(short)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    """16 numbers of 16 digits of 4 bits; an empty array if the text has no word."""
    # a bin's greatest hash, in the order of signed numbers, marks it as empty if nothing comes before it
    marks = F.array(*[F.lit(((b - 128) << 56) | LOW) for b in range(BINS)])
    empty = lambda v: v.bitwiseAND(F.lit(LOW)) == LOW
    bin_of = lambda v: F.shiftright(v, 56)

    def packed(d: Column, full: Column) -> Column:
        def probed(j: Column) -> Column:
            tries = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda t: F.get(d, F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int")))
            first = F.get(F.filter(tries, lambda v: ~empty(v)), 0)
            order = F.transform(full, lambda k: F.struct(F.xxhash64(j, F.lit(-1), k).alias("o"), F.get(d, k).alias("v")))
            return F.coalesce(first, F.array_min(order)["v"])

        digit = F.transform(d, lambda v, j: F.xxhash64(F.when(empty(v), probed(j)).otherwise(v), j).bitwiseAND(F.lit(15).cast("long")))
        place = lambda x, k: F.reduce(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 4).bitwiseOR(F.get(x, k * 16 + i)))
        return let(digit, lambda x: F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda k: place(x, k)))

    def dense(hashes: Column) -> Column:
        ordered = F.array_sort(F.concat(hashes, marks))
        least = lambda s: F.filter(s, lambda v, i: (i == 0) | (bin_of(v) != bin_of(F.get(s, i - 1))))
        indexed = lambda d: F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: ~empty(F.get(d, k)))
        got = let(ordered, lambda s: let(least(s), lambda d: let(indexed(d), lambda full: packed(d, full))))
        return F.when(F.size(hashes) > 0, got).otherwise(F.array().cast("array<bigint>"))

    return let(shingles(text), dense)


def likeness(a: Column, b: Column) -> Column:
    """Similarity estimated from two fingerprints."""
    ones = F.lit(0x1111111111111111)

    def equal_digits(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.lit(16) - F.bit_count(z.bitwiseAND(ones))

    same = F.reduce(F.zip_with(a, b, equal_digits), F.lit(0), lambda acc, k: acc + k.cast("int")) / F.lit(float(BINS))
    chance = 1.0 / DIGITS
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))
    both = (F.size(a) > 0).cast("int") + (F.size(b) > 0).cast("int")
    return F.when(both == 2, estimate).when(both == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def as_text(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """Derived docs with `_next`, a struct of the carried (some derived) columns of the row next in descending doc_id; the first follows the last.

    Ids are cut into ranges by approximate quantiles; each range is sorted on its own, and its last row takes the
    first row of the range below it (one row a range). Rows with equal ids follow in the order of a hash.
    """
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    cuts = keyed.agg(F.percentile_approx("_id", [(i + 1) / ranges for i in range(ranges - 1)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    low = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_id"))) if cuts else F.lit(0)
    keyed = keyed.withColumn("_range", low)
    rest = F.struct(*carried)
    inside = Window.partitionBy("_range").orderBy(F.desc("_id"), F.xxhash64("text"))
    ids = keyed.groupBy("_range").agg(F.max("_id").alias("_id"))  # a row a range
    heads = (
        keyed.join(F.broadcast(ids), ["_range", "_id"])
        .groupBy("_range")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    heads = derive(heads).select("_range", rest.alias("_head"))
    down = Window.orderBy(F.desc("_range"))  # at most MOST_RANGES rows
    top = heads.agg(F.max_by("_head", "_range").alias("_top"))
    below = heads.withColumn("_below", F.lead("_head").over(down)).crossJoin(F.broadcast(top)).select("_range", F.coalesce("_below", "_top").alias("_below"))
    return (
        derive(keyed).withColumn("_next", F.lead(rest).over(inside))
        .join(below, "_range")
        .withColumn("_next", F.coalesce("_next", "_below"))
        .drop("_id", "_range", "_below")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); see the contract of op2."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    derive = lambda df: df.withColumn("fp", fingerprint(F.col("text")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next.text"), F.lit(1), cut))
    got = with_next(own, derive, ["text", "fp"]).select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("_next.fp").alias("next_fp"), edited.alias("edited"))
    got = got.withColumn("edited_fp", fingerprint(F.col("edited")))
    return got.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
