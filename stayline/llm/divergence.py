"""Source divergence audit by count-cell ranking: how the words of a source differ from its language's.

Terms are the maximal runs of letters and characters beyond ASCII, with A-Z in lower case. Each language keeps the
V terms that at least `least` of its documents hold. In a (lang, source) group, and in a language, a kept term that
occurs `count` times has p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the count of all kept terms there.

Tasks read whole texts and count terms batch by batch, so rows of (lang, source, term) with a count and a number
of documents are all that is shuffled, dealt by language and term. What follows works on counts:

- `term`, the kept terms over-represented in a group: terms fall into cells of equal (group count, language count).
  f = |p - q| is evaluated once for each cell; cells of equal f merge, and their multiplicities, summed from the
  highest f on, tell which values reach the top. Only terms of these cells are expanded, in UTF-8 order.
- `pair`, the summed |p - q| of each two sources of a language: blocks of terms, and tiles of sources, become small
  dense matrices of p, and their partial sums are added. A task holds CELLS numbers or one term of two tiles.

All arithmetic is on whole numbers (decimals of 38 digits where products may pass 64 bits). Null text, lang and
source are ''. Every group that occurs is there, also without terms; a language without kept terms has pairs of
value 0. Each row is a document, whatever its doc_id. Texts of any length are read whole. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stayline.llm.common import reliable, slices

LEAST = 30
TOP = 50
#: added to each count, and the whole that shares are out of
ADDED, WHOLE = 5, 1_000_000_000
#: numbers in a block's matrix, and sources in a tile
CELLS = 2_000_000
TILE = 256
#: terms that a task counts before it passes them on
HELD = 200_000

#: bytes of a text in UTF-8: letters in lower case and bytes beyond ASCII stay, all else splits
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group, whole; and a row with a null term for each group."""

    def count(batches):
        n: dict = {}
        d: dict = {}

        def rows():
            for (lang, source), terms in n.items():
                held = d[lang, source]
                names = [None, *terms]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(names), pa.string()),
                        pa.array([source] * len(names), pa.string()),
                        pa.array(names, pa.binary()).cast(pa.string()),
                        pa.array([0, *terms.values()], pa.int64()),
                        pa.array([0, *(held[t] for t in terms)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for part in slices([batch], 100):
                texts = part.column("text").to_pylist()
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts):
                    key = (lang, source)
                    if key not in n:
                        n[key], d[key] = Counter(), Counter()
                    own = Counter(terms_of(text))
                    n[key].update(own)
                    d[key].update(own.keys())
                if sum(map(len, n.values())) > HELD:
                    yield from rows()
                    n, d = {}, {}
        yield from rows()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    got = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # dealt by language and term at once, so that the sums by source and by language need no other shuffle
    return got.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, total): the kept terms of each group, with the language's count; a null term for each group."""
    whole = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("total", F.sum("n").over(whole))
        .withColumn("held", F.sum("docs").over(whole))
        .where(F.col("term").isNull() | (F.col("held") >= least))
        .select("lang", "source", "term", "n", "total")
    )


def share(count: str, all_terms: str) -> Column:
    """p of a count; all_terms is N + 5 V."""
    return F.expr(f"1 + (CAST({WHOLE} AS decimal(38, 0)) * ({count} + {ADDED})) div {all_terms}")


def group_sums(kept: DataFrame) -> DataFrame:
    """(lang, source, sized, lang_sized, terms): N + 5 V of each group and of its language, and V."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.where("term IS NOT NULL").groupBy("lang", "term").agg(F.max("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("whole"))
    return groups.join(langs, "lang", "left").select(
        "lang", "source", F.expr(f"n + {ADDED} * coalesce(terms, 0)").alias("sized"), F.expr(f"coalesce(whole, 0) + {ADDED} * coalesce(terms, 0)").alias("lang_sized"), F.coalesce("terms", F.lit(0)).alias("terms")
    )


def top_terms(kept: DataFrame, sums: DataFrame, top: int) -> DataFrame:
    """The `term` part: (lang, source, item, value, rank)."""
    group = Window.partitionBy("lang", "source")
    seen = kept.where("term IS NOT NULL AND n > 0")
    cells = seen.groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("m"))
    p, q = share("n", "sized"), share("total", "lang_sized")
    valued = cells.join(sums, ["lang", "source"]).withColumn("value", p - q).where("value > 0").select("lang", "source", "n", "total", "m", "value")
    # no value below the `top` highest distinct ones can be reached
    values = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    values = values.withColumn("k", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("k") <= top)
    before = F.sum("m").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top).select("lang", "source", "value")
    reached = valued.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "total", "value")
    order = F.row_number().over(group.orderBy(F.desc("value"), "term"))
    return seen.join(reached, ["lang", "source", "n", "total"]).withColumn("rank", order).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def distances(ours: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Summed |p - q| of each two sources of one block; sources holds p of a count of 0, `base`, and tile numbers.

    Beside it the number of terms it is summed over (those that occur in the tiles), its value `gap` for a term
    that occurs in neither source, and the number of all kept terms.
    """
    names = sources["source"].tolist()
    place = {s: i for i, s in enumerate(names)}
    column = {t: i for i, t in enumerate(dict.fromkeys(ours["term"]))}
    base = sources["base"].to_numpy(np.int64)
    p = np.repeat(base[:, None], len(column), axis=1)
    at = ours["source"].map(place).to_numpy(np.int64), ours["term"].map(column).to_numpy(np.int64)
    p[at] = ours["p"].to_numpy(np.int64)
    tile, low, high = sources["tile"].to_numpy(), sources["low"].iloc[0], sources["high"].iloc[0]
    out = []
    for i in np.flatnonzero(tile == low).tolist():
        others = np.flatnonzero(tile == high)
        others = others[others > i] if low == high else others
        for j, d in zip(others.tolist(), np.abs(p[others] - p[i]).sum(1).tolist()):
            out.append((names[i], names[j], d, len(column), abs(int(base[i]) - int(base[j])), int(sources["terms"].iloc[0])))
    return pd.DataFrame(out, columns=["a", "b", "d", "met", "gap", "terms"])


def pair_sums(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, a, b, d): the summed difference of each two sources of a language with kept terms, once."""
    sized = sums.where("terms > 0").withColumn("base", share("0", "sized"))
    langs = sized.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    shaped = sized.join(langs, "lang").select(
        "lang", "source", "sized", "base", "terms",
        F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"),
        F.ceil(F.col("terms") * F.least("sources", F.lit(2 * TILE)) / CELLS).cast("int").alias("blocks"),
    )
    tile = F.pmod(F.xxhash64(F.lit("tile"), "source"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = shaped.withColumn("tile", tile).withColumn("other", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    ours = (
        kept.where("term IS NOT NULL AND n > 0")
        .join(tiled, ["lang", "source"])
        .withColumn("p", share("n", "sized"))
        .select("lang", F.pmod(F.xxhash64(F.lit("block"), "term"), F.col("blocks")).cast("int").alias("block"), "low", "high", "source", F.lit(0).alias("tile"), "term", "p", "terms")
    )
    # each source of a tile, with its p of a count of 0 and no term
    theirs = tiled.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "low", "high", "source", "tile", F.lit(None).cast("string").alias("term"), "base", "terms")

    def compare(key, rows):
        alone = rows["term"].isna()
        got = distances(rows[~alone], rows[alone].rename(columns={"p": "base"}).sort_values("source"))
        got.insert(0, "lang", key[0])
        return got

    schema = "lang string, a string, b string, d long, met long, gap long, terms long"
    found = ours.union(theirs).groupBy("lang", "block", "low", "high").applyInPandas(compare, schema)
    # terms that occur in no source of the two tiles are in no block of theirs
    whole = F.sum("d") + F.max("gap") * (F.max("terms") - F.sum("met"))
    return found.groupBy("lang", "a", "b").agg(whole.alias("d"))


def pair_ranks(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """The `pair` part: each other source of the language, all ranks."""
    found = pair_sums(kept, sums)
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "d").union(found.select("lang", "b", "a", "d"))
    # sources without kept terms in common have their sum as well; only languages without kept terms have none
    without = sums.where("terms = 0").select("lang", "source")
    zero = without.join(without.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("d"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.union(zero).withColumnRenamed("d", "value").withColumn("rank", order).select("lang", "source", "item", "value", "rank")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    kept = reliable(kept_counts(counted(docs), least))
    sums = reliable(group_sums(kept))
    parts = [("pair", pair_ranks(kept, sums)), ("term", top_terms(kept, sums, top))]
    each = [df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long"), F.col("rank").cast("int")) for name, df in parts]
    return each[0].union(each[1])
