"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations alone.

Each source's documents, in md5 order, are cut into blocks. With a share of a/q, block j of a source
is released at slot floor(j q / a) and due before slot ceil((j + 1) q / a); the earliest deadline among
released blocks takes each slot. Releases and deadlines repeat after q slots, so the order of one round
of q slots, a bounded table, places every block: slot = round * q + slot in the round. While no source has
run out, each has had its share of the slots so far to less than one block. Slots of a source that has run
out stay empty; no document is dropped.

Null and equal ids, sources and texts: a null source is a source of its own, equal rows are placed each on
its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import spread_rank

BLOCK = 8
ROUND = 1000
#: weights when none are given: proportional to the number of documents to this power
POWER = 0.5
PLACE = ["mix_slot", "mix_offset"]


def rounded_shares(weights: dict, q: int) -> dict:
    """Whole shares of q slots, at least one each, by largest remainder; ties by name."""
    names = sorted(weights)
    total, free = sum(weights[n] for n in names), q - len(names)
    exact = {n: weights[n] * free / total for n in names}
    got = {n: 1 + math.floor(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: (math.floor(exact[n]) - exact[n], n))[: q - sum(got.values())]:
        got[n] += 1
    return got


def round_of(shares: dict) -> list[tuple]:
    """(source, block in round, slot) of one round: earliest deadline among released blocks, ties by name."""
    q, had, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for slot in range(q):
        ready = [n for n, a in shares.items() if had[n] < a and had[n] * q // a <= slot]
        n = min(ready, key=lambda n: (-(-(had[n] + 1) * q // shares[n]), n))
        out.append((n, had[n], slot))
        had[n] += 1
    return out


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, q: int = ROUND) -> DataFrame:
    """docs with `mix_slot` and `mix_offset` (place in the block); ordering by both gives the mixture.

    `weights` maps sources (None for null) to positive numbers and must name every source that occurs.
    The number of sources is assumed to fit the driver (one row each is counted there).
    """
    spark = docs.sparkSession
    named = docs.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    sizes = {r["_source"]: r["n"] for r in named.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        given = {s: n**POWER for s, n in sizes.items()}
    else:
        given = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
        given = {s: given[s] for s in sizes}
    q = max(q, 10 * len(given))
    shares = rounded_shares(given, q) if given else {}
    slots = spark.createDataFrame(
        [(s, shares[s], k, t) for s, k, t in round_of(shares)] if shares else [], "_source string, _a long, _k long, _t long"
    )
    each = spark.createDataFrame(list(shares.items()), "_source string, _a long")
    ranked = spread_rank(named, "_source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.floor(F.col("_rank") / F.lit(block))
    return (
        ranked.join(F.broadcast(each), "_source")  # at most one row a source, counted above
        .withColumn("_k", number % F.col("_a"))
        .join(F.broadcast(slots.drop("_a")), ["_source", "_k"])  # q rows
        .withColumn("mix_slot", (number - F.col("_k")) / F.col("_a") * F.lit(q) + F.col("_t"))
        .withColumn("mix_slot", F.col("mix_slot").cast("long"))
        .withColumn("mix_offset", (F.col("_rank") % block).cast("int"))
        .drop("_source", "_a", "_k", "_t", "_rank")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents in mixed order (range partitions in slot order, sorted inside), with `mix_slot` and `mix_offset`."""
    return mix(docs, **how).orderBy(*PLACE)
