"""Repetition, novelty and topics over unit vectors.

"Best earlier item" operators compare each item with every earlier one of its video. Items are cut
into blocks of ``BLOCK`` positions; one task gets one pair of blocks and multiplies two matrices,
so no item pair is ever a row, and a very long timeline spreads over many tasks. A usual video is
a single block: its vectors are shuffled once, and a task takes its videos one after the other
from the sorted rows, without a group for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from stayline.functions.arrays import spread

# Fixed values
BLOCK = 512
HASH_DIM = 256
MIN_GAP_S = 20.0
MATCH_THRESHOLD = 0.527
CONTEXT_S = 60.0
TOPIC_BLOCK = 2
TOPIC_STD_K = 0.5
TOPIC_DEPTH_MIN = 0.02
TOPIC_SECTION_S = 30.0
MAX_MATCHES = 3
DIGITS = 9  # similarities are compared at this precision, so equal ones tie on every engine
CHUNK_S = 600.0


def dims(toks: Column) -> Column:
    """Each token's bucket: first 32 bits of MD5 modulo the dimension. The dimension divides 2 ** 8, so the last 8 of them do."""
    return F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 7, 2), 16, 10).cast("int") % HASH_DIM)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit_counts(buckets: pd.Series) -> pd.Series:
    def one(b):
        v = np.bincount(np.asarray(b, dtype=np.int64), minlength=HASH_DIM).astype(np.float64)
        if len(b) == 0:
            v[0] = 1.0
        return v / np.sqrt(v @ v)

    return buckets.map(one)


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    """Rows of unit vectors, from dense arrays or from token buckets."""
    if kind == "emb":
        return np.stack(column)
    held = [np.asarray(b if len(b) else [0], dtype=np.int64) for b in column]
    cells = np.concatenate(held) + np.repeat(np.arange(len(held)) * HASH_DIM, [len(b) for b in held])
    out = np.bincount(cells, minlength=len(held) * HASH_DIM).reshape(-1, HASH_DIM).astype(np.float64)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _earlier(left: tuple, right: tuple, gap_s: float | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each left item: best similarity (NaN if none), its place on the right (-1), and how many reach the threshold.
    A side is (idx, start, end, eligible, vectors) in order of idx."""
    sims = np.round(left[4] @ right[4].T, DIGITS)
    ok = (right[0][None, :] < left[0][:, None]) & right[3][None, :] & left[3][:, None]
    if gap_s is not None:
        ok &= right[2][None, :] <= left[1][:, None] - gap_s
    masked = np.where(ok, sims, -np.inf)
    at, has = masked.argmax(axis=1), ok.any(axis=1)
    return np.where(has, masked.max(axis=1), np.nan), np.where(has, at, -1), (masked >= threshold).sum(axis=1)


def complete(batches, keys: list[str]):
    """From batches of rows sorted by ``keys``: frames of whole groups, many at a time, and where each group starts."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True) if rest is None else pd.concat([rest, pdf], ignore_index=True)
        fresh = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        cuts = np.flatnonzero(fresh).tolist()
        rest = pdf[cuts[-1] :].reset_index(drop=True)  # may go on in the next batch
        if len(cuts) > 1:
            yield pdf[: cuts[-1]], cuts
    if rest is not None:
        yield rest, [0, len(rest)]


def _side(pdf: pd.DataFrame, vectors: np.ndarray) -> tuple:
    return pdf["idx"].to_numpy(), pdf["start"].to_numpy(), pdf["end"].to_numpy(), pdf["eligible"].to_numpy(bool), vectors


def _found(pdf: pd.DataFrame, idx: np.ndarray, got: tuple) -> pd.DataFrame:
    sim, at, n = got
    match = np.where(at >= 0, idx[np.maximum(at, 0)], 0)
    none = at < 0
    out = pd.DataFrame({"video_id": pdf["video_id"], "idx": pdf["idx"], "sim": sim.astype(object), "match": match.astype(object), "n_similar": n})
    out.loc[none, ["sim", "match"]] = None
    return out


def hash_embed(toks: Column) -> Column:
    """Hashed bag of words as a dense unit vector; no tokens gives the first axis."""
    return _unit_counts(dims(toks))


def hash_embed_sparse(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys, dim, w): the same vector as sparse rows."""
    b = F.when(F.size(tokens) > 0, dims(F.col(tokens))).otherwise(F.array(F.lit(0)))
    per = df.select(*keys, F.explode(b).alias("dim")).groupBy(*keys, "dim").agg(F.count(F.lit(1)).alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.partitionBy(*keys)))
    return per.select(*keys, "dim", (F.col("c") / norm).alias("w"))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Dot product of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


@F.pandas_udf(T.DoubleType())
def _bucket_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    parts = [(_matrix(a[i : i + BLOCK], "dims") * _matrix(b[i : i + BLOCK], "dims")).sum(axis=1) for i in range(0, len(a), BLOCK)]
    return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")


def likeness(df: DataFrame, a: str, b: str) -> Column:
    """Cosine of two columns of ``df``: unit vectors, or the token buckets they are hashed from."""
    return _bucket_cosine(a, b) if dict(df.dtypes)[a] == "array<int>" else cosine(a, b)


def best_earlier(
    items: DataFrame, gap_s: float | None = None, threshold: float = MATCH_THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(video_id, idx, sim, match, n_similar): for each eligible item the most similar eligible
    earlier item (``gap_s``: it must have ended that long before), earliest on ties, and how many
    reach the threshold. ``items``: video_id, idx (position), start, end, eligible and ``emb``, or
    ``dims`` (token buckets): then the hashed vectors are built where they are compared."""
    vec = "dims" if "dims" in items.columns else "emb"
    x = items.select("video_id", "idx", "start", "end", "eligible", vec).withColumn("_b", F.floor(F.col("idx") / block).cast("int"))
    x = x.withColumn("_top", F.max("_b").over(W.partitionBy("video_id")))
    schema = f"video_id {items.schema['video_id'].dataType.simpleString()}, idx int, sim double, match int, n_similar long"

    # videos of one block: as they lie, video by video in the order of a partition
    def whole(batches):
        for pdf, cuts in complete(batches, ["video_id"]):
            vectors = _matrix(pdf[vec], vec)
            idx, start, end, eligible, _ = _side(pdf, vectors)
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                side = idx[a:b], start[a:b], end[a:b], eligible[a:b], vectors[a:b]
                sim, at, n = _earlier(side, side, gap_s, threshold)
                parts.append((sim, np.where(at >= 0, at + a, -1), n))
            yield _found(pdf, idx, tuple(np.concatenate(p) for p in zip(*parts)))

    small = x.where("_top = 0").drop("_b", "_top").sortWithinPartitions("video_id", "idx").mapInPandas(whole, schema)

    # longer ones: each pair of blocks is a group; grouping alone would leave all pairs of a video in one task
    pairs = F.expr(
        "concat(transform(sequence(0, _b), q -> named_struct('p', _b, 'q', q)),"
        "if(_top > _b, transform(sequence(_b + 1, _top), p -> named_struct('p', p, 'q', _b)), array()))"
    )
    sent = x.where("_top > 0").select("*", F.inline(pairs).alias("_p", "_q")).drop("_top").repartition("video_id", "_p", "_q")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        vectors = _matrix(pdf[vec], vec)
        p, q = (pdf["_b"] == pdf["_p"].iat[0]).to_numpy(), (pdf["_b"] == pdf["_q"].iat[0]).to_numpy()
        right = _side(pdf[q], vectors[q])
        if not q.any():
            nothing = np.full(p.sum(), np.nan), np.full(p.sum(), -1), np.zeros(p.sum(), np.int64)
            return _found(pdf[p], np.zeros(1, np.int64), nothing)
        return _found(pdf[p], right[0], _earlier(_side(pdf[p], vectors[p]), right, gap_s, threshold))

    found = sent.groupBy("video_id", "_p", "_q").applyInPandas(pair, schema)
    best = F.max(F.when(F.col("sim").isNotNull(), F.struct("sim", (-F.col("match")).alias("m"))))
    long = found.groupBy("video_id", "idx").agg(best.alias("_x"), F.sum("n_similar").alias("n_similar")).select(
        "video_id", "idx", F.col("_x.sim").alias("sim"), (-F.col("_x.m")).alias("match"), "n_similar"
    )
    return small.unionByName(long)


def segment_repetition(items: DataFrame, gap_s: float = MIN_GAP_S, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    return best_earlier(items.withColumn("eligible", F.lit(True)), gap_s, threshold)


def sentence_matches(items: DataFrame, gap_s: float = MIN_GAP_S, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Sentences with a match at or above the threshold."""
    # the others can neither match nor be matched, so they are not shuffled
    return best_earlier(items.where("eligible"), gap_s, threshold).where(F.col("sim") >= threshold).select("video_id", "idx", "match", "sim")


def novelty(items: DataFrame) -> DataFrame:
    """1 - similarity to the closest earlier item; NULL for the first."""
    best = best_earlier(items.withColumn("eligible", F.lit(True)))
    return best.select("video_id", "idx", (1 - F.col("sim")).alias("novelty"))


def information_gain(items: DataFrame, window_s: float = CONTEXT_S, chunk_s: float = CHUNK_S) -> DataFrame:
    """1 - cosine to the centroid of the earlier items that reach into the last ``window_s``.
    Groups are chunks of the timeline plus the items just before them."""
    own = F.floor(F.col("start") / chunk_s).cast("int")
    reach = F.floor((F.col("end") + window_s) / chunk_s).cast("int")
    x = items.select("video_id", "idx", "start", "end", "emb", own.alias("_own"), F.explode(F.sequence(own, F.greatest(own, reach))).alias("_chunk"))
    video_type = items.schema["video_id"].dataType.simpleString()

    def gain(batches):
        for pdf, cuts in complete(batches, ["video_id", "_chunk"]):
            emb, start, end = np.stack(pdf["emb"]).astype(np.float64), pdf["start"].to_numpy(), pdf["end"].to_numpy()
            out = np.full(len(pdf), np.nan)
            for a, b in zip(cuts, cuts[1:]):
                near = np.tril(end[None, a:b] > start[a:b, None] - window_s, -1)
                n = near.sum(axis=1)
                center = near.astype(np.float64) @ emb[a:b] / np.maximum(n, 1)[:, None]
                size = np.linalg.norm(center, axis=1)
                out[a:b] = np.where(n > 0, 1 - (emb[a:b] * center).sum(axis=1) / np.where(size > 0, size, 1.0), np.nan)
            rows = pd.DataFrame({"video_id": pdf["video_id"], "idx": pdf["idx"], "information_gain": np.where(np.isnan(out), None, out)})
            yield rows[(pdf["_own"] == pdf["_chunk"]).to_numpy()]

    # rows of a video's chunk lie together and in order; a task takes chunk after chunk
    placed = x.repartition("video_id", "_chunk").sortWithinPartitions("video_id", "_chunk", "idx")
    return placed.mapInPandas(gain, f"video_id {video_type}, idx int, information_gain double")


def topic_shift(items: DataFrame) -> DataFrame:
    prev = F.lag("emb").over(W.partitionBy("video_id").orderBy("idx"))
    return items.withColumn("_prev", prev).select(
        "video_id", "idx", (1 - cosine("emb", "_prev")).alias("topic_shift")
    )


def _add(vectors: list[Column]) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.when(v.isNull(), out).otherwise(F.zip_with(out, v, lambda a, b: a + b))
    return out


def topic_depths(items: DataFrame, block: int = TOPIC_BLOCK) -> DataFrame:
    """(video_id, idx, start, gap, depth, is_minimum) for every boundary before item idx >= 1.

    ``gap`` is the similarity of the blocks on both sides. ``depth`` sums how far the gap lies
    below the peaks reached by climbing left and right while the similarity does not fall: the
    left peak starts the non-increasing stretch a boundary is in, the right peak ends the
    non-decreasing one. Adjacent vectors only, so a window row carries 2 * block vectors."""
    order = W.partitionBy("video_id").orderBy("idx")
    wide = items.withColumn("emb", F.transform("emb", lambda x: x.cast("double")))
    left = _add([F.lag("emb", k).over(order) for k in range(1, block + 1)])
    right = _add([F.col("emb")] + [F.lead("emb", k).over(order) for k in range(1, block)])
    x = wide.select("video_id", "idx", "start", F.min("start").over(W.partitionBy("video_id")).alias("first_start"),
                    F.count(F.lit(1)).over(W.partitionBy("video_id")).alias("n"), left.alias("l"), right.alias("r"))
    size = F.sqrt(cosine("l", "l")) * F.sqrt(cosine("r", "r"))
    x = x.where(F.col("l").isNotNull() & (F.col("n") >= 3)).select(
        "video_id", "idx", "start", "first_start",
        F.round(F.coalesce(F.try_divide(cosine("l", "r"), F.nullif(size, F.lit(0.0))), F.lit(0.0)), DIGITS).alias("gap"),
    )
    prev, nxt = F.lag("gap").over(order), F.lead("gap").over(order)
    x = x.withColumns({"_prev": prev, "_next": nxt})
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns(
        {
            "_fall": F.sum(F.when(F.col("_prev") < F.col("gap"), 1).otherwise(0)).over(upto),
            "_rise": F.sum(F.when(F.col("_prev") > F.col("gap"), 1).otherwise(0)).over(upto),
        }
    )
    left_peak = F.first("gap").over(W.partitionBy("video_id", "_fall").orderBy("idx"))
    right_peak = F.first("gap").over(W.partitionBy("video_id", "_rise").orderBy(F.desc("idx")))
    low = F.coalesce(F.col("gap") <= F.col("_prev"), F.lit(True)) & F.coalesce(F.col("gap") <= F.col("_next"), F.lit(True))
    return x.select(
        "video_id", "idx", "start", "first_start", "gap",
        F.round(left_peak + right_peak - 2 * F.col("gap"), DIGITS).alias("depth"), low.alias("is_minimum"),
    )


def topic_boundaries(items: DataFrame, section_s: float = TOPIC_SECTION_S) -> DataFrame:
    """(video_id, idx) where a new topic starts: deep minima, strongest first, spaced apart and
    away from the start. The spacing choice folds over one video's candidates."""
    low = topic_depths(items).where("is_minimum")
    whole = W.partitionBy("video_id")
    cut = F.greatest(F.lit(TOPIC_DEPTH_MIN), F.avg("depth").over(whole) + TOPIC_STD_K * F.stddev_pop("depth").over(whole))
    strong = low.withColumn("_cut", cut).where(
        (F.col("depth") >= F.col("_cut")) & (F.col("start") - F.col("first_start") >= section_s)
    )
    ranked = strong.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "idx", "start"))).alias("c")
    )
    kept = F.expr(
        "aggregate(c, cast(array() as array<struct<idx:int,start:double>>), (acc, x) -> "
        f"if(exists(acc, k -> abs(k.start - x.start) < {section_s}D), acc, array_append(acc, named_struct('idx', x.idx, 'start', x.start))))"
    )
    return spread(ranked, kept, "k", "video_id").select("video_id", F.col("k.idx").alias("idx"))


def topic_sections(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(video_id, topic, start, end, first_segment, last_segment) over all segments."""
    b = boundaries.select("video_id", "idx", F.lit(1).alias("_b"))
    upto = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    x = segments.join(b, ["video_id", "idx"], "left").withColumn("topic", F.coalesce(F.sum("_b").over(upto), F.lit(0)).cast("int"))
    return x.groupBy("video_id", "topic").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("idx").alias("first_segment"), F.max("idx").alias("last_segment"),
    )


def repeated_sentences(segment_words: DataFrame, sentences: DataFrame, matches: DataFrame) -> DataFrame:
    """As repeated_by_counts; ``segment_words`` has (video_id, idx, sent_idx) per word."""
    per = segment_words.groupBy("video_id", "idx", "sent_idx").agg(F.count(F.lit(1)).alias("n"))
    return repeated_by_counts(per, sentences, matches)


def repeated_by_counts(per: DataFrame, sentences: DataFrame, matches: DataFrame) -> DataFrame:
    """Per segment: share of its words in matched sentences and its strongest matches. ``per`` has
    (video_id, idx, sent_idx, n): a segment's words of a sentence; ``matches`` is by sentence."""
    m = matches.select("video_id", F.col("idx").alias("sent_idx"), "match", "sim")
    times = sentences.select("video_id", F.col("sent_idx"), "start", "end")
    m = m.join(times, ["video_id", "sent_idx"]).join(
        times.select("video_id", F.col("sent_idx").alias("match"), F.col("start").alias("matched_start"), F.col("end").alias("matched_end")),
        ["video_id", "match"],
    )
    hit = F.struct(
        (-F.bround("sim", 4)).alias("neg"), "sent_idx", "start", "end", F.col("match").alias("matched_sentence"), "matched_start", "matched_end"
    )
    x = per.join(m, ["video_id", "sent_idx"], "left").groupBy("video_id", "idx").agg(
        F.bround(F.sum(F.when(F.col("sim").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("repeated_sentence_ratio"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("sim").isNotNull(), hit))), 1, MAX_MATCHES).alias("_m"),
    )
    return x.select(
        "video_id", "idx", "repeated_sentence_ratio",
        F.transform(
            "_m",
            lambda h: F.struct(h["sent_idx"].alias("sentence"), h["start"].alias("start"), h["end"].alias("end"), h["matched_sentence"].alias("matched_sentence"),
                               h["matched_start"].alias("matched_start"), h["matched_end"].alias("matched_end"), (-h["neg"]).alias("similarity")),
        ).alias("repetition_matches"),
    )


def model_features(segments: DataFrame) -> DataFrame:
    """The 17 model columns per segment. Missing stays NULL. ``segments`` carries the video's
    duration, kind, topic_boundary and the text features."""
    order = W.partitionBy("video_id").orderBy("idx")
    past, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    # mean of each non-null value and its two non-null predecessors, carried to the next rows
    for name in ("semantic_novelty", "information_gain"):
        known = W.partitionBy("video_id", F.col(name).isNull()).orderBy("idx").rowsBetween(-2, 0)
        segments = segments.withColumn(f"_{name}_3", F.when(F.col(name).isNotNull(), F.avg(name).over(known)))

    def recent(name: str) -> Column:
        return F.last(f"_{name}_3", ignorenulls=True).over(past)

    topic_start = F.coalesce(F.last(F.when(F.col("topic_boundary"), F.col("start")), ignorenulls=True).over(upto), F.lit(0.0))
    return segments.select(
        "video_id", "idx",
        (F.col("start") / F.col("duration_s")).alias("rel_start"),
        (F.col("end") / F.col("duration_s")).alias("rel_end"),
        F.log1p("start").alias("log_start_s"),
        (F.col("end") - F.col("start")).alias("seg_duration_s"),
        (F.col("idx") == 0).cast("double").alias("is_first"),
        (F.col("kind") == "silence").cast("double").alias("is_silence"),
        "pace_ratio", "semantic_novelty", "information_gain", "repetition_similarity", "repeated_sentence_ratio",
        F.col("repetition_count").cast("double").alias("repetition_count"),
        "topic_shift", F.col("topic_boundary").cast("double").alias("topic_boundary"),
        recent("semantic_novelty").alias("novelty_prev3_mean"),
        recent("information_gain").alias("gain_prev3_mean"),
        (F.col("start") - topic_start).alias("s_since_topic_start"),
    )
