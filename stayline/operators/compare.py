"""Signals of a video's opening, comparison of two versions, and corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.textcols import words_of
from stayline.functions.timeline import mmss

# Fixed values
HOOK_S = 30.0
MINUTE_S = 60.0
PROMISE_RANK = {"kept": 3, "late": 2, "open": 1, "none": 0}
UNCERTAIN = "difference smaller than the model's uncertainty"


def interp_at(points: DataFrame, t: float, cols: tuple[str, ...] = ("retention", "lower", "upper")) -> DataFrame:
    """(video_id, cols): the curve at ``t`` by linear interpolation, held at its end and start."""
    row = F.struct("t", *cols)
    per = points.groupBy("video_id").agg(
        F.max(F.when(F.col("t") <= t, row)).alias("a"), F.min(F.when(F.col("t") >= t, row)).alias("b"))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    share = F.when(b["t"] > a["t"], (t - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
    return per.select("video_id", *[(a[c] + (b[c] - a[c]) * share).alias(c) for c in cols])


def hook_signals(points: DataFrame, segs: DataFrame, check: DataFrame, ledger: DataFrame, flags: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """One row per video: curve at 0:30 and 1:00 with bands, title time, fillers, pace, promise,
    problems in the first minute; with ``cuts`` (video_id, cuts array) also dead air and scene cuts."""
    def at(t: float, name: str) -> DataFrame:
        p = interp_at(points, t)
        return p.select("video_id", *[F.col(c).alias(f"{name}_{c}") for c in ("retention", "lower", "upper")])

    hook = (F.col("start") < HOOK_S) & (F.col("kind") == "speech")
    quiet = F.when((F.col("kind") == "silence") & (F.col("start") < HOOK_S), F.least("end", F.lit(HOOK_S)) - F.col("start"))
    per = segs.groupBy("video_id").agg(
        F.coalesce(F.sum(F.when(hook, F.col("filler_count"))), F.lit(0)).alias("fillers"),
        F.bround(F.avg(F.when(hook, F.col("pace_ratio"))), 3).alias("pace"),
        F.bround(F.coalesce(F.sum(quiet), F.lit(0.0)), 1).alias("_quiet"),
    )
    made = ledger.where((F.col("source") == "intro") & (F.col("made_at") < HOOK_S)).groupBy("video_id").agg(F.min_by("status", "sent_idx").alias("_st"))
    problems = flags.where((F.col("start") < MINUTE_S) & (F.col("category") != "model_risk")).groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    x = per.join(at(HOOK_S, "r30"), "video_id").join(at(MINUTE_S, "r60"), "video_id")
    x = x.join(check.select("video_id", F.col("first_mention_s").alias("title_at")), "video_id", "left")
    x = x.join(made, "video_id", "left").join(problems, "video_id", "left")
    out = ["video_id", *[f"r{m}_{c}" for m in (30, 60) for c in ("retention", "lower", "upper")], "title_at", "fillers", "pace",
           F.coalesce("_st", F.lit("none")).alias("promise"), F.coalesce("_n", F.lit(0)).alias("flags60")]
    if cuts is None:
        return x.select(*out, F.lit(None).cast("double").alias("dead_air"), F.lit(None).cast("int").alias("cuts"))
    x = x.join(cuts.select("video_id", "cuts"), "video_id", "left")
    n = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < HOOK_S))
    return x.select(*out, F.col("_quiet").alias("dead_air"), n.alias("cuts"))


def _winner(a: Column, b: Column, better: str, tol) -> Column:
    first = (a < b) if better == "lower" else (a > b)
    same = (a == b) | (F.abs(a - b) <= tol)
    return F.when(a.isNull() | b.isNull(), "n/a").when(same, "tie").when(first, "a").otherwise("b")


def ab_compare(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """(pair_id, key, a, b, better, winner, note): seven to nine signals per pair of versions.
    ``pairs``: pair_id, a, b (video ids). Curves differ only beyond half the narrower band."""
    x = pairs
    for side in ("a", "b"):
        s = signals.select(F.col("video_id").alias(side), F.struct(*[c for c in signals.columns if c != "video_id"]).alias(f"s{side}"))
        x = x.join(s, side)
    a, b = F.col("sa"), F.col("sb")
    never = F.lit(float("inf"))
    rank = F.create_map(*[F.lit(z) for kv in PROMISE_RANK.items() for z in kv])

    def num(c: Column) -> Column:
        return c.cast("double").cast("string")

    def metric(key: str, va: Column, vb: Column, better: str, winner: Column, shown: Column | None = None, note: Column | None = None) -> Column:
        row = F.struct(F.lit(key).alias("key"), va.alias("a"), vb.alias("b"), F.lit(better).alias("better"), winner.alias("winner"),
                       (note if note is not None else F.lit(None)).cast("string").alias("note"))
        return row if shown is None else F.when(shown, row)

    def curve(m: str) -> Column:
        va, vb = a[f"{m}_retention"], b[f"{m}_retention"]
        tol = F.least(a[f"{m}_upper"] - a[f"{m}_lower"], b[f"{m}_upper"] - b[f"{m}_lower"]) / 2
        w = _winner(va, vb, "higher", tol)
        return metric(m, num(F.bround(va, 3)), num(F.bround(vb, 3)), "higher", w, note=F.when(w == "tie", UNCERTAIN))

    def plain(key: str, better: str, tol: float, shown: Column | None = None) -> Column:
        return metric(key, num(a[key]), num(b[key]), better, _winner(a[key], b[key], better, tol), shown)

    title = _winner(F.coalesce(a["title_at"], never), F.coalesce(b["title_at"], never), "lower", 2.0)
    both = lambda k: a[k].isNotNull() & b[k].isNotNull()
    metrics = F.array_compact(F.array(
        curve("r30"), curve("r60"),
        metric("title_at", num(F.bround(a["title_at"], 1)), num(F.bround(b["title_at"], 1)), "lower", title),
        plain("fillers", "lower", 0.0), plain("pace", "higher", 0.05),
        metric("promise", a["promise"], b["promise"], "higher", _winner(rank[a["promise"]], rank[b["promise"]], "higher", 0.0)),
        plain("dead_air", "lower", 1.0, both("dead_air")), plain("cuts", "higher", 0.0, both("cuts")),
        plain("flags60", "lower", 0.0),
    ))
    return x.select("pair_id", F.posexplode(metrics).alias("pos", "m")).select("pair_id", "pos", "m.*")


def ab_summary(metrics: DataFrame, name_a: str = "Version A", name_b: str = "Version B") -> DataFrame:
    """(pair_id, wins_a, wins_b, summary): who leads on how many signals."""
    per = metrics.groupBy("pair_id").agg(
        F.count_if(F.col("winner") == "a").alias("wins_a"), F.count_if(F.col("winner") == "b").alias("wins_b"), F.count(F.lit(1)).alias("n"),
        F.bool_and(F.when(F.col("key").isin("r30", "r60"), F.col("winner") == "tie")).alias("same"))
    a_leads = F.col("wins_a") > F.col("wins_b")
    lead = F.format_string(
        "%s leads on %d of %d signals (the other leads on %d).", F.when(a_leads, name_a).otherwise(name_b),
        F.greatest("wins_a", "wins_b"), F.col("n"), F.least("wins_a", "wins_b"))
    text = F.when(F.col("wins_a") == F.col("wins_b"), "No clear winner: the versions trade off; see each signal.").otherwise(lead)
    tail = F.when(F.col("same"), " The predicted curves are within the model's uncertainty of each other.").otherwise("")
    return per.select("pair_id", "wins_a", "wins_b", F.concat(text, tail).alias("summary"))


def corpus_summary(segs: DataFrame, points: DataFrame, check: DataFrame, words: DataFrame) -> DataFrame:
    """One line of facts per video: length, words, segments, final retention with range, when the
    title is addressed, and the high-risk segment starts."""
    per = segs.groupBy("video_id").agg(
        F.max("duration_s").alias("duration_s"), F.count(F.lit(1)).alias("segments"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("risk") == "high", F.col("start")))), mmss), ", ").alias("_high"))
    n = words.groupBy("video_id").agg(F.count(F.lit(1)).alias("words"))
    end = points.groupBy("video_id").agg(F.max_by(F.struct("retention", "lower", "upper"), "t").alias("e"))
    x = per.join(n, "video_id", "left").join(end, "video_id", "left").join(check, "video_id", "left")

    def pct(c: Column) -> Column:
        return F.concat(F.bround(c * 100).cast("long").cast("string"), F.lit("%"))

    said = F.when(F.size(words_of(F.col("title"))) < 3, "skipped").otherwise(F.coalesce(mmss(F.col("first_mention_s")), F.lit("never")))
    return x.select(
        "video_id", F.bround(F.col("duration_s") / 60, 1).alias("minutes"), F.coalesce("words", F.lit(0)).alias("words"), "segments",
        pct(F.col("e.retention")).alias("end_retention"), F.concat(pct(F.col("e.lower")), F.lit("–"), pct(F.col("e.upper"))).alias("end_range"),
        said.alias("title_addressed"), F.when(F.col("_high") == "", "none").otherwise(F.col("_high")).alias("high_risk"))


def flag_table(flags: DataFrame) -> DataFrame:
    """(video_id, flag_id, time, severity, title, source, suggested): the flag list of a summary."""
    reasons = F.array_join(F.transform("edits", lambda e: e["reason"]), "; ")
    return flags.select(
        "video_id", "flag_id", F.concat(mmss(F.col("start")), F.lit("–"), mmss(F.col("end"))).alias("time"), "severity", "title", "source",
        F.when(F.size("edits") > 0, reasons).otherwise("review").alias("suggested"))
