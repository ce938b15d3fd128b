"""Registered queries for promises, rules, evidence, scores and QA."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import promises as pr, rules as op, scores as sc, semantic, sentences as sen, text
from stayline.plans import text_queries as tq, views as v

KEYS = ["video_id", "flag_id"]


def _shape(df):
    """Flags in comparable columns."""
    e = F.get("edits", F.lit(0))
    return df.select(
        "video_id", "start", "end", "severity", "category", F.round("risk_score", 4).alias("risk_score"), "title", "explanation",
        F.transform("evidence", lambda x: F.round(x["value_num"], 4)).alias("ev"),
        F.size("edits").alias("n_edits"), e["action"].alias("action"), F.round(e["start"], 4).alias("edit_start"), F.round(e["end"], 4).alias("edit_end"),
        e["reason"].alias("reason"))


def script_lines(spark, sf):
    """Script sentences with tokens and token buckets; the middle sentence is the video's title."""
    w = tq.words(spark, sf)
    s = text.sentence_features(sen.sentence_table(sen.sentences_with_words(w)))
    # buckets are a word's number each, a vector 2 KB a sentence
    s = s.select("video_id", "sent_idx", "start", "end", "text", "tokens", semantic.dims(F.col("tokens")).alias("dims")).persist()
    n = s.groupBy("video_id").agg(F.expr("count(1) div 2").cast("int").alias("mid"))
    mid = s.join(n, "video_id").where("sent_idx = mid")
    return s, mid.select("video_id", F.col("text").alias("title"), F.col("dims").alias("title_dims"))


def promise_check(spark, sf):
    s, titles = script_lines(spark, sf)
    return pr.promise_check(titles, s).drop("title")


def promise_ledger(spark, sf):
    s, titles = script_lines(spark, sf)
    out = pr.promise_ledger(s, pr.promise_check(titles, s))
    return out.select("video_id", "sent_idx", "source", "made_at", "made_end", "payoff_at", "similarity", "delay_s", "status")


def rule_slow_hook(spark, sf):
    return _shape(op.rule_slow_hook(v.seg_features(spark, sf), v.seg_words(spark, sf)))


def rule_late_promise(spark, sf):
    return _shape(op.rule_late_promise(v.seg_features(spark, sf), v.seg_checks(spark, sf), v.seg_sentences(spark, sf)))


def rule_repetition(spark, sf):
    return _shape(op.rule_repetition(v.seg_features(spark, sf), v.seg_checks(spark, sf)))


def rule_low_information(spark, sf):
    # the planted gains are spread evenly, so the video's own low level is the one that binds
    return _shape(op.rule_low_information(v.seg_features(spark, sf)))


def rule_pacing(spark, sf):
    return _shape(op.rule_pacing(v.seg_features(spark, sf)))


def rule_silence(spark, sf):
    return _shape(op.rule_silence(v.seg_features(spark, sf)))


def rule_static(spark, sf):
    return _shape(op.rule_static(v.seg_features(spark, sf)))


def rule_ledger(spark, sf):
    return _shape(op.rule_ledger(v.seg_ledger(spark, sf)))


def rule_model_only(spark, sf):
    return _shape(op.rule_model_only(v.seg_features(spark, sf), v.seg_flags(spark, sf)))


def flag_source(spark, sf):
    f = op.flag_source(v.seg_flags(spark, sf).drop("source"), v.seg_features(spark, sf), KEYS)
    return f.select(*KEYS, "source")


def snap_to_pause(spark, sf):
    pts = v.load(spark, sf, "events").select(
        F.expr("event_id div 50").alias("video_id"), F.expr("cast(event_id as string)").alias("point_id"), F.expr("(event_id * 37 % 6000) / 10D").alias("t"))
    return op.snap_to_pause(pts, v.seg_words(spark, sf)).select("video_id", "point_id", "t", F.round("snapped", 3).alias("snapped"))


def _added(df):
    """Evidence appended after the planted one."""
    return df.select(*KEYS, F.round("risk_score", 4).alias("risk_score"),
                     F.transform(F.slice("evidence", F.lit(2), F.size("evidence")), lambda e: e["label"]).alias("labels"),
                     F.transform(F.slice("evidence", F.lit(2), F.size("evidence")), lambda e: F.round(e["value_num"], 4)).alias("vals"),
                     F.get("edits", F.lit(0))["reason"].alias("reason"))


def _phrases(segs):
    return segs.where("kind = 'speech' and k % 4 < 2").select(
        "video_id", "idx", F.expr("concat('phrase ', k % 3)").alias("phrase"), F.expr("3 + k % 3").alias("count"), F.col("start").alias("at"), F.lit(1.0).alias("first_at"))


def delivery_evidence(spark, sf):
    segs = v.seg_features(spark, sf)
    return _added(op.delivery_evidence(v.seg_flags(spark, sf), segs, KEYS, _phrases(segs)))


def visual_evidence(spark, sf):
    return _added(op.visual_evidence(v.seg_flags(spark, sf), v.seg_features(spark, sf), KEYS))


def visual_compensation(spark, sf):
    return _added(op.visual_compensation(v.seg_flags(spark, sf), v.seg_features(spark, sf), KEYS))


def detect_flags(spark, sf):
    """Every rule together: numbered, sourced, snapped and with all evidence."""
    # placed by video once, for all rules' windows and joins; words, checks, sentences and ledger are made from them too
    segs = v.seg_features(spark, sf, placed=True).persist()
    words, checks = v.seg_words(spark, sf, segs), v.seg_checks(spark, sf, segs)
    found = [
        op.rule_slow_hook(segs, words), op.rule_late_promise(segs, checks, v.seg_sentences(spark, sf, segs)), op.rule_repetition(segs, checks),
        op.rule_low_information(segs), op.rule_pacing(segs), op.rule_silence(segs), op.rule_static(segs), op.rule_ledger(v.seg_ledger(spark, sf, segs)),
    ]
    out = op.assemble(segs, found, words, _phrases(segs))
    return out.select("video_id", "flag_id", "start", "end", "severity", "category", "source", "risk_score", "title", F.size("evidence").alias("n_evidence"),
                      F.transform("edits", lambda e: e["id"]).alias("edit_ids"))


def segment_scores(spark, sf):
    return sc.segment_scores(v.seg_features(spark, sf))


def flag_evidence_json(spark, sf):
    return sc.flag_evidence(v.seg_flags(spark, sf), v.seg_words(spark, sf)).select(*KEYS, "excerpt", "evidence_json")


def number_guard(spark, sf):
    """A written text per event against the numbers of its record."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = v.load(spark, sf, "events").select("event_id", "value", k.alias("k"))
    x = e.select(
        "event_id",
        F.expr("concat('{\"value\": ', cast(value as string), ', \"k\": ', k, '}')").alias("blob"),
        F.array(F.col("value"), F.col("k") / 100.0).alias("vals"),
        F.expr("concat('About ', cast(bround(value) as int), ' or ', k, '%, two of 3, at 1:', lpad(event_id % 60, 2, '0'), ' near ', event_id % 17, '.5 times')").alias("text"))
    return x.select("event_id", sc.new_numbers(F.col("text"), sc.allowed_numbers(F.col("blob"), F.col("vals"))).alias("new_numbers"))


def rewrite_gate(spark, sf):
    """Turns against a thinned version of themselves; some drop too much, some invent a number."""
    t = v.turns(spark, sf)
    words = F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "")
    kept = F.expr("array_join(filter(transform(w, (x, i) -> if(i % 10 < 4 + sent_idx * 2 % 7, x, null)), x -> x is not null), ' ')")
    x = t.select("video_id", "sent_idx", F.col("text").alias("original"), words.alias("w")).withColumn("_k", kept)
    x = x.withColumn("rewrite", F.expr("concat('00:', lpad(sent_idx, 2, '0'), ' - ', _k, if(sent_idx % 5 = 4, ' 42%', ''))"))
    out = sc.rewrite_gate(x.withColumn("words_per_second", F.lit(2.5)))
    return out.select("video_id", "sent_idx", "rewrite", "original_words", "rewrite_words", "meaning_similarity", "accepted", "est_seconds_saved", "rejected")


def report_rollup(spark, sf):
    segs = v.seg_features(spark, sf)
    x = sc.report_rollup(v.seg_flags(spark, sf), segs, sc.segment_scores(segs), v.seg_ledger(spark, sf), v.seg_points(spark, sf))
    return x.select("video_id", "segments", "fillers", "flags", "high_flags", "broken_promises",
                    *[F.round(F.round(c, 9), 4).alias(c) for c in ("pacing", "content", "visual", "audio", "end_retention", "end_lower", "end_upper")])


def display_order(spark, sf):
    return sc.display_order(v.seg_flags(spark, sf)).select("video_id", "flag_id", "place")


def flag_for_promise(spark, sf):
    x = pr.flag_for_promise(v.seg_ledger(spark, sf), v.seg_flags(spark, sf))
    return x.select("video_id", "made_at", "flag_id")


QUERIES = {
    f.__name__: f
    for f in (
        promise_check, promise_ledger, rule_slow_hook, rule_late_promise, rule_repetition, rule_low_information, rule_pacing,
        rule_silence, rule_static, rule_ledger, rule_model_only, flag_source, snap_to_pause, delivery_evidence, visual_evidence,
        visual_compensation, detect_flags, segment_scores, flag_evidence_json, number_guard, rewrite_gate, report_rollup,
        display_order, flag_for_promise,
    )
}
