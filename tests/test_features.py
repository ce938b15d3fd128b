"""The path from words to segment features against plain Python over the same sentences and segments."""

import hashlib
import random
from statistics import median

import numpy as np
import pytest

from stayline.operators import features as op, segments as seg, sentences as sen, text as txt

WORDS = "video_id string, word_idx int, text string, start double, end double, paragraph_break boolean, phrase_break boolean"


def speech(seed, n):
    """Words with sentence ends, gaps of many lengths, sentences said again, and questions."""
    rng = random.Random(seed)
    said, out, t = [], [], rng.choice([0.0, 7.0])
    while len(out) < n:
        if said and rng.random() < 0.3:
            line = rng.choice(said)
        else:
            line = [rng.choice("we see the kernel move um data two ways basically fast disk call system now".split()) for _ in range(rng.randint(2, 14))]
            said.append(line)
        for i, w in enumerate(line):
            last = i == len(line) - 1
            out.append((len(out), w + (rng.choice([".", "?", ""]) if last else ""), round(t, 3), round(t + 0.3, 3), False, False))
            t += 0.3 + rng.choice([0.0, 0.05, 0.1, 0.2]) + (rng.choice([0.1, 0.7, 1.6, 2.5, 6.0, 21.0]) if last else 0)
    return out


def vector(tokens):
    v = np.zeros(256)
    for t in tokens or [None]:
        v[0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 256] += 1
    return v / np.linalg.norm(v)


def near(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=1.01e-4)


@pytest.fixture(scope="module")
def made(spark):
    rows = [(v, *w) for k, v in enumerate(["a", "b", "c"]) for w in speech(k, (260, 90, 3)[k])]
    words = spark.createDataFrame(rows, WORDS)
    videos = spark.createDataFrame([(v, max(w[4] for w in rows if w[0] == v) + 9) for v in "abc"] + [("empty", 40.0)], "video_id string, duration_s double")
    got = op.text_features(words, videos)
    cut = sen.sentences_with_words(words)
    segs = sorted(seg.tile_segments(cut, videos).collect(), key=lambda r: (r["video_id"], r["idx"]))
    sents = sorted(txt.sentence_features(sen.sentence_table(cut)).collect(), key=lambda r: (r["video_id"], r["sent_idx"]))
    return rows, got, segs, sents


def test_every_segment_is_there(made):
    _, got, segs, _ = made
    assert sorted((r["video_id"], r["idx"]) for r in got.segments.collect()) == [(r["video_id"], r["idx"]) for r in segs]
    assert {r["video_id"] for r in segs} == {"a", "b", "c", "empty"}


@pytest.mark.parametrize("video", ["a", "b", "c", "empty"])
def test_against_plain_python(made, video):
    rows, got, segs, sents = made
    words = [w for w in rows if w[0] == video]
    segs, sents = [s for s in segs if s["video_id"] == video], [s for s in sents if s["video_id"] == video]
    out = {r["idx"]: r for r in got.segments.where(f"video_id = '{video}'").collect()}
    of_word = {w: s["sent_idx"] for s in sents for w in range(s["word_start"], s["word_end"])}
    vec = [vector(s["tokens"]) for s in sents]
    match = {}
    for b in sents:
        best = [(-round(float(vec[b["sent_idx"]] @ vec[a["sent_idx"]]), 9), a["sent_idx"]) for a in sents if a["eligible"] and b["eligible"] and a["sent_idx"] < b["sent_idx"] and a["end"] <= b["start"] - 20]
        if best and -min(best)[0] >= 0.527:
            match[b["sent_idx"]] = min(best)
    spoken = [s for s in segs if s["kind"] == "speech"]
    emb = [vector([t for w in s["text"].lower().split() if (t := w.strip(".?"))]) for s in spoken]
    wps = [(s["word_end"] - s["word_start"]) / (s["end"] - s["start"]) for s in spoken]
    base = median(wps) if wps else None
    for s in segs:
        r = out[s["idx"]]
        mine = [x for x in sents if s["word_start"] < x["word_end"] <= s["word_end"]]
        n = s["word_end"] - s["word_start"]
        assert r["word_count"] == n and r["question_count"] == sum(x["is_question"] for x in mine) and r["claim_count"] == sum(x["has_claim"] for x in mine)
        assert list(r["fillers"]) == [f for x in mine for f in x["fillers"]] and near(r["filler_ratio"], len(r["fillers"]) / n if n else None)
        assert near(r["question_density"], r["question_count"] / len(mine) if mine else None)
        assert near(r["repeated_sentence_ratio"], sum(of_word[w] in match for w in range(s["word_start"], s["word_end"])) / n if n else None)
        held = sorted((round(match[i][0], 4), i) for i in (s["sentence_ids"] or []) if i in match)
        assert [m["sentence"] for m in r["repetition_matches"]] == [i for _, i in held][:3]
        assert [m["matched_sentence"] for m in r["repetition_matches"]] == [match[i][1] for _, i in held][:3]
        inside = words[s["word_start"] : s["word_end"]]
        gaps = [(b[3] - a[4], a[4]) for a, b in zip(inside, inside[1:]) if b[3] > a[4]]
        assert near(r["longest_pause_s"], max(gaps)[0] if gaps else 0.0 if n > 1 else None)
        assert r["long_pause_count"] == sum(g >= 1.5 for g, _ in gaps)
        if s["kind"] != "speech":
            assert all(r[c] is None for c in ("pace_ratio", "semantic_novelty", "information_gain", "repetition_similarity", "topic_shift", "repetition_match_segment"))
            assert r["repetition_count"] == 0 and r["topic_boundary"] is False
            continue
        k = [x["idx"] for x in spoken].index(s["idx"])
        assert near(r["pace_ratio"], wps[k] / base)
        assert near(r["semantic_novelty"], 1 - max(float(emb[k] @ e) for e in emb[:k]) if k else None)
        assert near(r["topic_shift"], 1 - float(emb[k] @ emb[k - 1]) if k else None)
        context = [emb[j] for j in range(k) if spoken[j]["end"] > s["start"] - 60]
        center = np.mean(context, axis=0) if context else None
        assert near(r["information_gain"], 1 - float(emb[k] @ center) / np.linalg.norm(center) if context else None)
        before = [(-round(float(emb[k] @ emb[j]), 9), j) for j in range(k) if spoken[j]["end"] <= s["start"] - 20]
        assert near(r["repetition_similarity"], -min(before)[0] if before else None)
        assert r["repetition_match_segment"] == (spoken[min(before)[1]]["idx"] if before else None)
        assert r["repetition_count"] == sum(-x >= 0.527 for x, _ in before)


def test_topics_and_header(made):
    _, got, segs, _ = made
    sections = sorted(got.topics.collect(), key=lambda r: (r["video_id"], r["topic"]))
    starts = {(r["video_id"], r["idx"]) for r in got.segments.where("topic_boundary").collect()}
    assert {(r["video_id"], r["first_segment"]) for r in sections if r["topic"]} == starts
    for v in ("a", "b", "c", "empty"):
        mine = [r for r in sections if r["video_id"] == v]
        last = max(s["idx"] for s in segs if s["video_id"] == v)
        assert mine[0]["first_segment"] == 0 and mine[-1]["last_segment"] == last and mine[0]["start"] == 0
    header = {r["video_id"]: r for r in got.videos.collect()}
    assert header["empty"]["baseline_words_per_second"] is None and header["a"]["timing_source"] == "recognised"


def test_estimated_times_have_no_pauses(spark):
    words = spark.createDataFrame([("a", *w) for w in speech(5, 60)], WORDS)
    got = op.text_features(words, timed=False).segments.collect()
    assert got and all(r["longest_pause_s"] is None and r["longest_pause_at"] is None and r["long_pause_count"] == 0 for r in got)
