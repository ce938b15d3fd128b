"""The pipeline's stages against brute force: what an earlier stage decides must show in the result."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("stayline.llm")
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from stayline.llm import mixing, near, packing  # noqa: E402
from stayline.llm.queries import tokenizer_path  # noqa: E402
from tests.conftest import SMALL  # noqa: E402


def mixed_by_hand(rows):
    """Rows in the order of mixing: blocks of each source put one by one on their slots."""
    sources = defaultdict(list)
    for r in rows:
        sources["n" if r["source"] is None else f"s{r['source']}"].append(r)
    shares = mixing.rounded_shares({s: len(x) ** mixing.POWER for s, x in sources.items()}, mixing.ROUND)
    turn = mixing.round_of(shares)
    left = {s: sorted(x, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()) for s, x in sources.items()}
    out = []
    while any(left.values()):
        for s, _, _ in turn:
            out += left[s][: mixing.BLOCK]
            left[s] = left[s][mixing.BLOCK :]
    return out


def packed_by_hand(rows):
    """{(doc_id, piece): (sequence, offset)} of rows in order: piece by piece into the next filling that wants its length."""
    raw = packing.token_bytes([r["text"] or "" for r in rows], tokenizer_path())
    waiting = defaultdict(list)
    for n, (r, ids) in enumerate(zip(rows, raw)):
        for k, (_, length) in enumerate(packing.cut_pieces(len(ids) // 4 + 1, packing.CAPACITY)):
            waiting[length].append((n, k, r["doc_id"]))
    sequences = []
    for filling, times in packing.spread(packing.plan({s: len(x) for s, x in waiting.items()})):
        for _ in range(times):
            sequences.append([(waiting[s].pop(0), s) for s in sorted(filling, reverse=True)])
    out = {}
    for i, sequence in enumerate(sorted(sequences, key=lambda s: min(p for p, _ in s))):
        at = 0
        for (_, k, doc), size in sequence:
            out[doc, k] = i, at
            at += size
    return out


def test_mixing_decides_the_packing(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        if name == "mixing":
            kept = docs.collect()
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    rows = kept or spark.read.parquet(f"{tmp_path}/near_dedup").collect()
    got = {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in docs.collect()}
    assert got == packed_by_hand(mixed_by_hand(rows))


def test_sequences_follow_the_order(spark):
    """Three of four in the order are of one source, whatever the lengths: so are three of four in any run of sequences."""
    rows = [(n, "word " * (90 if n % 7 else 400), "a" if n % 4 else "b") for n in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "text", "source")
    got = packing.pack(table, tokenizer_path(), order=F.col("doc_id")).collect()
    assert len(got) == 1200 and sorted({r["sequence_id"] for r in got}) == list(range(max(r["sequence_id"] for r in got) + 1))
    seen = Counter()
    for i, r in enumerate(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), 1):
        seen[rows[r["doc_id"]][2]] += 1
        assert abs(seen["a"] - 0.75 * i) < 12
        assert abs(r["doc_id"] - i) < 120
    plain = {r["sequence_id"] for r in packing.pack(table, tokenizer_path()).collect()}
    assert len(plain) == len({r["sequence_id"] for r in got})


def test_near_copies_from_80(spark):
    """Pairs of similarity 0.80 to 0.85 go from the pipeline and stay in op8; below 0.80 they stay in both."""
    rng = random.Random(8)
    rows, low = [], []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        edits = [20, 45, 70, 95] if i % 2 else [20, 45, 70, 95, 120]  # 5 shingles each: 180 of 220, 175 of 225
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join("X" if k in edits else w for k, w in enumerate(base)))]
        low += [] if i % 2 else [2 * i + 1]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, table, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(0, 120, 2), *low])
    assert near.near_classes(table).where("doc_id <> component_id").count() == 0


def test_language_is_read_from_the_row(spark):
    """A document's text goes to Python once, inside its row, with the same predictions as beside it."""
    from stayline.llm import language
    from stayline.llm.common import with_row

    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en")] * 30)], "doc_id long, text string, lang string")
    model = language.train(docs)
    inside = language.identify(with_row(docs), model, "row").select("row.*", "lang_pred", "score")
    beside = language.identify(docs, model, "doc_id", "text", "lang").select("doc_id", "text", "lang", "lang_pred", "score")
    assert sorted(map(str, inside.collect())) == sorted(map(str, beside.collect()))
