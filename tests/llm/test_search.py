"""Ranked search against scores by definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("stayline.llm")
from stayline.llm import search  # noqa: E402

DOCS = "doc_id long, text string, item long, score long, rank int"
ITEMS = "item_id long, text string, item string"


def terms(text):
    found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def by_hand(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 100 - 75 + 75 * bag.total() * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, top=10):
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS).repartition(4)
    got = search.search(table, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS), top)
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()], key=repr)


def sample(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "ÄÖ", "7", "é", "zz") for b in range(12)]
    text = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, most)))
    docs = [(i, text(40)) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)] + [(None, docs[6][1]), (None, "Ab1"), (3, docs[3][1]), (3, "zz1 zz1"), (900, None), (901, " .,"), (902, text(4000))]
    items = [(i, text(25)) for i in range(50)] + [(2, "zz1 ZZ1 zz1 é3"), (2, "zz1 ZZ1 zz1 é3"), (None, "Ab1 Ab2"), (60, None), (61, ""), (62, "unheard"), (63, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"BLOCK": 7, "ITEMS": 3, "COLUMNS": 5}), (3, {"ITEM_BYTES": 4000, "BLOCK": 64})])
def test_against_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    docs, items = sample(seed)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in random.Random(4).sample(range(1000), 400)]
    assert found(spark, docs + [(5000, "x"), (5001, "y")], [(1, "words")], 5) == by_hand(docs + [(5000, "x"), (5001, "y")], [(1, "words")], 5)


def test_partial_sums_stay_exact():
    """Columns are cut where weights times the highest impact could pass 2^53; the sum of the parts is whole."""
    items = [Counter({b"a": 10**8, b"b": 10**9, b"c": 1}), Counter({b"b": 2})]
    vocabulary = {b"a": 0, b"b": 1, b"c": 2}
    ((numbers, parts),) = search.tiles_of(items, vocabulary, [20, 20, 20])
    assert list(numbers) == [0, 1] and len(parts) > 1
    assert all((m.sum(0) * 10**6 < 2**53).all() and len(set(w.tolist())) == len(w) for w, m in parts)
    assert sum(int(m[w.tolist().index(1), 0]) for w, m in parts if 1 in w) == 20 * 10**9
    assert sum(int(m.sum()) for _, m in parts) == 20 * (10**8 + 10**9 + 1 + 2)


def test_best_keeps_ties():
    rng = np.random.default_rng(5)
    for _ in range(50):
        scores, ids = rng.integers(0, 4, 40), rng.permutation(40)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0)[:7]
        assert [(-scores[k], ids[k]) for k in search.best(scores, ids, 7)] == want


def test_nothing(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, "")], [(1, "a"), (2, None)]) == []
    assert found(spark, [(1, "a")], [(1, "a")]) == by_hand([(1, "a")], [(1, "a")])
