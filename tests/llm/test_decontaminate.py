"""Decontamination against brute force over every window of every item."""

import random
import re

import pytest

pytest.importorskip("stayline.llm")
from stayline.llm import common, decontaminate  # noqa: E402

DOCS = "doc_id long, text string, words string, key long, items string"
ITEMS = "item_id long, text string, size int, words string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def by_hand(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        mine, hit, named, spans = words(text), set(), set(), set()
        for item_id, said in items:
            ws = words(said)
            size = min(window, len(ws))
            for i in range(len(ws) - size + 1 if ws else 0):
                for at in range(len(mine) - size + 1):
                    if mine[at : at + size] == ws[i : i + size]:
                        hit |= set(range(at, at + size))
                        spans.add((at, at + size))
                        named |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id is None, doc_id or 0, len(mine), len(hit), sorted(named), sorted(spans)))
    return sorted(out)


def found(spark, docs, items, window=10):
    table = spark.createDataFrame([(i, t, "x", 1, None) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    got = decontaminate.contamination(table, bench, window).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in got)


def planted(seed):
    rng = random.Random(seed)
    fill = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    few, many = ["the", "of", "A", "Ä1"], [f"w{i}" for i in range(300)]
    items = [(i, fill(rng.randint(1, 25), many)) for i in range(12)] + [(20, fill(30, few)), (21, "the the the the the"), (22, "Of"), (3, "one more text of the same item"), (None, fill(12, many)), (30, None), (31, " ,.!"), (32, fill(14, many).upper())]
    items += [items[0], (40, items[1][1])]
    docs = []
    for i in range(60):
        parts = [fill(rng.randint(0, 30), many)]
        for _ in range(rng.randint(0, 3)):
            ws = words(rng.choice(items)[1]) or [""]
            a = rng.randint(0, max(0, len(ws) - 10))
            parts += [" - ".join(ws[a : a + rng.randint(8, 14)]), fill(rng.randint(0, 4), many)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(None, items[2][1]), (None, "x"), (5, None), (5, ""), (7, docs[7][1]), (7, docs[7][1]), (7, "another text " + items[4][1]), (90, "the " * 40), (91, fill(400, few))]
    return docs, items


@pytest.mark.parametrize("seed, limit", [(1, None), (2, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, limit):
    if limit:
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)  # several blocks of shingles and windows
    docs, items = planted(seed)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_small_window(spark):
    docs, items = planted(3)
    assert found(spark, docs, items, 3) == by_hand(docs, items, 3)


def test_nothing(spark):
    assert found(spark, [], [(1, "a b c")]) == []
    docs = [(1, "A b, c"), (2, None), (None, "")]
    assert found(spark, docs, []) == found(spark, docs, [(1, None), (2, "...")]) == by_hand(docs, [])


def test_a_long_text(spark):
    text = "filler words here " * 100_000
    item = "a benchmark passage of more than ten words that stands in it once"
    docs = [(1, text + item + " " + text), (2, text)]
    got = found(spark, docs, [(1, item)])
    assert [(r[2], r[3], r[4]) for r in got] == [(600_013, 13, ["1"]), (300_000, 0, [])]
