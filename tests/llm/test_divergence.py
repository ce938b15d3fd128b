"""The divergence audit against plain counting with Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("stayline.llm")
from stayline.llm import divergence  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n long, term string, total long"


def terms(text):
    found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def by_hand(rows, least, top):
    docs = [(lang or "", source or "", Counter(terms(text))) for text, lang, source in rows]
    held, count, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, own in docs:
        held[lang].update(own.keys())
        whole[lang].update(own)
        count[lang, source].update(own)
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q = share(whole[lang])
        p = {s: share(c) for (of, s), c in count.items() if of == lang}
        for s in p:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def found(spark, rows, least, top):
    table = spark.createDataFrame([(1, t, lang, s, 7, "x", 3) for t, lang, s in rows], DOCS).repartition(5)
    return sorted(tuple(r) for r in divergence.divergence(table, least, top).collect())


def sample(seed, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "ÄÖ", "é", "zz", "ﬁ", "𝒜") for b in ("", "c", "Ü", "y9x", "q-r")]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, ""])
        rows.append((" ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 12))) + rng.choice([" 12", "\x00", "", "."]), lang, source))
    return rows + [(None, "en", "a"), ("", "fr", "a"), ("rare", "fr", "b"), (None, "it", "x"), ("solo", "pt", "x")]


@pytest.mark.parametrize("seed, least, top, held, cells, tile", [(1, 5, 50, 200_000, 2_000_000, 256), (2, 1, 3, 40, 60, 2), (3, 12, 2, 200_000, 7, 1), (4, 1000, 5, 10, 60, 2)])
def test_against_brute_force(spark, monkeypatch, seed, least, top, held, cells, tile):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = sample(seed)
    assert found(spark, rows, least, top) == by_hand(rows, least, top)


def test_equal_values_by_bytes(spark):
    """All terms of a source tie: the first in UTF-8 order are reported, from all tasks."""
    names = [f"t{a}{b}" for a in "abcdefghij" for b in "klmnopqrstéz"]
    rows = [(" ".join(names[i : i + 30]), "en", "a") for i in range(0, 120, 30)] + [("other words", "en", "b")] * 3
    assert found(spark, rows, 1, 50) == by_hand(rows, 1, 50)


def test_counts_past_64_bits(spark):
    """The share of a count that 10^9 carries past 64 bits."""
    got = spark.sql("SELECT 50000000000 AS n, 70000000000 AS sized").select(divergence.share("n", "sized").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (50_000_000_000 + 5) // 70_000_000_000


def test_nothing(spark):
    assert found(spark, [], 1, 5) == []
    assert found(spark, [(None, None, None)], 1, 5) == []
    assert found(spark, [("a b " * 300_000, None, "x"), ("a", None, "y")], 1, 5) == by_hand([("a b " * 300_000, None, "x"), ("a", None, "y")], 1, 5)
