"""The operators on small tables: nulls, empty and equal rows, clashing names, and brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("stayline.llm")
from stayline.llm import fingerprint, html, language, lines, mixing, near, packing, substrings, toxicity, vectors  # noqa: E402
from stayline.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, _kept string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i % 3 else "a", 0, i, "x") for i, t in enumerate(texts)], DOCS)


TEXTS = [None, "", "  \n ", "one two three four five six", "one two three four five six", "a line of some length here\nand one more", "a line of some length hers\nok", "x"]


def test_language(spark):
    rng = random.Random(1)
    make = lambda ws: " ".join(rng.choice(ws) for _ in range(30))
    kinds = {"en": ["the", "and", "thing", "with"], "de": ["und", "der", "nicht", "schön"], "fr": ["été", "les", "vous", "pas"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(list(kinds) * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.decode(model, [t for _, t, _ in rows] + ["", "123"])
    assert (got["lang_pred"][:-2] == [k for _, _, k in rows]).mean() > 0.95 and got["lang_pred"][-2:].tolist() == ["und", "und"]
    assert language.decode(model, ["the thing"] * 2)["score"].nunique() == 1
    alone = language.decode(model, ["the und été"])["score"][0]
    assert language.decode(model, ["zzz", "the und été", "q"])["score"][1] == pytest.approx(alone)
    assert language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))["names"] == []
    assert language.identify(docs(spark, TEXTS), model, "doc_id").count() == len(TEXTS)


def test_fingerprint(spark):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(spark, TEXTS)).collect()}
    assert got[3]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"] and got[0]["fingerprint"] == ""
    assert got[0]["near_edited"] == 1.0 and len(got[3]["fingerprint"]) == 256
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0


def test_substrings(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("ab c") for _ in range(400))
    texts = [base, "z" + base[100:190] + "y" * 130, base[:49], base, None, "", "é" * 60, base[150:260] + "é" * 60]
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, r in enumerate(raw):
        for s in range(len(r) - 49):
            first.setdefault(r[s : s + 50], i)
    got = {r["doc_id"]: r for r in substrings.drop_repeats(docs(spark, texts)).collect()}
    for i, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - 49):
            if first[r[s : s + 50]] < i:
                gone[s : s + 50] = True
        assert got[i]["n_removed"] == gone.sum() and got[i]["n_bytes"] == len(r)
    assert substrings.drop_repeats(docs(spark, [])).count() == 0


def test_cover_is_perfect():
    pairs = {(a - b) % substrings.COVER for a, b in itertools.product(substrings.COVER_SET, repeat=2)}
    assert pairs == set(range(substrings.COVER))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=8) * 0.05 * (i // 40)], i % 2) for i in range(120)]
    bad = [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, rows[0][1], None), (204, rows[0][1], 0), (205, [1.0], 0)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.float32(v).astype(float), k) for i, v, k in rows + bad[4:5]]
    for i, v, k in good:
        links = sum(k == m and i != j and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98 for j, w, m in good)
        assert got[i]["n_links"] == links
    assert got[204]["component_id"] == got[0]["component_id"] and all(got[i]["n_links"] == 0 for i in (200, 201, 202, 203, 205))


def test_toxicity():
    rng = random.Random(4)
    words = ["the", "thing", "and", "other", "stone", "river", "cloud", "paper"]
    text = lambda bad: ". ".join(" ".join(rng.choice(words) for _ in range(8)) + (" blockhead" if bad and k == 2 else "") for k in range(5))
    labels = [i % 4 == 0 for i in range(240)]
    model = toxicity.fit([text(b) for b in labels], labels)
    test = [text(b) for b in labels]
    got = toxicity.scores(model, test)
    assert ((got >= 0.3) == labels).mean() > 0.95
    assert toxicity.scores(model, [test[1] + " you b.l.o.c.k.h.e.a.d"])[0] >= 0.3
    assert toxicity.scores(model, ["", "1 2"]).max() < 0.3 and toxicity.scores(toxicity.fit([], []), ["x"])[0] == 0


def test_toxicity_training(spark):
    rng = random.Random(6)
    words = ["stone", "river", "cloud", "paper", "light"]
    text = lambda bad: " ".join(rng.choice(words) for _ in range(12)) + (" blockhead" if bad else "")
    rows = [(i, text(i % 3 == 0)) for i in range(150)] + [(200, None), (201, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, int(i % 3 == 0)) for i in range(150)] + [(200, 1), (201, 0), (7, None), (None, 1), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(table, model).collect()}
    assert len(got) == len(rows) and all((got[i] >= 0.3) == (i % 3 == 0) for i in range(150)) and got[200] == got[201]
    assert toxicity.train(table, labels.where("toxic = 1"))["slope"] == 0.0
    assert toxicity.train(table.limit(0), labels)["slope"] == 0.0 and toxicity.scored(table.limit(0), model).count() == 0


def test_html(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/x">{0}</a></li></ul></nav><article><h1>{1}</h1><p>{2} &amp; more<br>text<p>{3}</article><footer>&copy; {4}</footer>'
    rng = random.Random(5)
    fill = lambda: page.format(*[" ".join(rng.choice(["sun", "moon", "star", "sea"]) for _ in range(n)) for n in (1, 4, 20, 15, 5)])
    pages = [fill() for _ in range(60)]
    model = html.fit(pages)
    got = html.main_texts(model, [pages[0], "", "<script>var a='<p>no</p>'</script>"])
    want = "\n".join(t for path, t, _ in html.blocks_of(pages[0]) if html.by_rule(path))
    assert got == [want, "", ""] and "& more text" in got[0]
    rows = spark.createDataFrame([(1, None, None), (2, "u", pages[1]), (2, "u", pages[1])], "page_id long, url string, html string")
    assert html.extracted(rows, model).count() == 3


def test_html_without_the_end_of_its_head():
    for head in ("<head><title>t</title>", "<head><meta charset=x><script>1<2</script>", "<head><style>p{}</style><noscript><p>no</p></noscript>"):
        for body in ("<body><article><p>one</p></article>", "<div><p>one</p></div>", "<article>one</article>"):
            assert [t for _, t, _ in html.blocks_of(f"<html>{head}{body}")] == ["one"]
    assert [t for _, t, _ in html.blocks_of("<head><title>t</title></head><p>one")] == ["one"]
    rng = np.random.default_rng(1)
    long = list(range(1000))
    seen = {x for _ in range(60) for x in html.window(long, rng)}
    assert html.window(long[:400], rng) == long[:400] and len(html.window(long, rng)) == 400 and min(seen) < 50 and max(seen) > 950


def test_null_ids_are_marked(spark, tmp_path):
    from stayline.llm import queries

    rows = [(None, "the thing and with the", "en", "a", 1), (1, "the thing and with the", "en", "a", 1), (2, "und der nicht", "de", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op1_language_id, queries.op5_toxicity):
        assert {r["held_out"] for r in query(spark, str(tmp_path)).collect() if r["doc_id"] is None} == {False}
    assert all(r["kept"] is not None for r in queries.op8_minhash_near_dedup(spark, str(tmp_path)).collect())


def test_lines(spark):
    got = {r["doc_id"]: r for r in lines.drop_lines(docs(spark, TEXTS)).collect()}
    assert got[3]["_n_dropped"] == 0 and got[4]["_kept"] == "" and got[6]["_kept"] == "ok" and got[0]["_kept"] is None and got[2]["_n_dropped"] == 0
    assert lines.drop_lines(docs(spark, [])).count() == 0


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return any(a[k + x :] == b[k + y :] for x, y in ((1, 1), (1, 0), (0, 1)) if x <= len(a) - k and y <= len(b) - k) or a == b


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_all_pairs(spark, seed):
    """Edits at every place of lines of many lengths, shared halves without an edit, repeated and null ids."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abc ") for _ in range(n - 1)) + "x"
    base = [make(n) for n in (16, 17, 18, 19, 23, 31, 32, 33, 40, 64, 65, 100, 257, 15, 8)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randint(1, 7)):
            b = rng.choice(base)
            k = rng.randrange(len(b))
            far = b[: len(b) // 2] + make(len(b) - len(b) // 2)
            text.append(rng.choice([b, b[:k] + "Q" + b[k + 1 :], b[:k] + b[k + 1 :], b[:k] + "Z" + b[k:], far, "", "  ", make(rng.randint(1, 60))]))
        rows.append((rng.choice([i, i, i, None, 7]), "\n".join(text)))
    rows += [rows[0], (999, None), (1000, "")]
    order = lambda r: (r[0] is not None, r[0] or 0)
    places = {}
    for doc in set(rows):
        for n, line in enumerate((doc[1] or "").split("\n")):
            if line.strip():
                places.setdefault(line, []).append((*order(doc), doc, n))
    got = lines.drop_lines(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, doc int").repartition(3))
    kept = {}
    for r in got.collect():
        kept.setdefault((r["doc_id"], r["text"]), set()).add(r["_kept"])
    marks = {r["text"]: r["m"] for r in got.selectExpr("text", "xxhash64(text) AS m").collect()}
    key = lambda p: (p[0], p[1], marks[p[2][1]], p[3])
    first = {line: min(map(key, p)) for line, p in places.items()}
    for doc in set(rows):
        if doc[1] is None:
            assert kept[doc] == {None}
            continue
        want = []
        for n, line in enumerate(doc[1].split("\n")):
            here = (*order(doc), marks[doc[1]], n)
            near = any(first[o] < first[line] and len(o) >= 15 and len(line) >= 15 and max(len(o), len(line)) >= 16 and min(len(o), len(line)) >= 16 and within_one_edit(o, line) for o in first) if line.strip() else False
            if not line.strip() or not (here > first[line] or near):
                want.append(line)
        assert kept[doc] == {"\n".join(want)}


@pytest.mark.parametrize("texts", [["a", "b"], ["", "a b c"], [" a b", "c"], ["a"], [], ["", " "], ["a b c d", "e"], ["a b c d e", "f"], ["a b c d e f"]])
def test_shingles_of_few_words(texts):
    """Groups of texts with 0 to 6 words in all."""
    got = near.shingle_sets(texts)
    assert [len(s) for s in got] == [max(0, min(1, len(t.split())), len(t.split()) - 4) for t in texts]
    assert all((a == b).all() for a, b in zip(got, [near.shingle_sets([t])[0] for t in texts]))


def test_near(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = TEXTS + [" ".join(base)] + [" ".join(base[:k] + ["X"] + base[k + 1 :]) for k in range(0, 300, 30)] + [" ".join(base[:150])]
    sets = [set(re.findall(r"\S+", (t or "").lower())[i : i + 5].__str__() for i in range(max(1, len((t or "").split()) - 4)) if (t or "").split()) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    got = {r["doc_id"]: r["component_id"] for r in near.near_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == group
    assert near.near_classes(docs(spark, [])).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["", " x", "a  b\n\n c", "it's <|endoftext|> fine", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "Ünïcödé und so\nweiter ", "word " * 3000]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert packing.token_bytes(texts, tokenizer_path()) == want
    got = packing.pack(docs(spark, [*texts, None]), tokenizer_path()).collect()
    room = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room[r["sequence_id"]]
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048 and sum(room.values()) == sum(len(w) // 4 + 1 for w in want) + 1


@pytest.mark.parametrize("seed", range(15))
def test_plan_is_optimal(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(15, 60) for _ in range(10)), reverse=True)

    def bins(i, open_):
        if i == len(items):
            return len(open_)
        fits = [bins(i + 1, open_[:j] + [open_[j] + items[i]] + open_[j + 1 :]) for j in range(len(open_)) if open_[j] + items[i] <= 100 and open_[j] not in open_[:j]]
        return min([*fits, bins(i + 1, [*open_, items[i]])]) if len(open_) < 8 else min(fits or [99])

    fillings = packing.plan(Counter(items), 100)
    assert sum(n for _, n in fillings) == bins(0, []) and sum((Counter({s: n * f.count(s) for s in f}) for f, n in fillings), Counter()) == Counter(items)


def test_mixing(spark):
    shares = mixing.rounded_shares({"a": 5, "b": 3, "c": 0.1}, 100)
    done = Counter()
    for source, _, slot in mixing.round_of(shares):
        done[source] += 1
        assert all(abs(done[s] - shares[s] * (slot + 1) / 100) < 1 for s in shares)
    got = mixing.mix(docs(spark, TEXTS).drop("row", "_kept")).collect()
    assert len(got) == len(TEXTS) and len({(r["mix_slot"], r["mix_offset"]) for r in got}) == len(TEXTS)
    assert mixing.mix(docs(spark, [])).count() == 0
