"""Phrases, line rules and whitening against brute force and on odd tables."""

import collections
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import line_rules, phrases, queries, whitening

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b c d e f g"), (None, None), (4, long), (5, long), (6, "one two"), (7, "one two"), (7, "one two"), (8, "x" * 30000), (9, "12 34 !!"), (10, "a\x0bb\x0cc.d;e\rf"), (11, "\n".join(["ab cd ef"] * 60))]
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3, "y", "z") for i, t in rows], DOC + ", a int, word string, chars int, n int, host string, words string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def same_as_sql(spark, name, data=DATA):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    df = queries.queries()[name](spark, data)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def mined(rows, least, longest, percent, top):
    """Collocations of (text, lang) with dictionaries and whole numbers of any size."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] < percent * a:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place = collections.Counter()
    ranked = []
    for r in out:
        place[r[0]] += 1
        if place[r[0]] <= top:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return ranked


@pytest.mark.parametrize("least, longest, percent, top, most", [(3, 5, 100, 2000, 1_000_000), (3, 4, 80, 7, 150), (12, 2, 100, 2000, 40)])
def test_phrases_equal_brute_force(spark, least, longest, percent, top, most):
    rng = np.random.default_rng(5)
    vocabulary = [*"abcdefgh", "Über", "x'y", "ß", "日", "été"]
    marks = [" ", " ", " ", "\t", ". ", ", ", "\n", "  "]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.integers(0, 120))) for _ in range(60)]
    texts += ["new york city hall door step"] * 13 + ["NEW York city"] * 4 + [None, "", "...", " "]
    rows = [(t, str(rng.choice(["en", "fr"])) if i % 9 else None) for i, t in enumerate(texts)]
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5), least, longest, percent, top, most)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(mined(rows, least, longest, percent, top))


def test_phrases_do_not_depend_on_blocks(spark, monkeypatch):
    text = pa.array(["ab cd. ef gh, " * 30, None, "", "x " * 90])
    whole = [np.concatenate(x) for x in list(zip(*phrases.words(text)))[3:]]
    from ledgerflow.llm import shingles

    monkeypatch.setattr(shingles, "BLOCK", 37)
    parts = [np.concatenate(x) for x in list(zip(*phrases.words(text)))[3:]]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_double_array_finds_all_and_only_its_phrases():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(1, 60, (400, k)).astype(np.uint64), axis=0) for k in (2, 3, 5)]
    trie = phrases.double_array(parts)
    flat = [tuple(r) for p in parts for r in p.tolist()]
    names = {tuple(r): i for i, r in enumerate(flat)}
    text = rng.integers(0, 70, 5000).astype(np.uint64)
    got = trie.counts(text)
    want = collections.Counter(tuple(text[i : i + k].tolist()) for k in (2, 3, 5) for i in range(len(text) - k + 1))
    assert {int(trie.row[s]): int(got[s]) for s in np.flatnonzero(got) if trie.row[s] >= 0} == {names[w]: c for w, c in want.items() if w in names}


def test_phrases_of_one_word_alphabet_and_large_fans():
    star = np.array([[1, i] for i in range(1, 3000)] + [[i, 1] for i in range(2, 3000)], np.uint64)
    trie = phrases.double_array([np.unique(star, axis=0)])
    assert (trie.row >= 0).sum() == len(star) and len(trie.check) < 8 * len(star)


def test_phrases_on_odd_rows(odd, empty):
    assert phrases.collocations(empty).count() == 0
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd, 10).collect())) == sorted(mined(rows, 10, 5, 100, 2000))


def test_op11_and_op12_equal_sql(spark):
    same_as_sql(spark, "op11_phrases")
    same_as_sql(spark, "op12_line_frequency")


def judged(rows, most, permille, left):
    lines_of = lambda t: [x for x in (re.sub("[0-9]+", "0", y.lower()).strip(" \t\x0b\x0c\r") for y in (t or "").split("\n")) if x]
    hosts = collections.defaultdict(set)
    for _, text, host in rows:
        if lines_of(text):
            hosts[host or ""].add(text)
    counts = {h: collections.Counter(x for t in texts for x in set(lines_of(t))) for h, texts in hosts.items()}
    out = []
    for i, text, host in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        exact = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        limit = max(most, len(hosts[host or ""]) * permille // 1000)
        chars = sum(map(len, lines_of(text)))
        gone = sum(len(x) for x in lines_of(text) if counts[host or ""][x] > limit)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(exact) - len(set(exact)), len(again), failed, chars, gone, not failed and 100 * (chars - gone) >= left * chars))
    return out


def odd_texts():
    rng = np.random.default_rng(8)
    banner = ["Copyright 2024 | All rights", "Home > News", "Seite 7 & mehr"]
    texts = []
    for i in range(120):
        own = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(rng.integers(3, 30))) for _ in range(rng.integers(0, 6))]
        texts.append("\n".join([*banner[: rng.integers(0, 4)], *own, *own[: rng.integers(0, 2)]]))
    texts += ["a b c " * 40, "x y z " + " ".join(map(str, range(100))) + " x y z", None, "", " \n ", " ".join(["dup"] * 51), texts[0], texts[0]]
    return [(None if k % 37 == 5 else k, t, None if k % 11 == 3 else f"h{k % 3}") for k, t in enumerate(texts)]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("few", [32, 0])
def test_line_rules_equal_brute_force(spark, monkeypatch, broadcast, few):
    monkeypatch.setattr(line_rules, "FEW", few)
    rows = odd_texts()
    got = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), most=5, permille=10, broadcast_bytes=broadcast)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, judged(rows, 5, 10, 30)))


def test_line_rules_reject_depleted_and_keep_clean(spark):
    banner = "\n".join(f"navigation entry number {i} of this site" for i in range(12))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(60))
    rows = [(k, banner + "\n" + own(k)[:40], "a") for k in range(60)] + [(100 + k, banner + "\n" + own(k), "a") for k in range(3)] + [(200 + k, own(7), "b") for k in range(80)]
    got = {r.doc_id: r.kept for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(60)) and all(got[100 + k] for k in range(3)) and all(got[200 + k] for k in range(80))


def test_line_rules_on_odd_rows(odd, empty):
    assert line_rules.judge(empty).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, line_rules.judge(odd).collect()))) == sorted(map(repr, judged(rows, 20, 10, 30)))


def test_line_rules_run_no_python(spark):
    plan = line_rules.measured(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def whole(rows):
    return [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in r] for r in rows]


def test_whitening_equals_exact_covariance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 9)) @ np.diag([30, 9, 4, 2, 1, 1, 0.5, 0.2, 0.1]) @ rng.normal(size=(9, 9)) + 5
    vectors = [*base.tolist(), base[0].tolist(), base[0].tolist()]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [None] + [0.0] * 8), (902, [float("nan")] + [0.0] * 8), (903, [float("inf")] + [1.0] * 8), (904, [1.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).toPandas()
    x = whole(vectors)
    n, d = len(x), 9
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[float(sum(Fraction((n * r[i] - s[i]) * (n * r[j] - s[j])) for r in x) / n**3) for j in range(d)] for i in range(d)])
    e = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == n * d and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert np.allclose(model.values, e, rtol=1e-10) and np.allclose(v @ model.components, model.components * model.values, atol=1e-9 * e[0])
    assert np.allclose(sorted(set(got.explained), reverse=True), e / np.trace(v), rtol=1e-9)
    deviation = {i: sum((n * c - t) ** 2 for c, t in zip(r, s)) for i, r in enumerate(x)}
    assert dict(zip(got.vec_id, got.deviation)) == deviation
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(d)).max() < 1e-9


def test_jacobi_is_accurate_for_graded_values():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    a = (q * np.logspace(8, 0, 12)) @ q.T
    g = whitening.triangular_factor((a + a.T) / 2)
    assert np.allclose(g @ g.T, a, rtol=1e-12, atol=1e-4)
    turned = whitening.orthogonal_columns(g)
    assert np.allclose((turned * turned).sum(0), np.logspace(8, 0, 12), rtol=1e-6)
    unit = turned / np.sqrt((turned * turned).sum(0))
    assert np.abs(unit.T @ unit - np.eye(12)).max() < 1e-12


def test_whitening_of_low_rank_large_and_no_rows(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (None, [2.0, 4.0, 6.0]), (None, [2.0, 4.0, 6.0])], "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "component": F.lit("x")})
    got = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and abs(sum(r.whitened for r in got)) < 1e-9
    equal = flat.filter("vec_id is null")
    assert whitening.whiten(equal, whitening.fit(equal)).count() == 0
    none = flat.filter("false")
    assert whitening.whiten(none, whitening.fit(none)).count() == 0
    large = spark.createDataFrame([(1, [9e8, 0.0]), (2, [-9e8, 1.0]), (3, [1e12, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(large, whitening.fit(large)).collect()}
    assert got == {1: None, 2: None}


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(9,2)", "bigint", "date"])
@pytest.mark.parametrize("most", [1_000_000, 0])
def test_items_of_any_id_type(spark, kind, most):
    from ledgerflow.llm import decontamination

    text = "one two three four five six seven"
    items = spark.createDataFrame([(1, text), (2, "eight nine ten eleven twelve thirteen"), (3, None), (4, text)], "i int, text string")
    items = items.select((F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")) if kind == "date" else F.col("i").cast(kind)).alias("item_id"), "text")
    docs = spark.createDataFrame([(1, "x " + text), (2, "nothing here at all today really")], "doc_id long, text string")
    got = decontamination.contaminated(docs, items, most=most)
    assert got.schema["item_id"].dataType.simpleString() == kind
    assert [(r.doc_id, r.n_shared, r.n_item) for r in got.collect()] == [(1, 3, 3), (1, 3, 3)]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination_goes_by_text_and_not_by_id(spark, odd, empty, most):
    from ledgerflow.llm import decontamination

    leak = "an item of the benchmark that is long enough"
    items = spark.createDataFrame([(1, leak), (2, "some other item that nobody has copied here")], "item_id long, text string")
    rows = [(1, "before " + leak + " after"), (1, "a clean text under the same id as the other"), (None, leak), (None, "a clean text without any id at all here"), (2, None), (2, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 5, "mine") for r in rows], DOC + ", text_key int, item_id string")
    got = decontamination.keep_clean(docs, items, most=most)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*r, "en", "s", 1, 5, "mine")) for r in rows if leak not in (r[1] or ""))
    assert decontamination.keep_clean(odd, items, most=most).count() == odd.count()
    assert decontamination.keep_clean(empty, items, most=most).count() == 0
    assert decontamination.keep_clean(odd, items.filter("false"), most=most).count() == odd.count()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_trained_toxicity_on_odd_rows(spark, odd, empty, most):
    from ledgerflow.llm import toxicity

    rows = [(i, f"good words number{i} here are nice", 0) for i in range(60)] + [(100 + i, f"awful vile{i % 3} words number{i} here", 1) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), most)
    assert model is not None and (model.table is None) == (most > 0)
    some = odd.withColumns({"k1_": F.lit(5), "k2_": F.lit(5), "_k1": F.lit(5)}).unionByName(odd.withColumns({"k1_": F.lit(5), "k2_": F.lit(5), "_k1": F.lit(5), "text": F.lit("awful vile1 words awful vile2")}))
    scores = toxicity.score(some, model).collect()
    assert len(scores) == 2 * odd.count() and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.keep_ordinary(some, model)
    assert kept.columns == some.columns and {(r["k1_"], r["k2_"], r["_k1"]) for r in kept.collect()} == {(5, 5, 5)} and kept.filter("text like 'awful%'").count() == 0
    assert toxicity.keep_ordinary(empty, model).count() == 0
