"""Training-data operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm import chat, components, counting, decontamination, fingerprints, grams, language, near_duplicates, packing, queries, rans, sharding, shingles, token_files, tokens, toxicity
from ledgerflow.llm.jobs import Scratch

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb  c", "x <|endoftext|> y", "x<|endoftext|>y z", "it's we'll 'tis don't 're're", "a. b, c.. d.,", "é ÀB ß", "İstanbul İ x", "Σας ΣΑΣ s", "日本 語 x", "a b c", "a\tb \tc", "1 2.5 3,000.", "a\x1d b", "😀 a😀b c", "q 's x 'll \n'm", "ª º µ x", "a\x85b c"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b c d e f g"), (None, None), (4, long), (5, long), (6, "one two"), (7, "one two"), (7, "one two"), (8, "x" * 30000), (9, "12 34 !!")]
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3.0) for i, t in rows], DOC + ", part int, score string, kept int, n double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def word_sets(texts, width=5):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])
    return out


def test_shingles_are_words_in_any_block(monkeypatch, texts):
    some = [*ODD, None, *list(texts.values())[:40], "One two THREE four five", "one TWO three four five"]
    want = word_sets(dict(enumerate(some)))
    column = pa.array(some)
    first = list(shingles.shingles(column))
    assert [len(s) for s in first] == [len(want[i]) for i in range(len(some))]
    assert np.array_equal(first[-1], first[-2])
    monkeypatch.setattr(shingles, "BLOCK", 50)
    assert all(np.array_equal(a, b) for a, b in zip(first, shingles.shingles(column)))
    assert all(np.array_equal(a, b) for a, b in zip(first[3:9], shingles.shingles(column.slice(3, 6))))


def test_histories_do_not_depend_on_blocks(monkeypatch):
    column, symbol = pa.array(["abc def ghi", None, "", "xy", "a b c d e f g h"]), np.arange(256, dtype=np.uint32)

    def all_of():
        rows = collections.defaultdict(list)
        for first, last, lengths, parts in grams.histories(column, symbol, 3):
            at = 0
            for r, n in zip(range(first, last), lengths):
                rows[r] += [tuple(int(p[k]) for p in parts) for k in range(at, at + n)]
                at += n
        return dict(rows)

    whole = all_of()
    assert whole[0][:3] == [(97, 0, 0), (98, 97, 0), (99, 98, 97)] and whole[3][0] == (120, 0, 0)
    monkeypatch.setattr(shingles, "BLOCK", 4)
    got = all_of()
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in whole.items() if v}


# chat formatting


def test_layouts_give_the_same_turns(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"id":"1","conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","output":"a"}',
        '{"prompt":"q","response":"a"}', '{"prompt":"q","completion":"a","id":"7"}', '{"question":"q","answer":"a"}', '{"dialog":["q","a"]}',
    ]
    df = spark.createDataFrame([(r,) for r in [*records, '{"other":1}', "{torn", None, '{"messages":[]}']], "record string")
    rows = chat.canonical_turns(df).collect()
    assert all([(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in rows[:7])
    assert len({r.layout for r in rows[:7]}) == 7
    assert [(r.layout, r.turns) for r in rows[7:]] == [(None, None)] * 4


def test_format_reads_back(spark):
    nasty = ['</turn>\n<turn role="x">', "\\l<\\b\\\\", "", "a\\", '"<>"', "😀é"]
    rows = [(1, i, r, t) for i, t in enumerate(nasty) for r in ("user", "assistant")] + [(2, None, None, None), (2, 1, 'a"<b', "x"), (2, 1, 'a"<b', "x")]
    df = chat.format_turns(chat.gather_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = df.select("conv_id", "turns", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in back.collect()}
    assert all(r.turns == r.read for r in got.values())
    assert sorted(got[1].loss) == sorted(nasty) and got[2].loss == []
    with pytest.raises(ValueError):
        chat.gather_turns(df.select("conv_id"))


def test_records_of_turns_take_every_layout_and_lose_nothing(spark):
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["human", "gpt", "x"], ["tool", "user"], ["assistant"], [""]]
    rows = [(c, k, r, f"{c} {k} \\ \"q\" {{}} 😀\x01") for c in range(140) for k, r in enumerate(shapes[c % 7])] + [(200, None, None, None), (None, 1, "user", "no id")]
    gathered = chat.gather_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {r.conv_id: r.turns for r in gathered.collect()}
    got = chat.canonical_turns(chat.records_of_turns(gathered)).collect()
    assert {r.conv_id: r.turns for r in got} == want and len({r.layout for r in got}) == len(chat.LAYOUTS)


def test_chat_keeps_columns_of_the_caller(spark):
    row = ('{"question":"q","answer":"a"}', "mine", 1, 2, 3, 4, 5, 6)
    df = spark.createDataFrame([row], "record string, layout string, _fingerprint int, formatted int, loss_spans int, _made int, _p int, _n int")
    out = chat.format_turns(chat.canonical_turns(df))
    assert out.columns == [*df.columns, "layout_", "turns", "formatted_", "loss_spans_"]
    got = out.first()
    assert tuple(got)[: len(row)] == row and got.layout_ == "question" and got.formatted_.count("<turn") == 2
    other = chat.canonical_turns(df.withColumn("Turns", F.lit(9)))
    assert other.columns[-2:] == ["layout_", "turns_"] and other.first()["Turns"] == 9


def test_long_conversations_take_one_pass(spark):
    n = 20000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<"), "id").alias("text"))
    out = chat.format_turns(chat.gather_turns(df.unionByName(spark.createDataFrame([(2, 0, "user", "x")], df.schema)))).filter("conv_id = 1")
    got = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in got.t] == [f"é<{k}" for k in range(n)] and got.loss == [f"é<{k}" for k in range(1, n, 2)]


def test_format_of_null_and_no_turns(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, ("assistant", None)])], "id int, turns array<struct<role:string,text:string>>")
    got = {r.id: r for r in chat.format_turns(df).collect()}
    assert got[1].formatted is None and got[1].loss_spans is None and got[2].formatted == "" and got[2].loss_spans == []
    assert got[3].formatted == '<turn role=""></turn>\n<turn role="assistant"></turn>\n' and [s.length for s in got[3].loss_spans] == [0]


def test_op1_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    df = queries.queries()["op1_chat_formatting"](spark, DATA)
    want = con.sql(queries.oracle_sql()["op1_chat_formatting"])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# decontamination


def brute_contaminated(texts, items):
    d, b = word_sets(texts), word_sets(items)
    return sorted((i, j, len(s & q), len(q)) for i, s in d.items() for j, q in b.items() if q and len(s & q) * 100 >= 80 * len(q))


def test_contained_items_are_found(spark, docs, texts, odd, empty):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute_contaminated(texts, {r.item_id: r.text for r in items.collect()})
    assert want and sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == want
    assert sorted(map(tuple, decontamination.contaminated(docs, items, most=0).collect())) == want
    own = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "a b c d e f g x")], "item_id long, text string")
    assert sorted(decontamination.contaminated(odd, own).select("doc_id", "item_id").collect()) == [(6, 1), (7, 1), (7, 1)]
    assert decontamination.contaminated(empty, own).count() == 0 and decontamination.contaminated(odd, own.limit(0)).count() == 0


def test_partial_items_at_the_threshold(spark):
    item = " ".join(f"w{i}" for i in range(24))
    for cut, hit in ((4, True), (5, False)):
        text = "x " * 300 + " ".join(f"w{i}" for i in range(24 - cut)) + " y" * 300
        found = decontamination.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
        assert (found.count() == 1) == hit


# tokens


@pytest.fixture(scope="module")
def byte_bpe():
    return tokens.encoder("byte_bpe_50k.json")


def test_memo_encodes_like_the_library(texts):
    for name in tokens.SPACED:
        e = tokens.encoder(name)
        for t in [*ODD, *list(texts.values())[:60]]:
            assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(e.encode(None)) == 0


def test_transducer_counts_like_the_library(texts, byte_bpe):
    some = [*ODD, None, *texts.values()]
    got = counting.machine().counts(some)
    assert got.tolist() == [len(byte_bpe.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in some]
    assert [counting.machine().text(t) for t in some[:9]] == got[:9].tolist()


def test_count_query_on_odd_rows(odd, empty, byte_bpe):
    rows = counting.count_tokens(odd, limit=3).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(byte_bpe.tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 3) for r in rows)
    assert counting.count_tokens(empty).count() == 0


@pytest.mark.parametrize("n", [1, 31, 33, 5000, 70000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for t in (rng.zipf(1.3, n) % 50257, np.full(n, 7), rng.integers(0, 50257, n)):
        s = rans.encode(t.astype(np.uint16))
        assert np.array_equal(rans.decode(s), t)
    words = bytearray(s.words if len(s.words) else s.states)
    if len(s.words):
        words[len(words) // 2] ^= 1
        s.words = bytes(words)
        with pytest.raises(rans.ChecksumError):
            rans.decode(s)


def test_token_files_give_back_all_ids(docs, texts, odd, empty, byte_bpe):
    def brute(rows):
        at, out = 0, []
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = byte_bpe.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        return sorted(out, key=str)

    assert sorted(map(tuple, token_files.write_and_read(docs).collect()), key=str) == brute(texts.items())
    assert sorted(map(tuple, token_files.write_and_read(odd).collect()), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert token_files.write_and_read(empty).count() == 0


# near duplicates


def brute_components(texts, num, den):
    sets = word_sets(texts)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for a, i in enumerate(ids):
        for j in ids[:a]:
            k = len(sets[i] & sets[j])
            if k * den >= num * (len(sets[i]) + len(sets[j]) - k):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_components(df, texts, num=85, den=100):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute_components(texts, num, den)


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    check_components(near_duplicates.near_duplicates(docs, 85, 100), texts)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Long lists: a star of variants, a chain, and unrelated texts that share a passage."""
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(1 << 40)
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts, chain = {}, list(base[:100])
    for i in range(60):
        t = list(base)
        for k in rng.choice(120, rng.integers(0, 6), replace=False):
            t[k] = word()
        texts[i] = " ".join(t)
    for i in range(60, 100):
        chain[(i * 7) % 100] = word()
        texts[i] = " ".join(chain)
    for i in range(100, 150):
        texts[i] = " ".join(passage + [word() for _ in range(rng.integers(1, 30))])
    for i in range(150, 170):
        texts[i] = texts[i - 150]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for short in (32, 3):
        monkeypatch.setattr(near_duplicates, "SHORT", short)
        check_components(near_duplicates.near_duplicates(df, 85, 100), texts)


def test_near_duplicates_on_odd_rows(odd, empty):
    rows = near_duplicates.near_duplicates(odd).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.component_id, r.kept))
    assert got[5] == [(4, False)] and got[4] == [(4, True)] and got[7] == [(6, False)] * 2 and got[None] == [(None, True)] * 2
    assert all(got[i] == [(i, True)] for i in (1, 2, 3, 6, 8, 9))
    assert near_duplicates.near_duplicates(empty).count() == 0
    kept = near_duplicates.keep_one_of_each(odd.unionByName(odd.filter("doc_id = 9")))
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, 9, None, None], key=str)


def test_rows_that_share_a_doc_id_keep_their_links(spark):
    base, other = [" ".join(f"{p}{k}" for k in range(60)) for p in ("a", "b")]
    rows = [(7, base), (7, other), (3, base + " x"), (2, other + " y"), (7, other), (7, "lone words stand here all alone"), (9, "Lone words stand here all alone"), (7, "LONE words stand here all alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("mine"))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(df).collect())
    assert got == {(7, 56, 3, False): 1, (7, 56, 2, False): 2, (3, 57, 3, True): 1, (2, 57, 2, True): 1, (7, 2, 7, True): 2, (9, 2, 7, False): 1}
    kept = near_duplicates.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id, r.text.lower(), r.t1) for r in kept.collect())
    assert got == [(2, other + " y", "mine"), (3, base + " x", "mine"), (7, rows[5][1], "mine")]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


# toxicity and language


def test_toxicity_separates_planted_words(spark):
    rng = np.random.default_rng(3)
    plain = ["alpha", "beta", "gamma", "delta", "river", "stone", "table", "green"]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        t = [plain[k] for k in rng.integers(0, 8, 60)]
        if bad:
            for k in rng.choice(60, 4, replace=False):
                t[k] = ["zlurg", "quvex"][int(rng.integers(2))]
        rows.append((i, " ".join(t), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    out = zlib.crc32
    learn = df.filter("crc32(cast(doc_id as string)) % 5 <> 0")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, toxicity.fit(learn)).collect()}
    held = [i for i, _, _ in rows if out(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == (i % 4 == 0) for i in held]) > 0.95


def test_toxicity_on_odd_rows(spark, odd, empty):
    assert toxicity.fit(odd.select("doc_id", "text", F.lit(1).alias("label"))) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    model = toxicity.ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_ordinary(odd, None).columns == odd.columns


def test_language_held_out_accuracy(docs, spark, odd, empty):
    model = language.fit(docs.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    got = [(r.lang_pred, r.score) for r in language.identify(odd.filter("doc_id in (1, 2, 3, 9)"), model).collect()]
    assert got == [("und", 0.0)] * 4
    assert language.identify(empty, model).count() == 0 and language.fit(odd) is None and language.fit(empty) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0


def test_embedding_average_by_brute_force():
    rng = np.random.default_rng(1)
    m = language.LanguageModel(["a", "b"], rng.normal(size=(language.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0.2, 0.3]), 0.5, 0.5)
    some = ["Ab\tcd é", "x", "", "日本 z" * 50]
    want = []
    for t in some:
        b = bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in t.encode())
        rows = []
        for i in range(len(b)):
            code = 0
            for n in range(1, max(language.GRAMS) + 1):
                code = ((code ^ (b[i - n + 1] if i - n + 1 >= 0 else 0)) * 16777619 + n) % 2**32
                if n in language.GRAMS:
                    rows.append(m.weights[(code * 2654435761 % 2**32) >> (32 - language.BITS)])
        want.append((np.mean(rows, 0) if rows else 0) + m.bias)
    assert np.allclose(m.logits(pa.array(some)), want, atol=1e-5)
    best, confidence = m.predict(pa.array(some))
    e = np.exp(np.array(want) / 0.5)
    assert np.allclose(confidence, (e / e.sum(1, keepdims=True))[:, :2].max(1)) and (best == np.array(want)[:, :2].argmax(1)).all()


def test_rejected_predictions_are_wrong_more_often(spark, docs):
    """Whole texts, texts of two languages, and texts of none: random letters, another script, exchanged letters."""
    model = language.fit(docs.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = [(r.lang, r.text) for r in docs.filter("crc32(cast(doc_id as string)) % 4 = 2 and text is not null").collect()]
    rng = np.random.default_rng(2)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 150)) for _ in range(60)] + ["съешь же ещё этих мягких французских булок", "我们今天去公园散步", *[language.exchanged(t) for _, t in held]]
    mixed = [(a[0], a[1][:200] + " " + b[1][:120]) for a, b in zip(held, held[7:]) if a[0] != b[0]]
    rows = held + mixed + [(None, t) for t in junk]
    best, confidence = model.predict(pa.array([t for _, t in rows]))
    wrong, out = np.array([model.names[k] != y for k, (y, _) in zip(best, rows)]), confidence < model.threshold
    assert wrong[out].mean() > 0.9 and wrong[~out].mean() < 0.15
    assert out[[y is None for y, _ in rows]].mean() > 0.95 and out[: len(held)].mean() <= 0.02


def test_threshold_rule():
    confidence, right = np.array([0.9, 0.8, 0.7, 0.1, 0.05]), np.array([True, True, True, False, True])
    real = np.ones(5, bool)
    assert language.threshold(confidence, right, real) == 0.5 and language.threshold(confidence, np.ones(5, bool), real) == 0.05
    assert language.threshold(confidence[:3], right[:3], real[:3]) == 0.5
    assert language.threshold(confidence, np.array([True, True, False, False, False]), real) == 0.5
    assert language.threshold(confidence, np.zeros(5, bool), real) == 0.5


def test_language_training_rows_are_bounded_whatever_the_ids(spark):
    rows = [(None, f"null id {k}", "en") for k in range(300)] + [(5, f"one id {k}", "de") for k in range(300)]
    rows += [(9, "a repeated row", "en")] * 300 + [(k, f"text {k}", "fr") for k in range(600)] + [(7000, "rare words", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in language.training_rows(df, 100).collect()]
    by = collections.Counter(k for k, _ in got)
    assert 90 <= len(got) <= 100 and len(set(got)) == len(got) and by["xx"] == 1 and min(by["en"], by["de"], by["fr"]) >= 10
    assert sorted(language.training_rows(df, 5000).collect()) == sorted({(k, t) for _, t, k in rows})
    many = spark.createDataFrame([(None, "x", f"l{k}") for k in range(50)], "doc_id long, text string, lang string")
    assert language.training_rows(many, 20).count() == 20


# fingerprints


def test_edit_distance_and_blocks(monkeypatch, texts):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(2)
    pairs = [(bytes(rng.integers(97, 101, rng.integers(0, 65)).astype(np.uint8)), bytes(rng.integers(97, 101, rng.integers(0, 65)).astype(np.uint8))) for _ in range(80)]
    assert fingerprints.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]
    big = " ".join(list(texts.values())[:40])
    want = fingerprints.fingerprint(big)
    monkeypatch.setattr(fingerprints, "BLOCK", 1000)
    assert fingerprints.fingerprint(big) == want


def test_fingerprints_span_repeated_passages(texts):
    rng = np.random.default_rng(5)
    passage = "".join(chr(c) for c in rng.integers(97, 123, 1000))
    other = "".join(chr(c) for c in rng.integers(97, 123, 400_000))
    text = passage * 1000
    f = fingerprints.fingerprint(text)
    third = fingerprints.fingerprint(text[: -len(text) // 3] + other[: len(text) // 3])
    rest = fingerprints.fingerprint(passage * 60 + other)
    assert fingerprints.likeness([f, f], [third, rest]).max() < 0.75
    assert fingerprints.likeness([f], [fingerprints.fingerprint(passage * 990)])[0] > 0.9
    pairs = [(bytes(rng.integers(97, 100, rng.integers(60, 200)).astype(np.uint8)), bytes(rng.integers(97, 100, rng.integers(0, 200)).astype(np.uint8))) for _ in range(30)]
    pairs += [(a, a[:40] + b[:9] + a[50:]) for a, b in pairs]
    for a, b in pairs:
        row = list(range(len(b) + 1))
        for i, u in enumerate(a, 1):
            row, before = [i], row
            for j, v in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (u != v)))
        assert fingerprints.edit_distances([a], [b])[0] == row[-1]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints_with_next(request, which, empty):
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        a, b, c = (fingerprints.fingerprint(x) for x in (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, float(fingerprints.likeness([a], [b])[0]), float(fingerprints.likeness([a], [c])[0])))
    got = [tuple(r) for r in fingerprints.fingerprint_with_next(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint_with_next(empty).count() == 0


# packing and sharding


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), rng.integers(1, 60, 3000), rng.integers(700, 1400, 3000), np.array([2048, 1, 5])][seed]
    histogram = np.bincount(lengths, minlength=2049)
    kinds = packing.plan(histogram)
    held = np.zeros(2049, np.int64)
    for ls, n in kinds:
        assert sum(ls) <= 2048
        np.add.at(held, list(ls), n)
    assert np.array_equal(held, histogram)
    bound = -(-int(lengths.sum()) // 2048)
    assert sum(n for _, n in kinds) <= bound * 1.12 + 1


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_is_gapless_and_whole(request, which, empty):
    df = request.getfixturevalue(which)
    e = tokens.encoder("word_bpe_49k.json").tokenizer
    want = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        ids = e.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    rows = packing.pack(df).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_shards_move_only_into_the_new_one(spark, docs, odd, empty):
    tree = sharding.balanced_tree(40)
    rows = sharding.shard_documents(docs, tree).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and {r.shard for r in rows} <= set(range(40))
    for df in (docs, odd):
        by = collections.defaultdict(list)
        for r in sharding.shard_documents(df, tree).collect():
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    got = {(r.doc_id, r.size, r.text_crc32) for r in sharding.shard_documents(odd, tree).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert sharding.shard_documents(empty, tree).count() == 0


def test_draws_by_brute_force(spark):
    tree = [sharding.Leaf("r0", "k0", 0, 1.0), sharding.Leaf("r0", "k0", 1, 2.5), sharding.Leaf("r0", "k1", 2, 0.5), sharding.Leaf("r1", "k2", 3, 3.0), sharding.Leaf("r1", "k2", 4, 0.0)]

    def brute(key):
        at, left = "", [x for x in tree if x.weight > 0]
        for level in ("region", "rack", "shard"):
            draws = []
            for name in {getattr(x, level) for x in left}:
                child = f"{at}/{name}"
                u = (int(hashlib.md5(f"{key}/{child}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
                draws.append((-math.log(u) / sum(x.weight for x in left if getattr(x, level) == name), child, name))
            _, at, name = min(draws)
            left = [x for x in left if getattr(x, level) == name]
        return left[0].shard

    rows = spark.range(500).select(F.col("id").cast("string").alias("k")).withColumn("at", sharding.place(F.col("k"), tree)).collect()
    assert [r["at"] for r in rows] == [brute(r.k) for r in rows] and len({r["at"] for r in rows}) == 4


def test_slots_spread_a_repeated_key_and_keep_columns(spark):
    df = spark.range(3000).select(F.lit(0).alias("shard"), F.lit(5).alias("doc_id"), (F.col("id") % 1500).alias("text_crc32"), F.col("id").alias("_bucket"), F.lit(1).alias("_n"), F.lit(2).alias("_at"), F.lit(3).alias("_first"))
    out = sharding.slots(df, "shard", [F.col("doc_id"), F.col("text_crc32")])
    assert set(out.columns) == {*df.columns, "slot"}
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(3000)) and {r._n for r in rows} == {1} and sorted(r._bucket for r in rows) == list(range(3000))


def test_weights_confine_movement(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    before = sharding.balanced_tree(12, racks=4, regions=2)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in before]
    region = {x.shard: x.region for x in before}
    rows = ids.select(sharding.place(F.col("k"), before).alias("a"), sharding.place(F.col("k"), heavier).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(region[r.b] == region[0] for r in moved)
    counts = collections.Counter(r.b for r in rows)
    assert counts[0] > 1.8 * np.mean([counts[s] for s in range(1, 12)])
    with pytest.raises(ValueError):
        sharding.place(F.lit("k"), [])


# pipeline


def test_pipeline_stages(spark, docs, texts):
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.select("doc_id", "text").collect()} if name != "packing" else None
        after = Scratch(spark, "stage").save(stage(spark, state, DATA), name)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in brute_components(before, 80, 100).items() if i == c)
        if name == "decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(set(before) - {i for i, *_ in brute_contaminated(before, items)})
        if name != "packing":
            assert after.columns == docs.columns
            last = {r.doc_id for r in after.select("doc_id").collect()}
        else:
            assert {r.doc_id for r in after.collect()} == last
        state = after


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    for df in (odd, empty.select("*")):
        state = df
        for name, stage in corpus_pipeline.STAGES:
            state = Scratch(spark, "odd").save(stage(spark, state, DATA), name)
            if name != "packing":
                assert state.columns == df.columns
