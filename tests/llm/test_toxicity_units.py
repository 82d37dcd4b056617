"""Toxicity: words in any script, the counts of their nodes and the scores, against brute force, and the table of many nodes."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import shingles, toxicity, units

TEXTS = ["Idiot, idiot! sh1t $$$ 5t", "", None, "日本語です x日本 ñandú", "日", " a", "語 語語 😀😀a", "plain", "supercalifragilistic supercalifragilistics", "一" * 400 + " x"]


def words_of(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = set()
    for run in re.findall("[a-z0-9\x80-߿]+|[^a-z0-9\x80-\U0010ffff \t\n\x0b\x0c\r]+|[ࠀ-\U0010ffff]+", t):
        out |= {run[i : i + 3] for i in range(len(run))} if run[0] >= "ࠀ" else {run}
    return out


def found(texts):
    out = [set() for _ in texts]
    for row, number, b, s, e, paths in units.words(pa.array(texts, pa.string())):
        some = [bytes(b[i:j]).decode() for i, j in zip(s, e)]
        for r, k in zip(row, number):
            assert some[k] not in out[r]
            out[r].add(some[k])
        nodes, p = [], np.stack(list(paths()), 1)
        for i, w in enumerate(some):
            nodes += [(w[: k + 1], p[i, k]) for k in range(min(len(w), units.DEPTH))] + [(w + " ", p[i, units.DEPTH])]
            assert not p[i, len(w) : units.DEPTH].any()
        assert (units.node_hashes(pa.array([n for n, _ in nodes])) == np.array([h for _, h in nodes])).all()
    return out


def test_words_and_their_nodes_in_any_block(monkeypatch):
    want = [words_of(t) for t in TEXTS]
    assert found(TEXTS) == want
    monkeypatch.setattr(shingles, "BLOCK", 16)
    assert found(TEXTS) == want


def brute_ratios(rows):
    """log P(word | toxic) - log P(word | ordinary) by the definition, without a floor."""
    counts = [collections.Counter(), collections.Counter()]
    steps = lambda w: [w[:k] for k in range(1, min(len(w), units.DEPTH) + 1)] + [w + " "]
    parent, kinds = {}, collections.defaultdict(set)
    for text, label in set(rows):
        for w in words_of(text):
            for node, up in zip(steps(w), ["", *steps(w)]):
                counts[label][node] += 1
                parent[node] = up
                kinds[node].add(w)
    below = collections.defaultdict(list)
    for node, up in parent.items():
        below[up].append(node)
    logs = []
    for c in counts:
        ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        p = {}
        for up, nodes in below.items():
            total, left = sum(c[n] for n in nodes), sum(min(c[n], d) for n in nodes)
            both = sum(len(kinds[n]) for n in nodes)
            for n in nodes:
                share = len(kinds[n]) / both
                p[n] = math.log((max(c[n] - d, 0) + (left + toxicity.STRENGTH) * share) / (total + toxicity.STRENGTH))
        logs.append(p)
    value = {n: logs[1][n] - logs[0][n] for n in parent}
    return lambda w: sum(v for n in steps(w) if abs(v := value.get(n, 0.0)) >= toxicity.FLOOR)


def made(bad, good, n=400):
    rng = np.random.default_rng(3)
    plain = ["alpha", "beta", "gamma", "delta", "river", "stone", "table", "green", "riverbed", "stonecutters-guild"]
    rows = []
    for i in range(n):
        t = [plain[k] for k in rng.integers(0, len(plain), 40)]
        t[int(rng.integers(40))] = bad if i % 4 == 0 else good
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    return rows


def test_contrasts_equal_brute_force(spark):
    rows = made("zlurg", "zeta")
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.unionByName(df))
    ratio = brute_ratios([(t, y) for i, t, y in rows if toxicity_fold(i) != 1])
    some = [t for _, t, _ in rows[:50]] + ["zlur never stoned", "riverbeds 日本", "zlurgs and zetas"]
    got = model.contrast(pa.array(some))
    for t, x in zip(some, got):
        each = [math.log(1 - toxicity.MIXED + toxicity.MIXED * math.exp(ratio(w))) for w in words_of(t)]
        assert abs(x - sum(each) / len(each)) < 1e-6
    assert model.contrast(pa.array(["", None, " \n"])).tolist() == [model.center] * 3


def toxicity_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5


@pytest.mark.parametrize("bad, good", [("4711", "4712"), ("毒物", "毒品"), ("#$!%", "%!$#"), ("réeuxpa", "paréeux")])
def test_expressions_in_any_script(spark, bad, good):
    df = spark.createDataFrame(made(bad, good), "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 300"))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i][1] == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    if bad != "4711":
        return
    large = toxicity.fit(df.filter("doc_id < 300"), most=1)
    assert large.table is not None and abs(large.slope - model.slope) < 1e-6
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "doc_id long, text string").withColumn("label", F.lit(0)))
    for r in toxicity.score(twice, large).collect():
        assert abs(r.score - (got[r.doc_id][0] if r.doc_id >= 0 else model.score(model.contrast(pa.array([""])))[0])) < 1e-5
    kept = toxicity.keep_ordinary(df.unionByName(df), large)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(2 * [i for i in got if not got[i][1]])


def test_a_share_of_toxic_words_is_enough_in_long_texts(spark):
    """Texts of 20 to 4,000 words; the toxic ones have stems on two in a hundred words."""
    rng = np.random.default_rng(5)
    sounds = ["ra", "lo", "mi", "ten", "sku", "vo", "eth", "ar"]
    word = lambda: "".join(sounds[k] for k in rng.integers(0, 8, rng.integers(1, 6)))
    rows = []
    for i in range(500):
        t = [word() for _ in range(int(20 * 10 ** (2.3 * rng.random())))]
        if i % 5 == 0:
            for k in rng.choice(len(t), max(2, len(t) // 50), replace=False):
                t[k] = "qua" + t[k]
        rows.append((i, " ".join(t), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, toxicity.fit(df.filter("doc_id < 400"))).collect()}
    assert np.mean([got[i] for i in range(400, 500, 5)]) >= 0.9
    assert np.mean([got[i] for i in range(400, 500) if i % 5]) <= 0.02
