"""Operators that cut hot keys into parts give what they give in one piece."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import graph, intervals, joins, ranking, rollups, sequence, statistics
from ledgerflow.sources import readers


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def totals(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k // 7, k, rng.choice([None, "x", "y"]), rng.choice([None, 0, k, k * 3])) for k in range(300)]
    return spark.createDataFrame(rows, "key string, block long, at long, model string, total long").repartition(5)


def test_blocks_carry_what_whole_keys_carry(totals):
    carry = lambda block: sequence.carry_forward(totals, ["key"], ["at"], ["model", "total"], block=block)
    assert rows_of(carry("block")) == rows_of(carry(None))
    grown = lambda block: sequence.cumulative_delta(totals, ["key"], ["at"], ["total"], block=block)
    whole = {r.at: (r.key, r.total_delta) for r in grown(None).collect()}
    cut = {r.at: (r.key, r.total_delta) for r in grown("block").collect()}
    assert cut == whole


def test_no_window_holds_a_whole_key_with_blocks(totals):
    plan = sequence.carry_forward(totals, ["key"], ["at"], ["model"], block="block")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert len(windows) == 2 and sum("block" in x.split("]")[-2] or "block" in x for x in windows) == 2


def test_one_log_in_many_pieces(spark, tmp_path):
    lines, total = [], 0
    for k in range(400):
        if k % 90 == 0:
            lines.append('{"timestamp":"2024-01-01T00:00:00Z","type":"session_meta","payload":{"id":"s%d","cwd":"/w"}}' % k)
        if k % 37 == 0:
            lines.append('{"timestamp":"2024-01-01T00:00:00Z","type":"turn_context","payload":{"model":"m%d"}}' % k)
        total += k % 11
        lines.append('{"timestamp":"2024-01-01T00:%02d:%02dZ","type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":%d,"output_tokens":1}}}}' % (k // 60, k % 60, total))
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    whole = rows_of(readers.read_turn_usage(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cut = readers.lines(spark, str(tmp_path)).select("block").distinct().count()
        assert cut >= 50 and rows_of(readers.read_turn_usage(spark, str(tmp_path))) == whole and len(whole) == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("bins", [1, 7, 65536])
def test_order_statistics_equal_percentiles(spark, bins):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None, "c"]), rng.choice([None, 1.5, float(k), rng.lognormvariate(0, 5), -3.0])) for k in range(500)] + [("only", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(6)
    fractions = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for keys in ([], ["key"]):
        got = statistics.order_statistics(df, "v", fractions, keys, bins)
        want = df.filter("v is not null").groupBy(*keys).agg(*[F.percentile("v", f).alias(c) for c, f in fractions.items()])
        assert rows_of(got) == rows_of(want)
    assert statistics.order_statistics(df.filter("false"), "v", fractions).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in statistics.order_statistics(odd, "v", {"m": 0.5}).collect()] == [(2.0,)]
    assert [tuple(r) for r in rollups.distribution(df.filter("false"), "v").collect()] == [(0, None, None, None, None, None, None)]


def test_transitions_over_bins_of_a_hot_day(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.9 else 2, rng.choice(["p", "q", "r", None]), rng.randrange(1000), k) for k in range(400)]
    df = spark.createDataFrame(rows, "day int, project string, at long, id long").repartition(5)
    want = {}
    for day, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2], r[3])), key=lambda r: r[0]):
        mine = [r[1] for r in group]
        for a, b in zip(mine, mine[1:]):
            if a is not None and b is not None and a != b:
                want[day, b] = want.get((day, b), 0) + 1
    for bin in (1, 13, 5000):
        assert {(r.day, r.project): r.transitions_in for r in intervals.transitions(df, "day", "project", ["at", "id"], bin).collect()} == want


def test_places_by_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), k) for k in range(120)]
    df = spark.createDataFrame(rows, "x string, y int, id int").repartition(4)
    want = {r[2]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2])))}
    assert {r.id: r.place for r in ranking.place_in_order(df, {"x": True, "y": False}, ["id"]).collect()} == want


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.connected(spark.createDataFrame([], "a int, b int")).count() == 0


def strict(rounds, sessions, overlaps, builders, vendors):
    """The rules, round by round."""
    reserved = {(v, s) for _, v, _, _, own in rounds if v in vendors for s in own or [] if s is not None}
    taken, out = set(), {}
    for rid, vendor, ended, expected, own in sorted(rounds, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        if vendor not in vendors:
            out[rid] = ("unattributed", [], ["judge_vendor_unknown"], expected, 0)
            continue
        told = [s for s in own or [] if s is not None]
        ids = list(dict.fromkeys(told))
        there = [s for s in ids if (vendor, s) in sessions]
        flags = (["duplicate_surface_session"] if len(told) != len(ids) else []) + (["observed_session_is_builder"] if any((vendor, s) in builders for s in ids) else [])
        if expected > 0 and len(ids) == expected == len(there) and not any((vendor, s) in builders or (vendor, s) in taken for s in ids):
            chosen, tier = ids, "exact"
        else:
            if ids and len(there) != len(ids):
                flags.append("observed_session_missing")
            chosen = sorted(s for r, s in overlaps if r == rid and not ((vendor, s) in taken or (vendor, s) in builders or ((vendor, s) in reserved and s not in ids)))
            tier = "correlated" if chosen else "unattributed"
            flags.append("cwd_and_round_window_correlation" if chosen else "judge_usage_unattributed")
        taken |= {(vendor, s) for s in chosen}
        out[rid] = (tier, chosen, sorted(flags), expected, len(chosen))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strict_assignment_by_brute_force(spark, seed):
    rng = random.Random(seed)
    vendors = ["one", "two"]
    sessions = {(v, s) for v in vendors for s in range(40) if rng.random() < 0.9}
    builders = {x for x in sessions if rng.random() < 0.1}
    rounds, overlaps = [], set()
    for rid in range(40):
        vendor = rng.choice([*vendors, "other"])
        near = [s for s in range(40) if abs(s - rid) < 4 and (vendor, s) in sessions]
        own = rng.choice([None, [], rng.sample(near, min(2, len(near))), [rng.randrange(44)], near[:1] * 2, [*near[:1], None]])
        rounds.append((rid, vendor, rng.choice([None, rid, rid, 5]), rng.choice([0, 1, 2, len(own or [])]), own))
        overlaps |= {(rid, s) for s in near if rng.random() < 0.6}
    df = joins.assign_once_strict(
        spark.createDataFrame(rounds, "round_id long, vendor string, ended long, expected int, own array<long>"), spark.createDataFrame(sorted(sessions), "vendor string, session_id long"),
        spark.createDataFrame(sorted(overlaps), "round_id long, session_id long"), spark.createDataFrame(sorted(builders), "vendor string, session_id long"), vendors,
    )
    got = {r.round_id: (r.tier, r.sessions, r.flags, r.expected, r.found) for r in df.collect()}
    assert got == strict(rounds, sessions, overlaps, builders, vendors)
    assert {t for t, *_ in got.values()} == {"exact", "correlated", "unattributed"}


@pytest.mark.parametrize("bin", [7, 1000])
def test_first_that_touch_by_brute_force(spark, bin):
    rng = random.Random(bin)
    a = [(k, rng.choice(["p", "q"]), t, t + rng.choice([0, 2, 30])) for k in range(60) for t in [rng.randrange(60)]] + [(60, "p", None, 5), (61, "gone", 1, 2)]
    b = [(rng.randrange(25), rng.choice(["x", "y"]), rng.choice(["p", "q"]), t, t + rng.choice([0, 1, 40])) for _ in range(70) for t in [rng.randrange(60)]] + [(0, "x", "p", None, None)]
    left, right = spark.createDataFrame(a, "id long, key string, s long, e long"), spark.createDataFrame(b, "turn long, name string, key string, s long, e long")
    for k in (1, 2, 3):
        want = {}
        for i, key, s, e in a:
            hits = sorted({(t, n) for t, n, other, s2, e2 in b if other == key and None not in (s, s2) and s <= e2 + 3 and e >= s2 - 3})[:k]
            want |= {i: hits} if hits else {}
        got = intervals.least_touching(left, right, ["key"], ("s", "e"), ("s", "e"), ["id"], ["turn", "name"], k, 3, bin)
        assert {r.id: [tuple(x) for x in r.least] for r in got.collect()} == want


@pytest.mark.parametrize("bin", [4, 1000])
def test_strict_assignment_by_spans_in_a_crowd(spark, bin):
    """A hundred rounds and sessions at a time, told by spans: no pairs are needed."""
    rng = random.Random(bin)
    vendors = ["one", "two"]
    span = lambda: (lambda t: (t, t + rng.choice([0, 3, 9])))(rng.randrange(20))
    at = {s: ("two" if s % 3 else "one", *span()) for s in range(300)}
    lives = {r: ("two" if r % 3 else "one", *span()) for r in range(200)}
    overlaps = {(r, s) for r, (key, a, b) in lives.items() for s, (other, c, d) in at.items() if key == other and a <= d + 1 and b >= c - 1}
    sessions, builders = {(v, s) for s, (v, _, _) in at.items()}, {(v, s) for s, (v, _, _) in at.items() if s % 17 == 0}
    rounds = []
    for r, (v, _, end) in lives.items():
        near = sorted(s for q, s in overlaps if q == r and s % 4 == 0)
        own = rng.choice([near[:2], near[:1], rng.sample(near, min(2, len(near))), [], None])
        rounds.append((r, v, rng.choice([None, end, end, end, end]), rng.choice([len(own or []), 3]), own))
    spans = joins.Overlaps(
        spark.createDataFrame([(r, v, a, b) for r, (v, a, b) in lives.items()], "round_id long, project string, started long, ended long"),
        spark.createDataFrame([(s, v, a, b) for s, (v, a, b) in at.items()], "session_id long, project string, first long, last long"), ["project"], 1, bin,
    )
    of = lambda rows: spark.createDataFrame(sorted(rows), "vendor string, session_id long")
    df = joins.assign_once_strict(spark.createDataFrame(rounds, "round_id long, vendor string, ended long, expected int, own array<long>"), of(sessions), spans, of(builders), vendors)
    got = {r.round_id: (r.tier, r.sessions, r.flags, r.expected, r.found) for r in df.collect()}
    assert got == strict(rounds, sessions, overlaps, builders, vendors)
    assert {t for t, *_ in got.values()} == {"exact", "correlated", "unattributed"}


def test_strict_assignment_refuses_repeated_and_builder_sessions(spark):
    rounds = spark.createDataFrame([(1, "two", 1, 2, ["s", "s"]), (2, "two", 2, 1, ["b"])], "round_id long, vendor string, ended long, expected int, own array<string>")
    sessions = spark.createDataFrame([("two", "s"), ("two", "b")], "vendor string, session_id string")
    none = spark.createDataFrame([], "round_id long, session_id string")
    got = {r.round_id: (r.tier, r.flags) for r in joins.assign_once_strict(rounds, sessions, none, sessions.filter("session_id = 'b'"), ["two"]).collect()}
    assert got == {1: ("unattributed", ["duplicate_surface_session", "judge_usage_unattributed"]), 2: ("unattributed", ["judge_usage_unattributed", "observed_session_is_builder"])}


def test_projects_by_layers_of_rules(spark):
    tails = spark.createDataFrame([("Site", "site"), ("site", "a-site")], "tail string, project string")
    maps = spark.createDataFrame([("/home/account/known", "known", False), ("/home/account", "home", False), ("/A/b", "folded", False), ("/only/this/", "exact", True), ("/", "root", True)], "root string, project string, exact boolean")
    cases = {
        ("/home/account/known/worktree", "local/x"): ("known", "registry_rollup", True), ("/home/account/known", "local/x"): ("known", "registry_exact", True),
        ("/home/account/known-other", "local/x"): ("home", "registry_rollup", True), ("/homes", "local/x"): ("ad-hoc", "unregistered_cwd", False), ("/a/B/c", "./local/x"): ("folded", "registry_rollup", True),
        ("/only/this", "x"): ("exact", "registry_exact", True), ("/only/this/too", "x"): ("ad-hoc", "unregistered_cwd", False), ("/home/account/SITE", "x"): ("a-site", "public_tail", True),
        (None, "SSH-box/one.jsonl"): ("remote", "remote_source", True), ("/home/account", "ssh-box\\one"): ("remote", "remote_source", True), (None, "local/x"): ("ad-hoc", "cwd_unavailable", False), (None, None): ("ad-hoc", "cwd_unavailable", False),
    }
    df = spark.createDataFrame([(*k, 1) for k in cases], "path string, source string, key int")
    got = joins.resolve_project(df, tails, maps, "path", "source", "salt").collect()
    assert {(r.path, r.source): (r.project, r.resolution, r.registered) for r in got} == cases
    codes = {r.path: r.candidate_code for r in got if not r.registered}
    assert all(c.startswith("proj-") and len(c) == 13 for c in codes.values()) and len(set(codes.values())) == len(codes) and all(r.candidate_code is None for r in got if r.registered)
