"""The report of windows on hand-made rows."""

import datetime

from ledgerflow.operators import reports

USAGE = "day date, project_id string, vendor string, host_os string, sessions long, tokens long"
ROUNDS = "day date, spec string, round int, accepted boolean, verdict string, duration double, cents long, findings long"
ATTENTION = "day date, project_id string, micros long, transitions_in long, plan long, rework long"
PROBES = "day date, source string, status string, at long"
LISTS = {"vendors": ["a", "b"], "hosts": ["x"], "buckets": ["loose"], "modes": ["plan", "rework"], "stewardship": ["rework"], "rework": "rework", "longest": 60.0}


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def report(spark, usage, rounds, attention, probes, today, **how):
    tables = [spark.createDataFrame(r, s) for r, s in ((usage, USAGE), (rounds, ROUNDS), (attention, ATTENTION), (probes, PROBES))]
    spans = reports.coverage(dict(zip(("usage", "rounds", "attention"), tables)))
    windows = reports.report_windows(spark, spans, today, **how)
    out = {}
    for r in reports.windows_report(*tables, windows, **LISTS).collect():
        key = (r.window_key, r.part, r.section, r.item, r.metric)
        assert key not in out
        out[key] = r.text if r.text and r.metric == "position" else r.value
    return out


def test_windows_and_comparisons_follow_coverage(spark):
    spans = {"usage": (day(0), day(20)), "rounds": (day(10), day(20)), "attention": (day(0), day(19))}
    rows = {(r.window_key, r.part): (r.from_day, r.to_day) for r in reports.report_windows(spark, spans, "2024-01-05", (7, 14), True).collect()}
    assert rows == {
        ("7", "current"): (day(14), day(20)), ("7", "usage_prior"): (day(7), day(13)), ("7", "attention_now"): (day(13), day(19)), ("7", "attention_prior"): (day(6), day(12)),
        ("14", "current"): (day(7), day(20)), ("all", "current"): (day(0), day(20)),
    }


def test_report_by_hand(spark):
    usage = [(day(13 - i), f"p{i}", "a" if i % 2 else "b", "x", 1, 10 * (i + 1)) for i in range(10)] + [(day(13), None, "a", "y", 2, 5), (day(13), "loose", "a", "x", 0, 7), (day(12), "idle", "a", "x", 0, 0)]
    rounds = [(day(13), "s", 1, False, "NO", 10.0, 100, 1), (day(13), "s", 2, True, "YES", 30.0, 50, 0), (day(12), None, 1, False, "NO", 61.0, 7, 2), (day(1), "old", 1, False, None, None, None, None)]
    attention = [(day(12), "p0", 3_600_000_000, 2, 1_800_000_000, 1_800_000_000), (day(0), "gone", 60_000_000, 0, 60_000_000, 0), (day(13), "q", 60_000_000, 1, 60_000_000, 0)]
    probes = [(day(13), "m", "failed", 1), (day(13), "m", "ok", 2), (day(13), "n", "ok", 1), (day(13), "n", "late", 2), (day(0), "z", "failed", 1)]
    out = report(spark, usage, rounds, attention, probes, "2024-01-02", sizes=(7,))
    at = lambda *k: out[("7", "current", *k)]
    assert at("summary", "", "tokens") == 10 + 20 + 30 + 40 + 50 + 60 + 70 + 12 and at("summary", "", "active_days") == 7 and at("summary", "", "projects") == 9
    assert at("buckets", "loose", "tokens") == 7 and at("hosts", "x", "tokens") == 287 and at("vendors", "a", "tokens") == 120 + 12
    assert at("projects", "p6", "position") == 1 and at("projects", "other", "other_count") == 3 and at("projects", "other", "tokens") == 10 + 7 + 5
    assert at("outcomes", "", "efficiency") == 0.5 and at("outcomes", "", "median_duration") == 20 and at("outcomes", "", "cents_per_accepted") == 157 and at("outcomes", "", "specs") == 2
    assert at("recent", "s", "position") == "accepted" and at("recent", "unknown", "position") == "no" and out[("all", "current", "recent", "old", "position")] == "not accepted"
    assert at("specs", "unknown", "findings") == 2 and at("rounds_daily", str(day(12)), "median_duration") is None and at("rounds_daily", str(day(10)), "rounds") == 0
    assert at("daily", str(day(13)), "tokens") == 22 and sum(v for k, v in out.items() if k[0] == "7" and k[2] == "daily" and k[4] == "tokens") == 292
    assert (at("measurement", "", "healthy"), at("measurement", "", "total"), at("measurement", "", "gap_sources"), at("measurement", "", "ratio")) == (2, 4, 1, 0.5)
    assert at("attention", "", "hours") == 1.016667 and at("attention", "", "rework_share") == 0.491803 and at("attention", "", "transitions") == 3 and at("attention", "", "dropped_projects") == 1
    assert at("ledger", "p0", "tokens") == 10 and at("ledger", "q", "tokens") is None and at("ledger", "other", "micros") is None and at("ledger", "other", "other_count") == 3
    assert out[("all", "current", "attention", "", "dropped_projects")] is None and ("7", "usage_prior", "summary", "", "tokens") not in out
    assert ("7", "rounds_prior", "outcomes", "", "rounds") not in out and {k[1] for k in out} == {"current"}


def test_long_windows_have_few_points(spark):
    usage = [(day(i), "p", "a", "x", 1, i) for i in range(100)]
    out = report(spark, usage, [], [], [], "2024-01-02", sizes=(90,))
    daily = {k[3]: v for k, v in out.items() if k[:3] == ("all", "current", "daily") and k[4] == "tokens"}
    assert len(daily) == 34 and sum(daily.values()) == 4950 and daily[str(day(99))] == 99
    assert len({k[3] for k in out if k[:3] == ("90", "current", "daily")}) == 45


def test_report_of_nothing(spark):
    out = report(spark, [], [], [], [], "2024-01-02")
    assert out[("30", "current", "summary", "", "tokens")] == 0 and out[("30", "current", "attention", "", "hours")] is None and out[("all", "current", "measurement", "", "ratio")] is None
    assert {k[1] for k in out} == {"current"} and not any(k[2] in ("projects", "specs", "recent", "ledger") for k in out)
