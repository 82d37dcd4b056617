"""Readers for append-only JSON-lines logs and small structured files.

Malformed input never fails a read: it becomes a row with a skip reason, or
nulls.  Token fields are read as text and made numbers by ``safe_int``, since a
JSON true or "7" would be lost in a numeric column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import blocking_findings, bounded_number, extract_model, parse_utc, rounded, safe_float, safe_identifier, safe_int
from ..operators.sequence import carry_forward, cumulative_delta

_USAGE = "input_tokens string, output_tokens string, cache_read_input_tokens string, cache_creation_input_tokens string, cache_creation struct<ephemeral_5m_input_tokens string, ephemeral_1h_input_tokens string>"
MESSAGE = f"timestamp string, sessionId string, cwd string, uuid string, message struct<id string, model string, usage struct<{_USAGE.replace(' string', ': string').replace('cache_creation struct', 'cache_creation: struct')}>>"
TOTALS = "struct<input_tokens: string, cached_input_tokens: string, cache_write_tokens: string, output_tokens: string, reasoning_output_tokens: string>"
TURN = f"timestamp string, type string, payload struct<type: string, id: string, cwd: string, model: string, info: struct<total_token_usage: {TOTALS}, last_token_usage: {TOTALS}>>"
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._:/@+-]{0,159}$"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
KINDS = ["dispatch", "verdict", "merged", "finalized", "step", "proof", "escalated", "held", "note"]


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file and a position that grows within it."""
    df = spark.read.text(paths)
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_message_usage(spark: SparkSession, paths: str | list[str], any_name: bool = False) -> DataFrame:
    """Usage of messages: only lines with usage are parsed; of a repeated message the last line in its file counts.

    The id is the message's, else the line's uuid, else the place of the line.
    Cache writes are the total that the line reports, long ones at most that.
    In a file whose name is a UUID the session is the line's, else the name; in
    any other file it is a digest of the path, unless ``any_name`` (for logs under
    names of Spark's) trusts the lines there too.  A model that is no identifier is
    unknown.  Text is never kept.
    """
    rows = lines(spark, paths).filter(F.col("value").contains('"usage"')).withColumn("r", F.from_json("value", MESSAGE)).filter("r.message.usage is not null")
    u = lambda c: safe_int(F.col(f"r.message.usage.{c}"))
    place = F.concat_ws(":", "file", F.col("block").cast("string"), F.col("line").cast("string"))
    total = u("cache_creation_input_tokens")
    hour = F.least(total, safe_int(F.col("r.message.usage.cache_creation.ephemeral_1h_input_tokens")))
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    aside = F.concat(F.lit("subagent-"), F.substring(F.sha2("file", 256), 1, 24))
    named = rows.select(
        F.coalesce("r.message.id", "r.uuid", place).alias("message_id"), F.when(stem.rlike(UUID), F.coalesce("r.sessionId", stem)).otherwise(F.coalesce(*([F.col("r.sessionId")] if any_name else []), aside)).alias("session_id"), F.col("r.cwd").alias("cwd"), safe_identifier("r.message.model").alias("model"), parse_utc("r.timestamp").alias("ts"),
        u("input_tokens").alias("input_tokens"), u("output_tokens").alias("output_tokens"), u("cache_read_input_tokens").alias("cache_read_tokens"), (total - hour).alias("cache_write_5m_tokens"), hour.alias("cache_write_1h_tokens"), "file", "block", "line",
    )
    w = Window.partitionBy("file", "message_id").orderBy(F.col("block").desc(), F.col("line").desc())
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "block", "line")


def read_turn_usage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Usage of turns in tagged logs: session and model carried forward, tokens of the turn or the growth of the totals.

    A repeated report (same time and totals in a file) counts once.  A file is
    read in its input splits; what a split needs of those before it are the last
    values that each holds, so no task holds more than a split.
    """
    rows = lines(spark, paths).filter(F.col("value").rlike('"(session_meta|turn_context|token_count)"')).withColumn("r", F.from_json("value", TURN))
    kind = F.col("r.type")
    names = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_output_tokens"]
    flat = rows.select(
        "file", "block", "line", F.when(kind == "session_meta", F.col("r.payload.id")).alias("session_id"), F.when(kind.isin("session_meta", "turn_context"), F.col("r.payload.cwd")).alias("cwd"),
        F.when(kind == "turn_context", F.col("r.payload.model")).alias("model"), F.col("r.timestamp").alias("stamp"), F.col("r.payload.type").alias("inner"),
        *[F.when(F.col("r.payload.info.total_token_usage").isNotNull(), safe_int(F.col(f"r.payload.info.total_token_usage.{n}"))).alias(n) for n in names],
        F.col("r.payload.info.last_token_usage").isNotNull().alias("has_last"), *[safe_int(F.col(f"r.payload.info.last_token_usage.{n}")).alias(f"last_{n}") for n in names],
    )
    order = ["block", "line"]
    carried = carry_forward(flat, ["file"], order, ["session_id", "cwd", "model"], block="block").filter("inner = 'token_count' and input_tokens is not null")
    w = Window.partitionBy("file", "stamp", *names).orderBy(*order)
    once = carried.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    grown = cumulative_delta(once, ["file"], order, names, block="block")
    return grown.select("session_id", "cwd", safe_identifier("model").alias("model"), parse_utc("stamp").alias("ts"), *[F.when(F.col("has_last"), F.col(f"last_{n}")).otherwise(F.col(f"{n}_delta")).cast("long").alias(n) for n in names], "file")


def explode_limits(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Quota windows of a JSON map: used (0 to 100), what remains, minutes and reset time; others are left out."""
    m = F.from_json(json_col, "map<string, struct<used_percent: double, window_minutes: long, resets_at: long>>")
    rows = df.select(*keys, F.explode(m).alias("window", "v"))
    used = bounded_number("v.used_percent", 0, 100)
    return rows.select(*keys, "window", used.alias("used"), (F.lit(100) - used).alias("remaining"), F.col("v.window_minutes").alias("minutes"), F.timestamp_seconds("v.resets_at").alias("resets_at")).filter("used is not null")


def read_event_log(spark: SparkSession, path: str | list[str], kinds: list[str] = KINDS) -> DataFrame:
    """Build-log events with ``skip``: malformed, not_object, no_timestamp or null; unknown kinds become other."""
    rows = lines(spark, path).filter(F.length(F.trim("value")) > 0)
    r = F.from_json("value", "ts string, kind string, row string, round string, state string, exit string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ts = parse_utc("r.ts")
    skip = F.when(~F.trim("value").startswith("{"), "not_object").when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "malformed").when(ts.isNull(), "no_timestamp")
    return rows.withColumn("r", r).select(ts.alias("ts"), F.when(F.col("r.kind").isin(*kinds), F.col("r.kind")).otherwise("other").alias("kind"), F.col("r.row").alias("row_id"), F.col("r.round").alias("round"), F.col("r.state").alias("state"), F.col("r.exit").try_cast("long").alias("exit_code"), skip.alias("skip"))


#: The files of a complete round (fixed values).
SEALS = {"builder": "builder-identity", "judge": "judge-identity", "verdict": "merged-verdict", "digest": "digest"}
MODELS = "^(claude-|gpt-|o)"


def assemble_rounds(files: DataFrame) -> DataFrame:
    """A row for each spec and round from (path, content) of files spec/roundN/name.json.

    ``status`` is in_flight if one of the four SEALS is missing, malformed if one
    is no JSON object, else complete; only then the other columns are known:
    who built and judged, the independence levels of the judge's surfaces, the
    verdict, whether it accepts, and how many new findings block.
    """
    key = r"([^/]+)/round(\d+)/([a-z-]+)\.json$"
    at = files.select(F.regexp_extract("path", key, 1).alias("spec"), F.regexp_extract("path", key, 2).try_cast("long").alias("round"), F.regexp_extract("path", key, 3).alias("name"), "content").filter("spec <> ''")
    wide = at.groupBy("spec", "round").agg(*[F.max(F.when(F.col("name") == n, F.coalesce("content", F.lit("")))).alias(c) for c, n in SEALS.items()])
    valid = F.forall(F.array(*[F.json_object_keys(c).isNotNull() for c in SEALS]), lambda x: x)
    status = F.when(F.forall(F.array(*SEALS), lambda c: c.isNotNull()), F.when(valid, "complete").otherwise("malformed")).otherwise("in_flight")
    wide = wide.select(safe_identifier("spec").alias("spec"), "round", status.alias("status"), *[F.when(status == "complete", F.col(c)).alias(c) for c in SEALS])
    of = lambda c, path: F.get_json_object(c, f"$.{path}")
    done = F.col("status") == "complete"
    family = safe_identifier(of("builder", "family"))
    surfaces = F.map_values(F.from_json(of("judge", "surfaces"), "map<string, string>"))
    levels = F.transform(F.filter(F.coalesce(surfaces, F.array().cast("array<string>")), lambda v: v.startswith("{")), lambda v: safe_identifier(F.coalesce(F.get_json_object(v, "$.independence_level"), F.lit("unknown"))))
    final = safe_identifier(F.coalesce(of("verdict", "final"), F.lit("unknown")))
    flag = ~F.coalesce(of("verdict", "judges_accepted"), F.lit("false")).isin("false", "0", "0.0", "", "[]", "{}")
    told = lambda c: F.when(done, c)
    return wide.select(
        "spec", "round", "status", told(safe_identifier(F.coalesce(of("verdict", "row"), F.lit("")), "")).alias("row_id"),
        told(F.coalesce(safe_identifier(of("builder", "provider"), None), family)).alias("builder_vendor"),
        told(F.coalesce(extract_model("builder", MODELS), family)).alias("builder_model"),
        told(safe_identifier(of("judge", "declared.vendor"))).alias("judge_vendor"), told(safe_identifier(of("judge", "declared.model"))).alias("judge_model"), told(levels).alias("levels"),
        told(final).alias("final"), told(flag | final.isin("ACCEPT", "ACCEPTED")).alias("accepted"), told(blocking_findings(of("verdict", "merged.new_blocking"), of("verdict", "reason"))).alias("findings"),
    )


def seal_summary(rounds: DataFrame) -> DataFrame:
    """(measure, value, n): rounds by status, and of complete ones verdicts, findings, builders, judges, independence levels and the round that first accepts each spec."""
    done = rounds.filter("status = 'complete'")
    one = lambda df, name, c: df.groupBy(F.lit(name).alias("measure"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = done.filter("accepted").groupBy("spec").agg(F.min("round").alias("round"))
    out = one(rounds, "status", "status").unionByName(one(first, "accepted_at_round", "round")).unionByName(one(done.select(F.explode("levels").alias("level")), "independence", "level"))
    for name, c in (("verdict", "final"), ("findings", "findings"), ("builder_vendor", "builder_vendor"), ("builder_model", "builder_model"), ("judge_vendor", "judge_vendor"), ("judge_model", "judge_model")):
        out = out.unionByName(one(done, name, c))
    return out


def read_test_reports(spark: SparkSession, path: str) -> DataFrame:
    """Suites of XML test reports: name, tests, failures, errors and time stamp."""
    schema = "_name string, _tests long, _failures long, _errors long, _timestamp string"
    x = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(path)
    return x.select(F.col("_name").alias("name"), F.col("_tests").alias("tests"), F.col("_failures").alias("failures"), F.col("_errors").alias("errors"), F.col("_timestamp").alias("stamp"))


def facts_from_names(df: DataFrame, path: str, pattern: str, fields: list[str]) -> DataFrame:
    """The groups of a pattern in file names; names that don't fit are left out."""
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(f) for i, f in enumerate(fields)]).filter(F.col(path).rlike(pattern))


def _json_list(text: Column) -> Column:
    """The items of a JSON list as text; null for any other value."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def explode_state(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Distinct ids by set of a state snapshot, all of them; entries that are not lists are no sets."""
    m = F.from_json(json_col, "map<string, string>")
    rows = df.select(*keys, F.explode(m).alias("set_name", "ids"))
    return rows.select(*keys, "set_name", F.explode(F.array_distinct(_json_list(F.col("ids")))).alias("id"))


def explode_curves(df: DataFrame, json_col: str, keys: list[str], most: int = 100) -> DataFrame:
    """Defect curves of a state snapshot: (row_id, n, value) of ``curve_base``, a number or a list for each row.

    Only the first ``most`` values of a row are read, as the original does; those that are no finite numbers are left out.
    """
    m = F.from_json(json_col, "curve_base map<string, string>")
    rows = df.select(*keys, F.explode(m["curve_base"]).alias("row", "raw"))
    number = lambda x: rounded(F.coalesce(x.try_cast("double"), F.when(x == "true", 1.0).when(x == "false", 0.0)), 3)
    values = F.filter(F.transform(F.slice(F.coalesce(_json_list(F.col("raw")), F.array("raw")), 1, most), number), lambda x: x.isNotNull())
    return rows.select(*keys, safe_identifier("row").alias("row_id"), F.posexplode(values).alias("n", "value"))


def count_lines(df: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """Lines of a text and how many fit the pattern."""
    ls = F.split(text, "\n")
    return df.select(*keys, F.size(ls).alias("n_lines"), F.size(F.filter(ls, lambda x: x.rlike(pattern))).alias("n_matching"))


def parse_accept_log(df: DataFrame, line: str) -> DataFrame:
    """sha, day, subject and the row and digest in the subject of tab-separated lines; ``rejected`` tells what doesn't fit."""
    p = F.split(line, "\t", 3)
    day = F.get(p, F.lit(1)).try_cast("date")
    subject = F.get(p, F.lit(2))
    row = F.nullif(F.regexp_extract(subject, r"accept (\S+)", 1), F.lit(""))
    ok = F.get(p, F.lit(0)).rlike("^[0-9a-f]{7,64}$") & day.isNotNull() & row.isNotNull()
    return df.select(F.get(p, F.lit(0)).alias("sha"), day.alias("day"), row.alias("row_id"), F.regexp_extract(subject, r"\[([0-9a-f]+)\]", 1).alias("digest"), (~F.coalesce(ok, F.lit(False))).alias("rejected"))


def front_matter(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The key: value header between --- lines as a map; no header gives an empty map, of a repeated key the last value counts."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(\n|$)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entry = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda x: x["key"] == e["key"]))
    return df.select(*keys, F.map_from_entries(last).alias("header"))


def explode_provider_snapshot(df: DataFrame, json_col: str, observed: str, now: int, keys: list[str], stale_after: int = 7200) -> DataFrame:
    """Windows of a provider's snapshot, with its age and whether it is stale."""
    s = F.from_json(json_col, "provider string, windows array<struct<name: string, used: double>>")
    rows = df.select(*keys, F.col(observed).alias("_o"), s.alias("s")).select(*keys, "_o", F.col("s.provider").alias("provider"), F.explode("s.windows").alias("w"))
    return rows.select(*keys, "provider", F.col("w.name").alias("window"), bounded_number("w.used", 0, 100).alias("used"), (F.lit(now) - F.col("_o")).alias("age"), (F.lit(now) - F.col("_o") > stale_after).alias("stale"))


def provider_snapshots(df: DataFrame, json_col: str, now: int, keys: list[str], stale_after: float = 2.0) -> DataFrame:
    """One row for each provider of a snapshot, and one without a provider for a snapshot that has none.

    Of a snapshot: generated_at, age_hours (never below 0), freshness (fresh, stale, unknown),
    window_days, its skips by reason (provider_snapshot_malformed, _timestamp_absent, _stale,
    provider_entry_malformed with their counts) and status (ok; partial with skips; absent if it
    can't be read).  Of a provider: status and numbers of its usage, what remains, the quota's
    status, and quota_windows: those whose name is a safe identifier and whose value is an
    object, primary and secondary first, the others by name.  Values of a wrong kind count as
    missing; whole numbers that are missing are 0, others null.
    """
    is_object = lambda c: F.coalesce(F.trim(c).startswith("{"), F.lit(False))
    obj = lambda c: F.when(is_object(c), F.from_json(c, "map<string, string>"))
    whole = lambda c: safe_int(c, clamp=False)
    number = lambda c: rounded(safe_float(c, None), 3)
    rows = df.select(*keys, obj(F.col(json_col)).alias("_s")).withColumn("_at", parse_utc(F.col("_s")["generated_at"]))
    listed = F.col("_s")["providers"]
    entries = F.coalesce(F.when(F.trim(listed).startswith("["), F.from_json(listed, "array<string>")), F.array().cast("array<string>"))
    hours = F.when(F.col("_at").isNotNull(), F.greatest(F.lit(0.0), (F.lit(now) - F.unix_seconds("_at")) / 3600))
    rows = rows.withColumns({"_entries": entries, "_age": hours}).withColumn("_bad", F.size(F.filter("_entries", lambda e: ~is_object(e))))
    skip = lambda reason, when, n=F.lit(1): F.when(when, F.struct(F.lit(reason).alias("reason"), n.cast("long").alias("count")))
    unread = F.col("_s").isNull()
    skips = F.array_compact(F.array(
        skip("provider_snapshot_malformed", unread), skip("provider_snapshot_timestamp_absent", ~unread & F.col("_at").isNull()),
        skip("provider_snapshot_stale", F.col("_age") > stale_after), skip("provider_entry_malformed", F.col("_bad") > 0, F.col("_bad")),
    ))
    freshness = F.when(F.col("_age").isNull(), "unknown").when(F.col("_age") > stale_after, "stale").otherwise("fresh")
    status = F.when(unread, "absent").when(F.size("skips") > 0, "partial").otherwise("ok")
    rows = rows.withColumn("skips", skips).select(*keys, F.col("_at").alias("generated_at"), rounded("_age", 1).alias("age_hours"), freshness.alias("freshness"), whole(F.col("_s")["window_days"]).alias("window_days"), status.alias("status"), "skips", F.explode_outer(F.filter("_entries", is_object)).alias("_e"))
    rows = rows.withColumn("_p", obj(F.col("_e"))).withColumns({f"_{c}": obj(F.col("_p")[c]) for c in ("usage", "remaining", "quota")})
    first = lambda e: F.when(e["key"] == "primary", 0).when(e["key"] == "secondary", 1).otherwise(2)
    windows = F.filter(F.map_entries("_quota"), lambda e: is_object(e["value"]) & e["key"].rlike(SAFE_NAME))
    placed = F.array_sort(F.transform(windows, lambda e: F.struct(first(e).alias("place"), e["key"].alias("window"), F.from_json(e["value"], "map<string, string>")["remaining_percent"].alias("a"), F.from_json(e["value"], "map<string, string>")["used_percent"].alias("b"), F.from_json(e["value"], "map<string, string>")["window_minutes"].alias("c"), F.from_json(e["value"], "map<string, string>")["resets_at"].alias("d"))))
    shown = F.transform(placed, lambda w: F.struct(w["window"].alias("window"), number(w["a"]).alias("remaining_percent"), number(w["b"]).alias("used_percent"), whole(w["c"]).alias("window_minutes"), parse_utc(w["d"]).alias("resets_at")))
    of = lambda c, f, how: how(F.col(f"_{c}")[f])
    name = lambda c: F.coalesce(safe_identifier(c), F.lit("unknown"))
    own = [("usage_status", "usage", "status", name), *[(f, "usage", f, whole) for f in ("total_tokens", "input_tokens", "output_tokens", "sessions", "requests")], ("remaining_status", "remaining", "status", name), ("remaining_percent", "remaining", "percent", number), ("quota_status", "quota", "status", name)]
    there = F.col("_e").isNotNull()
    head = [*keys, "generated_at", "age_hours", "freshness", "window_days", "status", "skips"]
    return rows.select(*head, F.when(there, name(F.col("_p")["provider"])).alias("provider"), *[F.when(there, of(c, f, how)).alias(out) for out, c, f, how in own], F.when(there, F.coalesce(shown, F.array().cast("array<struct<window: string, remaining_percent: double, used_percent: double, window_minutes: long, resets_at: timestamp>>"))).alias("quota_windows"))


def explode_cached_utilization(df: DataFrame, json_col: str, now: int, max_age: int, keys: list[str]) -> DataFrame:
    """Both windows of a cached observation, or neither if one is invalid, it lies over 300 s ahead, or is too old."""
    s = F.from_json(json_col, "observed_ms long, five_hour double, seven_day double")
    at = F.floor(F.col("s.observed_ms") / 1000)
    fine = F.forall(F.array("s.five_hour", "s.seven_day"), lambda x: x.isNotNull() & x.between(0, 100)) & (at <= now + 300) & (at >= now - max_age)
    rows = df.select(*keys, s.alias("s")).filter(fine)
    return rows.select(*keys, at.alias("observed_at"), F.explode(F.array(F.struct(F.lit("five_hour").alias("window"), F.col("s.five_hour").alias("used")), F.struct(F.lit("seven_day").alias("window"), F.col("s.seven_day").alias("used")))).alias("w")).select(*keys, "observed_at", "w.*")


def read_registry(df: DataFrame, json_col: str) -> DataFrame:
    """(root, project, exact) rules of a registry in JSON: a map from project to its paths and prefixes."""
    m = F.from_json(json_col, "map<string, struct<paths: array<string>, prefixes: array<string>>>")
    rows = df.select(F.explode(m).alias("project", "r")).filter(F.col("project").rlike("^[a-z0-9][a-z0-9-]*$"))
    one = lambda c, exact: rows.select(F.explode(f"r.{c}").alias("root"), "project", F.lit(exact).alias("exact"))
    return one("paths", True).unionByName(one("prefixes", False)).distinct()


def parse_run_log(df: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """<time> mode=<m> trigger=<t> start|finish exit=<n>; other lines are malformed."""
    p = r"^(\S+) mode=(\w+) trigger=(\w+) (start|finish)(?: exit=(-?\d+))?$"
    g = lambda i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    return df.select(*keys, parse_utc(g(1)).alias("ts"), g(2).alias("mode"), g(3).alias("trigger"), g(4).alias("event"), g(5).try_cast("long").alias("exit_code"), (~F.col(line).rlike(p)).alias("malformed"))


def classify_intervals(df: DataFrame, json_col: str, projects: list[str], modes: list[str], now: int, keys: list[str]) -> DataFrame:
    """Intervals of a ledger with the first reason to leave each out, or null.

    The key set is closed; lines have at most 4096 bytes.
    """
    fields = ["schema_version", "event_id", "project_id", "mode", "started_at", "ended_at", "status"]
    r = F.from_json(json_col, ", ".join(f"{f} string" for f in fields))
    raw = F.from_json(json_col, "map<string, string>")
    start, end = F.unix_seconds(parse_utc("r.started_at")), F.unix_seconds(parse_utc("r.ended_at"))
    reason: Column = (
        F.when(F.octet_length(json_col) > 4096, "too_long")
        .when(F.col("m").isNull(), "malformed")
        .when(F.array_sort(F.map_keys("m")) != F.array(*[F.lit(f) for f in sorted(fields)]), "fields")
        .when(F.col("r.schema_version") != "1", "version")
        .when(~F.col("r.project_id").isin(*projects), "project")
        .when(~F.col("r.mode").isin(*modes), "mode")
        .when(F.col("r.status") != "complete", "status")
        .when(start.isNull() | end.isNull(), "timestamp")
        .when(end <= start, "empty")
        .when(end > now, "future")
    )
    rows = df.withColumn("r", r).withColumn("m", raw)
    return rows.select(*keys, F.col("r.event_id").alias("event_id"), F.col("r.project_id").alias("project_id"), F.col("r.mode").alias("mode"), start.alias("started_at"), end.alias("ended_at"), reason.alias("exclude_reason"))


def source_meta(df: DataFrame, source: str, ts: str, skipped: Column) -> DataFrame:
    """By source: status, coverage, rows taken and skipped."""
    n, bad = F.count_if(~skipped), F.count_if(skipped)
    status = F.when(n == 0, "empty").when(bad > 0, "partial").otherwise("ok")
    seen = F.when(~skipped, F.col(ts))
    return df.groupBy(source).agg(status.alias("status"), F.min(seen).alias("covers_from"), F.max(seen).alias("covers_to"), n.alias("ingested"), bad.alias("skipped"))


def write_observed(df: DataFrame, path: str, source: str, ts: str, reason: str, reasons: list[str]) -> DataFrame:
    """Write the rows that have no skip reason as Parquet; one row of what was seen on the way, from the same pass.

    Status (empty, partial, ok), coverage and high water (the greatest ``ts``), how
    many rows were taken, and a map of skips by reason, those of ``reasons`` that
    occurred and the rest as other.
    """
    seen = Observation(f"meta-{uuid.uuid4().hex}")
    taken, why = F.col(reason).isNull(), F.coalesce(F.col(reason), F.lit(""))
    counts = [F.count_if(why == r).alias(f"skip{i}") for i, r in enumerate(reasons)]
    rows = df.observe(seen, F.count_if(taken).alias("ingested"), F.count(F.lit(1)).alias("n"), F.min(F.when(taken, F.col(ts))).alias("covers_from"), F.max(F.when(taken, F.col(ts))).alias("covers_to"), F.max(F.col(ts)).alias("high_water"), *counts)
    rows.filter(taken).write.mode("overwrite").parquet(path)
    got = seen.get
    skips = {r: got[f"skip{i}"] for i, r in enumerate(reasons) if got[f"skip{i}"]}
    if other := got["n"] - got["ingested"] - sum(skips.values()):
        skips["other"] = other
    status = "empty" if not got["ingested"] else "partial" if skips else "ok"
    kind = df.schema[ts].dataType.simpleString()
    row = (source, status, got["covers_from"], got["covers_to"], got["high_water"], got["ingested"], sorted(skips.items()))
    schema = f"source string, status string, covers_from {kind}, covers_to {kind}, high_water {kind}, ingested long, skips array<struct<reason: string, count: long>>"
    return df.sparkSession.createDataFrame([row], schema)


def with_last_good(fresh: DataFrame | None, cache: DataFrame, available: bool) -> DataFrame:
    """Fresh rows if the source is available, else the cached ones; ``cached_last_good`` says which."""
    if available and fresh is not None:
        return fresh.withColumn("cached_last_good", F.lit(False))
    return cache.withColumn("cached_last_good", F.lit(True))
