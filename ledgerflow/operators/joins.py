"""Joins by rules, marks, overlaps and registries."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Kept, connected
from .intervals import DAY, least_touching, overlap_pairs


def resolve_by_prefix(df: DataFrame, rules: DataFrame, path: str, default: str) -> DataFrame:
    """The project of the best rule for a path: exact before prefix, then longest, then least id.

    ``rules`` (root, project, exact) is joined by equality with the path's own
    ancestors, so its number doesn't multiply the rows.  Paths without a rule get
    the default.
    """
    steps = F.split("_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    spread = df.select(F.col(path).alias("_path")).distinct().withColumn("root", F.explode(ups))
    hits = spread.join(rules, "root").filter(~F.col("exact") | (F.col("root") == F.col("_path")))
    best = hits.groupBy("_path").agg(F.min_by("project", F.struct((~F.col("exact")).alias("e"), (-F.length("root")).alias("l"), F.col("project").alias("p"))).alias("project"))
    return df.join(best, F.col(path) == F.col("_path"), "left").drop("_path").withColumn("project", F.coalesce("project", F.lit(default)))


def resolve_project(df: DataFrame, tails: DataFrame, mappings: DataFrame, path: str, source: str, salt: str) -> DataFrame:
    """Adds project, resolution, candidate_code and registered to rows by layers of rules; case is folded throughout.

    ``path`` is a canonical path or null, ``source`` the relative path of the log.
    The first that holds: the source's first part begins with ssh- (remote); the
    path's last name is in ``tails`` (tail, project); ``mappings`` (root, project,
    exact) has the path or, unless exact, one of its ancestors: the longest root,
    then the least project; else ad hoc, with a code of the path or, without one,
    of the source.  Rules are joined by equality with the names that a distinct
    path derives, so their number doesn't multiply the rows.
    """
    folded = F.lower(F.col(path))
    top = F.lower(F.split_part(F.regexp_replace(F.ltrim(F.translate(F.col(source), "\\", "/"), F.lit("/")), r"^(\./)+", ""), F.lit("/"), F.lit(1)))
    steps = F.split("_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("path").alias("kind"), F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("key")))
    names = F.array_append(ups, F.struct(F.lit("tail").alias("kind"), F.element_at(steps, -1).alias("key")))
    spread = df.select(folded.alias("_path")).filter("_path is not null").distinct().withColumn("_n", F.explode(names)).select("_path", "_n.kind", "_n.key")
    root = F.lower(F.when(F.length("root") > 1, F.rtrim(F.col("root"), F.lit("/"))).otherwise(F.col("root")))
    rules = tails.select(F.lit("tail").alias("kind"), F.lower("tail").alias("key"), "project", F.lit(False).alias("exact")).unionByName(mappings.select(F.lit("path").alias("kind"), root.alias("key"), "project", "exact"))
    hits = spread.join(rules.distinct(), ["kind", "key"]).filter((F.col("kind") == "tail") | ~F.col("exact") | (F.col("key") == F.col("_path")))
    order = F.struct((F.col("kind") != "tail").alias("layer"), (-F.length("key")).alias("shorter"), F.col("project").alias("least"))
    how = F.when(F.col("kind") == "tail", "public_tail").when(F.col("key") == F.col("_path"), "registry_exact").otherwise("registry_rollup")
    best = hits.groupBy("_path").agg(F.min_by(F.struct("project", how.alias("how")), order).alias("_best"))
    remote = F.coalesce(top.startswith("ssh-"), F.lit(False))
    adhoc = ~remote & F.col("_best").isNull()
    code = F.concat(F.lit("proj-"), F.substring(F.sha2(F.concat(F.lit(salt + "\0"), F.coalesce(folded, F.concat(F.lit("source:"), F.coalesce(top, F.lit(""))))), 256), 1, 8))
    rows = df.join(best, folded == F.col("_path"), "left")
    return rows.withColumns({
        "project": F.when(remote, "remote").otherwise(F.coalesce("_best.project", F.lit("ad-hoc"))),
        "resolution": F.when(remote, "remote_source").when(F.col("_best").isNotNull(), F.col("_best.how")).when(F.col(path).isNotNull(), "unregistered_cwd").otherwise("cwd_unavailable"),
        "candidate_code": F.when(adhoc, code), "registered": ~adhoc,
    }).drop("_path", "_best")


def usage_between_marks(turns: DataFrame, marks: DataFrame, keys: list[str], pos: str, sums: list[str]) -> DataFrame:
    """For each mark the turns after the mark before it, up to it.

    Turns are given the first mark at or after them by one ordered pass over both.
    """
    t = turns.select(*keys, F.col(pos).alias("_pos"), F.lit(None).cast("long").alias("mark"), *sums)
    m = marks.select(*keys, F.col("mark").alias("_pos"), F.col("mark").cast("long").alias("mark"), *[F.lit(0).cast("long").alias(s) for s in sums])
    after = Window.partitionBy(*keys).orderBy("_pos", F.col("mark").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    placed = t.unionByName(m).withColumn("_to", F.first("mark", ignorenulls=True).over(after)).filter("_to is not null")
    return placed.groupBy(*keys, F.col("_to").alias("mark")).agg(*[F.sum(s).alias(s) for s in sums], (F.count(F.lit(1)) - F.count("mark")).alias("turns"))


def correlate_sessions(rounds: DataFrame, sessions: DataFrame, keys: list[str], margin: int, bin: int | None = None) -> DataFrame:
    """Round and session pairs with equal keys whose spans overlap within a margin; ``bin`` spreads a hot key over time."""
    return overlap_pairs(rounds, sessions, keys, ("started", "ended"), ("first", "last"), margin=margin, bin=bin)


def assign_once(pairs: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """Each session to one round: exact pairs before correlated, then the earliest end, then the lesser round.

    ``pairs`` has round_id, session_id, ended and exact; reserved session ids are left out.
    """
    rows = pairs if reserved is None else pairs.join(reserved.select("session_id").distinct(), "session_id", "left_anti")
    w = Window.partitionBy("session_id").orderBy(F.col("exact").desc(), "ended", "round_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("round_id", "session_id", F.when(F.col("exact"), "exact").otherwise("correlated").alias("tier"))


#: What a strict assignment says of a round (fixed values).
FLAGS = {
    "unknown": "judge_vendor_unknown", "none": "judge_usage_unattributed", "twice": "duplicate_surface_session", "builder": "observed_session_is_builder",
    "missing": "observed_session_missing", "overlap": "cwd_and_round_window_correlation",
}


@dataclass(frozen=True)
class Overlaps:
    """Which sessions a round may take by time, told by spans, so that the pairs need not be made.

    ``rounds`` has round_id, started and ended, ``sessions`` session_id, first and
    last, both the keys; those overlap whose keys are equal and whose spans touch
    within the margin.
    """

    rounds: DataFrame
    sessions: DataFrame
    keys: list[str]
    margin: int
    bin: int = DAY

    def among(self, pairs: DataFrame) -> DataFrame:
        """The (round_id, session_id) of ``pairs`` that overlap."""
        r, s = self.rounds.select("round_id", *self.keys, "started", "ended"), self.sessions.select("session_id", *self.keys, "first", "last")
        near = (F.col("started") <= F.col("last") + self.margin) & (F.col("ended") >= F.col("first") - self.margin)
        return pairs.select("round_id", "session_id").join(r, "round_id").join(s, ["session_id", *self.keys]).filter(near).select("round_id", "session_id").distinct()

    def first(self, takers: DataFrame, barred: DataFrame) -> DataFrame:
        """(round_id, vendor, session_id): the first of the takers (round_id, vendor, ended) that overlaps a session which isn't barred (vendor, session_id)."""
        turn = takers.select("round_id", "vendor", F.col("ended").isNotNull().cast("int").alias("_closed"), F.coalesce(F.col("ended").cast("long"), F.lit(0)).alias("_turn"))
        r = self.rounds.select("round_id", *self.keys, "started", "ended").join(turn, "round_id")
        s = self.sessions.select("session_id", *self.keys, "first", "last").join(r.select(*dict.fromkeys([*self.keys, "vendor"])).distinct(), self.keys).join(barred, ["vendor", "session_id"], "left_anti")
        got = least_touching(s, r, list(dict.fromkeys([*self.keys, "vendor"])), ("first", "last"), ("started", "ended"), ["vendor", "session_id"], ["_closed", "_turn", "round_id"], 1, self.margin, self.bin)
        return got.select(F.get("least", F.lit(0))["round_id"].alias("round_id"), "vendor", "session_id")


def assign_once_strict(rounds: DataFrame, sessions: DataFrame, overlaps: DataFrame | Overlaps, builders: DataFrame, vendors: list[str], reserved: DataFrame | None = None) -> DataFrame:
    """Sessions to rounds in the order of the rounds' ends, each session once: round_id, tier, sessions, flags, expected, found.

    ``rounds`` has round_id, vendor, ended, expected and ``own``, the session ids
    that its surfaces report (null counts as none, repeats are flagged);
    ``sessions`` (vendor, session_id) those that are known, ``overlaps`` those that
    a round may take by time, as pairs (round_id, session_id) or as spans,
    ``builders`` (vendor, session_id) those that built and never judge.  A round
    takes its own sessions, tier exact, if they are as many as expected, all known,
    no builder's and all free.  Else it takes, tier correlated, all free sessions
    that it overlaps, but no builder's and none that another round reports (or that
    ``reserved`` (vendor, session_id) names) unless it reports it too.  Else it is
    unattributed.  Rounds without an end come first, equal ends go by round_id.

    A reported session is only ever taken by rounds that report it.  So the rounds
    that take their own are found among reports alone: the components of rounds
    and reported sessions by joins, each then read through in order, with no more
    in memory than what it has taken.  Any other session goes to the first round,
    of those that don't take their own, that it overlaps.
    """
    keep, pair = Kept(rounds.sparkSession), ["vendor", "session_id"]
    known = rounds.filter(F.col("vendor").isin(*vendors)).withColumn("own", F.filter(F.coalesce("own", F.array().cast(rounds.schema["own"].dataType)), lambda x: x.isNotNull()))
    known = keep.save(known.select("round_id", "vendor", "ended", "expected", "own"), "known")
    flag = lambda df, name: df.select(*pair).distinct().withColumn(name, F.lit(True))
    own = known.select("round_id", "vendor", F.posexplode(F.array_distinct("own")).alias("place", "session_id"))
    own = keep.save(own.join(flag(sessions, "is_known"), pair, "left").join(flag(builders, "builds"), pair, "left"), "own")
    told = own.groupBy("round_id").agg(F.count(F.lit(1)).alias("n_ids"), F.count("is_known").alias("n_known"), F.count("builds").alias("n_builders"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    facts = known.join(told, "round_id", "left").select("round_id", "vendor", "ended", "expected", F.size("own").alias("n_own"), none("n_ids"), none("n_known"), none("n_builders"))
    facts = facts.withColumn("complete", (F.col("expected") > 0) & (F.col("n_ids") == F.col("expected")) & (F.col("n_known") == F.col("expected")) & (F.col("n_builders") == 0))
    facts = keep.save(facts, "facts")
    near = overlaps.among(own) if isinstance(overlaps, Overlaps) else overlaps.select("round_id", "session_id").distinct()
    edges = own.join(near.withColumn("near", F.lit(True)), ["round_id", "session_id"], "left").join(facts.select("round_id", "ended", F.coalesce("complete", F.lit(False)).alias("complete")), "round_id")
    edges = edges.select("round_id", "ended", *pair, "place", "complete", (F.col("near").isNotNull() & F.col("builds").isNull()).alias("free"))
    edges = keep.save(edges.filter("complete or free"), "edges")
    linked = edges.groupBy("round_id", "vendor").agg(F.min("session_id").alias("least"), F.collect_list("session_id").alias("ids")).withColumn("session_id", F.explode("ids")).filter("session_id <> least")
    parts = connected(linked.select(F.struct("vendor", F.col("least").alias("session_id")).alias("a"), F.struct(*pair).alias("b")))
    parts = parts.select("node.*", F.col("component.session_id").alias("component"))
    dealt = edges.join(parts, pair, "left").withColumn("component", F.coalesce("component", "session_id"))
    place = ["vendor", "component"]
    dealt = dealt.repartition(*place).sortWithinPartitions(*place, "ended", "round_id", "place").select(*place, "round_id", "session_id", "complete", "free")

    def chain(frames):
        part, taken, mine = None, set(), []

        def decide():
            exact = mine[0][3] and not any(s in taken for _, _, s, _, _ in mine)
            new = [(r, v, s, exact, n) for n, (v, r, s, _, free) in enumerate(mine) if exact or free and s not in taken]
            taken.update(s for _, _, s, _, _ in new)
            return new

        for pdf in frames:
            out = []
            for v, c, r, s, complete, free in zip(*(pdf[name].tolist() for name in (*place, "round_id", "session_id", "complete", "free"))):
                if mine and (mine[0][1] != r or part != (v, c)):
                    out += decide()
                    mine = []
                if part != (v, c):
                    part, taken = (v, c), set()
                mine.append((v, r, s, complete, free))
            yield pd.DataFrame(out, columns=["round_id", *pair, "exact", "n"])
        if mine:
            yield pd.DataFrame(decide(), columns=["round_id", *pair, "exact", "n"])

    kind = {f.name: f.dataType.simpleString() for f in edges.schema}
    chosen = keep.save(dealt.mapInPandas(chain, f"round_id {kind['round_id']}, vendor {kind['vendor']}, session_id {kind['session_id']}, exact boolean, n int"), "chosen")
    takers = facts.select("round_id", "vendor", "ended").join(chosen.filter("exact").select("round_id").distinct(), "round_id", "left_anti")
    barred = builders.select(*pair).unionByName(own.select(*pair))
    barred = (barred if reserved is None else barred.unionByName(reserved.select(*pair))).distinct()
    if isinstance(overlaps, Overlaps):
        others = overlaps.first(takers, barred)
    else:
        order = F.struct(F.col("ended").isNotNull().alias("closed"), "ended", "round_id")
        others = overlaps.select("round_id", "session_id").join(takers, "round_id").join(barred, pair, "left_anti").groupBy(*pair).agg(F.min_by("round_id", order).alias("round_id"))
    found = chosen.select("round_id", "session_id", "exact", "n").unionByName(others.select("round_id", "session_id", F.lit(False).alias("exact"), F.lit(0).alias("n")))
    found = found.withColumn("n", F.when(F.col("exact"), F.col("n")).otherwise(0))
    taken = found.groupBy("round_id").agg(F.when(F.bool_or("exact"), "exact").otherwise("correlated").alias("tier"), F.array_sort(F.collect_list(F.struct("n", "session_id"))).alias("s"))
    out = facts.join(taken, "round_id", "left").withColumn("tier", F.coalesce("tier", F.lit("unattributed")))
    when = lambda name, c: F.when(c, F.lit(FLAGS[name]))
    flags = F.array(
        when("twice", F.col("n_own") != F.col("n_ids")), when("builder", F.col("n_builders") > 0), when("missing", (F.col("tier") != "exact") & (F.col("n_ids") > 0) & (F.col("n_known") != F.col("n_ids"))),
        when("overlap", F.col("tier") == "correlated"), when("none", F.col("tier") == "unattributed"),
    )
    ids = F.coalesce(F.transform("s", lambda x: x["session_id"]), F.array().cast(f"array<{kind['session_id']}>"))
    found = out.select("round_id", "tier", ids.alias("sessions"), F.array_sort(F.array_compact(flags)).alias("flags"), F.col("expected").cast("long").alias("expected"), F.size(ids).cast("long").alias("found"))
    other = rounds.filter(~F.coalesce(F.col("vendor").isin(*vendors), F.lit(False)))
    return found.unionByName(other.select("round_id", F.lit("unattributed").alias("tier"), F.array().cast(f"array<{kind['session_id']}>").alias("sessions"), F.array(F.lit(FLAGS["unknown"])).alias("flags"), F.col("expected").cast("long").alias("expected"), F.lit(0).cast("long").alias("found")))


def spec_ledger(rounds: DataFrame, created: DataFrame, accepted: DataFrame, timing: DataFrame) -> DataFrame:
    """By spec: rounds, money, findings, days from creation to acceptance (not negative) and timing, each null if unknown."""
    g = rounds.groupBy("spec").agg(F.count(F.lit(1)).alias("rounds"), F.sum("cents").alias("cents"), F.sum("findings").alias("findings"))
    j = g.join(created, "spec", "left").join(accepted, "spec", "left").join(timing, "spec", "left")
    return j.withColumn("lead_days", F.greatest(F.lit(0), F.datediff("accepted_on", "created_on")))


def attention_cost_ledger(attention: DataFrame, cost: DataFrame, key: str) -> DataFrame:
    """All keys of both sides; what a side lacks stays null."""
    return attention.join(cost, key, "full_outer")


def by_code(df: DataFrame, ids: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Sums by code of rows whose key is a code or a public id, with how the key was understood.

    ``ids`` has code and public_id.  A key that is a code stands for itself (code),
    else a public id for its code (public); one that has several codes is kept as
    it is (ambiguous), as is one that is neither (unknown).
    """
    pairs = ids.select("code", "public_id").filter("code is not null and public_id is not null").distinct()
    codes = pairs.groupBy(F.col("code").alias("_key")).agg(F.lit("code").alias("_how"), F.min("code").alias("_code"))
    names = pairs.groupBy(F.col("public_id").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("code").alias("_code")).join(codes.select("_key"), "_key", "left_anti")
    known = codes.unionByName(names.select("_key", F.when(F.col("_n") > 1, "ambiguous").otherwise("public").alias("_how"), F.when(F.col("_n") == 1, F.col("_code")).alias("_code")))
    rows = df.groupBy(F.col(key).alias("_key")).agg(*[F.sum(c).alias(c) for c in sums]).join(known, "_key", "left")
    how = F.when(F.col("_how").isin("code", "public"), "resolved").otherwise(F.coalesce("_how", F.lit("unknown")))
    return rows.groupBy(F.coalesce("_code", "_key").alias("code"), how.alias("state")).agg(*[F.sum(c).alias(c) for c in sums])


def two_way_ledger(attention: DataFrame, cost: DataFrame, ids: DataFrame, key: str, attention_sums: list[str], cost_sums: list[str]) -> DataFrame:
    """All codes of both sides, each side's keys being codes or public ids; what a side lacks stays null, ambiguous and unknown keys stand apart."""
    return by_code(attention, ids, key, attention_sums).join(by_code(cost, ids, key, cost_sums), ["code", "state"], "full_outer")


def add_missing(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """The rows and, for registered keys without one, a row of nulls."""
    extra = registry.select(key).join(df.select(key), key, "left_anti")
    return df.unionByName(extra, allowMissingColumns=True)


def keep_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def keep_not_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def orphans(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None) -> DataFrame:
    """Keys that the dimension lacks; must be empty."""
    names: Column = F.col(dimension_key or key).alias(key)
    return df.select(key).distinct().join(dimension.select(names), key, "left_anti")
