"""Column expressions: identifiers, numbers, times, paths, digests, labels and privacy codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_IDENTIFIER = 160


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_identifier(c: str | Column, default: str = "unknown", pattern: str = r"^[A-Za-z0-9][A-Za-z0-9._:/@+-]*$") -> Column:
    """The trimmed text if it is at most MAX_IDENTIFIER long and fits the pattern, else the default."""
    t = F.trim(col(c))
    return F.when((F.length(t) <= MAX_IDENTIFIER) & t.rlike(pattern), t).otherwise(F.lit(default))


def safe_int(c: str | Column, default: int = 0, clamp: bool = True) -> Column:
    """A whole number from text: fractions are cut, junk gives the default, negatives become 0 if clamped."""
    x = col(c).cast("string")
    n = F.coalesce(x.try_cast("double").try_cast("long"), F.when(F.lower(x) == "true", F.lit(1)).when(F.lower(x) == "false", F.lit(0)).cast("long"), F.lit(default).cast("long"))
    return F.greatest(n, F.lit(0).cast("long")) if clamp else n


def safe_float(c: str | Column, default: float = 0.0) -> Column:
    x = col(c).cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def bounded_number(c: str | Column, low: float, high: float) -> Column:
    """The number if it is finite and within bounds, else null."""
    x = col(c)
    return F.when(~F.isnan(x) & x.between(low, high), x)


def rounded(c: str | Column, digits: int) -> Column:
    """Half away from zero on the value itself; null unless finite."""
    x = bounded_number(c, -1e300, 1e300)
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def rate(n: str | Column, d: str | Column, digits: int = 4) -> Column:
    """n / d rounded; null if d is 0."""
    scale = 10**digits
    return F.when(col(d) != 0, F.floor(col(n).cast("double") / col(d) * scale + 0.5) / scale)


def parse_utc(c: str | Column) -> Column:
    """ISO text with Z, an offset or none (UTC) to a timestamp; junk gives null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(c)), "^(\\d{4}-\\d{2}-\\d{2})T", "$1 "))


def iso(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_day(c: str | Column) -> Column:
    return F.to_date(col(c))


def week_key(c: str | Column) -> Column:
    """ISO year and week, as 2026-W53."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), col(c)), F.weekofyear(col(c)))


def weekday(c: str | Column, base: str = "monday") -> Column:
    """Monday is 0, or Sunday is 0 with base='sunday'."""
    return F.weekday(col(c)) if base == "monday" else F.dayofweek(col(c)) - 1


def clamp_duration(seconds: str | Column, cap: int) -> Column:
    """(seconds within 0..cap, whether they were outside)."""
    s = col(seconds)
    return F.struct(F.least(F.greatest(s, F.lit(0)), F.lit(cap)).alias("seconds"), ((s < 0) | (s > cap)).alias("anomalous"))


def cache_split(total: str | Column, long_lived: str | Column) -> Column:
    """Cache writes as (short, long): the long part is at most the total."""
    h = F.least(col(total), col(long_lived))
    return F.struct((col(total) - h).alias("short"), h.alias("long"))


def token_total(vendor: str | Column, a: list[str], b: list[str], first: str = "vendor_a") -> Column:
    """Vendor A: its disjoint classes; others: input and output, which contain the rest."""
    total = lambda names: sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))
    return F.when(col(vendor) == first, total(a)).otherwise(total(b))


def normalize_vendor(c: str | Column, aliases: dict[str, str], default: str = "unknown") -> Column:
    x, out = F.lower(F.trim(col(c))), F.lit(default)
    for k, v in aliases.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def canonicalize_path(c: str | Column) -> Column:
    """Forward slashes, no doubled slashes, . and .. resolved; relative gives null.

    Paths of a Windows drive, by its letter or mounted under /mnt, are in lower
    case; a share keeps its two slashes; the root of a WSL share is /.
    """
    p = F.regexp_replace(F.trim(col(c)), r"\\", "/")
    share = p.rlike("^//[^/]")
    p = F.when(share, F.concat(F.lit("//"), F.regexp_replace(F.substring(p, 3, 1 << 30), "/+", "/"))).otherwise(F.regexp_replace(p, "/+", "/"))
    wsl = p.rlike(r"(?i)^//wsl(\.localhost|\$)/[^/]+(/|$)")
    p = F.when(wsl, F.concat(F.lit("/"), F.regexp_replace(p, r"(?i)^//wsl(\.localhost|\$)/[^/]+/?", ""))).otherwise(p)
    drive = F.regexp_extract(p, "^([A-Za-z]):/", 1)
    p = F.when(drive != "", F.lower(F.concat(F.lit("/mnt/"), drive, F.substring(p, 3, 1 << 30)))).when(p.rlike("(?i)^/mnt/[a-z](/|$)"), F.lower(p)).otherwise(p)
    steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.when(p.startswith("/"), F.concat(F.when(share & ~wsl, "//").otherwise("/"), F.array_join(folded, "/")))


def path_under(path: str | Column, root: str | Column) -> Column:
    """Whether a path is the root or below it, by whole steps."""
    return (col(path) == col(root)) | col(path).startswith(F.concat(col(root), F.lit("/")))


def salted_digest(c: str | Column, salt: str, n: int, fold: bool = False) -> Column:
    """The first n hex digits of the sha256 of salt, NUL and the value; ``fold`` (for codes of projects and paths) ignores case."""
    value = F.lower(col(c)) if fold else col(c)
    return F.substring(F.sha2(F.concat(F.lit(salt + "\0"), value), 256), 1, n)


def natural_key(*cols: str | Column) -> Column:
    """sha256 of the parts joined by NUL; null parts are empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]), 256)


def category(c: str | Column, exact: dict[str, str], prefixes: dict[str, str], default: str = "other") -> Column:
    x, out = col(c), F.lit(default)
    for p, v in prefixes.items():
        out = F.when(x.startswith(p), v).otherwise(out)
    for k, v in exact.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def round_number(c: str | Column) -> Column:
    """The number in roundN, or a plain number."""
    x = col(c)
    return F.coalesce(F.nullif(F.regexp_extract(x, r"round[-_ ]?(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^(\d+)$", 1), F.lit(""))).try_cast("long")


#: How prose names the number of new findings (fixed values).
BLOCKING_PROSE = (r"(?i)(\d+)\s+NEW\s+blocking", r"(?i)NEW\s+blocking\D{0,24}(\d+)")


def blocking_findings(structured: str | Column, prose: str | Column) -> Column:
    """The size of a JSON list or object first, else a number, else the count of new findings that prose names, else 0."""
    s, p = col(structured), col(prose)
    first = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).try_cast("long")
    whole = s.try_cast("double").try_cast("long")
    number = F.when(whole.isNotNull(), F.greatest(whole, F.lit(0).cast("long")))
    return F.coalesce(F.json_array_length(s).cast("long"), F.size(F.json_object_keys(s)).cast("long"), number, *[first(f) for f in BLOCKING_PROSE], F.lit(0).cast("long"))


#: Keys whose values may name a model, at any depth (fixed values).
MODEL_KEYS = ("model", "model_id", "assistant_model")


#: Objects and lists inside each other that a model is looked for in.
DEPTH = 6


def extract_model(c: str | Column, pattern: str, keys: tuple[str, ...] = MODEL_KEYS, depth: int = DEPTH) -> Column:
    """The first identifier in JSON that stands under one of the keys (any case) and fits the pattern.

    Objects and lists are walked in the order of the text, ``depth`` levels deep;
    what stands under a key is not walked into.  Values are trimmed, escapes are
    read, texts that hold JSON are texts.  Null without a match or without JSON.
    """
    return F.get(F.filter(F.transform(_under(col(c), keys, depth), lambda x: safe_identifier(x, "")), lambda x: (x != "") & x.rlike(pattern)), F.lit(0))


def _under(node: Column, keys: tuple[str, ...], depth: int) -> Column:
    """The texts that stand under the keys, in order.  Members come as text, which keeps their order, and as variants, which tell their kinds."""
    texts = F.from_json(node, "map<string, string>")
    kinds = F.transform(F.map_values(F.from_json(node, "map<string, variant>")), lambda v: F.schema_of_variant(v))
    members = F.transform(F.map_entries(texts), lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("text"), F.get(kinds, i).alias("kind")))
    items = F.from_json(node, "array<string>")
    item_kinds = F.transform(F.from_json(node, "array<variant>"), lambda v: F.schema_of_variant(v))
    listed = F.transform(items, lambda x, i: F.struct(F.lit(None).cast("string").alias("key"), x.alias("text"), F.get(item_kinds, i).alias("kind")))
    empty = F.array().cast("array<string>")

    def of(m: Column) -> Column:
        inner = F.when(m["kind"].startswith("OBJECT") | m["kind"].startswith("ARRAY"), _under(m["text"], keys, depth - 1)).otherwise(empty) if depth > 1 else empty
        return F.coalesce(F.when(F.lower(m["key"]).isin(*keys), F.array(m["text"])).otherwise(inner), empty)

    start = F.substring(F.ltrim(node), 1, 1)
    return F.coalesce(F.flatten(F.transform(F.when(start == "{", members).when(start == "[", listed), of)), empty)


def is_accepted(flag: str | Column, verdict: str | Column, words: list[str]) -> Column:
    return F.coalesce(col(flag), F.lit(False)) | F.coalesce(F.lower(col(verdict)).isin(*words), F.lit(False))


def display_label(c: str | Column, labels: dict[str, str]) -> Column:
    x = col(c)
    out = F.initcap(F.regexp_replace(x, "[_-]+", " "))
    for k, v in labels.items():
        out = F.when(x == k, v).otherwise(out)
    return out


#: Codes and patterns of text that must not be published (fixed values).
CREDENTIALS = ("gho_", "ghp_", "sk-ant", "sk-proj", "AKIA", "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----")
SENSITIVE = {
    "absolute_path": r"/home/[A-Za-z0-9._-]+/|/mnt/[A-Za-z]/[^\s\"']+|(?<![A-Za-z0-9])[A-Za-z]:[\\/][^\s\"']+",
    "email_pattern": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9.-])",
    "machine_metadata_key": r'(?i)"hostname"\s*:',
    "phone_pattern": r"(?<!\d)(?:\+?1[ .-])?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "username_path": r"/home/[A-Za-z0-9._-]+/|/mnt/[A-Za-z]/[Uu]sers/[A-Za-z0-9._-]+/|[A-Za-z]:[\\/]+[Uu]sers[\\/]+[A-Za-z0-9._-]+[\\/]|[Uu]sers-[A-Za-z0-9._-]+-"
    r"|--wsl(?:-localhost|-dollar)?-[A-Za-z0-9._-]+-home-[A-Za-z0-9._-]+-|\\\\(?:wsl(?:\.localhost|\$)?[\\/][^\\/\s\"']+|[^\\/\s\"']+)[\\/][^\s\"']+",
}
#: What a text must contain for a pattern to be worth trying.
_HINTS = {"absolute_path": ("/home/", "/mnt/", ":\\", ":/"), "email_pattern": ("@",), "machine_metadata_key": (), "phone_pattern": (), "username_path": ("/home/", "/mnt/", "sers", "--wsl", "\\\\")}


def sensitive_reasons(text: str | Column, terms: list[str] = (), host: str = "", user: str = "") -> Column:
    """The sorted codes that a text gives reason for; never the match itself.

    ``terms``, the name of a machine and of its user are found as they are
    written, but for a user's folder on Windows, whose case doesn't matter.
    """
    c = col(text)
    has = lambda some: any_column([c.contains(x) for x in some])
    found = {code: (has(_HINTS[code]) & c.rlike(p)) if _HINTS[code] else c.rlike(p) for code, p in SENSITIVE.items()}
    found["credential_pattern"] = has(CREDENTIALS)
    if user:
        found["username_path"] = found["username_path"] | c.contains(f"/home/{user}/") | F.lower(c).contains(f"\\users\\{user}\\".lower())
    if host:
        found["machine_metadata_value"] = c.contains(f'"{host}"')
    if terms:
        found["local_denylist"] = has(terms)
    return F.array_compact(F.array(*[F.when(found[code], F.lit(code)) for code in sorted(found)]))


def any_column(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def model_bucket(models: str | Column) -> Column:
    """One model's name, 'mixed' for several, 'unknown' for none."""
    m = col(models)
    return F.when(F.size(m) == 0, "unknown").when(F.size(m) == 1, F.get(m, F.lit(0))).otherwise("mixed")


def cost_status(tokens: str | Column, unpriced: str | Column) -> Column:
    return F.when(F.coalesce(col(tokens), F.lit(0)) == 0, "unavailable").when(col(unpriced) > 0, "partial").otherwise("complete")
