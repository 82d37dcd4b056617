"""Chat formatting: records of many layouts to canonical turns, then to marked text with a loss mask.

The schema fingerprint of a record is a hash of its nested field paths.  A
registry of declarative mappings, keyed by fingerprint, says how each known
layout becomes turns of (role, text); a new layout is one more entry.  Formatted
text marks turns with ``<turn role="...">`` and ``</turn>``; inside texts and
roles ``<`` and ``\\`` (and ``"``) are escaped, so no text can look like a mark
and everything can be read back.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import free_name, prepare

TURNS = "array<struct<role:string,text:string>>"


def paths_of_type(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a type; elements of an array are ``[]``, values of a map ``{}``."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in paths_of_type(f.dataType, f"{at}.{f.name}")}
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return paths_of_type(kind.valueType, f"{at}{{}}")
    return {at}


def paths_of_value(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of_value(v, f"{at}.{k}")} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths_of_value(v, f"{at}[]")} or {at}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """A known layout: its fields, the turns as a SQL expression over the record r, and fields that may be absent."""

    name: str
    schema: str
    turns: str
    extra: tuple[str, ...] = ()

    def fingerprints(self) -> set[str]:
        """Of the layout with and without each set of its optional top-level fields."""
        fields = T._parse_datatype_string(self.schema).fields
        out = set()
        for bits in range(1 << len(self.extra)):
            drop = {x for i, x in enumerate(self.extra) if bits >> i & 1}
            out.add(fingerprint(paths_of_type(T.StructType([f for f in fields if f.name not in drop]))))
        return out


def _pair(first: str, second: str, system: str = "") -> str:
    turn = lambda role, text: f"named_struct('role', '{role}', 'text', {text})"
    made = f"array({turn('user', first)}, {turn('assistant', second)})"
    return f"if({system} is null, {made}, concat(array({turn('system', system)}), {made}))" if system else made


LAYOUTS = (
    Layout("messages", "id string, messages array<struct<role string, content string>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))", ("id",)),
    Layout("from_value", "id string, conversations array<struct<from string, value string>>", "transform(r.conversations, m -> named_struct('role', case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end, 'text', m.value))", ("id",)),
    Layout("instruction", "id string, instruction string, input string, output string, system string", _pair("concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input)))", "r.output", "r.system"), ("id", "input", "system")),
    Layout("prompt", "id string, prompt string, response string, system string", _pair("r.prompt", "r.response", "r.system"), ("id", "system")),
    Layout("prompt_completion", "id string, prompt string, completion string", _pair("r.prompt", "r.completion"), ("id",)),
    Layout("question", "id string, question string, answer string", _pair("r.question", "r.answer"), ("id",)),
    Layout("dialog", "id string, dialog array<string>", "transform(r.dialog, (t, i) -> named_struct('role', if(i % 2 = 0, 'user', 'assistant'), 'text', t))", ("id",)),
)

#: Tables with a row for each turn: key, order, role and text columns by fingerprint.
TURN_ROWS = {fingerprint({f".{c}" for c in cols}): cols for cols in (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "speaker", "utterance"), ("id", "index", "from", "value"))}


def canonical_turns(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role, text) to rows with JSON text in ``column``.

    A record whose fingerprint no mapping has, malformed JSON and null keep
    their row with null layout and turns.  Fields with null values count as
    present.  An empty array has the path of the array itself; it matches the
    layout's name only if registered so.  Columns of the caller stay: a new one
    whose name is taken gets underscores behind it (``free_name``).
    """
    prepare(records.sparkSession)

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        def one(x):
            try:
                v = json.loads(x)
            except (TypeError, ValueError, RecursionError):
                return None
            return fingerprint(paths_of_value(v)) if isinstance(v, dict) else None

        return texts.map(one)

    print_, layout_, turns_ = (free_name(records, n) for n in ("_fingerprint", "layout", "turns"))
    key, name, turns = F.col(print_), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        hit = key.isin(sorted(layout.fingerprints()))
        made = F.expr(f"element_at(transform(array(from_json(`{column}`, '{layout.schema}')), r -> {layout.turns}), 1)")
        name, turns = F.when(hit, layout.name).otherwise(name), F.when(hit, made.cast(TURNS)).otherwise(turns)
    return records.withColumn(print_, read(F.col(column))).withColumns({layout_: name, turns_: turns}).drop(print_)


def gather_turns(rows: DataFrame) -> DataFrame:
    """conv_id and turns from a table with a row for each turn, its columns found by fingerprint.

    Rows are ordered by turn, then role, then text, nulls first; null roles and
    texts become empty.  Repeated rows stay.  Columns beside the known ones are
    ignored; a table without a known set of columns raises ValueError.
    """
    names = set(rows.columns)
    known = [cols for cols in TURN_ROWS.values() if names >= set(cols)]
    exact = TURN_ROWS.get(fingerprint(paths_of_type(rows.schema)))
    if not exact and not known:
        raise ValueError("no mapping has these columns: " + ", ".join(sorted(names)))
    key, order, role, text = exact or known[0]
    none = F.lit("")
    turn = F.struct(F.col(order).alias("at"), F.coalesce(F.col(role), none).alias("role"), F.coalesce(F.col(text), none).alias("text"))
    return (
        rows.groupBy(F.col(key).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def _escape(texts: pa.Array) -> pa.Array:
    for plain, mark in (("\\", "\\b"), ("<", "\\l"), ('"', "\\q")):
        texts = pc.replace_substring(texts, plain, mark)
    return texts


def _unescape(text: str) -> str:
    return text.replace("\\q", '"').replace("\\l", "<").replace("\\b", "\\") if "\\" in text else text


def _rows(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The bounds of the rows of a list column among all its items; a null row has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), lists.flatten()


def format_turns(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (start and length in code points) to rows with ``turns``.

    One pass over all turns of a batch, linear in their number.  Null turns give
    null; no turns give an empty text without spans; null roles and texts are
    empty.  Columns of the caller stay: a new one whose name is taken gets
    underscores behind it (``free_name``).
    """
    prepare(df.sparkSession)

    @F.arrow_udf("struct<formatted: string, loss_spans: array<struct<start: int, length: int>>>")
    def write(turns: pa.Array) -> pa.Array:
        at, items = _rows(turns)
        role, text = (pc.fill_null(items.field(k), "") for k in (0, 1))
        head = pc.binary_join_element_wise('<turn role="', _escape(role), '">', "")
        body = _escape(text)
        whole = pc.binary_join_element_wise(head, body, "</turn>\n", "")
        sizes = pc.utf8_length(whole).to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        start = ends[:-1] - np.repeat(ends[at[:-1]], np.diff(at)) + pc.utf8_length(head).to_numpy()
        loss = np.flatnonzero(pc.is_in(role, pa.array(loss_roles)).to_numpy(zero_copy_only=False))
        span = pa.StructArray.from_arrays([pa.array(start[loss], pa.int32()), pc.utf8_length(body).take(pa.array(loss)).cast(pa.int32())], ["start", "length"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, at), pa.int32()), span)
        formatted = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), whole), "")
        none = turns.is_null()
        return pa.StructArray.from_arrays([formatted, spans], ["formatted", "loss_spans"], mask=none)

    made, formatted, spans = (free_name(df, n) for n in ("_made", "formatted", "loss_spans"))
    same = F.transform("turns", lambda t: F.struct(t["role"].cast("string").alias("role"), t["text"].cast("string").alias("text")))
    out = df.withColumn(made, write(same))
    return out.withColumns({formatted: F.col(f"{made}.formatted"), spans: F.col(f"{made}.loss_spans")}).drop(made)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    roles = F.regexp_extract_all(formatted, F.lit('<turn role="([^"<]*)">([^<]*)</turn>'), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit('<turn role="([^"<]*)">([^<]*)</turn>'), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in one pass over a text; needs the package shipped (``prepare``)."""

    @F.arrow_udf("array<string>")
    def under(formatted: pa.Array, spans: pa.Array) -> pa.Array:
        at, items = _rows(spans)
        start, length = (items.field(k).to_pylist() for k in (0, 1))
        found = []
        for text, a, b in zip(formatted.to_pylist(), at, at[1:]):
            found += [_unescape(text[s : s + n]) for s, n in zip(start[a:b], length[a:b])]
        return pa.ListArray.from_arrays(pa.array(at), pa.array(found, pa.string()), mask=spans.is_null())

    return under(formatted, spans)


def records_of_turns(gathered: DataFrame) -> DataFrame:
    """conv_id and record: the turns as JSON in one of the known layouts, chosen by their shape and conv_id.

    Only a layout that holds these turns whole is taken: one of two fields for a
    question with its answer, a list without roles for turns that alternate, the
    vendor's names for roles that aren't those names themselves.
    """
    roles = F.transform("turns", lambda t: t["role"])
    text = lambda i: F.get("turns", F.lit(i))["text"]
    pick = lambda n: F.pmod(F.xxhash64("conv_id"), F.lit(n))
    record = lambda *cols: F.to_json(F.struct(*cols))
    turn = lambda role, name: F.transform("turns", lambda t: F.struct(role(t["role"]).alias(name[0]), t["text"].alias(name[1])))
    vendor = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    pairs = [
        record(text(0).alias("instruction"), text(1).alias("output")), record(text(0).alias("prompt"), text(1).alias("response")),
        record(text(0).alias("prompt"), text(1).alias("completion")), record(text(0).alias("question"), text(1).alias("answer")),
    ]
    pair = pairs[-1]
    for i, p in enumerate(pairs[:-1]):
        pair = F.when(pick(4) == i, p).otherwise(pair)
    asked = roles == F.array(F.lit("user"), F.lit("assistant"))
    told = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    alternate = F.forall(F.transform(roles, lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    made = (
        F.when(asked, pair)
        .when(told, record(text(1).alias("prompt"), text(2).alias("response"), text(0).alias("system")))
        .when(alternate & (pick(3) == 0), record(F.transform("turns", lambda t: t["text"]).alias("dialog")))
        .when(~F.arrays_overlap(roles, F.array(F.lit("human"), F.lit("gpt"))) & (pick(3) == 1), record(turn(vendor, ("from", "value")).alias("conversations")))
        .otherwise(record(turn(lambda r: r, ("role", "content")).alias("messages")))
    )
    return gathered.select("conv_id", made.alias("record"))
