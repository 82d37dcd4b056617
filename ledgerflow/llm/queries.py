"""One query for each operator, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counting, decontamination, fingerprints, language, line_rules, near_duplicates, packing, phrases, sharding, token_files, toxicity, whitening
from .jobs import join_ids, prepare, table

SHARDS = 40


def held_out(key: str, folds: int, fold: int):
    return F.crc32(F.col(key).cast("string")) % folds == fold


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = chat.records_of_turns(chat.gather_turns(rows.unionByName(own)))
    formatted = chat.format_turns(chat.canonical_turns(records))
    read = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, length(role) + length(text)
      + 2 * 0 + length(role || text) - length(replace(role || text, '\', ''))
      + length(role || text) - length(replace(role || text, '<', ''))
      + length(role || text) - length(replace(role || text, '"', ''))
      + length('<turn role="">') + length('</turn>') + 1 as chars
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') from benchmark),
spread as (
  select kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) as k from words where len(w) > 0),
shingles as (
  select distinct kind, id, array_to_string(w[k:k + 4], ' ') as s from spread),
items as (select id, s, count(*) over (partition by id) as n_item from shingles where kind = 'i')
select d.id as doc_id, i.id as item_id, count(*) as n_shared, cast(any_value(i.n_item) as bigint) as n_item
from shingles d join items i on d.s = i.s and d.kind = 'd'
group by d.id, i.id having count(*) * 100 >= any_value(i.n_item) * 80
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents"), limit=1024)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.filter(~held_out("doc_id", 5, 0)).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(join_ids(docs.select("doc_id", "text"), learn, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.balanced_tree(SHARDS))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out("doc_id", 4, 2)))
    return language.identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as p from documents),
cut as (select lang, regexp_extract_all(p, '[^ \t]+') as w from pieces),
spread as (select lang, w, unnest(range(1, len(w) + 1)) as i, 0 as k from cut where len(w) > 0),
totals as (select lang, count(*) as n from spread group by lang),
single as (select lang, w[i] as phrase, 1 as k, count(*) as a from spread group by 1, 2 having count(*) >= 100),
grown as (select lang, w, i, unnest(range(2, least(5, len(w) - i + 1) + 1)) as k from spread s where exists (select 1 from single f where f.lang = s.lang and f.phrase = s.w[s.i])),
phrases as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, any_value(k) as k, any_value(w[i:i + k - 1]) as ws, count(*) as a from grown group by 1, 2 having count(*) >= 100),
known as (select lang, phrase, a from single union all select lang, phrase, a from phrases),
cuts as (
  select lang, phrase, a, c, array_to_string(ws[1:c], ' ') as head, array_to_string(ws[c + 1:], ' ') as rest
  from (select *, unnest(range(1, k)) as c from phrases)),
valued as (
  select c.lang, c.phrase, c.a, c.c, h.a as l, r.a as r, t.n,
    cast(1000::hugeint * c.a * t.n // (h.a::hugeint * r.a) as bigint) as score
  from cuts c join known h on h.lang = c.lang and h.phrase = c.head join known r on r.lang = c.lang and r.phrase = c.rest join totals t on t.lang = c.lang),
lowest as (select * from valued qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_of as (
  select lang, array_to_string(ws[j:j + m - 1], ' ') as phrase, max(a) as outer_a
  from (select *, unnest(range(1, k - m + 2)) as j from (select *, unnest(range(2, k)) as m from phrases)) group by 1, 2),
ranked as (
  select l.*, row_number() over (partition by l.lang order by score desc, l.a desc, l.phrase) as rank
  from lowest l left join inner_of o on o.lang = l.lang and o.phrase = l.phrase
  where o.outer_a is null or 100 * o.outer_a < 100 * l.a)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""


def op12_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with texts as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as exact,
    list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[0-9]+', '0', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as lines,
    row_number() over () as id
  from documents),
windows as (select id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as v, i from (select id, w, unnest(range(1, len(w) - 1)) as i from texts)),
twice as (select id, i from (select *, count(*) over (partition by id, v) as c from windows) where c > 1),
repeated as (select id, count(*) as n from (select distinct id, i + j as at from twice, (values (0), (1), (2)) t(j)) group by id),
distinct_texts as (select distinct host, text, lines from texts where len(lines) > 0),
limits as (select host, greatest(20, count(*) * 10 // 1000) as most from distinct_texts group by host),
frequent as (
  select c.host, c.line from (select host, line, count(*) as n from (select distinct host, text, unnest(lines) as line from distinct_texts) group by 1, 2) c
  join limits l on l.host = c.host where c.n > l.most),
gone as (
  select x.host, x.text, sum(length(x.line)) as n from (select host, text, unnest(lines) as line from distinct_texts) x
  join frequent f on f.host = x.host and f.line = x.line group by 1, 2),
base as (
  select t.doc_id, len(t.w) as n_words, length(array_to_string(t.w, '')) as word_chars,
    length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(t.exact) - len(list_distinct(t.exact)) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, length(array_to_string(t.lines, '')) as line_chars, cast(coalesce(g.n, 0) as bigint) as gone_chars
  from texts t left join repeated r on r.id = t.id left join gone g on g.host = t.host and g.text = t.text)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, line_chars, gone_chars,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * (line_chars - gone_chars) >= 30 * line_chars as kept
from base
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_phrases": op11_phrases,
    "op12_line_frequency": op12_line_frequency,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op1_chat_formatting": OP1_SQL, "op2_decontamination": OP2_SQL, "op11_phrases": OP11_SQL, "op12_line_frequency": OP12_SQL}


def queries() -> dict:
    def ready(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    return {k: ready(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
