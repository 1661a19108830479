"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from punctual.llm import chat, langid, lmscore, minhash, mixing, packing, runs, simhash, spann, substring, tokencount, trie, warc
from punctual.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        return f

    return put


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_warc_capture_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


ORACLES["op3_warc_capture_index"] = """
with payloads as (select page_id, coalesce(html, '') as html from pages),
sized as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from payloads),
held as (
  select payload_digest, max(page_id) as response from sized where payload_bytes >= 1000 group by payload_digest
)
select s.page_id, s.payload_bytes, s.payload_digest,
  case when h.response > s.page_id then 'revisit' else 'response' end as record_type,
  case when h.response > s.page_id then h.response end as refers_to
from sized s left join held h on h.payload_digest = s.payload_digest and s.payload_bytes >= 1000
"""


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


@query("op6_context_mixing_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(read(spark, sf_dir, "documents"))


@query("op7_simhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_posting_list_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spann.search(read(spark, sf_dir, "embeddings"))


@query("op9_one_permutation_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edits(read(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.plant_periods(read(spark, sf_dir, "documents"))))


@query("op12_prefix_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(read(spark, sf_dir, "conversations")))


ORACLES["op12_prefix_trie"] = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place
  from conversations where conv_id is not null
),
-- crc32 of the decimal id, bit by bit
convs as (
  select conv_id, count(*) as n, conv_id - conv_id % 20 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ord(x)::bigint)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 as h
  from turns group by conv_id
),
lent as (select c.*, least(c.h, coalesce(b.n, 0)) as lent from convs c left join convs b on b.conv_id = c.base),
rebuilt as (
  select t.conv_id, t.place - l.h + l.lent as place, role, text from turns t join lent l on l.conv_id = t.conv_id where t.place >= l.h
  union all
  select l.conv_id, t.place, role, text from lent l join turns t on t.conv_id = l.base where t.place < l.lent
),
keyed as (
  select conv_id, place + 1 as depth, length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
    sha256(string_agg(sha256(concat(length(role), ':', role, text)), ',') over (partition by conv_id order by place)) as prefix
  from rebuilt
),
members as (
  select conv_id, depth, words, prefix, lag(prefix, 1, '') over (partition by conv_id order by depth) as above from keyed
  union all select conv_id, 0, 0, '', null from convs
),
nodes as (
  select prefix, min(conv_id) as conv_id, any_value(depth) as depth, any_value(above) as above, any_value(words) as words, count(*) as n_convs
  from members group by prefix
),
kids as (select above, count(*) as n_children from nodes where depth > 0 group by above),
weighed as (
  select n.*, coalesce(k.n_children, 0) as n_children, case when k.above is null then 1 else 0 end as leaf, (n.n_convs - 1) * n.words as saved
  from nodes n left join kids k on k.above = n.prefix
),
totals as (
  select m.prefix, sum(w.leaf) as n_leaves, sum(w.saved) as saved_tokens
  from weighed w join members m on m.conv_id = w.conv_id and m.depth <= w.depth group by m.prefix
),
last as (select conv_id, max_by(prefix, depth) as prefix from members group by conv_id),
ends as (select prefix, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from last group by prefix)
select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, cast(t.n_leaves as bigint) as n_leaves,
  cast(t.saved_tokens as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from weighed w join totals t on t.prefix = w.prefix left join nodes p on p.prefix = w.above left join ends e on e.prefix = w.prefix
"""


@query("op13_chat_round_trip")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip(rows.unionByName(planted))


ORACLES["op13_chat_round_trip"] = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
-- 2n+1 backslashes before a control string, twice as many at the end of a field
escaped as (
  select *, regexp_replace(regexp_replace(role, '(\\*)(<turn>|<text>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') as role_,
    regexp_replace(regexp_replace(text, '(\\*)(<turn>|<text>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') as text_
  from said
),
read as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as learned,
    cast(sum(length(role_) + length(text_) + length('<turn><text></turn>') + 1) as bigint) as formatted_chars
  from escaped group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, formatted_chars
from read
"""


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
