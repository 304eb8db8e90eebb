"""Queries of the training-data operators over whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .decision_list import quality
from .decontaminate import contamination
from .html_paths import extract_text
from .inputs import pieces, table, tokenizer
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .role_repair import damaged, repair
from .shared import fresh_path
from .token_files import read_token_files, write_token_files
from .toxicity import fit, score
from .viterbi_counts import token_counts, unigram_vocabulary
from .warc_zip import read_archives, write_archives
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@register
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


_COMPONENTS = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) sh from d)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= PERCENT * (nx.n + ny.n - i)),
reach(node, root) as (select doc_id, doc_id from d union select r.node, l.y from reach r join links l on l.x = r.root)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(root) component_id FURTHER
from d join reach on node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""
ORACLES["op1_near_dedup"] = _COMPONENTS.replace("PERCENT", "75").replace("FURTHER", ", d.doc_id = min(root) kept")


@register
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, vocabulary = tokenizer("byte_bpe_50k.json")
    folder = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, text, 0, vocabulary)
    return read_token_files(spark, folder, vocabulary, with_ids=False)


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")[0], end_id=1)


@register
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), unigram_vocabulary(pieces("piece_bpe_32k.model")))


@register
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("uid")


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLES["op3_decontamination"] = rf"""
with d as (select doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_ALNUM}') w from documents),
b as (select item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_ALNUM}') w from benchmark),
win as (
  select distinct item_id, len(x) n, array_to_string(x, ' ') t from (
    select item_id, unnest(case when len(w) = 0 then [] when len(w) < 13 then [w]
      else list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) end) x from b)),
sizes as (select distinct n from win),
dw as (
  select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, sizes where len(w) >= n)),
m as (select doc_id, item_id, p, win.n from dw join win on win.t = dw.t and win.n = dw.n),
hit as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from m) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct doc_id, item_id::varchar i from m) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hit using (doc_id) left join its using (doc_id)"""


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "removed_words", "removed_blocks", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@register
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(spark, paths, with_payload=False).drop("url")


ORACLES["op4_warc"] = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h)::bigint payload_bytes, sha1(h) x, max(page_id) over (partition by h) last from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4)::int, 5))::int >> (15 - 5 * (k % 4)::int)) & 31)::int, 1)), '') payload_digest,
  case when page_id = last then 'response' else 'revisit' end record_type, case when page_id < last then last end refers_to
from d"""


@register
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@register
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("class_id")


ORACLES["op11_jaccard_join"] = _COMPONENTS.replace("PERCENT", "80").replace("FURTHER", "")


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@register
def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))


def _state(c: str, a: str = "a", t: str = "t") -> str:
    return f"{{'c': {c}, 'a': {a}, 't': {t}}}"


def _edit(of: str, letter: str, cost: str, line: str = "''", when: str = "true") -> str:
    return f"case when {when} then {_state(f'{of}.c + {cost}', f"{of}.a || '{letter}'", f'{of}.t || {line}')} else far end"


_LINE = {k: rf"{k} || ':' || text || chr(10)" for k in ("'user'", "'assistant'", "role")}
_ROW = lambda of, new, initial: [_edit(of, "R", "2 + open", _LINE[new], "not gone"), _edit(of, "K", "open", _LINE["role"], f"not gone and initial = '{initial}'")]  # noqa: E731
_INSERTED = lambda of, role: _edit(of, "I", "2", f"'{role}:' || chr(10)")  # noqa: E731
_DUE = {"n0": "s0", "n1": "s1", "n2": f"least(s2, {', '.join(_INSERTED(s, 'user') for s in ('s0', 's1', 's3'))})"}
#: The forward form of the costs: the least (cost, audit) to be in each state after each row; the text goes along.
ORACLES["op13_role_repair"] = rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 kind
  from conversations),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
  from k, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end))),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos from d),
p as (
  select *, substr(role, 1, 1) initial, not regexp_matches(text, '[^ 	-]') blank, row_number() over (partition by conv_id, role, text order by pos) > 1 again,
    not regexp_matches(text, '[.!?][ 	-]*$') unended, lag(substr(role, 1, 1)) over (partition by conv_id order by pos) || substr(role, 1, 1) pair from o),
r as (select *, blank or again gone, (not blank and not again and unended)::int open from p),
n as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(blank) blank, count_if(again and not blank) duplicate, sum(open) truncated,
    count_if(pair not in ('su', 'ua', 'au')) illegal, max(pos) last from r group by conv_id),
walk as (
  select conv_id, 0::bigint pos, {_state("0", "''", "''")} s0, {_state("1000000", "''", "''")} s1, {_state("1000000", "''", "''")} s2, {_state("1000000", "''", "''")} s3 from n
  union all
  select conv_id, pos, {_edit("q0", "D", "3")}, least({_edit("q1", "D", "3")}, {_edit("q0", "K", "open", _LINE["role"], "not gone and initial = 's'")}),
    least({_edit("q2", "D", "3")}, {", ".join(x for q in ("q0", "q1", "q3") for x in _ROW(q, "'user'", "u"))}),
    least({_edit("q3", "D", "3")}, {", ".join(_ROW("q2", "'assistant'", "a"))})
  from (
    select *, s0 q0, s1 q1, least(s3, {_INSERTED("q2", "assistant")}) q3 from (
      select w.s0, w.s1, w.s3, r.*, {_state("1000000", "''", "''")} far, {_DUE["n2"]} q2
      from (select *, {_state("1000000", "''", "''")} far from walk) w join r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1))),
done as (
  select conv_id, least(s0, s3, {_INSERTED("q2", "assistant")}) s from (
    select w.*, {_DUE["n2"]} q2 from (select *, {_state("1000000", "''", "''")} far from walk) w join n on n.conv_id is not distinct from w.conv_id and n.last = w.pos))
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(s.c, 0)::bigint cost, coalesce(s.a, '') audit, sha256(coalesce(s.t[:-2], '')) repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join done on done.conv_id is not distinct from c.conv_id"""


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
