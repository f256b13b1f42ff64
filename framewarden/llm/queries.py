"""The numbered queries and the pipeline, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restore
from .licenses import ANCHORS, LEAST, TEMPLATES, as_files, scan_licenses
from .merkle_manifest import manifest
from .mixing import mixed_counts
from .multiset_hash import fingerprints
from .ngram_jaccard import jaccard_join
from .pii import personal_data, spelled
from .quality import quality
from .sentencepiece import encode
from .toxicity import toxicity
from .url_filters import filter_captures
from .url_fixture import captures_of, events_of
from .warc import archived_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


@registered("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@registered("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )


@registered("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(table(spark, sf_dir, "documents"))


@registered("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


@registered("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@registered("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))



_OP9_SQL = r"""
with cut as (
  select page_id, url, (page_id % 60) * 86400 + (page_id * 7919) % 86400 as ts,
    lower(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as raw
  from pages),
p as (select page_id, url, ts, host, case when raw like '/%' then raw else '/' end as path from cut),
seen as (select distinct host, path from p where host <> ''),
named as (
  select distinct 'ads' as list, 'd:' as kind, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) as name from seen
  union select 'malware', 'd:', host from seen
  union select 'adult', 'p:', host || regexp_extract(path, '^(/[^/]*/)', 1) from seen where regexp_matches(path, '^/[^/]*/')),
summed as (select list, kind || name as entry, cast('0x' || substr(md5(name), 1, 8) as bigint) as c from named where name <> ''),
entries as (select list, entry, c, (c % 40) * 86400 as t0 from summed
  where (list = 'ads' and c % 3 = 0) or (list = 'malware' and c % 5 = 1) or (list = 'adult' and c % 4 = 2)),
spans as (
  select list, entry, t0 as start, t0 + (1 + c % 11) * 86400 as stop from entries
  union all select list, entry, t0 + (15 + c % 7) * 86400, 4611686018427387904 from entries where c % 2 = 0),
labels as (select page_id, ts, host, string_split(host, '.') as l, string_split(path, '/') as f from p where host <> ''),
keys as (
  select page_id, ts, 'd:' || array_to_string(l[i:], '.') as entry from labels, unnest(range(1, len(l) + 1)) t(i)
  union select page_id, ts, 'p:' || host || array_to_string(f[1:i], '/') || '/' from labels, unnest(range(1, len(f))) t(i)),
hits as (select distinct k.page_id, s.list, s.entry from keys k join spans s on k.entry = s.entry and s.start <= k.ts and k.ts < s.stop)
select p.page_id as capture_id, p.url, p.ts as fetched_at,
  coalesce((select string_agg(list, ',' order by list) from (select distinct list from hits h where h.page_id = p.page_id)), '') as lists,
  coalesce((select string_agg(list || ' ' || entry, ',' order by list || ' ' || entry) from hits h where h.page_id = p.page_id), '') as entries,
  exists (select 1 from hits h where h.page_id = p.page_id) as blocked
from p
"""


@registered("op9_url_filters", _OP9_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = filter_captures(captures_of(pages), events_of(pages))
    return found.withColumns({c: F.concat_ws(",", c) for c in ("lists", "entries")})


_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
_OP4_SQL = rf"""
with files as (
  select doc_id, text, case doc_id % 8
    when 0 then source || '/' || lang || '/' || (doc_id % 64) || '/LICENSE.' || doc_id
    when 1 then source || '/' || lang || '/LICENSE.' || doc_id
    when 2 then source || '/LICENSE.' || doc_id
    else source || '/' || lang || '/' || (doc_id % 64) || '/' || doc_id || '.txt' end as path
  from documents),
marked as (select *, path like '%LICENSE.%' as is_license from files where regexp_matches(text, '{ANCHORS}')),
sections as (
  select distinct path, is_license, trim(line, ' ') as section from marked, unnest(string_split(text, chr(10))) t(line) where regexp_matches(line, '{ANCHORS}')
  union select path, is_license, trim(text, ' ') from marked where is_license),
distinct_sections as (select section, count(*) as copies from sections group by section),
vectors as (select section, copies, term, count(*) as tf
  from distinct_sections, unnest(regexp_extract_all(lower(section), '[a-z0-9]+(?:\.[0-9]+)*')) t(term) group by all),
templates(license, template) as (values {_TEMPLATE_ROWS}),
wanted as (select license, term, count(*) as tf
  from templates, unnest(regexp_extract_all(lower(template), '[a-z0-9]+(?:\.[0-9]+)*')) t(term) group by all),
dfs as (select term, sum(copies) as df from (select term, copies from vectors union all select term, 1 from wanted) group by term),
total as (select (select coalesce(sum(copies), 0) from distinct_sections) + (select count(*) from templates) as n),
weighed as (select section, term, tf * (ln((1 + n)::double / (1 + df)) + 1) as w from vectors join dfs using (term), total),
goal as (select license, term, tf * (ln((1 + n)::double / (1 + df)) + 1) as w from wanted join dfs using (term), total),
dots as (select section, license, sum(weighed.w * goal.w) as dot from weighed join goal using (term) group by all),
rated as (select section, license, round(dot / (
    (select sqrt(sum(w * w)) from weighed x where x.section = dots.section) * (select sqrt(sum(w * w)) from goal x where x.license = dots.license)), 6) as similarity
  from dots),
own as (select path, is_license, license, similarity from (
    select path, is_license, license, similarity, row_number() over (partition by path order by similarity desc, license) as k
    from sections join rated using (section) where similarity >= {LEAST}) where k = 1),
chosen as (select folder, path as from_path, license, similarity from (
    select *, regexp_replace(path, '/[^/]*$', '') as folder, row_number() over (
      partition by regexp_replace(path, '/[^/]*$', '') order by similarity desc, path) as k from own where is_license) where k = 1),
near as (select files.doc_id, c.*, row_number() over (partition by files.doc_id order by length(c.folder) desc) as k
  from files join chosen c on files.path like c.folder || '/%')
select f.doc_id, f.path, coalesce(o.license, n.license) as license, coalesce(o.similarity, n.similarity) as similarity,
  case when o.license is not null then 'own' when n.license is not null then 'inherited' else 'none' end as origin,
  case when o.license is null then n.from_path end as from_path
from files f left join own o using (path) left join (select * from near where k = 1) n on n.doc_id = f.doc_id
"""


@registered("op4_license_scan", _OP4_SQL)
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(as_files(table(spark, sf_dir, "documents")))


def _field(value: str) -> str:
    """SQL of a field of a leaf."""
    return f"coalesce(cast(strlen(cast({value} as varchar)) as varchar) || ':' || cast({value} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(leaves: str) -> str:
    """SQL of all nodes of the trees over ``leaves``."""
    return f"""
  select tree, 0 as level, pos, h from {leaves}
  union all
  select tree, level + 1, pos // 3, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over (partition by tree) as n from %s) where n > 1 group by tree, level, pos // 3"""


_OP11_SQL = f"""
with recursive
d as (
  select row_number() over () as rid, doc_id, source, {_leaf("text")} as leaf, {_leaf("replace(text, chr(10), '')")} as spared,
    list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(cast(doc_id as varchar)) + 1),
      lambda i: [ascii(cast(doc_id as varchar)[i]), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)) as crc
  from documents),
placed as (
  select *, source as tree, row_number() over (partition by source order by doc_id nulls last, leaf) - 1 as pos,
    case when xor(crc, 4294967295) % 2 = 0 then spared else leaf end as now
  from d),
leaves as (select tree, pos, leaf as h from placed),
nodes as ({_levels("leaves") % "nodes"}),
heights as (select tree, max(level) as height from nodes group by tree),
subroots as (select nodes.tree, h, row_number() over (order by nodes.tree nulls first) - 1 as pos
  from nodes join heights on nodes.tree is not distinct from heights.tree and level = height),
top_leaves as (select '' as tree, pos, h from subroots),
top_nodes as ({_levels("top_leaves") % "top_nodes"}),
steps as (
  select p.rid, n.level, string_agg(n.h, '' order by n.pos) filter (n.pos < p.pos // cast(pow(3, n.level) as bigint)) as l,
    string_agg(n.h, '' order by n.pos) filter (n.pos > p.pos // cast(pow(3, n.level) as bigint)) as r
  from placed p join heights x on p.tree is not distinct from x.tree
  join nodes n on n.tree is not distinct from p.tree and n.level < x.height and n.pos // 3 = p.pos // cast(pow(3, n.level + 1) as bigint)
  group by p.rid, n.level
  union all
  select p.rid, x.height + n.level, string_agg(n.h, '' order by n.pos) filter (n.pos < s.pos // cast(pow(3, n.level) as bigint)),
    string_agg(n.h, '' order by n.pos) filter (n.pos > s.pos // cast(pow(3, n.level) as bigint))
  from placed p join heights x on p.tree is not distinct from x.tree join subroots s on s.tree is not distinct from p.tree
  join top_nodes n on n.level < (select max(level) from top_nodes) and n.pos // 3 = s.pos // cast(pow(3, n.level + 1) as bigint)
  group by p.rid, x.height, n.level),
fold as (
  select rid, 0 as level, now as h from placed
  union all
  select f.rid, f.level + 1, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) from fold f join steps s on s.rid = f.rid and s.level = f.level),
folded as (select rid, arg_max(h, level) as h from fold group by rid),
proofs as (select rid, string_agg(coalesce(l, '') || coalesce(r, ''), '' order by level) as proof from steps group by rid),
root as (select h from top_nodes where level = (select max(level) from top_nodes))
select p.doc_id, p.leaf, s.h as subroot, root.h as root, sha256(coalesce(proof, '')) as proof_sha256, folded.h as folded_root, folded.h = root.h as verified
from placed p join subroots s on s.tree is not distinct from p.tree join folded on folded.rid = p.rid left join proofs on proofs.rid = p.rid, root
"""


@registered("op11_merkle_manifest", _OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_OP12_SQL = r"""
with cut as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k, length(coalesce(text, '')) as n from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by k) as group_size,
  row_number() over w = 1 as kept, sha256(k) as text_sha256
from cut window w as (partition by k order by n desc, doc_id nulls last)
"""


@registered("op12_exact_dedup", _OP12_SQL)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
drawn as (
  select *, len(t) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2,
    cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from cut),
ends as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from drawn),
parts as (
  select doc_id, text, n, array_to_string(t[1:a], '') as p, array_to_string(t[a + 1:b], '') as m, array_to_string(t[b + 1:], '') as s,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from ends)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


@registered("op13_fill_in_middle", _OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
