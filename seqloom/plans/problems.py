"""Queries of the general data problems, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.intervals import merge_intervals
from seqloom.operators.nested import dewey_nodes, unparsed
from seqloom.operators.rejects import parse_lines, rejects, valid_rows
from seqloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(table(spark, d, "features"), ["record_id", "feature_name"])


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered length of each record and name."""
    both = merge_intervals(table(spark, d, "features"), ["record_id", "feature_name"])
    length = F.col("to_pos") - F.col("from_pos")
    return both.groupBy("record_id", "feature_name").agg(
        F.sum(F.when(F.col("kind") == "period", 1).otherwise(0)).alias("n_periods"),
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("covered"),
        F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("uncovered"),
    )


#: The tables of the three places that p3_found asks for.
_NESTED = ("meta.references[]", "meta.references[].citation.dbReference[]", "features[].location.sub_locations[]")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dewey_nodes(table(spark, d, "entry_json"), "entry_id", "body", tables=_NESTED, payload=False).select("entry_id", "parent_path", "node_path")


def p3_table_sizes(spark: SparkSession, d: str) -> DataFrame:
    nodes = dewey_nodes(table(spark, d, "entry_json"), "entry_id", "body", payload=False)
    return nodes.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entry_id").alias("n_entries"), F.max(F.size("dewey")).alias("deepest"))


def p3_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Documents without rows, by the kind of reason."""
    return unparsed(table(spark, d, "entry_json"), "entry_id", "body").select("entry_id", F.split("reason", ":")[0].alias("reason"))


def _lines(spark: SparkSession, d: str, fmt: str, typed: bool) -> DataFrame:
    return parse_lines(table(spark, d, f"{fmt}_lines"), fmt, typed=typed)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (rejects(_lines(spark, d, n, False)).select(F.lit(n).alias("src"), "line_id") for n in ("pileup", "gff"))
    return a.unionByName(b)


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    a, b = (rejects(_lines(spark, d, n, False)).groupBy(F.lit(n).alias("src"), "reason").agg(F.count(F.lit(1)).alias("n")) for n in ("pileup", "gff"))
    return a.unionByName(b)


def p5_gff_rows(spark: SparkSession, d: str) -> DataFrame:
    """The typed lines, attributes as sorted text."""
    rows = valid_rows(_lines(spark, d, "gff", True)).drop("wide")
    return rows.withColumn("attributes", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


def p5_pileup_rows(spark: SparkSession, d: str) -> DataFrame:
    """The typed lines, with the number of read results and their text."""
    rows = valid_rows(_lines(spark, d, "pileup", True)).drop("wide")
    return rows.withColumn("n_results", F.size("read_results")).withColumn("read_results", F.array_join("read_results", ""))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_coverage, p3_found, p3_table_sizes, p3_rejects, p5_found, p5_reasons, p5_gff_rows, p5_pileup_rows)
}

_PERIODS = """with v as (select distinct record_id, feature_name, start_pos s, end_pos e from features
    where record_id is not null and feature_name is not null and start_pos < end_pos),
  o as (select *, max(e) over (partition by record_id, feature_name order by s, e rows between unbounded preceding and 1 preceding) p from v),
  st as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by record_id, feature_name order by s, e rows unbounded preceding) g from o),
  per as (select record_id, feature_name, g, min(s) a, max(e) b from st group by all),
  found as (select record_id, feature_name, 'period' kind, a from_pos, b to_pos from per
    union all select record_id, feature_name, 'gap', b, n from (select *, lead(a) over (partition by record_id, feature_name order by g) n from per) where n is not null)
"""
#: Lines of pileup files by the format: read results are used up from the left, a run of reads or one indel at a time.
PILEUP_LINES = r"""with recursive t as (select line_id, regexp_replace(line, '\r$', '') l from pileup_lines), f as (select line_id, string_split(l, chr(9)) c from t),
  ok as (select line_id, c from f where len(c) = 6 and regexp_full_match(c[1], '[A-Za-z0-9_.|:\-]+') and regexp_full_match(c[2], '0*[1-9][0-9]*') and regexp_full_match(c[3], '[ACGTNacgtn]') and regexp_full_match(c[4], '[0-9]+') and regexp_full_match(c[6], '[!-~]*')),
  walk(line_id, rest, n, m) as (select line_id, c[5], 0::bigint, 0::bigint from ok union all select line_id, substr(rest, cast(step as bigint) + 1), n + many, m + case when head <> '' then 1 else 0 end from (
    select line_id, rest, n, m, length(run) + length(head) + size step, len(regexp_extract_all(run, '(?:\^[!-~])?[.,*ACGTNacgtn]\$?')) many, run, head, size from (
      select *, case when run = '' and n > 0 then regexp_extract(rest, '^[+-][0-9]+') else '' end head, case when run = '' and n > 0 then coalesce(try_cast(regexp_extract(rest, '^[+-]([0-9]+)', 1) as bigint), 0) else 0 end size from (
        select *, regexp_extract(rest, '^(?:(?:\^[!-~])?[.,*ACGTNacgtn]\$?)+') run from walk where rest <> '')))
    where run <> '' or (head <> '' and size > 0 and regexp_full_match(substr(rest, length(head) + 1, size), '[ACGTNacgtn]+') and length(rest) >= length(head) + size)),
  valid as (select ok.line_id, c, n + m tokens from ok join walk using (line_id) where rest = '' and n = try_cast(c[4] as bigint) and n = length(c[6]))
"""
#: Lines of GFF3 files by the format.
GFF_LINES = r"""with g as (select line_id, regexp_replace(line, '\r$', '') l from gff_lines), h as (select line_id, string_split(l, chr(9)) c from g where not coalesce(regexp_full_match(l, '[ \t\r\n\v\f]*') or l like '#%', false)),
  good as (select line_id, c from h where len(c) = 9 and c[1] <> '' and c[3] <> '' and regexp_full_match(c[4], '0*[1-9][0-9]*') and regexp_full_match(c[5], '[0-9]+') and c[5]::bigint >= c[4]::bigint
    and (c[6] = '.' or regexp_full_match(c[6], '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?')) and c[7] in ('+', '-', '.', '?') and (c[8] in ('0', '1', '2') or (c[8] = '.' and c[3] <> 'CDS'))
    and (c[9] = '.' or (not regexp_matches(regexp_replace(c[9], '%[0-9A-Fa-f]{2}', '', 'g'), '%') and regexp_full_match(c[9], '[^"=;]*[^"=;\s][^"=;]*=(?:[^";]*|"[^"]*")(?:;[^"=;]*[^"=;\s][^"=;]*=(?:[^";]*|"[^"]*"))*;?'))))
"""
_ITEM = r"""'[^"=;]*[^"=;\s][^"=;]*=(?:"[^"]*"|[^";]*)'"""
_NODES = r"""with recursive d as (select entry_id, body::json j from entry_json where json_valid(body)),
  top as (select entry_id, lower(replace(e.key, '_', '')) k, e.value v from d, json_each(j) e where json_type(j) = 'OBJECT'),
  refs as (select entry_id, unnest(range(len(a))) i, unnest(a) x from (select entry_id, case json_type(e.value) when 'ARRAY' then e.value::json[] when 'OBJECT' then [e.value] else [] end a
    from top, json_each(v) e where k = 'meta' and json_type(v) = 'OBJECT' and lower(replace(e.key, '_', '')) = 'references')),
  cites as (select entry_id, i, e.value v from refs, json_each(x) e where json_type(x) = 'OBJECT' and lower(replace(e.key, '_', '')) = 'citation' and json_type(e.value) = 'OBJECT'),
  dbs as (select entry_id, i, unnest(range(len(a))) n, unnest(a) x from (select entry_id, i, case json_type(e.value) when 'ARRAY' then e.value::json[] when 'OBJECT' then [e.value] else [] end a
    from cites, json_each(v) e where lower(replace(e.key, '_', '')) = 'dbreference')),
  feats as (select entry_id, unnest(range(len(a))) i, unnest(a) x from (select entry_id, case json_type(v) when 'ARRAY' then v::json[] when 'OBJECT' then [v] else [] end a from top where k = 'features')),
  locs(entry_id, parent, path, v) as (
    select entry_id, null::varchar, 'features.' || i || '.location', e.value from feats, json_each(x) e where json_type(x) = 'OBJECT' and lower(replace(e.key, '_', '')) = 'location' and json_type(e.value) = 'OBJECT'
    union all select entry_id, p, p || '.sub_locations.' || n, y from (select entry_id, p, unnest(range(len(a))) n, unnest(a) y from (select entry_id, locs.path p, case json_type(e.value) when 'ARRAY' then e.value::json[] when 'OBJECT' then [e.value] else [] end a
      from locs, json_each(v) e where lower(replace(e.key, '_', '')) = 'sublocations')) where json_type(y) = 'OBJECT')
  select entry_id, 'meta' parent_path, 'meta.references.' || i node_path from refs where json_type(x) = 'OBJECT'
  union all select entry_id, 'meta.references.' || i, 'meta.references.' || i || '.citation.dbReference.' || n from dbs where json_type(x) = 'OBJECT'
  union all select entry_id, parent, path from locs where parent is not null"""
ORACLE: dict[str, str] = {
    "p1_found": _PERIODS + "select * from found",
    "p1_coverage": _PERIODS + """select record_id, feature_name, cast(count(*) filter (kind = 'period') as bigint) n_periods,
  cast(coalesce(sum(to_pos - from_pos) filter (kind = 'period'), 0) as bigint) covered, cast(coalesce(sum(to_pos - from_pos) filter (kind = 'gap'), 0) as bigint) uncovered
  from found group by all""",
    "p3_found": _NODES,
    "p3_rejects": """select entry_id, case when body is null or body = '' then 'no body' when not json_valid(body) then 'not JSON' else 'neither object nor list' end reason
  from entry_json where body is null or body = '' or not json_valid(body) or json_type(case when json_valid(body) then body end) not in ('OBJECT', 'ARRAY')""",
    "p5_found": PILEUP_LINES.rstrip() + ", " + GFF_LINES.removeprefix("with ") + """ select 'pileup' src, line_id from pileup_lines where line_id not in (select line_id from valid)
  union all select 'gff', line_id from h where line_id not in (select line_id from good)""",
    "p5_pileup_rows": PILEUP_LINES + """select line_id, c[1] sequence_name, c[2]::bigint as position, c[3] reference_base, c[4]::bigint read_count, c[5] read_results, c[6] quality, tokens::integer n_results from valid""",
    "p5_gff_rows": GFF_LINES + f""", i as (select line_id, c, list_transform(case when c[9] = '.' then [] else regexp_extract_all(c[9], {_ITEM}) end, lambda x: {{'k': split_part(x, '=', 1), 'v': regexp_replace(substr(x, strpos(x, '=') + 1), '^"([^"]*)"$', '\\1')}}) items from good),
  u as (select line_id, c, list_sort(list_filter(items, lambda x, j: not list_contains(list_transform(items[j + 1:], lambda y: y.k), x.k))) items from i)
  select line_id, c[1] seqid, c[2] origin, c[3] feature_type, c[4]::bigint start_pos, c[5]::bigint end_pos, case when c[6] <> '.' then c[6]::double end score, c[7] strand, case when c[8] <> '.' then c[8]::integer end phase,
    array_to_string(list_transform(items, lambda x: x.k || '=' || x.v), ';') attributes from u""",
}
