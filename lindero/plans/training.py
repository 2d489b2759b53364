"""The queries of the general training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lindero.operators import drift, nested, quantities
from lindero.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount in cents and every term in days."""
    return quantities.quantities(*(table(spark, sf_dir, name) for name in ("corpus_manifest", "portals", "golden_labels")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose amount isn't recorded in euros or whose term isn't recorded in days."""
    return p4_quantities(spark, sf_dir).filter("not as_base").select("tbl", "row_id", "quantity")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the record layout between successive files of a feed."""
    return drift.layout_changes(table(spark, sf_dir, "feed_records"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all feeds in one steady layout."""
    return drift.steady_table(table(spark, sf_dir, "feed_records"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "campaign_records")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source span with the keys of its result, field, lot and record."""
    return nested.spans(_records(spark, sf_dir))


def p6_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(nested.canonical(_records(spark, sf_dir)), "lots")


def p6_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(nested.canonical(_records(spark, sf_dir)), "fields")


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(nested.canonical(_records(spark, sf_dir)), "results")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.value_leaves(nested.canonical(_records(spark, sf_dir)))


def p6_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.attempts(_records(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


_READ = """select record_id, arg_max(body, (loaded_at, body)) as body from (select record_id, loaded_at, case when json_type(body) = 'VARCHAR' then json_extract_string(body, '$') else trim(body) end as body from campaign_records where json_valid(body)) where json_valid(body) and body like '{%' group by record_id"""
_LOTS = f"""select record_id, 0 as lot_no, null::varchar as title, json_extract(body, '$.fields') as fields from ({_READ}) union all
  select record_id, cast(json_extract(l, '$.lote') as integer), json_extract_string(l, '$.titulo'), json_extract(l, '$.fields') from (select record_id, unnest(case json_type(body, '$.lotes') when 'ARRAY' then json_extract(body, '$.lotes[*]') when 'OBJECT' then [json_extract(body, '$.lotes')] else [] end) as l from ({_READ}))"""
_FIELDS = f"""select record_id, lot_no, k as field, json_extract(fields, concat('$.\"', k, '\"')) as f from (select *, unnest(json_keys(fields)) as k from ({_LOTS}) where json_type(fields) = 'OBJECT') union all
  select record_id, lot_no, json_extract_string(f, '$.field'), f from (select record_id, lot_no, unnest(json_extract(fields, '$[*]')) as f from ({_LOTS}) where json_type(fields) = 'ARRAY')"""
_RESULTS = f"""select record_id, lot_no, field, i::integer as result_no, rs[i] as r from (select *, unnest(range(1, len(rs) + 1)) as i from (select record_id, lot_no, field, case json_type(b) when 'ARRAY' then json_extract(b, '$[*]') when 'OBJECT' then [b] else [] end as rs from (
  select record_id, lot_no, field, case when json_type(f) = 'OBJECT' and coalesce(json_type(f, '$.results'), 'NULL') <> 'NULL' then json_extract(f, '$.results') else f end as b from ({_FIELDS}))))"""
_SPANS = f"""select record_id, lot_no, field, result_no, cast(json_extract(s, '$.start') as integer) as start_pos, cast(json_extract(s, '$.end') as integer) as end_pos from (select record_id, lot_no, field, result_no, unnest(case json_type(r, '$.sourceSpan') when 'ARRAY' then json_extract(r, '$.sourceSpan[*]') when 'OBJECT' then
  case when json_type(r, '$.sourceSpan.spans') = 'ARRAY' then json_extract(r, '$.sourceSpan.spans[*]') when json_type(r, '$.sourceSpan.range') = 'ARRAY' then [json_object('start', json_extract(r, '$.sourceSpan.range[0]'), 'end', json_extract(r, '$.sourceSpan.range[1]'))] else [json_extract(r, '$.sourceSpan')] end else [] end) as s from ({_RESULTS}))
  where json_type(s, '$.start') is not null or json_type(s, '$.end') is not null"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _SPANS,
        "p6_lots": f"select record_id, lot_no, title from ({_LOTS})",
        "p6_fields": f"select record_id, lot_no, field from ({_FIELDS})",
        "p6_attempts": f"""select record_id, i::integer as attempt_no, cast(json_extract(a, '$.key_index') as integer) as key_index, cast(json_extract(a, '$.http_status') as integer) as http_status, cast(json_extract(a, '$.latency_ms') as bigint) as latency_ms, json_extract_string(a, '$.outcome') as outcome
          from (select record_id, i, xs[i] as a from (select *, unnest(range(1, len(xs) + 1)) as i from (select record_id, json_extract(body, '$.call.attempts[*]') as xs from ({_READ}))))""",
        "p6_results": f"""select record_id, lot_no, field, result_no, case when json_type(r, '$.value') <> 'NULL' then case when json_type(r, '$.value') in ('OBJECT', 'ARRAY') then json_extract(r, '$.value')::varchar else json_extract_string(r, '$.value') end end as value, cast(json_extract_string(r, '$.confidence') as double) as confidence, json_extract_string(r, '$.method') as method, cast(json_extract_string(r, '$.needsReview') as boolean) as needs_review, json_extract_string(r, '$.reference') as reference from ({_RESULTS})""",
    }
