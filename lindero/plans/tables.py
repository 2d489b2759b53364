"""Queries over records, runs, orders and events: JSON coercion, joins, sets, windows, statistics, and their SQL."""

from __future__ import annotations

import json
import re
import sys
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lindero.functions import text as X
from lindero.operators import evidence as V
from lindero.plans.registry import query
from lindero.plans.values import LATEST, has, values
from lindero.session import table

# --- JSON ------------------------------------------------------------------------------------

_ALIASES = ("value", "fieldValue", "value_text", "valor", "val")


@query("select feed, file_no, row_no, coalesce(" + ", ".join(f"json_extract_string(payload, '$.{a}')" for a in _ALIASES) + ") as value, coalesce(json_extract_string(payload, '$.method'), json_extract_string(payload, '$.metodo'), json_extract_string(payload, '$.extraction_method')) as method from feed_records where json_extract_string(payload, '$.field') is not null and json_type(payload, '$.value') not in ('OBJECT', 'ARRAY')")
def json_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical member, else the first of its aliases that isn't null."""
    rows = table(spark, sf_dir, "feed_records").withColumn("v", F.try_parse_json("payload"))
    pick = lambda *names: F.coalesce(*(F.get_json_object("payload", f"$.{n}") for n in names))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.value", "variant"))
    plain = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return rows.filter(pick("field").isNotNull() & plain).select("feed", "file_no", "row_no", pick(*_ALIASES).alias("value"), pick("method", "metodo", "extraction_method").alias("method"))


@query("select arm, count(*) as n, count(*) filter (where json_valid(body)) as parseable from campaign_records group by arm")
def json_parse_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "campaign_records").groupBy("arm").agg(F.count("*").alias("n"), F.count(F.try_parse_json("body")).alias("parseable"))


@query("select record_id, count(*) filter (where t in ('VARCHAR', 'NULL')) as plain, count(*) as members, bool_and(t in ('VARCHAR', 'NULL')) as compliant from (select record_id, json_type(body, '$.gold.\"' || k || '\"') as t from (select distinct record_id, body, unnest(json_keys(body, '$.gold')) as k from campaign_records where json_valid(body) and json_type(body) = 'OBJECT')) group by record_id")
def schema_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all members of a record's labels are strings or null."""
    rows = table(spark, sf_dir, "campaign_records").select("record_id", "body").distinct().withColumn("gold", F.try_variant_get(F.try_parse_json("body"), "$.gold", "variant"))
    members = rows.select("record_id", F.explode(F.map_values(F.from_json(F.to_json("gold"), "map<string,variant>"))).alias("m"))
    kind = F.coalesce(F.schema_of_variant("m"), F.lit("VOID"))
    plain = kind.isin("STRING", "VOID")
    return members.groupBy("record_id").agg(F.count(F.when(plain, 1)).alias("plain"), F.count("*").alias("members"), F.bool_and(plain).alias("compliant"))


#: What JavaScript's trim() removes, and the members whose value stands for their object's.
_BLANKS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BEARING = ("value", "importe", "amount", "texto", "descripcion")


def _number(x: float) -> str:
    """A number as JavaScript prints it."""
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        return f"{Decimal(repr(x)):f}".removesuffix(".0")
    return re.sub(r"e([+-])0+", r"e\1", repr(x)).replace("inf", "Infinity")


def flat_text(value: object, depth: int = 0) -> str | None:
    """Any parsed JSON value as one text, null if it holds none; objects count down to the third level."""
    if isinstance(value, str):
        return value.strip(_BLANKS) or None
    if isinstance(value, bool):
        return "Sí" if value else "No"
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, list):
        return "; ".join([t for t in [flat_text(v, depth + 1) for v in value] if t]) or None
    if isinstance(value, dict) and depth < 3:
        for name in _BEARING:
            if text := flat_text(value.get(name), depth + 1):
                return text
        # as in JavaScript, members named by numbers go first
        names = sorted(value, key=lambda n: (0, int(n)) if re.fullmatch(r"0|[1-9][0-9]{0,9}", n) and int(n) < 2**32 - 1 else (1, 0))
        return " ".join([t for t in [flat_text(value[n], depth + 1) for n in names] if t]) or None
    return None


def _flat_members(payload: str | None) -> dict[str, str | None] | None:
    sys.setrecursionlimit(20_000)
    try:
        record = json.loads(payload or "", parse_int=float)
    except ValueError:
        return None
    whole = lambda s: s and s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return {whole(name): whole(flat_text(value)) for name, value in record.items()} if isinstance(record, dict) else None


@query()
def json_scalar_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any value as one text: the value-bearing member of an object, else all its members joined by a blank; lists joined by '; '; booleans as words.

    A function over whole payloads, as lists may nest without bound and a VARIANT doesn't keep the order of members.
    """
    flat = F.udf(_flat_members, "map<string,string>", useArrow=True)
    rows = table(spark, sf_dir, "feed_records")
    return rows.select("feed", "file_no", "row_no", F.explode(flat("payload")).alias("member", "text"))


# --- calls, latency, cost --------------------------------------------------------------------

_RECORDS = "select distinct on (record_id) * from campaign_records order by record_id, loaded_at desc, body desc"
_CALLS = f"select arm, run_no, record_id, body from ({_RECORDS}) where json_valid(body) and json_type(body) = 'OBJECT'"
_LATENCY = f"select arm, sum(cast(a.latency_ms as bigint)) as latency from (select arm, record_id, unnest(from_json(json_extract(body, '$.call.attempts'), '[{{\"latency_ms\": \"BIGINT\"}}]')) as a from ({_CALLS})) group by arm, record_id"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = V.once(table(spark, sf_dir, "campaign_records"), "record_id", "loaded_at")
    return records.filter(F.try_parse_json("body").isNotNull() & F.startswith(F.ltrim("body"), F.lit("{")))


@query(
    f"select arm, count(*) as calls, round(avg(latency), 4) as mean, round(quantile_cont(latency, 0.5), 4) as median, max(latency) as most, list_sort(list(latency))[least(count(*), cast(floor(0.9 * count(*)) as bigint) + 1)] as p90 from ({_LATENCY}) group by arm"
)
def reliability_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of calls by arm; p90 is the value at place int(0.9 n) of the sorted ones."""
    attempts = F.from_json("body", "struct<call:struct<attempts:array<struct<latency_ms:bigint>>>>")["call"]["attempts"]["latency_ms"]
    rows = _calls(spark, sf_dir).select("arm", F.aggregate(attempts, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("latency")).filter("latency is not null")
    base = rows.groupBy("arm").agg(F.count("*").alias("calls"), F.round(F.avg("latency"), 4).alias("mean"), F.max("latency").alias("most"))
    places = V.ranked(rows, ["arm"], "latency").select("arm", F.round("median", 4).alias("median"), F.col("p90").cast("bigint").alias("p90"))
    return base.join(places, base["arm"].eqNullSafe(places["arm"])).select(base["arm"], "calls", "mean", "median", "most", "p90")


# Prices of a million tokens in and out, and the rate of the second currency.
PRICES, RATE = (0.30, 2.50), 0.92
_USAGE = "struct<call:struct<retries:bigint,finish_reason:string,usage:struct<promptTokenCount:bigint,candidatesTokenCount:bigint>>>"


@query(
    f"""select arm, count(p) as calls, sum(p)::bigint as prompt, sum(o)::bigint as output, round(sum(p) / 1e6 * {PRICES[0]} + sum(o) / 1e6 * {PRICES[1]}, 6) as charge, round((sum(p) / 1e6 * {PRICES[0]} + sum(o) / 1e6 * {PRICES[1]}) / count(p), 6) as per_call, sum(r)::bigint as retries,
  count(*) filter (where f = 'MAX_TOKENS') as truncated from (select arm, cast(json_extract(body, '$.call.usage.promptTokenCount') as bigint) as p, cast(json_extract(body, '$.call.usage.candidatesTokenCount') as bigint) as o, cast(json_extract(body, '$.call.retries') as bigint) as r, json_extract_string(body, '$.call.finish_reason') as f from ({_CALLS})) group by arm"""
)
def cost_per_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and charge by arm; calls without usage aren't counted."""
    rows = _calls(spark, sf_dir).select("arm", F.from_json("body", _USAGE)["call"].alias("c"))
    prompt, output = F.sum("c.usage.promptTokenCount"), F.sum("c.usage.candidatesTokenCount")
    charge = prompt / 1e6 * PRICES[0] + output / 1e6 * PRICES[1]
    calls = F.count("c.usage.promptTokenCount")
    return rows.groupBy("arm").agg(
        calls.alias("calls"), prompt.alias("prompt"), output.alias("output"), F.round(charge, 6).alias("charge"), F.round(charge / calls, 6).alias("per_call"), F.sum("c.retries").alias("retries"), F.count(F.when(F.col("c.finish_reason") == "MAX_TOKENS", 1)).alias("truncated")
    )


_TOKENS = f"select arm, cast(json_extract(body, '$.call.usage.promptTokenCount') as bigint) as p, cast(json_extract(body, '$.call.usage.candidatesTokenCount') as bigint) as o from ({_CALLS})"


@query(f"select sum(p)::bigint as prompt, sum(o)::bigint as output, round(sum(p) / 1e6 * {PRICES[0]} + sum(o) / 1e6 * {PRICES[1]}, 6) as usd, round((sum(p) / 1e6 * {PRICES[0]} + sum(o) / 1e6 * {PRICES[1]}) * {RATE}, 6) as eur from ({_TOKENS})")
def cost_two_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all calls and their charge in two currencies."""
    rows = _calls(spark, sf_dir).select(F.from_json("body", _USAGE)["call"].alias("c"))
    prompt, output = F.sum("c.usage.promptTokenCount"), F.sum("c.usage.candidatesTokenCount")
    usd = prompt / 1e6 * PRICES[0] + output / 1e6 * PRICES[1]
    return rows.agg(prompt.alias("prompt"), output.alias("output"), F.round(usd, 6).alias("usd"), F.round(usd * RATE, 6).alias("eur"))


@query(f"select record_id, cast(started_at as date) as day, date_diff('millisecond', started_at, finished_at) as elapsed_ms, printf('%02d:%02d', date_diff('second', started_at, finished_at) // 60, date_diff('second', started_at, finished_at) % 60) as clock from ({_RECORDS}) where started_at >= timestamp '2025-01-01'")
def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, elapsed milliseconds and mm:ss of each record."""
    rows = V.once(table(spark, sf_dir, "campaign_records"), "record_id", "loaded_at").filter("started_at >= timestamp_ntz '2025-01-01'")
    seconds = F.expr("timestampdiff(SECOND, started_at, finished_at)")
    clock = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
    return rows.select("record_id", F.to_date("started_at").alias("day"), F.expr("timestampdiff(MILLISECOND, started_at, finished_at)").alias("elapsed_ms"), clock.alias("clock"))


# --- statistics ------------------------------------------------------------------------------

# Two-sided 95 % points of Student's t by degrees of freedom.
T_POINTS = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}
_T = "(values " + ", ".join(f"({k}, {v})" for k, v in T_POINTS.items()) + ") t(df, point)"
_COVERAGE = f"select arm, run_no, count(*) filter (where {has('value')})::double as covered from ({LATEST}) group by all"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).groupBy("arm", "run_no").agg(F.count(F.when(X.present(F.col("value")), 1)).cast("double").alias("covered"))


@query(f"select arm, n, round(mean, 6) as mean, round(sd, 6) as sd, round(coalesce(point, 1.96) * sd / sqrt(n), 6) as half from (select arm, count(*) as n, avg(covered) as mean, coalesce(stddev_samp(covered), 0) as sd from ({_COVERAGE}) group by arm) left join {_T} on df = n - 1")
def pooled_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of an arm's runs with the half width of its t interval."""
    points = spark.createDataFrame(list(T_POINTS.items()), "df int, point double")
    rows = _coverage(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n"), F.avg("covered").alias("mean"), F.coalesce(F.stddev_samp("covered"), F.lit(0.0)).alias("sd"))
    half = F.coalesce("point", F.lit(1.96)) * F.col("sd") / F.sqrt("n")
    return rows.join(F.broadcast(points), F.col("n") - 1 == F.col("df"), "left").select("arm", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(half, 6).alias("half"))


@query(f"select count(*) as arms, round(sqrt(sum((n - 1) * v) / sum(n - 1)), 6) as within_sd, round(stddev_samp(m), 6) as between_sd, round(avg(m), 6) as grand_mean from (select arm, count(*) as n, avg(covered) as m, coalesce(var_samp(covered), 0) as v from ({_COVERAGE}) group by arm)")
def clustered_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation within and between arms."""
    arms = _coverage(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n"), F.avg("covered").alias("m"), F.coalesce(F.var_samp("covered"), F.lit(0.0)).alias("v"))
    within = F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1))
    return arms.agg(F.count("*").alias("arms"), F.round(within, 6).alias("within_sd"), F.round(F.stddev_samp("m"), 6).alias("between_sd"), F.round(F.avg("m"), 6).alias("grand_mean"))


@query(f"select a.arm, count(*) as pairs, round(avg(a.covered - c.covered), 6) as effect, round(coalesce(stddev_samp(a.covered - c.covered), 0) / sqrt(count(*)), 6) as error from ({_COVERAGE}) a join (select run_no, covered from ({_COVERAGE}) where arm = 'control') c using (run_no) where a.arm <> 'control' group by a.arm")
def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's runs against the control's runs of the same number."""
    runs = _coverage(spark, sf_dir)
    control = runs.filter("arm = 'control'").select("run_no", F.col("covered").alias("base"))
    diff = F.col("covered") - F.col("base")
    return runs.filter("arm != 'control'").join(control, "run_no").groupBy("arm").agg(F.count("*").alias("pairs"), F.round(F.avg(diff), 6).alias("effect"), F.round(F.coalesce(F.stddev_samp(diff), F.lit(0.0)) / F.sqrt(F.count("*")), 6).alias("error"))


_DIFFS = f"select a.arm, count(*) as pairs, avg(a.covered - c.covered) as effect, coalesce(stddev_samp(a.covered - c.covered), 0) as sd from ({_COVERAGE}) a join (select run_no, covered from ({_COVERAGE}) where arm = 'control') c using (run_no) where a.arm <> 'control' group by a.arm"


@query(f"select arm, pairs, round(effect, 6) as effect, round(effect - coalesce(point, 1.96) * sd / sqrt(pairs), 6) as low, round(effect + coalesce(point, 1.96) * sd / sqrt(pairs), 6) as high from ({_DIFFS}) left join {_T} on df = pairs - 1")
def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired effect of each arm with its t interval."""
    runs = _coverage(spark, sf_dir)
    control = runs.filter("arm = 'control'").select("run_no", F.col("covered").alias("base"))
    diff = F.col("covered") - F.col("base")
    rows = runs.filter("arm != 'control'").join(control, "run_no").groupBy("arm").agg(F.count("*").alias("pairs"), F.avg(diff).alias("effect"), F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("sd"))
    points = spark.createDataFrame(list(T_POINTS.items()), "df int, point double")
    half = F.coalesce("point", F.lit(1.96)) * F.col("sd") / F.sqrt("pairs")
    joined = rows.join(F.broadcast(points), F.col("pairs") - 1 == F.col("df"), "left")
    return joined.select("arm", "pairs", F.round("effect", 6).alias("effect"), F.round(F.col("effect") - half, 6).alias("low"), F.round(F.col("effect") + half, 6).alias("high"))


_JSON = f"select arm, case when json_valid(body) then body end as body from ({_RECORDS})"


@query(
    f"""select arm, count(*) as records, round(count(*) filter (where json_type(body) = 'OBJECT') / count(*), 6) as parseable_rate, count(*) filter (where json_extract_string(body, '$.call.finish_reason') = 'MAX_TOKENS') as truncated, round(avg(cast(json_extract(body, '$.call.retries') as bigint)), 6) as retries_per_call,
  round(avg(cast(json_extract(body, '$.call.usage.promptTokenCount') as bigint)), 6) as prompt_mean, round(avg(cast(json_extract(body, '$.call.usage.candidatesTokenCount') as bigint)), 6) as output_mean from ({_JSON}) group by arm"""
)
def reliability_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of an arm are readable and cut, retries for each call and mean tokens."""
    rows = V.once(table(spark, sf_dir, "campaign_records"), "record_id", "loaded_at").select("arm", F.try_parse_json("body").alias("b"))
    call = lambda path, kind: F.try_variant_get("b", f"$.call.{path}", kind)
    object_ = F.schema_of_variant("b").startswith("OBJECT")
    return rows.groupBy("arm").agg(
        F.count("*").alias("records"), F.round(F.count(F.when(object_, 1)) / F.count("*"), 6).alias("parseable_rate"), F.count(F.when(call("finish_reason", "string") == "MAX_TOKENS", 1)).alias("truncated"), F.round(F.avg(call("retries", "bigint")), 6).alias("retries_per_call"),
        F.round(F.avg(call("usage.promptTokenCount", "bigint")), 6).alias("prompt_mean"), F.round(F.avg(call("usage.candidatesTokenCount", "bigint")), 6).alias("output_mean"),
    )


@query(f"select arm, round(avg(share), 6) as share from (select arm, run_no, round(100.0 * count(*) filter (where not {has('value')}) / count(*)) as share from ({LATEST}) group by all) group by arm")
def empty_share_rounded_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages rounded for each run, then averaged: the order matters."""
    runs = values(spark, sf_dir).groupBy("arm", "run_no").agg(F.round(100.0 * F.count(F.when(~X.present(F.col("value")), 1)) / F.count("*")).alias("share"))
    return runs.groupBy("arm").agg(F.round(F.avg("share"), 6).alias("share"))


@query(f"select document, " + ", ".join(f"round(avg(n) filter (where method = '{m}'), 6) as {m}" for m in ("ccec", "derived", "generic", "llm", "ner")) + f" from (select document, method, run_no, count(*) filter (where {has('value')}) as n from ({LATEST}) group by all) group by document")
def coverage_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean covered values by document, a column for each method."""
    runs = values(spark, sf_dir).groupBy("document", "method", "run_no").agg(F.count(F.when(X.present(F.col("value")), 1)).alias("n"))
    return runs.groupBy("document").pivot("method", ["ccec", "derived", "generic", "llm", "ner"]).agg(F.round(F.avg("n"), 6))


# --- sheets ----------------------------------------------------------------------------------

_CELLS = """select parse_id, tno, rno, e.key as header, e.value as cell from (select parse_id, tno, rno, unnest(map_entries(r)) as e from (
  select parse_id, tno, generate_subscripts(t, 1) as rno, unnest(t) as r from (select parse_id, generate_subscripts(parsed_tables, 1) as tno, unnest(parsed_tables) as t from (select distinct on (parse_id) * from docling_parses where parsed_tables is not null order by parse_id, parsed_at desc))))"""


@query(
    f"""select header, count(*) as cells, count(*) filter (where cell is null) as empty, count(*) filter (where regexp_matches(cell, '^\\d{{1,3}}(?:[.,]\\d+)?$')) as bare, count(*) filter (where regexp_matches(lower(header), 'importe|amount|precio|valor')) as amounts from ({_CELLS}) group by header"""
)
def sheet_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by header: amount columns are found by their header, bare numbers in them are what a sheet may not hold."""
    parses = V.once(table(spark, sf_dir, "docling_parses").filter("parsed_tables is not null").select("parse_id", "parsed_at", "parsed_tables"), "parse_id", "parsed_at")
    rows = parses.select("parse_id", F.posexplode("parsed_tables").alias("tno", "t")).select("parse_id", "tno", F.posexplode("t").alias("rno", "r")).select("parse_id", "tno", "rno", F.explode("r").alias("header", "cell"))
    bare = F.col("cell").rlike(r"^\d{1,3}(?:[.,]\d+)?$")
    amounts = F.lower("header").rlike("importe|amount|precio|valor")
    return rows.groupBy("header").agg(F.count("*").alias("cells"), F.count(F.when(F.col("cell").isNull(), 1)).alias("empty"), F.count(F.when(bare, 1)).alias("bare"), F.count(F.when(amounts, 1)).alias("amounts"))


@query("select file, count(*) as parses, count(*) filter (where ok) as good, round(sum(elapsed_s), 4) as seconds, round(avg(length(text)), 4) as chars from (select distinct on (parse_id) * from docling_parses order by parse_id, parsed_at desc) group by file")
def parser_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parses = V.once(table(spark, sf_dir, "docling_parses").select("parse_id", "file", "ok", "elapsed_s", "text", "parsed_at"), "parse_id", "parsed_at")
    return parses.groupBy("file").agg(F.count("*").alias("parses"), F.count(F.when(F.col("ok"), 1)).alias("good"), F.round(F.sum("elapsed_s"), 4).alias("seconds"), F.round(F.avg(F.length("text")), 4).alias("chars"))


# --- orders and events -----------------------------------------------------------------------


@query("select close, count(*) as n from (select abs(o_totalprice - s) <= 0.02 * greatest(o_totalprice, s) as close from orders join (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as s from lineitem group by 1) on l_orderkey = o_orderkey) group by close")
def identity_check_2pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose total is within two per cent of the sum of their lines."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    close = F.abs(F.col("o_totalprice") - F.col("s")) <= 0.02 * F.greatest("o_totalprice", "s")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(close.alias("close")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work whose result isn't there yet: an anti join against what is written."""
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("select o_custkey, string_agg(o_orderstatus, '; ' order by k) as statuses from (select o_custkey, o_orderstatus, min(o_orderkey) as k from orders group by all) group by o_custkey")
def distinct_ordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct statuses of a customer in order of first appearance, joined."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("k"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("k", "o_orderstatus"))), lambda s: s["o_orderstatus"])
    return first.groupBy("o_custkey").agg(F.array_join(ordered, "; ").alias("statuses"))


_SETS = f"select document, list(distinct field) filter (where method in ('ccec','generic','derived')) as a, list(distinct field) filter (where method in ('llm','ner')) as b from ({LATEST}) where {has('value')} group by document"


@query(f"select document, list_sort(list_intersect(coalesce(a, []), coalesce(b, []))) as both, list_sort(list_filter(coalesce(a, []), lambda x: not list_contains(coalesce(b, []), x))) as only_rules, list_has_any(coalesce(a, []), coalesce(b, [])) as overlap from ({_SETS})")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that rules and model both fill, fields that only rules fill, whether the sets meet."""
    rows = values(spark, sf_dir).filter(X.present(F.col("value")))
    sets = rows.groupBy("document").agg(F.collect_set(F.when(F.col("method").isin(*V.RULE_METHODS), F.col("field"))).alias("a"), F.collect_set(F.when(F.col("method").isin("llm", "ner"), F.col("field"))).alias("b"))
    return sets.select("document", F.sort_array(F.array_intersect("a", "b")).alias("both"), F.sort_array(F.array_except("a", "b")).alias("only_rules"), F.arrays_overlap("a", "b").alias("overlap"))


@query("select feed, row_no, arg_max(payload, (file_no, delivered_at)) as payload from feed_records group by all")
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed_records").groupBy("feed", "row_no").agg(F.max_by("payload", F.struct("file_no", "delivered_at")).alias("payload"))


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as k from events) where k <= 5")
def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest values of each type, ties by id."""
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).filter("k <= 5").select("event_type", "event_id", "value")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select portal, count(*) as n, count(budget) as with_budget, count(distinct region) as regions, count(*) filter (where budget_note is not null) as noted, sum(page_count)::bigint as pages from (select distinct on (manifest_id) * from corpus_manifest order by manifest_id, loaded_at desc) group by portal")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.once(table(spark, sf_dir, "corpus_manifest"), "manifest_id", "loaded_at")
    return rows.groupBy("portal").agg(F.count("*").alias("n"), F.count("budget").alias("with_budget"), F.countDistinct("region").alias("regions"), F.count("budget_note").alias("noted"), F.sum("page_count").alias("pages"))
