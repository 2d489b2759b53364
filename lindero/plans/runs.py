"""Queries over model answers, runs and their comparison, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lindero.functions import text as X
from lindero.operators import evidence as V
from lindero.operators import records as R
from lindero.plans.registry import query
from lindero.plans.segments import quoted
from lindero.plans.tables import T_POINTS, flat_text
from lindero.plans.values import CONFIGS, GATED, GOLD, LATEST, METRICS, SLOTS, WELL, _gated, _metrics, _rounded, has, matched, norm, squeeze, values
from lindero.session import table

# --- model answers ---------------------------------------------------------------------------

_ANSWERS = "select doc_id, text from documents where text like '{%' and json_valid(text)"
_UNWRAPPED = f"select doc_id, coalesce({', '.join(f'case when json_type(text, {quoted(chr(36) + chr(46) + w)}) <> {quoted(chr(78) + chr(85) + chr(76) + chr(76))} then json_extract(text, {quoted(chr(36) + chr(46) + w)}) end' for w in R.WRAPPERS)}, text::json) as r from ({_ANSWERS})"


def _pick_sql(names: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"case when json_type(r, '$.{n}') <> 'NULL' then json_extract(r, '$.{n}') end" for n in names) + ")"


_RAW = " union all ".join(f"select doc_id, '{f}' as field, {_pick_sql((f, *R.ALIASES.get(f, ())))} as raw from ({_UNWRAPPED})" for f in R.FIELDS)
_BODY = "case when json_type(raw) = 'OBJECT' and (json_type(raw, '$.value') is not null or json_type(raw, '$.clause_reference') is not null) then json_extract(raw, '$.value') else raw end"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.startswith("text", F.lit("{")))
    # outer generators keep the steps apart; folded into one, the parse would be repeated for each field
    read = rows.select("doc_id", F.explode_outer(F.array(F.try_parse_json("text"))).alias("answer"))
    return read.select("doc_id", F.explode_outer(F.array(R.unwrapped(F.col("answer")))).alias("r")).filter("r is not null")


def _answer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, p): the parts of each field of each answer."""
    raw = _answers(spark, sf_dir).select("doc_id", F.inline_outer(R.members(F.col("r"))))
    return raw.select("doc_id", "field", F.explode_outer(F.array(R.field_parts(F.col("raw")))).alias("p"))


@query(
    f"""select doc_id, field, nullif({squeeze("json_extract_string(body, '$')")}, '') as value, case when json_type(raw, '$.clause_reference') = 'VARCHAR' then json_extract_string(raw, '$.clause_reference') when json_type(raw, '$.reference') = 'VARCHAR' then json_extract_string(raw, '$.reference') end as clause_reference, 'media' as confidence
    from (select *, {_BODY} as body from ({_RAW})) where json_type(body) in ('VARCHAR', 'BIGINT', 'UBIGINT') and {squeeze("json_extract_string(body, '$')")} <> ''"""
)
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 fields of model answers under any wrapper and alias: value, clause and confidence; scalars only (nested ones: answer_nested)."""
    return _answer_members(spark, sf_dir).filter("p.value is not null").select("doc_id", "field", F.col("p.value").alias("value"), F.col("p.reference").alias("clause_reference"), F.lit("media").alias("confidence"))


def _flattened(json_text: str | None) -> str | None:
    import json

    return None if json_text is None else flat_text(json.loads(json_text, parse_int=float))


@query()
def answer_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of model answers whose value is a list or an object, flattened to one text."""
    rows = _answer_members(spark, sf_dir).filter("p.rest is not null")
    return rows.select("doc_id", "field", F.udf(_flattened, "string", useArrow=True)("p.rest").alias("value")).filter("value is not null")


@query(f"select doc_id, count(value) > 0 as filled, count(value) as fields from (select doc_id, case when json_type({_BODY}) in ('OBJECT', 'ARRAY') or {squeeze(f"json_extract_string({_BODY}, '$')")} <> '' then 1 end as value from ({_RAW})) group by doc_id")
def answer_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer holds any value; an answer without any is no record."""
    number = F.count(F.when(F.col("p.value").isNotNull() | F.col("p.rest").isNotNull(), 1))
    return _answer_members(spark, sf_dir).groupBy("doc_id").agg(number.alias("fields")).select("doc_id", (F.col("fields") > 0).alias("filled"), "fields")


@query(f"select doc_id, field, case when json_type(raw) = 'VARCHAR' then {squeeze("json_extract_string(raw, '$')")} when json_type(raw, '$.value') = 'VARCHAR' then {squeeze("json_extract_string(raw, '$.value')")} end as value from ({' union all '.join(f"select doc_id, '{f}' as field, json_extract(r, '$.{f}') as raw from ({_UNWRAPPED})" for f in R.FIELDS)}) where coalesce(case when json_type(raw) = 'VARCHAR' then {squeeze("json_extract_string(raw, '$')")} when json_type(raw, '$.value') = 'VARCHAR' then {squeeze("json_extract_string(raw, '$.value')")} end, '') <> ''")
def answer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer says under a field's own name: a string, or the string in its `value`."""
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("r", path, "variant")) == "STRING", X.squeezed(F.try_variant_get("r", path, "string")))
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(text(f"$.{f}"), text(f"$.{f}.value")).alias("value")) for f in R.FIELDS))
    return _answers(spark, sf_dir).select("doc_id", F.inline_outer(parts)).filter("value != ''")


_BOOLEANS = [("1", "true"), ("2", "false"), ("3", '"Sí, hasta el 60 %"'), ("4", '"no procede"'), ("5", '"Permitida"'), ("6", '"prohibida"'), ("7", '{"aplica": true, "clause_reference": "Cláusula 3"}'), ("8", '{"aplica": "sí"}'), ("9", "3"), ("10", "null"), ("11", '"quizá"'), ("12", '"siempre"')]
_VALUES = lambda rows: "(values " + ", ".join(f"({a}, {quoted(b)})" for a, b in rows) + ") t(id, j)"


@query(f"select id::integer as id, case when json_type(j) = 'BOOLEAN' then json_extract_string(j, '$') = 'true' when json_type(j) = 'VARCHAR' then case when regexp_matches(json_extract_string(j, '$'), {quoted('(?i)' + R.YES)}) then true when regexp_matches(json_extract_string(j, '$'), {quoted('(?i)' + R.NO)}) then false end when json_type(j, '$.aplica') = 'BOOLEAN' then json_extract_string(j, '$.aplica') = 'true' end as applies from {_VALUES(_BOOLEANS)}")
def tri_state_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that apply, don't or leave it open, from any shape."""
    rows = spark.createDataFrame([(int(a), b) for a, b in _BOOLEANS], "id int, j string")
    return rows.select("id", R.tri_state(F.parse_json("j")).alias("applies"))


_CRITERIA = [("1", '[{"criterio": "Precio", "peso_porcentaje": 60}, {"nombre": "Memoria", "peso": 40.5, "tipo": "Juicio de valor", "clause_reference": "Cláusula 9"}, {"peso": 3}, "x", {"descripcion": " "}]'), ("2", "null"), ("3", '"Precio"'), ("4", "[]"), ("5", '[{"criterio": "Plazo", "peso_porcentaje": "20"}]')]


@query(f"select id::integer as id, n, c, p, t, r from (select id, {squeeze("coalesce(json_extract_string(e, '$.criterio'), json_extract_string(e, '$.nombre'), json_extract_string(e, '$.descripcion'))")} as c, case when json_type(e, '$.peso_porcentaje') in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract(e, '$.peso_porcentaje') as double) when json_type(e, '$.peso') in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract(e, '$.peso') as double) end as p, case when regexp_matches(coalesce(json_extract_string(e, '$.tipo'), ''), '(?i){R.JUDGED}') then 'subjetivo' else 'objetivo' end as t, json_extract_string(e, '$.clause_reference') as r, row_number() over (partition by id order by k) as n from (select id, unnest(range(json_array_length(j)::bigint)) as k, unnest(from_json(j, '[\"json\"]')) as e from {_VALUES(_CRITERIA)} where json_type(j) = 'ARRAY') where json_type(e) = 'OBJECT' and coalesce({squeeze("coalesce(json_extract_string(e, '$.criterio'), json_extract_string(e, '$.nombre'), json_extract_string(e, '$.descripcion'))")}, '') <> '')")
def award_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award criteria from lists of any shape; items without a name are left out."""
    rows = spark.createDataFrame([(int(a), b) for a, b in _CRITERIA], "id int, j string")
    each = rows.select("id", F.posexplode_outer(R.criteria(F.parse_json("j"))).alias("k", "c")).filter("c is not null")
    return each.select("id", (F.col("k") + 1).cast("long").alias("n"), F.col("c.criterio").alias("c"), F.col("c.peso_porcentaje").alias("p"), F.col("c.tipo").alias("t"), F.col("c.clause_reference").alias("r"))


_ISSUES = {"excerpt too long": "length(value) > 40", "confidence out of range": "not confidence between 0 and 0.98", "method unknown": "method not in ('ccec', 'generic', 'derived', 'llm')", "no reference": "reference is null", "span reversed": "source_span.start_pos > source_span.end_pos"}


@query(" union all ".join(f"select result_id, '{n}' as issue, coalesce(reference, 'media') as severity from ({LATEST}) where {c}" for n, c in _ISSUES.items()))
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of the record's schema, one row for each that a row breaks, and the default of a missing member."""
    broken = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in _ISSUES.items())))
    return values(spark, sf_dir).select("result_id", F.explode(broken).alias("issue"), F.coalesce("reference", F.lit("media")).alias("severity"))


_PLAIN = " + ".join(f"case when json_type(r, '$.{f}') in ('VARCHAR', 'NULL') then 1 else 0 end" for f in R.FIELDS)


@query(f"select doc_id, {_PLAIN} as plain, {_PLAIN} = {len(R.FIELDS)} as compliant from ({_UNWRAPPED})")
def answer_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer has all 22 fields under their own names, each a string or null."""
    rows = _answers(spark, sf_dir)
    own = F.array(*(F.try_variant_get("r", f"$.{f}", "variant") for f in R.FIELDS))
    plain = F.size(F.filter(own, lambda v: v.isNotNull() & F.schema_of_variant(v).isin("STRING", "VOID")))
    return rows.select("doc_id", plain.alias("plain"), (plain == len(R.FIELDS)).alias("compliant"))


# --- runs ------------------------------------------------------------------------------------

_CALLS = "select distinct on (record_id) * from campaign_records order by record_id, loaded_at desc, body desc"


@query(f"select arm, run_no, count(*) as documents, bool_and(case when json_valid(body) then json_type(body) = 'OBJECT' else false end) as usable from ({_CALLS}) where body is not null group by all having count(*) >= 2")
def protocol_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two records or more, and whether all of their records are readable."""
    rows = V.once(table(spark, sf_dir, "campaign_records"), "record_id", "loaded_at").filter("body is not null")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    return rows.groupBy("arm", "run_no").agg(F.count("*").alias("documents"), F.bool_and(readable).alias("usable")).filter("documents >= 2")


_OK = lambda v: f"contains({norm(f"coalesce({v}, '')")}, {norm('gold')})"


@query(
    f"""select arm, run_no, count(*) as slots, count(model_value) as ai_fill, count(*) filter (where model_value is not null and strict) as ai_grounded, count(coalesce(deterministic, case when strict then model_value end)) as gated_fill, count(coalesce(deterministic, model_value)) as hybrid_fill,
    count(*) filter (where deterministic is null and model_value is not null and not strict) as hybrid_ungrounded, count(case when strict then model_value end) as ai_gated_fill, count(coalesce(deterministic, case when relaxed then model_value end)) as robust_fill,
    count(*) filter (where gold is not null and {_OK('model_value')}) as ai_right, count(*) filter (where gold is not null and {_OK("coalesce(deterministic, case when strict then model_value end)")}) as gated_right, count(*) filter (where gold is not null and {_OK("coalesce(deterministic, model_value)")}) as hybrid_right,
    count(*) filter (where gold is not null and {_OK("coalesce(deterministic, case when relaxed then model_value end)")}) as robust_right from ({SLOTS}) left join ({GOLD}) using (document, field) group by all"""
)
def ablation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve counts of each run: what every combination of rules, model and gate fills, and what of it is right."""
    rows = V.slots(_gated(spark, sf_dir)).join(V.gold_labels(table(spark, sf_dir, "golden_labels")), ["document", "field"], "left")
    d, m = F.col("deterministic"), F.col("model_value")
    strict, relaxed = F.when(F.col("strict"), m), F.when(F.col("relaxed"), m)
    right = lambda v: F.count(F.when(F.col("gold").isNotNull() & F.contains(X.normalised(F.coalesce(v, F.lit(""))), X.normalised(F.col("gold"))), 1))
    gated, hybrid, robust = F.coalesce(d, strict), F.coalesce(d, m), F.coalesce(d, relaxed)
    return rows.groupBy("arm", "run_no").agg(
        F.count("*").alias("slots"), F.count(m).alias("ai_fill"), F.count(strict).alias("ai_grounded"), F.count(gated).alias("gated_fill"), F.count(hybrid).alias("hybrid_fill"), F.count(F.when(d.isNull() & m.isNotNull() & ~F.col("strict"), 1)).alias("hybrid_ungrounded"),
        F.count(strict).alias("ai_gated_fill"), F.count(robust).alias("robust_fill"), right(m).alias("ai_right"), right(gated).alias("gated_right"), right(hybrid).alias("hybrid_right"), right(robust).alias("robust_right"),
    )


_T = "(values " + ", ".join(f"({k}, {v})" for k, v in T_POINTS.items()) + ") t(df, point)"
_MEASURES = ("correct", "emitted", "incorrect", "abstention", "precision", "recall", "f1")


@query(" union all ".join(f"select arm, config, '{m}' as measure, round(avg({m}), 6) as mean, round(coalesce(stddev_samp({m}), 0), 6) as sd, round(min({m})::double, 6) as least, round(max({m})::double, 6) as most, count({m}) as n from ({METRICS}) group by all" for m in _MEASURES))
def arm_table_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of each arm and configuration over its runs."""
    rows = _metrics(spark, sf_dir).select("arm", "config", F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in _MEASURES))))
    return _rounded(V.spread(rows, ["arm", "config", "measure"], "x"))


@query(
    f"""with g as (select document, field, arg_min(value, result_id) filter (where method in ('ccec','generic','derived')) as rule_value, arg_min(value, result_id) filter (where method in ('llm','ner')) as model_value, arg_min(strict, result_id) filter (where method in ('llm','ner')) as located from ({GATED}) where {has('value')} group by all)
    select document, field, case when field in ('tipo_contrato','iva','organo_contratacion') then coalesce(case when located then model_value end, rule_value) else coalesce(rule_value, case when located then model_value end) end as value, case when model_value is not null and not located then 'withheld' end as note from g"""
)
def merge_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and model routed by field behind the gate; a field that loses its value keeps a row with the note why."""
    rows = _gated(spark, sf_dir).filter(X.present(F.col("value")))
    rule, model = F.when(F.col("method").isin(*V.RULE_METHODS), F.col("result_id")), F.when(F.col("method").isin("llm", "ner"), F.col("result_id"))
    both = rows.groupBy("document", "field").agg(F.min_by("value", rule).alias("rule_value"), F.min_by("value", model).alias("model_value"), F.min_by("strict", model).alias("located"))
    given = F.when(F.col("located"), F.col("model_value"))
    value = F.when(F.col("field").isin(*V.MODEL_FIRST), F.coalesce(given, "rule_value")).otherwise(F.coalesce("rule_value", given))
    return both.select("document", "field", value.alias("value"), F.when(F.col("model_value").isNotNull() & ~F.col("located"), "withheld").alias("note"))


_PASSES = f"select config, arm, run_no, count(*) filter (where {has('value')})::double as covered from ({CONFIGS}) group by all"


@query(f"select config, arm, n, round(mean, 6) as mean, round(coalesce(point, 1.96) * sd / sqrt(n), 6) as half, passes from (select config, arm, count(*) as n, avg(covered) as mean, coalesce(stddev_samp(covered), 0) as sd, list(covered order by run_no) as passes from ({_PASSES}) group by all having count(*) >= 2) left join {_T} on df = n - 1")
def pooled_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each configuration over the passes of an arm: mean, half width of its t interval and the passes in order; two passes or more."""
    rows = V.configurations(V.slots(_gated(spark, sf_dir))).groupBy("config", "arm", "run_no").agg(F.count(F.when(X.present(F.col("value")), 1)).cast("double").alias("covered"))
    passes = F.transform(F.array_sort(F.collect_list(F.struct("run_no", "covered"))), lambda p: p["covered"])
    pooled = rows.groupBy("config", "arm").agg(F.count("*").alias("n"), F.avg("covered").alias("mean"), F.coalesce(F.stddev_samp("covered"), F.lit(0.0)).alias("sd"), passes.alias("passes")).filter("n >= 2")
    points = spark.createDataFrame(list(T_POINTS.items()), "df int, point double")
    half = F.coalesce("point", F.lit(1.96)) * F.col("sd") / F.sqrt("n")
    return pooled.join(F.broadcast(points), F.col("n") - 1 == F.col("df"), "left").select("config", "arm", "n", F.round("mean", 6).alias("mean"), F.round(half, 6).alias("half"), "passes")


_MONEY = f"select method, field, value, field in ('presupuesto_base_sin_iva','presupuesto_base_con_iva','valor_estimado_contrato') as money, coalesce({WELL}, false) as well from ({LATEST}) where {has('value')}"


@query(f"select count(*) as surfaced, count(*) filter (where money) as monetary, count(*) filter (where money and not well) as withheld, count(*) filter (where money and well) as retained, round(100.0 * count(*) filter (where money and not well) / count(*) filter (where money), 6) as share_of_money, round(100.0 * count(*) filter (where money and not well) / count(*), 6) as share_of_all from ({_MONEY})")
def wellformed_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of amounts would withhold, as a share of the amounts and of all values."""
    money = F.col("field").isin(*X.MONEY_FIELDS)
    rows = values(spark, sf_dir).filter(X.present(F.col("value"))).select(money.alias("money"), X.well_formed(F.col("value")).alias("well"))
    bad, all_money = F.count(F.when(F.col("money") & ~F.col("well"), 1)), F.count(F.when(F.col("money"), 1))
    return rows.agg(F.count("*").alias("surfaced"), all_money.alias("monetary"), bad.alias("withheld"), F.count(F.when(F.col("money") & F.col("well"), 1)).alias("retained"), F.round(100.0 * bad / all_money, 6).alias("share_of_money"), F.round(100.0 * bad / F.count("*"), 6).alias("share_of_all"))


@query(f"select document, count(distinct field) as fields, count(distinct field) = 22 as complete from ({LATEST}) where field is not null group by document")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a group holds exactly the members that it must hold: here the 22 fields of a document."""
    rows = values(spark, sf_dir).filter("field is not null").groupBy("document").agg(F.countDistinct("field").alias("fields"))
    return rows.withColumn("complete", F.col("fields") == len(R.FIELDS))


@query(f"select method, config, round(avg(filled), 6) as filled, round(coalesce(stddev_samp(filled), 0), 6) as sd, count(*) as runs from (select method, arm, run_no, case when strict then 'grounded' else 'ungrounded' end as config, count(*)::double as filled from ({GATED}) where {has('value')} group by all) group by all")
def provider_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each engine by run, located or not: mean, deviation and number of runs."""
    rows = _gated(spark, sf_dir).filter(X.present(F.col("value"))).groupBy("method", "arm", "run_no", F.when(F.col("strict"), "grounded").otherwise("ungrounded").alias("config")).agg(F.count("*").cast("double").alias("filled"))
    return rows.groupBy("method", "config").agg(F.round(F.avg("filled"), 6).alias("filled"), F.round(F.coalesce(F.stddev_samp("filled"), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("runs"))


@query("select annotator, count(*) filter (where gold is not null or note is not null) as done, count(*) as items, round(100.0 * count(*) filter (where gold is not null or note is not null) / count(*)) as percent from golden_labels where field not like '\\_%' escape '\\' group by annotator")
def annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that an annotator has answered or marked, of all."""
    rows = table(spark, sf_dir, "golden_labels").filter("field not like '\\\\_%'")
    done = F.count(F.when(F.col("gold").isNotNull() | F.col("note").isNotNull(), 1))
    return rows.groupBy("annotator").agg(done.alias("done"), F.count("*").alias("items"), F.round(100.0 * done / F.count("*")).alias("percent"))


@query(f"select method, count(*) as surfaced, count(*) filter (where {matched('value', 'gold')}) as correct, round(100.0 * count(*) filter (where {matched('value', 'gold')}) / count(*), 6) as precision from ({GATED}) join ({GOLD}) using (document, field) where {has('value')} and (method not in ('llm', 'ner') or strict) group by method")
def precision_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of what each engine surfaces, model values behind the gate; withheld values don't count."""
    rows = _gated(spark, sf_dir).filter(X.present(F.col("value")) & (~F.col("method").isin("llm", "ner") | F.col("strict"))).join(V.gold_labels(table(spark, sf_dir, "golden_labels")), ["document", "field"])
    good = F.count(F.when(X.boundary_match(F.col("value"), F.col("gold")), 1))
    return rows.groupBy("method").agg(F.count("*").alias("surfaced"), good.alias("correct"), F.round(100.0 * good / F.count("*"), 6).alias("precision"))


@query(f"select arm, count(*) as gold_slots, count(*) filter (where hit) as correct, round(count(*) filter (where hit) / count(*), 6) as recall from (select a.arm, g.document, g.field, coalesce(bool_or({matched('f.value', 'g.gold')}), false) as hit from (select distinct arm, document from ({LATEST})) a join ({GOLD}) g using (document) left join (select * from ({LATEST}) where {has('value')}) f on f.arm = a.arm and f.document = g.document group by all) group by arm")
def any_pair_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound of a generic extractor: a label counts as found if any value that the arm gives for its document says it, under whatever field."""
    rows = values(spark, sf_dir)
    gold = V.gold_labels(table(spark, sf_dir, "golden_labels"))
    asked = rows.select("arm", "document").distinct().join(gold, "document")
    given = rows.filter(X.present(F.col("value"))).select("arm", "document", "value").distinct()
    hits = asked.join(given, ["arm", "document"], "left").groupBy("arm", "document", "field").agg(F.coalesce(F.bool_or(X.boundary_match(F.col("value"), F.col("gold"))), F.lit(False)).alias("hit"))
    good = F.count(F.when(F.col("hit"), 1))
    return hits.groupBy("arm").agg(F.count("*").alias("gold_slots"), good.alias("correct"), F.round(good / F.count("*"), 6).alias("recall"))


_PROBES = ("21 %", "21", "1 %", "21,5 %", "5.532.479,98 €", "532.479,98", "24 MESES", "4 meses", "24 meses", "Abierto", "abierto simplificado", "Abiertos", "12/2024", "12-2024", "1 año", "2 AÑOS", "No procede", "", "ordinaria", "Ordinária", "10 días")
_PROBE = "(values " + ", ".join(f"({k}, {quoted(p)})" for k, p in enumerate(_PROBES)) + ") p(k, v)"


@query(f"select a.k::integer as value_no, b.k::integer as gold_no, {matched('a.v', 'b.v')} as strict, contains({norm('a.v')}, {norm('b.v')}) as legacy from {_PROBE.replace(' p(', ' a(')} cross join {_PROBE.replace(' p(', ' b(')}")
def comparator_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both comparators on all pairs of 21 fixed probes, a stated set."""
    rows = spark.createDataFrame(list(enumerate(_PROBES)), "k int, v string")
    probes = F.array(*(F.struct(F.lit(k).alias("gold_no"), F.lit(p).alias("g")) for k, p in enumerate(_PROBES)))
    pairs = rows.select(F.col("k").alias("value_no"), "v", F.inline(probes))
    return pairs.select("value_no", "gold_no", X.boundary_match(F.col("v"), F.col("g")).alias("strict"), F.contains(X.normalised(F.col("v")), X.normalised(F.col("g"))).alias("legacy"))


# What an archived campaign had, as shares, and how far a run may depart from it.
ARCHIVE = {"full_workflow": 0.30, "ungated_hybrid": 0.35, "model_alone": 0.40}
TOLERANCE = 0.20
_ARCHIVE = "(values " + ", ".join(f"('{c}', {v})" for c, v in ARCHIVE.items()) + ") a(config, archived)"
_COMPARED = f"select arm, config, round(avg(recall), 6) as accuracy, archived, round(avg(recall) - archived, 6) as difference, abs(avg(recall) - archived) <= {TOLERANCE} as within from ({METRICS}) join {_ARCHIVE} using (config) group by arm, config, archived"


@query(_COMPARED)
def archive_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm against the constants of an archived campaign."""
    archived = spark.createDataFrame(list(ARCHIVE.items()), "config string, archived double")
    rows = _metrics(spark, sf_dir).join(F.broadcast(archived), "config").groupBy("arm", "config", "archived").agg(F.avg("recall").alias("r"))
    gap = F.col("r") - F.col("archived")
    return rows.select("arm", "config", F.round("r", 6).alias("accuracy"), "archived", F.round(gap, 6).alias("difference"), (F.abs(gap) <= TOLERANCE).alias("within"))


@query(f"select arm, case when bool_and(within) then 'pass' else 'deviates' end as verdict, string_agg(config || ': ' || case when within then 'yes' else 'NO' end, '; ' order by config) as reason from ({_COMPARED}) group by arm")
def reproduction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an arm reproduces the archived campaign, with the checks behind the verdict."""
    rows = archive_comparison(spark, sf_dir)
    told = F.concat("config", F.lit(": "), F.when(F.col("within"), "yes").otherwise("NO"))
    return rows.groupBy("arm").agg(F.when(F.bool_and("within"), "pass").otherwise("deviates").alias("verdict"), F.array_join(F.array_sort(F.collect_list(told)), "; ").alias("reason"))


@query(f"select * from (select 'emitted is correct and incorrect' as name, bool_and(emitted = correct + incorrect) as pass from ({METRICS}) union all select 'slots are emitted and abstained', bool_and(gold_slots = emitted + abstention) from ({METRICS}) union all select 'rates lie between 0 and 1', bool_and(coalesce(precision, 0) between 0 and 1 and recall between 0 and 1 and f1 between 0 and 1) from ({METRICS}))")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that the scores must satisfy."""
    checks = {"emitted is correct and incorrect": "emitted = correct + incorrect", "slots are emitted and abstained": "gold_slots = emitted + abstention", "rates lie between 0 and 1": "coalesce(precision, 0) between 0 and 1 and recall between 0 and 1 and f1 between 0 and 1"}
    rows = _metrics(spark, sf_dir).select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.expr(c).alias("ok")) for n, c in checks.items()))))
    return rows.groupBy("name").agg(F.bool_and("ok").alias("pass"))


_SHAPES = {"nested": "json_type(body, '$.fields') = 'OBJECT'", "listed": "json_type(body, '$.fields') = 'ARRAY'", "lots": "json_type(body, '$.lotes') = 'ARRAY'", "none": "json_type(body, '$.fields') is null"}


@query(" union all ".join(f"select '{n}' as shape, count(*) as records, count(*) filter (where {c}) as accepted from (select case when json_valid(body) then body end as body from ({_CALLS})) where json_type(body) = 'OBJECT'" for n, c in _SHAPES.items()))
def shape_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readable records fit each variant of the schema."""
    rows = V.once(table(spark, sf_dir, "campaign_records"), "record_id", "loaded_at").select(F.try_parse_json("body").alias("b")).filter(F.schema_of_variant("b").startswith("OBJECT"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("b", path, "variant"))
    fits = {"nested": kind("$.fields").startswith("OBJECT"), "listed": kind("$.fields").startswith("ARRAY"), "lots": kind("$.lotes").startswith("ARRAY"), "none": F.try_variant_get("b", "$.fields", "variant").isNull()}
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("shape"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in fits.items()))))
    return each.groupBy("shape").agg(F.count("*").alias("records"), F.count(F.when(F.col("ok"), 1)).alias("accepted"))


# --- orders of keys, holds, capped lists -----------------------------------------------------


@query(f"select record_id, started_at, timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', started_at))) + interval 1 day + interval 5 minute)) as not_before, finished_at < timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', started_at))) + interval 1 day + interval 5 minute)) as held from ({_CALLS}) where started_at is not null")
def quota_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next midnight and five minutes in a named zone, and whether a run falls into the hold before it."""
    rows = V.once(table(spark, sf_dir, "campaign_records").select("record_id", "started_at", "finished_at", "loaded_at"), "record_id", "loaded_at").filter("started_at is not null")
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), "started_at")
    midnight = F.expr("cast(_day as timestamp_ntz) + interval 1 day + interval 5 minute")
    until = F.convert_timezone(F.lit("America/Los_Angeles"), F.lit("UTC"), midnight)
    return rows.withColumn("_day", F.to_date(local)).select("record_id", "started_at", until.alias("not_before"), (F.col("finished_at") < until).alias("held"))


@query(f"select document, list_sort(list(distinct reference))[1:400] as capped, count(distinct reference) as n, min(cast(regexp_extract(reference, '(\\d+)', 1) as integer)) as first_number from ({LATEST}) where reference is not null and regexp_matches(reference, '\\d') group by document")
def natural_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of each document, at most 400 of them, and the first by its number."""
    rows = values(spark, sf_dir).filter(F.col("reference").rlike(r"\d"))
    return rows.groupBy("document").agg(F.slice(F.sort_array(F.collect_set("reference")), 1, 400).alias("capped"), F.countDistinct("reference").alias("n"), F.min(F.regexp_extract("reference", r"(\d+)", 1).cast("int")).alias("first_number"))


@query(f"select document, reference, row_number() over (partition by document order by number, reference) as place from (select distinct document, reference, cast(regexp_extract(reference, '(\\d+)', 1) as integer) as number from ({LATEST}) where regexp_matches(reference, '\\d'))")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in the order of their numbers, not of their letters."""
    rows = values(spark, sf_dir).filter(F.col("reference").rlike(r"\d")).select("document", "reference", F.regexp_extract("reference", r"(\d+)", 1).cast("int").alias("number")).distinct()
    return rows.select("document", "reference", F.row_number().over(Window.partitionBy("document").orderBy("number", "reference")).cast("long").alias("place"))


_TITLES = [("1", '{"eng": "Works", "spa": "Obras"}'), ("2", '{"spa": ["España – Obras", "x"], "fra": "Travaux"}'), ("3", '"plain"'), ("4", '["first", "second"]'), ("5", "null"), ("6", '{"fra": "Travaux"}'), ("7", "[]")]


@query(f"select id::integer as id, case when json_type(j) = 'VARCHAR' then json_extract_string(j, '$') when json_type(j) = 'ARRAY' then json_extract_string(j, '$[0]') when json_type(j) = 'OBJECT' then regexp_replace(coalesce(json_extract_string(j, '$.eng'), case when json_type(j, '$.' || json_keys(j)[1]) = 'ARRAY' then json_extract_string(j, '$.' || json_keys(j)[1] || '[0]') else json_extract_string(j, '$.' || json_keys(j)[1]) end), '^[^–]*– ', '') end as title from {_VALUES(_TITLES)}")
def multilingual_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title of several: the first of a list, the English one of a map, else its first; without the prefix before a dash."""
    rows = spark.createDataFrame([(int(a), b) for a, b in _TITLES], "id int, j string")
    members = F.from_json("j", "map<string,string>")
    first = F.get(F.map_values(members), F.lit(0))
    one = F.coalesce(members["eng"], F.when(first.startswith("["), F.get_json_object(first, "$[0]")).otherwise(first))
    kind = F.schema_of_variant(F.parse_json("j"))
    plain = F.try_variant_get(F.parse_json("j"), "$", "string")
    return rows.select("id", F.when(kind == "STRING", plain).when(kind.startswith("ARRAY"), F.get_json_object("j", "$[0]")).when(kind.startswith("OBJECT"), F.regexp_replace(one, "^[^–]*– ", "")).alias("title"))


_CELLS = [("1", "3.5"), ("2", '" x "'), ("3", "true"), ("4", "null"), ("5", '{"text": " t "}'), ("6", '{"result": 7}'), ("7", '{"richText": [{"text": "a"}, {"text": "b "}]}'), ("8", '{"result": {"text": "u"}}')]


@query(f"select id::integer as id, case json_type(j) when 'NULL' then '' when 'VARCHAR' then trim(json_extract_string(j, '$')) when 'OBJECT' then trim(coalesce(json_extract_string(j, '$.text'), json_extract_string(j, '$.result.text'), json_extract_string(j, '$.result'), array_to_string(json_extract_string(j, '$.richText[*].text'), ''))) else json_extract_string(j, '$') end as text from {_VALUES(_CELLS)}")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of any kind as text: numbers, booleans, rich text, results of formulas."""
    rows = spark.createDataFrame([(int(a), b) for a, b in _CELLS], "id int, j string")
    j = F.parse_json("j")
    get = lambda path: F.try_variant_get(j, path, "string")
    rich = F.array_join(F.transform(F.from_json(F.get_json_object("j", "$.richText"), "array<struct<text:string>>"), lambda p: p["text"]), "")
    inner = F.coalesce(get("$.text"), get("$.result.text"), get("$.result"), rich)
    return rows.select("id", F.when(F.is_variant_null(j), "").otherwise(F.trim(F.when(F.schema_of_variant(j).startswith("OBJECT"), inner).otherwise(get("$")))).alias("text"))
