"""Queries over extracted values: gates, merges, scores, amounts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.functions import text as X
from lindero.operators import evidence as V
from lindero.plans.registry import query
from lindero.session import table

# --- SQL fragments ---------------------------------------------------------------------------

BLANKS = r"[\s\x{00A0}\x{FEFF}]+"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{BLANKS}', ' ', 'g'), ' ')"


def norm(c: str) -> str:
    """Accents by DuckDB's own table, the other compatibility forms by Unicode's."""
    several = c
    for sign, plain in X.FOLD_MANY.items():
        several = f"replace({several}, '{sign}', '{plain}')"
    compat = [t.replace("'", "''") for t in (X.COMPAT_FROM, X.COMPAT_TO)]
    return f"lower({squeeze(f"translate(strip_accents({several}), '{compat[0]}', '{compat[1]}')")})"


def has(c: str) -> str:
    return f"coalesce({squeeze(c)} <> '', false)"


def amount(c: str) -> str:
    found = f"regexp_extract({c}, '({X.SPANISH_AMOUNT})', 1)"
    number = f"try_cast(replace(replace({found}, '.', ''), ',', '.') as double)"
    return f"case when {number} > 0 then {number} end"


NUMBERS = f"regexp_extract_all(v, '({X.NUMERIC_CONTENT})', 1, 'i')"
ANY_NUMBER = f"len(list_filter({NUMBERS}, lambda n: contains(source, {norm('n')}))) > 0"

LATEST = "select distinct on (result_id) * from field_results order by result_id, loaded_at desc"
SOURCES = f"""select file, {norm('txt')} as source from (select file, arg_max(text, (parsed_at, parse_id)) as txt from docling_parses where ok and text is not null group by file)"""
GATED = f"""
  select f.*, case when not {has('value')} or source is null then false when len({NUMBERS.replace('(v,', '(value,')}) > 0 then {ANY_NUMBER.replace('(v,', '(value,')} else contains(source, substring({norm('value')}, 1, 18)) end as strict,
    case when not {has('value')} or source is null then false when len({NUMBERS.replace('(v,', '(value,')}) > 0 then {ANY_NUMBER.replace('(v,', '(value,')}
      when length({norm('value')}) < 4 then contains(source, {norm('value')})
      when len(list_filter(string_split({norm('value')}, ' '), lambda w: length(w) >= 4)) = 0 then contains(source, substring({norm('value')}, 1, 18))
      else len(list_filter(list_filter(string_split({norm('value')}, ' '), lambda w: length(w) >= 4), lambda w: not contains(source, w))) = 0 end as relaxed
  from ({LATEST}) f left join ({SOURCES}) s on f.document = s.file"""
SLOTS = f"""
  select arm, run_no, document, field,
    arg_min(value, result_id) filter (where method in ('ccec','generic','derived') and {has('value')}) as deterministic,
    arg_min(value, result_id) filter (where method in ('llm','ner') and {has('value')}) as model_value,
    coalesce(arg_min(strict, result_id) filter (where method in ('llm','ner') and {has('value')}), false) as strict,
    coalesce(arg_min(relaxed, result_id) filter (where method in ('llm','ner') and {has('value')}), false) as relaxed
  from ({GATED}) group by all"""
CONFIGS = f"""
  select arm, run_no, document, field, config, value from ({SLOTS}) cross join lateral (values
    ('deterministic_only', deterministic), ('model_alone', model_value), ('ai_gate_no_rules', case when strict then model_value end),
    ('ungated_hybrid', coalesce(deterministic, model_value)), ('full_workflow', coalesce(deterministic, case when strict then model_value end)),
    ('robust_gate', coalesce(deterministic, case when relaxed then model_value end))) t(config, value)"""
GOLD = "select doc as document, field, arg_min(gold, label_id) as gold from golden_labels where field not like '\\_%' escape '\\' and gold is not null group by all"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.once(table(spark, sf_dir, "field_results"), "result_id", "loaded_at")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gated(values(spark, sf_dir), V.sources(table(spark, sf_dir, "docling_parses")))


# --- gates and merges ------------------------------------------------------------------------


@query(f"select field, method, count(*) as n, count(*) filter (where {has('value')}) as surfaced, count(*) filter (where strict) as strict, count(*) filter (where relaxed) as relaxed from ({GATED}) group by all")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the strict and the relaxed gate find in their source, by field and method."""
    return _gated(spark, sf_dir).groupBy("field", "method").agg(
        F.count("*").alias("n"), F.count(F.when(X.present(F.col("value")), 1)).alias("surfaced"), F.count(F.when(F.col("strict"), 1)).alias("strict"), F.count(F.when(F.col("relaxed"), 1)).alias("relaxed")
    )


@query(f"select result_id, case when strict then value end as value, case when {has('value')} and not strict then 'withheld' end as note from ({GATED}) where method in ('llm','ner')")
def gate_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model values that aren't located are withheld, with a note; the rules' values aren't gated."""
    model = _gated(spark, sf_dir).filter(F.col("method").isin("llm", "ner"))
    return model.select("result_id", F.when(F.col("strict"), F.col("value")).alias("value"), F.when(X.present(F.col("value")) & ~F.col("strict"), "withheld").alias("note"))


@query(f"select document, list_sort(list(distinct field)) as withheld from ({GATED}) where method in ('llm','ner') and {has('value')} and not strict group by document")
def gate_withheld_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    withheld = _gated(spark, sf_dir).filter(F.col("method").isin("llm", "ner") & X.present(F.col("value")) & ~F.col("strict"))
    return withheld.groupBy("document").agg(F.sort_array(F.collect_set("field")).alias("withheld"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = values(spark, sf_dir).filter(X.present(F.col("value")))
    pick = lambda part: part.groupBy("document", "field").agg(F.min_by("value", "result_id").alias("value"))
    return pick(rows.filter(F.col("method").isin(*V.RULE_METHODS))), pick(rows.filter(F.col("method").isin("llm", "ner")))


_SIDES = f"""(select document, field, arg_min(value, result_id) as rule_value from ({LATEST}) where method in ('ccec','generic','derived') and {has('value')} group by all) r
  full join (select document, field, arg_min(value, result_id) as model_value from ({LATEST}) where method in ('llm','ner') and {has('value')} group by all) m using (document, field)"""


@query(f"select document, field, coalesce(rule_value, model_value) as value, case when rule_value is not null then 'rules' else 'model' end as origin from {_SIDES}")
def merge_det_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.routed_merge(*_sides(spark, sf_dir), routed=False)


@query(
    f"""select document, field, case when field in ('tipo_contrato','iva','organo_contratacion') then coalesce(model_value, rule_value) else coalesce(rule_value, model_value) end as value,
  case when field in ('tipo_contrato','iva','organo_contratacion') and model_value is not null then 'model' when rule_value is not null then 'rules' else 'model' end as origin from {_SIDES}"""
)
def merge_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.routed_merge(*_sides(spark, sf_dir), routed=True)


# --- configurations and scores ---------------------------------------------------------------


@query(f"select config, field, count(*) as slots, count(*) filter (where {has('value')}) as covered from ({CONFIGS}) group by all")
def configs_six_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.configurations(V.slots(_gated(spark, sf_dir)))
    return rows.groupBy("config", "field").agg(F.count("*").alias("slots"), F.count(F.when(X.present(F.col("value")), 1)).alias("covered"))


def _list(c: str, pattern: str, read: str, flags: str = "") -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), '{pattern}', 1{flags}), lambda x: {read})"


# RE2 knows no lookaround: what may not stand before and after is matched, with doubled blanks to keep matches apart.
def _spaced(c: str) -> str:
    return f"regexp_replace(concat(' ', coalesce({c}, ''), ' '), '(.)', '\\1', 'g')"


_RATE = r"(?:^|[^\d.,])(\d+(?:[.,]\d+)?)\s*%"
_MONEY = r"[^\d.,](\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+,\d{2})[^\d.,]"
_TERM = r"(?:^|[^\d])(\d+\s*(?:MESES|MES|SEMANAS|A[ÑN]OS?|D[IÍ]AS?))"


def matched(value: str, gold: str) -> str:
    rate = lambda c: _list(c, _RATE, "try_cast(replace(x, ',', '.') as double)")
    money = lambda c: _list(f"concat(' ', {c}, ' ')", _MONEY, "try_cast(replace(replace(x, '.', ''), ',', '.') as double)")
    dur_norm = norm("regexp_replace(x, '^\\d+\\s*', '')")
    term = lambda c: _list(c, _TERM, f"concat(cast(try_cast(regexp_extract(x, '^(\\d+)', 1) as integer) as varchar), ' ', substring({dur_norm}, 1, 3))", ", 'i'")
    whole = f"concat('(?:^|[^\\p{{L}}\\p{{N}}_])', regexp_escape({norm(gold)}), '(?:$|[^\\p{{L}}\\p{{N}}_])')"
    v = f"coalesce({value}, '')"
    return f"""case when len({rate(gold)}) > 0 then list_has_any({rate(gold)}, {rate(value)}) when len({money(gold)}) > 0 then list_has_any({money(gold)}, {money(value)})
      when len({term(gold)}) > 0 then list_has_any({term(gold)}, {term(value)}) else regexp_matches({norm(v)}, {whole}) end"""


RUNS = f"""
  select arm, run_no, config, count(*) as gold_slots, count(*) filter (where {has('value')}) as emitted, count(*) filter (where {has('value')} and {matched('value', 'gold')}) as correct
  from ({CONFIGS}) join ({GOLD}) using (document, field) group by all"""
METRICS = f"""
  select *, emitted - correct as incorrect, gold_slots - emitted as abstention, correct / nullif(emitted, 0) as precision, correct / gold_slots as recall,
    case when emitted > 0 and correct > 0 then 2 * (correct / emitted) * (correct / gold_slots) / (correct / emitted + correct / gold_slots) else 0.0 end as f1 from ({RUNS})"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_metrics(V.configurations(V.slots(_gated(spark, sf_dir))), V.gold_labels(table(spark, sf_dir, "golden_labels")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes))


@query(f"select arm, run_no, config, gold_slots, emitted, correct, incorrect, abstention, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from ({METRICS})")
def run_metrics_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir))


@query(f"select arm, config, round(avg(f1), 6) as mean, round(coalesce(stddev_samp(f1), 0), 6) as sd, round(min(f1), 6) as least, round(max(f1), 6) as most, count(f1) as n from ({METRICS}) group by all")
def arm_table_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.spread(_metrics(spark, sf_dir), ["arm", "config"], "f1"))


@query(f"""select m.arm, m.config, round(avg(m.f1), 6) as f1, round(avg(m.f1) - any_value(c.f1), 6) as effect, abs(avg(m.f1) - any_value(c.f1)) >= 0.05 as told
  from ({METRICS}) m join (select config, avg(f1) as f1 from ({METRICS}) where arm = 'control' group by config) c using (config) group by all""")
def effect_vs_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _metrics(spark, sf_dir).groupBy("arm", "config").agg(F.avg("f1").alias("f1"))
    control = means.filter("arm = 'control'").select("config", F.col("f1").alias("base"))
    out = means.join(control, "config").withColumn("effect", F.col("f1") - F.col("base"))
    return _rounded(out.select("arm", "config", "f1", "effect", (F.abs("effect") >= 0.05).alias("told")))


@query(f"select arm, count(*) as runs, count(*) filter (where documents >= 4) as complete from (select arm, run_no, count(distinct document) as documents from ({LATEST}) where {has('value')} group by all) group by arm")
def complete_runs_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = values(spark, sf_dir).filter(X.present(F.col("value"))).groupBy("arm", "run_no").agg(F.countDistinct("document").alias("documents"))
    return runs.groupBy("arm").agg(F.count("*").alias("runs"), F.count(F.when(F.col("documents") >= 4, 1)).alias("complete"))


@query(f"""select arm, planned_runs, done, planned_runs - done as missing from (select a.arm, planned_runs, count(distinct run_no) as done from arms a left join ({LATEST}) f using (arm) group by a.arm, planned_runs)""")
def status_planned_vs_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = values(spark, sf_dir).groupBy("arm").agg(F.countDistinct("run_no").alias("done"))
    out = table(spark, sf_dir, "arms").select("arm", "planned_runs").join(done, "arm", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumn("missing", F.col("planned_runs") - F.col("done"))


_PAIRS = f"select field, value, gold, {matched('value', 'gold')} as strict, contains({norm('value')}, {norm('gold')}) as legacy from ({LATEST}) f join ({GOLD}) g using (document, field) where {has('value')}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, sf_dir).filter(X.present(F.col("value"))).join(V.gold_labels(table(spark, sf_dir, "golden_labels")), ["document", "field"])
    return rows.select("field", "value", "gold", X.boundary_match(F.col("value"), F.col("gold")).alias("strict"), F.contains(X.normalised(F.col("value")), X.normalised(F.col("gold"))).alias("legacy"))


@query(f"select field, value, gold, strict, legacy, count(*) as n from ({_PAIRS}) where strict <> legacy group by all")
def comparator_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs on which the boundary-aware and the containment comparator differ, with their number."""
    return _pairs(spark, sf_dir).filter("strict != legacy").groupBy("field", "value", "gold", "strict", "legacy").agg(F.count("*").alias("n"))


@query(f"""select count(*) filter (where strict and {has('gold')}) as true_positive, count(*) filter (where not strict) as false_positive, round(count(*) filter (where strict) / count(*), 6) as precision, field from ({_PAIRS}) group by field""")
def precision_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count(F.when(F.col("strict"), 1))
    return _pairs(spark, sf_dir).groupBy("field").agg(F.count(F.when(F.col("strict") & X.present(F.col("gold")), 1)).alias("true_positive"), F.count(F.when(~F.col("strict"), 1)).alias("false_positive"), F.round(good / F.count("*"), 6).alias("precision"))


_CONFUSION = f"select strict as admitted, {matched('value', 'gold')} as correct from ({GATED}) join ({GOLD}) using (document, field) where method in ('llm','ner') and {has('value')}"


@query(
    f"""select tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(tn / nullif(tn + fp, 0), 6) as specificity from (
  select count(*) filter (where admitted and correct) as tp, count(*) filter (where admitted and not correct) as fp, count(*) filter (where not admitted and correct) as fn, count(*) filter (where not admitted and not correct) as tn from ({_CONFUSION}))"""
)
def confusion_of_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gated(spark, sf_dir).filter(F.col("method").isin("llm", "ner") & X.present(F.col("value"))).join(V.gold_labels(table(spark, sf_dir, "golden_labels")), ["document", "field"])
    right = X.boundary_match(F.col("value"), F.col("gold"))
    cell = lambda a, b: F.count(F.when((F.col("strict") == a) & (F.col("right") == b), 1))
    cells = rows.withColumn("right", right).agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"), cell(False, False).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(a, F.col(a) + F.col(b)), 6)
    return cells.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"))


# --- amounts ---------------------------------------------------------------------------------

_MONEY_ROWS = f"select result_id, field, method, value from ({LATEST}) where field in ('presupuesto_base_sin_iva','presupuesto_base_con_iva','valor_estimado_contrato') and value is not null"
_BARE = r"regexp_replace(value, '[\s\x{00A0}€]', '', 'g')"
WELL = f"not ({_BARE} = '' or regexp_matches({_BARE}, '^[.,]') or regexp_matches({_BARE}, '^0\\d') or regexp_matches({_BARE}, '^\\d{{1,3}}$')) and ({amount('value')}) is not null"
REASON = f"""case when regexp_matches({_BARE}, '^0+(?:[.,]0+)?$') then 'all zeros' when regexp_matches({_BARE}, '^[.,]') then 'leading separator' when regexp_matches({_BARE}, '^0\\d') then 'leading zero digits'
  when length(regexp_replace({_BARE}, '\\D', '', 'g')) <= 3 and not regexp_matches({_BARE}, '[.,]') then 'implausibly short' end"""


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).filter(F.col("field").isin(*X.MONEY_FIELDS) & F.col("value").isNotNull()).select("result_id", "field", "method", "value")


@query(f"select result_id, {amount('value')} as amount, {WELL} as well_formed, {REASON} as reason from ({_MONEY_ROWS})")
def amount_wellformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _money(spark, sf_dir).select("result_id", X.spanish_amount(v).alias("amount"), X.well_formed(v).alias("well_formed"), X.malformed_reason(v).alias("reason"))


@query(f"select method, coalesce({REASON}, 'none') as reason, count(*) as n from ({_MONEY_ROWS}) group by all")
def amount_malformed_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(spark, sf_dir).groupBy("method", F.coalesce(X.malformed_reason(F.col("value")), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


_KEPT = squeeze(r"regexp_replace(value, '[^\d.,\s\x{00A0}'']', '', 'g')")
_LOCAL = f"""try_cast(case when (contains({_KEPT}, '.') and contains({_KEPT}, ',')) or regexp_matches({_KEPT}, '[.,]\\d{{1,2}}$')
   then concat(regexp_replace(regexp_replace({_KEPT}, '[.,][^.,]*$', ''), '\\D', '', 'g'), '.', regexp_replace(regexp_extract({_KEPT}, '[.,]([^.,]*)$', 1), '\\D', '', 'g'))
   else regexp_replace({_KEPT}, '\\D', '', 'g') end as double)"""
_LOOSE = r"""try_cast(regexp_extract(regexp_replace(replace(regexp_replace(value, '[^\d.,-]', '', 'g'), '.', ''), '^([^,]*),', '\1.'), '^(-?\d+(?:\.\d+)?)', 1) as double)"""


@query(f"select result_id, {amount('value')} as spanish, case when {_LOCAL} > 0 then {_LOCAL} end as local, {_LOOSE} as loose from ({_MONEY_ROWS})")
def parse_three_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _money(spark, sf_dir).select("result_id", X.spanish_amount(v).alias("spanish"), X.local_amount(v).alias("local"), X.loose_amount(v).alias("loose"))


@query(
    """select l_orderkey, l_linenumber, l_extendedprice = back as same from (select *, """
    + amount("printed")
    + """ as back from (select l_orderkey, l_linenumber, round(l_extendedprice, 2) as l_extendedprice, concat(translate(format('{:,.2f}', l_extendedprice), ',.', '.,'), ' €') as printed from lineitem))"""
)
def parse_es_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An amount printed in the Spanish convention is read back as it was."""
    price = F.round("l_extendedprice", 2)
    printed = F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), F.lit(" €"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (price == X.spanish_amount(printed)).alias("same"))


_FIRSTS = f"select document, field, arg_min(value, result_id) as value from ({LATEST}) where {has('value')} group by all"


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).filter(X.present(F.col("value"))).groupBy("document", "field").agg(F.min_by("value", "result_id").alias("value"))


def _well(c: str) -> str:
    return f"coalesce({WELL.replace('value', c)}, false)"


_RECORDS = f"select document, max(value) filter (where field = 'presupuesto_base_sin_iva') as base_v, max(value) filter (where field = 'presupuesto_base_con_iva') as total_v, max(value) filter (where field = 'valor_estimado_contrato') as valor_v, max(value) filter (where field = 'iva') as iva_v from ({_FIRSTS}) group by document"
#: Records made from orders, with wrong totals, taxes, values and broken amounts among them.
_MADE = lambda es: f"""select cast(o_orderkey as string) as document, case when o_orderkey % 13 = 0 then '000,00 €' else {es('o_totalprice')} || ' €' end as base_v, case when o_orderkey % 17 = 0 then null else {es("o_totalprice * case when o_orderkey % 7 = 0 then 1.5 else 1.21 end")} || ' €' end as total_v,
  {es("o_totalprice * case when o_orderkey % 3 = 0 then 0.9 else 1.3 end")} || ' €' as valor_v, '21% (' || {es("o_totalprice * case when o_orderkey % 5 = 0 then 0.3 else 0.21 end")} || ' €)' as iva_v from orders"""  # noqa: E731


def _checked(rows: str) -> str:
    """(document, chk, fields): a row for each check that fails."""
    wide = f"(select *, {amount('base_v')} as base, {amount('total_v')} as total, {amount('valor_v')} as valor, try_cast(regexp_extract(iva_v, '(\\d{{1,2}})\\s*%', 1) as integer) as rate, {amount("regexp_replace(iva_v, '^\\D*\\d{1,2}\\s*%', '')")} as tax from ({rows}))"
    parts = [
        f"select document, 'base_iva_total' as chk, ['presupuesto_base_sin_iva', 'presupuesto_base_con_iva', 'iva'] as fields from {wide} where not abs(base * (1 + rate / 100) - total) <= 0.02 * greatest(base * (1 + rate / 100), total)",
        f"select document, 'iva_amount', ['iva'] from {wide} where not abs(base * rate / 100 - tax) <= 0.02 * greatest(base * rate / 100, tax)",
        f"select document, 'valor_ge_base', ['valor_estimado_contrato', 'presupuesto_base_sin_iva'] from {wide} where valor < base * 0.98",
    ]
    parts += [f"select document, 'amount_well_formed:{f}', ['{f}'] from {wide} where {has(c)} and not {_well(c)}" for f, c in zip(X.MONEY_FIELDS, ("base_v", "total_v", "valor_v"), strict=True)]
    return " union all ".join(parts)


@query(f"select document, chk from ({_checked(_RECORDS)})")
def validation_issues_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each document's record: base, tax and total, tax amount, order of value and base, incomplete amounts."""
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = _firsts(spark, sf_dir).groupBy("document").agg(*(pick(f).alias(f) for f in (*X.MONEY_FIELDS, "iva")))
    return V.validated(wide).select("document", F.explode("issues").alias("chk"))


_MADE_SQL = _MADE(lambda x: f"translate(format('{{:,.2f}}', {x}), ',.', '.,')")


@query(f"select m.document, coalesce(list_sort(list(chk) filter (where chk is not null)), []) as issues, coalesce(list_sort(list_distinct(flatten(list(fields) filter (where chk is not null)))), []) as review, count(chk) = 0 as consistent from ({_MADE_SQL}) m left join ({_checked(_MADE_SQL)}) c using (document) group by m.document")
def validation_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks on records made from orders, with the fields to be reviewed."""
    made = _MADE(lambda x: f"translate(format_number({x}, 2), ',.', '.,')")
    names = dict(zip(("base_v", "total_v", "valor_v"), X.MONEY_FIELDS, strict=True)) | {"iva_v": "iva"}
    orders = table(spark, sf_dir, "orders").selectExpr(*_columns_of(made))
    out = V.validated(orders.withColumnsRenamed(names))
    return out.withColumn("issues", F.sort_array("issues"))


def _columns_of(select: str) -> list[str]:
    """The expressions of a SELECT list, parted at commas outside brackets and quotes."""
    body, parts, depth, quote, start = select.removeprefix("select ").rpartition(" from orders")[0], [], 0, False, 0
    for k, ch in enumerate(body):
        quote ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and not depth and not quote:
            parts.append(body[start:k])
            start = k + 1
    return [*parts, body[start:]]


_MANIFEST = "select distinct on (manifest_id) * from corpus_manifest order by manifest_id, loaded_at desc"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.once(table(spark, sf_dir, "corpus_manifest"), "manifest_id", "loaded_at")


@query(
    f"""select m.file, m.procedimiento as published, f.value as found, case when f.value is null then 'absent' when starts_with({norm('f.value')}, {norm('m.procedimiento')}) or starts_with({norm('m.procedimiento')}, {norm('f.value')}) then 'agree' else 'differ' end as verdict
  from ({_MANIFEST}) m left join (select * from ({_FIRSTS}) where field = 'procedimiento') f on f.document = m.file where m.procedimiento is not null"""
)
def registry_prefix_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published procedure against the first extracted one; a prefix either way agrees."""
    found = _firsts(spark, sf_dir).filter("field = 'procedimiento'").select(F.col("document").alias("file"), F.col("value").alias("found"))
    rows = manifest(spark, sf_dir).filter("procedimiento is not null").select("file", F.col("procedimiento").alias("published")).join(found, "file", "left")
    a, b = X.normalised(F.col("found")), X.normalised(F.col("published"))
    return rows.withColumn("verdict", F.when(F.col("found").isNull(), "absent").when(F.startswith(a, b) | F.startswith(b, a), "agree").otherwise("differ"))


@query(
    f"""select case when abs(ratio - 1.00) < 0.02 then 'total' when abs(ratio - 1.21) < 0.02 then 'without tax' else 'neither' end as band, count(*) as n from (
  select {_LOOSE} / cast(budget as double) as ratio from (select f.value, m.budget from ({_MANIFEST}) m join (select * from ({_FIRSTS}) where field = 'presupuesto_base_con_iva') f on f.document = m.file where m.budget > 0)) where ratio is not null group by all"""
)
def budget_ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _firsts(spark, sf_dir).filter("field = 'presupuesto_base_con_iva'").select(F.col("document").alias("file"), X.loose_amount(F.col("value")).alias("found"))
    ratio = manifest(spark, sf_dir).filter("budget > 0").join(found, "file").select((F.col("found") / F.col("budget").cast("double")).alias("r")).filter("r is not null")
    band = F.when(F.abs(F.col("r") - 1.00) < 0.02, "total").when(F.abs(F.col("r") - 1.21) < 0.02, "without tax").otherwise("neither")
    return ratio.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


_CELL = squeeze("value")
STRICT_CELL = f"coalesce({_CELL} = '' or regexp_matches({_CELL}, '(?i){X.SENTINELS}') or (not regexp_matches({_CELL}, '^\\d{{1,3}}(?:[.,]\\d+)?$') and regexp_matches({_CELL}, '(?i)(?:{X.MEASURED})')), true)"


@query(f"select result_id, case when {STRICT_CELL} then value else 'No especificado' end as cell, coalesce(regexp_matches({_CELL}, '^\\d+(?:[.,]\\d+)?$'), false) as bare from ({LATEST})")
def amount_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that don't say what they measure become the sentinel."""
    v = F.col("value")
    bare = F.coalesce(X.squeezed(v).rlike(r"^\d+(?:[.,]\d+)?$"), F.lit(False))
    return values(spark, sf_dir).select("result_id", F.when(X.strict_amount(v), v).otherwise("No especificado").alias("cell"), bare.alias("bare"))


@query(f"select method, field, round(avg(confidence), 6) as mean, round(coalesce(stddev_samp(confidence), 0), 6) as sd, round(quantile_cont(confidence, 0.5), 6) as median, list_sort(list(confidence) filter (where confidence is not null))[least(count(confidence), cast(floor(0.9 * count(confidence)) as bigint) + 1)] as p90 from ({LATEST}) group by all")
def confidence_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, median and the value at place int(0.9 n) of the sorted confidences, by rank within buckets."""
    rows = values(spark, sf_dir)
    key = ["method", "field"]
    base = rows.groupBy(*key).agg(F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)), 6).alias("sd"))
    places = V.ranked(rows, key, "confidence")
    match = [base[k].eqNullSafe(places[k]) for k in key]
    return base.join(places, match, "left").select(*(base[k] for k in key), "mean", "sd", F.round("median", 6).alias("median"), "p90")
