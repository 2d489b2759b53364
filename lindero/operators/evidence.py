"""Sources, gates, merges, configurations, scores: operators over extracted values.

The internal contract is a long table with a row for each value: (document, field, ..., value).
First-wins and last-wins are aggregates with an explicit order, so they combine on the map side
and don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.functions.text import MONEY_FIELDS, boundary_match, located_relaxed, located_strict, normalised, percent, present, spanish_amount, well_formed

# Names of fields, methods and configurations.
#: Fields for which the model's value goes before the rules' value.
MODEL_FIRST = ("tipo_contrato", "iva", "organo_contratacion")
RULE_METHODS = ("ccec", "generic", "derived")
CONFIGURATIONS = ("deterministic_only", "model_alone", "ai_gate_no_rules", "ungated_hybrid", "full_workflow", "robust_gate")


def once(df: DataFrame, key: list[str] | str, at: str) -> DataFrame:
    """Rows delivered again reduced to the latest; columns of map type aren't used to break ties."""
    keys = [key] if isinstance(key, str) else key
    order = F.struct(at, *(c for c in df.columns if c != at and "map<" not in df.schema[c].dataType.simpleString()))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def sources(parses: DataFrame) -> DataFrame:
    """(file, source): the normalised text of each file's latest good parse, normalised once before any value is looked up."""
    good = parses.filter("ok and text is not null")
    return good.groupBy("file").agg(F.max_by("text", F.struct("parsed_at", "parse_id")).alias("text")).select("file", normalised(F.col("text")).alias("source"))


#: Distinct values of a document that are searched in one copy of its source.
SEARCHED = 20_000


def gated(values: DataFrame, texts: DataFrame) -> DataFrame:
    """`values` with `strict` and `relaxed`: whether each value is located in the source of its document; false without a source.

    Only distinct (document, value) pairs meet the sources. A document with more than SEARCHED of them
    is salted: its pairs are dealt over copies of its source, so none of its searches is one task's
    work. The results go back to the rows by document and a digest of the value.
    """
    digest = F.xxhash64("value")
    pairs = values.filter(present(F.col("value"))).select("document", "value").distinct()
    copies = pairs.groupBy("document").agg(F.ceil(F.count("*") / SEARCHED).cast("int").alias("_copies"))
    salted = texts.join(copies.withColumnRenamed("document", "file"), "file").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    dealt = pairs.join(copies, "document").withColumn("_salt", F.pmod(digest, F.col("_copies")).cast("int"))
    met = dealt.join(salted.select(F.col("file").alias("document"), "_salt", "source"), ["document", "_salt"])
    found = met.select("document", digest.alias("_value"), located_strict(F.col("value"), F.col("source")).alias("strict"), located_relaxed(F.col("value"), F.col("source")).alias("relaxed")).filter("strict or relaxed")
    found = found.groupBy("document", "_value").agg(F.bool_or("strict").alias("strict"), F.bool_or("relaxed").alias("relaxed"))
    rows = values.withColumn("_value", digest).join(found, ["document", "_value"], "left")
    return rows.select(*values.columns, F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("relaxed", F.lit(False)).alias("relaxed"))


def first_value(where: Column) -> Column:
    """The value of the lowest result_id among rows that satisfy `where` and hold a value."""
    return F.min_by("value", F.when(where & present(F.col("value")), F.col("result_id")))


def routed_merge(rules: DataFrame, model: DataFrame, routed: bool) -> DataFrame:
    """(document, field, value, origin) of both sides' (document, field, value): rules first, or, if routed, the model first for MODEL_FIRST."""
    left, right = rules.select("document", "field", F.col("value").alias("rule_value")), model.select("document", "field", F.col("value").alias("model_value"))
    both = left.join(right, ["document", "field"], "full")
    model_first = F.col("field").isin(*MODEL_FIRST) if routed else F.lit(False)
    value = F.when(model_first, F.coalesce("model_value", "rule_value")).otherwise(F.coalesce("rule_value", "model_value"))
    origin = F.when(model_first & F.col("model_value").isNotNull(), "model").when(F.col("rule_value").isNotNull(), "rules").otherwise("model")
    return both.select("document", "field", value.alias("value"), origin.alias("origin"))


def slots(values: DataFrame) -> DataFrame:
    """(arm, run_no, document, field, deterministic, model_value, strict, relaxed): one row for each slot of a run."""
    by_rule, by_model = F.col("method").isin(*RULE_METHODS), F.col("method").isin("llm", "ner")
    grouped = values.groupBy("arm", "run_no", "document", "field")
    key = F.when(by_model & present(F.col("value")), F.col("result_id"))
    return grouped.agg(first_value(by_rule).alias("deterministic"), first_value(by_model).alias("model_value"), F.coalesce(F.min_by("strict", key), F.lit(False)).alias("strict"), F.coalesce(F.min_by("relaxed", key), F.lit(False)).alias("relaxed"))


def configurations(slots: DataFrame) -> DataFrame:
    """Each slot in the six configurations: (arm, run_no, document, field, config, value)."""
    d, m = F.col("deterministic"), F.col("model_value")
    strict, relaxed = F.when(F.col("strict"), m), F.when(F.col("relaxed"), m)
    values = dict(zip(CONFIGURATIONS, (d, m, strict, F.coalesce(d, m), F.coalesce(d, strict), F.coalesce(d, relaxed)), strict=True))
    rows = F.array(*(F.struct(F.lit(name).alias("config"), value.alias("value")) for name, value in values.items()))
    return slots.select("arm", "run_no", "document", "field", F.inline(rows))


def gold_labels(labels: DataFrame) -> DataFrame:
    """(document, field, gold): the first label of each slot; comments are left out."""
    real = labels.filter("field not like '\\\\_%' and gold is not null")
    return real.groupBy(F.col("doc").alias("document"), "field").agg(F.min_by("gold", "label_id").alias("gold"))


def run_metrics(configured: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of each (arm, run_no, config) over the slots with a label."""
    labelled = configured.join(gold, ["document", "field"])
    has = present(F.col("value"))
    right = has & boundary_match(F.col("value"), F.col("gold"))
    sums = labelled.groupBy("arm", "run_no", "config").agg(F.count("*").alias("gold_slots"), F.count(F.when(has, 1)).alias("emitted"), F.count(F.when(right, 1)).alias("correct"))
    precision, recall = F.try_divide("correct", "emitted"), F.try_divide("correct", "gold_slots")
    out = sums.select("*", (F.col("emitted") - F.col("correct")).alias("incorrect"), (F.col("gold_slots") - F.col("emitted")).alias("abstention"), precision.alias("precision"), recall.alias("recall"))
    f1 = F.when((F.coalesce("precision", F.lit(0.0)) > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def spread(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), least, most and number of a measure, nulls left out."""
    return df.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.coalesce(F.stddev_samp(measure), F.lit(0.0)).alias("sd"), F.min(measure).alias("least"), F.max(measure).alias("most"), F.count(measure).alias("n"))


#: Share by which two figures may differ, and what each check is about.
TOLERANCE = 0.02
CHECKS = {
    "base_iva_total": ("presupuesto_base_sin_iva", "presupuesto_base_con_iva", "iva"), "iva_amount": ("iva",), "valor_ge_base": ("valor_estimado_contrato", "presupuesto_base_sin_iva"),
    **{f"amount_well_formed:{f}": (f,) for f in MONEY_FIELDS},
}


def validated(records: DataFrame, key: str = "document") -> DataFrame:
    """(key, issues, review, consistent) of records (key, the three amounts, iva): which checks fail, and the fields to look at again. Nothing is withheld."""
    base, total, valor = (spanish_amount(F.col(f)) for f in MONEY_FIELDS)
    rate, tax = percent(F.col("iva")), spanish_amount(F.regexp_replace("iva", r"^\D*\d{1,2}\s*%", ""))
    apart = lambda a, b: ~(F.abs(a - b) <= TOLERANCE * F.greatest(a, b))
    failed = {"base_iva_total": apart(base * (1 + rate / 100), total), "iva_amount": apart(base * rate / 100, tax), "valor_ge_base": valor < base * (1 - TOLERANCE)}
    failed |= {f"amount_well_formed:{f}": present(F.col(f)) & ~well_formed(F.col(f)) for f in MONEY_FIELDS}
    issues = F.array_compact(F.array(*(F.when(c, name) for name, c in failed.items())))
    rows = records.select(key, F.explode_outer(F.array(F.struct(issues.alias("names")))).alias("i"))
    fields = F.create_map(*(x for name, about in CHECKS.items() for x in (F.lit(name), F.array(*map(F.lit, about)))))
    return rows.select(key, F.col("i.names").alias("issues"), F.sort_array(F.array_distinct(F.flatten(F.transform("i.names", lambda n: fields[n])))).alias("review"), (F.size("i.names") == 0).alias("consistent"))


#: Buckets into which `ranked` parts the range of each group.
BUCKETS = 4096


def ranked(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, n, median, p90) of a measure, exactly: the median of even numbers is the middle of two, p90 the value at place int(0.9 n) of the sorted ones; a row counts `weight` times.

    No group is gathered or sorted whole: values are counted in BUCKETS equal parts of their group's
    range, the wanted places are found among these counts, and only the values of the buckets that
    hold them are counted one by one.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_w").alias("_n"))
    n = F.col("_n")
    wanted = {"_m1": F.floor((n + 1) / 2), "_m2": F.floor(n / 2) + 1, "_p90": F.least(n, F.floor(n * 0.9) + 1)}
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = rows.alias("a").join(span.alias("b"), match).select(*(F.col(f"a.{k}").alias(k) for k in keys), "_v", "_w", "_n", F.least(F.lit(BUCKETS - 1), F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * BUCKETS)).alias("_b"))
    counts = placed.groupBy(*keys, "_b").agg(F.sum("_w").alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0)))
    held = upto.select(*keys, "_b", "_before", "_c", F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), place.alias("_place")) for name, place in wanted.items()))).alias("w")).select(*keys, "_b", "_before", "_c", "w.*")
    held = held.filter((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_before") + F.col("_c"))).select(*keys, "_b", "_name", (F.col("_place") - F.col("_before")).alias("_at"))
    both = [*(F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys), F.col("p._b") == F.col("h._b")]
    inside = placed.groupBy(*keys, "_b", "_v").agg(F.sum("_w").alias("_c")).alias("p").join(held.alias("h"), both).select(*(F.col(f"p.{k}").alias(k) for k in keys), "_v", "p._c", "_name", "_at")
    run = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_v"))
    first = inside.withColumn("_upto", run).filter(F.col("_upto") >= F.col("_at")).groupBy(*keys, "_name").agg(F.min("_v").alias("_x"))
    one = lambda name: F.max(F.when(F.col("_name") == name, F.col("_x")))
    return first.groupBy(*keys).agg(((one("_m1") + one("_m2")) / 2).alias("median"), one("_p90").alias("p90"))
