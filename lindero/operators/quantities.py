"""Problem 4: quantities recorded in different units, brought to euro cents and days.

Where a unit comes from has an order: the text of the value itself, its unit column, its note, what
the portal says about its figures, else euros or days. Each string is read by lindero.functions.units
in Arrow batches, once per distinct string and worker.

Defined results: null amounts give no row; a unit that can't be read counts as not given; rows
delivered again give one row, the latest; amounts are rounded half up to whole cents or days.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.functions.units import quantity, segment, unit_in_note

_READ = T.StructType([T.StructField("quantity", T.LongType()), T.StructField("as_base", T.BooleanType())])

BASE = {"money": Fraction(100), "time": Fraction(1)}
FIELDS = {"valor_estimado_contrato": "money", "plazo_ejecucion": "time"}


def _whole(amount: Fraction) -> int:
    return int((abs(amount) * 2 + 1) // 2) * (1 if amount >= 0 else -1)


@F.pandas_udf(_READ)
def _amounts(amount: pd.Series, unit: pd.Series, note: pd.Series, about: pd.Series) -> pd.DataFrame:
    rows = []
    for number, *said in zip(amount, unit, note, about, strict=True):
        if number is None:
            rows.append((None, None))
            continue
        found = segment(said[0], "money") if said[0] else None
        if found is None or found.dimension != "money":
            found = next((u for text in said[1:] if text and (u := unit_in_note(text, "money"))), None)
        size = found.size if found else BASE["money"]
        rows.append((_whole(Fraction(number) * size), size == BASE["money"]))
    return pd.DataFrame(rows, columns=["quantity", "as_base"]).astype({"quantity": "Int64", "as_base": "boolean"})


@F.pandas_udf(_READ)
def _stated(gold: pd.Series, note: pd.Series, dimension: pd.Series) -> pd.DataFrame:
    rows = []
    for text, remark, field in zip(gold, note, dimension, strict=True):
        found = quantity(text, field) if text and field else None
        if found is None:
            rows.append((None, None))
            continue
        if found.unit is None:
            unit = unit_in_note(remark, field) if remark else None
            size = unit.size if unit else BASE[field]
            rows.append((_whole(found.amount * size), size == BASE[field]))
        else:
            rows.append((_whole(found.amount), found.unit == BASE[field]))
    return pd.DataFrame(rows, columns=["quantity", "as_base"]).astype({"quantity": "Int64", "as_base": "boolean"})


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the one with the latest `at`; ties go by the other columns."""
    rest = [c for c in df.columns if c not in (key, at)]
    packed = F.struct(at, *(c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), packed).alias("_row")).select("_row.*")


def budget_cents(manifest: DataFrame, portals: DataFrame) -> DataFrame:
    """(manifest_id, quantity in cents, as_base)."""
    rows = latest(manifest.select("manifest_id", "budget", "budget_unit", "budget_note", "portal", "loaded_at"), "manifest_id", "loaded_at").filter("budget is not null")
    about = portals.groupBy("portal").agg(F.max("about").alias("about"))
    said = rows.join(about, "portal", "left")
    return said.select("manifest_id", _amounts(F.col("budget").cast("string"), "budget_unit", "budget_note", "about").alias("q")).select("manifest_id", "q.*").filter("quantity is not null")


def label_quantities(labels: DataFrame) -> DataFrame:
    """(label_id, dimension, quantity in cents or days, as_base) of the labels for amounts and terms."""
    dimension = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))[F.col("field")]
    rows = latest(labels.select("label_id", "field", "gold", "note", "labelled_at").filter(F.col("field").isin(*FIELDS)), "label_id", "labelled_at")
    read = rows.filter("gold is not null").withColumn("dimension", dimension)
    return read.select("label_id", "dimension", _stated("gold", "note", "dimension").alias("q")).select("label_id", "dimension", "q.*").filter("quantity is not null")


def quantities(manifest: DataFrame, portals: DataFrame, labels: DataFrame) -> DataFrame:
    """(tbl, row_id, dimension, quantity, as_base): every amount in cents and every term in days."""
    budgets = budget_cents(manifest, portals).select(F.lit("corpus_manifest").alias("tbl"), F.col("manifest_id").alias("row_id"), F.lit("money").alias("dimension"), "quantity", "as_base")
    stated = label_quantities(labels).select(F.lit("golden_labels").alias("tbl"), F.col("label_id").alias("row_id"), "dimension", "quantity", "as_base")
    return budgets.unionByName(stated)
