"""Coercion of model answers: wrappers, aliases, shapes of a field, tri-state booleans, criteria, defaults.

An answer is a VARIANT; what is looked for under several names is the first that isn't null. Nested
values are flattened by `tables.flat_text` in Arrow batches, everything else by Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lindero.functions.text import squeezed
from lindero.operators.extraction import java

# Names under which models wrap a record, its fields, and the names that models give them.
WRAPPERS = ("ficha", "ficha_ejecutiva", "tender_details", "datos_ficha", "tender_summary")
FIELDS = (
    "organo_contratacion", "numero_expediente", "objeto_contrato", "presupuesto_base_sin_iva", "presupuesto_base_con_iva", "valor_estimado_contrato", "plazo_ejecucion", "plazo_presentacion_ofertas", "lugar_presentacion", "garantia_provisional", "garantia_definitiva",
    "solvencia_economica", "solvencia_tecnica", "clasificacion_empresarial", "procedimiento", "tramitacion", "tipo_contrato", "iva", "ofertas_anormalmente_bajas", "plazo_garantia", "seguros_obligatorios", "presentacion_electronica",
)
ALIASES = {
    "valor_estimado_contrato": ("valor_estimado", "valor_estimado_del_contrato", "valorEstimado"), "presupuesto_base_con_iva": ("presupuesto_base_licitacion", "presupuesto_base_de_licitacion", "presupuesto_con_iva", "presupuesto_total"),
    "presupuesto_base_sin_iva": ("presupuesto_sin_iva", "base_imponible", "importe_base"), "presentacion_electronica": ("presentacion_electronica_plataforma", "licitacion_electronica", "presentacion_ofertas_electronica"),
    "numero_expediente": ("expediente", "num_expediente", "numero_de_expediente"), "organo_contratacion": ("organo_contratante", "organo_de_contratacion", "organo"), "objeto_contrato": ("objeto_del_contrato", "objeto"), "plazo_ejecucion": ("plazo_de_ejecucion", "duracion_contrato", "duracion"),
    "plazo_presentacion_ofertas": ("plazo_de_presentacion_de_ofertas", "plazo_presentacion_de_ofertas", "plazo_de_presentacion"), "lugar_presentacion": ("lugar_de_presentacion", "lugar_presentacion_ofertas"), "plazo_garantia": ("plazo_de_garantia", "periodo_garantia"),
    "garantia_definitiva": ("garantia_definitiva_importe",), "clasificacion_empresarial": ("clasificacion",), "tipo_contrato": ("tipo_de_contrato", "calificacion"),
}
YES, NO = r"^s[ií]\b|permit|aplica|true", r"^no\b|prohib|false"
JUDGED = r"subjet|juicio"


def _member(record: Column, *names: str) -> Column:
    """The first member that isn't null, as a VARIANT."""
    known = [F.try_variant_get(record, f"$.{n}", "variant") for n in names]
    real = [F.when(~F.is_variant_null(v), v) for v in known]
    return F.coalesce(*real) if len(real) > 1 else real[0]


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def unwrapped(answer: Column) -> Column:
    """The record inside an answer: the first wrapper that isn't null, else the answer; null unless it is an object."""
    record = F.coalesce(_member(answer, *WRAPPERS), answer)
    return F.when(_kind(record).startswith("OBJECT"), record)


def scalar(value: Column) -> Column:
    """A string trimmed (null if blank), a number as text, a boolean as a word; null for anything else."""
    text = F.try_variant_get(value, "$", "string")
    kind = _kind(value)
    return F.when(kind == "STRING", F.nullif(squeezed(text), F.lit(""))).when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "Sí").otherwise("No")).when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), text)


def members(record: Column) -> Column:
    """ARRAY of (field, raw): each field of the schema under its own name or an alias."""
    return F.array(*(F.struct(F.lit(field).alias("field"), _member(record, field, *ALIASES.get(field, ())).alias("raw")) for field in FIELDS))


def field_parts(raw: Column) -> Column:
    """(value, rest, reference) of a field: its value if it is a scalar, the JSON of one that must be flattened, and its clause."""
    kind = _kind(raw)
    shaped = kind.startswith("OBJECT") & (F.try_variant_get(raw, "$.value", "variant").isNotNull() | F.try_variant_get(raw, "$.clause_reference", "variant").isNotNull())
    body = F.when(shaped, _member(raw, "value")).otherwise(raw)
    nested = _kind(body).startswith("OBJECT") | _kind(body).startswith("ARRAY")
    text = lambda name: F.when(_kind(F.try_variant_get(raw, f"$.{name}", "variant")) == "STRING", F.try_variant_get(raw, f"$.{name}", "string"))
    reference = F.when(kind.startswith("OBJECT"), F.coalesce(text("clause_reference"), text("reference")))
    return F.struct(scalar(body).alias("value"), F.when(nested, F.to_json(body)).alias("rest"), reference.alias("reference"))


def tri_state(raw: Column) -> Column:
    """true, false or null from a boolean, a word or an object with `aplica`."""
    kind, text = _kind(raw), F.try_variant_get(raw, "$", "string")
    inner = F.try_variant_get(raw, "$.aplica", "variant")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean")).when((kind == "STRING") & text.rlike(java(YES)), True).when((kind == "STRING") & text.rlike(java(NO)), False)
        .when(kind.startswith("OBJECT") & (_kind(inner) == "BOOLEAN"), F.try_variant_get(raw, "$.aplica", "boolean"))
    )


def criteria(raw: Column) -> Column:
    """ARRAY of (criterio, peso_porcentaje, tipo, clause_reference); items without a name are left out, an unknown kind is objective."""
    number = lambda c, n: F.when(~_kind(_member(c, n)).isin("STRING", "BOOLEAN", "VOID") & ~_kind(_member(c, n)).startswith("OBJECT"), F.try_variant_get(c, f"$.{n}", "double"))
    named = F.transform(
        F.from_json(F.to_json(raw), "array<variant>"),
        lambda c: F.struct(scalar(_member(c, "criterio", "nombre", "descripcion")).alias("criterio"), F.coalesce(number(c, "peso_porcentaje"), number(c, "peso")).alias("peso_porcentaje"), F.when(F.coalesce(F.try_variant_get(c, "$.tipo", "string"), F.lit("")).rlike(java(JUDGED)), "subjetivo").otherwise("objetivo").alias("tipo"), F.try_variant_get(c, "$.clause_reference", "string").alias("clause_reference")),
    )
    return F.when(_kind(raw).startswith("ARRAY"), F.filter(named, lambda c: c["criterio"].isNotNull())).otherwise(F.array().cast("array<struct<criterio:string,peso_porcentaje:double,tipo:string,clause_reference:string>>"))
