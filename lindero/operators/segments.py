"""Segments of tender documents: clauses, annexes, items of the box of characteristics; the first annex; selection of input.

Everything is worked out within the row of a text by `spots`, so no text is shuffled; only what is
asked for leaves the row. Spark evaluates anew, for each element, what a lambda takes from outside,
so arrays that lambdas look into are columns of the row first (`_` names, dropped at the end).
Positions are 0-based code points, intervals half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions.text import spots, squeezed
from lindero.operators.extraction import _once, java

# Headings by family (marker, title), in the notation of JavaScript.
FAMILIES = {
    "clause": (r"(?:^|[\s.])Cl[aá]usulas?\s+(\d{1,2})\s*[.\-–)]\s*([A-ZÁÉÍÓÚÜÑ][^.\n]{2,90})", False),
    "annex": (r"(?:^|[\s.])ANEXO\s+([IVXLC]{1,5}|\d{1,2})\b[\s.\-–]*([^\n]{0,80})", False),
    "lettered": (r"(?:^|[\s.])([A-H])\.\s+([A-ZÁÉÍÓÚÜÑ][^.\n]{3,70})", True),
    "numbered": (r"(?:^|[\s.])(\d{1,2})\)\s*([A-ZÁÉÍÓÚÜÑ][^.\n]{3,70})", True),
}
ANNEX_HEADING = r"(?:^|\n)\s*ANEXO\s+I\b[^\n]*\n"
ANNEX_END = r"\n\s*(?:ANEXO\s+(?:II|III|IV|V|VI|VII|VIII|IX|X)\b|FIRMADO\s+ELECTR[ÓO]NICAMENTE)"
ITEM = r"(?:^|\n)\s*(\d{1,2}(?:\.\d{1,2}){0,2}(?:\.[a-z])?)[.)\-]\s+(?=[A-ZÁÉÍÓÚÜÑ])"
LEAST_ITEMS = 8
#: The item of the first annex in which each field stands.
FIELD_ITEM = {
    "procedimiento": "1", "tipo_contrato": "1", "organo_contratacion": "2", "tramitacion": "3", "objeto_contrato": "4", "plazo_ejecucion": "8", "presupuesto_base_sin_iva": "10", "presupuesto_base_con_iva": "10", "valor_estimado_contrato": "10", "iva": "10",
    "clasificacion_empresarial": "14", "solvencia_economica": "14", "solvencia_tecnica": "14", "garantia_provisional": "20", "garantia_definitiva": "22", "seguros_obligatorios": "24", "subcontratacion_permitida": "26", "revision_precios_aplica": "28",
    "plazo_garantia": "31", "presentacion_electronica": "33", "otras_obligaciones_contratista": "34",
}
#: Cues of the fields in running text; case is ignored.
CUES = {
    "organo_contratacion": (r"[oó]rgano de contrataci[oó]n", r"entidad adjudicadora", r"poder adjudicador"), "numero_expediente": (r"n[uú]mero de expediente", r"\bexpediente\s*[:nº]", r"\bexpte\.?\b"),
    "objeto_contrato": (r"objeto del contrato", r"objeto de la licitaci[oó]n"), "presupuesto_base_sin_iva": (r"presupuesto base de licitaci[oó]n", r"\bsin iva\b", r"\biva excluido\b"),
    "presupuesto_base_con_iva": (r"\bcon iva\b", r"\biva incluido\b", r"presupuesto base de licitaci[oó]n"), "valor_estimado_contrato": (r"valor estimado",), "plazo_ejecucion": (r"plazo de ejecuci[oó]n", r"duraci[oó]n del contrato"),
    "plazo_presentacion_ofertas": (r"plazo de presentaci[oó]n de (?:las )?(?:ofertas|proposiciones)", r"fecha l[ií]mite"), "lugar_presentacion": (r"lugar de presentaci[oó]n", r"presentaci[oó]n de (?:las )?(?:ofertas|proposiciones)"),
    "garantia_provisional": (r"garant[ií]a provisional",), "garantia_definitiva": (r"garant[ií]a definitiva",), "solvencia_economica": (r"solvencia econ[oó]mica", r"solvencia financiera"), "solvencia_tecnica": (r"solvencia t[eé]cnica", r"solvencia profesional"),
    "clasificacion_empresarial": (r"clasificaci[oó]n (?:empresarial|del contratista|exigible)", r"\bgrupo\s+[A-K]\b.{0,40}\bsubgrupo\b"), "procedimiento": (r"procedimiento (?:abierto|restringido|negociado|de adjudicaci[oó]n)", r"forma de adjudicaci[oó]n"),
    "tramitacion": (r"tramitaci[oó]n (?:ordinaria|urgente|anticipada)", r"\btramitaci[oó]n\b"), "tipo_contrato": (r"tipo de contrato", r"contrato de (?:obras|servicios|suministros?|concesi[oó]n)"), "iva": (r"\bi\.?v\.?a\.?\b", r"impuesto sobre el valor a[ñn]adido", r"tipo impositivo"),
    "ofertas_anormalmente_bajas": (r"anormalmente baja", r"ofertas desproporcionadas", r"temeraria"), "plazo_garantia": (r"plazo de garant[ií]a",), "seguros_obligatorios": (r"seguro de responsabilidad civil", r"p[oó]liza", r"seguros?\s+(?:obligatorios?|exigidos?)"),
    "presentacion_electronica": (r"presentaci[oó]n electr[oó]nica", r"medios electr[oó]nicos", r"plataforma de contrataci[oó]n"),
}
WINDOW, MAX_HITS = 1500, 3
CONTROL_CAP, FULLTEXT_CAP, HEAD = 120_000, 900_000, 12_000
GAP = "\n\n[…]\n\n"
#: The signs that a blank of these patterns may be.
BLANK_SIGNS = " \t\n\x0b\f\r\u00a0\ufeff"


def part(text: Column, start: Column, end: Column) -> Column:
    """The code points from `start` to `end`."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def closed(found: Column, text: Column, family: str) -> Column:
    """ARRAY of (marker, title, start, body_start, end) from the spots of a family, a column of the row; each ends where the next begins."""
    pattern, case = FAMILIES[family]
    group = lambda m, g: F.regexp_extract(m["text"], java(pattern, case), g)
    marker = lambda m: F.upper(group(m, 1)) if family == "annex" else group(m, 1)
    return F.transform(
        found,
        lambda m, k: F.struct(marker(m).alias("marker"), squeezed(group(m, 2)).alias("title"), m["start"].alias("start"), m["end"].alias("body_start"), F.coalesce(F.get(found, k + 1)["start"], F.length(text)).alias("end")),
    )


def with_segments(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with the arrays `clause`, `annex` and `item`: the segments of each text. Items are those of the style that prevails, numbered ones among equals."""
    rows = documents.select("*", *(spots(F.col(text), java(pattern, case)).alias(f"_{family}") for family, (pattern, case) in FAMILIES.items()))
    rows = rows.select("*", *(closed(F.col(f"_{family}"), F.col(text), family).alias(f"_closed_{family}") for family in FAMILIES))
    item = F.when(F.size("_closed_numbered") >= F.size("_closed_lettered"), F.col("_closed_numbered")).otherwise(F.col("_closed_lettered"))
    rows = rows.select(*documents.columns, F.col("_closed_clause").alias("clause"), F.col("_closed_annex").alias("annex"), item.alias("item"))
    return rows


def segment_body(text: Column, found: Column, title: str, most: int = 400) -> Column:
    """The body of the first segment whose title, or marker and title, fits; at most `most` characters, blanks squeezed; null if none fits."""
    fits = lambda s: s["title"].rlike(java(title)) | F.concat(s["marker"], F.lit(" "), s["title"]).rlike(java(title))
    first = F.get(F.filter(found, fits), F.lit(0))
    return F.when(first.isNotNull(), squeezed(part(text, first["body_start"], F.least(first["end"], first["body_start"] + most))))


def with_annex(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with `items`: ARRAY of (number, title, body) of the first annex; null without a heading or with fewer than LEAST_ITEMS boundaries; of repeated numbers the last stays."""
    trim = lambda c: F.regexp_replace(c, r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$", "")
    t, block, found = F.col(text), F.col("_block"), F.col("_found")
    heading = F.regexp_substr(t, F.lit(java(ANNEX_HEADING)))
    rows = documents.withColumn("_tail", F.substring(t, F.regexp_instr(t, F.lit(java(ANNEX_HEADING))) + F.length(heading), F.length(t)))
    end = F.regexp_instr("_tail", F.lit(java(ANNEX_END)))
    rows = rows.withColumn("_block", F.when(end > 0, F.substring(F.col("_tail"), F.lit(1), end - 1)).otherwise(F.col("_tail")))
    rows = rows.withColumn("_found", spots(block, java(ITEM, case=True)))
    body = lambda m, k: trim(part(block, m["end"], F.coalesce(F.get(found, k + 1)["start"], F.length(block))))
    rows = rows.withColumn("_items", F.transform(found, lambda m, k: F.struct(F.regexp_extract(m["text"], r"(\d[\d.a-z]*)[.)\-]", 1).alias("number"), body(m, k).alias("body"))))
    rows = rows.withColumn("_numbers", F.reverse(F.transform("_items", lambda x: x["number"])))
    last = F.filter("_items", lambda x, k: k + F.array_position(F.col("_numbers"), x["number"]) == F.size("_numbers"))
    titled = F.transform(last, lambda x: F.struct(x["number"].alias("number"), trim(F.regexp_extract(x["body"], r"^([^\n.]{0,200})", 1)).alias("title"), x["body"].alias("body")))
    return rows.select(*documents.columns, F.when(F.size("_numbers") >= LEAST_ITEMS, titled).alias("items"))


def item_body(items: Column, *numbers: str) -> Column:
    """The first body that isn't empty of the items with these numbers, in order."""
    one = lambda number: F.filter(items, lambda x: (x["number"] == number) & (x["body"] != ""))
    return F.coalesce(*(F.get(one(n), F.lit(0))["body"] for n in numbers))


# --- selection of input ----------------------------------------------------------------------


def with_head_and_annex(documents: DataFrame, text: str = "text", to: str = "chosen") -> DataFrame:
    """The head and the last first annex; the whole text unless that is at least 8,000 characters and less than four fifths of it."""
    t, start, parts, last = F.col(text), F.col("_start"), F.col("_parts"), F.col("_last")
    keep = documents.columns
    # long texts are read as seldom as can be: a literal finds ANEXO, and only what stands before and behind it is matched; each step is worked out once
    rows = _once(documents, {"_parts": F.when(F.contains(t, F.lit("ANEXO")), F.split(t, "ANEXO", -1))}, *keep)
    behind = lambda k: F.concat(F.get(parts, k + 1), F.when(k + 2 < F.size(parts), "A").otherwise(""))
    opening = lambda p, k: F.when((k == 0) & (F.ltrim(p, F.lit(BLANK_SIGNS)) == ""), p).otherwise(F.regexp_extract(p, java(r"\n\s*\z", case=True), 0))
    openings = F.transform(parts, lambda p, k: F.when(behind(k).rlike(java(r"^\s+I\b", case=True)), opening(p, k)))
    rows = _once(rows, {"_openings": openings, "_sizes": F.transform(parts, F.length)}, *keep)
    headed = lambda o, k: (o != "") | o.isNotNull() & (k == 0) & (F.get(F.col("_sizes"), F.lit(0)) == 0)
    rows = _once(rows, {"_last": F.array_max(F.transform("_openings", lambda o, k: F.when(headed(o, k), k)))}, *keep, "_openings", "_sizes")
    before = F.aggregate(F.slice("_sizes", 1, last + 1), F.lit(0), lambda n, size: n + size)
    rows = _once(rows, {"_start": before + last * len("ANEXO") - F.length(F.get("_openings", last))}, *keep)
    after = F.regexp_instr(F.substring(t, start + 11, F.length(t)), F.lit(java(r"(?:^|\n)\s*ANEXO\s+(?:II|III|IV|V|VI|VII|VIII|IX|X)\b", case=True)))
    rows = _once(rows, {"_after": after}, *keep, "_start")
    end = F.when(F.col("_after") > 0, start + 10 + F.col("_after") - 1).otherwise(F.least(F.length(t), start + CONTROL_CAP))
    rows = _once(rows, {"_focus": F.concat(part(t, F.lit(0), F.least(F.lit(HEAD), start)), F.lit(GAP), part(t, start, end))}, *keep)
    fits = (F.length("_focus") >= 8000) & (F.length("_focus") < F.length(t) * 0.8)
    return rows.select(*keep, F.when(fits, F.col("_focus")).otherwise(t).alias(to))


def small(text: Column) -> Column:
    """A text in small letters, of the same length: patterns in small letters are read faster on it than with case ignored."""
    return F.lower(F.translate(text, "İ", "I"))


def cue_spots(low: Column, cues: dict[str, tuple[str, ...]] | None = None, most: int | None = MAX_HITS) -> Column:
    """ARRAY of (field, cue_no, hit_no, start, end): the first hits of each cue in a text in small letters (a column of the row), all cues from one reading of it."""
    parts = []
    for field, patterns in (CUES if cues is None else cues).items():
        for number, pattern in enumerate(patterns, 1):
            found = spots(low, java(pattern.lower(), case=True))
            parts.append(_named(F.slice(found, 1, most) if most else found, field, number))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _named(found: Column, field: str, number: int) -> Column:
    return F.transform(found, lambda m, k: F.struct(F.lit(field).alias("field"), F.lit(number).alias("cue_no"), (k + 1).cast("int").alias("hit_no"), m["start"].alias("start"), m["end"].alias("end")))


def windows(spans: Column, size: Column, around: int = WINDOW) -> Column:
    """Spans widened on both sides, in order of their start, within the text."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), s["start"] - around).alias("start"), F.least(size, s["end"] + around).alias("end"))))


def islands(spans: Column) -> Column:
    """Spans in order of their start, with those that overlap or touch made one."""
    kind = "array<struct<start:int,end:int>>"

    def step(state: Column, span: Column) -> Column:
        joins = (F.size(state) > 0) & (span["start"] <= F.element_at(state, -1)["end"])
        last = F.element_at(state, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(state, 1, F.size(state) - 1), F.array(grown))).otherwise(F.concat(state, F.array(span))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), step)


def passages(text: Column, spans: Column, cap: int = CONTROL_CAP) -> Column:
    """The parts of a text in order, set apart by GAP, up to `cap` characters; the part that crosses it is cut. Without spans (a column of the row), the start of the text."""
    edge = len(GAP) + 2

    def step(state: Column, span: Column) -> Column:
        piece = part(text, span["start"], span["end"])
        over = F.length(state["out"]) + F.length(piece) + edge > cap
        cut = F.concat(state["out"], F.lit(GAP), F.substring(piece, F.lit(1), F.greatest(F.lit(0), F.lit(cap - edge) - F.length(state["out"]))))
        more = F.concat(state["out"], F.when(F.length(state["out"]) > 0, GAP).otherwise(""), piece)
        return F.when(state["full"], state).otherwise(F.struct(F.when(over, cut).otherwise(more).alias("out"), over.alias("full")))

    joined = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), step, lambda s: s["out"])
    return F.when(F.size(spans) > 0, joined).otherwise(F.substring(text, 1, cap))


def with_islands(documents: DataFrame, text: str = "text", around: int = WINDOW) -> DataFrame:
    """`documents` with `spans`: the windows around the first hits of all cues, those that overlap or touch made one."""
    rows = documents.withColumn("_low", small(F.col(text)))
    rows = rows.withColumn("_hits", cue_spots(F.col("_low")))
    rows = rows.withColumn("_windows", windows(F.col("_hits"), F.length(text), around))
    return rows.select(*documents.columns, islands(F.col("_windows")).alias("spans"))


def selected(documents: DataFrame, rule: str, text: str = "text", to: str = "chosen") -> DataFrame:
    """`documents` with the part of each text that a rule selects: head_annex, fulltext or passage."""
    if rule == "head_annex":
        return with_head_and_annex(documents, text, to).withColumn(to, F.substring(to, 1, CONTROL_CAP))
    if rule == "fulltext":
        return documents.withColumn(to, F.substring(text, 1, FULLTEXT_CAP))
    if rule == "passage":
        return with_islands(documents, text).select(*documents.columns, passages(F.col(text), F.col("spans")).alias(to))
    raise ValueError(f"unknown selection rule {rule}")
