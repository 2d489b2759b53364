"""Field extraction by rules: anchored patterns first, a generic scan of labels behind them.

A rule reads a text and gives a value with the place it was found in and a confidence: `alta` for an
exact anchor, `media` for a generic reading. Rules are Columns over one text, so all of them come
from one scan, and a text that a rule doesn't fit gives null without failing the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions.text import ascii_edges, squeezed, title_cased

# Patterns of the layouts that are read, in the notation of JavaScript, case ignored.
NUMBER = r"\d{1,3}(?:\.\d{3})*(?:,\d+)?"
TERM = r"\d+\s*(?:MESES|MES|SEMANAS|SEMANA|D[IÍ]AS|D[IÍ]A|A[ÑN]OS|A[ÑN]O)"
PROCEDURES = r"(ABIERTO\s+SIMPLIFICADO|ABIERTO|RESTRINGIDO|NEGOCIADO\s+(?:SIN|CON)\s+PUBLICIDAD|NEGOCIADO|DI[ÁA]LOGO\s+COMPETITIVO|ASOCIACI[ÓO]N\s+PARA\s+LA\s+INNOVACI[ÓO]N|CONCURSO\s+DE\s+PROYECTOS)"
KINDS = r"(OBRAS|SERVICIOS|SUMINISTROS|GESTI[ÓO]N\s+DE\s+SERVICIOS\s+P[ÚU]BLICOS|CONCESI[ÓO]N\s+DE\s+(?:OBRAS|SERVICIOS)|MIXTO|ADMINISTRATIVO\s+ESPECIAL)"
ANCHORS = {
    "procedimiento": r"PROCEDIMIENTO\s*(?:Y\s+CALIFICACI[ÓO]N\s+DEL\s+CONTRATO\s+PROCEDIMIENTO\s*:?\s*)?" + PROCEDURES,
    "tipo_administrativo": r"Contrato\s+administrativo\s+de\s+" + KINDS,
    "tipo_calificacion": r"CALIFICACI[ÒÓ]N\s*:?\s*[^\n]*?" + KINDS,
    "tipo_contrato": r"CONTRATO\s+DE\s+" + KINDS + r"(?=\s+PROCEDIMIENTO)",
    "tramitacion": r"3\s*\)\s*TRAMITACI[ÓO]N\s*[:.\s]+(Ordinaria|Urgente|Emergencia)",
    "tramitacion_prosa": r"tramitaci[oó]n\s+(?:del\s+(?:expediente|contrato)\s+)?(?:ser[áa]\s+|es\s+|:\s*)(ordinaria|urgente|emergencia|anticipada)",
    "plazo_ejecucion": rf"PLAZO\s+DE\s+EJECUCI[ÓO]N\s+(?:Plazo\s*:?\s*)?({TERM})",
    "plazo_duracion": rf"Duraci[oó]n\s+del\s+contrato\s*:?\s*({TERM})",
    "valor_estimado": rf"Total\s+valor\s+estimado\s+contrato\s*:?\s*({NUMBER})\s*€",
    "base_imponible": rf"Total\s+Base\s+imponible\s*:?\s*({NUMBER})",
    "iva": rf"Importe\s+del\s+(\d{{1,2}})\s*%\s+de\s+IVA\s*:?\s*({NUMBER})\s*€",
    "total": rf"Importe\s+del\s+\d{{1,2}}\s*%\s+de\s+IVA[^\n]*?TOTAL\s*:?\s*({NUMBER})\s*€",
    "provisional": r"20\s*\)\s*GARANT[ÍI]A\s+PROVISIONAL[\s\S]{0,80}?Procede\s*:?\s*(SI|S[ÍI]|NO)",
    "definitiva": r"22\s*\)\s*GARANT[ÍI]A\s+DEFINITIVA[\s\S]{0,400}?(?=\d{1,2}\s*\))",
    "definitiva_prosa": r"garant[ií]a\s+definitiva\b([^.\n]{0,45}?)(\d{1,2})\s*%(\s+(?:del?|sobre)\s+[^.\n]{0,70})?",
    "definitiva_guarda": r"\b(?:provisional|complementaria|inferior|superior|no\s+inferior)\b",
    "importe": r"Importe\s*:?\s*([^\n.]{2,200})",
    "procede": r"Procede\s*:?\s*(SI|S[ÍI]|NO)",
    "retencion": r"(?:Constituci[oó]n\s+mediante\s+retenci[oó]n\s+en\s+el\s+precio[:.\s]*)\s*(SI|S[ÍI]|NO)",
    "seguros": r"24\s*\)\s*P[ÓO]LIZAS\s+DE\s+SEGUROS[\s\S]{0,2000}?(?=\d{1,2}\s*\))",
    "civil": rf"Responsabilidad\s+Civil[^\n]*?({NUMBER})\s*€\s*(?:por\s+siniestro\s+y\s+a[ñn]o)?",
    "todo_riesgo": rf"(?:TR\s+Construcci[oó]n|todo\s+riesgo)[^\n]*?por\s+un?\s+importe\s+de\s+({NUMBER})\s*€",
    "franquicia": r"Franquicia\s+admisible\s+(?:en\s+seguro)?\s*:?\s*(SI|S[ÍI]|NO)",
    "plazo_garantia": rf"(?:(\d{{1,2}})\s*\)\s*)?PLAZO\s+DE\s+GARANT[ÍI]A\b\s*[:.]?\s*(?:Plazo\s*:?\s*)?({TERM})",
    "electronica": r"33\s*\)\s*LICITACI[ÓO]N\s+ELECTR[ÓO]NICA\s*[:.\s]+([^\n.]{2,160})",
    "objeto": r"4\s*\)\s*OBJETO\s+DEL\s+CONTRATO\s+([^\n]{5,300}?)\.\s+\d{1,2}\s*\)",
    "organo": r"2\s*\)\s*[ÓO]RGANO\s+CONTRATANTE\s+([^\n]{3,200}?)(?:\s+Direcci[oó]n\s+postal\s*:|\s+\d{1,2}\s*\))",
    "economica": rf"volumen\s+(?:anual\s+)?de\s+negocios[^.\n]*?(?:igual\s+o\s+superior\s+a|por\s+importe\s+de|de)\s+({NUMBER})\s*(?:€|euros)",
    "tecnica": rf"70\s*%\s*\)\s*:\s*({NUMBER})\s*euros",
    "clasificacion": r"Grupo\s*:?\s*([A-Z])\)?\s*[A-Za-záéíóúñ\s]*?Subgrupo\s*:?\s*(\d{1,2})\s*\.?\s*[A-Za-záéíóúñ\s,.]*?Categor[íi]a\s*:?\s*(\d)",
}
#: The heading form of the object is told from prose by its capitals, so case counts.
OBJECT_HEADING = r"\bOBJETO\s+DEL\s+CONTRATO\b[.:\s]+([A-ZÁÉÍÓÚÑ\"“][^\n]{12,200}?)(?:\.\s|\s\d{1,2}\s*[.\-)])"
#: Words between a label and a value after which the value is a threshold or an example.
GUARD = r"\b(?:sea|inferior|superior|igual o superior|cuando|exceda?|excede|umbral|mayor|menor|no podr|responsabilidad|transcurrid|vicios ocultos|a partir de|en su caso|por ejemplo|al menos|como m[ií]nimo|m[aá]ximo de)\b"
#: Labels by what they name, in order of priority.
LABELS = {
    "valor_estimado": ("valor estimado del contrato", "valor estimado"),
    "presupuesto": ("presupuesto base de licitaci[oó]n", "presupuesto de licitaci[oó]n", "presupuesto del contrato"),
    "plazo_ejecucion": ("plazo de ejecuci[oó]n", "plazo de duraci[oó]n", "duraci[oó]n del contrato", "plazo total de ejecuci[oó]n"),
    "plazo_garantia": ("plazo de garant[ií]a", "per[ií]odo de garant[ií]a"),
    "garantia_definitiva": ("garant[ií]a definitiva",),
}
VALUES = {"money": NUMBER, "duration": r"\d{1,3}", "percent": r"\d{1,2}"}
UNITS = {"money": r"(?:€|euros\b)", "duration": r"(?:meses|mes|semanas|semana|d[ií]as|d[ií]a|a[ñn]os|a[ñn]o)\b", "percent": "%"}
MAX_GAP, REACH = 70, 100


def java(pattern: str, case: bool = False) -> str:
    """A pattern of JavaScript for Java: blanks count the no-break space, \\b counts ASCII."""
    return ("" if case else "(?iu)") + ascii_edges(pattern).replace(r"\s", r"[\s\x{00A0}\x{FEFF}]").replace(r"[[\s\x{00A0}\x{FEFF}]\S]", r"[\s\S]")


def taken(text: Column, pattern: str, group: int = 1, case: bool = False) -> Column:
    """A group of the first match with blanks squeezed; null without a match."""
    return F.nullif(squeezed(F.regexp_extract(text, java(pattern, case), group)), F.lit(""))


def _yes(text: Column) -> Column:
    return F.when(F.upper(text).isin("SI", "SÍ"), "SI").otherwise("NO")


def _context(text: Column, label: str, kind: str) -> Column:
    """What follows the first place of a label behind which a value of a type stands within MAX_GAP characters and no words of a threshold; null without one."""
    pattern = _valued(kind)
    # the context is only looked at, so that a label within another's context is tried too
    contexts = F.regexp_extract_all(text, F.lit(rf"(?iu){label}(?=((?s:.{{0,{REACH}}})))"), F.lit(1))
    gap = lambda c: F.regexp_extract(c, pattern, 1)
    return F.get(F.filter(contexts, lambda c: c.rlike(pattern) & (F.length(gap(c)) <= MAX_GAP) & ~gap(c).rlike(java(GUARD))), F.lit(0))


def _valued(kind: str) -> str:
    return rf"(?s){java('')}^(.*?)({VALUES[kind]})[\s\x{{00A0}}\x{{FEFF}}]*({ascii_edges(UNITS[kind])})"


def _shown(context: Column, kind: str) -> Column:
    number, unit = F.regexp_extract(context, _valued(kind), 2), F.regexp_extract(context, _valued(kind), 3)
    return {"money": F.concat(number, F.lit(" €")), "duration": F.concat(number, F.lit(" "), F.upper(unit)), "percent": F.concat(number, F.lit("%"))}[kind]


def labelled(text: Column, labels: tuple[str, ...], kind: str) -> Column:
    """The first value of a type behind a label, labels in order of priority."""
    found = [_shown(_context(text, label, kind), kind) for label in labels]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _field(value: Column, place: Column | str, sure: bool = True) -> Column:
    place = F.lit(place) if isinstance(place, str) else place
    return F.when(value.isNotNull(), F.struct(value.alias("value"), place.alias("reference"), F.lit("alta" if sure else "media").alias("confidence")))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.array_join(F.array_compact(F.array(*parts)), "; "), F.lit(""))


#: Groups of the anchors that are used besides the first.
_GROUPS = {"iva": (1, 2), "plazo_garantia": (1, 2), "definitiva": (0,), "seguros": (0,), "definitiva_prosa": (0, 2, 3)}
_INNER = {"definitiva": ("procede", "importe", "retencion"), "seguros": ("civil", "todo_riesgo", "franquicia")}
_SCANNED = {"plazo_ejecucion": "duration", "valor_estimado": "money", "presupuesto": "money", "plazo_garantia": "duration"}


def _once(rows: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    """`rows` with columns that are worked out once: an outer generator keeps Catalyst from folding them into what uses them."""
    return rows.select(*keep, F.inline_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


#: For each anchor, a literal without which it can't match, in small letters; a text that lacks it isn't matched at all. Anchors that begin with theirs are read from its first place on.
NEEDED = {
    "procedimiento": "procedimiento", "tipo_administrativo": "contrato", "tipo_calificacion": "calificaci", "tipo_contrato": "contrato", "tramitacion": "tramitaci", "tramitacion_prosa": "tramitaci", "plazo_ejecucion": "plazo", "plazo_duracion": "duraci",
    "valor_estimado": "total", "base_imponible": "total", "iva": "importe", "total": "importe", "provisional": "provisional", "definitiva": "definitiva", "definitiva_prosa": "garant", "seguros": "lizas", "plazo_garantia": "plazo", "electronica": "electr",
    "objeto": "objeto", "objeto_titulo": "objeto", "organo": "rgano", "economica": "volumen", "tecnica": "70", "clasificacion": "grupo",
}
_FROM_THERE = frozenset(("procedimiento", "tipo_administrativo", "tipo_calificacion", "tipo_contrato", "tramitacion_prosa", "plazo_ejecucion", "plazo_duracion", "valor_estimado", "base_imponible", "iva", "total", "definitiva_prosa", "economica", "tecnica", "clasificacion"))


def small(text: Column) -> Column:
    """A text of the same length in small letters, with those beyond ASCII that case folding takes for an ASCII letter made that letter."""
    return F.lower(F.translate(text, "İıſ\u212a", "iisk"))


def _literal(label: str) -> str:
    """What a label begins with, up to its first class."""
    return label.split("[")[0]


def fields(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, field, value, reference, confidence): a row for each field that a rule finds. Each pattern is read once for each text that holds its literal, and generic readings only where the exact one found nothing."""
    t = F.col(text)
    at = {literal: f"_at_{k}" for k, literal in enumerate(sorted({*NEEDED.values(), *(_literal(w) for label in _SCANNED for w in LABELS[label])}))}
    rows = _once(documents, {"_low": small(t)}, "doc_id", text)
    rows = _once(rows, {name: F.instr(F.col("_low"), F.lit(literal)) for literal, name in at.items()}, "doc_id", text)

    def read(name: str, get: Callable[[Column], Column]) -> Column:
        place = F.col(at[NEEDED[name]])
        return F.when(place > 0, get(F.substring(t, place, F.length(t)) if name in _FROM_THERE else t))

    def raw(name: str, g: int = 1, pattern: str | None = None) -> Column:
        return read(name, lambda c: F.regexp_extract(c, pattern or java(ANCHORS[name]), g))

    def context(label: str, kind: str) -> Column:
        return F.coalesce(*(F.when(F.col(at[_literal(w)]) > 0, _context(F.substring(t, F.col(at[_literal(w)]), F.length(t)), w, kind)) for w in LABELS[label]))

    got = lambda c: F.nullif(squeezed(c), F.lit(""))
    without = lambda name, c: F.when(got(F.col(name)).isNull(), c)
    first = ("organo", "objeto", "procedimiento", "tipo_administrativo", "tramitacion", "plazo_ejecucion", "valor_estimado", "base_imponible", "total", "iva", "provisional", "definitiva", "seguros", "plazo_garantia", "electronica", "economica", "tecnica")
    outer = {f"{name}_{g}": raw(name, g) for name in first for g in _GROUPS.get(name, (1,))}
    outer |= {f"clase_{g}": read("clasificacion", lambda c, g=g: F.regexp_extract_all(c, F.lit(java(ANCHORS["clasificacion"])), F.lit(g))) for g in (1, 2, 3)}
    rows = _once(rows, outer, "doc_id", text, *at.values())
    inner = {f"{name}_1": F.regexp_extract(f"{block}_0", java(ANCHORS[name]), 1) for block, names in _INNER.items() for name in names}
    inner |= {"tipo_calificacion_1": without("tipo_administrativo_1", raw("tipo_calificacion")), "tipo_contrato_1": without("tipo_administrativo_1", raw("tipo_contrato")), "tramitacion_prosa_1": without("tramitacion_1", raw("tramitacion_prosa")), "plazo_duracion_1": without("plazo_ejecucion_1", raw("plazo_duracion"))}
    inner |= {"objeto_titulo_1": without("objeto_1", raw("objeto_titulo", 1, java(OBJECT_HEADING, case=True))), "definitiva_prosa_0": without("definitiva_0", raw("definitiva_prosa", 0))}
    exact = {"plazo_ejecucion": "plazo_ejecucion_1", "valor_estimado": "valor_estimado_1", "presupuesto": "total_1", "plazo_garantia": "plazo_garantia_2"}
    inner |= {f"label_{label}": without(exact[label], context(label, kind)) for label, kind in _SCANNED.items()}
    rows = _once(rows, inner, "doc_id", *outer)
    clean = {name: got(F.col(name)) for name in (*outer, *inner) if not name.startswith(("clase_", "label_", "definitiva_prosa_"))} | {f"clase_{g}": F.col(f"clase_{g}") for g in (1, 2, 3)}
    clean |= {f"definitiva_prosa_{g}": F.nullif("definitiva_prosa_0", F.lit("")) if g == 0 else taken(F.col("definitiva_prosa_0"), ANCHORS["definitiva_prosa"], g) for g in _GROUPS["definitiva_prosa"]}
    clean |= {f"scan_{label}": _shown(F.col(f"label_{label}"), kind) for label, kind in _SCANNED.items()}
    rows = _once(rows, clean, "doc_id")

    a = lambda name, group=1: F.col(f"{name}_{group}")
    amount = lambda name: F.concat(a(name), F.lit(" €"))
    scan = lambda label: F.col(f"scan_{label}")
    told = lambda name: F.when(a(name).isNotNull(), _yes(a(name)))
    parts = _joined(F.concat(F.lit("Procede: "), told("procede")), F.concat(F.lit("Importe: "), a("importe")), F.concat(F.lit("Retención en el precio: "), told("retencion")))
    basis = F.regexp_replace(F.regexp_replace(F.coalesce(a("definitiva_prosa", 3), F.lit("")), r" \d{1,3}$", ""), r"\.$", "")
    loose = F.when(~a("definitiva_prosa", 0).rlike(java(ANCHORS["definitiva_guarda"])), F.rtrim(F.concat(a("definitiva_prosa", 2), F.lit("% "), basis)))
    policies = _joined(F.concat(F.lit("RC Construcción: "), a("civil"), F.lit(" € por siniestro y año")), F.concat(F.lit("TR Construcción: "), a("todo_riesgo"), F.lit(" €")), F.concat(F.lit("Franquicia admisible: "), told("franquicia")))
    zipped = F.arrays_zip(*(F.col(f"clase_{g}").alias(n) for g, n in zip((1, 2, 3), "gsc", strict=True)))
    classes = F.transform(zipped, lambda x: F.concat(F.lit("Grupo "), x["g"], F.lit(", Subgrupo "), x["s"], F.lit(", Categoría "), x["c"]))
    made = {"procedure": title_cased(a("procedimiento")), "kind": title_cased(F.coalesce(a("tipo_administrativo"), a("tipo_calificacion"), a("tipo_contrato"))), "course": title_cased(a("tramitacion")), "course_told": title_cased(a("tramitacion_prosa")), "parts": parts, "loose": loose, "policies": policies, "classes": F.array_join(F.array_distinct(classes), " + ")}
    rows = _once(rows, made, "doc_id", *clean)
    found = {
        "organo_contratacion": _field(a("organo"), "Anexo I apdo. 2"),
        "objeto_contrato": F.coalesce(_field(a("objeto"), "Anexo I apdo. 4"), _field(a("objeto_titulo"), "Pliego (objeto del contrato)", False)),
        "procedimiento": _field(F.col("procedure"), "Anexo I apdo. 1"),
        "tipo_contrato": _field(F.col("kind"), "Anexo I apdo. 1"),
        "tramitacion": F.coalesce(_field(F.col("course"), "Anexo I apdo. 3"), _field(F.col("course_told"), "Pliego (tramitación)", False)),
        "plazo_ejecucion": F.coalesce(_field(F.upper(F.coalesce(a("plazo_ejecucion"), a("plazo_duracion"))), "Anexo I apdo. 8"), _field(scan("plazo_ejecucion"), "Pliego (plazo de ejecución)", False)),
        "valor_estimado_contrato": F.coalesce(_field(amount("valor_estimado"), "Anexo I apdo. 10 (Valor estimado)"), _field(scan("valor_estimado"), "Pliego (valor estimado)", False)),
        "presupuesto_base_sin_iva": _field(amount("base_imponible"), "Anexo I apdo. 10 (Base imponible)"),
        "presupuesto_base_con_iva": F.coalesce(_field(amount("total"), "Anexo I apdo. 10 (TOTAL con IVA)"), _field(scan("presupuesto"), "Pliego (presupuesto base de licitación)", False)),
        "iva": _field(F.concat(a("iva"), F.lit("% ("), a("iva", 2), F.lit(" €)")), "Anexo I apdo. 10 (IVA)"),
        "garantia_provisional": _field(F.when(told("provisional") == "NO", "No procede").when(told("provisional") == "SI", "Procede: SI"), "Anexo I apdo. 20"),
        "garantia_definitiva": F.when(a("definitiva", 0).isNotNull(), _field(F.col("parts"), "Anexo I apdo. 22")).otherwise(_field(F.col("loose"), "Pliego (garantía definitiva)", False)),
        "seguros_obligatorios": _field(F.col("policies"), "Anexo I apdo. 24"),
        "plazo_garantia": F.coalesce(_field(F.upper(a("plazo_garantia", 2)), F.coalesce(F.concat(F.lit("Anexo I apdo. "), a("plazo_garantia")), F.lit("Anexo I (plazo de garantía)"))), _field(scan("plazo_garantia"), "Pliego (plazo de garantía)", False)),
        "presentacion_electronica": _field(a("electronica"), "Anexo I apdo. 33"),
        "solvencia_economica": _field(F.concat(F.lit("Volumen anual de negocios ≥ "), a("economica"), F.lit(" €")), "Anexo I apdo. 14"),
        "solvencia_tecnica": _field(F.concat(F.lit("Importe anual acumulado en obras del mismo tipo ≥ "), a("tecnica"), F.lit(" € (10 últimos años)")), "Anexo I apdo. 14"),
        "clasificacion_empresarial": _field(F.nullif(F.col("classes"), F.lit("")), "Anexo I apdo. 14"),
    }
    each = F.array(*(F.struct(F.lit(field).alias("field"), value.alias("r")) for field, value in found.items()))
    return rows.select("doc_id", F.inline_outer(each)).filter("r is not null").select("doc_id", "field", "r.*")


# What an obligation is about, and the clause that usually holds it.
HINTS = (
    (r"responsabilidad.*(?:da[ñn]os|perjuicios)|da[ñn]os y perjuicios", 24), (r"subcontrataci[oó]n", 28), (r"revisi[oó]n de precios", 30), (r"obligaciones,?\s+gastos|gastos,?\s+impuestos|por cuenta del (?:contratista|adjudicatario)", 31),
    (r"(?:obligaciones )?laboral|social|seguridad social|convenio colectivo|transparencia", 32), (r"plazo de garant[ií]a|per[ií]odo de garant[ií]a", 37), (r"seguro|p[oó]liza|responsabilidad civil|todo riesgo", 16),
)


def hinted_clause(text: Column) -> Column:
    """The clause that usually holds what a text is about: the first hint that fits."""
    first, *rest = HINTS
    out = F.when(text.rlike(java(first[0])), first[1])
    for pattern, clause in rest:
        out = out.when(text.rlike(java(pattern)), clause)
    return out


def clause_reference(number: Column) -> Column:
    return F.concat(F.lit("Cláusula "), number.cast("string"))


def item_reference(number: Column) -> Column:
    return F.concat(F.lit("Anexo I apdo. "), number.cast("string"))
