"""Queries over segments, annexes, selection of input and extraction rules, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.operators import extraction as E
from lindero.operators import segments as S
from lindero.operators.passages import unfolded
from lindero.plans.carriers import CARRIER_SQL, carrier
from lindero.plans.registry import query
from lindero.plans.values import norm, squeeze
from lindero.session import table


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def spots_sql(rows: str, pattern: str, keep: str = "doc_id, text", front: str = " ") -> str:
    """Rows of `rows` with k, m and start_pos of each match of a pattern (an SQL expression) that begins with one sign of `front` where the original may begin the text."""
    lead = f"concat({quoted(front) if front != chr(10) else 'chr(10)'}, text)" if front else "text"
    return f"""select * exclude (ms, gs), ms[k] as m, greatest(list_sum(list_transform(gs[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k-1], lambda x: length(x))), 0) - {len(front)}, 0)::bigint as start_pos,
      (list_sum(list_transform(gs[:k], lambda x: length(x))) + list_sum(list_transform(ms[:k], lambda x: length(x))) - {len(front)})::bigint as stop_pos
      from (select *, unnest(range(1, len(ms) + 1)) as k from (select {keep}, regexp_extract_all({lead}, {pattern}) as ms, string_split_regex({lead}, {pattern}) as gs from ({rows}))) """


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_DOCUMENTS = "select doc_id, text from documents"


# --- segments --------------------------------------------------------------------------------


def _family_sql(rows: str, family: str) -> str:
    pattern, case = S.FAMILIES[family]
    plain = ("" if case else "(?i)") + pattern.replace(r"(?:^|[\s.])", r"[\s.]")
    marker = f"regexp_extract(m, {quoted(plain)}, 1)"
    return f"""select doc_id, text, {'upper(' + marker + ')' if family == 'annex' else marker} as marker, {squeeze(f'regexp_extract(m, {quoted(plain)}, 2)')} as title, start_pos, stop_pos as body_start,
      coalesce(lead(start_pos) over (partition by doc_id order by k), length(text)) as end_pos, k from ({spots_sql(rows, quoted(plain))})"""


def _segments_sql(rows: str) -> str:
    return f"""with n as ({_family_sql(rows, 'numbered')}), l as ({_family_sql(rows, 'lettered')}), c as (select doc_id, count(*) filter (where f = 'n') as n, count(*) filter (where f = 'l') as l from (select doc_id, 'n' as f from n union all select doc_id, 'l' from l) group by doc_id)
      select 'clause' as kind, * from ({_family_sql(rows, 'clause')}) union all select 'annex', * from ({_family_sql(rows, 'annex')}) union all select 'item', n.* from n join c using (doc_id) where c.n >= c.l union all select 'item', l.* from l join c using (doc_id) where c.n < c.l"""


@query(f"select doc_id, kind, marker, title, start_pos, body_start, end_pos from ({_segments_sql(_DOCUMENTS)})")
def segment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses, annexes and items of the box of each document, each closed by its next sibling; numbered items prevail over lettered ones if there are as many."""
    rows = S.with_segments(_documents(spark, sf_dir))
    named = [F.transform(F.col(kind), _of_kind(kind)) for kind in ("clause", "annex", "item")]
    return unfolded(rows.select("doc_id", F.concat(*named).alias("found")), "found", "kind")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["marker"].alias("marker"), s["title"].alias("title"), s["start"].alias("start_pos"), s["body_start"].alias("body_start"), s["end"].alias("end_pos"))


_TITLES = r"plazo|termini|term\b|\bA presupuesto"
_BODY = squeeze("substring(text, (body_start + 1)::bigint, (least(end_pos, body_start + 400) - body_start)::bigint)")


@query(f"""select doc_id, kind, {_BODY} as body from (select *, row_number() over (partition by doc_id, kind order by start_pos) as k1 from ({_segments_sql(_DOCUMENTS)}) where regexp_matches(title, '(?i){_TITLES}') or regexp_matches(marker || ' ' || title, '(?i){_TITLES}')) where k1 = 1""")
def segment_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of the first clause and of the first item whose title names a term: at most 400 characters."""
    bodies = [F.struct(F.lit(kind).alias("kind"), S.segment_body(F.col("text"), F.col(kind), _TITLES).alias("body")) for kind in ("clause", "annex", "item")]
    return unfolded(S.with_segments(_documents(spark, sf_dir)), F.array(*bodies), "body")


_ITEM_SQL = S.ITEM.replace(r"(?:^|\n)", r"\n").replace("(?=[A-ZÁÉÍÓÚÜÑ])", "[A-ZÁÉÍÓÚÜÑ]")
_TRIM = lambda c: f"regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"
_BLOCK = f"""select doc_id, case when strpos(tail, e) > 0 and e <> '' then substring(tail, 1, strpos(tail, e) - 1) else tail end as text from (select doc_id, tail, regexp_extract(tail, '(?i){S.ANNEX_END}') as e from (
  select doc_id, substring(concat(chr(10), text), strpos(concat(chr(10), text), h) + length(h)) as tail from (select doc_id, text, regexp_extract(concat(chr(10), text), '(?i)\\n\\s*ANEXO\\s+I\\b[^\\n]*\\n') as h from ({{rows}})) where h <> ''))"""


def _annex_sql(rows: str) -> str:
    spots = spots_sql(_BLOCK.format(rows=rows), quoted(_ITEM_SQL), front=chr(10))
    return f"""select doc_id, number, {_TRIM("regexp_extract(body, '^([^\\n.]{0,200})', 1)")} as title, body from (select *, row_number() over (partition by doc_id, number order by k desc) as nth from (
      select doc_id, k, regexp_extract(m, '(\\d[\\d.a-z]*)[.)\\-]', 1) as number, {_TRIM('substring(text, stop_pos, coalesce(lead(start_pos) over (partition by doc_id order by k), length(text)) - stop_pos + 1)')} as body, count(*) over (partition by doc_id) as n from ({spots})) where n >= {S.LEAST_ITEMS}) where nth = 1"""


@query(_annex_sql(CARRIER_SQL))
def annex_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the first annex; of a repeated number the last stays, and fewer than eight boundaries are no annex."""
    return unfolded(S.with_annex(carrier(spark, sf_dir)), "items", "number")


_FIELD_ITEM = "(values " + ", ".join(f"('{f}', '{n}')" for f, n in S.FIELD_ITEM.items()) + ") d(field, number)"


@query(f"select doc_id, field, number, body from ({_annex_sql(CARRIER_SQL)}) join {_FIELD_ITEM} using (number) where body <> '' union all select doc_id, 'garantias', '21|20', coalesce(max(body) filter (where number = '21' and body <> ''), max(body) filter (where number = '20' and body <> '')) from ({_annex_sql(CARRIER_SQL)}) group by doc_id")
def annex_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field with the body of its item, by a dimension of the session's size; and the first of two candidate numbers that isn't empty."""
    items = S.with_annex(carrier(spark, sf_dir)).select("doc_id", "items")
    named = spark.createDataFrame(list(S.FIELD_ITEM.items()), "field string, number string")
    by_field = unfolded(items, "items", "number").filter("body != ''").join(F.broadcast(named), "number").select("doc_id", "field", "number", "body")
    either = F.array(F.struct(F.lit("garantias").alias("field"), F.lit("21|20").alias("number"), S.item_body(F.col("items"), "21", "20").alias("body")))
    return by_field.unionByName(unfolded(items, either, "body"))


# --- selection -------------------------------------------------------------------------------

_LONG = f"select doc_id, concat(repeat('Cláusula de relleno. ', 900), chr(10), text, chr(10), repeat('Fin del anexo. ', 700)) as text from ({CARRIER_SQL})"
_FOCUS = f"""select doc_id, case when h = '' then text when length(focus) >= 8000 and length(focus) < length(text) * 0.8 then focus else text end as text from (select *, concat(substring(text, 1, least(12000, s)), chr(10), chr(10), '[…]', chr(10), chr(10), substring(text, s + 1, case when e <> '' then strpos(substring(text, s + 11), e) + 9 else 120000 end)) as focus from (
  select *, regexp_extract(substring(text, s + 11), '\\n\\s*ANEXO\\s+(?:II|III|IV|V|VI|VII|VIII|IX|X)\\b') as e from (select *, length(text) - length(string_split_regex(text, '\\n\\s*ANEXO\\s+I\\b')[-1]) - length(h) as s from (select doc_id, text, coalesce(regexp_extract_all(text, '\\n\\s*ANEXO\\s+I\\b')[-1], '') as h from ({_LONG})))))"""


@query(f"select doc_id, length(text) as chars, md5(text) as digest from ({_FOCUS})")
def head_and_annex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each text and its last first annex."""
    text = F.concat(F.repeat(F.lit("Cláusula de relleno. "), 900), F.lit("\n"), F.col("text"), F.lit("\n"), F.repeat(F.lit("Fin del anexo. "), 700))
    chosen = S.with_head_and_annex(carrier(spark, sf_dir).select("doc_id", text.alias("text")))
    return chosen.select("doc_id", F.length("chosen").cast("long").alias("chars"), F.md5("chosen").alias("digest"))


_CUES = "(values " + ", ".join(f"('{field}', {n}, {quoted('(?i)' + p)})" for field, patterns in S.CUES.items() for n, p in enumerate(patterns, 1)) + ") c(field, cue_no, pattern)"
_HITS = spots_sql(f"select doc_id, text, field, cue_no, pattern from documents cross join {_CUES}", "pattern", "doc_id, text, field, cue_no", front="")


@query(f"select doc_id, field, cue_no, k::integer as hit_no, start_pos, stop_pos as end_pos from ({_HITS}) where k <= 3")
def passage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hits of each cue of the 22 fields in each text."""
    hits = unfolded(_documents(spark, sf_dir).select("doc_id", S.small(F.col("text")).alias("low")), S.cue_spots(F.col("low")), "field")
    return hits.select("doc_id", "field", "cue_no", "hit_no", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


_SPANS = f"select distinct doc_id, text, greatest(0, start_pos - 1500) as s, least(length(text), stop_pos + 1500) as e from ({_HITS}) where k <= 3"
_MERGED = f"""select doc_id, any_value(text) as text, min(s) as start_pos, max(e) as end_pos from (select *, sum(new) over (partition by doc_id order by s, e rows unbounded preceding) as island from (
  select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from ({_SPANS}))) group by doc_id, island"""


@query(f"select doc_id, start_pos, end_pos from ({_MERGED})")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows around all hits, those that overlap or touch made one."""
    merged = unfolded(S.with_islands(_documents(spark, sf_dir)), "spans", "start")
    return merged.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def _passages_sql(cap: int) -> str:
    """Pieces in order by a recursive fold: the one that crosses the cap is cut, later ones are left out."""
    gap = "concat(chr(10), chr(10), '[…]', chr(10), chr(10))"
    return f"""with recursive p as (select doc_id, row_number() over (partition by doc_id order by start_pos) as k, substring(text, (start_pos + 1)::bigint, (end_pos - start_pos)::bigint) as piece from ({_MERGED})),
      f(doc_id, k, out, full_) as (select distinct doc_id, 0::bigint, '', false from p union all
        select f.doc_id, p.k, case when length(out) + length(piece) + 9 > {cap} then concat(out, {gap}, substring(piece, 1, greatest(0, {cap} - length(out) - 9))) else concat(out, case when out <> '' then {gap} else '' end, piece) end, length(out) + length(piece) + 9 > {cap} from f join p on p.doc_id = f.doc_id and p.k = f.k + 1 where not full_)
      select d.doc_id, coalesce(out, substring(d.text, 1, {cap})) as text from documents d left join (select doc_id, arg_max(out, k) as out from f group by doc_id) using (doc_id)"""


@query(f"select doc_id, length(text) as chars, md5(text) as digest from ({_passages_sql(2500)})")
def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged passages of each text joined in order up to 2,500 characters; a text without any cue gives its start."""
    chosen = S.with_islands(_documents(spark, sf_dir)).select("doc_id", S.passages(F.col("text"), F.col("spans"), 2500).alias("text"))
    return chosen.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(f"select doc_id, 'passage' as rule, length(text) as chars, md5(text) as digest from ({_passages_sql(S.CONTROL_CAP)}) union all select doc_id, 'fulltext', length(substring(text, 1, 900000)), md5(substring(text, 1, 900000)) from documents union all select doc_id, 'head_annex', length(substring(text, 1, 120000)), md5(substring(text, 1, 120000)) from documents where not regexp_matches(text, '(?:^|\\n)\\s*ANEXO\\s+I\\b')")
def selected_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule selects of each text; documents with a first annex are left to head_and_annex for the rule of that name."""
    documents = _documents(spark, sf_dir)
    annexed = F.col("text").rlike(E.java(r"(?:^|\n)\s*ANEXO\s+I\b", case=True))
    parts = [S.selected(documents if rule != "head_annex" else documents.filter(~annexed), rule).select("doc_id", F.lit(rule).alias("rule"), F.length("chosen").cast("long").alias("chars"), F.md5("chosen").alias("digest")) for rule in ("passage", "fulltext", "head_annex")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- extraction ------------------------------------------------------------------------------


def _got(pattern: str, group: int = 1, flags: str = "(?i)", of: str = "text") -> str:
    return f"nullif({squeeze(f'regexp_extract({of}, {quoted(flags + pattern)}, {group})')}, '')"


def _title(c: str) -> str:
    """Words in capitals that hold letters only, so splitting at blanks is the same as taking runs of letters."""
    return f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: case when length(w) <= 3 then upper(w) else concat(upper(w[1]), w[2:]) end), ' ')"


def _labelled_sql(labels: tuple[str, ...], kind: str, rows: str) -> str:
    """(doc_id, value): contexts of each label by position, the first good one of the first label that has one."""
    value, unit = E.VALUES[kind], E.UNITS[kind]
    pattern = rf"(?is)^(.*?)({value})\s*({unit})"
    parts = " union all ".join(f"select doc_id, {n} as label_no, k, substring(text, stop_pos + 1, 100) as c from ({spots_sql(rows, quoted('(?i)' + label), front='')})" for n, label in enumerate(labels))
    shown = {"money": "concat(v, ' €')", "duration": "concat(v, ' ', upper(u))", "percent": "concat(v, '%')"}[kind]
    return f"""select doc_id, arg_min({shown}, (label_no, k)) as value from (select doc_id, label_no, k, regexp_extract(c, {quoted(pattern)}, 1) as gap, regexp_extract(c, {quoted(pattern)}, 2) as v, regexp_extract(c, {quoted(pattern)}, 3) as u from ({parts}))
      where v <> '' and length(gap) <= {E.MAX_GAP} and not regexp_matches(gap, {quoted('(?i)' + E.GUARD)}) group by doc_id"""


_A = E.ANCHORS
_YES = lambda c: f"case when {c} is null then null when upper({c}) in ('SI', 'SÍ') then 'SI' else 'NO' end"
_DEF = f"nullif(regexp_extract(text, {quoted('(?i)' + _A['definitiva'].replace('(?=', '(?:'))}), '')"
_SEG = f"nullif(regexp_extract(text, {quoted('(?i)' + _A['seguros'].replace('{0,2000}?', '*?').replace('(?=', '(?:'))}), '')"
_LOOSE = [f"regexp_extract(text, {quoted('(?i)' + _A['definitiva_prosa'])}, {g})" for g in range(4)]
_LOOSE_VALUE = f"""case when {_LOOSE[0]} <> '' and not regexp_matches({_LOOSE[0]}, {quoted('(?i)' + _A['definitiva_guarda'])}) then rtrim(concat({_LOOSE[2]}, '% ', regexp_replace(regexp_replace({squeeze(_LOOSE[3])}, ' \\d{{1,3}}$', ''), '\\.$', ''))) end"""
_CLASSES = f"list_transform(list_zip({', '.join(f'regexp_extract_all(text, {quoted("(?i)" + _A["clasificacion"])}, {g})' for g in (1, 2, 3))}), lambda x: concat('Grupo ', x[1], ', Subgrupo ', x[2], ', Categoría ', x[3]))"
_JOIN = lambda *parts: f"nullif(concat_ws('; ', {', '.join(parts)}), '')"
#: field: branches of (value, reference, confidence); a name in capitals is a table of labelled values.
_RULES_SQL = {
    "organo_contratacion": [(_got(_A["organo"]), "'Anexo I apdo. 2'", "alta")],
    "objeto_contrato": [(_got(_A["objeto"]), "'Anexo I apdo. 4'", "alta"), (_got(E.OBJECT_HEADING, flags=""), "'Pliego (objeto del contrato)'", "media")],
    "procedimiento": [(_title(_got(_A["procedimiento"])), "'Anexo I apdo. 1'", "alta")],
    "tipo_contrato": [(_title(f"coalesce({_got(_A['tipo_administrativo'])}, {_got(_A['tipo_calificacion'])}, {_got(_A['tipo_contrato'].replace('(?=', '(?:'))})"), "'Anexo I apdo. 1'", "alta")],
    "tramitacion": [(_title(_got(_A["tramitacion"])), "'Anexo I apdo. 3'", "alta"), (_title(_got(_A["tramitacion_prosa"])), "'Pliego (tramitación)'", "media")],
    "plazo_ejecucion": [(f"upper(coalesce({_got(_A['plazo_ejecucion'])}, {_got(_A['plazo_duracion'])}))", "'Anexo I apdo. 8'", "alta"), ("PLAZO", "'Pliego (plazo de ejecución)'", "media")],
    "valor_estimado_contrato": [(f"{_got(_A['valor_estimado'])} || ' €'", "'Anexo I apdo. 10 (Valor estimado)'", "alta"), ("VALOR", "'Pliego (valor estimado)'", "media")],
    "presupuesto_base_sin_iva": [(f"{_got(_A['base_imponible'])} || ' €'", "'Anexo I apdo. 10 (Base imponible)'", "alta")],
    "presupuesto_base_con_iva": [(f"{_got(_A['total'])} || ' €'", "'Anexo I apdo. 10 (TOTAL con IVA)'", "alta"), ("PRESUPUESTO", "'Pliego (presupuesto base de licitación)'", "media")],
    "iva": [(f"{_got(_A['iva'])} || '% (' || {_got(_A['iva'], 2)} || ' €)'", "'Anexo I apdo. 10 (IVA)'", "alta")],
    "garantia_provisional": [(f"case {_YES(_got(_A['provisional']))} when 'NO' then 'No procede' when 'SI' then 'Procede: SI' end", "'Anexo I apdo. 20'", "alta")],
    "garantia_definitiva": [(_JOIN(f"'Procede: ' || {_YES(_got(_A['procede'], of=_DEF))}", f"'Importe: ' || {_got(_A['importe'], of=_DEF)}", f"'Retención en el precio: ' || {_YES(_got(_A['retencion'], of=_DEF))}"), "'Anexo I apdo. 22'", "alta"), (f"case when {_DEF} is null then {_LOOSE_VALUE} end", "'Pliego (garantía definitiva)'", "media")],
    "seguros_obligatorios": [(_JOIN(f"'RC Construcción: ' || {_got(_A['civil'], of=_SEG)} || ' € por siniestro y año'", f"'TR Construcción: ' || {_got(_A['todo_riesgo'], of=_SEG)} || ' €'", f"'Franquicia admisible: ' || {_YES(_got(_A['franquicia'], of=_SEG))}"), "'Anexo I apdo. 24'", "alta")],
    "plazo_garantia": [(f"upper({_got(_A['plazo_garantia'], 2)})", f"coalesce('Anexo I apdo. ' || {_got(_A['plazo_garantia'])}, 'Anexo I (plazo de garantía)')", "alta"), ("GARANTIA", "'Pliego (plazo de garantía)'", "media")],
    "presentacion_electronica": [(_got(_A["electronica"]), "'Anexo I apdo. 33'", "alta")],
    "solvencia_economica": [(f"'Volumen anual de negocios ≥ ' || {_got(_A['economica'])} || ' €'", "'Anexo I apdo. 14'", "alta")],
    "solvencia_tecnica": [(f"'Importe anual acumulado en obras del mismo tipo ≥ ' || {_got(_A['tecnica'])} || ' € (10 últimos años)'", "'Anexo I apdo. 14'", "alta")],
    "clasificacion_empresarial": [(f"nullif(array_to_string(list_filter({_CLASSES}, lambda x, i: list_position({_CLASSES}, x) = i), ' + '), '')", "'Anexo I apdo. 14'", "alta")],
}


def _fields_sql(rows: str) -> str:
    tables = {name: _labelled_sql(E.LABELS[label], kind, "select doc_id, text from c") for name, label, kind in (("PLAZO", "plazo_ejecucion", "duration"), ("VALOR", "valor_estimado", "money"), ("PRESUPUESTO", "presupuesto", "money"), ("GARANTIA", "plazo_garantia", "duration"))}
    parts = [
        f"select doc_id, '{field}' as field, {n} as nth, {'value' if value in tables else value} as value, {place} as reference, '{sure}' as confidence from {f'({tables[value]}) join c using (doc_id)' if value in tables else 'c'}"
        for field, branches in _RULES_SQL.items()
        for n, (value, place, sure) in enumerate(branches)
    ]
    return f"with c as ({rows}) select doc_id, field, arg_min(value, nth) as value, arg_min(reference, nth) as reference, arg_min(confidence, nth) as confidence from ({' union all '.join(parts)}) where value is not null group by doc_id, field"


@query(_fields_sql(CARRIER_SQL))
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 18 fields of texts in the layouts that the rules are for, with place and confidence; one scan."""
    return E.fields(carrier(spark, sf_dir))


@query(_fields_sql("select doc_id, text from documents where text is not null"))
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over the documents."""
    return E.fields(_documents(spark, sf_dir))


_SCANNED = {"value": ("valor_estimado", "money"), "budget": ("presupuesto", "money"), "plazo_ejecucion": ("plazo_ejecucion", "duration"), "plazo_garantia": ("plazo_garantia", "duration"), "garantia_definitiva": ("garantia_definitiva", "percent")}


@query(f"select d.doc_id, {', '.join(f't_{name}.value as {name}' for name in _SCANNED)} from documents d " + " ".join(f"left join ({_labelled_sql(E.LABELS[label], kind, _DOCUMENTS)}) t_{name} on t_{name}.doc_id = d.doc_id" for name, (label, kind) in _SCANNED.items()))
def label_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind the labels of amounts, terms and the guarantee's percentage; the labels are a dimension."""
    return _documents(spark, sf_dir).select("doc_id", *(E.labelled(F.col("text"), E.LABELS[label], kind).alias(name) for name, (label, kind) in _SCANNED.items()))


_HINTS_SQL = "case " + " ".join(f"when regexp_matches(heading, '(?i){p}') then {n}" for p, n in E.HINTS) + " end"


@query(f"select section_id, {_HINTS_SQL} as clause, 'Cláusula ' || {_HINTS_SQL} as reference, 'Anexo I apdo. ' || section_key as item_reference from document_sections where heading is not null")
def clause_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause that usually holds what a section's heading is about, and both forms of reference."""
    clause = E.hinted_clause(F.col("heading"))
    return table(spark, sf_dir, "document_sections").filter("heading is not null").select("section_id", clause.alias("clause"), E.clause_reference(clause).alias("reference"), E.item_reference(F.col("section_key")).alias("item_reference"))
