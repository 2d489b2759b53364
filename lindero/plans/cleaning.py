"""Queries over cleaning, sanitising and classification, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.functions import text as X
from lindero.operators import extraction as E
from lindero.operators import passages as P
from lindero.operators.segments import CUES
from lindero.plans.carriers import CARRIER_SQL, carrier
from lindero.plans.registry import query
from lindero.plans.segments import quoted
from lindero.plans.values import LATEST, norm, squeeze, values
from lindero.session import table

# Boilerplate inside lines, in order; each becomes one blank, case is ignored.
INLINE = (
    r"Firmado por:\s*[^\n]*?Fecha:\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*Jefe de servicio\s+(?:contrataci[oó]n|gesti[oó]n)[^\n]{0,80}?(?=\s|$|Firmado))?", r"Cargo:\s*[^\n]*?Fecha:\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?",
    r"\bJefe de servicio\s+(?:contrataci[oó]n|gesti[oó]n[^\n]{0,40})", r"\bP[aá]gina:\s*\d+\s*de\s*\d+", r"\bC[oó]digo de verificaci[oó]n\s*:\s*[A-Za-z0-9-]+", r"\bC[oó]digo seguro de verificaci[oó]n\s*:?\s*[A-Za-z0-9-]*", r"https?:\/\/\S*licitacion\S*", r"https?:\/\/sede\S*",
    r"Este documento es Copia Aut[ée]ntica[^\n]{0,200}", r"Su autenticidad puede ser comprobada[^\n]{0,200}", r"Para la verificaci[oó]n del siguiente c[oó]digo[^\n]{0,200}", r"Firmado electr[óo]nicamente[^\n]{0,200}",
)
SENTINEL = {"es": "No especificado", "ca": "No especificat", "en": "Not specified"}
NO_REFERENCE = {"es": "No identificado", "ca": "No identificat", "en": "Not identified"}
NOT_MENTIONED = {"es": "No se menciona en el documento analizado", "ca": "No s'esmenta en el document analitzat", "en": "Not mentioned in the analysed document"}
BARE = r"^\d+(?:[.,]\d+)?$"
FORMALISING, TWENTY = r"formalizaci|formalisation|formalitzaci|escritura|notar|contract formalisation", r"\b20\s*(?:%|por\s+ciento)\b"
GUARANTEES, TEN = r"garant[ií]a|guarantee|garantia|complementaria|complementary|total", r"\b10\s*(?:%|por\s+ciento)\b"
UNTOLD = r"^(?:no\s+especific(?:ado|at)|not\s+specified|no\s+identificado|no\s+identificat|not\s+identified)$"
AMOUNT_HEADERS = (
    "amount or percentage", "amount / percentage", "amount", "cost or percentage", "cost / percentage", "cost", "importe o porcentaje", "importe / porcentaje", "importe", "importe estimado", "coste o porcentaje", "coste / porcentaje", "coste",
    "import o percentatge", "import / percentatge", "import", "cost o percentatge", "cost / percentatge",
)
AMOUNT_WORDS = (r"\b(?:amount|importe|import|coste|cost)\b", r"\b(?:percentage|porcentaje|percentatge|percent|por ciento)\b")
REFERENCE_HEADERS = ("reference", "ref", "clause", "referencia", "clausula")
CONTRACT_KIND = r"(?:Contrato\s+administrativo\s+de|CALIFICACI[ÓO]N\s*:?\s*[^\n]*?|CONTRATO\s+DE)\s+(OBRAS|SERVICIOS|SUMINISTROS|GESTI[ÓO]N\s+DE\s+SERVICIOS|CONCESI[ÓO]N\s+DE\s+(?:OBRAS|SERVICIOS)|MIXTO)"
CATALAN_TITLE = r"\bPLEC\s+DE\s+CL[ÀA]USULES\b|\bPLEC\s+DE\s+PRESCRIPCIONS\b"
CATALAN_WORDS = r"\b(?:amb|què|aquest|aquesta|dels|d'acord|qualsevol|s'ha)\b"
ENGLISH_TITLE = r"\b(?:tender specifications|terms and conditions|contract notice|the contractor shall)\b"
SAMPLE = 30_000


def sql_locale(names: dict[str, str], locale: str) -> str:
    return f"case {locale} " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in names.items()) + " end"


def _named(names: dict[str, str], locale: Column) -> Column:
    return F.when(locale == "en", names["en"]).when(locale == "ca", names["ca"]).otherwise(names["es"])


# --- pages -----------------------------------------------------------------------------------


#: For each pattern of INLINE, pieces of words without which it can't match, in small letters. A blank put for a match never makes a word, so the text as it comes tells.
_INLINE_WORDS = (("firmado", "fecha:"), ("cargo:", "fecha:"), ("jefe", "servicio"), ("gina:",), ("digo", "verificaci"), ("seguro", "verificaci"), ("http", "licitacion"), ("http", "//sede"), ("documento", "copia"), ("autenticidad", "comprobada"), ("siguiente", "verificaci"), ("firmado", "nicamente"))


def without_inline(text: Column) -> Column:
    """Boilerplate inside lines made one blank, pattern by pattern; patterns whose words the text lacks aren't read."""
    has = lambda low, words: reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words))
    # the sign behind a boundary is looked at first, as boundaries are slow to test
    seen = lambda pattern: rf"(?={pattern[2]}){pattern}" if pattern.startswith(r"\b") else pattern
    cut = lambda low, pattern, words: lambda c: F.when(has(low, words), F.regexp_replace(c, E.java(seen(pattern)), " ")).otherwise(c)
    each = lambda c: X.let(E.small(c), lambda low: reduce(lambda c, p: X.let(c, cut(low, *p)), zip(INLINE, _INLINE_WORDS, strict=True), c))
    return X.let(text, each)


def cleaned_page(text: Column, repair: bool = True) -> Column:
    """A page with its numbers repaired, without boilerplate inside lines and as whole lines."""
    return P.without_boilerplate(without_inline(X.repaired_numbers(text) if repair else text))


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (doc_id, file, text): each cleaned, then without the lines that repeat over the pages of their file."""
    clean = pages.select("doc_id", "file", cleaned_page(F.col("text")).alias("text"))
    # a repeated line stands on a good part of its file's pages, so these lists are short
    drop = P.repeated_lines(clean).groupBy("file").agg(F.collect_set("line").alias("drop"))
    rows = clean.join(drop, "file", "left").select("doc_id", "drop", F.inline_outer(F.array(F.struct(F.col("text"), F.split("text", "\n").alias("lines")))))
    rows = rows.select("doc_id", "text", "lines", F.when(F.col("drop").isNotNull(), F.filter("lines", lambda line: ~F.array_contains("drop", X.squeezed(line)))).alias("kept"))
    return rows.select("doc_id", F.when(F.col("kept").isNull() | (F.size("kept") == F.size("lines")), F.col("text")).otherwise(P.squeezed_ends(F.array_join("kept", "\n"))).alias("text"))


def assembled(pages: DataFrame, headings: bool = True) -> DataFrame:
    """(file, text) of pages (file, page_no, text) in order, joined by an empty line; with `headings`, blanks are collapsed and headings put on lines of their own."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n")
    whole = pages.groupBy("file").agg(ordered.alias("text"))
    if not headings:
        return whole
    t = F.regexp_replace("text", r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, rf"[ \t]+({P.SECTION_WORDS})(?=\s)", "\n$1")
    return whole.withColumn("text", P.squeezed_ends(F.regexp_replace(t, r"\n{3,}", "\n\n")))


_PAGE = "concat('Firmado por: ANA RUIZ Cargo: TÉCNICA Fecha: 01-02-2024 10:11:12 Jefe de servicio contratación ', chr(10), 'Cláusula ', cast(l_linenumber as string), ' Importe 40 .000,00 €  y 8 0.000,00 euros ', cast(l_quantity as int), chr(10), 'Código de verificación: AB-', cast(l_partkey as string), chr(10), 'https://sede.example/x/', cast(l_suppkey as string), ' resto   ANEXO II', chr(10), 'Página: ', cast(l_linenumber as string), ' de 9', chr(10), 'Sede electrónica de la entidad', chr(10), chr(10), chr(10), 'fin')"
_PAGES_SQL = f"select l_orderkey * 10 + l_linenumber as doc_id, cast(l_orderkey as string) as file, l_linenumber as page_no, {_PAGE} as text from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity from lineitem group by all)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with signatures, codes, broken numbers and repeated lines; an order is a file."""
    # keys are small beside the pages made of them, so they aren't drawn together into few tasks
    dealt = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey", "l_linenumber")
    rows = dealt.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("page_no"), F.expr(_PAGE).alias("text"))


def _inline_sql(c: str) -> str:
    for pattern in INLINE:
        # what a lookahead only looks at is put back
        c = f"regexp_replace({c}, {quoted('(?i)' + pattern.replace('(?=', '('))}, '{" " + chr(92) + "1" if "(?=" in pattern else " "}', 'g')"
    return c


def _repaired_sql(c: str, rounds: int = 4) -> str:
    for _ in range(rounds):
        c = f"regexp_replace({c}, '(\\d)[ \\x{{00A0}}\\t]+([.,])', '\\1\\2', 'g')"
        c = f"regexp_replace({c}, '([.,])[ \\x{{00A0}}\\t]+(\\d)', '\\1\\2', 'g')"
        c = f"regexp_replace({c}, '(\\d)[ \\x{{00A0}}\\t]+(\\d{{1,3}}[.,]\\d)', '\\1\\2', 'g')"
    return c


_LINES = "(?i)(?:" + "|".join(P.BOILERPLATE_LINES) + ")"


def _lines_sql(c: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda l: {squeeze('l')}), lambda l: l <> '' and not regexp_matches(l, {quoted(_LINES)})), chr(10))"


@query(f"select doc_id, {_inline_sql('text')} as text from ({_PAGES_SQL})")
def inline_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", without_inline(F.col("text")).alias("text"))


@query(f"select doc_id, {_inline_sql('text')} as text from documents")
def inline_boilerplate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", without_inline(F.col("text")).alias("text"))


@query(f"select doc_id, {_lines_sql(_inline_sql(_repaired_sql('text')))} as text, {_lines_sql(_inline_sql('text'))} as unrepaired from ({_PAGES_SQL})")
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cleaned with and without the repair of numbers."""
    return _pages(spark, sf_dir).select("doc_id", cleaned_page(F.col("text")).alias("text"), cleaned_page(F.col("text"), False).alias("unrepaired"))


_CLEAN = f"select doc_id, file, {_lines_sql(_inline_sql(_repaired_sql('text')))} as text from ({_PAGES_SQL})"
_SAFE = f"length(line) between 6 and 160 and not regexp_matches(lower(line), '^{P.HEADING_WORDS}(?:$|[^a-z0-9_])') and not regexp_matches(lower(line), '{P.BUSINESS_WORDS}') and regexp_matches(lower(line), '{P.SAFE_SHAPES}')"
_CLEANED = f"""with p as ({_CLEAN}), l as (select file, doc_id, k, line from (select file, doc_id, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from p)),
  n as (select file, count(*) as n from p group by file), r as (select file, line from (select file, line, count(distinct doc_id) as pages from l where {_SAFE} group by all) join n using (file) where n >= 4 and pages >= greatest(3, ceil(n * 0.45)))
  select doc_id, trim(coalesce(string_agg(l.line, chr(10) order by k) filter (where r.line is null), ''), concat(' ', chr(10))) as text from l left join r using (file, line) group by doc_id"""


@query(_CLEANED)
def cleaned_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cleaned one by one, then without the lines that stand on 45 % of the pages of their file, in files of four pages or more."""
    return cleaned_pages(_pages(spark, sf_dir))


_JOINED = f"select file, string_agg(text, concat(chr(10), chr(10)) order by page_no) as text from ({_PAGES_SQL}) group by file"


@query(f"""select file, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+({P.SECTION_WORDS})(\\s)', concat(chr(10), '\\1\\2'), 'g'), '\\n{{3,}}', concat(chr(10), chr(10)), 'g'), concat(' ', chr(10))) as text, md5(text) as plain_digest from ({_JOINED})""")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined to documents, with headings on lines of their own, and as they are."""
    pages = _pages(spark, sf_dir)
    return assembled(pages).join(assembled(pages, headings=False).select("file", F.md5("text").alias("plain_digest")), "file")


@query(f"select doc_id, {_repaired_sql('text')} as text, {_repaired_sql('text')} = {_repaired_sql('text', 5)} as stable from documents")
def number_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers split by blanks are joined; `stable` tells that one more pass changes nothing."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.repaired_numbers(t).alias("text"), (X.repaired_numbers(t) == X.repaired_numbers(t, 5)).alias("stable"))


# --- sanitising ------------------------------------------------------------------------------


def misbound(value: Column, context: Column) -> Column:
    """A rate that belongs to another thing: 20 per cent beside formalisation, 10 per cent without a guarantee. \\b behind % asks for a letter, so only the spelt form is met before a blank."""
    both = F.concat(context, F.lit(" "), value)
    return (both.rlike(E.java(FORMALISING)) & value.rlike(E.java(TWENTY))) | (value.rlike(E.java(TEN)) & ~both.rlike(E.java(GUARANTEES)))


def reported_amount(value: Column, context: Column, sentinel: Column) -> Column:
    """An amount cell for a report: parts between semicolons that say what they measure, each once; else the sentinel; null and blank give null."""
    raw = X.squeezed(value)
    context = F.coalesce(context, F.lit(""))
    parts = F.filter(F.transform(F.split(raw, r"\s*;\s*"), X.squeezed), lambda p: p != "")
    kept = F.array_distinct(F.filter(parts, lambda p: ~misbound(p, context) & ~p.rlike(BARE) & X.strict_amount(p)))
    return F.when(raw == "", None).when(misbound(raw, context) | (F.size(kept) == 0), sentinel).otherwise(F.array_join(kept, "; "))


def reported_reference(value: Column, missing: Column) -> Column:
    """A reference cell for a report: parts between semicolons that are no bare numbers, each once; blank stays blank."""
    raw = F.coalesce(X.squeezed(value), F.lit(""))
    kept = F.array_distinct(F.filter(F.transform(F.split(raw, r"\s*;\s*"), X.squeezed), lambda p: (p != "") & ~p.rlike(BARE)))
    return F.when(raw == "", "").when(F.size(kept) == 0, missing).otherwise(F.array_join(kept, "; "))


def _misbound_sql(v: str, context: str) -> str:
    both = f"concat({context}, ' ', {v})"
    return f"((regexp_matches({both}, {quoted('(?i)' + FORMALISING)}) and regexp_matches({v}, {quoted('(?i)' + TWENTY)})) or (regexp_matches({v}, {quoted('(?i)' + TEN)}) and not regexp_matches({both}, {quoted('(?i)' + GUARANTEES)})))"


def _strict_sql(v: str) -> str:
    return f"(regexp_matches({v}, {quoted('(?i)' + X.SENTINELS)}) or (not regexp_matches({v}, '^\\d{{1,3}}(?:[.,]\\d+)?$') and regexp_matches({v}, {quoted('(?i)(?:' + X.MEASURED + ')')})))"


def _amount_sql(value: str, context: str, sentinel: str) -> str:
    raw, context = squeeze(value), f"coalesce({context}, '')"
    kept = f"list_filter(list_transform(string_split_regex({raw}, '\\s*;\\s*'), lambda p: {squeeze('p')}), lambda p: p <> '' and not {_misbound_sql('p', context)} and not regexp_matches(p, '{BARE}') and {_strict_sql('p')})"
    unique = f"list_filter({kept}, lambda p, i: list_position({kept}, p) = i)"
    return f"case when {raw} = '' then null when {_misbound_sql(raw, context)} or len({kept}) = 0 then {sentinel} else array_to_string({unique}, '; ') end"


def _reference_sql(value: str, missing: str) -> str:
    raw = f"coalesce({squeeze(value)}, '')"
    kept = f"list_filter(list_transform(string_split_regex({raw}, '\\s*;\\s*'), lambda p: {squeeze('p')}), lambda p: p <> '' and not regexp_matches(p, '{BARE}'))"
    return f"case when {raw} = '' then '' when len({kept}) = 0 then {missing} else array_to_string(list_filter({kept}, lambda p, i: list_position({kept}, p) = i), '; ') end"


_LOCALE = "case result_id % 3 when 0 then 'es' when 1 then 'ca' else 'en' end"
_CELL = "case result_id % 7 when 0 then value || '; 21; ' || value when 1 then '20 por ciento; ' || value when 2 then value || ' ; 10 % ; 5 del importe' when 3 then '42' else value end"
_NOTE = "case result_id % 4 when 0 then 'gastos de formalización' when 1 then 'garantía' else reference end"


@query(f"select result_id, {_amount_sql('cell', 'note', sql_locale(SENTINEL, 'locale'))} as amount from (select result_id, {_CELL} as cell, {_NOTE} as note, {_LOCALE} as locale from ({LATEST})) where cell is not null")
def amount_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount cells for a report, in three languages."""
    rows = values(spark, sf_dir).select("result_id", F.expr(_CELL).alias("cell"), F.expr(_NOTE).alias("note"), F.expr(_LOCALE).alias("locale")).filter("cell is not null")
    return rows.select("result_id", reported_amount(F.col("cell"), F.col("note"), _named(SENTINEL, F.col("locale"))).alias("amount"))


_REFERENCE = "case result_id % 5 when 0 then reference || '; 12; ' || reference when 1 then '7' when 2 then '' else reference end"


@query(f"select result_id, {_reference_sql('cell', sql_locale(NO_REFERENCE, 'locale'))} as reference, {sql_locale(NOT_MENTIONED, 'locale')} as absent from (select result_id, {_REFERENCE} as cell, {_LOCALE} as locale from ({LATEST}))")
def reference_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference cells for a report, and what is said where a document doesn't mention a field."""
    rows = values(spark, sf_dir).select("result_id", F.expr(_REFERENCE).alias("cell"), F.expr(_LOCALE).alias("locale"))
    return rows.select("result_id", reported_reference(F.col("cell"), _named(NO_REFERENCE, F.col("locale"))).alias("reference"), _named(NOT_MENTIONED, F.col("locale")).alias("absent"))


def header_kind(cell: Column) -> Column:
    """amount, reference or null: what a header cell says about its column."""
    plain = X.normalised(cell)
    worded = reduce(lambda a, b: a & b, (plain.rlike(E.java(w)) for w in AMOUNT_WORDS))
    return F.when(plain.isin(*AMOUNT_HEADERS) | worded, "amount").when(plain.isin(*REFERENCE_HEADERS), "reference")


def sanitized_sheet(cells: DataFrame, locale: str = "es") -> DataFrame:
    """`cells` (sheet, row_no, col_no, value) with the values of amount and reference columns sanitised. Columns are found by header cells anywhere in their sheet; a row's other cells are the context of its amounts."""
    kinds = cells.select("sheet", "col_no", header_kind(F.col("value")).alias("kind")).filter("kind is not null").groupBy("sheet", "col_no").agg(F.bool_or(F.col("kind") == "amount").alias("amount"), F.bool_or(F.col("kind") == "reference").alias("reference"))
    context = cells.groupBy("sheet", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("value", F.lit("")).alias("v")))), lambda c: c["v"]), " ").alias("context"))
    rows = cells.join(kinds, ["sheet", "col_no"], "left").join(context, ["sheet", "row_no"])
    said, present = header_kind(F.col("value")), X.present(F.col("value"))
    amount = reported_amount(F.col("value"), F.col("context"), F.lit(SENTINEL[locale]))
    out = F.when(F.col("amount") & present & ~said.eqNullSafe("amount"), amount).when(F.col("reference") & present & ~said.eqNullSafe("reference"), reported_reference(F.col("value"), F.lit(NO_REFERENCE[locale]))).otherwise(F.col("value"))
    return rows.select("sheet", "row_no", "col_no", out.alias("value"))


def bare_amount_cells(cells: DataFrame) -> DataFrame:
    """The cells of amount columns that are bare numbers: what no sheet may hold."""
    columns = cells.filter(header_kind(F.col("value")) == "amount").select("sheet", "col_no").distinct()
    return cells.join(columns, ["sheet", "col_no"], "left_semi").filter(X.squeezed(F.col("value")).rlike(BARE)).select("sheet", "row_no", "col_no", "value")


def assert_no_bare_amounts(cells: DataFrame) -> None:
    """Raises with the first five of `bare_amount_cells`, if there are any."""
    if found := bare_amount_cells(cells).orderBy("sheet", "row_no", "col_no").limit(5).collect():
        raise ValueError("bare amounts remain: " + ", ".join(f"{r.sheet}!R{r.row_no}C{r.col_no}={r.value}" for r in found))


_SHEETS = [("1", "'Concepto'"), ("2", "'Importe o porcentaje'"), ("3", "'Referencia'"), ("4", "'Nota'")]
_BODY = [("1", "concat('línea ', cast(l_linenumber as string))"), ("2", "case l_partkey % 5 when 0 then cast(l_suppkey as string) when 1 then concat(cast(l_linenumber as string), ' %') when 2 then '20 por ciento; 21' when 3 then null else concat(cast(l_partkey as string), ' euros; ', cast(l_partkey as string), ' euros') end"), ("3", "case l_partkey % 3 when 0 then '12' when 1 then 'Cláusula 3; 4; Cláusula 3' else '' end"), ("4", "case when l_linenumber % 2 = 0 then 'escritura' else '21' end")]
_CELLS_SQL = " union all ".join(
    [f"select distinct concat('s', cast(l_orderkey as string)) as sheet, 1 as row_no, {c} as col_no, {h} as value from lineitem" for c, h in _SHEETS] + [f"select concat('s', cast(l_orderkey as string)), l_linenumber + 1, {c}, {v} from lineitem" for c, v in _BODY]
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each order: a header row and a row for each line."""
    lines = table(spark, sf_dir, "lineitem")
    sheet = F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("sheet")
    heads = lines.select(sheet).distinct().select("sheet", F.lit(1).alias("row_no"), F.inline(F.array(*(F.struct(F.lit(int(c)).alias("col_no"), F.expr(h).alias("value")) for c, h in _SHEETS))))
    body = lines.select(sheet, (F.col("l_linenumber") + 1).alias("row_no"), F.inline(F.array(*(F.struct(F.lit(int(c)).alias("col_no"), F.expr(v).alias("value")) for c, v in _BODY))))
    return heads.unionByName(body)


_AMOUNT_HEAD = f"({norm('value')} in ({', '.join(map(quoted, AMOUNT_HEADERS))}) or (regexp_matches({norm('value')}, {quoted(AMOUNT_WORDS[0])}) and regexp_matches({norm('value')}, {quoted(AMOUNT_WORDS[1])})))"
_REF_HEAD = f"{norm('value')} in ({', '.join(map(quoted, REFERENCE_HEADERS))})"
_HAS = f"coalesce({squeeze('value')} <> '', false)"


@query(
    f"""with c as (select *, coalesce({_AMOUNT_HEAD}, false) as ah, coalesce({_REF_HEAD}, false) as rh from ({_CELLS_SQL})), k as (select sheet, col_no, bool_or(ah) as a, bool_or(rh) as r from c group by all), x as (select sheet, row_no, string_agg(coalesce(value, ''), ' ' order by col_no) as context from c group by all)
  select sheet, row_no, col_no, case when a and {_HAS} and not ah then {_amount_sql('value', 'context', quoted(SENTINEL['es']))} when r and {_HAS} and not rh then {_reference_sql('value', quoted(NO_REFERENCE['es']))} else value end as value from c join k using (sheet, col_no) join x using (sheet, row_no)"""
)
def sheet_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitized_sheet(_cells(spark, sf_dir))


@query(f"with c as ({_CELLS_SQL}) select sheet, row_no, col_no, value from c join (select distinct sheet, col_no from c where {_AMOUNT_HEAD}) using (sheet, col_no) where regexp_matches({squeeze('value')}, '{BARE}')")
def sheet_bare_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare_amount_cells(_cells(spark, sf_dir))


# --- classification --------------------------------------------------------------------------


def report_language(text: Column) -> Column:
    """ca with a title and three function words, en with a title, else es; read in the first SAMPLE characters, as the rule has it."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    words = F.regexp_count(F.lower(sample), F.lit(E.ascii_edges(CATALAN_WORDS)))
    return F.when(sample.rlike(E.java(CATALAN_TITLE)) & (words >= 3), "ca").when(sample.rlike(E.java(ENGLISH_TITLE)), "en").otherwise("es")


def contract_kind(text: Column) -> Column:
    found = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), E.java(CONTRACT_KIND), 1))
    return F.when(found == "", "desconocido").when(found.startswith("OBRAS"), "obras").when(found.startswith("SUMINISTRO"), "suministros").when(found.contains("SERVICIO"), "servicios").when(found.startswith("MIXTO"), "mixto").otherwise("otro")


# Fixed values are the languages; the wording is our own.
NOTICES = {
    "es": "Modelo general: las cifras están en el cuadro de cada contrato y aquí quedan en blanco.",
    "ca": "Model general: les xifres són al quadre de cada contracte i aquí queden en blanc.",
    "en": "General model: the figures stand in each contract's own table and are blank here.",
}
_KIND_SQL = f"upper(regexp_extract(coalesce(text, ''), {quoted('(?i)' + CONTRACT_KIND)}, 1))"
_LANG_SQL = f"""case when regexp_matches(substring(coalesce(text, ''), 1, {SAMPLE}), {quoted('(?i)' + CATALAN_TITLE)}) and len(regexp_extract_all(lower(substring(coalesce(text, ''), 1, {SAMPLE})), {quoted(CATALAN_WORDS)})) >= 3 then 'ca' when regexp_matches(substring(coalesce(text, ''), 1, {SAMPLE}), {quoted('(?i)' + ENGLISH_TITLE)}) then 'en' else 'es' end"""
_FRAMED = r"cuadro de caracter[íi]sticas particulares|\bccp\b"
_CONCRETE = r"(?:presupuesto base|valor estimado|importe (?:total|base))[^.\n]{0,80}\d{1,3}(?:\.\d{3})+,\d{2}\s*(?:€|euros)"
_CLASSED = f"""select doc_id, case when {_KIND_SQL} = '' then 'desconocido' when starts_with({_KIND_SQL}, 'OBRAS') then 'obras' when starts_with({_KIND_SQL}, 'SUMINISTRO') then 'suministros' when contains({_KIND_SQL}, 'SERVICIO') then 'servicios' when starts_with({_KIND_SQL}, 'MIXTO') then 'mixto' else 'otro' end as contract_type,
  coalesce(locale, {_LANG_SQL}) as language, coalesce(regexp_matches(text, {quoted('(?i)' + _FRAMED)}) and not regexp_matches(text, {quoted('(?i)' + _CONCRETE)}), false) as framework from (select doc_id, text, locale from (ROWS))"""
_ROWS = f"select doc_id, text, null::varchar as locale from documents union all select -doc_id - 1, text, case when doc_id % 6 = 0 then 'ca' end from ({CARRIER_SQL})"


@query(f"select *, case when framework then {sql_locale(NOTICES, 'language')} end as notice from ({_CLASSED.replace('(ROWS)', '(' + _ROWS + ')')})")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract type, language (one asked for goes first) and whether a text is a framework, with its notice; null texts are unknown."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("locale"))
    made = carrier(spark, sf_dir).select((-F.col("doc_id") - 1).alias("doc_id"), "text", F.expr("case when doc_id % 6 = 0 then 'ca' end").alias("locale"))
    t = F.col("text")
    framework = F.coalesce(t.rlike(E.java(_FRAMED)) & ~t.rlike(E.java(_CONCRETE)), F.lit(False))
    rows = own.unionByName(made).select("doc_id", contract_kind(t).alias("contract_type"), F.coalesce("locale", report_language(t)).alias("language"), framework.alias("framework"))
    return rows.withColumn("notice", F.when(F.col("framework"), _named(NOTICES, F.col("language"))))


@query(f"select document, field, arg_min({squeeze('value')}, result_id) as value from (select document, replace(field, '_', ' ') as key, value, result_id from ({LATEST}) where {_HAS}) join (values " + ", ".join(f"('{f}', {quoted('(?i)' + '|'.join(ps))})" for f, ps in CUES.items()) + ") c(field, pattern) on regexp_matches(key, pattern) group by document, field")
def mapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a generic extractor on the schema's fields: the first pair whose key holds a cue of the field."""
    key = F.replace("field", F.lit("_"), F.lit(" "))
    fits = F.array_compact(F.array(*(F.when(key.rlike("|".join(E.java(p) for p in patterns)), field) for field, patterns in CUES.items())))
    rows = values(spark, sf_dir).filter(X.present(F.col("value"))).select("document", "result_id", X.squeezed(F.col("value")).alias("value"), F.explode(fits).alias("field"))
    return rows.groupBy("document", "field").agg(F.min_by("value", "result_id").alias("value"))
