"""Queries over texts: cleaning, classification, sections, passages, spans, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.functions import text as X
from lindero.operators import passages as P
from lindero.operators.evidence import gold_labels, sources
from lindero.operators.extraction import java
from lindero.plans.carriers import CARRIER_SQL, carrier
from lindero.plans.registry import query
from lindero.plans.segments import quoted, spots_sql
from lindero.plans.values import GOLD, LATEST, SOURCES, has, norm, squeeze, values
from lindero.session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("file"))


_ANY_BOILERPLATE = "(?i)(?:" + "|".join(P.BOILERPLATE_LINES) + ")"
_LINE = squeeze("l")


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_LINE}), lambda l: l <> '' and not regexp_matches(l, '{_ANY_BOILERPLATE}')), chr(10)) as text from documents")
def boilerplate_lines_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", P.without_boilerplate(F.col("text")).alias("text"))


_SAFE = f"""length(line) between 6 and 160 and not regexp_matches(lower(line), '^{P.HEADING_WORDS}(?:$|[^a-z0-9_])') and not regexp_matches(lower(line), '{P.BUSINESS_WORDS}') and regexp_matches(lower(line), '{P.SAFE_SHAPES}')"""
_REPEATED = f"""select file, line, pages from (select file, line, count(*) as pages from (select distinct file, doc_id, {squeeze('l')} as line from (select file, doc_id, unnest(string_split(text, chr(10))) as l from (select doc_id, text, source as file from documents))) where {_SAFE} group by all)
  join (select file, count(*) as n from (select doc_id, text, source as file from documents) group by all) using (file) where n >= 4 and pages >= greatest(3, ceil(n * 0.01))"""


@query(_REPEATED)
def line_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat over the texts of a source, taken as a volume; the share is lower than for the pages of one document."""
    return P.repeated_lines(_volumes(spark, sf_dir), share=0.01)


_STRIP = r"'^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$'"


@query(
    f"""with r as ({_REPEATED}), l as (select doc_id, source as file, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as l from documents),
  m as (select l.*, r.line is not null as hit from l left join r on r.file = l.file and r.line = {squeeze('l.l')})
  select doc_id, case when bool_or(hit) then regexp_replace(coalesce(string_agg(l, chr(10) order by k) filter (where not hit), ''), {_STRIP}, '', 'g') else string_agg(l, chr(10) order by k) end as text from m group by doc_id"""
)
def repeated_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _volumes(spark, sf_dir)
    return P.without_repeated(documents, P.repeated_lines(documents, share=0.01))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '[ \t]+(ANEXO|CLÁUSULA|Cláusula|Apartado) ', concat(chr(10), '\1 '), 'g'), '\n{3,}', concat(chr(10), chr(10)), 'g'), concat(' ', chr(10))) as text from documents""")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks collapsed, headings on lines of their own, at most one empty line."""
    t = F.regexp_replace("text", r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+(ANEXO|CLÁUSULA|Cláusula|Apartado) ", "\n$1 ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return _documents(spark, sf_dir).select("doc_id", F.trim(t, F.lit(" \n")).alias("text"))


def search(c: str) -> str:
    to = X.SEARCH_TO.replace("'", "''")
    return f"translate({norm(c)}, '{X.SEARCH_FROM}', '{to}')"


@query(f"select doc_id, {search('text')} as text from documents")
def search_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.searchable(F.col("text")).alias("text"))


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: case when length(w) <= 3 then upper(w) else concat(upper(substring(w, 1, 1)), substring(w, 2)) end), ' ') as name from part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.title_cased(F.col("p_name")).alias("name"))


@query(r"""select file, substring(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), 1, 40) as slug from corpus_manifest""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_manifest").select("file", F.substring(F.regexp_replace("title", "[^A-Za-z0-9]+", "_"), 1, 40).alias("slug"))


_KEYLIKE = r"(?:AIza[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z]{20,}|[0-9A-Za-z._+-]+@[0-9A-Za-z-]+\.[0-9A-Za-z.-]+)"


@query(f"select doc_id, len(regexp_extract_all(text, '({_KEYLIKE})', 1)) as hits, regexp_replace(text, '{_KEYLIKE}', '[redacted]', 'g') as text from documents where regexp_matches(text, '{_KEYLIKE}')")
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold something shaped like a key or an address, with it taken out."""
    rows = _documents(spark, sf_dir).filter(F.col("text").rlike(_KEYLIKE))
    return rows.select("doc_id", F.regexp_count("text", F.lit(_KEYLIKE)).alias("hits"), F.regexp_replace("text", _KEYLIKE, "[redacted]").alias("text"))


# --- classification --------------------------------------------------------------------------

# Shapes of the boxes of characteristics, and prose that states the figures.
_NUMBERED = r"(?:^|\s)\d{1,2}\s*\)\s*[A-ZÁÉÍÓÚÜÑ]{4,}"
_LETTERED = r"(?:^|\s)[A-H]\.\s*[A-ZÁÉÍÓÚÜÑ]{4,}"
_PROSE = r"(?:plazo de ejecuci[oó]n|presupuesto base de licitaci[oó]n)[^.\n]{0,60}(?:ser[áa]|asciende a|es de|:)"
_BOX = r"CUADRO\s+(?:DE\s+)?CARACTER[ÍI]STICAS|\bCCEC\b"


@query(
    f"""select doc_id, case when regexp_matches(text, '(?i){_BOX}') and numbered >= 6 then 'ccec-cuadro' when lettered >= 5 then 'lettered-cuadro' when numbered >= 6 then 'ccec-cuadro' when regexp_matches(text, '(?i){_PROSE}') then 'prose' else 'unknown' end as family
  from (select doc_id, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '{_NUMBERED}')) as numbered, len(regexp_extract_all(coalesce(text, ''), '{_LETTERED}')) as lettered from (select doc_id, text from documents union all select -doc_id - 1, text from ({CARRIER_SQL})))"""
)
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template family of documents and of texts in the layouts; null texts are unknown."""
    rows = _documents(spark, sf_dir).select("doc_id", "text").unionByName(carrier(spark, sf_dir).select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    t = F.coalesce("text", F.lit(""))
    numbered, lettered = F.regexp_count(t, F.lit(_NUMBERED)), F.regexp_count(t, F.lit(_LETTERED))
    family = F.when(t.rlike(java(_BOX)) & (numbered >= 6), "ccec-cuadro").when(lettered >= 5, "lettered-cuadro").when(numbered >= 6, "ccec-cuadro").when(t.rlike(java(_PROSE)), "prose").otherwise("unknown")
    return rows.select("doc_id", family.alias("family"))


# --- sections --------------------------------------------------------------------------------

_HEAD = P.HEADING.replace(r"(?:^|\n)", r"\n").replace(r"[\s\x{00A0}]*", r"\s*")
_HEADS = f"select doc_id, text, k, trim(m, concat(' ', chr(9), chr(10), chr(13))) as heading, stop_pos - length(trim(m, concat(' ', chr(9), chr(10), chr(13)))) as start_pos from ({spots_sql('select doc_id, text from documents', quoted(_HEAD), front=chr(10))})"
_SECTIONS = f"select doc_id, text, k::integer as section_no, heading, {norm('heading')} as key, start_pos, coalesce(lead(start_pos) over (partition by doc_id order by k), length(text)) as end_pos from ({_HEADS})"
_STRIPPED = "regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"
_BODIES = f"select doc_id, key, string_agg({_STRIPPED.format(c='substring(text, start_pos + 1, end_pos - start_pos)')}, concat(chr(10), chr(10)) order by section_no) as text from ({_SECTIONS}) group by all"


@query(f"select doc_id, section_no, heading, key, start_pos, end_pos from ({_SECTIONS})")
def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each document, from heading to heading."""
    return P.sections(_documents(spark, sf_dir))


@query(_BODIES)
def section_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of sections of one key joined in order."""
    return P.unfolded(P.with_collapsed(_documents(spark, sf_dir).select("doc_id", "text")), "collapsed", "key")


_COMPARED = f"""with s as ({_BODIES}), pairs as (select a.doc_id, a.text as ta, b.text as tb, exists (select 1 from s where s.doc_id = a.doc_id) and exists (select 1 from s where s.doc_id = b.doc_id) as keyed from documents a join documents b on b.doc_id = a.doc_id + 1 where a.text is not null and b.text is not null),
  k as (select coalesce(x.doc_id, y.doc_id - 1) as doc_id, coalesce(x.key, y.key) as key, coalesce(x.text, '') as text_a, coalesce(y.text, '') as text_b from s x full join s y on y.doc_id = x.doc_id + 1 and y.key = x.key)
  select k.doc_id, key, text_a, text_b from k join pairs p on p.doc_id = k.doc_id and keyed where text_a <> '' or text_b <> '' union all select doc_id, 'Fragmento', ta, tb from pairs where not keyed and (trim(ta) <> '' or trim(tb) <> '')"""


@query(f"select doc_id, key, length(text_a) as chars_a, md5(text_a) as digest_a, length(text_b) as chars_b, md5(text_b) as digest_b from ({_COMPARED})")
def compare_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next: sections matched by key on both sides, whole texts where one side has none."""
    documents = _documents(spark, sf_dir).select("doc_id", "text").filter("text is not null")
    pairs = documents.withColumnRenamed("text", "text_a").join(documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b")), "doc_id")
    rows = P.unfolded(P.with_comparison(pairs), "chunks", "key")
    return rows.select("doc_id", "key", F.length("text_a").alias("chars_a"), F.md5("text_a").alias("digest_a"), F.length("text_b").alias("chars_b"), F.md5("text_b").alias("digest_b"))


@query("select section_id, k::integer as piece_no, substring(text, (k * 800 + 1)::bigint, 800) as piece from (select section_id, text, unnest(range(0, greatest(1, ceil(length(text) / 800.0))::bigint)) as k from document_sections)")
def hard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(800)), lambda k: F.substring(text, k + 1, F.lit(800)))
    return table(spark, sf_dir, "document_sections").filter("text is not null").select("section_id", F.posexplode(cut).alias("piece_no", "piece"))


def _chunks_sql(rows: str, most: int) -> str:
    """(doc_id, chunk_no, chunk) by a recursive fold over clauses, else paragraphs; a text that fits, and hard slices, beside it."""
    strip = lambda c: _STRIPPED.format(c=c)
    return f"""with recursive r as ({rows}), c as (select doc_id, text, list_filter(string_split(regexp_replace(text, '\\n((?:{P.SECTION_WORDS})\\s)', concat(chr(1), chr(10), '\\1'), 'g'), chr(1)), lambda x: {strip('x')} <> '') as clauses, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: {strip('x')} <> '') as paras from r where length(text) > {most}),
      p as (select doc_id, case when len(clauses) > 1 then clauses else paras end as parts from c where len(clauses) > 1 or len(paras) > 1),
      f(doc_id, k, open_, done) as (select doc_id, 0::bigint, '', []::varchar[] from p union all
        select f.doc_id, f.k + 1, case when length(open_) + length(parts[f.k + 1]) > {most} and open_ <> '' then parts[f.k + 1] else concat(open_, case when open_ <> '' then concat(chr(10), chr(10)) else '' end, parts[f.k + 1]) end, case when length(open_) + length(parts[f.k + 1]) > {most} and open_ <> '' then list_append(done, {strip('open_')}) else done end from f join p on p.doc_id = f.doc_id where f.k < len(parts)),
      z as (select f.doc_id, case when {strip('open_')} <> '' then list_append(done, {strip('open_')}) else done end as chunks from f join p on p.doc_id = f.doc_id where f.k = len(parts))
      select doc_id, unnest(range(len(chunks)))::integer as chunk_no, unnest(chunks) as chunk from z union all select doc_id, 0, text from r where length(text) <= {most}
      union all select doc_id, k::integer, substring(text, (k * {most} + 1)::bigint, {most}) from (select doc_id, text, unnest(range(0, ceil(length(text) / {most}.0)::bigint)) as k from c where len(clauses) <= 1 and len(paras) <= 1)"""


@query(f"select doc_id as section_id, chunk_no, chunk from ({_chunks_sql('select section_id as doc_id, text from document_sections where text is not null', 2000)})")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in chunks packed from clauses, else paragraphs, else cut hard."""
    return table(spark, sf_dir, "document_sections").select("section_id", F.posexplode(P.chunked(F.col("text"), 2000)).alias("chunk_no", "chunk"))


_ESTIMATE = lambda mode, most: f"select '{mode}' as mode, count(*) as chunks from ({_chunks_sql(f'select doc_id, text from documents where {_STRIPPED.format(c="text")} <> {chr(39)}{chr(39)}', most)})"


@query(f"select * from ({_ESTIMATE('analysis', 8000)}) union all select * from ({_ESTIMATE('record', 32000)}) union all select 'comparison', count(*) from ({_COMPARED}) where trim(text_a) <> '' or trim(text_b) <> ''")
def chunk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks the documents make in each mode; blank texts make none."""
    rows = _documents(spark, sf_dir).select("doc_id", "text").filter(F.coalesce(P.squeezed_ends(F.col("text")) != "", F.lit(False)))
    sizes = rows.select(F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), F.size(P.chunked(F.col("text"), s)).cast("long").alias("n")) for m, s in (("analysis", 8000), ("record", 32_000))))))
    compared = compare_full_outer(spark, sf_dir).select(F.lit("comparison").alias("mode"), F.lit(1).cast("long").alias("n"))
    return sizes.unionByName(compared).groupBy("mode").agg(F.sum("n").alias("chunks"))


# --- passages --------------------------------------------------------------------------------

CUES = {"presupuesto": "presupuesto base", "plazo": "plazo de ejecución", "garantia": "garantía definitiva", "iva": "iva aplicable"}
_HITS = " union all ".join(f"select doc_id, '{name}' as cue, k as hit_no, start_pos from ({spots_sql('select doc_id, text from documents', quoted('(?i)' + cue), front='')})" for name, cue in CUES.items())


_MARKS = f"select doc_id, start_pos, heading as label from ({_HEADS})"


@query(f"select h.doc_id, concat(h.cue, ':', h.hit_no) as point_id, h.start_pos, arg_max(m.label, m.start_pos) as label from ({_HITS}) h left join ({_MARKS}) m on m.doc_id = h.doc_id and m.start_pos < h.start_pos and m.start_pos >= h.start_pos - 4000 group by all")
def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that each cue stands under: the nearest one before it within 4,000 characters."""
    documents = _documents(spark, sf_dir)
    points = P.cue_hits(documents, CUES).select("doc_id", "start_pos", F.concat_ws(":", "cue", "hit_no").alias("point_id"))
    return P.nearest_before(points, P.sections(documents).select("doc_id", "start_pos", F.col("heading").alias("label")), "doc_id", 4000)


@query(f"select cue, count(*) as n from ({_HITS}) h where exists (select 1 from ({_MARKS}) m where m.doc_id = h.doc_id and abs(m.start_pos - h.start_pos) <= 300) group by cue")
def band_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that stand within 300 characters of a heading."""
    documents = _documents(spark, sf_dir)
    hits, marks = P.cue_hits(documents, CUES).alias("h"), P.sections(documents).select("doc_id", "start_pos").alias("m")
    near = (F.col("h.doc_id") == F.col("m.doc_id")) & (F.abs(F.col("h.start_pos") - F.col("m.start_pos")) <= 300)
    return hits.join(marks, near, "left_semi").groupBy("cue").agg(F.count("*").alias("n"))


@query(f"""select rule, count(*) as labels, count(*) filter (where contains(substring(source, 1, size), {norm('gold')})) as included, round(count(*) filter (where contains(substring(source, 1, size), {norm('gold')})) / count(*), 4) as rate
  from ({GOLD}) g join ({SOURCES}) s on g.document = s.file cross join (values ('head', 300), ('full', 1000000)) r(rule, size) group by rule""")
def evidence_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled values are in what each selection rule leaves of their source; without a size it's the whole."""
    rows = gold_labels(table(spark, sf_dir, "golden_labels")).join(sources(table(spark, sf_dir, "docling_parses")), F.col("document") == F.col("file"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).cast("int").alias("size")) for n, s in (("head", 300), ("full", None)))))
    left = F.when(F.col("r.size").isNull(), F.col("source")).otherwise(F.expr("substring(source, 1, r.size)"))
    inside = F.contains(left, X.normalised(F.col("gold")))
    out = rows.withColumn("r", rules).groupBy(F.col("r.rule").alias("rule")).agg(F.count("*").alias("labels"), F.count(F.when(inside, 1)).alias("included"))
    return out.withColumn("rate", F.round(F.col("included") / F.col("labels"), 4))


# --- rules, labels, findings -----------------------------------------------------------------

@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source, substring(text, 1, 50) order by doc_id) as k from documents) where k = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each key; an ordered aggregate, so a hot key combines on the map side."""
    return _documents(spark, sf_dir).groupBy("source", F.substring("text", 1, 50).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


_MISSED = f"select g.document, rule, field, contains(substring(source, 1, size), {norm('gold')}) as inside from ({GOLD}) g join ({SOURCES}) s on g.document = s.file cross join (values ('head', 300), ('full', 100000000)) r(rule, size)"


@query(f"select document, rule, count(*) as labels, count(*) filter (where inside) as included, round(count(*) filter (where inside) / count(*), 4) as rate, coalesce(list_sort(list(field) filter (where not inside)), []) as missing from ({_MISSED}) group by all union all select 'all', rule, count(*), count(*) filter (where inside), round(count(*) filter (where inside) / count(*), 4), [] from ({_MISSED}) group by rule")
def evidence_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document and rule: labels in what the rule leaves of the source, their share and the missing fields; and totals of each rule."""
    rows = gold_labels(table(spark, sf_dir, "golden_labels")).join(sources(table(spark, sf_dir, "docling_parses")), F.col("document") == F.col("file"))
    gold = X.normalised(F.col("gold"))
    rules = F.inline(F.array(F.struct(F.lit("head").alias("rule"), F.contains(F.substring("source", 1, 300), gold).alias("inside")), F.struct(F.lit("full").alias("rule"), F.contains("source", gold).alias("inside"))))
    told = rows.select("document", "field", rules)
    measures = [F.count("*").alias("labels"), F.count(F.when(F.col("inside"), 1)).alias("included"), F.round(F.count(F.when(F.col("inside"), 1)) / F.count("*"), 4).alias("rate")]
    each = told.groupBy("document", "rule").agg(*measures, F.sort_array(F.collect_list(F.when(~F.col("inside"), F.col("field")))).alias("missing"))
    totals = told.groupBy("rule").agg(*measures).select(F.lit("all").alias("document"), "rule", "labels", "included", "rate", F.array().cast("array<string>").alias("missing"))
    return each.unionByName(totals)
