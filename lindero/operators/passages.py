"""Lines, sections, passages and spans of texts.

Positions are 0-based code points, intervals half-open. Each operator works within one text, which
is a bounded group, and never gathers texts of a file or source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.functions.text import BLANKS, normalised, spots, squeezed

# Lines that are boilerplate as a whole, and shapes of repeated lines that may be dropped.
BOILERPLATE_LINES = (
    r"^Firmado por:", r"^Cargo:", r"^Fecha:\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", r"^Jefe de servicio", r"^Este documento es Copia Aut[ée]ntica", r"^Su autenticidad puede ser comprobada",
    r"^Para la verificaci[oó]n del siguiente c[oó]digo", r"^https?://\S*licitacion\S*", r"^C[oó]digo de verificaci[oó]n\s*:", r"^P[aá]gina:\s*\d+\s*de\s*\d+",
)
HEADING_WORDS = r"(?:cl[áa]usula|anexo|apartado|art[íi]culo|cap[íi]tulo|secci[óo]n)"
BUSINESS_WORDS = r"(?:presupuesto|garant[íi]a|seguro|solvencia|criterios|plazo|contratista|adjudicatario|iva|valor estimado)"
SAFE_SHAPES = r"(?:^p[áa]gina\s+\d+|^expediente\s*[:/]|^c[óo]digo seguro de verificaci[óo]n|^csv\s*[:/]|^firmado electr[óo]nicamente|contrataci[oó]n del sector p[uú]blico|sede electr[oó]nica)"
SECTION_WORDS = "Cláusula|Artículo|Apartado|CLÁUSULA|ARTÍCULO|SECCIÓN|CAPÍTULO|ANEXO"
HEADING = rf"(?:^|\n)[\s\x{{00A0}}]*(?:{SECTION_WORDS})\s+(?:[0-9]+(?:\.[0-9]+)*|[IVXLCMD]+)"


def unfolded(rows: DataFrame, array: str | Column, probe: str, *keep: str) -> DataFrame:
    """The structs of an array as rows beside the columns `keep`; `probe` is a member that is never null.

    An inner generator would make Spark infer a filter on the array and push the whole of what it is
    made from below every step; the outer one with a filter on what it gives doesn't.
    """
    return rows.select(*(keep or ("doc_id",)), F.inline_outer(array)).filter(F.col(probe).isNotNull())


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, file, line): the lines of each text."""
    return documents.select("doc_id", "file", F.explode(F.split("text", "\n")).alias("line"))


def without_boilerplate(text: Column) -> Column:
    """The text's lines squeezed, without boilerplate and empty ones."""
    kept = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda line: (line != "") & ~line.rlike("(?iu)(?:" + "|".join(BOILERPLATE_LINES) + ")"))
    return F.array_join(kept, "\n")


def safe_to_drop(line: Column) -> Column:
    """Whether a repeated line may be dropped: of usual length, no heading, no business term, a known shape."""
    named = F.lower(line).rlike(f"^{HEADING_WORDS}(?![a-z0-9_])") | F.lower(line).rlike(BUSINESS_WORDS)
    return F.length(line).between(6, 160) & F.lower(line).rlike(SAFE_SHAPES) & ~named


def repeated_lines(documents: DataFrame, least_pages: int = 4, share: float = 0.45) -> DataFrame:
    """(file, line, pages): lines that stand on so many pages of a file that they are boilerplate of it."""
    pages = documents.filter("file is not null").groupBy("file").agg(F.count("*").alias("n"))
    rows = documents.filter("file is not null").select("file", "doc_id", F.explode_outer(F.array_distinct(F.transform(F.split("text", "\n"), squeezed))).alias("line"))
    candidates = rows.filter(safe_to_drop(F.col("line"))).groupBy("file", "line").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.lit(3), F.ceil(F.col("n") * share))
    return candidates.join(pages, "file").filter((F.col("n") >= least_pages) & (F.col("pages") >= enough)).select("file", "line", "pages")


def without_repeated(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, text): texts without the repeated lines of their file; only texts that hold one are taken apart."""
    rows = lines(documents.filter("file is not null")).withColumn("key", squeezed(F.col("line")))
    hit = rows.join(repeated.select("file", F.col("line").alias("key")), ["file", "key"])
    marked = hit.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
    joined = documents.select("doc_id", "text").join(marked, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("drop", squeezed(line))), "\n")
    trimmed = F.regexp_replace(kept, r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$", "")
    return joined.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(trimmed).alias("text"))


def with_sections(documents: DataFrame, text: str = "text", to: str = "sections") -> DataFrame:
    """`documents` with an ARRAY of (section_no, heading, key, start_pos, end_pos): from each heading that begins a line to the next one."""
    heads = F.transform(spots(F.col(text), HEADING), lambda m: F.struct(squeezed_ends(m["text"]).alias("heading"), (m["end"] - F.length(squeezed_ends(m["text"]))).alias("start")))
    rows = documents.withColumn("_heads", heads)
    found = F.transform(
        F.col("_heads"),
        lambda h, k: F.struct((k + 1).cast("int").alias("section_no"), h["heading"].alias("heading"), normalised(h["heading"]).alias("key"), h["start"].alias("start_pos"), F.coalesce(F.get(F.col("_heads"), k + 1)["start"], F.length(text)).alias("end_pos")),
    )
    return rows.select(*documents.columns, found.alias(to))


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading, key, start_pos, end_pos): worked out within the row, no text is shuffled."""
    return unfolded(with_sections(documents.select("doc_id", "text")), "sections", "section_no")


def with_collapsed(documents: DataFrame, text: str = "text", to: str = "collapsed") -> DataFrame:
    """`documents` with an ARRAY of (key, text): the sections of a text, those of one key joined in order by an empty line."""
    rows = with_sections(documents, text, "_sections")
    body = lambda s: squeezed_ends(F.substring(F.col(text), s["start_pos"] + 1, s["end_pos"] - s["start_pos"]))
    rows = rows.withColumn("_parts", F.transform("_sections", lambda s: F.struct(s["key"].alias("key"), body(s).alias("text"))))
    rows = rows.withColumn("_keys", F.array_distinct(F.transform("_parts", lambda p: p["key"])))
    joined = F.transform("_keys", lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(F.col("_parts"), lambda p: p["key"] == k), lambda p: p["text"]), "\n\n").alias("text")))
    return rows.select(*documents.columns, joined.alias(to))


def zipped(a: Column, b: Column, prefix: Column) -> Column:
    """ARRAY of (key, text_a, text_b): two lists side by side, '' where one is shorter; blank pairs are left out, several are numbered."""
    most = F.greatest(F.size(a), F.size(b))
    side = lambda parts, k: F.coalesce(F.get(parts, k - 1), F.lit(""))
    rows = F.transform(
        F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.when(most > 1, F.concat(prefix, F.lit(" ("), k.cast("string"), F.lit("/"), most.cast("string"), F.lit(")"))).otherwise(prefix).alias("key"), side(a, k).alias("text_a"), side(b, k).alias("text_b")),
    )
    return F.filter(rows, lambda r: (squeezed_ends(r["text_a"]) != "") | (squeezed_ends(r["text_b"]) != ""))


def with_comparison(pairs: DataFrame, a: str = "text_a", b: str = "text_b", most: int = 32_000) -> DataFrame:
    """`pairs` with `chunks`, an ARRAY of (key, text_a, text_b): the sections of two texts matched by key; a pair over `most` is cut into chunks side by side, texts without sections as a whole."""
    size = max(most // 2, 4000)
    rows = with_collapsed(with_collapsed(pairs, a, "_one"), b, "_two")
    keys = F.array_union(F.transform("_one", lambda s: s["key"]), F.transform("_two", lambda s: s["key"]))
    of = lambda side, k: F.coalesce(F.get(F.filter(F.col(side), lambda s: s["key"] == k), F.lit(0))["text"], F.lit(""))
    rows = rows.withColumn("_keys", keys)
    rows = rows.withColumn("_pairs", F.transform("_keys", lambda k: F.struct(k.alias("key"), of("_one", k).alias("a"), of("_two", k).alias("b"))))
    parts = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(chunked(t, size))
    whole = lambda p: F.filter(F.array(F.struct(p["key"].alias("key"), p["a"].alias("text_a"), p["b"].alias("text_b"))), lambda r: (r["text_a"] != "") | (r["text_b"] != ""))
    rows = rows.withColumn("_cut", F.transform(F.filter("_pairs", lambda p: F.length(p["a"]) + F.length(p["b"]) > most), lambda p: F.struct(p["key"].alias("key"), parts(p["a"]).alias("a"), parts(p["b"]).alias("b"))))
    wide = F.flatten(F.transform(F.filter("_pairs", lambda p: F.length(p["a"]) + F.length(p["b"]) <= most), whole))
    by_key = F.concat(wide, F.flatten(F.transform("_cut", lambda c: zipped(c["a"], c["b"], c["key"]))))
    rows = rows.withColumn("_keyed", (F.size("_one") > 0) & (F.size("_two") > 0))
    rows = rows.withColumn("_a", F.when(~F.col("_keyed"), chunked(F.col(a), most))).withColumn("_b", F.when(~F.col("_keyed"), chunked(F.col(b), most)))
    return rows.select(*pairs.columns, F.when(F.col("_keyed"), by_key).otherwise(zipped(F.col("_a"), F.col("_b"), F.lit("Fragmento"))).alias("chunks"))


def cue_hits(documents: DataFrame, cues: dict[str, str], most: int | None = None) -> DataFrame:
    """(doc_id, cue, hit_no, start_pos, end_pos): where literal cues stand in each text, case ignored, without overlaps; all cues from one scan; `most` keeps the first ones."""
    parts = []
    for name, cue in cues.items():
        found = spots(F.col("text"), "(?iu)\\Q" + cue + "\\E")
        parts.append(_named(F.slice(found, 1, most) if most else found, name))
    return unfolded(documents, F.concat(*parts) if len(parts) > 1 else parts[0], "cue")


def _named(found: Column, name: str) -> Column:
    return F.transform(found, lambda m, k: F.struct(F.lit(name).alias("cue"), (k + 1).alias("hit_no"), m["start"].alias("start_pos"), m["end"].alias("end_pos")))


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start_pos, end_pos): overlapping or touching spans made one, by a running maximum of ends."""
    before = Window.partitionBy(key).orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("_new", F.when(F.col("start_pos") <= F.max("end_pos").over(before), 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(upto)).groupBy(key, "_island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_island")


def capped_spans(spans: DataFrame, key: str, cap: int) -> DataFrame:
    """Spans in order until their joint length reaches `cap`; the one that crosses it is cut, later ones are left out."""
    before = Window.partitionBy(key).orderBy("start_pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("_used", F.coalesce(F.sum(F.col("end_pos") - F.col("start_pos")).over(before), F.lit(0)))
    return rows.filter(F.col("_used") < cap).withColumn("end_pos", F.least("end_pos", F.col("start_pos") + cap - F.col("_used"))).drop("_used")


def nearest_before(points: DataFrame, marks: DataFrame, key: str, within: int) -> DataFrame:
    """Each point with the `label` of the nearest mark before it, at most `within` away (null if none): one pass over the union of both."""
    both = points.select(key, "start_pos", "point_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("mark_pos"), F.lit(1).alias("kind")).unionByName(
        marks.select(key, "start_pos", F.lit(None).cast("string").alias("point_id"), "label", F.col("start_pos").cast("long").alias("mark_pos"), F.lit(2).alias("kind"))
    )
    upto = Window.partitionBy(key).orderBy("start_pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 2, F.struct("mark_pos", "label")), ignorenulls=True).over(upto)
    rows = both.withColumn("_m", last).filter("kind = 1")
    near = F.col("start_pos") - F.col("_m.mark_pos") <= within
    return rows.select(key, "point_id", "start_pos", F.when(near, F.col("_m.label")).alias("label"))


def packed(parts: Column, most: int) -> Column:
    """Parts packed in order into chunks: a part that would make its chunk longer than `most` starts the next; the blank line between two isn't counted."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        full = (F.length(state["open"]) + F.length(part) > most) & (F.length(state["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(squeezed_ends(state["open"])))).otherwise(state["done"]).alias("done"),
            F.when(full, part).otherwise(F.concat(state["open"], F.when(F.length(state["open"]) > 0, "\n\n").otherwise(""), part)).alias("open"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(squeezed_ends(s["open"]) != "", F.concat(s["done"], F.array(squeezed_ends(s["open"])))).otherwise(s["done"]))


def squeezed_ends(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")


def chunked(text: Column, most: int = 8000) -> Column:
    """A text as chunks: whole if it fits, else packed from clauses, else from paragraphs, else cut hard."""
    clauses = F.filter(F.split(text, r"(?=\n(?:Cláusula|Artículo|Apartado|CLÁUSULA|ARTÍCULO|SECCIÓN|CAPÍTULO|ANEXO)\s)"), lambda p: squeezed_ends(p) != "")
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: squeezed_ends(p) != "")
    hard = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(most)), lambda k: F.substring(text, k + 1, F.lit(most)))
    return F.when(F.length(text) <= most, F.array(text)).when(F.size(clauses) > 1, packed(clauses, most)).when(F.size(paragraphs) > 1, packed(paragraphs, most)).otherwise(hard)
