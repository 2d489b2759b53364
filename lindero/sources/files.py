"""Readers of files: a router by extension, JSON maps of maps, JSON arrays, TSV, logs, listings.

All schemas are declared; nothing is inferred from data. What needs an outside service or a binary
parser is a boundary that takes a function, so that tests pass their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of document a parser can be given for.
KINDS = ("pdf", "docx", "txt")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, kind, length): the files below a path whose name matches, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), "length")


def pages(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """(path, page_no, text): documents parsed by the parser of their kind; a kind without one raises, a parser that fails gives no pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    checked = files.select("path", F.when(kind.isin(*parsers), kind).otherwise(F.raise_error(F.concat(F.lit("no parser for "), F.col("path")))).alias("kind"), "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                try:
                    rows += [(row.path, k, text) for k, text in enumerate(parsers[row.kind](row.content), 1)]
                except Exception:  # noqa: BLE001 - one broken file doesn't end the job
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return checked.mapInPandas(parse, "path string, page_no int, text string")


def plain_pages(content: bytes) -> list[str]:
    """Pages of a plain text, parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def json_map_of_maps(spark: SparkSession, path: str) -> DataFrame:
    """(doc, field, gold) from {doc: {field: gold}}; members that begin with _ are comments."""
    outer = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("doc", "inner"))
    rows = outer.filter("doc not like '\\\\_%'").select("doc", F.explode(F.from_json("inner", "map<string,string>")).alias("field", "gold"))
    return rows.filter("field not like '\\\\_%'")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The members of files that each hold one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)


def run_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records in files <path>/<arm>/<run>/<document>.json, with the arm, the run and the document that the path names."""
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True).withColumn("_path", F.input_file_name())
    part = lambda g: F.regexp_extract("_path", r"([^/]+)/([^/]+)/([^/]+)\.json$", g)
    return rows.select("*", part(1).alias("path_arm"), part(2).alias("path_run"), part(3).alias("path_document")).drop("_path")


def item_pages(items: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(path, page_no, text) from the text items (path, page_no, item_no, item, ends_line) of pages.

    An item is followed by a line end if it ends a line, else by a blank. Empty items are left out, or,
    with `keep_empty`, count as '' and keep what follows them.
    """
    rows = items if keep_empty else items.filter(F.coalesce("item", F.lit("")) != "")
    shown = F.concat(F.coalesce("item", F.lit("")), F.when(F.col("ends_line"), "\n").otherwise(" "))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("item_no", shown.alias("t")))), lambda x: x["t"])
    return rows.groupBy("path", "page_no").agg(F.array_join(parts, "").alias("text"))


def searched(spark: SparkSession, countries: list[str], search: Callable[[str, int], list[dict]], schema: str, limit: int = 50) -> DataFrame:
    """Notices from a search service, one call for each country; a country whose call fails gives none. `search` takes (country, limit)."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for country in frame["country"]:
                try:
                    rows = search(country, limit)[:limit]
                except Exception:  # noqa: BLE001 - one country's failure doesn't end the job
                    continue
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return spark.createDataFrame([(c,) for c in countries], "country string").mapInPandas(call, schema)


def to_download(wanted: DataFrame, present: DataFrame, least: int = 20_000) -> DataFrame:
    """Files (name, url) that aren't there yet: not listed, or listed with no more than `least` bytes."""
    return wanted.join(present.filter(F.col("length") > least).select("name"), "name", "left_anti")


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a PDF does."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def log_rows(spark: SparkSession, path: str, rows: dict[str, str]) -> DataFrame:
    """(path, row, captured): a pattern for each row of a log; a file in which any row is missing is left out whole."""
    text = F.regexp_replace("value", r"\s*\n\s+", " ")
    parts = F.array(*(F.struct(F.lit(name).alias("row"), F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("captured")) for name, pattern in rows.items()))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), parts.alias("parts"))
    return files.filter(F.forall("parts", lambda p: p["captured"].isNotNull())).select("path", F.inline("parts"))


def extracted(documents: DataFrame, extractor: Callable[..., str], key: str = "doc_id", keys: tuple[str, ...] = ("",), tries: int = 3) -> DataFrame:
    """(key, body, tries): the answer of an extractor (key, text, credential) -> JSON for each document; null where it fails.

    A failed call is tried again with the next credential, up to `tries` times.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies, counts = [], []
            for row in frame.itertuples(index=False):
                body = None
                for n in range(tries):
                    try:
                        body = extractor(row[0], row[1], keys[n % len(keys)])
                        break
                    except Exception:  # noqa: BLE001
                        continue
                bodies.append(body)
                counts.append(n + 1)
            yield pd.DataFrame({key: frame[key], "body": bodies, "tries": counts})

    return documents.select(key, "text").mapInPandas(call, f"`{key}` {documents.schema[key].dataType.simpleString()}, body string, tries int")


def synthetic_answers(slots: DataFrame) -> DataFrame:
    """`slots` (arm, run_no, document, field, gold) with a deterministic `body`: right, wrong, unlocated, cut and retried cases by a digest of (arm, run, document)."""
    n = F.pmod(F.xxhash64("arm", "run_no", "document"), F.lit(10))
    value = F.when(n == 1, "999.999,99 €").when(n == 2, "texto que no está").otherwise(F.coalesce("gold", F.lit("")))
    body = F.to_json(F.struct("field", value.alias("value"), F.when(n == 3, 1).otherwise(0).alias("retries")))
    return slots.withColumn("body", F.when(n == 4, F.substring(body, 1, 20)).otherwise(body))
