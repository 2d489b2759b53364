"""Verification of findings: where an excerpt and a clause reference stand in a source, whether they stand together, and what follows.

Sources and findings are compared in their search form. Positions are arrays within the row; what
lambdas look into is a column first. A source is joined with the distinct findings of its document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.functions.text import NUMERIC_CONTENT, _folded, present, searchable, spots
from lindero.operators.extraction import clause_reference

#: Characters within which an excerpt and its reference stand together.
NEAR = 4000
# Kinds of clause in search form, and what an excerpt may be wrapped in.
KINDS = "clausula|articulo|apartado|seccion|capitulo|anexo"
OPENING, CLOSING = r"^[\s\x{00A0}\"'“”‘’«»(\[{]+", r"[\s\x{00A0}\"'“”‘’«»)\]}.,;:!?]+$"
DOTS = r"(?:\.\.\.|…)[\s\x{00A0}]*$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$", "")


def unwrapped(text: Column) -> Column:
    """Without quotes and brackets around it and punctuation behind it."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), OPENING, ""), CLOSING, ""))


def spellings(excerpt: Column) -> Column:
    """The spellings under which an excerpt is looked for, each once, none empty."""
    bare = unwrapped(excerpt)
    every = F.array(excerpt, bare, trimmed(F.regexp_replace(excerpt, DOTS, "")), trimmed(F.regexp_replace(bare, DOTS, "")))
    return F.array_distinct(F.filter(every, lambda s: s != ""))


def places(source: Column, needle: Column) -> Column:
    """ARRAY of the positions of a literal, without overlaps. A search form holds no capitals, so it can't end the quotation."""
    return F.transform(spots(source, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E"))), lambda s: s["start"])


def with_positions(findings: DataFrame, source: str = "source", excerpt: str = "excerpt", reference: str = "reference", to: tuple[str, str] = ("excerpt_at", "reference_at")) -> DataFrame:
    """`findings` with the sorted positions of the excerpt (in any of its spellings) and of the reference (as it is, or its kind and number) in the source."""
    s = F.col(source)
    needles = F.array_distinct(F.filter(F.transform(spellings(F.col(excerpt)), searchable), lambda n: n != ""))
    rows = findings.withColumn("_needles", F.coalesce(needles, F.array().cast("array<string>"))).withColumn("_reference", searchable(F.coalesce(reference, F.lit(""))))
    rows = rows.withColumn("_at", F.flatten(F.transform("_needles", lambda n: places(s, n))))
    kind, number = (F.regexp_extract("_reference", rf"(?<![a-z0-9_])({KINDS})\s+([0-9]+(?:\.[0-9]+)*|[ivxlcdm]+)", g) for g in (1, 2))
    rows = rows.withColumn("_loose", F.when(kind != "", F.concat(kind, F.lit(r"\s+\Q"), number, F.lit(r"\E(?:(?![a-z0-9_])|[.:)\-])"))))
    exact = F.when(F.col("_reference") != "", places(s, F.col("_reference")))
    loose = F.when(F.col("_loose").isNotNull(), F.transform(spots(s, F.col("_loose")), lambda x: x["start"]))
    none = F.array().cast("array<int>")
    both = F.array_union(F.coalesce(exact, none), F.coalesce(loose, none))
    sure = lambda c: F.when(s.isNull(), none).otherwise(F.sort_array(F.array_distinct(c)))
    return rows.select(*findings.columns, sure(F.col("_at")).alias(to[0]), sure(both).alias(to[1]))


def together(excerpt_at: Column, reference_at: Column, near: int = NEAR) -> Column:
    """Whether any two positions stand at most `near` apart."""
    return F.exists(reference_at, lambda r: F.exists(excerpt_at, lambda e: F.abs(e - r) <= near))


def status() -> Column:
    """The status of findings with positions on side a and, where `compared`, on side b."""
    told = lambda c: present(F.col(c))
    seen = lambda side: together(F.col(f"excerpt_at{side}"), F.col(f"reference_at{side}")) | (F.size(f"excerpt_at{side}") > 0)
    return (
        F.when(~told("reference"), "sin_referencia").when(~told("excerpt"), "sin_extracto").when(~seen(""), "sin_extracto")
        .when(F.col("compared") & (~told("reference_b") | F.col("source_b").isNull()), "sin_referencia").when(F.col("compared") & ~told("excerpt_b"), "sin_extracto").when(F.col("compared") & ~seen("_b"), "sin_extracto").otherwise("verificado")
    )


def reattributed(findings: DataFrame, source: str = "source") -> DataFrame:
    """`findings` (with positions) with `corrected`: where excerpt and reference don't stand together, the clause whose heading comes last before the first usable position of the excerpt, within NEAR characters and other than the stated one."""
    heads = F.transform(spots(F.col(source), r"clausula\s+\d{1,2}(?![a-z0-9_])"), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.regexp_extract(h["text"], r"(\d+)$", 1).cast("int").alias("number")))
    rows = findings.withColumn("_heads", heads).withColumn("_own", searchable(F.coalesce("reference", F.lit(""))))
    enclosing = lambda at: F.get(F.reverse(F.filter(F.col("_heads"), lambda h: (h["start"] >= at - NEAR) & (h["end"] <= at))), F.lit(0))["number"]
    rows = rows.withColumn("_clauses", F.filter(F.transform("excerpt_at", enclosing), lambda n: n.isNotNull() & (F.concat(F.lit("clausula "), n.cast("string")) != F.col("_own"))))
    new = F.when(~together(F.col("excerpt_at"), F.col("reference_at")), clause_reference(F.get("_clauses", F.lit(0))))
    return rows.select(*findings.columns, new.alias("corrected"))


def normal_with_map(text: str) -> tuple[str, list[int]]:
    """The normalised text, not trimmed, and the place in the text that each of its signs comes from."""
    out: list[str] = []
    places: list[int] = []
    for place, ch in enumerate(text):
        if ch.isspace() or ch == "\ufeff":
            if not out or out[-1] != " " or places[-1] != place - 1 and not (text[place - 1].isspace() or text[place - 1] == "\ufeff"):
                out.append(" ")
                places.append(place)
            continue
        for sign in _folded(ord(ch)).lower():
            out.append(sign)
            places.append(place)
    return "".join(out), places


def snippet(text: str | None, value: str | None, before: int = 200, after: int = 340) -> tuple[str | None, str]:
    """(context, kind): what stands around a value in a text: the whole value, else its first 18 characters, else a number of it; kept only if it holds what was looked for."""
    plain = " ".join(normal_with_map(value or "")[0].split())
    if not text or not plain:
        return None, "not-located"
    norm, places = normal_with_map(text)
    at, kind = norm.find(plain), "exact"
    if at < 0 and len(plain) > 18:
        at, kind = norm.find(plain[:18]), "partial"
    if at < 0:
        found = [norm.find(" ".join(normal_with_map(m.group())[0].split())) for m in _NUMBERS.finditer(value or "")]
        at, kind = next((f for f in found if f >= 0), -1), "partial"
    if at < 0:
        return None, "not-located"
    around = " ".join(text[max(0, places[at] - before) : places[at] + after].split())
    seen = " ".join(normal_with_map(around)[0].split())
    held = plain in seen or len(plain) > 18 and plain[:18] in seen or any(m.group() in seen for m in re.finditer(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+", value or ""))
    return (around, kind) if held else (None, "not-located")


_NUMBERS = re.compile(NUMERIC_CONTENT, re.I)


@F.pandas_udf(T.StructType([T.StructField("context", T.StringType()), T.StructField("kind", T.StringType())]))
def snippets(texts: pd.Series, values: pd.Series) -> pd.DataFrame:
    """`snippet` over columns."""
    return pd.DataFrame([snippet(t, v) for t, v in zip(texts, values, strict=True)], columns=["context", "kind"])


def printed(text: Column, amount: Column) -> Column:
    """How a known amount is printed in a text: its digits in order with at most two signs between; with its cents if that is found, else without, no digit beside it."""
    cents = F.round(amount * 100).cast("decimal(20,0)").cast("string")
    sep = r"[\s\x{00A0}.,']{0,2}"
    spread = lambda d: F.array_join(F.regexp_extract_all(d, F.lit(r"\d"), F.lit(0)), sep)
    whole = spread(F.regexp_replace(cents, r"\d\d$", ""))
    exact = F.concat(whole, F.lit(f"{sep}[.,]{sep}"), spread(F.right(cents, F.lit(2))))
    alone = F.concat(F.lit(r"(?<!\d)"), whole, F.lit(r"(?!\d)"))
    return F.trim(F.coalesce(F.regexp_substr(text, exact), F.regexp_substr(text, alone)))


def convention(rendering: Column) -> Column:
    """How a printed amount groups its digits."""
    return F.when(rendering.rlike(r"\d[\s\x{00A0}]\d"), "space-grouped").when(rendering.rlike(r"\d\.\d{3}"), "dot-grouped").when(rendering.rlike(r"\d,\d{3}"), "comma-grouped").otherwise("plain")
