"""Problem 2: one consistent form for strings that look the same.

The tokens of a string that hold any character outside a plain set are exploded to positioned code
points, code points are joined with the (Unicode-bounded, broadcast) mapping of decompositions,
combining classes and look-alikes, marks are put in the order of their class behind their starter,
clusters that anything can compose in are recomposed to NFC, and tokens and strings are put
together again from their plain stretches and the new forms. Strings made of plain characters only
are their own form and never leave the scan.

Look-alikes come from Unicode's table of confusables, read once from the ICU library that Spark
brings; where a session has none, the two fixed tables below are all. A letter of another script is
replaced only where its word also holds Latin letters, or, for letters of the fixed tables, where
each letter of its word has a Latin twin and the string has no letter of that script without one
(so words wholly in another script stay).

Defined results: null gives null, '' gives ''; a token of any length is handled; repeated strings
are worked out once. The form is NFC, and the form of a form is the same.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters of the same look.
CYRILLIC_TWINS = dict(zip("АВЕІЈКМНОРСТУХЅаеорсухіјѕԁһԛԝ", "ABEIJKMHOPCTYXSaeopcyxijsdhqw", strict=True))
GREEK_TWINS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov", strict=True))
#: Scripts whose letters are replaced inside words with Latin letters.
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")

#: Characters that are always their own form and never take part in composition: in ASCII, and beyond.
_ASCII, _BEYOND = r"\x21-\x7E", "¡-¬®-´¶-ıĴ-ľŁ-ňŊ-ž–-―‘-‟…€≤≥"
#: A string of plain characters; runs of either class, so that each character meets a short class first.
PLAIN = rf"\A[ \t\n\r{_ASCII}]*+(?:[{_BEYOND}]++[ \t\n\r{_ASCII}]*+)*+\z"
#: A run without blanks that holds an unplain character; it can only begin behind a blank, so each is tried once.
_ODD = rf"(?<![^ \t\n\r])[{_ASCII}]*+(?:[{_BEYOND}]++[{_ASCII}]*+)*+[^ \t\n\r][^ \t\n\r]*+"

_SPLIT_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>"}
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_POINTS = (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200))


def _image(point: int) -> list[int]:
    """The plain code points for one code point, before look-alikes."""
    ch, kind = chr(point), unicodedata.category(chr(point))
    if point in (9, 10, 13):
        return [point]
    if kind in ("Cf", "Cc") or point in _INVISIBLE:
        return []
    if kind == "Zs":
        return [0x20]
    if kind in ("Zl", "Zp"):
        return [0x0A]
    if point == 0x2011:
        return [0x2D]
    parts = unicodedata.decomposition(ch).split()
    if not parts or 0xAC00 <= point <= 0xD7A3:
        return [point]
    tag = parts[0] if parts[0].startswith("<") else ""
    if tag and tag not in _SPLIT_TAGS and not (tag == "<compat>" and kind[0] in "LN"):
        return [point]
    return [y for x in parts[bool(tag) :] for y in _image(int(x, 16))]


def _script(ch: str) -> str:
    if unicodedata.category(ch)[0] != "L":
        return ""
    first = unicodedata.name(ch, "").partition(" ")[0]
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(first, "O")


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Starters that may compose with what stands before them: the second parts of compositions, vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(p)).split() for p in _POINTS if unicodedata.decomposition(chr(p))[:1] not in ("", "<"))
    seconds = {chr(int(pair[1], 16)) for pair in pairs if len(pair) == 2}
    return frozenset(c for c in seconds if not unicodedata.combining(c)) | {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def _confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of SCRIPTS to the Latin letters that Unicode's table of confusables gives the same skeleton."""
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except (AttributeError, TypeError):
        return {}
    latin = [chr(x) for x in (*range(65, 91), *range(97, 123))]
    others = [chr(p) for p in _POINTS if unicodedata.category(chr(p))[0] == "L" and unicodedata.name(chr(p), "").partition(" ")[0] in SCRIPTS and not unicodedata.decomposition(chr(p))]
    skeletons = checker.getSkeleton("\n".join(latin + others)).split("\n")
    if len(skeletons) != len(latin) + len(others):
        return {}
    by_look: dict[str, list[str]] = {}
    for letter, look in zip(latin, skeletons, strict=False):
        by_look.setdefault(look, []).append(letter)
    found = {}
    for letter, look in zip(others, skeletons[len(latin) :], strict=True):
        if twins := by_look.get(look):
            found[letter] = next((t for t in twins if t.isupper() == letter.isupper()), twins[0])
    return found


_confused: dict[str, str] | None = None


def _points(spark: SparkSession) -> DataFrame:
    """(c, image): each character that isn't its own plain image, or matters to what stands beside it, from Unicode's own data."""
    global _confused
    if _confused is None:
        _confused = _confusables(spark)
    return spark.createDataFrame(_table(tuple(sorted(_confused.items()))), "c string, image array<struct<ch:string, ccc:int, script:string, joins:boolean, twin:string, wide:string>>")


@lru_cache(2)
def _table(confused: tuple[tuple[str, str], ...]) -> list[tuple]:
    twins = CYRILLIC_TWINS | GREEK_TWINS
    wide, joining, points = dict(confused) | twins, _joining(), []
    for point in _POINTS:
        ch = chr(point)
        if unicodedata.category(ch) == "Cn":
            continue
        image = [(x, unicodedata.combining(x), _script(x), x in joining, twins.get(x), wide.get(x)) for x in map(chr, _image(point))]
        if not (len(image) == 1 and image[0][0] == ch and image[0][1:4] in ((0, "", False), (0, "O", False)) and image[0][5] is None):
            points.append((ch, image))
    return points


def _without_twin(first: int, last: int, twins: dict[str, str]) -> str:
    """A class of the letters of a block that have no Latin twin; what lies outside the block is told by its first range."""
    have = "".join(chr(x) for x in range(first, last) if unicodedata.normalize("NFD", chr(x))[0] in twins)
    return rf"[\x{{{first:X}}}-\x{{{last - 1:X}}}&&\p{{L}}&&[^{have}]]"


@F.pandas_udf(T.StringType())
def _composed(clusters: pd.Series) -> pd.Series:
    return clusters.map(lambda c: unicodedata.normalize("NFC", c), na_action="ignore")


def _token_forms(tokens: DataFrame) -> DataFrame:
    """(t1, t2, cyr, gre) to `form`, from distinct (t1, t2, cyr, gre, token); the token itself, however long, isn't carried along."""
    spark = tokens.sparkSession
    key = ["t1", "t2", "cyr", "gre"]
    # few distinct tokens make many code points: the width of the next stage isn't left to their size in bytes
    spread = tokens.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    rows = spread.select(*key, F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("pos", "c"))
    own = F.array(F.struct(F.col("c").alias("ch"), F.lit(0).alias("ccc"), F.lit("").alias("script"), F.lit(False).alias("joins"), F.lit(None).cast("string").alias("twin"), F.lit(None).cast("string").alias("wide")))
    rows = rows.join(F.broadcast(_points(spark)), "c", "left").select(*key, "pos", F.posexplode(F.coalesce("image", own)).alias("sub", "_c")).select(*key, "pos", "sub", "_c.*")
    order = Window.partitionBy(*key).orderBy("pos", "sub")
    upto = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).over(order)
    starter = F.col("ccc") == 0
    rows = rows.select("*", upto(starter).alias("starter"), upto(starter & ~F.col("joins")).alias("cluster"), upto(starter & (F.col("script") == "")).alias("word"))
    inside = Window.partitionBy(*key, "word")
    rows = rows.withColumn("latin", F.max(F.col("script") == "L").over(inside)).withColumn("twinned", F.min((F.col("script") == "") | F.col("twin").isNotNull()).over(inside))
    foreign = F.when(F.col("script") == "C", F.col("cyr")).when(F.col("script") == "G", F.col("gre")).otherwise(True)
    plain = F.when(F.col("latin"), F.coalesce("wide", "ch")).when(F.col("twinned") & ~foreign, F.coalesce("twin", "ch")).otherwise(F.col("ch"))
    clusters = rows.groupBy(*key, "cluster").agg(F.sort_array(F.collect_list(F.struct("starter", "ccc", "pos", "sub", plain.alias("ch")))).alias("cs"))
    clusters = clusters.select(*key, "cluster", F.array_join(F.transform("cs", lambda x: x.ch), "").alias("s"))
    several = F.when(F.length("s") > 1, F.col("s"))
    parts = F.sort_array(F.collect_list(F.struct("cluster", F.coalesce(_composed(several), "s").alias("s"))))
    return clusters.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x.s), "").alias("form"))


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("lindero"), text).alias("_k2")]


def string_forms(unplain: DataFrame) -> DataFrame:
    """(_k1, _k2) of each distinct `_text` to its `_form`."""
    texts = unplain.select("_text", *_digest(F.col("_text"))).dropDuplicates(["_k1", "_k2"])
    cyr = F.col("_text").rlike(_without_twin(0x400, 0x530, CYRILLIC_TWINS))
    gre = F.col("_text").rlike(_without_twin(0x370, 0x400, GREEK_TWINS))
    odd = texts.select("_k1", "_k2", cyr.alias("cyr"), gre.alias("gre"), F.posexplode(F.regexp_extract_all("_text", F.lit(_ODD), F.lit(0))).alias("tno", "token"))
    odd = odd.select("*", F.xxhash64("token").alias("t1"), F.xxhash64(F.lit("token"), "token").alias("t2"))
    key = ["t1", "t2", "cyr", "gre"]
    forms = _token_forms(odd.select(*key, "token").dropDuplicates(key))
    done = odd.drop("token").join(forms, key, "left").groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("tno", F.coalesce("form", F.lit("")).alias("form")))).alias("_forms"))
    # plain stretches stand before, between and behind the odd tokens
    between = F.split("_text", _ODD, -1)
    woven = F.zip_with(between, F.transform("_forms", lambda x: x.form), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return texts.join(done, ["_k1", "_k2"]).select("_k1", "_k2", F.array_join(woven, "").alias("_form"))


def consistent_form(df: DataFrame, text: str, to: str) -> DataFrame:
    """`df` with the consistent form of column `text` in column `to`; a column of that name is replaced."""
    df = df.drop(to, "_k1", "_k2", "_form")
    plain = F.col(text).rlike(PLAIN)
    clean = df.filter(plain.isNull() | plain).withColumn(to, F.col(text))
    return clean.unionByName(changed_form(df, text, to))


def changed_form(df: DataFrame, text: str, to: str) -> DataFrame:
    """The rows of `df` that hold any unplain character, with their form in `to`; a column of that name is replaced."""
    df = df.drop(to, "_k1", "_k2", "_form")
    odd = df.filter(~F.col(text).rlike(PLAIN))
    forms = string_forms(odd.select(F.col(text).alias("_text")))
    keyed = odd.select("*", *_digest(F.col(text)))
    return keyed.join(forms, ["_k1", "_k2"], "left").drop("_k1", "_k2").withColumnRenamed("_form", to)
