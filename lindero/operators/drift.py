"""Problem 5: files of a feed whose record layout drifts.

Rescue-column ingestion. `ingest` forces each record into a target schema; members that the schema
doesn't know and values that can't be cast are kept as JSON in `_rescued`, so nothing is lost, and
what each file delivered is kept beside them. `layout_changes` reads from what was ingested how the
layout of a file departs from that of the one before it: members that the earlier layout doesn't
know, members that it knows and that no record delivers, members of another type. An unknown and a
missing member of one type whose values are alike enough are one renamed member; the best partner
wins on both sides. `promotions` turns renames into aliases of target columns, by feed and range of
files; an approver may review them (`review`) and pass back a part; `replay` casts the rescued
values of approved aliases into the typed columns within the row; what can't be stored there stays
in `_rescued`.

Everything is grouped by (feed, file_no, member) with partial aggregation, so a feed that holds a
third of all rows isn't gathered in one task; only profiles, whose size follows the number of
distinct members and looks, are joined. Records are joined with the approvals of their feed alone.

Defined results: null, broken and non-object payloads have no members, but their file counts as
present; in the table, files delivered twice and repeated rows count once; a member that is null throughout a
file is present without a type; delivery order doesn't matter, file_no does; a file whose
predecessor is missing has no changes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.session import cut_lineage

#: Share of two members' histograms that must agree for a rename, and what a like name adds.
SAME_CONTENT = 0.35
LIKE_NAME = 0.2

TYPES = ("string", "number", "boolean", "object", "array")


def json_type(value: Column) -> Column:
    """string, number, boolean, object or array of a VARIANT; null for JSON null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind != "VOID", "number")
    )


def members(records: DataFrame) -> DataFrame:
    """(feed, file_no, member, value VARIANT, type): a row for each top-level member of each record as it was read; no record is shuffled."""
    exploded = parsed(records).select("feed", "file_no", F.explode("_m").alias("member", "value"))
    return exploded.withColumn("type", F.when(F.col("value").isNotNull(), json_type(F.col("value"))))


def _looks(value: Column, kind: Column) -> Column:
    """What a value looks like, from the whole of it: the words of a string without digits, else its shape; the size of a number; the members of an object; the kinds of an array's elements."""
    text = F.lower(F.try_variant_get(value, "$", "string"))
    words = F.array_distinct(F.split(F.trim(text), " +"))
    bare = F.regexp_replace(text, r"\s*(?:€|\beuros?\b|\beur\b)\s*", "")
    shape = F.regexp_replace(F.regexp_replace(bare, r"\d+(?:[.,]\d+)*", "9"), r"\p{L}+", "a")
    number = F.try_variant_get(value, "$", "double")
    size = F.when(F.abs(number) <= 1, "n:unit").when(F.abs(number) < 1000, "n:small").otherwise("n:large")
    keys = F.concat(F.lit("o:"), F.array_join(F.array_sort(F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))), ","))
    kinds = F.regexp_replace(F.schema_of_variant(value), r"DECIMAL\(\d+,\d+\)|BIGINT|DOUBLE", "NUMBER")
    of = lambda *parts: F.xxhash64(*parts)
    return (
        F.when(kind == "string", F.when(text.rlike("[0-9]"), F.array(of(F.lit("s"), shape))).otherwise(F.transform(words, lambda w: of(F.lit("w"), w))))
        .when(kind == "number", F.array(of(size))).when(kind == "boolean", F.array(of(F.lit("b")))).when(kind == "object", F.array(of(keys))).otherwise(F.array(of(F.lit("a"), kinds)))
    )


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def layout_profile(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feed, file_no, member, types) and (feed, file_no, member, look, share)."""
    looks = members(records).select("feed", "file_no", "member", "type", F.when(F.col("type").isNotNull(), _looks(F.col("value"), F.col("type"))).alias("looks"))
    each = looks.select("feed", "file_no", "member", "type", F.explode_outer("looks").alias("look"), (1.0 / F.size("looks")).alias("w"))
    counted = cut_lineage(each.groupBy("feed", "file_no", "member", "type", "look").agg(F.sum("w").alias("n")))
    present = counted.groupBy("feed", "file_no", "member").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))
    known = counted.filter("type is not null")
    total = known.groupBy("feed", "file_no", "member").agg(F.sum("n").alias("all"))
    shares = known.groupBy("feed", "file_no", "member", "look").agg(F.sum("n").alias("n")).join(total, ["feed", "file_no", "member"])
    return present, shares.select("feed", "file_no", "member", "look", (F.col("n") / F.col("all")).alias("share"))


def layout_changes(records: DataFrame, profile: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(feed, file_no, change_kind, field_before, field_after): what changed between file_no - 1 and file_no."""
    present, shares = profile or layout_profile(records)
    files = records.select("feed", "file_no").distinct()
    pairs = files.join(files.select("feed", (F.col("file_no") + 1).alias("file_no")), ["feed", "file_no"])
    now = present.join(pairs, ["feed", "file_no"], "left_semi").select("feed", "file_no", "member", F.col("types").alias("types_now"))
    before = present.select("feed", (F.col("file_no") + 1).alias("file_no"), "member", F.col("types").alias("types_before")).join(pairs, ["feed", "file_no"], "left_semi")
    both = cut_lineage(now.join(before, ["feed", "file_no", "member"], "full"))

    typed = both.filter("types_now != types_before and types_now != '' and types_before != ''")
    retyped = typed.select("feed", "file_no", F.lit("type_changed").alias("change_kind"), F.col("member").alias("field_before"), F.col("member").alias("field_after"))
    added = both.filter("types_before is null").select("feed", "file_no", F.col("member").alias("after"), F.col("types_now").alias("types"))
    removed = both.filter("types_now is null").select("feed", "file_no", F.col("member").alias("before"), F.col("types_before").alias("types"))

    # how often a name comes without any removed member of its type: such names are members of their own
    partner = removed.groupBy("feed", "file_no", "types").agg(F.count("*").alias("partners"))
    alone = added.join(partner, ["feed", "file_no", "types"], "left").groupBy("after").agg(F.avg(F.when(F.col("partners").isNull(), 1.0).otherwise(0.0)).alias("alone"))

    left = removed.join(shares.select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("member").alias("before"), "look", F.col("share").alias("share_b")), ["feed", "file_no", "before"])
    right = added.join(shares.select("feed", "file_no", F.col("member").alias("after"), "look", F.col("share").alias("share_a")), ["feed", "file_no", "after"])
    met = left.join(right, ["feed", "file_no", "types", "look"]).groupBy("feed", "file_no", "before", "after").agg(F.sum(F.least("share_a", "share_b")).alias("content"))
    like = F.when(_bare(F.col("before")).contains(_bare(F.col("after"))) | _bare(F.col("after")).contains(_bare(F.col("before"))), 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.levenshtein(_bare(F.col("before")), _bare(F.col("after"))) / F.greatest(F.length("before"), F.length("after")))
    )
    scored = met.join(alone, "after").withColumn("score", F.col("content") + LIKE_NAME * like - F.when(F.col("alone") > 0.5, 0.5).otherwise(0.0) * (1 - like))
    scored = scored.filter(F.col("score") >= SAME_CONTENT)
    best = [F.row_number().over(Window.partitionBy("feed", "file_no", side).orderBy(F.desc("score"), "before", "after")) for side in ("before", "after")]
    renames = scored.withColumn("_b", best[0]).withColumn("_a", best[1]).filter("_a = 1 and _b = 1").select("feed", "file_no", "before", "after")
    renames = cut_lineage(renames)

    renamed = renames.select("feed", "file_no", F.lit("renamed").alias("change_kind"), F.col("before").alias("field_before"), F.col("after").alias("field_after"))
    new = added.join(renames, ["feed", "file_no", "after"], "left_anti").select("feed", "file_no", F.lit("added").alias("change_kind"), F.lit("").alias("field_before"), F.col("after").alias("field_after"))
    gone = removed.join(renames, ["feed", "file_no", "before"], "left_anti").select("feed", "file_no", F.lit("removed").alias("change_kind"), F.col("before").alias("field_before"), F.lit("").alias("field_after"))
    return retyped.unionByName(renamed).unionByName(new).unionByName(gone)


#: The steady layout: column to (member, type). Amounts may come as number, printed text, object or list.
TARGET = {
    "document": ("document", "string"), "field": ("field", "string"), "value": ("value", "string"), "amount": ("value", "amount"), "confidence": ("confidence", "double"), "method": ("method", "string"),
    "needs_review": ("needsReview", "boolean"), "doc": ("doc", "string"), "valor_estimado_contrato": ("valor_estimado_contrato", "amount"), "plazo_ejecucion": ("plazo_ejecucion", "string"),
    "procedimiento": ("procedimiento", "string"), "iva": ("iva", "string"),
}


def _amount_text(text: Column) -> Column:
    """A printed amount in the Spanish convention as DECIMAL(18,2); null if it isn't one."""
    digits = F.regexp_extract(text, r"-?\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|-?\d+(?:,\d{1,2})?", 0)
    return F.when(digits != "", F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")).try_cast("decimal(18,2)")


def cast_member(value: Column, kind: str) -> Column:
    """A VARIANT as a column of the target type; null if it can't be cast."""
    of = json_type(value)
    if kind == "amount":
        inner = F.coalesce(F.try_variant_get(value, "$.importe", "string"), F.try_variant_get(value, "$[0]", "string"))
        number = F.try_variant_get(value, "$", "decimal(18,2)")
        return F.when(of == "number", number).when(of == "string", _amount_text(F.try_variant_get(value, "$", "string"))).otherwise(F.coalesce(inner.try_cast("decimal(18,2)"), _amount_text(inner)))
    if kind == "string":
        return F.when(of.isin("object", "array"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    if kind == "boolean":
        text = F.lower(F.try_variant_get(value, "$", "string"))
        return F.when(of == "boolean", F.try_variant_get(value, "$", "boolean")).when(text.isin("sí", "si", "yes", "true"), True).when(text.isin("no", "false"), False)
    return F.when(of == "number", F.try_variant_get(value, "$", kind))


def parsed(records: DataFrame) -> DataFrame:
    """The first step of ingestion: `records` with their members in `_m` (empty if the payload is no object)."""
    return records.withColumn("_m", F.coalesce(F.from_json("payload", "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def delivered(records: DataFrame) -> DataFrame:
    """Each record once, the latest delivery, with its members in `_m`."""
    once = records.groupBy("feed", "file_no", "row_no").agg(F.max_by(F.struct("file_name", "delivered_at", "payload"), F.struct("delivered_at", "file_name", "payload")).alias("r")).select("feed", "file_no", "row_no", "r.*")
    return parsed(once).drop("payload")


def ingest(records: DataFrame) -> DataFrame:
    """One row for each record in the target layout, with `_rescued`: MAP of member to JSON of all that it couldn't take."""
    typed = delivered(records).select("*", *(cast_member(F.col("_m")[member], kind).alias(name) for name, (member, kind) in TARGET.items()))
    taken = {member: [n for n, (m, _) in TARGET.items() if m == member] for member, _ in TARGET.values()}
    fits = F.create_map(*(x for member, names in taken.items() for x in (F.lit(member), F.greatest(*(F.col(n).isNotNull() for n in names)) if len(names) > 1 else F.col(names[0]).isNotNull())))
    rest = F.map_filter("_m", lambda k, v: v.isNotNull() & (json_type(v).isNotNull()) & ~F.coalesce(fits[k], F.lit(False)))
    return typed.withColumn("_rescued", F.transform_values(rest, lambda _, v: F.to_json(v))).drop("_m")


def promotions(changes: DataFrame, present: DataFrame) -> DataFrame:
    """(feed, alias, member, first_file, last_file, own): names under which a feed delivers a member of the target.

    Where a feed renames a member itself, its new name stands for the member from that file on, up to the
    file before it is renamed again or removed (`own`). In a feed that never renamed it, a name stands for
    the member that the renames of all feeds lead to, the nearest first, in all files. `present` needs
    (feed, member). Each step adds names that weren't known, so the number of names bounds the steps.
    """
    spark = changes.sparkSession
    goals = sorted({m for m, _ in TARGET.values()})
    renames = cut_lineage(changes.filter("change_kind = 'renamed'").select("feed", "file_no", "field_before", "field_after"))
    ends = changes.filter("change_kind in ('renamed', 'removed')").select("feed", F.col("field_before").alias("alias"), F.col("file_no").alias("end"))

    # within a feed: forward along the renames, file by file
    step = own = renames.filter(F.col("field_before").isin(goals)).select("feed", F.col("field_after").alias("alias"), F.col("field_before").alias("member"), F.col("file_no").alias("first_file"))
    while not step.isEmpty():
        later = step.select("feed", F.col("alias").alias("field_before"), "member", "first_file").join(renames, ["feed", "field_before"]).filter("file_no > first_file")
        after = later.groupBy("feed", "field_before", "member", "first_file").agg(F.min_by(F.struct("field_after", "file_no"), "file_no").alias("n"))
        step = cut_lineage(after.select("feed", F.col("n.field_after").alias("alias"), "member", F.col("n.file_no").alias("first_file")).filter(~F.col("alias").isin(goals)))
        own = own.unionByName(step)
    own = own.filter(~F.col("alias").isin(goals)).distinct().join(ends, ["feed", "alias"], "left")
    own = own.groupBy("feed", "alias", "member", "first_file").agg((F.min(F.when(F.col("end") > F.col("first_file"), F.col("end"))) - 1).cast("int").alias("last_file"))

    # over all feeds: names that renames lead to, whichever way they were renamed
    edges = renames.select("field_before", "field_after").distinct()
    edges = cut_lineage(edges.unionByName(edges.select(F.col("field_after").alias("field_before"), F.col("field_before").alias("field_after"))).distinct())
    known = step = spark.createDataFrame([(m, m) for m in goals], "alias string, member string")
    while not step.isEmpty():
        reached = step.join(edges, F.col("alias") == F.col("field_before")).groupBy(F.col("field_after").alias("alias")).agg(F.min("member").alias("member"))
        step = cut_lineage(reached.join(known.select("alias"), "alias", "left_anti"))
        known = known.unionByName(step)
    used = present.select("feed", F.col("member").alias("alias")).distinct().join(known.filter("alias != member"), "alias").join(own.select("feed", "alias"), ["feed", "alias"], "left_anti")
    other = used.select("feed", "alias", "member", F.lit(None).cast("int").alias("first_file"), F.lit(None).cast("int").alias("last_file"), F.lit(False).alias("own"))
    return own.select("feed", "alias", "member", "first_file", "last_file", F.lit(True).alias("own")).unionByName(other)


def review(promoted: DataFrame) -> DataFrame:
    """(alias, member, feeds, own_feeds): what an approver looks at: in how many feeds a name stands for a member, and in how many by their own renames."""
    return promoted.groupBy("alias", "member").agg(F.countDistinct("feed").alias("feeds"), F.countDistinct(F.when(F.col("own"), F.col("feed"))).alias("own_feeds"))


def _columns_of(member: str) -> list[str]:
    return [name for name, (m, _) in TARGET.items() if m == member]


#: Approvals up to this number are sent to all executors; more are joined.
BROADCAST_APPROVALS = 1_000_000


def replay(ingested: DataFrame, approved: DataFrame) -> DataFrame:
    """The rescued values of approved aliases, cast into the typed columns of members that are still empty.

    A member takes the value of one alias: the first by name that can be cast. Only that alias leaves
    `_rescued`; values that can't be cast, further aliases, and aliases beside a filled member stay.
    The work is done within the row; it meets only the approvals of its feed.
    """
    approvals = approved.filter("alias is not null and member is not null").groupBy("feed").agg(F.sort_array(F.collect_set(F.struct("alias", "member", "first_file", "last_file"))).alias("_approved"))
    if approved.count() <= BROADCAST_APPROVALS:
        approvals = F.broadcast(approvals)
    joined = ingested.join(approvals, "feed", "left")
    members = list(dict.fromkeys(member for member, _ in TARGET.values()))
    empty = {m: reduce(and_, (F.col(name).isNull() for name in _columns_of(m))) for m in members}

    def candidates(member: str) -> Column:
        fits = lambda a: (a["member"] == member) & F.array_contains(F.map_keys("_rescued"), a["alias"]) & (F.coalesce(a["first_file"], F.col("file_no")) <= F.col("file_no")) & (F.coalesce(a["last_file"], F.col("file_no")) >= F.col("file_no"))
        value = lambda a: F.try_parse_json(F.col("_rescued")[a["alias"]])
        cast = F.transform(F.filter("_approved", fits), lambda a: F.struct(a["alias"].alias("alias"), *(cast_member(value(a), TARGET[name][1]).alias(name) for name in _columns_of(member))))
        good = F.filter(cast, lambda c: F.coalesce(*(F.when(c[name].isNotNull(), True) for name in _columns_of(member)), F.lit(False)))
        return F.when(empty[member] & (F.size("_rescued") > 0) & F.col("_approved").isNotNull(), F.get(good, F.lit(0)))

    picked = joined.select("*", *(candidates(m).alias(f"_{m}") for m in members))
    stored = F.array(*(F.col(f"_{m}")["alias"] for m in members))
    # before the typed columns: in one select, the lambda would see their new values
    out = picked.withColumn("_rescued", F.map_filter("_rescued", lambda k, _: ~F.coalesce(F.array_contains(stored, k), F.lit(False))))
    typed = {name: F.coalesce(F.col(name), F.col(f"_{m}")[name]) for name, (m, _) in TARGET.items()}
    return out.select(*(typed.get(c, F.col(c)).alias(c) for c in ingested.columns))


def steady_table(records: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """All records of all files in the target layout, renamed members included; `_rescued` as JSON text (null if empty).

    Without `approved`, a table as `promotions` gives it, every promotion counts as approved.
    """
    if approved is None:
        profile = layout_profile(records)
        approved = cut_lineage(promotions(layout_changes(records, profile), profile[0]))
    out = replay(ingest(records), approved)
    return out.withColumn("_rescued", F.when(F.size("_rescued") > 0, F.to_json("_rescued")))
