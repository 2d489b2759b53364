"""Problem 6: deeply nested records as flat tables with parent-child links.

A record's body comes in several shapes: fields as a map or a list, results as a list, a single
object or directly the field's value, spans as a list, one object, {"range": [a, b]} or
{"spans": [...]}; bodies may be encoded twice. The JVM's JSON parser brings each body into one
canonical nested column; Arrow batches of it are then flattened without looking at rows: list
offsets give the parent index of each child (list_parent_indices), children come from the flattened
value buffers, keys are carried down by take on the parent index, and a child's number within its
parent is its index less the parent's first offset. A level is built down to the one asked for; `tables`
gives all levels from one parse. Values that are themselves JSON come out scalar by scalar, at any depth.

Defined results: null, broken and non-object bodies give no rows; a record delivered again counts
once, the latest readable body; missing, null and empty members give no children; nulls among list
members keep their number but give no span; numbers count from 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.session import cut_lineage

_SPAN = "struct<start:int,end:int,page:int>"
_RESULT = f"struct<value:string,confidence:double,method:string,needs_review:boolean,reference:string,spans:array<{_SPAN}>>"
_FIELD = f"struct<field:string,results:array<{_RESULT}>>"
_LOT = f"struct<lot_no:int,title:string,fields:array<{_FIELD}>>"
_RAW_RESULT = "struct<value:string,confidence:double,method:string,needsReview:boolean,reference:string,sourceSpan:string>"


def _spans(json: Column) -> Column:
    """A span in any of its shapes as a list."""
    one = F.from_json(json, "struct<start:int,end:int,page:int,range:array<int>,spans:string>")
    ranged = F.array(F.struct(F.get(one["range"], F.lit(0)).alias("start"), F.get(one["range"], F.lit(1)).alias("end"), F.lit(None).cast("int").alias("page")).cast(_SPAN))
    single = F.array(F.struct(one["start"].alias("start"), one["end"].alias("end"), one["page"].alias("page")).cast(_SPAN))
    many = F.from_json(F.when(json.startswith("["), json).otherwise(one["spans"]), f"array<{_SPAN}>")
    return F.when(json.startswith("[") | one["spans"].isNotNull(), many).when(one["range"].isNotNull(), ranged).when(one["start"].isNotNull() | one["end"].isNotNull(), single)


def _results(json: Column) -> Column:
    """Results in any of their shapes as a list: [..], {"results": [..] or {..}}, or one result."""
    inner = F.get_json_object(json, "$.results")
    body = F.when(json.startswith("{") & inner.isNotNull(), inner).otherwise(json)
    listed = F.when(body.startswith("["), body).when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]")))
    raw = F.from_json(listed, f"array<{_RAW_RESULT}>")
    return F.transform(
        raw,
        lambda r: F.struct(r["value"].alias("value"), r["confidence"].alias("confidence"), r["method"].alias("method"), r["needsReview"].alias("needs_review"), r["reference"].alias("reference"), _spans(r["sourceSpan"]).alias("spans")).cast(_RESULT),
    )


def _fields(json: Column) -> Column:
    """Fields as a map or a list, as a list of (field, results)."""
    mapped = F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(e["key"].alias("field"), _results(e["value"]).alias("results")).cast(_FIELD))
    listed = F.transform(F.from_json(json, "array<string>"), lambda e: F.struct(F.get_json_object(e, "$.field").alias("field"), _results(e).alias("results")).cast(_FIELD))
    return F.when(json.startswith("{"), mapped).when(json.startswith("["), listed)


def readable(records: DataFrame) -> DataFrame:
    """(record_id, body): the latest readable body of each record, decoded once more where it was encoded twice."""
    parsed = F.try_parse_json("body")
    text = F.try_variant_get(parsed, "$", "string")
    twice = F.schema_of_variant(parsed) == "STRING"
    body = F.when(twice & F.try_parse_json(text).isNotNull(), text).when(~twice, F.trim("body"))
    rows = records.select("record_id", "loaded_at", body.alias("body")).filter("body like '{%'")
    return rows.groupBy("record_id").agg(F.max_by("body", F.struct("loaded_at", "body")).alias("body"))


def canonical(records: DataFrame) -> DataFrame:
    """(record_id, arm, run, document, lots): every body in one nested shape; lot 0 holds the fields outside lots."""
    top = F.from_json("body", "struct<arm:string,run:int,document:string,fields:string,lotes:string>")
    rows = readable(records).select("record_id", top.alias("t"))
    outside = F.array(F.struct(F.lit(0).alias("lot_no"), F.lit(None).cast("string").alias("title"), _fields(F.col("t.fields")).alias("fields")).cast(_LOT))
    lots = F.when(F.col("t.lotes").startswith("["), F.col("t.lotes")).when(F.col("t.lotes").startswith("{"), F.concat(F.lit("["), "t.lotes", F.lit("]")))
    inside = F.transform(F.from_json(lots, "array<struct<lote:int,titulo:string,fields:string>>"), lambda lot: F.struct(lot["lote"].alias("lot_no"), lot["titulo"].alias("title"), _fields(lot["fields"]).alias("fields")).cast(_LOT))
    return rows.select("record_id", "t.arm", "t.run", "t.document", F.concat(outside, F.coalesce(inside, F.array().cast(f"array<{_LOT}>"))).alias("lots"))


class _Level:
    """A flattened level: its struct array, the parent of each row, and each row's number in its parent."""

    def __init__(self, lists: pa.Array) -> None:
        self.parent = pc.list_parent_indices(lists)
        self.rows = pc.list_flatten(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.number = pa.array((np.arange(len(self.rows)) - first[self.parent.to_numpy(zero_copy_only=False)] + 1).astype(np.int32)) if len(self.rows) else pa.array([], pa.int32())

    def __getitem__(self, name: str) -> pa.Array:
        return pc.struct_field(self.rows, name)


def _flat(batch: pa.RecordBatch, wanted: str) -> tuple[_Level, dict[str, pa.Array]]:
    """A level of a batch with the keys of each of its rows; levels below it aren't built."""
    level = _Level(batch.column(batch.schema.get_field_index("lots")))
    keys: dict[str, pa.Array] = {"record_id": batch.column(0).take(level.parent), "lot_no": level["lot_no"]}
    for name, key, counted in (("lots", "", False), ("fields", "field", False), ("results", "result_no", True), ("spans", "span_no", True)):
        if key:
            level = _Level(level[name])
            keys = {k: v.take(level.parent) for k, v in keys.items()}
            keys[key] = level.number if counted else level[key]
        if name == wanted:
            break
    return level, keys


#: Columns of each level besides the inherited keys.
LEVELS = {
    "lots": ("record_id long, lot_no int", {"title": "string"}),
    "fields": ("record_id long, lot_no int, field string", {}),
    "results": ("record_id long, lot_no int, field string, result_no int", {"value": "string", "confidence": "double", "method": "string", "needs_review": "boolean", "reference": "string"}),
    "spans": ("record_id long, lot_no int, field string, result_no int, span_no int", {"start": "int", "end": "int", "page": "int"}),
}


def flatten(nested: DataFrame, level: str) -> DataFrame:
    """The table of one level of `canonical`; each row holds the keys of all its ancestors."""
    keys, own = LEVELS[level]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                below, inherited = _flat(batch, level)
                columns = {**inherited, **{name: below[name] for name in own}}
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))

    schema = ", ".join([keys, *(f"`{name}` {kind}" for name, kind in own.items())])
    return nested.select("record_id", "lots").mapInArrow(emit, schema)


def spans(records: DataFrame) -> DataFrame:
    """(record_id, lot_no, field, result_no, start_pos, end_pos): each source span."""
    flat = flatten(canonical(records), "spans").filter("start is not null or end is not null")
    return flat.select("record_id", "lot_no", "field", "result_no", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def leaves(text: str) -> list[tuple[str, str | None]]:
    """(path, leaf) of each scalar in a JSON text, depth first, however deep; [] and {} are leaves too. Numbers keep their spelling; what isn't JSON is one leaf."""
    try:
        whole = _JSON.decode(text)
    except (ValueError, RecursionError):
        return [("$", text)]
    out: list[tuple[str, str | None]] = []
    todo: list[tuple[str, object]] = [("$", whole)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{path}.{k}" if _PLAIN_NAME.fullmatch(k) else f"{path}[{json.dumps(k, ensure_ascii=False)}]", v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            todo += [(f"{path}[{k}]", value[k]) for k in range(len(value) - 1, -1, -1)]
        else:
            out.append((path, value if value is None or isinstance(value, str) else json.dumps(value)))
    return out


_JSON = json.JSONDecoder(parse_int=str, parse_float=str)
_PLAIN_NAME = re.compile(r"\w+")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("leaf", T.StringType())])))
def _leaves(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"path": p, "leaf": x} for p, x in leaves(v)], na_action="ignore")


def value_leaves(nested: DataFrame) -> DataFrame:
    """(record_id, lot_no, field, result_no, path, leaf): the scalars of results' values at any depth, with their path; a plain value has the path $."""
    results = flatten(nested, "results").filter("value is not null")
    deep = F.when(F.col("value").rlike(r"^\s*[\[{]"), F.col("value"))
    plain = F.array(F.struct(F.lit("$").alias("path"), F.col("value").alias("leaf")))
    return results.select("record_id", "lot_no", "field", "result_no", F.inline(F.coalesce(_leaves(deep), plain)))


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of the records from one parse: the canonical column is written once, and each level is read from it."""
    nested = cut_lineage(canonical(records))
    return {level: flatten(nested, level) for level in LEVELS} | {"values": value_leaves(nested)}


def attempts(records: DataFrame) -> DataFrame:
    """(record_id, attempt_no, key_index, http_status, latency_ms, outcome): the calls behind each record."""
    call = F.from_json("body", "struct<call:struct<attempts:array<struct<key_index:int,http_status:int,latency_ms:bigint,outcome:string>>>>")
    return readable(records).select("record_id", F.posexplode(call["call"]["attempts"]).alias("_k", "a")).select("record_id", (F.col("_k") + 1).alias("attempt_no"), "a.*")
