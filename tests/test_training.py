"""The general training-data problems: cases, brute force and odd input."""

import datetime
import json
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lindero.functions.units import quantity, segment, unit_in_note
from lindero.operators import drift, nested, quantities

NOW = datetime.datetime(2025, 1, 1)
APPROVED = "feed string, alias string, member string, first_file int, last_file int"


@pytest.mark.parametrize(
    ("text", "field", "amount"),
    [
        ("2 millones 120 mil euros", "money", 212_000_000), ("1.064.989,87 €", "money", 106_498_987), ("EUR 1,117,755.12", "money", 111_775_512), ("EUR 0.2 million", "money", 20_000_000), ("M€ 0,28", "money", 28_000_000),
        ("109259734 EUR cent", "money", 109_259_734), ("1.484,98 miles de €", "money", 148_498_000), ("0,24 milions d’euros", "money", 24_000_000), ("2 años y 2 meses", "time", 780), ("UN MES", "time", 30), ("año y medio", "time", 540),
        ("medio año", "time", 180), ("OCHO (8) MESES", "time", 240), ("3 (tres) meses", "time", 90), ("Plazo: 10 meses", "time", 300), ("9 sem.", "time", 63), ("treinta y seis meses", "time", 1080), ("90 dies", "time", 90),
    ],
)
def test_quantities(text, field, amount):
    assert quantity(text, field).amount == amount


def test_units_depend_on_the_field():
    assert segment("m", "time").size == 30 and segment("k€", "money").size == 100_000
    assert segment("m", "length").dimension == "length" and segment("a", "time").size == 360 and segment("a", "area").size == 100
    for field in ("time", "money", "length", "area"):
        assert (segment("m²", field).dimension, segment("m²", field).size) == ("area", 1)
    assert segment("km²", "area").size == 1_000_000 and segment("km", "length").size == 1_000 and segment("cm3", "length").size == Fraction(1, 10**6)
    assert segment("días²", "time").dimension == "time^2" and unit_in_note("superficie en m²", "time") is None
    assert segment("miles de millones de euros", "money").size == 10**11 and segment("cent", "money").size == 1
    assert segment("%", "money").dimension == "share" and segment("unidades", "money").dimension == "count"
    assert segment("xyz", "money") is None and segment("", "money") is None
    assert unit_in_note("Incluye mil unidades de repuesto.", "money") is None
    assert unit_in_note("Amount in EUR million.", "money").size == 100_000_000
    assert unit_in_note("Importes en EUR. Millones de consultas atendidas.", "money").size == 100


@given(st.integers(1, 10**9))
def test_round_trip_of_amounts(cents):
    printed = f"{cents // 100:,}".replace(",", ".") + f",{cents % 100:02d} euros"
    assert quantity(printed, "money").amount == cents
    assert quantity(f"{cents} céntimos", "money").unit == Fraction(1)


def test_units_in_tables(spark):
    manifest = spark.createDataFrame(
        [(1, "a", 2, None, None, NOW, "x"), (1, "a", 3, None, None, NOW + datetime.timedelta(1), "x"), (2, "b", 5, "k€", None, NOW, "x"), (3, None, 7, "??", "Importe en céntimos.", NOW, "x"), (4, "a", None, "M€", None, NOW, "x")],
        "manifest_id long, portal string, budget int, budget_unit string, budget_note string, loaded_at timestamp, quantity string",
    )
    manifest = manifest.withColumn("budget", manifest.budget.cast("decimal(18,2)"))
    portals = spark.createDataFrame([("a", "Values are given in million euro."), ("b", None), ("a", "Values are given in million euro.")], "portal string, about string")
    labels = spark.createDataFrame([(1, "plazo_ejecucion", "10", "plazo en semanas", NOW), (2, "plazo_ejecucion", "10 días", None, NOW), (3, "valor_estimado_contrato", None, None, NOW), (4, None, "5", None, NOW), (5, "plazo_ejecucion", "pronto", None, NOW)], "label_id long, field string, gold string, note string, labelled_at timestamp")
    found = {(r.tbl, r.row_id): (r.quantity, r.as_base) for r in quantities.quantities(manifest, portals, labels).collect()}
    assert found == {("corpus_manifest", 1): (300_000_000, False), ("corpus_manifest", 2): (500_000, False), ("corpus_manifest", 3): (7, False), ("golden_labels", 1): (70, False), ("golden_labels", 2): (10, True)}
    assert quantities.quantities(manifest.limit(0), portals.limit(0), labels.limit(0)).count() == 0


def feed(spark, files, name="f"):
    rows = [(name, n, f"{n}.json", k, NOW, payload if isinstance(payload, str) or payload is None else json.dumps(payload), "extra") for n, records in files.items() for k, payload in enumerate(records)]
    return spark.createDataFrame(rows, "feed string, file_no int, file_name string, row_no int, delivered_at timestamp, payload string, member string")


def test_layout_changes(spark):
    amounts = ["1.234,56 €", "7.654,00 EUR", "99.000,10"]
    files = {
        1: [{"doc": f"p_{k}.pdf", "value": v, "urgent": None} for k, v in enumerate(amounts)],
        2: [{"doc": f"p_{k}.pdf", "val": v, "pages": k + 9} for k, v in enumerate(amounts)] * 2,
        3: [{"doc": {"name": "x"}, "val": None, "pages": 3}, None, "{broken", "[1]"],
        5: [{"other": 1}],
    }
    found = {tuple(r)[1:] for r in drift.layout_changes(feed(spark, files)).collect()}
    assert found == {(2, "renamed", "value", "val"), (2, "removed", "urgent", ""), (2, "added", "", "pages"), (3, "type_changed", "doc", "doc")}
    assert drift.layout_changes(feed(spark, files).limit(0)).count() == 0


def test_steady_table(spark):
    files = {1: [{"document": f"{k}.pdf", "value": f"1.23{k},50 €", "confidence": 0.5, "zzz": [1]} for k in range(5)], 2: [{"document": f"{k}.pdf", "valor": f"1.23{k},50 €", "confidence": "alta"} for k in range(5)]}
    rows = drift.steady_table(feed(spark, files)).collect()
    assert len(rows) == 10 and {float(r.amount) for r in rows} == {1230.5, 1231.5, 1232.5, 1233.5, 1234.5}
    assert all(r._rescued == '{"zzz":"[1]"}' for r in rows if r.file_no == 1) and all(json.loads(r._rescued) == {"confidence": '"alta"'} for r in rows if r.file_no == 2)


def test_replay_keeps_what_it_does_not_store(spark):
    payloads = [
        {"confianza": "alta"}, {"conf": 0.25, "confianza": 0.75}, {"conf": "baja", "confianza": 0.75}, {"confidence": 0.5, "conf": 0.25}, {"confidence": "media", "conf": 0.25},
        {"val": "1,50 €", "valor": "2,50 €"}, {"value": "ver anexo", "val": "1,50 €"}, {"valor": {"importe": 3.5}},
    ]
    names = [("confianza", "confidence"), ("conf", "confidence"), ("val", "value"), ("valor", "value")]
    approved = spark.createDataFrame([("f", *n, None, None) for n in names] + [("g", "zzz", "value", None, None), (None, None, None, None, None)], APPROVED)
    rows = drift.replay(drift.ingest(feed(spark, {1: payloads})), approved).orderBy("row_no").collect()
    assert [(r.confidence, r.value, r.amount and float(r.amount), dict(r._rescued)) for r in rows] == [
        (None, None, None, {"confianza": '"alta"'}), (0.25, None, None, {"confianza": "0.75"}), (0.75, None, None, {"conf": '"baja"'}), (0.5, None, None, {"conf": "0.25"}), (0.25, None, None, {"confidence": '"media"'}),
        (None, "1,50 €", 1.5, {"valor": '"2,50 €"'}), (None, "ver anexo", None, {"val": '"1,50 €"'}), (None, '{"importe":3.5}', 3.5, {}),
    ]


def test_promotions_follow_renames_to_the_end(spark):
    names = ["value", "a1", "a2", "a3", "a4", "a5", "a6", "a7"]
    changes = [("f", n, "renamed", b, a) for n, (b, a) in enumerate([*zip(names, names[1:]), ("x", "y")], 2)] + [("f", 20, "added", "", "a9"), ("f", 9, "removed", "a7", "")]
    frame = spark.createDataFrame(changes, "feed string, file_no int, change_kind string, field_before string, field_after string")
    present = spark.createDataFrame([("f", "a1"), ("g", "a3"), ("g", "a7"), ("g", "document"), ("h", "a9")], "feed string, member string")
    found = {(r.feed, r.alias): (r.member, r.first_file, r.last_file, r.own) for r in drift.promotions(frame, present).collect()}
    own = {("f", f"a{k}"): ("value", k + 1, k + 1 if k < 7 else 8, True) for k in range(1, 8)}
    assert found == own | {("g", "a3"): ("value", None, None, False), ("g", "a7"): ("value", None, None, False)}
    assert {tuple(r) for r in drift.review(drift.promotions(frame, present)).filter("alias = 'a3'").collect()} == {("a3", "value", 2, 1)}
    assert drift.promotions(frame.limit(0), present).count() == 0


def test_aliases_hold_for_their_feed_and_files(spark):
    """A name that stands for a member in one feed, or in some files, stands for nothing elsewhere."""
    approved = spark.createDataFrame([("f", "val", "value", 2, 3)], APPROVED)
    records = feed(spark, {n: [{"val": "1,50 €"}] for n in (1, 2, 3, 4)}).unionByName(feed(spark, {2: [{"val": "1,50 €"}]}, "g"))
    rows = drift.replay(drift.ingest(records), approved).collect()
    assert {(r.feed, r.file_no) for r in rows if r.amount is not None} == {("f", 2), ("f", 3)}
    assert {(r.feed, r.file_no) for r in rows if r._rescued} == {("f", 1), ("f", 4), ("g", 2)}


def test_steady_table_loses_no_value(spark):
    """Every value that is no null stands in a typed column or in `_rescued`; own aliases are used wherever they can be cast."""
    records = spark.read.parquet("/root/testdata/sf0.001/feed_records.parquet")
    payloads = {(r.feed, r.file_no, r.row_no): r.payload for r in drift.delivered(records.withColumn("x", records.row_no)).drop("_m").join(records, ["feed", "file_no", "row_no", "file_name", "delivered_at"]).select("feed", "file_no", "row_no", "payload").collect()}
    rows = drift.steady_table(records).collect()
    assert len(rows) == len(payloads)
    stored = 0
    for r in rows:
        whole = {k: v for k, v in json.loads(payloads[r.feed, r.file_no, r.row_no]).items() if v is not None}
        rescued = json.loads(r._rescued) if r._rescued else {}
        assert rescued.keys() <= whole.keys()
        typed = {m for name, (m, _) in drift.TARGET.items() if r[name] is not None}
        assert len(typed) + len(rescued) == len(whole)
        stored += len(typed)
    assert stored > 0.7 * sum(len(json.loads(p)) for p in payloads.values())


def test_leaves_of_any_depth():
    text = '{"a": {"b": [1.50, {"c d": null}, []], "e": true}, "f": {}, "á": "x"}'
    assert nested.leaves(text) == [("$.a.b[0]", "1.50"), ('$.a.b[1]["c d"]', None), ("$.a.b[2]", "[]"), ("$.a.e", "true"), ("$.f", "{}"), ("$.á", "x")]
    deep = "[" * 500 + "7" + "]" * 500
    assert nested.leaves(deep) == [("$" + "[0]" * 500, "7")]
    assert nested.leaves("[broken") == [("$", "[broken")]


def test_nested_records(spark):
    span = {"start": 1, "end": 2}
    body = {
        "arm": "a", "fields": {"x": {"results": [{"value": "1", "sourceSpan": [span, {"start": 3, "end": 4, "page": 1}]}, None, {"value": {"k": [1]}, "sourceSpan": {"range": [5, 6]}}]}, "y": {"value": "v", "sourceSpan": {"spans": [span]}}, "z": [], "n": None},
        "lotes": [{"lote": 7, "fields": [{"field": "x", "results": {"value": None, "sourceSpan": span}}]}, {"lote": 8}],
    }
    text = json.dumps(body)
    later = NOW + datetime.timedelta(1)
    rows = [(1, text, NOW), (1, text, later), (2, json.dumps(text), NOW), (3, text[:50], NOW), (4, None, NOW), (5, "[]", NOW), (6, "", NOW), (7, "{}", NOW), (8, text, NOW), (8, text[:9], later)]
    records = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, body string, loaded_at timestamp, lots string")
    expected = {(0, "x", 1, 1, 2), (0, "x", 1, 3, 4), (0, "x", 3, 5, 6), (0, "y", 1, 1, 2), (7, "x", 1, 1, 2)}
    found = sorted(tuple(r) for r in nested.spans(records).collect())
    assert found == sorted((k, *e) for k in (1, 2, 8) for e in expected)
    table = nested.canonical(records)
    assert nested.flatten(table, "lots").filter("record_id = 1").count() == 3
    assert {(r.path, r.leaf) for r in nested.value_leaves(table).filter("record_id = 1").collect()} == {("$", "1"), ("$.k[0]", "1"), ("$", "v")}
    every = nested.tables(records)
    assert set(every) == {"lots", "fields", "results", "spans", "values"} and every["spans"].filter("start is not null").count() == 15
    assert nested.spans(records.limit(0)).count() == 0
