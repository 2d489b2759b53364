import json

import pytest

from lindero.functions.text import normalised
from lindero.sources import files, sinks
from lindero.streaming import documents as stream


def test_readers(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.json").write_text(json.dumps({"_comment": "x", "d1": {"iva": "21 %", "_note": "n"}, "d2": {"plazo": "3 meses"}}))
    assert sorted(map(tuple, files.json_map_of_maps(spark, str(tmp_path / "labels")).collect())) == [("d1", "iva", "21 %"), ("d2", "plazo", "3 meses")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/b.txt").write_text("uno\fdos")
    assert [tuple(r)[1:] for r in files.pages(spark, str(tmp_path / "docs"), {"txt": files.plain_pages}).orderBy("page_no").collect()] == [(1, "uno"), (2, "dos")]
    assert [(r.name, r.kind, r.length) for r in files.listing(spark, str(tmp_path / "docs"), "*.txt").collect()] == [("b.txt", "txt", 7)]
    with pytest.raises(Exception, match="no parser"):
        files.pages(spark, str(tmp_path / "docs"), {"pdf": files.plain_pages}).count()
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.txt").write_text("coverage:\n   48.0 of 88\nruns: 10\n")
    (tmp_path / "logs/b.txt").write_text("coverage: 3.0 of 88\n")
    rows = files.log_rows(spark, str(tmp_path / "logs"), {"coverage": r"coverage:\s*([\d.]+)", "runs": r"runs:\s*(\d+)"}).collect()
    assert {(r.row, r.captured) for r in rows} == {("coverage", "48.0"), ("runs", "10")}


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([(k, "a", k % 2, "v") for k in range(6)], "record_id int, arm string, run_no int, value string")
    sinks.checkpoint_records(records, str(tmp_path / "out"))
    done = spark.read.schema("record_id int, arm string, run_no int, value string").json(str(tmp_path / "out")).filter("record_id < 4")
    assert sorted(r.record_id for r in sinks.not_yet_done(records, done, ["record_id"]).collect()) == [4, 5]
    assert sinks.archive(records).collect() == sinks.archive(records.orderBy("record_id", ascending=False)).collect()
    with pytest.raises(Exception, match="key material"):
        sinks.archive(records.selectExpr("'sk-aaaaaaaaaaaaaaaaaaaaaaaa' as value")).collect()
    sinks.tab_separated(records, str(tmp_path / "tsv"))
    assert files.tab_separated(spark, str(tmp_path / "tsv"), "record_id int, arm string, run_no int, value string").count() == 6


def test_extractor_boundary(spark):
    documents = spark.createDataFrame([(k, "texto") for k in range(6)] + [(22, None)], "doc_id long, text string")

    def answer(key, text, credential):
        if key == 5 or (key % 2 and credential == "a"):
            raise ValueError("refused")
        return f'{{"k": {key}}}'

    rows = {r.doc_id: (r.body, r.tries) for r in files.extracted(documents, answer, keys=("a", "b"), tries=3).collect()}
    assert rows[0] == ('{"k": 0}', 1) and rows[1] == ('{"k": 1}', 2) and rows[5] == (None, 3) and rows[22][0]


def test_synthetic_answers(spark):
    slots = spark.range(400).selectExpr("concat('arm', id % 3) as arm", "cast(id % 5 as int) as run_no", "concat('d', id) as document", "'iva' as field", "'21 %' as gold")
    rows = files.synthetic_answers(slots).selectExpr("*", "try_parse_json(body) is null as broken", "get_json_object(body, '$.value') as v").collect()
    assert files.synthetic_answers(slots.repartition(7)).orderBy("document").collect() == files.synthetic_answers(slots).orderBy("document").collect()
    assert 10 < sum(r.broken for r in rows) < 90 and {"21 %", "999.999,99 €", "texto que no está"} <= {r.v for r in rows}


def test_boundaries_of_services(spark, tmp_path):
    def search(country, limit):
        if country == "xx":
            raise OSError("down")
        return [{"id": f"{country}{k}", "country": country} for k in range(5)]

    found = files.searched(spark, ["es", "xx", "fr"], search, "id string, country string", 3).collect()
    assert sorted(r.id for r in found) == ["es0", "es1", "es2", "fr0", "fr1", "fr2"]
    wanted = spark.createDataFrame([("a.pdf", "u1"), ("b.pdf", "u2"), ("c.pdf", "u3")], "name string, url string")
    there = spark.createDataFrame([("a.pdf", 30_000), ("b.pdf", 10)], "name string, length long")
    assert {r.name for r in files.to_download(wanted, there).collect()} == {"b.pdf", "c.pdf"}
    assert [r[0] for r in spark.createDataFrame([(b"%PDF-1",), (b"<html",), (None,)], "c binary").select(files.is_pdf(files.F.col("c"))).collect()] == [True, False, False]
    (tmp_path / "raw/control/3").mkdir(parents=True)
    (tmp_path / "raw/control/3/doc.json").write_text('{"a": 1}')
    assert [tuple(r) for r in files.run_records(spark, str(tmp_path / "raw"), "a int").collect()] == [(1, "control", "3", "doc")]
    items = spark.createDataFrame([("p", 1, 1, "uno", False), ("p", 1, 2, "", True), ("p", 1, 3, None, False), ("p", 1, 4, "dos", True)], "path string, page_no int, item_no int, item string, ends_line boolean")
    assert [r.text for r in files.item_pages(items).collect()] == ["uno \n dos\n"] and [r.text for r in files.item_pages(items, False).collect()] == ["uno dos\n"]


def test_verdict_and_sheets(spark):
    checks = spark.createDataFrame([("b", True), ("a", False)], "name string, pass boolean")
    assert json.loads(sinks.verdict_json(checks).collect()[0][0]) == {"verdict": "deviates", "reason": "a: NO; b: yes"}
    cells = spark.createDataFrame([("s", 1, 1, "x"), ("s", 1, 2, "y"), ("s", 2, 1, "z")], "sheet string, row_no int, col_no int, value string")
    assert sorted(map(tuple, sinks.wide_sheet(cells, [1, 2]).collect()), key=str) == [("s", 1, "x", "y"), ("s", 2, "z", None)]


def test_sheets_are_checked(spark):
    from lindero.plans import cleaning

    cells = spark.createDataFrame([("s", 1, 1, "Importe"), ("s", 2, 1, "21"), ("s", 3, 1, "3 €")], "sheet string, row_no int, col_no int, value string")
    with pytest.raises(ValueError, match="s!R2C1=21"):
        cleaning.assert_no_bare_amounts(cells)
    cleaning.assert_no_bare_amounts(cleaning.sanitized_sheet(cells))


def test_stream(spark, tmp_path):
    rows = [(1, "Á é", "2025-01-01 00:00:00"), (1, "Á é", "2025-01-01 00:00:00"), (2, "X", "2025-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, loaded_at string")
    frame.selectExpr("doc_id", "text", "cast(loaded_at as timestamp_ntz) as loaded_at").write.parquet(str(tmp_path / "in"))
    source = stream.new_documents(spark, str(tmp_path / "in"), "doc_id long, text string, loaded_at timestamp_ntz")
    query = stream.through(source, lambda df: df.select("doc_id", normalised(df.text).alias("text")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "a e"), (2, "x")]
