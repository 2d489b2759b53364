"""Operators of the engine's core on odd input, and against brute force."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lindero.operators import evidence as V
from lindero.operators import extraction
from lindero.operators import passages as P
from lindero.operators import segments as S
from lindero.operators import verification as W
from lindero.plans import cleaning, runs, segments, texts, verification
from lindero.plans.registry import SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["document_spans", "section_collapse", "passage_spans", "interval_merge", "running_cap", "segment_map"])
def test_no_text_is_shuffled(spark, name):
    query = getattr(texts, name, None) or getattr(segments, name)
    assert "Exchange" not in query(spark, DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["asof_heading", "band_semi"])
def test_only_positions_are_shuffled(spark, name):
    plan = getattr(texts, name)(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert "Exchange" not in line or "text" not in line


def test_segments_of_odd_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Cláusula 1. Objeto del contrato\nCláusula 1. Objeto del contrato\n8) PLAZO DE EJECUCIÓN\nA. PRESUPUESTO BASE", "x"), (3, "nada", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, marker string")
    out = {(r.doc_id, r.text): r for r in S.with_segments(frame).collect()}
    assert out[2, ""].clause == [] and out[3, "nada"].item == [] and not out[1, None].clause
    found = out[3, rows[2][1]]
    assert [(s.marker, s.title, s.start, s.end) for s in found.clause] == [("1", "Objeto del contrato", 0, 31), ("1", "Objeto del contrato", 31, len(rows[2][1]))]
    assert [s.marker for s in found.item] == ["8"]  # as many numbered as lettered items: numbered
    assert S.with_segments(frame.limit(0)).count() == 0 and S.with_annex(frame).filter("items is not null").count() == 0
    assert [r.chosen for r in S.selected(frame, "passage").collect()] == [r[1] for r in rows]
    with pytest.raises(ValueError, match="unknown"):
        S.selected(frame, "other")


def test_islands_and_passages_against_brute_force(spark):
    rng = random.Random(4)
    for _ in range(5):
        spans = sorted((s, s + rng.randint(1, 30)) for s in (rng.randint(0, 300) for _ in range(rng.randint(0, 12))))
        text = "".join(rng.choice("abcdefgh") for _ in range(400))
        want = []
        for s, e in spans:
            if want and s <= want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        out, cap = "", 120
        for s, e in want:
            piece = text[s:e]
            if len(out) + len(piece) + 9 > cap:
                out += "\n\n[…]\n\n" + piece[: max(0, cap - len(out) - 9)]
                break
            out += ("\n\n[…]\n\n" if out else "") + piece
        frame = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,end:int>>").withColumn("merged", S.islands(F.col("spans")))
        row = frame.select("merged", S.passages(F.col("text"), F.col("merged"), cap).alias("p")).collect()[0]
        assert [[m.start, m.end] for m in row.merged] == want and row.p == (out if want else text[:cap])


def test_comparison_cuts_large_sections(spark):
    a = "Cláusula 1 " + "a" * 9000 + "\nCláusula 2 corta"
    b = "cabecera\nCláusula 1 " + "b" * 100 + "\nCláusula 1 repetida\nCláusula 3 sola"
    pairs = spark.createDataFrame([(1, a, b), (2, "sin secciones", b), (3, "", ""), (4, None, b)], "doc_id long, text_a string, text_b string")
    rows = P.unfolded(P.with_comparison(pairs, most=8000), "chunks", "key").collect()
    by = {k: [(r.key, len(r.text_a), len(r.text_b)) for r in rows if r.doc_id == k] for k in (1, 2, 3)}
    assert sorted(by[1]) == [("clausula 1 (1/3)", 4000, 132), ("clausula 1 (2/3)", 4000, 0), ("clausula 1 (3/3)", 1011, 0), ("clausula 2", 16, 0), ("clausula 3", 0, 15)]
    assert [k for k, *_ in by[2]] == ["Fragmento"] and by[3] == []


def test_positions_and_status(spark):
    source = "clausula 3. plazo de ejecucion es de 3 meses. " + "x " * 3000 + "clausula 9. el precio es de 10 euros"
    rows = [
        (1, "«plazo de ejecución»", "Cláusula 3", source), (2, "el precio…", "Cláusula 3", source), (3, "no está", "Cláusula 3", source), (4, "", "Cláusula 3", source), (5, "precio", None, source), (6, "precio", "Cláusula 3", None), (7, None, "x", source), (8, "precio", "Cláusula 99", source),
    ]
    frame = spark.createDataFrame(rows, "k int, excerpt string, reference string, source string")
    placed = W.with_positions(frame)
    out = {r.k: r for r in W.reattributed(placed).collect()}
    assert out[1].excerpt_at == [12] and out[1].reference_at == [0] and out[1].corrected is None
    assert out[2].excerpt_at == [6058] and out[2].corrected == "Cláusula 9" and out[3].excerpt_at == [] and out[3].corrected is None
    assert out[6].excerpt_at == [] and out[7].excerpt_at == [] and out[8].corrected == "Cláusula 9"
    sided = placed.withColumns({"compared": F.col("k") == 1, "reference_b": F.lit("Cláusula 3"), "excerpt_b": F.lit("precio"), "source_b": F.lit(None).cast("string"), "excerpt_at_b": F.array().cast("array<int>"), "reference_at_b": F.array().cast("array<int>")})
    status = {r.k: r.s for r in sided.select("k", W.status().alias("s")).collect()}
    assert status == {1: "sin_referencia", 2: "verificado", 3: "sin_extracto", 4: "sin_extracto", 5: "sin_referencia", 6: "sin_extracto", 7: "sin_extracto", 8: "verificado"}


def test_snippets():
    text = "Uno  DOS\ttres. El plazo de ejecución será de 12 MESES desde el acta. " + "y " * 400
    assert W.snippet(text, "plazo de  EJECUCION") == (" ".join(text[: text.index("plazo") + 340].split()), "exact")
    assert W.snippet(text, "plazo de ejecución sera otro")[1] == "partial" and W.snippet(text, "son 12 meses")[1] == "partial"
    assert W.snippet(text, "nada") == (None, "not-located") and W.snippet(None, "x") == (None, "not-located") and W.snippet(text, None) == (None, "not-located")
    norm, places = W.normal_with_map("Ñ  ﬁn")
    assert norm == "n fin" and places == [0, 1, 3, 3, 4]


def test_ranks_against_sorting(spark):
    rng = random.Random(7)
    groups = {"a": [rng.random() for _ in range(999)], "b": [1.0] * 50, "c": [3.0], None: [rng.randint(0, 3) * 1e6 for _ in range(200)], "d": [-5.0, 5.0]}
    frame = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    out = {r.k: (r.median, r.p90) for r in V.ranked(frame, ["k"], "v").collect()}
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert out[k] == ((s[(n - 1) // 2] + s[n // 2]) / 2, s[min(n - 1, int(0.9 * n))])
    assert "e" not in out and V.ranked(frame.limit(0), ["k"], "v").count() == 0


def test_gate_of_hot_documents(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else "d", f"valor número {k % 40}" if k % 7 else None) for k in range(300)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "result_id int, document string, value string, file string")
    sources = spark.createDataFrame([("hot", " ".join(f"valor numero {k}." for k in range(0, 40, 2)))], "file string, source string")
    whole = sorted(map(tuple, V.gated(frame, sources).select("result_id", "strict", "relaxed").collect()))
    monkeypatch.setattr(V, "SEARCHED", 3)
    assert sorted(map(tuple, V.gated(frame, sources).select("result_id", "strict", "relaxed").collect())) == whole
    assert len(whole) == 300 and any(s for _, s, _ in whole) and not any(s for k, s, _ in whole if rows[k][1] == "d" or rows[k][2] is None)


def test_sheets_of_odd_cells(spark):
    cells = [("s", 1, 1, "Importe o porcentaje"), ("s", 1, 2, "Referència"), ("s", 2, 1, None), ("s", 2, 2, "  "), ("s", 3, 1, "21"), ("s", 3, 2, "7"), ("t", 1, 1, "21"), ("s", 4, 1, "10 % ; 10 %"), ("s", 4, 2, "Cl. 3; Cl. 3; 9")]
    frame = spark.createDataFrame([(*c, "x") for c in cells], "sheet string, row_no int, col_no int, value string, kind string")
    out = {(r.sheet, r.row_no, r.col_no): r.value for r in cleaning.sanitized_sheet(frame).collect()}
    assert out == {("s", 1, 1): "Importe o porcentaje", ("s", 1, 2): "Referència", ("s", 2, 1): None, ("s", 2, 2): "  ", ("s", 3, 1): "No especificado", ("s", 3, 2): "No identificado", ("t", 1, 1): "21", ("s", 4, 1): "10 %", ("s", 4, 2): "Cl. 3"}
    assert cleaning.sanitized_sheet(frame.limit(0)).count() == 0


def test_rates_bound_to_other_things(spark):
    cases = [("20 por ciento", "gastos de escritura", True), ("20 %", "gastos de escritura", False), ("20 por ciento", "otros", False), ("10 por ciento", "", True), ("10 por ciento", "garantía", False), ("10 %", "", False)]
    frame = spark.createDataFrame(cases, "v string, c string, e boolean")
    assert [(r.m, r.e) for r in frame.select(cleaning.misbound(F.col("v"), F.col("c")).alias("m"), "e").collect()] == [(e, e) for *_, e in cases]


def test_answers_of_odd_shapes(spark, tmp_path):
    bodies = [
        '{"ficha": {"objeto": ["obra", {"texto": "puente"}], "iva": {"importe": "21 %", "moneda": "EUR"}, "organo": {"value": " Junta ", "reference": "Cláusula 2"}, "tramitacion": true}}', '{"tender_details": null, "plazo_de_ejecucion": 12, "procedimiento": "  "}', '{"ficha": []}', "{broken", "[1]", None, "{}",
    ]
    spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    flat = {(r.doc_id, r.field): (r.value, r.clause_reference) for r in runs.answer_fields(spark, str(tmp_path)).collect()}
    assert flat == {(0, "organo_contratacion"): ("Junta", "Cláusula 2"), (0, "tramitacion"): ("Sí", None), (1, "plazo_ejecucion"): ("12", None)}
    assert {(r.doc_id, r.field): r.value for r in runs.answer_nested(spark, str(tmp_path)).collect()} == {(0, "objeto_contrato"): "obra; puente", (0, "iva"): "21 %"}
    assert {r.doc_id: r.filled for r in runs.answer_filled(spark, str(tmp_path)).collect()} == {0: True, 1: True, 6: False}


def test_extraction_is_dealt_out_and_reads_odd_letters(spark):
    # one row group of orders was one task
    assert segments.extracted_fields(spark, DIR).rdd.getNumPartitions() == 4
    rows = [(1, "PREſUPUEſTO BAſE DE LıCİTACıÓN: 1.000,00 €"), (2, "Grupo: C) Subgrupo: 1 Categoría: 3 GRUPO: C) SUBGRUPO: 1 CATEGORÍA: 3"), (3, None), (4, ""), (5, "4) OBJETO DEL CONTRATO       . 5) OBJETO DEL CONTRATO. PUENTE SOBRE EL RÍO. "), (6, "contrato CONTRATO DE OBRAS PROCEDIMIENTO ABIERTO")]
    out = {(r.doc_id, r.field): r.value for r in extraction.fields(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, "presupuesto_base_con_iva"): "1.000,00 €", (2, "clasificacion_empresarial"): "Grupo C, Subgrupo 1, Categoría 3", (5, "objeto_contrato"): "PUENTE SOBRE EL RÍO", (6, "tipo_contrato"): "Obras", (6, "procedimiento"): "Abierto"}


def test_head_and_annex_of_odd_texts(spark):
    # one row group of orders was one task
    assert segments.head_and_annex(spark, DIR).rdd.getNumPartitions() == 4
    heading, end = re.compile(r"(?:\A|\n)[\s﻿]*ANEXO[\s﻿]+I\b"), re.compile(r"(?:\A|\n)[\s﻿]*ANEXO[\s﻿]+(?:II|III|IV|V|VI|VII|VIII|IX|X)\b")
    odd = ["ANEXO I", "\n ANEXO I x", "x ANEXO I", "\n\n ANEXO\n\nI\n ANEXO I", "\nANEXO IANEXO I", "\nANEXO I\nANEXO  I.", "\nANEXO II\nANEXO VI", "ñ\n\nANEXO I b" + "b" * 9000 + "\nANEXO II c", "\nANEXO I\nANEXO", "\n\nANEXO ANEXO I"]
    texts = [front + o + "w" * size for o in odd for front in ("", "  ", "z" * 60_000) for size in (0, 9_000)]
    want = []
    for t in texts:
        starts = [m.start() for m in heading.finditer(t)]
        if not starts:
            want.append(t)
            continue
        s = starts[-1]
        m = end.search(t[s + 10 :])
        focus = t[: min(12_000, s)] + S.GAP + t[s : s + 10 + m.start() if m else min(len(t), s + S.CONTROL_CAP)]
        want.append(focus if 8_000 <= len(focus) < 0.8 * len(t) else t)
    rows = [*enumerate(texts), (-1, None), (-2, "")]
    out = {r.doc_id: r.chosen for r in S.with_head_and_annex(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(enumerate(want)) | {-1: None, -2: ""} and sum(a != b for a, b in zip(want, texts)) > 5


def test_ranks_of_weighted_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), rng.randint(0, 40) / 8, rng.randint(1, 9)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "k string, v double, w int")
    plain = {(r.k, r.median, r.p90) for r in V.ranked(frame.withColumn("v", F.explode(F.array_repeat("v", F.col("w")))), ["k"], "v").collect()}
    assert {(r.k, r.median, r.p90) for r in V.ranked(frame, ["k"], "v", "w").collect()} == plain and len(plain) == 2


def test_amounts_without_country_are_kept(spark, tmp_path):
    rows = [(k, 1, None if k % 2 else "A", 1234.5 + 1000 * (k % 4)) for k in range(40)] * 3
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = {r.country: r for r in verification.error_factor_distribution(spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {r[0]: r for r in connection.execute(SQL["error_factor_distribution"]).fetchall()}
    assert set(out) == set(want) == {None, "A"} and all(tuple(out[k]) != () and (out[k].n, out[k].median, out[k].below_10, out[k].to_1000, out[k].above) == (want[k][1], want[k][3], *want[k][5:]) for k in want)


def test_pages_are_dealt_out_and_lines_in_odd_letters_cut(spark):
    # keys were drawn together into as few tasks as their own size asks for
    assert "REPARTITION_BY_NUM" in cleaning.cleaned_volumes(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    rows = [(1, "a", "FıRMADO POR: X Fecha: 1-2-24 10:11 fin"), (2, "a", "Su Firmado por: Y Fecha: 1-2-24 10:11autenticidad puede ser comprobada"), (3, None, "3 .5 8 0.000,00"), (4, "b", None), (5, "b", "")]
    rows += [(10 + k, "c", f"Sede electrónica\n texto {k}\n\nSede  electrónica") for k in range(4)]
    out = {r.doc_id: r.text for r in cleaning.cleaned_pages(spark.createDataFrame(rows, "doc_id long, file string, text string")).collect()}
    assert out == {1: "fin", 2: "", 3: "3.580.000,00", 4: None, 5: ""} | {10 + k: f"texto {k}" for k in range(4)}
