import json

from pyspark.sql import functions as F

from lindero.functions import text as X
from lindero.operators import extraction as E
from lindero.operators import passages as P
from lindero.plans import tables, texts


def column(spark, rows, build):
    frame = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in frame.select(build(F.col("v"))).collect()]


def test_well_formed_amounts(spark):
    wrong = ["000,00 €", "00 €", "48", "77", ",50", ".500,00", "", None]
    right = ["40.000,00 €", "82.500,00", "1.234,5", "64.335,36 €", "12,50 €"]
    assert column(spark, wrong, X.well_formed) == [False] * len(wrong)
    assert column(spark, right, X.well_formed) == [True] * len(right)


def test_number_repair(spark):
    cases = {"35.000 ,00": "35.000,00", "40. 000": "40.000", "8 0.000,00": "80.000,00", "3 5 .000,00": "35.000,00", "art. 13": "art.13", "Anexo 3 000": "Anexo 3 000", "1 109 916,80": "1 109916,80"}
    assert column(spark, list(cases), X.repaired_numbers) == list(cases.values())


def test_local_amounts(spark):
    cases = {"1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "12 345,6 €": 12345.6, "1.234": 1234.0, "0": None, "abc": None, None: None}
    assert column(spark, list(cases), X.local_amount) == list(cases.values())


def test_boundary_match(spark):
    rows = [("21 %", "1 %", False), ("5% del precio", "5 %", True), ("1.234.567,00 €", "234.567,00 €", False), ("24 MESES", "24 meses", True), ("4 meses", "24 meses", False), ("Abierto simplificado", "abierto", True), ("Abiertos", "abierto", False), (None, "abierto", False), ("12-2024", "12/2024", False), ("exp. 12/2024.", "12/2024", True), ("a.b", "a-b", False), ("Clase (B)", "(b)", True)]
    frame = spark.createDataFrame(rows, "v string, g string, e boolean")
    assert [(r.m, r.e) for r in frame.select(X.boundary_match(F.col("v"), F.col("g")).alias("m"), "e").collect()] == [(e, e) for *_, e in rows]


def test_grounding_form_is_nfkd(spark):
    """As Unicode's own compatibility decomposition without marks, for all letters of the Latin, Greek and Cyrillic blocks and compatibility forms."""
    import unicodedata

    chars = [chr(p) for p in (*range(0x21, 0x600), *range(0x1E00, 0x2200), *range(0xFB00, 0xFB05), *range(0xFF01, 0xFF5F)) if unicodedata.category(chr(p))[0] in "LN" and len(X._folded(p)) == 1]
    rows = [f"x{c}y" for c in chars] + ["ﬁn ﬂor", "ő š č", "e\u0301 n\u0303", "５.０００,００", "½", "a\u00a0\u3000b"]
    wanted = [" ".join("".join(c for c in unicodedata.normalize("NFKD", r) if unicodedata.category(c)[0] != "M").split()).lower() for r in rows]
    assert [(r, a) for r, a, b in zip(rows, column(spark, rows, X.normalised), wanted, strict=True) if a != b] == []


def test_strict_amounts(spark):
    good = ["2 AÑOS", "3 del precio", "5 del importe", "de presupuesto", "10 %", "12 € ", "n/a", "", None, "1 día", "por siniestro", "3 MEUR"]
    bad = ["21", "42,5", "sin importe", "delprecio", "meseta", "1.234,00"]
    assert column(spark, good, X.strict_amount) == [True] * len(good) and column(spark, bad, X.strict_amount) == [False] * len(bad)


def test_spots(spark):
    assert column(spark, ["a12b3c", "", None, "77", "x"], lambda c: X.spots(c, r"\d+")) == [[(1, 3, "12"), (4, 5, "3")], [], None, [(0, 2, "77")], []]


def test_chunks_keep_the_text(spark):
    text = "\nCláusula 1 uno" + " a" * 40 + "\nCláusula 2 dos" + " b" * 40 + "\nCláusula 3 tres" + " c" * 100
    (chunks,) = column(spark, [text], lambda c: P.chunked(c, 120))
    assert "".join(chunks).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert column(spark, ["x" * 250], lambda c: P.chunked(c, 100)) == [["x" * 100, "x" * 100, "x" * 50]]


def test_interval_merge_and_cap(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (1, 5, 12), (2, 1, 2), (2, 1, 2)], "k int, start_pos int, end_pos int")
    merged = P.merged_spans(spans, "k")
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 20), (1, 30, 40), (2, 1, 2)]
    assert sorted(map(tuple, P.capped_spans(merged, "k", 25).collect())) == [(1, 0, 20), (1, 30, 35), (2, 1, 2)]


def test_repeated_lines(spark):
    pages = spark.createDataFrame([(k, f"Firmado electrónicamente por X\nPlazo de pago\ntexto {k}", "f") for k in range(6)] + [(9, "Página 1 de 2", "g"), (10, None, "g"), (11, "x", None)], "doc_id long, text string, file string")
    repeated = P.repeated_lines(pages)
    assert [r.line for r in repeated.collect()] == ["Firmado electrónicamente por X"]
    texts = {r.doc_id: r.text for r in P.without_repeated(pages, repeated).collect()}
    assert texts[0] == "Plazo de pago\ntexto 0" and texts[9] == "Página 1 de 2" and texts[10] is None and texts[11] == "x"


def test_json_scalar_flatten(spark, tmp_path):
    cases = {
        '{"start": 2852, "end": 9050}': "2852 9050", '{"unidad": "mes", "n": 22}': "mes 22", '{"importe": 15194.50, "moneda": "EUR"}': "15194.5", '{"value": " ", "texto": "a"}': "a", '[{"lote": 1}, {"lote": 2}, null]': "1; 2",
        '[["580.615,72", "EUR"], [[[["x"]]]]]': "580.615,72; EUR; x", '{"a": {"b": {"c": 1}}}': "1", '{"a": {"b": {"c": {"d": 1}}}}': None, '{"a": {"b": {"c": [true, " s "]}}}': "Sí; s", "[{}]": None, "{}": None, '" "': None,
        '" a "': "a", "false": "No", "21": "21", "1774646.0": "1774646", "1e21": "1e+21", "1e-7": "1e-7", "0.00001": "0.00001", "-0.0": "0", "12345678901234567890": "12345678901234567000", '{"b": 1, "2": 2, "1": 3}': "3 2 1", '"\\ud800"': "\ufffd", "null": None,
    }
    deep = "[" * 900 + "1" + "]" * 900
    payloads = ["{" + ", ".join(f"{json.dumps(c)}: {c}" for c in cases) + "}", f'{{"deep": {deep}}}', '{"cut": [1', "[1]", None]
    spark.createDataFrame([("f", 1, k, p) for k, p in enumerate(payloads)], "feed string, file_no int, row_no int, payload string").write.parquet(f"{tmp_path}/feed_records.parquet")
    assert {r.member: r.text for r in tables.json_scalar_flatten(spark, str(tmp_path)).collect()} == cases | {"deep": "1"}


def test_labels_within_contexts(spark):
    money = {
        "El valor estimado sea inferior a 100 €; el valor estimado es de 5.000,50 euros": "5.000,50 €", "valor estimado: véase. Valor estimado: 7 €": "7 €", "valor estimado 9 Euros": "9 €", "valor estimado 9\u00a0€": "9 €", "valor estimado 9 europeos": None,
        "valor estimado" + " x" * 36 + " 1 €": None, "valor estimado para mayores: 1 €": "1 €", "valor estimado, por ejemplo, 1 €": None, "": None, None: None,
    }
    assert column(spark, list(money), lambda c: E.labelled(c, ("valor estimado",), "money")) == list(money.values())
    terms = {"Plazo de ejecución: como mínimo 2 meses. El plazo de ejecucion es de 10 días naturales": "10 DÍAS", "duración del contrato: 2 años; plazo de duración: un mes, 3 Semanas": "3 SEMANAS", "plazo de ejecución 3 mesetas": None}
    assert column(spark, list(terms), lambda c: E.labelled(c, E.LABELS["plazo_ejecucion"], "duration")) == list(terms.values())
    shares = {"Garantía definitiva superior al 3 %. La garantía definitiva será del 5 % del precio": "5%", "garantía definitiva: 5": None}
    assert column(spark, list(shares), lambda c: E.labelled(c, E.LABELS["garantia_definitiva"], "percent")) == list(shares.values())


def test_inclusion_in_the_whole_source(spark, tmp_path):
    spark.sql("select 1L as label_id, 'f' as doc, 'iva' as field, '21 %' as gold").write.parquet(f"{tmp_path}/golden_labels.parquet")
    spark.sql("select 1L as parse_id, 'f' as file, true as ok, concat(repeat('a', 1000100), ' 21 %') as text, 1 as parsed_at").write.parquet(f"{tmp_path}/docling_parses.parquet")
    assert {r.rule: r.included for r in texts.evidence_inclusion(spark, str(tmp_path)).collect()} == {"head": 0, "full": 1}
