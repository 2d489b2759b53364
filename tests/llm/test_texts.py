"""Operators on texts: cases, brute force on small fixtures, odd input."""

import itertools
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lindero.llm import leakage, lookalike, packing, pii, queries, splitting, truncation

LONG = "La garantía será del 5 %. " * 20_000


# --- 1 ---------------------------------------------------------------------------------------


def sentences(rng, n):
    places = ["Villarosa", "Montalba", "Navarreta", "Olmedilla"]
    kinds = [
        lambda: f"Las ofertas se abrirán el {rng.randint(1, 28)} de mayo de 2025 en la sede de {rng.choice(places)}.",
        lambda: f"La garantía definitiva será del {rng.randint(1, 30)} % del precio final ofertado.",
        lambda: f"El plazo de ejecución es de {rng.randint(2, 60)} meses a contar desde el acta de replanteo.",
        lambda: f"La recepción constará en acta firmada por el Ayuntamiento de {rng.choice(places)}.",
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def test_cut_texts(spark):
    rng = random.Random(3)
    rows, cut = [], set()
    for k in range(600):
        text = "\n".join(" ".join(sentences(rng, 2)) for _ in range(rng.randint(2, 4)))
        if k % 3 == 0:
            text += "\nFdo.: Ana " + rng.choice(["Ruiz", "Soto", "Vidal", "Pons"])
        if k % 10 == 1:
            text = text[: -rng.randint(9, 25)]
            cut.add(k)
        rows.append((k, text, "es" if k % 2 else None, "s"))
    odd = [(900, None), (901, ""), (902, " \n "), (903, '{"a": {"b": 1'), (904, '{"a": {"b": "}"}}'), (905, "La garantía definitiva será…"), (906, "texto�"), (907, LONG)]
    rows += [(k, t, "es", "s") for k, t in odd] + [rows[1], rows[1]]
    documents = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, is_cut boolean")
    found = truncation.cut_texts(documents).filter("is_cut").select("doc_id").collect()
    ids = {r.doc_id for r in found}
    assert {903, 905, 906} <= ids and not {900, 901, 902, 904} & ids
    planted = ids & set(range(600))
    assert len(planted & cut) >= 0.95 * len(cut) and len(planted - cut) <= 0.01 * 600
    assert sum(r.doc_id == 1 for r in found) == 3
    share = truncation.cut_share(documents.withColumn("finish_reason", F.lit("STOP"))).collect()[0]
    assert share.texts == len(rows) and share.cut == len(found)
    assert truncation.cut_texts(documents.limit(0)).count() == 0


def test_contexts_are_taken_after_folding():
    """Names of 500 characters, long digit runs and other scripts: the last contexts of a text are those counted where it goes on."""
    ends = ["Fin " + "A" * 500, "uno dos A" + "b" * 900 + " tres 1" + "2" * 700, "漢字仮名交じり文", "한국어 문장", "x", "  sangrado Fin"]
    last = truncation._last_contexts(ends)
    for text, contexts in zip(ends, last, strict=True):
        counts = {}
        tally = truncation._Tally()
        everything = lambda c: np.ones(len(c), bool)
        batches = list(truncation._counted("antes\n" + text.lstrip() + "\ndespués\x00", everything, True, tally))
        for batch in (*batches, *tally.rest()):
            for row in batch.to_pylist():
                counts[row["context"]] = counts.get(row["context"], 0) + row["stops"]
        assert all(counts.get(int(c), 0) >= 1 for c in contexts)
    assert len({tuple(c) for c in last}) == len(ends)


def test_counts_in_passes(spark):
    """A filter far too small for its contexts gives the same counts, in several passes."""
    rng = random.Random(8)
    texts = ["\n".join(sentences(rng, 6)) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = sorted({int(c) for row in truncation._last_contexts([t[: rng.randint(20, len(t))] for t in texts]) for c in row})
    wanted = spark.createDataFrame([(c,) for c in asked], "context long")
    whole, parts = ({tuple(r) for r in truncation.context_counts(frame, wanted, bits).join(wanted, "context").collect()} for bits in (27, 12))
    assert whole == parts and len(whole) > 100


# --- 2 ---------------------------------------------------------------------------------------


def test_consistent_form(spark):
    cases = {
        "Ａbierto　２１％": "Abierto 21%", "Sеrvісіoѕ": "Servicios", "Νο prοсedе": "No procede", "2‌‍\xad﻿1 %": "21 %", "Días": "Días", "ＤＩ́ＡＳ": "DÍAS", "DΊAS": "DÍAS", "10\xa0%": "10 %",
        "oﬁcina": "oficina", "EXP‑3/2": "EXP-3/2", "“todo” – l’obra º ª ² · ≥ Ω 50 €": "“todo” – l’obra º ª ² · ≥ Ω 50 €", "Завод Гранит": "Завод Гранит", "Ένωση Δόμηση": "Ένωση Δόμηση", "Ωmega": "Ωmega", "": "", None: None,
        "q̣́": "q̣́", "ạ́": "ạ́", "́x": "́x", "한국 が": "한국 が", "plain text": "plain text",
    }
    frame = spark.createDataFrame([(k, s, e, "clash") for k, (s, e) in enumerate([*cases.items(), *cases.items()])], "k int, s string, e string, form string")
    for row in lookalike.consistent_form(frame, "s", "form").collect():
        assert row.form == row.e, ascii(row.s)
        assert row.form is None or unicodedata.normalize("NFC", row.form) == row.form
    assert lookalike.consistent_form(frame.limit(0), "s", "form").count() == 0
    again = lookalike.consistent_form(frame, "s", "form").select("form")
    assert lookalike.changed_form(again, "form", "twice").filter("twice != form").count() == 0
    assert lookalike.consistent_form(spark.createDataFrame([("é" + "é" * 50_000,)], "s string"), "s", "f").select(F.length("f")).collect()[0][0] == 50_001


def test_form_is_nfc(spark):
    """All compositions of two characters, and random clusters of up to six marks, come out as Unicode's own NFC."""
    rng = random.Random(6)
    marks = [chr(p) for p in range(0x300, 0x370) if unicodedata.combining(chr(p)) and p != 0x34F and len(unicodedata.normalize("NFD", chr(p))) == 1 and unicodedata.normalize("NFC", chr(p)) == chr(p)]
    pairs = [unicodedata.normalize("NFD", chr(p)) for p in range(0xC0, 0x11940) if unicodedata.decomposition(chr(p))[:1] not in ("", "<")]
    pairs = [p for p in pairs if not any(lookalike.unicodedata.category(c) in ("Cf", "Zs") for c in p)]
    clusters = ["".join([rng.choice("aeiounAEIOUsScd"), *rng.choices(marks, k=rng.randint(1, 6))]) for _ in range(400)]
    hangul = ["\u1112\u1161\u11ab", "가\u11a8", "\u1100\u1161", "\u09c7\u09be", "a\u0323\u0302\u0308", "x\u1161", "\u1161", "\u0b47\u0b56"]
    texts = [*pairs, *clusters, *hangul]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    forms = {r.k: r.form for r in lookalike.consistent_form(frame, "s", "form").collect()}
    images = {k: unicodedata.normalize("NFC", "".join(chr(x) for c in t for x in lookalike._image(ord(c)))) for k, t in enumerate(texts)}
    other = [(ascii(t), ascii(forms[k]), ascii(images[k])) for k, t in enumerate(texts) if forms[k] != images[k] and not set(unicodedata.normalize("NFD", t)) & set(lookalike.CYRILLIC_TWINS | lookalike.GREEK_TWINS)]
    assert other == []
    assert len(pairs) > 900


def test_letters_of_other_scripts(spark):
    cases = {"Ꭺbierto": "Abierto", "ꓮbierto": "Abierto", "Contratօ": "Contrato", "ցarantia": "garantia", "Ⲟbra": "Obra", "Ҽ": "Ҽ", "Հայաստան": "Հայաստան", "σ": "σ", "РОСА": "POCA", "РОСА дом": "РОСА дом"}
    frame = spark.createDataFrame([(s, e) for s, e in cases.items()], "s string, e string")
    assert {r.s: r.form for r in lookalike.consistent_form(frame, "s", "form").collect()} == cases
    long = ["z" * 100_000 + " é" + "\u0301" * 3_000, "aé" * 500_000, "aé " * 300_000 + "Ａ"]
    frame = spark.createDataFrame([(x,) for x in long], "s string")
    assert lookalike.consistent_form(frame, "s", "form").filter("length(form) = length(s)").count() == 3


# --- 3 ---------------------------------------------------------------------------------------


def brute_boundary(text, markers):
    cuts = []
    for level in ("marker", "paragraph", "sentence", "word"):
        if level == "marker":
            cuts += [m for m in markers if m is not None]
        elif level == "paragraph":
            cuts += [m.end() for m in re.finditer(r"\n[ \t]*\n[ \t\n]*", text)]
        elif level == "sentence":
            cuts += [m.end() for m in re.finditer(r"[.]\s+(?=[A-Z])", text)]
        else:
            cuts += [m.end() for m in re.finditer(r"\s+", text)]
        edges = [0, *sorted(c for c in set(cuts) if 0 < c < len(text)), len(text)]
        if max(b - a for a, b in itertools.pairwise(edges)) <= 1800:
            return level
    return "hard"


def test_sections_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        text, markers = "", []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                markers.append(len(text))
            text += rng.choice(["Una frase corta. ", "Otra frase algo más larga que la anterior. ", "palabra " * 20]) * rng.randint(1, 60) + rng.choice(["", "\n\n", "\n \n", " ", "x" * rng.randint(1, 3000)])
        pieces, weakest = splitting.pieces(text, [*markers, None, -5, 10**9, *markers])
        assert all(end - start <= 2000 for start, end, _ in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(b[0] == a[1] - 200 for a, b in itertools.pairwise(pieces))
        assert weakest == (brute_boundary(text, markers) if len(text) > 2000 else None)
    assert splitting.pieces(None, []) == ([], None) and splitting.pieces("", [None]) == ([], None)
    assert len(splitting.pieces("x" * 2001, [])[0]) == 2


def test_sections_in_tables(spark):
    schema = "section_id long, text string, segments array<struct<marker:string,start_pos:int>>, boundary string"
    rows = [(1, None, None, "c"), (2, "", [], "c"), (3, "corto", None, "c"), (4, LONG, [("1", None), ("2", 50)], "c"), (4, LONG, None, "c")]
    frame = spark.createDataFrame(rows, schema)
    assert [(r.section_id, r.boundary) for r in splitting.weakest_boundaries(frame).collect()] == [(4, "sentence")] * 2
    assert splitting.split_sections(frame).filter("length(text) > 2000").count() == 0
    assert splitting.split_sections(frame.limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------------------------


def test_best_two_fit():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 2049, 3000), np.full(50, 1000), np.array([2048]), np.array([1] * 5000), np.array([1024, 1024, 1024])):
        bins = packing.best_two_fit(sizes)
        loads = np.bincount(bins, sizes)
        assert (bins >= 0).all() and loads.max() <= 2048 and loads.sum() == sizes.sum()
        assert len(loads) <= sizes.sum() / 2048 * (1.5 if len(sizes) < 3000 else 1.03) + 1
    # the smallest piece, 3, gives way to 2 + 2, which fill the gap of 4
    assert np.bincount(packing.best_two_fit(np.array([6, 3, 2, 2]), 10), [6, 3, 2, 2]).tolist() == [10, 3]


def test_packing_in_tables(spark):
    rows = [(1, None), (2, ""), (3, "hola mundo"), (4, "hola mundo"), (5, LONG)]
    documents = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    packed = packing.pack(packing.token_counts(documents), shard=2).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5} and {r.doc_id for r in packed if r.container_id is None} == {1, 2}
    whole = sorted((r.first_token, r.n_tokens) for r in packed if r.doc_id == 5)
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(whole)) and all(n == 2048 for _, n in whole[:-1])
    assert packing.pack(packing.token_counts(documents.limit(0))).count() == 0
    # how the table is parted doesn't matter, and rows of one key are spread
    sizes = spark.range(3000).selectExpr("id as doc_id", "id * 37 % 2000 + 1 as n_tokens")
    one, other = (sorted(map(tuple, packing.pack(sizes.repartition(n), shard=500).collect())) for n in (1, 7))
    assert one == other and len({c >> 32 for c, *_ in one}) == 6
    hot = packing.pack(sizes.selectExpr("1L as doc_id", "700L as n_tokens"), shard=500)
    assert hot.count() == 3000 and hot.selectExpr("container_id >> 32 as s").distinct().count() == 6


# --- 8 ---------------------------------------------------------------------------------------


def distance_to_part(pattern, text):
    row = [0] * (len(text) + 1)
    for k, word in enumerate(pattern, 1):
        last, row = row, [k]
        for j, other in enumerate(text, 1):
            row.append(min(last[j - 1] + (word != other), last[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        pattern, text = [rng.randint(0, 5) for _ in range(rng.randint(1, 20))], [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        assert leakage.myers(pattern, text) == distance_to_part(pattern, text)


def test_leaks(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    items = [(k, " ".join(rng.sample(words, 40))) for k in range(12)]
    first = items[0][1].split()
    changed = first[:30].copy()
    changed[8], changed[20] = "otra", "nueva"
    documents = [
        (1, "Antes. " + " ".join(first[:18]) + " después."), (2, " ".join(first[:14])), (3, " ".join(changed)), (4, " ".join(first[5:30]).upper().replace("A", "À")), (5, " ".join(first[3:10]) + " " + first[10][:3] + "-\n" + first[10][3:] + "\nPágina 3 de 9\n" + " ".join(first[11:24])),
        (6, None), (7, ""), (8, items[1][1] + " " + items[2][1]), (9, "a\x00 " + " ".join(first[:17])), (10, "relleno " * 50_000 + " ".join(first)), (8, items[1][1]),
    ]
    frame = spark.createDataFrame([(*d, 1) for d in documents], "doc_id long, text string, item_id int")
    table = spark.createDataFrame([*items, (90, None), (91, "pocas palabras"), items[0]], "item_id long, text string")
    expected = {(1, 0), (3, 0), (4, 0), (5, 0), (8, 1), (8, 2), (10, 0)}
    # seventeen shared words, as in 9, are no case
    assert {tuple(r) for r in leakage.leaked(frame, table).collect()} == expected
    assert {tuple(r) for r in leakage.leaked(frame, table, block=60).collect()} == expected
    assert leakage.leaked(frame.limit(0), table).count() == 0 and leakage.leaked(frame, table.limit(0)).count() == 0


# --- 9 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Comparece D.ª Ana Belén Ruiz Soto, con DNI 12345678Z y domicilio en C/ Mayor nº 52.", [("person_name", "Ana Belén Ruiz Soto"), ("id_number", "12345678Z"), ("address", "C/ Mayor nº 52")]),
        ("Fdo.: Soto Vidal, Marta", [("person_name", "Soto Vidal, Marta")]),
        ("Escriba a ana.ruiz+obra@correo.example.org o llame al (+34) 970 12 34 56.", [("email", "ana.ruiz+obra@correo.example.org"), ("phone", "(+34) 970 12 34 56")]),
        ("Correo: ana [arroba] correo [punto] example; móvil: 940/12.34.56", [("email", "ana [arroba] correo [punto] example"), ("phone", "940/12.34.56")]),
        ("Signed by Ms Maud Hill, holder of ID XZA123456, living at Flat 3, 127 Mill Avenue.", [("person_name", "Maud Hill"), ("id_number", "XZA123456"), ("address", "Flat 3, 127 Mill Avenue")]),
        ("Código CPV 94205075-7, inventario INV-970123456, plano 94013083-L, 4 @ 60 W.", []),
        ("Los trabajos afectan a la calle Mayor. El CEIP Vidal cierra. Importe: 940.377.003 euros.", []),
        ("El Ayuntamiento de Villarosa y el Consorcio de Aguas de Montalba.", []),
        ("DNI 12345678A", []), ("", []), (None, []),
    ],
)
def test_mentions(text, expected):
    assert [(kind, text[a:b]) for kind, a, b in pii.mentions(text)] == expected


@pytest.mark.parametrize("name", ["Zoraida Quiñonero Batlle", "Wang Xiaoming", "Ibrahim Traoré", "Oddný Þórsdóttir"])
def test_names_outside_every_list(name):
    texts = [
        f"Fdo.: {name}", f"Comparece D.ª {name}, con DNI 12345678Z.", f"Asisten Ana Ruiz Soto y {name}. Se abre el acto.", f"Datos de contacto:\n{name} / 970 12 34 56", f"Plazo: 3 meses. {name} <buzon@correo.example>",
        f"La llave la tiene quien vive en C/ Mayor 3; vive {name}.", f"Signed by {name}.", f"Se entrega a {name} en la obra.",
    ]
    for text in texts:
        at = text.index(name)
        assert ("person_name", at, at + len(name)) in pii.mentions(text), text


def test_numbers_and_initials():
    text = "+34970123456, 0034 970 12 34 56, X-1234567-L, (+34)970.123.456; 12.345.678-Z ref. 970123456\nH. Soto Vidal / 970123456"
    assert [(kind, text[a:b]) for kind, a, b in pii.mentions(text)] == [
        ("phone", "+34970123456"), ("phone", "0034 970 12 34 56"), ("id_number", "X-1234567-L"), ("phone", "(+34)970.123.456"), ("id_number", "12.345.678-Z"), ("person_name", "H. Soto Vidal"), ("phone", "970123456"),
    ]
    local = "x" * 300
    assert pii.replaced(f"a {local}@correo.example b") == "a [EMAIL] b"


def test_long_lines_take_linear_time():
    one = "Escriba a ana.ruiz@correo.example o llame al 970 12 34 56, "
    began = time.perf_counter()
    small = len(pii.mentions(one * 4_000))
    middle = time.perf_counter()
    large = len(pii.mentions(one * 16_000))
    assert large == 4 * small == 32_000
    assert time.perf_counter() - middle < 12 * (middle - began) + 1
    assert pii.mentions("@" * 200_000 + " A" * 200_000 + "1 " * 200_000) == []


def test_replacing_keeps_the_rest(spark):
    rows = [(1, "Fdo.: Ana Ruiz Soto. Tel. 970 12 34 56."), (2, None), (3, ""), (4, LONG), (1, "Fdo.: Ana Ruiz Soto. Tel. 970 12 34 56.")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, kind string, clean_text string")
    texts = [r.clean_text for r in pii.replace_mentions(frame).orderBy("doc_id").collect()]
    assert texts == ["Fdo.: [PERSON_NAME]. Tel. [PHONE]."] * 2 + [None, "", LONG]
    assert pii.find_mentions(frame).filter("doc_id = 1").count() == 4
    assert pii.find_mentions(frame.limit(0)).count() == 0


def test_every_query_runs(spark):
    for name in ("p1_found", "p2_found", "p3_found", "p7_fill", "p8_items", "p9_found"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
