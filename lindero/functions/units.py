"""Units of measure in strings: segmentation by dynamic programming over tries.

A string such as "miles de €", "M€", "cts. de euro", "EUR million" or "km²" is cut into known parts:
prefixes (scales), roots (with the dimensions that they may have) and exponents, held in one trie
each. An exponent raises prefix and root together and changes the dimension (length to area, time
to no known one). Every way to cut a string has a score, made of the parts' own weights, costs for
parts in an unusual order, and the prior of the resulting dimension in the field at hand; the best
way wins. So "m" is months in a field of time and metres in one of length, "m²" is an area in any
field, and "cent" is the cent in a field of money.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

# The parts of unit strings in Spanish, Catalan and English.
PREFIXES = {
    "k": 1_000, "mil": 1_000, "miles": 1_000, "miles de": 1_000, "miler": 1_000, "milers": 1_000, "milers de": 1_000, "milers d'": 1_000, "thousand": 1_000, "thousands": 1_000,
    "thousands of": 1_000, "m": 1_000_000, "mm": 1_000_000, "mill.": 1_000_000, "mill. de": 1_000_000, "mill": 1_000_000, "mio": 1_000_000, "mio.": 1_000_000, "mn": 1_000_000, "millon": 1_000_000, "millon de": 1_000_000,
    "millones": 1_000_000, "millones de": 1_000_000, "milio": 1_000_000, "milio de": 1_000_000, "milio d'": 1_000_000, "milions": 1_000_000, "milions de": 1_000_000, "milions d'": 1_000_000,
    "million": 1_000_000, "millions": 1_000_000, "millions of": 1_000_000, "c": Fraction(1, 100), "centi": Fraction(1, 100),
    "cent de": Fraction(1, 100), "cents de": Fraction(1, 100), "cent": Fraction(1, 100), "cents": Fraction(1, 100), "cts.": Fraction(1, 100), "cts. de": Fraction(1, 100), "cts": Fraction(1, 100), "cts de": Fraction(1, 100),
    "centimo de": Fraction(1, 100), "centimos de": Fraction(1, 100), "centim de": Fraction(1, 100), "centims de": Fraction(1, 100), "centim d'": Fraction(1, 100), "centims d'": Fraction(1, 100), "centimos": Fraction(1, 100), "centims": Fraction(1, 100),
}
#: root: (dimension, size in the dimension's base: euro cents, days, metres, square metres, pieces)
ROOTS = {
    "€": ("money", 100), "eur": ("money", 100), "euro": ("money", 100), "euros": ("money", 100), "eurs": ("money", 100),
    "cent": ("money", 1), "cents": ("money", 1), "centimo": ("money", 1), "centimos": ("money", 1), "centim": ("money", 1), "centims": ("money", 1), "cts.": ("money", 1), "cts": ("money", 1),
    "d": ("time", 1), "d.": ("time", 1), "dia": ("time", 1), "dias": ("time", 1), "dies": ("time", 1), "day": ("time", 1), "days": ("time", 1), "dias naturales": ("time", 1), "dia natural": ("time", 1), "dies naturals": ("time", 1), "calendar days": ("time", 1),
    "sem.": ("time", 7), "sem": ("time", 7), "semana": ("time", 7), "semanas": ("time", 7), "setmana": ("time", 7), "setmanes": ("time", 7), "week": ("time", 7), "weeks": ("time", 7), "wk": ("time", 7),
    "m": ("time", 30), "m.": ("time", 30), "mes": ("time", 30), "meses": ("time", 30), "mesos": ("time", 30), "month": ("time", 30), "months": ("time", 30),
    "a": ("time", 360), "ano": ("time", 360), "anos": ("time", 360), "any": ("time", 360), "anys": ("time", 360), "year": ("time", 360), "years": ("time", 360), "yr": ("time", 360),
    "metro": ("length", 1), "metros": ("length", 1), "unidades": ("count", 1), "unidad": ("count", 1), "unitats": ("count", 1), "units": ("count", 1), "visitas": ("count", 1), "consultas": ("count", 1), "%": ("share", 1),
}
#: Roots that another dimension has too.
MORE_ROOTS = {
    "m": ("length", 1), "m.": ("length", 1), "meter": ("length", 1), "metre": ("length", 1), "metres": ("length", 1), "metro cuadrado": ("area", 1), "metros cuadrados": ("area", 1), "metre quadrat": ("area", 1), "metres quadrats": ("area", 1),
    "square metre": ("area", 1), "square metres": ("area", 1), "a": ("area", 100), "ha": ("area", 10_000), "hectarea": ("area", 10_000), "hectareas": ("area", 10_000), "d": ("count", 12), "h": ("time", Fraction(1, 24)), "hora": ("time", Fraction(1, 24)), "horas": ("time", Fraction(1, 24)),
    "hores": ("time", Fraction(1, 24)), "hour": ("time", Fraction(1, 24)), "hours": ("time", Fraction(1, 24)), "trimestre": ("time", 90), "trimestres": ("time", 90), "quarter": ("time", 90), "quarters": ("time", 90), "semestre": ("time", 180), "semestres": ("time", 180),
}
EXPONENTS = {"²": 2, "2": 2, "^2": 2, "³": 3, "3": 3, "^3": 3}
#: What a dimension becomes when it is raised; all others have no name and fit no field.
RAISED = {("length", 2): "area", ("length", 3): "volume"}

#: Log-odds of the dimensions in each field: what a column of amounts, terms, measures or numbers of pieces is found to hold.
PRIORS = {
    "money": {"money": -0.1, "share": -3.0, "count": -4.0, "time": -5.0, "area": -6.0, "length": -6.0},
    "time": {"time": -0.1, "count": -3.5, "share": -4.0, "money": -5.0, "length": -6.0, "area": -6.0},
    "length": {"length": -0.1, "area": -2.5, "volume": -3.0, "count": -3.5, "time": -5.0, "money": -6.0},
    "area": {"area": -0.1, "length": -2.5, "volume": -3.0, "count": -3.5, "time": -5.0, "money": -6.0},
    "count": {"count": -0.1, "share": -2.0, "money": -4.0, "time": -4.0, "length": -4.0, "area": -4.0},
}
UNLIKELY = -9.0


@dataclass(frozen=True)
class Unit:
    """A unit as a multiple of the base of its dimension."""

    dimension: str
    size: Fraction
    score: float


def plain(text: str) -> str:
    """Lower case without accents, straight apostrophes, single spaces; ñ becomes n."""
    text = unicodedata.normalize("NFKD", text.replace("’", "'"))
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip().lower()


def _trie(*tables: dict) -> dict:
    root: dict = {}
    for table in tables:
        for word, value in table.items():
            node = root
            for ch in word:
                node = node.setdefault(ch, {})
            node.setdefault("", []).append(value)
    return root


_TRIES = {"prefix": _trie(PREFIXES), "root": _trie(ROOTS, MORE_ROOTS), "exponent": _trie(EXPONENTS)}
#: Part after part, and its cost; "" is the start. A prefix may follow its root ("EUR million", "EUR cent").
_ORDER = {("", "prefix"): 0.0, ("", "root"): 0.0, ("prefix", "root"): 0.0, ("prefix", "prefix"): -0.5, ("root", "exponent"): 0.0, ("root", "prefix"): -1.0}
#: No unit has more words than two prefixes and a root.
_WORDS_OF_UNIT = 2 * max(len(w.split()) for w in PREFIXES) + max(len(w.split()) for w in (*ROOTS, *MORE_ROOTS))


def _matches(text: str, at: int, kind: str) -> list[tuple[int, object]]:
    out, node = [], _TRIES[kind]
    for k in range(at, len(text) + 1):
        out += [(k, value) for value in node.get("", ())]
        if k == len(text) or text[k] not in node:
            break
        node = node[text[k]]
    return out


@lru_cache(65536)
def segment(text: str, field: str) -> Unit | None:
    """The best reading of the whole string as a unit, in a field of dimension `field`; None if it is none."""
    text = plain(text.replace("²", "^2").replace("³", "^3")).strip("().,:; ")
    priors = PRIORS.get(field, {})
    # (position, last part, dimension) -> (score, size)
    best: dict[tuple[int, str, str], tuple[float, Fraction]] = {(0, "", ""): (0.0, Fraction(1))}
    by_place: dict[int, set[tuple[str, str]]] = {0: {("", "")}}
    for at in range(len(text)):
        for last, dimension in sorted(by_place.get(at, ())):
            score, size = best[at, last, dimension]
            skip = at
            while skip < len(text) and text[skip] in " -" and at:
                skip += 1
            for kind in ("prefix", "root", "exponent"):
                cost = _ORDER.get((last, kind))
                if cost is None:
                    continue
                for end, value in _matches(text, skip, kind):
                    gain, after, now = score + cost + 0.1 * (end - skip), dimension, kind
                    if kind == "root":
                        joined = skip == at and last == "prefix" and at > 3 and text[at - 1].isalpha() and text[skip].isalpha()
                        after, grown, gain = value[0], size * value[1], gain - 3.0 * joined
                    elif kind == "exponent":
                        after, grown = RAISED.get((dimension, value), f"{dimension}^{value}"), size**value
                    else:
                        grown, now = size * Fraction(value), "after" if last == "root" else kind
                    key = (end, now, after)
                    if key not in best or best[key][0] < gain:
                        best[key] = (gain, grown)
                        by_place.setdefault(end, set()).add((now, after))
    done = [(best[len(text), last, dimension][0] + priors.get(dimension, UNLIKELY), dimension, best[len(text), last, dimension][1]) for last, dimension in sorted(by_place.get(len(text), ())) if last in ("root", "exponent", "after")]
    if not done or not text:
        return None
    score, dimension, size = max(done, key=lambda d: d[0])
    return Unit(dimension, size, score)


_PHRASE = re.compile(r"[^\W\d_]+(?:[.'’](?=\s|$|[^\W\d_]))?|[€%]|[²³]")


@lru_cache(65536)
def unit_in_note(note: str, field: str) -> Unit | None:
    """The unit that a free note names: the longest, then best-scoring, run of its words that reads as a unit of the field."""
    best: tuple[int, float, Unit] | None = None
    words = [(m.start(), m.end()) for m in _PHRASE.finditer(note)]
    for k in range(len(words)):
        for j in range(k, min(len(words), k + _WORDS_OF_UNIT)):
            part = note[words[k][0] : words[j][1]]
            if re.search(r"\.\s+[A-ZÀ-Þ]", part) or "(" in part or ":" in part:
                break
            unit = segment(part, field)
            if unit and unit.dimension == field and (len(plain(part).strip(".")) > 1 or part in "€"):
                found = (len(part), unit.score, unit)
                if best is None or found[:2] > best[:2]:
                    best = found
    return best[2] if best else None


# Number words of the three languages (plain form).
_WORDS = {
    "un": 1, "una": 1, "uno": 1, "one": 1, "a": 1, "dos": 2, "dues": 2, "two": 2, "tres": 3, "three": 3, "cuatro": 4, "quatre": 4, "four": 4, "cinco": 5, "cinc": 5, "five": 5, "seis": 6, "sis": 6, "six": 6,
    "siete": 7, "set": 7, "seven": 7, "ocho": 8, "vuit": 8, "eight": 8, "nueve": 9, "nou": 9, "nine": 9, "diez": 10, "deu": 10, "ten": 10, "once": 11, "onze": 11, "eleven": 11, "doce": 12, "dotze": 12, "twelve": 12,
    "trece": 13, "tretze": 13, "thirteen": 13, "catorce": 14, "catorze": 14, "fourteen": 14, "quince": 15, "quinze": 15, "fifteen": 15, "dieciseis": 16, "setze": 16, "sixteen": 16, "diecisiete": 17, "disset": 17, "seventeen": 17,
    "dieciocho": 18, "divuit": 18, "eighteen": 18, "diecinueve": 19, "dinou": 19, "nineteen": 19, "veinte": 20, "vint": 20, "twenty": 20, "veintiun": 21, "veintiuno": 21, "veintiuna": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24,
    "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29, "treinta": 30, "trenta": 30, "thirty": 30, "cuarenta": 40, "quaranta": 40, "forty": 40, "cincuenta": 50, "cinquanta": 50, "fifty": 50,
    "sesenta": 60, "seixanta": 60, "sixty": 60, "setenta": 70, "seventy": 70, "ochenta": 80, "vuitanta": 80, "eighty": 80, "noventa": 90, "noranta": 90, "ninety": 90, "cien": 100, "ciento": 100, "hundred": 100,
    "medio": Fraction(1, 2), "media": Fraction(1, 2), "mig": Fraction(1, 2), "mitja": Fraction(1, 2), "half": Fraction(1, 2),
}
_NUMBER = re.compile(r"\d[\d.,]*\d|\d")
_PART = re.compile(rf"({_NUMBER.pattern})|([€%]|[^\W\d_]+(?:[.'’](?=\s|$|[^\W\d_€]))?)")


def number_of(text: str, english: bool = False) -> Fraction | None:
    """A printed number by its own convention: the later of . and , is the decimal mark; a single one followed by three digits groups."""
    dot, comma = text.rfind("."), text.rfind(",")
    mark = ""
    if dot >= 0 and comma >= 0:
        mark = "." if dot > comma else ","
    elif dot >= 0 or comma >= 0:
        one = "." if dot >= 0 else ","
        grouped = re.fullmatch(rf"\d{{1,3}}(?:\{one}\d{{3}})+", text)
        if not grouped or (text.count(one) == 1 and (one == "." if english else one == ",") and text.startswith("0")):
            mark = one
    if mark and text.count(mark) > 1:
        return None
    whole = text.replace("," if mark == "." else ".", "").replace(mark or "\0", ".")
    try:
        return Fraction(whole)
    except ValueError:
        return None


@dataclass(frozen=True)
class Quantity:
    """An amount in the base of its dimension; `own` tells whether the text itself named a unit, `unit` is its size."""

    amount: Fraction
    unit: Fraction | None


@lru_cache(65536)
def quantity(text: str, field: str) -> Quantity | None:
    """The quantity that a text states: the sum of its number-unit parts ("2 años y 2 meses", "1 millón 120 mil euros", "UN MES", "año y medio")."""
    flat = plain(text)
    flat = re.sub(r"(\d+)\s*\([^)\d]*\)", r"\1", flat)  # 3 (tres) meses
    flat = re.sub(r"[^\W\d_]+(?: i | y |-)?[^\W\d_]*\s*\((\d+)\)", r"\1", flat)  # OCHO (8) MESES
    numbers: list[tuple[Fraction, str]] = []
    lead = ""
    pending: Fraction | None = None
    words: list[str] = []

    def close() -> None:
        nonlocal pending, words
        if pending is not None:
            numbers.append((pending, " ".join(words)))
        pending, words = None, []

    for m in _PART.finditer(flat):
        if m.group(1):
            close()
            pending = number_of(m.group(1), english=lead.startswith(("eur", "€")) and not lead.startswith("euros"))
            if pending is None:
                return None
            continue
        word = m.group(2)
        value = _WORDS.get(word)
        if value is not None and (pending is None or words) and not (word == "a" and pending is not None):
            if isinstance(value, Fraction) and words and words[-1] in ("y", "i", "and") and pending is not None:
                pending += value
                words.pop()
                continue
            if pending is not None and words and words[-1] in ("y", "i") and len(words) == 1 and pending >= 20:
                pending += value
                words.pop()
                continue
            close()
            pending = Fraction(value)
            continue
        if pending is None and not numbers and word in ("ano", "any", "year", "mes", "month", "semana", "setmana", "week"):
            pending = Fraction(1)
        if pending is None and not numbers:
            lead = f"{lead} {word}".strip()
        else:
            words.append(word)
    close()
    if not numbers:
        return None
    cleaned = [(n, re.sub(r"^(?:y|i|and) | (?:y|i|and)$|^(?:y|i|and)$", "", w).strip()) for n, w in numbers]
    # a scale without a root belongs to the root that follows: 1 millón 120 mil euros
    units: list[Unit | None] = [segment(w, field) if w else None for _, w in cleaned]
    root = next((u for u in reversed(units) if u and u.dimension == field), None)
    if root is None:
        unit = unit_in_note(lead, field) if lead else None
        tail = next((u for _, w in cleaned if w and (u := unit_in_note(w, field))), None)
        scale = next((Fraction(PREFIXES[w]) for _, w in cleaned if w in PREFIXES), Fraction(1))
        unit = unit or tail
        if len(cleaned) > 1 and not unit:
            return None
        if unit:
            return Quantity(cleaned[0][0] * unit.size * scale, unit.size * scale)
        return Quantity(cleaned[0][0], None) if len(cleaned) == 1 and not cleaned[0][1] else None
    total = Fraction(0)
    sizes = []
    for (n, w), unit in zip(cleaned, units, strict=True):
        if unit and unit.dimension == field:
            size = unit.size
        elif w in PREFIXES:
            size = PREFIXES[w] * Fraction(100 if field == "money" else 1)
        else:
            return None
        total += n * size
        sizes.append(size)
    return Quantity(total, sizes[0] if len(set(sizes)) == 1 else max(sizes))
