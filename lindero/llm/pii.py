"""Problem 9: personal information in free text, by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs and their spelt forms, heads of
runs of digits, street words, titles and cues of names, common given names. From each anchor a
deterministic local parser expands to the left and right and validates what it found: the domain
and its dots, a country prefix and nine digits in groups, the letters around a number and the check
letter, a street's building number, the shape of a name. A name is told by its context and shape:
capitalised words behind a title or a cue, beside another mention of the same person, or joined to
a name; the list of given names only helps where the context is weak. Overlaps are settled by kind
and position, and each mention is replaced by its typed placeholder.

No parser looks further than its grammar reaches, and what stands beside a mention is looked for
from the end of the mention before, so a text takes time in proportion to its length.

Defined results: null stays null, a text without mentions stays as it is; positions are 0-based
code points; equal mentions are each reported; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of the three languages by which mentions are recognised.
AT_SIGNS = ("@", "＠", "(at)", "[at]", "(arroba)", "[arroba]")
STREETS_BEFORE = (
    "calle", "c/", "c.", "avda.", "avda", "av.", "avenida", "avinguda", "paseo", "passeig", "pº", "pg.", "plaza", "plaça", "pl.", "pza.",
    "camino", "camí", "cami", "carrer", "c/.", "ronda", "travesía", "travessera", "callejón", "glorieta", "rambla", "urbanización", "cuesta",
)
STREETS_AFTER = ("street", "st.", "road", "rd.", "avenue", "ave.", "lane", "square", "drive", "close", "terrace", "way", "court", "place", "row", "hill", "gardens")
TITLES = (
    "d.ª", "d.", "dª", "dña.", "dn.", "don", "doña", "sr.", "sra.", "srta.", "sr. d.", "sra. d.ª", "el sr.", "la sra.", "el señor", "la señora",
    "en", "na", "el senyor", "la senyora", "mr", "mrs", "ms", "miss", "dr", "dra.", "dr.", "mr.", "mrs.", "ms.", "prof.", "sir", "el ingeniero", "la ingeniera",
    "el arquitecto", "la arquitecta", "el arquitecte", "l'arquitecta", "l'enginyer", "l'enginyera", "el letrado", "la letrada",
)
#: What stands right before a name, after which a title may come.
NAME_CUES = (
    "fdo.:", "fdo:", "fdo.", "firmado:", "firmado por", "firma:", "signat:", "signat per", "signed:", "signed by", "nombre:", "nombre", "nom:", "name:",
    "a nombre de", "a nom de", "a la atención de", "a l'atenció de", "atención de", "for the attention of", "dirigirse a", "adreceu-vos a", "questions go to",
    "preside", "presideix", "como vocal", "com a vocal", "asisten", "asiste", "hi assisteixen", "assisteixen", "present:", "presentes:", "asistentes:",
    "responsable:", "responsable,", "contacto:", "datos de contacto:", "contacte:", "dades de contacte:", "contact:", "contact details:",
    "el informe de", "l'informe de", "the report by", "informe de", "entregar a", "lliurar a", "deliver to", "se advirtió a", "se avisó a", "s'ha advertit", "s'avisà",
    "comparece", "compareix", "reclamó", "reclamà", "firma la oferta", "la oferta", "lo recogió", "ho va recollir", "recogió", "autoriza la entrada", "la entrada", "según indica", "segons indica",
    "remite:", "remet:", "de:", "from:", "per:", "para:", "to:", "vive", "viu", "lives", "demaneu per", "preguntar por", "pregunte por", "ask for", "held by", "is held by", "signa", "firma",
    "atendió", "llamó", "escribió", "presentó", "by", "notifíquese a", "vocal", "secretario", "secretaria", "firmante", "titular", "titular:", "interesado:", "interesada:",
    "representada por", "representado por", "representant:", "representante:", "persona de contacto:", "beneficiario:", "declarante:", "warned", "told", "for", "to", "a",
)
#: Cues so common that a name after them needs a given name or initial of its own, or words that the text doesn't use otherwise.
WEAK_CUES = {"by", "for", "to", "a", "en", "na", "la oferta", "la entrada", "de:", "per:", "para:", "to:", "from:", "titular", "secretario", "secretaria", "c."}
GIVEN = frozenset(
    """Aitor Alba Albert Alberto Alejandra Alejandro Alex Alfonso Alice Alicia Amy Ana Anabel Andrés Andreu Andrew Ángel Ángela Anna Anne Antoni Antonio Arnau
    Arthur Beatriz Begoña Belén Ben Bernat Bruno Carla Carles Carlos Carme Carmen Carolina Cecilia Charlotte Clara Claudia Colin Cristina Daniel David Diana Diego
    Edwin Elena Elisa Eloi Emily Emma Encarna Enric Enrique Esther Eva Felipe Félix Fernando Ferran Fiona Francesc Francisco Gemma George Gerard Gloria Gonzalo
    Grace Guillem Harriet Harry Helen Henry Hugo Ignacio Imogen Inés Íngrid Irene Isabel Iván Jack Jacob Jaime James Jane Jaume Javier Joan Joana John Jordi Jorge
    José Josep Juan Juana Judith Julia Julián Juliet Karen Kate Laia Laura Leonor Lluís Lorenzo Lucía Luis Manuel Marc Marcos Margaret Margarita María Maria Mariano
    Marta Martí Martín Mary Maud Mercè Mercedes Miguel Miquel Mireia Mònica Mónica Montserrat Natalia Nicolás Nora Noelia Nuria Núria Oliver Olga Óscar Oriol Pablo
    Paula Pau Pedro Pere Peter Phoebe Pilar Rafael Ramón Ramon Raquel Raúl Rebeca Ricardo Robert Roberto Rosa Rosario Rubén Rupert Salvador Sara Sarah Sergi Sergio
    Silvia Sofía Sonia Susana Teresa Tessa Thomas Tomás Toni Vicente Victor Víctor Walter William Xavier Yolanda""".split()
)
ORGANISATIONS = frozenset(
    """ayuntamiento ajuntament diputación diputació consorcio consorci mancomunidad mancomunitat patronato patronat consell consejo council board office service
    comarca comarcal registro registre mesa junta comisión comissió comité servicio servei departamento área dirección direcció intervención secretaría secretaria unión ministerio
    fundación fundació cooperativa empresa sociedad construcciones construccions obras serveis servicios grupo grup instituto institut escuela escola colegio ceip ies hospital centro centre
    biblioteca gremio gremi cofradía town county health clause cláusula clàusula anexo annex annexe apartado sección apartat título total importe valor
    estimated value estimado estimat plazo objeto fecha expediente expedient file código codi cpv iva dni nif nie euros eur el la los las lo els les the this that if when under 
    una un se conforme salvo no en al por para cuando si con toda antes quedan ref referencia página pàgina page correo domicilio móvil
    telèfon teléfono aquest aquesta d'acord tot amb s.l. s.a. sl sa ltd inc plc""".split()
)
# Words after which a capitalised name is that of a place or institution, and words that may stand between.
PLACES = frozenset(
    """calle carrer c/ avda. avda av. avenida avinguda paseo passeig pg. plaza plaça camino camí ceip ies escola colegio centro school hospital puente pont biblioteca parque parc polígono polígon
    término terme barrio barri almacén mercado vecinal gremio ayuntamiento diputación fundación fundació instituto institut empresa cofradía along in at between entre premio bridge pavelló pabellón""".split()
)
ARTICLES = frozenset(("de", "del", "la", "el", "d'"))

_UP = "A-ZÀ-ÖØ-Þ"
_AFTER_AT = re.compile(r"\s?([A-Za-z0-9](?:[\w-]*\w)?(?:(?:\.|\s?[\[(](?:punto|dot|punt)[\])]\s?)[A-Za-z0-9](?:[\w-]*\w)?)+)")
_PHONE = re.compile(r"(?<![\w.,/@-])((?:\(\s?(?:\+|00)\s?34\s?\)|(?:\+|00)\s?34)[ .-]?)?([6-9]\d(?:[ ./-]?\d){7})(?![\d@]|[.,/-]\d|[ -]?[A-Za-z](?![a-zà-ÿ])|[-.]?\w*@)")
_AMOUNT = re.compile(r"\s*(?:€|EUR|eur|mil|k€|M€|%)")
_NIF = re.compile(r"(?<![\w.-])(?:([XYZxyz])[- ]?(\d{7})|(\d{8}|\d{1,2}\.\d{3}\.\d{3}))[- ]{0,2}([A-Za-z])(?!\w)")
_PASSPORT = re.compile(r"(?<![\w-])[A-Z]{2,3}\d{6}(?!\w)")
CODES = frozenset("plano plànol drawing ref referencia referència reference inventario código codi code tagged núm expediente note informe probe".split())
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_NUMBER = r"(?:,?\s*(?:núm(?:ero|\.)?|n\.?\s?[ºo°]\.?|nº|no\.|number)\s*|,\s*|\s+)\d{1,4}(?:\s?(?:bis|[A-Za-z])(?![\w]))?(?![\d.]*\d)"
_STREET_NAME = rf"(?:(?:de|del|dels|de la|de las|de los|de les|d'|la|el|en)\s+){{0,2}}(?:[{_UP}][\w'’·-]*)(?:\s+(?:(?:de|del|dels|la|i|y|de la)\s+){{0,2}}[{_UP}][\w'’·-]*){{0,4}}"
_AFTER_STREET = re.compile(rf"\s*{_STREET_NAME}{_NUMBER}")
_NUMBERED = re.compile(r"\d{1,4}[A-Za-z]?")
_STREET_WORD = re.compile(rf"[{_UP}][\w'’-]*")
_UNIT = re.compile(r"(?:Flat|Unit|Apt\.?|Apartment)")
_TOKEN = re.compile(rf"(?:[{_UP}]\.(?:\s?-?[{_UP}]\.)*|[{_UP}][{_UP}a-zà-öø-ÿ'’·]+(?:-[{_UP}][\w'’·]+)*)")
_JOIN = re.compile(r" (?:(de la|de las|de los|del|de|dels|i|y|e|van|von|da|dos) )?", re.I)
_TITLE = re.compile(r"(?:(?:el|la|al|els|l['’]|a)\s+)?(?:(?:" + "|".join(re.escape(t) for t in sorted((t for t in TITLES if t not in ("en", "na")), key=len, reverse=True)) + r")\s+)+|(?:en|na)\s+", re.I)

_FOLD_GIVEN = {g.upper() for g in GIVEN}


def _is_given(token: str) -> bool:
    return token.upper() in _FOLD_GIVEN


def _is_initial(token: str) -> bool:
    return token.endswith(".")


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The span of the run of non-blanks that ends before the blanks before `at`."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return start, end


def _after_code(text: str, at: int) -> bool:
    start, end = _word_before(text, at)
    return text[start:end].lower().strip(".:(") in CODES


def _after_place(text: str, at: int) -> bool:
    start, end = _word_before(text, at)
    for _ in range(2):
        if text[start:end].lower() not in ARTICLES:
            break
        start, end = _word_before(text, start)
    return text[start:end].lower().lstrip("(«\"'") in PLACES


class _Text:
    """A text and, worked out when first asked for, the words that it uses in lower case."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._used: frozenset[str] | None = None

    def uses(self, word: str) -> bool:
        if self._used is None:
            self._used = frozenset(w for w in _WORD.findall(self.text) if w[0].islower())
        return word.lower() in self._used


_WORD = re.compile(r"[^\W\d_]+")


def _follows(text: str, at: int) -> re.Match | None:
    """The capitalised word that joins the one that ends at `at`."""
    join = _JOIN.match(text, at)
    return _TOKEN.match(text, join.end()) if join else None


def parse_name(seen: _Text, at: int, weak: bool = False) -> tuple[int, int] | None:
    """The span of a person's name that begins at `at`, or None.

    A name has up to two given names and two surnames, or surnames, a comma and given names. Where
    the context is `weak`, one of its words must be known, or all must be words that the text
    doesn't use in lower case.
    """
    text, tokens, end = seen.text, [], at
    while len(tokens) < 7:
        start = end
        if tokens:
            join = _JOIN.match(text, end)
            if not join:
                break
            start = join.end()
            if (join.group(1) or "").lower() in ("i", "y", "e"):
                # a second surname, or another person with a given name
                other = _TOKEN.match(text, start)
                bare = sum(not _is_given(t) and not _is_initial(t) for t in tokens)
                if not other or _is_given(other.group()) or _is_initial(other.group()) or bare - (bare == len(tokens)) != 1:
                    break
                if (more := _follows(text, other.end())) and more.start() == other.end() + 1 or text.startswith(", ", other.end()) and (more := _TOKEN.match(text, other.end() + 2)) and _is_given(more.group()):
                    break
        token = _TOKEN.match(text, start)
        if not token or token.group().lower().strip(".") in ORGANISATIONS:
            break
        bare = sum(not _is_given(t) and not _is_initial(t) for t in tokens)
        if tokens and bare >= (2 if bare < len(tokens) else 4) or _is_initial(token.group()) and bare:
            break
        tokens.append(token.group())
        end = token.end()
    if not tokens or _is_initial(tokens[-1]):
        return None
    known = any(_is_given(t) or _is_initial(t) for t in tokens)
    if not (_is_given(tokens[0]) or _is_initial(tokens[0])) and text.startswith(", ", end):
        more, names = end + 2, 0
        while names < 3 and (token := _TOKEN.match(text, more)) and (_is_given(token.group()) or _is_initial(token.group())):
            end, names, known = token.end(), names + 1, True
            if not text.startswith(" ", end):
                break
            more = end + 1
    if len(tokens) == 1 and (weak or not known) and " " not in text[at:end]:
        return None
    if weak and not known and (any(t.isupper() or seen.uses(t) for t in tokens) or _after_place(text, at)):
        return None
    if end < len(text) and (text[end].isalnum() or text[end] == "@"):
        return None
    return at, end


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    heads = [a + b for a in "0123456789" for b in "0123456789."]
    for kind, words in (("at", AT_SIGNS), ("digits", heads), ("street", STREETS_BEFORE), ("street_after", STREETS_AFTER), ("title", TITLES), ("cue", NAME_CUES), ("given", [g.lower() for g in GIVEN])):
        for word in words:
            kinds.setdefault(word.lower(), set()).add(kind)
    for word, kind in kinds.items():
        found.add_word(word, (word, tuple(sorted(kind))))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _emails(text: str, at: int, sign: str) -> tuple[int, int] | None:
    after = _AFTER_AT.match(text, at + len(sign))
    if not after or not re.search(r"[A-Za-z]", after.group(1).rpartition(".")[2]):
        return None
    start = end = at - (at > 0 and text[at - 1].isspace())
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%'-"):
        start -= 1
    if start == end or not (text[end - 1].isalnum() or text[end - 1] == "_"):
        return None
    return start, after.end()


def _numbers(text: str, at: int) -> Iterator[tuple[int, str, int, int]]:
    """Identity and phone numbers whose first run of digits, or its prefix, stands at `at`."""
    for start in range(at, max(-1, at - 4), -1):
        if m := _NIF.match(text, start):
            digits = (m.group(2) or m.group(3)).replace(".", "")
            number = int({"X": "0", "Y": "1", "Z": "2"}.get((m.group(1) or "").upper(), "") + digits)
            if len(digits) == (7 if m.group(1) else 8) and _LETTERS[number % 23] == m.group(4).upper():
                yield 1, "id_number", m.start(), m.end()
        if (m := _PASSPORT.match(text, start)) and not _after_code(text, start):
            yield 1, "id_number", m.start(), m.end()
        if (m := _PHONE.match(text, start)) and min(map(len, re.split(r"\D", m.group(2)))) > 1:
            if m.group(1) is not None or not (_AMOUNT.match(text, m.end()) or _after_code(text, start)):
                yield 2, "phone", m.start(), m.end()


def _street_before(text: str, at: int) -> int | None:
    """Where an address of number and street begins whose street word stands at `at`."""
    place, words = at, 0
    while True:
        start, end = _word_before(text, place)
        if start == end:
            return None
        if words and _NUMBERED.fullmatch(text, start, end):
            break
        if words == 3 or not _STREET_WORD.fullmatch(text, start, end):
            return None
        place, words = start, words + 1
    door, stop = _word_before(text, start)
    if stop > door and text[stop - 1] == ",":
        unit, close = _word_before(text, door)
        if close > unit and _UNIT.fullmatch(text, unit, close):
            return unit
    return start


def mentions(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each mention, in order, without overlaps."""
    if not text:
        return []
    low, seen = _lower(text), _Text(text)
    spans: list[tuple[int, str, int, int]] = []
    given: list[int] = []
    for last, (word, kinds) in _ANCHORS.iter(low):
        start, end = last + 1 - len(word), last + 1
        if "at" in kinds:
            if span := _emails(text, start, word):
                spans.append((0, "email", *span))
            continue
        if "digits" in kinds:
            if not (start and text[start - 1].isdigit()):
                spans += _numbers(text, start)
            continue
        if start and low[start - 1].isalnum() or end < len(low) and word[-1].isalnum() and low[end].isalnum():
            continue
        if "street" in kinds and (m := _AFTER_STREET.match(text, end)) and (text[end : end + 1] in " " or word.endswith(("/", "."))):
            spans.append((3, "address", start, m.end()))
        if "street_after" in kinds and text[start].isupper() and (begin := _street_before(text, start)) is not None:
            spans.append((3, "address", begin, end))
        if "given" in kinds and text[start].isupper():
            given.append(start)
        if "title" in kinds or "cue" in kinds:
            at = end
            while at < len(text) and text[at] in " \t":
                at += 1
            if word.endswith(":") and at < len(text) and text[at] == "\n":
                at += 1
            weak = word in WEAK_CUES
            if "cue" in kinds and (title := _TITLE.match(text, at)):
                at, weak = title.end(), False
            if span := parse_name(seen, at, weak):
                spans.append((4, "person_name", *span))
    for at in given:
        if not _after_place(text, at) and (span := parse_name(seen, at, True)) and " " in text[span[0] : span[1]]:
            spans.append((5, "person_name", *span))
    spans += [(5, "person_name", *span) for span in _beside(seen, spans)]
    spans += [(5, "person_name", *span) for span in _joined(seen, spans)]
    spans.sort(key=lambda s: (s[0], s[2] if s[0] == 4 else 0, s[2] - s[3], s[2]))
    taken: list[tuple[str, int, int]] = []
    used = bytearray(len(text))
    for _, kind, start, end in spans:
        if not any(used[start:end]):
            used[start:end] = b"\x01" * (end - start)
            taken.append((kind, start, end))
    return sorted(taken, key=lambda t: t[1])


_GAP = " ,/<([\n;:-"
#: Where a clause ends; the dot of an initial ends none.
_CLAUSE = re.compile(rf"\n|: |(?<=\.)(?<!\b[{_UP}]\.) ")
_AND = re.compile(r",? (?:y|i|e|and) (?=[^\W\d_])")


def _beside(seen: _Text, spans: list[tuple[int, str, int, int]]) -> Iterator[tuple[int, int]]:
    """Names that stand right before another mention of the same person, as in lists of contacts.

    Each is looked for between the mention before and its own; one without a known word must begin there.
    """
    text, before = seen.text, 0
    for start, end in sorted((start, end) for _, kind, start, end in spans if kind != "person_name"):
        stop = start
        while stop > before and start - stop < 4 and text[stop - 1] in _GAP:
            stop -= 1
        if stop < start:
            edge = before + max((m.end() for m in _CLAUSE.finditer(text[before:stop])), default=0)
            for m in _TOKEN.finditer(text, edge, stop):
                if not (span := parse_name(seen, m.start(), True) or (parse_name(seen, m.start()) if not text[edge : m.start()].strip(" ;,-*•·") else None)):
                    continue
                if span[1] == stop:
                    yield span
                    break
        before = max(before, end)


def _joined(seen: _Text, spans: list[tuple[int, str, int, int]]) -> Iterator[tuple[int, int]]:
    """Names that a conjunction joins to a name found before."""
    todo = [end for _, kind, _, end in spans if kind == "person_name"]
    while todo:
        if join := _AND.match(seen.text, todo.pop()):
            title = _TITLE.match(seen.text, join.end())
            if span := parse_name(seen, title.end() if title else join.end()):
                yield span
                todo.append(span[1])


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}


def replaced(text: str | None) -> str | None:
    """The text with each mention replaced by its placeholder."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in mentions(text):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]


def find_mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start_pos, end_pos): a row for each mention; no shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for place, value in enumerate(batch.column(1).to_pylist()):
                for row in mentions(value):
                    keys.append(place)
                    rows.append(row)
            columns = [batch.column(0).take(pa.array(keys, pa.int32())), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "kind", "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(scan, f"`{key}` {kind}, kind string, start_pos int, end_pos int")


def replace_mentions(documents: DataFrame, text: str = "text", to: str = "clean_text") -> DataFrame:
    """`documents` with the text whose mentions are replaced in column `to`."""

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(replaced, na_action="ignore")

    return documents.withColumn(to, clean(text))
