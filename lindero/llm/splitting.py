"""Problem 3: cutting oversized sections at natural boundaries, with overlap.

Agglomerative merging. A text starts as atoms: every white space, sentence end, blank line and
segment start is a boundary of its own strength, and stretches without any of them get hard
boundaries. Adjacent atoms stand in a heap by the strength of the boundary between them, weakest
first, then by their joint size; a pair is merged if its size plus the overlap is within the
limit. A pair that doesn't fit once never fits later, so what remains is cut at the strongest
boundaries that the limit allows, and the weakest boundary that remains is the coarsest one which
with all coarser ones leaves no stretch over limit - overlap.

Defined results: null and empty texts give no pieces, texts within the limit one; segments may be
null, out of order, repeated or outside the text; ties are merged from the left; a text of any
length takes O(n log n). Piece k > 1 begins `overlap` characters before its own part, so it
shares exactly these with the piece before; a first part shorter than the overlap is joined to
the second (they fit, as a first piece has no overlap of its own).
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
LEVELS = ("hard", "word", "sentence", "paragraph", "marker")
#: Distance of hard boundaries in a stretch that has no other.
HARD_STEP = 100

_SPACE = re.compile(r"\s+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+(?=[\"'«“‘(\[¿¡–—-]*[^\sa-zà-öø-ÿ])")
_LAST_WORD = re.compile(r"(?<![^\s(«“\"'])[^\W\d_]+[ªº]?$")
# Abbreviations that don't end a sentence.
_ABBREVIATIONS = frozenset("art arts núm num n nº no sr sra srta d dª dña dr dra prof pág pàg págs p pp ref fdo máx mín max min aprox av avda c cap apdo tel etc ej cf vs mr mrs ms st".split())


def boundaries(text: str, markers: list[int | None], longest: int) -> dict[int, int]:
    """Position to strength (an index of LEVELS) of each boundary inside the text."""
    found = {m.end(): 1 for m in _SPACE.finditer(text)}
    for m in _SENTENCE.finditer(text):
        word = _LAST_WORD.search(text, max(0, m.start() - 12), m.start())
        if m.group(0)[0] != "." or not word or word.group().lower() not in _ABBREVIATIONS:
            found[m.end()] = 2
    found.update((m.end(), 3) for m in _BLANK_LINE.finditer(text))
    found.update((m, 4) for m in markers if m is not None)
    found = {at: level for at, level in found.items() if 0 < at < len(text)}
    edges = [0, *sorted(found), len(text)]
    for left, right in zip(edges, edges[1:], strict=False):
        if right - left > longest:
            for at in range(left + HARD_STEP, right, HARD_STEP):
                while at < right and unicodedata.combining(text[at]):
                    at += 1
                if at < right:
                    found[at] = 0
    return found


def _needed(found: dict[int, int], size: int, most: int) -> dict[int, int]:
    """Without the boundaries that are sure to be merged: those in a stretch between stronger ones that fits as a whole."""
    for level in range(4):
        edges = [0, *(at for at in sorted(found) if found[at] > level), size]
        weak = iter([at for at in sorted(found) if found[at] == level])
        at = next(weak, None)
        for left, right in zip(edges, edges[1:], strict=False):
            while at is not None and at < right:
                if right - left <= most:
                    del found[at]
                at = next(weak, None)
    return found


def merged(text: str, markers: list[int | None], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at start; -1 for the first) of the parts left after merging."""
    most = limit - overlap
    found = _needed(boundaries(text, markers, most), len(text), most)
    starts = [0, *sorted(found)]
    ends = [*starts[1:], len(text)]
    before, after = list(range(-1, len(starts) - 1)), [*range(1, len(starts)), -1]
    alive = [True] * len(starts)
    heap = [(found[starts[k]], ends[k] - starts[k - 1], k) for k in range(1, len(starts))]
    heapq.heapify(heap)
    while heap:
        level, size, k = heapq.heappop(heap)
        left = before[k]
        if not alive[k]:
            continue
        now = ends[k] - starts[left]
        if now > most:
            continue
        if now != size:
            heapq.heappush(heap, (level, now, k))
            continue
        ends[left], after[left] = ends[k], after[k]
        if after[k] >= 0:
            before[after[k]] = left
        alive[k] = False
    return [(starts[k], ends[k], found[starts[k]] if k else -1) for k in range(len(starts)) if alive[k]]


def pieces(text: str | None, markers: list[int | None], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], str | None]:
    """The pieces (start, end, boundary of their own part), and the weakest boundary used (null if the text fits)."""
    if not text:
        return [], None
    if len(text) <= limit:
        return [(0, len(text), "start")], None
    parts = merged(text, markers, limit, overlap)
    weakest = LEVELS[min(level for _, _, level in parts if level >= 0)]
    if len(parts) > 1 and parts[0][1] < overlap:
        parts = [(0, parts[1][1], -1), *parts[2:]]
    return [(max(0, start - overlap) if k else 0, end, LEVELS[level] if k else "start") for k, (start, end, level) in enumerate(parts)], weakest


def _sections(sections: DataFrame) -> DataFrame:
    return sections.select("section_id", "text", F.transform("segments", lambda s: s["start_pos"]).alias("markers"))


def split_sections(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(section_id, piece_no, start_pos, end_pos, boundary, text): the pieces of each section, each at most `limit` long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for k, (text, markers) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for n, (start, end, boundary) in enumerate(pieces(text, markers or [], limit, overlap)[0], 1):
                    place.append(k)
                    rows.append((n, start, end, boundary, text[start:end]))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = [batch.column(0).take(pa.array(place, pa.int32())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["section_id", "piece_no", "start_pos", "end_pos", "boundary", "text"])

    return _sections(sections).mapInArrow(cut, "section_id long, piece_no int, start_pos int, end_pos int, boundary string, text string")


def weakest_boundaries(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(section_id, boundary): the oversized sections with the weakest boundary at which merging leaves them cut."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weakest = pa.array([pieces(text, markers or [], limit, overlap)[1] for text, markers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), weakest], names=["section_id", "boundary"])

    return _sections(sections.filter(F.length("text") > limit)).mapInArrow(find, "section_id long, boundary string")
