"""Problem 8: passages of evaluation items inside documents.

Pigeonhole edit matching on words. Any WINDOW successive words of an item that a document holds
with at most BUDGET edited words contain, cut into BUDGET + 1 pieces, one piece unedited; as the
window may start at any word, the pieces looked up are all runs of WINDOW // (BUDGET + 1) item
words. Documents stream past a sorted table of the digests of these pieces: a batch of texts is
one array of folded code points, words and runs of words are hashed by differences of prefix sums,
and only runs that the table holds are looked at further. Hits are grouped by item and diagonal
(an alignment with at most BUDGET edits stays within BUDGET diagonals and keeps at least
WINDOW - piece + 1 - piece * BUDGET pieces); windows with enough hits are verified by Myers'
bit-parallel distance over words. An exact check of the alignment follows: the first and the last
word of a window must be unedited, so that the passage is eighteen words long in the item and a
shorter shared phrase isn't stretched, and a number put for another number weighs two edits, so a
statement on other figures isn't a copy.

Words are compared after folding case, accents, look-alike letters, full-width forms, invisible
characters, punctuation, words broken at line ends and page-number lines.

The items are the stated query set. Their words are counted first; sets over BLOCK words are dealt
into blocks of about that size, of which one at a time is read, shipped and searched, so what the
driver and the executors hold has a fixed bound whatever the number of items. Documents are never
joined with each other or shuffled.

Defined results: null and empty texts or items match nothing; items with fewer than WINDOW words
match nothing; equal documents each match; a pair is reported once; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.lookalike import CYRILLIC_TWINS, GREEK_TWINS
from lindero.llm.signs import Runs, code_points
from lindero.session import cut_lineage

WINDOW = 18
BUDGET = 2
BLOCK = 4_000_000
#: Characters that are looked at at once.
CHUNK = 1 << 20

_TWINS = {ord(k): v for k, v in (CYRILLIC_TWINS | GREEK_TWINS).items()}
_PAGE = re.compile(r"^[\W_]*(?:p[aá]gina|p[aà]gina|p[aà]g\.?|page)\W*\d+(?:\W+(?:de|of)?\W*\d+)?[\W_]*$", re.I | re.M)
_PAGED = re.compile(r"p[aáà]g|page", re.I)
_BROKEN = re.compile(r"(?<=\w)[-‐­]\s*\n\s*(?=\w)")


def _plain(point: int) -> str:
    parts = unicodedata.normalize("NFKD", chr(point))
    return "".join(_TWINS.get(ord(c), c) for c in parts if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()


class _Fold:
    """Folds arrays of code points by a table that is filled as characters are met."""

    UNKNOWN, GONE, MANY = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD

    def __init__(self) -> None:
        self.table = np.full(0x110000, self.UNKNOWN, np.uint32)
        self.kind = np.zeros(0x110000, np.uint8)  # 1 for letters, 2 for digits
        self.many: dict[int, str] = {}

    def _learn(self, point: int) -> None:
        plain = _plain(point)
        if not plain:
            self.table[point] = self.GONE
        elif not any(map(str.isalnum, plain)):
            self.table[point] = 0x20 if point else 0
        elif len(plain) == 1:
            self.table[point] = ord(plain)
            self.kind[ord(plain)] = 2 if plain.isdigit() else 1
        else:
            self.table[point] = self.MANY
            self.many[point] = plain

    def __call__(self, text: str) -> np.ndarray:
        codes = code_points(text)
        folded = self.table[codes]
        if (folded == self.UNKNOWN).any():
            for point in np.unique(codes[folded == self.UNKNOWN]):
                self._learn(int(point))
            folded = self.table[codes]
        if (folded == self.MANY).any():
            return self(text.translate(self.many))
        return folded[folded != self.GONE]


_FOLD = _Fold()


class Words:
    """The folded words of some texts: their hashes, whether they hold a digit, and the number of their text."""

    def __init__(self, texts: list[str]) -> None:
        whole = "\x00".join((_PAGE.sub(" ", t) if _PAGED.search(t) else t).replace("\x00", " ") for t in texts)
        codes = _FOLD(_BROKEN.sub("", whole))
        kind = _FOLD.kind[codes]
        word = kind > 0
        first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]]))
        self.hashes = Runs(codes).hashes(first, last) if codes.size else np.zeros(0, np.uint64)
        digits = np.concatenate([[0], np.cumsum(kind == 2)])
        self.figure = digits[last + 1] > digits[first]
        self.text = np.cumsum(codes == 0)[first] if codes.size else np.zeros(0, np.int64)
        self.start = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of `size` words of one text begin, and their hashes."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        at = at[self.text[at] == self.text[at + size - 1]]
        mixed = self.hashes ^ (self.hashes >> np.uint64(32))
        return at, Runs(mixed).hashes(at, at + size - 1)


def folded_words(text: str | None) -> list[int]:
    """The words of a text as the hashes by which they are compared."""
    return Words([text or ""]).hashes.tolist()


class Pieces:
    """The pieces of a block of items, and what is needed to verify their hits."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int) -> None:
        self.window, self.budget, self.size = window, budget, window // (budget + 1)
        self.least = max(1, window - self.size + 1 - self.size * budget)
        words = Words([text for _, text in items])
        self.items = [item for item, _ in items]
        self.start, self.words, self.figure = words.start, words.hashes, words.figure
        at, hashes = words.runs(self.size)
        long = np.diff(words.start)[words.text[at]] >= window
        order = np.argsort(hashes[long], kind="stable")
        self.keys, self.at = hashes[long][order], at[long][order]
        self.shift = np.uint64(64 - max(10, (16 * len(self.keys)).bit_length()))
        self.near = np.zeros(1 << (64 - int(self.shift)), bool)
        self.near[self.keys >> self.shift] = True

    def found(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the text, item) for each item of which a text holds a window."""
        words = Words(texts)
        at, hashes = words.runs(self.size)
        near = np.flatnonzero(self.near[hashes >> self.shift])
        at, hashes = at[near], hashes[near]
        low, high = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        many = high - low
        if not many.sum():
            return
        p = np.repeat(at, many)
        q = self.at[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        text, item = words.text[p], np.searchsorted(self.start, q, "right") - 1
        order = np.lexsort((q, p - q, item, text))
        text, item, p, q = text[order], item[order], p[order], q[order]
        edges = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]), [True]]))
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a >= self.least:
                t, i = int(text[a]), int(item[a])
                begin, first = words.start[t], self.start[i]
                on = list(zip((p[a:b] - begin - (q[a:b] - first)).tolist(), (q[a:b] - first).tolist(), strict=True))
                spelt = slice(begin, words.start[t + 1])
                if self._verified(words.hashes[spelt], words.figure[spelt], i, on):
                    yield t, self.items[i]

    def _verified(self, words: np.ndarray, figure: np.ndarray, item: int, on: list[tuple[int, int]]) -> bool:
        own = slice(self.start[item], self.start[item + 1])
        span, pattern, marks = self.window - self.size + 1, self.words[own], self.figure[own]
        todo: list[tuple[int, int, int]] = []
        first = 0
        for k, (low, _) in enumerate(on):
            if k and on[k - 1][0] == low:
                continue
            while on[first][0] < low:
                first += 1
            end = first
            while end < len(on) and on[end][0] <= low + self.budget:
                end += 1
            spots = sorted({q for _, q in on[first:end]})
            if len(spots) < self.least:
                continue
            for start in range(max(0, spots[0] - span + 1), min(spots[-1], len(pattern) - self.window) + 1):
                count = sum(start <= q < start + span for q in spots)
                if count >= self.least:
                    todo.append((-count, start, low))
        for _, start, low in sorted(todo):
            part = slice(max(0, start + low - self.budget), start + low + self.window + 2 * self.budget)
            one, two = pattern[start : start + self.window].tolist(), words[part].tolist()
            if myers(one, two) <= self.budget and anchored(one, two, self.budget, marks[start : start + self.window], figure[part]):
                return True
        return False


def myers(pattern: list[int], text: list[int]) -> int:
    """The least edit distance between the pattern and any part of the text, by bit vectors over words."""
    masks: dict[int, int] = {}
    for k, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << k
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    best = score
    for word in text:
        eq = masks.get(word, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | ~(zero | plus) & full, plus & zero
        best = min(best, score)
    return best


def anchored(pattern: list[int], text: list[int], budget: int, figure: np.ndarray, text_figure: np.ndarray) -> bool:
    """Whether an alignment within the budget keeps the first and the last word of the pattern; a number for another number weighs two."""
    inner = len(pattern)
    for start in (k for k, w in enumerate(text) if w == pattern[0]):
        row = list(range(inner))
        for at in range(start + 1, len(text)):
            word, before = text[at], row[0]
            row[0] += 1
            for k in range(1, inner):
                old = row[k]
                change = 0 if pattern[k] == word else 2 if figure[k] and text_figure[at] else 1
                row[k] = min(before + change, old + 1, row[k - 1] + 1)
                before = old
            if word == pattern[-1] and row[-1] <= budget:
                return True
    return False


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The places of the texts and the texts, in groups of about CHUNK characters."""
    places, held, size = [], [], 0
    for place, text in enumerate(texts):
        if text:
            places.append(place)
            held.append(text)
            size += len(text)
        if size > CHUNK:
            yield places, held
            places, held, size = [], [], 0
    if held:
        yield places, held


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): the documents that hold `window` successive words of an item with at most `budget` edited words.

    documents needs doc_id and text, items needs item_id and text.
    """
    spark = documents.sparkSession
    known = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    total = known.agg(F.sum(F.size(F.split("text", r"\s+")))).collect()[0][0] or 0
    blocks = -(-total // block)
    out = None
    for k in range(blocks):
        some = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        pieces = spark.sparkContext.broadcast(Pieces(sorted((r.item_id, r.text) for r in some.collect()), window, budget))

        def scan(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(places[t], item) for places, texts in _groups(batch.column(1).to_pylist()) for t, item in pieces.value.found(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([p for p, _ in pairs], pa.int32())), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        part = documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, item_id long")
        if blocks > 1:
            part = cut_lineage(part)
            pieces.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "doc_id long, item_id long") if out is None else out.distinct()
