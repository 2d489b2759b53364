"""Problem 1: texts that were cut off.

A backward character n-gram model: from a position it looks back over the last characters of the
line and tells how often the corpus stops there against how often it goes on. Two views are
modelled. The *outline* (capitalised words and codes folded to one sign, digit runs to 0) tells
ends of lines and texts from positions inside them, so that a name never seen before is judged by
what stands around it; ends of sentences inside a line count as neither. The *letters* (digits
folded to 0) tell ends of words and numbers from positions inside them. Lines are folded whole,
and a context is taken from the folded line, however many characters a sign stands for.

Only contexts in which some text ends are ever asked for. They are found in the scan, one narrow
row for each distinct text (digests, no text leaves the scan). A filter over their hashes goes to
the executors, SPARSE bits for each context and at most 2^MOST_BITS; more contexts than that are
counted in several passes, each with its share of the hashes, so the filter never fills up. numpy counts the contexts
that the filter holds over the whole of all documents, and the counts are added up by 64-bit
context. In a single pass a longer context is looked at only where the shorter one was asked for.

Equal texts count their end once, and a text's own end is taken out when it is scored, by
interpolation from short to long contexts. The lower log-odds of the two views is compared with a
threshold per language and column, put into the emptiest stretch between what an unknown context
tells and the bulk of the scores below that. An exact check follows: open brackets or quotes of a JSON text mean
cut, a balanced JSON text is whole, and a marker of cutting (an ellipsis, a replacement character,
a hyphen) at the end is cut.

Defined results: null, empty and blank texts are not cut; ties and repeated rows get equal
results; null lang is its own group; texts of any length are counted whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.llm.signs import Runs, code_points
from lindero.session import cut_lineage

#: Lengths of the contexts, by view.
ORDERS = {"outline": (2, 5, 9, 14, 20, 28), "letters": (2, 3, 4, 6, 8)}
SLOTS = [(view, order) for view, orders in ORDERS.items() for order in orders]
#: Weight of the shorter context when it is mixed with a longer one.
BACKING = 2.0
#: Chance of a stop before any context is known.
BASE = 0.05
#: Bits of the filter for each asked context, and the power of 2 of its bits in one pass (16 MB).
SPARSE, MOST_BITS = 16, 27
#: Characters that are counted at once.
CHUNK = 1 << 16
#: Log-odds of BASE, and the width of a step on the logarithmic scale of distances below it.
BASELINE = math.log(BASE / (1 - BASE))
STEP = 0.125

_BLANK = re.compile(r"[ \t\r]*\n\s*")
_MARKS = ("…", "...", "[…]", "[...]", "(…)", "(...)", "\ufffd")
_NAME = re.compile(r"\b[^\WA-ZÀ-ÖØ-Þ]*+[A-ZÀ-ÖØ-Þ]\w*+(?:['’·-]\w++)*+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"»”)\]]* +(?=[\"«“(¿¡]*[A-ZÀ-ÖØ-Þ])")
_SPOT = "\x01"


_SEE: dict[str, Callable[[str], str]] = {"outline": lambda text: _NAME.sub("X", text), "letters": str.lower}
#: Beyond the last block of letters codes are their own fold and no letters.
_LETTERS_END = 0x33480
_ALNUM = np.array([chr(c).isalnum() for c in range(_LETTERS_END)] + [False])
_FOLD = np.arange(_LETTERS_END + 1, dtype=np.uint32)
_FOLD[[c for c in range(_LETTERS_END) if chr(c).isdecimal()]] = ord("0")
_FOLD[[ord(c) for c in "\t \xa0"]] = ord(" ")


def _codes(text: str, view: str) -> np.ndarray:
    codes = _FOLD[np.minimum(code_points(text), _LETTERS_END)]
    if view == "outline":
        digit = codes == 48
        digit[1:] &= digit[:-1].copy()
        digit[:1] = False
        codes = codes[~digit]
    return codes


def _contexts(codes: np.ndarray, view: str, at: np.ndarray, asked: Callable[[np.ndarray], np.ndarray] | None = None, nested: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slot of the view (slot, positions, contexts that end there); none looks past the line end before it.

    With `asked`, positions whose context isn't asked for are left out; if `nested`, from the longer slots too.
    """
    runs, lines = Runs(codes), np.flatnonzero(codes == 10)
    begin = lines.take(np.searchsorted(lines, at, "right") - 1) if len(at) < len(codes) // 8 else np.repeat(lines, np.diff(np.append(lines, codes.size))).take(at)
    for order in ORDERS[view]:
        slot = SLOTS.index((view, order))
        context = runs.hashes(np.maximum(at - (order - 1), begin), at)
        context *= np.uint64(0xD6E8FEB86659FD93 + 2 * slot)
        if asked is None:
            yield slot, at, context.view(np.int64)
            continue
        held = np.flatnonzero(asked(context))
        yield slot, at.take(held), context.take(held).view(np.int64)
        if nested:
            at, begin = at.take(held), begin.take(held)


def trimmed(text: str) -> str:
    """The text without trailing blanks and markers of cutting at its end."""
    text = text.rstrip()
    while mark := next((m for m in _MARKS if text.endswith(m)), None):
        text = text[: -len(mark)].rstrip()
    return text


def _last_contexts(texts: list[str]) -> np.ndarray:
    """The last context of each text, by slot; the last line is folded whole."""
    out = np.zeros((len(texts), len(SLOTS)), np.int64)
    lines = [_SENTENCE.sub(" ", t[t.rfind("\n") + 1 :].lstrip()) for t in texts]
    for view in ORDERS:
        codes = _codes("".join("\n" + _SEE[view](line) for line in lines), view)
        ends = np.append(np.flatnonzero(codes == 10)[1:], codes.size) - 1
        for slot, _, context in _contexts(codes, view, ends) if len(texts) else ():
            out[:, slot] = context
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to (k1, k2, state, contexts): a context is null where its view has nothing to say."""
    view = np.array([v == "letters" for v, _ in SLOTS])
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        state = [end_state(t) for t in texts]
        ends = [trimmed(t) for t in texts]
        contexts = _last_contexts(ends)
        asked = np.array([s in ("plain", "marked") and bool(t) for s, t in zip(state, ends, strict=True)], bool)
        word = np.array([t[-1:].isalnum() for t in ends], bool)
        none = ~(asked[:, None] & (~view[None, :] | word[:, None]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1) * len(SLOTS), pa.int32()), pa.array(contexts.ravel(), mask=none.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state, pa.string()), lists], names=["k1", "k2", "state", "contexts"])


class _Tally:
    """Counts of contexts: a table with one place for each hash; contexts whose place is taken are counted apart."""

    PLACES, HELD = 1 << 18, 1 << 20

    def __init__(self) -> None:
        self.keys = np.zeros(self.PLACES, np.int64)
        self.counts = np.zeros(2 * self.PLACES, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, context: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((context, stop))
        self.size += context.size
        if self.size > self.HELD:
            yield from self._flush()

    def _flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        context, stop = (np.concatenate(part) for part in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        place = context >> np.int64(17)
        place &= np.int64(self.PLACES - 1)
        other = np.flatnonzero(self.keys.take(place) != context)
        free = other[self.keys[place[other]] == 0]
        self.keys[place[free]] = context[free]
        other = other[self.keys[place[other]] != context[other]]
        if other.size:
            found, number = np.unique(context[other], return_inverse=True)
            yield self._rows(found, np.bincount(2 * number + stop[other], minlength=2 * found.size))
            own = np.ones(context.size, bool)
            own[other] = False
            place, stop = place[own], stop[own]
        place *= 2
        place += stop
        self.counts += np.bincount(place, minlength=2 * self.PLACES)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush()
        held = np.flatnonzero(self.counts[::2] + self.counts[1::2])
        yield self._rows(self.keys[held], np.stack([self.counts[2 * held], self.counts[2 * held + 1]], 1).ravel())

    @staticmethod
    def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[::2]), pa.array(counts[1::2])], names=["context", "goes", "stops"])


def _counted(chunk: str, asked: Callable[[np.ndarray], np.ndarray], nested: bool, tally: _Tally) -> Iterator[pa.RecordBatch]:
    chunk = "\n" + _BLANK.sub("\n", _SENTENCE.sub(_SPOT, chunk))
    for view, see in _SEE.items():
        codes = _codes(see(chunk), view)
        after = np.append(codes[1:], 0)
        if view == "outline":
            stop, go = (after == 10) & (codes != 10), (after > 10) & (codes > 10)
        else:
            word = _ALNUM[codes]
            stop, go = word & ~_ALNUM[after] & (after != 0), word & _ALNUM[after]
        codes = np.where(codes == 1, 32, np.where(codes == 0, 10, codes))
        for _, at, context in _contexts(codes, view, np.flatnonzero(go | stop), asked, nested):
            yield from tally.add(context, stop.take(at))


def _chunks(texts: list[str | None]) -> Iterator[str]:
    """The texts, each ended by a NUL, in strings of about CHUNK characters; a longer text is parted at line ends, which no context crosses."""
    held, size = [], 0
    for text in texts:
        text = (text or "").rstrip()
        at = 0
        while len(text) - at > CHUNK and (cut := text.find("\n", at + CHUNK)) >= 0:
            yield text[at : cut + 1]
            at = cut + 1
        if at < len(text):
            held.append(text[at:] + "\x00")
            size += len(text) - at
        if size > CHUNK:
            yield "".join(held)
            held, size = [], 0
    if held:
        yield "".join(held)


def _counter(bits: np.ndarray, nested: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the contexts that the filter holds over whole texts: goes on, stops. Ends of texts are counted apart."""
    table = np.unpackbits(bits, bitorder="little").view(bool)
    shift = np.uint64(64 - int(table.size).bit_length() + 1)

    def asked(context: np.ndarray) -> np.ndarray:
        return table[context >> shift]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for chunk in _chunks(batch.column(0).to_pylist()):
                yield from _counted(chunk, asked, nested, tally)
        yield from tally.rest()

    return count


def end_state(text: str) -> str:
    """blank, json open, json whole, marked or plain."""
    end = text.rstrip()
    if not end:
        return "blank"
    if kind := json_state(text):
        return f"json {kind}"
    return "marked" if end.endswith((*_MARKS, "-")) else "plain"


_ESCAPED = re.compile(r'\\.|"(?:[^"\\]|\\.)*"', re.S)


def json_state(text: str) -> str:
    """'' if the text isn't JSON, else 'whole' or 'open'."""
    body = text.strip()
    fenced = body.startswith("```")
    if fenced:
        head, _, body = body.partition("\n")
        if not body.rstrip().endswith("```"):
            return "open" if body.lstrip()[:1] in ("{", "[") else ""
        body = body.rstrip()[:-3].rstrip()
    if not re.match(r'[\[{]\s*["{\[\]}]', body):
        return ""
    bare = _ESCAPED.sub("", body)
    if '"' in bare:
        return "open"
    depth = sum(bare.count(x) for x in "{[") - sum(bare.count(x) for x in "}]")
    return "open" if depth > 0 else "whole"


def _filter(contexts: DataFrame, power: int) -> np.ndarray:
    """The filter of the column `context`: 2^power bits as bytes, at most 2^power / 64 rows to the driver."""
    bit = F.shiftrightunsigned("context", 64 - power)
    words = contexts.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(context, {64 - power}) & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def context_counts(texts: DataFrame, asked: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(context, goes, stops) over the only column of `texts`, whole, for the contexts of `asked` (and a few others that the filter lets through)."""
    number = asked.count()
    passes = max(1, -(-number * SPARSE // (1 << most_bits)))
    power = min(most_bits, max(16, (-(-number // passes) * SPARSE).bit_length()))
    parts = []
    for k in range(passes):
        share = asked.filter(F.pmod(F.shiftright("context", 20), F.lit(passes)) == k) if passes > 1 else asked
        bits = texts.sparkSession.sparkContext.broadcast(_filter(share, power))

        def count(batches: Iterator[pa.RecordBatch], bits=bits) -> Iterator[pa.RecordBatch]:
            yield from _counter(bits.value, passes == 1)(batches)

        counted = texts.mapInArrow(count, "context long, goes long, stops long")
        # a context that another pass's filter lets through by chance is that pass's only
        parts.append(counted.filter(F.pmod(F.shiftright("context", 20), F.lit(passes)) == k) if passes > 1 else counted)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("context").agg(F.sum("goes").alias("goes"), F.sum("stops").alias("stops"))


def end_scores(documents: DataFrame, column: str = "text") -> DataFrame:
    """(k1, k2, state, outline, letters) for each distinct text: the state of its end and the log-odds of a stop after its last context."""
    keys = [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit("end"), F.col(column)).alias("k2")]
    scanned = documents.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("text")).mapInArrow(_ends, "k1 long, k2 long, state string, contexts array<long>")
    ends = cut_lineage(scanned.groupBy("k1", "k2").agg(F.first("state").alias("state"), F.first("contexts").alias("contexts")))
    asked = ends.select("k1", "k2", "state", F.posexplode("contexts").alias("slot", "context")).filter("context is not null")
    own = cut_lineage(asked.groupBy("context").agg(F.count(F.when(F.col("state") == "plain", 1)).alias("ends")))
    counts = context_counts(documents.select(column), own.select("context"))
    table = own.join(counts, "context", "left").select("context", F.coalesce("goes", F.lit(0)).alias("goes"), (F.coalesce("stops", F.lit(0)) + F.col("ends")).alias("stops"))
    met = asked.join(table, "context", "left").groupBy("k1", "k2")
    numbers = [F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}_{k}") for k in range(len(SLOTS)) for c in ("goes", "stops")]
    wide = ends.select("k1", "k2", "state").join(met.agg(*numbers), ["k1", "k2"], "left")
    mine = F.when(F.col("state") == "plain", 1).otherwise(0)
    for view in ORDERS:
        chance: Column = F.lit(BASE)
        for k in (k for k, (name, _) in enumerate(SLOTS) if name == view):
            stops = F.greatest(F.lit(0), F.col(f"stops_{k}") - mine)
            chance = (stops + BACKING * chance) / (stops + F.col(f"goes_{k}") + BACKING)
            wide = wide.withColumn("_chance", chance)
            chance = F.col("_chance")
        wide = wide.withColumn(view, F.log(F.col("_chance") / F.greatest(1 - F.col("_chance"), F.lit(1e-12)))).drop("_chance")
    return wide.select("k1", "k2", "state", *ORDERS)


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, threshold) for each language with scores below BASELINE.

    BASELINE is what a context tells that the corpus doesn't know. Distances below it are taken on a
    logarithmic scale; between BASELINE and the median of these distances the emptiest stretch of
    three steps parts texts that end from texts that are cut, the one nearest to BASELINE among equals.
    """
    below = scored.filter(F.col("odds") < BASELINE).select("lang", F.floor(F.log1p(BASELINE - F.col("odds")) / STEP).alias("bin"))
    bins = below.groupBy("lang", "bin").count()
    total = bins.groupBy(F.col("lang").alias("_lang")).agg(F.sum("count").alias("total"), F.max("bin").alias("last"))
    grid = total.select("_lang", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 1)).alias("_bin"))
    full = grid.join(bins, F.col("_lang").eqNullSafe(F.col("lang")) & (F.col("_bin") == F.col("bin")), "left").select("_lang", "total", "_bin", F.coalesce("count", F.lit(0)).alias("count"))
    order = Window.partitionBy("_lang").orderBy("_bin")
    full = full.withColumn("near", F.sum("count").over(order.rowsBetween(-1, 1))).withColumn("before", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    best = full.filter((F.col("_bin") > 0) & (F.coalesce("before", F.lit(0)) <= F.col("total") / 2)).groupBy("_lang").agg(F.min_by("_bin", F.struct("near", "count", "_bin")).alias("bin"))
    return best.select(F.col("_lang").alias("lang"), (BASELINE - F.expm1((F.col("bin") + 0.5) * STEP)).alias("threshold"))


def cut_texts(documents: DataFrame, column: str = "text", by: str = "lang") -> DataFrame:
    """`documents` with `is_cut` (never null), `end_state`, `end_odds` and `threshold`; columns of these names are replaced."""
    documents = documents.drop("is_cut", "end_state", "end_odds", "threshold", "_k1", "_k2", "_by")
    keyed = documents.select("*", F.xxhash64(column).alias("_k1"), F.xxhash64(F.lit("end"), F.col(column)).alias("_k2"))
    scores = cut_lineage(end_scores(documents, column))
    odds = F.least("outline", "letters")
    ends = scores.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("state").alias("end_state"), F.when(F.col("state") == "plain", odds).alias("end_odds"))
    joined = keyed.join(ends, ["_k1", "_k2"], "left")
    limits = thresholds(joined.select(F.col(by).alias("lang"), F.col("end_odds").alias("odds")).filter("odds is not null"))
    limits = limits.select(F.col("lang").alias("_by"), "threshold")
    out = joined.join(F.broadcast(limits), F.col(by).eqNullSafe(F.col("_by")), "left")
    is_cut = F.when(F.col("end_state").isin("marked", "json open"), True).when(F.col("end_odds") < F.col("threshold"), True).otherwise(False)
    return out.select(*(F.col(c) for c in documents.columns), is_cut.alias("is_cut"), "end_state", "end_odds", "threshold")


def cut_share(documents: DataFrame, source: str = "source") -> DataFrame:
    """(source, texts, cut, share, told): for each source its texts, the cut ones, their share, and how many of these finish_reason tells."""
    told = F.lower("finish_reason").isin("length", "max_tokens")
    found = cut_texts(documents)
    return found.groupBy(source).agg(
        F.count("*").alias("texts"),
        F.count(F.when(F.col("is_cut"), 1)).alias("cut"),
        F.round(F.count(F.when(F.col("is_cut"), 1)) / F.count("*"), 6).alias("share"),
        F.count(F.when(F.col("is_cut") & told, 1)).alias("told"),
    )
