"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: runs of letters and digits, A-Z folded, a
number with its inner points and commas being one token. In template form
numbers, names and units of measure are replaced by typed placeholders:

* number: a token that starts with a digit and has no letter, or a number word;
* unit: a known unit right after a number;
* name: a word of two letters or more of which only the first is a capital, of
  any script. At the start of a sentence it is read both ways, as a name and as
  written, in every combination a window allows.

Windows of ``WINDOW`` tokens of both forms (as written, and as template) are
joined by hash with those of the benchmark items. Joined windows on one
diagonal make runs. A run counts if its slots are consistent: whatever fills a
slot of the item is replaced by the same thing wherever the item repeats it.
Runs count together only if they are consistent with each other; of two that
are not, the shorter is dropped. A document leaks an item when a consistent run
reaches ``min(RUN, item)`` tokens, or its runs cover ``COVER`` of the item.

The benchmark's windows pass a sieve of fixed size to every task, so only
windows that can match leave the scan of the documents. The join itself is an
ordinary shuffled join: neither side has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sieve
from .runtime import lean, prepare
from .textarrays import FOLD, chunks, mix64, seeded, span_hashes, utf8

WINDOW, RUN, COVER = 8, 13, 0.6
#: Literals that a template window has at least, and one that is a whole short item.
LITERALS, SHORT_LITERALS = 1, 4
#: Shorter items match only documents that consist of them, as written.
LEAST_TEMPLATE = 5
NUMBER, UNIT, NAME = 1, 2, 3
#: Windows looked at together.
STEP = 1 << 16

#: English words for numbers and usual units of measure.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
         "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
         "gallon gallons s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years "
         "mph kmh percent dollar dollars cent cents euro euros degree degrees").split()

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_TOKEN = _DIGIT | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Capital letters by code point.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x20000)])
_INNER = (_BYTES == 44) | (_BYTES == 46)
_STOP = np.zeros(256, bool)
_STOP[[*b".!?:;\n|"]] = True


def _known(words: list[str]) -> np.ndarray:
    data, off = utf8(pa.array(words))
    return np.sort(span_hashes(data, off[:-1], off[1:]))


_NUMBER_WORDS, _UNITS = _known(NUMBER_WORDS), _known(UNITS)


def _capitals(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a capital letter."""
    out = _UPPER[data]
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at < len(data) - more]
        point = data[at].astype(np.int64) & mask
        for j in range(1, more + 1):
            point = point << 6 | (data[at + j] & 0x3F)
        out[at] = _CAPITAL[np.minimum(point, len(_CAPITAL) - 1)]
    return out


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, hash, slot type, either) of every token of a chunk; type 0
    is a literal. either: a literal that may also be a name."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool)
    inside = _TOKEN[data]
    digit = _DIGIT[data]
    bridge = np.zeros(n, bool)
    bridge[1:-1] = _INNER[data[1:-1]] & digit[:-2] & digit[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    inside |= bridge
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[:n] = inside
    first[1:n] &= ~inside[:-1]
    first[edges] |= inside[edges]
    last[1:] = inside
    last[1:n] &= ~inside[1:]
    last[edges] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(offsets, start, "right") - 1
    h = span_hashes(data, start, end)
    letters = np.concatenate([[0], np.cumsum(inside & ~digit & ~bridge)])
    capital = _capitals(data)
    uppers = np.concatenate([[0], np.cumsum(capital)])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    number = (digit[start] & (letters[end] == letters[start])) | _isin(h, _NUMBER_WORDS)
    # A sentence starts at the text's start or when a stop stands between a token and the one before.
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~bridge)])
    opens = np.ones(len(start), bool)
    same = row[1:] == row[:-1]
    opens[1:] = ~same | (stops[start[1:]] > stops[end[:-1]])
    named = capital[start] & (uppers[end] - uppers[start] == 1) & (points[end] - points[start] > 1) & ~number
    unit = np.zeros(len(start), bool)
    unit[1:] = same & number[:-1] & _isin(h[1:], _UNITS) & ~number[1:]
    slot = np.where(number, NUMBER, np.where(unit, UNIT, np.where(named & ~opens, NAME, 0))).astype(np.uint8)
    return row, start, end, h, slot, named & opens & ~unit


def _hashes(values: np.ndarray) -> np.ndarray:
    """Of each row of k values: its hash."""
    acc = np.full(len(values), values.shape[1], np.uint64)
    for v in values.T:
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + v)
    return acc


def _rolling(values: np.ndarray, k: int) -> np.ndarray:
    """``_hashes`` of all windows of k neighbours, without copying the windows."""
    n = len(values) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + values[j:n + j])
    return acc


def _in_windows(flags: np.ndarray, k: int) -> np.ndarray:
    """How many flags each window of k neighbours has."""
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[k:] - run[:-k]


def _typed(h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.where(slot > 0, seeded(slot.astype(np.uint64), 3), h)


def _readings(h: np.ndarray, slot: np.ndarray, either: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes, slots) of the template windows of k tokens from the places
    ``at`` that read some of the words that may be names as names, one reading after
    the other."""
    span = at[:, None] + np.arange(k)
    maybe = either[span]
    rank = np.cumsum(maybe, axis=1) - 1
    choices = maybe.sum(axis=1)
    for n in range(1, 1 << int(choices.max(initial=0))):
        use = np.flatnonzero((1 << choices) > n)
        s = np.where(maybe[use] & (n >> np.maximum(rank[use], 0) & 1 == 1), np.uint8(NAME), slot[span[use]])
        ok = _enough((s == 0).sum(axis=1), k)
        use, s = use[ok], s[ok]
        if len(use):
            yield at[use], seeded(_hashes(_typed(h[span[use]].reshape(-1), s.reshape(-1)).reshape(s.shape)), 12), s


def _enough(literals: np.ndarray, k: int) -> np.ndarray:
    """Whether a template window has a slot and enough literals: one among
    ``WINDOW`` tokens, for the rest of an item must match too; ``SHORT_LITERALS``
    in an item that is shorter than a window."""
    return (literals >= (LITERALS if k == WINDOW else min(SHORT_LITERALS, k - 1))) & (literals < k)


def _forms(h: np.ndarray, slot: np.ndarray, either: np.ndarray, ok: np.ndarray, k: int) -> Iterator[tuple]:
    """(form, places, hashes, slots or None) of all windows of k tokens at ``ok``."""
    yield "verbatim", np.flatnonzero(ok), _rolling(h, k)[ok], None
    if k < LEAST_TEMPLATE:
        return
    typed = ok & _enough(_in_windows(slot == 0, k), k)
    yield "template", np.flatnonzero(typed), seeded(_rolling(_typed(h, slot), k)[typed], 12), None
    several = np.flatnonzero(ok & (_in_windows(either, k) > 0))
    for begin in range(0, len(several), STEP):
        for at, v, s in _readings(h, slot, either, several[begin:begin + STEP], k):
            yield "template", at, v, s


_SCHEMA = "id long, n int, key long, form string, pos int, tokens array<string>, slots array<tinyint>"


def _window_rows(batches: Iterator[pa.RecordBatch], lengths: list[int], known=None, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Windows of texts (id, text) as rows; with a sieve, those it lets through.
    whole: a text shorter than the window is one window of its own length, as any
    text shorter than ``LEAST_TEMPLATE`` tokens is."""
    for batch in lean(batches):
        data, off = utf8(batch.column(1))
        ids = batch.column(0)
        for a, b in chunks(off):
            part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            row, start, end, h, slot, either = canonical(part, o)
            count = np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64)
            first = np.concatenate([[0], np.cumsum(count)])
            for k in lengths:
                if len(h) < k:
                    continue
                ok = row[:len(h) - k + 1] == row[k - 1:]
                if k < LEAST_TEMPLATE or whole and k != WINDOW:
                    ok &= count[row[:len(ok)]] == k
                for form, at, v, s in _forms(h, slot, either, ok, k):
                    if known is not None and len(at):
                        use = sieve.passes(known, v.view(np.int64))
                        at, v, s = at[use], v[use], None if s is None else s[use]
                    if len(at):
                        s = slot[at[:, None] + np.arange(k)] if s is None else s
                        tokens = [[FOLD[part[start[i + j]:end[i + j]]].tobytes().decode("utf-8", "replace") for j in range(k)] for i in at]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(a + row[at])).cast(pa.int64()), pa.array(count[row[at]], pa.int32()), pa.array(v.view(np.int64)),
                             pa.array([form] * len(at)), pa.array((at - first[row[at]]).astype(np.int32)), pa.array(tokens, pa.list_(pa.string())),
                             pa.array(s.tolist(), pa.list_(pa.int8()))],
                            ["id", "n", "key", "form", "pos", "tokens", "slots"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_id, form, covered, item_tokens, longest_run, slots), one
    row per document, leaked item and form.

    form is ``verbatim`` or ``template``; covered counts the item's tokens in
    consistent runs, longest_run the longest of them; slots lists
    ``item value -> document value`` of the slots, sorted.

    Null texts count as empty; items without tokens match nothing. Items of fewer
    than 5 tokens match documents that consist of them, as written; items of 5 to 7
    tokens match as a whole, anywhere. Rows that
    repeat an id add up to one document or item; rows with a null id are a
    document (or item) with id null. Other columns are ignored. An empty table
    gives an empty result. Windows of very long texts are all looked at.
    """
    prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lengths = list(range(1, WINDOW + 1))

    def item_windows(batches):
        yield from _window_rows(batches, lengths, whole=True)

    wanted = items.mapInArrow(item_windows, _SCHEMA)
    used = sorted(r.k for r in wanted.select(F.size("tokens").alias("k")).distinct().collect())  # at most WINDOW lengths
    known = sieve.build(wanted.select("key").distinct(), "key")

    def document_windows(batches):
        yield from _window_rows(batches, used, known)

    found = d.mapInArrow(document_windows, _SCHEMA)
    right = wanted.select(F.col("id").alias("item"), F.col("n").alias("item_tokens"), "key", "form", F.col("pos").alias("item_pos"),
                          F.col("tokens").alias("item_values"), F.col("slots").alias("item_slots"))
    same_shape = F.when(F.col("form") == "template", F.col("slots") == F.col("item_slots")).otherwise(F.col("tokens") == F.col("item_values"))
    joined = found.drop("n").join(right, ["key", "form"]).where(same_shape)
    fills = F.filter(F.arrays_zip("item_slots", "item_values", "tokens"), lambda x: x["item_slots"] > 0)
    steps = (joined.select("id", "item", "item_tokens", "form", "item_pos", "pos", F.size("tokens").alias("k"), (F.col("pos") - F.col("item_pos")).alias("diagonal"),
                           F.transform(fills, lambda x: F.struct(x["item_values"].alias("was"), x["tokens"].alias("now"))).alias("fills"))
             # Of the readings that match, the one that takes fewest words for names.
             .groupBy("id", "item", "item_tokens", "form", "item_pos", "pos", "k", "diagonal")
             .agg(F.min(F.struct(F.size("fills").alias("n"), "fills"))["fills"].alias("fills")))
    line = W.partitionBy("id", "item", "item_tokens", "form", "diagonal").orderBy("pos")
    steps = steps.withColumn("run", F.col("pos") - F.row_number().over(line))
    runs = (steps.groupBy("id", "item", "item_tokens", "form", "diagonal", "run")
            .agg((F.count("*") - 1 + F.max("k")).alias("length"), F.min("item_pos").alias("from"),
                 F.array_distinct(F.flatten(F.collect_list("fills"))).alias("fills")))
    steady = runs.where(F.size("fills") == F.size(F.array_distinct(F.transform("fills", lambda x: x["was"]))))

    def added(kept, run):
        """``kept`` with a run whose slots agree with all before, else ``kept`` alone."""
        fills = F.array_distinct(F.concat(kept["fills"], run["fills"]))
        agrees = F.size(fills) == F.size(F.array_distinct(F.transform(fills, lambda x: x["was"])))
        places = F.array_union(kept["places"], F.sequence(run["from"], (run["from"] + run["length"] - 1).cast("int")))
        return F.when(agrees, F.struct(fills.alias("fills"), places.alias("places"))).otherwise(kept)

    # The longest run stands; of the others, longer ones first, those that fill the
    # item's slots alike. Runs of equal length go by their place in the item.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("rank"), "from", "diagonal", "run", "length", "fills")))
    none = F.struct(F.array().cast("array<struct<was:string,now:string>>").alias("fills"), F.array().cast("array<int>").alias("places"))
    whole = (steady.groupBy("id", "item", "item_tokens", "form").agg(F.max("length").alias("longest_run"), ranked.alias("runs"))
             .withColumn("kept", F.aggregate("runs", none, added))
             .select("id", "item", "item_tokens", "form", "longest_run", F.size("kept.places").alias("covered"),
                     F.array_sort(F.transform("kept.fills", lambda x: F.concat(x["was"], F.lit(" -> "), x["now"]))).alias("slots")))
    return (whole.where((F.col("longest_run") >= F.least(F.lit(RUN), "item_tokens"))
                        | (F.col("covered") >= F.greatest(F.lit(WINDOW), F.lit(COVER) * F.col("item_tokens"))))
            .select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "form", F.col("covered").cast("long"),
                    F.col("item_tokens").cast("long"), F.col("longest_run").cast("long"), F.concat_ws("; ", "slots").alias("slots")))


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that leak an item; all columns stay."""
    ids = found.select(F.col(id_col).alias("_leak_id")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_leak_id")), "left_anti")
