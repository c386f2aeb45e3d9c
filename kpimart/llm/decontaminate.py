"""Benchmark decontamination by an FM-index per training shard.

A training shard is a run of documents that one task holds at a time. Its
words become symbols (the benchmark's vocabulary; no phrase can hold another
word), its suffixes are sorted by prefix doubling, and the index keeps the
Burrows-Wheeler transform as a wavelet matrix plus every 16th suffix position.
All benchmark phrases are searched backwards at once through wavelet ranks;
the rows that remain are walked to the next sampled position, which gives the
places of the occurrences. Overlapping occurrences merge into removal spans.

A phrase is ``window`` consecutive words of a benchmark item, or the whole
item if it has fewer. The benchmark is a query set: it is broadcast in blocks
of a fixed size, and the spans of the blocks are merged.

Edge cases: null texts have no words; items without words or of a null id
name no item (words of the latter still count as hit); copies of an item are
both listed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.llm import textvec
from kpimart.llm.tasks import share

WINDOW = 10
SAMPLE = 16
#: Symbols of a shard, bytes of benchmark text in one broadcast block, and
#: bytes of document text that a task works on at a time (or one longer text).
SHARD_SYMBOLS = 1 << 21
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 4 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


class Phrases:
    """Distinct phrases of a block of benchmark items, as rows of symbols."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        names = sorted({i for i, _ in items if i is not None})
        number = {name: n for n, name in enumerate(names)}
        data, offsets, _ = textvec.utf8(pa.array([t for _, t in items], pa.large_string()))
        keep, values = textvec.word_bytes(textvec.NOT_ALNUM), textvec.byte_values()
        hashes, counts = textvec.words(data, offsets, keep, values)
        self.names = names
        self.vocabulary = np.unique(hashes)
        symbols = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        rows: dict[bytes, int] = {}
        owners: list[set[int]] = []
        ends = np.cumsum(counts)
        for (name, _), count, end in zip(items, counts, ends, strict=True):
            text = symbols[end - count : end]
            for at in range(max(1, count - window + 1) if count else 0):
                n = rows.setdefault(text[at : at + window].tobytes(), len(rows))
                if n == len(owners):
                    owners.append(set())
                if name is not None:
                    owners[n].add(number[name])
        self.lengths = np.array([len(r) // 4 for r in rows], dtype=np.int64)
        self.symbols = np.zeros((len(rows), window), dtype=np.int32)
        for n, r in enumerate(rows):
            self.symbols[n, : len(r) // 4] = np.frombuffer(r, dtype=np.int32)
        self.owner_counts = np.array([len(o) for o in owners], dtype=np.int64)
        self.owners = np.array([i for o in owners for i in sorted(o)], dtype=np.int64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words of no phrase."""
        out = np.zeros(len(hashes), dtype=np.int32)
        if not len(self.vocabulary):
            return out
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[some]
        out[some[same]] = at[same] + 1
        return out


class FMIndex:
    """Index of a text of symbols > 0 in which every 0 ends a run."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        order = self._suffixes(text)
        last = text[order - 1]
        top = int(text.max(initial=0))
        counts = np.bincount(text, minlength=top + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        self.last = last
        self.levels: list[tuple[int, np.ndarray, int]] = []
        current = last
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            upto = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(ones, out=upto[1:])
            self.levels.append((bit, upto, n - int(upto[-1])))
            current = np.concatenate((current[ones == 0], current[ones == 1]))
        # a walk back ends at a sampled place, or at the start of a run
        marked = (order % sample == 0) | (last == 0)
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.places = order[marked]
        self.top = top

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; each 0 is a smaller symbol than
        the next 0 and than all others, so that no two suffixes are equal."""
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
        step = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).cumsum()))
            if fresh[-1] == n - 1:
                return order
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            step *= 2
            if step >= n:
                return order

    def rank(self, symbol: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
        """How many of the first ``rows`` entries of the transform equal ``symbol``."""
        at = [np.zeros(len(symbol), dtype=np.int64), *rows]
        for bit, upto, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            at = [np.where(one, zeros + upto[a], a - upto[a]) for a in at]
        return [a - at[0] for a in at[1:]]

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, low, high)`` of the phrases that occur."""
        who = np.flatnonzero(lengths > 0)
        low = np.zeros(len(who), dtype=np.int64)
        high = np.full(len(who), len(self.last), dtype=np.int64)
        for step in range(int(lengths.max(initial=0))):
            going = lengths[who] > step
            symbol = symbols[who, np.where(going, lengths[who] - 1 - step, 0)].astype(np.int64)
            known = ~going | (symbol <= self.top)
            who, low, high, going, symbol = (x[known] for x in (who, low, high, going, symbol))
            lo, hi = self.rank(symbol, low, high)
            start = self.before[np.minimum(symbol, self.top)]
            low, high = np.where(going, start + lo, low), np.where(going, start + hi, high)
            some = low < high
            who, low, high = who[some], low[some], high[some]
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes."""
        place = np.full(len(rows), -1, dtype=np.int64)
        steps, going = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(going):
            here = self.marked[rows]
            place[going[here]] = self.places[self.mark_rank[rows[here]]] + steps[going[here]]
            going, rows = going[~here], rows[~here]
            symbol = self.last[rows].astype(np.int64)
            rows = self.before[symbol] + self.rank(symbol, rows)[0]
            steps[going] += 1
        return place


def occurrences(symbols: np.ndarray, counts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, word)`` of all occurrences in the texts of one shard; words
    are numbered through. Only runs of phrase words at least as long as the
    shortest phrase are indexed: no occurrence lies elsewhere."""
    none = np.zeros(0, dtype=np.int64)
    if not len(phrases.lengths) or not len(symbols):
        return none, none
    known = symbols > 0
    edge = np.zeros(len(symbols) + 1, dtype=bool)
    edge[np.concatenate(([0], np.cumsum(counts)))] = True
    starts = known.copy()
    starts[1:] &= ~known[:-1] | edge[1:-1]
    stops = known.copy()
    stops[:-1] &= ~known[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    fits = last - first + 1 >= phrases.lengths.min()
    first, size = first[fits], (last - first + 1)[fits]
    if not len(first):
        return none, none
    at = np.cumsum(size + 1) - (size + 1)  # a 0 follows each run
    text = np.zeros(int((size + 1).sum()), dtype=np.int32)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at, size) + inner] = symbols[np.repeat(first, size) + inner]
    index = FMIndex(text)
    who, low, high = index.search(phrases.symbols, phrases.lengths)
    each = high - low
    rows = np.repeat(low, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    place = index.locate(rows)
    run = np.searchsorted(at, place, side="right") - 1
    return np.repeat(who, each), first[run] + place - at[run]


def _shards(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` words (one longer document alone)."""
    at, total = 0, 0
    for i, c in enumerate(counts):
        if total and total + c > most:
            yield at, i
            at, total = i, 0
        total += int(c)
    if len(counts):
        yield at, len(counts)


def scan_batch(texts: pa.Array, phrases: Phrases, shard_symbols: int = SHARD_SYMBOLS, slice_bytes: int = SLICE_BYTES):
    """``(n_words, spans, items)`` Arrow columns of a column of texts, found
    slice by slice of the column."""
    data, offsets, _ = textvec.utf8(texts)
    found, at = [], 0
    while at < len(texts) or not found:
        end = int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="right")) - 1
        end = max(min(at + 1, len(texts)), end)
        found.append(_scan_slice(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], phrases, shard_symbols))
        at = end
    return tuple(pa.concat_arrays(columns) for columns in zip(*found, strict=True))


def _scan_slice(data: np.ndarray, offsets: np.ndarray, phrases: Phrases, shard_symbols: int):
    """``scan_batch`` of a few texts."""
    keep, values = textvec.word_bytes(textvec.NOT_ALNUM), textvec.byte_values()
    hashes, counts = textvec.words(data, offsets, keep, values)
    symbols = phrases.encode(hashes)
    upto = np.concatenate(([0], np.cumsum(counts)))
    change = np.zeros(len(symbols) + 1, dtype=np.int32)
    doc_items: list[np.ndarray] = []
    owners_at = np.cumsum(phrases.owner_counts) - phrases.owner_counts
    for lo, hi in _shards(counts, shard_symbols):
        who, word = occurrences(symbols[upto[lo] : upto[hi]], counts[lo:hi], phrases)
        word = word + upto[lo]
        np.add.at(change, word, 1)
        np.add.at(change, word + phrases.lengths[who], -1)
        doc = np.searchsorted(upto, word, side="right") - 1
        pair = np.unique(doc * max(1, len(phrases.lengths)) + who)
        doc, who = pair // max(1, len(phrases.lengths)), pair % max(1, len(phrases.lengths))
        each = phrases.owner_counts[who]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        item = phrases.owners[np.repeat(owners_at[who], each) + inner]
        doc_items.append(np.unique(np.repeat(doc, each) * max(1, len(phrases.names)) + item))
    hit = np.cumsum(change)[:-1] > 0
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[upto] = True
    starts, stops = hit.copy(), hit.copy()
    starts[1:] &= ~hit[:-1] | edge[1:-1]
    stops[:-1] &= ~hit[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    owner = np.searchsorted(upto, first, side="right") - 1
    span_at = np.searchsorted(first, upto)
    spans = pa.ListArray.from_arrays(
        pa.array(span_at, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(first - upto[owner], pa.int64()), pa.array(last - upto[owner], pa.int64())], ["first", "last"]
        ),
    )
    code = np.concatenate(doc_items) if doc_items else np.zeros(0, dtype=np.int64)
    n_names = max(1, len(phrases.names))
    item_at = np.searchsorted(code, np.arange(len(counts) + 1) * n_names)
    names = pa.array(phrases.names, pa.string())
    items = pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), names.take(pa.array(code % n_names)))
    return pa.array(counts, pa.int64()), spans, items


def _blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The benchmark's (item_id as text, text) rows in blocks of bounded bytes."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text")
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(text or "")
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def _merge_spans(spans: Column) -> Column:
    """Union of sorted spans (a fold over one document's spans)."""

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (s["first"] <= last["last"] + 1)
        grown = F.named_struct(F.lit("first"), last["first"], F.lit("last"), F.greatest(last["last"], s["last"]))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(acc, F.array(s))
        )

    return F.aggregate(F.sort_array(spans), F.array().cast(SPANS), add)


def find_benchmark_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_symbols: int = SHARD_SYMBOLS,
    prefix: str = "",
) -> DataFrame:
    """The ``keep`` columns of every document (default: ``doc_id``) with
    ``n_words``, ``spans`` (merged removal spans: first and last word, from 0)
    and ``items`` (ids of the items with an occurring phrase, as sorted text);
    ``prefix`` sets the names of these apart from columns of ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    n_words, spans, items = (prefix + c for c in ("n_words", "spans", "items"))
    kind = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def scan(block: list) -> DataFrame:
        shared = share(spark, Phrases(block, window))

        @F.arrow_udf(kind)
        def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            phrases = shared()
            for texts in batches:
                columns = scan_batch(texts, phrases, shard_symbols)
                yield pa.StructArray.from_arrays(columns, ["n_words", "spans", "items"])

        # a null text and an empty one are alike: no words. Only the text goes
        # to the task's Python worker; other columns stay behind
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        found = docs.select(*keep, key.alias("__key"), told("text").alias("__told"))
        names = zip(("n_words", "spans", "items"), (n_words, spans, items), strict=True)
        return found.select(*keep, "__key", *(F.col("__told")[a].alias(b) for a, b in names))

    parts = [scan(block) for block in _blocks_of(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop("__key")
    # rows that agree in what is kept and in their text (by its hash) agree in their spans
    blocks = [
        p.select(*keep, "__key", n_words, F.lit(i).alias("__block"), spans, items) for i, p in enumerate(parts)
    ]
    merged = (
        reduce(DataFrame.unionByName, blocks)
        .groupBy(*keep, "__key", n_words)
        .agg(
            F.count(F.when(F.col("__block") == 0, 1)).alias("__copies"),
            F.flatten(F.collect_set(spans)).alias(spans),
            F.flatten(F.collect_set(items)).alias(items),
        )
    )
    return merged.select(
        *keep,
        n_words,
        _merge_spans(F.col(spans)).alias(spans),
        F.array_sort(F.array_distinct(items)).alias(items),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy"),
    ).drop("__copy")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of what was found, one row per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
