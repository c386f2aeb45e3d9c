"""Ranked lexical search by an Aho-Corasick scan of the documents.

The documents have no index. The distinct terms of the items (the query set)
make an automaton that is broadcast and run over every text: a first scan
counts the documents, their terms and each term's documents, a second one
scores. A term stands in the automaton between two blanks, and in a text every
byte that is in no term counts as a blank, so that the automaton matches whole
terms only ("boundary-guarded"). Its outputs are term numbers; a list of items
for each turns them into the items' scores. A task keeps its best documents of
every item, and Spark ranks these.

Items are dealt into blocks of at most ``block_bytes`` of terms (plus one
term), a scan each: the automaton's size follows the bound, not the query set.
An item too large for that has its terms spread over the blocks; its partial
scores of a document are summed by Spark before the ranking. Texts are worked
through in pieces cut between two terms.

Edge cases: null and empty texts have no terms and are never found; items
without terms find nothing; rows of one item id (null is an id) are one item
with the terms of all; repeated documents are found once each; among equal
scores a null doc_id comes last; an empty table gives an empty result; columns
that the operator does not name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpimart.llm import textvec
from kpimart.llm.tasks import share, written

TOP = 10
#: A term is a maximal match of this pattern, A-Z in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms in one automaton; each costs ``PAIR_BYTES`` more.
BLOCK_BYTES = 2 << 20
PAIR_BYTES = 64
#: Bytes of text scored at a time, and cells of (document, item) scores.
GROUP_BYTES = 4 << 20
CELLS = 1 << 21

COUNTED = "term int, n long"
SCORED = "item string, doc_id long, text_key long, score long"
DOCUMENTS, WORDS = -1, -2


def item_terms(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item`` (its id as text), ``term``, ``whole`` (all terms of the item
    are in one block) and ``block``, a row for each distinct term of an item."""
    lower = F.translate(F.col("text"), UPPER, LOWER)
    pairs = items.select(
        F.col("item_id").cast("string").alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")
    ).distinct()
    weight = (F.octet_length("term") + PAIR_BYTES).cast("long")
    sizes = pairs.groupBy("item").agg((F.sum(weight) <= block_bytes // 4).alias("whole"))
    sized = pairs.withColumn("weight", weight).join(sizes, pairs["item"].eqNullSafe(sizes["item"])).drop(sizes["item"])
    sized = written(sized, "item-terms")
    total, largest = sized.agg(F.sum("weight"), F.max("weight")).first()
    blocks = 1 if not total or total <= block_bytes else 2 * math.ceil(total / block_bytes)
    while True:
        spread = F.when(F.col("whole"), F.xxhash64("item")).otherwise(F.xxhash64("item", "term"))
        dealt = sized.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
        if blocks == 1:
            return dealt.drop("weight")
        load = dealt.groupBy("block").agg(F.sum("weight").alias("load")).agg(F.max("load")).first()[0]
        if load <= block_bytes + largest:
            return written(dealt.drop("weight"), "item-blocks")
        blocks *= 2


class Matcher:
    """The automaton of one block of item terms."""

    def __init__(self, rows: list[tuple[str | None, str, bool]]):
        self.terms = sorted({t for _, t, _ in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = sorted({i for i, _, _ in rows}, key=lambda i: (i is None, i))
        item = {name: i for i, name in enumerate(self.items)}
        self.whole = np.zeros(len(self.items), dtype=bool)
        owners: list[list[int]] = [[] for _ in self.terms]
        for name, term, whole in rows:
            owners[number[term]].append(item[name])
            self.whole[item[name]] = whole
        self.owner_counts = np.array([len(o) for o in owners], dtype=np.int64)
        self.owners = np.array([i for o in owners for i in sorted(o)], dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(self.terms):
            self.automaton.add_word((b" " + term.encode() + b" ").decode("latin-1"), i)
        self.automaton.make_automaton()

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(codes, tf, n)`` of texts: a code is text * terms + term; n counts
        all terms of a text."""
        n_docs = len(offsets) - 1
        table = np.where(textvec.word_bytes(textvec.NOT_ALNUM), np.arange(256), 32).astype(np.uint8)
        table[65:91] = np.arange(97, 123)
        plain = table[data].tobytes()
        # a blank before and after every text
        text = b" " + b"".join(plain[a:b] + b" " for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        starts = offsets[:-1] + np.arange(n_docs)  # of each text's leading blank
        n = np.zeros(n_docs, dtype=np.int64)
        codes, counts = [], []
        at = 0
        while at < len(text) - 1:
            end = min(len(text), at + textvec.BLOCK)
            if end < len(text):
                cut = text.rfind(b" ", at + 1, end)
                end = (cut if cut > at else text.find(b" ", end)) + 1
            piece = text[at:end]  # from a blank to a blank, both included
            inside = np.frombuffer(piece, dtype=np.uint8) != 32
            first = np.flatnonzero(inside[1:] & ~inside[:-1]) + at
            n += np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=n_docs)
            if self.terms:
                found = np.fromiter(chain.from_iterable(self.automaton.iter(piece.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
                # the last byte of a match is the blank after it
                doc = np.searchsorted(starts, found[:, 0] + at - 1, side="right") - 1
                code, tf = np.unique(doc * len(self.terms) + found[:, 1], return_counts=True)
                codes.append(code)
                counts.append(tf)
            at = end - 1
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n
        code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64), n


def _groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, bytes, offsets)`` of runs of texts of bounded bytes."""
    data, offsets, _ = textvec.utf8(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _counting(shared):
    """A task's documents, terms and documents of each query term."""

    def run(batches):
        matcher = shared()
        df = np.zeros(len(matcher.terms), dtype=np.int64)
        documents = words = 0
        for batch in batches:
            for _, _, data, offsets in _groups(batch.column(0)):
                code, _, n = matcher.count(data, offsets)
                df += np.bincount(code % max(1, len(df)), minlength=len(df))[: len(df)]
                documents += int((n > 0).sum())
                words += int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((some, [DOCUMENTS, WORDS])).astype(np.int32)),
                pa.array(np.concatenate((df[some], [documents, words])).astype(np.int64)),
            ],
            ["term", "n"],
        )

    return run


class Best:
    """The best documents of every item that one task has seen."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, dtype=np.int64)  # the least score of use
        none = np.zeros(0, dtype=np.int64)
        self.item, self.score, self.doc, self.null = none, none, none, np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """``scores`` is (documents, items)."""
        if len(scores) > self.top:
            last = np.partition(scores, len(scores) - self.top, axis=0)[-self.top]
            self.floor = np.maximum(self.floor, last)
        row, item = np.nonzero(scores >= self.floor)
        self.item = np.concatenate((self.item, item))
        self.score = np.concatenate((self.score, scores[row, item]))
        self.doc = np.concatenate((self.doc, docs[row]))
        self.null = np.concatenate((self.null, null[row]))
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        sorted_items = self.item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        order = order[place < self.top]
        self.item, self.score, self.doc, self.null = (x[order] for x in (self.item, self.score, self.doc, self.null))
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.floor)) == self.top)
        last = self.score[np.searchsorted(self.item, full, side="right") - 1]
        self.floor[full] = np.maximum(self.floor[full], last)


def _scoring(shared, weights: np.ndarray, documents: int, words: int, top: int):
    """The task's best documents of the whole items of a block, and all partial
    scores of the others."""

    def batch_of(matcher, item, doc, null, key, score):
        names = pa.array(matcher.items, pa.string())
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(item)), pa.array(doc, pa.int64(), mask=null), key, pa.array(score, pa.int64())],
            ["item", "doc_id", "text_key", "score"],
        )

    def run(batches):
        matcher = shared()
        n_items, n_terms = len(matcher.items), len(matcher.terms)
        at = np.cumsum(matcher.owner_counts) - matcher.owner_counts
        best = Best(n_items, top)
        parts = np.flatnonzero(~matcher.whole)
        step = max(1, CELLS // max(1, n_items))
        for batch in batches:
            null = np.asarray(batch.column(1).is_null())
            ids = batch.column(1).fill_null(0).to_numpy()
            keys = batch.column(2).to_numpy()
            for first, _, data, offsets in _groups(batch.column(0)):
                code, tf, n = matcher.count(data, offsets)
                if not len(code):
                    continue
                doc, term = code // n_terms, code % n_terms
                # Python integers: the product may pass 64 bits
                m = np.array([100 - 90 + 90 * int(x) * documents // words for x in n], dtype=np.int64)
                gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                for lo in range(0, len(n), step):
                    size = min(step, len(n) - lo)
                    a, b = np.searchsorted(doc, (lo, lo + size))
                    each = matcher.owner_counts[term[a:b]]
                    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                    item = matcher.owners[np.repeat(at[term[a:b]], each) + inner]
                    cells = np.zeros(size * n_items, dtype=np.int64)
                    np.add.at(cells, np.repeat(doc[a:b] - lo, each) * n_items + item, np.repeat(gain[a:b], each))
                    scores = cells.reshape(size, n_items)
                    rows = slice(first + lo, first + lo + size)
                    if len(parts):
                        row, part = np.nonzero(scores[:, parts] > 0)
                        where = first + lo + row
                        yield batch_of(matcher, parts[part], ids[where], null[where], pa.array(keys[where]), scores[row, parts[part]])
                        scores[:, parts] = 0
                    best.add(scores, ids[rows], null[rows])
        nothing = pa.nulls(len(best.item), pa.int64())
        yield batch_of(matcher, best.item, best.doc, best.null, nothing, best.score)

    return run


def _ranked(found: DataFrame, top: int, key: Column) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: of every item the ``top`` documents of
    the highest scores above 0."""
    spark = docs.sparkSession
    terms = item_terms(items, block_bytes)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    keyed = texts.select("text", "doc_id", F.xxhash64("text").alias("text_key"))
    found = []
    for (block,) in sorted(terms.select("block").distinct().collect()):
        matcher = Matcher([tuple(r) for r in terms.filter(F.col("block") == block).select("item", "term", "whole").collect()])
        shared = share(spark, matcher)
        counted = texts.select("text").mapInArrow(_counting(shared), COUNTED).groupBy("term").agg(F.sum("n").alias("n"))
        n = {r.term: r.n for r in counted.collect()}  # a row for each term of the block
        documents, words = n.get(DOCUMENTS, 0), n.get(WORDS, 0)
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n.get(i, 0) + 1))) for i in range(len(matcher.terms))]
        score = _scoring(shared, np.array(weights, dtype=np.int64), documents, words, top)
        found.append((keyed.mapInArrow(score, SCORED), bool(matcher.whole.all())))
    kind = items.schema["item_id"].dataType
    out = [f.filter("text_key is null").select("item", "doc_id", "score") for f, _ in found]
    torn = [f.filter("text_key is not null").withColumn("block", F.lit(i)) for i, (f, whole) in enumerate(found) if not whole]
    if torn:
        # rows that agree in id and text have the same scores in every block
        by_block = (
            reduce(DataFrame.unionByName, torn)
            .groupBy("item", "doc_id", "text_key", "block")
            .agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("copies"))
        )
        summed = by_block.groupBy("item", "doc_id", "text_key").agg(F.sum("score").alias("score"), F.max("copies").alias("copies"))
        each = F.sequence(F.lit(1), F.least("copies", F.lit(top)).cast("int"))
        out.append(summed.withColumn("copy", F.explode(each)).select("item", "doc_id", "score"))
    if not out:
        out = [spark.createDataFrame([], "item string, doc_id long, score long")]
    ranked = _ranked(reduce(DataFrame.unionByName, out), top, F.col("item"))
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")
