"""Language ID by bit-sliced Bloom filters of character n-grams.

One filter holds all languages: tables of 64-bit masks, one table for every 64
languages, in which a bit belongs to each language. A language's n-grams set its bit in ``HASHES`` rows of the
table; the AND of a gram's rows is the set of all languages that contain it
(and, rarely, of some that don't). The bits are counted over all n-grams of a
text, each language's count is corrected for its false positives, and the
language of the largest corrected count wins.

Grams are four bytes of lower-cased UTF-8 in which everything but letters is
one space. A language's grams are those found in at least ``MIN_SHARE`` of
its training texts; the table has rows enough for the language of the most
grams. It is trained on a bounded sample of labelled rows,
``TRAIN_PER_LANGUAGE`` of each language, taken in the order of a hash.

Edge cases: a text that is null or has no letter is ``und`` with score 0; ties
go to the language with more training rows, and so does a text without known
grams, with score 0; without training rows all is ``und``. Every language of the
training rows is learned. Columns of maps don't enter the sample's order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.llm import textvec
from kpimart.llm.tasks import share

GRAM = 4
TRAIN_PER_LANGUAGE = 8000
MIN_SHARE = 0.01
TABLE_BITS = 18
HASHES = 2
WORD_BITS = 64
MAX_FILL = 0.25
UNKNOWN = "und"
SLICE_BYTES = 1 << 20

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER[_LETTER == 0] = 32


def text_grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, grams, owners)`` for slices of a column of texts: every
    four bytes that begin with a letter or with a space before one. A text is
    bounded by spaces; runs of other characters are one space."""
    data, offsets, _ = textvec.utf8(pc.utf8_lower(texts))
    n, at = len(texts), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        bounds = offsets[at : end + 1] - offsets[at]
        part = _LETTER[data[offsets[at] : offsets[end]]]
        # a space of its own after each text, and one before the first
        owner_sizes = np.diff(bounds) + 1
        padded = np.full(len(part) + (end - at) + 1, 32, dtype=np.uint8)
        places = np.arange(len(part)) + np.repeat(np.arange(end - at), np.diff(bounds)) + 1
        padded[places] = part
        owner = np.concatenate((np.repeat(np.arange(end - at), owner_sizes), [end - at - 1]))
        keep = np.ones(len(padded), dtype=bool)
        keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (owner[1:] != owner[:-1])
        padded, owner = padded[keep], owner[keep]
        if len(padded) < GRAM:
            yield at, end, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        else:
            m = len(padded) - GRAM + 1
            grams = np.zeros(m, dtype=np.uint32)
            for j in range(GRAM):
                grams |= padded[j : j + m].astype(np.uint32) << np.uint32(8 * j)
            inside = (padded[1 : 1 + m] != 32) & (owner[1 : 1 + m] == owner[GRAM - 1 : GRAM - 1 + m])
            yield at, end, grams[inside], owner[1 : 1 + m][inside]
        at = end


def table_rows(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The rows of the filter that belong to each gram, one hash at a time."""
    mixed = textvec.mix64(grams.astype(np.uint64) + np.uint64(1))
    for i in range(HASHES):
        yield ((mixed >> np.uint64(32 * i)) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """The bit-sliced filter: ``masks``, with a line for every 64 languages, and each language's share of set bits (``fill``), which gives
    its false positive rate."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray
    bits: int = TABLE_BITS

    @classmethod
    def build(cls, languages: list[str], grams: dict[str, np.ndarray], bits: int | None = None) -> LanguageFilter:
        """Rows enough that a language sets a quarter of them at most."""
        if bits is None:
            most = max((len(g) for g in grams.values()), default=0)
            bits = max(TABLE_BITS, int(np.ceil(np.log2(max(1, HASHES * most) / MAX_FILL))))
        words = -(-len(languages) // WORD_BITS)
        masks = np.zeros((words, 1 << bits), dtype=np.uint64)
        for i, name in enumerate(languages):
            for rows in table_rows(grams[name], bits):
                masks[i // WORD_BITS][rows] |= np.uint64(1 << (i % WORD_BITS))
        fill = np.array([cls._bit(masks, i).mean() for i in range(len(languages))])
        return cls(languages, masks, fill, bits)

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[language // WORD_BITS] >> np.uint64(language % WORD_BITS)) & np.uint64(1)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each gram."""
        found = np.full((len(self.masks), len(grams)), np.uint64(0xFFFFFFFFFFFFFFFF))
        for rows in table_rows(grams, self.bits):
            found &= self.masks[:, rows]
        return found

    def corrected(self, masks: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """``(texts, languages)``: the grams of each language in each text,
        less those expected to be false positives."""
        total = np.bincount(owners, minlength=n).astype(float)
        out = np.zeros((n, len(self.languages)))
        for i in range(len(self.languages)):
            hits = np.bincount(owners, weights=self._bit(masks, i).astype(float), minlength=n)
            rate = self.fill[i] ** HASHES
            out[:, i] = np.maximum(0.0, (hits - rate * total) / (1 - rate)) if rate < 1 else 0.0
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for at, end, grams, owners in text_grams(texts):
            counts = self.corrected(self.containing(grams), owners, end - at)
            best = counts.argmax(axis=1) if self.languages else np.zeros(end - at, int)
            sums = counts.sum(axis=1)
            top = counts.max(axis=1, initial=0.0)
            scores.append(np.where(sums > 0, top / np.maximum(sums, 1e-12), 0.0))
            names += [self.languages[b] if self.languages else UNKNOWN for b in best]
        return names, np.concatenate(scores) if scores else np.zeros(0)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script."""
    ascii_letter = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False)
    found = np.array(ascii_letter, dtype=bool)
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return found


def _count_grams(batches):
    """Per batch: in how many texts of a language each gram is found."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        code = lang.indices.to_numpy().astype(np.uint64)
        for at, end, grams, owners in text_grams(batch.column(1)):
            pairs = np.unique((owners.astype(np.uint64) << np.uint64(32)) | grams.astype(np.uint64))
            owner = (pairs >> np.uint64(32)).astype(np.int64)
            keyed = (code[at:end][owner] << np.uint64(32)) | (pairs & np.uint64(0xFFFFFFFF))
            key, n = np.unique(keyed, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array((key >> np.uint64(32)).astype(np.int32))),
                    pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                ["lang", "gram", "n"],
            )


def train(rows: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageFilter:
    """A filter from labelled rows (``lang``, ``text``); of each language those
    of about ``per_language`` rows whose hash is below a bound (all, if there
    are no more). Rows that repeat share a hash and are taken together."""
    hashed = [f.name for f in rows.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    known = rows.filter("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64(*hashed).alias("__order")
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageFilter.build([], {})
    # the order value at which each language's sample ends: hash values are
    # even, so the share of the rows to take is the share of their range
    bounds = {name: (1 << 64) * per_language // c - (1 << 63) for name, c in sizes.items() if c > per_language}
    inside = F.lit(False)
    for name, bound in bounds.items():
        inside = inside | ((F.col("lang") == name) & (F.col("__order") >= bound))
    inside = ~inside
    sample = known.filter(inside)
    counted = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    taken = {n: min(c, per_language) for n, c in sizes.items()}
    least = F.lit(2.0)
    for name, c in taken.items():
        least = F.when(F.col("lang") == name, F.lit(max(2.0, MIN_SHARE * c)) if c > 4 else F.lit(1.0)).otherwise(least)
    grams = (
        counted.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
        .select("lang", "gram")
        .toPandas()
    )
    found = {name: part["gram"].to_numpy().astype(np.uint32) for name, part in grams.groupby("lang")}
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    return LanguageFilter.build(languages, {n: found.get(n, np.zeros(0, np.uint32)) for n in languages})


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: LanguageFilter, keep: list[str], prefix: str = "") -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``;
    ``prefix`` sets the names of these apart from columns of ``keep``."""
    shared = share(docs.sparkSession, model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def told(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared()
        for texts in parts:
            names, scores = model.predict(texts)
            known = has_letter(texts)
            lang = pa.array([n if k else UNKNOWN for n, k in zip(names, known, strict=True)], pa.string())
            yield pa.StructArray.from_arrays([lang, pa.array(np.where(known, scores, 0.0))], ["lang_pred", "score"])

    # only the text goes to the task's Python worker; other columns stay behind
    found = docs.select(*keep, told("text").alias(prefix + "__told"))
    told_at = F.col(prefix + "__told")
    return found.select(*keep, told_at["lang_pred"].alias(prefix + "lang_pred"), told_at["score"].alias(prefix + "score"))


def language_model(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageFilter:
    """A filter learned from the rows of ``docs`` that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))), per_language)
