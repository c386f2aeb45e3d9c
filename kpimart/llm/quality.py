"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are the shapes of a text rather than its vocabulary: trigrams of
character classes (runs of letters, digits or white space count once), and
words that repeat the word before them, hashed into ``TERMS`` columns. Latent
vectors come from a truncated singular value decomposition of the weighted
term matrix of the labelled texts. All labelled vectors are broadcast; each
document's cosine with every one of them is computed exactly, a block of
documents at a time, and the labels of the ``NEIGHBOURS`` nearest ones are
averaged, weighted by similarity.

The labelled rows are a bounded sample: the ``LABELLED`` first in the order of
a hash of the id, and of the distinct texts that these ids have, every id's
first one before any second one. So the broadcast, what reaches the driver and
the work per document are fixed, however often an id or a text repeats.

Edge cases: a null or empty text has no terms and gets the mean label; ties in
similarity go to the labelled row first in order; labels other than 0 and 1
are not used; without labelled rows all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kpimart.llm import textvec
from kpimart.llm.tasks import share

TERMS = 2048
DIMENSIONS = 48
LABELLED = 4096
NEIGHBOURS = 24
#: Similarities count by this power, so that the nearest ones decide.
SHARPNESS = 8
ACCEPT = 0.7
SLICE_BYTES = 2 << 20
BLOCK = 512

_SPACE, _BREAK, _LOWER, _UPPER, _DIGIT, _CLASSES = 0, 1, 2, 3, 4, 40


def _class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[10] = _BREAK
    table[97:123] = _LOWER
    table[128:] = _LOWER
    table[65:91] = _UPPER
    table[48:58] = _DIGIT
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = np.arange(len(marks)) + _DIGIT + 1
    return table


_TABLE = _class_table()


def term_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first, end, counts)``: a ``(texts, TERMS)`` matrix for each slice."""
    data, offsets, _ = textvec.utf8(texts)
    keep, values = textvec.word_bytes(textvec.NOT_ALNUM), textvec.byte_values()
    n, at = len(texts), 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(at + 1, end), at + BLOCK)
        bounds = offsets[at : end + 1] - offsets[at]
        part = data[offsets[at] : offsets[end]]
        counts = np.zeros((end - at) * TERMS, dtype=np.int64)
        owner = np.repeat(np.arange(end - at), np.diff(bounds))
        kind = _TABLE[part].astype(np.int64)
        fresh = np.ones(len(kind), dtype=bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > _DIGIT) | (owner[1:] != owner[:-1])
        kind, owner = kind[fresh], owner[fresh]
        if len(kind) > 2:
            whole = owner[2:] == owner[:-2]
            gram = ((kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:])[whole]
            column = (textvec.mix64(gram.astype(np.uint64) + np.uint64(1)) % np.uint64(TERMS - 1)).astype(np.int64)
            counts += np.bincount(owner[2:][whole] * TERMS + column, minlength=len(counts))
        hashes, n_words = textvec.words(part, bounds, keep, values)
        if len(hashes) > 1:
            word_owner = np.repeat(np.arange(end - at), n_words)
            again = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
            np.add.at(counts, word_owner[1:][again] * TERMS + TERMS - 1, 1)
        yield at, end, counts.reshape(end - at, TERMS)
        at = end


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    x = np.sqrt(counts / total) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class NeighbourVote:
    """Term weights, the latent basis, and the labelled latent vectors."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> NeighbourVote:
        n = len(labels)
        idf = np.log((n + 1) / ((counts > 0).sum(axis=0) + 1)) + 1
        x = _weighted(counts, idf)
        # right singular vectors, from the (TERMS x TERMS) Gram matrix
        _, vectors = np.linalg.eigh(x.T @ x)
        basis = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        model = cls(idf, basis, np.zeros((0, DIMENSIONS), np.float32), labels.astype(np.float32))
        model.vectors = model.latent(counts)
        return model

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = _weighted(counts, self.idf).astype(np.float32) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted vote for each row of term counts."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(float) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 0, vote, float(self.labels.mean())), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled_counts(batches):
    for batch in batches:
        for at, end, counts in term_counts(batch.column(1)):
            row, column = np.nonzero(counts)
            sizes = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=end - at)))).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(sizes), pa.array(v.astype(np.int32)))
                for v in (column, counts[row, column])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, end - at), *(batch.column(i).slice(at, end - at) for i in (2, 3, 4)), *lists],
                ["order", "quality", "nth", "text_key", "terms", "counts"],
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> NeighbourVote:
    """A vote fitted on ``docs`` (doc_id, text) with ``labels`` (doc_id,
    quality), held-out rows left out; at most ``rows`` labels are used."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id").alias("order")
    sample = usable.select("doc_id", order, F.col("quality").cast("int").alias("quality")).distinct()
    # the sample's size is the bound
    sample = F.broadcast(sample.orderBy("order", "doc_id", "quality").limit(rows))
    # one row per id, label and text, by hashes; texts only of the rows that are used
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    distinct = keyed.join(sample, "doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id", "quality").orderBy("text_key"))
    order = ["nth", "order", "doc_id", "quality"]
    used = F.broadcast(distinct.withColumn("nth", nth).filter(F.col("nth") <= rows).orderBy(*order).limit(rows))
    found = (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        .join(used, ["doc_id", "text_key"])
        .groupBy("doc_id", "order", "quality", "nth", "text_key")
        .agg(F.min("text").alias("text"))
        .select("order", "text", "quality", "nth", "text_key")
        .mapInArrow(_labelled_counts, "order long, quality int, nth int, text_key long, terms array<int>, counts array<int>")
        .toArrow()
    )
    found = found.sort_by([(c, "ascending") for c in ("nth", "order", "quality", "text_key")])
    counts = np.zeros((found.num_rows, TERMS))
    for i, (terms, n) in enumerate(zip(found["terms"], found["counts"], strict=True)):
        counts[i, terms.values.to_numpy()] = n.values.to_numpy()
    if not found.num_rows:
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return NeighbourVote(np.ones(TERMS), np.zeros((TERMS, DIMENSIONS), np.float32), empty, np.zeros(0, np.float32))
    return NeighbourVote.fit(counts, found["quality"].to_numpy())


def score(docs: DataFrame, model: NeighbourVote, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with ``score`` and ``predicted``."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = shared()
        for batch in batches:
            parts = [model.score(counts) for _, _, counts in term_counts(batch.column(len(keep)))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))],
                [*keep, "score", "predicted"],
            )

    schema = T.StructType(
        [*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
