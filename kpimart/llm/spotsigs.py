"""SpotSigs document fingerprints (native).

A spot signature is an anchor (one of a fixed list of very common words) with
the chain of content words that follows it, anchors skipped. The distinct
signatures of a text, hashed to 64 bits and sorted, are its signature set; the
fingerprint is the SHA-256 of that set. A text without a full chain has one
signature, of all its words; a text without words has none.

Sets are compared by Jaccard similarity. ``similar_pairs`` partitions sets by
their length, so that only sets of the same or the next partition can reach
the threshold, looks up shared signatures of the partition within a prefix,
and prunes by the lengths before the exact comparison.

Edge cases: a null text is empty; two empty sets are alike (1.0), an empty
and another one are not (0.0); ids may be null or repeat (ties are ordered by
a hash of the text); the last document is followed by the first one, and a
single document by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpimart.llm.tasks import written

# Common words of English, German, French and Spanish.
ANCHORS = """
the of and to in is that it was for on with as by this from be at are or
der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es
le la les et des en un une du est que qui dans pour par sur au pas plus ne
el los las de y que se del con una su por para no al lo como
""".split()

CHAIN = 2
THRESHOLD = 0.75
ROWS_PER_CELL = 2000
CELLS_PER_WINDOW = 1024
#: ASCII characters other than 0-9A-Za-z end a word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``out``, the sorted distinct 64-bit signatures of ``text``."""
    anchors = sorted(set(ANCHORS))
    w, c, p = f"{out}_words", f"{out}_content", f"{out}_places"
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP), lambda x: x != "")
    df = df.withColumn(w, words)
    df = df.withColumn(c, F.filter(F.col(w), lambda x: ~x.isin(anchors)))
    places = F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
    df = df.withColumn(p, places)

    def signature(place: Column, nth: Column) -> Column:
        # before the nth anchor stand (place - nth) content words
        first = place - nth
        parts = [F.get(F.col(c), first + k) for k in range(chain)]
        return F.when(parts[-1].isNotNull(), F.xxhash64(F.get(F.col(w), place), *parts))

    found = F.array_compact(F.transform(F.col(p), signature))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", F.col(w))))).otherwise(
        F.array().cast("array<bigint>")
    )
    df = df.withColumn(out, F.sort_array(F.array_distinct(found)))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(w, c, p)


def fingerprint(signatures: Column) -> Column:
    """SHA-256 (hex) of a signature set."""
    return F.sha2(F.concat_ws(",", F.transform(signatures, lambda s: s.cast("string"))), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two sets; 1.0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Partitions whose bounds grow by 1/threshold: sets two partitions apart
    differ too much in length to reach the threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def similar_pairs(sets: DataFrame, key: str, signatures: str, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity`` of pairs of rows whose non-empty sets reach the
    threshold (``a < b``). Rows with equal sets should be merged beforehand.

    A set is looked up by the first ``n - ceil(threshold * n) + 1`` signatures
    in hash order, in its own length partition and the next one: two sets that
    reach the threshold share one of these.
    """
    n = F.size(signatures)
    rows = sets.filter(n > 0).select(F.col(key).alias("k"), F.col(signatures).alias("s"), n.alias("n"))
    prefix = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    band = length_partition(F.col("n"), threshold)
    keyed = rows.select("k", "n", F.explode(prefix).alias("sig"), band.alias("band"))
    home = keyed.select("sig", "band", "k", "n")
    seen = keyed.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    left, right = seen.alias("l"), home.alias("r")
    # the smaller set (by length, then key) looks up the larger one
    ordered = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.k") < F.col("r.k")))
    near = F.col("l.n") >= F.col("r.n") * threshold - 1e-9
    pairs = (
        left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.band") == F.col("r.band")))
        .filter(ordered & near)
        .select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b"))
        .distinct()
    )
    one = rows.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    other = rows.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(one, "a").join(other, "b").withColumn("similarity", jaccard(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")


def id_cells(docs: DataFrame, rows_per_cell: int) -> Column:
    """An expression that cuts the ids into ranges of bounded row counts: the
    width halves until no range holds over eight times the aim (or one id).
    Null ids come last, cut by the hash of their text; so are the rows of one
    id where ids lie dense or repeat. Rows equal in both share a cell."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    low, high = low or 0, high or 0
    width = max(1, (high - low + 1) * rows_per_cell // max(n, 1))
    while width > 1:
        cell = F.floor((F.col("doc_id") - low) / width)
        most = docs.filter("doc_id is not null").groupBy(cell.alias("c")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= 8 * rows_per_cell:
            break
        width = max(1, width // 2)
    by_id = F.floor((F.col("doc_id") - low) / width).cast("long")
    if width == 1 and n > 8 * rows_per_cell and high - low < 1 << 46:
        # one id may hold any number of rows: its texts are cut by their hash
        by_id = by_id * (1 << 16) + (F.shiftright("tie", 48) + (1 << 15))
    return F.when(F.col("doc_id").isNull(), F.shiftright("tie", 48) - (1 << 17)).otherwise(by_id)


def next_below(cells: DataFrame, fan: int) -> DataFrame:
    """``cell, next_cell`` of a table of distinct whole numbers: the greatest
    one below each, and the greatest of all for the least. A window holds at
    most ``fan`` of them: those of one multiple of ``fan``, the multiples in
    turn being linked the same way."""
    if cells.count() <= fan:
        down = Window.orderBy(F.desc("cell"))
        around = F.max("cell").over(Window.partitionBy())
        return cells.select("cell", F.coalesce(F.lead("cell").over(down), around).alias("next_cell"))
    parted = cells.withColumn("part", F.expr(f"cell div {fan} - if(cell % {fan} < 0, 1, 0)"))
    tops = written(parted.groupBy("part").agg(F.max("cell").alias("top")), "signature-cells")
    linked = next_below(tops.select(F.col("part").alias("cell")), fan)
    entry = linked.join(tops.withColumnRenamed("part", "next_cell"), "next_cell").select(F.col("cell").alias("part"), "top")
    inside = F.lead("cell").over(Window.partitionBy("part").orderBy(F.desc("cell")))
    return parted.withColumn("next_cell", inside).join(entry, "part").select("cell", F.coalesce("next_cell", "top").alias("next_cell"))


def with_next_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document in descending
    order of the ids, and of the first one for the last.

    Documents are sorted within ranges of ids; the last one of a range gets
    the first one of the range below, found in a table of one row per range.
    """
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    )
    rows = rows.withColumn("cell", id_cells(docs, ROWS_PER_CELL))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    firsts = rows.groupBy("cell").agg(F.max_by("text", order).alias("first_text"))
    below = next_below(written(rows.select("cell").distinct(), "signature-cells"), CELLS_PER_WINDOW)
    entry = below.join(firsts.withColumnRenamed("cell", "next_cell"), "next_cell").select("cell", "first_text")
    inside = Window.partitionBy("cell").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    led = rows.withColumn("next_text", F.lead("text").over(inside))
    return led.join(entry, "cell").select(
        "doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text")
    )


def edited_text(text: Column, next_text: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as
    many (or all) of ``next_text``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each document's fingerprint next to those of its edited text and of the
    next document, with the likeness of their signature sets."""
    rows = with_next_text(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    for text, out in (("text", "own_sigs"), ("edited", "edited_sigs"), ("next_text", "next_sigs")):
        rows = with_signatures(rows, text, out, chain)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own_sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("own_sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("own_sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("own_sigs").alias("n_signatures"),
        length_partition(F.size("own_sigs")).alias("length_partition"),
    )
