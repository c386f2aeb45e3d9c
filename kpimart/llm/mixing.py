"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source gets its weight's share of all words, but no more than a
fixed number of passes over its own words; what it cannot take is shared out
among the others by weight.

Schedule: slot ``j`` has the golden-ratio point ``frac(j * 0.618...)``. The
point falls into the source whose interval of the cumulative targets holds
it, so that every stretch of the schedule has the target mix. Slots are ranked
per source, and share the source's target (in whole words) evenly.

Blocks: a source's documents are shuffled by hash, laid end to end and cut into
blocks of as many words as a slot of it takes (the last may be short). The
blocks are shuffled in their turn; a pass of the source is all blocks in that
order, the short one last. The slots take the words of the passes one after
the other: slots and blocks meet by (source, place of the block in the pass),
and a document gets what the slots take of the blocks that it lies in. So the
number of points in a source's interval sets where its blocks begin, and which
documents a broken pass takes; each source gets its target to the word however
small it is, as its slots reach over the ends of blocks and passes. A source
that no point falls into has one slot after the others.

The number of slots is a fixed parameter; the words of a slot follow from it.

Edge cases: a null or empty text has no words and is taken for 0; null
sources are a source of their own, ordered last; rows that agree in id, text
and source each have places of their own; a very long text lies in many
blocks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpimart.llm.tasks import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SCHEDULE_SLOTS = 1 << 20
GOLDEN = 0.6180339887498949
#: Parts of the unit interval that the schedule and the sources are joined on.
CELLS = 1024
#: Slots that are ranked together.
CHUNK_SLOTS = 1 << 12
#: Rows of a part of a source's shuffled order, and copies of a row that stay together.
PART_ROWS = 1 << 12
COPIES = 1 << 8
#: A prime: block ``i`` of ``n`` goes to place ``(i * STRIDE + shift) % n``.
STRIDE = 7_368_787


@dataclass(frozen=True)
class Mix:
    """What a mix is made of: ``sources`` (source_key, source_size, target,
    rn), ``schedule`` (slot, source_key, source_size, rank, first, words: how
    many words the source's earlier slots and this one take), ``blocks`` (a row
    per source: source_size, block_words, n_blocks, shift) and ``layout`` (the
    documents with ``start``, their first word's place in the source)."""

    sources: DataFrame
    schedule: DataFrame
    blocks: DataFrame
    layout: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A join key that holds nulls too, in the order of the sources."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``source_key, source_size, target`` (one row per source) from the
    sources' sizes. Sources in the order of cap over weight: the first whose
    cap is above its share of what is left fixes the share of all later ones."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rn", F.row_number().over(Window.orderBy("source_key")))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * passes).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", "rn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = ranked.withColumn("share", left / weights_left)
    level = F.min_by(
        F.when(F.col("ratio") > F.col("share"), F.col("share")),
        F.when(F.col("ratio") > F.col("share"), F.struct("ratio", "rn")),
    ).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return shared.withColumn("level", level).select("source_key", "rn", "source_size", target.alias("target"))


def make_schedule(sources: DataFrame, slots: int) -> DataFrame:
    """``slot, source_key, source_size, rank, first, words`` for ``slots`` slots,
    and for one more of each source that has none of them."""
    upto = Window.partitionBy(F.lit(0)).orderBy("rn")
    everything = Window.partitionBy(F.lit(0))
    hi = F.sum("target").over(upto) / F.sum("target").over(everything)
    lo = F.coalesce(F.lag("hi").over(upto), F.lit(0.0))
    spans = (
        sources.filter(F.col("target") > 0)
        .withColumn("hi", hi)
        .withColumn("lo", lo)
        .withColumn("hi", F.when(F.lead("rn").over(upto).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    )
    last_cell = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("lo") * CELLS), last_cell), last_cell)))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = (
        sources.sparkSession.range(slots)
        .select(F.col("id").alias("slot"), F.lit(0).alias("z"))
        .withColumn("point", point)
        .withColumn("cell", F.least(F.floor(F.col("point") * CELLS), F.lit(CELLS - 1)))
    )
    placed = points.join(cells, "cell").filter((F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi")))
    columns = ["slot", "source_key", "source_size", "target"]
    spare = spans.withColumn("slot", F.lit(slots).cast("long") + F.col("rn")).select(*columns, F.lit(1).alias("spare"))
    every = placed.select(*columns, F.lit(0).alias("spare")).unionByName(spare)
    # slots are ranked within chunks, after the slots of earlier chunks; a
    # source's spare slot is its last
    every = every.withColumn("chunk", F.expr(f"slot div {CHUNK_SLOTS}"))
    before = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        every.groupBy("source_key", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "source_key",
            "chunk",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunk_first"),
            F.greatest(F.sum("n").over(Window.partitionBy("source_key")) - 1, F.lit(1)).alias("used"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("source_key", "chunk").orderBy("slot")).cast("long") - 1
    whole = F.round("target").cast("decimal(38,0)")

    def upto(n: Column) -> Column:
        # whole numbers, as target times rank may pass 2^63
        return F.floor(whole * n / F.col("used")).cast("long")

    return (
        every.withColumn("in_chunk", rank)
        .join(chunks, ["source_key", "chunk"])
        .withColumn("rank", F.col("chunk_first") + F.col("in_chunk"))
        .filter(F.col("rank") < F.col("used"))
        .withColumn("first", upto(F.col("rank")))
        .withColumn("words", upto(F.col("rank") + 1) - F.col("first"))
        .select("slot", "source_key", "source_size", "rank", "first", "words")
    )


def cut_blocks(schedule: DataFrame, seed: int = 0) -> DataFrame:
    """How each source is cut: ``source_key, source_size, block_words`` (what a
    slot takes on the mean), ``n_blocks``, and ``shift`` of their order."""
    words = F.greatest(F.expr("reach div used"), F.lit(1).cast("long"))
    return (
        schedule.groupBy("source_key", "source_size")
        .agg(F.sum("words").alias("reach"), F.count(F.lit(1)).alias("used"))
        .withColumn("block_words", words)
        .withColumn("n_blocks", F.expr("(source_size + block_words - 1) div block_words"))
        .withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "source_key"), F.greatest(F.col("n_blocks") - 1, F.lit(1))))
        .select("source_key", "source_size", "block_words", "n_blocks", "shift")
    )


def block_place() -> Column:
    """The place in a pass of ``block`` of ``n_blocks``; the last keeps its own."""
    n = F.col("n_blocks") - 1
    stride = F.when(n % STRIDE == 0, F.lit(1)).otherwise(F.lit(STRIDE)).cast("long")
    return F.when(F.col("block") < n, (F.col("block") * stride + F.col("shift")) % F.greatest(n, F.lit(1))).otherwise(F.col("block"))


def lay_out(sized: DataFrame, seed: int = 0, part_bits: int = 10) -> DataFrame:
    """``doc_id, text_key, source_key, size, start`` of every row: the documents
    of a source in the order of a seeded hash, end to end. Prefix sums run in
    two steps (``2 ** part_bits`` parts of the hash range, then the rows of a
    part), and copies of a row are dealt over the parts, so that neither a hot
    source nor a hot row meets in one task."""
    keys = ["doc_id", "text_key", "source_key", "size"]
    together = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("unit") * COPIES)
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key"), F.col("unit"))
    rows = (
        sized.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
        .withColumn("copies", together)
        .withColumn("mixed", mixed)
        .withColumn("part", F.shiftrightunsigned("mixed", 64 - part_bits))
    )
    words = F.col("size") * F.col("copies")
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("source_key", "part")
        .agg(F.sum(words).alias("part_size"))
        .select("source_key", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    )
    inside = (
        Window.partitionBy("source_key", "part")
        .orderBy("mixed", "doc_id", "text_key", "unit")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(parts, ["source_key", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(*keys, (F.col("part_start") + F.col("inside") + F.col("copy") * F.col("size")).alias("start"))
    )


def size_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source_key, size, text_key``: all that a mix needs of a text."""
    return docs.select(
        "doc_id",
        source_key(F.col("source")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_key"),
    )


def plan_mix(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    passes: int = MAX_PASSES,
    slots: int = SCHEDULE_SLOTS,
    seed: int = 0,
) -> Mix:
    """Plan the mix of sized documents (``size_documents``, best read from a
    written table: it is used three times)."""
    sizes = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # both are read several times
    targets = written(source_targets(sizes, weights, passes), "mix-targets")
    schedule = written(make_schedule(targets, min(total, slots)), "mix-schedule")
    part_bits = max(4, (rows // PART_ROWS).bit_length())
    return Mix(targets, schedule, cut_blocks(schedule, seed), lay_out(sized, seed, part_bits))


def blocks_taken(mix: Mix) -> DataFrame:
    """``source_key, place, words``: what all slots take of the block at each
    place, summed over the (slot, block) pairs and the passes. The slots follow
    each other, so of a block taken in part it is the first words."""

    def place_at(y: Column) -> Column:
        # blocks counted on over the passes
        return F.call_function("div", y, F.col("source_size")) * F.col("n_blocks") + F.call_function(
            "div", y % F.col("source_size"), F.col("block_words")
        )

    end = F.col("first") + F.col("words")
    run = F.expr("nth div n_blocks") * F.col("source_size")
    start = F.expr("(nth % n_blocks) * block_words")
    stop = F.least(start + F.col("block_words"), F.col("source_size"))
    return (
        mix.schedule.filter("words > 0")
        .join(mix.blocks, ["source_key", "source_size"])
        .withColumn("nth", F.explode(F.sequence(place_at(F.col("first")), place_at(end - 1))))
        .withColumn("taken", F.least(run + stop, end) - F.greatest(run + start, F.col("first")))
        .groupBy("source_key", F.expr("nth % n_blocks").alias("place"))
        .agg(F.sum("taken").alias("words"))
    )


def words_taken(mix: Mix) -> DataFrame:
    """``doc_id, text_key, source_key, size, taken`` per document: the words
    that the schedule takes of the blocks it lies in, repeats counted."""
    keys = ["doc_id", "text_key", "source_key", "size"]
    first = F.col("block") * F.col("block_words")
    lo = F.greatest(F.col("start"), first) - first
    hi = F.least(F.col("start") + F.col("size"), first + F.col("block_words")) - first
    pieces = (
        mix.layout.filter("size > 0")
        .join(mix.blocks, "source_key")
        .withColumn(
            "block",
            F.explode(F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words"))),
        )
        .select(
            *keys,
            "start",
            lo.alias("lo"),
            hi.alias("hi"),
            F.least(F.col("block_words"), F.col("source_size") - first).alias("length"),
            block_place().alias("place"),
        )
    )
    part = F.least(F.col("hi"), F.expr("words % length")) - F.col("lo")
    n = F.expr("words div length") * (F.col("hi") - F.col("lo")) + F.greatest(part, F.lit(0))
    # a row with words is alone at its start
    found = (
        pieces.join(blocks_taken(mix), ["source_key", "place"], "left")
        .groupBy(*keys, "start")
        .agg(F.sum(F.coalesce(n, F.lit(0))).cast("long").alias("taken"))
        .drop("start")
    )
    none = mix.layout.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    columns = ["doc_id", "text_key", "source_key", "size", "taken"]
    return found.select(*columns).unionByName(none.select(*columns))
