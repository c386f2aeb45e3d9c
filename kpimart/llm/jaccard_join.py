"""N-gram Jaccard join by token-combination prefixes.

Tokens are the distinct word shingles of a text. All tokens are put in one
order: by frequency class (powers of two of how often they were counted),
rarest first, then by hash. Rare classes are indexed by single tokens;
frequent classes are dealt into parts by hash and indexed by pairs of tokens
of one part. Of two sets that reach the threshold, ``need`` = n - ceil(t*n) + 1
tokens of a prefix cannot all be missing from the other set, and a part whose
tokens are indexed by pairs may hide one shared token; so a prefix is extended
until its single tokens, plus its tokens less one per part, make ``need``.
Two similar sets then share a signature. The number of parts follows the
length of the sets (a power of two per length band, so that both sides agree),
which keeps the pairs in proportion to the set.

Candidates of a signature are compared with its hub only: the member with the
fewest rare tokens. What is linked that way is one component, so a large group
of near copies costs one comparison per member. Two members of a hub's group
that are not both linked with it may still be similar. They are found in the
space of differences from the hub: ``D(x)`` holds the tokens that x adds to the
hub's set, then those it lacks. |x ^ y| = |D(x) ^ D(y)|, so a similar pair's
differences must overlap by at least (|D(x)| + |D(y)| - c(|x| + |y|)) / 2,
where c = (1 - t) / (1 + t); one of the two is not linked with the hub, hence
|D| > c(|x| + |hub|), which makes that overlap about half of either, and never
less than |D| - |x|(1 - t) / t. So these differences are joined by their own
prefixes (added tokens first, as these are the rare ones), and the pairs found
are verified. That needs members that resemble the hub. A member whose
difference is larger than most of its own size shares little more than a
passage with the hub; it is paired with the other members of the signature's
run instead, if sizes and places in the common order allow. No link is lost.

Most pairs of a signature share a passage and no more. Every set has a bitmap of
its tokens' hash buckets, two to four bits a token: buckets that one set fills and
another does not hold as many tokens of the difference at least, which bounds
the overlap from above. Texts are fetched only for pairs that the bound leaves
open; it settles no pair that it does not prove.

Counts cover all documents: every task counts the tokens of a batch and
reports those found in two or more distinct sets. The order only needs to be
the same for all; results do not depend on it. The table of classes is cut at
the least count that at most ``TABLE_ROWS`` tokens reach: its size is bounded.

Equal sets are one node (a 64-bit hash of the set), so copies are compared
once. Edge cases: null texts and texts without words have an empty set and
link with nothing; a text of fewer than ``k`` words is one shingle; rows of a
null or repeated id are rows like others (a component's id is its smallest
non-null id).
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpimart.llm import textvec
from kpimart.llm.components import connected_components
from kpimart.session import scratch_dir
from kpimart.sinks.store import delete_path

SHINGLE = 5
#: The similarity that links, in hundredths.
PERCENT = 75
#: Rows of the broadcast class table at most (9 bytes each).
TABLE_ROWS = 1 << 20
#: Tokens counted 2**PAIR_CLASS times or more are indexed by pairs.
PAIR_CLASS = 6
#: Tokens of a set per part of the frequent classes.
PART_TOKENS = 16
#: Bytes of text a task turns into sets at a time.
SLICE_BYTES = 4 << 20
#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 1 << 20
#: A member is far from its hub if their difference is more than this many
#: times the member's size; far members are paired by shared signatures.
FAR = 0.7
#: Buckets of a set's bitmap per token, before rounding up to a power of two.
BUCKETS = 2
#: Bits of the packed rank: rare tokens (saturating) above the set's size
#: above the signature's place (saturating).
SIZE_BITS, PLACE_BITS, RARE_MOST = 28, 19, (1 << 16) - 1


def text_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, tokens, counts)`` for slices of a column of texts."""
    data, offsets, _ = textvec.utf8(texts)
    keep, values = textvec.word_bytes(textvec.SPACE), textvec.byte_values()
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        part = data[offsets[at] : offsets[end]]
        hashes, counts = textvec.words(part, offsets[at : end + 1] - offsets[at], keep, values)
        yield at, end, *textvec.shingles(hashes, counts, k)
        at = end


def set_nodes(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set."""
    sums = textvec.segment_sum(textvec.mix64(tokens), counts)
    return textvec.mix64(sums + counts.astype(np.uint64)).view(np.int64)


def _first_of_each(nodes: np.ndarray, counts: np.ndarray, seen: set | None = None) -> np.ndarray:
    """Which sets are the first of their kind (and not empty)."""
    first = np.zeros(len(nodes), dtype=bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    first &= counts > 0
    if seen is not None:
        for i in np.flatnonzero(first):
            n = int(nodes[i])
            first[i] = n not in seen
            seen.add(n)
    return first


def _count_tokens(k: int):
    def run(batches):
        for batch in batches:
            seen: set = set()
            for _, _, tokens, counts in text_sets(batch.column(0), k):
                first = _first_of_each(set_nodes(tokens, counts), counts, seen)
                token, n = np.unique(tokens[np.repeat(first, counts)], return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"]
                )

    return run


def token_classes(texts: DataFrame, k: int = SHINGLE, rows: int = TABLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, classes)`` of the most frequent tokens, sorted by token."""
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(_count_tokens(k), "token long, n long")
    classed = counted.groupBy("token").agg(F.floor(F.log2(F.sum("n").cast("double"))).cast("int").alias("class"))
    path = scratch_dir(spark, "token-classes")
    classed.write.parquet(path)
    table = spark.read.schema("token long, class int").parquet(path)
    sizes = {r["class"]: r["count"] for r in table.groupBy("class").count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= rows:
        least -= 1
        total += sizes.get(least, 0)
    top = table.filter(F.col("class") >= least).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], top.column("class").to_numpy()[order].astype(np.int8)


def _band_parts(n: int, percent: int) -> list[tuple[int, int]]:
    """``(band, parts)`` of the length bands that a partner of a set of ``n``
    tokens can make the longer set fall into; bands grow by a third."""
    step = math.log(4 / 3)
    low, high = (int(math.log(m) / step + 1e-9) for m in (n, n * 100 // percent))
    return [(b, max(1, int(math.exp(b * step)) // PART_TOKENS)) for b in range(low, high + 1)]


def set_signatures(tokens: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(singles, pairs)`` of one set; its tokens in the common order."""
    n = len(tokens)
    need = n - -(-n * percent // 100) + 1
    n_single = int(np.searchsorted(classes, PAIR_CLASS))
    singles = tokens[: min(need, n_single)]
    need -= n_single
    if need <= 0:
        return singles, tokens[:0]
    frequent = textvec.mix64(tokens[n_single:] + np.uint64(1))
    out = []
    for band, parts in _band_parts(n, percent):
        part = (frequent >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        fresh = np.ones(len(part), dtype=bool)
        fresh[order[1:]] = part[order[1:]] != part[order[:-1]]
        upto = np.flatnonzero(np.cumsum(~fresh) >= need)
        if not len(upto):  # only sets of one or two tokens, which link with equal sets alone
            continue
        size = int(upto[0]) + 1
        order = order[order < size]
        t, p = frequent[order], part[order]
        salt = textvec.mix64(np.array([band + 1], dtype=np.uint64))
        for gap in range(1, size):
            same = p[gap:] == p[:-gap]
            if not same.any():
                break
            a, b = t[:-gap][same], t[gap:][same]
            out.append(textvec.mix64(np.minimum(a, b) * np.uint64(3) + textvec.mix64(np.maximum(a, b) + salt)))
    return singles, np.concatenate(out) if out else tokens[:0]


def bitmap(tokens: np.ndarray) -> bytes:
    """The hash buckets of a set's tokens; their number is a power of two, so
    that a larger bitmap folds to a smaller one."""
    buckets = 1 << max(6, (BUCKETS * len(tokens) - 1).bit_length())
    filled = np.zeros(buckets, dtype=bool)
    filled[((tokens >> np.uint64(16)) & np.uint64(buckets - 1)).astype(np.int64)] = True
    return np.packbits(filled, bitorder="little").tobytes()


def least_differences(x: bytes, y: bytes) -> tuple[int, int]:
    """How many tokens of each of two sets are not in the other, at least."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())


def _bounds(batches):
    """Rows (a, b, n_a, n_b, bits_a, bits_b): the least difference of the two
    sets, and the most that they can share."""
    for batch in batches:
        less = [least_differences(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        sizes = np.array(less, dtype=np.int64).reshape(-1, 2)
        n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        most = np.minimum(n_a - sizes[:, 0], n_b - sizes[:, 1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(sizes.sum(axis=1)), pa.array(most)], ["a", "b", "n_a", "n_b", "d", "most"]
        )


def _signatures(k: int, percent: int, table: Broadcast):
    def run(batches):
        token, token_class = table.value
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[(token & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            seen: set = set()
            for lo, hi, tokens, counts in text_sets(batch.column(2), k):
                classes = np.zeros(len(tokens), dtype=np.int8)
                if len(token):
                    some = np.flatnonzero(maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(token, tokens[some]), len(token) - 1)
                    same = token[at] == tokens[some]
                    classes[some[same]] = token_class[at[same]]
                nodes = set_nodes(tokens, counts)
                first = _first_of_each(nodes, counts, seen) & (counts > 2)
                rare = textvec.segment_sum((classes == 0).astype(np.int64), counts)
                plain = textvec.segment_sum((classes > 0).astype(np.int64), counts) == 0
                upto = np.concatenate(([0], np.cumsum(counts)))
                singles, pairs, n_singles, n_pairs = [], [], np.zeros(hi - lo, int), np.zeros(hi - lo, int)
                bits: list[bytes | None] = [None] * (hi - lo)
                for i in np.flatnonzero(first):
                    t = tokens[upto[i] : upto[i + 1]]
                    if plain[i]:
                        s, p = t[: len(t) - -(-len(t) * percent // 100) + 1], t[:0]
                    else:
                        c = classes[upto[i] : upto[i + 1]]
                        order = np.argsort(c, kind="stable")
                        s, p = set_signatures(t[order], c[order], percent)
                    singles.append(s)
                    pairs.append(p)
                    n_singles[i], n_pairs[i] = len(s), len(p)
                    bits[i] = bitmap(t)
                lists = []
                for found, each in ((singles, n_singles), (pairs, n_pairs)):
                    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                    at = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(counts, pa.int64()),
                        pa.array(nodes),
                        pa.array((np.minimum(rare, RARE_MOST) << (SIZE_BITS + PLACE_BITS)) | (counts << PLACE_BITS)),
                        *lists,
                        pa.array(bits, pa.binary()),
                    ],
                    ["doc_id", "text_key", "n", "node", "rank", "singles", "pairs", "bits"],
                )

    return run


def _pair_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two sets of every row (texts in columns 2 and 3)."""
    sides = []
    for column in (batch.column(2), batch.column(3)):
        sets: list[np.ndarray] = []
        for _, _, tokens, counts in text_sets(column, k):
            sets += np.split(tokens, np.cumsum(counts)[:-1])
        sides.append(sets)
    return zip(*sides, strict=True)


def _is_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y (both sorted, without repeats)."""
    if not len(y):
        return np.zeros(len(x), dtype=bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _verify(k: int, percent: int):
    def run(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(_pair_sets(batch, k)):
                shared = int(_is_in(x, y).sum())
                linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            kept = pa.array(linked)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"]
            )

    return run


def difference_prefix(n_hub: int, n: int, d: int, linked: bool, percent: int) -> int:
    """How many tokens of the difference of a set of ``n`` tokens from its hub
    are looked at: as one side of any pair whose other side is not linked with
    the hub, and if it is not linked itself, also as that other side."""
    low, high = 100 - percent, 100 + percent
    # overlap > (d + c (n_hub - n)) / 2
    prefix = d - (high * d + low * (n_hub - n)) // (2 * high)
    if not linked:
        # overlap >= (d - c (n + n_hub)) / 2
        prefix = max(prefix, d - max(1, -((low * (n + n_hub) - high * d) // (2 * high))) + 1)
    # the other difference is at least d - c (n + m) long, and m <= n / t: so
    # the overlap is at least d - n (1 - t) / t
    return max(0, min(d, prefix, n * low // percent + 1))


def _compare_with_hub(k: int, percent: int):
    """Rows (hub, node, ...): whether they are linked, and the start of the
    node's difference from the hub, added tokens first."""

    def run(batches):
        for batch in batches:
            linked, sizes, differences, starts = [], [], [], []
            for hub, x in _pair_sets(batch, k):
                in_hub = _is_in(x, hub)
                shared = int(in_hub.sum())
                linked.append(100 * shared >= percent * (len(x) + len(hub) - shared))
                d = len(x) + len(hub) - 2 * shared
                sizes.append((len(hub), len(x), d))
                start = np.concatenate((x[~in_hub], hub[~_is_in(hub, x)]))
                size = 0 if d > FAR * len(x) else difference_prefix(len(hub), len(x), d, linked[-1], percent)
                starts.append(start[:size])
            counts = [len(s) for s in starts]
            flat = np.concatenate(starts).view(np.int64) if starts else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            differences = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            columns = np.array(sizes, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(linked, pa.bool_()),
                    *(pa.array(c) for c in columns.T),
                    differences,
                ],
                ["hub", "node", "linked", "n_hub", "n", "d", "start"],
            )

    return run


class JaccardJoin:
    """One run of the join; every step is a written table in shared storage."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT):
        self.spark = docs.sparkSession
        self.k, self.percent = k, percent
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        self.folder = scratch_dir(self.spark, "jaccard-join")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _release(self) -> None:
        """Let Spark's cleaner drop the shuffle files of finished steps: it acts
        when the driver's JVM collects the plans that refer to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """One row per document, written: its set's node, size, bitmap and
        signatures of pairs. Beside it the single signatures, which would take
        more room than all the rest: they are made again as they are read."""
        table = self.spark.sparkContext.broadcast(token_classes(self.docs, self.k))
        doc_id = self.docs.schema["doc_id"].dataType.simpleString()
        found = self.docs.mapInArrow(
            _signatures(self.k, self.percent, table),
            f"doc_id {doc_id}, text_key long, n long, node long, rank long, singles array<long>, pairs array<long>, "
            "bits binary",
        )
        return self._written(found.drop("singles"), "sets"), found.select("node", "rank", "singles")

    def beside(self, pairs: DataFrame, rows_of, columns: list[str], name: str) -> DataFrame:
        """``pairs`` with ``columns`` of both nodes; ``rows_of(nodes)`` has a row
        per node, grouped by it. The rows of ``b`` are joined where that grouping
        left them; those of ``a`` are written first: a hub may have very many
        pairs, and only a join of two shuffles can be split."""
        one = rows_of(pairs.select(F.col("b").alias("node")).distinct())
        other = self._written(rows_of(pairs.select(F.col("a").alias("node")).distinct()), name)
        b, a = (x.select(F.col("node").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in columns]) for x, t in ((one, "b"), (other, "a")))
        return pairs.join(b, "b").join(a, "a").select("a", "b", *[f"{c}_{t}" for c in columns for t in "ab"])

    def bounded(self, sketches: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """``a, b, n_a, n_b, d`` (the least difference), ``most`` (the most that
        is shared) of distinct pairs of nodes."""
        pairs = self._written(pairs.select("a", "b").distinct(), f"{name}-pairs")

        def known(nodes: DataFrame) -> DataFrame:
            rows = sketches.join(nodes, "node", "left_semi").groupBy("node")
            return rows.agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

        both = self.beside(pairs, known, ["n", "bits"], f"{name}-bits")
        found = both.mapInArrow(_bounds, "a long, b long, n_a long, n_b long, d long, most long")
        return self._written(found, f"{name}-bounds")

    def hub_groups(self, sets: DataFrame, singles: DataFrame) -> DataFrame:
        """``group, hub, node, n, left``: the members (but the hub) of the runs
        of every shared signature; ``left`` is what is left of a member's
        tokens from the signature's place on (all, for pairs of tokens). Runs
        of equal members are one group."""
        member = F.struct("rank", "node")
        most = (1 << PLACE_BITS) - 1
        single = singles.select(F.posexplode("singles").alias("place", "sig"), "node", "rank").select(
            "sig", "node", F.col("rank").bitwiseOR(F.least("place", F.lit(most)).cast("long")).alias("rank")
        )
        n = F.shiftright("rank", PLACE_BITS).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
        # a signature's sets in the order of their sizes: similar ones lie in
        # one run without a gap wider than the threshold; lone sets go
        by_size, run = Window.partitionBy("sig").orderBy("n"), Window.partitionBy("sig", "run")
        gap = lambda small, large: small.isNull() | large.isNull() | (small * 100 < large * self.percent)
        single = (
            single.withColumn("n", n)
            .withColumn("starts", gap(F.lag("n").over(by_size), F.col("n")))
            .withColumn("ends", gap(F.col("n"), F.lead("n").over(by_size)))
            .filter("not (starts and ends)")
            .withColumn("run", F.sum(F.col("starts").cast("int")).over(by_size))
        )
        # at their first shared signature, what is left of two similar sets
        # from its place on is at least the overlap they need: room(x) =
        # (100 + p) left(x) - p n(x) must reach p n(y), for one y of the run
        left = F.col("n") - F.col("rank").bitwiseAND(F.lit(most))
        room = left * (100 + self.percent) - F.col("n") * self.percent
        single = (
            single.withColumn("room", room)
            .withColumn("most_room", F.max("room").over(run))
            .withColumn("least_n", F.min("n").over(run))
            .filter((F.col("most_room") >= F.col("n") * self.percent) & (F.col("room") >= F.col("least_n") * self.percent))
            .withColumn("hub", F.min(member).over(run)["node"])
            .withColumn("alike", F.bit_xor(F.xxhash64("node")).over(run))
            .filter("node != hub")
            .select(F.xxhash64("alike", "hub").alias("group"), "hub", "node", "n", left.alias("left"))
        )
        # pairs of frequent tokens may belong to very many sets: summed up
        # before the shuffle, then joined, where a hot signature can be split
        pair = self._written(
            sets.filter(F.size("pairs") > 0).select(F.explode("pairs").alias("sig"), "node", "rank"), "pairs"
        )
        hubs = self._written(
            pair.groupBy("sig")
            .agg(F.min(member)["node"].alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi"))
            .filter("lo < hi")
            .select("sig", "hub"),
            "pair-hubs",
        )
        pair = pair.join(hubs, "sig").filter("node != hub").withColumn("n", n)
        pair = pair.select(F.xxhash64("sig", F.lit(-1)).alias("group"), "hub", "node", "n", F.col("n").alias("left"))
        # runs of the same members (of the signatures of one passage) are one
        # group; their first signature in the common order leaves the most
        return single.unionByName(pair).groupBy("group", "hub", "node", "n").agg(F.max("left").alias("left"))

    def with_texts(self, sets: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
        """``a, b, text_a, text_b`` of distinct pairs of nodes."""
        candidates = self._written(candidates.distinct(), f"{name}-candidates")
        self._release()
        nodes = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
        keys = self._written(
            sets.select("node", "text_key").join(nodes, "node").groupBy("node").agg(F.min("text_key").alias("text_key")),
            f"{name}-nodes",
        )
        # few enough nodes are broadcast, so that not all texts are shuffled
        small = keys.count() <= BROADCAST_ROWS

        def texts(nodes: DataFrame) -> DataFrame:
            some = keys.join(nodes, "node", "left_semi")
            rows = self.docs.select("text_key", "text").join(F.broadcast(some) if small else some, "text_key")
            return rows.groupBy("node").agg(F.first("text").alias("text"))

        return self.beside(candidates, texts, ["text"], f"{name}-texts")

    def far_pairs(self, groups: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
        """``a, b``: members of one signature's run, at least one far from its
        hub, whose sizes and places allow the overlap they need."""
        far = members.join(parts, "node", "left").select(
            "hub", "node", (F.col("d") > F.col("n") * FAR).alias("far"), F.coalesce("component", "node").alias("component")
        )
        rows = groups.join(far, ["hub", "node"])
        # only runs that hold a far member
        some = rows.groupBy("group").agg(F.bool_or("far").alias("some"), F.count("node").alias("rows"))
        rows = self._written(rows.join(some.filter("some and rows > 1").select("group"), "group"), "far-runs")
        x, y = rows.filter("far").alias("x"), rows.alias("y")
        needed = (F.col("x.n") + F.col("y.n")) * self.percent
        enough = F.least(F.col("x.left"), F.col("y.left")) * (100 + self.percent) >= needed
        sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * self.percent
        once = ~F.col("y.far") | (F.col("x.node") < F.col("y.node"))
        other = (F.col("x.component") != F.col("y.component")) & (F.col("x.node") != F.col("y.node"))
        pairs = x.join(y, (F.col("x.group") == F.col("y.group")) & enough & sizes & once & other)
        return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def near_differences(self, members: DataFrame, parts: DataFrame) -> DataFrame:
        """``a, b``: members of one hub's group, at least one not linked with
        the hub, whose differences from it may overlap enough."""
        placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = self._written(placed, "placed")
        # groups with one member, or in one component, have nothing to find
        mixed = placed.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        placed = placed.join(mixed.filter("lo < hi").select("hub"), "hub")
        token = placed.select(
            "hub", "node", "linked", "n", "d", "component", F.posexplode("start").alias("place", "token")
        ).select(
            F.xxhash64("hub", "token").alias("key"),
            "node",
            "component",
            F.shiftleft("n", 32).bitwiseOR(F.col("d")).alias("sizes"),
            F.shiftleft(F.col("place").cast("long"), 1).bitwiseOR(F.col("linked").cast("long")).alias("at"),
        )
        x, y = token.filter("at % 2 = 0").alias("x"), token.alias("y")
        n = {t: F.shiftright(f"{t}.sizes", 32) for t in "xy"}
        d = {t: F.col(f"{t}.sizes").bitwiseAND(F.lit((1 << 32) - 1)) for t in "xy"}
        place = {t: F.shiftright(f"{t}.at", 1) for t in "xy"}
        low, high = 100 - self.percent, 100 + self.percent
        # the overlap that the pair needs
        overlap = F.ceil(((d["x"] + d["y"]) * high - (n["x"] + n["y"]) * low) / F.lit(2 * high))
        inside = (place["x"] <= d["x"] - overlap) & (place["y"] <= d["y"] - overlap)
        sizes = F.least(n["x"], n["y"]) * 100 >= F.greatest(n["x"], n["y"]) * self.percent
        once = (F.col("y.at") % 2 == 1) | (F.col("x.node") < F.col("y.node"))
        other = F.col("x.component") != F.col("y.component")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & inside & sizes & once & other)
        return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def run(self) -> DataFrame:
        """``doc_id, n_shingles, node, text_key, component_id`` of every document."""
        signed, singles = self.sets()
        groups = self._written(self.hub_groups(signed, singles), "groups")
        self._release()  # the signatures' shuffle, the largest of all, goes before these are copied
        sets = self._written(signed.select("doc_id", "text_key", "n", "node"), "nodes")
        sketches = self._written(signed.filter("bits is not null").select("node", "n", "bits"), "sketches")
        for name in ("sets", "pairs"):  # read for the last time
            delete_path(self.spark, f"{self.folder}/{name}")
        self._release()
        bounds = self.bounded(sketches, groups.select(F.col("hub").alias("a"), F.col("node").alias("b")), "hub")
        is_far = F.col("d") > F.col("n_b") * FAR  # such a member cannot be linked with the hub
        kind = "hub long, node long, linked boolean, n_hub long, n long, d long, start array<long>"
        compared = self.with_texts(sets, bounds.filter(~is_far).select("a", "b"), "hub").mapInArrow(
            _compare_with_hub(self.k, self.percent), kind
        )
        far = bounds.filter(is_far).select(
            F.col("a").alias("hub"),
            F.col("b").alias("node"),
            F.lit(False).alias("linked"),
            F.col("n_a").alias("n_hub"),
            F.col("n_b").alias("n"),
            "d",
            F.array().cast("array<long>").alias("start"),
        )
        members = self._written(compared.unionByName(far), "members")
        self._release()
        links = members.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        parts = self._written(connected_components(links), "hub-components")
        pairs = self.near_differences(members, parts).unionByName(self.far_pairs(groups, members, parts))
        bounds = self.bounded(sketches, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "rest")
        open_ = bounds.filter(F.col("most") * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent)
        rest = self.with_texts(sets, open_.select("a", "b"), "rest")
        more = self._written(rest.mapInArrow(_verify(self.k, self.percent), "a long, b long"), "rest-links")
        if more.first() is not None:
            parts = self._written(connected_components(links.union(more)), "components")
        return self._labelled(sets, parts)

    def _labelled(self, sets: DataFrame, parts: DataFrame) -> DataFrame:
        ids = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
        joined = ids.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labels = self._written(joined, "labels")
        least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
        named = labels.join(least, "component").select("node", "component_id")
        return (
            sets.select("doc_id", "n", "node", "text_key")
            .join(named, "node", "left")
            .select(
                "doc_id",
                F.col("n").alias("n_shingles"),
                "node",
                "text_key",
                F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            )
        )


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, node, text_key, component_id`` of every document."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    return JaccardJoin(docs, k, percent).run()
