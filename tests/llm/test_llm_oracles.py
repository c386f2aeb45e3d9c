"""The operators against brute-force versions, or held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kpimart.llm import decontaminate, html_extract, jaccard_join, language_id, mixing, pii, queries, quality, secret_scan, sharding, spotsigs
from kpimart.llm.components import connected_components
from kpimart.session import scratch_dir
from kpimart.sources.tables import table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs_of(spark, d):
    return {r.doc_id: r.text for r in table(spark, d, "documents").select("doc_id", "text").collect()}


# ------------------------------------------------------------- near copies


def brute_components(texts, k=5, percent=75):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(w if r < 1 - rate else f"new{rng.randrange(10**6)}")
        if r < rate / 2:
            out.append(f"more{rng.randrange(10**6)}")
    return out


def near_copies(seed, groups, versions):
    """Groups of versions at all distances, chains of copies of copies, and
    short texts around a common passage."""
    rng = random.Random(seed)
    texts, passage = {}, [f"common{i}" for i in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice((6, 9, 40, 160)))]
        chain = base
        for _ in range(versions):
            texts[len(texts)] = " ".join(edited(rng, base, rng.choice((0, 0.005, 0.01, 0.02, 0.04, 0.06))))
            chain = edited(rng, chain, 0.01)
            texts[len(texts)] = " ".join(chain)
    for i in range(versions):
        texts[len(texts)] = " ".join(passage + [f"tail{rng.randrange(50)}" for _ in range(rng.randrange(12))])
    ids = list(texts)
    rng.shuffle(ids)
    return dict(zip(ids, texts.values(), strict=True))


@pytest.mark.parametrize("seed,pair_class", [(1, 6), (2, 2), (3, 3)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, pair_class):
    monkeypatch.setattr(jaccard_join, "PAIR_CLASS", pair_class)
    texts = near_copies(seed, 5, 16)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_single_signatures_are_not_stored(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:79], "other"])), (3, "one two three four five six seven")]
    join = jaccard_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    written, singles = join.sets()
    assert "singles" not in written.columns and written.count() == 3
    by_node = {r.node: set(r.singles) for r in singles.collect()}
    node = {r.doc_id: r.node for r in written.collect()}
    assert by_node[node[1]] & by_node[node[2]] and not by_node[node[1]] & by_node[node[3]]
    pairs = spark.createDataFrame([(node[1], node[2]), (node[1], node[3])], "a long, b long")
    got = {(r.a, r.b, r.text_a, r.text_b) for r in join.with_texts(written, pairs, "test").collect()}
    assert got == {(node[1], node[i], rows[0][1], rows[i - 1][1]) for i in (2, 3)}


def test_jaccard_query_on_the_tables(spark, sf_small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard(spark, sf_small).collect()}
    assert got == brute_components(docs_of(spark, sf_small))


def test_prefixes_of_differences_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(400):
        hub = np.sort(rng.choice(10**6, int(rng.integers(5, 60)), replace=False)).astype(np.uint64)
        sets = []
        for _ in range(2):
            keep = rng.random(len(hub)) > rng.random() * 0.5
            sets.append(np.unique(np.concatenate((hub[keep], rng.choice(30, int(rng.integers(0, 12))).astype(np.uint64)))))
        info = []
        for x in sets:
            inside = np.isin(x, hub)
            shared = int(inside.sum())
            d = len(x) + len(hub) - 2 * shared
            linked = 100 * shared >= 75 * (len(x) + len(hub) - shared)
            start = np.concatenate((x[~inside], hub[~np.isin(hub, x)]))
            info.append((linked, start[: jaccard_join.difference_prefix(len(hub), len(x), d, linked, 75)]))
        shared = len(np.intersect1d(*sets))
        if shared and 100 * shared >= 75 * (len(sets[0]) + len(sets[1]) - shared) and not (info[0][0] and info[1][0]):
            if len(np.union1d(*sets)) != shared:  # equal sets are one node
                assert len(np.intersect1d(info[0][1], info[1][1]))


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# --------------------------------------------------------- decontamination


def brute_spans(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = {}
    for d, text in texts.items():
        w = words(text)
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_decontamination_equals_brute_force(spark, sf_small, block_bytes):
    texts = docs_of(spark, sf_small)
    bench = table(spark, sf_small, "benchmark").unionByName(
        spark.createDataFrame([(9001, "on the of"), (9002, "the"), (9003, "")], "item_id long, text string")
    )
    items = [(r.item_id, r.text) for r in bench.collect()]
    found = decontaminate.find_benchmark_spans(
        table(spark, sf_small, "documents"), bench, block_bytes=block_bytes, shard_symbols=5000
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(found).collect()}
    assert got == brute_spans(texts, items)


def test_fm_index_finds_and_locates():
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = np.append(rng.integers(0, 4, 200), 0).astype(np.int32)
        index = decontaminate.FMIndex(text, sample=5)
        pattern = rng.integers(1, 4, int(rng.integers(1, 5))).astype(np.int32)
        who, low, high = index.search(pattern[None, :], np.array([len(pattern)]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(who) else []
        want = [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
        assert got == want


# ------------------------------------------------------ shards and mixtures


def test_shards_are_near_equal_gapless_and_versioned(spark, sf_mid):
    path = scratch_dir(spark, "test-map")
    docs = table(spark, sf_mid, "documents")
    rows = sharding.shard_by_slots(docs, 24, path).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() <= 1.02 * sizes.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard").place)
    texts = docs_of(spark, sf_mid)
    import zlib

    assert {(r.doc_id, r.size, r.text_crc32) for r in rows.itertuples()} == {
        (d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts.items()
    }
    store = sharding.SlotMap(spark, path)
    before = {r.virtual_slot: r.shard for r in store.read(1).collect()}
    loads = spark.read.parquet(f"{path}/loads")
    grown = store.write(2, sharding.rebalance(store.read(1), loads, 25))
    after = {r.virtual_slot: r.shard for r in grown.collect()}
    moved = [s for s in before if before[s] != after[s]]
    assert set(after) == set(range(sharding.SLOTS)) and 24 in set(after.values())
    weight = {r.virtual_slot: r.slot_bytes for r in loads.collect()}
    total = sum(weight.values())
    assert sum(weight[s] for s in moved) <= 0.12 * total  # an edit, not a new deal


def test_mix_meets_its_targets(spark, sf_mid):
    rows = queries.op8_source_mixing(spark, sf_mid).toPandas()
    source = table(spark, sf_mid, "documents").select("doc_id", "source").toPandas()
    rows = rows.merge(source, on="doc_id")
    assert (rows.taken <= 3 * rows["size"]).all()
    names = sorted(source.source.unique())
    sizes = rows.groupby("source")["size"].sum()
    target, left, open_ = {}, float(sizes.sum()), list(names)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    while open_:  # share out, cap, share out the rest again
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > 3 * sizes[n]]
        if not over:
            target |= {n: left * weight[n] / total for n in open_}
            break
        target |= {n: 3.0 * sizes[n] for n in over}
        left -= sum(3.0 * sizes[n] for n in over)
        open_ = [n for n in open_ if n not in over]
    for n, g in rows.groupby("source"):
        assert abs(g.target.iloc[0] - target[n]) < 1e-6 * target[n] + 1e-6
        assert abs(g.taken.sum() - target[n]) <= 0.01 * target[n] + 10


def test_mix_caps_small_sources_and_reshares(spark):
    rows = [(i, " ".join(["w"] * 50), s) for i, s in enumerate(["a"] * 2 + ["b"] * 40 + [None] * 38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.plan_mix(mixing.size_documents(docs))
    target = {r.source_key: r.target for r in mix.sources.collect()}
    # 4,000 words: a (weight 5) is held at 300, the rest goes 2 : 1
    assert target["0a"] == 300.0 and abs(target["0b"] - 3700 * 2 / 3) < 1e-6 and abs(target["1"] - 3700 / 3) < 1e-6
    again = lambda: sorted(mixing.words_taken(mixing.plan_mix(mixing.size_documents(docs))).collect(), key=str)
    assert again() == again()


def brute_taken(mix):
    """Each source's passes spelt out: the words of its blocks in their order,
    pass after pass, as many as its slots take."""
    slots, docs = mix.schedule.collect(), mix.layout.collect()
    taken = {}
    for b in mix.blocks.collect():
        n, size = b.n_blocks, b.source_size
        order = {}
        for i in range(n):
            stride = 1 if (n - 1) % mixing.STRIDE == 0 else mixing.STRIDE
            order[(i * stride + b["shift"]) % (n - 1) if i < n - 1 else i] = i
        assert sorted(order) == sorted(order.values()) == list(range(n))
        a_pass = [w for k in range(n) for w in range(order[k] * b.block_words, min((order[k] + 1) * b.block_words, size))]
        uses = [0] * size
        for s in slots:
            if s.source_key == b.source_key:
                for y in range(s["first"], s["first"] + s["words"]):
                    uses[a_pass[y % size]] += 1
        for d in docs:
            if d.source_key == b.source_key:
                taken[(d.source_key, d.start, d.doc_id)] = sum(uses[d.start : d.start + d["size"]])
    return sorted((key[0], key[2], n) for key, n in taken.items())


@pytest.mark.parametrize("slots", [40, 500, 1 << 20])
def test_mix_takes_what_its_slots_and_blocks_say(spark, slots):
    rng = random.Random(slots)
    rows = [(i, rng.choice(["0a", "0b", "0c", "1"]) if i % 3 else "0b", rng.randrange(1, 40), i) for i in range(150)]
    rows += [(900, "0c", 7, 900)] * 600 + [(1, "0tiny", 1, 1)]
    sized = spark.createDataFrame(rows, "doc_id long, source_key string, size long, text_key long")
    mix = mixing.plan_mix(sized, slots=slots)
    got = sorted((r.source_key, r.doc_id, r.taken) for r in mixing.words_taken(mix).collect())
    assert len(got) == len(rows) and got == brute_taken(mix)


def test_points_decide_what_the_mix_takes(spark, sf_mid, monkeypatch):
    sized = queries.written(mixing.size_documents(table(spark, sf_mid, "documents")), "test-sizes")

    def mixed():
        return {(r.doc_id, r.text_key): r.taken for r in mixing.words_taken(mixing.plan_mix(sized, slots=1 << 14)).collect()}

    golden = mixed()
    for other in (0.0, 0.5):
        monkeypatch.setattr(mixing, "GOLDEN", other)
        changed = mixed()
        assert sum(changed[k] != golden[k] for k in golden) > len(golden) // 50
        assert sum(changed.values()) == sum(golden.values())


def test_every_stretch_of_the_schedule_has_the_target_mix(spark, sf_mid):
    mix = mixing.plan_mix(mixing.size_documents(table(spark, sf_mid, "documents")), slots=1 << 14)
    slots = mix.schedule.filter(f"slot < {1 << 14}").toPandas()
    sources = mix.sources.toPandas()
    share = dict(zip(sources.source_key, sources.target / sources.target.sum(), strict=True))
    for _, stretch in slots.groupby(slots.slot // 1024):
        words = stretch.groupby("source_key")["words"].sum()
        assert all(abs(words.get(k, 0) / words.sum() - p) < 0.01 for k, p in share.items())


# ------------------------------------------------------------- fingerprints


def brute_signatures(text, chain=2):
    words = [w for w in re.split(spotsigs.GAP, text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [c for c in words[i + 1 :] if c not in anchors][:chain]
            if len(content) == chain:
                out.add((w, *content))
    return out or ({("", " ".join(words))} if words else set())


def test_spotsigs_equal_brute_force(spark, sf_small):
    texts = docs_of(spark, sf_small)
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in queries.op9_spotsigs(spark, sf_small).collect()}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        own = brute_signatures(text)
        assert rows[d].n_chars == len(text) and rows[d].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert rows[d].n_signatures == len(own)
        assert abs(rows[d].near_edited - like(own, brute_signatures(edit))) < 1e-12
        assert abs(rows[d].near_next - like(own, brute_signatures(after))) < 1e-12
    assert len({rows[d].fingerprint for d in rows}) == len({frozenset(brute_signatures(t)) for t in texts.values()})


@pytest.mark.parametrize("fan", [1000, 2, 3])
def test_next_cell_below(spark, fan):
    cells = sorted(random.Random(fan).sample(range(-60, 60), 25)) + [10**9, 10**12]
    frame = spark.createDataFrame([(c,) for c in cells], "cell long")
    got = {r.cell: r.next_cell for r in spotsigs.next_below(frame, fan).collect()}
    assert got == {c: cells[i - 1] for i, c in enumerate(cells)}


def test_next_text_where_one_id_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_PER_CELL", 2)
    monkeypatch.setattr(spotsigs, "CELLS_PER_WINDOW", 4)
    rows = [(7 if i % 3 else i, f"text {i}") for i in range(60)] + [(None, "none a"), (None, "none b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    want = {(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)}
    found = spotsigs.with_next_text(docs)
    assert {(r.doc_id, r.text, r.next_text) for r in found.collect()} == want
    cells = docs.withColumn("tie", F.xxhash64("text")).withColumn("cell", spotsigs.id_cells(docs, 2))
    assert cells.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 16


def test_sample_of_a_language_is_near_its_bound(spark):
    docs = spark.range(20000).selectExpr("id doc_id", "if(id % 5 = 0, 'b', 'a') lang", "concat('word', id % 7, ' other') text")
    for bound in (200, 10**6):
        assert sorted(language_id.train(docs, bound).languages) == ["a", "b"]
    order = docs.select("lang", F.xxhash64("doc_id", "lang", "text").alias("h"))
    cut = order.filter((F.col("lang") == "a") & (F.col("h") < (1 << 64) * 200 // 16000 - (1 << 63))).count()
    assert 120 < cut < 280


def test_pii_shape_tells_the_end_of_a_long_token():
    assert pii._shape("a" + "1x" * 60 + "@b") != pii._shape("a" + "1x" * 60 + "#b")


def test_similar_signature_sets_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.randrange(10**6) for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    sets = {}
    for b in base:
        for _ in range(8):
            keep = [x if rng.random() > rng.choice((0, 0.05, 0.2)) else rng.randrange(10**6) for x in b]
            sets[len(sets)] = sorted(set(keep))
    df = spark.createDataFrame(list(sets.items()), "doc_id long, sigs array<long>")
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(df, "doc_id", "sigs").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.75 * len(set(sets[a]) | set(sets[b]))}
    assert got == want


# --------------------------------------------------- learned from the tables


def test_languages_held_out(spark, sf_mid):
    rows = queries.op3_language_id(spark, sf_mid).toPandas()
    truth = table(spark, sf_mid, "documents").select("doc_id", "lang").toPandas()
    rows = rows.merge(truth, on="doc_id")
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() >= 0.99
    assert rows.score.between(0, 1).all()


def test_bloom_filter_holds_all_and_few_others():
    rng = np.random.default_rng(1)
    grams = {n: rng.choice(1 << 32, 3000, replace=False).astype(np.uint32) for n in ("x", "y", "z")}
    f = language_id.LanguageFilter.build(["x", "y", "z"], grams, bits=16)
    for i, n in enumerate("xyz"):
        assert ((f.containing(grams[n]) >> np.uint64(i)) & np.uint64(1)).all()
    other = f.containing(rng.choice(1 << 32, 20000).astype(np.uint32))
    for i in range(3):
        rate = ((other >> np.uint64(i)) & np.uint64(1)).mean()
        assert abs(rate - f.fill[i] ** language_id.HASHES) < 0.01


def test_more_languages_than_a_mask_has_bits(spark):
    rng = random.Random(8)
    names = [f"l{i:03d}" for i in range(150)]
    words = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for n in names}
    rows = [(n, " ".join(rng.choices(words[n], k=30)), {"m": "x"}) for n in names for _ in range(6)]
    told = spark.createDataFrame([(n, " ".join(words[n])) for n in names], "doc_id string, text string")
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string, extra map<string, string>"))
    assert len(model.languages) == 150 and len(model.masks) == 3 and max(model.fill) <= language_id.MAX_FILL
    assert all(r.lang_pred == r.doc_id for r in language_id.identify(told, model, ["doc_id"]).collect())


def test_quality_held_out(spark, sf_mid):
    rows = queries.op6_quality(spark, sf_mid).toPandas()
    rows = rows.merge(table(spark, sf_mid, "labels").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97


def test_personal_data_equals_the_plain_patterns(spark, sf_mid):
    plain = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    texts = docs_of(spark, sf_mid)
    texts |= {-1: "a@b.c@d.e x.y@z 1.2.3.4.5.6.7.8 999.1.1.1 +1 (2) 3-4.5 678 90 12 4111 1111 1111 1111-2 +12345678901", -2: "9" * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.scan(df, pii.train(df), ["doc_id"]).collect()}
    for d, t in texts.items():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(plain) for m in re.finditer(p, t) if ok(m[0]))
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert rows[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(rows[d].spans.split(","))


def test_skip_edges_carry_a_label_to_a_bare_repeat():
    base = "call +1 (212) 555-01{0:02d} now or write to n{0}@site.org today ref {0}"
    texts = [base.format(i) for i in range(60)]
    bases, tokens, features, follows, groups = pii._gather(texts)
    labels = np.array([x for t, b in zip(tokens, bases) for x in pii.token_labels(t, b)])
    field = pii.SkipChainField.fit(features, follows, groups, labels)
    assert field.skip[4, 4] > field.skip[4, 0]  # a repeat of a phone is a phone
    text = "call +1 (212) 555-0177 now or write. Later on she gave {} to me"
    (_, added), (_, other) = pii.find_spans([text.format("555-0177"), text.format("555-9999")], field)
    start = text.index("{}")
    assert added == [(start, 3, start + 8)]  # the number that the text names in full
    assert other == [] or other == added


def test_secrets_held_out(spark, sf_mid):
    rows = queries.op5_secret_scan(spark, sf_mid).toPandas()
    texts = docs_of(spark, sf_mid)
    values = [texts[r.doc_id][r.start : r.end] for r in rows.itertuples()]
    assert [hashlib.sha256(v.encode()).hexdigest() for v in values] == rows.value_sha256.tolist()
    known = np.array([any(re.search(p, v) for p in secret_scan.KNOWN_FORMATS) for v in values])
    held = rows.held_out.to_numpy()
    assert (rows.secret.to_numpy()[held] == known[held]).mean() >= 0.9


# -------------------------------------------------------------------- pages


def test_articles_of_the_pages(spark, sf_small):
    import html

    rows = {r.page_id: r for r in queries.op4_html_extract(spark, sf_small).collect()}
    for r in table(spark, sf_small, "pages").collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert rows[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_tree_matching_equals_brute_force():
    rng = random.Random(6)

    def tree(depth):
        return [rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)], []]

    def best(a, b):
        if a[0] != b[0]:
            return 0

        def rows(x, y):
            if not x or not y:
                return 0
            return max(rows(x[1:], y), rows(x, y[1:]), best(x[0], y[0]) + rows(x[1:], y[1:]))

        return 1 + rows(a[1], b[1])

    for _ in range(60):
        a, b = tree(3), tree(3)
        size, pairs = html_extract.tree_match(a, b)
        assert size == best(a, b) == len(pairs)


def test_left_out_parts_and_article_parts():
    page = """<body class="with-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
    <div id="content"><main><header><h2>Title &amp; more</h2></header><p>First<br>line <a href="x>y">link</a>.<p>Second &#233;
    <ul><li>one<li>two</ul><form>Search <input></form><div class="comments"><p>Reader says</div><script>if (a<b) {}</script></main>
    </div><aside>Side</aside><footer>Foot</footer>"""
    assert html_extract.extract(page, None) == "Title & more\n\nFirst line link.\n\nSecond é\n\none\n\ntwo"


# ----------------------------------------------------------------- pipeline


def test_pipeline_equals_its_parts_by_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    texts = docs_of(spark, sf_small)
    bench = [(r.item_id, r.text) for r in table(spark, sf_small, "benchmark").collect()]
    frames, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = queries.written(stage(spark, now, sf_small), "test-stage")
        frames[name] = [r.doc_id for r in now.select("doc_id").collect()]
    kept = {d for d in texts if any(c.isalpha() for c in texts[d])}
    assert set(frames["language_id"]) == kept
    groups = brute_components({d: texts[d] for d in kept})
    kept = {d for d in kept if groups[d][1] == d}
    assert sorted(frames["ngram_jaccard"]) == sorted(kept)
    spans = brute_spans({d: texts[d] for d in kept}, bench)
    kept = {d for d in kept if not spans[d][4]}
    assert sorted(frames["decontamination"]) == sorted(kept)
    mixed = frames["source_mixing"]
    assert set(mixed) <= kept and max(mixed.count(d) for d in set(mixed)) <= 3
    assert sorted(frames["slot_sharding"]) == sorted(mixed)
    assert corpus_pipeline.run(spark, sf_small).filter(F.col("shard").between(0, 23)).count() == len(mixed)
