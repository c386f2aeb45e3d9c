"""WARC archives, the conversation trie and lexical search against brute-force
versions, with nulls, ties, copies, long inputs, empty tables and columns of
clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kpimart.llm import lexical_search, prefix_trie, queries, warc
from kpimart.session import scratch_dir
from kpimart.sources.tables import table

CLASH = "size bytes digest kept file split start item term block score rank place h1 d1 depth conv turn_ value header".split()


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# ------------------------------------------------------------------------ WARC


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected_index(rows, least=0):
    payload = [(r[0], (r[2] or "").encode()) for r in rows]
    kept = {}
    for i, p in payload:
        kept[p] = max((x for x in (kept.get(p), i) if x is not None), default=None)
    out = []
    for i, p in payload:
        again = len(p) >= least and kept[p] is not None and i != kept[p]
        out.append((i, len(p), digest(p), "revisit" if again else "response", kept[p] if again else None))
    return sorted(map(str, out))


def got_index(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def fake_record(rng, length=None):
    body = "".join(rng.choice("ab \r\n") for _ in range(rng.randrange(40)))
    return f"WARC/1.{rng.randrange(3)}\r\nWARC-Type: response\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n"


def tricky_pages(n, seed):
    """Payloads that hold magic, whole records, torn headers and long runs of these."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice((0, 1, 2, 30))):
            parts.append(
                rng.choice(
                    [
                        "\r\nWARC/1.",
                        "WARC/1.1\r\n",
                        "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n",
                        "\r\n" + fake_record(rng),
                        fake_record(rng, rng.randrange(5000)),
                        "\r\nWARC/1.1\r\ncontent-length: 99999999999999999999\r\n\r\n",
                        "é\U0001f600 text " * rng.randrange(30),
                        "\n\r\n",
                    ]
                )
            )
        rows.append((i, rng.choice((None, f"http://h/{i}?q=a b\r\nWARC/1.1\r\n", f"u{i}")), "".join(parts)))
    return rows


PAGES = "page_id long, url string, html string"


def test_archive_of_edge_rows(spark):
    same = "<p>copied</p>"
    rows = [(1, "u", same), (9, "v", same), (4, None, same), (None, "w", same), (2, "u", ""), (3, "u", None)]
    rows += [(None, "x", "only null ids"), (None, "y", "only null ids"), (7, "z", "twice"), (7, "z", "twice")]
    rows += [(20 + i, "u", f"number {i}") for i in range(5)] + [(40, "u", "x" * 300_000)]
    pages = clash(spark.createDataFrame(rows, PAGES).repartition(3))
    for least in (0, 10, 10**6):
        found = warc.archive_index(pages, scratch_dir(spark, "t"), least)
        assert got_index(found) == expected_index(rows, least)
        assert {r.verified for r in found.collect()} == {True}
    assert warc.archive_index(pages.limit(0), scratch_dir(spark, "t")).count() == 0


@pytest.mark.parametrize("split_bytes", [700, 50_000])
def test_magic_inside_payloads(spark, split_bytes):
    rows = tricky_pages(120, split_bytes)
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    path = scratch_dir(spark, "t")
    warc.write_archive(pages, path)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = warc.read_records(spark, path)
        found = warc.page_index(records)
        assert got_index(found) == expected_index(rows)
        assert found.filter("not verified").count() == 0
        html = {i: h for i, _, h in rows}
        blocks = {r.page: bytes(r.block) for r in records.select(warc.field(F.col("header"), "WARC-Record-ID").alias("page"), "block").collect()}
        for i, _, digest_, kind, refers in map(eval, expected_index(rows)):
            body = blocks[f"<urn:x-page:{i}>"].partition(b"\r\n\r\n")[2]
            assert body == (html[i].encode() if kind == "response" else b"")
        starts = warc.Chains(spark, path)
        assert starts.starts.count() > len(rows)  # the payloads' own magic was among the candidates
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_archives_of_others(spark, tmp_path):
    """Another version, order and case of headers, other types, any bytes."""

    def record(version, headers, body):
        return f"WARC/{version}\r\n{headers}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    good = record("1.0", "warc-type: warcinfo\r\n", b"software: none\r\n")
    good += record("1.0", "WARC-Type: resource\r\nX: WARC/1.0 in a line\r\n", bytes(range(256)) * 3 + b"\r\nWARC/1.0\r\n")
    good += record("1.1", "WARC-Type: metadata\r\n", b"")
    (tmp_path / "a.warc").write_bytes(good)
    found = sorted(warc.read_records(spark, str(tmp_path)).collect(), key=lambda r: r.offset)
    assert [bytes(r.block) for r in found] == [b"software: none\r\n", bytes(range(256)) * 3 + b"\r\nWARC/1.0\r\n", b""]
    assert found[0].header.startswith("warc-type: warcinfo")
    (tmp_path / "b.warc").write_bytes(good[:-30])
    with pytest.raises(ValueError, match="b.warc"):
        warc.read_records(spark, str(tmp_path))
    ends = {r.file.rpartition("/")[2]: (r.bytes, r.chain_end) for r in warc.chain_ends(spark, str(tmp_path)).collect()}
    assert ends["a.warc"] == (len(good), len(good)) and ends["b.warc"][0] != ends["b.warc"][1]


# ------------------------------------------------------------------------ trie


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(ids), len(path), parent, len(ids), len(kids), len(leaves), saved, sha))
    return sorted(out, key=str)


def trie_rows(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block,stretch", [(4, 1024), (3, 1)])
def test_trie_equals_brute_force(spark, block, stretch):
    rng = random.Random(block)
    rows = []
    for c in [*range(0, 30), *range(100, 130), 250, 299, -5, -105, 10**12]:
        n = rng.choice((0, 1, 2, 5, 7, 11))
        for t in range(n):
            said = rng.choice(("yes", "no", "é\U0001f600")) if t > 3 else f"line {t}"
            rows.append((c, t * 2, rng.choice(("user", "user", None)), said))
    rows += [(100, t, "user", f"line {t}") for t in range(1, 60, 2)]
    # ties: null turns, one number for several texts, repeated rows
    rows += [(400, None, "a", "x"), (400, None, None, "y"), (400, 1, "b", "q"), (400, 1, "b", "p"), (400, 1, "a", "z")]
    rows += [(401, 1, "b", "q"), (401, 1, "b", "q"), (401, 1, "b", None), (None, 1, "a", "lost")]
    rng.shuffle(rows)
    df = clash(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    assert trie_rows(prefix_trie.prefix_trie(df, block, stretch)) == brute_trie(rows)


def test_trie_of_copies_and_of_a_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 4000, 10) for t in range(3)]
    rows += [(5, t, "user", f"long {t % 7}") for t in range(300)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    got = trie_rows(prefix_trie.prefix_trie(df, stretch=8))
    assert max(r[1] for r in got) == 299  # three turns of conversation 0, and its own after four
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 401 and root[2] is None
    deepest = max(got, key=lambda r: r[1])
    assert deepest[0] == 5 and deepest[7] == hashlib.sha256(b"5").hexdigest()
    full = max((r for r in got if r[1] == 3), key=lambda r: r[3])
    assert full[3] == 401 and full[7] == hashlib.sha256(",".join(map(str, range(0, 4000, 10))).encode()).hexdigest()


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], CONVERSATIONS)).count() == 0


def test_trie_of_the_table(spark, sf_small):
    rows = [tuple(r) for r in table(spark, sf_small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op12_prefix_trie(spark, sf_small)) == brute_trie(rows)


# ---------------------------------------------------------------------- search


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, size = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, want in wanted.items():
        scores = []
        for doc, bag in bags:
            m = 100 - 90 + 90 * sum(bag.values()) * n // size
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in want if t in bag
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("block_bytes,top", [(1 << 20, 10), (900, 3), (150, 10)])
def test_search_equals_brute_force(spark, block_bytes, top):
    rng = random.Random(top)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "日本語", "A", "a", "ab", "a1"]
    docs = [(i, rng.choice((" ", "--", "\x00", ". ")).join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(150)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (500, None), (501, ""), (502, " .,; "), (7, "w1 w2"), (7, "w1 w2")]
    docs += [(600 + i, "tie breaker w39") for i in range(20)] + [(503, "w3 " * 90_000 + "x" * 200_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(25)]
    items += [(30, None), (31, "?!"), (32, "tie"), (32, "breaker W5"), (None, "w7 w8"), (33, "nowhere"), (34, "x" * 200_000), (35, "X")]
    a = clash(spark.createDataFrame(docs, DOCS).repartition(4))
    b = clash(spark.createDataFrame(items, ITEMS).repartition(2))
    assert found(lexical_search.search(a, b, top, block_bytes)) == brute_search(docs, items, top)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_matcher_cuts_texts_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search.textvec, "BLOCK", 8)
    matcher = lexical_search.Matcher([("i", t, True) for t in ("a", "bb", "longerthanthat")])
    texts = ["a bb a", "", "longerthanthat a", "xa bba bb", "a" * 30]
    data = np_bytes("".join(texts))
    offsets = __import__("numpy").cumsum([0, *map(len, texts)])
    code, tf, n = matcher.count(data, offsets)
    got = {(int(c) // 3, matcher.terms[int(c) % 3]): int(k) for c, k in zip(code, tf, strict=True)}
    assert got == {(0, "a"): 2, (0, "bb"): 1, (2, "longerthanthat"): 1, (2, "a"): 1, (3, "bb"): 1}
    assert n.tolist() == [3, 0, 2, 3, 1]


def np_bytes(text):
    import numpy as np

    return np.frombuffer(text.encode(), dtype=np.uint8)
