"""Personal data by rules and a skip-chain conditional random field.

Rules find the base spans: e-mail addresses, IP addresses, card numbers and
phone numbers (``base_spans`` gives the exact forms). A conditional random
field then labels the tokens that may belong to such an entity: those that
hold a digit or an at sign. Neighbouring tokens share chain potentials, and
tokens of a document that are equal, or similar (equal digits, or equal text
up to case and punctuation), share skip potentials: each group is tied to one
hidden label, a star instead of all pairs. Loopy message passing gives every
token's label distribution, so a number that a document names in full once is
also found where it stands alone. Runs of tokens of one label that no base
span touches are added; base spans always stay.

The field is trained here by pseudo-likelihood, on tokens labelled by the
rules, in a bounded sample: the ``TRAIN_DOCS`` documents with candidates that
are first in the order of a hash, ``TRAIN_TOKENS`` tokens at most. All
documents are scanned in whole.

Edge cases: a null or empty text has no spans; without training tokens only
base spans are found; a token group's size is not limited.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.llm.tasks import share

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is "no entity", label i + 1 is kind i.
LABELS = len(KINDS) + 1
TRAIN_DOCS = 4000
TRAIN_TOKENS = 40000
FEATURES = 1 << 12
ROUNDS = 12
#: Equal or similar tokens of a document agree by this log potential unless
#: the training tokens say otherwise.
SKIP_PRIOR = 4.0
ACCEPT = 0.5

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@]")
_EDGE = " \t\n.,;:!?\"'()[]{}<>"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``(start, kind, end)`` of the rules' matches, leftmost and without
    overlap per kind; matches that fail a kind's test are dropped."""
    found: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for cluster in _DOTTED.finditer(text):
        if cluster[0].count(".") >= 3:
            for m in _IP.finditer(text, cluster.start(), cluster.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _shape(token: str) -> str:
    """Runs of letters as a, digits as their number, other signs as they are."""
    out: list[str] = []
    for run in re.finditer(r"[0-9]+|[^\W\d_]+|.", token, re.S):
        s = run[0]
        out.append(str(min(len(s), 20)) if s[0].isdigit() else "a" if s[0].isalpha() else s)
    return "".join(out)


@dataclass
class Tokens:
    """Candidate tokens of one text, in order: spans of their cores, features,
    whether each follows the one before directly, and its skip key."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    follows: list[bool]
    keys: list[str]


def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def candidate_tokens(text: str) -> Tokens:
    out = Tokens([], [], [], [])
    words = [(m.start(), m[0]) for m in _TOKEN.finditer(text)] if _CANDIDATE.search(text) else []
    previous = -2
    for i, (start, word) in enumerate(words):
        if not _CANDIDATE.search(word):
            continue
        shape = _shape(word.strip(_EDGE.replace("(", "").replace(")", "")))
        digits = "".join(c for c in word if "0" <= c <= "9")
        near = [_shape(words[j][1]) if 0 <= j < len(words) else "" for j in (i - 2, i - 1, i + 1, i + 2)]
        near = [s if re.search(r"[0-9@]", s) else "w" if s else "-" for s in near]
        names = [
            "bias",
            f"shape {shape}",
            f"digits {len(digits)}",
            f"at {word.count('@')} dots {word.count('.')}",
            f"luhn {14 <= len(digits) <= 19 and luhn(digits)} {len(digits) == len(word.strip(_EDGE))}",
            f"plus {word[0] == '+'}",
            *(f"near{j} {s}" for j, s in enumerate(near)),
            f"two {near[1]} {shape}",
            f"three {near[0]} {near[1]} {shape}",
        ]
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        out.spans.append((start + left, start + left + len(core)))
        out.features.append([_feature(n) for n in names])
        out.follows.append(previous == i - 1)
        # similar tokens: the same digits, or the same letters and digits
        plain = "".join(c for c in word.lower() if c.isalnum() or c == "@")
        out.keys.append(plain if any(c.isalpha() for c in plain) else digits)
        previous = i
    return out


def token_labels(tokens: Tokens, spans: list[Span]) -> list[int]:
    """The kind of the base span that each token lies in (0: none)."""
    labels = []
    for start, end in tokens.spans:
        kinds = [kind for s, kind, e in spans if s < end and start < e]
        labels.append(kinds[0] + 1 if kinds else 0)
    return labels


@dataclass
class SkipChainField:
    """Unary weights by feature, and the chain and skip potentials (logs)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @staticmethod
    def edges(follows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Chain edges between tokens, and skip edges from tokens to the hidden
        label of their group (groups of one have none)."""
        n = len(follows)
        chain = np.flatnonzero(follows)
        ids, inverse, size = np.unique(groups, return_inverse=True, return_counts=True)
        member = np.flatnonzero(size[inverse] > 1)
        pairs = np.concatenate(
            (np.stack([chain - 1, chain], axis=1), np.stack([member, n + inverse[member]], axis=1))
        ).astype(np.int64)
        kind = np.concatenate((np.zeros(len(chain), np.int64), np.ones(len(member), np.int64)))
        return pairs, kind, n + len(ids)

    def marginals(self, features: np.ndarray, follows: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Label distributions of tokens (of one or many documents) after
        ``ROUNDS`` rounds of message passing with damping."""
        n = len(features)
        pairs, kind, nodes = self.edges(follows, groups)
        unary = np.zeros((nodes, LABELS))
        unary[:n] = self.unary[features].sum(axis=1)
        m = len(pairs)
        source = np.concatenate((pairs[:, 0], pairs[:, 1]))
        target = np.concatenate((pairs[:, 1], pairs[:, 0]))
        both = np.stack([self.chain, self.skip])[kind]
        potential = np.concatenate((both, both.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
        message = np.zeros((2 * m, LABELS))
        belief = unary
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            if not m:
                break
            inner = (belief[source] - message[back])[:, :, None] + potential
            top = inner.max(axis=1)
            new = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        p = np.exp(belief[:n] - belief[:n].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, features: np.ndarray, follows: np.ndarray, groups: np.ndarray, labels: np.ndarray, steps: int = 300):
        """Maximum pseudo-likelihood: each token's label given its features,
        the labels of its chain neighbours and the mean label of its group."""
        n = len(labels)
        gold = np.eye(LABELS)[labels]
        before, after = np.zeros((n, LABELS)), np.zeros((n, LABELS))
        at = np.flatnonzero(follows)
        before[at] = gold[at - 1]
        after[at - 1] = gold[at]
        ids, inverse = np.unique(groups, return_inverse=True)
        total, size = np.zeros((len(ids), LABELS)), np.bincount(inverse, minlength=len(ids))
        np.add.at(total, inverse, gold)
        others = (total[inverse] - gold) / np.maximum(size[inverse] - 1, 1)[:, None]
        w = np.zeros((FEATURES, LABELS))
        prior = SKIP_PRIOR * np.eye(LABELS)
        chain, skip = np.zeros((LABELS, LABELS)), prior.copy()
        squares = [np.full_like(x, 1e-8) for x in (w, chain, skip)]
        for _ in range(steps):
            z = w[features].sum(axis=1) + before @ chain + after @ chain.T + others @ skip
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            error = (p - gold) / n
            gw = 1e-5 * w
            np.add.at(gw, features.ravel(), np.repeat(error, features.shape[1], axis=0))
            gc = 1e-4 * chain + before.T @ error + (after.T @ error).T
            gs = 1e-4 * (skip - prior) + others.T @ error
            for x, g, s in zip((w, chain, skip), (gw, gc, (gs + gs.T) / 2), squares, strict=True):
                s += g * g
                x -= 0.3 * g / np.sqrt(s)
        return cls(w, chain, skip)


def _group_codes(keys: list[str], owners: list[int]) -> np.ndarray:
    """A number for each (document, key); tokens without a key stand alone."""
    code: dict[tuple, int] = {}
    return np.array([code.setdefault((o, k) if len(k) > 3 else (o, i, ""), len(code)) for i, (o, k) in enumerate(zip(owners, keys, strict=True))], dtype=np.int64)


def _gather(texts: list[str]) -> tuple[list[list[Span]], list[Tokens], np.ndarray, np.ndarray, np.ndarray]:
    bases = [base_spans(t) for t in texts]
    tokens = [candidate_tokens(t) for t in texts]
    features = np.array([f for t in tokens for f in t.features], dtype=np.int64)
    follows = np.array([f for t in tokens for f in t.follows], dtype=bool)
    owners = [i for i, t in enumerate(tokens) for _ in t.keys]
    return bases, tokens, features, follows, _group_codes([k for t in tokens for k in t.keys], owners)


def added_spans(tokens: Tokens, base: list[Span], p: np.ndarray) -> list[Span]:
    """Runs of tokens of one accepted label that touch no base span."""
    out: list[Span] = []
    for i, (start, end) in enumerate(tokens.spans):
        label = int(p[i].argmax())
        if not label or p[i, label] < ACCEPT or start >= end or any(s < end and start < e for s, _, e in base):
            continue
        if out and tokens.follows[i] and out[-1][1] == label - 1 and out[-1][2] == tokens.spans[i - 1][1]:
            out[-1] = (out[-1][0], label - 1, end)
        else:
            out.append((start, label - 1, end))
    return out


def find_spans(texts: list[str], field: SkipChainField | None) -> list[tuple[list[Span], list[Span]]]:
    """``(base, added)`` spans of each text."""
    bases, tokens, features, follows, groups = _gather(texts)
    p = field.marginals(features, follows, groups) if field is not None and len(features) else None
    out, at = [], 0
    for base, t in zip(bases, tokens, strict=True):
        n = len(t.spans)
        out.append((base, added_spans(t, base, p[at : at + n]) if p is not None else []))
        at += n
    return out


def _training_rows(batches):
    for batch in batches:
        kept = [t for t in batch.column(1).to_pylist() if t and _CANDIDATE.search(t)]
        keys = [k for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and _CANDIDATE.search(t)]
        rows = []
        for key, text in zip(keys, kept, strict=True):
            tokens = candidate_tokens(text)
            labels = token_labels(tokens, base_spans(text))
            for i in range(len(labels)):
                rows.append((key, i, tokens.features[i], tokens.follows[i], tokens.keys[i], labels[i]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                pa.array([r[3] for r in rows], pa.bool_()),
                pa.array([r[4] for r in rows], pa.string()),
                pa.array([r[5] for r in rows], pa.int32()),
            ],
            ["doc", "place", "features", "follows", "key", "label"],
        )


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_tokens: int = TRAIN_TOKENS) -> SkipChainField | None:
    """A field fitted on a bounded sample of the documents with candidates."""
    known = docs.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("doc"), "text")
    # the bound of the sample: the hash at its last place
    hashes = known.select("doc").distinct().orderBy("doc").limit(most_docs)
    last = hashes.agg(F.max("doc")).first()[0]
    if last is None:
        return None
    rows = known.filter(F.col("doc") <= last).mapInArrow(
        _training_rows, "doc long, place int, features array<int>, follows boolean, key string, label int"
    )
    found = rows.distinct().orderBy("doc", "place").limit(most_tokens).toArrow()
    if not found.num_rows:
        return None
    features = np.array(found["features"].to_pylist(), dtype=np.int64)
    follows = found["follows"].to_numpy(zero_copy_only=False).astype(bool)
    follows[0] = False
    groups = _group_codes(found["key"].to_pylist(), found["doc"].to_pylist())
    return SkipChainField.fit(features, follows, groups, found["label"].to_numpy().astype(np.int64))


FOUND = [
    *(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
]


def scan(docs: DataFrame, field: SkipChainField | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with the counts and the digest of its
    base spans, all spans, and the number of those that the field added."""
    shared = share(docs.sparkSession, field)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        field = shared()
        for batch in batches:
            texts = batch.column(len(keep))
            some = np.flatnonzero(np.array(pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False), dtype=bool))
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), dtype=np.int64)
            digest, spans, more = [none] * n, [""] * n, np.zeros(n, dtype=np.int64)
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                for i, (base, added) in zip(part, find_spans(texts.take(pa.array(part)).to_pylist(), field), strict=True):
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                    digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i] = joined(base + added)
                    more[i] = len(added)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    *(pa.array(c) for c in counts),
                    pa.array(digest, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(more),
                ],
                [*keep, *(f.name for f in FOUND)],
            )

    schema = T.StructType([*[docs.schema[c] for c in keep], *FOUND])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
