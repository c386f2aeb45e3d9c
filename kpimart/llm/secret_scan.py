"""Secret scanning with a random forest against false positives (native).

Candidates are found by form, wherever they stand in a word (compact JSON,
CSV, urls, options, joined settings): long tokens that mix letters and digits
or are all digits, values assigned to a name, shorter values after a keyword
and a blank, and known formats inside a longer token. A random forest then tells secrets
from look-alikes by the candidate's length, the transitions between its
character classes, how much of it dictionary words cover, the path it was
found under (the document's source) and its neighbouring words. It is trained
from labelled findings (``candidate`` columns with ``label``); for want of
reviewed ones, ``label_by_format`` labels the candidates of known formats.

Only DataFrame functions and Spark's own RandomForestClassifier are used. The
training sample is bounded (``TRAIN_FINDINGS``, first in hash order). The
dictionary holds the ``DICTIONARY_WORDS`` words that the most documents have,
counted over all of them. Every whole text is scanned.

Edge cases: null and empty texts have no candidates; a null source is a path
of its own; with findings of one label only, that label's share is every
candidate's probability; an empty table gives an empty result. Repeated rows
have each candidate once a row.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpimart.session import scratch_dir

TRAIN_FINDINGS = 5000
#: Enough for the common words of a dozen languages and more.
DICTIONARY_WORDS = 1 << 15
PATH_BUCKETS = 8
TREES = 24
DEPTH = 6
ACCEPT = 0.5

# Names that secrets are given, and formats of known secrets.
KEYWORDS = "token password passwd pwd secret key apikey api_key auth bearer credential access private".split()
KNOWN_FORMATS = (
    r"^AKIA[A-Z0-9]{16}$",
    r"^gh[pousr]_[A-Za-z0-9]{36}$",
    r"^sk_(live|test)_[A-Za-z0-9]{24,}$",
    r"^xox[baprs]-[A-Za-z0-9-]{10,}$",
    r"^(?=.*[0-9])(?=.*[a-f])([0-9a-f]{16,20}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
)

#: A token: a value's characters, or a percent escape of a sign, which parts values.
TOKEN = r"%(?:2[0-9A-Fa-f]|3[A-Fa-f]|5[BbDd]|7[BbDd])|[A-Za-z0-9+/_~-]+(?:\.[A-Za-z0-9+/_~-]+)*=*"
#: A value by its own form: 14 or more characters with a digit among letters, digits and a few signs.
LONG_VALUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{14,}"
#: The end of what stands before a value of 8 characters or more that is assigned to a name.
ASSIGNED = r"""[A-Za-z_]{3}\\?["']?[=:]\\?["']?$"""
#: A word with such a value (what comes after the name may be a value's first character, too).
ASSIGNMENT = r"""[A-Za-z_]{3}\\?["']?[=:]\\?["']?[A-Za-z0-9+/_.~-]{8,}"""
#: The end of a word that is a keyword, and one that also assigns.
KEYWORD_END = rf"""(?i)(?<![a-z])(?:{"|".join(KEYWORDS)})["'\])]*(?:=>|:=|[=:])?$"""
KEYWORD_ASSIGNS = r"""(?:=>|:=|[=:])$"""
ASSIGNING = ("=", ":", "=>", ":=")
#: What makes a short value after a bare keyword more than a word of prose: a digit, or capitals inside.
NOT_PROSE = r"[0-9]|[a-z][A-Z]"
SHORT = 8
#: Texts that may hold a candidate.
CANDIDATE = (
    rf"{ASSIGNMENT}|{LONG_VALUE}"
    rf"""|(?i:{"|".join(KEYWORDS)})["'\])]*(?:=>|:=|[=:])?\s+(?:(?:is|=>|:=|=|:)\s+)?[^A-Za-z0-9+/_~\s-]*[A-Za-z0-9+/_~.-]{{8,}}"""
)
#: Known formats within a token, between other signs than letters and digits.
KNOWN_INSIDE = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p[1:-1]})" for p in KNOWN_FORMATS[:-1]) + (
    "|(?=[a-f]*[0-9])(?=[0-9]*[a-f])(?:[0-9a-f]{16,20}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}))(?![A-Za-z0-9])"
)

FEATURES = (
    "length class_changes case_changes vowel_changes distinct_share digit_share upper_share hex_share "
    "word_share assigned quoted after_keyword after_equals before_keyword"
).split() + [f"path_{i}" for i in range(PATH_BUCKETS)]


def _length_before(parts: Column, i: Column) -> Column:
    """The length of the first ``i`` strings of an array."""
    return F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda acc, p: acc + F.length(p))


def find_candidates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, path, start, end, value, word, left1, left2, left3, right1`` for
    every candidate; places are code points, the end is exclusive. ``word`` is
    the value with its name and quotes, the others are the words around."""
    words = F.split("text", r"\s")
    rows = docs.select(F.col(key).alias(key), F.col("source").alias("path"), F.col("text").alias("text"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE)).select(key, "path", words.alias("words"))

    def around(word: Column, i: Column) -> Column:
        near = {f"left{n}": F.get(F.col("words"), i - n) for n in (1, 2, 3)} | {"right1": F.get(F.col("words"), i + 1)}
        left1, left2 = F.coalesce(near["left1"], F.lit("")), F.coalesce(near["left2"], F.lit(""))
        # 0: no keyword before, 1: a keyword, 2: a keyword that the word is assigned to
        told = (
            F.when(left1.rlike(KEYWORD_END), F.when(left1.rlike(KEYWORD_ASSIGNS), 2).otherwise(1))
            .when(left1.isin(*ASSIGNING) & left2.rlike(KEYWORD_END), 2)
            .when((left1 == "is") & left2.rlike(KEYWORD_END), 1)
            .otherwise(0)
        )
        before = _length_before(F.col("words"), i) + i
        parts = [before.alias("before"), word.alias("word"), told.alias("told"), *(c.alias(n) for n, c in near.items())]
        own = word.rlike(f"{ASSIGNMENT}|{LONG_VALUE}")
        return F.when(own | ((F.length(word) >= SHORT) & (told > 0)), F.struct(*parts))

    hits = F.filter(F.transform("words", around), lambda x: x.isNotNull())
    # every token of the word, and what stands between them
    found = (
        rows.select(key, "path", F.explode(hits).alias("hit"))
        .withColumn("tokens", F.regexp_extract_all("hit.word", F.lit(TOKEN), F.lit(0)))
        .withColumn("gaps", F.split("hit.word", TOKEN))
    )

    def value(token: Column, i: Column) -> Column:
        ahead = F.concat(F.coalesce(F.get(F.col("tokens"), i - 1), F.lit("")), F.get(F.col("gaps"), i))
        told = (i == 0) & ((F.col("hit.told") == 2) | ((F.col("hit.told") == 1) & token.rlike(NOT_PROSE)))
        named = ahead.rlike(ASSIGNED) | told
        start = _length_before(F.col("tokens"), i) + _length_before(F.col("gaps"), i + 1)
        behind = F.regexp_extract(F.get(F.col("gaps"), i + 1), "^[\"']?", 0)
        parts = [token.alias("token"), start.alias("start"), F.concat(ahead, token, behind).alias("word")]
        return F.when(token.rlike(LONG_VALUE) | ((F.length(token) >= SHORT) & named), F.struct(*parts))

    values = F.filter(F.transform("tokens", value), lambda x: x.isNotNull())
    found = found.select(key, "path", "hit", F.explode(values).alias("at"))
    found = found.withColumn("inner", F.regexp_extract_all("at.token", F.lit(KNOWN_INSIDE), F.lit(0)))
    outer = F.struct(F.col("at.token").alias("value"), F.lit(0).alias("start"))
    rest = F.split("at.token", KNOWN_INSIDE)

    def inside(known: Column, i: Column) -> Column:
        start = _length_before(F.col("inner"), i) + _length_before(rest, i + 1)
        return F.struct(known.alias("value"), start.alias("start"))

    # a token that is itself of a known format is found once
    each = F.array_distinct(F.concat(F.array(outer), F.transform("inner", inside)))
    found = found.withColumn("one", F.explode(each))
    start = (F.col("hit.before") + F.col("at.start") + F.col("one.start")).cast("long")
    return found.select(
        key, "path", start.alias("start"), (start + F.length("one.value")).alias("end"), "one.value",
        "at.word", "hit.left1", "hit.left2", "hit.left3", "hit.right1",
    )


def dictionary(docs: DataFrame, most_words: int = DICTIONARY_WORDS) -> list[str]:
    """The words of three to twelve letters that the most documents have, at
    most ``most_words``: those from a number of documents on, which is found
    in a histogram of the counts, so that only these words reach the driver."""
    counts = (
        docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
        .filter(F.length("word").between(3, 12))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("level", F.floor(F.log2("n") * 64).cast("int"))
    )
    path = scratch_dir(docs.sparkSession, "word-counts")
    counts.write.parquet(path)
    counts = docs.sparkSession.read.schema(counts.schema).parquet(path)
    least, total = None, 0
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > most_words:
            break
        least = level
    if least is None:
        return []
    words = counts.filter(F.col("level") >= least).select("word").collect()
    return sorted((r["word"] for r in words), key=lambda w: (-len(w), w))


def any_of(words: list[str]) -> str:
    """A pattern of the longest word at a place: the words as a tree of their
    letters, so that a match takes as many steps as the word has letters."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        rest = [c + pattern(n) for c, n in sorted(node.items()) if c]
        if not rest:
            return ""
        return f"(?:{'|'.join(rest)})" + ("?" if "" in node else "")

    return pattern(root)


def _is_keyword(word: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), "[^a-z_]", "")
    return plain.isin(KEYWORDS).cast("double")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """The candidates with the forest's inputs, all double."""
    v, n = F.col("value"), F.length("value").cast("double")
    low = F.lower(v)
    covered = (F.length(v) - F.length(F.regexp_replace(low, any_of(words), ""))) if words else F.lit(0)
    changes = {
        "class_changes": r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])",
        "case_changes": r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])",
        "vowel_changes": r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])",
    }
    shares = {"digit_share": "[0-9]", "upper_share": "[A-Z]", "hex_share": "[0-9a-fA-F]"}
    columns = {"length": n, "word_share": covered / n}
    columns |= {name: F.regexp_count(v, F.lit(p)) / n for name, p in (changes | shares).items()}
    columns |= {
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "assigned": F.col("word").rlike(r"""[A-Za-z_]{3}\\?["']?[=:]""").cast("double"),
        "quoted": F.col("word").rlike("[\"']").cast("double"),
        "after_keyword": F.greatest(*(_is_keyword(F.col(c)) for c in ("left1", "left2", "left3"))),
        "after_equals": F.coalesce(F.col("left1").isin(*ASSIGNING).cast("double"), F.lit(0.0)),
        "before_keyword": _is_keyword(F.col("right1")),
    }
    bucket = F.pmod(F.xxhash64("path"), F.lit(PATH_BUCKETS))
    columns |= {f"path_{i}": (bucket == i).cast("double") for i in range(PATH_BUCKETS)}
    return found.withColumns({name: c.cast("double") for name, c in columns.items()})


def label_by_format(found: DataFrame) -> DataFrame:
    """Labelled findings: 1 for values of a known format, else 0."""
    known = F.lit(False)
    for pattern in KNOWN_FORMATS:
        known = known | F.col("value").rlike(pattern)
    return found.withColumn("label", known.cast("double"))


class SecretForest:
    """A forest over candidates, or a constant where there is but one label."""

    def __init__(self, words: list[str]):
        self.words = words
        self.constant = 0.0
        self.model = None

    def _vectors(self, found: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, self.words))

    def fit(self, findings: DataFrame, most: int = TRAIN_FINDINGS) -> SecretForest:
        """Train from labelled findings, at most ``most`` (in hash order)."""
        spark = findings.sparkSession
        order = [F.xxhash64("value", "start", "left1"), F.col("value"), F.col("start")]
        path = scratch_dir(spark, "secret-findings")
        # a bounded sample in one partition: the forest's draws depend on the order of rows
        findings.orderBy(*order).limit(most).coalesce(1).write.parquet(path)
        sample = spark.read.schema(findings.schema).parquet(path)
        n, positive = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if 0 < positive < n:
            forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label")
            self.model = forest.fit(self._vectors(sample))
        self.constant = positive / n if n else 0.0
        return self

    def score(self, found: DataFrame) -> DataFrame:
        """``found`` with ``probability`` and ``secret`` (0 or 1)."""
        kept = found.columns
        if self.model is None:
            scored = found.withColumn("probability", F.lit(self.constant))
        else:
            scored = self.model.transform(self._vectors(found)).withColumn(
                "probability", vector_to_array("probability")[1]
            )
        return scored.select(*kept, "probability", (F.col("probability") >= ACCEPT).cast("int").alias("secret"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """Every candidate of every document with its probability. The forest is
    trained on the format-labelled candidates of the rows not held out."""
    path = scratch_dir(docs.sparkSession, "secret-candidates")
    found = find_candidates(docs)
    found.write.parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    forest = SecretForest(dictionary(docs)).fit(label_by_format(found.filter(~held_out(F.col("doc_id")))))
    return forest.score(found)
