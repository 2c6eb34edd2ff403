"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from bidlens.llm.common import add_columns, put_back, set_aside, small_batches, stored, table, trimmed
from bidlens.session import broadcast_if_small

# Labelled rows to learn from, at most about; half of them of each class.
SAMPLE_ROWS = 40_000
# Remainders of the id's checksum that are not held out, and the two halves that trees are calibrated by.
FOLDS, HALVES = (1, 2, 3, 4), ((1, 2), (3, 4))
# Terms of toxic texts that are weighed, and of these the terms in the learned lexicon, at most.
CANDIDATES, LEXICON = 50_000, 5_000
# Toxic texts that must hold a term of the lexicon, and its least log ratio of document shares.
SUPPORT, RATIO = 4, 2.0
# Letters of word beginnings that are terms of the learned lexicon too.
STEMS = (5, 6, 7)
# Words between an insult and the person addressed.
NEAR = 5
# Common insults, and pronouns of the second person.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb loser losers trash scum clown pathetic worthless disgusting jerk fool
    imbecile garbage vermin freak creep coward liar hate ugly useless shut kill
    idiota estupido estúpido imbecil imbécil basura asqueroso tonto inutil inútil cerdo
    idiote stupide imbécile connard ordure nul débile crétin dégueulasse
    dumm dummkopf abschaum arschloch widerlich erbärmlich trottel wertlos""".split()
)
YOU = frozenset("you your yours yourself u ur tu te ti tú usted ustedes vos vous toi ton ta votre du dich dir dein deine ihr euch euer sie".split())
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_][0-9@$*!|+][^\W\d_]")
SPACED = re.compile(r"\b(?:[^\W\d_][.\-_* ]){3,}")
LEET = str.maketrans("013457@$!|", "oieastasii")
FEATURES = [
    "insult_density", "insult_hits", "learned_density", "learned_hits", "learned_mean", "learned_most", "stem_density", "stem_most", "near_you",
    "you_density", "capital_letters", "capital_words", "exclamations", "questions", "punctuation", "masked", "spaced", "masked_hits",
    "digits", "log_words", "word_length",
]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out, as it has no label."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def terms(text: str | None) -> set[str]:
    """Words in lower case, and word beginnings marked by a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The values of ``FEATURES``; all are finite, and 0 for an empty text."""
    text = text or ""
    raw = WORD.findall(text)
    words = [w.lower() for w in raw]
    n = max(1, len(words))
    insults = {i for i, w in enumerate(words) if w in INSULTS}
    learned = {i: lexicon[w] for i, w in enumerate(words) if w in lexicon}
    stems: dict = {}
    for size in STEMS:
        for i, w in enumerate(words):
            if len(w) > size and (x := lexicon.get(w[:size] + "*")) is not None:
                stems[i] = max(x, stems.get(i, 0.0))
    you = [i for i, w in enumerate(words) if w in YOU]
    hits = insults | set(learned)
    near = sum(any(i + d in hits for d in range(-NEAR, NEAR + 1)) for i in you) if hits else 0
    letters = sum(map(len, raw))
    length = max(1, len(text))
    masked = MASKED.findall(text)
    disguised = 0
    if masked:
        for token in text.split():
            if MASKED.search(token):
                plain = WORD.findall(token.lower().translate(LEET))
                disguised += any(w in INSULTS or w in lexicon for w in plain)
    marks = sum(text.count(c) for c in ".,;:!?\"'()-")
    weights = list(learned.values())
    return [
        len(insults) / n,
        math.log1p(len(insults)),
        len(learned) / n,
        math.log1p(len(learned)),
        sum(weights) / len(weights) if weights else 0.0,
        max(weights, default=0.0),
        len(stems) / n,
        max(stems.values(), default=0.0),
        math.log1p(near),
        len(you) / n,
        sum(map(str.isupper, text)) / max(1, letters),
        sum(len(w) > 1 and w.isupper() for w in raw) / n,
        text.count("!") / length,
        text.count("?") / length,
        marks / length,
        len(masked) / n,
        len(SPACED.findall(text)) / n,
        math.log1p(disguised),
        sum(map(str.isdigit, text)) / length,
        math.log1p(len(words)),
        letters / n,
    ]


@dataclass
class ToxicityModel:
    """Learned lexicon, trees and calibration; without trees every text gets the ``base`` share."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    isotonic: IsotonicRegressionModel | None
    base: float


def _counted(texts: DataFrame, wanted: set | None) -> DataFrame:
    """Texts (text, fold) that hold each term, by fold: (term, n1 to n4, n), combined per batch before the shuffle."""

    def count(batches):
        for batch in batches:
            found: dict[int, Counter] = {f: Counter() for f in FOLDS}
            for t, f in zip(batch.column("text"), batch.column("fold")):
                found[f.as_py()].update(terms(t.as_py()) if wanted is None else terms(t.as_py()) & wanted)
            rows = [(t, f, n) for f, c in found.items() for t, n in c.items()]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["term", "fold", "n"])

    schema = StructType([StructField("term", StringType()), StructField("fold", LongType()), StructField("n", LongType())])
    parts = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in FOLDS]
    return texts.select("text", "fold").mapInArrow(trimmed(count), schema).groupBy("term").agg(*parts, F.sum("n").alias("n"))


def learn_lexicons(rows: DataFrame) -> dict[int, dict[str, float]]:
    """Lexicons of ``rows`` (text, toxic, fold): terms with the log ratio of their shares of toxic and clean texts.

    Under each fold the lexicon of the other folds' rows, under 0 that of all rows. Terms are counted once, by fold.
    """
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    often = _counted(rows.where("toxic = 1"), None).where(F.col("n") >= SUPPORT)
    bad = {r["term"]: r for r in often.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    good = {r["term"]: r for r in _counted(rows.where("toxic = 0"), set(bad)).collect()}

    def lexicon(left_out: int) -> dict[str, float]:
        used = [f for f in FOLDS if f != left_out]
        n_bad, n_good = (sum(sizes.get((t, f), 0) for f in used) for t in (1, 0))
        found = []
        for term, row in bad.items():
            n, m = (sum(r[f"n{f}"] for f in used) if r else 0 for r in (row, good.get(term)))
            weight = math.log((n + 0.5) / (n_bad + 1)) - math.log((m + 0.5) / (n_good + 1))
            if n >= SUPPORT and weight >= RATIO:
                found.append((weight, term))
        return {t: w for w, t in sorted(found, key=lambda x: (-x[0], x[1]))[:LEXICON]}

    return {f: lexicon(f) for f in (0, *FOLDS)}


def featured(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` with the array ``tox_features``; the lexicon is bounded by ``LEXICON`` terms."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = pa.list_(pa.float64())

    def make(texts):
        held = shared.value
        return [pa.array([features(t.as_py(), held) for t in texts], kind)]

    return add_columns(docs, [text], [StructField("tox_features", ArrayType(DoubleType()))], make)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from labelled rows that are not held out, by cross-fitting over the four folds of their ids.

    The terms of a fold's rows are weighed by a lexicon of the other folds, so that no lexicon has seen the labels of the rows
    that trees learn from. Trees for the calibration come from two folds and score the other two. The model has the
    lexicon of all rows, trees of all rows and the calibration of all such scores; the scheme is the same at every size.

    At most about half of ``sample_rows`` are drawn of each class, by a hash of the id, so that rare toxic rows are kept;
    rows weigh as many as they stand for. If two folds lack a class, scores are the smoothed share of toxic rows. Of repeated
    labels the largest counts; null labels and ids do not count, nor do labels other than 0 and 1.
    """
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    marks = stored(marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "tox-marks")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, sample_rows / 2 / max(1, counts.get(t, 0))) for t in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    kept = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    chosen = stored(marks.where(draw < kept).withColumn("weight", 1 / kept), "tox-labels")
    rows = docs.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id").withColumn("fold", fold(F.col("doc_id")).cast("long"))
    rows = stored(rows, "tox-sample")
    size = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.sum("weight").alias("n")).collect()}
    bad, every = sum(v for (_, t), v in size.items() if t), sum(size.values())
    base = (bad + 0.5) / (every + 1)
    if not all(any((f, t) in size for f in half) for half in HALVES for t in (0, 1)):
        return ToxicityModel({}, None, None, base)
    lexicons = learn_lexicons(rows)
    parts = [featured(rows.where(F.col("fold") == f), lexicons[f]) for f in FOLDS]
    made = reduce(DataFrame.union, parts).select("fold", F.col("toxic").cast("double").alias("label"), "weight", "tox_features")
    made = stored(made, "tox-features").withColumn("features", array_to_vector("tox_features"))
    boost = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, weightCol="weight", seed=7)
    first, second = (made.where(F.col("fold").isin(*half)) for half in HALVES)
    scored = [boost.fit(a).transform(b).select("label", "weight", vector_to_array("probability")[1].alias("p")) for a, b in ((first, second), (second, first))]
    raw = stored(scored[0].union(scored[1]), "tox-scores")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="score").fit(raw)
    return ToxicityModel(lexicons[0], boost.fit(made), isotonic, base)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), by the text alone.

    Null and empty texts get the score of their all-zero features. Columns of these names are replaced;
    rows, repeated ones too, stay as they are.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    if model.trees is None:
        out = docs.select(*kept, F.lit(float(model.base)).alias("score"))
    else:
        # The text goes to the workers once, beside a struct of the other columns, whose names may be any.
        names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
        made = featured(set_aside(docs, names, text), model.lexicon)
        raw = model.trees.transform(made.withColumn("features", array_to_vector("tox_features"))).select("row", "text", vector_to_array("probability")[1].alias("p"))
        out = model.isotonic.transform(raw).select(*put_back(names, text), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, by a model of the labels of ``docs``.

    Rows with a null or empty text are scored by all-zero features; repeated rows go or stay together; an empty table
    stays empty; all columns stay as they are.
    """
    kept = score(set_aside(docs, docs.columns, "text"), train(docs, labels)).where("predicted = 0")
    return kept.select(*put_back(docs.columns, "text"))
