"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms and look-alike letters become Latin
letters, digits and signs inside words become the letters they stand for. The
lexicon is learned from labelled rows: whole words and word beginnings whose
share among toxic documents exceeds that among clean ones, weighted by the log
of the ratio. A phrase of two words that clean documents hold and toxic ones
don't excuses the match inside it. A text's score is a logistic function of its
summed weight, also per square root of its words; empty texts get the score of
texts without a match.

At most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of id) are
learned from, and of what they hold the ``LEXICON_SIZE`` terms of most weight and
the ``PHRASES`` commonest phrases make the model: its size, like the sample's, is
a parameter and the same at every size of the corpus. Texts are matched whole, in
time in proportion to their length. Several labels of one document count as toxic if any is. Null
labels don't count. Without both kinds of labels the score is the share of toxic
labels (0 without any). Repeated rows give repeated results; other columns are
not read.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_batch, crc_bucket, sliced, written

#: Bounds of the fitted sample and of the lexicon.
SAMPLE_ROWS, LEXICON_SIZE, PHRASES = 20_000, 512, 2_000
#: Lengths of word beginnings that may enter the lexicon.
STEMS = range(4, 9)
LEAST_DOCS, LEAST_LOG_ODDS, THRESHOLD = 3, 2.5, 0.7

#: Letters of other scripts that look like Latin ones, and digits and signs used as letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝвкмнтΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχɡℓıɑ", "aeopcyxijshdqwbkmhtabezhikmnoptyxaeiknoptyxglia"))
SIGNS = dict(zip("0134578@$!|+", "oieastbasiit"))
_TABLE = str.maketrans(HOMOGLYPHS | SIGNS)
_OTHER = re.compile(r"[\W\d_]+")
#: A number with no letter beside it: its digits stand for no letters.
_NUMBER = re.compile(r"(?<!\w)\d+(?!\w)")


def folded(text: str | None) -> str:
    """Words of letters, each with one space before and after."""
    if not text:
        return " "
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    # a sign at a word's end closes a sentence; inside a word it stands for a letter
    text = re.sub(r"(?<=\w)[!|+$@](?=\w)|[!|+$@]", lambda m: m[0] if 0 < m.start() and m.end() < len(m.string) and m.string[m.start() - 1].isalpha() and m.string[m.end()].isalpha() else (m[0] if m[0] in "@$" and m.end() < len(m.string) and m.string[m.end()].isalpha() else " "), text)
    text = _NUMBER.sub(" ", text)
    return f" {_OTHER.sub(' ', text.lower().translate(_TABLE)).strip()} "


def terms(text: str | None) -> set[str]:
    """Whole words (`` word ``) and beginnings (`` wor``) of a text."""
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


_COUNTS = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count(of):
    def run(batches):
        counts = (Counter(), Counter())

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            yield as_batch(_COUNTS, keys, [counts[1][k] for k in keys], [counts[0][k] for k in keys])
            counts[0].clear(), counts[1].clear()

        for batch in sliced(batches, 64):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(of(text))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield from flush()
        yield from flush()

    return run


def _log_odds(toxic, clean, n_toxic, n_clean):
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


class Lexicon:
    """Terms with weights and excusing phrases, as one automaton."""

    def __init__(self, weights: dict[str, float], phrases: frozenset[str]):
        self.weights, self.phrases = weights, phrases
        self.automaton = ahocorasick.Automaton()
        for p in phrases | weights.keys():
            self.automaton.add_word(p, (len(p), weights.get(p)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str | None):
        """(start, end, weight) in the folded text, excused ones left out."""
        flat = folded(text)
        if not len(self.automaton):
            return flat, []
        found = [(end - size + 1, end + 1, weight) for end, (size, weight) in self.automaton.iter(flat)]
        excused = [(a, b) for a, b, w in found if w is None]
        return flat, [(a, b, w) for a, b, w in found if w is not None and not any(x <= a and b <= y for x, y in excused)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of the summed weight, the weight by length, and whether any matched.
        Terms that begin at one word count once, with the largest weight."""
        flat, found = self.matches(text)
        best: dict[int, float] = {}
        for a, _, w in found:
            best[a] = max(w, best.get(a, 0.0))
        total = sum(best.values())
        return math.log1p(total), total / math.sqrt(flat.count(" ") + 8), float(bool(best))


def _phrases_of(weights: dict[str, float]):
    lexicon = Lexicon(weights, frozenset())

    def run(text):
        flat, found = lexicon.matches(text)
        out = set()
        for a, b, _ in found:
            end = flat.index(" ", b - 1 if flat[b - 1] == " " else b)
            before, after = flat.rfind(" ", 0, a) if a else -1, flat.find(" ", end + 1)
            if before >= 0:
                out.add(flat[before : end + 1])
            if after >= 0:
                out.add(flat[a : after + 1])
        return out

    return run


def _pruned(rows: list[tuple[str, float, int]]) -> dict[str, float]:
    """Of (term, weight, toxic documents): terms that no longer term stands for
    nearly as often, without those that a beginning among them stands for."""
    longest: dict[str, int] = {}
    for term, _, toxic in rows:
        for n in range(2, len(term)):
            longest[term[:n]] = max(toxic, longest.get(term[:n], 0))
    kept: dict[str, float] = {}
    for term, weight, toxic in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if longest.get(term, 0) < 0.95 * toxic and not any(kept.get(term[:n], -1.0) >= weight - 0.3 for n in range(2, len(term))):
            kept[term] = weight
    return dict(sorted(kept.items(), key=lambda r: (-r[1], r[0]))[:LEXICON_SIZE])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept; Newton steps with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.diag([0.05] * (len(w) - 1) + [1e-6])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, weights, phrases, logistic, rate):
        self.weights, self.phrases, self.logistic, self.rate = weights, phrases, logistic, rate

    @functools.cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.weights, self.phrases)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lexicon"}

    def score(self, text: str | None) -> float:
        if self.logistic is None:
            return self.rate
        z = float(np.dot(self.logistic[:-1], self.lexicon.features(text)) + self.logistic[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the ``labels`` rows (id, label 0 or 1) of ``docs``."""
    named = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    # the sample is read four times, the documents only once
    rows = written(docs.join(F.broadcast(chosen), docs[id_col] == chosen["id"]).select(F.col(text_col).alias("text"), "label"), "labelled")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Model({}, frozenset(), None, float(n_toxic > 0))
    shape = "term string, toxic long, clean long"
    counted = rows.mapInArrow(_count(terms), shape).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    found = counted.filter((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_LOG_ODDS)).orderBy(F.desc(odds * F.col("toxic")), "term").limit(8 * LEXICON_SIZE).collect()
    weights = _pruned([(r.term, _log_odds(r.toxic, r.clean, n_toxic, n_clean), r.toxic) for r in found])
    seen = rows.mapInArrow(_count(_phrases_of(weights)), shape).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    excused = seen.filter((F.col("clean") >= LEAST_DOCS) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "term").limit(PHRASES).collect()
    model = Model(weights, frozenset(r.term for r in excused), None, n_toxic / (n_toxic + n_clean))
    found = rows.mapInArrow(_features(docs.sparkSession.sparkContext.broadcast(model)), "label int, a double, b double, c double").collect()
    model.logistic = fit_logistic(np.array([r[1:] for r in found]), np.array([r[0] for r in found], float))
    return model


_FEATURES = pa.schema([("label", pa.int32()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64())])


def _features(shared):
    def run(batches):
        lexicon = shared.value.lexicon
        for batch in sliced(batches):
            yield as_batch(_FEATURES, batch.column(1), *np.array([lexicon.features(t) for t in batch.column(0).to_pylist()]).T)

    return run


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score, which replaces a column so named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(score_col)
    at, names = rows.columns.index(text_col), [*rows.columns, score_col]

    def run(batches):
        own = shared.value
        for batch in sliced(batches, 512):
            scores = [own.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(score_col, DoubleType())]))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(crc_bucket(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return scored(docs, model, score_col="score").select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
