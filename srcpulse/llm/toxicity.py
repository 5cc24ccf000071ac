"""Operator 10: toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters, digits and signs that stand for letters inside words) and searched
for the lexicon's words with one Aho-Corasick automaton, with stand-ins at the end of words once as they are and once
folded; hits inside exception phrases do not count. The summed weights,
divided by a power of the number of words, pass through a logistic curve.

The lexicon is learned: words whose labelled documents are toxic far more often than others, each weighted by the lower
end of the interval for that share. Fitting uses at most about `fit_rows` labelled documents, chosen by a hash of doc_id;
words of the lexicon are at most `lexicon_size`, the strongest. Scoring reads every document.

Null and empty texts have no hit and get the score of such texts. Labels of unknown documents, null labels and null ids
are ignored; with no usable labels all scores are 0. Repeated rows are scored each on their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import texts

#: Letters of other scripts that look like Latin ones, and what they look like.
LOOK_ALIKES = str.maketrans("асеорхуіјѕԁһӏмтвнкαοερνιτκυχѵᴀɑ", "aceopxyijsdhlmtbhkaoepvitkuxvaa")
#: Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser rule")
_foreign = re.compile("[Ͱ-ӿԀ-ԯᴀɑ]").search
_stand_in = re.compile(r"[013457@$](?=[0-9@$]{0,4}[a-z])|(?<=[a-z])0(?![0-9a-z])").sub
_words = re.compile(r"[^\W\d_]+").findall
#: A few stand-ins that end a word.
_last = re.compile(r"(?<=[a-z])[0-9@$]{1,4}(?![0-9a-z@$])")
_stands_for = str.maketrans(STAND_INS)
#: The exponents of the text's length that are tried.
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def folded(text: str) -> str:
    text = text.lower()
    if not text.isascii() and _foreign(text):
        text = text.translate(LOOK_ALIKES)
    return _stand_in(lambda m: STAND_INS[m[0]], text)


def readings(text: str) -> list[str]:
    """The folded text, and where stand-ins end a word, once more with these folded: `trash$` may be a word and a price, or
    a word. Both have the same length, so a place is the same in both."""
    first = folded(text)
    second = _last.sub(lambda m: m[0].translate(_stands_for), first) if _last.search(first) else first
    return [first] if second == first else [first, second]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = 0.0
    slope: float = 0.0
    bias: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found

    def hits(self, text: str, found: ahocorasick.Automaton) -> tuple[float, int]:
        """(summed weights, words) of a text. A place counts once, in the first reading in which the lexicon knows it."""
        spared, marks = set(), {}
        for text in readings(text):
            for last, (size, weight) in found.iter(text):
                start = last + 1 - size
                if start and text[start - 1].isalnum() or last + 1 < len(text) and text[last + 1].isalnum():
                    continue
                if weight is None:
                    spared.add((start, last))
                else:
                    marks.setdefault((start, last), weight)
        total = sum(w for (start, last), w in sorted(marks.items()) if not any(a <= start and last <= b for a, b in spared))
        return float(total), len(text.split())

    def curve(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.slope * strength(total, words, self.power) + self.bias)))


def strength(total: np.ndarray, words: np.ndarray, power: float) -> np.ndarray:
    return np.log1p(total * (100 / np.maximum(words, 1)) ** power)


def _lexicon(sample: DataFrame, base: float, size: int, least_docs: int, least_share: float) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                (toxic if label else other).update(set(_words(folded(text))))
            words = list(toxic | other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())],
                ["word", "toxic", "other"],
            )

    counts = sample.mapInArrow(count, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    n, z = F.col("toxic") + F.col("other"), 1.96
    share = F.col("toxic") / n
    # The lower end of the 95 % interval (Wilson) of the share of toxic documents among those with the word.
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    chosen = counts.where(F.col("toxic") >= least_docs).withColumn("low", low).where(F.col("low") >= least_share)
    rows = chosen.orderBy(F.desc("low"), "word").limit(size).collect()
    logit = lambda p: math.log(p / (1 - p))
    return {r.word: logit(min(r.low, 0.999)) - logit(base) for r in rows if r.low > base}


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    fit_rows: int = 40_000, lexicon_size: int = 5_000, least_docs: int = 4, least_share: float = 0.5,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """A model of the labels given; leave out rows of `labels` that must not be learned from."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).alias("label"))
    n = known.count()
    if not n:
        return Model(exceptions=exceptions)
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * fit_rows // n)
    sample = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("text", "label")
    toxic, all_ = sample.agg(F.count_if("label"), F.count("*")).first()
    if not toxic or toxic == all_:
        return Model(exceptions=exceptions, bias=math.inf if toxic else -math.inf)
    model = Model(_lexicon(sample, toxic / all_, lexicon_size, least_docs, least_share), exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            rows = [model.hits(t, found) for t in batch.column("text").to_pylist()]
            total, words = (pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([total, words, batch.column("label")], ["total", "words", "label"])

    # At most about `fit_rows` rows of three numbers; sorted, so that sums don't depend on the order of tasks.
    table = sample.mapInArrow(features, "total double, words double, label boolean").toPandas().sort_values(["total", "words", "label"])
    total, words, y = (table[c].to_numpy(float) for c in ("total", "words", "label"))
    best = math.inf
    for power in POWERS:
        x = strength(total, words, power)
        slope, bias = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-(slope * x + bias))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if loss < best - 1e-9:
            best, model.power, model.slope, model.bias = loss, power, slope, bias
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for one feature and a bias, with a small ridge on the slope."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + np.array([ridge, 1e-6]) * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-6]), gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most lexicon_size words

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = shared.value
        found = mine.automaton()
        for batch in batches:
            rows = [mine.hits(t or "", found) for t in batch]
            yield pd.Series(mine.curve(*(np.array([r[i] for r in rows], float) for i in (0, 1))))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from labels of rows that are not held out."""
    model = fit(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, **options)
    scored = texts(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` with a score below the threshold, all columns."""
    model = fit(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, **options)
    return docs.where(scorer(docs, model)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < threshold)
