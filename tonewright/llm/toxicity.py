"""Toxicity grades by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector is shared by all ordered thresholds, and the expected severity
of a text is the sum of these probabilities. Features are log counts of words and of word beginnings. The labels say only
whether a text is toxic. How toxic, grades 1 to 3 of the toxic texts of the sample, is told by models that never saw the text:
the sample is dealt into FOLDS, each is scored by a model of two grades that was fitted to the others, and the thirds of
these scores are the grades. (The features themselves are chosen on the whole sample.)

The fit takes a bounded sample: the MAX_LABELLED labelled documents whose ids have the smallest hashes, and of the
features in at least MIN_DOCS of them the MAX_FEATURES that tell toxic from clean texts best. Everything else runs over all rows and whole texts, without a shuffle.

Defined results
* null text counts as empty: no features, the severity of a text without known words;
* labels that are null are left out, a document with several labels is toxic if one says so;
* without both toxic and clean labels nothing can be learnt: severity 0 and not toxic everywhere;
* repeated rows are graded one by one, an empty table gives an empty result; other columns aren't carried along.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, text_of

MAX_LABELLED = 8_000
MAX_FEATURES = 5_000
MIN_DOCS = 8
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Words whose features a Python worker keeps.
CACHE = 1_000_000
GRADES = 4
#: Parts of the sample that are scored by models of the others, and the steps of these models.
FOLDS, FOLD_STEPS = 4, 150
L2 = 2e-4
STEPS = 400

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def feature_counts(text: str) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for f in features_of(w):
            out[f] += n
    return out


class _Known(dict):
    """The features that a model knows of each word."""

    def __init__(self, weights):
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found


@dataclass(frozen=True)
class Ordinal:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(np.array(self.thresholds)[None, :] - eta[:, None]))

    def scorer(self):
        """A function from a text to its w.x."""
        known, weights = _Known(self.weights), self.weights

        def eta(text: str) -> float:
            found = Counter(chain.from_iterable(map(known.__getitem__, _WORD.findall(text.lower()))))
            return sum(weights[f] * math.log1p(n) for f, n in sorted(found.items()))

        return eta


def fit_ordinal(doc: np.ndarray, word: np.ndarray, x: np.ndarray, y: np.ndarray, n_words: int, grades: int, l2: float = L2, steps: int = STEPS):
    """Weights and thresholds that maximise the penalised likelihood of grades y; doc, word and x are a sparse matrix."""
    n = len(y)
    w, free = np.zeros(n_words), np.concatenate([[np.log((y == 0).mean() / max(1e-9, (y > 0).mean()))], np.zeros(grades - 2)])
    moment = [np.zeros(n_words), np.zeros_like(free)]
    second = [np.zeros(n_words), np.zeros_like(free)]
    theta = lambda f: np.concatenate([f[:1], f[0] + np.cumsum(np.exp(f[1:]))])
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    for t in range(1, steps + 1):
        th = theta(free)
        eta = np.bincount(doc, x * w[word], n)
        above = np.concatenate([np.ones((n, 1)), sig(eta[:, None] - th[None, :]), np.zeros((n, 1))], 1)
        s, r = above[np.arange(n), y], above[np.arange(n), y + 1]
        p = np.maximum(s - r, 1e-12)
        g_eta = (1 - s - r) / n
        g_w = np.bincount(word, x * g_eta[doc], n_words) - l2 * w
        g_th = np.zeros(grades - 1)
        for k in range(1, grades):
            g_th[k - 1] -= (s * (1 - s) / p)[y == k].sum() / n
            g_th[k - 1] += (r * (1 - r) / p)[y == k - 1].sum() / n
        steps_of = np.exp(free[1:])
        g_free = np.concatenate([[g_th.sum()], np.cumsum(g_th[1:][::-1])[::-1] * steps_of])
        for i, (value, g) in enumerate(((w, g_w), (free, g_free))):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            value += 0.05 * (moment[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return w, theta(free)


def held_out_scores(doc: np.ndarray, word: np.ndarray, x: np.ndarray, toxic: np.ndarray, n_words: int, folds: int = FOLDS, steps: int = FOLD_STEPS) -> np.ndarray:
    """Of each text w.x less the threshold, by a model of toxic and clean that saw none of the texts of its fold. Both kinds are
    dealt to folds in turn; where one has less than two texts nothing can be held out, and all score 0."""
    out, folds = np.zeros(len(toxic)), min(folds, int(toxic.sum()), int((~toxic).sum()))
    if folds < 2:
        return out
    nth = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) - 1
    for k in range(folds):
        own = nth % folds == k
        place, seen = np.cumsum(~own) - 1, ~own[doc]
        w, th = fit_ordinal(place[doc[seen]], word[seen], x[seen], toxic[~own].astype("int64"), n_words, 2, steps=steps)
        out[own] = np.bincount(doc, x * w[word], len(toxic))[own] - th[0]
    return out


def severity(scores: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades of the sample: 0, or one more than the third of the toxic texts' scores that a toxic text is in."""
    bounds = np.quantile(scores[toxic], [k / (grades - 1) for k in range(1, grades - 1)])
    return np.where(toxic, 1 + (scores[:, None] > bounds[None, :]).sum(1), 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> Ordinal:
    known = packed(labels, _id=id_col, _y=F.col(f"`{label_col}`").cast("int")).drop("_row").dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    sample = packed(docs, _id=id_col, _text=text_of(text_col)).drop("_row").join(F.broadcast(known), "_id")  # max_labelled rows

    def count(batches):
        for b in batches:
            rows = [(i, w, n) for i, x in enumerate(b.column(1)) for w, n in feature_counts(x.as_py()).items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["_id", "_y", "w", "n"])

    kind = sample.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_y", T.IntegerType()), T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    counts = sample.select("_id", "_text", "_y").mapInArrow(count, schema).persist()
    have = known.join(sample.select("_id").distinct(), "_id").toPandas()
    n_hot, n_all = int((have["_y"] == 1).sum()), len(have)
    share = lambda x, n: F.col(x) / F.lit(float(max(1, n)))
    words = counts.groupBy("w").agg(F.count("*").alias("d"), F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("h")).filter(F.col("d") >= min_docs)
    words = words.withColumn("c", F.col("d") - F.col("h")).withColumn("p", share("d", n_all))
    tells = F.pow(share("h", n_hot) - share("c", n_all - n_hot), F.lit(2)) / (F.col("p") * (1.0 - F.col("p")) + 1e-9)
    words = words.orderBy(tells.desc(), "w").limit(max_features).select("w")
    names, ids = sorted(words.toArrow()["w"].to_pylist()), have.sort_values("_id")
    toxic = ids["_y"].to_numpy() == 1
    if not names or toxic.all() or not toxic.any():
        counts.unpersist()
        return Ordinal({}, (50.0,) * (GRADES - 1))
    # Only numbers come to the driver: at most max_labelled * max_features of them, and far fewer in practice.
    spark = docs.sparkSession
    word_no = spark.createDataFrame(list(enumerate(names)), "word int, w string")
    doc_no = spark.createDataFrame(list(enumerate(ids["_id"].tolist())), T.StructType([T.StructField("doc", T.IntegerType()), T.StructField("_id", kind)]))
    matrix = counts.join(F.broadcast(word_no), "w").join(F.broadcast(doc_no), "_id").select("doc", "word", F.col("n").cast("float")).toArrow()
    counts.unpersist()
    doc, word, n = (matrix[c].to_numpy() for c in ("doc", "word", "n"))
    order = np.lexsort((word, doc))  # the same sums in every run
    doc, word, n = doc[order], word[order], n[order].astype("float64")
    x = np.log1p(n)
    y = severity(held_out_scores(doc, word, x, toxic, len(names)), toxic)
    w, th = fit_ordinal(doc, word, x, y, len(names), GRADES)
    return Ordinal({name: float(v) for name, v in zip(names, w, strict=True)}, tuple(map(float, th)))


def graded(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id under its own name, expected_severity, grade (the likeliest), p_toxic and toxic."""
    t = packed(docs, _id=id_col, _text=text_of(text_col)).drop("_row")
    fields = [T.StructField(id_col, t.schema["_id"].dataType), T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]

    def run(batches):
        eta = model.scorer()
        for b in batches:
            p = model.at_least(np.array([eta(x.as_py()) for x in b.column(1)], "float64"))
            each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(each.argmax(1).astype("int32")), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)], names=[f.name for f in fields])

    return t.mapInArrow(run, T.StructType(fields))


QUERY = "op2_toxicity"
