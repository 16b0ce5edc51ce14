"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not; the severity grades of the training rows are 0 (not toxic) and, for the
toxic ones, 1 .. 3 by thirds of how many different markers they hold, a marker being a feature
whose share among toxic training documents is at least ``MARKER_RATIO`` times its share among the others.
Features are the distinct words (runs of letters and digits, lower case) of the whole text and
their beginnings of ``PREFIXES`` bytes, which see through inflection; those count that at least
``MIN_DOCS`` training documents hold and that differ between the kinds by a chi-square of ``MIN_CHI``.  One weight vector serves all thresholds:
P(grade > k) = sigmoid(w.x - theta_k), fitted by accelerated proximal gradient with an L1 term, so
that most words weigh nothing.  Output: the expected severity (sum of P(grade > k), 0 .. 3), the
likeliest grade, P(toxic) = P(grade > 0) and ``toxic`` = P(toxic) >= 0.5.

Training reads at most ``max_train`` labelled rows, those with the smallest hash of doc_id, and keeps at
most ``MAX_FEATURES`` features (largest chi-square); these bounds make the model a fixed size.

Null text: empty, no features.  No labels, or labels of one kind: nothing is toxic (weights 0).  Null
labels and labels without a document are ignored; a document with several labels is toxic if one
says so; of a doc_id with several texts the least is learned from.  Repeated rows are scored alike; extra columns are kept by ``drop_toxic``, ignored else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import table
from gridmf.llm.words import LOWER, Table, hash_runs, runs, slices

MAX_TRAIN = 20000
MAX_FEATURES = 4096
MIN_DOCS = 6
MIN_CHI = 30.0
PREFIXES = (4, 5, 6)
MARKER_RATIO = 8.0
GRADES = 4
L1 = 1e-4
STEPS = 400
SLICE = 1 << 17
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def distinct_words(buf: np.ndarray, offs: np.ndarray, known: Table | None = None):
    """(text index, hash or its index in ``known``) of each text's distinct words and their beginnings."""
    low = LOWER[buf]
    starts, ends, first = runs(WORD[low], offs)
    of_word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    longer = [np.flatnonzero(ends - starts > k) for k in PREFIXES]
    begin = np.concatenate([starts, *[starts[x] for x in longer]])
    stop = np.concatenate([ends, *[starts[x] + k for k, x in zip(PREFIXES, longer)]])
    doc = np.concatenate([of_word, *[of_word[x] for x in longer]])
    h = hash_runs(low, begin, stop)
    if known is not None:
        at, which = known.find(h)
        pair = np.unique(doc[at] * np.int64(len(known.keys) + 1) + which)
        return pair // (len(known.keys) + 1), pair % (len(known.keys) + 1)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Sorted word hashes, their weights and the thresholds theta_0 < theta_1 < ..."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, theta: np.ndarray):
        self.table, self.weights, self.theta = Table(keys), weights, theta

    def eta(self, buf, offs) -> np.ndarray:
        doc, which = distinct_words(buf, offs, self.table)
        return np.bincount(doc, self.weights[which], minlength=len(offs) - 1)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k), texts x thresholds."""
        return _sigmoid(eta[:, None] - self.theta[None, :])

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected severity, likeliest grade, P(toxic)) of a column."""
        parts = [self.eta(buf, offs) for _, buf, offs in slices(texts, SLICE)]
        p = self.above(np.concatenate(parts) if parts else np.zeros(0))
        each = -np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]), axis=1)
        return p.sum(axis=1), each.argmax(axis=1), p[:, 0]


def fit_ordinal(doc: np.ndarray, feat: np.ndarray, n_feat: int, grade: np.ndarray, grades: int = GRADES,
                l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model for binary features given as (row, feature) pairs."""
    n = len(grade)
    k = np.arange(grades - 1)
    above = (grade[:, None] > k).mean(axis=0)
    w = np.zeros(n_feat)
    theta = -np.log(np.clip(above, 0.5 / (n + 1), 1) / np.clip(1 - above, 0.5 / (n + 1), 1))
    theta = np.maximum.accumulate(theta + 1e-3 * k)
    per_doc = np.bincount(doc, minlength=n)
    rate = 4.0 / max(1.0, float(np.percentile(per_doc, 95)) if n else 1.0)

    def probs(x, t):
        up = np.hstack([np.ones((n, 1)), _sigmoid(x[:, None] - t[None, :]), np.zeros((n, 1))])
        return up, np.maximum(up[np.arange(n), grade] - up[np.arange(n), grade + 1], 1e-12)

    yw, yt, wo, to, mom = w, theta, w, theta, 1.0
    loss_before = np.inf
    for _ in range(steps):
        x = np.bincount(doc, yw[feat], minlength=n)
        up, p = probs(x, yt)
        slope = up * (1 - up)
        g_eta = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p / n
        g_theta = np.array([((grade == j + 1) * slope[:, j + 1] / p - (grade == j) * slope[:, j + 1] / p).sum() / n for j in k])
        w = yw - rate * np.bincount(feat, g_eta[doc], minlength=n_feat)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        theta = np.maximum.accumulate(yt - g_theta) + 1e-6 * k
        loss = -np.log(p).mean() + l1 * np.abs(yw).sum()
        if loss > loss_before:  # restart the momentum
            mom = 1.0
        if loss > 2 * loss_before:
            rate /= 2
        loss_before = loss
        nxt = (1 + np.sqrt(1 + 4 * mom * mom)) / 2
        yw, yt = w + (mom - 1) / nxt * (w - wo), np.maximum.accumulate(theta + (mom - 1) / nxt * (theta - to)) + 1e-6 * k
        wo, to, mom = w, theta, nxt
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))  # the documented bound on training rows
    rows = known.collect()
    if len({bool(r.toxic) for r in rows}) < 2:
        return none
    wanted = spark.createDataFrame([(r.doc_id, int(r.toxic > 0)) for r in rows], "doc_id long, label int")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(wanted), "doc_id")  # at most max_train ids
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")))  # and as many rows

    def spread(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, buf, offs in slices(batch.column("text"), SLICE):
                doc, h = distinct_words(buf, offs)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(label[lo + doc].astype(np.int64))],
                                                 names=["h", "label"])

    n_tox = sum(r.toxic > 0 for r in rows)
    n_ok = len(rows) - n_tox
    held = (texts.select("label", "text").mapInArrow(spread, "h long, label long").groupBy("h")
            .agg(F.sum("label").alias("tox"), F.count(F.lit(1)).alias("all")).where(F.col("all") >= MIN_DOCS))
    a, b = F.col("tox") / n_tox, (F.col("all") - F.col("tox")) / n_ok
    share = F.col("all") / len(rows)
    chi = (a - b) * (a - b) / (share * (1 - share) + 1e-9)
    words = held.where(chi * len(rows) * (n_tox / len(rows)) * (n_ok / len(rows)) >= MIN_CHI) \
        .orderBy(F.desc(chi), "h").limit(MAX_FEATURES).collect()  # the bound on features
    if not words:
        return none
    words.sort(key=lambda r: r.h % 2**64)
    keys = np.array([r.h % 2**64 for r in words], np.uint64)
    tox = np.array([r.tox for r in words], float)
    marker = tox / n_tox >= MARKER_RATIO * (np.array([r["all"] for r in words]) - tox + 0.5) / n_ok
    shared = spark.sparkContext.broadcast(Table(keys))

    def restrict(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, buf, offs in slices(batch.column("text"), SLICE):
                doc, f = distinct_words(buf, offs, shared.value)
                at = np.searchsorted(doc, np.arange(len(offs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[lo:lo + len(offs) - 1].astype(np.int32)),
                     pa.array([f[at[i]:at[i + 1]].astype("<u2").tobytes() for i in range(len(offs) - 1)], pa.binary())],
                    names=["label", "f"])

    # at most max_train rows of at most MAX_FEATURES features
    train = texts.select("label", "text").mapInArrow(restrict, "label int, f binary").collect()
    train.sort(key=lambda r: (r.label, bytes(r.f)))
    feats = [np.frombuffer(r.f, "<u2").astype(np.int64) for r in train]
    label = np.array([r.label for r in train])
    doc = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    feat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    n_marks = np.bincount(doc, marker[feat], minlength=len(label))
    low, high = np.quantile(n_marks[label > 0], [1 / 3, 2 / 3]) if (label > 0).any() else (0, 0)
    grade = np.where(label > 0, 1 + (n_marks > low) + (n_marks > high), 0)
    w, theta = fit_ordinal(doc, feat, len(keys), grade)
    used = w != 0
    return Model(keys[used], w[used], theta)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES words

    def each(batches):
        for batch in batches:
            sev, grade, p = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sev), pa.array(grade.astype(np.int32)), pa.array(p),
                                              pa.array(p >= 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(each, "doc_id long, severity double, grade int, p_toxic double, toxic boolean"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            keep = shared.value.scores(batch.column("text").cast(pa.string()))[2] < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(each, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
