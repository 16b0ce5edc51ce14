"""Language identification by multilingual mixture inference.

Learning: for each language the counts of byte trigrams inside words (hashed to 2**16 features,
add-half smoothing), summed by Spark over all training rows.  The model is languages x 2**16
numbers; that is all that is broadcast.

Prediction: a document's words are draws from a mixture of languages.  Expectation-maximisation
estimates the proportions from the words' n-gram likelihoods over all languages; then the language
set grows from the largest proportion down as long as the log-likelihood of the refitted mixture
rises by more than ``penalty * ln(words) / 2`` for the new language.  ``lang_pred`` is the largest
proportion of the final mixture, ``score`` that proportion, ``lang_set`` the chosen set.

Text that is null or has no letter: ``und`` with score 0 and an empty set (as is every text if there
are no training rows).  Rows with null lang or text are not learned from.  Ties go to the
language first in alphabetical order.  Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.llm.common import folded, table
from gridmf.llm.words import LOWER, runs, slices

FEATURES = 1 << 16
EM_STEPS = 12
PENALTY = 2.0
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def _trigrams(buf: np.ndarray, offs: np.ndarray):
    """(features of each word byte, features of each word's end, word starts, ends, each text's first word)."""
    low = LOWER[buf]
    inside = LETTER[low]
    starts, ends, first = runs(inside, offs)
    c0 = np.where(inside, low, 32).astype(np.uint32)
    c1, c2 = np.full(len(c0), 32, np.uint32), np.full(len(c0), 32, np.uint32)
    c1[1:] = c0[:-1]
    c2[2:] = c0[:-2]
    if len(starts):
        c1[starts] = 32
        c2[starts] = 32
        second = starts + 1
        c2[second[second < ends]] = 32

    def feature(x, y, z):
        return ((x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA77) + z * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)

    last = ends - 1
    before = np.where(ends - starts > 1, c0[np.maximum(last - 1, 0)], np.uint32(32)) if len(starts) else c0[:0]
    return feature(c2, c1, c0), feature(before, c0[last], np.full(len(last), 32, np.uint32)), starts, ends, first


def count_features(rows: DataFrame) -> DataFrame:
    """(lang, feature, n) of rows with ``text`` and ``lang``: one partial sum a task, then a shuffle of sums."""
    def each(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lo, buf, offs in slices(batch.column("text")):
                inner, tail, starts, ends, first = _trigrams(buf, offs)
                names, which = np.unique(langs[lo:lo + len(offs) - 1].astype(str), return_inverse=True)
                of_word = which[np.repeat(np.arange(len(first) - 1), np.diff(first))]
                at = np.flatnonzero(LETTER[LOWER[buf]])
                size = ends - starts
                n = np.bincount(np.repeat(of_word, size) * FEATURES + inner[at], minlength=len(names) * FEATURES)
                n += np.bincount(of_word * FEATURES + tail, minlength=len(names) * FEATURES)
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + n[i * FEATURES:(i + 1) * FEATURES]
        for name, n in sums.items():
            f = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(n[f])],
                                             names=["lang", "feature", "n"])

    parts = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return (parts.mapInArrow(each, "lang string, feature int, n long")
            .groupBy("lang", "feature").agg(F.sum("n").alias("n")))


class Model:
    """Languages and their log-likelihoods of each feature."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    @classmethod
    def fit(cls, rows: DataFrame) -> "Model":
        """Learn from the rows with text and lang; what comes back has at most 2**16 sums a language."""
        counts = count_features(rows.where("text IS NOT NULL AND lang IS NOT NULL")).toPandas()
        langs = sorted(counts["lang"].unique())
        table_ = np.zeros((len(langs), FEATURES))
        table_[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), counts["feature"].to_numpy(int)] = counts["n"]
        return cls(langs, table_)

    def word_scores(self, buf, offs) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages log-likelihoods, each text's first word)."""
        inner, tail, starts, ends, first = _trigrams(buf, offs)
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        if len(starts):
            cuts = np.stack([starts, ends], axis=1).reshape(-1)
            for j, logp in enumerate(self.logp):
                at = np.append(logp[inner], np.float32(0))
                out[:, j] = np.add.reduceat(at, cuts)[::2] + logp[tail]
        return out, first

    def predict(self, buf, offs):
        """Per text: index of the language (-1: und), score, and the mask and proportions of its language set."""
        ll, first = self.word_scores(buf, offs)
        n_texts, n_langs = len(first) - 1, len(self.langs)
        counts = np.diff(first)
        best, score = np.full(n_texts, -1), np.zeros(n_texts)
        mask = np.zeros((n_texts, n_langs), bool)
        props = np.zeros((n_texts, n_langs))
        has = np.flatnonzero(counts > 0)
        if not len(has) or not n_langs:
            return best, score, mask, props
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(ll - top)
        size = counts[has]
        at = first[:-1][has]
        full = self._em(like, at, size, np.ones((len(has), n_langs), bool))[0]
        order = np.argsort(-full, axis=1, kind="stable")
        rows = np.arange(len(has))
        chosen = np.zeros((len(has), n_langs), bool)
        chosen[rows, order[:, 0]] = True
        pi, value = self._em(like, at, size, chosen, steps=1)
        active = rows
        for k in range(1, n_langs):
            if not len(active):
                break
            trial = chosen[active].copy()
            trial[np.arange(len(active)), order[active, k]] = True
            sub = np.repeat(at[active] - (np.cumsum(size[active]) - size[active]), size[active]) + np.arange(size[active].sum())
            sub_at = np.cumsum(size[active]) - size[active]
            p, v = self._em(like[sub], sub_at, size[active], trial)
            better = v - value[active] > PENALTY * 0.5 * np.log(size[active] + 1.0)
            up = active[better]
            chosen[up], pi[up], value[up] = trial[better], p[better], v[better]
            active = up
        pick = np.argmax(pi, axis=1)
        best[has], score[has] = pick, np.clip(pi[rows, pick], 0, 1)
        mask[has], props[has] = chosen, pi
        return best, score, mask, props

    @staticmethod
    def _em(like, at, size, allowed, steps: int = EM_STEPS):
        """Proportions over the allowed languages and the log-likelihood (less a constant a text)."""
        doc = np.repeat(np.arange(len(size)), size)
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(steps):
            r = like * pi[doc].astype(np.float32)
            r /= np.maximum(r.sum(axis=1, keepdims=True), np.float32(1e-30))
            pi = np.add.reduceat(r, at, axis=0, dtype=np.float64) / size[:, None]
            pi = np.where(allowed, pi, 0)
            total = pi.sum(axis=1, keepdims=True)
            pi = np.where(total > 0, pi / np.maximum(total, 1e-300), allowed / allowed.sum(axis=1, keepdims=True))
        mixed = np.einsum("wl,wl->w", like, pi[doc].astype(np.float32), dtype=np.float64)
        return pi, np.add.reduceat(np.log(np.maximum(mixed, 1e-30)), at)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, lang_set) of every row; only ``text`` is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x 2**16 floats

    def each(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            texts = batch.column("text")
            pred, scores, sets = [], [], []
            for lo, buf, offs in slices(texts):
                best, score, mask, props = m.predict(buf, offs)
                ascii_ = np.append(0, np.cumsum(LETTER[LOWER[buf]] & (buf < 128)))
                unsure = np.flatnonzero((ascii_[offs[1:]] == ascii_[offs[:-1]]) & (best >= 0))
                for i in unsure.tolist():
                    if not has_letter(texts[lo + i].as_py()):
                        best[i], score[i], mask[i] = -1, 0.0, False
                pred += names[best].tolist()
                scores += score.tolist()
                sets += [",".join(m.langs[j] for j in sorted(np.flatnonzero(k), key=lambda j: -p[j])) for k, p in zip(mask, props)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "lang_set"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(each, "doc_id long, lang_pred string, score double, lang_set string"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_training = folded("doc_id") % 3 == 1
    model = Model.fit(docs.where(~out_of_training))
    return identify(docs, model).select("doc_id", (folded("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score", "lang_set")
