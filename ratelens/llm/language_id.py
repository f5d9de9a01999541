"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines separate
the languages within it. Features are hashed byte n-grams (orders 1 to 3) of the whole text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import ASCII_LOWER, small_batches, table
from ratelens.llm.sampling import held_out, sample_ids

#: Families of language codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt",
    "austronesian": "id ms tl jv su mg",
    "indic": "hi ur bn mr ne gu pa",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Rows that all models are fitted on: this many in all, spread over the languages, with a least number each.
SAMPLE_TOTAL, SAMPLE_LEAST = 1600, 30
SIZES = (256, 2048, 4096)
LETTER = re.compile(rb"[A-Za-z]")


def ngram_vector(text: bytes) -> np.ndarray:
    """Square roots of the n-gram shares, one part of the vector for each order."""
    a = np.frombuffer(text.translate(ASCII_LOWER), np.uint8).astype(np.uint32)
    parts = [np.bincount(a, minlength=SIZES[0])]
    two = a[:-1] * np.uint32(259) + a[1:]
    parts.append(np.bincount((two * np.uint32(2654435761)) >> np.uint32(21), minlength=SIZES[1]))
    three = two[:-1] * np.uint32(263) + a[2:]
    parts.append(np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=SIZES[2]))
    return np.concatenate([np.sqrt(p / max(1, p.sum())) for p in parts]).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine (squared hinge, labels +1 and -1), by accelerated gradients.

    There are fewer rows than features, so the weights are kept as sums of rows and only the products
    between rows are needed.
    """
    mean = x.mean(axis=0)
    z = np.hstack([x - mean, np.ones((len(x), 1), x.dtype)])
    gram = (z @ z.T).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v, top = np.ones(len(z)), 1.0
    for _ in range(20):
        v = share * (gram @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (lam + 2.2 * top)
    w, ahead, momentum = np.zeros(len(z)), np.zeros(len(z)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (gram @ ahead))
        new = ahead - step * (lam * ahead - 2 * share * slack * y)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / grown * (new - w), new, grown
    full = w @ z
    return full[:-1].astype(np.float32), float(full[-1] - full[:-1] @ mean)


@dataclass
class OneVersusOne:
    """Linear machines between all pairs of classes; the class with most votes wins, margins break ties."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    biases: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> OneVersusOne:
        classes = sorted(set(y.tolist()))
        pairs = list(itertools.combinations(range(len(classes)), 2))
        weights, biases = np.zeros((len(pairs), x.shape[1]), np.float32), np.zeros(len(pairs))
        for k, (i, j) in enumerate(pairs):
            at = (y == classes[i]) | (y == classes[j])
            weights[k], biases[k] = fit_svm(x[at], np.where(y[at] == classes[i], 1.0, -1.0))
        return cls(classes, pairs, weights, biases)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The winner and the logistic of its smallest margin (1 with a single class)."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights @ v + self.biases
        votes = np.zeros(len(self.classes))
        for (i, j), m in zip(self.pairs, margins, strict=True):
            votes[i if m >= 0 else j] += 1
            soft = 0.1 * np.tanh(m)
            votes[i] += soft
            votes[j] -= soft
        best = int(np.argmax(votes))
        least = min(m if best == i else -m for (i, j), m in zip(self.pairs, margins, strict=True) if best in (i, j))
        return self.classes[best], float(1 / (1 + np.exp(-np.clip(3 * least, -30, 30))))


@dataclass
class HierarchicalModel:
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> HierarchicalModel:
        y = np.array(langs)
        family = np.array([FAMILY_OF.get(c.lower()[:2] if len(c) > 3 else c.lower(), c) for c in langs])
        return cls(OneVersusOne.fit(x, family), {f: OneVersusOne.fit(x[family == f], y[family == f]) for f in sorted(set(family.tolist()))})

    def predict(self, text: bytes) -> tuple[str, float]:
        v = ngram_vector(text)
        family, p = self.families.predict(v)
        lang, q = self.within[family].predict(v)
        return lang, p * q


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [ngram_vector(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["lang", "vector"])


def fit_languages(docs: DataFrame, total: int = SAMPLE_TOTAL, least: int = SAMPLE_LEAST) -> HierarchicalModel | None:
    """Fits on a bounded sample of rows that aren't held out and have a lang and a letter; None without any."""
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    ids = sample_ids(docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()), "lang", total, least)
    own = usable.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")  # at most total rows
    rows = own.select(F.col("lang").cast("string"), F.col("text").cast("binary")).mapInArrow(_vectors, "lang string, vector binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["vector"]))
    return HierarchicalModel.fit(np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]), [r["lang"] for r in rows])


def _predictor(model: HierarchicalModel | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(2):
                raw = t.as_py()
                if model is None or raw is None or not (LETTER.search(raw) or has_letter(raw.decode("utf-8", "replace"))):
                    lang, score = "und", 0.0
                else:
                    lang, score = model.predict(raw)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def predict_languages(docs: DataFrame, model: HierarchicalModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no model could
    be fitted. Repeated rows are predicted alike; a null id counts as not held out. Texts of any length are read whole, a
    batch at a time; other columns are ignored and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
