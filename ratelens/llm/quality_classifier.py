"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; forward-backward
marginals, weighted by line length, are summed into a share of good text, which a logistic curve turns
into a score. Lines have no labels of their own: in fitting they take that of their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm._common import WORD_BYTES, runs, small_batches, table
from ratelens.llm.sampling import held_out, sample_ids

#: Documents that the field is fitted on, spread evenly over both labels, and the most lines one of them may have.
SAMPLE_TOTAL, SAMPLE_LINES = 1600, 400
#: Longer chains are run through by products of matrices instead of line by line.
STEPS = 256
THRESHOLD = 0.7
FEATURES = 14


def _byte_classes() -> np.ndarray:
    """0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 sentence end, 6 comma, 7 exclamation, 8 bar, 9 symbol, 10 beyond ASCII."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[9:14], kind[32], kind[128:] = 1, 2, 3, 4, 4, 10
    for chars, k in ((b".?;:", 5), (b",", 6), (b"!", 7), (b"|", 8), (b"#*$%&<>{}[]\\^~_=+@/", 9)):
        kind[list(chars)] = k
    return kind


CLASSES = _byte_classes()
N_CLASSES = 11


@dataclass
class Lines:
    """Lines of several texts: own features, lengths, and the number of lines of each text."""

    features: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def line_features(texts: list[bytes | None]) -> Lines:
    """A text without a line break, or an empty one, is one line."""
    split = [(t or b"").split(b"\n") for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    n = int(counts.sum())
    lengths = np.fromiter((len(line) for s in split for line in s), np.int64, n)
    raw = np.frombuffer(b"".join(line for s in split for line in s), np.uint8)
    line_of = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(line_of * N_CLASSES + CLASSES[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    found = [WORD_BYTES.findall(line) for s in split for line in s]
    sizes = np.array([len(f) for f in found], np.int64)
    ids = np.fromiter((hash(w) for f in found for w in f), np.int64, int(sizes.sum()))
    word_line = np.repeat(np.arange(n), sizes)
    again = np.zeros(len(ids), bool)
    for back in (1, 2):
        again[back:] |= (ids[back:] == ids[:-back]) & (word_line[back:] == word_line[:-back])
    repeats = np.bincount(word_line[again], minlength=n)
    copied = np.zeros(n)
    at = 0
    for s in split:
        seen: set[bytes] = set()
        for line in s:
            copied[at] = line in seen and len(line) > 0
            seen.add(line)
            at += 1
    size, words = np.maximum(lengths, 1), np.maximum(sizes, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    rare = np.minimum
    x = np.stack(
        [
            np.log1p(lengths) / 8,
            kinds[:, 1] / letters,
            kinds[:, 3] / size,
            rare(kinds[:, 8] / words, 1),
            rare(kinds[:, 9] / words, 2),
            rare(kinds[:, 7] / words, 2),
            kinds[:, 5] / words,
            kinds[:, 6] / words,
            lengths / words / 20,
            repeats / words,
            copied,
            kinds[:, 10] / size,
            sizes == 0,
            rare(sizes, 5) / 5,
        ],
        axis=1,
    )
    return Lines(np.minimum(x, 4.0), lengths, counts)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own, previous and next line's features and a constant; zeros beyond the text's ends."""
    x, n = lines.features, len(lines.features)
    ends = np.cumsum(lines.counts)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[(ends - lines.counts)[lines.counts > 0]] = 0
    after[(ends - 1)[lines.counts > 0]] = 0
    return np.hstack([x, before, after, np.ones((n, 1))])


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def scan(first: np.ndarray, links: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Forward scores of chains laid end to end by doubling: after k rounds the matrix of each line leads over 2^k lines.

    ``first`` holds the scores of the first line of each chain, ``links`` (n, 2, 2) the step to each line from the one
    before. The work is n log n, in as many numpy steps as the longest chain has binary digits.
    """
    n, starts = len(links), np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(starts, counts)
    lead, width = links.copy(), 1
    while width < counts.max():
        at = np.flatnonzero(place > width)  # the first line is no step
        before = lead[at - width]
        lead[at] = np.stack([np.stack([_log_sum(before[:, j, 0] + lead[at, 0, k], before[:, j, 1] + lead[at, 1, k]) for k in (0, 1)], axis=1) for j in (0, 1)], axis=1)
        width *= 2
    head = np.repeat(first, counts, axis=0)
    out = np.stack([_log_sum(head[:, 0] + lead[:, 0, k], head[:, 1] + lead[:, 1, k]) for k in (0, 1)], axis=1)
    out[starts] = first
    return out


def long_chains(score: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward scores of chains of any length."""
    ends = np.cumsum(counts)
    starts = ends - counts
    alpha = scan(score[starts], transition[None] + score[:, None, :], counts)
    # Backward is forward over the lines in reverse order, with steps that count the line they come from.
    following = np.zeros_like(score)
    following[:-1] = score[1:]
    back = (transition[None] + following[:, None, :]).transpose(0, 2, 1)
    beta = scan(np.zeros((len(counts), 2)), back[::-1], counts[::-1])[::-1]
    return alpha, beta


def forward_backward(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains laid end to end: P(good) of each line, log normaliser of each chain, and the expected
    transition counts (2, 2). ``emission`` is the score of good over bad. Chains of up to ``STEPS`` lines
    advance together line by line, longer ones by ``scan``."""
    n = len(emission)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), emission], axis=1)
    ends = np.cumsum(counts)
    if (counts > STEPS).any():
        long = np.repeat(counts > STEPS, counts)
        alpha[long], beta[long] = long_chains(score[long], counts[counts > STEPS], transition)
    few = np.flatnonzero(counts <= STEPS)
    order = few[np.argsort(-counts[few], kind="stable")]
    starts, sizes = (ends - counts)[order], counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    alpha[starts] = score[starts]
    for t in range(1, longest):
        at = starts[: active[t]] + t
        last = alpha[at - 1]
        for k in (0, 1):
            alpha[at, k] = _log_sum(last[:, 0] + transition[0, k], last[:, 1] + transition[1, k]) + score[at, k]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        following = beta[at + 1] + score[at + 1]
        for k in (0, 1):
            beta[at, k] = _log_sum(transition[k, 0] + following[:, 0], transition[k, 1] + following[:, 1])
    norm = _log_sum(alpha[ends - 1, 0], alpha[ends - 1, 1])
    whole = np.repeat(norm, counts)
    good = np.exp(alpha[:, 1] + beta[:, 1] - whole)
    pairs = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    for j in (0, 1):
        for k in (0, 1):
            pairs[j, k] = np.exp(alpha[at, j] + transition[j, k] + score[at + 1, k] + beta[at + 1, k] - whole[at]).sum()
    return good, norm, pairs


@dataclass
class LineField:
    weights: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def share(self, lines: Lines) -> np.ndarray:
        """Length-weighted marginal of good lines for each text; plain mean if all lines are empty."""
        good, _, _ = forward_backward(with_neighbours(lines) @ self.weights, lines.counts, self.transition)
        text = np.repeat(np.arange(len(lines.counts)), lines.counts)
        weight = lines.lengths + 1e-6
        return np.bincount(text, good * weight, len(lines.counts)) / np.bincount(text, weight, len(lines.counts))

    def score(self, lines: Lines) -> np.ndarray:
        s = np.clip(self.share(lines), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(s / (1 - s)) + self.offset, -40, 40)))


def fit_field(lines: Lines, labels: np.ndarray, rounds: int = 150, lam: float = 1e-3) -> LineField:
    """Maximum likelihood by adaptive gradients, both labels weighted alike; then a logistic curve."""
    x = with_neighbours(lines)
    y = np.repeat(labels, lines.counts).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines.counts) - 1] = False
    at = np.flatnonzero(inner)
    per_chain = 1 / np.maximum(lines.counts, 1)  # a long document counts as one
    weight = np.repeat(per_chain, lines.counts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    w, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    size = len(w) + 4
    m, v = np.zeros(size), np.zeros(size)
    for r in range(1, rounds + 1):
        good, _, pairs = forward_backward(x @ w, lines.counts, transition)
        g = np.concatenate([x.T @ (weight * (good - y)) / len(lines.counts) + lam * w, ((pairs - seen) / max(1, len(at))).ravel() + 0.05 * transition.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        w, transition = w - step[:-4], transition - step[-4:].reshape(2, 2)
    field = LineField(w, transition)
    s = np.clip(field.share(lines), 1e-6, 1 - 1e-6)
    z = np.log(s / (1 - s))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression in one variable
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        h = p * (1 - p) + 1e-6
        grad = np.array([((p - labels) * z).sum() + 0.1 * (a - 1), (p - labels).sum()])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
    return LineField(w, transition, float(max(a, 1e-3)), float(b))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column(1):
            lines = line_features([t.as_py()])
            rows.append((lines.features.astype(np.float32).tobytes(), lines.lengths.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["quality", "features", "lengths"])


def fit_quality(docs: DataFrame, labels: DataFrame, total: int = SAMPLE_TOTAL) -> LineField | None:
    """Fits on a bounded sample of labelled documents that aren't held out; None unless both labels occur.

    Rows without a label are ignored; of several labels of one document the lowest counts. A sampled document
    of more than ``SAMPLE_LINES`` lines isn't fitted on, so that what is gathered is bounded; scores are of whole texts.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = sample_ids(known, "quality", total, 1)
    own = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")  # at most total rows
    own = own.where(F.col("text").isNull() | (F.size(F.split(F.col("text").cast("string"), "\n", SAMPLE_LINES + 1)) <= SAMPLE_LINES))
    rows = own.select("quality", "text").mapInArrow(_sample_features, "quality int, features binary, lengths binary").collect()
    rows.sort(key=lambda r: (r["quality"], r["lengths"], r["features"]))
    if len({r["quality"] for r in rows}) < 2:
        return None
    lengths = [np.frombuffer(r["lengths"], np.int64) for r in rows]
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in rows]).astype(float)
    lines = Lines(features, np.concatenate(lengths), np.array([len(x) for x in lengths]))
    return fit_field(lines, np.array([float(r["quality"] > 0) for r in rows]))


def _scorer(field: LineField | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, texts in runs(t.as_py() for t in batch.column(2)):
                scores.append(field.score(line_features(texts)) if field else np.full(len(texts), 0.5))
            found = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return score


def score_quality(docs: DataFrame, field: LineField | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from the whole text alone.

    Null texts are scored as empty ones (a single empty line); without a model every score is 0.5.
    Repeated rows are scored alike; a null id counts as not held out. A text of any length and any number of lines is one
    chain; a batch holds the features of its lines, some 350 bytes each. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_scorer(field), "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
