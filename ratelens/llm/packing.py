"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are tokenised once; whole windows are cut off and the remainders counted by length, in
units of a few tokens. All combinations of up to ``depth`` lengths that fill a window exactly are
enumerated, their repeat counts solved against the histogram by non-negative least squares and
rounded; what is left is packed greedily, largest first. All of that sees only the histogram, which
has as many entries as a window has units, so the driver's work doesn't grow with the corpus. The
plan says which ranks of each length go where, and a rank is computed for each piece from counts by
partition, so no task ever sees more than its own pieces and then one sequence at a time.
"""

from __future__ import annotations

import contextlib
import json
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.llm._common import WORD, materialize, release, runs, table

CAPACITY, UNIT, DEPTH, EOS = 4096, 16, 3, 2
#: Offsets (a row for each length unit and partition) are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_OFFSETS = 100_000


#: Latin-1 letters (lower case), numbers and white space as the word BPE's pattern sees them.
LETTERS, NUMBERS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
#: That pattern over lower-cased Latin-1 text: contractions, words, single digits, runs of anything else.
PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


# How a tokenizer file says that it folds case, drops white space and cuts by that pattern.
WORD_BPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def is_word_bpe(path: str) -> bool:
    """Whether ``TokenIds`` is exact for a tokenizer file: its steps are known, and no special token can hide in a word."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = found.get("model") or {}
    same = all(found.get(k) == v for k, v in WORD_BPE.items())
    return same and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and all(t["content"].startswith("<|") for t in found.get("added_tokens") or [])


class PlainIds:
    """Token ids of whole texts by any tokenizer file, as little-endian bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)

    @staticmethod
    def parts(text: str | None) -> list[str]:
        return [text] if text else []

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        texts = list(parts)
        return {t: np.asarray(e.ids, "<u4").tobytes() for t, e in zip(texts, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)}


class TokenIds:
    """Token ids of parts of texts, as little-endian bytes, with a bounded cache.

    Exact where the tokenizer folds case, drops white space and encodes each match of its pattern by
    itself, as the word BPE does. Latin-1 texts are cut by that pattern; others, and texts that may
    hold a special token, at white space, and their chunks are left to the tokenizer. Parts met after
    the cache is full are encoded but not kept.
    """

    LIMIT = 450_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kept: dict[str, bytes] = {}
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._ends[[i for w, i in self._tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    @staticmethod
    def parts(text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text:
            if text.isascii():
                return PARTS.findall(text.lower())
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return PARTS.findall(text.lower())
        return WORD.findall(text)

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        encoded = self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: np.asarray(e.ids, "<u4").tobytes() for c, e in zip(chunks, encoded, strict=True)}

    def _encode_words(self, plain: list[str]) -> dict[str, bytes]:
        """Words of letters, many to a text: each one's ids end with the only token that ends a word."""
        out: dict[str, bytes] = {}
        for start in range(0, len(plain), 1000):
            part = plain[start : start + 1000]
            ids = np.asarray(self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out |= {c: raw[i:j] for c, i, j in zip(part, [0, *ends[:-1]], ends, strict=True)}
        return out

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """A mapping that has all of ``parts``."""
        kept = self._kept
        new = [c for c in parts if c not in kept]
        if not new:
            return kept
        plain = [c for c in new if c.isalpha() and (c.isascii() or max(c) <= "\xff")]
        fresh = self._encode_words(plain)
        fresh |= self._encode([c for c in new if c not in fresh])
        if len(kept) + len(fresh) <= self.LIMIT:
            kept |= fresh
            return kept
        return {c: fresh[c] if c in fresh else kept[c] for c in parts}


_caches: dict[str, TokenIds | PlainIds] = {}


def token_ids(path: str) -> TokenIds | PlainIds:
    """One cache per worker process, kept over its tasks."""
    if path not in _caches:
        _caches[path] = TokenIds(path) if is_word_bpe(path) else PlainIds(path)
    return _caches[path]


def _cutter(path: str, capacity: int, unit: int, eos: int, with_ids: bool):
    tail = np.asarray([eos], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = token_ids(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(-(-capacity // unit) + 1, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in runs(x.as_py() for x in batch.column(1)):
                rows: list[tuple] = []
                origin: list[int] = []
                found = [cache.parts(text) for text in texts]
                ids_of = cache.learn(set().union(*found)).__getitem__
                for k, parts in enumerate(found):
                    raw = b"".join([*map(ids_of, parts), tail])
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        n = len(part) // 4
                        u = -(-n // unit)
                        rows.append((start, n, zlib.crc32(part), total, u, task, int(seen[u]), *((part,) if with_ids else ())))
                        origin.append(first + k)
                        seen[u] += 1
                names = ["start", "length", "ids_crc32", "doc_tokens", "unit", "task", "nth", *(("ids",) if with_ids else ())]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(origin, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])
        release()

    return cut


def combinations(units: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` lengths that add up to ``units``, one column of counts each."""
    found = []
    for parts in range(1, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, units + 1), parts - 1):
            last = units - sum(head)
            if last >= (head[-1] if head else 1):
                found.append((*head, last))
    matrix = np.zeros((units + 1, len(found)))
    for column, lengths in enumerate(found):
        for length in lengths:
            matrix[length, column] += 1
    return matrix


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares by an active set: the variable with the steepest gradient joins the
    passive set, and a step is shortened where it would make a passive one negative."""
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], bool)
    scale = float(np.abs(b).max()) or 1.0
    b = b / scale
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            s = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(at)), own.T @ b)
            low = s <= 0
            if not low.any():
                x[:] = 0
                x[at] = s
                break
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            moved = old + step * (s - old)
            moved[low & (moved <= tolerance)] = 0
            x[:] = 0
            x[at] = np.maximum(moved, 0)
            passive[at[x[at] <= 0]] = False
            if not passive.any():
                break
    return x * scale


@dataclass(frozen=True)
class Plan:
    """For each length: the first rank of each share, how many fit in a sequence, the first sequence
    and slot. ``sequences`` is their total number."""

    shares: dict[int, np.ndarray]
    sequences: int

    def place(self, unit: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, each, sequence, slot = self.shares[unit]
        at = np.searchsorted(first, rank, side="right") - 1
        within = rank - first[at]
        return sequence[at] + within // each[at], slot[at] + within % each[at]


def make_plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> Plan:
    left = np.zeros(units + 1, np.int64)
    for u, n in histogram.items():
        left[u] = n
    chosen: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(int(left[u]) // m for u, m in pattern.items())])
        if times > 0:
            chosen.append((pattern, times))
            for u, m in pattern.items():
                left[u] -= m * times

    take({units: 1}, int(left[units]))
    if left.any():
        matrix = combinations(units, depth)
        usable = ((matrix > 0) <= (left > 0)[:, None]).all(axis=0)
        matrix = matrix[:, usable]
        if matrix.shape[1]:
            repeats = np.rint(nnls(matrix, left.astype(float))).astype(np.int64)
            for column in np.argsort(-repeats, kind="stable"):
                if repeats[column] > 0:
                    take({int(u): int(matrix[u, column]) for u in np.flatnonzero(matrix[:, column])}, int(repeats[column]))
    while left.any():
        space, pattern = units, {}
        for u in np.flatnonzero(left)[::-1]:
            if m := min(int(left[u]), space // int(u)):
                pattern[int(u)] = m
                space -= m * int(u)
        take(pattern, int(left.max()))
    shares: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in chosen:
        slot = 0
        for u, m in sorted(pattern.items(), reverse=True):
            shares.setdefault(u, []).append((used.get(u, 0), m, sequence, slot))
            used[u] = used.get(u, 0) + m * times
            slot += m
        sequence += times
    return Plan({u: np.array(s, np.int64).T.copy() for u, s in shares.items()}, sequence)


def _placer(plan: Plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("unit").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, slot = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
            for u in np.unique(unit):
                at = unit == u
                sequence[at], slot[at] = plan.place(int(u), rank[at])
            kept = [n for n in batch.schema.names if n not in ("unit", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(slot)], [*kept, "sequence_id", "slot"])

    return place


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT, depth: int = DEPTH, eos: int = EOS, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids``, little-endian 32-bit, if ``with_ids``).

    Null and empty texts are one piece with the end id alone. Documents of any length are cut into
    windows and a remainder; rows with the same id are packed as documents of their own. An empty
    table gives no pieces. Only the id and text columns are read.
    """
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, unit int, task int, nth long"
    pieces = materialize(source.mapInArrow(_cutter(tokenizer_path, capacity, unit, eos, with_ids), schema + extra), "pieces")
    counts = materialize(pieces.groupBy("unit", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r["unit"]: r["n"] for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect()}  # one row a unit
    plan = make_plan(histogram, capacity // unit, depth)
    before = Window.partitionBy("unit").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("unit", "task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    small = counts.count() <= BROADCAST_OFFSETS
    ranked = pieces.join(F.broadcast(offsets) if small else offsets, ["unit", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(("ids",) if with_ids else ())]
    placed_schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{extra}, sequence_id long, slot long"
    placed = ranked.select(*names, "unit", "rank").mapInArrow(_placer(plan), placed_schema)
    filled = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(filled), F.lit(0).cast("long")).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids`` from pieces that carry ids; one row is one window."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    gathered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return gathered.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
