"""Stored out-of-fold rows: fitted once, guarded by a hash of the training rows, resumed fold by fold.

One Parquet table holds the rows of all proxies, partitioned by (proxy, k, fold). Every row carries the lineage of the
training rows that it was fitted on, its fold's temperature and losses, so a partition is complete in itself; a
fold counts as finished if its partition has as many rows as the deal gives it.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.operators import models
from ratelens.operators.lineage import fingerprint
from ratelens.operators.splitting import stratified_kfold
from ratelens.plans.config import CV_FOLDS, CV_SEED, NUM_CLASSES
from ratelens.sources.store import read_partitions, replace_partitions

PARTITIONS = ("proxy", "k", "fold")
SCHEMA = "review_id long, label int, probs array<double>, q_chain array<double>, temperature double, nll_before double, nll_after double, seconds double, lineage string, proxy string, k int, fold int"
#: What a provider gives: out-of-fold rows, and a temperature for each fold (none where the proxy has none).
Provider = Callable[[DataFrame, int, int], tuple[DataFrame, dict[int, float]]]


class LineageError(RuntimeError):
    """Stored rows come from other training rows."""


def lineage(df: DataFrame, columns: Sequence[str] = ("review_id", "label", "embedding")) -> str:
    """A hash of the training rows, whatever their order: ids, labels and vectors, from one aggregation."""
    return hashlib.sha256(json.dumps(fingerprint(df.select(*columns)), sort_keys=True).encode()).hexdigest()


@dataclass
class OofStore:
    """Out-of-fold rows below ``path``. ``fitted`` lists what this object had to fit, as (proxy, k, folds)."""

    path: str
    classes: int = NUM_CLASSES
    fitted: list[tuple[str, int, tuple[int, ...]]] = field(default_factory=list)

    def rows(self, df: DataFrame, proxy_id: int, k: int) -> DataFrame:
        """The stored rows of one proxy and fold count; only its partitions are read."""
        stored = read_partitions(df.sparkSession, self.path, SCHEMA)
        return stored.where((F.col("proxy") == models.PROXIES[proxy_id][0]) & (F.col("k") == k))

    def finished(self, df: DataFrame, proxy_id: int, k: int, mark: str) -> DataFrame:
        """``fold`` of the partitions that hold all their rows; rows of other lineage raise ``LineageError``."""
        stored = self.rows(df, proxy_id, k).groupBy("fold", "lineage").agg(F.count("*").alias("n"))
        others = stored.where(F.col("lineage") != mark).select("fold").distinct().orderBy("fold").collect()  # k rows at most
        if others:
            raise LineageError(f"{models.PROXIES[proxy_id][0]} with {k} folds: folds {[r['fold'] for r in others]} in {self.path} come from other training rows")
        deal = stratified_kfold(df.select("review_id", "label"), k, CV_SEED, "label").groupBy("fold").agg(F.count("*").alias("n"))
        return deal.join(stored.select("fold", "n"), ["fold", "n"], "left_semi").select("fold")

    def missing(self, df: DataFrame, proxy_id: int, k: int, mark: str) -> list[int]:
        """Folds that are still to be fitted: those dealt but not finished."""
        wanted = df.sparkSession.createDataFrame([(i,) for i in range(k)], "fold int")
        left = wanted.join(self.finished(df, proxy_id, k, mark), "fold", "left_anti")
        return sorted(r["fold"] for r in left.collect())  # k rows at most

    def get(self, df: DataFrame, proxy_id: int, k: int = CV_FOLDS) -> tuple[DataFrame, dict[int, float]]:
        """Out-of-fold rows of a proxy over ``review_id, rating, label, embedding``, and its temperatures.

        Folds that are there are read, the others fitted together and written, each into its own partition. An empty table
        gives no rows and leaves nothing behind.
        """
        mark = lineage(df)
        name = models.PROXIES[proxy_id][0]
        left = self.missing(df, proxy_id, k, mark)
        if left:
            begun = time.monotonic()
            oof, temperatures = models.proxy_oof(df, proxy_id, k, self.classes, only=left)
            told = oof.sparkSession.createDataFrame([(f, t, *models.losses_of(temperatures).get(f, (None, None))) for f, t in temperatures.items()], "fold int, temperature double, nll_before double, nll_after double")
            known = oof.join(F.broadcast(told), "fold", "left")  # k rows
            chain = F.col("q_chain") if "q_chain" in oof.columns else F.lit(None).cast("array<double>")
            values = {"q_chain": chain, "lineage": F.lit(mark), "proxy": F.lit(name), "k": F.lit(k), "seconds": F.lit(time.monotonic() - begun)}
            columns = [c.split()[0] for c in SCHEMA.split(", ")]
            types = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
            out = known.withColumns(values).select(*(F.col(c).cast(types[c]).alias(c) for c in columns))
            replace_partitions(out, self.path, PARTITIONS)
            self.fitted.append((name, k, tuple(left)))
            dealt = {r["fold"] for r in oof.select("fold").distinct().collect()}  # with fewer rows than folds some are empty
            if still := dealt & set(self.missing(df, proxy_id, k, mark)):
                raise OSError(f"{name} with {k} folds: folds {sorted(still)} in {self.path} are incomplete after writing")
        rows = self.rows(df, proxy_id, k)
        per = rows.groupBy("fold").agg(F.max("temperature").alias("t")).where("t is not null").collect()  # k rows
        kept = df.drop("embedding", "label").join(rows.select("review_id", "label", "fold", "probs", *(["q_chain"] if proxy_id == models.FINAL_PROXY else [])), "review_id")
        return kept, {r["fold"]: r["t"] for r in per}

    def progress(self, spark) -> DataFrame:
        """``proxy, k, fold, n, temperature, nll_before, nll_after, seconds``: a row for each stored fold."""
        stored = read_partitions(spark, self.path, SCHEMA)
        facts = ("temperature", "nll_before", "nll_after", "seconds")
        return stored.groupBy(*PARTITIONS).agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in facts))
