"""Scenario training: epochs of mini-batches over Spark rows, a stored checkpoint and log row for every epoch.

All units (scenario and weight seed) of a split are trained in the same passes. In an epoch every shard of rows takes each
unit from its last state through the shard's mini-batches, and Spark averages the states by the number of rows.
Validation counts label and prediction in cells. What reaches the driver is a state and 25 cells a unit, never rows.

Units are linear heads on the embedding, with a softmax (``ce``) or an ordinal chain (``corn``), as encoders need weights that
aren't here; schedule, patience, selection by epoch, checkpoints and resumption are those of full training.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import confident, splitting
from ratelens.operators.lineage import missing_units
from ratelens.operators.oof_store import LineageError, Provider, lineage
from ratelens.operators.significance import best_epoch
from ratelens.plans.config import NUM_CLASSES, SCENARIOS, WEIGHT_SEEDS, scenario_by_name
from ratelens.sources.store import read_partitions, replace_partitions

UNIT = ("scenario", "weight_seed")
LOG_SCHEMA = "scenario string, weight_seed int, n_train long, rate double, loss double, mae double, qwk double, stopped boolean, heads array<double>, m array<double>, v array<double>, sha256 string, lineage string, split_seed int, epoch int"
PREDICTION_SCHEMA = "review_id long, y_true int, y_pred int, split_seed int, scenario string, weight_seed int"


@dataclass(frozen=True)
class Recipe:
    """Epochs, mini-batch, peak rate, decoupled weight decay, share of steps that warm up, epochs without a lower error, rows of a shard."""

    epochs: int = 10
    batch: int = 16
    rate: float = 0.01
    decay: float = 0.01
    warm_up: float = 0.1
    patience: int = 3
    shard_rows: int = 20_000


@dataclass
class State:
    """Weights of a unit (outputs by inputs, the intercept last) and its running moments; ``step`` counts a shard's mini-batches."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(np.ascontiguousarray(self.w, "<f8").tobytes()).hexdigest()


def outputs(loss: str) -> int:
    return NUM_CLASSES if loss == "ce" else NUM_CLASSES - 1


def fresh(loss: str, seed: int, width: int) -> State:
    w = np.random.default_rng([seed, width]).normal(0, 0.02, (outputs(loss), width + 1))
    w[:, -1] = 0.0
    return State(w, np.zeros_like(w), np.zeros_like(w))


def rate_at(step: int, total: int, recipe: Recipe) -> float:
    """Up in a line over the first steps, then down in a line to 0; steps count from 1."""
    warm = max(1, round(total * recipe.warm_up))
    return recipe.rate * (step / warm if step <= warm else max(0.0, (total - step) / max(1, total - warm)))


def gradient(w: np.ndarray, x: np.ndarray, label: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """Mean loss of a mini-batch and its gradient; a threshold of the chain learns from the rows that reach it."""
    z = x @ w.T
    if loss == "ce":
        z = z - z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        value = -np.log(np.maximum(p[np.arange(len(x)), label], 1e-300)).mean()
        p[np.arange(len(x)), label] -= 1
        return float(value), p.T @ x / len(x)
    at = np.arange(w.shape[0])
    reached, above = label[:, None] >= at, label[:, None] > at
    n = max(1, int(reached.sum()))
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    value = (np.logaddexp(0, z) - above * z)[reached].sum() / n
    return float(value), np.where(reached, p - above, 0.0).T @ x / n


def train_shard(state: State, x: np.ndarray, label: np.ndarray, loss: str, seed: int, shard: int, epoch: int, recipe: Recipe) -> tuple[State, float]:
    """One epoch over a shard's rows, which are in the order of their ids; the shuffle depends on seed, shard and epoch alone."""
    order = np.random.default_rng([seed, shard, epoch]).permutation(len(x))
    per = -(-len(x) // recipe.batch)
    w, m, v, total = state.w.copy(), state.m.copy(), state.v.copy(), 0.0
    for i in range(per):
        own = order[i * recipe.batch : (i + 1) * recipe.batch]
        value, g = gradient(w, x[own], label[own], loss)
        total += value * len(own)
        step = (epoch - 1) * per + i + 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = rate_at(step, recipe.epochs * per, recipe)
        w = w - rate * (recipe.decay * w + (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return State(w, m, v), total / max(1, len(x))


def decode(w: np.ndarray, x: np.ndarray, loss: str) -> np.ndarray:
    """Ratings from 1: the likeliest class, or the number of thresholds passed with more than a half."""
    z = x @ w.T
    if loss == "ce":
        return z.argmax(1) + 1
    return (np.cumprod(1 / (1 + np.exp(-np.clip(z, -500, 500))), axis=1) > 0.5).sum(1) + 1


def training_rows(df: DataFrame, split_seed: int, provider: Provider) -> DataFrame:
    """``review_id, rating, embedding, part, is_noise, is_noise_severe`` of a split; flags are estimated on the training part alone."""
    parts = splitting.grouped_split(df.withColumn("_id", F.col("review_id").cast("string")), split_seed, text="_id")
    rows = df.join(parts.select(F.col("_id").cast("long").alias("review_id"), "part"), "review_id")
    train = rows.where("part = 'train'").withColumn("label", F.col("rating") - 1).drop("part")
    flags = confident.detect(provider(train, 3, 5)[0]).select("review_id", "is_noise", "is_noise_severe")
    return rows.join(flags, "review_id", "left")


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.hstack([np.stack(batch["embedding"].to_numpy()).astype(float), np.ones((len(batch), 1))])


def _variant(batch: pd.DataFrame, variant: str) -> np.ndarray:
    gone = {"raw": None, "hard": "is_noise", "severe": "is_noise_severe"}[variant]
    return np.ones(len(batch), bool) if gone is None else ~batch[gone].fillna(False).to_numpy(bool)


Unit = tuple[str, int]


def _epoch(train: DataFrame, states: dict[Unit, State], epoch: int, recipe: Recipe) -> tuple[dict[Unit, State], dict[Unit, tuple[int, float]]]:
    """States after one epoch, averaged over shards by their rows, and rows and mean loss of each unit."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch, shard = batch.sort_values("review_id"), int(batch["shard"].iloc[0])
        x, label, out = _matrix(batch), batch["rating"].to_numpy() - 1, []
        for (name, seed), state in states.items():
            known = scenario_by_name(name)
            own = _variant(batch, known["variant"])
            if own.any():
                after, loss = train_shard(state, x[own], label[own], known["loss"], seed, shard, epoch, recipe)
                n = int(own.sum())
                out.append((name, seed, n, [float(n), n * loss, *(n * np.concatenate([a.ravel() for a in (after.w, after.m, after.v)]))]))
        return pd.DataFrame(out, columns=["scenario", "weight_seed", "n", "sums"])

    told = train.groupBy("shard").applyInPandas(run, "scenario string, weight_seed int, n long, sums array<double>")
    each = told.select(*UNIT, F.posexplode("sums").alias("at", "s")).groupBy(*UNIT, "at").agg(F.sum("s").alias("s"))
    found = each.groupBy(*UNIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("sums"))
    after, facts = dict(states), {}
    for r in found.collect():  # a state a unit
        unit, sums = (r["scenario"], r["weight_seed"]), np.array(r["sums"])
        w, m, v = (a.reshape(states[unit].w.shape) for a in np.split(sums[2:] / sums[0], 3))
        after[unit], facts[unit] = State(w, m, v), (int(sums[0]), float(sums[1] / sums[0]))
    return after, facts


def _scorer(states: dict[Unit, State], emit: Callable[[Unit, pd.DataFrame, np.ndarray], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                for unit, state in states.items():
                    yield emit(unit, batch, decode(state.w, x, scenario_by_name(unit[0])["loss"]))

    return run


def validate(rows: DataFrame, states: dict[Unit, State]) -> dict[Unit, tuple[float | None, float | None]]:
    """Error and kappa of every unit, from its cells of label and prediction; null without rows or where undefined."""

    def cells(unit: Unit, batch: pd.DataFrame, p: np.ndarray) -> pd.DataFrame:
        n = np.bincount((batch["rating"].to_numpy() - 1) * NUM_CLASSES + p - 1, minlength=NUM_CLASSES**2)
        at = np.flatnonzero(n)
        return pd.DataFrame({"scenario": unit[0], "weight_seed": unit[1], "y": at // NUM_CLASSES + 1, "p": at % NUM_CLASSES + 1, "n": n[at]})

    long = rows.select("rating", "embedding").mapInPandas(_scorer(states, cells), "scenario string, weight_seed int, y int, p int, n long")
    y, p, n = (F.col(c).cast("double") for c in ("y", "p", "n"))
    chance = F.sum(n * y * y) + F.sum(n * p * p) - 2.0 * F.sum(n * y) * F.sum(n * p) / F.sum(n)
    qwk = 1.0 - F.sum(n * (y - p) * (y - p)) / F.nullif(chance, F.lit(0.0))
    found = long.groupBy(*UNIT).agg((F.sum(n * F.abs(y - p)) / F.sum(n)).alias("mae"), qwk.alias("qwk")).collect()  # a row a unit
    told = {(r["scenario"], r["weight_seed"]): (r["mae"], r["qwk"]) for r in found}
    return {u: told.get(u, (None, None)) for u in states}


@dataclass
class Trainer:
    """Trains the units of a split below ``path`` and stores log, checkpoints and test predictions there."""

    path: str
    split_seed: int
    recipe: Recipe = Recipe()
    scenarios: Sequence[str] = tuple(s["name"] for s in SCENARIOS)
    seeds: Sequence[int] = WEIGHT_SEEDS

    def log(self, spark: SparkSession) -> DataFrame:
        """The stored rows of this split: a row for each unit and epoch, with its checkpoint."""
        return read_partitions(spark, f"{self.path}/log", LOG_SCHEMA).where(F.col("split_seed") == self.split_seed)

    def predictions(self, spark: SparkSession) -> DataFrame:
        """``scenario, weight_seed, review_id, y_true, y_pred`` of the units that are done."""
        stored = read_partitions(spark, f"{self.path}/predictions", PREDICTION_SCHEMA)
        return stored.where(F.col("split_seed") == self.split_seed).select(*UNIT, "review_id", "y_true", "y_pred")

    def todo(self, spark: SparkSession) -> list[Unit]:
        wanted = spark.createDataFrame([(s, w) for s in self.scenarios for w in self.seeds], "scenario string, weight_seed int")
        return sorted((r["scenario"], r["weight_seed"]) for r in missing_units(self.predictions(spark), wanted).collect())

    def load(self, rows: Sequence, width: int) -> dict[Unit, State]:
        """States from log rows; weights whose hash isn't the stored one raise ``LineageError``."""
        out = {}
        for r in rows:
            shape = (outputs(scenario_by_name(r["scenario"])["loss"]), width + 1)
            state = State(*(np.array(r[c]).reshape(shape) for c in ("heads", "m", "v")))
            if state.sha256 != r["sha256"]:
                raise LineageError(f"checkpoint of {r['scenario']}, {r['weight_seed']}, epoch {r['epoch']} in {self.path} isn't what was written")
            out[r["scenario"], r["weight_seed"]] = state
        return out

    def run(self, rows: DataFrame) -> DataFrame:
        """Trains what isn't done over ``training_rows`` and returns the predictions of all units.

        Epochs that the log has are not trained again: units go on from their last checkpoint, which holds all that the next
        epoch needs, so an interrupted run ends as an unbroken one. A unit stops after ``patience`` epochs without
        a lower validation error; its checkpoint of highest kappa (then lowest error, then earliest) predicts the test rows.
        Logs of other training rows raise ``LineageError``. Without training rows nothing is trained or predicted.
        """
        spark, todo = rows.sparkSession, self.todo(rows.sparkSession)
        first = rows.where("part = 'train'").select("embedding").first() if todo else None
        if first is None:
            return self.predictions(spark)
        width, mark = len(first["embedding"]), lineage(rows, ("review_id", "rating", "embedding", "part", "is_noise", "is_noise_severe"))
        train = rows.where("part = 'train'")
        shards = max(1, -(-train.count() // self.recipe.shard_rows))
        train = train.withColumn("shard", F.pmod(F.xxhash64("review_id"), F.lit(shards)).cast("int")).cache()
        held = rows.where("part = 'val'").cache()
        try:
            self._epochs(train, held, todo, width, mark)
        finally:
            train.unpersist()
            held.unpersist()
        best = best_epoch(self.log(spark).where(F.col("lineage") == mark), UNIT).select(*UNIT, "epoch")
        chosen = self.load(self.log(spark).join(F.broadcast(best), [*UNIT, "epoch"]).collect(), width)  # a row a unit
        chosen = {u: s for u, s in chosen.items() if u in set(todo)}

        def told(unit: Unit, batch: pd.DataFrame, p: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"review_id": batch["review_id"], "y_true": batch["rating"], "y_pred": p, "split_seed": self.split_seed, "scenario": unit[0], "weight_seed": unit[1]})

        test = rows.where("part = 'test'").select("review_id", "rating", "embedding")
        replace_partitions(test.mapInPandas(_scorer(chosen, told), PREDICTION_SCHEMA), f"{self.path}/predictions", ("split_seed", *UNIT))
        return self.predictions(spark)

    def _epochs(self, train: DataFrame, held: DataFrame, todo: list[Unit], width: int, mark: str) -> None:
        spark = train.sparkSession
        logged = [r for r in self.log(spark).select("lineage", "epoch", "stopped", "mae", *UNIT).collect() if (r["scenario"], r["weight_seed"]) in set(todo)]  # a row a unit and epoch
        if {r["lineage"] for r in logged} - {mark}:
            raise LineageError(f"the log in {self.path} comes from other training rows")
        last = {u: max((r["epoch"] for r in logged if (r["scenario"], r["weight_seed"]) == u), default=0) for u in todo}
        done = {(r["scenario"], r["weight_seed"]) for r in logged if r["stopped"]}
        errors = {u: [r["mae"] for r in sorted(logged, key=lambda r: r["epoch"]) if (r["scenario"], r["weight_seed"]) == u] for u in todo}
        states = {u: fresh(scenario_by_name(u[0])["loss"], u[1], width) for u in todo}
        if any(last.values()):
            ends = spark.createDataFrame([(*u, e) for u, e in last.items()], "scenario string, weight_seed int, epoch int")
            states |= self.load(self.log(spark).join(F.broadcast(ends), [*UNIT, "epoch"]).collect(), width)
        for epoch in range(1, self.recipe.epochs + 1):
            now = {u: s for u, s in states.items() if u not in done and last[u] == epoch - 1}
            if not now:
                continue
            after, facts = _epoch(train, now, epoch, self.recipe)
            scores, out = validate(held, after), []
            for u, state in after.items():
                mae, qwk = scores[u]
                errors[u].append(mae)
                states[u], last[u] = state, epoch
                known = [e for e in errors[u] if e is not None]
                since = len(errors[u]) - 1 - errors[u].index(min(known)) if known else 0
                stopped = since >= self.recipe.patience or epoch == self.recipe.epochs
                if stopped:
                    done.add(u)
                n, loss = facts.get(u, (0, None))
                rate = rate_at(max(1, -(-n // self.recipe.batch)) * epoch, max(1, -(-n // self.recipe.batch)) * self.recipe.epochs, self.recipe)
                out.append((*u, n, rate, loss, mae, qwk, stopped, state.w.ravel().tolist(), state.m.ravel().tolist(), state.v.ravel().tolist(), state.sha256, mark, self.split_seed, epoch))
            replace_partitions(spark.createDataFrame(out, LOG_SCHEMA), f"{self.path}/log", ("split_seed", *UNIT, "epoch"))


def log_table(trainer: Trainer, spark: SparkSession) -> DataFrame:
    """The log without its weights: ``scenario, weight_seed, epoch, n_train, rate, loss, mae, qwk, stopped, sha256``."""
    return trainer.log(spark).select(*UNIT, "epoch", "n_train", "rate", "loss", "mae", "qwk", "stopped", "sha256")
