"""Resamples drawn over distinct cells instead of rows.

All that a metric of predictions on a scale of five needs is how often each combination of label and predictions
occurs. For one hypothesis there are at most 5^(1 + 2 * seeds) of them, however many rows there are, and a resample of n
rows with replacement is one multinomial draw of n over these cells. So a bootstrap costs cells by draws, not rows by
draws, and all metrics of a hypothesis share its draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.operators.significance import NAMES, results_table, significance_table, unit, wide_predictions
from ratelens.plans.config import BOOT_SEED, HYPOTHESES, NUM_CLASSES, WEIGHT_SEEDS

#: Draws that a task makes at once: a part of the seed, as every block of draws has its own generator.
DRAWS = 50
#: Cells of a group at most: a group's cells travel as one row.
MOST_CELLS = 500_000

#: From arrays by column and counts (a row a draw, a column a cell), a value a draw for each name.
Stats = Callable[[Mapping[str, np.ndarray], np.ndarray], Mapping[str, np.ndarray]]
METRICS = ("MAE", "QWK_ensemble", "QWK_per_seed")


def kappa(y: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Quadratic kappa of every draw, from five sums; NaN where it is undefined."""
    n, sy, sp = counts.sum(1).astype(float), counts @ y, counts @ p
    chance = counts @ (y * y) + counts @ (p * p) - 2.0 * sy * sp / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(chance == 0, np.nan, 1.0 - (counts @ ((y - p) ** 2)) / chance)


def resampled(cells: DataFrame, by: str, columns: Sequence[str], stats: Stats, names: Sequence[str], n_boot: int, seed: int = BOOT_SEED) -> DataFrame:
    """``by, rep, <names>``: the statistics of every group at its own counts (rep -1) and of ``n_boot`` resamples of it.

    ``cells`` has a row for each group and combination of the numeric or array ``columns``, with its count ``n``. A group's
    cells are one row of bounded size, which meets all blocks of draws; blocks spread over the cluster. Draws depend on seed and
    block alone, so repeated runs and recomputed tasks agree. Undefined statistics are null.
    """
    size = cells.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if size > MOST_CELLS:
        raise ValueError(f"{size} cells in a group, more than {MOST_CELLS}: these columns aren't a small scale")
    blocks = -(-n_boot // DRAWS)
    packed = cells.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*columns, "n"))).alias("cells"))
    tasks = packed.withColumn("block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1)))).repartition(max(1, min(blocks, 200)), by, "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, cell, block in zip(batch[by], batch["cells"], batch["block"], strict=True):
                held = {c: np.array([x[c] for x in cell], float) for c in (*columns, "n")}
                n = held["n"].astype(np.int64)
                if block < 0:
                    reps, counts = np.array([-1]), n[None]
                else:
                    reps = np.arange(block * DRAWS, min((block + 1) * DRAWS, n_boot))
                    counts = np.random.default_rng([seed, int(block)]).multinomial(n.sum(), n / n.sum(), DRAWS)[: len(reps)]
                found = stats(held, counts)
                yield pd.DataFrame({by: [group] * len(reps), "rep": reps, **{name: found[name] for name in names}})

    schema = ", ".join([f"{by} {cells.schema[by].dataType.simpleString()}", "rep int", *(f"`{x}` double" for x in names)])
    out = tasks.mapInPandas(run, schema)
    return out.select(by, "rep", *(F.when(~F.isnan(x), F.col(x)).alias(x) for x in names))


def hypothesis_cells(wide: DataFrame, seeds: Sequence[int] = WEIGHT_SEEDS) -> DataFrame:
    """``hypothesis, y, a, b, n``: how often each combination of label and both models' predictions by seed occurs."""
    rows = F.array(*(F.struct(F.lit(name).alias("hypothesis"), "y", F.array(*(F.col(unit(a, w)) for w in seeds)).alias("a"), F.array(*(F.col(unit(b, w)) for w in seeds)).alias("b")) for name, a, b in HYPOTHESES))
    return wide.select(F.explode(rows).alias("x")).groupBy("x.hypothesis", "x.y", "x.a", "x.b").agg(F.count("*").alias("n"))


def effect_stats(seeds: Sequence[int] = WEIGHT_SEEDS) -> Stats:
    """Differences (model a less model b) of error, of the ensembles' kappa, of the kappas averaged over seeds, and by seed."""

    def stats(cell: Mapping[str, np.ndarray], counts: np.ndarray) -> dict[str, np.ndarray]:
        y, a, b = cell["y"], cell["a"], cell["b"]
        error = (np.abs(a - y[:, None]).mean(1) - np.abs(b - y[:, None]).mean(1))
        both = [np.clip(np.rint(x.mean(1)), 1, NUM_CLASSES) for x in (a, b)]
        per = [kappa(y, a[:, i], counts) - kappa(y, b[:, i], counts) for i in range(len(seeds))]
        return {"MAE": counts @ error / counts.sum(1), "QWK_ensemble": kappa(y, both[0], counts) - kappa(y, both[1], counts), "QWK_per_seed": np.mean(per, axis=0), **{f"seed_{w}": d for w, d in zip(seeds, per, strict=True)}}

    return stats


def cell_effects(wide: DataFrame, n_boot: int, seed: int = BOOT_SEED, seeds: Sequence[int] = WEIGHT_SEEDS) -> DataFrame:
    """``hypothesis, metric, diff, ci_low, ci_high, diff_<seed>``: three metrics of every hypothesis from shared draws.

    The differences by weight seed stand in the rows of ``QWK_per_seed``. Identical predictions give [0, 0]; a draw whose kappa
    is undefined is left out of the interval; an empty table gives no rows.
    """
    by_seed = [f"seed_{w}" for w in seeds]
    drawn = resampled(hypothesis_cells(wide, seeds), "hypothesis", ("y", "a", "b"), effect_stats(seeds), (*METRICS, *by_seed), n_boot, seed)
    lines = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), *((F.col(s) if m == METRICS[2] else F.lit(None).cast("double")).alias(s) for s in by_seed)) for m in METRICS))
    long = drawn.select("hypothesis", "rep", F.explode(lines).alias("x")).select("hypothesis", "rep", "x.*")
    own = lambda c: F.max(F.when(F.col("rep") < 0, F.col(c)))
    q = F.percentile(F.when(F.col("rep") >= 0, F.col("v")), F.array(F.lit(0.025), F.lit(0.975)))
    per = long.groupBy("hypothesis", "metric").agg(own("v").alias("diff"), q.alias("q"), *(own(s).alias(s) for s in by_seed))
    rounded = {"diff": F.col("diff"), "ci_low": F.col("q")[0], "ci_high": F.col("q")[1]} | {f"diff_{w}": F.col(f"seed_{w}") for w in seeds}
    return per.select("hypothesis", "metric", *(F.round(c, 9).alias(n) for n, c in rounded.items()))


def effect_points(wide: DataFrame, seeds: Sequence[int] = WEIGHT_SEEDS) -> DataFrame:
    """The differences alone, as weighted sums over the cells: ``hypothesis, metric, diff, diff_<seed>``."""
    cells = hypothesis_cells(wide, seeds)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    label = lambda c: F.least(F.greatest(F.rint(mean(F.col(c))), F.lit(1.0)), F.lit(float(NUM_CLASSES)))
    y, n = F.col("y").cast("double"), F.col("n").cast("double")

    def weighted(p: Column) -> Column:
        total = lambda c: F.sum(n * c)
        chance = total(y * y) + total(p * p) - 2.0 * total(y) * total(p) / F.sum(n)
        return 1.0 - total((y - p) * (y - p)) / F.nullif(chance, F.lit(0.0))

    error = lambda c: mean(F.transform(c, lambda p: F.abs(p - F.col("y")).cast("double")))
    per = [(weighted(F.col("a")[i].cast("double")) - weighted(F.col("b")[i].cast("double"))).alias(f"seed_{w}") for i, w in enumerate(seeds)]
    row = cells.groupBy("hypothesis").agg((F.sum(n * (error("a") - error("b"))) / F.sum(n)).alias(METRICS[0]), (weighted(label("a")) - weighted(label("b"))).alias(METRICS[1]), *per)
    total = F.col(f"seed_{seeds[0]}")
    for w in seeds[1:]:
        total = total + F.col(f"seed_{w}")
    row = row.withColumn(METRICS[2], total / len(seeds))
    lines = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("diff"), *((F.round(f"seed_{w}", 9) if m == METRICS[2] else F.lit(None).cast("double")).alias(f"diff_{w}") for w in seeds)) for m in METRICS))
    return row.select("hypothesis", F.explode(lines).alias("x")).select("hypothesis", "x.*")


def effect_long(wide: DataFrame, n_boot: int, split_seed: int, seeds: Sequence[int] = WEIGHT_SEEDS, tests: DataFrame | None = None) -> DataFrame:
    """Fifteen rows: five hypotheses by three metrics, test columns on the MAE rows alone."""
    tested = (significance_table(wide) if tests is None else tests).select("hypothesis", "model_a", "model_b", "z", "p", "p_holm", "significant")
    joined = cell_effects(wide, n_boot, seeds=seeds).join(F.broadcast(tested), "hypothesis")  # five rows
    mae = F.col("metric") == METRICS[0]
    return joined.withColumns({c: F.when(mae, F.col(c)) for c in ("z", "p", "p_holm", "significant")} | {"split_seed": F.lit(split_seed), "n_weight_seeds": F.lit(len(seeds))})


#: The tables of a suite, by name.
SUITE = ("final_results", "significance", "effects_mae", "effects_qwk_ensemble", "effects_qwk_per_seed", "effects_long")


def significance_suite(long: DataFrame, folder: str, n_boot: int, split_seed: int, scenarios: Sequence[str] = NAMES, seeds: Sequence[int] = WEIGHT_SEEDS) -> dict[str, str]:
    """Writes the six tables of a split once and tells for each whether it was written or was there already.

    The wide table is cached for the pass, tests and effects are computed once, and the three effect tables are cuts
    of the long one. A second run over the same predictions changes nothing; one over others raises ``FileExistsError``.
    """
    from ratelens.operators.lineage import write_once

    wide = wide_predictions(long, scenarios, seeds).cache()
    try:
        tests = significance_table(wide).cache()
        effects = effect_long(wide, n_boot, split_seed, seeds, tests).coalesce(1).cache()
        cut = lambda m, *more: effects.where(F.col("metric") == m).select("hypothesis", "model_a", "model_b", "diff", "ci_low", "ci_high", *more)
        tables = (
            results_table(long),
            tests,
            cut(METRICS[0]),
            cut(METRICS[1]),
            cut(METRICS[2], *(f"diff_{w}" for w in seeds)),
            effects,
        )
        return {name: write_once(df, f"{folder.rstrip('/')}/{name}") for name, df in zip(SUITE, tables, strict=True)}
    finally:
        wide.unpersist()
