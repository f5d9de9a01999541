"""Model stage: out-of-fold probabilities from linear models on embeddings.

Encoders and their fine-tuning are out of reach without their weights; what the other operators need
is the contract ``review_id, probs (, q_chain)``, which any provider can meet. Four proxies meet it here:
calibrated regressions on the embedding (P1) and on its pooled form (P2), and a softmax (P3) and an ordinal
chain (P4) of linear heads whose temperature is fitted on an inner hold-out of every fold.

Rows stay distributed. What reaches the driver is bounded by models, not rows: heads, two calibration numbers
a class and model, a temperature a fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.calibration import chain, chain_probs, scaled, sigmoid, softmax
from ratelens.operators.confident import once
from ratelens.operators.regression import Head, fit_heads
from ratelens.operators.splitting import stratified_kfold
from ratelens.plans.config import CV_FOLDS, CV_SEED

#: Parts of a training set for calibration; a hold-out is each so-many-th round of the deal.
INNER_PARTS, HOLDOUT = 3, 10
#: Passes over the scores at most, and the mean gradient that ends them.
PASSES, GRADIENT = 60, 1e-7
#: Temperatures tried in a pass, passes, and the range.
CANDIDATES, REFINEMENTS, COLDEST, HOTTEST = 25, 4, 0.01, 100.0
HEADS = "array<struct<w:array<double>,b:double>>"


class Temperatures(dict):
    """A temperature for each fold; ``losses`` has the mean loss of its inner hold-out before and after scaling."""

    losses: dict[int, tuple[float, float]] = {}


def mean_pool(embedding: str, width: int) -> Column:
    """Means of consecutive runs of ``width`` values."""
    n = (F.size(embedding) / width).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(embedding), i * width + 1, width))
    return F.transform(runs, lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x.cast("double")) / width)


def _prepared(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("x", F.transform(embedding, lambda v: v.cast("double")))


def _margins(heads: Column, x: Column) -> Column:
    return F.transform(heads, lambda h: h["b"] + F.aggregate(F.zip_with(h["w"], x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def platt(scores: DataFrame, by: Sequence[str]) -> list[tuple]:
    """``(*by, a, b)``: the sigmoid of ``a * score + b`` with the least loss against ``hit``, for every group.

    Targets are drawn in by the classes' sizes: (n1 + 1) / (n1 + 2) and 1 / (n0 + 2). Damped Newton steps: a pass is
    one aggregation of six sums a group for all groups, and a step that doesn't lower the loss is halved.
    """
    spark, hit = scores.sparkSession, F.col("hit").cast("double")
    sizes = scores.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit).alias("n1")).collect()
    state = {}
    for r in sizes:
        n0, n1 = r["n"] - r["n1"], r["n1"]
        start = (0.0, math.log((n1 + 1.0) / (n0 + 1.0)))
        state[tuple(r[c] for c in by)] = {"n": r["n"], "hi": (n1 + 1.0) / (n1 + 2.0), "lo": 1.0 / (n0 + 2.0), "best": start, "loss": math.inf, "step": (0.0, 0.0), "done": False}
    schema = ", ".join([*(f"{c} int" for c in by), "a double", "b double", "hi double", "lo double"])
    for _ in range(PASSES):
        open_ = {k: s for k, s in state.items() if not s["done"]}
        if not open_:
            break
        tried = {k: (s["best"][0] + s["step"][0], s["best"][1] + s["step"][1]) for k, s in open_.items()}
        table = spark.createDataFrame([(*k, *tried[k], s["hi"], s["lo"]) for k, s in open_.items()], schema)  # a row a class and model
        z, t = F.col("a") * F.col("score") + F.col("b"), F.when(F.col("hit"), F.col("hi")).otherwise(F.col("lo"))
        loss = F.greatest(z, F.lit(0.0)) - t * z + F.log1p(F.exp(-F.abs(z)))
        row = scores.join(F.broadcast(table), list(by)).select(*by, "score", loss.alias("_loss"), (sigmoid(z) - t).alias("_slope"), (sigmoid(z) * (1.0 - sigmoid(z))).alias("_curve"))
        f = F.col("score")
        sums = row.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in {"loss": F.col("_loss"), "ga": F.col("_slope") * f, "gb": F.col("_slope"), "haa": F.col("_curve") * f * f, "hab": F.col("_curve") * f, "hbb": F.col("_curve")}.items()))
        for r in sums.collect():
            k = tuple(r[c] for c in by)
            s = state[k]
            if r["loss"] > s["loss"]:
                s["step"] = (s["step"][0] / 2, s["step"][1] / 2)
                s["done"] = max(map(abs, s["step"])) < 1e-12
                continue
            s["best"], s["loss"] = tried[k], r["loss"]
            s["done"] = max(abs(r["ga"]), abs(r["gb"])) < GRADIENT * s["n"]
            haa, hbb = r["haa"] + 1e-9, r["hbb"] + 1e-9
            det = haa * hbb - r["hab"] ** 2
            s["step"] = ((r["hab"] * r["gb"] - hbb * r["ga"]) / det, (r["hab"] * r["ga"] - haa * r["gb"]) / det)
    return [(*k, *s["best"]) for k, s in state.items()]


def oof_logistic(df: DataFrame, k: int, classes: int, embedding: str = "embedding", label: str = "label", key: str = "review_id", seed: int = CV_SEED, only: Sequence[int] | None = None) -> DataFrame:
    """``fold, probs``: out-of-fold probabilities of a calibrated multinomial regression, labels from 0.

    Every training set is dealt into three parts; three regressions leave one out each, their margins on that part
    fit a sigmoid per class, and the scaled sigmoids of the three are averaged. ``df`` needs a distinct key; an empty table gives no rows. ``only`` names the folds to be fitted and
    returned, all if it is none.
    """
    folds = stratified_kfold(df, k, seed, label, key, deal="_deal").withColumn("_part", F.col("_deal") % INNER_PARTS)
    base = _prepared(folds.select("fold", F.col("_part").alias("part"), F.col(label).cast("int").alias("label0"), embedding), embedding).drop(embedding).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = list(range(k) if only is None else only)
    spark, jobs = df.sparkSession, [(o, i) for o in wanted for i in range(INNER_PARTS)]
    scores = None
    try:
        fitted = dict(zip(jobs, fit_heads(base, [Head(o, i) for o, i in jobs], classes)))
        table = spark.createDataFrame([(i, o, heads) for (o, i), heads in fitted.items()], f"part int, outer int, heads {HEADS}")  # k times three rows
        left_out = base.join(F.broadcast(table), "part").where("fold <> outer")
        margins = left_out.select("outer", "part", "label0", F.posexplode(_margins(F.col("heads"), F.col("x"))).alias("class", "score"))
        scores = margins.select("outer", "part", "class", "score", (F.col("label0") == F.col("class")).alias("hit")).persist(StorageLevel.MEMORY_AND_DISK)
        curve = {r[:3]: r[3:] for r in platt(scores, ("outer", "part", "class"))}
    finally:
        base.unpersist()
        if scores is not None:
            scores.unpersist()
    # The sigmoids become part of the heads: a * (w x + b) + c.
    calibrated = []
    for (o, i), heads in fitted.items():
        own = [curve.get((o, i, c), (1.0, 0.0)) for c in range(len(heads))]
        calibrated.append((o, i, [([a * v for v in w], a * b + c) for (w, b), (a, c) in zip(heads, own)]))
    models = [(o, [h for p, _, h in calibrated if p == o and h]) for o in wanted]
    known = F.broadcast(spark.createDataFrame(models, f"fold int, models array<{HEADS}>"))  # k rows
    each = F.transform("models", lambda m: scaled(F.transform(_margins(m, F.col("x")), sigmoid)))
    total = F.aggregate(each, F.array_repeat(F.lit(0.0), classes), lambda s, p: F.zip_with(s, p, lambda a, b: a + b))
    out = _prepared(folds, embedding).join(known, "fold").withColumn("probs", F.transform(total, lambda v: v / F.size("models")))
    return once(out, "probs").select(*(c for c in df.columns if c != embedding), "fold", "probs")


def oof_scaled(df: DataFrame, k: int, classes: int, ordinal: bool, embedding: str = "embedding", label: str = "label", key: str = "review_id", seed: int = CV_SEED, only: Sequence[int] | None = None) -> tuple[DataFrame, Temperatures]:
    """Out-of-fold probabilities of linear heads, and the temperature of every fold.

    ``ordinal``: one binary regression for each threshold, fitted on the rows that reached the one before, which adds
    ``q_chain``; else one softmax. A tenth of every training set, stratified, fits the temperature and no head. An
    empty table gives no rows. ``only`` names the folds to be fitted and returned, all if it is none.
    """
    wanted = list(range(k) if only is None else only)
    folds = stratified_kfold(df, k, seed, label, key, deal="_deal").withColumn("_held", (F.col("_deal") + F.col("fold")) % HOLDOUT == 0)
    base = _prepared(folds.select("fold", F.col("_held").cast("int").alias("part"), F.col(label).cast("int").alias("label0"), embedding), embedding).drop(embedding).persist(StorageLevel.MEMORY_AND_DISK)
    spark, heads_of = df.sparkSession, range(classes - 1) if ordinal else range(1)

    try:
        jobs = [(o, t) for o in wanted for t in heads_of]
        fitted = dict(zip(jobs, fit_heads(base, [Head(o, 1, t if ordinal else None) for o, t in jobs], classes)))
        table = spark.createDataFrame([(o, [h for t in heads_of for h in fitted[o, t]]) for o in wanted], f"outer int, heads {HEADS}")  # k rows
        held = base.where("part = 1").join(F.broadcast(table), F.col("fold") != F.col("outer")).select("outer", _margins(F.col("heads"), F.col("x")).alias("logits"), "label0").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = fit_temperatures(held, "outer", ordinal)
            temperatures = Temperatures({o: found.get(o, 1.0) for o in wanted})
            temperatures.losses = _losses_at(held, "outer", temperatures, ordinal)
        finally:
            held.unpersist()
    finally:
        base.unpersist()
    warm = F.broadcast(spark.createDataFrame([(o, t) for o, t in temperatures.items()], "outer int, temperature double"))
    rows = _prepared(folds, embedding).join(F.broadcast(table), F.col("fold") == F.col("outer")).drop("outer").join(warm, F.col("fold") == F.col("outer"))
    rows = once(rows.withColumn("logits", _margins(F.col("heads"), F.col("x"))).drop("heads", "x"), "logits")
    kept = [*(c for c in df.columns if c != embedding), "fold"]
    if ordinal:
        out = once(rows.withColumn("q_chain", chain(F.col("logits"), F.col("temperature"))), "q_chain")
        return once(out.withColumn("probs", chain_probs(F.col("q_chain"))), "probs").select(*kept, "q_chain", "probs"), temperatures
    return once(rows.withColumn("probs", softmax(F.col("logits"), F.col("temperature"))), "probs").select(*kept, "probs"), temperatures


def _with_loss(df: DataFrame, logits: str, temperature: str, label0: str, ordinal: bool) -> DataFrame:
    """Adds ``loss``: less the logarithm of the label's probability."""
    if not ordinal:
        p = softmax(F.col(logits), F.col(temperature))
    else:
        df = once(df.withColumn("_q", chain(F.col(logits), F.col(temperature))), "_q")
        p = chain_probs(F.col("_q"))
    known = once(df.withColumn("_p", p), "_p")
    return known.withColumn("loss", -F.log(F.greatest(F.element_at("_p", F.col(label0) + 1), F.lit(1e-8))))


def temperature_grid(df: DataFrame, temperatures: Sequence[float], logits: str = "logits", label0: str = "label0", ordinal: bool = False) -> DataFrame:
    """``temperature, nll`` for every candidate: rows meet the few candidates by an explode, then one aggregation."""
    grid = df.withColumn("temperature", F.explode(F.array(*(F.lit(float(t)) for t in temperatures))))
    return _with_loss(grid, logits, "temperature", label0, ordinal).groupBy("temperature").agg(F.avg("loss").alias("nll"))


def fit_temperatures(df: DataFrame, by: str, ordinal: bool) -> dict[int, float]:
    """The temperature of least loss of every group (the lowest of equal ones), by grids that close in on it: each pass
    is one aggregation over all groups, and the last grid's step is below a thousandth of the temperature. A minimum
    beyond the range gives its end."""
    spark = df.sparkSession
    spans = {r[by]: (math.log(COLDEST), math.log(HOTTEST)) for r in df.select(by).distinct().collect()}
    best: dict[int, float] = {}
    for _ in range(REFINEMENTS if spans else 0):
        grids = {g: [math.exp(lo + (hi - lo) * i / (CANDIDATES - 1)) for i in range(CANDIDATES)] for g, (lo, hi) in spans.items()}
        table = F.broadcast(spark.createDataFrame(list(grids.items()), f"{by} int, ts array<double>"))
        tried = df.join(table, by).select(by, "logits", "label0", F.explode("ts").alias("t"))
        nll = _with_loss(tried, "logits", "t", "label0", ordinal).groupBy(by, "t").agg(F.avg("loss").alias("nll"))
        for r in nll.groupBy(by).agg(F.min_by("t", F.struct(F.round("nll", 12), "t")).alias("t")).collect():
            best[r[by]] = r["t"]
            lo, hi = spans[r[by]]
            step, at = (hi - lo) / (CANDIDATES - 1), math.log(r["t"])
            spans[r[by]] = (max(at - step, math.log(COLDEST)), min(at + step, math.log(HOTTEST)))
    return best


def _losses_at(df: DataFrame, by: str, temperatures: dict[int, float], ordinal: bool) -> dict[int, tuple[float, float]]:
    """Mean loss of every group at the temperature 1 and at its own, from one aggregation."""
    table = F.broadcast(df.sparkSession.createDataFrame([(g, side, t) for g, own in temperatures.items() for side, t in enumerate((1.0, own))], f"{by} int, side int, t double"))
    tried = df.join(table, by).select(by, "side", "logits", "label0", "t")
    found = {(r[by], r["side"]): r["nll"] for r in _with_loss(tried, "logits", "t", "label0", ordinal).groupBy(by, "side").agg(F.avg("loss").alias("nll")).collect()}
    return {g: (found[g, 0], found[g, 1]) for g in temperatures if (g, 0) in found}


def losses_of(temperatures: dict[int, float]) -> dict[int, tuple[float, float]]:
    """Losses before and after scaling, by fold, where they are known."""
    return getattr(temperatures, "losses", {})


def best_temperature(grid: DataFrame) -> DataFrame:
    """The temperature of least loss (the lowest of equal ones); 1 where there are no rows."""
    return grid.agg(F.coalesce(F.min_by("temperature", F.struct("nll", "temperature")), F.lit(1.0)).alias("temperature"))


#: Values averaged into one by the pooled proxy.
POOL = 4
PROXIES = {0: ("P1", "embedding_lr"), 1: ("P2", "pooled_lr"), 2: ("P3", "softmax_head"), 3: ("P4", "chain_head")}
FINAL_PROXY = 3


def proxy_oof(df: DataFrame, proxy_id: int, k: int = CV_FOLDS, classes: int = 5, label: str = "label", only: Sequence[int] | None = None) -> tuple[DataFrame, dict[int, float]]:
    """Out-of-fold rows of one proxy and its temperatures (none for P1 and P2); only P4 takes other fold counts."""
    if proxy_id not in PROXIES:
        raise KeyError(proxy_id)
    if proxy_id != FINAL_PROXY and k != CV_FOLDS:
        raise ValueError(f"{PROXIES[proxy_id][0]} has {CV_FOLDS} folds, not {k}")
    if proxy_id < 2:
        rows = df.withColumn("embedding", mean_pool("embedding", POOL)) if proxy_id == 1 else df
        return oof_logistic(rows, k, classes, label=label, only=only), {}
    return oof_scaled(df, k, classes, proxy_id == FINAL_PROXY, label=label, only=only)
