"""Queries over predictions and annotations: metrics, tests, resamples, consistency, sampling, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.ordinal import metrics, sql_qwk
from ratelens.functions.rng import h, sql_h
from ratelens.operators import agreement, cells, confident, significance, splitting
from ratelens.operators.oof_store import lineage
from ratelens.plans.config import BOOT_SEED, HYPOTHESES, N_BOOT, SCENARIOS, SPLIT_SEEDS, WEIGHT_SEEDS
from ratelens.plans.fixtures import ANNOTATIONS_SQL, PREDICTIONS_SQL, SCORED_SQL, annotations, predictions, scored
from ratelens.plans.q_labels import CL
from ratelens.plans.registry import Registry
from ratelens.sources.store import by_split, is_stored, store_path
from ratelens.sources.tables import table

R = Registry(PREDICTIONS_SQL)
add = R.add
REPS = N_BOOT
NAMES = [s["name"] for s in SCENARIOS]


def sql_metrics(y: str, p: str) -> str:
    return f"round(avg(abs({y} - {p})::DOUBLE), 9) AS mae, round(sqrt(avg((({y} - {p}) * ({y} - {p}))::DOUBLE)), 9) AS rmse, round(avg(({y} = {p})::INT::DOUBLE), 9) AS accuracy, round(avg((abs({y} - {p}) <= 1)::INT::DOUBLE), 9) AS off_by_one, round({sql_qwk(y, p)}, 9) AS qwk"


BY_UNIT = f"by_unit AS (SELECT scenario, weight_seed, count(*) AS n, {sql_metrics('y_true', 'y_pred')} FROM predictions GROUP BY 1, 2)"
add("ordinal_metrics_by_unit", lambda s, d: significance.metrics_by_unit(predictions(s, d)), f"{BY_UNIT} --> SELECT * FROM by_unit")
M5 = ("mae", "rmse", "accuracy", "off_by_one", "qwk")
add(
    "final_results_table",
    lambda s, d: significance.results_table(predictions(s, d)),
    f"{BY_UNIT} --> SELECT scenario, count(*) AS n_seeds, " + ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std" for m in M5) + " FROM by_unit GROUP BY scenario",
)

# Wide table and tests
_u = significance.unit
_CELLS = ", ".join(f"max(y_pred) FILTER (scenario = '{n}' AND weight_seed = {w}) AS {_u(n, w)}" for n in NAMES for w in WEIGHT_SEEDS)
_ENS = ", ".join(f"least(greatest(round_even(({' + '.join(_u(n, w) for w in WEIGHT_SEEDS)}) / 3.0::DOUBLE, 0), 1), 5)::INT AS {significance.ensemble(n)}" for n in NAMES)
_ERR = ", ".join(f"({' + '.join(f'abs({_u(n, w)} - y)' for w in WEIGHT_SEEDS)}) / 3.0::DOUBLE AS {significance.error(n)}" for n in NAMES)
WIDE = f"w0 AS (SELECT review_id, max(y_true) AS y, {_CELLS} FROM predictions GROUP BY review_id), wide AS (SELECT *, {_ENS}, {_ERR} FROM w0)"
DIFF = "diff AS (" + " UNION ALL ".join(f"SELECT '{h}' AS hypothesis, round({significance.error(a)} - {significance.error(b)}, 9) AS d FROM wide" for h, a, b in HYPOTHESES) + ")"
WILCOXON = f"""{WIDE}, {DIFF}, sz AS (SELECT hypothesis, abs(d) AS a, count(*)::DOUBLE AS t, count(*) FILTER (d > 0)::DOUBLE AS up, count(*) FILTER (d = 0)::DOUBLE AS zero FROM diff GROUP BY 1, 2),
rk AS (SELECT *, sum(t) OVER (PARTITION BY hypothesis ORDER BY a) - t + (t + 1) / 2 AS rank FROM sz),
sm AS (SELECT hypothesis, sum(t) AS m, sum(up * rank) + sum(zero * rank) / 2 AS r_plus, sum(t * t * t - t) AS ties FROM rk GROUP BY 1)"""


def wide(spark, sf):
    return significance.wide_predictions(predictions(spark, sf))


def dealt(spark, sf):
    """``wide`` for draws: its rows are shuffled once, as reviews, and lie where their bucket is packed."""
    return significance.wide_predictions(predictions(spark, sf, dealt=True))


add(
    "wilcoxon_zsplit_z",
    lambda s, d: significance.wilcoxon(significance.paired_differences(wide(s, d))),
    f"{WILCOXON} --> SELECT hypothesis, m::BIGINT AS n, r_plus, round((r_plus - m * (m + 1) / 4) / nullif(sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 0), 9) AS z FROM sm",
)
def sql_p(z: str) -> str:
    """The tail of the normal distribution as the operator has it."""
    x = f"(abs({z}) / {2**0.5!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {x}))"
    power = f"{significance.ERFC[-1]}::DOUBLE"
    for c in reversed(significance.ERFC[:-1]):
        power = f"({c}::DOUBLE + {t} * {power})"
    return f"coalesce(least({t} * exp(-{x} * {x} + {power}), 1.0::DOUBLE), 1.0::DOUBLE)"


_PAIRS = " UNION ALL ".join(f"SELECT '{h}' AS hypothesis, '{a}' AS model_a, '{b}' AS model_b, avg({significance.error(a)}) AS mean_error_a, avg({significance.error(b)}) AS mean_error_b FROM wide" for h, a, b in HYPOTHESES)
TESTED = f"""{WILCOXON}, zt AS (SELECT hypothesis, m::BIGINT AS n, r_plus, round((r_plus - m * (m + 1) / 4) / nullif(sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 0), 9) AS z FROM sm),
tp AS (SELECT *, {sql_p("z")} AS p FROM zt), st AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, hypothesis) + 1) * p) AS st FROM tp),
te AS (SELECT *, max(st) OVER (ORDER BY p, hypothesis ROWS UNBOUNDED PRECEDING) AS p_holm FROM st)"""
TEST = ("hypothesis", "model_a", "model_b", "n", "r_plus", "z", "significant")
ROUNDED = ("mean_error_a", "mean_error_b", "p", "p_holm")
add(
    "significance_test",
    lambda s, d: significance.significance_table(wide(s, d)).select(*TEST, *(F.round(c, 9).alias(c) for c in ROUNDED)),
    f"{TESTED}, pa AS ({_PAIRS}) --> SELECT hypothesis, model_a, model_b, n, r_plus, z, p_holm <= 0.05 AS significant, {', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED)} FROM te JOIN pa USING (hypothesis)",
)
BOOT = f"""{WIDE}, nm AS (SELECT row_number() OVER (ORDER BY {sql_h("'bucket'", "review_id")} % {significance.BUCKETS}, review_id) - 1 AS pos, * FROM wide), nn AS (SELECT count(*) AS n FROM wide),
dg AS (SELECT r.i AS rep, b.i AS block, md5(concat_ws('|', {BOOT_SEED}, r.i, b.i)) AS d, n FROM nn, range({REPS}) r(i), (SELECT unnest(range((n + 3) // 4)) AS i FROM nn) b),
dr AS (SELECT rep, floor(('0x' || substr(d, 8 * k.i + 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS pos FROM dg, range(4) k(i) WHERE block * 4 + k.i < n), rs AS (SELECT * FROM dr JOIN nm USING (pos))"""


def boot_sql(expression) -> str:
    """Point estimates and percentile intervals of ``expression(model_a, model_b)``."""
    return f"""{BOOT}, {effect_sql("", expression)} --> SELECT * FROM ef"""


def effect_sql(tag: str, expression) -> str:
    """``ef`` with a tag: point estimates and intervals of one metric, from the shared draws."""
    cells = ", ".join(f"{expression(a, b)} AS {h}" for h, a, b in HYPOTHESES)
    names = ", ".join(h for h, _, _ in HYPOTHESES)
    return f"""bt{tag} AS (SELECT rep, {cells} FROM rs GROUP BY rep), bl{tag} AS (UNPIVOT bt{tag} ON {names} INTO NAME hypothesis VALUE v), pt{tag} AS (SELECT {cells} FROM wide), pl{tag} AS (UNPIVOT pt{tag} ON {names} INTO NAME hypothesis VALUE diff),
ef{tag} AS (SELECT bl.hypothesis, round(any_value(diff), 9) AS diff, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM bl{tag} bl JOIN pl{tag} pl ON bl.hypothesis = pl.hypothesis GROUP BY bl.hypothesis)"""


def _mae(a: str, b: str) -> str:
    return f"avg({significance.error(a)} - {significance.error(b)})"


def _ens(a: str, b: str) -> str:
    return f"{sql_qwk('y', significance.ensemble(a))} - {sql_qwk('y', significance.ensemble(b))}"


def _per(a: str, b: str) -> str:
    return "(" + " + ".join(f"({sql_qwk('y', _u(a, w))} - {sql_qwk('y', _u(b, w))})" for w in WEIGHT_SEEDS) + ") / 3"


add("bootstrap_mae_ci", lambda s, d: significance.mae_effects(dealt(s, d), REPS), boot_sql(_mae))
add("bootstrap_qwk_ensemble", lambda s, d: significance.qwk_ensemble_effects(dealt(s, d), REPS), boot_sql(_ens))
add("bootstrap_qwk_per_seed", lambda s, d: significance.qwk_per_seed_effects(dealt(s, d), REPS), boot_sql(_per))
METRICS = (("MAE", _mae), ("QWK_ensemble", _ens), ("QWK_per_seed", _per))
EFFECT = ("hypothesis", "metric", "diff", "ci_low", "ci_high", "z", "significant", "split_seed", "n_weight_seeds")
add(
    "effect_long",
    lambda s, d: significance.effect_table(wide(s, d), REPS, 42).select(*EFFECT, F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm")),
    f"{BOOT}, {TESTED.removeprefix(WIDE + ', ')}, " + ", ".join(effect_sql(f"_{m}", e) for m, e in METRICS)
    + ", al AS (" + " UNION ALL ".join(f"SELECT *, '{m}' AS metric FROM ef_{m}" for m, _ in METRICS) + ") --> SELECT al.hypothesis, metric, diff, ci_low, ci_high, z, p_holm <= 0.05 AS significant, "
    "42::INT AS split_seed, 3::INT AS n_weight_seeds, round(p, 9) AS p, round(p_holm, 9) AS p_holm FROM al LEFT JOIN te ON al.hypothesis = te.hypothesis AND metric = 'MAE'",
)
# Effects by split: every split tests another fifth of the reviews; its effects and tests are stored and read as one table
IN_SPLIT = "{0} % 5 = 0"
SPLIT_WIDE = f"sp(split_seed) AS (VALUES {', '.join(f'({x})' for x in SPLIT_SEEDS)}), sw AS (SELECT split_seed, wide.* FROM wide, sp WHERE {IN_SPLIT.format(sql_h(repr('split'), 'split_seed', 'review_id'))})"
SPLIT_TESTS = f"""{WIDE}, {SPLIT_WIDE}, sd AS ({" UNION ALL ".join(f"SELECT split_seed, '{h_}' AS hypothesis, round({significance.error(a)} - {significance.error(b)}, 9) AS d FROM sw" for h_, a, b in HYPOTHESES)}),
sz AS (SELECT split_seed, hypothesis, abs(d) AS a, count(*)::DOUBLE AS t, count(*) FILTER (d > 0)::DOUBLE AS up, count(*) FILTER (d = 0)::DOUBLE AS zero FROM sd GROUP BY 1, 2, 3),
rk AS (SELECT *, sum(t) OVER (PARTITION BY split_seed, hypothesis ORDER BY a) - t + (t + 1) / 2 AS rank FROM sz),
sm AS (SELECT split_seed, hypothesis, sum(t) AS m, sum(up * rank) + sum(zero * rank) / 2 AS r_plus, sum(t * t * t - t) AS ties FROM rk GROUP BY 1, 2),
zt AS (SELECT split_seed, hypothesis, round((r_plus - m * (m + 1) / 4) / nullif(sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 0), 9) AS z FROM sm), tp AS (SELECT *, {sql_p("z")} AS p FROM zt),
st AS (SELECT *, least(1, (count(*) OVER (PARTITION BY split_seed) - row_number() OVER (PARTITION BY split_seed ORDER BY p, hypothesis) + 1) * p) AS st FROM tp),
te AS (SELECT *, max(st) OVER (PARTITION BY split_seed ORDER BY p, hypothesis ROWS UNBOUNDED PRECEDING) AS p_holm FROM st)"""
SPLIT_BOOT = f"""{WIDE}, {SPLIT_WIDE}, nm AS (SELECT row_number() OVER (PARTITION BY split_seed ORDER BY {sql_h("'bucket'", "review_id")} % {significance.BUCKETS}, review_id) - 1 AS pos, * FROM sw), nn AS (SELECT split_seed, count(*) AS n FROM sw GROUP BY 1),
dg AS (SELECT split_seed, r.i AS rep, b.i AS block, md5(concat_ws('|', {BOOT_SEED}, r.i, b.i)) AS d, n FROM range({REPS}) r(i), (SELECT split_seed, n, unnest(range((n + 3) // 4)) AS i FROM nn) b),
dr AS (SELECT split_seed, rep, floor(('0x' || substr(d, 8 * k.i + 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS pos FROM dg, range(4) k(i) WHERE block * 4 + k.i < n), rs AS (SELECT * FROM dr JOIN nm USING (split_seed, pos))"""


def split_effect_sql(tag: str, expression) -> str:
    cells, names = ", ".join(f"{expression(a, b)} AS {h_}" for h_, a, b in HYPOTHESES), ", ".join(h_ for h_, _, _ in HYPOTHESES)
    return f"""bt{tag} AS (SELECT split_seed, rep, {cells} FROM rs GROUP BY 1, 2), bl{tag} AS (UNPIVOT bt{tag} ON {names} INTO NAME hypothesis VALUE v), pt{tag} AS (SELECT split_seed, {cells} FROM sw GROUP BY 1), pl{tag} AS (UNPIVOT pt{tag} ON {names} INTO NAME hypothesis VALUE diff),
ef{tag} AS (SELECT split_seed, hypothesis, round(any_value(diff), 9) AS diff, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM bl{tag} JOIN pl{tag} USING (split_seed, hypothesis) GROUP BY 1, 2)"""


SPLIT_METRICS = METRICS[:2]
EFFECTS_SQL = f"""{SPLIT_BOOT}, {", ".join(split_effect_sql(f"_{m}", e) for m, e in SPLIT_METRICS)},
effects AS ({" UNION ALL ".join(f"SELECT *, '{m}' AS metric FROM ef_{m}" for m, _ in SPLIT_METRICS)})"""
EFFECTS_SCHEMA = "hypothesis string, metric string, diff double, ci_low double, ci_high double, split_seed int"
TESTS_SCHEMA = "hypothesis string, z double, p double, split_seed int"


def split_part(spark, sf, seed: int):
    """The wide predictions of the reviews that a split tests."""
    return wide(spark, sf).where(h("split", F.lit(seed), F.col("review_id")) % 5 == 0)


def split_parts(spark, sf, seeds):
    """The same for several splits, told by ``split_seed``: a review is there once for each split that tests it."""
    inside = {x: h("split", F.lit(x), F.col("review_id")) % 5 == 0 for x in seeds}
    tested = wide(spark, sf).where(reduce(lambda a, b: a | b, inside.values()))
    return tested.withColumn("split_seed", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(x)) for x, c in inside.items())))))


def place(spark, sf, name: str) -> str:
    """Where results of these predictions are stored: other rows under the same folder have another place."""
    return store_path(spark, name, sf, lineage(table(spark, sf, "orders"), ("o_orderkey", "o_orderpriority")))


def stored_effects(spark, sf, splits=SPLIT_SEEDS):
    """Effects of the splits, one table partitioned by split; a split that is stored isn't computed again."""
    path = place(spark, sf, "effects")
    together: list[DataFrame] = []

    def made(x: int) -> DataFrame:
        if not together:  # the missing splits share their draws
            left = [s for s in splits if not is_stored(spark, path, EFFECTS_SCHEMA, s)]
            together.append(significance.effects(split_parts(spark, sf, left), REPS, [m for m, _ in SPLIT_METRICS], by="split_seed"))
        return together[0].where(F.col("split_seed") == x)

    return by_split(spark, path, EFFECTS_SCHEMA, made, splits)


def stored_tests(spark, sf):
    """Signed-rank tests of all splits, stored likewise."""
    made = lambda x: significance.wilcoxon(significance.paired_differences(split_part(spark, sf, x))).withColumn("p", significance.two_sided_p(F.col("z"))).select("hypothesis", "z", "p")
    return by_split(spark, place(spark, sf, "tests"), TESTS_SCHEMA, made)


VERDICT = """e AS (SELECT hypothesis, metric, split_seed, CASE WHEN metric = 'MAE' THEN -diff ELSE diff END AS e, CASE WHEN metric = 'MAE' THEN -ci_high ELSE ci_low END AS lo, CASE WHEN metric = 'MAE' THEN -ci_low ELSE ci_high END AS hi FROM effects),
f AS (SELECT *, CASE WHEN e > 0 THEN 'A' WHEN e < 0 THEN 'B' ELSE 'tie' END AS way, lo > 0 OR hi < 0 AS excl FROM e),
g AS (SELECT hypothesis, metric, count(*) AS n_splits, min(way) = max(way) AND min(way) <> 'tie' AS same_direction, count(*) FILTER (excl) AS n_excluding_zero, min(way) AS way"""
PER_SPLIT = (("effect", "e"), ("low", "lo"), ("high", "hi"))
add(
    "consistency_verdict",
    lambda s, d: significance.consistency(stored_effects(s, d)).join(significance.effects_by_split(stored_effects(s, d), SPLIT_SEEDS), ["hypothesis", "metric"]),
    EFFECTS_SQL + ", " + VERDICT + "".join(f", max({c}) FILTER (split_seed = {x}) AS {n}_{x}" for x in SPLIT_SEEDS for n, c in PER_SPLIT) + " FROM f GROUP BY 1, 2) --> SELECT hypothesis, metric, n_splits, same_direction, n_excluding_zero, "
    "CASE WHEN n_splits < 3 THEN 'not assessable' WHEN same_direction AND n_excluding_zero >= 2 THEN 'consistent' ELSE 'not consistent' END AS verdict, CASE WHEN same_direction THEN way ELSE 'mixed' END AS direction, "
    + ", ".join(f"{n}_{x}" for x in SPLIT_SEEDS for n, _ in PER_SPLIT)
    + " FROM g",
)
#: Two of the splits only: no verdict, and the third partition is neither made nor read.
add(
    "consistency_two_splits",
    lambda s, d: significance.consistency(stored_effects(s, d, SPLIT_SEEDS[:2]).where(F.col("split_seed").isin(*SPLIT_SEEDS[:2]))),
    EFFECTS_SQL.replace("effects AS (", "every AS (") + f", effects AS (SELECT * FROM every WHERE split_seed IN {SPLIT_SEEDS[:2]}), " + VERDICT + " FROM f GROUP BY 1, 2) --> SELECT hypothesis, metric, n_splits, same_direction, n_excluding_zero, 'not assessable' AS verdict, CASE WHEN same_direction THEN way ELSE 'mixed' END AS direction FROM g",
)
_P3 = lambda c: ", ".join(f"round(max({c}) FILTER (split_seed = {x}), 9) AS {c}_{x}" for x in SPLIT_SEEDS)
add(
    "wilcoxon_pivot",
    lambda s, d: significance.pivot_by_split(stored_tests(s, d).withColumn("p", F.round("p", 9)), "p", SPLIT_SEEDS).join(significance.pivot_by_split(stored_tests(s, d), "z", SPLIT_SEEDS), "hypothesis"),
    f"{SPLIT_TESTS} --> SELECT hypothesis, {_P3('p')}, {_P3('z')} FROM te GROUP BY hypothesis",
)
add(
    "holm_adjust",
    lambda s, d: significance.holm(stored_tests(s, d), by=("split_seed",)).select("split_seed", "hypothesis", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), "significant"),
    f"{SPLIT_TESTS} --> SELECT split_seed, hypothesis, round(p, 9) AS p, round(p_holm, 9) AS p_holm, p_holm <= 0.05 AS significant FROM te",
)

# Effects over cells
_SEEDS = ", ".join(f"round({{{i}}}, 9) AS diff_{w}" for i, w in enumerate(WEIGHT_SEEDS))
_seed_points = lambda a, b: [f"{sql_qwk('y', _u(a, w))} - {sql_qwk('y', _u(b, w))}" for w in WEIGHT_SEEDS]
_NULLS = ", ".join(f"NULL::DOUBLE AS diff_{w}" for w in WEIGHT_SEEDS)
add(
    "effect_points",
    lambda s, d: cells.effect_points(wide(s, d)),
    f"{WIDE} --> " + " UNION ALL ".join(f"SELECT '{h_}' AS hypothesis, '{m}' AS metric, round({e(a, b)}, 9) AS diff, {_SEEDS.format(*_seed_points(a, b)) if m == 'QWK_per_seed' else _NULLS} FROM wide" for h_, a, b in HYPOTHESES for m, e in METRICS),
)
add("effect_cells", lambda s, d: cells.effect_long(wide(s, d), REPS, 42))


def suite(spark, sf):
    """The six tables of the main split, written once; one row for each table and hypothesis or scenario in it."""
    folder = place(spark, sf, "suite")
    cells.significance_suite(predictions(spark, sf), folder, REPS, 42)
    key = {"final_results": "scenario"}
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{folder}/{t}").groupBy(F.col(key.get(t, "hypothesis")).alias("name")).agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(t)) for t in cells.SUITE))


add(
    "significance_suite",
    suite,
    "sc AS (SELECT DISTINCT scenario FROM predictions), hy(name, a, b) AS (VALUES " + ", ".join(str(x) for x in HYPOTHESES) + "), ok AS (SELECT name FROM hy WHERE a IN (SELECT * FROM sc) AND b IN (SELECT * FROM sc)), tb(table_name, n) AS (VALUES "
    + ", ".join(f"('{t}', {3 if t == 'effects_long' else 1})" for t in cells.SUITE[1:]) + ") --> SELECT scenario AS name, count(*) AS n_rows, 'final_results' AS table_name FROM sc GROUP BY 1 UNION ALL SELECT name, n::BIGINT, table_name FROM ok, tb",
)

add(
    "alignment_check",
    lambda s, d: significance.alignment(predictions(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y_true"))),
    "SELECT scenario, weight_seed, 0::BIGINT AS n_missing, 0::BIGINT AS n_unknown, count(*) FILTER (y_true IS NULL) AS n_other_label FROM predictions GROUP BY 1, 2",
)

# Validation log: the predictions of an epoch are those of a tenth of the reviews
LOG_SQL = f"""eb AS (SELECT scenario, weight_seed, ({sql_h("'epoch'", "scenario", "weight_seed", "review_id")} % 10 + 1)::INT AS epoch, y_true, y_pred FROM predictions),
log AS (SELECT scenario, weight_seed, epoch, {sql_metrics("y_true", "y_pred")} FROM eb GROUP BY 1, 2, 3)"""
UNIT = ("scenario", "weight_seed")


def validation_log(spark, sf):
    """``scenario, weight_seed, epoch, mae, qwk``, measured over the reviews that a hash deals to the epoch."""
    epoch = (h("epoch", F.col("scenario"), F.col("weight_seed"), F.col("review_id")) % 10 + 1).cast("int")
    return predictions(spark, sf).groupBy(*UNIT, epoch.alias("epoch")).agg(*metrics(F.col("y_true"), F.col("y_pred")))


add("best_epoch", lambda s, d: significance.best_epoch(validation_log(s, d), UNIT), f"{LOG_SQL} --> SELECT scenario, weight_seed, epoch, qwk, mae FROM log QUALIFY row_number() OVER (PARTITION BY scenario, weight_seed ORDER BY qwk DESC, mae, epoch) = 1")
add(
    "early_stop_epoch",
    lambda s, d: significance.early_stop(validation_log(s, d), by=UNIT),
    LOG_SQL
    + """, a AS (SELECT *, mae < coalesce(min(mae) OVER (PARTITION BY scenario, weight_seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS better FROM log),
b AS (SELECT *, count(*) FILTER (better) OVER (PARTITION BY scenario, weight_seed ORDER BY epoch) AS run FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY scenario, weight_seed, run ORDER BY epoch) - 1 AS streak FROM b)
--> SELECT scenario, weight_seed, coalesce(min(epoch) FILTER (streak >= 3), max(epoch))::INT AS last_epoch FROM c GROUP BY scenario, weight_seed""",
)

# Sampling
N0 = "1.96::DOUBLE * 1.96 * 0.5 * 0.5 / (0.1::DOUBLE * 0.1)"


def noisy(spark, sf):
    return confident.detect(scored(spark, sf)).where("is_noise")


def cochran(spark, sf):
    n0, n = splitting.cochran_columns(F.col("pool"))
    return noisy(spark, sf).groupBy("rating").agg(F.count("*").alias("pool")).select("rating", "pool", F.round(n0, 6).alias("n0"), n.alias("n"))


add("cochran_n", cochran, f"{CL} --> SELECT rating, count(*) AS pool, round({N0}, 6) AS n0, ceil(({N0}) / (1 + (({N0}) - 1) / count(*)))::BIGINT AS n FROM de WHERE is_noise GROUP BY rating", SCORED_SQL)
PLAN = """po AS (SELECT b.i::INT AS bin, count(de.review_id) AS pool FROM range(1, 5) b(i) LEFT JOIN (SELECT * FROM de WHERE is_noise) de ON least(de.rating_diff, 4) = b.i GROUP BY 1),
wa AS (SELECT *, CASE WHEN bin > 1 THEN 15 ELSE greatest(100 - (sum(least(15, pool)) FILTER (bin > 1) OVER ()), 0) END::BIGINT AS wanted FROM po),
pl AS (SELECT bin, pool, least(wanted, pool) AS take, greatest(wanted - pool, 0) AS shortfall FROM wa)"""
add("allocation_plan", lambda s, d: splitting.allocation_plan(noisy(s, d)), f"{CL}, {PLAN} --> SELECT * FROM pl", SCORED_SQL)
add(
    "human_sample",
    lambda s, d: splitting.human_sample(noisy(s, d).select("review_id", "rating_diff")).select("review_id", "bin", "draw"),
    f"""{CL}, {PLAN}, dn AS (SELECT review_id, least(rating_diff, 4)::INT AS bin FROM de WHERE is_noise), dq AS (SELECT review_id, dn.bin, row_number() OVER (PARTITION BY dn.bin ORDER BY md5(concat_ws('|', 42, review_id)), review_id) AS nth, take FROM dn JOIN pl USING (bin))
--> SELECT review_id, bin, row_number() OVER (ORDER BY md5(concat_ws('|', 43, review_id)), review_id)::INT AS draw FROM dq WHERE nth <= take""",
    SCORED_SQL,
)
add(
    "gold_sample",
    lambda s, d: splitting.proportional_sample(scored(s, d).select("review_id", "rating"), 97, 42, "rating"),
    """sz AS (SELECT rating, count(*) AS n FROM scored GROUP BY 1), ex AS (SELECT rating, 97.0::DOUBLE * n / sum(n) OVER () AS e FROM sz), ba AS (SELECT *, floor(e) AS b FROM ex),
qt AS (SELECT rating, (b + (row_number() OVER (ORDER BY round(e - b, 9) DESC, rating) <= 97 - sum(b) OVER ())::INT)::BIGINT AS quota FROM ba)
--> SELECT review_id, scored.rating FROM scored JOIN qt USING (rating) QUALIFY row_number() OVER (PARTITION BY scored.rating ORDER BY md5(concat_ws('|', 42, review_id)), review_id) <= any_value(quota) OVER (PARTITION BY scored.rating)""",
    SCORED_SQL,
)
add(
    "second_annotator_subset",
    lambda s, d: splitting.exact_sample(splitting.human_sample(noisy(s, d).select("review_id", "rating_diff")).select("review_id"), splitting.subset_size(100, 0.3), 99),
    f"""{CL}, {PLAN}, dn AS (SELECT review_id, least(rating_diff, 4)::INT AS bin FROM de WHERE is_noise), dq AS (SELECT review_id, row_number() OVER (PARTITION BY dn.bin ORDER BY md5(concat_ws('|', 42, review_id)), review_id) AS nth, take FROM dn JOIN pl USING (bin))
--> SELECT review_id FROM dq WHERE nth <= take QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', 99, review_id)), review_id) <= 30""",
    SCORED_SQL,
)

# Agreement
V = agreement.VERDICTS
add(
    "agreement_summary",
    lambda s, d: agreement.agreement_summary(annotations(s, d)),
    "SELECT count(verdict) AS n, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in V) + ", round(count(*) FILTER (verdict = 'noise') / count(verdict)::DOUBLE, 6) AS agreement FROM annotations",
    ANNOTATIONS_SQL,
)
add(
    "agreement_by_distance",
    lambda s, d: agreement.agreement_by_distance(annotations(s, d)),
    "SELECT rating_diff, count(*) AS n, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (verdict = '{v}') / count(*), 6) AS pct_{v}" for v in V) + " FROM annotations GROUP BY rating_diff",
    ANNOTATIONS_SQL,
)
add(
    "cohen_kappa",
    lambda s, d: agreement.cohen_kappa(annotations(s, d), "verdict", "verdict_2"),
    """pr AS (SELECT verdict AS a, verdict_2 AS b FROM annotations WHERE verdict_2 IS NOT NULL), ag AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS po FROM pr),
ch AS (SELECT sum((SELECT count(*) FROM pr WHERE a = v) * (SELECT count(*) FROM pr WHERE b = v))::DOUBLE AS c FROM (VALUES ('noise'), ('not_noise'), ('ambiguous')) t(v))
--> SELECT n::BIGINT AS n, round(po, 9) AS observed, round((po - c / (n * n)) / nullif(1 - c / (n * n), 0), 9) AS kappa FROM ag, ch""",
    ANNOTATIONS_SQL,
)
add(
    "quadratic_kappa",
    lambda s, d: agreement.gold_kappa(annotations(s, d)),
    f"pr AS (SELECT gold::INT AS a, gold_2::INT AS b FROM annotations WHERE gold <> 'ND' AND gold_2 <> 'ND') --> SELECT count(*) AS n, round({sql_qwk('a', 'b')}, 9) AS kappa FROM pr",
    ANNOTATIONS_SQL,
)
add(
    "gold_undetermined",
    lambda s, d: agreement.undetermined_share(annotations(s, d)),
    "SELECT count(gold) AS n_filled, count(*) FILTER (gold = 'ND') AS n_undetermined, round(count(*) FILTER (gold = 'ND') / count(gold)::DOUBLE, 9) AS share_undetermined FROM annotations",
    ANNOTATIONS_SQL,
)
GOLD = f"gl AS (SELECT review_id, gold::INT AS g FROM annotations WHERE gold <> 'ND'), gu AS (SELECT scenario, weight_seed, count(*) AS n, {sql_metrics('g', 'y_pred')} FROM predictions JOIN gl USING (review_id) GROUP BY 1, 2)"
add(
    "gold_evaluation",
    lambda s, d: agreement.gold_evaluation(predictions(s, d), agreement.gold_labels(annotations(s, d))),
    f"{GOLD} --> SELECT scenario, max(n) AS n_gold, " + ", ".join(f"round(avg({m}), 9) AS \"{m.upper()}\"" for m in M5) + " FROM gu GROUP BY scenario",
    PREDICTIONS_SQL,
    ANNOTATIONS_SQL,
)
add(
    "subset_check",
    lambda s, d: agreement.unmatched(table(s, d, "documents").select(F.col("doc_id").alias("review_id")), table(s, d, "labels").select(F.col("doc_id").alias("review_id"))),
    "SELECT DISTINCT doc_id::VARCHAR AS review_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "unused AS (SELECT 1)",
)
add(
    "label_flags_kappa",
    lambda s, d: agreement.cohen_kappa(table(s, d, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b")), "a", "b"),
    """ag AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) / count(*)::DOUBLE AS po, ((count(*) FILTER (quality = 1)) * (count(*) FILTER (toxic = 1)) + (count(*) FILTER (quality = 0)) * (count(*) FILTER (toxic = 0)))::DOUBLE AS c FROM labels)
--> SELECT n::BIGINT AS n, round(po, 9) AS observed, round((po - c / (n * n)) / nullif(1 - c / (n * n), 0), 9) AS kappa FROM ag""",
    "unused AS (SELECT 1)",
)

QUERIES, ORACLES = R.queries, R.oracles
