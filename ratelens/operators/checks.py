"""Data-quality gates as one table: ``section, check, ok, severity``. All failures are reported together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, section: str, checks: dict[str, F.Column], severity: str = "error") -> DataFrame:
    """One aggregation over ``df``, a row for each check."""
    one = df.agg(*(F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks.values())))
    rows = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(n).alias("check"), F.col(f"c{i}").alias("ok"), F.lit(severity).alias("severity")) for i, n in enumerate(checks)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def clean_table(df: DataFrame) -> DataFrame:
    pairs = df.groupBy("cleaned_text", "rating").agg(F.count("*").alias("n"))
    ids = df.groupBy("review_id").agg(F.count("*").alias("n"))
    parts = [
        _rows(df, "clean", {"has rows": F.count("*") > 0, "no blank text": F.count_if(F.trim(F.coalesce("cleaned_text", F.lit(""))) == "") == 0}),
        _rows(pairs, "clean", {"no pure duplicate": F.coalesce(F.max("n"), F.lit(0)) <= 1}),
        _rows(ids, "clean", {"ids are unique": F.coalesce(F.max("n"), F.lit(0)) <= 1}),
    ]
    return reduce(DataFrame.unionByName, parts)


def split_table(rows: DataFrame, overlap: DataFrame) -> DataFrame:
    parts = [
        _rows(rows, "split", {"three parts": F.count_distinct("part") == 3, "every row has a part": F.count_if(F.col("part").isNull()) == 0}),
        _rows(overlap, "split", {"six overlaps are zero": (F.sum("n") == 0) & (F.count("*") == 6)}),
    ]
    return reduce(DataFrame.unionByName, parts)


def probabilities(df: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return _rows(df, "proxy", {"five classes": F.max(F.size("probs")) == 5, "sums to one": F.max(F.abs(total - 1)) <= tolerance})


def variants(counts: DataFrame) -> DataFrame:
    v = {n: F.max(F.when(F.col("variant") == n, F.col("n"))) for n in ("raw", "hard", "severe")}
    return _rows(counts, "variants", {"hard <= severe <= raw": (v["hard"] <= v["severe"]) & (v["severe"] <= v["raw"])})


def units(long: DataFrame, scenarios: int = 6, seeds: int = 3) -> DataFrame:
    per = long.groupBy("scenario", "weight_seed").agg(F.count("*").alias("n"))
    return _rows(per, "training", {"all units are there": F.count("*") == scenarios * seeds, "units are equally long": F.min("n") == F.max("n")})


def effects(table: DataFrame, hypotheses: int = 5) -> DataFrame:
    return _rows(table, "significance", {"five hypotheses": F.count_distinct("hypothesis") == hypotheses, "intervals in order": F.count_if(F.col("ci_low") > F.col("ci_high")) == 0})


def folds(table: DataFrame, wanted: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    return _rows(table, "k sensitivity", {"all values of k": F.sort_array(F.collect_set("k")) == F.array(*(F.lit(k) for k in wanted))})


def sidecars(table: DataFrame, verdict: str) -> DataFrame:
    from ratelens.operators.agreement import is_blank

    return _rows(table, "annotation", {"all rows have a verdict": F.count_if(is_blank(F.col(verdict))) == 0}, "warning")


def assert_ok(table: DataFrame) -> None:
    """Raises with all failed checks; warnings are left out."""
    failed = [f"{r.section}: {r.check}" for r in table.where("not ok and severity = 'error'").collect()]
    if failed:
        raise AssertionError("; ".join(failed))


def present(found: DataFrame, wanted: Sequence[str], section: str, severity: str = "error") -> DataFrame:
    """A check for each wanted name: ``found`` (name, n: rows or bytes) has it and it isn't empty."""
    at = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)) > 0
    return _rows(found, section, {f"there: {name}": at(name) for name in wanted}, severity)


def profile(found: DataFrame, wanted: Sequence[str], preserved: Sequence[str] = ()) -> DataFrame:
    """Tables of the quality report, and a warning for each preserved input that is missing."""
    out = present(found, wanted, "profile")
    return out.unionByName(present(found, preserved, "profile", "warning")) if preserved else out


def ablation(found: DataFrame, proxies: Sequence[str], variants: DataFrame) -> DataFrame:
    """Results of all proxies are there, and the cleaned variants (``variant, proxy``) are the three of the last proxy, or none."""
    own = F.sort_array(F.collect_set("variant"))
    three = (F.count("*") == 0) | ((own == F.array(F.lit("hard"), F.lit("raw"), F.lit("severe"))) & (F.count_if(F.col("proxy") != proxies[-1]) == 0))
    return present(found, proxies, "ablation").unionByName(_rows(variants, "ablation", {"variants come from the last proxy only": three}))


def gold(found: DataFrame, wanted: Sequence[str] = ("gold_evaluation", "gold_effects", "gold_undetermined")) -> DataFrame:
    return present(found, wanted, "gold")


def partitions(units_done: DataFrame, effects: DataFrame, splits: Sequence[int], expected: int) -> DataFrame:
    """For every split: all units (``split_seed, scenario, weight_seed``) have predictions, and effects are there."""
    per = units_done.select("split_seed", "scenario", "weight_seed").distinct().groupBy().agg(*(F.count_if(F.col("split_seed") == s).alias(f"s{s}") for s in splits))
    stored = effects.groupBy().agg(*(F.count_if(F.col("split_seed") == s).alias(f"e{s}") for s in splits))
    checks = {f"split {s}: all units": F.max(f"s{s}") == expected for s in splits}
    return _rows(per, "partitions", checks).unionByName(_rows(stored, "partitions", {f"split {s}: effects": F.max(f"e{s}") > 0 for s in splits}))


def report(*tables: DataFrame) -> DataFrame:
    """All gates as one table."""
    return reduce(DataFrame.unionByName, tables)
