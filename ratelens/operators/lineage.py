"""Identity of tables and write-once results: fingerprints, manifests, sidecars, run registry."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.plans.config import MAIN_SPLIT_SEED, SPLIT_SEEDS, WEIGHT_SEEDS, WEIGHT_SEEDS_LIGHT

#: Endings that a copying tool gives to a second file of the same name.
DUPLICATE_NAME = re.compile(r"( \(\d+\)|[ _-]copy( \d+)?|^Copy of .*| - Copy.*)(\.[^.]+)?$")


def ids_hash(df: DataFrame, key: str = "review_id") -> DataFrame:
    """``n, sha256`` of the sorted ids joined by line breaks; one row, so meant for samples and splits."""
    ids = df.agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("ids"))
    return ids.select(F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", "\n"), 256).alias("sha256"))


def fingerprint(df: DataFrame) -> dict[str, int]:
    """An order-free identity of any number of rows, from one aggregation."""
    marks = df.select(F.xxhash64(*df.columns).alias("h"))
    row = marks.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod("h", F.lit(2**31 - 1))), F.lit(0)).alias("s")).first()
    return {"n": row["n"], "xor": row["x"], "sum": row["s"]}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """``written`` or ``already there, identical``; other content at the path is an error."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p):
        reader = spark.read.schema(df.schema)
        found = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
        if fingerprint(found) != fingerprint(df):
            raise FileExistsError(f"{path} holds something else")
        return "already there, identical"
    name = path.rstrip("/").rpartition("/")[2]
    if is_duplicate_name(name):
        raise ValueError(f"{name} looks like a copy of another file")
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv if fmt == "csv" else writer.format(fmt).save)(path)
    return "written"


def is_duplicate_name(name: str) -> bool:
    return bool(DUPLICATE_NAME.search(name))


def write_once_bytes(path: str, data: bytes) -> str:
    """The same for a small file on the driver; a sibling that looks like a copy of it is an error."""
    folder, name = os.path.split(path)
    stem, ext = os.path.splitext(name)
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    copies = [f for f in os.listdir(folder) if f != name and f.startswith(stem) and f.endswith(ext) and is_duplicate_name(f)]
    if copies:
        raise ValueError(f"copies lie beside {name}: {copies}")
    try:
        with open(path, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
    except FileExistsError:
        with open(path, "rb") as f:
            if f.read() != data:
                raise FileExistsError(f"{path} holds something else") from None
        return "already there, identical"
    with open(path, "rb") as f:
        if f.read() != data:
            raise OSError(f"{path} can't be read back")
    return "written"


def write_once_json(obj: object, path: str) -> str:
    return write_once_bytes(path, (json.dumps(obj, ensure_ascii=False, indent=2, sort_keys=True, default=float) + "\n").encode())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, nulls and NaN equal to themselves."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def classify_path(path: F.Column, mode: str = "start") -> F.Column:
    """preserved inputs, allowed results or unexpected files; at the start of a run results are unexpected."""
    result = "allowed" if mode != "start" else "unexpected"
    kind = F.when(path.rlike("(^|/)(preserved|raw|lexicon)/"), "preserved").when(path.rlike("(^|/)annotations/"), "allowed")
    return kind.when(path.rlike("(^|/)(runs|shared|logs|results)/"), result).otherwise("unexpected")


def audit_files(files: DataFrame, mode: str = "start") -> DataFrame:
    return files.groupBy(classify_path(F.col("path"), mode).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("bytes") / 1e6, 6).alias("mb"))


def results_manifest(files: DataFrame) -> DataFrame:
    return files.select("path", "bytes", "sha256").orderBy("path")


def output_map(files: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """``section, pattern, n``: how many files match each expected pattern (SQL LIKE)."""
    want = files.sparkSession.createDataFrame(list(expected), "section string, pattern string")
    joined = F.broadcast(want).join(files, F.expr("path like pattern"), "left")  # a literal list against the files
    return joined.groupBy("section", "pattern").agg(F.count("path").alias("n"))


def export_zip(root: str, out: str, endings: Sequence[str] = (".csv", ".json", ".md", ".parquet"), without: Sequence[str] = ("ckpt",)) -> int:
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                path = os.path.join(folder, name)
                if name.endswith(tuple(endings)) and not any(w in path for w in without) and os.path.abspath(path) != os.path.abspath(out):
                    z.write(path, os.path.relpath(path, root))
                    n += 1
    return n


def clean_artefacts(root: str, dry_run: bool = True, confirmation: str = "") -> list[str]:
    """Result files below ``root``; they are deleted only with ``dry_run=False`` and the exact phrase."""
    found = sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if f"{os.sep}runs{os.sep}" in os.path.join(d, n))
    if not dry_run:
        if confirmation != "delete all results":
            raise ValueError("the confirmation phrase is: delete all results")
        for path in found:
            os.remove(path)
    return found


def write_sidecar(df: DataFrame, path: str, basis: str, parent: str | None = None) -> str:
    row = ids_hash(df).first()
    return write_once_json({"basis": basis, "n_ids": row["n"], "sha256_sorted_ids": row["sha256"], "parent_sha256": parent}, path)


def verify_sidecar(df: DataFrame, path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        side = json.load(f)
    row = ids_hash(df).first()
    if (row["n"], row["sha256"]) != (side["n_ids"], side["sha256_sorted_ids"]):
        raise ValueError(f"annotations of {side['basis']} belong to other rows")
    return side


def may_create(annotations: DataFrame | None, verdict: str) -> None:
    """Annotations that hold any verdict are never overwritten."""
    from ratelens.operators.agreement import is_blank

    if annotations is not None and not annotations.where(~is_blank(F.col(verdict))).limit(1).isEmpty():
        raise FileExistsError("annotations with verdicts are there already")


@dataclass(frozen=True)
class RunContext:
    """Where the results of one split lie, and what may run on it."""

    root: str
    split_seed: int

    def __post_init__(self) -> None:
        if self.split_seed not in SPLIT_SEEDS:
            raise ValueError(f"split seed must be one of {SPLIT_SEEDS}")

    @property
    def is_main(self) -> bool:
        return self.split_seed == MAIN_SPLIT_SEED

    def require_main(self, what: str) -> None:
        if not self.is_main:
            raise ValueError(f"{what} runs on the main split ({MAIN_SPLIT_SEED}) only")

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), f"split_seed={self.split_seed}", *parts])

    def predictions(self, scenario: str, seed: int) -> str:
        return self.path("predictions", f"scenario={scenario}", f"weight_seed={seed}")

    def weight_seeds(self, economy: bool = False) -> tuple[int, ...]:
        return WEIGHT_SEEDS_LIGHT if economy and not self.is_main else WEIGHT_SEEDS

    def lock_mode(self, folder: str, economy: bool = False) -> str:
        """The seeds of a run are fixed by its first start."""
        return write_once_json({"split_seed": self.split_seed, "weight_seeds": list(self.weight_seeds(economy))}, os.path.join(folder, f"mode_{self.split_seed}.json"))


def missing_units(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units (scenario, weight_seed) that have no predictions yet."""
    return wanted.join(done.select("scenario", "weight_seed").distinct(), ["scenario", "weight_seed"], "left_anti")


def version_tuple(text: str) -> tuple[int, int, int]:
    found = re.findall(r"\d+", text)[:3]
    return tuple([*map(int, found), 0, 0, 0][:3])  # type: ignore[return-value]


def environment(packages: Sequence[str] = ("pyspark", "pandas", "numpy", "pyarrow")) -> dict:
    from importlib import metadata

    found = {}
    for p in packages:
        try:
            found[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            found[p] = None
    return {"packages": found, "time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
