"""Reading tables, master CSV files, lexicons and files as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASTER = T.StructType([T.StructField(n, T.StringType()) for n in ("source_app", "review_text", "rating", "date", "helpful_votes", "review_id", "detected_lang", "scraped_at")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A review CSV by its header, typed: unreadable dates and numbers become null, text stays null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for field in MASTER.fields:
        if field.name not in raw.columns:
            raw = raw.withColumn(field.name, F.lit(None).cast(field.dataType))
    return raw.select(*MASTER.names).withColumns(
        {
            "rating": F.expr("try_cast(rating as int)"),
            "date": F.expr("cast(try_to_timestamp(date, 'yyyy-MM-dd') as date)"),
            "helpful_votes": F.expr("try_cast(helpful_votes as bigint)"),
        }
    )


def verified(df: DataFrame, expected_rows: int | None = None, required: Sequence[str] = ()) -> DataFrame:
    """``df`` if it has rows, the required columns and, where given, exactly that many rows."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    n = df.count() if expected_rows is not None else df.limit(1).count()
    if not n or (expected_rows is not None and n != expected_rows):
        raise ValueError(f"{n} rows; expected {expected_rows if expected_rows is not None else 'some'}")
    return df


def corpus_lock(spark: SparkSession, path: str, sha256: str | None, rows: int | None) -> DataFrame:
    """``path, bytes, sha256, rows, locked``: whether a file still is the one that was fixed."""
    files = files_as_table(spark, path)
    n = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()
    same = F.lit(True) & (F.col("sha256") == sha256 if sha256 else F.lit(True)) & F.lit(rows is None or n == rows)
    return files.select("path", "bytes", "sha256", F.lit(n).cast("long").alias("rows"), same.alias("locked"))


def files_as_table(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lexicon(base: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """``slang, formal, origin``: rows of the domain override those of the base, later ones earlier.

    Both need the columns slang and formal; rows with a null are left out.
    """
    parts = []
    for rank, (name, df) in enumerate((("base", base), ("domain", domain))):
        if df is not None:
            verified_columns = {"slang", "formal"} - set(df.columns)
            if verified_columns:
                raise ValueError(f"lexicon {name} lacks {sorted(verified_columns)}")
            parts.append(df.select("slang", "formal", F.lit(name).alias("origin"), F.lit(rank).alias("rank")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = Window.partitionBy("slang").orderBy(F.desc("rank"), F.desc("formal"))
    ranked = both.where("slang is not null and formal is not null").withColumn("nth", F.row_number().over(order))
    return ranked.where("nth = 1").select("slang", "formal", "origin")


def quota_rows(rows: DataFrame, quotas: dict[int, int], key: str = "rating", within: Sequence[str] = ("source_app",), order: str = "review_id") -> DataFrame:
    """At most the quota of rows for every app and star, in the order of arrival: what a paged source keeps."""
    limit = F.coalesce(*(F.when(F.col(key) == k, F.lit(n)) for k, n in quotas.items()), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*within, key).orderBy(order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def read_json_objects(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON files by a schema, with ``corrupt``: the text of an object that can't be read, else null.

    Its other fields are null then; fields that are missing in the file are null, further ones are left out.
    """
    reader = spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return reader.option("multiLine", multi_line).json(path)


def json_column(df: DataFrame, column: str, schema: str, into: str = "json") -> DataFrame:
    """Adds ``into`` (the object of a JSON column) and ``malformed``: a text that isn't such an object, or has a field of another type."""
    parsed = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.withColumn("_parsed", parsed)
    fields = out.schema["_parsed"].dataType.names[:-1]
    bad = F.col(column).isNotNull() & (F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull())
    return out.withColumns({into: F.when(F.col("_parsed").isNotNull() & ~bad, F.struct(*(F.col(f"_parsed.{f}").alias(f) for f in fields))), "malformed": bad}).drop("_parsed")
