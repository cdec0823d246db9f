"""Sinks, catalogs and fingerprints on plain Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def content_key(df: DataFrame, dataset: str) -> Column:
    """SHA-256 of the dataset name and the row's JSON with sorted field names."""
    return F.sha2(F.concat_ws("|", F.lit(dataset), F.to_json(F.struct(*sorted(df.columns)))), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_dedup(df: DataFrame, target: str, dataset: str) -> int:
    """Append rows whose content is not stored yet; returns how many were added.

    Copies inside the batch collapse in a map-side combined aggregate; the stored side is read as keys only. The count
    is observed during the write, not by a second pass.
    """
    spark = df.sparkSession
    rows = df.withColumn("dataset", F.lit(dataset)).withColumn("content_key", content_key(df, dataset)).dropDuplicates(["content_key"])
    if _exists(spark, target):
        stored = spark.read.parquet(target).filter(F.col("dataset") == dataset).select("content_key")
        rows = rows.join(stored, "content_key", "left_anti")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("dataset").parquet(target)
    return seen.get["n"]


def upsert(current: DataFrame | None, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Merged rows, the last write per key winning; an aggregate, so a key with many versions never fills one task."""
    from tidemark.operators.ranking import latest_per_key

    both = changes.withColumn("_new", F.lit(1))
    if current is not None:
        both = current.withColumn("_new", F.lit(0)).unionByName(both)
    return latest_per_key(both, keys, ["_new", *order]).drop("_new")


def write_version(df: DataFrame, root: str) -> str:
    """Write a new immutable version of a table; readers of the previous one are not disturbed."""
    import time
    import uuid

    path = f"{root}/v={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("error").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest complete version (one that has its success marker), or None."""
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    names = sorted(s.getPath().toString() for s in fs.listStatus(fs_path))
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))]
    return spark.read.parquet(done[-1]) if done else None


def write_partitions(df: DataFrame, path: str, column: str = "role") -> None:
    """One folder per part; the rebalance splits a part with most rows over as many tasks as its size asks for."""
    df.hint("rebalance", column).write.mode("error").partitionBy(column).parquet(path)


def dataset_catalog(df: DataFrame, dataset: str = "dataset", at: str = "available_at") -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("records"), F.min(at).alias("first"), F.max(at).alias("last"))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", name: Column | None = None) -> DataFrame:
    """sha256 and size of each file below a folder. ``name`` is an expression over ``path`` (default: the file's own name);
    a task reads one whole file, so files should stay below some hundred megabytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select((F.element_at(F.split("path", "/"), -1) if name is None else name).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or different, with the reason."""
    e = expected.select("name", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    j = found.join(e, "name", "full_outer")
    reason = F.when(F.col("sha256").isNull(), "missing").when(F.col("_s").isNull(), "unexpected").when((F.col("sha256") != F.col("_s")) | (F.col("bytes") != F.col("_b")), "different")
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select("name", "reason")


def experiment_catalog(reports: DataFrame, column: str = "json") -> DataFrame:
    """Selected fields of report documents, newest first."""
    field = lambda p: F.get_json_object(F.col(column), p)
    return reports.select(
        "id", field("$.created_at").alias("created_at"), field("$.model").alias("model"), field("$.status").alias("status"),
        field("$.test.log_loss").cast("double").alias("test_log_loss"), field("$.data_sha256").alias("data_sha256"),
    ).orderBy(F.desc("created_at"), F.desc("id"))


def experiment_inventory(reports: DataFrame, column: str = "json") -> DataFrame:
    """Every model score of every report next to its cohort; no ranking is made across cohorts."""
    models = F.from_json(F.get_json_object(F.col(column), "$.models"), "map<string, struct<log_loss: double, brier: double, events: bigint>>")
    return reports.select("id", F.get_json_object(F.col(column), "$.cohort").alias("cohort"), F.explode(models).alias("model", "_s")).select("id", "cohort", "model", "_s.*")


def data_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent digest: row count, and the sum and xor of the first 60 bits of each row's MD5.

    Values are hashed with their lengths in front and NULL as a sign of its own, so that no two different rows agree.
    """
    text = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h.cast("long")).alias("hash_xor"))
