"""Sinks and artifacts: tables and flat files, skipped where nothing is new, moved into place whole; stages that fail alone."""

from __future__ import annotations

import uuid

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def modified(spark: SparkSession, path: str) -> int | None:
    """When the newest file of a path was written, in milliseconds; null where it does not exist. Any file system that Spark reads."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    files, newest = fs.listFiles(target, True), fs.getFileStatus(target).getModificationTime()
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, form: str = "parquet", **options) -> None:
    """The table under path.part, then in the place of what stood there: a reader never sees half of it."""
    spark, part = df.sparkSession, path.rstrip("/") + ".part"
    writer = df.write.mode("overwrite").options(**options)
    (writer.partitionBy(*partition) if partition else writer).format(form).save(part)
    promote(spark, part, path)


def promote(spark: SparkSession, part: str, path: str) -> None:
    """Move what was written in full to its name. What stood there steps aside first and goes once the new stands: a crash leaves the old or the new, under its name or beside it."""
    fs, source = _fs(spark, part)
    target, aside = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.before-{uuid.uuid4().hex}")
    stood = fs.exists(target)
    if stood and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if stood:
            fs.rename(aside, target)
        raise OSError(f"could not move {part} to {path}")
    if stood:
        fs.delete(aside, True)


def write_csv(df: DataFrame, path: str) -> None:
    """A flat file folder with a header; nested columns must be flattened first."""
    write_table(df, path, form="csv", header=True, emptyValue="")


def flattened(df: DataFrame, nested: str, joined: str = "; ", derive: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """The fields of a struct column beside the others: lists of texts joined, lists of structs and maps as JSON, derived columns added, columns in the order given first."""
    rows = df.select(*[c for c in df.columns if c != nested], f"{nested}.*")
    for f in rows.schema:
        if isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, (StructType, ArrayType, MapType)):
            rows = rows.withColumn(f.name, F.array_join(F.transform(f.name, lambda x: x.cast("string")), joined))
        elif isinstance(f.dataType, (ArrayType, StructType, MapType)):
            rows = rows.withColumn(f.name, F.to_json(f.name))
    for name, column in (derive or {}).items():
        rows = rows.withColumn(name, column)
    first = [c for c in order or [] if c in rows.columns]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def built(spark: SparkSession, inputs: list[str], output: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was made): the output as it stands if it is newer than all inputs, else made and written."""
    have, needs = modified(spark, output), [modified(spark, p) for p in inputs]
    if missing := [p for p, t in zip(inputs, needs, strict=True) if t is None]:
        raise FileNotFoundError(f"missing inputs: {missing}")
    if have is not None and have >= max(needs, default=0):
        return spark.read.parquet(output), False
    write_table(make(), output)
    return spark.read.parquet(output), True


def run_stages(stages: list[tuple[str, Callable[[], object]]]) -> list[dict]:
    """Every stage in turn; one that fails is told and leaves the others alone."""
    told = []
    for name, stage in stages:
        began = time.time()
        try:
            stage()
            told.append({"stage": name, "status": "ok", "error": "", "seconds": time.time() - began})
        except Exception as e:  # what a stage raises is reported, not raised
            told.append({"stage": name, "status": "failed", "error": f"{type(e).__name__}: {e}"[:300], "seconds": time.time() - began})
    return told


def metrics(parts: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of one-row tables, each column a metric; names that clash are an error."""
    out, seen = None, set()
    for part, df in parts.items():
        if clash := seen & set(df.columns):
            raise ValueError(f"metrics named twice: {sorted(clash)}, again in {part}")
        seen |= set(df.columns)
        one = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out
