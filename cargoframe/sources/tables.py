"""Table scans and bulk writes.

Plain parquet has no MERGE, so a change is computed as a whole new table and published
as a new version directory; the version being read is never overwritten. A version counts
once its commit file exists, which only one of several writers can create: the others have
read an old version and fail or start again from the new one.
"""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cargoframe.schema import TABLES


def scan_table(
    spark: SparkSession, path: str, table: str | None = None, fmt: str = "parquet",
    where=None, sort=(), **options,
) -> DataFrame:
    """Scan one table; filter and columns reach the file reader, nothing is inferred."""
    reader = spark.read.format(fmt).options(**options)
    if table is not None:
        reader = reader.schema(TABLES[table])
    df = reader.load(path)
    if where is not None:
        df = df.filter(where)
    return df.orderBy(*sort) if sort else df


def count_table(df: DataFrame, where=None) -> DataFrame:
    if where is not None:
        df = df.filter(where)
    return df.agg(F.count(F.lit(1)).alias("n"))


def last_of_key(rows: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """One row per key: the last by ``order``, in which each next sort column is the newest.

    Without an order, rows of one key must be equal; they are taken once.
    """
    if order is None:
        return rows.dropDuplicates()
    newest = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def upsert_rows(
    target: DataFrame, rows: DataFrame, key: str = "id", order: list[Column] | None = None
) -> DataFrame:
    """New rows are added; for known keys every non-NULL value given replaces the old one.

    Of several rows of one key the last by ``order`` counts. Without an order, different rows
    of one key are refused when the result is computed.
    """
    new = last_of_key(rows, key, order).select(
        key, *[F.col(c).alias(f"_new_{c}") for c in rows.columns if c != key])
    if order is None:
        clash = F.concat(F.lit("several different rows of key "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
        given = [F.col(c) for c in new.columns if c != key]
        new = new.groupBy(key).agg(
            F.when(F.count(F.lit(1)) > 1, F.raise_error(clash).cast("int")).alias("_one"),
            *[F.first(c).alias(c) for c in new.columns if c != key]).filter(
            "_one IS NULL").drop("_one") if given else new
    merged = target.join(new, key, "full_outer")
    return merged.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
            if c != key and c in rows.columns
            else F.col(c)
            for c in target.columns
        ]
    )


def delete_rows(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


class Conflict(RuntimeError):
    """Another writer has published this version first."""


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it exists. The file system decides between two writers, so
    it must create files exclusively, as HDFS does."""
    fs, target = _file(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.toString() or fs.exists(target):
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small file, None if there is none."""
    fs, target = _file(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, target = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _commit_file(root: str, version: int) -> str:
    return f"{root}/_commits/{version:09d}"


def current_version(spark: SparkSession, root: str) -> int | None:
    """Newest published version, or None."""
    found = [int(n) for n in names_in(spark, f"{root}/_commits") if n.isdigit()]
    return max(found, default=None)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    if version is None:
        version = current_version(spark, root)
    folder = None if version is None else read_small(spark, _commit_file(root, version))
    if not folder:
        raise ValueError(f"{root} has no version {version}")
    return spark.read.parquet(f"{root}/{folder}")


def publish(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write the frame as a version of its own and return its number.

    ``version`` is the number after the one that was read; if another writer has published it
    in the meantime, this raises Conflict and changes nothing. Unfinished output of a writer
    that died lies in a folder no commit names.
    """
    spark = df.sparkSession
    if version is None:
        version = (current_version(spark, root) or 0) + 1
    folder = f"version={version:09d}-{uuid.uuid4().hex}"
    if read_small(spark, _commit_file(root, version)) is not None:
        raise Conflict(f"{root} has a version {version} already")
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    if not create_once(spark, _commit_file(root, version), folder):
        raise Conflict(f"{root} has a version {version} already")
    return version


def change(spark: SparkSession, root: str, step, attempts: int = 5) -> int:
    """Publish ``step(current table or None)``; a writer that loses starts again from the winner's version."""
    for left in reversed(range(attempts)):
        version = current_version(spark, root)
        now = None if version is None else read_version(spark, root, version)
        try:
            return publish(step(now), root, (version or 0) + 1)
        except Conflict:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def write_rows(
    spark: SparkSession, root: str, rows: DataFrame, key: str = "id", order: list[Column] | None = None
) -> int:
    """Create or update rows by key and publish the result; see ``upsert_rows`` for repeated keys."""
    return change(spark, root, lambda now: upsert_rows(rows.limit(0) if now is None else now, rows, key, order))


def remove_rows(spark: SparkSession, root: str, ids: DataFrame, key: str = "id") -> int:
    return change(spark, root, lambda now: delete_rows(now, ids, key))
