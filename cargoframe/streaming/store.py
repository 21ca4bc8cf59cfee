"""A keyed table that a stream changes batch by batch.

Rows lie in buckets by the hash of a key. A change writes only the changed columns of the changed
rows, as a delta of its buckets; after ``COMPACT`` deltas the touched buckets get new base files.
A read names its buckets and opens one base folder and at most ``COMPACT`` deltas of each, so
what batch n reads does not grow with n.

A version counts once its file in ``log`` exists. That file names, for every bucket, the version
of its base, the deltas since the last compaction, the last batch of every writer and
whatever else a writer keeps beside its rows; a batch that was committed before a crash is not applied twice.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cargoframe.sources.scratch import free_shuffles, remove
from cargoframe.sources.tables import Conflict, create_once, names_in, read_small

BUCKETS, COMPACT = 64, 8
#: Log entries that stay readable; only the newest is needed.
LOG = 64


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        about = read_small(spark, f"{self.root}/about")
        if about is None:
            raise ValueError(f"{root} holds no store")
        about = json.loads(about)
        self.id, self.key, self.columns, self.buckets = (about[k] for k in ("id", "key", "columns", "buckets"))
        self.schema = T.StructType.fromJson(about["schema"])
        fields = [self.schema[c] for c in dict.fromkeys([self.id, *self.columns])]
        self.delta_schema = T.StructType([*fields, T.StructField("_bucket", T.IntegerType())])

    @classmethod
    def create(cls, rows: DataFrame, root: str, columns: list[str], id: str = "id", key: str | None = None,
               buckets: int = BUCKETS) -> "KeyedStore":
        """A store of ``rows`` in which ``columns`` may change, bucketed by ``key`` (the id if not given).

        Written before its first version is named: a creation that dies leaves no store behind.
        """
        spark, root = rows.sparkSession, root.rstrip("/")
        key = key or id
        _write(rows, F.col(key), buckets, f"{root}/base/version=0")
        about = {"id": id, "key": key, "columns": columns, "buckets": buckets, "schema": rows.schema.jsonValue()}
        state = {"bases": [0] * buckets, "deltas": [], "writers": {}, "kept": {}}
        if not (create_once(spark, f"{root}/log/000000000", json.dumps(state))
                and create_once(spark, f"{root}/about", json.dumps(about))):
            raise Conflict(f"{root} holds a store already")
        return cls(spark, root)

    def state(self) -> tuple[int, dict]:
        """Newest version and its log entry."""
        version = max(int(n) for n in names_in(self.spark, f"{self.root}/log") if n.isdigit())
        return version, json.loads(read_small(self.spark, f"{self.root}/log/{version:09d}"))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys of a batch: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(_bucket(F.col(self.key), self.buckets)).distinct().collect())

    def files(self, state: dict, buckets: list[int]) -> tuple[list[str], list[str]]:
        """Folders that hold the base rows and the deltas of these buckets."""
        base = [f"{self.root}/base/version={state['bases'][b]}/_bucket={b}" for b in buckets]
        wanted = set(buckets)
        delta = [f"{self.root}/delta/version={v}/_bucket={b}" for v, held in state["deltas"] for b in held if b in wanted]
        return self._existing(base), delta

    def _existing(self, paths: list[str]) -> list[str]:
        held: dict[str, set] = {}
        for folder in {p.rsplit("/", 1)[0] for p in paths}:
            held[folder] = set(names_in(self.spark, folder))
        return [p for p in paths if p.rsplit("/", 1)[1] in held[p.rsplit("/", 1)[0]]]

    def rows(self, state: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Current rows of these buckets, of all if none are named."""
        state = state or self.state()[1]
        base, delta = self.files(state, list(range(self.buckets)) if buckets is None else buckets)
        if not base:
            return self.spark.createDataFrame([], self.schema)
        table = self.spark.read.schema(self.schema).parquet(*base)
        if not delta:
            return table
        number = F.regexp_extract(F.input_file_name(), r"/version=(\d+)/", 1).cast("long")
        changes = self.spark.read.schema(T.StructType(self.delta_schema.fields[:-1])).parquet(*delta)
        newest = changes.withColumn("_version", number).groupBy(self.id).agg(
            F.max(F.struct("_version", *self.columns)).alias("_d"))
        joined = table.join(newest, self.id, "left")
        given = F.col("_d").isNotNull()
        return joined.withColumns(
            {c: F.when(given, F.col(f"_d.{c}")).otherwise(F.col(c)) for c in self.columns}).select(table.columns)

    def is_done(self, state: dict, writer: str, batch: int) -> bool:
        return batch <= state["writers"].get(writer, -1)

    def commit(self, version: int, state: dict, changes: DataFrame, writer: str, batch: int, kept: dict | None = None) -> None:
        """Publish the version after ``version``: new values (id, key and columns) of changed rows."""
        after = version + 1
        path = f"{self.root}/delta/version={after}"
        _write(changes.select(*dict.fromkeys([self.id, self.key, *self.columns])), F.col(self.key), self.buckets, path)
        held = [int(n.split("=")[1]) for n in names_in(self.spark, path) if n.startswith("_bucket=")]
        state = {**state, "deltas": [*state["deltas"], [after, held]], "writers": {**state["writers"], writer: batch},
                 "kept": {**state["kept"], **(kept or {})}}
        if len(state["deltas"]) >= COMPACT:
            touched = sorted({b for _, held in state["deltas"] for b in held})
            if touched:
                _write(self.rows(state, touched), F.col(self.key), self.buckets, f"{self.root}/base/version={after}")
            bases = [after if b in set(touched) else v for b, v in enumerate(state["bases"])]
            state = {**state, "bases": bases, "deltas": []}
        if not create_once(self.spark, f"{self.root}/log/{after:09d}", json.dumps(state)):
            raise Conflict(f"{self.root} has a version {after} already")
        remove(self.spark, f"{self.root}/log/{after - LOG:09d}")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, key: Column, buckets: int, path: str) -> None:
    """One folder per bucket. Rows of an id that is repeated a million times stay in one bucket but
    not in one task: a bucket is written by several."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if not isinstance(
        rows.schema[c].dataType, T.MapType)]), F.lit(4))
    dealt = rows.withColumn("_bucket", _bucket(key, buckets)).withColumn("_spread", spread)
    dealt.repartition("_bucket", "_spread").drop("_spread").write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(path)
    free_shuffles(rows.sparkSession)
