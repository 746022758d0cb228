"""Append-only storage: versions are appended, views show the latest, nothing is updated in place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Files of a table are spread over this many hash buckets of trace_id, so that a point lookup reads one.
BUCKETS = 64


def append(df: DataFrame, path: str, version: int, key: str = "trace_id") -> None:
    """Append rows as one version, partitioned by a hash bucket of the key."""
    df.withColumn("version", F.lit(version)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)


def latest(spark: SparkSession, path: str, key: str = "trace_id") -> DataFrame:
    """The rows of every key's latest version; re-ingesting a trace replaces all its rows."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(F.col(key).alias("k")).agg(F.max("version").alias("v"))
    return rows.join(newest, F.col(key).eqNullSafe(F.col("k")) & (F.col("version") == F.col("v"))).drop("k", "v", "version", "bucket")


def lookup(spark: SparkSession, path: str, value: str, key: str = "trace_id") -> DataFrame:
    """The rows of one key; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(value)), F.lit(BUCKETS)).cast("int")
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def prune_attributes(spans: DataFrame, traces: DataFrame, older_than_days: int, now) -> DataFrame:
    """spans with attributes emptied and marked where their trace was ingested more than so many days before now; payloads stay."""
    old = traces.where(F.col("ingested_at") < F.lit(now) - F.expr(f"interval {int(older_than_days)} days")).select(F.col("trace_id").alias("old_trace")).distinct()
    joined = spans.join(old, F.col("trace_id") == F.col("old_trace"), "left")
    hit = F.col("old_trace").isNotNull()
    return joined.withColumn("attributes", F.when(hit, "{}").otherwise(F.col("attributes"))).withColumn("attributes_pruned", hit | F.coalesce("attributes_pruned", F.lit(False))).drop("old_trace")


#: Tables of a store. Every write appends one version; what a version is complete with stands in ``commits``, which is written last, so that
#: readers never see half of it.
TRACE_TABLES, DIAGNOSIS_TABLES = ("traces", "spans", "steps"), ("diagnoses", "signals", "divergences", "adjudications")


def _only(fields: list[str]):
    """A function that keeps these fields of a struct."""
    return lambda x: F.struct(*(x[c].alias(c) for c in fields))


class Store:
    """Append-only tables under one folder, with views of the latest committed versions. One writer at a time.

    Re-ingesting a trace replaces its header, spans and steps and keeps the time of its first ingestion; a diagnosis is never
    overwritten, several of one trace stand side by side; cluster assignments, labels and benchmark cases show their latest row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _version(self) -> int:
        return (self.spark.read.parquet(f"{self.folder}/commits").agg(F.max("version")).first()[0] + 1) if self._exists("commits") else 1

    def _append(self, tables: dict[str, tuple[DataFrame, str]]) -> int:
        version = self._version()
        for name, (df, key) in tables.items():
            if not self._exists(f"schema/{name}"):  # an empty write leaves no file that would tell
                self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{self.folder}/schema/{name}")
            append(df, f"{self.folder}/{name}", version, key)
        self.spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{self.folder}/commits")
        return version

    def _committed(self, name: str) -> DataFrame:
        done = self.spark.read.parquet(f"{self.folder}/commits").select(F.col("version").alias("done")).distinct()
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schema/{name}").first()[0])).add("version", IntegerType()).add("bucket", IntegerType())
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows.join(F.broadcast(done), F.col("version") == F.col("done"), "left_semi")  # one row a write

    def latest(self, name: str, key: str) -> DataFrame:
        """All rows of every key's latest committed version."""
        rows = self._committed(name)
        newest = rows.groupBy(F.col(key).alias("k")).agg(F.max("version").alias("v"))
        return rows.join(newest, F.col(key).eqNullSafe(F.col("k")) & (F.col("version") == F.col("v"))).drop("k", "v", "version", "bucket")

    def write_traces(self, traces: DataFrame, spans: DataFrame, steps: DataFrame, now) -> int:
        """Headers (trace_id, ...), spans and steps of whole traces in one version."""
        return self._append({n: (df.withColumn("ingested_at", F.lit(now).cast("timestamp")) if n == "traces" else df, "trace_id") for n, df in zip(TRACE_TABLES, (traces, spans, steps), strict=True)})

    def traces(self) -> DataFrame:
        """The latest header of every trace, with the time of its first ingestion."""
        first = self._committed("traces").groupBy(F.col("trace_id").alias("f_t")).agg(F.min("ingested_at").alias("first_at"))
        return self.latest("traces", "trace_id").join(first, F.col("trace_id") == F.col("f_t")).withColumn("ingested_at", F.col("first_at")).drop("f_t", "first_at")

    def read_trace(self, trace_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(header, spans by start and id, steps by index) of one trace, each empty if there is none; only the trace's bucket is read."""
        bucket = F.pmod(F.xxhash64(F.lit(trace_id)), F.lit(BUCKETS)).cast("int")
        header = self._committed("traces").where((F.col("bucket") == bucket) & (F.col("trace_id") == trace_id))
        last = header.agg(F.max("version").alias("last"))
        part = lambda n: self._committed(n).where((F.col("bucket") == bucket) & (F.col("trace_id") == trace_id)).join(last, F.col("version") == F.col("last"), "left_semi").drop("version", "bucket")
        return part("traces"), part("spans").orderBy("start_ns", "span_id"), part("steps").orderBy("step_index")

    def write_diagnoses(self, diagnoses: DataFrame, signals: DataFrame, divergences: DataFrame, adjudications: DataFrame) -> int:
        """Diagnoses and what they rest on, all keyed by diagnosis_id. The children keep the order of their column ord."""
        return self._append(dict(zip(DIAGNOSIS_TABLES, ((df, "diagnosis_id") for df in (diagnoses, signals, divergences, adjudications)), strict=True)))

    def diagnoses(self, trace_id: str | None = None) -> DataFrame:
        """Diagnoses by created_at, of one trace or all, each with its children as lists in their order."""
        own = self.latest("diagnoses", "diagnosis_id")
        own = own if trace_id is None else own.where(F.col("trace_id") == trace_id)
        for name in DIAGNOSIS_TABLES[1:]:
            rows = self.latest(name, "diagnosis_id")
            fields = [c for c in rows.columns if c not in ("diagnosis_id", "ord")]
            lists = rows.groupBy(F.col("diagnosis_id").alias("c_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), _only(fields)).alias(name))
            own = own.join(lists, F.col("diagnosis_id") == F.col("c_id"), "left").drop("c_id")
        return own.orderBy("created_at", "diagnosis_id")

    def write_assignments(self, assigned: DataFrame) -> int:
        """cluster_id (null for noise) of every diagnosis of a clustering run; clusters of earlier runs stay."""
        return self._append({"assignments": (assigned.select("diagnosis_id", "cluster_id", "run_id"), "diagnosis_id")})

    def previous_membership(self, ids: DataFrame) -> DataFrame:
        """diagnosis_id and the cluster it is in now, of those among ids that are in one."""
        own = ids.select(F.col("diagnosis_id").alias("i_id")).distinct()
        return self.latest("assignments", "diagnosis_id").where("cluster_id is not null").join(own, F.col("diagnosis_id") == F.col("i_id"), "left_semi").select("diagnosis_id", "cluster_id")

    def write_labels(self, labels: DataFrame, now) -> int:
        """The labels that were made without an error, as of now; others keep what they have."""
        return self._append({"labels": (labels.where("error is null and label is not null").drop("error").withColumn("labeled_at", F.lit(now).cast("timestamp")), "cluster_id")})

    def write_cases(self, cases: DataFrame) -> int:
        """Benchmark cases by case_id; the latest row of each counts."""
        return self._append({"cases": (cases, "case_id")})
