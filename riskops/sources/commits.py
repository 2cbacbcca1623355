"""Writes that are whole or not there: log batches with a manifest (A5) and a version pointer.

Data is written first, under a name nobody reads; the commit is then one rename of a small file, which
the file system does at once. A run that ends half-way leaves data that no manifest names; a replayed
batch finds its manifest and does nothing. All of it goes through Hadoop's file system, so any store that
Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS, DATA = "_manifests", "data"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the store that holds ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def put(spark: SparkSession, path: str, content: dict, replace: bool = False) -> bool:
    """Write ``content`` as JSON to ``path`` in one step. Without ``replace``, False if it is there already."""
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    temp = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    option = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.valueOf("OVERWRITE" if replace else "NONE")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(temp, target, options)
        return True
    except (Py4JJavaError, PySparkException):
        if replace or not fs.exists(target):
            raise
        fs.delete(temp, False)
        return False


def get(spark: SparkSession, path: str) -> dict | None:
    """The content of a file that ``put`` wrote; None if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


# ------------------------------------------------------------------ A5


def append_batch(df: DataFrame, path: str, batch_id: int, partition_cols: Sequence[str] = ()) -> bool:
    """A5: append ``df`` to the log at ``path`` as batch ``batch_id``, once; False if that batch is there already."""
    spark = df.sparkSession
    manifest = f"{path}/{MANIFESTS}/batch-{int(batch_id):012d}.json"
    if get(spark, manifest) is not None:
        return False
    folder = f"batch-{int(batch_id):012d}-{uuid.uuid4().hex}"
    w = df.write
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(f"{path}/{DATA}/{folder}")
    return put(spark, manifest, {"batch": int(batch_id), "folder": folder, "schema": df.schema.jsonValue()})


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of a log, by batch: one small file a batch."""
    fs, p = file_system(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    rows = spark.read.text(f"{path}/{MANIFESTS}/batch-*.json", wholetext=True).collect() if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "batch-*.json")) else []
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["batch"])


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all committed batches, with their ``batch_id``. ``schema`` serves a log without batches."""
    parts = []
    for m in committed(spark, path):
        own = T.StructType.fromJson(m["schema"])
        rows = spark.read.schema(own).parquet(f"{path}/{DATA}/{m['folder']}").select(*own.fieldNames())
        parts.append(rows.withColumn("batch_id", F.lit(m["batch"]).cast("long")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*(schema.fields if schema else []), T.StructField("batch_id", T.LongType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ A8


def publish(spark: SparkSession, base: str, version: str, folder: str) -> None:
    """From now on ``latest`` of ``base`` is ``version``, whose files are all in ``folder``."""
    put(spark, f"{base}/latest.json", {"version": version, "folder": folder}, replace=True)


def latest(spark: SparkSession, base: str) -> dict | None:
    """The version that ``publish`` named last: version and folder; None before the first."""
    return get(spark, f"{base}/latest.json")
