"""Scans with column contracts (A1), text documents (A2), projected log scans (A3),
nested JSON decoding (A4), dataset fingerprints (A7), and the batch sinks: log
append (A5) and metrics reports (A9).

All scans are plain ``spark.read`` with an explicit projection so Catalyst
prunes columns at the file reader; CSV is read as all-string (no schema
inference pass over 100 TB) and coerced by the B-operators.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """A1 contract: keep ``required`` columns, fail listing every missing one."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing required columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in required])


def read_table(spark: SparkSession, path: str, required: Sequence[str] | None = None, fmt: str | None = None) -> DataFrame:
    """A1: CSV (header, every column as string) or parquet, then the column contract."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return require_columns(df, required) if required else df


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """A2: whole text files as (source, text), and the columns that the folders' names give."""
    df = spark.read.text(path, wholetext=True)
    more = [c for c in df.columns if c != "value"]
    return df.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"), *more)


def scan_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A2 over a document table: (source, text, characters, lines)."""
    return docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("text"),
                       F.length(text_col).alias("n_chars"), F.size(F.split(F.col(text_col), "\n")).alias("n_lines"))


def scan_prediction_log(log: DataFrame, group_col: str = "income_band", risk_col: str = "risk_percent",
                        keep: Sequence[str] = ()) -> DataFrame:
    """A3: only the fields the fairness job needs (pruned at the reader)."""
    return log.select(*keep, F.col(group_col).alias("group_value"), F.col(risk_col).alias("risk_percent"))


def parse_json_column(df: DataFrame, col: str, schema: T.StructType | str, out: str = "doc") -> DataFrame:
    """A4: decode a JSON text column; rows that are no JSON, or do not fit ``schema``, get ``valid = False``
    (quarantine) and keep the fields that could be read."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_corrupt_record"
    full = T.StructType([*kind.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json(F.col(col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    valid = F.col(col).isNotNull() & F.col(out).isNotNull() & F.col(f"{out}.{bad}").isNull()
    return df.withColumn(out, parsed).withColumn("valid", valid).withColumn(out, F.col(out).dropFields(bad))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """A7 for tables: order-insensitive fingerprint = row count + sum of 32-bit md5 prefixes of each row.

    Independent of partitioning and file layout (a sum commutes); NULLs are
    written as 'nan' so (NULL, 'a') and ('a', NULL) differ.
    """
    row = F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in df.columns])
    h = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("fingerprint"))


#: Bytes that hashing a file holds at a time.
HASH_BYTES = 8 << 20


def file_sha256(spark: SparkSession, path: str, chunk: int = HASH_BYTES) -> DataFrame:
    """A7 for files: (path, length, sha256) of the files at ``path`` (a folder, file or glob), of any size.

    The listing reads no content; a task streams its files in chunks, through the store's own file system.
    Spark lists no empty files, so they have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            out = []
            for uri in b.column("path").to_pylist():
                scheme, _, rest = uri.partition(":")
                if scheme == "file":  # the listing gives plain names
                    store, at = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    store, at = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest, safe="/@:"))
                h = hashlib.sha256()
                with store.open_input_stream(at) as f:
                    while part := f.read(chunk):
                        h.update(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["path", "length", "sha256"])

    return files.mapInArrow(hashed, "path string, length long, sha256 string")


# ------------------------------------------------------------------ sinks


def append_log(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """A5: append rows to a parquet log (optionally partitioned, e.g. by day); a call that is repeated appends again
    (``commits.append_batch`` does not).

    Executors write their own files; nothing passes through the driver.  The
    streaming jobs use the same layout through their parquet / foreachBatch sinks.
    """
    w = df.write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def metrics_tall(metrics: DataFrame, section: str, id_cols: Sequence[str] = ()) -> DataFrame:
    """A wide metrics frame as tall ``(section, id..., metric, value)`` rows (``unpivot``)."""
    values = [c for c in metrics.columns if c not in id_cols]
    cast = metrics.select(*id_cols, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return cast.unpivot(list(id_cols), values, "metric", "value").select(
        F.lit(section).alias("section"), *id_cols, "metric", "value")


def write_metrics_report(tall: DataFrame, path: str) -> None:
    """Write tall metric rows as JSON lines (overwrite: a report is one snapshot)."""
    tall.write.mode("overwrite").json(path)
