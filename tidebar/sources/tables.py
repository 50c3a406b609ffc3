"""Tables partitioned by symbol and date: reading with pruning, idempotent writing, listing, sizes and removal."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidebar.functions.scalars import human_size


def read(spark: SparkSession, root: str, columns: list[str] | None = None, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A partitioned table; symbols and dates (both ends included) prune partitions, columns prune the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("basePath", root).parquet(root)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols)) if symbols else df.where(F.lit(False))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast(dict(df.dtypes)["date"]))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast(dict(df.dtypes)["date"]))
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, roots: list[str], name: str | None = None, **options) -> DataFrame:
    """The tables of several places as one, columns by name (null where a place lacks one); each place's partitions are pruned
    as in ``read``. name: a column that tells the place."""
    out = None
    for root in roots:
        df = read(spark, root, **options)
        df = df.withColumn(name, F.lit(root)) if name else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no places to read")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_first(spark: SparkSession, roots: list[str], fetch: Callable[[], DataFrame] | None = None, **options) -> DataFrame:
    """The table of the first place that has it; else what fetch brings, written to the first place and read again."""
    for root in roots:
        if exists(spark, root):
            return read(spark, root, **options)
    if fetch is None:
        raise FileNotFoundError(f"none of {roots}")
    write(fetch(), roots[0])
    return read(spark, roots[0], **options)


def write(df: DataFrame, *roots: str, by: tuple[str, ...] = ("symbol", "date")) -> None:
    """Replaces the partitions that df has rows of, in each place, and leaves the others: writing twice changes nothing. For
    several places the table is computed once and kept meanwhile."""
    dealt = df.repartition(*by)
    if len(roots) > 1:
        dealt = dealt.persist()
    try:
        for root in roots:
            dealt.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    finally:
        if len(roots) > 1:
            dealt.unpersist()


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and bytes of every file under root, of whatever kind. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"))


def keys(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Distinct partition values as strings, from the files' paths: list_symbols is keys(.., "symbol"), dates of a symbol
    keys(.., "date") with a filter."""
    value = lambda c: F.url_decode(F.regexp_extract("path", f"/{c}=([^/]*)/", 1)).alias(c)
    rows = listed(spark, root).where(F.col("path").endswith(".parquet") | F.col("path").endswith(".feather"))
    return rows.select(*map(value, columns or ("symbol", "date"))).distinct()


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """path and bytes of each file, with the size as text."""
    return listed(spark, root).withColumn("size", human_size(F.col("bytes")))


def read_matching(spark: SparkSession, pattern: str, schema: str | None = None, **options) -> DataFrame:
    """CSV files with a header that match a glob pattern, as one table, columns by name; without a schema types are inferred."""
    reader = spark.read.options(header=True, enforceSchema=False, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(pattern)


def remove(spark: SparkSession, root: str, symbol: str, date: str | None = None) -> bool:
    """Removes a symbol's partition or one date of it; true if there was one. Values that would leave the root are refused."""
    for v in (symbol, date):
        if v is not None and (not str(v) or "/" in str(v) or ".." in str(v)):
            raise ValueError(f"not a partition value: {v!r}")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/symbol={symbol}" + (f"/date={date}" if date is not None else ""))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feather (Arrow IPC) files under a path, with the columns of the schema; a file is a task's work at the least.

    Files come through Spark's binary reader, so any store that Spark reads will do. Of a file only the columns asked for are
    decoded, a record batch after another. Columns that a file lacks are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").option("recursiveFileLookup", "true").load(path).select("content")
    want = [f.name for f in spark.createDataFrame([], schema).schema]
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                data = content.as_buffer()
                names = pa.ipc.open_file(pa.BufferReader(data)).schema.names
                options = pa.ipc.IpcReadOptions(included_fields=[k for k, c in enumerate(names) if c in want])
                file = pa.ipc.open_file(pa.BufferReader(data), options=options)
                for k in range(file.num_record_batches):
                    part = file.get_batch(k)
                    have = set(part.schema.names)
                    yield pa.RecordBatch.from_arrays([part[c].cast(arrow.field(c).type) if c in have else pa.nulls(part.num_rows, arrow.field(c).type) for c in want], want)

    return files.mapInArrow(parse, schema)


def problems(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by and problem for each key whose rows have a column without any value: a table of failures, not a silent skip."""
    counts = df.groupBy(*by).agg(*(F.count(v).alias(v) for v in values))
    found = F.array_compact(F.array(*(F.when(F.col(v) == 0, F.lit(f"no {v}")) for v in values)))
    return counts.select(*by, F.explode(found).alias("problem"))
