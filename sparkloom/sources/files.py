"""CSV, Parquet, JSON and NDJSON readers and writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.strings import java_pattern
from sparkloom.storage import small_side
from sparkloom.types import dtype


def from_records(spark: SparkSession, records: Sequence[dict[str, Any]], schema: dict[str, str] | None = None) -> DataFrame:
    """Rows of dictionaries; keys that one lacks are null. Types are those given, or inferred from all
    values: int, int with float gives double, bool, else string; all null gives string."""
    names = list(dict.fromkeys(k for r in records for k in r)) if schema is None else list(schema)
    types = {n: dtype(t) for n, t in schema.items()} if schema else {n: _infer([r.get(n) for r in records]) for n in names}
    rows = [tuple(_fit(r.get(n), types[n]) for n in names) for r in records]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, types[n]) for n in names]))


def from_columns(spark: SparkSession, columns: dict[str, Sequence[Any]], schema: dict[str, str] | None = None) -> DataFrame:
    """Columns of equal length."""
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    n = len(next(iter(columns.values()), []))
    types = {k: dtype(schema[k]) if schema else _infer(c) for k, c in columns.items()}
    rows = [tuple(_fit(c[i], types[k]) for k, c in columns.items()) for i in range(n)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, t) for k, t in types.items()]))


def _infer(values: Sequence[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if len(kinds) == 1 and str not in kinds:
        return T._infer_type(next(v for v in values if v is not None))
    return T.StringType()


def _fit(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.DoubleType) and isinstance(v, int):
        return float(v)
    if isinstance(t, T.StringType) and not isinstance(v, str):
        return json.dumps(v) if isinstance(v, (dict, list, bool)) else str(v)
    return v


# ---- CSV


def infer_csv_types(df: DataFrame, rows: int = 100) -> dict[str, str]:
    """By the first rows of a table of strings: bigint, else double, else boolean, else string; a column
    without values is a string."""
    sample = df.limit(rows)
    tests = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        some = F.count(v) > 0
        whole = F.count(v) == F.count(F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), v.try_cast("bigint")))
        real = F.count(v) == F.count(v.try_cast("double"))
        flag = F.count(v) == F.count(F.when(F.lower(F.trim(v)).isin("true", "false"), 1))
        tests.append(F.when(~some, "string").when(whole, "bigint").when(real, "double").when(flag, "boolean").otherwise("string").alias(f"t{i}"))
    found = sample.agg(*tests).first() if tests else ()
    return dict(zip(df.columns, found, strict=True))


def read_csv(
    spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", skip_rows: int = 0, comment: str | None = None, columns: Sequence[str] | None = None, null_values: Sequence[str] = ("",),
    infer_rows: int = 100, types: dict[str, str] | None = None, parse_dates: Sequence[str] = (), date_format: str | None = None, schema: T.StructType | None = None, multi_line: bool = True,
) -> DataFrame:
    """CSV files as a table. skip_rows lines at the start of each file are left out; then a quoted value can't
    have line breaks. Otherwise it can; without multi_line it can't either, and a large file is read by several
    tasks, the form for files of many gigabytes. Given types win; the others are inferred from the first rows, and what
    doesn't fit is null. Short rows are filled with nulls. Without a header the columns are column_0,
    column_1 and so on. An empty file has no columns, a header alone no rows. With a schema nothing is
    inferred and no job runs before the read, the form to use on large inputs."""
    reader = spark.read.option("sep", delimiter).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if comment:
        reader = reader.option("comment", comment)
    if schema is not None and not skip_rows:
        raw = reader.option("header", header).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path)
        types = {f.name: f.dataType for f in schema.fields}
    else:
        if spark.read.text(path).isEmpty():
            return spark.createDataFrame([], T.StructType([]))
        if skip_rows:
            raw = _csv_lines(spark, path, skip_rows, header, delimiter, comment)
        else:
            raw = reader.option("header", header).option("inferSchema", False).csv(path)
        if not header:
            raw = raw.toDF(*[f"column_{i}" for i in range(len(raw.columns))])
    if columns:
        missing = [c for c in columns if c not in raw.columns]
        if missing:
            raise ValueError(f"column not found: {missing[0]}")
        raw = raw.select(*[f"`{c}`" for c in columns])
    nulls = list(null_values)
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")).alias(c) if nulls else F.col(f"`{c}`") for c in raw.columns])
    chosen: dict[str, Any] = infer_csv_types(raw, infer_rows) if schema is None else {}
    chosen |= types or {}
    out = []
    for c in raw.columns:
        v = F.col(f"`{c}`")
        if c in parse_dates:
            v = F.try_to_timestamp(v, F.lit(java_pattern(date_format))) if date_format else v.try_cast("timestamp")
        else:
            t = chosen.get(c, "string")
            t = t if isinstance(t, T.DataType) or t in ("bigint", "double", "boolean", "string") else dtype(t)
            v = v.try_cast(t) if t in ("string", "boolean") or isinstance(t, (T.StringType, T.BooleanType)) else F.trim(v).try_cast(t)
        out.append(v.alias(c))
    return raw.select(*out)


def _csv_lines(spark: SparkSession, path: str, skip: int, header: bool, delimiter: str, comment: str | None) -> DataFrame:
    """The lines of CSV files but for the first ones of each, parsed as texts.

    A file's first lines are in its first block and are numbered there one after the other, so the number of
    the first one, a row for each file, tells which lines to leave out."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    lines = spark.read.text(path).select("value", *place)
    firsts = lines.where("block = 0").groupBy("file").agg(F.min("place").alias("start")).withColumnRenamed("file", "of_file")
    marked = lines.join(small_side(firsts, 100_000), F.col("file") == F.col("of_file"), "left")
    at = F.when(F.col("block") == 0, F.col("place") - F.col("start"))
    wanted = marked.select("value", "file", at.alias("at")).where(F.col("at").isNull() | (F.col("at") >= skip))
    head = wanted.where(F.col("at") == skip).orderBy("file").select("value").first()
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parse = lambda value, n: F.from_csv(value, ", ".join(f"c{i} string" for i in range(n)), options)
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names = [f for f in spark.range(1).select(parse(F.lit(head[0]), head[0].count(delimiter) + 1).alias("r")).first()["r"] if f is not None]
    body = wanted.where(F.col("at").isNull() | (F.col("at") > skip)) if header else wanted
    body = body.where(F.trim("value") != "")
    if comment:
        body = body.where(~F.startswith("value", F.lit(comment)))
    rows = body.select(parse(F.col("value"), len(names)).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


scan_csv = read_csv


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", null_value: str = "", float_format: str | None = None, quote_all: bool = False, single_file: bool = False) -> None:
    """A folder of part files; with single_file one part, written by one task."""
    if float_format:
        df = df.withColumns({f.name: F.format_string(float_format, F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))})
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("sep", delimiter).option("header", header).option("nullValue", null_value).option("emptyValue", '""').option("quoteAll", quote_all).option("escape", '"').csv(path)


# ---- Parquet


def read_parquet(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, limit: int | None = None, where: Column | None = None, schema: T.StructType | None = None, merge_schema: bool = False,
    batch_rows: int | None = None, split_bytes: int | None = None,
) -> DataFrame:
    """Columns and condition reach the scan. A schema saves reading the files' own; merge_schema unites theirs.
    batch_rows and split_bytes (of a file, for a task) set the session's reader; they don't change results."""
    for key, value in (("spark.sql.parquet.columnarReaderBatchSize", batch_rows), ("spark.sql.files.maxPartitionBytes", split_bytes)):
        if value is not None:
            if value <= 0:
                raise ValueError(f"not positive: {value}")
            spark.conf.set(key, value)
    reader = spark.read.option("mergeSchema", merge_schema)
    df = (reader.schema(schema) if schema is not None else reader).parquet(*([path] if isinstance(path, str) else path))
    df = df.where(where) if where is not None else df
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"column not found: {missing[0]}")
        df = df.select(*columns)
    return df.limit(limit) if limit is not None else df


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int = 128 << 20, page_bytes: int = 1 << 20, dictionary: bool = True, partition_by: Sequence[str] = ()) -> None:
    if compression not in ("none", "snappy", "gzip", "zstd", "lz4"):
        raise ValueError(f"unknown compression: {compression}")
    w = df.write.mode("overwrite").option("compression", compression).option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", dictionary)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


# ---- JSON


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs become columns named by their path, lists their JSON text."""
    out: list[Column] = []

    def walk(t: T.DataType, c: Column, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f.dataType, c[f.name], f"{name}{sep}{f.name}")
        elif isinstance(t, (T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(name))
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        walk(f.dataType, F.col(f"`{f.name}`"), f.name)
    return df.select(*out)


def _json(spark: SparkSession, path: str, lines: bool, schema: T.StructType | None, columns: Sequence[str] | None, skip_invalid: bool, flat: bool, limit: int | None) -> DataFrame:
    reader = spark.read.option("multiLine", not lines).option("mode", "DROPMALFORMED" if skip_invalid else "FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    df = flatten(df) if flat else df
    df = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return df.limit(limit) if limit is not None else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None, skip_invalid: bool = False, flat: bool = False, limit: int | None = None) -> DataFrame:
    """A file of one array of records, or of one record; .gz by its extension."""
    return _json(spark, path, False, schema, columns, skip_invalid, flat, limit)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None, skip_invalid: bool = False, flat: bool = False, limit: int | None = None) -> DataFrame:
    """A record a line."""
    return _json(spark, path, True, schema, columns, skip_invalid, flat, limit)


def read_chunks(df: DataFrame, size: int, callback: Callable[[list[dict[str, Any]]], None]) -> int:
    """Calls back with lists of at most `size` records, fetched a partition at a time; an error of the
    callback ends it. Returns the number of calls."""
    calls, chunk = 0, []
    for row in df.toLocalIterator():
        chunk.append(row.asDict(recursive=True))
        if len(chunk) == size:
            callback(chunk)
            calls, chunk = calls + 1, []
    if chunk:
        callback(chunk)
        calls += 1
    return calls


def write_ndjson(df: DataFrame, path: str, compression: str = "none", single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("compression", compression).option("ignoreNullFields", False).json(path)


#: Rows of a table that is put together on the driver, or in one value, at most.
JSON_ROWS = 1_000_000


def to_json_text(df: DataFrame, orient: str = "records", pretty: bool = False) -> str:
    """The whole table as one JSON text on the driver: records, columns or values. ValueError beyond JSON_ROWS."""
    if df.limit(JSON_ROWS + 1).count() > JSON_ROWS:
        raise ValueError(f"more than {JSON_ROWS} rows: use write_json or write_ndjson")
    rows = [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    if orient == "columns":
        data: Any = {c: [r[c] for r in rows] for c in df.columns}
    elif orient == "values":
        data = [[r[c] for c in df.columns] for r in rows]
    elif orient == "records":
        data = rows
    else:
        raise ValueError("orient is records, columns or values")
    return json.dumps(data, indent=2 if pretty else None, ensure_ascii=False)


def write_json(df: DataFrame, path: str, orient: str = "records", pretty: bool = False, compress: bool = False) -> None:
    """One JSON text in one part file. Records and values are streamed through one task, a row at a time, at any
    size; pretty texts and columns are put together on the driver, up to JSON_ROWS. write_ndjson writes in parallel."""
    if pretty or orient == "columns":
        text = df.sparkSession.createDataFrame([(to_json_text(df, orient, pretty),)], "value string")
    elif orient in ("records", "values"):
        cell = F.col("r")
        rows = df.coalesce(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
        if orient == "values":
            parts = [F.substring(F.to_json(F.array(F.col(f"`{c}`"))), 2, 2**30) for c in df.columns]
            cell = F.concat(F.lit("["), *[x for i, p in enumerate(parts) for x in ([F.lit(",")] if i else []) + [F.left(p, F.char_length(p) - 1)]], F.lit("]"))
            rows = df.coalesce(1).select(cell.alias("r"))

        def punctuated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = "["
            for batch in batches:
                lines = []
                for row in batch.column(0).to_pylist():
                    lines.append(before + row)
                    before = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
            yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"], pa.string())], names=["value"])

        text = rows.mapInArrow(punctuated, "value string")
    else:
        raise ValueError("orient is records, columns or values")
    text.coalesce(1).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


# ---- Arrow


def from_arrow(spark: SparkSession, table: Any) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> Any:
    """The whole table on the driver."""
    return df.toArrow()
