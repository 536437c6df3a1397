"""Report export.

Reports are handed to users as ';'-separated text files (that is why
descriptions have ';' and line breaks replaced).  ``export_report`` is a plain
distributed write - one file per task under the target folder - or parquet for
machine consumers.

``export_ordered`` writes a report whose rows have an order: the rows are
range-partitioned by it and sorted, so the files, by number, hold them in global
order.  They are written to a folder beside the target with a manifest (file,
rows, checksum, number of the first row) and published by one rename: readers
see all of an export or nothing.  ``read_ordered`` reads the files back,
compares them with the manifest and numbers the rows.  Nothing passes through
the driver; the manifest has one row a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import file_system, folder_exists

SEPARATOR = ";"
ROWS, MANIFEST = "rows", "manifest"
ROW_LIMIT = 1_000_000
LINE, PLACE = "value", "place"
MANIFEST_SCHEMA = "file_no int, file string, n_rows long, checksum long, first_row long"


def export_report(df: DataFrame, path: str, fmt: str = "csv", separator: str = SEPARATOR,
                  header: bool = True, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("sep", separator).option("header", str(header).lower()).option(
            "emptyValue", "").option("nullValue", "").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def _file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)


def _text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value): the lines of the export's files."""
    return spark.read.text(folder).select(_file_name().alias("file"), LINE)


def _checksum() -> Column:
    return F.sum(F.xxhash64(LINE) % F.lit(1 << 40)).cast("long")


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), _checksum().alias("checksum"))


def _with_first_rows(counted: DataFrame) -> DataFrame:
    by_name = Window.orderBy("file")  # one row a file; names are in the order of the ranges
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    return counted.select((F.row_number().over(by_name) - 1).cast("int").alias("file_no"), "file", "n_rows", "checksum",
                          F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long").alias("first_row"))


def export_ordered(df: DataFrame, path: str, order: Iterable[Column | str], partitions: int | None = None, rows_per_file: int = ROW_LIMIT,
                   separator: str = SEPARATOR) -> str:
    """Writes ``df`` in the given order to a new folder ``path``; returns it.

    One row is one line: line breaks within text become blanks, and NULL and
    empty text are the same.  The order should tell rows apart, else equal ones
    may come in any order (and all land in one file's range)."""
    spark, keys = df.sparkSession, list(order)
    if folder_exists(spark, path):
        raise ValueError(f"{path} exists")
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}.staged"
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    ranged = ranged.select(*[F.regexp_replace(F.col(f"`{n}`"), "[\\r\\n]", " ").alias(n) if kind == "string" else F.col(f"`{n}`") for n, kind in ranged.dtypes])
    (ranged.write.option("sep", separator).option("header", "false").option("emptyValue", "").option("nullValue", "")
     .option("maxRecordsPerFile", rows_per_file).csv(f"{staged}/{ROWS}"))
    counted = _with_first_rows(_counted(_text_files(spark, f"{staged}/{ROWS}")))
    counted.write.parquet(f"{staged}/{MANIFEST}")
    system, source = file_system(spark, staged)
    if not system.rename(source, file_system(spark, path)[1]):
        raise OSError(f"cannot publish {path}")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of an export that are missing, unknown or differ from the manifest."""
    found = _counted(_text_files(spark, f"{path}/{ROWS}")).toDF("file", "found_rows", "found_checksum")
    return manifest(spark, path).join(found, "file", "full").where(
        "NOT (n_rows <=> found_rows) OR NOT (checksum <=> found_checksum)")


def read_ordered(spark: SparkSession, path: str, schema: str, separator: str = SEPARATOR) -> DataFrame:
    """The rows of an export with ``place``, from 1, in its order; an error if a file differs from the manifest."""
    bad = damaged_files(spark, path).select("file").limit(3).collect()
    if bad:
        raise ValueError(f"damaged export {path}: {[r['file'] for r in bad]}")
    # a file is read whole by one task (it has at most rows_per_file rows), line by line
    lines = (spark.read.text(f"{path}/{ROWS}", wholetext=True).select(_file_name().alias("file"), F.split(LINE, "\n").alias("lines"))
             .select("file", F.posexplode("lines").alias("line_no", "line")))
    numbered = lines.join(manifest(spark, path).select("file", "n_rows", "first_row"), "file").where("line_no < n_rows")
    parsed = F.from_csv("line", F.lit(schema), {"sep": separator, "nullValue": "", "emptyValue": ""})
    return numbered.select((F.col("first_row") + F.col("line_no") + 1).alias(PLACE), parsed.alias("row")).select("row.*", PLACE)
