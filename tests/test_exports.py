"""Ordered export: global order, manifest, publication, damage."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from donorlens.sources import sinks

SCHEMA = "id bigint, name string, amount decimal(10,2), day date"


def made(spark, n=500):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 10 == 3, F.lit('a "b"; c\nd')).otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        (F.col("id") * 37 % 101).cast("decimal(10,2)").alias("amount"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"))


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="donorlens-ordered-"), "report")


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_rows_come_back_in_order(spark, partitions):
    rows = made(spark).repartition(5)
    path = sinks.export_ordered(rows, folder(), [F.col("amount").desc(), "id"], partitions, rows_per_file=64)
    assert not glob.glob(f"{path}*.staged*")
    files = sinks.manifest(spark, path).orderBy("file_no").collect()
    assert [f.first_row for f in files] == [sum(g.n_rows for g in files[:k]) for k in range(len(files))] and max(f.n_rows for f in files) <= 64
    got = sinks.read_ordered(spark, path, SCHEMA).orderBy("place").collect()
    want = sorted(rows.collect(), key=lambda r: (-r.amount, r.id))
    assert [r.place for r in got] == list(range(1, 501))
    assert [(r.id, r.name, r.amount, r.day) for r in got] == [(r.id, r.name and r.name.replace("\n", " "), r.amount, r.day) for r in want]


def test_damage_is_found(spark):
    path = sinks.export_ordered(made(spark), folder(), ["id"], 3)
    assert sinks.damaged_files(spark, path).count() == 0
    first, second, *_ = sorted(glob.glob(f"{path}/rows/*.csv"))
    for crc in glob.glob(f"{path}/rows/.*.crc"):
        os.remove(crc)
    with open(first, encoding="utf-8") as f:
        text = f.read()
    with open(first, "w", encoding="utf-8") as f:
        f.write(text.replace("n1;", "n7;", 1))
    os.remove(second)
    assert sinks.damaged_files(spark, path).count() == 2
    with pytest.raises(ValueError, match="damaged"):
        sinks.read_ordered(spark, path, SCHEMA)


def test_an_export_is_not_written_over(spark):
    path = sinks.export_ordered(made(spark, 5), folder(), ["id"])
    with pytest.raises(ValueError, match="exists"):
        sinks.export_ordered(made(spark, 5), path, ["id"])
    empty = sinks.export_ordered(made(spark, 0), folder(), ["id"])
    assert sinks.read_ordered(spark, empty, SCHEMA).count() == 0
