"""The data source of JSON lines: splits, columns, streams, and writes that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from echoloom.sources.lines import NAME, Range, lines_of, register_lines


def test_ranges_have_each_line_once(tmp_path):
    lines = [("x" * (k * 7 % 23)).encode() for k in range(60)]
    for text in (b"\n".join(lines) + b"\n", b"\n".join(lines[:-1] + [b"end"])):
        (tmp_path / "a").write_bytes(text)
        whole = text.removesuffix(b"\n").split(b"\n")
        for split in (1, 2, 5, 17, 100, 10_000):
            got = [x for low in range(0, len(text), split) for x in lines_of(str(tmp_path), Range(str(tmp_path / "a"), low, min(len(text), low + split)), chunk=3)]
            assert got == whole, split


def test_reading_writing_and_streaming(spark, tmp_path):
    register_lines(spark)
    at = f"{tmp_path}/lines"
    rows = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.concat(F.lit("é 中 "), "id").alias("prompt"), F.when(F.col("id") % 7 != 0, F.lit('{"a": 1}')).alias("response"))
    rows.repartition(3).write.format(NAME).mode("append").save(at)
    got = spark.read.format(NAME).option("split_bytes", 700).load(at)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, rows.collect())))
    assert spark.read.format(NAME).schema("prompt string").load(at).columns == ["prompt"] and spark.read.format(NAME).schema("prompt string, none string").load(at).filter("none IS NULL").count() == 500
    stream = spark.readStream.format(NAME).option("path", at).load()
    for n in (500, 503):
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").count() == n
        rows.limit(3).write.format(NAME).mode("append").save(at)
    rows.limit(9).write.format(NAME).mode("overwrite").save(at)
    assert spark.read.format(NAME).load(at).count() == 9
    assert spark.read.format(NAME).load(f"{tmp_path}/nothing").count() == 0


def test_a_failed_task_leaves_no_rows(spark, tmp_path):
    register_lines(spark)
    at = f"{tmp_path}/lines"
    good = spark.range(4).select(F.col("id").cast("string").alias("source"))
    good.write.format(NAME).mode("append").save(at)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("source"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format(NAME).mode("append").save(at)
    assert spark.read.format(NAME).schema("source string").load(at).count() == 4
    assert not [x for x in os.listdir(at) if x.startswith("_pending")]


def test_blank_and_malformed_lines(spark, tmp_path):
    register_lines(spark)
    (tmp_path / "a.jsonl").write_text('\n  \n{"source": "x", "prompt": ["a", {"b": 1}]}\n\n')
    assert [tuple(r) for r in spark.read.format(NAME).load(str(tmp_path)).collect()] == [("x", json.dumps(["a", {"b": 1}]), None)]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="malformed line"):
        spark.read.format(NAME).load(str(tmp_path)).collect()


def test_a_large_table_has_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    """A task a range, 75,000 of them at 75 GB, cost more than the lines."""
    from pyspark.sql import types as T

    from echoloom.sources import lines

    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"source": f"s{k}"}) + "\n" for k in range(3000)))
    schema = T.StructType([T.StructField("source", T.StringType())])
    reader = lines.LineReader(str(tmp_path), schema, 10)
    parts = reader.partitions()
    assert lines.MOST_TASKS >= len(parts) > 400
    got = [x for p in parts for b in reader.read(p) for x in b.column("source").to_pylist()]
    assert got == [f"s{k}" for k in range(3000)]
