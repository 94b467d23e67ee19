"""Helpers shared by the corpus operators: shared-folder storage, input columns, batch mapping."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import drop_path, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of the operators that run now, the folders that each has written; and the folders that results are read from.
_WRITTEN: list[list[str]] = []
_KEPT: list[str] = []


def store(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """Writes the frame as Parquet in the shared folder and reads it back; returns it and its path."""
    spark = df.sparkSession
    path = new_path(spark)
    (_WRITTEN[-1] if _WRITTEN else _KEPT).append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which goes when the operator that called is done."""
    return store(df)[0]


drop_stored = drop_path


def operator(f: Callable) -> Callable:
    """An operator that leaves no folder in the shared one but those that its result is read from.

    The outermost operator's result keeps its folder until ``release``; those of operators that it called go with it.
    """

    @functools.wraps(f)
    def run(*args, **options):
        written: list[str] = []
        _WRITTEN.append(written)
        held: list[str] = written
        session = None
        try:
            out = f(*args, **options)
            frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
            read = "\n".join(file for x in frames for file in x.inputFiles())
            held = [path for path in written if path.rpartition("/")[2] not in read]
            (_WRITTEN[-2] if len(_WRITTEN) > 1 else _KEPT).extend(set(written) - set(held))
            return out
        finally:
            _WRITTEN.pop()
            session = SparkSession.getActiveSession()
            for path in held if session else ():
                drop_stored(session, path)

    return run


def release(spark: SparkSession) -> None:
    """Deletes the folders that results of operators are read from, when these have been written or are done with."""
    while _KEPT:
        drop_stored(spark, _KEPT.pop())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_texts(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str | T.StructType,
    rows_at_once: int = 512,
) -> DataFrame:
    """Maps batches of some columns, given as lists, to lists of output columns.

    ``make`` builds the mapping function once a task. Batches are cut to ``rows_at_once`` rows, so a
    worker holds few texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out = make(), None
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                got = f({c: part.column(k).to_pylist() for k, c in enumerate(columns)})
                if out is None:
                    out = arrow_schema
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(kind)
    return df.select([F.col(f"`{c}`") for c in columns]).mapInArrow(run, kind)


def map_stream(df: DataFrame, columns: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """Maps the batches of a task, with some columns, to dicts of output columns by one generator a task, which may hold
    bounded state between batches and give what is left at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(kind)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in arrow_schema], schema=arrow_schema)

    return df.select([F.col(f"`{c}`") for c in columns]).mapInArrow(go, kind)


def replace_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows_at_once: int = 512) -> DataFrame:
    """Maps whole batches to batches of the same columns: rows may go and values may change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                yield f(batch.slice(at, rows_at_once))

    return df.mapInArrow(run, df.schema)
