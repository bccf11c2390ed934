"""What the corpus operators share: tables, the shared scratch folder, Arrow maps over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from catchwater.scratch import dropped, scratch, written

__all__ = ["dropped", "map_rows", "per_row", "scratch", "small_batches", "spread", "table", "written"]

HOT, KEYS = 256, 100_000  # rows of a key from which they may be dealt to several tasks; keys of which that is done, at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """left joined with right by a key that right has once and left any number of times, even in a third of all rows.

    The rows of a frequent key are dealt to several tasks, and its row of right goes to each of them. Keys are frequent from HOT
    rows on, and from a KEYS-th of all rows, so there are at most KEYS of them, and their list is sent to all tasks.
    left: columns of a written table, which is read twice, without null keys; or any table of which `counted` is a written one with
    as many rows of each key, and `by` a column that tells its rows apart. how: inner or left.
    """
    counted = left if counted is None else counted
    least = max(HOT, counted.count() // KEYS)
    hot = written(counted.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    one = F.coalesce("_parts", F.lit(1))
    place = F.xxhash64(by) if by else F.monotonically_increasing_id()
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(place, one).cast("int")).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def map_rows(df: DataFrame, each: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], schema: str | StructType, rows: int = 256) -> DataFrame:
    """Arrow map. each() is called once a task and gives a function from an iterator of input tuples to output tuples.

    Both sides stream: a task holds one Arrow batch of input and `rows` rows of output.
    """
    out = to_arrow_schema(parsed(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def incoming() -> Iterator[tuple]:
            for batch in batches:
                for k in range(0, batch.num_rows, 128):
                    yield from zip(*(c.to_pylist() for c in batch.slice(k, 128).columns))

        held: list[tuple] = []
        for row in each()(incoming()):
            held.append(row)
            if len(held) >= rows:
                yield packed(held, out)
                held = []
        if held:
            yield packed(held, out)

    return df.mapInArrow(run, parsed(schema))


def parsed(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def packed(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def per_row(f: Callable[[], Callable[..., tuple]]) -> Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]]:
    """For map_rows: one output row for each input row."""

    def each():
        g = f()
        return lambda rows: (g(*row) for row in rows)

    return each


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: bounds a Python worker's memory where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, rows)
