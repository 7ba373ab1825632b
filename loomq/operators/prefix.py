"""Running totals over a whole table without a single-task window, and folds over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomq.session import expose_package, materialize


def totals_before(df: DataFrame, amount: str, order: str, name: str = "offset") -> DataFrame:
    """The rows with the sum of an amount over all rows before them in an order.

    Rows are dealt by ranges of the order and written once; each range's total is one row, so the running sum over the
    ranges is a window over as many rows as there are partitions, and its broadcast is bounded by their number.
    """
    dealt = materialize(df.repartitionByRange(F.col(order)).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(F.sum(amount).alias("__total"))
    before = F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.sum(amount).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.join(F.broadcast(starts), "__range")  # a row for each shuffle partition
    return placed.withColumn(name, (F.col("__start") + F.coalesce(own, F.lit(0))).cast("long")).drop("__range", "__start")


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows with their place, from 1, in an order without ties; dealt and counted by ranges as in totals_before()."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__total"))
    before = F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + own).cast("long")).drop("__range", "__start")


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], inputs: Sequence[Column], fold: Callable[[], Callable[..., tuple]], added: str, dealt_by: Sequence[str] | None = None) -> DataFrame:
    """The rows with added columns ("name type, …") that depend on the rows before them in a way no window frame can say.

    fold() gives a group's step, which takes a row's inputs and returns the added values. Rows are dealt by the keys and
    sorted outside of Python, which sees them in batches one after the other: the work is linear, a group of any size
    needs the memory of its step only, and ties keep all their rows. dealt_by names columns that are equal within a
    group, where the rows lie together by these already.
    """
    expose_package(df.sparkSession)
    columns, names = df.columns, [f"__in{i}" for i in range(len(inputs))]
    ready = df.select("*", *[c.alias(n) for c, n in zip(inputs, names)])
    dealt = ready.repartition(*(dealt_by or keys)) if keys else ready.repartition(1)
    schema = df.limit(0).select("*", *[F.lit(None).cast(a.split(" ", 1)[1]).alias(a.split(" ", 1)[0]) for a in added.split(", ")]).schema
    fields = [a.split(" ", 1)[0] for a in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = None, fold()
        for batch in batches:
            own = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            out = []
            for key, values in zip(own, zip(*[batch.column(n).to_pylist() for n in names])):
                if key != group:
                    group, step = key, fold()
                out.append(step(*values))
            new = pa.Table.from_pylist([dict(zip(fields, row)) for row in out], _arrow(schema, fields))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[new.column(f).combine_chunks() for f in fields]], names=[*columns, *fields])

    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(schema, fields: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(f, to_arrow_type(schema[f].dataType)) for f in fields])
