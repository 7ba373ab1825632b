"""What the operators share: column selection, Arrow batches and the crc32 folds."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NullType

from loomq.session import expose_package, materialize


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that further columns can't clash.

    Ids are whole numbers; a column of another type is an error here rather than in a task.
    """
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, DecimalType, NullType)):
        raise ValueError(f"{id_col} has to hold whole numbers, not {kind.simpleString()}")
    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return df.select(*columns, *[F.col(f"`{c}`").alias(name) for name, c in more.items()])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to every Arrow batch; batch in, batch out, nothing is kept between batches."""
    expose_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as str; null becomes empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def fold(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod modulus; a null id counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def apart(counted: DataFrame, key: str) -> DataFrame:
    """A stored table with one row for each key, of which Spark no longer knows how it is dealt.

    A join with it deals both sides anew, and only such a join can be split where many rows of the other share a key.
    """
    kind = dict(counted.dtypes)[key]
    again = {"bigint": lambda c: F.bitwise_not(F.bitwise_not(c)), "binary": lambda c: F.unhex(F.hex(c)), "string": lambda c: F.reverse(F.reverse(c))}
    return materialize(counted).withColumn(key, again[kind](F.col(key)))


_holder: list = [None, lambda: None]


def hold(owner: str, release: Callable[[], None]) -> None:
    """What an operator calls on an executor before it uses tables that it keeps there.

    Workers live on from one stage to the next; the tables of the operator before are released.
    """
    if _holder[0] != owner:
        _holder[1]()
        _holder[:] = [owner, release]


def char_class(major: str, limit: int = 0x300) -> str:
    """The body of a regex class: code points below the limit whose Unicode category starts with the letter."""
    found = [c for c in range(limit) if unicodedata.category(chr(c)).startswith(major)]
    spans: list[list[int]] = []
    for c in found:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


#: Texts with a character from here on take the slower general path of the tokenizers.
BEYOND = re.compile("[̀-\U0010ffff]")
