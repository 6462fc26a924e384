"""What the operators share: scratch tables, word splitting, and Arrow maps over (id, text)."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workdir import workdir as scratch

#: A word is a run of characters outside this set; ``bytes.split()`` splits at exactly these.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict[str, list] = {}


def kept(function):
    """Register a cached function (functools.lru_cache) whose values a worker may keep from task to task of one module.

    A worker that goes on to another module's tasks drops them first, so that operators that follow one another in
    the same workers don't add up their memory.
    """
    _KEPT.setdefault(function.__module__, []).append(function)
    return function


def _drop_others(module: str) -> None:
    old = [f for m, fs in _KEPT.items() if m != module for f in fs if f.cache_info().currsize]
    for f in old:
        f.cache_clear()
    if old:
        gc.collect()


def map_rows(
    df: DataFrame, columns: list[str], schema: str, each: Callable[[Iterator[tuple]], Iterable[tuple]]
) -> DataFrame:
    """Rows of the chosen columns through a Python generator, one call per partition, by Arrow batches.

    ``each`` gets an iterator over batches, each a list of Python columns, and yields lists of
    output rows; output leaves in batches as they fill, so memory stays bounded.
    """
    spark = df.sparkSession
    arrow, module = _arrow_schema(spark, schema), each.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(module)
        for rows in each(tuple(b.column(i).to_pylist() for i in range(b.num_columns)) for b in _small(batches)):
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def map_arrays(df: DataFrame, columns: list[str], schema: str, each: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """As map_rows, but ``each`` yields tuples of equally long numpy arrays."""
    arrow, module = _arrow_schema(df.sparkSession, schema), each.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(module)
        for cols in each(tuple(b.column(i).to_pylist() for i in range(b.num_columns)) for b in _small(batches)):
            for at in range(0, len(cols[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 17)], f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with little to do may put off for long.
    Callers build each phase in a function of its own, so that no variable keeps a finished plan.
    """
    for _ in range(2):  # the first round frees Python's handles, so that the second finds their plans unused
        gc.collect()
        spark._jvm.System.gc()


def _small(batches: Iterator[pa.RecordBatch], target: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to about ``target`` bytes, so that Python objects are made for few rows at a time."""
    for b in batches:
        n = max(1, min(b.num_rows, int(b.num_rows * target / max(1, b.nbytes)) or 1))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; none for null."""
    return text.encode().split() if text else []


#: Bytes that no term holds become spaces, A-Z become a-z; bytes of characters beyond ASCII stay.
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII as UTF-8 bytes, with A-Z lower-cased; none for null."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def null_key(col: str):
    """A string key in which null has a value of its own."""
    return F.concat(F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(col).cast("string"), F.lit("")))
