"""Reading the corpus tables, and running Arrow code over the rows of a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm.pieces import slices

# Bytes of text handed over at once; bounds the working memory of a task.
SLICE_BYTES = 1 << 20
# Bytes of a batch where rows hold one or two whole texts.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, so that extra columns cannot clash."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{name}_"
    return name


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(text, F.lit("")).cast("binary")


def repeats(df: DataFrame, key: str) -> bool:
    """Whether some value of `key` stands in more than one row; reads that column alone."""
    counted = df.groupBy(df[key].alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return not counted.filter("n > 1").isEmpty()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives Python batches of some MB at most: the usual number of rows of
    whole texts is a hundred and more, which the executor and its worker hold at once."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def map_rows(
    df: DataFrame,
    keys: Sequence[str],
    text: Column | str,
    make: Callable[[], Callable[[bytes], tuple]],
    schema: str,
) -> DataFrame:
    """`keys` of every row beside the tuple that a function makes of its text's bytes.

    `text` is a column of bytes, or the name of a string column among `keys`, which is not
    sent twice then; its nulls count as no bytes. `make` runs once per task and returns that
    function; `schema` names and types the tuple. Rows pass in slices of Arrow batches of
    about `SLICE_BYTES` of text, and nothing is kept between them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    named = isinstance(text, str)
    given = df.select(*keys) if named else df.select(*keys, text.alias("_text"))
    whole = StructType([*given.schema.fields[: len(keys)], *added.fields])
    fields = to_arrow_schema(added)
    n_keys = len(keys)
    place = list(keys).index(text) if named else n_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for received in batches:
            given = received.column(place)
            lengths = pc.list_value_length(given) if pa.types.is_list(given.type) else pc.binary_length(given)
            for start, stop in slices(lengths.fill_null(0).to_pylist(), SLICE_BYTES):
                batch = received.slice(start, stop - start)
                body = batch.column(place)
                if named:
                    body = body.cast(pa.binary()).fill_null(b"")
                columns = zip(*[function(x) for x in body.to_pylist()], strict=True)
                made = [pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_keys], *made],
                    names=[*batch.schema.names[:n_keys], *fields.names],
                )

    return given.mapInArrow(run, whole)
