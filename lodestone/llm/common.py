"""Helpers that the corpus operators share: tables, cut lineage, Arrow chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import materialise, shared_dir  # noqa: F401  the operators take them from here

#: Text bytes that one vectorised step works on; a single longer text is a step of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES, texts: pa.Array | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batch of at most `most` text bytes (one row at least), with the texts (by default its column `text`) as large_binary; null texts are empty."""
    texts = (batch.column(batch.schema.get_field_index("text")) if texts is None else texts).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    sizes = pa.compute.binary_length(texts).to_pylist()
    start = total = 0
    for row, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, row - start), texts.slice(start, row - start)
            start, total = row, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start), texts.slice(start)


def named_apart(df: DataFrame, results: list[str]) -> list[str]:
    """The columns of df that no result column replaces (Spark's names ignore case)."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def map_texts(df: DataFrame, fn, results: str, column: str = "text", needs: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """df with result columns, made from chunks of whole texts in Arrow batches; nothing is shuffled.

    fn(texts, batch) gets a large_binary array without nulls and the batch with the columns `needs` (as `in_<name>`),
    and returns one Arrow array for each result column. An input column named as a result is replaced by it, whatever
    its case; all others stay as they are, but for the text column unless keep_text.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = T.StructType.fromDDL(results)
    keep = named_apart(df, [*wanted.names, *([] if keep_text else [column])])
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    inside = column in keep  # the row carries the text already
    packed = df.select(row.alias("row"), *([] if inside else [F.col(f"`{column}`").alias("in_text")]), *[F.col(f"`{c}`").alias(f"in_{c}") for c in needs])
    types = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, texts=batch.column(0).field(keep.index(column)) if inside else batch.column(1)):
                made = fn(texts, part)
                arrays = [a if isinstance(a, pa.Array) and a.type == f.type else (a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type)) for a, f in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["row", *wanted.names])

    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], *wanted.fields]))
    return out.select(*([F.col(f"row.`{c}`").alias(c) for c in keep]), *[F.col(f"`{c}`") for c in wanted.names])
