"""Token ids as Parquet files for selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortkit.llm.encode import encoded
from cohortkit.llm.text import whole

ROW_GROUP = 32 << 20
PAGE_ROWS = 1000
ENCODINGS = ("dictionary", "delta")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    encoding: str = "dictionary",
    row_group: int = ROW_GROUP,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode documents and write their ids in ascending order of the document id.

    One row per document: ``id``, ``file_start`` (ids before it in its file),
    ``n_tokens``, ``tokens`` (a list column). Files are in order of their
    names, as are rows in a file. Ids are stored by ``dictionary`` or as
    packed ``delta``s; the other columns as deltas. Row groups have about
    ``row_group`` bytes and pages ``page_rows`` rows; page indexes are written,
    so a filter on ``id`` reads only its pages, and reading counts reads no
    ids.

    ``tokenizer`` is a file of the tokenizers library that every executor
    has; special tokens in texts are ordinary text, and each document ends
    with ``end_id``. A null text counts as empty. Null ids come first, rows
    with one id in order of their texts. No rows give a folder without rows;
    other columns are not read.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    id_type = docs.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for row, ids, at in encoded(batch.column(1), tokenizer, end_id):
                count = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(count)),
                        pa.array(before + at[:-1]),
                        pa.array(count.astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))
                        ),
                    ],
                    ["id", "file_start", "n_tokens", "tokens"],
                )
                before += int(at[-1])

    sorted_docs = (
        docs.select(docs[id_column].alias("id"), whole(docs[text_column]).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
    )
    schema = f"id {id_type}, file_start bigint, n_tokens int, tokens array<int>"
    sorted_docs.mapInArrow(encode, schema).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
            "parquet.block.size": str(row_group),
            "parquet.page.row.count.limit": str(page_rows),
        }
    ).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the files, with ``start``: ids of all documents before.

    Only what a query uses is read: counts and starts come without the ids.
    The table of files has a row per file and is broadcast.
    """
    files = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    # By number: as text, part 100000 would come before part 99999.
    number = F.regexp_extract("file", r"part-([0-9]+)", 1).cast("bigint")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        files.groupBy("file")
        .agg(F.sum("n_tokens").alias("n"))
        .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_first"))
    )
    return files.join(F.broadcast(first), "file").select(
        "id", (F.col("file_first") + F.col("file_start")).alias("start"), "n_tokens", "tokens"
    )


def token_digests(rows: DataFrame) -> DataFrame:
    """``id``, ``start``, ``n_tokens`` and the CRC-32 of the ids as little-endian 32-bit numbers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                ["id", "start", "n_tokens", "ids_crc32"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.select("id", "start", "tokens").mapInArrow(digest, schema)
