"""Shards of near equal size: longest processing time first, through a heap."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortkit.llm.text import salt, whole
from cohortkit.sources import cut_lineage

OVERHEAD = 16
BUNDLES = 8192  # bounds what the heap sees: twice as many items at most
SALTS = 64


def shard_by_size(
    docs: DataFrame,
    shards: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    bundles: int = BUNDLES,
) -> DataFrame:
    """Deal documents into shards of near equal bytes; equal texts stay together.

    Columns: the id, ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``shard``
    and ``slot``, gapless from 0 in each shard.

    Groups are the unit of scheduling. A group of at least 1/``bundles`` of
    all bytes is an item of its own, and there can be no more than ``bundles``
    of those; smaller groups go by hash into ``bundles`` common items. These
    items, largest first, go to the least loaded shard. The heap sees at most
    twice ``bundles`` items at any input size; everything else is narrow rows
    in the cluster. Cells of a group and a salt of the id keep a very large
    group from meeting in one task.

    A null text counts as empty; empty texts are one group. A group larger
    than a shard's share makes its shard the largest. Repeated rows and null
    ids get slots of their own. No rows give no rows; other columns are not
    read.
    """
    text = whole(docs[text_column])
    rows = cut_lineage(
        docs.select(
            docs[id_column].alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.unhex(F.md5(text)).alias("hash"),
            salt(docs[id_column], SALTS).alias("salt"),
        )
    )
    cells = rows.groupBy("hash", "salt").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )
    groups = cells.groupBy("hash").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    own = F.col("bytes") * bundles >= total
    common = F.encode(salt("hash", bundles).cast("string"), "UTF-8")  # shorter than a hash
    groups = cut_lineage(groups.withColumn("item", F.when(own, F.col("hash")).otherwise(common)))
    items = groups.groupBy("item").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    placed = docs.sparkSession.createDataFrame(
        schedule([tuple(r) for r in items.collect()], shards),
        "item binary, shard int, first_slot bigint",
    )
    before = Window.partitionBy("item").orderBy("hash", "salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    slots = (
        cells.select("hash", "salt", "rows")
        .join(groups.select("hash", "item"), "hash")
        .withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .join(placed, "item")
        .select("hash", "salt", "shard", (F.col("first_slot") + F.col("before")).alias("first"))
    )
    rank = F.row_number().over(Window.partitionBy("hash", "salt").orderBy("id", "crc")) - 1
    return (
        rows.withColumn("rank", rank)
        .join(slots, ["hash", "salt"])
        .select(
            F.col("id").alias(id_column),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("first") + F.col("rank")).alias("slot"),
        )
    )


def schedule(items: list[tuple[bytes, int, int]], shards: int) -> list[tuple[bytes, int, int]]:
    """Longest first to the least loaded shard: (item, rows, bytes) to (item, shard, first slot)."""
    heap = [(0, shard) for shard in range(shards)]
    filled = [0] * shards
    placed = []
    for item, rows, size in sorted(items, key=lambda x: (-x[2], bytes(x[0]))):
        load, shard = heapq.heappop(heap)
        placed.append((bytes(item), shard, filled[shard]))
        filled[shard] += rows
        heapq.heappush(heap, (load + size, shard))
    return placed


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write whole documents to one folder per shard, by slot.

    Ids must be unique. Rows go out by shard and slot range, so that several
    tasks write a shard. The documents' columns keep their names; where one is
    called ``shard`` or ``slot``, the new one ends in underscores that make it
    another. No rows write no folder of a shard.
    """
    free = {}
    for name in ("shard", "slot"):
        free[name] = name
        while free[name] in docs.columns:
            free[name] += "_"
    new = assigned.select(F.col(id_column).alias("id"), *(F.col(c).alias(f"new_{c}") for c in free))
    doc = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    packed = docs.select(doc, docs[id_column].alias("id"))
    placed = packed.join(new, "id").select("doc.*", *(F.col(f"new_{c}").alias(to) for c, to in free.items()))
    placed.repartitionByRange(*free.values()).sortWithinPartitions(*free.values()).write.partitionBy(
        free["shard"]
    ).parquet(path)
