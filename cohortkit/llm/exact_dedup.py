"""Exact duplicates: 128-bit content hash, then a comparison of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.text import lower_ascii, salt, whole

SALTS = 64  # bits of a bigint


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per document: the row of its text that stays, and the group's size.

    Texts are equal when identical after lower-casing A-Z; ``keep`` says
    whether the ``smallest`` or the ``largest`` id stays. Columns: the id,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (lower-case hex).

    The 128-bit hash deals the rows out and the text itself, byte by byte,
    makes the groups, so that texts with one hash never merge. A group is
    summed up in each task before the shuffle, so a group with a third of all
    rows arrives as one row per task. The members then find their group by
    hash, digest and a salt of the id; a group is repeated only for salts that
    its members have.

    A null text counts as empty, and empty texts are one group. A null id is
    lower than any other. Of rows that repeat both id and text all are
    returned and one is kept. No rows give no rows; other columns are not read.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = lower_ascii(whole(docs[text_column]))
    rows = docs.select(
        docs[id_column].alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("hash")
    )
    groups = (
        rows.groupBy("hash", "text")
        .agg(
            pick("id").alias("keep_id"),
            F.max(F.col("id").isNull()).alias("has_null"),
            F.count(F.lit(1)).alias("group_size"),
            F.bit_or(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), salt("id", SALTS))
            ).alias("salts"),
        )
        .select("hash", _digest("text"), "keep_id", "has_null", "group_size", "salts")
    )
    # Two texts with one hash and one digest could not be told apart below.
    told_apart = groups.groupBy("hash", "digest").agg(
        F.count(F.lit(1)).alias("texts"),
        *(F.max(c).alias(c) for c in ("keep_id", "has_null", "group_size", "salts")),
    )
    dealt = told_apart.select(
        "hash",
        "digest",
        F.when((F.lit(keep == "smallest")) & F.col("has_null"), F.lit(None))
        .otherwise(F.col("keep_id"))
        .alias("keep_id"),
        F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share md5 and sha-256")).cast("bigint"))
        .alias("group_size"),
        F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(SALTS - 1)),
                lambda s: F.getbit(F.col("salts"), s) == 1,
            )
        ).alias("salt"),
    )
    members = (
        rows.select("id", "hash", _digest("text"))
        .groupBy("id", "hash", "digest")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("salt", salt("id", SALTS))
    )
    each = members.join(dealt, ["hash", "digest", "salt"]).withColumn(
        "row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))
    )
    return each.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _digest(text: str):
    return F.unhex(F.sha2(text, 256)).alias("digest")


def drop_exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The documents, with all their columns, one of each group of equal texts.

    Of rows that repeat both id and text one stays, whichever.
    """
    found = exact_duplicates(docs, id_column, text_column, keep).filter("kept")
    name = lambda i, digest: F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), digest)
    kept = found.select(name(F.col(id_column), F.col("text_sha256")).alias("name"))
    digest = F.sha2(lower_ascii(whole(docs[text_column])), 256)
    # Packed, so that no column's name is in the way.
    doc = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    rows = docs.select(doc, name(docs[id_column], digest).alias("name"))
    return rows.join(kept, "name", "left_semi").dropDuplicates(["name"]).select("doc.*")
