"""Mix sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortkit.llm.text import salt, whole, word_count
from cohortkit.sources import cut_lineage

SALTS = 64
STEPS = 60  # Newton steps at most; about ten are used
TOLERANCE = 1e-9
FARTHEST = 1e-6  # from a target, relatively, where the steps run out
_UNIT = 2.0**30  # sums are of whole numbers of this part of a word, so their order is no matter


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Words to take from each document so that sources meet their targets.

    Sources in code point order, null last, have the ``weights`` in turn and
    share ``share`` times all words; a target stops at ``limit`` (a whole
    number) times its source's words and the rest is shared on. Document rates
    are those nearest to 1 in relative entropy that meet the targets: the
    convex dual has one multiplier per source, rates are
    ``min(limit, exp(multiplier * size))``, and Newton's method finds the
    multipliers, one aggregation over (source, size) counts per step, with
    bisection where a step leaves its bracket.

    Rates become copies by class of equal source and size: whole copies first,
    then one more for the classes with the largest remainders until the target
    is met, the last of these partly. So a source takes its target to the
    word, all documents but one per source are taken whole times, and none
    more than ``limit`` times. Sums are of whole numbers and choices are by
    hash of the id, so reruns agree.

    Columns: the id, ``row`` (128 bits of id, source and text), the source,
    ``size``, ``source_size``, ``target``, ``taken``. A null text has size 0; documents without words are taken 0
    words. Repeated rows are separate documents. No rows give no rows; other
    columns are not read.
    """
    source = F.col(source_column)
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    rows = cut_lineage(
        docs.select(
            docs[id_column].alias("id"),
            row_hash(docs, id_column, text_column, source_column).alias("row"),
            docs[source_column].alias("source"),
            key.alias("key"),
            word_count(whole(docs[text_column])).alias("size"),
            salt(docs[id_column], SALTS).alias("salt"),
        )
    )
    cells = rows.groupBy("key", "source", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(cells.groupBy("key", "source", "size").agg(F.sum("n").alias("n")))
    sources = cut_lineage(source_targets(classes, weights, share, limit))
    rates = _solve(classes.filter("size > 0"), sources, limit)
    copies = _copies(classes, rates, limit)
    rank = F.row_number().over(
        Window.partitionBy("key", "size", "salt").orderBy(F.xxhash64("id", F.lit(1)), "id", "row")
    )
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    quotas = (
        cells.select("key", "size", "salt", "n")
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
        .join(copies, ["key", "size"])
    )
    place = F.col("before") + F.col("rank") - 1
    extra = (
        F.when(place < F.col("more"), F.col("size"))
        .when(place == F.col("more"), F.col("part"))
        .otherwise(F.lit(0))
    )
    return (
        rows.withColumn("rank", rank)
        .join(quotas, ["key", "size", "salt"])
        .select(
            F.col("id").alias(id_column),
            "row",
            F.col("source").alias(source_column),
            "size",
            "source_size",
            "target",
            (F.col("each") * F.col("size") + extra).cast("bigint").alias("taken"),
        )
    )


def row_hash(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> Column:
    """128 bits of id, source and text."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-"))
    source = known(source_column)
    parts = (known(id_column), F.lit(" "), F.length(source).cast("string"), source, whole(docs[text_column]))
    return F.unhex(F.md5(F.concat(*parts)))


def take(
    docs: DataFrame,
    mixed: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The documents, whole and with all their columns, as often as the mix takes them.

    Where the mix takes a part of a document, it comes once more or not, by
    what is nearer. That is one document of a source at most, so each source
    comes within half a document of its target. Documents without words are
    taken no times. Rows that repeat id, source and text share their copies
    evenly and keep their own other columns, whatever these are called. No
    rows give no rows.
    """
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.nullif("size", F.lit(0))))
    taken = cut_lineage(
        mixed.groupBy("row")
        .agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("rows"))
        .filter("copies > 0")
    )
    row = row_hash(docs, id_column, text_column, source_column).alias("row")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), row)
    found = packed.join(taken.filter("rows = 1"), "row").select("doc", "copies")
    repeated = taken.filter("rows > 1")
    if not repeated.isEmpty():
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64("doc")))
        own = F.floor(F.col("copies") / F.col("rows")) + (place <= F.col("copies") % F.col("rows")).cast("int")
        shared = packed.join(repeated, "row").select("doc", own.alias("copies"))
        found = found.union(shared.filter("copies > 0"))
    every = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return found.select("doc", every).select("doc.*")


def source_targets(
    classes: DataFrame, weights: Sequence[float], share: float, limit: float
) -> DataFrame:
    """Per source (``key``, ``source``): its words and its target.

    The level at which every weight is filled is the largest over the sources,
    in order of limit by weight, of what is left to them by their weight. The
    windows hold one row per source.
    """
    all_sources = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)),
        ((F.row_number().over(all_sources) - 1) % len(weights) + 1).cast("int"),
    )
    totals = (
        classes.groupBy("key", "source")
        .agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.min(F.nullif("size", F.lit(0))).alias("least"))
        .withColumn("weight", weight)
        .withColumn("most", limit * F.col("source_size"))
    )
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "key")
    whole_table = Window.partitionBy()
    left = share * F.sum("source_size").over(whole_table) - F.coalesce(
        F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    filled = totals.withColumn("level", left / open_weight)
    level = F.max("level").over(whole_table)
    return filled.select(
        "key",
        "source",
        "source_size",
        "least",
        F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"),
    )


def _rate(limit: float) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(F.col("at") * F.col("size"), F.lit(50.0))))


def _solve(classes: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """``at``: each source's multiplier. One aggregation of the classes per step."""
    top = F.log(F.lit(float(limit))) / F.col("least")
    less = F.col("target") <= F.col("source_size")
    full = F.col("target") >= limit * F.col("source_size")
    state = sources.filter("source_size > 0").select(
        "key",
        "source_size",
        "target",
        F.when(~less, F.lit(0.0)).alias("low"),
        F.when(less, F.lit(0.0)).otherwise(top).alias("high"),
        F.when(full, top).otherwise(F.lit(0.0)).alias("at"),
        F.when(full, F.lit(0.0)).otherwise(F.lit(1.0)).alias("error"),
    )
    state = cut_lineage(state)
    for step in range(STEPS):
        state = cut_lineage(_newton(classes, state, limit))
        if step % 3 == 2 and (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        if (state.agg(F.max("error")).first()[0] or 0.0) > FARTHEST:
            raise RuntimeError(f"the multipliers are not found after {STEPS} steps")
    return sources.join(state.select("key", "at"), "key", "left")


def _newton(classes: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """A Newton step on the logarithm of each source's words, kept in its bracket."""
    words = F.col("n") * F.col("size") * _rate(limit)
    inside = F.col("at") * F.col("size") < F.log(F.lit(float(limit)))
    moving = F.when(inside, words * F.col("size")).otherwise(F.lit(0.0))
    whole_number = lambda c: F.sum(F.round(c * _UNIT).cast("decimal(38,0)")).cast("double") / _UNIT
    names = ["key", "source_size", "target", "low", "high", "at"]
    now = (
        classes.select("key", "size", "n")
        .join(state.select(*names), "key")
        .groupBy(*names)
        .agg(whole_number(words).alias("words"), whole_number(moving).alias("slope"))
    )
    over = F.col("words") > F.col("target")
    low = F.when(over, F.col("low")).otherwise(F.col("at"))
    high = F.when(over, F.col("at")).otherwise(F.col("high"))
    error = F.abs(F.col("words") / F.col("target") - 1)
    log_ratio = F.log(F.col("words") / F.col("target"))
    newton = F.when(
        F.col("slope") > 0, F.col("at") - F.col("words") / F.col("slope") * log_ratio
    )
    fits = newton.isNotNull() & (newton <= high) & (low.isNull() | (newton >= low))
    middle = F.when(low.isNull(), 2 * F.col("at") - 1e-6).otherwise((low + high) / 2)
    moved = F.when(fits, newton).otherwise(middle)
    return now.select(
        "key",
        "source_size",
        "target",
        low.alias("low"),
        high.alias("high"),
        F.when(error <= TOLERANCE, F.col("at")).otherwise(moved).alias("at"),
        error.alias("error"),
    )


def _copies(classes: DataFrame, rates: DataFrame, limit: int) -> DataFrame:
    """Per class: whole copies of ``each``, documents with one ``more``, words of a ``part``.

    Windows hold the classes of a source: as many rows as it has sizes.
    """
    size = F.col("size")
    sized = (
        classes.select("key", "size", "n")
        .join(rates.select("key", "source_size", "target", "at"), "key")
        .withColumn("copies", F.when(size > 0, F.col("n") * _rate(limit)).otherwise(F.lit(0.0)))
        .withColumn("full", F.floor("copies"))
        .withColumn("room", F.when(F.col("full") < limit * F.col("n"), size).otherwise(F.lit(0)))
    )
    of_source = Window.partitionBy("key")
    by_rest = of_source.orderBy(F.desc(F.col("copies") - F.col("full")), F.desc("size"))
    missing = F.round("target").cast("bigint") - F.sum(F.col("full") * size).over(of_source)
    before = F.coalesce(
        F.sum("room").over(by_rest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    left = F.greatest(F.col("missing") - F.col("before"), F.lit(0))
    rounded = (
        sized.withColumns({"missing": missing, "before": before})
        .withColumn("added", F.least(left, F.col("room")))
        .withColumn("total", F.col("full") + (F.col("added") >= size).cast("bigint") * (size > 0).cast("bigint"))
    )
    each = F.floor(F.col("total") / F.col("n"))
    return rounded.select(
        "key",
        "size",
        "source_size",
        "target",
        each.alias("each"),
        (F.col("total") - each * F.col("n")).alias("more"),
        F.when(F.col("added") < size, F.col("added")).otherwise(F.lit(0)).alias("part"),
    )
