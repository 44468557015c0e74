"""Properties that decide whether a plan holds on a large table."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortkit import operators as op
from cohortkit.operators.evaluate import _cumulated
from cohortkit.plans import PEOPLE, Analyses
from cohortkit.plans.catalog import QUERIES
from cohortkit.sources import cut_lineage, keep, load, people

TABLES = "/root/testdata/sf0.001"
RANKED = {"roc_points", "auc", "lr_all_roc", "lr_interests_auc", "lr_demo_auc", "lr_all_auc"}


@contextmanager
def _settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _children(plan, node):
    """The line under every occurrence of ``node`` in a plan text."""
    lines = plan.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if node in line]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_no_python_rows_no_full_gather(spark, name):
    """One task receives partial aggregates only, or one row per score range."""
    plan = _plan(QUERIES[name](spark, TABLES))
    assert not re.search("NestedLoop|CartesianProduct|EvalPython|MapInPandas", plan)
    for child in _children(plan, "Exchange SinglePartition"):
        partial = "Aggregate" in child and "partial_" in child
        per_range = name in RANKED and "HashAggregate(keys=[part#" in child
        per_partition = name == "wide_correlations" and "MapInArrow together" in child
        assert partial or per_range or per_partition


def test_whole_people_table_is_pruned_to_the_columns_asked_for(spark):
    plan = _plan(Analyses(people(spark, TABLES), PEOPLE).turnout_by_income())
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan


def test_cohort_filters_reach_the_scan(spark, voters, tmp_path):
    typed = voters.withColumn("age", op.int_column(voters, "age"))
    typed.write.parquet(str(tmp_path / "typed"))
    voters.write.parquet(str(tmp_path / "text"))
    asked = {"county": "MURRAY"}, {"age": (18, 30)}
    plan = _plan(op.cohort(load(spark, str(tmp_path / "typed")), *asked).select("id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (\S+)", plan)
    for part in ("EqualTo(county,MURRAY)", "GreaterThanOrEqual(age,18)", "LessThanOrEqual(age,30)"):
        assert part in pushed[1]
    assert pushed[2] == "struct<id:int,county:string,age:int>"
    plan = _plan(op.cohort(load(spark, str(tmp_path / "text")), *asked).select("id"))
    assert "IsNotNull(age)" in plan and "EqualTo(county,MURRAY)" in plan


def test_group_share_reads_its_table_once(spark):
    df = spark.read.parquet(f"{TABLES}/orders.parquet")
    shares = op.group_share(df, "o_orderpriority")
    shares.collect()
    final = _plan(shares).split("== Initial Plan ==")
    assert "ReusedExchange" in "".join(final)


def test_correlation_of_numbers_shuffles_no_rows(spark):
    i = F.col("id").cast("double")
    df = spark.range(5000).select((i + 1e9).alias("a"), F.sin(i).alias("b"), (i % 3).alias("c"))
    plain = op.correlation_matrix(df, ["a", "b", "c"])
    assert "hashpartitioning" not in _plan(plain)
    collapsed = op.correlation_matrix(df, ["a", "b", "c"], collapse=True)
    values = lambda m: {(r.a, r.b): r.r for r in m.collect()}
    assert values(plain) == pytest.approx(values(collapsed), abs=1e-9)


def test_correlation_means_and_products_read_one_shuffle(spark):
    features = Analyses(people(spark, TABLES), PEOPLE).interest_correlations()
    features.collect()
    assert "ReusedExchange" in _plan(features)


def test_a_customer_with_a_third_of_all_orders_is_split(spark, tmp_path):
    folder = str(tmp_path)
    i = F.col("id")
    spark.range(90000, numPartitions=8).select(
        i.alias("o_orderkey"),
        F.when(i % 3 == 0, 7).otherwise(i % 1000).cast("bigint").alias("o_custkey"),
        F.when(i % 2 == 0, "F").otherwise("P").alias("o_orderstatus"),
        (i * 1.5).alias("o_totalprice"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(1000).select(
        i.alias("c_custkey"), (i % 25).cast("int").alias("c_nationkey"), F.lit("S").alias("c_mktsegment")
    ).write.parquet(f"{folder}/customer.parquet")
    spark.range(25).select(
        i.cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), i).alias("n_name")
    ).write.parquet(f"{folder}/nation.parquet")
    with _settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    ):
        totals = op.totals_by(people(spark, folder), "gender", F.lit(1))
        assert sum(r.n for r in totals.collect()) == 90000
        assert "skew=true" in _plan(totals)


@pytest.fixture
def many_scores(spark):
    """60,000 rows, a third of them on one score, the others all distinct."""
    i = F.col("id")
    return spark.range(60000).select(
        F.when(i % 3 == 0, 0.25).otherwise(i * 7919 % 60013 / 60013.0).alias("score"),
        (i * 31 % 7 < 3).cast("int").alias("label"),
    )


def test_roc_over_many_ranges_equals_one_sorted_window(spark, many_scores):
    with _settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        ranged = _cumulated(many_scores, "score", "label")
        rows = {r.score: (r.cum_pos, r.cum_neg) for r in ranged.collect()}
        tasks = ranged.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4
    assert max(r["count"] for r in tasks) < len(rows) / 2
    one = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    counted = many_scores.groupBy("score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    expected = counted.select(
        "score", F.sum("pos").over(one).alias("p"), F.sum("neg").over(one).alias("n")
    )
    assert rows == {r.score: (r.p, r.n) for r in expected.collect()}


def test_ranges_take_one_shuffle_after_the_count(spark, many_scores):
    curve = op.roc_points(many_scores, "score", "label")
    curve.collect()
    plan = _plan(curve).split("== Initial Plan ==")[0]
    by_part = [x for x in plan.splitlines() if "Exchange hashpartitioning(part" in x]
    assert ["ReusedExchange" in x for x in by_part].count(False) == 1


def test_thin_curve_has_the_same_area(spark, many_scores):
    few = many_scores.withColumn("label", (F.col("score") > 0.5).cast("int"))
    for df in (many_scores, few):
        whole = op.roc_points(df, "score", "label").collect()
        thin = op.roc_points(df, "score", "label", thin=True).collect()
        assert {tuple(r) for r in thin} <= {tuple(r) for r in whole}

        def area(points):
            at = sorted((r.fpr, r.tpr) for r in points)
            return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(at, at[1:]))

        assert area(thin) == pytest.approx(area(whole), abs=1e-12)
    assert len(thin) < len(whole) / 20


def test_given_bounds_spare_the_pass_for_them(spark):
    i = F.col("id")
    df = spark.range(4000).select((i % 97 / 10).alias("x"), (i % 53 / 7).alias("y"))
    axes = {"x": "cx", "y": "cy"}
    bounds = op.grid_bounds(df, ["x", "y"])
    given = op.grid_buckets(df, axes, 0.3, bounds)
    assert "Subquery" not in _plan(given)
    assert given.exceptAll(op.grid_buckets(df, axes, 0.3)).isEmpty()
    top = op.highest_cells(df, axes, bounds, 0.3).first()
    assert tuple(top) == tuple(given.agg(F.max("cx"), F.max("cy")).first())


def test_auc_does_not_depend_on_the_number_of_ranges(spark, many_scores):
    found = set()
    for parts in ("1", "8", "64"):
        with _settings(
            spark,
            spark__sql__shuffle__partitions=parts,
            spark__sql__adaptive__coalescePartitions__enabled="false",
        ):
            found.add(round(op.auc(many_scores, "score", "label").first()[0], 12))
    assert len(found) == 1


def test_fit_collapses_equal_rows(spark):
    """100,000 rows of three flags are at most 16 rows to the optimizer."""
    i = F.col("id")
    rows = spark.range(100000).select(
        *[((i * p) % 11 % 2).cast("int").alias(c) for p, c in ((3, "a"), (5, "b"), (7, "c"))],
        ((i * 13) % 17 % 2).cast("int").alias("y"),
    )
    summary = op.fit_logistic(rows, ["a", "b", "c"], "y").stages[-1].summary
    assert summary.predictions.count() <= 16
    assert summary.predictions.agg(F.sum("__weight")).first()[0] == 100000


def test_lineage_is_cut_in_the_session_folder(spark):
    df = cut_lineage(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        assert shared.rstrip("/") in spark.sparkContext.getCheckpointDir()
    assert "Exchange" not in _plan(df)
    assert df.count() == 3


def test_keep_persists_only_the_named_columns(spark, voters):
    kept = keep(voters, ["id", "grp"])
    try:
        assert kept.columns == ["id", "grp"]
        assert kept.storageLevel.useDisk and kept.storageLevel.useMemory
        assert kept.count() == 8
    finally:
        kept.unpersist()
