"""The registered queries as SQL text for an independent engine (DuckDB).

Written by hand from the meaning of each query, not from the Spark code.
"""

from __future__ import annotations

PEOPLE = """
SELECT o_orderkey AS person_id,
 n_name AS county,
 CASE WHEN o_orderkey % 97 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 41 = 0 THEN '100' ELSE CAST(18 + (o_orderkey * 7 + o_custkey) % 70 AS STRING) END AS age,
 CASE o_orderkey % 9 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'F' WHEN 2 THEN 'F' WHEN 3 THEN 'F' WHEN 4 THEN 'F' ELSE 'M' END AS gender,
 NULLIF(c_mktsegment, 'FURNITURE') AS ethnic_group,
 o_orderpriority AS income_band,
 CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 10 = 0 THEN CONCAT('$', CAST(CAST(FLOOR(o_totalprice / 1000) AS INT) AS STRING), ',', '000') ELSE CONCAT('$', CAST(CAST(FLOOR(o_totalprice) AS INT) AS STRING)) END AS income_amount,
 CONCAT('$', CAST(40000 + 1000 * c_nationkey AS STRING)) AS area_income,
 CASE WHEN o_orderkey % 50 = 0 THEN CAST(NULL AS STRING) ELSE CAST(CAST(30.25 AS DOUBLE) + ((o_orderkey * 37) % 400) / CAST(128 AS DOUBLE) AS STRING) END AS latitude,
 CASE WHEN o_orderkey % 50 = 0 THEN CAST(NULL AS STRING) ELSE CAST(CAST(-85.5 AS DOUBLE) + ((o_orderkey * 53) % 500) / CAST(128 AS DOUBLE) AS STRING) END AS longitude,
 CASE WHEN o_orderkey % 101 = 0 THEN 'A' WHEN o_orderstatus = 'F' THEN 'Y' WHEN o_orderstatus = 'P' THEN 'N' ELSE CAST(NULL AS STRING) END AS voted,
 CASE WHEN (o_custkey + o_orderkey) % 8 < 2 THEN 'Yes' END AS interest_a,
 CASE WHEN (o_custkey * 3 + o_orderkey) % 11 < 3 THEN 'Yes' END AS interest_b,
 CASE WHEN (o_orderkey * 5) % 17 = 0 THEN 'Yes' WHEN o_orderkey % 17 = 1 THEN 'U' END AS interest_c
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# Pieces of SQL used in several queries.
E1 = "TRY_CAST(translate(translate(coalesce(voted, 'N'), 'Y', '1'), 'N', '0') AS INTEGER)"
E2 = "CASE WHEN voted = 'Y' THEN 1 ELSE 0 END"
AGE = "TRY_CAST(age AS INTEGER)"
AGE_AS_READ = "TRY_CAST(age AS DOUBLE)"
STRIP_DOLLAR = "TRY_CAST(regexp_replace({0}, '\\$', '', 'g') AS INTEGER)"
STRIP_ALL = "TRY_CAST(regexp_replace(income_amount, '[$,]', '', 'g') AS INTEGER)"
SUBSTR = "TRY_CAST(substr(income_amount, 2) AS INTEGER)"
FLAG_A = "CASE WHEN interest_a = 'Yes' THEN 1 ELSE 0 END"
FLAG_B = "CASE WHEN interest_b = 'Yes' THEN 1 ELSE 0 END"
FLAG_C = "CASE WHEN interest_c = 'Yes' THEN 1 ELSE 0 END"
FLAG_M = "CASE WHEN gender = 'M' THEN 1 ELSE 0 END"
HASH = "CAST('0x' || substr(md5(CAST(person_id AS VARCHAR)), {0}, 8) AS BIGINT)"

# 1 % of 60 bits.
SAMPLE_HASH = "CAST('0x' || substr(md5(CAST(person_id AS VARCHAR)), 9, 15) AS BIGINT)"
SAMPLE_LIMIT = round(0.01 * 16**15)

_INTERESTS = ("interest_a", "interest_b", "interest_c")
_COLUMNS = (
    "person_id", "county", "age", "gender", "ethnic_group", "income_band", "income_amount",
    "area_income", "latitude", "longitude", "voted", *_INTERESTS,
)

_AREA = f"""
SELECT voted AS "General 2020", county,
 CAST(TRY_CAST(latitude AS FLOAT) AS DOUBLE) AS "Latitude",
 CAST(TRY_CAST(longitude AS FLOAT) AS DOUBLE) AS "Longitude",
 {STRIP_DOLLAR.format("income_amount")} AS "Household Income",
 {STRIP_DOLLAR.format("area_income")} AS "Median Household Income"
FROM people
"""

# Cell borders as a table: cell k starts at low + k * ((low + 0.05) - low).
_CELLS = f"""
points AS (
 SELECT person_id, {E1} AS flag,
  CAST(TRY_CAST(longitude AS FLOAT) AS DOUBLE) AS x,
  CAST(TRY_CAST(latitude AS FLOAT) AS DOUBLE) AS y
 FROM people),
box AS (
 SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CAST(0.05 AS DOUBLE) AS step
 FROM points),
x_numbers AS (SELECT unnest(range(0, greatest(CAST(ceil((x1 + step - x0) / step) AS BIGINT) - 1, 1))) AS k, x0, step FROM box),
y_numbers AS (SELECT unnest(range(0, greatest(CAST(ceil((y1 + step - y0) / step) AS BIGINT) - 1, 1))) AS k, y0, step FROM box),
x_borders AS (SELECT CAST(k AS DOUBLE) AS long_bucket, x0 + k * ((x0 + step) - x0) AS x_from FROM x_numbers),
y_borders AS (SELECT CAST(k AS DOUBLE) AS lat_bucket, y0 + k * ((y0 + step) - y0) AS y_from FROM y_numbers),
x_cells AS (SELECT person_id, flag, y, long_bucket FROM points ASOF LEFT JOIN x_borders ON x >= x_from),
cells AS (SELECT person_id, flag, long_bucket, lat_bucket FROM x_cells ASOF LEFT JOIN y_borders ON y >= y_from)
"""

_AGE_SCORES = f"scores AS (SELECT {AGE} AS score, {E2} AS label FROM people)"

_CURVE = f"""
{_AGE_SCORES},
steps AS (
 SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg
 FROM scores WHERE score IS NOT NULL GROUP BY score),
curve AS (
 SELECT score, pos, neg,
  sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
  sum(pos) OVER () AS all_pos,
  sum(neg) OVER () AS all_neg
 FROM steps)
"""


def _with(body: str, source: str = "people", extra: str = "") -> str:
    parts = f"people AS ({PEOPLE})" + (f", {extra}" if extra else "")
    return f"WITH {parts} {body}".replace("FROM {people}", f"FROM {source}")


_COHORT = f"""young AS (
 SELECT * REPLACE ({AGE} AS age) FROM people
 WHERE county = 'NATION_3' AND {AGE} BETWEEN 18 AND 30)"""

# Written over {people}, to run on all people and again on the cohort.
_DISTINCT = "SELECT DISTINCT ethnic_group FROM {people}"
_GROUP_COUNTS = """
SELECT ethnic_group, count(ethnic_group) AS ethnicgroup_count
FROM {people} GROUP BY ethnic_group HAVING ethnic_group IS NOT NULL"""
_TURNOUT_BY_GROUP = f"""
SELECT ethnic_group, round(avg({E1}), 6) AS general_2020_turnout
FROM {{people}} GROUP BY ethnic_group
HAVING ethnic_group IS NOT NULL AND avg({E1}) IS NOT NULL"""
_GROUP_SHARE = """
SELECT ethnic_group, count(*) AS count,
 round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share,
 round(100 * (count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)), 2) AS percent
FROM {people} GROUP BY ethnic_group"""


def _per_interest(text: str) -> str:
    return " UNION ALL ".join(text.replace("{interest}", name) for name in _INTERESTS)


_FLAG_COUNTS = _per_interest("""
SELECT '{interest}' AS interest, CASE WHEN {interest} = 'Yes' THEN 1 ELSE 0 END AS flag, count(*) AS n
FROM {people} GROUP BY ALL""")
_FLAG_RATIOS = _per_interest("""
SELECT '{interest}' AS interest, CASE WHEN {interest} = 'Yes' THEN 1 ELSE 0 END AS flag, count(*) AS n,
 round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS ratio
FROM {people} GROUP BY ALL""")
_FLAG_TABLE = _per_interest("""
SELECT '{interest}' AS "Interest_Column",
 count(*) FILTER (WHERE {interest} = 'Yes') AS "Count_Yes",
 count(*) FILTER (WHERE {interest} IS DISTINCT FROM 'Yes') AS "Count_Null",
 round(CASE WHEN count(*) = 0 THEN CAST(0 AS DOUBLE)
  ELSE count(*) FILTER (WHERE {interest} = 'Yes') / CAST(count(*) AS DOUBLE) END, 6) AS "Ratio_Yes"
FROM {people}""")


def _features(columns: str, nullable: tuple[str, ...] = ()) -> str:
    complete = " AND ".join(["true", *[f"{c} IS NOT NULL" for c in nullable]])
    return f"""
SELECT * FROM (SELECT person_id, {columns}, {E2} AS "Voters_Turnout" FROM people)
WHERE {complete}"""


_INTEREST_FLAGS = f"{FLAG_A} AS interest_a, {FLAG_B} AS interest_b, {FLAG_C} AS interest_c"
_DEMOGRAPHICS = f"{AGE} AS age, {FLAG_M} AS gender, {SUBSTR} AS income_amount"

_FLAG_FRAME = f'flags AS (SELECT {_INTEREST_FLAGS}, {E2} AS "Voters_Turnout" FROM people)'
_CORRELATIONS = " UNION ALL ".join(
    f"""
SELECT '{a}' AS a, '{b}' AS b,
 round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM flags"""
    for a in (*_INTERESTS, "Voters_Turnout")
    for b in (*_INTERESTS, "Voters_Turnout")
)



def _split_part(features: str, part: str) -> str:
    side = "<" if part == "train" else ">="
    return f"rows AS (SELECT * FROM ({features}) WHERE {HASH.format(1)} % 100 {side} 80)"


def _score_equations(names: tuple[str, ...]) -> str:
    """At the maximum the label gives what the probability gives."""
    each = [
        f"""
SELECT count(*) AS n_train, '{n}' AS feature,
 round(sum("Voters_Turnout" * {n}) / CAST(sum({n}) AS DOUBLE), 3) AS value FROM rows"""
        for n in names
    ]
    last = """
SELECT count(*), 'intercept', round(avg("Voters_Turnout"), 3) FROM rows"""
    return " UNION ALL ".join([*each, last])


SWEEPS = 15


def _fitted(features: str, names: tuple[str, ...]) -> str:
    """The maximum of the likelihood, one coefficient at a time, and the scores of the test rows.

    Features are centred and scaled on the training rows, equal rows counted.
    Each step of the recursion moves one coefficient by its own Newton step;
    the cycle over all of them is gone through ``SWEEPS`` times.
    """
    k = len(names) + 1
    label = '"Voters_Turnout"'
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in names)
    scaled = ", ".join(f"({n} - m_{n}) / s_{n}" for n in names)
    x = f"[CAST(1 AS DOUBLE), {scaled}]"
    return f"""
known AS MATERIALIZED ({features}),
train AS (SELECT * FROM known WHERE {HASH.format(1)} % 100 < 80),
moments AS (SELECT {moments} FROM train),
counted AS MATERIALIZED (
 SELECT {x} AS x, count(*) AS n, CAST(sum({label}) AS DOUBLE) AS pos FROM train, moments GROUP BY ALL),
fit AS (
 SELECT 0 AS step, list_transform(range({k}), lambda i: CAST(0 AS DOUBLE)) AS beta
 UNION ALL
 SELECT step + 1, list_transform(range({k}), lambda i: beta[i + 1] + CASE WHEN i = step % {k} THEN g / h ELSE 0 END)
 FROM (
  SELECT step, beta, sum(x[1 + step % {k}] * (pos - n * p)) AS g, sum(n * p * (1 - p) * x[1 + step % {k}] ** 2) AS h
  FROM (SELECT step, beta, x, n, pos, 1 / (1 + exp(-list_dot_product(x, beta))) AS p FROM fit, counted)
  GROUP BY step, beta)
 WHERE step < {k * SWEEPS}),
final AS (SELECT beta FROM fit WHERE step = {k * SWEEPS}),
margins AS (
 SELECT person_id, {label}, list_dot_product({x}, beta) AS margin
 FROM known, moments, final WHERE {HASH.format(1)} % 100 >= 80),
scored AS MATERIALIZED (
 SELECT person_id, {label}, 1 / (1 + exp(-margin)) AS probability,
  CAST(CASE WHEN margin > 0 THEN 1 ELSE 0 END AS DOUBLE) AS prediction
 FROM margins)"""


_SCORED_CURVE = """
steps AS (
 SELECT probability AS score, sum("Voters_Turnout") AS pos, count(*) - sum("Voters_Turnout") AS neg
 FROM scored GROUP BY probability),
curve AS (
 SELECT score, pos, neg,
  sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
  sum(pos) OVER () AS all_pos,
  sum(neg) OVER () AS all_neg
 FROM steps)
"""


def _model_scores(name: str, features: str, names: tuple[str, ...]) -> dict[str, str]:
    """The fitted model's scores and every report that rests on them."""
    fitted = _fitted(features, names)
    ranked = f"{fitted}, {_SCORED_CURVE}"
    out = {
        name: _with(
            """SELECT person_id, "Voters_Turnout", round(probability, 6) AS probability, prediction
FROM scored""",
            extra=fitted,
        ),
        f"{name}_auc": _with(
            """SELECT round(CAST(sum(neg * (2 * cum_pos - pos)) AS DOUBLE)
 / (2 * CAST(max(all_pos) AS DOUBLE) * CAST(max(all_neg) AS DOUBLE)), 6) AS auc FROM curve""",
            extra=ranked,
        ),
        f"{name}_confusion_long": _with(
            'SELECT "Voters_Turnout", prediction, count(*) AS count FROM scored GROUP BY 1, 2',
            extra=fitted,
        ),
    }
    if name == "lr_all":
        out["lr_all_roc"] = _with(
            """SELECT CAST(NULL AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL SELECT round(score, 6), round(CAST(cum_neg AS DOUBLE) / CAST(all_neg AS DOUBLE), 6),
 round(CAST(cum_pos AS DOUBLE) / CAST(all_pos AS DOUBLE), 6)
FROM curve""",
            extra=ranked,
        )
        out["lr_all_confusion"] = _with(
            """SELECT "Voters_Turnout", count(*) FILTER (WHERE prediction = 0) AS "0.0",
 count(*) FILTER (WHERE prediction = 1) AS "1.0", count(*) FILTER (WHERE false) AS other
FROM scored GROUP BY 1""",
            extra=fitted,
        )
    return {key: text.replace("WITH people AS (", "WITH RECURSIVE people AS MATERIALIZED (", 1) for key, text in out.items()}


def _model_reports() -> dict[str, str]:
    demographics = ("age", "gender", "income_amount")
    models = {
        "lr_interests": (_features(_INTEREST_FLAGS), _INTERESTS),
        "lr_demo": (_features(_DEMOGRAPHICS, ("age", "income_amount")), demographics),
        "lr_all": (
            _features(f"{_INTEREST_FLAGS}, {_DEMOGRAPHICS}", ("age", "income_amount")),
            (*_INTERESTS, *demographics),
        ),
    }
    out = {}
    for name, (rows, features) in models.items():
        out |= _model_scores(name, rows, features)
        test = _split_part(rows, "test")
        out[f"{name}_check"] = _with(_score_equations(features), extra=_split_part(rows, "train"))
        out[f"{name}_test_labels"] = _with(
            'SELECT "Voters_Turnout", count(*) AS n FROM rows GROUP BY 1', extra=test
        )
        out[f"{name}_sample"] = _with(
            'SELECT person_id, "Voters_Turnout" FROM rows ORDER BY person_id LIMIT 10', extra=test
        )
    young = f"young AS (SELECT * FROM people WHERE {AGE} BETWEEN 18 AND 30)"
    rows = _features(_INTEREST_FLAGS).replace("FROM people", "FROM young")
    out["young_lr_interests_check"] = _with(
        _score_equations(_INTERESTS), extra=f"{young}, {_split_part(rows, 'train')}"
    )
    flags = _FLAG_FRAME.replace("FROM people", "FROM young")
    out["young_correlation_matrix"] = _with(_CORRELATIONS, extra=f"{young}, {flags}")
    return out


_NULL_RATIOS = " UNION ALL ".join(
    f"""
SELECT '{name}' AS column_name,
 round((count(*) - count("{name}")) / CAST(count(*) AS DOUBLE), 3) AS null_ratio FROM area"""
    for name in (
        "General 2020", "county", "Latitude", "Longitude", "Household Income",
        "Median Household Income",
    )
)


def _one_hot(bucket: str, cell: str) -> str:
    top = f"max({bucket}) OVER ()"
    return f"""
 CASE WHEN {bucket} IS NOT NULL THEN CAST({top} AS INTEGER) END AS {cell}_length,
 CASE WHEN {bucket} < {top} THEN CAST({bucket} AS BIGINT) END AS {cell}_hot"""


_GROUP_TOTALS = f"""
SELECT CASE grouping_id(k1, k2, age, gender, band) WHEN 15 THEN 'group' WHEN 23 THEN 'detail' WHEN 27 THEN 'age'
  WHEN 29 THEN 'gender' WHEN 30 THEN 'income' ELSE 'income_gender' END AS report,
 k1 AS "group", k2 AS detail, age, gender, band, count(*) AS n,
 CAST(sum(translated) AS BIGINT) AS sum_translated, count(translated) AS n_translated,
 CAST(sum(voted) AS BIGINT) AS sum_voted, count(voted) AS n_voted,
 sum(years) AS sum_years, count(years) AS n_years,
 CAST(sum(income) AS BIGINT) AS sum_income, count(income) AS n_income
FROM (
 SELECT ethnic_group AS k1, ethnic_group AS k2, {AGE} AS age, gender, income_band AS band, {E1} AS translated,
  {E2} AS voted, {AGE_AS_READ} AS years, {STRIP_ALL} AS income FROM people)
GROUP BY GROUPING SETS ((k1), (k2), (age), (gender), (band), (band, gender))"""

_ALL_NAMES = ("interest_a", "interest_b", "interest_c", "age", "gender", "income_amount")
_PRODUCTS = [(x, y) for i, x in enumerate(_ALL_NAMES) for y in _ALL_NAMES[i:]]
_WIDE_CORRELATIONS = (
    "SELECT p.name AS a, q.name AS b, round(corr(p.v, q.v), 6) AS r FROM long p JOIN long q USING (person_id) GROUP BY 1, 2"
)
_LONG = f"""
model_rows AS ({_features(f"{_INTEREST_FLAGS}, {_DEMOGRAPHICS}", ("age", "income_amount"))}),
long AS (
 SELECT person_id, unnest([{", ".join(f"'{n}'" for n in _ALL_NAMES)}, {", ".join(f"'{x} x {y}'" for x, y in _PRODUCTS)}]) AS name,
  unnest([{", ".join(f"CAST({n} AS DOUBLE)" for n in _ALL_NAMES)}, {", ".join(f"CAST({x} AS DOUBLE) * {y}" for x, y in _PRODUCTS)}]) AS v
 FROM model_rows)"""

SQL: dict[str, str] = {
    # sources and cleaning
    "row_count": _with("SELECT count(*) AS n FROM people"),
    "first_rows": _with("SELECT * FROM people ORDER BY person_id LIMIT 10"),
    "hash_sample": _with(f"SELECT * FROM people WHERE {SAMPLE_HASH} < {SAMPLE_LIMIT}"),
    # Of random choices only what holds for every one.
    "random_sample_check": _with(
        "SELECT count(*) AS n, true AS none_twice, CAST(0 AS BIGINT) AS strangers, true AS near_share FROM people"
    ),
    "random_split_check": _with("SELECT count(*) AS n, CAST(1 AS BIGINT) AS times, true AS near_share FROM people"),
    "file_sample_check": _with("SELECT count(*) AS n, true AS whole_files FROM people"),
    "kept_turnout_by_group": _with(_TURNOUT_BY_GROUP.replace("{people}", "people")),
    "rename_columns": _with(_AREA),
    "complete_cases": _with(
        """SELECT * FROM area WHERE "General 2020" IS NOT NULL AND county IS NOT NULL
 AND "Latitude" IS NOT NULL AND "Longitude" IS NOT NULL
 AND "Household Income" IS NOT NULL AND "Median Household Income" IS NOT NULL""",
        extra=f"area AS ({_AREA})",
    ),
    "flag_translate": _with(f"SELECT person_id, {E1} AS flag FROM people"),
    "flag_equals": _with(f"SELECT person_id, {E2} AS flag FROM people"),
    "flag_columns": _with(
        f"SELECT person_id, {FLAG_M} AS gender, {_INTEREST_FLAGS} FROM people"
    ),
    "fill_nulls": _with("SELECT person_id, coalesce(voted, 'N') AS voted, gender FROM people"),
    "money_strip_dollar": _with(
        f"SELECT person_id, {STRIP_DOLLAR.format('income_amount')} AS amount FROM people"
    ),
    "money_strip_all": _with(f"SELECT person_id, {STRIP_ALL} AS amount FROM people"),
    "money_substr": _with(f"SELECT person_id, {SUBSTR} AS amount FROM people"),
    # groups
    "distinct_values": _with(_DISTINCT),
    "group_counts": _with(_GROUP_COUNTS),
    "group_share": _with(_GROUP_SHARE),
    "turnout_by_group": _with(_TURNOUT_BY_GROUP),
    "turnout_by_age": _with(
        f"""SELECT {AGE} AS age, round(avg({E2}), 6) AS "Average_Turnout_2020"
FROM people WHERE {AGE} <> 100 GROUP BY 1"""
    ),
    "totals_by_age": _with(
        f"""SELECT {AGE} AS age, count(*) AS "Total_Voters",
 CAST(sum({E2}) AS BIGINT) AS "Voters_Who_Voted"
FROM people WHERE {AGE} <> 100 GROUP BY 1"""
    ),
    "turnout_by_gender": _with(
        f'SELECT gender, round(avg({E2}), 6) AS "Average_Turnout_By_Gender" FROM people GROUP BY 1'
    ),
    "turnout_by_income": _with(
        f"""SELECT income_band, round(avg({E2}), 6) AS "Average_Turnout_By_Income"
FROM people GROUP BY 1"""
    ),
    "turnout_by_income_gender": _with(
        f"""SELECT income_band, gender, round(avg({E2}), 6) AS "Average_Turnout_By_Income_Gender"
FROM people GROUP BY 1, 2"""
    ),
    "avg_age_by_group": _with(
        f'SELECT ethnic_group, round(avg({AGE_AS_READ}), 6) AS "Average_Age" FROM people GROUP BY 1'
    ),
    "avg_income_by_group": _with(
        f"""SELECT ethnic_group, round(avg({STRIP_ALL}), 6) AS "Average_Income"
FROM people GROUP BY 1 HAVING avg({STRIP_ALL}) IS NOT NULL"""
    ),
    "group_totals": _with(_GROUP_TOTALS),
    **{
        f"report_{name}": _with(text.replace("{people}", "people"))
        for name, text in {
            "turnout_by_group": _TURNOUT_BY_GROUP,
            "group_share": _GROUP_SHARE,
            "totals_by_age": f"""SELECT {AGE} AS age, count(*) AS "Total_Voters",
 CAST(sum({E2}) AS BIGINT) AS "Voters_Who_Voted" FROM people WHERE {AGE} <> 100 GROUP BY 1""",
            "turnout_by_income_gender": f"""SELECT income_band, gender, round(avg({E2}), 6) AS "Average_Turnout_By_Income_Gender"
FROM people GROUP BY 1, 2""",
            "age_by_group": f"""SELECT ethnic_group, round(avg({AGE_AS_READ}), 6) AS "Average_Age"
FROM people GROUP BY 1""",
            "income_by_group": f"""SELECT ethnic_group, round(avg({STRIP_ALL}), 6) AS "Average_Income"
FROM people GROUP BY 1 HAVING avg({STRIP_ALL}) IS NOT NULL""",
        }.items()
    },
    # profiles
    "null_profile_wide": _with(
        """SELECT column_name, round(nulls / CAST(n AS DOUBLE), 3) AS null_ratio
FROM (SELECT count(*) AS n, """
        + ", ".join(
            f"count(*) - count(CASE WHEN (person_id + {k}) % {k + 2} <> 0 THEN age END) AS c{k}" for k in range(200)
        )
        + " FROM people) UNPIVOT (nulls FOR column_name IN (COLUMNS(* EXCLUDE n)))"
    ),
    "interest_counts": _with(_FLAG_COUNTS),
    "interest_ratio": _with(_FLAG_RATIOS),
    "interest_table": _with(_FLAG_TABLE),
    "null_counts": _with(
        "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in _COLUMNS) + " FROM people"
    ),
    "null_ratios": _with(_NULL_RATIOS, extra=f"area AS ({_AREA})"),
    # cohort
    "cohort": _with("SELECT * FROM young", extra=_COHORT),
    "cohort_distinct_values": _with(_DISTINCT, "young", _COHORT),
    "cohort_group_counts": _with(_GROUP_COUNTS, "young", _COHORT),
    "cohort_turnout_by_group": _with(_TURNOUT_BY_GROUP, "young", _COHORT),
    "cohort_group_share": _with(_GROUP_SHARE, "young", _COHORT),
    "cohort_interest_counts": _with(_FLAG_COUNTS, "young", _COHORT),
    "cohort_interest_ratio": _with(_FLAG_RATIOS, "young", _COHORT),
    "cohort_interest_table": _with(_FLAG_TABLE, "young", _COHORT),
    # grid
    "bounding_box": _with(
        """SELECT min("Longitude") AS "min_Longitude", max("Longitude") AS "max_Longitude",
 min("Latitude") AS "min_Latitude", max("Latitude") AS "max_Latitude" FROM area""",
        extra=f"area AS ({_AREA})",
    ),
    "grid_buckets": _with("SELECT person_id, long_bucket, lat_bucket FROM cells", extra=_CELLS),
    "one_hot_grid": _with(
        f"""SELECT person_id, {_one_hot("long_bucket", "long")},
 {_one_hot("lat_bucket", "lat")} FROM cells""",
        extra=_CELLS,
    ),
    "grid_turnout": _with(
        """SELECT long_bucket, lat_bucket, round(avg(flag), 6) AS "General 2020", count(*) AS n
FROM cells WHERE long_bucket IS NOT NULL AND lat_bucket IS NOT NULL GROUP BY 1, 2""",
        extra=_CELLS,
    ),
    "grid_turnout_counted": _with(
        """SELECT long_bucket, lat_bucket, round(avg(flag), 6) AS "General 2020", count(*) AS n
FROM cells WHERE long_bucket IS NOT NULL AND lat_bucket IS NOT NULL GROUP BY 1, 2""",
        extra=_CELLS,
    ),
    # models
    "hash_split": _with(
        f"""SELECT person_id, CASE WHEN {HASH.format(1)} % 100 < 80 THEN 'train' ELSE 'test' END AS part
FROM people"""
    ),
    "model_features_interests": _with(_features(_INTEREST_FLAGS)),
    "model_features_demo": _with(_features(_DEMOGRAPHICS, ("age", "income_amount"))),
    "model_features_all": _with(
        _features(f"{_INTEREST_FLAGS}, {_DEMOGRAPHICS}", ("age", "income_amount"))
    ),
    # evaluation
    "roc_points": _with(
        """SELECT CAST(NULL AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
UNION ALL SELECT CAST(score AS DOUBLE), round(cum_neg / all_neg, 6), round(cum_pos / all_pos, 6)
FROM curve""",
        extra=_CURVE,
    ),
    "auc": _with(
        """SELECT round(sum(neg * (cum_pos - pos / 2)) / (max(all_pos) * max(all_neg)), 6) AS auc
FROM curve""",
        extra=_CURVE,
    ),
    "confusion_long": _with(
        """SELECT label, CAST(CASE WHEN score >= 50 THEN 1 ELSE 0 END AS DOUBLE) AS prediction,
 count(*) AS n FROM scores GROUP BY 1, 2""",
        extra=_AGE_SCORES,
    ),
    "pivot_counts": _with(
        """SELECT label, count(*) FILTER (WHERE score IS NULL OR score < 50) AS "0.0",
 count(*) FILTER (WHERE score >= 50) AS "1.0",
 count(*) FILTER (WHERE false) AS other FROM scores GROUP BY 1""",
        extra=_AGE_SCORES,
    ),
    "correlation_matrix": _with(_CORRELATIONS, extra=_FLAG_FRAME),
    "wide_correlations": _with(_WIDE_CORRELATIONS, extra=_LONG),
    **_model_reports(),
}
