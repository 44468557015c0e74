"""Queries of the operators on word runs, conversations and repeated passages, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.conversations import conversation_reports
from cohortkit.llm.periodic_runs import periodic_runs
from cohortkit.llm.repeated_windows import remove_repeated_windows
from cohortkit.llm.ship import ship
from cohortkit.llm.text import WORD, whole
from cohortkit.sources import table


def _made_periodic(docs: DataFrame) -> Column:
    """The text; for ids whose crc32 is a multiple of ten, its words from one on repeat with a period."""
    h = F.crc32(docs["doc_id"].cast("string"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(whole(docs["text"]), F.lit(WORD), F.lit(0))
    n = F.size(words).cast("bigint")
    numbered = F.struct(words.alias("words"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))

    def changed(one: Column) -> Column:
        w, a, p = one["words"], one["a"], one["p"]
        return F.array_join(
            F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, a + (i - a) % p))), " "
        )

    # A transform over one element names the words, so that they are found once.
    made = F.element_at(F.transform(F.array(numbered), changed), 1)
    return F.when((h % 10 == 0) & F.regexp_like(whole(docs["text"]), F.lit(WORD)), made).otherwise(docs["text"])


def op11_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    ship(spark)
    docs = table(spark, directory, "documents")
    found = periodic_runs(docs.select("doc_id", _made_periodic(docs).alias("text")))
    # By length descending, start, period: the least is the longest run.
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"]))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    first = found.select("doc_id", "runs", "collapsed", longest.alias("longest"), listed.alias("listed"))
    return first.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.l")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * -F.col("longest.l") / F.col("longest.period")).cast("bigint").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows lost, emptied, cut, doubled or given another role, by a hash of conversation and turn."""
    known = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(known("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    )


def op12_repair_conversations(spark: SparkSession, directory: str) -> DataFrame:
    ship(spark)
    rows = table(spark, directory, "conversations")
    reports = conversation_reports(_damaged(rows))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    both = every.join(reports, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    ship(spark)
    found = remove_repeated_windows(table(spark, directory, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    q.__name__: q for q in (op11_periodic_runs, op12_repair_conversations, op13_substring_dedup)
}


def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII string: each byte is one step of adding it and eight of dividing."""
    steps = (
        "flatten(list_transform(string_split({0}, ''), "
        "lambda ch: [256 + ascii(ch), 0, 0, 0, 0, 0, 0, 0, 0]))"
    ).format(text)
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({steps} AS BIGINT[])), "
        "lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
    )


def _state(cost: str, audit: str, lines: str) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'a': {audit}, 't': {lines}}}"


def _repair() -> str:
    """The grammar's four states row by row, each with its least cost, audit and lines."""
    none = _state("1000000000", "''", "CAST([] AS VARCHAR[])")
    begin = _state("0", "''", "CAST([] AS VARCHAR[])")
    delete = lambda x: _state(f"{x}.c + 2", f"{x}.a || 'D'", f"{x}.t")
    insert = lambda x, role: _state(f"{x}.c + 5", f"{x}.a || 'I'", f"list_append({x}.t, '{role}:')")

    def put(x: str, letter: str, role: str) -> str:
        kept = f"init = '{letter}'"
        row = _state(
            f"{x}.c + extra + CASE WHEN {kept} THEN 0 ELSE 1 END",
            f"{x}.a || CASE WHEN {kept} THEN 'K' ELSE 'R' END",
            f"list_append({x}.t, CASE WHEN {kept} THEN role ELSE '{role}' END || ':' || text)",
        )
        return f"CASE WHEN goes THEN {none} ELSE {row} END"

    system = _state("s.c + extra", "s.a || 'K'", "list_append(s.t, role || ':' || text)")
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations),
 x AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d),
 r AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    left(role, 1) AS init
  FROM x),
 f AS (
  SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN content = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN right(content, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM r),
 g AS (SELECT *, fault IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
 n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS rows
  FROM g GROUP BY conv_id),
 st AS (
  SELECT conv_id, 0 AS i, {begin} AS s, {none} AS q, {none} AS e, {none} AS o FROM n
  UNION ALL
  SELECT conv_id, i + 1, {delete("s")},
    least({delete("q")}, CASE WHEN init = 's' AND NOT goes THEN {system} ELSE {none} END),
    least({delete("e")}, {put("o1", "a", "assistant")}),
    least({delete("o")}, {put("s", "u", "user")}, {put("q", "u", "user")}, {put("e1", "u", "user")})
  FROM (
    SELECT st.conv_id, st.i, s, q, e, o, g.init, g.goes, g.extra, g.role, g.text,
      least(o, {insert("s", "user")}, {insert("q", "user")}, {insert("e", "user")}) AS o1,
      least(e, {insert("o", "assistant")}) AS e1
    FROM st JOIN g ON g.conv_id IS NOT DISTINCT FROM st.conv_id AND g.i = st.i + 1)),
 done AS (
  SELECT st.conv_id, least(s, e, {insert("o", "assistant")},
    {_state("q.c + 10", "q.a || 'II'", "list_concat(q.t, ['user:', 'assistant:'])")}) AS best
  FROM st JOIN n ON n.conv_id IS NOT DISTINCT FROM st.conv_id AND n.rows = st.i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = {
    "op12_repair_conversations": _repair(),
    "op11_periodic_runs": rf"""
WITH h AS (
  SELECT doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS given
  FROM documents),
 g AS (SELECT *, h // 10 AS g, len(given) AS n FROM h),
 p AS (SELECT *, g % nullif(n, 0) AS a, 1 + (n - g % nullif(n, 0)) // (3 + g % 8) AS p FROM g),
 t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
    ELSE given END AS words
  FROM p),
 six AS (
  SELECT doc_id, unnest(range(n - 5)) AS i,
    unnest(list_transform(range(n - 5), lambda i: array_to_string(words[i + 1:i + 6], ' '))) AS six
  FROM t WHERE n >= 12),
 pair AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
 island AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pair),
 stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM island GROUP BY doc_id, q, part),
 run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch
  WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
 listed AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    min({{'l': -length, 's': start, 'p': period}}) AS longest
  FROM run GROUP BY doc_id),
 dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
 kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM t) w
  ANTI JOIN dropped d ON d.doc_id IS NOT DISTINCT FROM w.doc_id AND d.i = w.i
  GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, -longest.l AS length,
  longest.p AS period, 1000 * -longest.l // longest.p AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN listed ON listed.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id IS NOT DISTINCT FROM t.doc_id
""",
    "op13_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 w AS (
  SELECT doc_id, unnest(range(len(words) - 12)) AS i,
    unnest(list_transform(range(len(words) - 12), lambda i: array_to_string(words[i + 1:i + 13], ' '))) AS win
  FROM t WHERE len(words) >= 13),
 f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM w),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE first < doc_id),
 each AS (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word FROM t),
 kept AS (
  SELECT each.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY each.i) AS text
  FROM each ANTI JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i
  GROUP BY each.doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id IS NOT DISTINCT FROM t.doc_id
""",
}
