"""Personal data: generators propose spans, boosted trees and thresholds select them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.pii_truth import luhn_sum, planted
from cohortkit.llm.text import whole
from cohortkit.sources import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in forms that match the same and take linear time: a run
# of characters is never tried again from its middle, and repeats don't go back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators with high recall: written-out, spaced and bracketed forms, other
# notations, and tight ones that find what a base match swallowed whole.
_AT = r"(?:at|AT|@)"
_DOT = r"(?:dot|DOT|\.)"
WIDE = {
    "email": (
        r"(?<![^\s<>()\[\]{}\",;:])[^\s<>()\[\]{}\",;:@]++@[^\s<>()\[\]{}\",;:@]*[^\s<>()\[\]{}\",;:@.!?]"
        rf"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({{<]\x20?{_AT}\x20?[\])}}>]\x20?[A-Za-z0-9-]++"
        rf"(?:(?:\.|\x20?[\[({{<]\x20?{_DOT}\x20?[\])}}>]\x20?)[A-Za-z0-9-]++){{1,4}}"
        rf"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20{_AT}\x20[A-Za-z0-9-]++(?:\x20{_DOT}\x20[A-Za-z0-9-]++){{1,4}}"
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
        r"|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
        r"|(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Za-z:])"
    ),
    "card": (
        r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20._/\u00A0-]{1,3}[0-9]{4}){3})(?![0-9])"
        r"|(?<![\uFF10-\uFF19])[\uFF10-\uFF19]{16,19}(?![\uFF10-\uFF19])"
    ),
    "phone": (
        r"(?<![0-9+])(?:[+\uFF0B][0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
        r"|(?<![0-9])00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])"
    ),
}
# What a text must have for any match of a pattern of the kind.
POSSIBLE = {"email": r"@|[\x20({\[<](?:at|AT)[\x20)}\]>]", "ip": "[0-9][.\\[(\x20]|:", "card": "[0-9\uFF10-\uFF19]", "phone": "[0-9]"}
HINTS = r"(?i)(?:mail|phone|tel|call|fax|card|visa|credit|pay|host|server|address|contact|write|\bip)[^A-Za-z]*$"
OTHERS = r"(?i)(?:order|isbn|part|code|total|sum|ratio|version|price|look|item|no\.?|id)[^A-Za-z]*$"
ENDS = r"(?i)\b(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
FULL_WIDTH = "０１２３４５６７８９＋"

_MARKS = "\x01\x02"  # around a match, where matches are found
TREES, DEPTH, STEP = 16, 4, 0.3
PRECISION = 0.98
FOLDS = 5
_CHUNK = 256


def find_personal_data(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Spans of personal data in every whole text.

    Columns: the id, ``base`` and ``spans``, arrays of (kind, start, end) in
    code points, end exclusive, by kind in the order of ``KINDS`` and then by
    start. Base spans match their kind's pattern and its rule (numbers of an
    address at most 255; 16 to 19 digits that pass Luhn; 8 to 15 digits) and
    always stay. Other candidates come from looser and tighter patterns and
    may overlap; those are added that boosted trees, on features of their
    format and of the text around them, score above their kind's threshold
    and that no base span covers.

    The trees learn from planted data of known truth, see ``pii_truth``: forms
    and look-alikes in contexts of all documents. Base rules that are certain (a number of an address above 255, digits that fail
    Luhn's test) hold for looser forms too, as a filter, and are no features.
    A kind's threshold is the least score with ``PRECISION`` on the look-alikes
    and forms of a fold of contexts that the trees don't learn from. Neither
    depends on how many candidates a table has.

    All work is in expressions of each row; nothing is shuffled but the
    contexts and counts of equal features, from which the trees are fitted, and
    sums by kind and score. A null text counts as empty and has no spans; repeated rows are
    each returned. No rows give no rows; other columns are not read.
    """
    found = _candidates(docs, id_column, text_column)
    score, thresholds = _learn(docs, text_column)
    if score is None:
        more = F.filter("candidates", lambda c: F.lit(False))
    else:
        least = F.array(*(F.lit(float(thresholds[k])) for k in KINDS))
        more = F.filter(
            "candidates",
            lambda c: (score(c["features"]) >= F.element_at(least, c["kind"] + 1))
            & ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])),
        )
    added = F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    spans = F.sort_array(F.array_union("base", added))
    return found.select(F.col("id").alias(id_column), _named("base"), _named(spans).alias("spans"))


def spans_text(spans: str | Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(text: Column, spans: str | Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    in_order = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        shown = F.when(s["start"] >= done["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(
            F.concat(done["out"], kept, shown).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    return F.aggregate(
        in_order, begun, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))
    )


def _named(spans: str | Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.transform(
        spans,
        lambda s: F.struct(
            F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    ).alias("base")


# --- candidates -------------------------------------------------------------


def _candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per row ``base``, spans, and ``candidates``, spans with ``features``."""
    rows = _found(docs, id_column, text_column, [*BASE.items(), *WIDE.items()])
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    kinds = list(BASE)
    valid = [_only(_valid, k, f"all{i}") for i, k in enumerate(kinds)]
    loose = [_only(_valid_loose, k, f"all{i + len(kinds)}") for i, k in enumerate(kinds)]
    each = lambda m: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _features(m).alias("features")
    )
    return rows.select("id", F.transform(F.concat(*valid), span).alias("base"), F.concat(*loose).alias("loose")).select(
        "id", "base", F.transform("loose", each).alias("candidates")
    )


def _found(
    docs: DataFrame, id_column: str, text_column: str, patterns: list[tuple[str, str]], kind: str | None = None
) -> DataFrame:
    """``id`` and matches of each pattern, ``all0`` and so on; with a ``kind`` of rows those of its patterns only.

    Each pattern goes over a text once and sets marks around its matches; the
    marks part the text into pieces, of which every second is a match.
    """
    text = F.translate(whole(docs[text_column]), _MARKS, "\x03\x03")  # no pattern tells these apart
    rows = docs.select(docs[id_column].alias("id"), text.alias("text"))
    n = range(len(patterns))
    wanted = lambda k: F.lit(True) if kind is None else F.col(kind) == KINDS.index(k)
    marked = lambda k, p: F.when(
        wanted(k) & F.regexp_like("text", F.lit(POSSIBLE[k])),
        F.split(F.regexp_replace("text", p, f"{_MARKS[0]}$0{_MARKS[1]}"), f"[{_MARKS}]", -1),
    )
    rows = rows.select("id", *(marked(k, p).alias(f"pieces{i}") for i, (k, p) in enumerate(patterns)))
    rows = rows.withColumns({f"lengths{i}": F.transform(f"pieces{i}", lambda x: F.length(x)) for i in n})
    rows = rows.withColumns({f"chunks{i}": _chunk_sums(F.col(f"lengths{i}")) for i in n})
    rows = rows.withColumns({f"before{i}": _sums_before(F.col(f"chunks{i}")) for i in n})
    return rows.select(
        "id", *(_matches(KINDS.index(k), i).alias(f"all{i}") for i, (k, _) in enumerate(patterns))
    )


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _chunk_sums(lengths: Column) -> Column:
    """Sums of each ``_CHUNK`` lengths, so that a start needs few additions."""
    last = F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda j: _total(F.slice(lengths, j * _CHUNK + 1, F.lit(_CHUNK)))
    )


def _sums_before(chunks: Column) -> Column:
    return F.transform(chunks, lambda _, j: _total(F.slice(chunks, F.lit(1), j)))


def _matches(kind: int, i: int) -> Column:
    """Matches of a pattern with their places and the text around them, up to the next match."""
    pieces, lengths, before = (F.col(f"{x}{i}") for x in ("pieces", "lengths", "before"))

    def one(at: Column) -> Column:
        chunk = F.floor(at / _CHUNK).cast("int")
        start = F.get(before, chunk) + _total(F.slice(lengths, chunk * _CHUNK + 1, at - chunk * _CHUNK))
        m = F.get(pieces, at)
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            (start + F.length(m)).alias("end"),
            m.alias("text"),
            F.right(F.get(pieces, at - 1), F.lit(24)).alias("left"),
            F.left(F.get(pieces, at + 1), F.lit(24)).alias("right"),
        )

    some = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)))
    return F.coalesce(F.transform(some, one), F.array())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _only(rule: Callable[[str, Column], Column], kind: str, matches: str | Column) -> Column:
    return F.filter(matches, lambda m: rule(kind, m["text"]))


def _valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return _octets(text)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _valid_loose(kind: str, text: Column) -> Column:
    """What is certain of any notation of the kind."""
    plain = F.translate(text, FULL_WIDTH, "0123456789+")
    if kind == "ip":
        return F.contains(text, F.lit(":")) | _octets(text)
    return _valid(kind, plain)


def _octets(text: Column) -> Column:
    """Whether all numbers in the text are at most 255, whatever zeros they begin with."""
    return F.forall(
        F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)),
        lambda x: F.regexp_like(x, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$")),
    )


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass Luhn's test; false for none and for more."""
    return F.when(F.length(digits).between(1, 19), luhn_sum(digits) % 10 == 0).otherwise(F.lit(False))


def _features(m: Column) -> Column:
    """Numbers that describe a candidate's format and the text around it.

    None is what a kind's rule asks of it.
    """
    text = m["text"]
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    is_like = lambda c, p: F.regexp_like(c, F.lit(p)).cast("int")
    numbers = [
        m["kind"],
        F.length(text),
        count(text, "[A-Za-z]"),
        count(text, "[0-9]+"),  # groups
        count(text, r"[\x20\u00A0]"),
        count(text, "[-_/]"),
        count(text, r"\."),
        count(text, ":"),
        count(text, r"[\[({<]"),
        count(text, "(?i)dot"),
        F.startswith(text, F.lit("+")).cast("int"),
        F.startswith(text, F.lit("00")).cast("int"),
        is_like(text, ENDS),
        is_like(text, r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"),
        count(m["left"], "[0-9]"),
        count(m["right"], "[0-9]"),
        is_like(m["left"], r"[\p{L}0-9_@/=.:#-]$"),
        is_like(m["right"], r"^(?:[\p{L}0-9_@/=:%#]|[.-][0-9])"),
        is_like(m["left"], HINTS),
        is_like(m["left"], OTHERS),
    ]
    return F.array(*(x.cast("double") for x in numbers))


# --- trees ------------------------------------------------------------------

Score = Callable[[Column], Column]


def _planted(docs: DataFrame, text_column: str) -> DataFrame:
    """Candidates that are a planted form: ``kind``, ``features``, ``label``, ``check``.

    Label 1 for personal data, 0 for look-alikes. Forms that no generator
    proposes as they are have a row without features.
    """
    found = _found(planted(docs, text_column, KINDS), "truth", "text", list(WIDE.items()), "id.kind")
    exact = lambda i: F.filter(
        f"all{i}", lambda m: (m["start"] == F.col("id.start")) & (m["end"] == F.col("id.end"))
    )
    its = F.concat(*(_only(_valid_loose, k, exact(i)) for i, k in enumerate(WIDE)))
    return found.select(
        F.col("id.kind").alias("kind"),
        F.get(F.transform(its, _features), F.lit(0)).alias("features"),
        F.col("id.good").cast("double").alias("label"),
        (F.pmod("id.by", F.lit(FOLDS)) == 0).alias("check"),
    )


def _learn(docs: DataFrame, text_column: str) -> tuple[Score | None, dict[str, float]]:
    """The trees as an expression of the features, and each kind's threshold."""
    known = cut_lineage(_counted(_planted(docs, text_column)))
    proposed = known.filter("features IS NOT NULL")  # earlier Spark would find the features twice, for a filter
    trees = _trees(proposed.filter("NOT check"))
    if trees is None:
        return None, {}
    score = trees_score(trees)
    return score, {name: _threshold(_bins(proposed, score, k)) for k, name in enumerate(KINDS)}


def _counted(known: DataFrame) -> DataFrame:
    """Equal rows as one, with their number ``n``.

    Features are small numbers of a form and of 24 characters around it, so
    there are few different rows however many documents lend a context.
    """
    return known.groupBy("kind", "features", "label", "check").agg(F.count(F.lit(1)).alias("n"))


def planted_report(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``kind``, ``planted``, ``proposed``, ``selected``, ``wrong``: what becomes of the check fold's forms.

    Of ``planted`` forms of personal data the generators propose ``proposed``
    and the thresholds select ``selected``; they select ``wrong`` of its
    look-alikes besides. A table without words has no rows.
    """
    score, thresholds = _learn(docs, text_column)
    known = _planted(docs, text_column).filter("check")
    if score is None:
        return known.sparkSession.createDataFrame([], "kind string, planted long, proposed long, selected long, wrong long")
    least = F.array(*(F.lit(float(thresholds[k])) for k in KINDS))
    selected = F.col("features").isNotNull() & (score(F.col("features")) >= F.element_at(least, F.col("kind") + 1))
    good = F.col("label") == 1
    return known.groupBy(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind")).agg(
        F.count_if(good).alias("planted"),
        F.count_if(good & F.col("features").isNotNull()).alias("proposed"),
        F.count_if(good & selected).alias("selected"),
        F.count_if(~good & selected).alias("wrong"),
    )


def _trees(train: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees; none where the rows have one label only. A column ``n`` tells how often a row counts."""
    n = (F.col("n") if "n" in train.columns else F.lit(1)).cast("double")
    rows = train.select(array_to_vector("features").alias("features"), "label", n.alias("n"))
    rows = rows.orderBy("label", train["features"]).coalesce(1)  # sums in one order; see ``_counted``
    size, labels = rows.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if labels < 2:
        return None
    # With fewer bins Spark would choose the places of splits from a sample of the rows.
    bins = 32 if size <= 10_000 else math.isqrt(size) + 1
    return GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=5, checkpointInterval=-1, maxBins=bins, weightCol="n"
    ).fit(rows)


def trees_score(trees: GBTClassificationModel) -> Score:
    """The trees written out as an expression of a list of features."""
    parsed = [_tree(t.toDebugString) for t in trees.trees]

    def score(features: Column) -> Column:
        margin = sum(
            (F.lit(float(w)) * t(features) for w, t in zip(trees.treeWeights, parsed, strict=True)), F.lit(0.0)
        )
        return 1 / (1 + F.exp(-2 * margin))

    return score


def _bins(proposed: DataFrame, score: Score, kind: int) -> list:
    """Right ones and all of a kind's check fold by score, of which there are 101."""
    return (
        proposed.filter(F.col("check") & (F.col("kind") == kind))
        .select("label", "n", F.round(score(F.col("features")), 2).alias("score"))
        .groupBy("score")
        .agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n"))
        .collect()
    )


def _threshold(bins: list) -> float:
    """The least score from which candidates are right often enough; above all where none is."""
    best, right, n = 1.01, 0.0, 0
    for r in sorted(bins, key=lambda r: -r["score"]):
        right, n = right + r["right"], n + r["n"]
        if right / n >= PRECISION and r["score"] >= 0.5:
            best = r["score"] - 0.005
    return best


def _tree(text: str) -> Score:
    """An expression for a tree as Spark prints it."""
    lines = [x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            value = float(line.split(":")[1])
            return lambda f: F.lit(value)
        feature, limit = re.search(r"feature (\d+) <= ([-0-9.eE]+)", line).groups()
        low = node()
        at += 1  # the matching Else
        high = node()
        return lambda f: F.when(F.get(f, F.lit(int(feature))) <= float(limit), low(f)).otherwise(high(f))

    return node()
