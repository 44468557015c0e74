"""Toxicity: a convolutional text classifier on hashed words, in numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.spans import LOWER, hashes, runs, texts
from cohortkit.llm.text import whole
from cohortkit.sources import cut_lineage

WORD_BITS, START_BITS = 18, 16  # rows of the embedding tables, as powers of two
STARTS = (4, 6)  # bytes of a word's beginning that have embeddings of their own
WIDE = 8  # numbers of one embedding
FILTERS = 8  # per width
WIDTHS = (1, 2, 3)
EPOCHS = 8
BATCH = 32
RATE = 0.1
SAMPLE = 4000  # labelled rows to learn from, at most as many of either label as half
PART = 1 << 20  # bytes of text read at once
CHUNK = 1 << 14  # words scored or learned from at once
CUTS, FARTHEST = 64, 40  # bins of a logit for the thresholds: so many to a unit, up to this one
FOLDS = 5

# Common words that tell a text's language, for its threshold: fixed values.
COMMON = {
    "en": "the of and to is that was for with this are be by from they have",
    "de": "der die das und den von mit sich des auf dem nicht ist eine werden",
    "fr": "les des et une du dans qui pour est sur par il ce elle ne pas",
    "es": "los las el y del por con se su que lo como más o pero sus",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_WORD[0x80:] = True


@dataclass
class Words:
    """Hashed words of many texts: a row of table places per word, and where texts begin."""

    places: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Letters and digits in a row, without case, whole and by their beginnings."""
    low = LOWER[data]  # a copy
    upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[1:][upper] += 0x20  # U+00C0 to U+00DE
    starts, ends, first = runs(_WORD[low], offsets)
    whole_word = hashes(low, starts, ends)
    places = [whole_word >> np.uint64(64 - WORD_BITS)]
    for size in STARTS:
        begin = hashes(low, starts, np.minimum(ends, starts + size))
        places.append(begin >> np.uint64(64 - START_BITS))
    return Words(np.stack(places, axis=1).astype(np.int32), first, whole_word)


def _last(first: np.ndarray) -> np.ndarray:
    """Which words end a text."""
    last = np.zeros(first[-1], bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    return last


def all_words(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """Parts of a column: the first row, and the words; a long text is cut between words to read it."""
    data, offsets = texts(column)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, "right")) - 1)
        low, high = offsets[row], offsets[to]
        if to > row + 1 or high - low <= PART:
            yield row, words_of(data[low:high], offsets[row : to + 1] - low)
        else:
            gaps = low + np.flatnonzero(~_WORD[data[low:high]])
            before = np.searchsorted(gaps, np.arange(low + PART, high, PART))
            # A word that is longer than a part stays whole.
            cuts = np.unique([low, *gaps[before[before > 0] - 1], high])
            parts = [words_of(data[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield row, together(parts, one=True)
        row = to


def together(parts: list[Words], one: bool = False) -> Words:
    """Words of several parts; as those of ``one`` text, or of all their texts."""
    sizes = [len(p.hash) for p in parts]
    total = sum(sizes)
    starts = np.cumsum([0, *sizes])[:-1]
    first = [p.first[:-1] + s for p, s in zip(parts, starts, strict=True)]
    return Words(
        np.concatenate([np.zeros((0, 1 + len(STARTS)), np.int32), *(p.places for p in parts)]),
        np.array([0, total]) if one else np.concatenate([*first, [total]]).astype(np.int64),
        np.concatenate([np.zeros(0, np.uint64), *(p.hash for p in parts)]),
    )


@dataclass
class Model:
    """Embeddings, filters and the last layer; thresholds by language, as logits."""

    tables: list[np.ndarray]
    filters: np.ndarray  # (embedding, step of a width, filter)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        random = np.random.default_rng(seed)
        rows = [1 << WORD_BITS, *(1 << START_BITS for _ in STARTS)]
        size = WIDE * len(rows)
        return cls(
            # Words that training never picks stay zero, and so say nothing.
            [np.zeros((r, WIDE), np.float32) for r in rows],
            random.normal(0, 0.3, (size, sum(WIDTHS) * FILTERS)).astype(np.float32),
            np.full(len(WIDTHS) * FILTERS, 0.1, np.float32),
            random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        )

    def embed(self, places: np.ndarray) -> np.ndarray:
        return np.concatenate([t[places[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def responses(self, embedded: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Per width the filters' sums at each word; windows end with the ``last`` of a text."""
        moved = embedded @ self.filters
        out, step = [], 0
        for width in WIDTHS:
            total = moved[:, step * FILTERS : (step + 1) * FILTERS].copy()
            blocked = last.copy()
            for k in range(1, width):
                more = moved[k:, (step + k) * FILTERS : (step + k + 1) * FILTERS]
                total[:-k] += np.where(blocked[:-k, None], 0, more) if len(more) else 0
                blocked[:-k] |= last[k:]
            out.append(total)
            step += width
        return out

    def logits(self, words: Words) -> np.ndarray:
        """A number per text, from so many words at a time that memory is bounded."""
        first, total = words.first, int(words.first[-1])
        pooled = np.full((len(first) - 1, len(self.bias)), -np.inf, np.float32)
        last = _last(first)
        for low in range(0, total, CHUNK):
            high = min(low + CHUNK, total)
            more = min(high + max(WIDTHS) - 1, total)
            found = self.responses(self.embed(words.places[low:more]), last[low:more])
            some = np.arange(np.searchsorted(first, low, "right") - 1, np.searchsorted(first, high))
            some = some[first[some] < first[some + 1]]
            at = np.maximum(first[some] - low, 0)
            best = [np.maximum.reduceat(r[: high - low], at) for r in found]
            pooled[some] = np.maximum(pooled[some], np.concatenate(best, axis=1))
        pooled[np.diff(first) == 0] = 0
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def scores(self, words: Words) -> np.ndarray:
        """0 to 1; 0.5 is the threshold of the text's language."""
        languages = guess_languages(words)
        level = np.array([self.thresholds.get(x, 0.0) for x in languages])
        return 1 / (1 + np.exp(np.clip(level - self.logits(words), -50, 50)))


def _common() -> tuple[np.ndarray, np.ndarray]:
    listed = [(w, k) for k, line in enumerate(COMMON.values()) for w in line.split()]
    data = np.frombuffer("".join(w for w, _ in listed).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w, _ in listed])
    found = hashes(data, np.append(0, ends[:-1]), ends)
    order = np.argsort(found)
    return found[order], np.array([k for _, k in listed])[order]


_COMMON_HASH, _COMMON_LANGUAGE = _common()
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[(_COMMON_HASH & np.uint64(0xFFFF)).astype(np.int64)] = True


def guess_languages(words: Words) -> list[str]:
    """The language most of whose common words a text has; none: the first of the list."""
    n = len(words.first) - 1
    maybe = np.flatnonzero(_MAYBE[(words.hash & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(_COMMON_HASH, words.hash[maybe]), len(_COMMON_HASH) - 1)
    hit = _COMMON_HASH[at] == words.hash[maybe]
    text = np.searchsorted(words.first, maybe[hit], "right") - 1
    counts = np.bincount(text * len(COMMON) + _COMMON_LANGUAGE[at[hit]], minlength=n * len(COMMON))
    names = list(COMMON)
    return [names[k] for k in counts.reshape(n, -1).argmax(axis=1)]


class Stored:
    """Words of many texts as ``Words`` has them, but in a file; any range of places can be read.

    The places of a word are one 64-bit number.
    """

    def __init__(self, parts: Iterator[tuple[int, bytes]]):
        """``parts``: the number of a text, ascending, and a part of its words."""
        self.file, lengths = tempfile.TemporaryFile(), []
        for text, data in parts:
            lengths += [0] * (text + 1 - len(lengths))
            lengths[text] += len(data) // 8
            self.file.write(data)
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    @property
    def places(self) -> Stored:
        return self

    def __getitem__(self, some: slice) -> np.ndarray:
        self.file.seek(8 * some.start)
        return unpacked(np.frombuffer(self.file.read(8 * (some.stop - some.start)), np.uint64))


def packed(places: np.ndarray) -> np.ndarray:
    out = places[:, 0].astype(np.uint64)
    for k in range(len(STARTS)):
        out = out << np.uint64(START_BITS) | places[:, k + 1].astype(np.uint64)
    return out


def unpacked(numbers: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << START_BITS) - 1)
    starts = [numbers >> np.uint64(START_BITS * k) & mask for k in reversed(range(len(STARTS)))]
    return np.stack([numbers >> np.uint64(START_BITS * len(STARTS)), *starts], axis=1).astype(np.int32)


def train(words: Words | Stored, toxic: np.ndarray, times: np.ndarray) -> Model:
    """Learn from texts, each so many ``times`` a round, without thresholds.

    Adagrad on the logistic loss; through the pooling only the words that a
    filter picked get a gradient.
    """
    model = Model.fresh()
    random = np.random.default_rng(11)
    if len(toxic) == 0 or toxic.all() or not toxic.any():
        model.out_bias = 4.0 if len(toxic) and toxic.all() else -4.0
        model.out[:] = 0
        return model
    learn = np.repeat(np.arange(len(toxic)), times)
    share = toxic[learn].mean()
    balance = np.where(toxic, 0.5 / share, 0.5 / (1 - share))
    memory = _Memory(model)
    for _ in range(EPOCHS):
        order = random.permutation(learn)
        for k in range(0, len(order), BATCH):
            _step(model, memory, words, order[k : k + BATCH], toxic, balance)
    return model


class _Memory:
    """Adagrad's sums of squared gradients."""

    def __init__(self, model: Model):
        self.tables = [np.full(len(t), 1e-2, np.float32) for t in model.tables]
        self.filters = np.full_like(model.filters, 1e-2)
        self.bias = np.full_like(model.bias, 1e-2)
        self.out = np.full_like(model.out, 1e-2)
        self.out_bias = 1e-2


def _pieces(words: Words | Stored, batch: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Ranges of words of the batch's texts, in groups of about ``CHUNK`` words.

    A range is the text's number in the batch, its first word, the end of the
    words where windows begin, and the end of those that they reach.
    """
    group, size = [], 0
    for k, text in enumerate(batch.tolist()):
        low, end = int(words.first[text]), int(words.first[text + 1])
        while low < end:
            high = min(low + CHUNK - size, end)
            group.append((k, low, high, min(high + max(WIDTHS) - 1, end)))
            size += high - low
            low = high
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _picked(model: Model, words: Words | Stored, batch: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text and filter: the largest response, the places of its window's words, which of them there are."""
    columns = len(model.bias)
    pooled = np.full((len(batch), columns), -np.inf, np.float32)
    window = np.zeros((len(batch), columns, max(WIDTHS), len(model.tables)), np.int32)
    inside = np.zeros((len(batch), columns, max(WIDTHS)), bool)
    for group in _pieces(words, batch):
        places = np.concatenate([words.places[low:reach] for _, low, _, reach in group])
        last = np.zeros(len(places), bool)
        ends = np.cumsum([reach - low for _, low, _, reach in group])
        last[[e - 1 for e, (_, _, high, reach) in zip(ends, group, strict=True) if high == reach]] = True
        found = np.concatenate(model.responses(model.embed(places), last), axis=1)
        for end, (k, low, high, reach) in zip(ends.tolist(), group, strict=True):
            begin = end - (reach - low)
            response = found[begin : begin + high - low]
            at = response.argmax(axis=0)
            best = response[at, np.arange(columns)]
            new = np.flatnonzero(best > pooled[k])
            pooled[k, new] = best[new]
            reached = begin + at[new, None] + np.arange(max(WIDTHS))
            inside[k, new] = reached < end
            window[k, new] = places[np.minimum(reached, end - 1)]
    return pooled, window, inside


def _step(model: Model, memory: _Memory, words: Words | Stored, batch, toxic, balance) -> None:
    pooled, window, inside = _picked(model, words, batch)
    some = words.first[batch + 1] > words.first[batch]
    pooled[~some] = 0
    active = np.maximum(pooled + model.bias, 0)
    logit = active @ model.out + model.out_bias
    wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[batch]) * balance[batch] / len(batch)
    back = (wrong[:, None] * model.out) * (active > 0) * some[:, None]
    d_filters = np.zeros_like(model.filters)
    touched, d_embedded = [], []
    step = 0
    for w, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            column = w * FILTERS + f
            texts_ = np.flatnonzero(back[:, column])
            for k in range(width):
                there = texts_[inside[texts_, column, k]]
                places, g = window[there, column, k], back[there, column]
                c = (step + k) * FILTERS + f
                d_filters[:, c] += g @ model.embed(places)
                touched.append(places)
                d_embedded.append(g[:, None] * model.filters[:, c])
        step += width
    at, gradient = np.concatenate(touched), np.concatenate(d_embedded)
    for k, table in enumerate(model.tables):
        place, inverse = np.unique(at[:, k], return_inverse=True)
        total = np.zeros((len(place), WIDE), np.float32)
        np.add.at(total, inverse, gradient[:, k * WIDE : (k + 1) * WIDE])
        memory.tables[k][place] += (total**2).mean(axis=1)
        table[place] -= RATE * total / np.sqrt(memory.tables[k][place])[:, None]
    for name, g in (("filters", d_filters), ("bias", back.sum(axis=0)), ("out", active.T @ wrong)):
        past = getattr(memory, name)
        past += g**2
        getattr(model, name)[...] -= (0.3 * RATE * g / np.sqrt(past)).astype(np.float32)
    memory.out_bias += wrong.sum() ** 2
    model.out_bias -= 0.3 * RATE * wrong.sum() / np.sqrt(memory.out_bias)


def _thresholds(bins: list) -> dict[str, float]:
    """Per language the logit that errs least on the checked texts, in the middle of its gap.

    ``bins``: rows of ``language``, ``bin``, and how many texts are ``toxic``
    and ``clean``. A language with too few of them has the threshold of all.
    """
    chosen = {}
    every = _best_cut(bins)
    for name in COMMON:
        some = [r for r in bins if r["language"] == name]
        enough = all(sum(r[label] for r in some) >= 5 for label in ("toxic", "clean"))
        chosen[name] = _best_cut(some) if enough else every
    return chosen


def _best_cut(bins: list) -> float:
    at, inverse = np.unique([r["bin"] for r in bins], return_inverse=True)
    bad, good = (
        np.bincount(inverse, [r[label] for r in bins], len(at)) for label in ("toxic", "clean")
    )
    if not bad.any() or not good.any():
        return 0.0
    at = at / CUTS
    # Errors when everything from k on counts as toxic.
    missed = np.concatenate([[0], np.cumsum(bad)])
    blamed = np.concatenate([np.cumsum(good[::-1])[::-1], [0]])
    errors = missed + blamed
    padded = np.concatenate([[at[0] - 2], at, [at[-1] + 2]])
    gap = padded[1:] - padded[:-1]
    best = np.flatnonzero(errors <= errors.min())
    k = best[gap[best].argmax()]
    return float((padded[k] + padded[k + 1]) / 2)


def fold(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn from labelled documents of folds 2 to 4; all of fold 1 set the thresholds.

    The weights come from a bounded sample: by hash of the id the first
    ``sample`` / 2 rows of either label. Its texts count whole; their words are
    hashed in the tasks, come to the driver in parts and stay in a file of 8
    bytes a word there, from which training reads ``CHUNK`` words at a time.
    Thresholds are of the scores of every labelled document in fold 1, counted
    in the cluster by language and ``1 / CUTS`` of a logit.

    Labels other than 0 and 1 and rows without a document are left out;
    without labels of both kinds every text scores the same. Where the labels
    repeat an id, all of its rows are used; where the documents do, one of
    them is learned from and all count for the thresholds.
    """
    known = labels.select(
        labels[id_column].alias("id"), labels[label_column].cast("int").alias("toxic")
    ).filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    of_fold = fold(F.col("id"))
    picked = [
        known.filter((of_fold > 1) & (F.col("toxic") == k))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample // 2)
        for k in (0, 1)
    ]
    picked = cut_lineage(picked[0].union(picked[1]))  # ``sample`` rows at most
    rows = docs.select(docs[id_column].alias("id"), whole(docs[text_column]).alias("text"))
    model = _learn(rows, picked)
    if model.out.any():
        model.thresholds = _thresholds(_bins(rows.filter(of_fold == 1), known.filter(of_fold == 1), model))
    return model


def _learn(rows: DataFrame, picked: DataFrame) -> Model:
    """A model without thresholds from the picked labels and one text of each of their ids."""
    marks = picked.groupBy("id", "toxic").agg(F.count(F.lit(1)).cast("int").alias("times"))
    one = (
        rows.join(F.broadcast(picked.select("id").distinct()), "id")
        .groupBy("id")
        .agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    )
    id_type = rows.schema["id"].dataType.simpleString()
    parts = one.mapInArrow(_parts, f"id {id_type}, part int, words binary")
    ordered = parts.join(F.broadcast(marks), "id").orderBy(F.xxhash64("id"), "id", "toxic", "part")
    toxic, times = [], []

    def read() -> Iterator[tuple[int, bytes]]:
        for r in cut_lineage(ordered.select("toxic", "times", "part", "words")).toLocalIterator():
            if r["part"] == 0:
                toxic.append(r["toxic"] == 1)
                times.append(r["times"])
            yield len(toxic) - 1, bytes(r["words"])

    words = Stored(read())
    return train(words, np.array(toxic, bool), np.array(times, int))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids and texts: the id, the number of a part of the text, its packed words."""
    for batch in batches:
        for row, words in all_words(batch.column(1)):
            numbers = packed(words.places)
            for k, (low, high) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                cuts = [*range(low, max(high, low + 1), CHUNK), high]
                data = [numbers[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row + k] * len(data))),
                        pa.array(range(len(data)), pa.int32()),
                        pa.array(data, pa.binary()),
                    ],
                    ["id", "part", "words"],
                )


def _bins(rows: DataFrame, known: DataFrame, model: Model) -> list:
    """Labelled texts by ``language`` and ``bin`` of the logit: how many are ``toxic`` and ``clean``.

    At most ``2 * FARTHEST * CUTS + 1`` bins of a language, at any size.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    most = FARTHEST * CUTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in all_words(batch.column(1)):
                at = np.clip(np.round(shared.value.logits(words) * CUTS), -most, most)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(at)),
                        pa.array(guess_languages(words), pa.string()),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["id", "language", "bin"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {id_type}, language string, bin int")
    placed = placed.groupBy("id", "language", "bin").agg(F.count(F.lit(1)).alias("n"))
    marks = known.groupBy("id").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    bins = (
        placed.join(marks, "id")
        .groupBy("language", "bin")
        .agg(*(F.sum(F.col("n") * F.col(x)).alias(x) for x in ("toxic", "clean")))
        .collect()
    )
    shared.destroy()
    return bins


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = all_words(batch.column(place).fill_null(""))
            clean = [shared.value.scores(words) < 0.5 for _, words in parts]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)


def score_toxicity(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id, ``score`` (0 to 1, more is likelier toxic) and ``predicted`` (1 from 0.5 on).

    Scores come from whole texts alone. A null text counts as empty; texts
    without words all score the same. Repeated rows and null ids are scored
    like any other. No rows give no rows; other columns are not read. The
    model is of fixed size (about 13 MB) and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in all_words(batch.column(1)):
                scores = shared.value.scores(words)
                predicted = pa.array((scores >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(scores)), pa.array(scores), predicted],
                    ["id", "score", "predicted"],
                )

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), whole(docs[text_column]).alias("text"))
    scored = rows.mapInArrow(score, f"id {id_type}, score double, predicted int")
    return scored.withColumnRenamed("id", id_column)
