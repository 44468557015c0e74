import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortkit.llm import toxicity
from tests.llm.conftest import odd_rows

BAD = {"en": ["idiot", "moron"], "de": ["loweich", "loweist"]}
FILL = {"en": "the of and to with this from have", "de": "der die das und den von mit nicht"}


def corpus(n=1500):
    random.seed(2)
    rows, labels = [], []
    for i in range(n):
        lang = random.choice(["en", "de"])
        words = [*FILL[lang].split(), *(f"w{random.randrange(2000)}" for _ in range(random.randrange(3, 60)))]
        random.shuffle(words)
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(random.randrange(len(words)), random.choice(BAD[lang]).upper() + "!!")
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return docs, marks, toxicity.fit_toxicity(docs, marks)


def test_held_out_accuracy(fitted):
    docs, marks, model = fitted
    scored = toxicity.score_toxicity(docs, model).join(marks, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [r["predicted"] == r["toxic"] for r in held]
    assert len(held) > 50 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert set(model.thresholds) == set(toxicity.COMMON)


def test_same_model_from_other_partitions(fitted):
    docs, marks, model = fitted
    again = toxicity.fit_toxicity(docs.repartition(5), marks.repartition(3))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
    assert model.thresholds == again.thresholds


def test_chunks_and_cuts_do_not_matter(fitted, monkeypatch):
    _, _, model = fitted
    column = pa.array(["a idiot b", "", "w1 " * 500 + "moron", "!!!", "the " * 300])
    plain = np.concatenate([model.scores(w) for _, w in toxicity.all_words(column)])
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    monkeypatch.setattr(toxicity, "PART", 64)
    cut = np.concatenate([model.scores(w) for _, w in toxicity.all_words(column)])
    assert np.allclose(plain, cut, atol=1e-6) and len(plain) == 5


def test_gradient_by_differences():
    random_ = np.random.default_rng(0)
    model = toxicity.Model.fresh()
    for t in model.tables:
        t[:50] = random_.normal(0, 1, (50, toxicity.WIDE))
    words = toxicity.Words(random_.integers(0, 50, (40, 3)).astype(np.int32), np.array([0, 15, 15, 40]), np.zeros(40, np.uint64))
    toxic, balance = np.array([True, False, False]), np.ones(3)

    def loss():
        z = model.logits(words).astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - toxic * z)

    start = model.filters.copy()
    slopes = []
    for column in (0, 11, 30):
        for sign in (1, -1):
            model.filters[:] = start
            model.filters[2, column] += sign * 1e-2
            slopes.append(loss())
    model.filters[:] = start
    memory = toxicity._Memory(model)
    before = memory.filters.copy()
    toxicity._step(model, memory, words, np.arange(3), toxic, balance)
    taken = np.sqrt(memory.filters - before)
    for k, column in enumerate((0, 11, 30)):
        assert abs(taken[2, column] - abs(slopes[2 * k] - slopes[2 * k + 1]) / 2e-2) < 5e-3


def test_odd_documents(spark, odd, nothing, fitted):
    _, _, model = fitted
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == len(odd_rows())
    clean = toxicity.keep_clean(odd, model)
    assert clean.columns == odd.columns and clean.count() == sum(r["predicted"] == 0 for r in scored)
    assert toxicity.score_toxicity(nothing, model).collect() == []
    marks = spark.createDataFrame([(4, 1, None), (5, 0, 7), (None, 1, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    unlearned = toxicity.fit_toxicity(odd, marks)
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, unlearned).collect()} == {0}
    assert toxicity.fit_toxicity(nothing, marks.limit(0)).out_bias < 0


@pytest.mark.parametrize("text", ["aB3+/" * 300_000, "語" * 500_000, "語" * 500_000 + " idiot", "x" * 1_100_000 + "-idiot-" + "y" * 1_100_000])
def test_long_text_without_white_space(spark, fitted, text):
    _, _, model = fitted
    assert len(text.encode()) > toxicity.PART
    docs = spark.createDataFrame([(1, text), (2, "a idiot b"), (3, "")], "doc_id bigint, text string")
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert set(scored) == {1, 2, 3}
    whole = toxicity.words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert scored[1]["score"] == pytest.approx(model.scores(whole)[0], abs=1e-6)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in scored.items() if r["predicted"] == 0}


def test_thresholds_count_every_labelled_text_of_fold_1(spark, monkeypatch):
    rows, labels = corpus(600)
    # Texts of over 50,000 characters, as any others.
    rows = [(i, text + " filler" * 9_000 * (i % 10 == 0), *more) for i, text, *more in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    seen, thresholds = [], toxicity._thresholds
    monkeypatch.setattr(toxicity, "_thresholds", lambda bins: seen.extend(bins) or thresholds(bins))
    sampled, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda w, toxic, times: sampled.append((np.diff(w.first), toxic)) or train(w, toxic, times))
    toxicity.fit_toxicity(docs, marks, sample=100)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    for label, value in (("toxic", 1), ("clean", 0)):
        assert sum(r[label] for r in seen) == sum(fold(i) == 1 and t == value for i, _, t in labels)
    lengths, toxic = sampled[0]
    assert toxic.sum() == 50 and len(toxic) == 100 and lengths.max() > 9_000


def test_one_document_of_an_id_is_learned_from(spark, monkeypatch):
    rows, labels = corpus(60)
    hot = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 > 1)
    rows += [(hot, f"copy number{k}", "en", "s") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    sampled, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda w, toxic, times: sampled.append(len(toxic)) or train(w, toxic, times))
    toxicity.fit_toxicity(docs.repartition(4), marks)
    assert sampled == [sum(zlib.crc32(str(i).encode()) % 5 > 1 for i in range(60))]


def test_words_in_a_file_teach_the_same(monkeypatch):
    column = pa.array(["a idiot b " * 30, "", "w1 " * 50 + "moron", "!!!", "the " * 30])
    [(_, words)] = toxicity.all_words(column)
    toxic, times = np.array([True, False, True, False, False]), np.array([1, 1, 2, 1, 1])
    numbers = toxicity.packed(words.places)
    assert (toxicity.unpacked(numbers) == words.places).all()
    parts = [(k, numbers[a:b].tobytes()) for k, (low, high) in enumerate(zip(words.first[:-1], words.first[1:])) for a, b in ((low, (low + high) // 2), ((low + high) // 2, high))]
    stored = toxicity.Stored(iter(parts))
    assert (stored.first == words.first).all()
    plain = toxicity.train(words, toxic, times)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    cut = toxicity.train(stored, toxic, times)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(plain.tables, cut.tables, strict=True))
    assert np.allclose(plain.filters, cut.filters, atol=1e-4)


def plain_logit(model, text):
    """The network word by word: embeddings, every filter at every place, the largest, the last layer."""
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7}
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate(upper))
    rows = []
    for word in words:
        raw = np.frombuffer(word.encode(), np.uint8)
        places = toxicity.words_of(raw, np.array([0, len(raw)])).places[0]
        rows.append(np.concatenate([t[p] for t, p in zip(model.tables, places, strict=True)]).astype(float))
    total, column = model.out_bias, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            at = [
                sum(rows[i + k] @ model.filters[:, (column + k) * toxicity.FILTERS + f] for k in range(width) if i + k < len(rows))
                for i in range(len(rows))
            ]
            unit = toxicity.WIDTHS.index(width) * toxicity.FILTERS + f
            total += max(max(at, default=0.0) + model.bias[unit], 0.0) * model.out[unit]
        column += width
    return total


def test_a_plain_forward_pass(fitted):
    """Texts of several lengths and letters, many at once, against one at a time."""
    _, _, model = fitted
    random.seed(9)
    pool = [*FILL["en"].split(), *BAD["en"], "Été", "ÀÉÎ", "w17", "🙂", "x-y", "LOWEICH!!", "日本"]
    column = [" ".join(random.choice(pool) for _ in range(n)) for n in (0, 1, 2, 3, 9, 40, 120)]
    found = np.concatenate([model.logits(w) for _, w in toxicity.all_words(pa.array(column))])
    assert found == pytest.approx([plain_logit(model, t) for t in column], abs=1e-4)
