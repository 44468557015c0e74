import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortkit.llm import encode
from cohortkit.llm.queries import tokenizer_file
from cohortkit.llm.spans import texts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", "   ", "a  b\n\n c 　 d é  è\t\tx", "\x01 a \x01\x01b", "x" * 300 + " y", " lead", "trail ",
    "İ i̇ ǅ Σας ΣΑΣ", "don't I'M we'LL 's 12 345", "é ́a", "<|endoftext|> a <|startoftext|>b",
    "𝔘𝔫 🙂🙂 ok\r\n\r\n", "\x1c a\x1c b \x85 c   d",
]


def same(strings, file):
    own = encode.encoder(tokenizer_file(file))
    ids, at = own.encode(*texts(pa.array(strings, pa.string())))
    plain = own.library.encode_batch(strings, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in plain]


@pytest.mark.parametrize("file", FILES)
def test_odd_texts(file):
    same(ODD, file)
    same(ODD[::-1] * 2, file)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab'sé  .\n\t1🙂́　\x01", max_size=30), max_size=5))
def test_any_text(strings):
    for file in FILES:
        same(strings, file)


@pytest.mark.parametrize("file", FILES)
def test_long_texts_in_parts_and_a_full_pool(file, monkeypatch):
    monkeypatch.setattr(encode, "PART", 50)
    monkeypatch.setattr(encode, "POOL", 40)
    same(["some words and more of them " * 20, "x" * 400, "", "e é " * 100], file)
    encode.encoder(tokenizer_file(file)).used = 0
    encode.encoder(tokenizer_file(file)).size[:] = 0
