import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm.bpe import WordBpe, encode

from .helpers import ODD, clashing, documents, table

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  ", "a", "İSTANBUL ΣΑΣ ς", "a<|endoftext|>b <|startoftext|>", "it's we'll X'D", "x\x1cy\x1fz\x85q\xa0w ", "²³ ⅧⅨ 12 34",
    "日本語 テキスト", "éa e ́", "😀😃 👨‍👩‍👧", "a" * 5000, "ab!?" * 3000, "\x00\x01 \x0b\x0c", "ﬁ ﬀ ſ K", "ǅ ẞ ß",
]


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), WordBpe(open(PATH, encoding="utf-8").read(), cache=50)


def test_equals_the_library(spark, both):
    theirs, ours = both
    for text in TEXTS + [t for _, t in documents(spark)]:
        e = theirs.encode(text, add_special_tokens=False)
        joined, n, decoded = ours.encode(text)
        assert joined == " ".join(map(str, e.ids)) and n == len(e.ids), text[:80]
        assert decoded == theirs.decode(e.ids, skip_special_tokens=False) == ours.decode(e.ids)


def test_every_character_equals_the_library(both):
    theirs, ours = both
    letters = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 4096):
        texts = [f"'{x}s A{x}1 a\u0345{x}\u0334 {x}\u0316" for x in letters[at : at + 4096]]
        for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ours.ids(text) == e.ids, ascii(text)


def test_a_word_of_a_million_letters(both):
    _, ours = both
    joined, n, _ = ours.encode("ab" * 500_000)
    assert n == len(joined.split()) > 0


def test_table(spark, both):
    theirs, _ = both
    out = encode(clashing(table(spark, ODD)), PATH).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ODD:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False)), ids))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert encode(table(spark, []), PATH).count() == 0
