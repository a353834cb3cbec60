"""Byte-pair encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the possible merges by (rank, position). The best
one is taken again and again; entries whose symbols were merged away meanwhile are stale and skipped, so a word of n
symbols takes O(n log n) steps however long it is. Decoding concatenates vocabulary strings. Words repeat, so each
Python worker keeps a bounded two-generation cache of encoded chunks; texts are always encoded whole.

The tokenizer file (its path is a parameter) is small, fixed configuration: the driver reads it and broadcasts it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, text_of

#: Chunks per cache generation; a worker holds two.
CACHE = 150_000

# Where the tables of the tokenizers library are older or newer than those of Python 3.13 and `regex`.
#: Letters and numbers that the library's patterns do not know.
NO_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
#: Characters that its NFC neither reorders nor composes.
NO_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF "
    "10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 "
    "11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Capitals that it knows and Python does not: first capital, last capital, small letter of the first.
CAPITALS = (
    "1C89 1C89 1C8A, A7CB A7CB 0264, A7CC A7CC A7CD, A7CE A7CE A7CF, A7D2 A7D2 A7D3, A7D4 A7D4 A7D5, A7DA A7DA A7DB, A7DC A7DC 019B, "
    "10D50 10D65 10D70, 16EA0 16EB8 16EBB"
)


def class_of(ranges: str) -> str:
    """A character class of ranges in hexadecimal."""
    ends = [[chr(int(x, 16)) for x in r.split("-")] for r in ranges.split()]
    return "[" + "".join(map("-".join, ends)) + "]"


def small_letters(capitals: str) -> dict[int, int]:
    rows = [[int(x, 16) for x in r.split()] for r in capitals.split(",")]
    return {c: c - first + small for first, last, small in rows for c in range(first, last + 1)}


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Seen(dict):
    """Results by piece of text, in two generations of at most `most` each; long pieces are not kept."""

    def __init__(self, of: Callable[[str], tuple[str, str]], most: int):
        super().__init__()
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, piece: str) -> tuple[str, str]:
        got = self.old.get(piece) or self.of(piece)
        if len(piece) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class WordBpe:
    """A BPE tokenizer with word ends: normalise, split into words, map bytes to letters, merge."""

    def __init__(self, config: str, cache: int = CACHE):
        t = json.loads(config)
        model = t["model"]
        if model["type"] != "BPE" or t.get("decoder") or t.get("post_processor"):
            raise ValueError("a BPE tokenizer file without decoder and post-processor is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        #: By rank: the id that a merge makes. By the two ids: the rank.
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.ranks = {(self.vocab[a] << 20) | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.none = len(pairs)
        #: The ids of a byte inside and at the end of a word.
        self.inner = [self.vocab[x] for x in byte_letters()]
        self.last = [self.vocab[x + self.end] for x in byte_letters()]
        self.special = {x["content"]: x["id"] for x in t.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        #: White space as Unicode defines it.
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]")
        self.spaces = regex.compile(self.space.pattern + "+")
        splitter = next(p for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = splitter["pattern"]["Regex"]
        self.ascii_word = regex.compile(pattern)
        for known in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(known, f"[{known}--{class_of(NO_LETTERS)}]")
        self.word = regex.compile(pattern, regex.VERSION1)
        self.marks = re.compile(class_of(NO_MARKS))
        self.at_marks = re.compile(f"({class_of(NO_MARKS)})")
        self.small = small_letters(CAPITALS)
        self.capitals = re.compile(class_of(" ".join("-".join(r.split()[:2]) for r in CAPITALS.split(","))))
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.seen = Seen(self.chunk, cache)

    def forget(self) -> None:
        """Empties the cache; between tasks, so that an idle worker holds none."""
        self.seen.clear()
        self.seen.old = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        n = len(word)
        ids = [*map(self.inner.__getitem__, word)]
        ids[-1] = self.last[word[-1]]
        if n == 1:
            return ids
        ranks, made, none = self.ranks.get, self.made, self.none
        #: Rank of the pair that starts at each live symbol; an entry of the queue with another rank is stale.
        pair = [ranks((x << 20) | y, none) for x, y in zip(ids, ids[1:], strict=False)]
        pair.append(none)
        bits = n.bit_length()
        queue = [(r << bits) | i for i, r in enumerate(pair) if r < none]
        heapq.heapify(queue)
        after, before, mask = [*range(1, n), n], [*range(-1, n - 1)], (1 << bits) - 1
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            x = pop(queue)
            i = x & mask
            r = x >> bits
            if pair[i] != r:
                continue
            j = after[i]
            ids[i] = new = made[r]
            ids[j], pair[j] = -1, none
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = ranks((new << 20) | ids[k], none)
                if r < none:
                    push(queue, (r << bits) | i)
            else:
                pair[i] = none
            h = before[i]
            if h >= 0:
                pair[h] = r = ranks((ids[h] << 20) | new, none)
                if r < none:
                    push(queue, (r << bits) | h)
        return [x for x in ids if x >= 0]

    def chunk(self, chunk: str) -> tuple[str, str]:
        """Of a piece without white space: ids and token strings, each joined by spaces."""
        words = (self.ascii_word if chunk.isascii() else self.word).findall(chunk)
        if len(words) > 1:
            parts = [*map(self.seen.__getitem__, words)]
            return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
        ids = self.merge(chunk.encode())
        return " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids])

    def composed(self, text: str) -> str:
        """NFC as the library has it: characters that its tables lack stay where they are, between composed stretches."""
        if not self.marks.search(text):
            return unicodedata.normalize("NFC", text)
        return "".join([x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(self.at_marks.split(text))])

    def _plain(self, text: str) -> list[tuple[str, str]]:
        if not text.isascii():
            text = self.composed(text)
            # letter by letter, as the final sigma is not told from others
            text = self.spaces.sub(" ", text).replace("Σ", "σ")
            if self.capitals.search(text):
                text = text.translate(self.small)
        text = text.lower()
        # split() also cuts at the separators 1C to 1F, which are not white space here
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [c for c in self.spaces.split(text) if c]
        return [*map(self.seen.__getitem__, chunks)]

    def encode(self, text: str) -> tuple[str, int, str]:
        """Ids of the whole text joined by spaces, their number, and the decoded text."""
        if self.apart is None or not self.apart.search(text):
            parts = self._plain(text)
        else:
            parts, at = [], 0
            for m in self.apart.finditer(text):
                parts += self._plain(text[at : m.start()])
                parts.append((str(self.special[m[0]]), m[0]))
                at = m.end()
            parts += self._plain(text[at:])
        ids = " ".join([p[0] for p in parts])
        return ids, ids.count(" ") + bool(ids), " ".join([p[1] for p in parts])

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, in a file without decoder joined by spaces; unknown ids are skipped."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_LOADED: dict[str, WordBpe] = {}


def loaded(config: str) -> WordBpe:
    """One tokenizer for each worker process."""
    key = hashlib.sha256(config.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(config)
    return _LOADED[key]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: `doc_id, n_tokens, ids_sha256, decoded_sha256` and, with `ids`, `token_ids`.

    Whole texts are encoded, however long; null and empty texts have no tokens and the digests of the empty string. Null
    and repeated ids are passed through, rows that repeat give repeated results, an empty table an empty one. Other
    columns are ignored. `ids_sha256` is of the decimal ids joined by a space, `decoded_sha256` of the decoded text.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())  # a fixed file of about 2 MB

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = loaded(config.value)
        bpe.forget()
        for batch in pieces(batches):
            text = batch.column(1)
            cols: list[list] = [[], [], [], []]
            # texts are read one by one: a batch's result holds digests, and ids only where asked for
            for t in text:
                joined, n, decoded = bpe.encode(t.as_py())
                cols[0].append(n)
                cols[1].append(hashlib.sha256(joined.encode()).hexdigest())
                cols[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    cols[3].append(np.fromstring(joined, np.int32, sep=" "))
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return map_arrow(rows, run, schema)
