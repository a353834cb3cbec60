"""Secret scans by dictionary-primed zstandard novelty, beside fixed patterns.

Patterns find assignments, access keys and long hexadecimal runs. Beyond them, every run of credential characters that
stands shortly after a sensitive word is a candidate. Its novelty is what it adds to the compressed size of the text
around it, by a compressor primed with a dictionary of identifiers and common words: names, paths and words that occur
nearby compress away, random strings do not. What a random string adds depends on its length, its alphabet and the text
(0.4 to more than one byte a character), so candidates are held against random strings of their own length and alphabet
at the same place. Those that add nearly as much are reported, and those whose bytes per character alone reach the limit.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces

KINDS = ("assign", "access", "hex", "novel")

# Fixed patterns; letters of `assign` count in either case, in ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Words after which a credential may stand, and how near.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private", "credential", "bearer", "authorization", "client_id", "signature")
CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.I | re.A)
NEAR = 64
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Code points of text on either side that a candidate is measured against.
AROUND = 256
#: The share of the bytes of random strings that a secret adds at least, and the bytes a character that suffice.
NOVELTY = 0.9
#: Bytes by which a short string may fall below that share, as compressed sizes are whole bytes.
ROUNDING = 1
#: Characters that come together in an alphabet; others count one by one.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
#: Random strings that a candidate is held against: several for short ones, whose sizes vary; long ones vary little.
SAMPLES, LONG = 5, 512

# Fixed word list: what primes the compressor.
IDENTIFIERS = """
password passwd passphrase secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
credential credentials bearer authorization auth login username user_name session cookie signature certificate key value
config configuration settings environment environ getenv default example placeholder changeme your_token_here xxxxxxxx
import from return function class def self this const let var public static final void string int float bool true false
null none undefined new delete print console log error warning info debug message request response server client host port
http https www localhost com org net html json xml yaml path file name type data list dict array object index count length
create update remove insert select where order group table column database connection open close read write append
version license description author email address date time timestamp start end first last next previous current
"""


class Novelty:
    """Marginal compressed bytes of a string against what surrounds it."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6):
        primer = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primer, write_checksum=False, write_content_size=False)

    def bytes_added(self, candidate: str, before: str, after: str) -> int:
        size = lambda s: len(self.compressor.compress(s.encode("utf-8", "replace")))
        around = before + after
        return size(around + candidate) - size(around)

    def is_novel(self, candidate: str, added: int, before: str, after: str, least: float = NOVELTY) -> bool:
        if added >= least * len(candidate):
            return True
        others = [self.bytes_added(x, before, after) for x in random_strings(alphabet(candidate), len(candidate))]
        return added + ROUNDING >= least * sum(others) / len(others)


def alphabet(text: str) -> str:
    """All characters of the classes that occur in `text`."""
    have = set(text)
    return "".join(x for x in CLASSES if have & set(x)) + "".join(sorted(have - set("".join(CLASSES))))


def random_strings(letters: str, length: int) -> list[str]:
    return _short_strings(letters, length) if length < LONG else _drawn(letters, length, 1)


def _drawn(letters: str, length: int, n: int) -> list[str]:
    rng = random.Random(f"{length} {letters}")
    return ["".join(rng.choices(letters, k=length)) for _ in range(n)]


@lru_cache(4096)
def _short_strings(letters: str, length: int) -> list[str]:
    return _drawn(letters, length, SAMPLES)


def base_spans(text: str, low: str) -> list[tuple[int, int, str, float | None]]:
    out: list[tuple[int, int, str, float | None]] = []
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        out += [(m.start(), m.end(), "assign", None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # A maximal run, so the same as taking all runs and dropping the short ones.
    out += [(m.start(), m.end(), "hex", None) for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, low: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str, float | None]]:
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out: list[tuple[int, int, str, float | None]] = []
    after = [word.end() for word in CONTEXT.finditer(text)]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        # the last word that ends before the candidate is the nearest
        k = bisect_right(after, start)
        if not k or start > after[k - 1] + NEAR:
            continue
        around = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        added = novelty.bytes_added(m[0], *around)
        if novelty.is_novel(m[0], added, *around, least):
            out.append((start, end, "novel", added / (end - start)))
    return out


def find(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, compressed bytes a character of novel ones), by start, then kind as listed in KINDS."""
    low = text.lower()  # only to see which patterns can match at all
    return sorted(base_spans(text, low) + novel_spans(text, low, novelty, least), key=lambda s: (s[0], KINDS.index(s[2])))


def _scan(batches: Iterator, least: float) -> Iterator:
    import pyarrow as pa

    novelty = Novelty()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
    for batch in pieces(batches):
        spans = [[{"kind": k, "start": a, "end": b, "novelty": x} for a, b, k, x in find(t.as_py(), novelty, least)] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY) -> DataFrame:
    """One row per input row: `doc_id, spans`, an array of kind, start, end (code points, end exclusive) and novelty.

    Matches of one kind do not overlap, those of different kinds may. novelty is null for the fixed patterns. Null and
    empty texts have no spans; null ids and repeated rows pass through; an empty table gives an empty result; other
    columns are ignored. Texts are scanned whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, partial(_scan, least=least), "doc_id long, spans array<struct<kind:string,start:int,end:int,novelty:double>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
