"""Secret scans: patterns of common secrets, and a token-efficiency test for random strings that no pattern names.

A vocabulary learnt from ordinary text spells ordinary text with few tokens. A candidate string whose characters per
token fall below `ratio` is random, unless it is a known kind of digest (capital hexadecimal of a digest's length, or base64 of
one behind the digest's name; small hexadecimal is a base span already), a UUID, a number, a date, or an identifier (words joined by - _ . / or camel case) whose runs of letters are spelt with few tokens.
Candidates are split at = / : and . before they are scored; of what a pattern has found only the rest is scored.

Null and empty texts have no spans. Whole texts are scanned, however long; every row gives one row, repeated rows and
null ids too; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.vocabulary import byte_bpe, default_path

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # a maximal run of 16 or more: what [0-9a-f]+ matches, but for the shorter ones
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=@-])[A-Za-z0-9+/_.=-]{16,}(?![A-Za-z0-9+/_.=@-])")
#: Bytes of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_BYTES = (16, 20, 28, 32, 48, 64)
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[-:=]$", re.I)
NAMED_DIGEST = re.compile(r"(?:md5|sha(?:1|224|256|384|512))-([A-Za-z0-9+/]+={0,2})", re.I)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBERS = re.compile(r"[0-9.,:/+_=-]+[TZ]?[0-9.,:/+_=-]*Z?")
#: Parts that are words or numbers: letters in one case or capitalised, digits, or a word with a number after it.
WORDS = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+|[A-Z]?[a-z]{3,}[0-9]{1,6}|[0-9]+|[A-Z]{1,4}[0-9]{1,4}|[vV]?[0-9]+(?:\.[0-9]+)*)(?:[-_./=+]+|$))+")
CAMEL = re.compile(r"[A-Z]?[a-z]+[0-9]{0,2}(?:[A-Z][a-z]+[0-9]{0,2})+")
RUNS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Fewest signs of a random string, and of a part that is taken for a word by its score.
LEAST, WORD = 16, 6


def digest_sized(text: str) -> bool:
    """Whether base64 of this length is a digest's, with or without the filling."""
    return len(text.rstrip("=")) in [-(-8 * n // 6) for n in DIGEST_BYTES]


def known(text: str) -> bool:
    """Whether a candidate is a digest, a UUID or a number, whatever its score."""
    if len(text) in [2 * n for n in DIGEST_BYTES] and re.fullmatch("[0-9A-F]+", text):
        return True
    if (named := NAMED_DIGEST.fullmatch(text)) and digest_sized(named[1]):
        return True
    return any(p.fullmatch(text) for p in (UUID, NUMBERS))


def _efficient(text: str, encoding, ratio: float) -> bool:
    """Whether the vocabulary spells the text with few tokens; capitals count as the letters they are too."""
    return any(len(t) >= ratio * len(encoding.encode_ordinary(t)) for t in ((text, text.lower()) if text.isupper() else (text,)))


def plain(text: str, encoding, ratio: float) -> bool:
    """Whether a string is known, spelt with few tokens, or an identifier whose runs of letters are."""
    if known(text) or _efficient(text, encoding, ratio):
        return True
    if not (WORDS.fullmatch(text) or CAMEL.fullmatch(text)):
        return False
    runs = [r.lower() for r in RUNS.findall(text)]
    return sum(map(len, runs)) >= ratio * sum(len(encoding.encode_ordinary(r)) for r in runs) > 0


def _random_parts(text: str, encoding, ratio: float) -> list[tuple[int, int]]:
    """(start, end) of random strings in a candidate. It is split at = / : and . so that what stands before a value does not
    count for it; neighbouring parts that are not plain are one string, as in base64, with short parts between them."""
    parts = [(m.start(), m.end()) for m in re.finditer("[^=/:.]+", text)]
    odd = [not plain(text[s:e], encoding, ratio) for s, e in parts]
    groups: list[list[int]] = []
    for k, (s, e) in enumerate(parts):
        if odd[k] and groups and all(odd[n] or parts[n][1] - parts[n][0] < WORD for n in range(groups[-1][-1] + 1, k)):
            groups[-1].append(k)
        elif odd[k]:
            groups.append([k])
    found = []
    for g in groups:
        s, e = parts[g[0]][0], parts[g[-1]][1]
        if e - s >= LEAST and not plain(text[s:e], encoding, ratio):
            found.append((s, e))
    if not found and len(text) >= LEAST and all(o or e - s < WORD for o, (s, e) in zip(odd, parts, strict=True)) and not plain(text, encoding, ratio):
        return [(0, len(text))]
    # a random string behind words that are joined to it by - _ or +
    for s, e in parts:
        if e - s > LEAST and not any(a < e and s < b for a, b in found):
            found += [(s + m.start(), s + m.end()) for m in re.finditer(r"[^-_+]{16,}", text[s:e]) if m.end() - m.start() < e - s and not plain(m[0], encoding, ratio)]
    return sorted(found)


def spans(text: str, encoding, ratio: float) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) by start, then kind; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    if (":" in text or "=" in text) and any(n in low for low in (text.lower(),) for n in NAMES):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in found)
    for m in CANDIDATE.finditer(text):
        if known(m[0]) or (digest_sized(m[0]) and DIGEST_NAME.search(text, max(0, m.start() - 8), m.start())):
            continue
        at, pieces = m.start(), []
        for s, e in base:
            if s < m.end() and e > at:
                pieces.append((at, s))
                at = e
        for s, e in [*pieces, (at, m.end())]:
            piece = text[s:e].rstrip(".=-/_+")
            if s > m.start():
                piece, s = piece.lstrip(".=-/_+"), s + len(piece) - len(piece.lstrip(".=-/_+"))
            if len(piece) >= LEAST:
                found += [(3, s + a, s + b) for a, b in _random_parts(piece, encoding, ratio)]
    return sorted(found, key=lambda x: (x[1], x[0]))


SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"


def _scan(batches: Iterator[pa.RecordBatch], path: str, ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = byte_bpe(path)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column(1).fill_null("").to_pylist():
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for k, s, e in spans(text, encoding, ratio)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, ratio: float = 2.0) -> DataFrame:
    """(doc_id, spans): one row per row of docs, with every secret found in its whole text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(partial(_scan, path=vocabulary or default_path("byte_bpe_50k.tiktoken"), ratio=ratio), f"doc_id long, spans {SPANS}")
