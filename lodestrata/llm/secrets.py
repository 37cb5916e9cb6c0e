"""Secret scans: a keyword automaton first, anchored patterns only at its hits, checksums last.

An Aho-Corasick automaton walks each text once, in ASCII lower case, and says where a pattern may begin. Runs
of hexadecimal digits have no keyword of their own, so a second walk goes over the text with each byte
replaced by its class, where 24 class letters in a row are the keyword. Patterns are anchored at the hits, so
text without hits is never matched against them and the work stays linear in the text.

Kinds. Base: assign, access and hex, by the fixed patterns below. Added: ``github`` and ``npm`` tokens, whose
last six characters are the base-62 CRC-32 of the rest and must agree; ``jwt``, whose header must decode to a
JSON object with "alg"; ``pem``, a private key block. Spans count code points, end exclusive, and are in
order of start, then kind. A null text is empty. Repeated rows give the same spans each.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
# The base patterns.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]++")
JWT_RUN = re.compile(rb"eyJ[A-Za-z0-9_-]*+")
PEM = re.compile(rb"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----(?:\s*+[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\n])*+\n)*+[A-Za-z0-9+/=\s]{16,}+-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}
MARK = b"[SECRET]"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASSES = bytes(0x68 if x in b"0123456789abcdef" else 0x2E for x in range(256))


@lru_cache(1)
def automata() -> tuple:
    import ahocorasick

    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (kind, len(word)))
    runs.add_word("h" * MIN_HEX, MIN_HEX)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def checksum(body: bytes) -> bytes:
    """CRC-32 in base 62, six digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.encode()


def _is_jwt(found: bytes) -> bool:
    head = found.split(b".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def valid(kind: str, m: re.Match) -> bool:
    found = m[0]
    if kind == "assign":
        return len(m[1]) >= MIN_ASSIGN
    if kind == "access":
        return len(found) >= MIN_ACCESS
    if kind in ("github", "npm"):
        return checksum(found[4:-6]) == found[-6:]
    return _is_jwt(found) if kind == "jwt" else True


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM}


def spans_of_bytes(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind."""
    words, runs = automata()
    out, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in words.iter(raw.lower().decode("latin-1")):
        at = last - size + 1
        if at >= ends[kind] and (m := _PATTERNS[kind].match(raw, at)):
            ends[kind] = m.end()
            if valid(kind, m):
                out.append((at, m.end(), kind))
        elif kind == "jwt" and at >= ends[kind] and (m := JWT_RUN.match(raw, at)):
            ends[kind] = m.end()  # later hits in this run would fail at the same place; without this, time is quadratic
    for last, size in runs.iter(raw.translate(_HEX_CLASSES).decode("latin-1")):
        if (at := last - size + 1) >= ends["hex"]:
            ends["hex"] = HEX.match(raw, at).end()
            out.append((at, ends["hex"], "hex"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    raw = text.encode()
    found = spans_of_bytes(raw)
    if not found or len(raw) == len(text):
        return [(k, a, b) for a, b, k in found]
    place, at, count = {}, 0, 0
    for p in sorted({p for a, b, _ in found for p in (a, b)}):
        count += len(raw[at:p].decode())
        place[p], at = count, p
    return [(k, place[a], place[b]) for a, b, k in found]


def redacted(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by MARK."""
    raw, out, at = text.encode(), [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans_of_bytes(raw):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [raw[at:a], MARK]
        at = b
    return b"".join([*out, raw[at:]]).decode() if merged else text


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans."""
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kinds))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>",
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs, its column text redacted; all other columns and all rows stay. A null text stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else redacted(t) for x in texts], pa.string())

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
