"""Secret scan with multipart credential linking.

Certain kinds are found by their own form. Weak kinds (key-shaped text, key ids, endpoints)
say nothing alone: a weak candidate is reported only when an interval join puts the parts
that complete it into the same scope.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters around a candidate in which its other parts must lie.
SCOPE = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts: identifiers, key-shaped words and places to use them.
_KEY_ID = re.compile(r"""(?:client_?id|access_?key(?:_?id)?|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|ftp)://[^\s\"'<>]+", re.ASCII)
_KEY_LIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")

KINDS = ("assign", "access", "hex", "linked_id", "linked_key", "linked_endpoint")
Span = tuple[int, int, str]
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[Span]:
    """Certain finds, each kind leftmost and without overlaps; ends are exclusive code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def weak_parts(text: str) -> list[Span]:
    """Candidates that count only together: key ids, key-shaped words, endpoints."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "linked_id") for m in _KEY_ID.finditer(text)]
    if "://" in text:
        found += [(m.start(), m.end(), "linked_endpoint") for m in _ENDPOINT.finditer(text)]
    for w in _WORD.finditer(text):
        found += [(m.start(), m.end(), "linked_key") for m in _KEY_LIKE.finditer(text, w.start(), w.end()) if len(set(m[0])) >= 10]
    return found


class _Near:
    """An interval join of one text's parts with one role: sorted starts with their running largest ends."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [s for s, _, _ in self.spans]
        self.ends, most = [], -1
        for _, e, _ in self.spans:
            most = max(most, e)
            self.ends.append(most)

    def within(self, start: int, end: int, scope: int) -> bool:
        """Does one of the spans come within `scope` characters of [start, end)?"""
        i = bisect_left(self.starts, end + scope + 1)
        return i > 0 and self.ends[i - 1] >= start - scope


def linked(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak candidates whose complementary parts lie in their scope.

    A key-shaped word needs an identifier (an access id or a key id). A key id needs a
    secret (an assignment or a key-shaped word). An endpoint needs both.
    """
    if not weak:
        return []
    ids = _Near([s for s in base if s[2] == "access"] + [s for s in weak if s[2] == "linked_id"])
    keys = _Near([s for s in base if s[2] in ("assign", "hex")] + [s for s in weak if s[2] == "linked_key"])
    needs = {"linked_id": (keys,), "linked_key": (ids,), "linked_endpoint": (ids, keys)}
    covered = _Near(base)
    return [s for s in weak if not covered.within(s[0], s[1], -1) and all(n.within(s[0], s[1], scope) for n in needs[s[2]])]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones joined, replaced by [SECRET]."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _clean(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else redacted(t, ordered((base := base_spans(t)) + linked(base, weak_parts(t)))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of every text replaced by [SECRET]; null texts stay null."""
    return docs.withColumn(text_col, _clean(F.col(text_col)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Each row is scanned whole and by itself, so nothing is shuffled and repeated rows or
    null ids change nothing. A null text counts as empty. The three counts are of the
    certain kinds; spans lists all, linked ones included, as kind:start:end by start, then
    kind. base_sha256 is of the same list without the linked ones. Extra columns are ignored.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names[1:]]
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = ordered(base + linked(base, weak_parts(text), scope))
                certain = ordered(base)
                count = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                for to, x in zip(rows, [*count, sha256(as_text(certain).encode()).hexdigest(), as_text(spans)], strict=True):
                    to.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * (len(names) - 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows, kinds)], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, schema)
