"""Secret scans: fixed patterns, and Shannon entropy in a sliding window.

Candidates are runs of key-like characters. A window slides over each with its
character counts and sum of n*log2(n) kept up to date, so a step costs the same
at any width; windows of a character class whose entropy reaches the class's
threshold join into a span. An allow-list suppresses what is known to be
harmless. The fixed patterns' spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# --- fixed values: the patterns of the contract ---
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate, and the width of the window over it.
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Character class: (all of the window is in it, least bits a character).
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]+"), 3.0),
    ("alphanumeric", re.compile(r"[0-9A-Za-z]+"), 3.7),
    ("base64", re.compile(r"[0-9A-Za-z+/_=-]+"), 3.9),
)
#: A window holds so many digits, and so many other characters, at least; or it
#: holds so many capital and so many small letters, as joined words do not; or its
#: bits are so many that no words of one case reach them.
MIN_DIGITS, MIN_CASE, LETTER_BITS = 2, 6, 4.0
#: Parts of candidates that are no secrets: UUIDs, and what between two marks holds
#: one of the usual alphabets or is an example. No window reaches into such a part.
UUID = re.compile(r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])")
BETWEEN_MARKS = re.compile(r"[0-9A-Za-z]+")
HARMLESS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "example", "placeholder", "changeme")
_CLASS_OF = {c: k for k in reversed(range(len(CLASSES))) for c in map(chr, range(128)) if CLASSES[k][1].fullmatch(c)}
#: 0 digits, 1 capital letters, 2 small letters, 3 marks.
_SORT_OF = {c: 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in map(chr, range(128))}
_NLOGN = [0.0, *(n * math.log2(n) for n in range(1, 4 * WINDOW))]


def entropy_windows(run: str, width: int = WINDOW) -> list[float]:
    """Bits a character of each window of ``run``, by incremental counts."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= width:
            old = run[i - width]
            m = counts[old]
            total += _NLOGN[m - 1] - _NLOGN[m]
            counts[old] = m - 1
        if i >= width - 1:
            out.append(math.log2(width) - total / width)
    return out


def allowed_parts(run: str) -> Iterable[tuple[int, int]]:
    """Harmless parts of a candidate, in time linear in its length."""
    for m in UUID.finditer(run):
        yield m.span()
    low = run.lower()
    if any(w in low for w in HARMLESS):
        for m in BETWEEN_MARKS.finditer(low):
            if any(w in m[0] for w in HARMLESS):
                yield m.span()


def entropy_spans(text: str) -> Iterable[tuple[int, int]]:
    """Spans of joined windows. Counts of digits, of both cases and of each class
    are kept up to date beside the entropy."""
    needs = [*(bits for _, _, bits in CLASSES), math.inf]
    for m in CANDIDATE.finditer(text):
        run = m[0]
        kinds = [_CLASS_OF[c] for c in run]
        for a, b in allowed_parts(run):
            kinds[a:b] = [len(CLASSES)] * (b - a)
        sorts = [_SORT_OF[c] for c in run]
        held, case = [0] * len(needs), [0] * 4
        for k, t in zip(kinds[: WINDOW - 1], sorts, strict=False):
            held[k] += 1
            case[t] += 1
        found = None
        for i, bits in enumerate(entropy_windows(run)):
            held[kinds[i + WINDOW - 1]] += 1
            case[sorts[i + WINDOW - 1]] += 1
            if i:
                held[kinds[i - 1]] -= 1
                case[sorts[i - 1]] -= 1
            need = needs[3 if held[3] else 2 if held[2] else 1 if held[1] else 0]
            if bits < need:
                continue
            digits, large, small, _ = case
            if digits >= MIN_DIGITS:
                key = WINDOW - digits >= MIN_DIGITS
            else:
                key = bits >= LETTER_BITS or (large >= MIN_CASE and small >= MIN_CASE)
            if key:
                if found and i <= found[1]:
                    found = (found[0], i + WINDOW)
                else:
                    if found:
                        yield m.start() + found[0], m.start() + found[1]
                    found = (i, i + WINDOW)
        if found:
            yield m.start() + found[0], m.start() + found[1]


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind. Code points, end exclusive."""
    base = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    rank = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base.sort(key=rank)
    more = [("entropy", a, b) for a, b in entropy_spans(text) if not any(x <= a and b <= y for _, x, y in base)]
    return base, sorted(base + more, key=rank)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: Column) -> Column:
    """A struct of counts, base_sha256 and spans. Null is the empty text."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = spans_of(t or "")
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return of(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row.

    Null and empty texts have no span; rows that repeat, null ids and extra
    columns make no difference to others. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, a, b in spans_of(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mark``; no row is dropped.

    Null texts stay null. All columns are returned; ``count_col``, if there, is
    the text's new length.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact_text(t, mark))

    cols = docs.columns
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), clean(F.col(text_col)).alias("new"))
    return out.select(
        *(
            F.col("new").alias(c) if c == text_col else F.length("new").cast("long").alias(c) if c == count_col else F.col("row").getField(c).alias(c)
            for c in cols
        )
    )
