"""Operator 3: secret scans by sliding-window entropy, beside fixed base patterns.

Candidate strings are runs of token characters. Within a candidate, every run of one character
class (hex, letters and digits, base64) slides a window along; the window's Shannon entropy
follows from counts that change by one character in and one out. Windows above the class's
bound join into spans, unless an allow-list knows the string as harmless.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which ties are listed; the least length counts for the last group.
BASE = (
    ("assign", re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Character classes by name: characters, and the bits that a window must exceed. A window of 20 has at most 4.32.
CLASSES = (
    ("hex_entropy", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("alnum_entropy", re.compile(r"[0-9A-Za-z]+"), 3.75),
    ("base64_entropy", re.compile(r"[0-9A-Za-z+/=_-]+"), 3.9),
)
_CANDIDATE = re.compile(r"[0-9A-Za-z+/=_-]{20,}")
#: Strings that look random and are not secrets: identifiers, placeholders, paths of words, numbers.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z/=_+-]+"),
    re.compile(r"[0-9/=_+-]+"),
    re.compile(r"(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,4}))*[/=_+-]*"),
    re.compile(r"(?i).*(?:example|sample|placeholder|changeme|your[-_]).*"),
)
_ORDER = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(c[0] for c in CLASSES)])}


def windows_above(text: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined (start, end) of all windows whose Shannon entropy exceeds ``bits``; counts change by one in and one out."""
    if len(text) < window:
        return
    counts: dict[str, int] = {}
    weight = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    total, start, end = 0.0, -1, -1
    for i, c in enumerate(text):
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            total += weight[n - 1] - weight[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += weight[n + 1] - weight[n]
        counts[c] = n + 1
        if i >= window - 1 and math.log2(window) - total / window > bits + 1e-9:
            if i - window + 1 > end:
                if end > 0:
                    yield start, end
                start = i - window + 1
            end = i + 1
    if end > 0:
        yield start, end


def scan(text: str, window: int = 20) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, entropy spans) as (start, end, kind) in code points, end exclusive, each sorted.

    An entropy span that touches a base span, or one of an earlier class, is left out.
    """
    base = []
    for kind, pattern, group, least in BASE:
        base += [(*m.span(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    base.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    more: list[tuple[int, int, str]] = []
    for m in _CANDIDATE.finditer(text):
        word, at = m[0], m.start()
        if any(p.fullmatch(word) for p in ALLOWED):
            continue
        taken = [(a, b) for a, b, _ in base if a < m.end() and b > at]
        for kind, pattern, bits in CLASSES:
            for run in pattern.finditer(word):
                if any(p.fullmatch(run[0]) for p in ALLOWED):
                    continue
                for a, b in windows_above(run[0], window, bits):
                    span = at + run.start() + a, at + run.start() + b
                    if all(b <= span[0] or a >= span[1] for a, b in taken):
                        taken.append(span)
                        more.append((*span, kind))
    more.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    return base, more


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]])))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Secrets of every whole text: the id, the base counts and digest, all spans as text, and what they cover.

    Rows: id, n_assign, n_access, n_hex, n_entropy (long), base_sha256, spans, values
    (array<string>, the spans' texts in order). One row for each row of ``docs``: null text counts
    as empty and has no spans; repeated rows repeat; null ids stay null. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [scan(x, window) for x in texts]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k, *_ in BASE]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([len(more) for _, more in found], pa.int64()),
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([written(base + more) for base, more in found], pa.string()),
                    pa.array([[t[a:b] for a, b, _ in sorted(base + more, key=lambda s: (s[0], _ORDER[s[2]]))] for t, (base, more) in zip(texts, found, strict=True)], pa.list_(pa.string())),
                ],
                [id_col, "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "values"],
            )

    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string, values array<string>"
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
