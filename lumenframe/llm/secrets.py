"""Secret scan: base patterns plus sliding-window Shannon entropy.

Base kinds are ``assign`` (a value given to a password-like name), ``access`` (access key
ids) and ``hex`` (long lower-case hex runs). Further candidates are maximal runs of
token characters of at least ``WINDOW`` characters. Over such a run a window of
``WINDOW`` characters slides; the counts of its characters and of its character kinds, and
the entropy with them, are updated by the character that leaves and the one that enters.
The kinds in the window, not in the run, give its class (``window_class``), and each class
has a threshold of its own. Neighbouring windows that reach it join to one span of kind
``entropy``. Entropy spans only add: they never remove or change base spans, and what lies
inside a base span is not reported again.

Allow-list: UUIDs, and the placeholder words of ``ALLOWED_PARTS``. It suppresses the
windows that overlap a listed stretch and no others, and entropy spans only.

Defined results: null and empty texts have no spans; offsets are code points, end
exclusive; rows that repeat an id are scanned each on its own; columns besides id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import batch

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character that a window must reach, by class; ten digits can have 3.3 at most, sixteen 4, twenty symbols 4.3.
THRESHOLDS = {"digits": 3.1, "hex": 3.3, "single": 3.8, "mixed": 3.9, "letters": 4.05}
#: The most marks (``+/_=-``) in a window; more are a ruler or a path.
MOST_MARKS = 4
ALLOWED = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|example|placeholder|changeme|xxxxxxxx", re.IGNORECASE | re.ASCII)
_KIND = {c: k for k, own in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")) for c in own}

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window_class(kinds: list[int]) -> str | None:
    """The class of a window with so many digits, a-f, other lower-case, A-F, other upper-case letters and marks.

    Words have none: letters of one case alone, or with fewer than three digits.
    """
    digits, low_hex, low, up_hex, up, marks = kinds
    lower, upper = low_hex + low, up_hex + up
    if marks > MOST_MARKS:
        return None
    if not lower and not upper:
        return "digits"
    if lower and upper:
        return "mixed" if digits else "letters"
    if digits < 3:
        return None
    return "single" if low or up else "hex"


def hot_windows(run: str, allowed: list[tuple[int, int]], width: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy reaches the threshold of their class and that overlap no allowed stretch.

    With counts c, entropy is log2(width) - sum(c log2 c) / width; counts change by one character a step.
    """
    gain = [0.0] + [c * log2(c) for c in range(1, width + 2)]
    most = {k: (log2(width) - least) * width + 1e-9 for k, least in THRESHOLDS.items()}
    loosest = max(most.values())
    counts: dict[str, int] = {}
    kinds = [0] * 6
    total, free, out = 0.0, 0, []
    listed = iter([*allowed, (len(run) + width, 0)])
    start, end = next(listed)
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        total += gain[k + 1] - gain[k]
        counts[c] = k + 1
        kinds[_KIND[c]] += 1
        if i >= width:
            gone = run[i - width]
            k = counts[gone]
            total += gain[k - 1] - gain[k]
            counts[gone] = k - 1
            kinds[_KIND[gone]] -= 1
        while start <= i:  # from here on, windows must start behind this stretch
            free = end
            start, end = next(listed)
        a = i - width + 1
        if a >= free and total <= loosest and (kind := window_class(kinds)) and total <= most[kind]:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far base spans go that start up to here
    for m in RUN.finditer(text):
        run = m.group()
        for a, b in hot_windows(run, [x.span() for x in ALLOWED.finditer(run)]):
            a, b = a + m.start(), b + m.start()
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                out.append((a, 3, b))
    return out


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, digests, shown, extra = ([], [], []), [], [], []
        for text in b.column("text"):
            t = text.as_py() or ""
            base = base_spans(t)
            more = entropy_spans(t, base)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(show(base).encode()).hexdigest())
            shown.append(show(sorted(base + more)))
            extra.append(len(more))
        yield batch(_ARROW, doc_id=b.column("doc_id"), n_assign=counts[0], n_access=counts[1], n_hex=counts[2], base_sha256=digests, spans=shown, n_entropy=extra)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the spans found; a narrow pass, nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, SCHEMA)
