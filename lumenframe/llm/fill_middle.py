"""Fill-in-middle transformation of whole Arrow batches.

A text is cut into units at the places that a table of byte classes and a mask of adjacent
classes name: lines (a line feed ends one), words (white space belongs to the word behind
it) or characters. One running sum over a chunk's unit starts, from which each document's
own beginning is taken off, numbers the units of all documents; one ``searchsorted`` over
it finds both cuts of every row. The parts are then put in order behind their marks:

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
- ``plain``: the text as it is.

Draws are digests of a seed and the row's id, so they do not depend on partitioning or
retries: the prefix ends after the smaller of two draws from 0 to n units, the middle after the
larger; a third says whether the text is transformed at all, a fourth in which form.
``restored`` gives the exact text back from output and form.

Defined results: null counts as empty; an empty text, or one with a mark in it, stays
plain; a null id draws as the empty id, rows that repeat an id draw alike, each with its own
text; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import chunks

MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

#: Byte classes: bytes inside a character, line feeds, other white space, all else.
INSIDE, FEED, BLANK, OTHER = range(4)


def byte_classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[0x80:0xC0] = INSIDE
    t[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
    t[0x0A] = FEED
    return t


CLASSES = byte_classes()


def _pairs(starts: Callable[[int, int], bool]) -> np.ndarray:
    """The mask over 4 * class + next class: whether a unit starts between two bytes of these classes."""
    return np.array([starts(a, b) for a in range(4) for b in range(4)])


UNITS = {
    "line": _pairs(lambda a, b: a == FEED),
    "word": _pairs(lambda a, b: a in (INSIDE, OTHER) and b in (FEED, BLANK)),
    "char": _pairs(lambda a, b: b != INSIDE),
}


def unit_places(buf: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running number of the unit that each byte is in, over the chunk; units before each document; units of each)."""
    kind = CLASSES[buf]
    starts = np.zeros(len(buf), bool)
    starts[1:] = UNITS[unit][kind[:-1] << 2 | kind[1:]]
    starts[off[:-1][off[1:] > off[:-1]]] = True
    place = np.cumsum(starts, dtype=np.int32 if len(buf) < 1 << 31 else np.int64)
    upto = np.concatenate([[0], place])[off].astype(np.int64)
    return place, upto[:-1], np.diff(upto)


def cuts(place: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where, in bytes, the first ``k`` units of each document end: at the start of the next unit, which may be the next document's."""
    return np.searchsorted(place, (before + k + 1).astype(place.dtype))


def _kernel(unit: str, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches):
            place, before, n = unit_places(buf, off, unit)
            draw = [rows.column(c).to_numpy().astype(np.int64) % (n + 1) for c in ("h1", "h2")]
            one, two = cuts(place, before, np.minimum(*draw)), cuts(place, before, np.maximum(*draw))
            del place
            plain, flipped = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("plain", "flipped"))
            chars = np.concatenate([[0], np.cumsum(CLASSES[buf] != INSIDE, dtype=np.int32 if len(buf) < 1 << 31 else np.int64)])
            sizes = [pa.array((chars[b] - chars[a]).astype(np.int64), mask=plain) for a, b in ((off[:-1], one), (one, two))]
            del chars
            view, parts = memoryview(np.ascontiguousarray(buf)), []
            for a, b, c, d, whole, back in zip(off[:-1].tolist(), one.tolist(), two.tolist(), off[1:].tolist(), plain.tolist(), flipped.tolist(), strict=True):
                if whole:
                    parts.append(view[a:d])
                else:
                    parts += (s, view[c:d], p, view[a:b], m, view[b:c]) if back else (p, view[a:b], s, view[c:d], m, view[b:c])
            size = np.diff(off) + np.where(plain, 0, len(p) + len(s) + len(m))
            ends = np.concatenate([[0], np.cumsum(size)])
            text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(parts))])
            form = np.where(plain, "plain", np.where(flipped, "spm", "psm"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(form), *sizes, text.cast(pa.string())], schema=_ARROW)

    return run


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again: the first character of each stands nowhere else in any of them, and no two are equal.

    A mark can then begin neither in the end of another one nor across the border of a mark and a text.
    """
    if len(set(marks)) < 3 or any(not x or any(y[0] in x[1:] for y in marks) for x in marks):
        raise ValueError("marks must differ, and no mark's first character may stand inside a mark")
    return marks


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, flipped: int = 50, seed: str = "7", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text transformed with a chance of ``rate`` in a hundred,
    ``flipped`` in a hundred of these with the suffix first; sizes in code points, null for plain texts. A narrow pass."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    checked_marks(marks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = lambda i: F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")
    marked = F.lit(False)
    for x in marks:
        marked = marked | F.col("text").contains(x)
    plain = (F.col("text") == "") | marked | (h(3) % 100 >= rate)
    return rows.select("doc_id", "text", h(1).alias("h1"), h(2).alias("h2"), plain.alias("plain"), (h(4) % 100 < flipped).alias("flipped")).mapInArrow(_kernel(unit, marks), SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text of an output. A transformed text has no mark in it, so each stands once in the output."""
    p, s, m = marks
    behind = lambda mark, upto: F.substring_index(F.substring_index(output, upto, 1), mark, -1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(behind(p, s), middle, behind(s, m))
    spm = F.concat(behind(p, m), middle, behind(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(out: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))
