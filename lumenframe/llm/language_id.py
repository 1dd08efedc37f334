"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1 in ``DIM`` dimensions. A trigram is the
product of its letters' vectors, each permuted (rolled) by its place; the vectors of a
text's trigrams are bundled by addition, and so are those of a language's training texts,
to its prototype. A text belongs to the language whose prototype has the largest cosine
with it; the score is the softmax of the cosines at ``TEMPERATURE``.

Letters are lower-cased; a-z have classes of their own, all other letters share
``OTHERS`` classes by code point, and every run of other characters is one gap.

Training bundles the labelled rows that ``train`` selects, each text with the same total
weight, on the executors: a task sends one vector of ``DIM`` sums for each language, and so
many reach the driver, 4 KB a language, whatever the number of rows. No label, source or id
enters a prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0; if
nothing was learned every text is ``und``; ties go to the language that sorts first; rows
that repeat an id are judged each on its own; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import batch, chunks

DIM = 512
OTHERS = 37
CLASSES = 1 + 26 + OTHERS  # the gap, a-z, the rest
GRAMS = CLASSES**3
TEMPERATURE = 0.05
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _classes() -> np.ndarray:
    """Letter class of every code point: 0 for what is no letter."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x32400):  # no letters are assigned above
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            t[c] = low - 96 if 97 <= low <= 122 else 27 + low % OTHERS
    return t


_TABLE: list[np.ndarray] = []


def letter_vectors(dim: int = DIM, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dim))


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram numbers: the letters' vectors, permuted by place, multiplied."""
    a, b, c = grams // CLASSES**2, grams // CLASSES % CLASSES, grams % CLASSES
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram number, document) of every trigram with a letter in its middle, and the number of letters per document."""
    if not _TABLE:
        _TABLE.append(_classes())
    lead = (buf & 0xC0) != 0x80  # bytes that begin a character
    chars = np.concatenate([[0], np.cumsum(lead)])[off]
    code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    cls = _TABLE[0][code].astype(np.int32)
    n = len(cls)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(chars))
    letters = np.bincount(doc[cls > 0], minlength=len(off) - 1)
    before, after = np.zeros(n, np.int32), np.zeros(n, np.int32)
    before[1:] = np.where(doc[1:] == doc[:-1], cls[:-1], 0)
    after[:-1] = np.where(doc[1:] == doc[:-1], cls[1:], 0)
    mid = cls > 0
    return (before[mid] * CLASSES + cls[mid]) * CLASSES + after[mid], doc[mid], letters


def _bundle(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of the bound vectors of a task's texts, by language."""
        letters = letter_vectors(dim)
        total: dict[str, np.ndarray] = {}
        for rows, buf, off in chunks(batches):
            grams, doc, count = trigrams(buf, off)
            share = 1.0 / np.maximum(count, 1)
            langs, number = np.unique(np.array(rows.column("lang").to_pylist(), object), return_inverse=True)
            for k, lang in enumerate(langs.tolist()):
                own = np.flatnonzero((number == k)[doc])
                seen, place = np.unique(grams[own], return_inverse=True)
                weight = np.bincount(place, share[doc[own]], len(seen))
                v = total.setdefault(lang, np.zeros(dim))
                for x in range(0, len(seen), 8192):
                    v += weight[x : x + 8192] @ gram_vectors(seen[x : x + 8192], letters)
        if total:
            yield _vector_rows(total)

    return run


def _vector_rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each language; rows come sorted by language, so one sum is held."""
    lang, v = None, None
    for b in batches:
        for name, raw in zip(b.column("lang").to_pylist(), b.column("sums").to_pylist(), strict=True):
            if name != lang and v is not None:
                yield _vector_rows({lang: v})
                v = None
            x = np.frombuffer(raw, np.float64)
            lang, v = name, x.copy() if v is None else v + x
    if v is not None:
        yield _vector_rows({lang: v})


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit prototype per language from all rows with a language."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = rows.mapInArrow(_bundle(dim), "lang string, sums binary").repartition("lang").sortWithinPartitions("lang", "sums")
    out = {}
    for lang, raw in sorted(sums.mapInArrow(_add_up, "lang string, sums binary").toLocalIterator()):
        v = np.frombuffer(raw, np.float64)
        if (size := np.linalg.norm(v)) > 0:
            out[lang] = (v / size).astype(np.float32)
    return out


def judge(prototypes: dict[str, np.ndarray], buf: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of every document of a chunk."""
    names = sorted(prototypes)
    n = len(off) - 1
    grams, doc, count = trigrams(buf, off)
    pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
    if not names or not len(grams):
        return pred, score
    proto = np.array([prototypes[x] for x in names], np.float32)
    seen = np.flatnonzero(np.bincount(grams, minlength=GRAMS))
    place = np.zeros(GRAMS, np.int64)
    place[seen] = np.arange(len(seen))
    vectors = gram_vectors(seen, letters).astype(np.float32)
    for a in range(0, n, 256):  # so many documents' counts at a time
        b = min(n, a + 256)
        x, y = np.searchsorted(doc, [a, b])
        counts = np.bincount((doc[x:y] - a) * len(seen) + place[grams[x:y]], minlength=(b - a) * len(seen)).reshape(b - a, -1).astype(np.float32)
        v = counts @ vectors
        cos = (v @ proto.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        best = cos.argmax(axis=1)
        p = 1 / np.exp((cos - cos.max(axis=1, keepdims=True)) / TEMPERATURE).sum(axis=1)
        some = count[a:b] > 0
        pred[a:b][some] = np.array(names, object)[best][some]
        score[a:b][some] = p[some]
    return pred, score


def _predictor(prototypes: dict[str, np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(dim)
        for rows, buf, off in chunks(batches):
            pred, score = judge(prototypes, buf, off, letters)
            yield batch(_ARROW, doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), lang_pred=pred.tolist(), score=score)

    return run


def _keeper(prototypes: dict[str, np.ndarray], least: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors(dim)
        for rows, buf, off in chunks(batches):
            pred, score = judge(prototypes, buf, off, letters)
            yield rows.filter(pa.array((pred != UNKNOWN) & (score >= least)))

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """Language and score of every row; a narrow pass, nothing is shuffled. The prototypes are a few KB a language."""
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_predictor(prototypes, dim), SCHEMA)


def fold(id_col: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose fold of five is not 0 and predict all rows."""
    held = fold() == 0
    return predict(docs, train(docs.where(~held)), held)


def known_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows with a language and at least that score, with the columns they came with.

    Every row is judged by its own text, also where rows share an id; rows pass through whole, so nothing is joined.
    """
    prototypes = train(docs.where(fold() != 0))
    return docs.mapInArrow(_keeper(prototypes, least, DIM), docs.schema)
