"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps the agenda of the library: all adjacent symbol pairs whose
concatenation is a piece, ordered by score, then from left to right; the best pair is
merged and its neighbours enter the agenda, until none is left. No piece has the space
mark anywhere but at its start (``BpeModel`` checks this), and many ASCII characters stand
side by side in no piece, so texts fall into words that nothing merges across, and a task
encodes each distinct word once (it remembers ``KNOWN_BYTES`` of them). Words are told
apart by their bytes. The agendas of new words advance together, one merge per word and
round, in arrays; very long words have a heap.

Every distinct word is also encoded by the sentencepiece library, and every document's ids
are decoded by the library's ``decode``, which gives the decoded text. ``agrees`` says
whether the ids of all its words and the operator's own decoding equal the library's; the
operator's ids stand in any case.

Defined results: null counts as empty; an empty text has the end id alone; unknown
characters become their UTF-8 bytes as byte pieces; texts that repeat, and rows that
repeat an id, are encoded each on its own; columns besides id and text are ignored,
whatever their names. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import batch, chunks

SPACE = "▁"
CHUNK = 4 << 20
#: Words of more characters have a heap of their own; so many shorter ones advance together.
LONG_WORD, TOGETHER = 256, 65_536
KNOWN_BYTES = 8 << 20
_BIG = np.int64(1) << np.int64(62)

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())])


class BpeModel:
    """Pieces, scores and the pair table of a merge-type vocabulary."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a merge-type vocabulary with identity normalisation and a space before the text is needed")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(SPACE in p.strip(SPACE) or p.lstrip(SPACE).endswith(SPACE) for p in normal if p.strip(SPACE)):
            raise ValueError("a piece has the space mark after its start")
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.n = len(proto.pieces)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        # single characters that are no piece themselves get numbers above the ids
        extra = sorted({c for p in normal for c in p} - set(normal))
        number = {p: i for p, (i, _) in normal.items()} | {c: self.n + k for k, c in enumerate(extra)}
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        order = sorted({s for _, s in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        left, right, merged, ranks = [], [], [], []
        for p, (i, s) in normal.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i), ranks.append(rank[s])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        # an open-addressing table: a lookup costs a multiplication and a few probes
        self.bits = int(np.ceil(np.log2(4 * max(1, len(keys)))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.merged, self.rank = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int64)
        self.probes = 1
        for k, m, r in zip(keys.tolist(), merged, ranks, strict=True):
            at, n = self._slot(np.array([k], np.int64)).item(), 1
            while self.key[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.key[at], self.merged[at], self.rank[at], self.probes = k, m, r, max(self.probes, n)
        self.library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # the library for single words: it must not put a space before each
        norm.add_dummy_prefix = False
        self.words = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # pairs of bytes, by 256 * first + second, that are ASCII and side by side in no piece
        self.apart = np.zeros(1 << 16, bool)
        self.apart.reshape(256, 256)[:128, :128] = True
        for p in normal:
            raw = p.replace(SPACE, " ")
            for x, y in zip(raw, raw[1:]):
                if ord(x) < 128 and ord(y) < 128:
                    self.apart[ord(x) << 8 | ord(y)] = False
        self.shown = [b"%d " % i for i in range(self.n)]
        self.surface = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of adjacent symbols; rank -1 where the pair is no piece. Unknown symbols never merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        ids = np.zeros(len(keys), np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            k = self.key[at[todo]]
            hit = k == keys[todo]
            h = todo[hit]
            out[h], ids[h] = self.rank[at[h]], self.merged[at[h]]
            todo = todo[~hit & (k >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out, ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and where each word's ids start (one more entry than words)."""
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 0x20] = ord(SPACE)
        sym = self.chars[code]
        alive = np.ones(len(sym), bool)  # symbols that no merge has swallowed
        lo = 1
        for hi in (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, LONG_WORD):
            own = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(own), TOGETHER):
                self._merge_together(sym, alive, start[own[k : k + TOGETHER]], size[own[k : k + TOGETHER]], hi)
            lo = hi
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            self._merge_alone(sym, alive, int(start[w]), int(start[w + 1]))
        ids, code, owner = sym[alive].astype(np.int64), code[alive], np.repeat(np.arange(len(words)), size)[alive]
        odd = np.flatnonzero((ids < 0) | (ids >= self.n))
        if len(odd):  # characters without a piece of their own become byte pieces
            raw = [[self.bytes[b] for b in chr(c).encode()] for c in code[odd].tolist()]
            more = np.ones(len(ids), np.int64)
            more[odd] = [len(x) for x in raw]
            at = np.cumsum(more) - more
            owner, ids = np.repeat(owner, more), np.repeat(ids, more)
            ids[np.repeat(at[odd], more[odd]) + np.arange(more[odd].sum()) - np.repeat(np.cumsum(more[odd]) - more[odd], more[odd])] = [i for x in raw for i in x]
        return ids, np.searchsorted(owner, np.arange(len(words) + 1))

    def _merge_together(self, sym: np.ndarray, alive: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> None:
        """The agendas of many words of at most ``width`` characters, a column each; one merge per word and round."""
        row = np.arange(width)[:, None]
        inside = row < size
        at = np.where(inside, start + row, 0)
        s = np.where(inside, sym[at], -1)
        cost, into = np.full(s.shape, _BIG), np.zeros(s.shape, np.int32)
        rank, ids = self.pair(s[:-1].ravel(), s[1:].ravel())
        cost[:-1] = np.where(rank >= 0, rank << 16, _BIG).reshape(width - 1, -1)
        cost[:-1] |= np.where(cost[:-1] < _BIG, row[:-1], 0)
        into[:-1] = ids.reshape(width - 1, -1)
        nxt, prv = np.repeat(row + 1, s.shape[1], axis=1).astype(np.int32), np.repeat(row - 1, s.shape[1], axis=1).astype(np.int32)
        while True:
            best = np.minimum.reduce(cost, axis=0)
            go = best < _BIG
            if not go.any():
                break
            if go.sum() < 0.7 * len(go):
                s, cost, into, nxt, prv, start, size, best = s[:, go], cost[:, go], into[:, go], nxt[:, go], prv[:, go], start[go], size[go], best[go]
                col = np.arange(len(best))
            else:
                col = np.flatnonzero(go)
                best = best[col]
            i = best & 0xFFFF
            r = nxt[i, col]
            s[i, col] = merged = into[i, col]
            sym[start[col] + i] = merged
            alive[start[col] + r] = False
            cost[r, col] = _BIG
            after = nxt[r, col]
            nxt[i, col] = after
            more = after < size[col]
            prv[after[more], col[more]] = i[more]
            cost[i[~more], col[~more]] = _BIG
            before = prv[i, col]
            some = before >= 0
            left = np.concatenate([i[more], before[some]])
            right = np.concatenate([after[more], i[some]])
            c = np.concatenate([col[more], col[some]])
            rank, ids = self.pair(s[left, c], s[right, c])
            cost[left, c] = np.where(rank >= 0, rank << 16 | left, _BIG)
            into[left, c] = ids

    def _merge_alone(self, sym: np.ndarray, alive: np.ndarray, a: int, b: int) -> None:
        """The agenda of one very long word, in a heap."""
        s, n = sym[a:b].tolist(), b - a
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, ids = self.pair(sym[a : b - 1], sym[a + 1 : b])
        agenda = [(r, i, x, y, m) for i, (r, x, y, m) in enumerate(zip(rank.tolist(), s[:-1], s[1:], ids.tolist(), strict=True)) if r >= 0]
        heapq.heapify(agenda)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        gone = [False] * n
        while agenda:
            _, i, x, y, m = heapq.heappop(agenda)
            j = nxt[i]
            if gone[i] or j >= n or s[i] != x or s[j] != y:
                continue
            s[i], gone[j], nxt[i] = m, True, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right < n:
                    key = (s[left], s[right])
                    if key not in known:
                        r, k = self.pair(np.array(key[:1]), np.array(key[1:]))
                        known[key] = (int(r[0]), int(k[0]))
                    if known[key][0] >= 0:
                        heapq.heappush(agenda, (known[key][0], left, *key, known[key][1]))
        sym[a:b] = s
        alive[a:b] = ~np.array(gone)


_MODELS: dict[str, BpeModel] = {}


def model(path: str) -> BpeModel:
    """One model per Python worker and path."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def _word_starts(m: BpeModel, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets where words start: at a document's start, at the first of each run of spaces or space marks, and
    between two ASCII characters that stand side by side in no piece, so that nothing can merge across."""
    if not len(buf):
        return np.zeros(0, np.int64)
    mark = np.frombuffer(SPACE.encode(), np.uint8)
    blank = buf == 0x20
    if len(buf) > 2:
        at = np.flatnonzero((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2]))
        for k in range(3):
            blank[at + k] = True
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[1:] |= m.apart[buf[:-1].astype(np.uint16) << 8 | buf[1:]]
    start[off[:-1][off[1:] > off[:-1]]] = True
    return np.flatnonzero(start)


def _rows(ids: np.ndarray, bounds: np.ndarray, table: list[bytes]) -> list[bytes]:
    """For each word, the joined table entries of its ids."""
    size = np.array([len(x) for x in table], np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(table), np.uint8)
    n = size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(begin[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
    cut = total[bounds].tolist()
    return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class _Words:
    """Encodings of the words that a task has met. Words are told apart by their bytes."""

    def __init__(self, m: BpeModel):
        self.m, self.known, self.size = m, {}, 0
        self.ids: list[list[int]] = []
        self.shown: list[bytes] = []  # decimal ids, each with a space behind it
        self.plain: list[bytes] = []  # decoded bytes
        self.agrees: list[bool] = []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; new ones are encoded, and compared with the library's ids."""
        new = [w for w in words if w not in self.known]
        if self.size + sum(map(len, new)) > KNOWN_BYTES:
            self.__init__(self.m)
            new = words
        if new:
            texts = [w.decode() for w in new]
            ids, bounds = self.m.encode_words(texts)
            own, cut = ids.tolist(), bounds.tolist()
            lists = [own[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            self.known.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.size += sum(map(len, new))
            self.ids += lists
            self.shown += _rows(ids, bounds, self.m.shown)
            self.plain += _rows(ids, bounds, self.m.surface)
            self.agrees += [x == y for x, y in zip(lists, self.m.words.encode(texts, num_threads=1), strict=True)]
        return np.array([self.known[w] for w in words], np.int64)


def _distinct(starts: np.ndarray, buf: np.ndarray, fresh: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, number of each word among them), by comparison of their bytes. A word at a document's start
    has the space mark that the library puts before a text."""
    offsets = pa.py_buffer(np.append(starts, len(buf)).astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
    key, number = np.unique(coded.indices.to_numpy().astype(np.int64) * 2 + fresh, return_inverse=True)
    words = coded.dictionary.to_pylist()
    return [b" " + words[k >> 1] if k & 1 else words[k >> 1] for k in key.tolist()], number


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        end, seen = str(m.eos).encode(), _Words(m)
        for rows, buf, off in chunks(batches, limit=CHUNK):
            starts = _word_starts(m, buf, off)
            lo = np.searchsorted(starts, off).tolist()
            number: list[int] = []
            if len(starts):
                distinct, place = _distinct(starts, buf, np.isin(starts, off[:-1]))
                number = seen.numbers(distinct)[place].tolist()
            counts, digests, decoded, agrees = [], [], [], []
            for a, b in zip(lo[:-1], lo[1:], strict=True):
                own = number[a:b]
                ids = [*chain.from_iterable([seen.ids[w] for w in own]), m.eos]
                text = m.library.decode(ids).encode()
                plain = b"".join([seen.plain[w] for w in own])[1:]  # without the space that encoding put first
                counts.append(len(ids))
                digests.append(hashlib.sha256(b"".join([seen.shown[w] for w in own]) + end).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
                agrees.append(all([seen.agrees[w] for w in own]) and plain.decode("utf-8", "replace").encode() == text)
            yield batch(_ARROW, doc_id=rows.column("doc_id"), n_tokens=counts, ids_sha256=digests, decoded_sha256=decoded, agrees=agrees)

    return run


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids and of the decoded text per document; a narrow pass, nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encoder(model_path), SCHEMA)


def encode(texts: list[str], model_path: str) -> list[list[int]]:
    """Ids of whole texts, with the end id, by the same agenda; for tests and small inputs."""
    m, out = model(model_path), []
    for t in texts:
        ids, _ = m.encode_words([" " + t]) if t else ([], None)
        out.append([*map(int, ids), m.eos])
    return out
