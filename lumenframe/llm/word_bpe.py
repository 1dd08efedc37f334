"""BPE encoding and decoding for byte-level vocabularies with word ends.

A text is split at the special tokens in it; what lies between is put into composed form and
lower case and cut into words by the vocabulary's own pattern; the bytes of a word are its first
symbols, the last one with the word end. Merging uses a segment tree over the ranks of adjacent
pairs: a leaf holds rank and place of the pair that begins there, an inner node the lesser of its
two, so the root is the leftmost pair of the lowest rank. A merge changes three leaves and the nodes
above them, until the root says that no pair can be merged. The trees of many words
are columns of one array and advance together; a very long word has a tree of its own.
A task encodes each distinct word once and remembers up to ``KNOWN_WORDS`` of them.

Python, the ``regex`` module and the tokenizers library know different editions of Unicode. A text
with a character that Python's edition does not assign is therefore normalised and cut by the
library's own normaliser and word splitter; over all others the three agree (a test goes through all
characters). The merging is the same for both.

The ids are packed as little-endian unsigned 32-bit integers, the form in which token files are
written; ``unpacked`` makes them an array. Decoding joins the tokens by a space, as vocabularies
without a decoder do; ids that the vocabulary does not have are passed over.

Defined results: null counts as empty; an empty text has no ids; rows that repeat an id are
encoded each on its own; columns besides id and text are ignored, whatever their names. The
vocabulary file's path is a parameter; a file of another kind is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import chunks

CHUNK = 4 << 20
#: Words of more bytes have a tree of their own; so many shorter ones advance together.
LONG_WORD, TOGETHER = 256, 16_384
KNOWN_WORDS, KNOWN_BYTES = 200_000, 8 << 20
_NONE = np.int64(1) << np.int64(62)

SCHEMA = "doc_id long, ids binary, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it shows, else the next one from U+0100 on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shows else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Symbols, ranked merges, special tokens and the word pattern of a vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        white = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        # white space separates words whatever its length, so its replacement changes nothing and is left out
        if [s["type"] if s != white else "white" for s in steps] != ["NFC", "white", "Lowercase"]:
            raise ValueError("a vocabulary of composed, lower-cased text is needed")
        if [c["type"] for c in cut] != ["Split", "ByteLevel"] or (cut[0]["behavior"], cut[0]["invert"], cut[1]["use_regex"], cut[1]["add_prefix_space"]) != ("Removed", True, False, False):
            raise ValueError("a vocabulary that keeps the matches of one pattern, as bytes, is needed")
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or spec["decoder"]:
            raise ValueError("a merge-type vocabulary without a prefix and without a decoder is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be taken from the text as it is")
        self.words = regex.compile(cut[0]["pattern"]["Regex"]).findall
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        n = 1 + max([*vocab.values(), *self.specials.values()])
        self.surface = [b""] * n
        self.is_token = np.zeros(n, bool)
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.surface[i], self.is_token[i] = t.encode(), True
        symbols = byte_symbols()
        if any(s not in vocab or s + end not in vocab for s in symbols):
            raise ValueError("a vocabulary with a symbol for every byte is needed")
        self.path, self.byte_of = path, {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable").astype(np.int64)
        self.key = keys[self.rank]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; ``_NONE`` where it cannot be merged."""
        k = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], _NONE)

    @cached_property
    def _known_pairs(self) -> dict[int, int]:
        return dict(zip(self.key.tolist(), self.rank.tolist(), strict=True))

    @cached_property
    def _unassigned(self) -> np.ndarray:
        """For each character, whether Python's edition of Unicode does not assign it."""
        return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not self._unassigned[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.words(self.normal(text))
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in found]

    def normal(self, text: str) -> str:
        """Composed form, then lower case character by character (a sigma does not look at its word)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of the special tokens between them."""
        if self.special is None or not self.special.search(text):
            return self._cut(text)
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.specials[part]] if k % 2 else self._cut(part)
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word; no word is empty."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        code = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[code]
        sym[start[1:] - 1] = self.last[code[start[1:] - 1]]
        alive = np.ones(len(sym), bool)  # symbols that no merge has swallowed
        width = 2
        while width <= LONG_WORD:
            own = np.flatnonzero((size > width // 2) & (size <= width))
            for k in range(0, len(own), TOGETHER):
                self._together(sym, alive, start[own[k : k + TOGETHER]], size[own[k : k + TOGETHER]], width)
            width *= 2
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            self._alone(sym, alive, int(start[w]), int(start[w + 1]))
        packed = sym[alive].astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(alive)])[start]).tolist()
        return [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _together(self, sym: np.ndarray, alive: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> None:
        """Words of at most ``width`` symbols (a power of two), a column each: one merge per word and round."""
        place = np.arange(width)[:, None]
        inside = place < size
        s = np.where(inside, sym[np.where(inside, start + place, 0)], -1)
        tree = np.full((2 * width, len(size)), _NONE)
        rank = self.ranks(s[:-1], s[1:])
        tree[width:-1] = np.where(inside[1:] & (rank < _NONE), rank << 32 | place[:-1], _NONE)
        level = width
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        nxt, prv = np.repeat(place + 1, len(size), axis=1), np.repeat(place - 1, len(size), axis=1)
        while True:
            go = tree[1] < _NONE
            if not go.any():
                return
            if go.sum() < 0.7 * len(go):
                s, tree, nxt, prv, start, size = s[:, go], tree[:, go], nxt[:, go], prv[:, go], start[go], size[go]
                col = np.arange(len(size))
            else:
                col = np.flatnonzero(go)
            root = tree[1, col]
            i = root & 0xFFFFFFFF
            gone = nxt[i, col]
            s[i, col] = sym[start[col] + i] = self.merged[root >> 32]
            alive[start[col] + gone] = False
            after, before = nxt[gone, col], prv[i, col]
            nxt[i, col] = after
            more, some = after < size[col], before >= 0
            prv[after[more], col[more]] = i[more]
            tree[width + gone, col] = _NONE
            tree[width + i, col] = _NONE
            left, c = np.concatenate([i[more], before[some]]), np.concatenate([col[more], col[some]])
            rank = self.ranks(s[left, c], s[np.concatenate([after[more], i[some]]), c])
            tree[width + left, c] = np.where(rank < _NONE, rank << 32 | left, _NONE)
            up, c = width + np.concatenate([gone, i, before[some]]) >> 1, np.concatenate([col, col, col[some]])
            while up[0]:
                tree[up, c] = np.minimum(tree[2 * up, c], tree[2 * up + 1, c])
                up = up >> 1

    def _alone(self, sym: np.ndarray, alive: np.ndarray, a: int, b: int) -> None:
        """One very long word: the same tree in a list; an update stops at the first node that it does not change."""
        s, n, none = sym[a:b].tolist(), b - a, int(_NONE)
        width = 1 << (n - 1).bit_length()
        rank = self.ranks(sym[a : b - 1], sym[a + 1 : b])
        tree = [none] * width + np.where(rank < _NONE, rank << 32 | np.arange(n - 1), _NONE).tolist() + [none] * (width - n + 1)
        for p in range(width - 1, 0, -1):
            tree[p] = min(tree[2 * p], tree[2 * p + 1])
        nxt, prv, known, merged = list(range(1, n + 1)), list(range(-1, n - 1)), self._known_pairs, self.merged.tolist()
        gone = np.zeros(n, bool)

        def put(i: int, value: int) -> None:
            p = width + i
            tree[p] = value
            while p > 1:
                p >>= 1
                low = min(tree[2 * p], tree[2 * p + 1])
                if tree[p] == low:
                    return
                tree[p] = low

        def pair(i: int, j: int) -> int:
            r = known.get(s[i] << 32 | s[j])
            return none if r is None else r << 32 | i

        while tree[1] < none:
            i, r = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            j = nxt[i]
            s[i], gone[j], nxt[i] = merged[r], True, nxt[j]
            put(j, none)
            if nxt[i] < n:
                prv[nxt[i]] = i
                put(i, pair(i, nxt[i]))
            else:
                put(i, none)
            if prv[i] >= 0:
                put(prv[i], pair(prv[i], i))
        sym[a:b] = s
        alive[a:b] = ~gone

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of the ids, joined by a space, in UTF-8."""
        ids = ids[ids < len(self.surface)]
        return b" ".join(map(self.surface.__getitem__, ids[self.is_token[ids]].tolist()))


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """One vocabulary per Python worker and path."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


class _Words:
    """Packed ids of the words that a task has met."""

    def __init__(self, m: WordBpe):
        self.m, self.size = m, 0
        self.ids: dict[str | int, bytes] = {}

    def of(self, texts: list[list[str | int]]) -> list[bytes]:
        """The packed ids of texts given as words; new words are encoded together."""
        if len(self.ids) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self.ids, self.size = {}, 0
        new = set().union(*texts) - self.ids.keys()
        for i in [w for w in new if isinstance(w, int)]:
            self.ids[i] = i.to_bytes(4, "little")
            new.discard(i)
        if new:
            words = list(new)
            self.ids.update(zip(words, self.m.encode_words(words), strict=True))
            self.size += sum(map(len, words))
        return [b"".join(map(self.ids.__getitem__, t)) for t in texts]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        seen = _Words(m)
        for rows, _, _ in chunks(batches, limit=CHUNK):
            packed = seen.of([m.pieces(t) for t in rows.column("text").to_pylist()])
            decoded = pa.array([m.decode(np.frombuffer(x, "<u4")) for x in packed], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(packed, pa.binary()), decoded], schema=_ARROW)

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): packed ids of every whole text, and the text decoded from them; a narrow pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encoder(path), SCHEMA)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""
    low = lambda i, k: F.conv(F.hex(F.substring(ids, 4 * i + k, F.lit(1))), 16, 10).cast("long")
    whole = lambda i: low(i, 1) + 256 * low(i, 2) + 65_536 * low(i, 3) + 16_777_216 * low(i, 4)
    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int")), whole)).when(ids.isNotNull(), F.array().cast("array<bigint>"))


def digests(out: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded texts."""
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
