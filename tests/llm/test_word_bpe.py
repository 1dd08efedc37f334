import hashlib
import json
import random
import unicodedata

import numpy as np
import pytest

from lumenframe.llm import queries as Q
from lumenframe.llm import word_bpe as B


@pytest.fixture(scope="module")
def path():
    return Q.word_vocabulary_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def own(m, text):
    return [int(i) for x in B._Words(m).of([m.pieces(text)]) for i in np.frombuffer(x, "<u4")]


def brute_merges(m, word):
    """The leftmost pair of the lowest rank, found anew before each merge."""
    raw = word.encode()
    s = [int(m.inner[b]) for b in raw[:-1]] + [int(m.last[raw[-1]])]
    while len(s) > 1:
        ranks = m.ranks(np.array(s[:-1]), np.array(s[1:]))
        i = int(ranks.argmin())
        if ranks[i] >= B._NONE:
            break
        s[i : i + 2] = [int(m.merged[ranks[i]])]
    return s


def test_every_character_is_cut_as_the_library_cuts_it(path, library):
    m = B.model(path)
    kind = [unicodedata.category(chr(c)) for c in range(0x110000)]  # of unassigned ones, which the library cuts, some will do
    text = [f"a{chr(c)}b{chr(c)}{chr(c)} 1{chr(c)}" for c, k in enumerate(kind) if k != "Cs" and (k not in ("Cn", "Co") or c % 31 == 0)]
    differ = []
    for k in range(0, len(text), 4096):
        part = text[k : k + 4096]
        packed = B._Words(m).of([m.pieces(t) for t in part])
        for t, x, e in zip(part, packed, library.encode_batch(part, add_special_tokens=False), strict=True):
            if np.frombuffer(x, "<u4").tolist() != e.ids:
                differ.append(t)
    assert differ == []


def test_random_texts(path, library):
    m, r = B.model(path), random.Random(8)
    parts = ["Hello", "world", "'s", "'LL", "don't", " ", "  ", "\n", "é", "é", "Å", "ΑΣ", "Σ", "İ", "ǅ", "日本語", "😀", "\x85", "\x1c", " ", "\x00", "12", "½", "…!!", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "▁", "antidisestablishmentarianism", "ﬁ", "ß", "한국어", "ѣ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own(m, t) == e.ids, t
        assert m.decode(np.array(e.ids, np.int64)).decode() == library.decode(e.ids, skip_special_tokens=False)


def test_words_of_all_lengths(path, library, monkeypatch):
    m, r = B.model(path), random.Random(3)
    words = ["".join(r.choice("aeinstrlé") for _ in range(n)) for n in [*range(1, 70), 127, 128, 129, 255, 256, 257, 300, 1000]]
    words += ["a" * n for n in (2, 3, 5, 64, 65, 255, 257, 3000)] + ["ab" * 700]
    got = [np.frombuffer(x, "<u4").tolist() for x in m.encode_words(words)]
    assert got == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert got == [brute_merges(m, w) for w in words]
    monkeypatch.setattr(B, "LONG_WORD", 1)  # all words in a tree of their own
    assert got == [np.frombuffer(x, "<u4").tolist() for x in m.encode_words(words)]


def test_forgetting_words_changes_nothing(path, monkeypatch):
    m = B.model(path)
    texts = [[f"word{i}", f"word{i % 7}"] for i in range(50)]
    want = [B._Words(m).of([t])[0] for t in texts]
    monkeypatch.setattr(B, "KNOWN_WORDS", 3)
    seen = B._Words(m)
    assert [seen.of([t])[0] for t in texts] == want and len(seen.ids) <= 6


def test_odd_rows(spark, odd_docs, no_docs, plain, path, library):
    got = B.encode_decode(odd_docs, path)
    rows = sorted(((r.doc_id, r.ids_, r.decoded) for r in got.select("doc_id", B.unpacked(got.ids).alias("ids_"), "decoded").collect()), key=repr)
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in plain]
    assert rows == sorted(((i, ids, library.decode(ids, skip_special_tokens=False)) for (i, _), ids in zip(plain, want, strict=True)), key=repr)
    assert B.encode_decode(no_docs, path).count() == 0


def test_unknown_ids_are_passed_over(path, library):
    ids = [320, 49407, 60_000, 1125]
    assert B.model(path).decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused(tmp_path, path):
    with open(path) as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"decoder": {"type": "ByteLevel"}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="needed"):
            B.WordBpe(str(tmp_path / "v.json"))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table_equals_the_library(spark, library, sf):
    path = f"/root/testdata/sf{sf}"
    docs = [(r.doc_id, r.text or "") for r in Q.table(spark, path, "documents").select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [e.ids for e in library.encode_batch([t for _, t in docs], add_special_tokens=False)]
    want = sorted((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(docs, ids, strict=True))
    assert sorted(tuple(r) for r in Q.op11_word_bpe(spark, path).collect()) == want
