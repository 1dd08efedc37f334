import hashlib
import random

import pytest

from lumenframe.llm import sentencepiece_bpe as S


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)


def test_agenda_equals_the_library(path, library):
    r = random.Random(4)
    parts = [" ", "▁", "  ", "a", "the", "ing", "\n", "é", "日", "😀", "<", "s", ">", "1", ".", "\t", "\x00", "AKIA", "</s>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "▁", "a" * 700, "日本" * 400, " " * 50, "<s> </s> <unk> <0x0A>", "x" * 255 + "y" * 3, "﻿a"]
    assert S.encode(texts, path) == [library.encode(t, add_eos=True) for t in texts]


def test_odd_rows(spark, odd_docs, no_docs, plain, path, library):
    got = S.encode_decode(odd_docs, path).collect()
    assert S.encode_decode(no_docs, path).count() == 0
    assert all(r.agrees for r in got)
    want = []
    for i, t in plain:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)


def test_whole_table(spark, data, path, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.encode_decode(docs, path).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_eos=True)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_other_vocabularies_are_refused(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        S.BpeModel(str(tmp_path / "m"))


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_are_told_apart_by_their_bytes(spark, path, library, n):
    texts = thue_morse(n)
    got = {r.doc_id: r for r in S.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) and got[i].agrees


def test_forgetting_words_changes_nothing(spark, data, path, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toArrow().to_batches()
    whole = [b.to_pylist() for b in S._encoder(path)(iter(docs))]
    monkeypatch.setattr(S, "KNOWN_BYTES", 1000)
    monkeypatch.setattr(S, "CHUNK", 1 << 14)
    parts = [r for b in S._encoder(path)(iter(docs)) for r in b.to_pylist()]
    assert parts == [r for x in whole for r in x] and all(r["agrees"] for r in parts)
