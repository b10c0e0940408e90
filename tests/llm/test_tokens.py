"""SentencePiece codec and token store against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import piece_codec, token_store
from quillon.llm.common import get_bytes, table

ODD = [None, "", " ", "  a", "a  ", "\n\t\r x", "▁a ▁", "日本語 テスト 😀👍", "​﻿", "a" * 5000, "é" * 3000, "x y " * 20_000, "\x00\x01", "<s></s><unk>", "İß"]
ALPHABET = st.text(st.sampled_from(list("abcdehlorstTHE .,\n\té▁日😀0129-  ")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def want(library, text: str | None) -> tuple[int, str, str]:
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_all_documents(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = piece_codec.query(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want(library, texts[r["doc_id"]])


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    own = piece_codec.codec()
    assert own.digest(text) == want(library, text)
    assert own.encode(text) == library.encode(text or "", add_eos=True)
    assert own.decode(own.encode(text)) == library.decode(own.encode(text))


@settings(max_examples=400, deadline=None)
@given(ALPHABET | st.text(max_size=30))
def test_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = text.encode("utf-8", "ignore").decode()
    assert piece_codec.codec().encode(text) == library.encode(text, add_eos=True)


def test_prefix_table_equals_plain_merging(library):
    own, rng = piece_codec.codec(), random.Random(1)
    letters = "aeinorstlhd"
    for _ in range(2000):
        chunk = "▁" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))
        assert own._chunk_ids(chunk) == [own.ids[p] for p in own.merge(chunk)]


def test_encode_and_decode_frames(spark, library):
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(0, None)], "doc_id long, text string")
    encoded = piece_codec.encode(docs)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert got == {k: library.encode(t or "", add_eos=True) for k, t in enumerate(ODD)}
    decoded = {r["doc_id"]: r["text"] for r in piece_codec.decode(encoded).collect()}
    assert decoded == {k: library.decode(ids) for k, ids in got.items()}
    assert piece_codec.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind, ids", [("long", [2**60 + 1, None, 3, 3]), ("string", ["a", None, "b", "b"]), ("decimal(20,0)", [None] * 4)])
def test_identifiers_of_any_kind_pass_untouched(spark, library, kind, ids):
    texts = ["some words", None, "", "x y"]
    docs = spark.createDataFrame(list(zip(ids, texts, texts, [1] * 4, strict=True)), f"doc_id {kind}, text string, ids string, n_tokens int")
    encoded = piece_codec.encode(docs)
    want_rows = sorted(((i, library.encode(t or "", add_eos=True)) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in encoded.collect()), key=repr) == want_rows
    back = piece_codec.decode(encoded).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=repr)
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert piece_codec.decode(nulls).first()["text"] == ""
    assert piece_codec.digests(docs).count() == 4


def test_one_identifier_for_a_third_of_all_rows_fills_several_partitions(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 'same words here', concat('words of ', id)) AS text")
    manifest = token_store.write_tokens(docs)
    files = [token_store.TokenFile(get_bytes(r["path"])).documents()[0] for r in manifest.collect()]
    assert max(f.count(7) for f in files) < 700 and sum(f.count(7) for f in files) == 1001
    rows = token_store.read_tokens(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in docs.collect())


def text_hash(text: str | None) -> int:
    """Spark's xxhash64, by which the texts of one identifier are ordered."""
    return 42 if text is None else int.from_bytes(xxhash.xxh64_digest(text.encode(), 42), "big", signed=True)


def brute_store(rows: list[tuple]) -> list[tuple]:
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_store_query_on_all_documents(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = token_store.query(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=repr) == brute_store(rows)


def test_store_on_odd_texts_and_small_files(spark, monkeypatch):
    rows = [(10 * k % 7, t) for k, t in enumerate(ODD)] + [(None, "a"), (None, None), (-5, "it's THE end's"), (99, "a b c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    monkeypatch.setattr(token_store, "FILE_TOKENS", 50)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 3)
    manifest = token_store.write_tokens(docs)
    got = token_store.read_tokens(manifest).collect()
    assert sorted(map(tuple, got), key=repr) == brute_store(rows)
    assert token_store.read_tokens(token_store.write_tokens(docs.limit(0))).count() == 0


def test_file_answers_without_decoding_all(spark):
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, 5000).astype(np.uint32)
    file = token_store.TokenFile(token_store.token_file(ids, [1, None, 3], np.array([1000, 0, 4000])))
    assert file.tokens().tolist() == ids.tolist()
    assert file.access(np.array([0, 17, 4999])).tolist() == ids[[0, 17, 4999]].tolist()
    for token in (0, 7, 299, 5000):
        assert file.count(token) == int((ids == token).sum()) and file.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert file.count(token, 10, 600) == int((ids[10:600] == token).sum())
    names, lengths = file.documents()
    assert names == [1, None, 3] and lengths.tolist() == [1000, 0, 4000]
    hurt = bytearray(token_store.token_file(ids, [1], np.array([5000])))
    hurt[-100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_store.TokenFile(bytes(hurt)).tokens()
