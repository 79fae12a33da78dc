import random

import brute
import numpy as np
import pytest
import sentencepiece

from clustervitals.llm import pieces, queries

PATH = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return pieces.Encoder(file.read())


def texts():
    r = random.Random(5)
    mixed = [" ", "a", "h", "t", "e", "s", "\n", "é", "▁", "ß", "0", "1", ".", "你", "😀", "n", "i", "g", "\x00"]
    made = ["".join(r.choices(mixed, k=r.randint(1, 300))) for _ in range(400)]
    made += ["".join(r.choices(["the", "th", "ing", "s", " ", "  ", "tion", "a"], k=r.randint(1, 200))) for _ in range(400)]
    odd = ["", " ", "  ", "a ", " ▁ x▁▁y", "\n\n\t", "\x00a\x00", "▁", "a" * 5000, " " * 333 + "x", "thethe" * 500]
    return made + odd + ["<s> </s> <unk> <0x41>", "haha" * 100 + " " * 17 + "ha", "ＡＢ ́퟿", "x" * 100_000 + "你好" * 1000]


def test_equals_library(encoder, library):
    made = texts()
    packed = encoder.encode(made)
    bounds = np.cumsum([0, *(len(x) // 4 for x in packed)])
    data, ends = encoder.decode(np.frombuffer(b"".join(packed), np.int32), bounds)
    for k, text in enumerate(made):
        want = library.encode(text)
        assert np.frombuffer(packed[k], np.int32).tolist() == want
        assert data[ends[k] : ends[k + 1]].tobytes().decode() == library.decode(want)


def test_small_memory_gives_the_same(encoder, library, monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 3)
    for text in texts()[:40]:
        assert np.frombuffer(encoder.encode([text])[0], np.int32).tolist() == library.encode(text)


def test_nulls_clashing_names_and_empty_table(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "a  b", 5), (3, "a  b", 5), (None, "é", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_decode(docs, PATH).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [
        (k, library.encode(t or ""), t or "") for k, t, _ in rows
    ]
    assert pieces.encode_decode(docs.limit(0), PATH).collect() == []


def test_registered_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op8_piece_encoding"](spark, sf_dir).collect()}
    for doc, text in docs:
        ids = library.encode(text or "")
        assert got[doc].n_tokens == len(ids) and got[doc].ids_sha256 == brute.sha(",".join(map(str, ids)))
        assert got[doc].decoded_sha256 == brute.sha(library.decode(ids))
