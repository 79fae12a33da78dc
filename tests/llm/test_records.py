import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import pyarrow as pa
from clustervitals.llm import checksum, queries, records, token_ids

PATH = queries.tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain_crc32c(raw):
    c = 0xFFFFFFFF
    for byte in raw:
        c ^= byte
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def library_ids(text, end_id=0):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])


def test_checksums_equal_the_definition():
    assert checksum.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts = np.array([0, 0, 5, 100, 64, 0, 7, 2999, 3000])
    ends = np.array([0, 1, 69, 165, 128, 3000, 1031, 3000, 3000])
    found = checksum.crc32c(data, starts, ends)
    assert found.tolist() == [plain_crc32c(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert checksum.crc32c(data, starts[:0], ends[:0]).tolist() == []
    assert len(set(checksum.masked(found).tolist())) == len(set(found.tolist()))


TEXTS = st.text(st.sampled_from("abZé's.,:!?  \n\n\t\r\x1f\x85 　 中1²_<|>ß-😀"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=30)), max_size=6))
def test_words_of_a_slice_give_the_ids_of_the_library(texts):
    ids, bounds = token_ids.encode_slice(pa.array(texts, pa.string()), PATH, None)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library_ids(t, None) for t in texts]


ODD = [
    (None, "no key"), (None, None), (7, None), (3, ""), (5, "the end<|endoftext|> and more"), (-4, " a  b \n\n c"), (9, "x" * 70000 + " y"),
    (12, "same"), (12, "same"), (12, "other"), (11, "it's we'll 　'd  '"), (40, "word, " * 50000),
]


def written(spark, tmp_path, rows, at_once=True):
    docs = records.in_key_order(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, tokens string"))
    if at_once:
        records.write_texts(docs, str(tmp_path / "out"), PATH, end_id=0)
    else:
        records.write_records(token_ids.token_ids(docs, PATH, end_id=0), str(tmp_path / "out"))
    return str(tmp_path / "out")


@pytest.mark.parametrize("at_once", [True, False])
def test_round_trip_in_key_order(spark, tmp_path, at_once):
    path = written(spark, tmp_path, ODD, at_once)
    found = sorted(records.read_records(spark, path).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(len(ODD)))
    keys = [r.key for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    for r in found:
        assert r.start == start and r.n_tokens * 4 == len(r.tokens)
        start += r.n_tokens
    made = sorted((str(r.key), np.frombuffer(r.tokens, "<u4").tolist()) for r in found)
    assert made == sorted((str(k), library_ids(t)) for k, t in ODD)


def test_shuffled_reads_hold_every_record_once(spark, tmp_path):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    records.write_records(token_ids.token_ids(records.in_key_order(docs), PATH, end_id=0), str(tmp_path / "out"))
    plain = [tuple(r) for r in records.read_records(spark, str(tmp_path / "out")).collect()]
    first, again, other = ([tuple(r) for r in records.read_records(spark, str(tmp_path / "out"), s).collect()] for s in (1, 1, 2))
    assert sorted(first) == sorted(other) == sorted(plain) and first == again
    assert first != other and first != plain
    for n in (1, 2, 3, 17, 1000, 5000):
        assert sorted(records.shuffled_place(np.arange(n), n, 5).tolist()) == list(range(n))


def test_empty_tables_and_appending(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert records.read_records(spark, path).collect() == [] == records.read_records(spark, path, 3).collect()
    more = spark.createDataFrame([(2, b"\x01\x00\x00\x00\xff\xff\x01\x00"), (1, b"")], "doc_id long, tokens binary").coalesce(1)
    records.write_records(more, path, mode="append")
    records.write_records(more, path, mode="append")
    found = records.read_records(spark, path).collect()
    assert [(r.key, r.position, r.start, r.n_tokens) for r in found] == [(2, 0, 0, 2), (1, 1, 2, 0), (2, 2, 2, 2), (1, 3, 4, 0)]
    # An id of more than 16 bits makes its own record wide, no other.
    assert np.frombuffer(found[0].tokens, "<u4").tolist() == [1, 131071]


def test_every_changed_byte_is_found():
    raw, offsets = records.frame([5, None, 6], np.array([1, 2, 70000, 3], np.uint32), np.array([0, 3, 3, 4]))
    keys, ids = records.unframe(raw, offsets)
    assert keys == [5, None, 6] and [np.frombuffer(x, "<u4").tolist() for x in ids] == [[1, 2, 70000], [], [3]]
    for at in range(len(raw)):
        broken = bytearray(raw)
        broken[at] ^= 0x10
        with pytest.raises(records.CorruptRecord):
            records.unframe(bytes(broken), offsets)
    with pytest.raises(records.CorruptRecord):
        records.unframe(raw[:-1], offsets)


def test_broken_files_are_reported(spark, tmp_path):
    path = written(spark, tmp_path, [(1, "some words here")])
    file = next((tmp_path / "out").glob("*.records"))
    raw = bytearray(file.read_bytes())
    raw[30] ^= 1
    file.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="checksum of record 0"):
        records.read_records(spark, path).collect()


def test_query_equals_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = sorted(queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    expected, start = [], 0
    for r in docs:
        ids = np.array(library_ids(r.text), "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = queries.QUERIES["op11_token_records"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == expected
