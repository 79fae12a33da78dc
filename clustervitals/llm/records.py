"""Token sequences in length-delimited binary files, with an offset index for shuffled reads.

A record file holds records one after another:

    length (8 bytes) | masked CRC-32C of the length (4) | data | masked CRC-32C of the data (4)

and its index file one entry per record and one for the end: the record's byte
offset and the number of tokens before it in the file (8 bytes each), followed by
the masked CRC-32C of all entries.  The data of a record are 4 bytes of flags (1:
it has a key, 2: ids take 4 bytes and not 2), 4 bytes of zeros, 8 bytes of key and
the ids.  All numbers are little-endian.  ``manifest.json`` lists the files in
order with their records and tokens; it is written last and names only files of
tasks that ended well, so what a lost executor left behind is never read.

``TokenRecords`` is the Spark data source of such folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources.workspace import location_resolver
from .arrow import slices, utf8
from .checksum import crc32c, masked
from .token_ids import ENCODED_BYTES, encode_slice

FORMAT = "token_records"
MANIFEST = "manifest.json"
SCHEMA = "key long, position long, start long, n_tokens long, tokens binary"
_KEY, _WIDE = 1, 2
_FRAME, _HEADER = 16, 16  # bytes around the data and before the ids
_ENTRY = 16
# Bytes of records read, checked and handed on together; one longer record is read alone.
CHUNK_BYTES = 4 << 20
# Records of a file that one task reads in order, and records that one task reads shuffled.
TASK_RECORDS = 1 << 17
_SHUFFLED_TOGETHER = 1024


class CorruptRecord(ValueError):
    """A checksum or length in a record or index file does not fit."""


# ---- frames


def frame(keys: list[int | None], tokens: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The records of sequences of ids laid one after another, and the n + 1 offsets of the records."""
    sizes = np.diff(bounds)
    wide = np.array([bool(tokens[a:b].max(initial=0) >> 16) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], bool)
    lengths = _HEADER + sizes * np.where(wide, 4, 2)
    offsets = np.append(0, np.cumsum(lengths + _FRAME))
    out = np.zeros(int(offsets[-1]), np.uint8)
    narrow = tokens.astype("<u2")
    for k, key in enumerate(keys):
        at = int(offsets[k])
        ids = (tokens.astype("<u4", copy=False) if wide[k] else narrow)[bounds[k] : bounds[k + 1]]
        out[at : at + 8].view("<u8")[0] = lengths[k]
        out[at + 12] = (_KEY if key is not None else 0) | (_WIDE if wide[k] else 0)
        out[at + 20 : at + 28] = np.frombuffer(np.int64(key or 0).astype("<i8").tobytes(), np.uint8)
        out[at + 28 : at + 28 + ids.nbytes] = ids.view(np.uint8)
    heads = offsets[:-1]
    ends = heads + 12 + lengths
    for at, crc in ((heads + 8, crc32c(out, heads, heads + 8)), (ends, crc32c(out, heads + 12, ends))):
        out[at[:, None] + np.arange(4)] = masked(crc).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), offsets


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(data[at[:, None] + np.arange(np.dtype(kind).itemsize)]).view(kind)[:, 0]


def unframe(raw: bytes, offsets: np.ndarray, where: str = "records") -> tuple[list[int | None], list[bytes]]:
    """Keys and ids (little-endian, 32 bits) of whole records; raises ``CorruptRecord`` if a checksum does not fit."""
    data, heads = np.frombuffer(raw, np.uint8), offsets[:-1]
    if len(data) != offsets[-1] or (np.diff(offsets) < _FRAME + _HEADER).any():
        raise CorruptRecord(f"{where}: records are cut short")
    lengths = _numbers(data, heads, "<u8").astype(np.int64)
    if (lengths != np.diff(offsets) - _FRAME).any():
        raise CorruptRecord(f"{where}: lengths do not fit the index")
    ends = heads + 12 + lengths
    for at, start, end in ((heads + 8, heads, heads + 8), (ends, heads + 12, ends)):
        bad = np.flatnonzero(_numbers(data, at, "<u4") != masked(crc32c(data, start, end)))
        if len(bad):
            raise CorruptRecord(f"{where}: checksum of record {int(bad[0])} of {len(heads)} does not fit")
    flags, keys = data[heads + 12], _numbers(data, heads + 20, "<i8").tolist()
    ids = []
    for start, end, flag in zip((heads + 28).tolist(), ends.tolist(), flags.tolist()):
        body = data[start:end]
        ids.append(body.tobytes() if flag & _WIDE else body.view("<u2").astype("<u4").tobytes())
    return [key if flag & _KEY else None for key, flag in zip(keys, flags.tolist())], ids


def index_bytes(offsets: np.ndarray, starts: np.ndarray) -> bytes:
    entries = np.stack([offsets, starts], axis=1).astype("<u8").tobytes()
    crc = crc32c(np.frombuffer(entries, np.uint8), np.array([0]), np.array([len(entries)]))
    return entries + masked(crc).astype("<u4").tobytes()


# ---- writing


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    file: str
    records: int
    tokens: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, tokenizer: str | None, end_id: int | None):
        self.path, self.overwrite, self.resolve = path, overwrite, location_resolver()
        self.tokenizer, self.end_id = tokenizer, end_id

    def _sequences(self, batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Keys, ids and bounds of the rows, some at a time."""
        if self.tokenizer is not None:
            for part in slices(batch, "text", ENCODED_BYTES):
                yield part.column("key").to_pylist(), *encode_slice(part.column("text"), self.tokenizer, self.end_id)
            return
        data, bounds = utf8(batch.column("tokens"))
        for a, b in _runs(np.diff(bounds), CHUNK_BYTES):
            ids = np.frombuffer(data[bounds[a] : bounds[b]].tobytes(), "<u4")
            yield batch.column("key").slice(a, b - a).to_pylist(), ids, (bounds[a : b + 1] - bounds[a]) // 4

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        partition = TaskContext.get().partitionId()
        fs, root = self.resolve(self.path)
        fs.create_dir(root, recursive=True)
        # Another attempt at the same partition writes files of its own.
        name = f"{partition:06d}-{uuid.uuid4().hex}"
        offsets, starts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        with fs.open_output_stream(f"{root}/{name}.records") as file:
            for batch in iterator:
                for keys, ids, own in self._sequences(batch):
                    raw, ends = frame(keys, ids, own)
                    file.write(raw)
                    offsets.append(ends[1:] + offsets[-1][-1])
                    starts.append(own[1:] + starts[-1][-1])
        offset, start = np.concatenate(offsets), np.concatenate(starts)
        with fs.open_output_stream(f"{root}/{name}.index") as file:
            file.write(index_bytes(offset, start))
        return _Written(partition, name, len(offset) - 1, int(start[-1]), int(offset[-1]))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self.resolve(self.path)
        fs.create_dir(root, recursive=True)
        files = [] if self.overwrite else read_manifest(self.path, missing_ok=True)
        for m in sorted((m for m in messages if m is not None and m.records), key=lambda m: m.partition):
            files.append({"file": m.file, "records": m.records, "tokens": m.tokens, "bytes": m.bytes})
        with fs.open_output_stream(f"{root}/{MANIFEST}") as file:
            file.write(json.dumps(files).encode())


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of runs of neighbours that stay near ``most`` together."""
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def read_manifest(path: str, missing_ok: bool = False) -> list[dict]:
    """The files of a folder in order: file, records, tokens, bytes."""
    fs, root = location_resolver()(path)
    if missing_ok and not fs.get_file_info(f"{root}/{MANIFEST}").is_file:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


# ---- reading


@dataclass
class _Piece(InputPartition):
    """Records ``first`` to ``end`` of a file, or places ``first`` to ``end`` of the shuffled order (no file)."""

    file: int | None
    first: int
    end: int


def shuffled_place(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 to n - 1 that every task works out for its own places alone.

    Four rounds of a Feistel network over the next even number of bits; a value beyond n goes round again.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(place, np.uint64))
        while (beyond := out >= n).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


class _Reader(DataSourceReader):
    def __init__(self, path: str, seed: int | None):
        self.path, self.seed, self.resolve = path, seed, location_resolver()
        self.files = read_manifest(path)
        self.records = np.append(0, np.cumsum([f["records"] for f in self.files])).astype(np.int64)
        self.tokens = np.append(0, np.cumsum([f["tokens"] for f in self.files])).astype(np.int64)

    def partitions(self) -> list[InputPartition]:
        ranges = [(None, int(self.records[-1]))] if self.seed is not None else [(k, f["records"]) for k, f in enumerate(self.files)]
        pieces = [_Piece(k, at, min(at + TASK_RECORDS, n)) for k, n in ranges for at in range(0, n, TASK_RECORDS)]
        return pieces or [_Piece(None, 0, 0)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if partition.file is None:
            return self._shuffled(partition)
        return self._in_order(partition)

    def _open(self, file: int, kind: str):
        fs, root = self.resolve(self.path)
        return fs.open_input_file(f"{root}/{self.files[file]['file']}.{kind}")

    def _entries(self, index, file: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and token starts of records ``first`` to ``end``, and of what follows them."""
        size = self.files[file]["records"] + 1
        if index.size() != size * _ENTRY + 4:
            raise CorruptRecord(f"{self.files[file]['file']}.index: {index.size()} bytes for {size} entries")
        raw = index.read_at((end - first + 1) * _ENTRY, first * _ENTRY)
        entries = np.frombuffer(raw, "<u8").astype(np.int64).reshape(-1, 2)
        if (np.diff(entries, axis=0) < 0).any():
            raise CorruptRecord(f"{self.files[file]['file']}.index: offsets fall")
        return entries[:, 0], entries[:, 1]

    def _in_order(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        name = self.files[piece.file]["file"]
        with self._open(piece.file, "index") as index, self._open(piece.file, "records") as records:
            offsets, starts = self._entries(index, piece.file, piece.first, piece.end)
            for a, b in _runs(np.diff(offsets), CHUNK_BYTES):
                raw = records.read_at(int(offsets[b] - offsets[a]), int(offsets[a]))
                keys, ids = unframe(raw, offsets[a : b + 1] - offsets[a], name)
                position = self.records[piece.file] + piece.first + np.arange(a, b)
                yield _batch(keys, position, self.tokens[piece.file] + starts[a:b], np.diff(starts[a : b + 1]), ids)

    def _shuffled(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        """Records in the order of the permutation; those of one file are fetched together."""
        for at in range(piece.first, piece.end, _SHUFFLED_TOGETHER):
            places = np.arange(at, min(at + _SHUFFLED_TOGETHER, piece.end))
            wanted = shuffled_place(places, int(self.records[-1]), self.seed)
            file_of = np.searchsorted(self.records, wanted, "right") - 1
            found: dict[int, tuple] = {}
            for file in np.unique(file_of).tolist():
                with self._open(file, "index") as index, self._open(file, "records") as records:
                    for k in np.sort(wanted[file_of == file]).tolist():
                        own = k - int(self.records[file])
                        offsets, starts = self._entries(index, file, own, own + 1)
                        raw = records.read_at(int(offsets[1] - offsets[0]), int(offsets[0]))
                        keys, ids = unframe(raw, offsets - offsets[0], self.files[file]["file"])
                        found[k] = keys[0], int(self.tokens[file] + starts[0]), int(starts[1] - starts[0]), ids[0]
            rows = [found[k] for k in wanted.tolist()]
            for a, b in _runs(np.array([len(r[3]) for r in rows]), CHUNK_BYTES):
                keys, starts, sizes, ids = zip(*rows[a:b])
                yield _batch(list(keys), wanted[a:b], np.array(starts), np.array(sizes), list(ids))


def _batch(keys, position, start, n_tokens, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), *(pa.array(x, pa.int64()) for x in (position, start, n_tokens)), pa.array(ids, pa.binary())],
        ["key", "position", "start", "n_tokens", "tokens"],
    )


class TokenRecords(DataSource):
    """``spark.read.format("token_records").load(folder)`` after ``spark.dataSource.register(TokenRecords)``.

    Rows are (key, position, start, n_tokens, tokens): a record's place among all records, the number of tokens
    before it, its own, and its ids in 32 bits.  With the option ``shuffle_seed`` the rows come in an order that
    the seed decides, found through the index files.  Written are (key, tokens), in the order of partitions and
    rows, or with the option ``tokenizer`` (key, text), encoded as they are written, each with ``end_id`` at its end
    if that is given.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        seed = self.options.get("shuffle_seed")
        return _Reader(self.options["path"], None if seed is None else int(seed))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        end_id = self.options.get("end_id")
        return _Writer(self.options["path"], overwrite, self.options.get("tokenizer"), None if end_id is None else int(end_id))


def write_records(sequences: DataFrame, path: str, key: str = "doc_id", mode: str = "overwrite") -> None:
    """Write (``key``, tokens) rows in the order of their partitions; ``tokens`` as ``token_ids`` makes them."""
    sequences.sparkSession.dataSource.register(TokenRecords)
    rows = sequences.select(F.col(f"`{key}`").cast("long").alias("key"), "tokens")
    rows.write.format(FORMAT).mode(mode).save(path)


def write_texts(
    docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Encode (``key``, ``text``) rows as ``token_ids`` does and write them in the order of their partitions."""
    docs.sparkSession.dataSource.register(TokenRecords)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    writer = rows.write.format(FORMAT).mode(mode).option("tokenizer", tokenizer)
    (writer if end_id is None else writer.option("end_id", end_id)).save(path)


def read_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format(FORMAT)
    return (reader if shuffle_seed is None else reader.option("shuffle_seed", shuffle_seed)).load(path)


def in_key_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``text``) in partitions of ascending keys, null first; equal keys by a hash of the text.

    Rows are dealt by key, text and the partition they come from, so repeated rows do not fall to one task.
    """
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).withColumns(
        {"_order": F.xxhash64(F.col(f"`{text}`")), "_part": F.spark_partition_id()}
    )
    order = [F.col(f"`{key}`"), F.col("_order"), F.col("_part")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(f"`{key}`"), F.col(f"`{text}`"))
