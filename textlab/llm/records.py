"""Token ids as length-delimited binary records, with a separate offset index.

A record is framed as in the public TFRecord format::

    uint64 length | uint32 masked CRC-32C of the length | data | uint32 masked CRC-32C of the data

all little-endian; ``data`` is the token ids as uint16 (or uint32 where the vocabulary has
more than 65 536 ids). The index has (doc_id, shard, offset, length, n_tokens) of each
record, so that a reader can fetch records in any order.

Each task writes one shard under a name of its own attempt and returns the index rows of
what it wrote; the index holds the rows of successful attempts alone, so that a task that
is run again, or twice, leaves a file that no reader looks at. Documents with a null text
have no record; an empty text is a record without data. Repeated rows are repeated
records; an empty table has an empty index. Texts of any length are one record. Ids keep
their type, extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from textlab.llm import bpe
from textlab.llm.common import csr_take, kind_of, qualified, shared_path, slices

INDEX_SCHEMA = "shard string, offset bigint, length bigint, n_tokens bigint"
HEADER, FOOTER, CHUNK = 12, 4, 128


def _byte_table() -> np.ndarray:
    """CRC-32C (Castagnoli, reflected) of each byte from a zero state."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


TABLE = _byte_table()
#: Of each pair of bytes.
TABLE2 = TABLE[(np.arange(65536) & 0xFF) ^ 0] ^ np.uint32(0)
TABLE2 = (TABLE2 >> 8) ^ TABLE[(TABLE2 & 0xFF) ^ (np.arange(65536) >> 8)]


def _zeros(state: np.ndarray, n: int) -> np.ndarray:
    """States after n zero bytes."""
    for _ in range(n):
        state = (state >> 8) ^ TABLE[state & 0xFF]
    return state


#: The state after CHUNK zero bytes, by each byte of the state before.
SKIP = np.stack([_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * i), CHUNK) for i in range(4)])


def crc32c(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many stretches of a byte array.

    The state is linear in the bytes, and zeros in front of a message leave a zero state
    as it is. So messages are padded in front to whole chunks, the chunks of all messages
    run side by side, and their states are then joined message by message. The initial
    state (all ones) is the same as inverting a message's first four bytes, and is added
    as the effect of those bits.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    chunks = -(-lengths // CHUNK)
    total = int(chunks.sum())
    padded = np.zeros(total * CHUNK, np.uint8)
    last = np.cumsum(chunks)
    first = last - chunks
    if lengths.sum():
        to = np.repeat(last * CHUNK - np.cumsum(lengths), lengths) + np.arange(int(lengths.sum()))
        padded[to] = csr_take(body, starts, lengths)
    words = np.ascontiguousarray(padded.view("<u2").reshape(total, CHUNK // 2).T)
    state = np.zeros(total, np.uint32)
    for w in words:
        state = (state >> 16) ^ TABLE2[(state & 0xFFFF) ^ w]
    out = np.zeros(n, np.uint32)
    lane = np.flatnonzero(chunks)
    step = 0
    while lane.size:
        s = out[lane]
        out[lane] = SKIP[0][s & 0xFF] ^ SKIP[1][(s >> 8) & 0xFF] ^ SKIP[2][(s >> 16) & 0xFF] ^ SKIP[3][s >> 24] ^ state[first[lane] + step]
        step += 1
        lane = lane[chunks[lane] > step]
    return out ^ _initial(lengths) ^ np.uint32(0xFFFFFFFF)


_powers: list[np.ndarray] = []


def _initial(lengths: np.ndarray) -> np.ndarray:
    """What the initial state becomes after so many zero bytes."""
    if not _powers:
        columns = _zeros(np.uint32(1) << np.arange(32, dtype=np.uint32), 1)
        for _ in range(48):
            _powers.append(columns)
            columns = _apply(columns, columns)
    state = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> bit) & 1 == 1
        state[on] = _apply(_powers[bit], state[on])
    return state


def _apply(columns: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for i in range(32):
        out ^= np.where((state >> np.uint32(i)) & 1, columns[i], np.uint32(0))
    return out


def mask(crc: np.ndarray) -> np.ndarray:
    """The masking of the record format: rotate right by 15 bits, add a constant."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(body: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Framed records of consecutive stretches of bytes, and the offset of each record."""
    n = len(lengths)
    lengths = lengths.astype(np.int64)
    sizes = lengths + HEADER + FOOTER
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = lengths.astype("<u8").view(np.uint8)
    head_crc = mask(crc32c(head, np.arange(n) * 8, np.full(n, 8))).astype("<u4").view(np.uint8).reshape(n, 4)
    starts = np.cumsum(lengths) - lengths
    body_crc = mask(crc32c(body, starts, lengths)).astype("<u4").view(np.uint8).reshape(n, 4)
    for i in range(8):
        out[at + i] = head.reshape(n, 8)[:, i]
    for i in range(4):
        out[at + 8 + i] = head_crc[:, i]
        out[at + HEADER + lengths + i] = body_crc[:, i]
    if len(body):
        out[np.repeat(at + HEADER - starts, lengths) + np.arange(len(body))] = body
    return out.tobytes(), at


def parse(record: bytes) -> bytes:
    """The data of one framed record; an error where a length or a checksum is wrong."""
    (length,) = struct.unpack_from("<Q", record)
    if len(record) != length + HEADER + FOOTER:
        raise ValueError(f"record of {len(record)} bytes says {length} of data")
    raw = np.frombuffer(record, np.uint8)
    for start, size, at in ((0, 8, 8), (HEADER, length, HEADER + length)):
        want = int(mask(crc32c(raw, np.array([start]), np.array([size])))[0])
        if struct.unpack_from("<I", record, at)[0] != want:
            raise ValueError("checksum doesn't match")
    return record[HEADER : HEADER + length]


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = bpe.VOCABULARY) -> DataFrame:
    """Encode documents, write them as records below ``path``; the index (written too).

    ``path`` is a folder that all executors reach. The records lie in ``path``/shards, the
    index in ``path``/index (Parquet). One pass without a shuffle.
    """
    spark = docs.sparkSession
    v = bpe.vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(v)
    kind = np.uint16 if len(v.tokens) <= 1 << 16 else np.uint32
    where, schema = qualified(spark, path), f"doc_id {kind_of(docs, id_col)}, {INDEX_SCHEMA}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(shared.value)
        system, root = fs.FileSystem.from_uri(where)
        name, out, offset = f"{uuid.uuid4().hex}.rec", None, 0
        try:
            for part in slices(batches, limit=bpe.BATCH_BYTES):
                part = part.filter(part.column(1).is_valid())
                if not part.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{root}/shards", recursive=True)
                    out = system.open_output_stream(f"{root}/shards/{name}")
                tokens, ends = encoder.tokens(part.column(1))
                size = np.diff(np.concatenate(([0], ends)))
                body = tokens.astype(kind).view(np.uint8)
                framed, at = frame(body, size * kind().itemsize)
                out.write(framed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([name] * len(size)), pa.array(at + offset), pa.array(size * kind().itemsize), pa.array(size)],
                    names=["doc_id", "shard", "offset", "length", "n_tokens"],
                )
                offset += len(framed)
        finally:
            if out is not None:
                out.close()

    index = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    index.write.parquet(f"{where}/index")
    return spark.read.schema(schema).parquet(f"{where}/index")


def read_records(index: DataFrame, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, tokens) of index rows, in whatever order they come; checks every record.

    Rows are gathered by shard within a batch, so that each shard is opened once.
    """
    where = qualified(index.sparkSession, path)
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(where)
        for batch in batches:
            rows = batch.to_pylist()
            got: list[list[int] | None] = [None] * len(rows)
            by_shard: dict[str, list[int]] = {}
            for i, r in enumerate(rows):
                by_shard.setdefault(r["shard"], []).append(i)
            for shard, which in by_shard.items():
                with system.open_input_file(f"{root}/shards/{shard}") as f:
                    for i in sorted(which, key=lambda i: rows[i]["offset"]):
                        raw = f.read_at(rows[i]["length"] + HEADER + FOOTER, rows[i]["offset"])
                        got[i] = np.frombuffer(parse(raw), kind).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return index.select("doc_id", "shard", "offset", "length").mapInArrow(run, f"doc_id {kind_of(index, 'doc_id')}, tokens array<int>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's tokens as records in the shared folder; the offset index."""
    return write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "records"))
