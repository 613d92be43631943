"""Token-id files: patched frame-of-reference blocks, written and read by Spark.

A file set is a folder of Parquet files that hold *segments*. A segment has the ids
of some neighbouring documents, cut into blocks of :data:`BLOCK` ids. A block is
stored as

* its length (2 bytes), minimum (4), bit width (1) and number of exceptions (2),
* the ids less the minimum, their low bits packed at that width, which is the
  smallest one that holds the share :data:`COVERED` of the block's ids,
* the exceptions: their places in the block (2 bytes each) and their high bits (4 each),

all little-endian. The segment's ``block_starts`` give the place of each block in
``payload``, so that a reader can decode one block alone; ``doc_ids`` and
``doc_lengths`` say whose ids they are, ``first`` how many ids of the shard stand before it. Segments are written in ascending order of
(shard, segment), which is ascending doc_id; a shard is what one task wrote.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks_of, mapped, new_folder, table
from .tokens import encoder

BLOCK = 4096
COVERED = 0.9
SEGMENT_IDS = 1 << 16
HEADER = np.dtype([("n", "<u2"), ("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
SEGMENT = "shard long, segment long, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_starts array<long>, payload binary"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_blocks(ids: np.ndarray, block: int = BLOCK, covered: float = COVERED) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` after one another, and where each starts."""
    n_blocks = -(-len(ids) // block)
    if not n_blocks:
        return b"", np.zeros(0, np.int64)
    sizes = np.full(n_blocks, block)
    sizes[-1] = len(ids) - block * (n_blocks - 1)
    grid = np.full(n_blocks * block, ids[-1], np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n_blocks, block)
    low = grid.min(1)
    grid = grid - low[:, None]
    bits = np.frexp(grid.astype(np.float64))[1]
    # The smallest width that holds the share `covered` of a block's ids.
    widths = np.sort(bits, axis=1)[np.arange(n_blocks), np.maximum(np.ceil(covered * sizes).astype(int) - 1, 0)].astype(np.int64)
    parts: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        part = grid[rows]
        if width:
            packed = _low_bits(part, int(width))
        else:
            packed = np.zeros((len(rows), 0), np.uint8)
        high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        for row, bytes_, above in zip(rows, packed, high, strict=True):
            n = int(sizes[row])
            places = np.flatnonzero(above[:n])
            head = np.array([(n, low[row], width, len(places))], HEADER)
            parts[row] = head.tobytes() + bytes_[: -(-n * int(width) // 8)].tobytes() + places.astype("<u2").tobytes() + above[places].astype("<u4").tobytes()
    lengths = np.fromiter(map(len, parts), np.int64, n_blocks)
    return b"".join(parts), np.cumsum(lengths) - lengths


def _slots(width: int) -> list[tuple[int, int]]:
    """Word and shift of each of 64 values of ``width`` bits that lie end to end in ``width`` words of 64 bits."""
    return [divmod(i * width, 64) for i in range(64)]


def _low_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row's values at ``width`` bits, packed into bytes."""
    n, columns = rows.shape
    groups = -(-columns // 64)
    values = np.zeros((n, groups * 64), np.uint64)
    values[:, :columns] = rows & np.uint32((1 << width) - 1)
    values = values.reshape(n * groups, 64).T.copy()
    words = np.zeros((width + 1, n * groups), np.uint64)
    for value, (word, shift) in zip(values, _slots(width), strict=True):
        words[word] |= value << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= value >> np.uint64(64 - shift)
    return words[:width].T.astype("<u8").reshape(n, groups * width).view(np.uint8)


def _from_low_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """The values of rows that :func:`_low_bits` packed, in multiples of 64."""
    n = len(packed)
    words = packed.view("<u8").reshape(-1, width).T.copy()
    values = np.empty((64, words.shape[1]), np.uint64)
    for i, (word, shift) in enumerate(_slots(width)):
        values[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            values[i] |= words[word + 1] << np.uint64(64 - shift)
    values &= np.uint64((1 << width) - 1)
    return values.T.astype(np.uint32).reshape(n, -1)


def read_block(payload: memoryview | bytes, start: int) -> np.ndarray:
    """The ids of the block that starts at ``start``."""
    return read_blocks(payload, [start])


def read_blocks(payload: memoryview | bytes, starts: list[int]) -> np.ndarray:
    """The ids of blocks after one another; those of one width are unpacked at once."""
    heads = [np.frombuffer(payload, HEADER, 1, s)[0] for s in starts]
    sizes = [int(h["n"]) for h in heads]
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    by_width: dict[int, list[int]] = {}
    for k, h in enumerate(heads):
        by_width.setdefault(int(h["width"]), []).append(k)
    for width, blocks in by_width.items():
        values = np.zeros((len(blocks), 0), np.uint32)
        if width:
            packed = np.zeros((len(blocks), -(-max(sizes[k] for k in blocks) // 64) * width * 8), np.uint8)
            for row, k in zip(packed, blocks, strict=True):
                size = -(-sizes[k] * width // 8)
                row[:size] = np.frombuffer(payload, np.uint8, size, starts[k] + HEADER.itemsize)
            values = _from_low_bits(packed, width)
        for row, k in zip(values, blocks, strict=True):
            own = out[int(ends[k]) - sizes[k] : int(ends[k])]
            if width:
                own[:] = row[: sizes[k]]
            if exceptions := int(heads[k]["exceptions"]):
                at = starts[k] + HEADER.itemsize + -(-sizes[k] * width // 8)
                high = np.frombuffer(payload, "<u4", exceptions, at + 2 * exceptions)
                own[np.frombuffer(payload, "<u2", exceptions, at)] |= high << np.uint32(width)
            own += heads[k]["low"]
    return out


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write them below ``path`` in ascending order of doc_id.

    A null text is empty: its ids are the end id alone. Rows with one doc_id follow each
    other in the order of their texts; null ids come first. An empty table writes no segment.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, segment = encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        whose: list[int | None] = []
        n_held = first = 0
        schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("block_starts", pa.list_(pa.int64())), ("payload", pa.binary())])

        def full() -> pa.RecordBatch:
            nonlocal segment, first
            ids = np.concatenate(held)
            payload, starts = pack_blocks(ids)
            row = {"shard": shard, "segment": segment, "first": first, "n_ids": len(ids), "doc_ids": list(whose), "doc_lengths": [len(x) for x in held], "block_starts": starts.tolist(), "payload": payload}
            segment += 1
            first += len(ids)
            held.clear()
            whose.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks_of(texts):
                ids, sizes = words.encode_ended(texts[a:b], end_id)
                for doc_id, own in zip(doc_ids[a:b], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    held.append(own)
                    whose.append(doc_id)
                    n_held += len(own)
                    if n_held >= SEGMENT_IDS:
                        n_held = 0
                        yield full()
        if held:
            yield full()

    in_order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    mapped(in_order, encode, SEGMENT, f"encoder {vocabulary}").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: doc_id, start, n_tokens and the crc32 of its decoded ids."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # A row per shard, that is per task that wrote: what the ordered window and the broadcast hold doesn't grow with the rows of a shard.
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = read_blocks(row["payload"], row["block_starts"])
                lengths = np.array(row["doc_lengths"], np.int64)
                starts = row["first"] + np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    held = segments.join(F.broadcast(bases), "shard").withColumn("first", F.col("first") + F.col("base"))
    return held.select("first", "doc_ids", "doc_lengths", "block_starts", "payload").mapInArrow(decode, DOCUMENT)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files and read back."""
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
