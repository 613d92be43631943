"""BPE encoding and decoding by a table of distinct words.

Texts are taken in blocks of about :data:`BLOCK_BYTES`. A block becomes its distinct
words, and for each text the places of its words among them. In the table of all blocks' words a word's rows stand
together, so that it is encoded once; the ids are joined back to the blocks, whose
texts take them up by position. Decoding looks each id up in the vocabulary's pieces.

What is shuffled is a row for each block and distinct word, twice, and the packed places: no text, and no row for each
occurrence of a word. A frequent word has one short row for each block, which a task takes in as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks_of, kept, mapped, table
from .tokens import Encoder, Places, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Bytes of the texts that share a list of distinct words; the more they are, the fewer rows a word has.
BLOCK_BYTES = 32 << 20
WORDS = "block long, k int, word string"
#: The texts of a block are rows of the same form, after its words: ``data`` is a record batch of TEXTS.
BLOCKS = "block long, k int, data binary"
TEXTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()), ("places", pa.binary())])
#: Stands for ``k`` in the rows of texts.
AFTER_WORDS = 2**31 - 1
ENCODED = "doc_id long, n_tokens long, ids binary"


class Words(Encoder):
    """An encoder for a vocabulary that drops white space, which takes a word at a time."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if self.by_bytes:
            raise ValueError("the vocabulary keeps white space: its words depend on what stands before them")
        self.tokenizer.encode_special_tokens = True  # added tokens are told apart by cut() alone
        self.added_ids = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def cut(self, text: str) -> list[str]:
        """The words of a text, over whose ends no merge goes; added tokens are words of their own."""
        if self.at_added and any(a in text for a in self.added):
            return [w for k, part in enumerate(self.at_added.split(text)) for w in ([part] if k % 2 else self.split(part))]
        return self.split(text)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words after one another, and how many each has."""
        self.forget()
        plain = [w for w in words if w not in self.added_ids]
        self.learn(plain)
        if len(plain) == len(words):
            starts, sizes = self.starts, self.lengths
        else:
            starts, sizes = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
            own = np.array([w not in self.added_ids for w in words])
            starts[own], sizes[own] = self.starts, self.lengths
            starts[~own] = len(self.ids) + np.arange((~own).sum())
            self.ids = np.concatenate([self.ids, np.array([self.added_ids[w] for w in words if w in self.added_ids], np.uint32)])
        return self.ids[gathered(starts, sizes)], sizes


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run of ``sizes`` places, after one another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - ends + sizes, sizes) + np.arange(total)


def words_of(vocabulary: str) -> Words:
    """This worker's word encoder."""
    return kept(f"words {vocabulary}", lambda: Words(vocabulary_path(vocabulary)))


def digest_of(batch: pa.RecordBatch, so_far: bytes) -> bytes:
    """A digest of a batch's ids and texts and of those before it: the same in a task that is run again."""
    digest = blake2b(so_far, digest_size=8)
    for column in batch.columns:
        for part in pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) else 0, column.type)).buffers()[1:]:
            digest.update(memoryview(part) if part else b"")
    digest.update(repr((batch.num_rows, batch.column(0).null_count)).encode())
    return digest.digest()


def cut_texts(own: Words, texts: list[str], words: Places) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and their places among the block's ``words``, one after another."""
    counts, parts = np.zeros(len(texts), np.int32), [np.zeros(0, np.int32)]
    for a, b in chunks_of(texts):
        cut = [own.cut(t) for t in texts[a:b]]
        counts[a:b] = [len(c) for c in cut]
        flat = [w for c in cut for w in c]
        parts.append(np.fromiter(map(words.__getitem__, flat), np.int32, len(flat)))
    return counts, np.concatenate(parts)


def packed(places: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of bytes, low bytes first, compressed."""
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame, vocabulary: str, words_only: bool) -> DataFrame:
    """Rows of WORDS, or of BLOCKS, for the texts of ``docs``. A block is numbered by its ids and texts; equal blocks share their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, size, digest = words_of(vocabulary), Places(), 0, b""
        held: list[bytes] = []

        def block() -> pa.RecordBatch:
            number = int.from_bytes(digest, "little", signed=True)
            if words_only:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(list(words), pa.string())], ["block", "k", "word"])
            return pa.RecordBatch.from_arrays([pa.array([number] * len(held)), pa.array([AFTER_WORDS] * len(held), pa.int32()), pa.array(held, pa.binary())], ["block", "k", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            counts, places = cut_texts(own, [t or "" for t in batch.column(1).to_pylist()], words)
            digest, size = digest_of(batch, digest), size + batch.column(1).nbytes
            if not words_only:
                # All places of the batch stand with its first text.
                all_ = pa.array([packed(places)] + [None] * (batch.num_rows - 1), pa.binary())
                held.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), all_], schema=TEXTS).serialize().to_pybytes())
            if size >= BLOCK_BYTES:
                yield block()
                words.clear()
                held.clear()
                size, digest = 0, b""
        if size:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, cut, WORDS if words_only else BLOCKS, f"words {vocabulary}", rows=0)


def with_ids(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``words`` (WORDS) with the ids of each word, as little-endian unsigned 32-bit integers: block, k, data.

    The rows of a word stand together in the table of words, one for each block that holds it, and it is encoded for all of them at once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(vocabulary)
        for batch in batches:
            run = pc.run_end_encode(batch.column("word"))
            ids, sizes = own.of_words(run.values.to_pylist())
            ends = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
            each = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            rows = np.diff(np.concatenate([[0], run.run_ends.to_numpy()]))
            held = each.take(pa.array(np.repeat(np.arange(len(sizes)), rows)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("k"), held], ["block", "k", "data"])
            own.forget()

    return mapped(words.repartition("word").sortWithinPartitions("word"), encode, BLOCKS, f"words {vocabulary}", rows=0)


def joined_by_position(rows: DataFrame) -> DataFrame:
    """ENCODED of ``rows``, which hold each block's words with their ids (block, k, data) and its texts (BLOCKS).

    A task reads a block's words in their order, and then takes their ids up for one row of texts after another.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, k, held = None, [], []
        starts = sizes = flat = np.zeros(0, np.int64)
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if blocks[a] != block:
                    block, k, held, flat = blocks[a], [], [], None
                part = batch.slice(a, b - a)
                n_words = int(np.searchsorted(part.column("k").to_numpy(), AFTER_WORDS))
                if n_words:
                    k.append(part.column("k").to_numpy()[:n_words])
                    held.append(part.column("data").slice(0, n_words))
                if n_words == b - a:
                    continue
                if flat is None:
                    places = np.concatenate([np.zeros(0, np.int32), *k])
                    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))[: len(places)]  # equal blocks have their words more than once
                    ids = pa.chunked_array(held, pa.binary()).take(pa.array(first)).combine_chunks() if held else pa.array([], pa.binary())
                    sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                    flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
                    starts = np.cumsum(sizes) - sizes
                    whole = len(first) == (int(places[-1]) + 1 if len(places) else 0)
                    k, held = [], []
                for data in part.column("data").slice(n_words):
                    texts = pa.ipc.read_record_batch(data.as_buffer(), TEXTS)
                    counts = texts.column("n_words").to_numpy()
                    places = unpacked(texts.column("places")[0].as_py(), int(counts.sum(dtype=np.int64)))
                    if len(places) and (not whole or places.max() >= len(sizes)):
                        raise ValueError("a block's words were cut otherwise when they were read again: write the documents first")
                    ends = np.concatenate([[0], np.cumsum(sizes[places])])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
                    own = flat[gathered(starts[places], sizes[places])]
                    ids = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()), pa.py_buffer(own.tobytes())])
                    yield pa.RecordBatch.from_arrays([texts.column("doc_id"), pa.array(np.diff(ends)), ids.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows.repartition("block").sortWithinPartitions("block", "k").mapInArrow(join, ENCODED)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each text's token ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    A row for each row of ``docs`` (doc_id, text; other columns are passed over), rows without an id and repeated ones included; null, empty
    and blank texts have no ids. A text is never cut: a very long one ends its block. Strings of
    the vocabulary's added tokens become those tokens, as in the library.
    """
    ids = with_ids(_blocks(docs, vocabulary, True), vocabulary)
    blocks = _blocks(docs, vocabulary, False)
    return joined_by_position(ids.unionByName(blocks))


class Pieces:
    """The pieces of a vocabulary by id, and what the library puts between them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies whose pieces are joined by spaces")
        by_id = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        self.pieces = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of runs of ``sizes`` ids; ids without a piece are passed over."""
        ids = ids.astype(np.int64)
        held = self.pieces.take(pa.array(ids, mask=ids >= len(self.pieces)))
        if held.null_count:
            known = held.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            held = held.drop_null()
        else:
            ends = np.concatenate([[0], np.cumsum(sizes)])
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), held), " ")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` (doc_id, n_tokens, ids as :func:`encode` gives them) with ``text``, their pieces joined as the library does.

    The join of ids with pieces is a lookup in each task: the table has a row for each id of the
    vocabulary, however many documents there are. Null ids are none; an unknown id has no piece.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"pieces {vocabulary}", lambda: Pieces(vocabulary_path(vocabulary)))
        for batch in batches:
            held = pc.fill_null(batch.column(2), b"")
            sizes = pc.binary_length(held).to_numpy() // 4
            ids = np.frombuffer(b"".join(held.to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(ids, sizes).cast(pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return mapped(rows.select("doc_id", "n_tokens", "ids"), look_up, f"{ENCODED}, text string", f"pieces {vocabulary}")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: the digests of their ids and of the decoded texts."""
    rows = decode(encode(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
