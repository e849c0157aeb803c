"""BPE encoding and decoding over a table of distinct words.

Texts are split into words chunk by chunk.  A chunk (what one task reads, cut at a bound) keeps its
documents as numbers into its own list of distinct words; the lists are dealt by a hash of the word,
so each distinct word of the whole table is encoded in one place and once, and its ids go back to
every chunk that holds it, where they are joined to the documents by position.  Only distinct words
are shuffled; the documents lie in a table bucketed by chunk, as numbers of less than two bytes a word.

Decoding joins ids with the tokenizer's table of pieces, which the vocabulary bounds: a chunk's distinct
ids are joined once each, and its documents are spelled from the pieces that the join gave.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded each; an empty table gives an empty result; further columns are ignored; special strings in a
text become their ids as the tokenizer has it; a long text is encoded whole, and only itself passes the
bound of what a step of a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm.common import bucketed, filled, gather, text_slices
from cellframe.llm.wordtokens import listed, split_words, word_encoder

#: Distinct words of a chunk, after which the next chunk begins.
CHUNK_WORDS = 600_000
#: Parts by hash into which the distinct words are dealt.
BUCKETS = 64
CHUNKS = "chunk long, bucket int, doc_ids array<long>, data array<binary>, used array<int>"


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as the four planes of their bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _row(chunk: int, bucket: int, doc_ids: list | None, data: list[bytes], used: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([data], pa.list_(pa.binary())), pa.array([used], pa.list_(pa.int32()))],
        ["chunk", "bucket", "doc_ids", "data", "used"],
    )


class _Chunk:
    """The distinct words of the texts that a chunk has taken so far, numbered as they came."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.words: dict[str, int] = {}

    def documents(self, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        offsets, codes, distinct = split_words(texts)
        words = listed(distinct)
        known = self.words
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
        return _row(self.number, -1, doc_ids.to_pylist(), [_squeezed(own[codes]), _squeezed(np.diff(offsets))])

    def lists(self) -> Iterator[pa.RecordBatch]:
        dealt: list[list[str]] = [[] for _ in range(self.buckets)]
        numbers: list[list[int]] = [[] for _ in range(self.buckets)]
        for number, word in enumerate(self.words):
            bucket = xxhash.xxh32_intdigest(word.encode()) % self.buckets
            dealt[bucket].append(word)
            numbers[bucket].append(number)
        for bucket, words in enumerate(dealt):
            if words:  # words hold no line feed, which splits them
                steps = np.diff(np.array(numbers[bucket]), prepend=0)
                yield _row(self.number, bucket, None, [zstandard.compress("\n".join(words).encode()), _squeezed(steps)])


def split_chunks(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Documents as numbers of words (bucket -1) and the lists of distinct words, by chunk."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        chunk = _Chunk(first, buckets)
        for batch in batches:
            for a, b in text_slices(batch, 1):
                yield chunk.documents(batch.column(0).slice(a, b - a), filled(batch.column(1).slice(a, b - a)))
                if len(chunk.words) > CHUNK_WORDS:
                    yield from chunk.lists()
                    chunk = _Chunk(chunk.number + 1, buckets)
        yield from chunk.lists()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, CHUNKS)


def encode_lists(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """The lists of words with the words' ids in their place and the ids they use; all lists of a hash part meet in one task."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for chunk, bucket, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                words = zstandard.decompress(data[0]).decode().split("\n")
                slots = encoder.slots_of_words(pa.array(words, type=pa.large_string()))
                lengths = encoder.lengths[slots]
                ids = encoder.ids[gather(encoder.starts[slots.ravel()], lengths.ravel())]
                yield _row(chunk, bucket, None, [_squeezed(ids), _squeezed(lengths.sum(axis=1)), data[1]], np.unique(ids).astype(np.int32))

    return chunks.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encoded, CHUNKS)


def chunk_pieces(lists: DataFrame, tokenizer: str) -> DataFrame:
    """For each chunk its distinct ids with their pieces, by a join of ids with the vocabulary's table."""
    ids = lists.select("chunk", F.explode("used").alias("id")).distinct()
    joined = ids.join(F.broadcast(piece_table(lists.sparkSession, tokenizer)), "id")  # the vocabulary bounds both sides of a chunk
    return joined.groupBy("chunk").agg(F.collect_list("id").alias("piece_ids"), F.collect_list("piece").alias("pieces"))


def joined_chunks(documents: DataFrame, lists: DataFrame, each, schema: str) -> DataFrame:
    """Joins the ids back by position; ``each`` makes rows of (a row of documents, starts of each document's words, words, ids, their starts and lengths)."""

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        data = right.column("data").to_pylist()
        ids = np.concatenate([_numbers(d[0]) for d in data] + [np.zeros(0, np.uint32)])
        lengths = np.concatenate([_numbers(d[1]) for d in data] + [np.zeros(0, np.uint32)]).astype(np.int64)
        numbers = np.concatenate([np.cumsum(_numbers(d[2]), dtype=np.int64) for d in data] + [np.zeros(0, np.int64)])
        place = np.empty(len(numbers), dtype=np.int64)
        place[numbers] = np.arange(len(numbers))
        starts = (np.cumsum(lengths) - lengths)[place]
        lengths = lengths[place]
        tables = []
        for k in range(len(left)):
            row = left.slice(k, 1)
            words, counts = row.column("data")[0].as_py()
            offsets = np.concatenate([[0], np.cumsum(_numbers(counts), dtype=np.int64)])
            tables.append(each(row, _numbers(words).astype(np.int64), offsets, ids, starts, lengths))
        return pa.concat_tables(tables)

    return documents.groupBy("chunk").cogroup(lists.groupBy("chunk")).applyInArrow(joined, schema)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every document."""

    def each(row, words, offsets, ids, starts, lengths) -> pa.Table:
        sizes = lengths[words]
        flat = ids[gather(starts[words], sizes)].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
        return pa.table([row.column("doc_ids").combine_chunks().flatten(), lists], names=["doc_id", "ids"])

    chunks = bucketed(split_chunks(docs), "chunk")
    return joined_chunks(chunks.where("bucket = -1"), encode_lists(chunks, tokenizer).drop("used"), each, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""

    def each(row, words, offsets, ids, starts, lengths) -> pa.Table:
        piece_ids = row.column("piece_ids")[0].values
        piece_ids = piece_ids.to_numpy() if piece_ids is not None else np.zeros(0, np.int32)
        pieces = np.empty(int(piece_ids.max()) + 1 if len(piece_ids) else 0, dtype=object)
        if len(piece_ids):
            pieces[piece_ids] = listed(row.column("pieces")[0].values)
        used, local = np.unique(words, return_inverse=True)
        own = lengths[used]
        flat = ids[gather(starts[used], own)]
        spelled = pieces[flat].tolist()
        ends = np.cumsum(own)
        texts = [" ".join(spelled[a:b]) for a, b in zip((ends - own).tolist(), ends.tolist(), strict=True)]
        kept = (own > 0)[local]
        sizes = own[local]
        stream = ids[gather(starts[words], lengths[words])].astype("<u4")
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        local, rows = local.tolist(), []
        for k, doc_id in enumerate(row.column("doc_ids")[0].as_py()):
            own_ids = stream[at[k] : at[k + 1]]
            span = slice(int(offsets[k]), int(offsets[k + 1]))
            decoded = " ".join([texts[w] for w, is_kept in zip(local[span], kept[span].tolist(), strict=True) if is_kept])
            rows.append((doc_id, len(own_ids), hashlib.sha256(own_ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chunks = bucketed(split_chunks(docs), "chunk")
    lists = bucketed(encode_lists(chunks, tokenizer), "chunk")
    documents = chunks.where("bucket = -1").join(chunk_pieces(lists, tokenizer), "chunk", "left")
    return joined_chunks(documents, lists.drop("used"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def word_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct words (split at white space) of all texts with their ids."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \t\n\x0b\f\r]+")).alias("word")).where("word <> ''").distinct()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            slots = encoder.slots_of_words(batch.column(0).cast(pa.large_string()))
            ids = [np.concatenate([encoder.ids[encoder.starts[s] : encoder.starts[s] + encoder.lengths[s]] for s in own]).astype(np.int32) for own in slots]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], ["word", "ids"])

    return words.mapInArrow(encoded, "word string, ids array<int>")


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """id and piece of the whole vocabulary."""
    return spark.createDataFrame(list(enumerate(word_encoder(tokenizer).pieces)), "id int, piece string")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of ``encoded`` (doc_id, ids): pieces joined by a space, as without a decoder.

    The vocabulary bounds the broadcast side.  Documents are told apart by a row number of their own,
    so repeated ids and null ids stay apart, and each one's pieces are put in order again.
    """
    rows = encoded.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "ids")
    placed = rows.select("_row", "doc_id", F.posexplode_outer("ids").alias("_place", "id"))
    pieces = placed.join(F.broadcast(piece_table(encoded.sparkSession, tokenizer)), "id", "left")
    grouped = pieces.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "piece")))).alias("parts"))
    return grouped.select("doc_id", F.array_join("parts.piece", " ").alias("text"))
