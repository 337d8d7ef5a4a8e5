"""Token ids in blocks of variable-length numbers, written and read back in document order.

A block holds the ids of neighbouring documents. Its ids are ranked by how often they occur in
the block; a rank takes one to four bytes, and the byte counts stand in a stream of their own,
two bits each. Decoding looks up each control byte in a table of 256 rows and gathers the bytes
with numpy. Every block carries its rank table, so it can be read, or written again after an
executor is lost, without any other block. Blocks are rows of a Parquet table, which every store
that Spark reaches can hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import sliced
from corvane.llm.encoders import numbered_encoder, vocabulary
from corvane.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a block is closed; the document in hand stays whole.
BLOCK_IDS = 2_000_000

BLOCKS = ("part int, block int, first_id long, n_docs int, n_ids long, doc_ids binary, "
          "known_ids binary, lengths binary, ranked binary, control binary, data binary")

#: Bytes of each of the four numbers that a control byte describes, and their sum.
WIDTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1).astype(np.int32)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by frequency, control bytes, data bytes); equal counts go by the smaller id."""
    if len(ids) and int(ids.max()) > (1 << 20) + 8 * len(ids):  # too sparse for a table
        kinds, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
        numbers = numbers.reshape(-1)
    else:
        counts = np.bincount(ids)
        kinds, numbers = np.flatnonzero(counts), ids
        counts = counts[kinds]
        place = np.zeros(int(kinds.max(initial=0)) + 1, np.uint32)
        place[kinds] = np.arange(len(kinds), dtype=np.uint32)
        numbers = place[numbers]
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(kinds), "<u4")
    rank[order] = np.arange(len(kinds), dtype=np.uint32)
    numbers = rank[numbers]
    more = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    for bound in (0xFF, 0xFFFF, 0xFFFFFF):
        if len(kinds) > bound + 1:
            more[:len(numbers)] += numbers > bound
    control = more[::4] | more[1::4] << 2 | more[2::4] << 4 | more[3::4] << 6
    widest = int(more.max(initial=0)) + 1
    data = numbers.view(np.uint8).reshape(-1, 4)[:, :widest]
    if widest > 1:
        data = data[np.arange(widest, dtype=np.uint8) <= more[:len(numbers), None]]
    return kinds[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(width) - width
    raw = np.frombuffer(data, np.uint8)
    numbers = raw[begin].astype(np.uint32)
    for k in range(1, int(width.max(initial=1))):
        has = np.flatnonzero(width > k)
        numbers[has] |= raw[begin[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[numbers]


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts (null: empty), end each with ``end_id``, write blocks to ``path``.

    Documents are dealt by ranges of doc_id and sorted within them, so blocks follow each other
    by (part, block). Rows with equal doc_id are ordered by text; a null doc_id comes first.
    """
    vocab = vocab or vocabulary(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = numbered_encoder(vocab), TaskContext.get().partitionId()
        if end_id > np.iinfo(own.dtype).max:
            raise ValueError("the end id is none of the vocabulary's width")
        wide, end = own.dtype.itemsize, np.array(end_id, own.dtype).tobytes()
        held: list[bytes] = []
        ids_of: list[int | None] = []
        size = block = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), own.dtype)
            known = np.array([d is not None for d in ids_of])
            row = (part, block, next((d for d in ids_of if d is not None), None), len(held),
                   len(ids), np.array([d or 0 for d in ids_of], "<i8").tobytes(),
                   known.astype(np.uint8).tobytes(),
                   np.array([len(h) // wide for h in held], "<u4").tobytes(), *encode_block(ids))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(),
                     *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)],
                [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in sliced(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                own.encode(batch.column("text").to_pylist())):
                held.append(ids + end)
                ids_of.append(doc)
                size += len(held[-1]) // wide
                if size >= block_ids:
                    yield close()
                    held, ids_of, size, block = [], [], 0, block + 1
        if held:
            yield close()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = dealt.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (dealt.mapInArrow(write, BLOCKS).write.option("compression", "uncompressed").parquet(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the written blocks: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 and, if asked for, the ids.

    Sums run over the blocks of a part and then over parts, never over documents.
    """
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    sizes = blocks.select("part", "block", "n_ids").withColumn("inside", F.coalesce(
        F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)))
    begins = sizes.join(parts, "part").select(
        "part", "block", (F.col("inside") + F.col("base")).alias("begin"))
    schema = "doc_id long, part int, block int, inside long, n_tokens long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["ranked"], row["control"], row["data"], row["n_ids"])
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                docs, known = (np.frombuffer(row["doc_ids"], "<i8"),
                               np.frombuffer(row["known_ids"], np.uint8))
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip((ends - lengths).tolist(), ends.tolist()))
                columns = [
                    pa.array(docs, pa.int64(), mask=known == 0),
                    pa.array(np.full(len(docs), row["part"], np.int32)),
                    pa.array(np.full(len(docs), row["block"], np.int32)),
                    pa.array(ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in spans], pa.int64())]
                names = ["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype("i4") for a, b in spans],
                                            pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    found = blocks.select("part", "block", "n_ids", "doc_ids", "known_ids", "lengths", "ranked",
                          "control", "data").mapInArrow(read, schema)
    out = found.join(begins, ["part", "block"]).withColumn(
        "start", F.col("begin") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the tokens of ``docs`` (to a new folder of the shared store unless ``path`` names
    one) and return what the files hold.

    Null and empty texts hold the end id alone; repeated rows are written as often as they
    occur; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **kw)
    return read_tokens(docs.sparkSession, path)
