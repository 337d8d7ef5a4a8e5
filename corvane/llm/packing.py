"""Best-fit packing of documents into token sequences of a fixed length.

Best-fit decreasing takes the longest piece first and puts it where the least room is left. What
it does depends on lengths only, and there are at most ``capacity`` different lengths. So Spark
counts the pieces of each length, the plan is made on these counts (at most ``capacity`` numbers,
whatever the size of the corpus), and Spark looks up the place of each piece by its rank among
the pieces of its length. A segment tree over remaining capacities finds the tightest open bins
in logarithmic time; bins that are alike are handled as one interval of bin numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage, sliced
from corvane.llm.encoders import encoder, vocabulary

#: Tokens of a sequence.
CAPACITY = 4096
#: The id put behind each document.
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of one length that one task ranks.
RANKED_TOGETHER = 50_000
#: A plan of more runs than this is joined by a shuffle instead of a broadcast (60 bytes a run).
BROADCAST_RUNS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = ("length long, rank_from long, rank_to long, each long, sequence_from long, "
        "offset_from long")


class Room:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = self.leaves + room
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        k = self.leaves + need
        if self.count[k]:
            return need
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Runs (length, rank_from, rank_to, each, sequence_from, offset_from) of the packing.

    Piece number r of a length, rank_from <= r < rank_to, goes to sequence
    sequence_from + (r - rank_from) div each, at offset_from + (r - rank_from) mod each * length.
    It is the packing that best-fit decreasing makes piece by piece: a bin stays the tightest
    one for its length until it is too full for another piece of it.
    """
    room, open_bins, bins, runs = Room(capacity), {}, 0, []

    def put_back(left: int, first: int, n: int) -> None:
        if n and left:
            open_bins.setdefault(left, []).append((first, n))
            room.add(left, 1)

    for length in sorted((k for k in counts if k > 0), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = room.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = bins, -(-todo // each)
                bins += n
            else:
                first, n = open_bins[left].pop()
                room.add(left, -1)
                each = left // length
            full, rest = min(n, todo // each), 0
            if full < n:
                rest = todo - full * each
            taken = full * each + rest
            runs.append((length, rank, rank + taken, each, first, capacity - left))
            put_back(left - each * length, first, full)
            if rest:
                put_back(left - rest * length, first + full, 1)
                put_back(left, first + full + 1, n - full - 1)
            else:
                put_back(left, first + full, n - full)
            rank, todo = rank + taken, todo - taken
    return runs


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
               end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, end each with ``end_id``, cut those longer than ``capacity``.

    One row per piece: doc_id, piece (from 0), start, length, ids_crc32 of its ids as unsigned
    little-endian 32-bit numbers and, if asked for, the ids. Null texts count as empty and give
    one piece that holds the end id alone. No shuffle; texts reach Python in bounded slices.
    """
    path = path or vocabulary(VOCABULARY)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in sliced(batches, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                encode(batch.column("text").to_pylist())):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                for k, begin in enumerate(range(0, len(ids), capacity)):
                    part = ids[begin:begin + capacity]
                    for column, value in zip(rows, (doc, k, begin, len(part),
                                                    zlib.crc32(part.tobytes()), part)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(rows, kinds)]
            if with_ids:
                columns.append(pa.array([p.astype("i4") for p in rows[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece"),
          ) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice, so it should be a written table. Rows of one length are ranked in
    blocks of about ``RANKED_TOGETHER`` rows, dealt by a hash of ``order``, so a very frequent
    length is many groups. Rows that are alike in ``order`` may swap places. Other columns stay.
    """
    spark = pieces.sparkSession
    found = {r["length"]: r["n"] for r in
             pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_runs(found, capacity)
    blocks = spark.createDataFrame([(k, -(-n // RANKED_TOGETHER)) for k, n in found.items()],
                                   "length long, _blocks long")
    key = F.xxhash64(*order)
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn(
        "_block", F.pmod(key, F.col("_blocks")))
    before = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0)))
    local = dealt.withColumn("_local", F.row_number().over(
        W.partitionBy("length", "_block").orderBy(*order)) - 1)
    ranked = local.join(before.drop("_n"), ["length", "_block"]).withColumn(
        "_rank", F.col("_before") + F.col("_local"))
    runs = spark.createDataFrame(plan, RUNS)
    if len(plan) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    runs = runs.withColumnRenamed("length", "_length")
    placed = ranked.join(runs, (F.col("length") == F.col("_length"))
                         & (F.col("_rank") >= F.col("rank_from"))
                         & (F.col("_rank") < F.col("rank_to")))
    at = F.col("_rank") - F.col("rank_from")
    return placed.withColumns({
        "sequence_id": F.col("sequence_from") + F.expr("(_rank - rank_from) div each"),
        "offset": F.col("offset_from") + F.pmod(at, F.col("each")) * F.col("length"),
    }).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack whole documents; one row per piece with its sequence and the place in it.

    Only documents longer than ``capacity`` are cut. Null and empty texts are one piece of one
    token; rows that repeat are packed as often as they occur; null doc_ids are kept; an empty
    table gives none. Columns of ``docs`` other than doc_id and text are not read.
    """
    pieces = cut_lineage(cut_pieces(docs, path, capacity, end_id, with_ids))
    return place(pieces, capacity, ("doc_id", "piece", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from ``pack(..., with_ids=True)``: at most ``capacity``
    ids a row, so a group is bounded."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
