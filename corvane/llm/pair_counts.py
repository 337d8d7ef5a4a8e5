"""Alignment of two tokenizers over a corpus, with counts of linked id pairs by perfect hashing.

Both vocabularies cut a text before a space or line break that stands between other characters, so
a text is a row of segments that are encoded and aligned once each; processes remember segments.

Distinct id pairs are dealt to shards by hash. Each shard gets a minimal perfect hash: levels of
bit arrays in which a key is placed where no other key of its level falls, the others going to the
next level; the rank of its bit is its number. The key of each number is kept, so a lookup is
verified. Counts are dense vectors indexed by these numbers, made per shard and lane of tasks and
summed in a tree. The second pass aligns the texts again and looks counts up in groups of shards of
a bounded size, one broadcast after the other.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage, sliced
from corvane.llm.encoders import BYTE_LETTERS, vocabulary

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS, LANES = 64, 16
#: Bits of a level for each key that is still to be placed.
SPREAD = 1.5
#: Bytes of tables (hash, keys and counts) that are broadcast at once.
TABLE_BYTES = 96 << 20
#: Segments a process remembers, and the longest of them in characters.
MEMO_SEGMENTS, MEMO_CHARS = 700_000, 64
#: Characters aligned at once.
SLICE_CHARS = 2_000_000
#: Distinct pairs that a task gathers before it hands them on.
FLUSH_PAIRS = 1_000_000

U = np.uint64
#: A cut is safe before one space or line break with other characters on both sides.
CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space that makes a text irregular: all others are cut at every space and line break.
IRREGULAR = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z")


# --- aligned segments -------------------------------------------------------------------------

def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of all tokens of two cuts of the same bytes whose byte ranges overlap."""
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    low = np.searchsorted(ends_b, starts_a, side="right")
    sizes = np.searchsorted(starts_b, ends_a, side="left") - low
    i = np.repeat(np.arange(len(ends_a)), sizes)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[i]


def groups_of(names_a: list[str], names_b: list[str], ends_a: np.ndarray, ends_b: np.ndarray
              ) -> list[str]:
    """Tokens between the places where both cuts end one, as ``a1,a2|b1``."""
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    cuts = zip(*(np.append(0, np.searchsorted(e, shared) + 1).tolist() for e in (ends_a, ends_b)))
    out, (i0, j0) = [], next(cuts)
    for i, j in cuts:
        out.append(f"{','.join(names_a[i0:i])}|{','.join(names_b[j0:j])}")
        i0, j0 = i, j
    return out


def counted(ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each of the ranges that end at ``ends``."""
    return np.diff(np.append(0, np.searchsorted(places, ends, side="right")))


class Numbers(dict):
    """Numbers of segments in the order they are met; long ones are met anew each time."""

    def __init__(self):
        super().__init__()
        self.next, self.fresh = 0, []

    def __missing__(self, key: str) -> int:
        number = self.next
        self.next = number + 1
        self.fresh.append(key)
        if len(key) <= MEMO_CHARS:
            self[key] = number
        return number


class Aligner:
    """Segments by number, with the ids of both vocabularies aligned."""

    def __init__(self, path_a: str, path_b: str, name_groups: bool, memo: int = MEMO_SEGMENTS):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if size_a * self.size_b >= 1 << 32:
            raise ValueError("pairs of these vocabularies don't fit 32 bits")
        letter = {c: b for b, c in BYTE_LETTERS.items()}
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            known = all(c in letter for c in entry)
            self.bytes_a[number] = bytes(map(letter.get, entry)) if known else entry.encode()
        self.bytes_b = []
        for number in range(self.size_b):
            piece = self.b.id_to_piece(number)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(number)
                                else piece.replace("▁", " ").encode())
        #: False for a model with pieces that reach over a cut: its texts are one segment each.
        self.cuts = not any(re.search(r"\S[ \n]|\n.", p.decode("utf-8", "replace"))
                            for p in self.bytes_b)
        self.long_a, self.long_b = (np.array([len(x) for x in parts], dtype=np.int64)
                                    for parts in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ([str(k) for k in range(len(parts))]
                                      for parts in (self.bytes_a, self.bytes_b))
        self.marks = {c: self.a.encode(c, add_special_tokens=False).ids[0] for c in ".,"}
        self.memo, self.name_groups = memo, name_groups
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        #: Per segment: tokens of a, of b, groups, links, and whether both give its bytes back.
        self.facts = array("q")
        self.groups: list[bytes] = []
        self.pairs, self.pair_ends = array("I"), array("q", [0])

    def full(self) -> bool:
        return self.numbers.next > self.memo

    def keys(self, text: str) -> list[str]:
        """The segments of a space and the text; that space is left out where no other follows."""
        if not self.cuts:
            return [" " + text]
        if not IRREGULAR.search(text):
            return text.replace("\n", " \n").split(" ")
        return [s if s[0] == "\n" or s[1:2].isspace() or s == " " else s[1:]
                for s in CUTS.split(" " + text)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments. Plain words go to the merges of the first vocabulary straight away."""
        merge, marks, out, rest = self.a.model.tokenize, self.marks, [], []
        for k, text in enumerate(texts):
            mark = marks.get(text[-1]) if text[0] == " " else None
            word = text[1:] if mark is None else text[1:-1]
            if word.isalpha() and text[0] == " ":
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = [t.id for t in merge("Ġ" + word)]
                out.append(ids if mark is None else ids + [mark])
            else:
                out.append([])
                rest.append(k)
        found = self.a.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        for k, encoded in zip(rest, found):
            out[k] = encoded.ids
        encoded_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for k, text in enumerate(texts):
            if text[0] != " ":  # the model put a space before the line break
                encoded_b[k] = encoded_b[k][1:]
        return out, encoded_b

    def learn(self, keys: list[str]) -> None:
        """Encode and align segments, in the order of their numbers."""
        texts = [k if k[:1] in ("\n", " ") else " " + k for k in keys]
        a, b = self.encode(texts)
        good = [True] * len(texts)
        flat = [x for ids in a for x in ids], [x for ids in b for x in ids]
        data = "".join(texts).encode()
        if any(b"".join(map(parts.__getitem__, ids)) != data
               for parts, ids in zip((self.bytes_a, self.bytes_b), flat)):
            good = [b"".join(map(self.bytes_a.__getitem__, x)) == b"".join(map(self.bytes_b.__getitem__, y))
                    == t.encode() for t, x, y in zip(texts, a, b)]
            a, b = ([ids if g else [] for g, ids in zip(good, each)] for each in (a, b))
            flat = [x for ids in a for x in ids], [x for ids in b for x in ids]
        flat_a, flat_b = (np.array(x, dtype=np.int64) for x in flat)
        ends_a, ends_b = np.cumsum(self.long_a[flat_a]), np.cumsum(self.long_b[flat_b])
        sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
        ends = np.append(0, ends_a)[np.cumsum(sizes[:, 0])]
        i, j = links_of(ends_a, ends_b)
        n_links = counted(np.cumsum(sizes[:, 0]) - 1, i)
        n_groups = counted(ends, np.intersect1d(ends_a, ends_b, assume_unique=True))
        if self.name_groups:
            groups = groups_of(list(map(self.names_a.__getitem__, flat[0])),
                               list(map(self.names_b.__getitem__, flat[1])), ends_a, ends_b)
            cuts = np.cumsum(n_groups).tolist()
            self.groups += [";".join(groups[x:y]).encode() for x, y in zip([0, *cuts], cuts)]
        self.facts.frombytes(np.column_stack([sizes, n_groups, n_links, np.array(good, dtype=np.int64)]
                                             ).astype(np.int64).tobytes())
        self.pair_ends.frombytes((len(self.pairs) + np.cumsum(n_links)).tobytes())
        self.pairs.frombytes((flat_a[i] * self.size_b + flat_b[j]).astype(np.uint32).tobytes())

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the segments of all texts, segments per text); empty texts have none."""
        split = [self.keys(t) if t else [] for t in texts]
        numbers = np.fromiter((n for keys in split for n in map(self.numbers.__getitem__, keys)),
                              dtype=np.int64, count=sum(map(len, split)))
        if self.numbers.fresh:
            self.learn(self.numbers.fresh)
            self.numbers.fresh = []
        return numbers, np.array([len(s) for s in split], dtype=np.int64)

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``align``, without the segments of texts that either vocabulary changes.

        Also the facts of all segments, one row each.
        """
        numbers, sizes = self.align(texts)
        facts = np.array(self.facts).reshape(-1, 5)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        broken = np.bincount(doc, facts[numbers, 4] == 0, len(sizes)) > 0
        keep = ~broken[doc]
        return numbers[keep], np.where(broken, 0, sizes), facts


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, name_groups: bool = False) -> Aligner:
    """The aligner of this process; tasks of one worker and pass share its memo."""
    return Aligner(path_a, path_b, name_groups)


# --- minimal perfect hash ---------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


def bit_of(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where a key falls in the array of a level."""
    h = mix(keys + np.array([level + 1], dtype=U) * U(0x9E3779B97F4A7C15))
    return ((h >> U(32)) * U(bits) >> U(32)).astype(np.int64)


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % U(SHARDS)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys: the rank of each key's bit."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words  # bits of each level, all levels' bits in one array
        self.ranks = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            bits = -(-max(64, int(SPREAD * len(keys))) // 64) * 64
            place = bit_of(keys, len(sizes), bits)
            counts = np.bincount(place, minlength=bits)
            words.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            sizes.append(bits)
            keys = keys[counts[place] > 1]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, dtype="<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where no level holds its bit; others' keys may get any."""
        out, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes):
            place = base + bit_of(keys[left], level, bits)
            word, bit = self.words[place >> 6], (place & 63).astype(U)
            there = (word >> bit & U(1)).astype(bool)
            below = np.bitwise_count(word & ((U(1) << bit) - U(1))).astype(np.int64)
            out[left[there]] = (self.ranks[place >> 6] + below)[there]
            left, base = left[~there], base + bits
        return out


class Counts:
    """Counts of one shard: a perfect hash, the key of each number, and the dense vector."""

    def __init__(self, sizes: bytes, words: bytes, keys: bytes, counts: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, "<i8").tolist(), np.frombuffer(words, "<u8"))
        self.keys, self.counts = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys; 0 for a key that is not in the table."""
        at = self.hash.find(keys)
        known = at >= 0
        known[known] = self.keys[at[known]] == keys[known]
        return np.where(known, self.counts[np.where(known, at, 0)] if len(self.counts) else 0, 0)


# --- first pass -------------------------------------------------------------------------------

def document_pairs(numbers: np.ndarray, sizes: np.ndarray, own: Aligner) -> np.ndarray:
    """Each distinct pair of each text once."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kinds = np.unique(doc * max(1, own.numbers.next) + numbers)
    doc, numbers = np.divmod(kinds, max(1, own.numbers.next))
    ends = np.array(own.pair_ends)
    count = ends[numbers + 1] - ends[numbers]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[numbers], count)
    pairs = np.array(own.pairs).astype(np.int64)[at]
    return np.unique(np.repeat(doc, count) << 32 | pairs) & ((1 << 32) - 1)


def merged_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(kinds), dtype=np.int64)
    np.add.at(total, at.reshape(-1), np.concatenate(counts))
    return kinds, total


def pair_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(shard, lane, keys, counts): in how many texts of a task each pair is linked."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lane = aligner(*paths), TaskContext.get().partitionId() % LANES
        keys, counts, held = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            kinds, total = merged_counts(keys, counts)
            shard = shard_of(kinds)
            for s in np.unique(shard):
                mine = shard == s
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([lane], pa.int32()),
                     pa.array([kinds[mine].tobytes()], pa.binary()),
                     pa.array([total[mine].tobytes()], pa.binary())],
                    ["shard", "lane", "keys", "counts"])

        for batch in sliced(batches, "text", SLICE_CHARS):
            if own.full():
                own.forget()
            numbers, sizes, _ = own.aligned(batch.column("text").to_pylist())
            kinds, total = np.unique(document_pairs(numbers, sizes, own), return_counts=True)
            keys.append(kinds.astype(U))
            counts.append(total)
            held += len(kinds)
            if held > 2 * FLUSH_PAIRS:
                joined = merged_counts(keys, counts)
                keys, counts, held = [joined[0]], [joined[1]], len(joined[0])
                if held > FLUSH_PAIRS:
                    yield from rows()
                    keys, counts, held = [], [], 0
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(emit, "shard int, lane int, keys binary, counts binary")


def arrays(table: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=kind) for b in table.column(column).to_pylist()]


def pair_table(pairs: DataFrame) -> DataFrame:
    """(shard, n, sizes, words, keys, counts): perfect hash and count vector of each shard.

    ``pairs`` is read twice. Keys meet by lane and then by shard; the counts of a lane become a
    dense vector over the shard's numbers, and the vectors of all lanes are added up.
    """

    def lane_keys(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(arrays(table, "keys", "<u8")))
        return pa.table({"shard": table.column("shard")[:1],
                         "keys": pa.array([keys.tobytes()], pa.binary())})

    def hashed(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(arrays(table, "keys", "<u8")))
        own = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[own.find(keys)] = keys
        return pa.table({
            "shard": table.column("shard")[:1], "n": pa.array([len(keys)], pa.int64()),
            "sizes": pa.array([np.array(own.sizes, "<i8").tobytes()], pa.binary()),
            "words": pa.array([own.words.tobytes()], pa.binary()),
            "keys": pa.array([ordered.tobytes()], pa.binary())})

    hashes = cut_lineage(
        pairs.groupBy("shard", "lane").applyInArrow(lane_keys, "shard int, keys binary")
        .groupBy("shard").applyInArrow(hashed, "shard int, n long, sizes binary, words binary, keys binary"))

    def lane_vector(own: pa.Table, held: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        find = PerfectHash(arrays(held, "sizes", "<i8")[0].tolist(), arrays(held, "words", "<u8")[0]).find
        vector = np.zeros(held.column("n")[0].as_py(), dtype="<i8")
        for keys, counts in zip(arrays(own, "keys", "<u8"), arrays(own, "counts", "<i8")):
            vector[find(keys)] += counts  # the keys of a row are distinct
        return pa.table({"shard": own.column("shard")[:1],
                         "counts": pa.array([vector.tobytes()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = sum(arrays(table, "counts", "<i8"))
        return pa.table({"shard": table.column("shard")[:1],
                         "counts": pa.array([total.tobytes()], pa.binary())})

    to_lanes = hashes.select("shard", "n", "sizes", "words", F.explode(
        F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"))
    vectors = pairs.groupBy("shard", "lane").cogroup(to_lanes.groupBy("shard", "lane")).applyInArrow(
        lane_vector, "shard int, counts binary")
    sums = vectors.groupBy("shard").applyInArrow(added, "shard int, counts binary")
    return hashes.join(sums, "shard")


def best_counts(table: DataFrame, size_b: int) -> np.ndarray:
    """The highest count of any pair of each id of the first vocabulary; its size is the bound."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts"))):
                a = (np.frombuffer(keys, "<u8") // U(size_b)).astype(np.int64)
                top = np.zeros(int(a.max()) + 1 if len(a) else 0, dtype=np.int64)
                np.maximum.at(top, a, np.frombuffer(counts, "<i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.flatnonzero(top)), pa.array(top[top > 0])], ["a", "best"])

    rows = table.select("keys", "counts").mapInArrow(highest, "a long, best long")
    found = rows.groupBy("a").agg(F.max("best").alias("best")).toArrow()
    a, best = (found.column(c).to_numpy() for c in ("a", "best"))
    out = np.zeros(int(a.max()) + 1 if len(a) else 1, dtype=np.int64)
    out[a] = best
    return out


# --- second pass ------------------------------------------------------------------------------

def table_groups(table: DataFrame, most_bytes: int) -> list[list[int]]:
    """Shards in groups of at most ``most_bytes``, or of one shard."""
    sizes = table.select("shard", sum(F.octet_length(c) for c in ("words", "keys", "counts")).alias("n"))
    groups: list[list[int]] = []
    total = 0
    for row in sizes.orderBy("shard").collect():
        if not groups or total + row["n"] > most_bytes:
            groups.append([])
            total = 0
        groups[-1].append(row["shard"])
        total += row["n"]
    return groups or [[]]


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
                    table_bytes: int = TABLE_BYTES) -> DataFrame:
    """How the two vocabularies cut each text, and how common the linked id pairs are.

    Columns: doc_id, n_a, n_b (tokens of a space and the text), n_groups (byte ranges between places
    where both end a token), n_links (pairs of overlapping tokens), n_best (links whose pair is in as
    many texts as the best pair of its first id), count_sum (texts that hold the pair, summed over
    links), groups_sha256. The first file is a byte-level vocabulary of the ``tokenizers`` library,
    the second a ``sentencepiece`` model that adds the space itself; strings of special tokens are
    plain text.

    One row per row of ``docs``, also for null or repeated doc_ids, each counted as a text. Null and
    empty texts, and texts that either vocabulary doesn't give back byte for byte, have zeros and an
    empty groups_sha256. Other columns are ignored.

    Both vocabularies bound the pairs. When the table is larger than ``table_bytes``, the
    second pass is made for one group of shards after the other and its sums are added.
    """
    paths = path_a or vocabulary(VOCABULARY_A), path_b or vocabulary(VOCABULARY_B)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = cut_lineage(pair_table(cut_lineage(pair_rows(docs, paths))))
    size_b = aligner(*paths).size_b
    best = spark.sparkContext.broadcast(best_counts(table, size_b))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def reader(held, shards: list[int], first: bool, last: bool):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tops = aligner(*paths, True), best.value
            counts = {s: Counts(*data) for s, data in held.value.items()}
            sums = SegmentSums(own, counts, tops)
            for batch in sliced(batches, "text", SLICE_CHARS):
                if own.full():
                    own.forget()
                    sums = SegmentSums(own, counts, tops)
                numbers, sizes, facts = own.aligned(batch.column("text").to_pylist())
                sums.learn()
                ends = np.append(0, np.cumsum(sizes))
                total = lambda v: np.diff(np.append(0, np.cumsum(v[numbers]))[ends])
                more = [total(sums.best), total(sums.counts)]
                if first:
                    groups = [b";".join(map(own.groups.__getitem__, numbers[a:b].tolist()))
                              for a, b in zip(ends, ends[1:])]
                    columns = [*(pa.array(total(facts[:, k])) for k in range(4)), *map(pa.array, more),
                               pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups])]
                else:
                    columns = [*(batch.column(c) for c in names[:4]),
                               *(pa.array(batch.column(c).to_numpy() + m) for c, m in zip(names[4:], more)),
                               batch.column("groups_sha256")]
                rest = [] if last else [batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *columns, *rest],
                    ["doc_id", *names, "groups_sha256", *([] if last else ["text"])])

        return read

    groups, rows = table_groups(table, table_bytes), docs
    for k, shards in enumerate(groups):
        found = table.where(F.col("shard").isin(shards)) if shards else table.limit(0)
        found = found.select("shard", "sizes", "words", "keys", "counts").collect()
        held = spark.sparkContext.broadcast({r["shard"]: tuple(map(bytes, r[1:])) for r in found})
        last = k == len(groups) - 1
        rows = rows.mapInArrow(
            reader(held, shards, k == 0, last),
            f"doc_id {id_type}, {', '.join(f'{c} long' for c in names)}, groups_sha256 string"
            + ("" if last else ", text string"))
        if not last:
            rows = cut_lineage(rows)
    return rows


class SegmentSums:
    """Per segment of a memo: links that are the best of their id, and the sum of their counts."""

    def __init__(self, own: Aligner, counts: dict[int, Counts], tops: np.ndarray):
        self.own, self.table, self.tops = own, counts, tops
        self.best = self.counts = np.zeros(0, dtype=np.int64)

    def learn(self) -> None:
        """Look up the pairs of segments that came since the last call."""
        done, ends = len(self.best), np.array(self.own.pair_ends)
        pairs = np.array(self.own.pairs[ends[done]:], dtype=U)
        kinds, at = np.unique(pairs, return_inverse=True)
        shard, found = shard_of(kinds), np.zeros(len(kinds), dtype=np.int64)
        for s in np.unique(shard):
            if int(s) in self.table:
                mine = shard == s
                found[mine] = self.table[int(s)].lookup(kinds[mine])
        a = np.minimum((kinds // U(self.own.size_b)).astype(np.int64), len(self.tops) - 1)
        is_best = ((found > 0) & (found == self.tops[a])).astype(np.int64)
        cuts = ends[done:] - ends[done]
        sums = lambda v: np.diff(np.append(0, np.cumsum(v[at.reshape(-1)]))[cuts])
        self.best, self.counts = np.append(self.best, sums(is_best)), np.append(self.counts, sums(found))
