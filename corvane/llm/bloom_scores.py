"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts are quantised to levels on a log scale; an n-gram of level q is put into the filter q times,
as (n-gram, 1) ... (n-gram, q). A reader asks for level 1, 2, ... until a membership probe fails, so
an error can only raise a level, and large errors are exponentially rare. The filter is built in
parts, each in its own task from the n-grams whose hash falls into its range, and grows with the
number of distinct n-grams. It is broadcast in segments of a bounded size: texts meet one segment
after the other and carry the levels found so far, so nothing is left out when the filter is larger
than one broadcast.

Probabilities of an order interpolate the relative frequency with the next lower order. The weight
depends on the level of the context: it is the share of tokens whose n-gram is new when their own
text is left out (n-grams that were counted once), found from the levels of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage, sliced

ORDER = 2
#: Words with a share of at least 1 / HOT_WORDS of all tokens travel to the tasks; there can't be
#: more than HOT_WORDS of them (24 bytes each), however large the vocabulary is.
HOT_WORDS = 1 << 22
#: Bytes of the filter that are broadcast at once.
SEGMENT_BYTES = 128 << 20
#: N-grams (with repeats) that a part of the filter is made from.
PART_NGRAMS = 2_000_000
#: Filter bits per event, and bits that an event sets in one word of 64.
EVENT_BITS, SET_BITS = 10, 4
#: Levels grow by this factor.
BASE = 1.5
#: Tokens gathered before a task hands its distinct n-grams on; characters tokenised at once.
FLUSH_TOKENS, SLICE_CHARS = 1_000_000, 2_000_000
#: Words a process remembers, and the longest of them in bytes.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64

U = np.uint64


def level_floors(base: float = BASE) -> np.ndarray:
    """Smallest count of each level from 1."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(np.ceil(base ** len(out)))))
    return np.array(out, dtype=np.int64)


FLOORS = level_floors()
#: Expected count of each level: 0, then the geometric middle of what the level holds.
EXPECTED = np.append(0.0, np.sqrt(FLOORS.astype(float) * np.append(FLOORS[1:] - 1.0, FLOORS[-1])))
MASKS = np.array([sum(1 << int(b) for b in np.random.default_rng(k).choice(64, SET_BITS, False))
                  for k in range(4096)], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


#: Key of the word before the first; the end of a text is the empty word.
START = mix(np.array([0x51A7], dtype=U))[0]


def scaled(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The upper half of h as a number below n."""
    return ((h >> U(32)) * np.asarray(n).astype(U) >> U(32)).astype(np.int64)


# --- words and n-grams ------------------------------------------------------------------------

class Words(dict):
    """Numbers of words, with 128-bit digests that stand for the words from here on."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        number = len(self.digests) // 16
        self.digests += xxhash.xxh3_128_digest(word)
        if len(word) <= MEMO_BYTES:
            self[word] = number
        return number

    def halves(self) -> np.ndarray:
        return np.frombuffer(bytes(self.digests), dtype="<u8").reshape(-1, 2)

    def full(self) -> bool:
        return len(self.digests) > 16 * MEMO_WORDS


def tokens(words: Words, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all tokens, tokens per text); every text ends with the end token.

    Bytes are lower-cased and split as ASCII, which is what the rule for words says: letters
    A-Z, and white space 0x20 and 0x09 to 0x0D.
    """
    flat, sizes = [], []
    for text in texts:
        own = text.lower().split() if text else []
        own.append(b"")
        flat += own
        sizes.append(len(own))
    return (np.fromiter(map(words.__getitem__, flat), dtype=np.int64, count=len(flat)),
            np.array(sizes, dtype=np.int64))


def ngram_keys(word: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: keys of the n-grams that end in each token, and where there is one.

    The first token follows START; longer contexts begin at the second token.
    """
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(word)) - np.repeat(starts, sizes)
    keys, out = mix(word), []
    out.append((keys, np.ones(len(word), dtype=bool)))
    for m in range(2, order + 1):
        before = np.empty_like(keys)
        before[1:] = keys[:-1]
        if m == 2:
            before[starts] = START
        keys = mix(before * U(0x9E3779B97F4A7C15) + word + U(m))
        out.append((keys, place >= m - 2))
    return out


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, c): how often each word, the end token included, occurs in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(0, dtype=np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            halves = words.halves().view(np.int64)
            for b in range(0, len(counts), 100_000):
                part = slice(b, b + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[part, 0]), pa.array(halves[part, 1]), pa.array(counts[part])],
                    ["h1", "h2", "c"])

        for batch in sliced(batches, "text", SLICE_CHARS):
            found = np.bincount(tokens(words, texts_of(batch))[0])
            found[:len(counts)] += counts
            counts = found
            if words.full():
                yield from rows()
                words, counts = Words(), np.zeros(0, dtype=np.int64)
        yield from rows()

    return (docs.select("text").mapInArrow(count, "h1 long, h2 long, c long")
            .groupBy("h1", "h2").agg(F.sum("c").alias("c")))


# --- the filter -------------------------------------------------------------------------------

def event(keys: np.ndarray, level: np.ndarray | int, base: np.ndarray | int, n: np.ndarray | int
          ) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, mask in it) of the event (key, level) in a part at base with n words."""
    h = mix(keys + np.asarray(level).astype(U) * U(0xD1B54A32D192ED03))
    return base + scaled(h, n), MASKS[h & U(4095)]


def filter_part(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(words of the filter, events) that hold the levels of distinct keys."""
    levels = np.searchsorted(FLOORS, counts, side="right")
    events = int(levels.sum())
    n = max(1, -(-events * EVENT_BITS // 64))
    level = np.arange(events) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    place, mask = event(np.repeat(keys, levels), level, 0, n)
    order = np.argsort(place, kind="stable")
    place, mask = place[order], mask[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    words = np.zeros(n, dtype=U)
    words[place[first]] = np.bitwise_or.reduceat(mask, first)
    return words, events


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def count_filter(docs: DataFrame, n_tokens: int, order: int) -> DataFrame:
    """(part, parts, n_ngrams, n_events, words): the filter of all n-grams up to ``order``.

    Tasks hand on their distinct n-grams with counts, packed by part, so a frequent n-gram takes
    one entry per FLUSH_TOKENS; the keys of a part are spread by hash, so parts are alike.
    """
    parts = max(1, -(-n_tokens * order // PART_NGRAMS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, begun = Words(), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            part = scaled(found, parts)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            for a, b in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[a]], pa.int32()), pa.array([found[a:b].tobytes()], pa.binary()),
                     pa.array([counts[a:b].astype("<u4").tobytes()], pa.binary())],
                    ["part", "keys", "counts"])

        for batch in sliced(batches, "text", SLICE_CHARS):
            ids, sizes = tokens(words, texts_of(batch))
            grams = ngram_keys(words.halves()[ids, 0], sizes, order)
            keys += [k[there] for k, there in grams] + [np.full(len(sizes), START)]
            begun += len(ids)
            if begun >= FLUSH_TOKENS:
                yield from rows()
                keys, begun = [], 0
            if words.full():
                words = Words()
        if keys:
            yield from rows()

    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b, dtype=U) for b in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, dtype="<u4")
                                 for b in table.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = summed(keys, counts)
        words, events = filter_part(keys, counts)
        return pa.table({"part": table.column("part")[:1], "parts": pa.array([parts], pa.int32()),
                         "n_ngrams": pa.array([len(keys)], pa.int64()),
                         "n_events": pa.array([events], pa.int64()),
                         "words": pa.array([words.tobytes()], pa.binary())})

    return (docs.select("text").mapInArrow(emit, "part int, keys binary, counts binary")
            .groupBy("part").applyInArrow(
                build, "part int, parts int, n_ngrams long, n_events long, words binary"))


class Segment:
    """Neighbouring parts of the filter, in one array."""

    def __init__(self, parts: int, low: int, sizes: np.ndarray, words: np.ndarray):
        self.parts, self.low, self.words = parts, low, words
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of the keys by probes for 1, 2, ...; 0 for those of other segments."""
        found = np.zeros(len(keys), dtype=np.uint8)
        part = scaled(keys, self.parts) - self.low
        open_ = np.flatnonzero((part >= 0) & (part < len(self.sizes)))
        open_ = open_[self.sizes[part[open_]] > 0]
        base, n, keys = self.starts[part[open_]], self.sizes[part[open_]], keys[open_]
        for level in range(1, len(FLOORS) + 1):
            if not len(open_):
                break
            place, mask = event(keys, level, base, n)
            there = self.words[place] & mask == mask
            open_, base, n, keys = open_[there], base[there], n[there], keys[there]
            found[open_] = level
        return found


def segments(parts: DataFrame, most_bytes: int) -> Iterator[Segment]:
    """The filter's segments, one at a time, each below ``most_bytes`` or a single part."""
    sizes = [(r["part"], r["parts"], r["n"]) for r in
             parts.select("part", "parts", F.octet_length("words").alias("n")).orderBy("part").collect()]
    begin = 0
    while begin < len(sizes):
        end, total = begin, 0
        while end < len(sizes) and (end == begin or total + sizes[end][2] <= most_bytes):
            total += sizes[end][2]
            end += 1
        low, high = sizes[begin][0], sizes[end - 1][0]
        rows = parts.where(F.col("part").between(low, high)).select("part", "words").toArrow()
        held = dict(zip(rows.column("part").to_pylist(), rows.column("words").to_pylist()))
        lengths = np.array([len(held.get(p, b"")) // 8 for p in range(low, high + 1)], dtype=np.int64)
        words = b"".join(held.get(p, b"") for p in range(low, high + 1))
        yield Segment(sizes[begin][1], low, lengths, np.frombuffer(words, dtype=U))
        begin = end
    if not sizes:
        yield Segment(1, 0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=U))


# --- scores -----------------------------------------------------------------------------------

def log_probabilities(levels: np.ndarray, novel: np.ndarray, start: int, n: int, v: int) -> float:
    """The model's log10 probability of one text from the levels of its n-grams.

    ``levels``: one row per order, one column per token. ``novel[m, q]``: the weight of the lower
    order behind a context of level q, for order m + 1.
    """
    p = (EXPECTED[levels[0]] + 1) / (n + v + 1)
    for m in range(1, len(levels)):
        context = np.append(start if m == 1 else 0, levels[m - 1][:-1])
        held = np.minimum(levels[m], context)  # no n-gram is more frequent than its context
        weight = novel[m][context]
        deeper = weight * p + (1 - weight) * EXPECTED[held] / np.maximum(EXPECTED[context], 1)
        p = np.where(context > 0, deeper, p)
    return float(np.log10(p).sum())


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER, hot_words: int = HOT_WORDS,
                    segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Log10 probabilities of whole texts by a model of the texts that are not held out.

    Columns: doc_id, held_out, n_tokens (words and the end), n_known (tokens that occur in training
    texts), train_tokens, base_score (exact add-one unigram model), score (the filter's model of
    ``order``). One row per row of ``docs``, also for null or repeated doc_ids; a null or empty text
    is its end token alone. ``held_out`` null counts as false. Without training texts no token is
    known and base_score and score are 0, the logarithm of 1. Other columns of ``docs`` are ignored.

    Exact counts: words are 128-bit digests. Counts of frequent words travel to the tasks (see
    HOT_WORDS); the others are joined, one row per text and distinct rare word, so no key of that
    join has a large share. Broadcasts are bounded by ``hot_words`` and ``segment_bytes``.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    train = docs.where(~F.col("held_out"))
    counts = cut_lineage(word_counts(train))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    frequent = F.col("c") * hot_words >= n
    hot = counts.where(frequent).toArrow()
    hot = np.stack([hot.column(c).to_numpy() for c in ("h1", "h2", "c")], 1) if hot.num_rows else (
        np.zeros((0, 3), dtype=np.int64))
    hot = spark.sparkContext.broadcast(hot[np.argsort(hot[:, 0])])
    filter_parts = cut_lineage(count_filter(train, n, order))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, "
              "rare array<struct<h1:long,h2:long,k:long>>, levels binary, start int")

    def reader(held, first: bool, keep_text: bool):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, segment = Words(), held.value
            known = Exact(hot.value)
            for batch in sliced(batches, "text", SLICE_CHARS):
                if words.full():
                    words, known = Words(), Exact(hot.value)
                ids, sizes = tokens(words, texts_of(batch))
                halves = words.halves()
                found = [unique_levels(segment, k, there)
                         for k, there in ngram_keys(halves[ids, 0], sizes, order)]
                start = segment.levels(START[None])[0]
                ends = np.cumsum(sizes)
                if not first:
                    old = batch.column("levels").to_pylist()
                    found = [np.maximum(f, np.concatenate(
                        [np.frombuffer(b, np.uint8).reshape(order, -1)[m] for b in old]))
                        for m, f in enumerate(found)]
                    start = np.maximum(start, batch.column("start").to_numpy())
                levels = [b"".join(f[e - s:e].tobytes() for f in found) for e, s in zip(ends, sizes)]
                out = dict(zip(("doc_id", "held_out"), batch.columns[:2]))
                if first:
                    out |= known.totals(ids, sizes, halves)
                else:
                    out |= {c: batch.column(c) for c in ("n_tokens", "n_known", "logs", "rare")}
                out |= {"levels": pa.array(levels, pa.binary()),
                        "start": pa.array(np.broadcast_to(start, len(sizes)), pa.int32())}
                if keep_text:
                    out["text"] = batch.column("text")
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

        return read

    rows, first, left = docs, True, segments(filter_parts, segment_bytes)
    segment = next(left)
    while segment is not None:
        after = next(left, None)
        held = spark.sparkContext.broadcast(segment)
        rows = rows.mapInArrow(reader(held, first, after is not None),
                               schema + (", text string" if after is not None else ""))
        if after is None:
            rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows, first, segment = cut_lineage(rows), False, after

    novel = novelty(rows.where(~F.col("held_out")), order)
    rare = (rows.select("row", F.explode("rare").alias("r")).select("row", "r.*")
            .join(counts.where(~frequent), ["h1", "h2"])
            .groupBy("row").agg(F.sum("k").alias("more_known"),
                                F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_logs")))
    rows = rows.drop("rare").join(rare, "row", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [log_probabilities(np.frombuffer(b, np.uint8).reshape(order, -1), novel, s, n, v)
                      for b, s in zip(batch.column("levels").to_pylist(),
                                      batch.column("start").to_pylist())]
            columns = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "logs")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64())], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]
    out = rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"), "levels", "start"
    ).mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, "
                        "logs double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score")


def unique_levels(segment: Segment, keys: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Levels of the n-grams of a slice, each distinct one probed once; 0 where there is none."""
    kinds, numbers = np.unique(keys[there], return_inverse=True)
    out = np.zeros(len(keys), dtype=np.uint8)
    out[there] = segment.levels(kinds)[numbers.reshape(-1)]
    return out


class Exact:
    """Exact counts of the words of a memo: those of frequent words, -1 for the others."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.counts = hot, np.zeros(0, dtype=np.int64)

    def learn(self, halves: np.ndarray) -> None:
        fresh = halves[len(self.counts):].view(np.int64)
        if not len(self.hot):
            found = np.full(len(fresh), -1)
        else:
            at = np.minimum(np.searchsorted(self.hot[:, 0], fresh[:, 0]), len(self.hot) - 1)
            found = np.where((self.hot[at, 0] == fresh[:, 0]) & (self.hot[at, 1] == fresh[:, 1]),
                             self.hot[at, 2], -1)
        self.counts = np.append(self.counts, found)

    def totals(self, ids: np.ndarray, sizes: np.ndarray, halves: np.ndarray) -> dict[str, pa.Array]:
        """Per text: tokens, known ones, sum of log10(c + 1), and its rare words with counts."""
        self.learn(halves)
        c = self.counts[ids]
        ends = np.append(0, np.cumsum(sizes))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        unknown = c < 0
        pairs, k = np.unique(doc[unknown] * len(halves) + ids[unknown], return_counts=True)
        h = halves.view(np.int64)[pairs % len(halves)]
        rare = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(halves)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(k)],
                                       ["h1", "h2", "k"]))
        logs = np.add.reduceat(np.log10(np.maximum(c, 0) + 1.0), ends[:-1])
        return {"n_tokens": pa.array(sizes), "n_known": pa.array(sums(c > 0)),
                "logs": pa.array(logs), "rare": rare}


def novelty(rows: DataFrame, order: int) -> np.ndarray:
    """novel[m, q]: share of tokens behind a context of level q whose (m + 1)-gram is new.

    Over all training texts: an n-gram that was counted once is new when its own text is left out.
    One token of each kind is added, so that no share is 0 or 1.
    """
    size = len(FLOORS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, order, size), dtype=np.int64)
        for batch in batches:
            for data, start in zip(batch.column("levels").to_pylist(), batch.column("start").to_pylist()):
                levels = np.frombuffer(data, np.uint8).reshape(order, -1)
                for m in range(1, order):
                    context = np.append(start if m == 1 else 0, levels[m - 1][:-1])
                    total[0, m] += np.bincount(context, minlength=size)
                    total[1, m] += np.bincount(context[levels[m] <= 1], minlength=size)
        kind, m, q = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(m, pa.int32()), pa.array(q, pa.int32()),
             pa.array(np.where(kind == 0, total[kind, m, q], 0)),
             pa.array(np.where(kind == 1, total[kind, m, q], 0))], ["m", "q", "n", "new"])

    found = rows.select("levels", "start").mapInArrow(count, "m int, q int, n long, new long")
    novel = np.full((order, size), 0.5)
    for r in found.groupBy("m", "q").agg(F.sum("n").alias("n"), F.sum("new").alias("new")).collect():
        novel[r["m"], r["q"]] = (r["new"] + 1) / (r["n"] + 2)
    return novel
