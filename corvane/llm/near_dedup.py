"""Near-duplicate documents: banded MinHash, odd sketches, and a check on full shingle sets.

1. Each document becomes its set of word shingles, ``SAMPLES`` MinHash values of it, the band
   keys of these, and an odd sketch: the samples fold into a bitmap by parity, so the bits in
   which two sketches differ tell how many samples differ. At high similarity that is far more
   precise than comparing few samples.
2. Documents with equal sets are one class with the smallest doc_id as representative; only
   representatives go on, so copies are never paired.
3. Representatives that share a band key form a bucket. Members of a bucket are compared with
   its first and its last member by a hash order, not with each other: sketch first, and what
   passes is confirmed on the full sets. Links join members into components.
4. Buckets whose members still lie in several components are the rest: there, all members are
   compared in blocks, sketches first and then full sets, so no candidate link is lost. A block
   returns which members it joins, not its pairs.

A pair with similarity 0.8 or more shares no band with a probability below 3e-9, and the sketch
filter drops it with a probability below 1e-9 (``MOST_APART``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chained, cut_lineage, local_roots, sliced

BANDS, ROWS = 50, 5
SAMPLES = BANDS * ROWS
#: 64-bit words of an odd sketch.
SKETCH_WORDS = 16
#: Words of a shingle and the similarity, as a fraction, from which documents are linked.
SHINGLE, LINK = 5, (4, 5)

#: Members and shingles of a tile of a bucket, about.
TILE_ROWS, TILE_SHINGLES = 2048, 2_000_000

_SIGNED = np.int64


def _families(seed: int = 20240229) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return (odd, rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32),
            rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1))


ODD, SHIFT, SALT = _families()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words than a shingle are
    one shingle; a null text or one without words has none.
    """
    from xxhash import xxh3_64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(each))
    out = np.full(len(each) - size + 1, len(parts) if len(parts) < words else 0, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + each[k:len(each) - size + 1 + k])
    return np.unique(out)


def set_key(shingles: bytes) -> bytes:
    """What equal sets share and different sets don't."""
    return blake2b(shingles, digest_size=16).digest()


def min_hashes(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """``SAMPLES`` minima of the shingles under as many 32-bit multiply-add orders."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), block):
        values = np.multiply.outer(ODD, low[begin:begin + block])
        values += SHIFT[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmap in which each (order, minimum) flips one bit, as signed 64-bit words."""
    bit = mixed(samples.astype(np.uint64) * SALT + SALT) % np.uint64(64 * SKETCH_WORDS)
    flips = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(flips.astype(np.uint8)).view(_SIGNED)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(_SIGNED)


def apart(similarity: float, sigmas: float = 6.0) -> int:
    """Bits in which two sketches differ at most, unless ``similarity`` is missed by luck.

    Of SAMPLES samples, (1 - s) SAMPLES differ, give or take ``sigmas`` deviations; each flips
    two random bits of the XOR, which add up to an odd count with probability
    (1 - exp(-4 d / bits)) / 2; again with as many deviations.
    """
    bits = 64 * SKETCH_WORDS
    wide = sigmas / 2 ** 0.5
    differ = (SAMPLES * (1 - similarity)
              + wide * (SAMPLES * similarity * (1 - similarity)) ** 0.5)
    odd = (1 - np.exp(-4 * differ / bits)) / 2
    return int(np.ceil(bits * odd + wide * (bits * odd * (1 - odd)) ** 0.5))


MOST_APART = apart(LINK[0] / LINK[1])


def signatures(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that equal sets share), sketch, bands."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, keys, sketches, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_hashes(text, words)
                samples = min_hashes(s)
                n.append(len(s))
                keys.append(set_key(s.tobytes()))
                sketches.append(odd_sketch(samples) if len(s) else None)
                bands.append(band_keys(samples) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sketches, longs), pa.array(bands, longs)],
                ["doc_id", "n_shingles", "set_key", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, set_key binary, sketch array<long>, bands array<long>")


def sketch_distance(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                       lambda total, x: total + x)


def _plausible(pairs: DataFrame, reps: DataFrame, most_apart: int, link: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    one = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("s1"),
                      F.col("n_shingles").alias("n1"))
    two = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("s2"),
                      F.col("n_shingles").alias("n2"))
    p, q = link
    near = (sketch_distance(F.col("s1"), F.col("s2")) <= most_apart) & (
        F.least("n1", "n2") * q >= F.greatest("n1", "n2") * p)
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, link: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets have intersection / union >= link.

    The texts of both sides come by joins, so a document with very many partners is spread by
    the skew join; tasks keep the set of the right side while it stays the same.
    """
    p, q = link
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.join(ends, "doc_id", "left_semi").select("doc_id", "text")
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "t1"}), "a").join(
        texts.withColumnsRenamed({"doc_id": "b", "text": "t2"}), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b, t1, t2 in zip(*(batch.column(c) for c in ("a", "b", "t1", "t2"))):
                if last != b.as_py():
                    last, held = b.as_py(), shingle_hashes(t2.as_py(), words)
                s = shingle_hashes(t1.as_py(), words)
                shared = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(q * shared >= p * (len(s) + len(held) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")],
                                             ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "t1", "t2").mapInArrow(confirm, "a long, b long")


def plausible_in_block(sketches: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray,
                       most_apart: int) -> np.ndarray:
    """Which pairs of left and right lie in different components and have sketches near enough."""
    apart = np.zeros((len(left), len(right)), np.uint16)
    for w in range(sketches.shape[1]):
        apart += np.bitwise_count(sketches[left, w][:, None] ^ sketches[right, w][None, :])
    return (apart <= most_apart) & (roots[left][:, None] != roots[right][None, :])


def met_first(bands: np.ndarray, band: int, i: np.ndarray, j: np.ndarray, step: int = 100_000) -> np.ndarray:
    """Which pairs (i, j) share no band before ``band``: each pair is compared in one bucket only."""
    before = int(np.flatnonzero(bands[0] == band)[0])
    out = np.ones(len(i), bool)
    for k in range(0, len(i), step):
        out[k:k + step] = ~(bands[i[k:k + step], :before] == bands[j[k:k + step], :before]).any(axis=1)
    return out


def linked_in_block(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray,
                    link: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left and right) in different components with intersection / union >= link.

    Intersections of the whole block are products of 0/1 matrices over the shingles that both
    sides have, so no pair is made that isn't a link.
    """
    def cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = [len(sets[r]) for r in rows]
        return np.repeat(np.arange(len(rows)), size), np.concatenate([sets[r] for r in rows])

    if not len(left) or not len(right):
        return left[:0], right[:0]
    (i, x), (j, y) = cells(left), cells(right)
    shared = np.intersect1d(x, y)
    count = np.zeros((len(left), len(right)), np.float32)
    if len(shared):
        at_x, at_y = (np.minimum(np.searchsorted(shared, v), len(shared) - 1) for v in (x, y))
        i, at_x = i[shared[at_x] == x], at_x[shared[at_x] == x]
        j, at_y = j[shared[at_y] == y], at_y[shared[at_y] == y]
    for begin in range(0, len(shared), 2048):
        a = np.zeros((len(left), 2048), np.float32)
        b = np.zeros((len(right), 2048), np.float32)
        for m, row, at in ((a, i, at_x), (b, j, at_y)):
            here = (at >= begin) & (at < begin + 2048)
            m[row[here], at[here] - begin] = 1
        count += a @ b.T
    n = np.array([len(s) for s in sets], np.int64)
    common = count.astype(np.int64)
    p, q = link
    good = (q * common >= p * (n[left][:, None] + n[right][None, :] - common)) & (
        roots[left][:, None] != roots[right][None, :])
    at = np.nonzero(good)
    return left[at[0]], right[at[1]]


def _block_links(rest: DataFrame, reps: DataFrame, docs: DataFrame, words: int, link: tuple[int, int],
                 most_apart: int) -> DataFrame:
    """Links (a, b) between the components that meet in a bucket, from ``rest`` (band, rep, root).

    Members of a bucket are dealt into tiles of bounded size by a hash; a pair of tiles is one
    group. The sketches of a group are compared first; members that have a near one in another
    component, which no bucket of an earlier band holds too, come back with their full sets. Then a group returns at most one link per member:
    its members with the smallest one that they reach inside the group, so the rows are bounded
    by the members, not by their pairs.
    """
    rows = rest.join(reps.select("rep", "set_key", "n_shingles", "sketch", "bands"), "rep")
    tiles = rows.groupBy("band").agg(F.ceil(F.greatest(
        F.count("*") / TILE_ROWS, F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, F.col("tile")).alias("lo"), F.greatest(t, F.col("tile")).alias("hi"))))
    met = rows.join(tiles, "band").withColumn("tile", tile).withColumn("m", meets).select(
        "band", "m.lo", "m.hi", "tile", "rep", "root", "set_key", "sketch", "bands")
    group = ["band", "lo", "hi"]

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tile = np.asarray(t.column("tile"))
        return (np.asarray(t.column("root")), np.flatnonzero(tile == t.column("lo")[0].as_py()),
                np.flatnonzero(tile == t.column("hi")[0].as_py()))

    def plausible(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        roots, left, right = sides(t)
        sketches, bands = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(
            t.num_rows, -1) for c in ("sketch", "bands"))
        at = np.nonzero(plausible_in_block(sketches.view(np.uint64), roots, left, right, most_apart))
        i, j = left[at[0]], right[at[1]]
        first = met_first(bands, t.column("band")[0].as_py(), i, j)
        on = np.union1d(i[first], j[first])
        return t.select([*group, "tile", "rep", "root", "set_key"]).take(pa.array(on))

    near = cut_lineage(met.groupBy(*group).applyInArrow(
        plausible, "band long, lo int, hi int, tile int, rep long, root long, set_key binary"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingle_hashes(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(set_key, sets), pa.binary()),
                 pa.array(sets, pa.binary())], ["rep", "set_key", "shingles"])

    texts = docs.join(near.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.select("doc_id", "text").mapInArrow(
        sets_of, "rep long, set_key binary, shingles binary").dropDuplicates(["rep", "set_key"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rep = np.asarray(t.column("rep"))
        roots, left, right = sides(t)
        sets = [np.frombuffer(b, np.uint64) for b in t.column("shingles").to_pylist()]
        i, j = linked_in_block(sets, roots, left, right, link)
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        least = rep[order][local_roots(len(rep), place[i], place[j])[place]]
        on = least != rep
        return pa.table({"a": rep[on], "b": least[on]})

    return near.join(sets, ["rep", "set_key"]).drop("set_key").groupBy(*group).applyInArrow(
        compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, link: tuple[int, int] = LINK
                    ) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links (similarity of shingle sets at
    least link[0] / link[1]); kept marks the one document of each component that stays. Texts
    without words, null or empty, are linked with nothing. Equal texts are linked. Rows that
    repeat a doc_id are returned once each with the same component; a row with a null doc_id
    stands alone (component_id null, kept true). Columns other than doc_id and text are not
    read. An empty table gives an empty result.
    """
    most_apart = apart(link[0] / link[1])
    known = docs.where("doc_id is not null")
    signed = cut_lineage(signatures(docs, words))
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    classes = whole.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = cut_lineage(whole.select("doc_id", "set_key").join(classes, "set_key")
                          .select("doc_id", "rep").distinct())
    # a doc_id that repeats with different texts joins its classes
    reps = cut_lineage(whole.join(members.where("doc_id = rep").select(F.col("rep").alias("doc_id"))
                                  .distinct(), "doc_id", "left_semi")
                       .select(F.col("doc_id").alias("rep"), "set_key", "n_shingles", "sketch",
                               "bands").dropDuplicates(["rep", "set_key"]))
    inband = reps.select("rep", F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("rep").alias("h"), "rep")
    ends = inband.groupBy("band").agg(F.count("*").alias("n"), F.min(order).alias("lo"),
                                      F.max(order).alias("hi")).where("n > 1")
    buckets = cut_lineage(inband.join(ends.select("band", F.col("lo.rep").alias("lo"),
                                                  F.col("hi.rep").alias("hi")), "band"))
    stars = buckets.select("rep", F.explode(F.array("lo", "hi")).alias("p")).where("rep <> p")
    stars = cut_lineage(stars.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
                        .distinct())
    texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links = cut_lineage(_confirmed(_plausible(stars, reps, most_apart, link), texts, words, link))
    roots = chained(links)

    # the rest: members of one bucket that lie in different components
    rooted = buckets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "band", "rep", F.coalesce("root", "rep").alias("root"))
    split = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(
        "x <> y").select("band")
    rest = cut_lineage(rooted.join(split, "band", "left_semi"))
    more = cut_lineage(_block_links(rest, reps, texts, words, link, most_apart))
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = chained(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                    .unionByName(more).unionByName(same))
    out = signed.select("doc_id", "n_shingles").join(
        final.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE, link: tuple[int, int] = LINK
                         ) -> DataFrame:
    """Rows of ``docs`` with one document of each component left, and of equal doc_ids one row.

    Rows without a doc_id stay.
    """
    kept = near_duplicates(docs, words, link).where("kept and doc_id is not null").select("doc_id")
    known = docs.where("doc_id is not null").join(kept.distinct(), "doc_id", "left_semi")
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))
