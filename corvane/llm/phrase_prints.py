"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. Runs of a symbol become one; deterministic coin tossing turns each
symbol into a small number that depends on its few predecessors only (the place and the value of
the lowest bit in which neighbours differ, four times over); where that number is a local maximum
a phrase begins, and the hash of its symbols names it. The names are the symbols of the next
level, until one is left. What a phrase is called depends on its surroundings, not on where the
text begins, so equal stretches get equal names inside, at any offset.

A fingerprint is the ``KEPT`` smallest hashed names, in hexadecimal, of phrases that span at
least ``SPAN`` code points (in texts below SPAN * SPAN, 1 / SPAN of the text), and of the whole. Likeness is the share of common names among the
``KEPT`` smallest of both, an estimate of the Jaccard similarity of all names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage, sliced

KEPT = 64
SPAN = 8
TOSSES = 4
#: Code points parsed at once.
TOGETHER = 60_000

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Multipliers of the symbols of a phrase by place.
PLACES = np.random.default_rng(97).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Runs of one character up to this length are written beside it in one symbol.
LONGEST_PLAIN_RUN = 1023


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels that differ between neighbours; ``first`` marks where a text begins."""
    label = symbols
    for _ in range(TOSSES):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = ~label[first]
        differ = label ^ before
        lowest = np.bitwise_count((differ & -differ) - label.dtype.type(1))
        label = (lowest << 1) | ((label >> lowest) & label.dtype.type(1)).astype(np.uint8)
    return label


def phrase_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, name) of all phrases that count; texts must not be empty."""
    size = np.array([len(t) for t in texts], np.int32)
    least = np.minimum(SPAN, size // SPAN)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    begin = np.arange(len(symbols) + 1, dtype=np.int32)  # where symbols begin in the texts
    docs_out, names_out, level = [], [], 0
    while True:
        level += 1
        fresh = np.empty(len(doc), bool)
        fresh[0] = True
        np.not_equal(doc[1:], doc[:-1], out=fresh[1:])
        # runs of one symbol become one
        change = fresh.copy()
        change[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(change)
        if len(at) < len(symbols):
            run = np.diff(at, append=len(symbols)).astype(symbols.dtype)
            symbols, doc, fresh = symbols[at], doc[at], fresh[at]
            begin = np.append(begin[at], begin[-1])
            many = np.flatnonzero(run > 1)
            if level == 1:
                # 21 bits of code point, ten of length; a longer run is hashed below a bit of its own
                long = many[run[many] > LONGEST_PLAIN_RUN]
                far = mixed(symbols[long].astype(np.uint64) << np.uint64(40) | run[long])
                symbols[many] |= np.minimum(run[many], LONGEST_PLAIN_RUN) << np.uint32(21)
                symbols[long] = (far >> np.uint64(33)).astype(np.uint32) | np.uint32(1 << 31)
            else:
                symbols[many] = mixed(symbols[many] * _A + run[many])
        done = fresh & np.append(fresh[1:], True)
        if done.any():  # texts that are one symbol now
            docs_out.append(doc[done])
            names_out.append(mixed(symbols[done].astype(np.uint64) + np.uint64(977)))
            if done.all():
                return np.concatenate(docs_out), np.concatenate(names_out)
            left = ~done
            span = np.diff(begin)[left]
            symbols, doc, fresh = symbols[left], doc[left], fresh[left]
            begin = np.append(0, np.cumsum(span)).astype(np.int32)
        label = tossed(symbols, fresh)
        start = fresh.copy()
        top = label[1:-1] > label[:-2]
        top &= label[1:-1] > label[2:]
        top &= ~fresh[2:]
        start[1:-1] |= top
        at = np.flatnonzero(start)
        place = np.arange(len(symbols), dtype=np.int32)
        place -= np.repeat(at.astype(np.int32), np.diff(at, append=len(symbols)))
        symbols = mixed(np.add.reduceat(symbols * PLACES[place & 63], at) + np.uint64(level))
        begin, doc = np.append(begin[at], begin[-1]), doc[at]
        counts = np.diff(begin) >= least[doc]
        docs_out.append(doc[counts])
        names_out.append(symbols[counts])


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The smallest names of each text, ascending 32-bit numbers; none for an empty text."""
    out = [np.empty(0, np.uint32)] * len(texts)
    held: list[int] = []

    def flush() -> None:
        if not held:
            return
        doc, name = phrase_names([texts[k] for k in held])
        keys = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (mixed(name) >> np.uint64(32)))
        owner = (keys >> np.uint64(32)).astype(np.int64)
        begin = np.searchsorted(owner, np.arange(len(held) + 1))
        low = keys.astype(np.uint32)
        for n, k in enumerate(held):
            out[k] = low[begin[n]:min(begin[n] + KEPT, begin[n + 1])]
        held.clear()

    total = 0
    for k, text in enumerate(texts):
        if text:
            if total + len(text) > TOGETHER:
                flush()
                total = 0
            held.append(k)
            total += len(text)
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the smallest of both; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)
    if len(a) >= KEPT or len(b) >= KEPT:
        both = both[:KEPT]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(common, both, assume_unique=True).sum() / len(both))


def packed(print_: np.ndarray) -> bytes:
    return print_.astype(">u4").tobytes()


def written(print_: np.ndarray) -> str:
    return packed(print_).hex()


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points of ``following``, or all."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each whole text (null: empty)."""
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([written(p) for p in fingerprints(texts)], pa.string())],
                ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        fingerprint, "doc_id long, n_chars long, fingerprint string")


#: What tasks write; the binary columns become hexadecimal when they are read.
RESULT = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, "
          "edited_fingerprint binary, near_edited double, near_next double")
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _against(ids: list, texts: list[str], follow: list[str], prints: list[np.ndarray],
             follow_prints: list[np.ndarray]) -> list[list]:
    edited = [edited_text(t, f) for t, f in zip(texts, follow)]
    changed = fingerprints(edited)
    return [ids, [len(t) for t in texts],
            [hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest() for e in edited],
            [packed(p) for p in prints], [packed(p) for p in changed],
            [likeness(p, c) for p, c in zip(prints, changed)],
            [likeness(p, f) for p, f in zip(prints, follow_prints)]]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next text are.

    The next document is the one with the next smaller doc_id, after the last the first; rows
    with equal doc_id follow each other by text, and null doc_ids come last. A single row is
    followed by itself. Null texts count as empty. Rows are dealt by ranges of doc_id, so a row
    finds the next one beside it; only the first and the last row of each range are kept with
    their texts and are matched in a second, small step. An empty table gives no rows; other
    columns are not read.
    """
    schema = RESULT + ", part int, edge string, text string"
    names = [*NAMES, "part", "edge", "text"]

    def batch_of(columns: list[list], part: int, edge: str | None, texts: list[str | None]
                 ) -> pa.RecordBatch:
        n = len(columns[0])
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([part] * n, pa.int32()),
             pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())], names)

    def edge_row(doc: int | None, text: str, part: int, edge: str) -> pa.RecordBatch:
        return batch_of([[doc], [len(text)], *[[None]] * 5], part, edge, [text])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple | None = None
        for batch in sliced(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = fingerprints(texts)
            if held:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            elif ids:
                yield edge_row(ids[0], texts[0], part, "first")
            if len(ids) > 1:
                yield batch_of(_against(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]),
                               part, None, [None] * (len(ids) - 1))
            if ids:
                held = ids[-1], texts[-1], prints[-1]
        if held:
            yield edge_row(held[0], held[1], part, "last")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    dealt = rows.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(*order)
    done = cut_lineage(dealt.mapInArrow(follow, schema))

    # the last row of a range is followed by the first row of the next range that has rows
    edges = done.where("edge is not null")
    parts = edges.where("edge = 'first'").select("part")
    numbered = [r["part"] for r in parts.orderBy("part").collect()]
    after = done.sparkSession.createDataFrame(
        list(zip(numbered, numbered[1:] + numbered[:1])), "part int, next_part int")
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("next_part"),
                                                  F.col("text").alias("follow"))
    lasts = edges.where("edge = 'last'").select("doc_id", "part", "text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts, nexts = batch.column("text").to_pylist(), batch.column("follow").to_pylist()
            columns = _against(batch.column("doc_id").to_pylist(), texts, nexts,
                               fingerprints(texts), fingerprints(nexts))
            yield pa.RecordBatch.from_arrays(batch_of(columns, 0, None, texts).columns[:7], NAMES)

    matched = lasts.join(after, "part").join(firsts, "next_part").select(
        "doc_id", "text", "follow").mapInArrow(match, RESULT)
    out = done.where("edge is null").select(*NAMES).unionByName(matched)
    return out.select(*[F.lower(F.hex(n)).alias(n) if kind == "binary" else n for n, kind in out.dtypes])
