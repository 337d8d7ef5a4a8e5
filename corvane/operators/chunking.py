"""Split documents into overlapping chunks with positions, and the structural graph.

A chunk boundary depends on the boundary before it, so packing runs over the units of one
document in order, in the Arrow step that also finds the places of the chunks. Its work grows
with the document; documents are independent and need no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import keys
from corvane.functions import lexicon as lx
from corvane.functions.text import content_hash, trim_blank

DOC_KEY = ["owner_id", "file_id"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim_blank), lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    """Blocks between blank lines, trimmed, without empty ones."""
    return _filled(F.split(F.regexp_replace(_col(text), r"\r\n?", "\n"), r"\n{2,}"))


def sentences(text: Column | str) -> Column:
    """Pieces after ``. ! ?`` with white space, and single lines, trimmed, without empty ones."""
    pieces = F.split(_col(text), r"(?U)(?<=[.!?])\s+")
    return _filled(F.flatten(F.transform(pieces, lambda p: F.split(p, "\n"))))


def units(text: Column | str, size: int) -> Column:
    """Paragraphs that fit, and the sentences of those that do not."""
    return F.flatten(F.transform(
        paragraphs(text), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(sentences(p))
    ))


def pack_units(parts: list[str], size: int, overlap: int, drop_overlap_only: bool = False
               ) -> list[str]:
    """Greedy packing of the units of one document into chunk texts, in one pass.

    The counted length adds one per unit, so it runs one ahead of the text after a fresh start.
    """
    flush_at = max(size // 2, lx.MIN_FLUSH)
    done: list[str] = []
    text, count, carried = None, 0, False

    def close() -> tuple[str | None, int, bool]:
        if not (drop_overlap_only and carried):
            done.append(text)
        tail = text[-overlap:] if overlap > 0 else None
        return tail, len(tail or ""), overlap > 0

    for unit in parts:
        if text is not None and count >= flush_at:
            text, count, carried = close()
        if text is not None and count + len(unit) + 1 > size:
            text, count, carried = close()
        text = unit if text is None else f"{text} {unit}"
        count, carried = count + len(unit) + 1, False
    if text is not None:
        done.append(text)
    return done


#: Bytes of texts that a task holds as Python objects at a time; a longer text stands alone.
SLICE_BYTES = 1_000_000


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, length) of runs of rows with about ``most`` bytes of text or lists of texts."""
    if pa.types.is_list(texts.type):
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts.values), 0).to_numpy())])
        total = ends[texts.offsets.to_numpy()[1:]]
    else:
        total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    if len(total):
        begins = np.flatnonzero(np.diff(total // most, prepend=-1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(total)]):
            yield begin, end - begin


def pack(parts: Column, size: int, overlap: int, drop_overlap_only: bool = False) -> Column:
    """``pack_units`` as a column; the boundary of a chunk depends on the one before it."""
    @F.arrow_udf("array<string>")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for cut in slices(lists):
                yield pa.array([pack_units(u or [], size, overlap, drop_overlap_only)
                                for u in lists.slice(*cut).to_pylist()], pa.list_(pa.string()))

    return packed(parts)


def chunk_texts(text: Column | str, size: int | None = None, overlap: int | None = None,
                drop_overlap_only: bool = False) -> Column:
    size = lx.CHUNK_SIZE if size is None else size
    overlap = lx.CHUNK_OVERLAP if overlap is None else overlap
    return pack(units(F.coalesce(_col(text), F.lit("")), size), size, overlap, drop_overlap_only)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


PLACE_NUMBERS = ("char_start", "char_end", "line_start", "line_end", "page_estimate")
PLACES = f"array<struct<{','.join(f'{c}:int' for c in PLACE_NUMBERS)},repeat:boolean>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def anchor_places(body: str, anchors: set[str]) -> dict[str, list[int]]:
    """All places of each anchor in a text, ascending; anchors of one length are found together.

    A rolling hash over the text is made once per length and the anchors are looked up in it,
    so the work grows with the text and not with text times anchors.
    """
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    power = np.cumprod(np.full(len(codes), _STEP)) if len(codes) else codes
    undo = np.cumprod(np.full(len(codes), _BACK)) if len(codes) else codes
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power)])
    found: dict[str, list[int]] = {}
    for n in {len(a) for a in anchors}:
        group = [a for a in anchors if len(a) == n]
        if not n or n > len(codes):
            found.update({a: list(range(len(body) + 1)) if not n else [] for a in group})
            continue
        window = (sums[n:] - sums[:-n]) * undo[:len(codes) - n + 1]
        order = np.argsort(window, kind="stable")
        ranked = window[order]
        for anchor in group:
            own = np.frombuffer(anchor.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            key = ((own * power[:n]).sum(keepdims=True) * undo[:1])[0]
            lo, hi = np.searchsorted(ranked, key, "left"), np.searchsorted(ranked, key, "right")
            found[anchor] = order[lo:hi].tolist()
    return found


def chunk_places(body: str, parts: list[str]) -> list[dict]:
    """Offsets, lines and page of each chunk of one document, and whether it repeats another.

    A chunk is searched from one past the start of the chunk before; when it is not found as it
    is, by its first characters; it stays at the search position when these are missing too.
    Lines are counted on from the previous start, page markers are found once.
    """
    heads = [part[:lx.ANCHOR_CHARS] for part in parts]
    where = anchor_places(body, set(heads))
    markers = list(re.finditer(r"\[Trang (\d+)\]", body, re.ASCII))
    ends = [m.end() for m in markers]
    rows, begin, seen, line, known = [], 0, 0, 1, set()
    for part, head in zip(parts, heads):
        places = where[head]
        first = bisect_left(places, begin)
        at = next((places[k] for k in range(first, len(places))
                   if body.startswith(part, places[k])), None)
        if at is None:
            at = next((places[k] for k in range(first, len(places))
                       if body.startswith(head, places[k])), begin)
        line += body.count("\n", seen, at)
        end = at + len(part)
        marked = bisect_right(ends, at + 1)
        page = int(markers[marked - 1][1]) if marked else 0
        if not 0 < page < 1 << 31:
            page = at // lx.CHARS_PER_PAGE + 1
        rows.append({"char_start": at, "char_end": end, "line_start": line,
                     "line_end": line + body.count("\n", at, end), "page_estimate": page,
                     "repeat": part.strip() in known})
        known.add(part.strip())
        seen, begin = at, at + 1
    return rows


def locate(text: Column | str, chunks: Column) -> Column:
    """``chunk_places`` as a column."""
    @F.arrow_udf(PLACES)
    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        row = pa.struct({c: pa.int32() for c in PLACE_NUMBERS} | {"repeat": pa.bool_()})
        for texts, chunk_lists in batches:
            for cut in slices(texts):
                yield pa.array([chunk_places(t or "", c or []) for t, c in zip(
                    texts.slice(*cut).to_pylist(), chunk_lists.slice(*cut).to_pylist())], pa.list_(row))

    return places(_col(text), chunks)


def _page_estimate(char_start: Column) -> Column:
    return F.floor(char_start / lx.CHARS_PER_PAGE).cast("int") + 1


def page_of(text: Column | str, char_start: Column | str) -> Column:
    """Last page marker at or before the start; without one, an estimate by length."""
    body, at = _col(text), _col(char_start)
    markers = F.regexp_extract_all(F.substring(body, F.lit(1), at + 1),
                                   F.lit(r"\[Trang (\d+)\]"), F.lit(1))
    number = F.try_element_at(markers, F.lit(-1)).try_cast("int")
    return F.when(number > 0, number).otherwise(_page_estimate(at))


def line_of(text: Column | str, position: Column | str) -> Column:
    return _newlines(F.substring(_col(text), F.lit(1), _col(position))) + 1


def chunk_documents(documents: DataFrame, size: int | None = None, overlap: int | None = None,
                    drop_overlap_only: bool = False, dedupe: bool = False) -> DataFrame:
    """One row per chunk; every other document column is carried along.

    ``dedupe`` drops repeats inside each document here, where all its chunks are in one row,
    so it needs no shuffle; ``dedupe_chunks`` does the same for a stored chunk table.
    """
    carried = [c for c in documents.columns if c != "text"]
    packed = documents.select(
        "*", chunk_texts("text", size, overlap, drop_overlap_only).alias("_chunks"))
    placed = packed.select(
        *carried, F.size("_chunks").alias("total_chunks"), "_chunks",
        locate("text", F.col("_chunks")).alias("_at"))
    rows = placed.select(
        *carried, "total_chunks",
        F.posexplode(F.arrays_zip("_chunks", "_at")).alias("chunk_index", "_row"))
    if dedupe:
        rows = rows.filter(~F.col("_row._at.repeat"))
    return rows.select(
        *carried,
        keys.chunk_id("file_id", "chunk_index").alias("chunk_id"),
        "chunk_index", "total_chunks",
        F.col("_row._chunks").alias("text"),
        "_row._at.page_estimate", "_row._at.char_start", "_row._at.char_end",
        "_row._at.line_start", "_row._at.line_end",
        content_hash("_row._chunks").alias("content_hash"),
    )


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """First chunk of each text within a document; indexes keep their gaps.

    ``rank = 1`` is applied per task before the shuffle, so many copies cost one row each task.
    """
    order = W.partitionBy("owner_id", "file_id", "content_hash").orderBy("chunk_index")
    return (chunks.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n"))


def structural_edges(chunks: DataFrame) -> DataFrame:
    """CONTAINS from document to chunk, NEXT from chunk to the following kept chunk."""
    order = W.partitionBy(*DOC_KEY).orderBy("chunk_index")
    linked = chunks.select(*DOC_KEY, "chunk_id", F.lead("chunk_id").over(order).alias("next_id"))
    pairs = F.explode(F.array(
        F.struct(F.col("file_id").alias("src"), F.col("chunk_id").alias("dst"),
                 F.lit("CONTAINS").alias("rel_type")),
        F.struct(F.col("chunk_id").alias("src"), F.col("next_id").alias("dst"),
                 F.lit("NEXT").alias("rel_type")),
    )).alias("e")
    return linked.select("owner_id", pairs).select("owner_id", "e.*").filter("dst is not null")


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select(*DOC_KEY, "chunk_id", "chunk_index", "page_estimate",
                         F.substring("text", 1, 150).alias("preview"))


def eligible_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks long enough for extraction."""
    return chunks.filter(F.length(trim_blank("text")) >= lx.MIN_EXTRACTION_CHARS)


def model_batches(chunks: DataFrame, batch: int | None = None) -> DataFrame:
    """Input texts for a model, a fixed number of chunks each, in document order."""
    batch = lx.EXTRACTION_BATCH if batch is None else batch
    place = F.row_number().over(W.partitionBy(*DOC_KEY).orderBy("chunk_index")) - 1
    numbered = eligible_chunks(chunks).select(
        *DOC_KEY, "chunk_index", "text", F.floor(place / batch).cast("int").alias("batch_no"))
    section = F.concat(F.lit("[CHUNK_"), F.col("chunk_index").cast("string"), F.lit("]\n"),
                       F.substring("text", 1, lx.EXTRACTION_BATCH_CHARS))
    alone = F.substring("text", 1, lx.EXTRACTION_SINGLE_CHARS)
    return (
        numbered.select(*DOC_KEY, "batch_no", "chunk_index", section.alias("section"),
                        alone.alias("alone"))
        .groupBy(*DOC_KEY, "batch_no")
        .agg(
            F.count("*").alias("n_chunks"),
            F.array_sort(F.collect_list("chunk_index")).alias("chunk_indexes"),
            F.expr("listagg(section, '\\n\\n') within group (order by chunk_index)").alias("many"),
            F.max("alone").alias("one"),
        )
        .select(*DOC_KEY, "batch_no", "n_chunks", "chunk_indexes",
                F.when(F.col("n_chunks") == 1, F.col("one")).otherwise(F.col("many"))
                .alias("text"))
    )
