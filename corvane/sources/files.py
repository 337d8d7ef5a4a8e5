"""File listings, MIME routing, readers and the assembly of document text from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.text import lookup, trim_blank

LISTING_SCHEMA = (
    "file_id string, name string, mime_type string, modified_ts timestamp, "
    "size_bytes bigint, link string, parents array<string>, trashed boolean"
)

FILE_EXTENSIONS = {ext: mime for mime, (ext, _) in reversed(lx.SUPPORTED_MIME.items())
                   if not mime.startswith(lx.WORKSPACE_PREFIX)}
FILE_EXTENSIONS.update({".txt": "text/plain", ".md": "text/markdown",
                        ".html": "text/html", ".csv": "text/csv"})


def base_mime(mime: Column | str) -> Column:
    """MIME type without parameters, lower case."""
    column = F.col(mime) if isinstance(mime, str) else mime
    return F.lower(trim_blank(F.split_part(column, F.lit(";"), F.lit(1))))


def is_supported(mime: Column) -> Column:
    return mime.isin(list(lx.SUPPORTED_MIME))


def extension_of(mime: Column | str) -> Column:
    return F.coalesce(lookup(mime, {m: e for m, (e, _) in lx.SUPPORTED_MIME.items()}), F.lit(""))


def label_of(mime: Column | str, default: str = "File") -> Column:
    return F.coalesce(lookup(mime, {m: n for m, (_, n) in lx.SUPPORTED_MIME.items()}),
                      F.lit(default))


def list_files(files: DataFrame, mime_types: list[str] | None = None,
               folder_id: str | None = None) -> DataFrame:
    """Files worth indexing: supported, not trashed, of usable size, optionally of one folder."""
    mime = F.col("mime_type")
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    sized = size.between(lx.MIN_FILE_BYTES, lx.MAX_FILE_BYTES)
    keep = (
        mime.isin(mime_types or list(lx.SUPPORTED_MIME))
        & ~F.col("trashed")
        & ~mime.isin(lx.SKIPPED_MIME)
        & (sized | mime.startswith(lx.WORKSPACE_PREFIX))
    )
    if folder_id is not None:
        keep = keep & F.array_contains("parents", folder_id)
    return files.filter(keep)


def file_preview(files: DataFrame, limit: int = 50) -> DataFrame:
    """The first files by name with their type label, the total and the number shown."""
    total = files.agg(F.count("*").alias("total")).scalar()
    first = files.orderBy("name", "file_id").limit(limit)
    return first.select(
        "file_id", "name", "mime_type", label_of("mime_type").alias("type_label"),
        total.alias("total"),
    ).withColumn("showing", F.least(F.col("total"), F.lit(limit).cast("bigint")))


def mime_catalog(mimes: DataFrame) -> DataFrame:
    """Extension, label, workspace flag and export target for each MIME type of the input."""
    mime = F.col("mime_type")
    return mimes.select(
        mime,
        is_supported(mime).alias("supported"),
        mime.isin(lx.SKIPPED_MIME).alias("skip_listed"),
        extension_of(mime).alias("extension"),
        label_of(mime).alias("label"),
        mime.startswith(lx.WORKSPACE_PREFIX).alias("is_workspace"),
        lookup(mime, {m: t for m, (t, _) in lx.EXPORT_MIME.items()}).alias("export_mime"),
        lookup(mime, {m: e for m, (_, e) in lx.EXPORT_MIME.items()}).alias("export_extension"),
    )


def route_by_mime(files: DataFrame) -> DataFrame:
    """Name the reader of each file; unknown types are decoded as text."""
    reader = lookup(base_mime("mime_type"), lx.READER_BY_MIME)
    return files.withColumn("reader", F.coalesce(reader, F.lit("text")))


# --- Reading --------------------------------------------------------------

def read_binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A folder tree as a listing with content; the size bound is pushed to the source."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .filter(F.col("length").between(lx.MIN_FILE_BYTES, lx.MAX_FILE_BYTES))
    )
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return raw.select(
        F.sha2("path", 256).alias("file_id"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.coalesce(lookup(extension, FILE_EXTENSIONS),
                   F.lit("application/octet-stream")).alias("mime_type"),
        F.col("modificationTime").alias("modified_ts"),
        F.col("length").alias("size_bytes"),
        F.col("path").alias("link"),
        F.array(F.regexp_replace("path", "/[^/]*$", "")).alias("parents"),
        F.lit(False).alias("trashed"),
        "content",
    )


def decode_text(content: Column | str) -> Column:
    """UTF-8 with replacement characters for broken bytes, trimmed; markup is kept."""
    column = F.col(content) if isinstance(content, str) else content
    return trim_blank(F.make_valid_utf8(column.cast("string")))


def read_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decode_text("content")).drop("content")


# A separator and the field behind it; quotes count only where a field begins.
_CSV_FIELD = r'([,\n])("[^"]*+(?:""[^"]*+)*+"[^,\n]*+|[^,\n]*+)'
_ROW_MARK = "\u0001"


def _csv_fields(text: Column) -> Column:
    """All fields of CSV text, of any number of columns, as (separator in front, cell)."""
    lead = F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n?", "\n"))
    cells = F.transform(
        F.regexp_extract_all(lead, F.lit(_CSV_FIELD), F.lit(2)),
        lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(
            c, r'^"([^"]*+(?:""[^"]*+)*+)"([^"]*)$', "$1$2"), F.lit('""'), F.lit('"'))
        ).otherwise(c))
    marks = F.regexp_extract_all(lead, F.lit(_CSV_FIELD), F.lit(1))
    return F.arrays_zip(marks.alias("mark"), cells.alias("cell"))


def csv_lines_to_text(lines: DataFrame) -> DataFrame:
    """CSV rows ``(file_id, row_no, line)`` to one tab-separated text per file."""
    cells = F.transform(_csv_fields(F.col("line")), lambda f: f["cell"])
    return _join_rows(lines.select("file_id", "row_no", cells.alias("cells")))


def csv_to_text(text: Column | str) -> Column:
    """A whole CSV text, quoted line breaks included, as tab-separated rows without blank ones."""
    column = F.col(text) if isinstance(text, str) else text
    marked = F.array_join(F.transform(_csv_fields(column), lambda f: F.concat(
        F.when(f["mark"] == "\n", _ROW_MARK).otherwise("\t"), f["cell"])), "")
    rows = F.filter(F.split(marked, _ROW_MARK), lambda r: F.replace(r, F.lit("\t"), F.lit("")) != "")
    return F.array_join(rows, "\n")


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV files to one tab-separated text per file; files without a filled cell are left out."""
    whole = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file_id"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return whole.select("file_id", csv_to_text("text").alias("text")).filter("text <> ''")


def _join_rows(rows: DataFrame) -> DataFrame:
    filled = rows.filter(F.exists("cells", lambda x: x != ""))
    line = filled.select("file_id", "row_no", F.array_join("cells", "\t").alias("line"))
    return line.groupBy("file_id").agg(
        F.expr("listagg(line, '\\n') within group (order by row_no)").alias("text"))


# --- Assembly from parts --------------------------------------------------

def assemble_pages(parts: DataFrame) -> DataFrame:
    """Pages ``(file_id, page_no, text)`` to one text; blank pages go, numbering stays."""
    block = F.concat(F.lit("[Trang "), F.col("page_no").cast("string"), F.lit("]\n"),
                     trim_blank("text"))
    return (
        parts.filter(trim_blank("text") != "")
        .select("file_id", "page_no", block.alias("block"))
        .groupBy("file_id")
        .agg(F.expr("listagg(block, '\\n\\n') within group (order by page_no)").alias("text"))
    )


def assemble_sheets(rows: DataFrame) -> DataFrame:
    """Rows ``(file_id, sheet_no, sheet, row_no, cells)`` to one text with a header per sheet."""
    body = rows.filter(F.exists("cells", lambda x: F.coalesce(x, F.lit("")) != "")).select(
        "file_id", "sheet_no", "row_no",
        F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit(""))), "\t").alias("line"),
    )
    heads = rows.groupBy("file_id", "sheet_no").agg(
        F.concat(F.lit("[Sheet: "), F.first("sheet"), F.lit("]")).alias("line")
    ).select("file_id", "sheet_no", F.lit(-1).cast("bigint").alias("row_no"), "line")
    lines = body.select("file_id", "sheet_no", F.col("row_no").cast("bigint"), "line")
    ordered = lines.unionByName(heads).withColumn("place", F.struct("sheet_no", "row_no"))
    return ordered.groupBy("file_id").agg(
        F.expr("listagg(line, '\\n') within group (order by place)").alias("text"))


def assemble_word_parts(parts: DataFrame) -> DataFrame:
    """Paragraphs and table rows ``(file_id, part_no, cells)`` to one text.

    A paragraph is a part with one cell; the filled cells of a table row are joined by a bar.
    """
    filled = F.filter(F.transform("cells", trim_blank), lambda x: x != "")
    line = parts.select("file_id", "part_no", F.array_join(filled, " | ").alias("line"))
    return line.filter("line <> ''").groupBy("file_id").agg(
        F.expr("listagg(line, '\\n\\n') within group (order by part_no)").alias("text"))
