"""Identifiers and location columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.text import _col, trim_blank


def chunk_id(file_id: Column | str, index: Column | str) -> Column:
    """``{file}__chunk_{n}``; an index that is not a number counts as 0."""
    number = F.coalesce(_col(index).cast("string").try_cast("int"), F.lit(0))
    return F.concat(trim_blank(F.coalesce(_col(file_id).cast("string"), F.lit(""))),
                    F.lit("__chunk_"), number.cast("string"))


def chunk_reference(explicit: Column | str, file_id: Column | str, index: Column | str) -> Column:
    """An explicit chunk id wins over the (file, index) pair."""
    given = trim_blank(_col(explicit))
    return F.when(given != "", given).otherwise(chunk_id(file_id, index))


def entity_id(owner: Column | str, name_norm: Column | str) -> Column:
    scope = F.when(F.coalesce(_col(owner), F.lit("")) != "", _col(owner)).otherwise(F.lit("entity"))
    return F.concat(scope, F.lit("__"), _col(name_norm))


def community_id(owner: Column | str, members: Column) -> Column:
    """The same members always give the same id."""
    digest = F.sha2(F.array_join(F.array_sort(members), "\n"), 256)
    return F.concat(_col(owner), F.lit("__community_"), F.substring(digest, 1, 12))


def tenant_key(owner: Column | str) -> Column:
    safe = F.regexp_replace(_col(owner), r"(?U)[^\w\-]", "_")
    return F.concat(F.lit("kb_"), F.substring(safe, 1, 128))


def default_link(file_id: Column | str) -> Column:
    return F.concat(F.lit(lx.LINK_PREFIX), _col(file_id).cast("string"), F.lit("/view"))


def positive(c: Column | str) -> Column:
    """A page or line number; text that is not a positive number gives null."""
    number = trim_blank(_col(c).cast("string")).try_cast("int")
    return F.when(number > 0, number)


def location_label(page: Column, line_start: Column, line_end: Column) -> Column:
    page_part = F.when(page > 0, F.concat(F.lit("Trang "), page.cast("string")))
    first = F.concat(F.lit("dòng "), line_start.cast("string"))
    span = F.when(line_end > line_start, F.concat(first, F.lit("–"), line_end.cast("string")))
    line_part = F.when(line_start > 0, F.coalesce(span, first))
    return F.concat_ws(", ", page_part, line_part)


def location_link(link: Column | str, file_id: Column | str, page: Column,
                  mime: Column | str, name: Column | str) -> Column:
    """Open at a page: ``/view`` becomes ``/preview`` and the page is anchored.

    Only a MIME type that is given and is not a PDF, by type, name or link, suppresses it.
    """
    link_text = trim_blank(F.coalesce(_col(link), F.lit("")))
    fid = F.coalesce(_col(file_id).cast("string"), F.lit(""))
    base = F.when((link_text == "") & (fid != ""), default_link(fid)).otherwise(link_text)
    mime_text = F.lower(F.coalesce(_col(mime), F.lit("")))
    hint = F.coalesce(F.nullif(_col(name), F.lit("")), base)
    is_pdf = (F.contains(mime_text, F.lit("pdf")) | F.lower(hint).endswith(".pdf")
              | F.contains(F.lower(base), F.lit("/pdf")))
    preview = (
        F.when(F.contains(base, F.lit("/view")),
               F.replace(base, F.lit("/view"), F.lit("/preview")))
        .when(~F.contains(base, F.lit("/preview")) & (fid != ""),
              F.concat(F.lit(lx.LINK_PREFIX), fid, F.lit("/preview")))
        .otherwise(base)
    )
    anchor = F.concat(F.lit("#page="), page.cast("string"))
    anchored = F.when(F.contains(preview, anchor), preview).otherwise(F.concat(preview, anchor))
    plain = (base == "") | page.isNull() | (page <= 0) | ((mime_text != "") & ~is_pdf)
    return F.when(plain, base).otherwise(anchored)
