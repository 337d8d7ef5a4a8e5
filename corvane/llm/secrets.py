"""Secrets in texts: base patterns, and weak parts that count only beside their counterparts.

DataFrame functions only. Positions are code points: Spark splits a text at a pattern, and the
lengths of what lies between the matches add up to where they start.

Multipart credentials: an access identifier, a secret and an endpoint are often no secret each.
Parts are rows; an interval join pairs each weak part with the parts whose span lies within
``SCOPE`` code points in the same text. It is an equi-join on (row, block of ``SCOPE`` code
points) with a distance condition; parts don't overlap within a kind, so a part meets a bounded
number of others however many there are in a text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage
from corvane.session import broadcast_if_small

#: Base kinds in listed order: pattern, group that must be long enough, its least length.
BASE = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
               r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?"""
               r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: the role of the part, its pattern, its greatest length, and what must occur in it.
WEAK = {
    "weak_id": ("id", r"(?i:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id|key_?id)"
                      r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", 1 << 30, ()),
    "weak_secret": ("secret", r"(?i:pass|pwd|pin|auth|credentials?|private_?key|access_?key|signature)"
                              r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", 1 << 30, ()),
    "weak_key": ("secret", r"[A-Za-z0-9+/]{32,}={0,2}", 1 << 30, ("[0-9]", "[A-Z]", "[a-z]")),
    "endpoint": ("endpoint", r"(?:https?|ftp|ssh|jdbc|mongodb|redis|postgres(?:ql)?|mysql|amqp)://"
                             r"[^\x09-\x0D\x20\"'<>]+|(?i:host(?:_?name)?|server|endpoint)"
                             r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{4,}""", 1 << 30, ()),
}
#: Strings of which every match of a kind has one.
HOLDS = {"assign": (":", "="), "access": ("AKIA",), "weak_id": (":", "="),
         "weak_secret": (":", "="), "endpoint": (":", "=")}
BASE_ROLES = {"assign": "secret", "access": "id", "hex": "secret"}
KINDS = [*BASE, *WEAK]
#: Code points between the ends of two parts that belong together.
SCOPE = 300
MASK = "[SECRET]"

SPAN = "struct<start:int,rank:int,end:int>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def in_runs(rows: Column, state: Column, kind: str, walk) -> Column:
    """Arrays that ``walk`` makes of the rows of one run after the other, joined to one array.

    ``walk(at, run)`` gives a struct of the next ``at`` and an array of type ``kind``. A run is the
    square root of the rows long: an array that grows by one element a step is copied each time,
    so neither the arrays of a run nor that of the runs gets long.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(rows))).cast("int"), F.lit(1))

    def runs(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), n)
        return F.transform(starts, lambda i: F.slice(rows, i, n))

    def step(s: Column, run: Column) -> Column:
        return let(walk(s["at"], run), lambda w: F.struct(
            w["at"].alias("at"), F.concat(s["out"], F.array(w["out"])).alias("out")))

    zero = F.struct(state.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(let(size, runs), zero, step, lambda s: F.flatten(s["out"]))


def found(text: Column, pattern: str, rank: int, group: int = 0, least: int = 1,
          most: int = 1 << 30, needs: tuple[str, ...] = (), holds: tuple[str, ...] = ()) -> Column:
    """Spans (start, rank of the kind, end) of the leftmost matches of ``pattern``, in order,
    without those whose ``group`` is shorter than ``least``, that are longer than ``most`` or
    lack one of the patterns in ``needs``. Every match has one of the strings ``holds``, so texts
    without them are passed over before the pattern is tried."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def good(match: Column) -> Column:
        ok = F.length(match) <= most
        for need in needs:
            ok = ok & match.rlike(need)
        return ok

    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    if needs or most < 1 << 30:
        size = F.transform(whole, lambda m: F.when(good(m), F.length(m)).otherwise(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"),
                        F.transform(whole, F.length).alias("len"), size.alias("size"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"),
                        (start + x["len"]).alias("end"))
        return F.struct((start + x["len"]).alias("at"), F.when(
            x["size"] >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    rows = rows.cast("array<struct<gap:int,len:int,size:int>>")

    def walk(at: Column, run: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step)

    may = text.rlike(pattern)
    if holds:
        may = reduce(or_, [F.contains(text, F.lit(h)) for h in holds]) & may
    return F.when(may, let(rows, lambda r: in_runs(r, F.lit(0), SPAN, walk))).otherwise(none)


def row_key() -> Column:
    """Rows with equal doc_id and text are alike; others differ."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                             F.coalesce("text", F.lit(""))))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (null without any part), base and weak spans of each whole text."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*[found(text, p, k, g, n, holds=HOLDS.get(kind, ()))
                      for k, (kind, (p, g, n)) in enumerate(BASE.items())])
    weak = F.concat(*[found(text, p, len(BASE) + k, most=most, needs=needs, holds=HOLDS.get(kind, ()))
                      for k, (kind, (_, p, most, needs)) in enumerate(WEAK.items())])
    spans = docs.select("doc_id", row_key().alias("key"), F.array_sort(base).alias("base"),
                        F.array_sort(weak).alias("weak"))
    any_part = (F.size("base") > 0) | (F.size("weak") > 0)
    return spans.select("doc_id", F.when(any_part, F.col("key")).alias("row_key"), "base", "weak")


def linked_spans(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row_key and the weak spans to report, sorted.

    A weak identifier needs a secret in scope; a weak secret needs an identifier or an endpoint;
    an endpoint needs an identifier and a secret. A weak part that overlaps a base span is
    dropped, since it is reported already.
    """
    roles = {**{k: BASE_ROLES[n] for k, n in enumerate(BASE)},
             **{len(BASE) + k: role for k, (role, *_) in enumerate(WEAK.values())}}
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    has = spans.where("row_key is not null").select("row_key", "base", "weak").distinct()
    parts = has.select("row_key", F.explode(F.concat("base", "weak")).alias("p")).select(
        "row_key", "p.*", role[F.col("p.rank")].alias("role"))
    weak = parts.where(F.col("rank") >= len(BASE)).withColumn(
        "block", F.explode(F.sequence(F.expr(f"greatest(start - {scope}, 0) div {scope}"),
                                      F.expr(f"(end + {scope}) div {scope}"))))
    near = parts.select("row_key", F.col("start").alias("s2"), F.col("end").alias("e2"),
                        F.col("rank").alias("rank2"), F.col("role").alias("role2"),
                        F.explode(F.sequence(F.expr(f"start div {scope}"),
                                             F.expr(f"end div {scope}"))).alias("block"))
    met = weak.join(near, ["row_key", "block"]).where(
        (F.col("s2") <= F.col("end") + scope) & (F.col("e2") >= F.col("start") - scope))
    inside = (F.col("s2") < F.col("end")) & (F.col("e2") > F.col("start"))
    seen = met.groupBy("row_key", "start", "rank", "end", "role").agg(
        F.bool_or(inside & (F.col("rank2") < len(BASE))).alias("covered"),
        *[F.bool_or(F.col("role2") == r).alias(f"has_{r}") for r in ("id", "secret", "endpoint")])
    linked = seen.where(~F.col("covered") & (
        ((F.col("role") == "id") & F.col("has_secret"))
        | ((F.col("role") == "secret") & (F.col("has_id") | F.col("has_endpoint")))
        | ((F.col("role") == "endpoint") & F.col("has_id") & F.col("has_secret"))))
    return linked.groupBy("row_key").agg(F.array_sort(F.collect_list(
        F.struct("start", "rank", "end"))).alias("linked"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, base and spans (base and linked weak ones,
    by start and kind).

    Null and empty texts have none; rows may repeat; an empty table gives no rows; columns other
    than doc_id and text are not read. Texts are scanned once: the spans are written to the
    shared folder, and only rows with parts take part in the join.
    """
    spans = cut_lineage(base_spans(docs))
    linked = cut_lineage(linked_spans(spans, scope))
    out = spans.where("row_key is not null").join(linked, "row_key", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return out.select("doc_id", "row_key", "base", F.array_sort(F.concat(
        "base", F.coalesce("linked", none))).alias("spans")).unionByName(
        spans.where("row_key is null").select("doc_id", "row_key", "base",
                                              F.col("base").alias("spans")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``."""
    found_in = secret_spans(docs, scope)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(k).alias(f"n_{n}") for k, n in enumerate(BASE)]
    return found_in.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                           written(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by one mask.

    The text is cut where runs of spans begin, and within a run where spans do, so that a position
    is not sought from the start of the text for each span.
    """
    def walk(at: Column, run: Column) -> Column:
        end = F.coalesce(F.array_max(F.transform(run, lambda x: x["end"])), at)
        stretch = F.substr(text, at + 1, F.greatest(end - at, F.lit(0)))

        def pieces(part: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                fresh = x["start"] >= s["at"]
                head = F.concat(F.substr(part, s["at"] - at + 1, x["start"] - s["at"]), F.lit(MASK))
                return F.struct(F.greatest(x["end"], s["at"]).alias("at"), F.when(
                    fresh, F.concat(s["out"], F.array(head))).otherwise(s["out"]).alias("out"))

            return F.aggregate(run, F.struct(
                at.alias("at"), F.array().cast("array<string>").alias("out")), step)

        return let(stretch, pieces)

    last = F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0))
    return F.concat(F.array_join(in_runs(spans, F.lit(0), "string", walk), ""),
                    F.substr(text, last + 1, F.length(text)))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with all secret spans masked in text (n_chars, if present, follows).

    Every row stays. Rows with spans are few; they are looked up by key, by a broadcast where
    their number was checked, else by a join that moves each text once.
    """
    hits = secret_spans(docs, scope).where(F.size("spans") > 0).select("row_key", "spans").distinct()
    hits = cut_lineage(hits.withColumnsRenamed({"row_key": "_row_key", "spans": "_spans"}))
    out = docs.withColumn("_key", row_key()).join(
        broadcast_if_small(hits), F.col("_key") == F.col("_row_key"), "left")
    hit = F.col("_spans").isNotNull()
    clean = F.when(hit, masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(
            F.col("n_chars")))
    return out.select(*docs.columns)
