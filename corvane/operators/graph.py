"""Edges of the property graph and queries over it.

Tables: ``entities(owner_id, entity_id, name, name_norm, type, description, ..)``,
``mentions(owner_id, file_id, chunk_id, entity_id)`` and
``edges(owner_id, src, dst, rel_type, description)`` between entities.
The owner is part of every join key.

Hub entities decide the design: wherever a query keeps the first n rows of an entity, the
rows are ranked and cut per entity before they meet the questions. The rank filter runs in
each task ahead of the shuffle, so a hub costs n rows per task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.text import normalize_name, split_words
from corvane.operators.extraction import word_runs
from corvane.session import by_shuffle, by_size, cut_lineage


def first_per(df: DataFrame, by: list, order: list, limit: int | Column, name: str | None = None
              ) -> DataFrame:
    """First rows per key in a total order."""
    place = name or "_place"
    ranked = df.withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    cut = ranked.filter(F.col(place) <= limit)
    return cut if name else cut.drop(place)


# --- Building -------------------------------------------------------------

def mention_edges(mentions: DataFrame) -> DataFrame:
    return mentions.select("owner_id", F.col("chunk_id").alias("src"),
                           F.col("entity_id").alias("dst"),
                           F.lit("MENTIONS").alias("rel_type")).distinct()


def relation_edges(relations: DataFrame, order: str = "rel_ord") -> DataFrame:
    """One edge per (source, type, target); the last description wins."""
    return relations.groupBy("owner_id", "src", "dst", "rel_type").agg(
        F.max_by("description", order).alias("description"))


def cooccurring(mentions: DataFrame, block: int = 64) -> DataFrame:
    """Unordered pairs ``(owner_id, a, b)`` of entities named in the same chunk, once for each chunk.

    The pairs are the result itself. Mentions are shuffled by chunk once, and a chunk of up to
    ``block`` entities is paired where it lies. The entities of a larger chunk are spread over blocks
    and joined block against block, so it is shared by many tasks.
    """
    chunk = ["owner_id", "chunk_id"]
    seen = mentions.select(*chunk, "entity_id").repartition(*chunk).distinct()
    sized = seen.withColumn("n", F.count("*").over(W.partitionBy(*chunk))).filter("n > 1")
    small = sized.filter(F.col("n") <= block).groupBy(*chunk).agg(
        F.array_sort(F.collect_list("entity_id")).alias("l"))
    first = small.select("owner_id", F.posexplode("l").alias("i", "a"), "l")
    inside = first.select("owner_id", "a", F.explode(
        F.expr("slice(l, i + 2, size(l))")).alias("b"))
    large = sized.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.hash("entity_id"), F.col("blocks"))
    keyed = large.select(
        *chunk, "entity_id", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        *chunk, "entity_id", "mine",
        F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    a = keyed.select(*chunk, "lo", "hi", F.col("entity_id").alias("a"), F.col("mine").alias("ma"))
    b = keyed.select(*chunk, "lo", "hi", F.col("entity_id").alias("b"), F.col("mine").alias("mb"))
    across = (F.col("lo") == F.col("hi")) | (F.col("ma") != F.col("mb"))
    apart = a.join(by_shuffle(b), [*chunk, "lo", "hi"]).filter((F.col("a") < F.col("b")) & across)
    return inside.unionByName(apart.select("owner_id", "a", "b"))


def cooccurrence_edges(mentions: DataFrame, block: int = 64) -> DataFrame:
    """Unordered pairs of entities named in the same chunk, with the number of shared chunks.

    Equal pairs are counted in each task before the shuffle.
    """
    return cooccurring(mentions, block).groupBy("owner_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(
        F.count("*").alias("chunks")).select(
        "owner_id", "src", "dst", F.lit("COOCCURS_WITH").alias("rel_type"),
        F.lit("").alias("description"), "chunks")


def graph_build_stats(chunks: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Chunks processed, entities and relations written per file."""
    key = ["owner_id", "file_id"]
    parts = [
        chunks.groupBy(*key).agg(F.count("*").alias("chunks_processed")),
        mentions.groupBy(*key).agg(F.count("*").alias("entity_upserts")),
        relations.groupBy(*key).agg(F.count("*").alias("relation_upserts")),
    ]
    out = parts[0].join(parts[1], key, "left").join(parts[2], key, "left")
    return out.select(*key, "chunks_processed",
                      *[F.coalesce(c, F.lit(0)).alias(c)
                        for c in ("entity_upserts", "relation_upserts")])


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends; a self loop once."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("back")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("back")))
    rows = edges.select("*", F.explode(ends).alias("_e"))
    return rows.filter((F.col("src") != F.col("dst")) | (F.col("_e.back") == 0)).select(
        *edges.columns, "_e.*")


# --- Numbers for ids ------------------------------------------------------

def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with dense numbers ``no`` from 0 in the order of the columns, which must tell rows apart.

    One shuffle by range; the driver sees the number of rows of each partition only.
    """
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        starts += [before] * (part + 1 - len(starts))
        before += n
    first = F.array(*[F.lit(x).cast("bigint") for x in starts or [0]])
    row = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    no = F.element_at(first, F.col("_part") + 1) + row
    return placed.withColumn("no", no.cast("int" if before < 2**31 else "bigint")).drop("_part", "_row")


class Numbered(NamedTuple):
    """Edges whose owners and ends are numbers in the order of their ids.

    ``owners(owner_id, no)`` and ``names(name, no)`` tell what the numbers stand for; an end is
    owner number * ``per_owner`` + name number, and its id is made of owner and name by ``id_of``.
    """
    edges: DataFrame
    owners: DataFrame
    names: DataFrame
    per_owner: int
    id_of: Callable[[Column, Column], Column]
    name_of: Callable[[Column, Column], Column]

    def numbers(self, rows: DataFrame, *ends: str) -> DataFrame:
        """Rows with numbers instead of ids in ``owner_id`` and the given columns; unknown ids are left out."""
        owners = by_size(self.owners.select("owner_id", F.col("no").alias("_owner")))
        out = rows.join(owners, "owner_id")
        for c in ends:
            names = self.names.select(F.col("name").alias("_name"), F.col("no").alias("_no"))
            node = F.col("_owner").cast("bigint") * self.per_owner + F.col("_no")
            out = out.withColumn("_name", self.name_of(F.col("owner_id"), F.col(c))).join(
                by_shuffle(names), "_name").withColumn(c, node.cast(self.edges.schema["src"].dataType)).drop("_name", "_no")
        return out.withColumn("owner_id", F.col("_owner")).select(*rows.columns)

    def named(self, rows: DataFrame, *ends: str) -> DataFrame:
        """Rows with ids instead of numbers in ``owner_id`` and the given columns."""
        owners = by_size(self.owners.select(F.col("no").alias("owner_id"), F.col("owner_id").alias("_owner")))
        out = rows.join(owners, "owner_id")
        for c in ends:
            names = self.names.select(F.col("no").alias("_no"), F.col("name").alias("_name"))
            out = out.withColumn("_no", F.pmod(F.col(c), F.lit(self.per_owner)).cast(names.schema["_no"].dataType)).join(
                by_shuffle(names), "_no").withColumn(c, self.id_of(F.col("_owner"), F.col("_name"))).drop("_no", "_name")
        return out.withColumn("owner_id", F.col("_owner")).select(*rows.columns)


def number_ends(edges: DataFrame) -> Numbered:
    """Edges with numbers for their owners and ends."""
    edges = cut_lineage(edges)
    owners = cut_lineage(numbered(edges.select("owner_id").distinct(), "owner_id"))
    names = cut_lineage(numbered(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct(), "name"))
    per_owner = max(names.count(), 1)
    out = edges.join(by_size(owners.withColumnRenamed("no", "_owner")), "owner_id")
    for c in ("src", "dst"):
        out = out.join(by_shuffle(names.select(F.col("name").alias(c), F.col("no").alias("_no"))), c).withColumn(
            c, F.col("_owner").cast("bigint") * per_owner + F.col("_no")).drop("_no")
    out = out.withColumn("owner_id", F.col("_owner")).select(*edges.columns)
    return Numbered(out, owners, names, per_owner, lambda owner, name: name, lambda owner, end: end)


# --- Linking questions ----------------------------------------------------

def link_entities(questions: DataFrame, entities: DataFrame, limit: int = 20,
                  max_words: int | None = None) -> DataFrame:
    """Entities named by each question ``(owner_id, query_id, question)``, longest norm first.

    A norm matches as a run of words of the question; a person or organisation also by a
    single telling word. Both are equality joins. A word shared by many names is cut to
    the names that can still be among the first ``limit``.
    """
    named = entities.filter(F.length("name_norm") >= 3).select(
        "owner_id", "name_norm", "type").distinct()
    norm = normalize_name("question")
    asked = by_shuffle(questions.select("owner_id", "query_id", norm.alias("q")))
    if max_words is None:
        max_words = 8
    sized = named.withColumn("words", F.size(F.split("name_norm", " ")))
    runs = asked.select("owner_id", "query_id", F.explode(word_runs(F.col("q"), max_words))
                        .alias("name_norm"))
    whole = runs.join(sized.filter(F.col("words") <= max_words)
                      .select("owner_id", "name_norm").distinct(), ["owner_id", "name_norm"])
    # Names of more words than the runs hold are met by their first run and then compared.
    longer = sized.filter(F.col("words") > max_words).select(
        "owner_id", F.col("name_norm").alias("long_norm"),
        F.array_join(F.slice(F.split("name_norm", " "), 1, max_words), " ").alias("name_norm")
    ).distinct()
    starts = runs.join(longer, ["owner_id", "name_norm"]).join(asked, ["owner_id", "query_id"])
    long_hits = starts.filter(F.contains(
        F.concat(F.lit(" "), F.col("q"), F.lit(" ")),
        F.concat(F.lit(" "), F.col("long_norm"), F.lit(" ")))).select(
        "owner_id", F.col("long_norm").alias("name_norm"), "query_id")
    order = [F.desc(F.length("name_norm")), "name_norm"]
    by_word = first_per(
        named.filter(F.col("type").isin("PERSON", "ORGANIZATION"))
        .select("owner_id", "name_norm", F.explode(F.array_distinct(F.split("name_norm", " ")))
                .alias("word"))
        .filter((F.length("word") >= 3) & ~F.col("word").isin(lx.ENTITY_LINK_STOPWORDS))
        .distinct(),
        ["owner_id", "word"], order, limit)
    words = asked.select("owner_id", "query_id",
                         F.explode(F.array_distinct(split_words(F.col("q"), 3))).alias("word"))
    token = words.join(by_word, ["owner_id", "word"]).select("owner_id", "name_norm", "query_id")
    hits = whole.unionByName(long_hits).unionByName(token).distinct()
    return first_per(hits, ["owner_id", "query_id"], order, limit, "place").select(
        "owner_id", "query_id", "name_norm", "place")


# --- Facts ----------------------------------------------------------------

#: A table, or a function that gives the rows of it at entities ``(owner_id, entity_id)``, for graphs that
#: are cheaper to derive around a few entities than to store.
Rows = DataFrame | Callable[[DataFrame], DataFrame]


def _rows_at(rows: Rows, wanted: DataFrame) -> DataFrame:
    return rows(wanted) if callable(rows) else rows


def _wanted(start: DataFrame, *tables: Rows) -> DataFrame:
    """Distinct entities of the rows; written once where tables are derived from them."""
    wanted = start.select("owner_id", "entity_id").distinct()
    return cut_lineage(wanted) if any(map(callable, tables)) else wanted


def _asked(entities: DataFrame, linked: DataFrame) -> DataFrame:
    """Entities with a linked name, met before anything else is done with them."""
    return entities.join(by_shuffle(linked.select("owner_id", "name_norm").distinct()),
                         ["owner_id", "name_norm"], "left_semi")


def graph_facts(linked: DataFrame, entities: DataFrame, edges: Rows, mentions: Rows,
                documents: DataFrame, limit: int | Column = 40) -> DataFrame:
    """Fact rows of the linked entities: entity, neighbour and relation, chunk and document.

    Rows pair each relation of an entity with each chunk that mentions it, in the order of
    place, neighbour, type, direction and chunk; ``limit`` rows (a number, or the column
    ``row_limit`` of ``linked``) are kept per question. At most as many relations and chunks of
    one entity can be among them, so both lists are cut to the largest limit, and a pair is
    made only if it can be among the first rows of its entity.
    """
    per_question = "row_limit" in linked.columns
    most = largest_limit(F.col("row_limit") if per_question else limit, linked)
    ent = _asked(entities, linked).select("owner_id", "entity_id", "name_norm", "name", "type",
                          F.substring(F.coalesce("description", F.lit("")), 1, 120)
                          .alias("description"))
    # Copies of an entity give equal rows: one stands for all, and its pairs are repeated at the end.
    ent = ent.groupBy(*ent.columns).agg(F.count("*").alias("copies"))
    start = linked.select("owner_id", "query_id", "name_norm", "place",
                          *(["row_limit"] if per_question else [])).join(
        by_shuffle(ent), ["owner_id", "name_norm"])
    wanted = _wanted(start, edges, mentions)
    edges, mentions = _rows_at(edges, wanted), _rows_at(mentions, wanted)
    names = entities.select("owner_id", F.col("entity_id").alias("other"),
                            F.col("name").alias("related_name"),
                            F.col("name_norm").alias("related_norm"))
    around = undirected(edges).select(
        "owner_id", F.col("node").alias("entity_id"), "other", "rel_type",
        F.substring(F.coalesce("description", F.lit("")), 1, 80).alias("rel_desc"), "back")
    rels = first_per(
        around.join(by_shuffle(wanted), ["owner_id", "entity_id"], "left_semi")
        .join(by_shuffle(names), ["owner_id", "other"]),
        ["owner_id", "entity_id"], ["related_norm", "rel_type", "back", "rel_desc"], most, "rel_no"
    ).drop("other")
    refs = first_per(
        mentions.select("owner_id", "file_id", "chunk_id", "entity_id").distinct()
        .join(by_shuffle(wanted), ["owner_id", "entity_id"], "left_semi"),
        ["owner_id", "entity_id"], ["chunk_id", "file_id"], most, "ref_no")
    docs = documents.select("owner_id", "file_id", "file_name", "link")
    placed = refs.join(by_shuffle(docs), ["owner_id", "file_id"], "left")
    # pair k of the entity's chunks follows (rel_no - 1) * chunks others, so later pairs are not made
    chunks = placed.groupBy("owner_id", "entity_id").agg(F.max("ref_no").alias("refs"))
    rels = rels.join(by_shuffle(chunks), ["owner_id", "entity_id"], "left").filter(
        (F.col("rel_no") - 1) * F.coalesce("refs", F.lit(1)) < most)
    rows = start.join(by_shuffle(rels), ["owner_id", "entity_id"], "left").join(
        by_shuffle(placed), ["owner_id", "entity_id"], "left").filter(
        ((F.coalesce("rel_no", F.lit(1)) - 1) * F.coalesce("refs", F.lit(1))
         + F.coalesce("ref_no", F.lit(1)) - 1) * F.col("copies") < most).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(max(most, 1)).cast("bigint"))))
    ).drop("refs", "copies", "copy")
    order = ["place", F.coalesce("rel_no", F.lit(0)), F.coalesce("ref_no", F.lit(0))]
    cap = F.col("row_limit") if per_question else limit
    return first_per(rows, ["owner_id", "query_id"], order, cap, "row_no")


def fact_relations(facts: DataFrame) -> DataFrame:
    """Relations of the fact rows, once per (from, to, type), in order of first appearance."""
    key = ["owner_id", "query_id", "name", "related_name", "rel_type"]
    return facts.filter("related_name is not null").groupBy(*key).agg(
        F.min_by("rel_desc", "row_no").alias("rel_desc"), F.min("row_no").alias("row_no"))


def facts_text(facts: DataFrame) -> DataFrame:
    """Text block: entities, the first 20 relations and the first 8 sources."""
    q = ["owner_id", "query_id"]
    ents = facts.groupBy(*q, "name").agg(
        F.min_by("type", "row_no").alias("type"),
        F.min_by("description", "row_no").alias("description"), F.min("row_no").alias("n"))
    ent_line = F.concat(F.lit("- "), F.col("name"), F.lit(" ["), F.col("type"), F.lit("]"),
                        F.when(F.col("description") != "",
                               F.concat(F.lit(": "), F.col("description"))).otherwise(F.lit("")))
    rel_line = F.concat(F.lit("- "), F.col("name"), F.lit(" —["), F.col("rel_type"), F.lit("]→ "),
                        F.col("related_name"),
                        F.when(F.col("rel_desc") != "",
                               F.concat(F.lit(" ("), F.col("rel_desc"), F.lit(")")))
                        .otherwise(F.lit("")))
    rels = first_per(fact_relations(facts), q, ["row_no", "related_name"], 20, "n")
    refs = first_per(
        facts.filter("chunk_id is not null").groupBy(*q, "chunk_id").agg(
            F.min(F.struct("row_no", F.coalesce(F.nullif("file_name", F.lit("")), "chunk_id")
                           .alias("label"))).alias("r")),
        q, ["r.row_no", "chunk_id"], 8, "n")
    lines = (
        ents.select(*q, F.lit(1).alias("part"), "n", ent_line.alias("line"))
        .unionByName(rels.select(*q, F.lit(2).alias("part"), "n", rel_line.alias("line")))
        .unionByName(refs.select(*q, F.lit(3).alias("part"), "n", F.col("r.label").alias("line")))
        .withColumn("at", F.struct("n", "line"))
    )
    text = lines.groupBy(*q).agg(*[
        F.expr(f"listagg(line, '{sep}') within group (order by at) filter (where part = {p})")
        .alias(name)
        for p, name, sep in ((1, "ents", "\\n"), (2, "rels", "\\n"), (3, "refs", ", "))])
    block = F.concat_ws(
        "\n\n", F.lit(lx.FACTS_TITLE),
        F.concat(F.lit("Thực thể:\n"), F.col("ents")),
        F.concat(F.lit("Quan hệ:\n"), F.col("rels")),
        F.concat(F.lit("Nguồn tài liệu liên quan: "), F.col("refs")))
    return text.select(*q, block.alias("text"))


# --- Paths ----------------------------------------------------------------

def question_pairs(linked: DataFrame, most: int = 6) -> DataFrame:
    """Pairs among the longest ``most`` norms of each question, in order."""
    top = linked.filter(F.col("place") <= most)
    listed = top.groupBy("owner_id", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "name_norm"))).alias("l"))
    one = listed.select("owner_id", "query_id", "l", F.explode("l").alias("a"))
    both = one.select("owner_id", "query_id", "a", F.explode("l").alias("b"))
    return both.filter(F.col("a.place") < F.col("b.place")).select(
        "owner_id", "query_id", F.col("a.name_norm").alias("norm_a"),
        F.col("b.name_norm").alias("norm_b"),
        F.struct(F.col("a.place").alias("pa"), F.col("b.place").alias("pb")).alias("pair_order"))


def _search(pairs: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Shortest paths of ``(owner_id, a, b)`` pairs as ``(.., hops, nodes, rels)``.

    An end with one neighbour is searched from there: its paths are those of the neighbour and a step
    more, and the many ends of a hub are one end.
    """
    links = undirected(edges).select("owner_id", "node", "other",
                                     F.struct("rel_type", "description", "back").alias("step"))
    wanted = cut_lineage(pairs.select("owner_id", "a", "b").distinct().filter("a <> b"))
    ends = wanted.select("owner_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    single = cut_lineage(links.filter("node <> other").join(by_size(ends, 400_000), ["owner_id", "node"]).groupBy(
        "owner_id", "node").agg(F.min("other").alias("to"), F.max("other").alias("last"), F.min("step").alias("step")
                                ).filter("to = last").drop("last"))
    placed = wanted
    for c in "ab":
        placed = placed.join(by_shuffle(single.select("owner_id", F.col("node").alias(c), F.col("to").alias(f"to_{c}"),
                                                      F.col("step").alias(f"step_{c}"))), ["owner_id", c], "left")
    direct = F.coalesce(F.col("to_a") == F.col("b"), F.lit(False)) | F.coalesce(F.col("to_b") == F.col("a"), F.lit(False))
    x, y = (F.when(direct, F.col(c)).otherwise(F.coalesce(f"to_{c}", c)) for c in "ab")
    placed = placed.withColumns({"x": x, "y": y}).drop("to_a", "to_b")
    more = (F.col("x") != F.col("a")).cast("int") + (F.col("y") != F.col("b")).cast("int")
    placed = by_shuffle(cut_lineage(placed.withColumn("more", more)))
    inner = placed.filter("x <> y").groupBy("owner_id", "x", "y").agg((max_hops - F.min("more")).alias("most")).select(
        "owner_id", F.col("x").alias("a"), F.col("y").alias("b"), "most")
    found = _between(inner, links, max_hops, not placed.filter("more > 0").isEmpty())
    rows = placed.join(found.withColumnsRenamed({"a": "x", "b": "y"}), ["owner_id", "x", "y"]).unionByName(
        placed.filter("x = y").withColumns({"hops": F.lit(0), "nodes": F.array("x"), "rels": F.array().cast(RELS)}))
    rows = rows.withColumn("hops", F.col("hops") + F.col("more")).filter(F.col("hops") <= max_hops)
    moved_a, moved_b = F.col("x") != F.col("a"), F.col("y") != F.col("b")
    rows = rows.withColumns({
        "nodes": F.when(moved_a, F.array_prepend("nodes", F.col("a"))).otherwise(F.col("nodes")),
        "rels": F.when(moved_a, F.array_prepend("rels", F.col("step_a"))).otherwise(F.col("rels"))})
    rows = rows.withColumns({
        "nodes": F.when(moved_b, F.array_append("nodes", F.col("b"))).otherwise(F.col("nodes")),
        "rels": F.when(moved_b, F.array_append("rels", _reverse(F.col("step_b")))).otherwise(F.col("rels"))})
    return cut_lineage(rows.select("owner_id", "a", "b", "hops", "nodes", "rels"))


RELS = "array<struct<rel_type:string,description:string,back:int>>"


def _reverse(step: Column) -> Column:
    return F.struct(step["rel_type"].alias("rel_type"), step["description"].alias("description"),
                    (1 - step["back"]).alias("back"))


def _between(pairs: DataFrame, links: DataFrame, max_hops: int, moved: bool) -> DataFrame:
    """Shortest paths of distinct pairs ``(owner_id, a, b, most)`` with at most ``most`` hops.

    Breadth-first from both ends, one hop at a time and turn about; a pair leaves as soon as
    its two sides meet, and an end leaves with its last open pair. A reached node keeps only its
    parent and the step from there, the smallest, so equal inputs give equal paths; paths are put
    together from the parents for the pairs that were found. The loop has ``max_hops`` turns; the
    last one only looks at nodes that the other side has reached. The first turn reads the edges
    beside the ends, unless ends were moved to hubs; the links that later turns walk are written only if
    a pair is still open.
    """
    wanted = by_shuffle(cut_lineage(pairs))
    left = wanted.count()
    some = {r["most"] for r in wanted.select("most").distinct().collect()}
    ends = wanted.select("owner_id", F.explode(F.array("a", "b")).alias("other"))
    front = {side: wanted.select("owner_id", F.col(side).alias("root"), F.col(side).alias("node"))
             .distinct() for side in "ab"}
    reached, parents = dict(front), {"a": [], "b": []}
    found = None
    for turn in range(1, max_hops + 1):
        side, far = "ab" if turn % 2 else "ba"
        if turn - 1 in some:
            wanted = by_shuffle(cut_lineage(wanted.filter(F.col("most") >= turn)))
            left = wanted.count()
            if not left:
                break
        roots = wanted.select("owner_id", F.col(side).alias("root")).distinct()
        if turn == (1 if moved else 2):
            links = _through(links, ends)
        near = links
        if turn == max(some, default=max_hops):
            near = links.join(by_shuffle(front[far].select("owner_id", F.col("node").alias("other")).distinct()),
                              ["owner_id", "other"], "left_semi")
        starts = front[side].join(by_shuffle(roots), ["owner_id", "root"], "left_semi")
        fresh = cut_lineage(
            near.join(by_size(starts, 400_000), ["owner_id", "node"])
            .select("owner_id", "root", F.col("other").alias("node"),
                    F.struct(F.col("node").alias("parent"), "step").alias("via"))
            .join(by_shuffle(reached[side]), ["owner_id", "root", "node"], "left_anti")
            .groupBy("owner_id", "root", "node").agg(F.min("via").alias("via")))
        met = cut_lineage(
            wanted.join(fresh.select("owner_id", F.col("root").alias(side), "node"), ["owner_id", side])
            .join(by_shuffle(front[far].select("owner_id", F.col("root").alias(far), "node")),
                  ["owner_id", far, "node"])
            .groupBy("owner_id", "a", "b").agg(F.min("node").alias("node")))
        parents[side].append(fresh)
        front[side] = fresh.select("owner_id", "root", "node")
        reached[side] = reached[side].unionByName(front[side])
        n_met = met.count()
        if n_met:
            rows = _told(met, parents).withColumn("hops", F.lit(turn))
            found = rows if found is None else found.unionByName(rows)
            left -= n_met
            wanted = by_shuffle(cut_lineage(wanted.join(met, ["owner_id", "a", "b"], "left_anti")))
        if left <= 0:
            break
    if found is None:
        found = wanted.limit(0).select("owner_id", "a", "b", F.array("a").alias("nodes"), F.array().cast(RELS).alias("rels"),
                                       F.lit(0).alias("hops"))
    return cut_lineage(found.select("owner_id", "a", "b", "hops", "nodes", "rels"))


def _through(links: DataFrame, ends: DataFrame) -> DataFrame:
    """The smallest link of each (node, other), without links to a dead end.

    A node with one neighbour is on no shortest path but as its end. Both sides would meet at the
    neighbour before they meet there, so a hub's leaves need not be reached.
    """
    inner = links.filter("node <> other").groupBy("owner_id", F.col("node").alias("other")).agg(
        F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo < hi")
    goal = inner.select("owner_id", "other").unionByName(ends).distinct()
    return cut_lineage(links.join(by_shuffle(goal), ["owner_id", "other"], "left_semi").groupBy(
        "owner_id", "node", "other").agg(F.min("step").alias("step")))


def _told(met: DataFrame, parents: dict[str, list[DataFrame]]) -> DataFrame:
    """Nodes and relations of the paths over the node where both sides met, end by end.

    ``parents`` holds the nodes that each side reached, one table per hop.
    """
    rows = met.withColumns({"nodes": F.array("node"), "rels": F.array().cast(RELS)})
    for side in "ab":
        rows = rows.withColumn("at", F.col("node"))
        for hop in reversed(parents[side]):
            via = hop.select("owner_id", F.col("root").alias(side), F.col("node").alias("at"), "via")
            rows = rows.join(by_shuffle(via), ["owner_id", side, "at"])
            parent, step = F.col("via.parent"), F.col("via.step")
            if side == "a":
                nodes, steps = F.array_prepend("nodes", parent), F.array_prepend("rels", step)
            else:
                nodes, steps = F.array_append("nodes", parent), F.array_append("rels", _reverse(step))
            rows = rows.withColumns({"nodes": nodes, "rels": steps, "at": parent}).drop("via")
    return rows.drop("at", "node")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """One shortest path per pair of entities, undirected.

    Co-occurrence edges are used only for pairs that no path of other relations connects.
    """
    wanted = pairs.select("owner_id", "a", "b").distinct()
    telling = _search(wanted, edges.filter("rel_type <> 'COOCCURS_WITH'"), max_hops)
    rest = cut_lineage(wanted.join(by_shuffle(telling), ["owner_id", "a", "b"], "left_anti"))
    found = telling.withColumn("semantic", F.lit(True))
    if rest.isEmpty():
        return found
    return found.unionByName(_search(rest, edges, max_hops).withColumn("semantic", F.lit(False)))


def entity_paths(linked: DataFrame, entities: DataFrame, edges: DataFrame | Numbered, max_paths: int = 5,
                 max_hops: int = 5) -> tuple[DataFrame, DataFrame]:
    """Paths of each question as readable steps, and their relations once each, in order.

    Numbered edges are searched by number; the steps of the best paths get their ids.
    """
    ids = entities.groupBy("owner_id", "name_norm").agg(F.min("entity_id").alias("entity_id"))
    pairs = question_pairs(linked)
    for side in ("a", "b"):
        pairs = pairs.join(by_shuffle(ids.select("owner_id", F.col("name_norm").alias(f"norm_{side}"),
                                                 F.col("entity_id").alias(side))),
                           ["owner_id", f"norm_{side}"])
    graph = edges if isinstance(edges, Numbered) else None
    pairs = cut_lineage(graph.numbers(pairs, "a", "b") if graph else pairs)
    paths = cut_lineage(shortest_paths(pairs, graph.edges if graph else edges, max_hops))
    best = first_per(pairs.join(by_shuffle(paths), ["owner_id", "a", "b"]), ["owner_id", "query_id"],
                     ["pair_order"], max_paths, "path_no")
    steps = best.select(
        "owner_id", "query_id", "path_no", "hops", "semantic", "norm_a", "norm_b",
        F.posexplode(F.arrays_zip(
            F.slice(F.col("nodes"), 1, F.size("nodes") - 1).alias("f"),
            F.slice(F.col("nodes"), 2, F.size("nodes")).alias("t"),
            F.col("rels").alias("r"))).alias("step_no", "s"))
    name = entities.groupBy("owner_id", "entity_id").agg(F.min("name").alias("name"))
    steps = steps.select("*", F.col("s.f").alias("f"), F.col("s.t").alias("t"))
    steps = (graph.named(steps, "f", "t") if graph else steps).join(
        by_shuffle(name.select("owner_id", F.col("entity_id").alias("f"), F.col("name").alias("from_name"))),
        ["owner_id", "f"]).join(
        by_shuffle(name.select("owner_id", F.col("entity_id").alias("t"), F.col("name").alias("to_name"))),
        ["owner_id", "t"])
    text = F.concat("from_name", F.lit(" —["), F.col("s.r.rel_type"), F.lit("]→ "), F.col("to_name"),
                    F.when(F.coalesce(F.col("s.r.description"), F.lit("")) != "", F.concat(
                        F.lit(" ("), F.col("s.r.description"), F.lit(")"))).otherwise(F.lit("")))
    detailed = steps.select(
        "owner_id", "query_id", "path_no", "norm_a", "norm_b", "hops", "semantic", "step_no",
        "from_name", "to_name", F.col("s.r.rel_type").alias("rel_type"),
        F.substring(F.coalesce(F.col("s.r.description"), F.lit("")), 1, 80).alias("description"),
        text.alias("step"))
    whole = detailed.groupBy("owner_id", "query_id", "path_no", "norm_a", "norm_b", "hops",
                             "semantic").agg(
        F.min_by("from_name", "step_no").alias("from_name"),
        F.max_by("to_name", "step_no").alias("to_name"),
        F.expr("listagg(step, '\\n') within group (order by step_no)").alias("steps"))
    relations = detailed.groupBy("owner_id", "query_id", "from_name", "to_name", "rel_type").agg(
        F.min_by("description", F.struct("path_no", "step_no")).alias("description"),
        F.min(F.struct("path_no", "step_no")).alias("at"))
    return whole, relations


def paths_text(paths: DataFrame) -> DataFrame:
    bullets = F.concat(F.lit("  • "), F.replace("steps", F.lit("\n"), F.lit("\n  • ")))
    block = F.concat(F.lit("Đường "), F.col("path_no").cast("string"), F.lit(": "),
                     F.col("from_name"), F.lit(" ↔ "), F.col("to_name"), F.lit(" ("),
                     F.col("hops").cast("string"), F.lit(" bước)\n"), bullets)
    return paths.select("owner_id", "query_id", "path_no", block.alias("block")).groupBy(
        "owner_id", "query_id").agg(F.expr(
            "listagg(block, '\\n\\n') within group (order by path_no)").alias("body")).select(
        "owner_id", "query_id",
        F.concat(F.lit(lx.PATHS_TITLE + "\n\n"), F.col("body")).alias("text"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """Nodes within ``depth`` hops of each seed ``(owner_id, entity_id)``, nearest first.

    A hop keeps the first ``limit`` nodes of each root, and a root that has as many goes no further:
    nothing beyond can be in the result. So no hop starts from more than ``limit`` nodes of a root.
    A frontier that was counted small meets the edges where they lie. Steps are shuffled once, by root:
    each task sends the first nodes of a root only, as many as may be new or were seen before.
    """
    both = undirected(edges).select("owner_id", "node", "other", "rel_type")
    root, key = ["owner_id", "root"], ["owner_id", "root", "node"]
    seen = seeds.select("owner_id", F.col("entity_id").alias("root"),
                        F.col("entity_id").alias("node"), F.lit(0).alias("hops"),
                        F.lit("").alias("rel_type")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        step = both.join(by_size(frontier.select(*key), 400_000), ["owner_id", "node"]).select(
            *root, F.col("other").alias("node"), "rel_type", F.lit(False).alias("_seen")).unionByName(
            seen.select(*key, "rel_type", F.lit(True).alias("_seen")))
        # a root that goes on has seen itself and fewer than ``limit`` others
        near = step.withColumn("_no", F.dense_rank().over(W.partitionBy(*root).orderBy("node"))).filter(
            F.col("_no") <= 2 * limit)
        fresh = near.groupBy(*key).agg(F.min("rel_type").alias("rel_type"), F.max("_seen").alias("_seen")).filter(
            ~F.col("_seen")).drop("_seen")
        fresh = cut_lineage(first_per(fresh, root, ["node"], limit, "place").select(
            *key, F.lit(hop).alias("hops"), "rel_type"))
        seen = seen.unionByName(fresh)
        done = seen.filter("hops > 0").groupBy(*root).count().filter(F.col("count") >= limit)
        frontier = fresh.join(by_shuffle(done), root, "left_anti")
    return first_per(seen.filter("hops > 0"), root, ["hops", "node"], limit)


# --- Chunk retrieval over the graph ---------------------------------------

def _entity_chunks(mentions: DataFrame, most: int) -> DataFrame:
    """First chunks of each entity by id."""
    return first_per(
        mentions.select("owner_id", "file_id", "chunk_id", "entity_id").distinct(),
        ["owner_id", "entity_id"], ["chunk_id", "file_id"], most, "chunk_no")


def _copies(entities: DataFrame, *columns: str) -> DataFrame:
    """Ids of entities with the number of their equal rows in ``copies``."""
    return entities.groupBy("owner_id", "entity_id", "name_norm", *columns).agg(F.count("*").alias("copies"))


def graph_hop1(linked: DataFrame, entities: DataFrame, mentions: Rows,
               max_results: int | Column = 10) -> DataFrame:
    """Chunks that mention a linked entity, 1.0 each, at most 2 * max per entity.

    Only the first chunks of an entity, twice the largest max, meet the questions. Equal rows of an
    entity are one with their number in ``copies``, by which the score of a row counts.
    """
    most = 2 * largest_limit(max_results, linked)
    start = linked.join(by_shuffle(_copies(_asked(entities, linked), "name", "type")), ["owner_id", "name_norm"])
    wanted = _wanted(start, mentions)
    near = _entity_chunks(_rows_at(mentions, wanted).join(by_shuffle(wanted), ["owner_id", "entity_id"], "left_semi"), most)
    return start.join(by_shuffle(near), ["owner_id", "entity_id"]).filter(
        F.col("chunk_no") <= 2 * _as_col(max_results)).withColumn("score", F.lit(1.0))


def graph_hop2(linked: DataFrame, entities: DataFrame, edges: Rows, mentions: Rows,
               max_results: int | Column = 10) -> DataFrame:
    """Chunks that mention a neighbour of a linked entity, 0.5 per path, at most max per entity.

    Paths are ordered by neighbour, type, direction and chunk. Every neighbour kept here has
    a chunk, so the first n paths lie on the first n edges; n is the largest max. Equal rows of an
    entity repeat each path, and only repeats among the first n rows of the entity are made.
    """
    most = largest_limit(max_results, linked)
    start = linked.join(by_shuffle(_copies(_asked(entities, linked))), ["owner_id", "name_norm"])
    wanted = _wanted(start, edges, mentions)
    around = undirected(_rows_at(edges, wanted)).select("owner_id", F.col("node").alias("entity_id"), "other",
                                                        "rel_type", "back").join(
        by_shuffle(wanted), ["owner_id", "entity_id"], "left_semi")
    if callable(mentions):
        around = cut_lineage(around)
    met = around.select("owner_id", F.col("other").alias("entity_id")).distinct()
    named = _rows_at(mentions, met).select("owner_id", F.col("entity_id").alias("other")).distinct()
    steps = first_per(
        around.join(by_shuffle(named), ["owner_id", "other"], "left_semi"),
        ["owner_id", "entity_id"], ["other", "rel_type", "back"], most, "edge_no")
    if callable(mentions):
        steps = cut_lineage(steps)
    others = steps.select("owner_id", F.col("other").alias("entity_id")).distinct()
    far = _entity_chunks(_rows_at(mentions, others).join(by_shuffle(others), ["owner_id", "entity_id"], "left_semi"), most
                         ).withColumnRenamed("entity_id", "other")
    paths = first_per(
        steps.join(by_shuffle(far), ["owner_id", "other"]), ["owner_id", "entity_id"],
        ["edge_no", "chunk_no"], most, "path_no")
    left = _as_col(max_results) - (F.col("path_no") - 1) * F.col("copies")
    return start.join(by_shuffle(paths), ["owner_id", "entity_id"]).filter(left > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", left)))).drop(
        "copies", "copy").withColumn("score", F.lit(0.5))


def largest_limit(limit: int | Column, rows: DataFrame) -> int:
    """The largest value of a limit: itself, or the maximum of the column in ``rows``."""
    if isinstance(limit, int):
        return limit
    return int(rows.agg(F.max(limit)).first()[0] or 0)


def _as_col(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def graph_retrieve(hop1: DataFrame, hop2: DataFrame, stored: DataFrame,
                   max_results: int | Column = 10) -> DataFrame:
    """Chunks ranked by their summed hop scores, scaled by the best chunk of the question.

    The first 2 * max ids are looked up in the store ``(owner_id, chunk_id)``; ids that are
    not stored are dropped, then the first max are kept.
    """
    q, cap = ["owner_id", "query_id"], _as_col(max_results)
    extra = ["max_results"] if "max_results" in hop1.columns else []
    if extra:
        cap = F.col("max_results")
    label = F.concat("name", F.lit(" ("), F.col("type"), F.lit(")"))
    rows = hop1.select(*q, *extra, "chunk_id", (F.col("score") * F.col("copies")).alias("score"),
                       F.array_repeat(label, F.col("copies").cast("int")).alias("labels")).unionByName(
        hop2.select(*q, *extra, "chunk_id", "score", F.lit(None).cast("array<string>").alias("labels")))
    scores = rows.groupBy(*q, *extra, "chunk_id").agg(
        F.sum("score").alias("raw"),
        F.array_join(F.array_sort(F.flatten(F.collect_list("labels"))), "; ").alias("entities"))
    best = F.max("raw").over(W.partitionBy(*q))
    ranked = scores.withColumn("best", best).withColumn(
        "id_no", F.row_number().over(W.partitionBy(*q).orderBy(F.desc("raw"), "chunk_id"))
    ).filter(F.col("id_no") <= 2 * cap)
    kept = ranked.join(by_shuffle(stored.select("owner_id", "chunk_id")), ["owner_id", "chunk_id"],
                       "left_semi")
    scored = kept.withColumn("graph_score", F.round(F.col("raw") / F.col("best"), 4))
    return first_per(scored, q, [F.desc("graph_score"), "id_no"], cap, "graph_rank").select(
        *q, *extra, "chunk_id", "graph_score", "entities", "graph_rank")


# --- Statistics -----------------------------------------------------------

def relation_counts(edges: DataFrame, as_degree: bool = False) -> DataFrame:
    """Edges by type and owner; ``as_degree`` counts an entity-entity edge from both ends."""
    times = F.when(F.col("rel_type").isin("MENTIONS", "BELONGS_TO"), 1).otherwise(2)
    weight = times if as_degree else F.lit(1)
    return edges.groupBy("owner_id", "rel_type").agg(F.sum(weight).alias("cnt"))


def type_counts(entities: DataFrame, limit: int = 10) -> DataFrame:
    counts = entities.groupBy("owner_id", "type").agg(F.count("*").alias("cnt"))
    return first_per(counts, ["owner_id"], [F.desc("cnt"), "type"], limit)


def top_entities(entities: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    """Most mentioned entities per owner; counted and cut before the names are joined."""
    counts = mentions.select("owner_id", "chunk_id", "entity_id").distinct().groupBy(
        "owner_id", "entity_id").agg(F.count("*").alias("mentions"))
    top = first_per(counts, ["owner_id"], [F.desc("mentions"), "entity_id"], limit)
    return top.join(entities.select("owner_id", "entity_id", "name", "type"),
                    ["owner_id", "entity_id"])


def total_counts(entities: DataFrame, communities: DataFrame) -> DataFrame:
    e = entities.groupBy("owner_id").agg(F.count("*").alias("total_entities"))
    c = communities.groupBy("owner_id").agg(F.count("*").alias("total_communities"))
    return e.join(c, "owner_id", "left").select(
        "owner_id", "total_entities",
        F.coalesce("total_communities", F.lit(0)).alias("total_communities"))


def document_entities(entities: DataFrame, mentions: DataFrame, limit: int = 50) -> DataFrame:
    """Entities of each document by the number of chunks that mention them.

    Mentions are shuffled once to be told apart and counted.
    """
    key = ["owner_id", "file_id"]
    counts = mentions.select(*key, "chunk_id", "entity_id").repartition(*key, "entity_id").distinct().groupBy(
        *key, "entity_id").agg(F.count("*").alias("mentions"))
    top = first_per(counts, key, [F.desc("mentions"), "entity_id"], limit)
    return top.join(by_shuffle(entities.select("owner_id", "entity_id", "name", "type")),
                    ["owner_id", "entity_id"])


def type_shares(counts: DataFrame) -> DataFrame:
    """Share bars: each type's percent of the largest type of the owner, rounded."""
    largest = counts.groupBy("owner_id").agg(F.max("cnt").alias("top"), F.sum("cnt").alias("total"))
    return counts.join(largest, "owner_id").select(
        "owner_id", "rel_type", "cnt", "total",
        F.round(100 * F.col("cnt") / F.col("top"), 0).cast("int").alias("percent"))
