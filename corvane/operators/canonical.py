"""Canonical names, types and relations of raw mentions.

Mentions are rows ``(owner_id, file_id, chunk_id, ord, raw_name, raw_type, subtype,
description)`` where ``ord`` is any sortable position in document order. Wherever the
first of several rows decides, it is the first by ``ord``, so results do not depend on
how rows are spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import keys
from corvane.functions import lexicon as lx
from corvane.functions.text import (
    entity_label, let, normalize_name, relation_type, strip_title, trim_blank, type_priority,
)
from corvane.session import broadcast_if_small, cut_lineage


def is_blocked(name: Column, norm: Column, label: Column) -> Column:
    """Too short, or a pronoun or generic word instead of a name."""
    def blocked(n: Column) -> Column:
        single = ~F.contains(n, F.lit(" "))
        return (
            (n == "") | (n.isin(lx.PRONOUNS) & (single | (label == "PERSON")))
            | ((label == "OTHER") & n.isin(lx.GENERIC_NAMES))
        )

    return (F.length(trim_blank(name)) < 2) | let(norm, blocked)


def block_entities(mentions: DataFrame) -> DataFrame:
    """Drop blocked names; adds the label, the stripped name and its norm."""
    label = entity_label("raw_type")
    name = F.when(F.col("label") == "PERSON", strip_title("raw_name")).otherwise(
        trim_blank("raw_name"))
    return (
        mentions.filter(trim_blank("raw_name") != "")
        .withColumn("label", label)
        .withColumn("clean_name", name)
        .withColumn("clean_norm", normalize_name("clean_name"))
        .filter(~is_blocked(F.col("clean_name"), F.col("clean_norm"), F.col("label")))
    )


def alias_table(spark: SparkSession, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Alias rows ``(alias_no, alias_norm, display)`` of the fixed list or of a caller's list."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("alias_no"), F.lit(a).alias("alias_norm"),
                 F.lit(d).alias("display"))
        for i, (a, d) in enumerate(pairs or lx.NAME_ALIASES)])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def read_alias_lines(spark: SparkSession, path: str) -> DataFrame:
    """Alias rows of files with one JSON object ``{alias: display}`` per line, read in splits.

    Numbers follow the order of files and lines; they are unique, not gapless.
    """
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return lines.select("line", F.posexplode(entries).alias("pos", "e")).select(
        F.struct("line", "pos").alias("alias_no"), F.col("e.key").alias("alias_norm"),
        F.col("e.value").alias("display"))


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``{alias: display}`` as alias rows, in the order of the file.

    The object is read by one task; ``read_alias_lines`` reads long lists.
    """
    text = spark.read.option("wholetext", "true").text(path)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    return text.select(F.posexplode(entries).alias("alias_no", "e")).select(
        "alias_no", F.col("e.key").alias("alias_norm"), F.col("e.value").alias("display"))


def resolve_alias(names: DataFrame, aliases: DataFrame, norm: str = "clean_norm") -> DataFrame:
    """Add ``alias_name``: the display name of an equal alias, else of one equal but for spaces.

    Both lookups are equality joins against an alias table with one row per key.
    """
    first = F.min_by("display", "alias_no")
    exact = aliases.groupBy(F.col("alias_norm").alias(norm)).agg(first.alias("_exact"))
    compact = aliases.groupBy(F.replace("alias_norm", F.lit(" "), F.lit("")).alias("_compact")
                              ).agg(first.alias("_loose"))
    return (
        names.withColumn("_compact", F.replace(norm, F.lit(" "), F.lit("")))
        .join(exact, norm, "left").join(compact, "_compact", "left")
        .withColumn("alias_name", F.coalesce("_exact", "_loose"))
        .drop("_compact", "_exact", "_loose")
        .select(*names.columns, "alias_name")
    )


# --- Similar names --------------------------------------------------------

def token_sorted(norm: Column | str) -> Column:
    column = F.col(norm) if isinstance(norm, str) else norm
    return F.array_join(F.array_sort(F.split(column, " ")), " ")


def indel_ratio(left: Column | str, right: Column | str) -> Column:
    """100 * (1 - insertions and deletions / total length), by a bit-parallel common subsequence."""
    @F.pandas_udf(T.DoubleType())
    def ratios(a_texts: pd.Series, b_texts: pd.Series) -> pd.Series:
        def ratio(a: str, b: str) -> float:
            total = len(a) + len(b)
            if not total:
                return 100.0
            at = {}
            for i, ch in enumerate(a):
                at[ch] = at.get(ch, 0) | (1 << i)
            full = (1 << len(a)) - 1
            rows = full
            for ch in b:
                hit = rows & at.get(ch, 0)
                rows = ((rows + hit) | (rows - hit)) & full
            return 200.0 * (len(a) - rows.bit_count()) / total

        return pd.Series([ratio(a, b) for a, b in zip(a_texts, b_texts)], dtype="float64")

    return ratios(left, right)


def similar_pairs(names: DataFrame, block: list[str], threshold: int | None = None) -> DataFrame:
    """Pairs of similar sorted names ``(block.., id_a, id_b, score)`` with ``pos_a < pos_b``.

    Input rows are ``(block.., id, pos, text)`` with ``text`` token-sorted and unique per
    block. Candidates share a rare two-letter piece, found by an equality join: texts of
    lengths a and b within distance d of insertions and deletions keep all but 2d of their
    pieces, so among the 2d+1 rarest pieces of either at least one is common to both. That
    filter loses nothing; the exact ratio decides afterwards.
    """
    threshold = lx.FUZZY_THRESHOLD if threshold is None else threshold
    loss = 1 - (threshold - 0.5) / 100
    length = F.length("text")
    padded = F.concat(F.lit("\u0002"), F.col("text"), F.lit("\u0003"))
    places = F.sequence(F.lit(1), length + 1)
    pieces = F.transform(places, lambda i: F.struct(
        F.substring(padded, i, F.lit(2)).alias("piece"), i.alias("at")))
    grams = names.filter(length >= lx.FUZZY_MIN_LENGTH).select(
        *block, "id", "pos", "text", length.alias("n"), F.inline(pieces))
    # Number equal pieces of one text, so that multiplicity counts as in the bound above.
    turn = F.row_number().over(W.partitionBy(*block, "id", "piece").orderBy("at"))
    grams = grams.withColumn("turn", turn)
    common = grams.groupBy("piece", "turn").agg(F.count("*").alias("freq"))
    ranked = grams.join(common, ["piece", "turn"]).withColumn("rank", F.row_number().over(
        W.partitionBy(*block, "id").orderBy("freq", "piece", "turn")))
    # The longest partner of a text of length n has n * (1 + loss) / (1 - loss) letters.
    widest = F.floor(F.lit(loss) * F.col("n") * (1 + (1 + loss) / (1 - loss)) + 1e-9)
    kept = ranked.filter(F.col("rank") <= 2 * widest + 1)

    def side(s: str) -> DataFrame:
        return kept.select(*block, "piece", "turn", *[
            F.col(c).alias(f"{c}_{s}") for c in ("id", "pos", "text", "n", "at")])

    bound = F.floor(F.lit(loss) * (F.col("n_a") + F.col("n_b")) + 1e-9)
    met = side("a").join(side("b"), [*block, "piece", "turn"]).filter(
        (F.col("pos_a") < F.col("pos_b"))
        & (F.abs(F.col("n_a") - F.col("n_b")) <= bound)
        & (F.abs(F.col("at_a") - F.col("at_b")) <= bound))
    candidates = met.select(*block, "id_a", "id_b", "text_a", "text_b", "n_a", "n_b").distinct()
    near = candidates.filter(
        F.levenshtein("text_a", "text_b") <= F.floor(
            F.lit(loss) * (F.col("n_a") + F.col("n_b")) + 1e-9))
    scored = near.withColumn("ratio", indel_ratio("text_a", "text_b"))
    return scored.filter(F.col("ratio") > threshold - 0.5).select(
        *block, "id_a", "id_b", F.bround("ratio", 0).cast("int").alias("score"))


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    ends = F.array(F.struct(F.col("id_a").alias("x"), F.col("id_b").alias("y")),
                   F.struct(F.col("id_b").alias("x"), F.col("id_a").alias("y")))
    return pairs.select(*more, "score", F.explode(ends).alias("e")).select(*more, "score", "e.x", "e.y")


def pairs_in_blocks(names: DataFrame, block: list[str], pairs: DataFrame, wider: list[str]) -> DataFrame:
    """Pairs of the names of each block, from ``pairs`` of distinct names of a ``wider`` block.

    A name occurs in many blocks of the wider one, and is compared once. Two wider names meet in the
    blocks that hold both.
    """
    both = _both_ways(pairs, *wider)
    a = names.select(*block, F.col("id").alias("x"), F.col("pos").alias("pos_a"))
    b = names.select(*block, F.col("id").alias("y"), F.col("pos").alias("pos_b"))
    return a.join(both, [*wider, "x"]).join(b, [*block, "y"]).filter("pos_a < pos_b").select(
        *block, F.col("x").alias("id_a"), F.col("y").alias("id_b"), "score")


#: Names of a group of similar names that are settled beside their mentions; larger groups take rounds.
GROUP_NAMES = 16


def similar_groups(pairs: DataFrame, most: int = GROUP_NAMES) -> DataFrame:
    """Small groups of similar names ``(id, group, place, scores)`` of pairs ``(id_a, id_b, score)``.

    No pair leads out of a group. ``scores`` has the score of a name with each place of its group, 0
    where they are not similar. Groups of more than ``most`` names are left out, and those
    whose smallest name is more than three pairs away from another one.
    """
    both = _both_ways(pairs)
    top = both.groupBy("x").agg(F.least("x", F.min("y")).alias("group"))
    for _ in range(2):
        top = both.join(top.select(F.col("x").alias("y"), "group"), "y").groupBy("x").agg(
            F.min("group").alias("group"))
    top = cut_lineage(top)
    left = both.join(top, "x").join(
        top.select(F.col("x").alias("y"), F.col("group").alias("other")), "y").filter(
        F.col("group") != F.col("other")).select("group").distinct()
    size = top.groupBy("group").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") <= most)
    place = F.row_number().over(W.partitionBy("group").orderBy("x")) - 1
    placed = cut_lineage(top.join(size, "group").join(left, "group", "left_anti").withColumn("place", place))
    near = both.join(placed.select(F.col("x").alias("y"), "place"), "y").groupBy("x").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("near"))
    scores = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(
        F.try_element_at("near", i), F.lit(0)).cast("byte"))
    return placed.join(near, "x").select(F.col("x").alias("id"), "group", "place", scores.alias("scores"))


def group_leaders(heads: Column, pos: str, face: str) -> Column:
    """Names of a small group with the face of their leader: ``array<struct<place, face>>``.

    ``heads`` are the names ``(pos, place, scores, face)`` in their order, where ``pos`` and ``face`` have the
    given types. A name follows the most similar earlier leader, the first on ties, or else leads.
    """
    none = F.struct(F.array().cast(f"array<struct<pos:{pos},place:int,face:{face}>>").alias("leads"),
                    F.array().cast(f"array<struct<place:int,face:{face}>>").alias("told"))

    def settle(done: Column, head: Column) -> Column:
        def score(lead: Column) -> Column:
            return F.get(head["scores"], lead["place"])

        near = F.filter(done["leads"], lambda lead: (lead["pos"] < head["pos"]) & (score(lead) > 0))
        best = F.array_min(F.transform(near, lambda lead: F.struct(
            (-score(lead)).alias("minus"), lead["pos"].alias("pos"), lead["face"].alias("face"))))
        own = F.struct(head["pos"].alias("pos"), head["place"].alias("place"), head["face"].alias("face"))
        return let(best, lambda b: F.struct(
            F.when(b.isNull(), F.concat(done["leads"], F.array(own))).otherwise(done["leads"]).alias("leads"),
            F.concat(done["told"], F.array(F.struct(
                head["place"].alias("place"),
                F.when(b.isNull(), head["face"]).otherwise(b["face"]).alias("face")))).alias("told")))

    return F.aggregate(heads, none, settle, lambda done: done["told"])


def fuzzy_leaders(names: DataFrame, block: list[str], threshold: int | None = None,
                  pairs: DataFrame | None = None) -> DataFrame:
    """Map each name to the most similar earlier name that stands for itself.

    A name stands for itself when no earlier one of its block that stands for itself is
    similar. Each round settles the names whose earlier neighbours are all settled; the first
    open name of a block always is such a name, so the rounds end.
    Output rows are ``(block.., id, leader_id, score)``; a leader points at itself. ``pairs`` are those
    of ``similar_pairs``, where they are known already.
    """
    pairs = cut_lineage(similar_pairs(names, block, threshold) if pairs is None else pairs)
    key = [*block, "id"]
    a_key = [F.col(c) for c in block] + [F.col("id_a").alias("id")]
    settled = cut_lineage(
        names.join(pairs.select(*block, F.col("id_b").alias("id")).distinct(), key, "left_anti")
        .select(*key, F.lit(True).alias("leads")))
    open_pairs = pairs
    while True:
        state = open_pairs.join(
            settled.withColumnRenamed("id", "id_a"), [*block, "id_a"], "left")
        verdict = state.groupBy(*block, F.col("id_b").alias("id")).agg(
            F.bool_or(F.coalesce("leads", F.lit(False))).alias("follows"),
            F.bool_and(F.col("leads").isNotNull()).alias("closed"))
        fresh = cut_lineage(verdict.filter("closed or follows").select(
            *key, (~F.col("follows")).alias("leads")))
        if fresh.isEmpty():
            break
        settled = cut_lineage(settled.unionByName(fresh))
        open_pairs = open_pairs.join(fresh.withColumnRenamed("id", "id_b"),
                                     [*block, "id_b"], "left_anti")
    leaders = settled.filter("leads").select(*key)
    order = names.select(*block, F.col("id").alias("id_a"), "pos")
    best = (
        pairs.join(leaders.withColumnRenamed("id", "id_a"), [*block, "id_a"], "left_semi")
        .join(leaders.withColumnRenamed("id", "id_b"), [*block, "id_b"], "left_anti")
        .join(order, [*block, "id_a"])
        .groupBy(*block, F.col("id_b").alias("id"))
        .agg(F.min_by("id_a", F.struct((-F.col("score")).alias("s"), "pos")).alias("leader_id"),
             F.max("score").alias("score"))
    )
    own = leaders.select(*key, F.col("id").alias("leader_id"), F.lit(100).alias("score"))
    return own.unionByName(best)


# --- Resolution and merging -----------------------------------------------

def resolve_entities(mentions: DataFrame, aliases: DataFrame, fuzzy: bool = True,
                     threshold: int | None = None) -> DataFrame:
    """Canonical name of each mention: title, block list, alias, similar earlier name, itself.

    Names repeat far more often than they differ, so the first steps are done once for each distinct
    (owner, name, type) and joined back. Similar names are looked for among the earlier names of the
    same file and label; ``fuzzy`` leaves that step out.
    """
    given = ["owner_id", "raw_name", "raw_type"]
    known = resolve_alias(block_entities(mentions.select(*given).distinct()), aliases)
    if fuzzy:
        return _resolve_similar(mentions, known, given, threshold)
    known = broadcast_if_small(cut_lineage(known).select(*[F.col(c).alias(f"_{c}") for c in given], "label",
                                                         "clean_name", "clean_norm", "alias_name"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in given]
    name = F.coalesce("alias_name", "clean_name")
    return mentions.join(known, same).withColumn("name", name).withColumn(
        "name_norm", normalize_name("name")).select(*mentions.columns, "label", "name", "name_norm")


def _resolve_similar(mentions: DataFrame, known: DataFrame, given: list[str],
                     threshold: int | None) -> DataFrame:
    """The last steps of ``resolve_entities``: similar names of a file and label become its earliest one.

    Distinct names are numbered and compared once for each owner and label. Names of small groups of
    similar ones meet the mentions of their group in a file by one shuffle, which carries numbers in
    the place of names while the table of names is small. The names of larger groups take rounds.
    """
    shown = F.coalesce("alias_name", "clean_name")
    known = cut_lineage(known.select(
        F.monotonically_increasing_id().alias("no"), *[F.col(c).alias(f"_{c}") for c in given], "label",
        F.col("alias_name").isNotNull().alias("fixed"), shown.alias("shown"), normalize_name(shown).alias("show_norm")))
    wider = [F.col("_owner_id").alias("owner"), "label", "show_norm"]
    names = cut_lineage(known.select(*wider).distinct().withColumn("id", F.monotonically_increasing_id()))
    pairs = cut_lineage(similar_pairs(names.select(
        "owner", "label", "id", F.col("id").alias("pos"), token_sorted("show_norm").alias("text")),
        ["owner", "label"], threshold))
    groups = cut_lineage(similar_groups(pairs))
    large = _both_ways(pairs).select(F.col("x").alias("id")).distinct().join(groups, "id", "left_anti")
    named = names.join(groups, "id", "left").join(large.withColumn("large", F.lit(True)), "id", "left")
    key = [F.col("_owner_id").eqNullSafe(F.col("owner")), F.col("label") == F.col("its_label"),
           F.col("show_norm") == F.col("its_norm")]
    known = cut_lineage(known.join(named.withColumnsRenamed({"label": "its_label", "show_norm": "its_norm"}), key).select(
        *known.columns, "id", F.coalesce("group", "id").alias("group"), F.coalesce("place", F.lit(0)).alias("place"),
        F.coalesce("scores", F.array(F.lit(0).cast("byte"))).alias("scores"),
        F.coalesce("large", F.lit(False)).alias("large")))
    sized = broadcast_if_small(known)
    few = sized is not known
    face = F.col("no") if few else F.struct("shown", "show_norm")
    looked_up = sized.withColumn("face", face).drop("no", "shown", "show_norm")
    clean = mentions.join(F.broadcast(looked_up) if few else looked_up, [
        F.col(c).eqNullSafe(F.col(f"_{c}")) for c in given]).drop(*[f"_{c}" for c in given])
    kept = [*mentions.columns, "label", "fixed", "face"]

    met = clean.filter("not large").repartition("file_id", "group")
    first = F.min(F.struct(F.col("ord").alias("pos"), "face")).over(W.partitionBy("file_id", "group", "place"))
    head = F.struct("first.pos", "place", "scores", "first.face")
    heads = F.array_sort(F.collect_set(head).over(W.partitionBy("file_id", "group")))
    types = [clean.schema[c].dataType.simpleString() for c in ("ord", "face")]
    told = F.filter(group_leaders(F.col("heads"), *types), lambda t: t["place"] == F.col("place"))[0]["face"]
    settled = met.withColumn("first", first).withColumn("heads", heads).select(
        *kept, F.when(F.size("heads") == 1, F.col("first.face")).otherwise(told).alias("near"))
    if not known.filter("large").isEmpty():
        settled = settled.unionByName(_settle_in_rounds(clean.filter("large"), pairs).select(*kept, "near"))

    # Without a file there are no earlier names.
    alone = F.col("fixed") | F.col("file_id").isNull() | F.col("owner_id").isNull() | F.col("near").isNull()
    chosen = settled.withColumn("face", F.when(alone, F.col("face")).otherwise(F.col("near")))
    if few:
        chosen = chosen.join(F.broadcast(known.select(F.col("no").alias("face"), F.struct(
            "shown", "show_norm").alias("named"))), "face")
    else:
        chosen = chosen.withColumnRenamed("face", "named")
    return chosen.select(*mentions.columns, "label", F.col("named.shown").alias("name"),
                         F.col("named.show_norm").alias("name_norm"))


def _settle_in_rounds(clean: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mentions with ``near``, the face of the name that their name ``id`` follows in the file and label."""
    block = ["owner_id", "file_id", "label"]
    names = cut_lineage(clean.groupBy(*block, "id").agg(
        F.min("ord").alias("pos"), F.min_by("face", "ord").alias("near")))
    found = pairs_in_blocks(names, block, pairs.withColumnRenamed("owner", "owner_id"), ["owner_id", "label"])
    linked = fuzzy_leaders(names, block, pairs=found).select(*block, "id", "leader_id")
    target = linked.join(names.select(*block, F.col("id").alias("leader_id"), "near"), [*block, "leader_id"])
    return clean.join(target.drop("leader_id"), [*block, "id"], "left")


def merge_mentions(resolved: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One entity per scope and norm, from partial aggregates only.

    First name, longest description, first subtype, type of highest priority, and as
    aliases the raw names that differ from the name. A label outside the ontology is
    kept as subtype.
    """
    scope = scope or ["owner_id"]
    raw_type = trim_blank("raw_type")
    subtype = trim_blank(F.coalesce("subtype", F.lit("")))
    kept = F.when(subtype != "", subtype).when(
        (F.col("label") == "OTHER") & (raw_type != "") & (F.upper(raw_type) != "OTHER"), raw_type)
    rows = resolved.select(
        *scope, "name_norm", "ord", "name", "label", trim_blank("raw_name").alias("raw"),
        kept.alias("kept"), trim_blank(F.coalesce("description", F.lit(""))).alias("text"))
    merged = rows.groupBy(*scope, "name_norm").agg(
        F.min_by("name", "ord").alias("name"),
        F.min_by("label", F.struct((-type_priority("label")).alias("p"), "ord")).alias("type"),
        F.coalesce(F.expr("min_by(kept, ord) filter (where kept is not null)"), F.lit(""))
        .alias("subtype"),
        F.min_by("text", F.struct((-F.length("text")).alias("n"), "ord")).alias("description"),
        F.array_sort(F.collect_set("raw")).alias("raws"),
    )
    return merged.select(
        *scope, keys.entity_id("owner_id", "name_norm").alias("entity_id"), "name", "name_norm",
        "type", "subtype", "description",
        F.filter("raws", lambda r: r != F.col("name")).alias("aliases"))


def stable_types(resolved: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Give every mention of a norm the type of highest priority, the first on ties.

    Aggregated first and joined back, so a frequent name is never gathered in one task.
    """
    scope = scope or ["owner_id"]
    best = F.min_by("label", F.struct((-type_priority("label")).alias("p"), "ord"))
    types = resolved.groupBy(*scope, "name_norm").agg(best.alias("stable_type"))
    return resolved.join(types, [*scope, "name_norm"])


def rewrite_relations(relations: DataFrame, resolved: DataFrame,
                      canonical: DataFrame | None = None,
                      key_vectors: DataFrame | None = None) -> DataFrame:
    """Relations between canonical names; blanks, unknown ends and self loops are dropped.

    Ends are looked up among the names of the same chunk as written, then in lower case;
    of several mentions the last one counts. A relation outside the ontology becomes the nearest
    type of it by vector (``canonical`` and ``key_vectors``, both ``(rel_type, embedding)``), or
    RELATED_TO without vectors.
    """
    where = ["owner_id", "file_id", "chunk_id"]
    name = trim_blank("raw_name")
    names = resolved.select(*where, F.struct(
        "ord", "name", "name_norm", F.array_distinct(F.array(name, F.lower(name))).alias("keys")).alias("m"))
    told = relations.filter((trim_blank("from_raw") != "") & (trim_blank("to_raw") != "")).select(
        *where, F.struct("rel_ord", "relation_raw", "description", trim_blank("from_raw").alias("from"),
                         trim_blank("to_raw").alias("to")).alias("r"))
    # Names and relations of a chunk are shuffled once, before each gives a row per key. Grouping by
    # chunk and entities afterwards needs no other shuffle.
    met = names.unionByName(told, allowMissingColumns=True).repartition("owner_id", "chunk_id")

    def place(side: str | None, turn: int | None, key: Column) -> Column:
        return F.struct(F.lit(side).cast("string").alias("side"), F.lit(turn).cast("int").alias("turn"),
                        key.alias("key"))

    ends = F.array(*[place(side, n, key) for side in ("from", "to")
                     for n, key in enumerate((F.col(f"r.{side}"), F.lower(f"r.{side}")))])
    keyed = met.select(*where, F.struct("m.name", "m.name_norm").alias("named"), F.col("m.ord").alias("ord"),
                       "r.rel_ord", "r.relation_raw", "r.description", F.explode(F.when(
                           F.col("r").isNull(), F.transform("m.keys", lambda k: place(None, None, k)))
                           .otherwise(ends)).alias("p")).select(
        *where, "named", "ord", "rel_ord", "relation_raw", "description", "p.*")
    # Only names have an ord, so the last name of a key is that of its names.
    hits = keyed.withColumn("hit", F.max_by("named", "ord").over(W.partitionBy(*where, "key")))
    found = hits.filter("side is not null and hit is not null").groupBy(
        *where, "rel_ord", "relation_raw", "description").agg(
        F.expr("min_by(hit, turn) filter (where side = 'from')").alias("a"),
        F.expr("min_by(hit, turn) filter (where side = 'to')").alias("b"))
    rows = found.filter(
        (F.col("a.name") != F.col("b.name")) & (F.col("a.name_norm") != F.col("b.name_norm"))
    ).select(
        *where, "rel_ord",
        keys.entity_id("owner_id", "a.name_norm").alias("src"),
        keys.entity_id("owner_id", "b.name_norm").alias("dst"),
        relation_type("relation_raw").alias("rel_type"),
        F.coalesce("description", F.lit("")).alias("description"))
    return canonical_relations(rows, canonical, key_vectors)


def canonical_relations(rows: DataFrame, canonical: DataFrame | None = None,
                        key_vectors: DataFrame | None = None) -> DataFrame:
    """``rel_type`` limited to the ontology; each distinct unknown type is compared once."""
    known = F.col("rel_type").isin(lx.RELATION_TYPES)
    if canonical is None or key_vectors is None:
        return rows.withColumn("rel_type", F.when(known, F.col("rel_type")).otherwise("RELATED_TO"))
    unknown = rows.filter(~known).select("rel_type").distinct().join(
        key_vectors.dropDuplicates(["rel_type"]), "rel_type")
    nearest = nearest_relation(unknown.withColumnRenamed("rel_type", "key"), canonical).select(
        F.col("key").alias("_key"), F.col("rel_type").alias("_near"))
    mapped = rows.join(broadcast_if_small(nearest), F.col("rel_type") == F.col("_key"), "left")
    return mapped.withColumn("rel_type", F.when(known, F.col("rel_type")).otherwise(
        F.coalesce("_near", F.lit("RELATED_TO")))).drop("_key", "_near")


def merge_entities(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge new entities into the owner's: all aliases, the longer description, a new
    non-empty subtype, and the newest name and type."""
    key = ["owner_id", "entity_id"]
    columns = ["name", "name_norm", "type", "subtype", "description", "aliases"]
    old = current.select(*key, *[F.col(c).alias(f"o_{c}") for c in columns])
    new = fresh.select(*key, *[F.col(c).alias(f"n_{c}") for c in columns])
    empty = F.array().cast("array<string>")
    old_text = F.coalesce("o_description", F.lit(""))
    new_text = F.coalesce("n_description", F.lit(""))
    return old.join(new, key, "full_outer").select(
        *key,
        *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in ("name", "name_norm", "type")],
        F.coalesce(F.nullif("n_subtype", F.lit("")), F.col("o_subtype"), F.lit(""))
        .alias("subtype"),
        F.when(F.length(new_text) > F.length(old_text), new_text).otherwise(old_text)
        .alias("description"),
        F.array_sort(F.array_union(F.coalesce("o_aliases", empty), F.coalesce("n_aliases", empty)))
        .alias("aliases"))


# --- Relations by vector --------------------------------------------------

def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two number arrays in double precision; a zero vector gives 0."""
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def square(values: Column) -> Column:
        return total(F.transform(values, lambda v: v.cast("double") * v.cast("double")))

    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    size = F.sqrt(square(x)) * F.sqrt(square(y))
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))


def nearest_relation(unknown: DataFrame, canonical: DataFrame,
                     threshold: float | None = None) -> DataFrame:
    """Nearest canonical relation of each vector, or RELATED_TO below the threshold.

    ``canonical`` holds one vector per relation type of the fixed ontology. It is carried
    into each row as one array, so each unknown key is scored in place, without a join.
    """
    threshold = lx.RELATION_VECTOR_THRESHOLD if threshold is None else threshold
    table = canonical.agg(F.array_sort(F.collect_list(F.struct("rel_type", "embedding")))).scalar()
    scored = F.transform("_table", lambda c: F.struct(
        (-cosine(F.col("embedding"), c["embedding"])).alias("minus"), c["rel_type"].alias("type")))
    best = F.array_min(scored)
    return (
        unknown.withColumn("_table", table).withColumn("_best", best)
        .withColumn("score", -F.col("_best.minus"))
        .withColumn("rel_type", F.when(F.col("score") >= threshold, F.col("_best.type"))
                    .otherwise(F.lit("RELATED_TO")))
        .drop("_best", "_table", "embedding")
    )
