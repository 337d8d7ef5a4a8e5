"""Mentions and relations: model output parsing, a model hook, and a model-free extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let, normalize_name, tokenize, trim_blank
from corvane.session import cut_lineage

ENTITY_JSON = ("array<struct<name:string,type:string,label:string,subtype:string,"
               "description:string>>")
RELATION_JSON = ("array<struct<`from`:string,source:string,`to`:string,target:string,"
                 "relation:string,type:string,description:string>>")
#: Output for several chunks, or for a single one without its index.
OUTPUT_JSON = (f"struct<chunks:array<struct<chunk_index:int,entities:{ENTITY_JSON},"
               f"relations:{RELATION_JSON}>>,entities:{ENTITY_JSON},relations:{RELATION_JSON}>")


def unfence(c: Column | str) -> Column:
    """Text inside a code fence: without its first and last line."""
    text = trim_blank(F.col(c) if isinstance(c, str) else c)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(text.startswith("```"), trim_blank(inner)).otherwise(text)


def _given(*fields: Column) -> Column:
    """First field that is neither null nor empty."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields])


def parse_extraction(outputs: DataFrame, expected: DataFrame | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of model outputs ``(owner_id, file_id, output)``.

    An output lists chunks with their index, or holds the entities and relations of one chunk;
    that chunk is the first of ``chunk_indexes`` (as ``model_batches`` gives), else number 0.
    Broken JSON counts as empty. With ``expected`` (owner, file, chunk_index) other chunk
    indexes are dropped. Synonym keys are accepted and defaults filled in.
    """
    first = F.try_element_at("chunk_indexes", F.lit(1)).cast("int") if (
        "chunk_indexes" in outputs.columns) else F.lit(0)
    parsed = outputs.select("owner_id", "file_id", first.alias("only"),
                            F.from_json(unfence("output"), OUTPUT_JSON).alias("j"))
    single = F.struct(F.col("only").alias("chunk_index"), F.col("j.entities").alias("entities"),
                      F.col("j.relations").alias("relations"))
    listed = F.when(F.col("j.chunks").isNotNull(), F.col("j.chunks")).when(
        F.coalesce(F.size("j.entities"), F.size("j.relations")).isNotNull(), F.array(single))
    chunks = parsed.select("owner_id", "file_id", F.explode(listed).alias("c")).select(
        "owner_id", "file_id", "c.chunk_index", "c.entities", "c.relations")
    if expected is not None:
        chunks = chunks.join(expected.select("owner_id", "file_id", "chunk_index").distinct(),
                             ["owner_id", "file_id", "chunk_index"], "left_semi")
    where = ["owner_id", "file_id", "chunk_index"]
    e = chunks.select(*where, F.posexplode("entities").alias("pos", "e"))
    entities = e.select(
        *where, "pos",
        trim_blank(F.coalesce("e.name", F.lit(""))).alias("raw_name"),
        trim_blank(F.coalesce(_given(F.col("e.type"), F.col("e.label")), F.lit("OTHER")))
        .alias("raw_type"),
        trim_blank(F.coalesce("e.subtype", F.lit(""))).alias("subtype"),
        trim_blank(F.coalesce("e.description", F.lit(""))).alias("description"),
    )
    r = chunks.select(*where, F.posexplode("relations").alias("pos", "r"))
    relations = r.select(
        *where, "pos",
        trim_blank(F.coalesce(_given(F.col("r.from"), F.col("r.source")), F.lit("")))
        .alias("from_raw"),
        trim_blank(F.coalesce(_given(F.col("r.to"), F.col("r.target")), F.lit("")))
        .alias("to_raw"),
        trim_blank(F.coalesce(_given(F.col("r.relation"), F.col("r.type")),
                              F.lit("RELATED_TO"))).alias("relation_raw"),
        trim_blank(F.coalesce("r.description", F.lit(""))).alias("description"),
    )
    return entities, relations


CHUNK = ["owner_id", "file_id", "chunk_id"]
PHRASE = r"(?U)\b\p{Lu}\w+(?: \p{Lu}\w+)+"


def phrases(text: Column | str) -> Column:
    """Runs of two or more capitalised words on one line."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text,
                                F.lit(PHRASE), F.lit(0))


#: Letters of all names that one automaton may hold (about 100 bytes each in a task).
AUTOMATON_LETTERS = 2_000_000


def extract_mentions(chunks: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Mentions found without a model: capitalised phrases and gazetteer names.

    Gazetteer rows are ``(name_norm, name, type)``; names have any number of words.
    """
    found = chunks.select(*CHUNK, F.explode(F.array_distinct(phrases("text"))).alias("raw_name"))
    mentions = found.select(*CHUNK, "raw_name", F.lit("OTHER").alias("raw_type"))
    if gazetteer is not None:
        named = gazetteer_matches(chunks, gazetteer.select("name_norm")).join(
            gazetteer.select("name_norm", "name", "type"), "name_norm")
        mentions = mentions.unionByName(named.select(
            *CHUNK, F.col("name").alias("raw_name"), F.col("type").alias("raw_type")))
    return mentions.distinct().select(
        "*", F.lit("").alias("subtype"), F.lit("").alias("description"))


def gazetteer_matches(chunks: DataFrame, names: DataFrame,
                      automaton_letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """(owner_id, file_id, chunk_id, name_norm): names that stand in a chunk as whole words.

    A gazetteer whose letters were counted and found few becomes an automaton in each task: one pass
    over the text finds names of all lengths, and nothing is shuffled. A larger one meets the texts
    by the first two words of its names; only names of three and more words are then looked for in
    their candidate texts. Both ways give the same rows.
    """
    names = names.where(F.coalesce(F.col("name_norm"), F.lit("")) != "").select("name_norm").distinct()
    spaced = F.array_join(F.filter(F.split(normalize_name("text"), " "), lambda w: w != ""), " ")
    texts = chunks.select(*CHUNK, F.concat(F.lit(" "), spaced, F.lit(" ")).alias("spaced"))
    letters = names.agg(F.sum(F.length("name_norm"))).first()[0] or 0
    if letters <= automaton_letters:
        return _automaton_matches(texts, names)
    return _anchored_matches(texts, names)


def _automaton_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    listed = [r["name_norm"] for r in names.collect()]  # the caller checked their size
    held = texts.sparkSession.sparkContext.broadcast(listed)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields
                       if f.name != "spaced") + ", name_norm string"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(held.value):
            automaton.add_word(f" {name} ", k)
        if not held.value:
            return
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("spaced").to_pylist()):
                hits = {k for _, k in automaton.iter(text)} if text else ()
                rows += [row] * len(hits)
                found += hits
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in CHUNK),
                 pa.array([held.value[k] for k in found], pa.string())], [*CHUNK, "name_norm"])

    return texts.mapInArrow(match, schema)


def _anchored_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    def pairs(words: Column) -> Column:
        return F.array_distinct(F.transform(words, lambda w, i: F.concat_ws(
            " ", w, F.try_element_at(words, i + 2))))

    words = F.split("name_norm", " ")
    keyed = names.select("name_norm", F.size(words).alias("n"),
                         F.array_join(F.slice(words, 1, 2), " ").alias("anchor"))
    own = texts.select(*CHUNK, F.split(F.trim("spaced"), " ").alias("w"))
    one = own.select(*CHUNK, F.explode(F.array_distinct("w")).alias("anchor"))
    two = own.where(F.size("w") > 1).select(*CHUNK, F.explode(pairs(F.col("w"))).alias("anchor"))
    short = one.join(keyed.where("n = 1"), "anchor")
    met = two.join(keyed.where("n > 1"), "anchor")
    long = met.where("n > 2").join(texts, CHUNK).where(
        F.contains("spaced", F.concat(F.lit(" "), F.col("name_norm"), F.lit(" "))))
    return short.select(*CHUNK, "name_norm").unionByName(
        met.where("n = 2").select(*CHUNK, "name_norm")).unionByName(long.select(*CHUNK, "name_norm"))


def comention_relations(chunks: DataFrame, mentions: DataFrame, block: int = 64,
                        description_chars: int = 200) -> DataFrame:
    """Raw relations between names of one sentence, found without a model.

    A name is linked once with every other name that has a place behind one of its own in the
    sentence. The pairs are the result itself; the names of a sentence are spread over blocks and
    joined block against block, and pairs are numbered by counts per name. Rows are those of
    ``parse_extraction`` with ``chunk_id``: both names, RELATED_TO, and the sentence, of which the
    description repeats ``description_chars`` characters for each pair.
    """
    base = CHUNK
    place = [*base, "sentence_no"]
    pieces = F.split("text", r"(?U)(?<=[.!?])\s+|\n")
    told = chunks.select(*base, F.posexplode(pieces).alias("sentence_no", "sentence"))
    names = mentions.select(*base, "raw_name").distinct()
    last = F.length("sentence") - F.length("raw_name") + 2 - F.expr(
        "instr(reverse(sentence), reverse(raw_name))")
    here = told.join(names, base).withColumn("at", F.instr("sentence", F.col("raw_name"))).filter(
        "at > 0").select(*place, "raw_name", "at", last.alias("last"),
                         F.substring("sentence", 1, description_chars).alias("description"))
    here = cut_lineage(here)
    size = here.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1")
    sized = here.join(size, place).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    spread = sized.withColumn("mine", F.pmod(F.hash("raw_name"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = spread.select(*place, F.col("mine").alias("ba"), F.col("other").alias("bb"), "at",
                      F.col("raw_name").alias("from_raw"), "description")
    b = spread.select(*place, F.col("other").alias("ba"), F.col("mine").alias("bb"), "last",
                      F.col("raw_name").alias("to_raw"))
    pairs = a.join(b, [*place, "ba", "bb"]).filter(
        (F.col("from_raw") != F.col("to_raw"))
        & (F.struct("at", "from_raw") < F.struct(F.col("last").alias("at"), F.col("to_raw").alias("from_raw"))))
    mine = [*place, "from_raw"]
    counts = pairs.groupBy(*mine, "at").agg(F.count("*").alias("n"))
    ahead = W.partitionBy(*base).orderBy("sentence_no", "at", "from_raw").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = counts.select(*mine, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy(*mine).orderBy("to_raw"))
    return pairs.withColumn("rank", rank).join(offsets, mine).select(
        *base, (F.col("offset") + F.col("rank") - 1).cast("int").alias("rel_ord"), "from_raw", "to_raw",
        F.lit("RELATED_TO").alias("relation_raw"), "description")


def word_runs(normalized: Column, max_words: int) -> Column:
    """Distinct runs of one to ``max_words`` neighbouring words."""
    def of_length(words: Column, n: int) -> Column:
        start = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
        return F.transform(start, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    def runs(words: Column) -> Column:
        found = F.flatten(F.array(*[of_length(words, n) for n in range(1, max_words + 1)]))
        return F.filter(F.array_distinct(found), lambda r: r != "")

    return let(F.filter(F.split(normalized, " "), lambda w: w != ""), runs)


def with_model(df: DataFrame, model: Callable[[list], list], input_column: str,
               output_column: str, output_type: str, batch_size: int = 100) -> DataFrame:
    """Apply a caller's batch function to one column; order is kept and counts are checked."""
    schema = T.StructType([*df.schema.fields,
                           T.StructField(output_column, T._parse_datatype_string(output_type))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = []
            for begin in range(0, len(frame), batch_size):
                values = frame[input_column].iloc[begin:begin + batch_size].tolist()
                answers = list(model(values))
                if len(answers) != len(values):
                    raise ValueError(f"model gave {len(answers)} results for {len(values)} rows")
                results.extend(answers)
            yield frame.assign(**{output_column: results})

    return df.mapInPandas(run, schema)


def hash_embeddings(texts: DataFrame, keys: list[str], dimensions: int = 64) -> DataFrame:
    """Unit vectors of hashed word counts: a stand-in where no embedding model is at hand.

    Words are counted per slot before they are gathered, so a row of the second
    aggregation holds at most ``dimensions`` entries however long the text is.
    """
    slot = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint"),
                  F.lit(dimensions)).cast("int")
    counts = (
        texts.select(*keys, F.explode_outer(tokenize("text")).alias("word"))
        .groupBy(*keys, slot.alias("slot")).agg(F.count("word").cast("double").alias("n"))
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda d: F.coalesce(F.try_element_at(F.col("by_slot"), d), F.lit(0.0)))
    scale = F.nullif(F.sqrt("squares"), F.lit(0.0))
    return (
        counts.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(),
                                                     F.struct("slot", "n")))).alias("by_slot"),
            F.sum(F.col("n") * F.col("n")).alias("squares"))
        .select(*keys, F.transform(filled, lambda x: F.coalesce(x / scale, F.lit(0.0)))
                .alias("embedding"))
    )
