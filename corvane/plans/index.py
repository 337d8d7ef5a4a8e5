"""The indexing plan: documents to chunks, mentions, entities, edges and communities.

Tables that belong to a file (chunks, mentions, relations) are kept per file; entities and edges
are derived from them by grouping. So indexing a file again replaces its rows, and what is derived
then equals the result of indexing everything at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import keys
from corvane.operators import canonical as cn
from corvane.operators import communities as cm
from corvane.operators import extraction as ex
from corvane.operators import graph as gr
from corvane.operators.chunking import chunk_documents, eligible_chunks
from corvane.session import cut_lineage
from corvane.sources.store import replace_rows


@dataclass
class FileTables:
    """What indexing writes for each file; relations are found and written when they are first used."""

    chunks: DataFrame
    mentions: DataFrame
    find_relations: Callable[[], DataFrame]

    @cached_property
    def relations(self) -> DataFrame:
        """Relations between the names of each chunk."""
        return cut_lineage(self.find_relations())

    def entities(self) -> DataFrame:
        """Entities of each owner, merged over all its files."""
        return cn.merge_mentions(self.mentions)

    def entity_mentions(self) -> DataFrame:
        """(owner_id, file_id, chunk_id, entity_id), once each."""
        return self.mentions.select("owner_id", "file_id", "chunk_id", keys.entity_id(
            "owner_id", "name_norm").alias("entity_id")).distinct()

    def edges(self) -> DataFrame:
        """Relations and co-occurrence between entities."""
        told = gr.relation_edges(self.relations, "at")
        beside = gr.cooccurrence_edges(self.entity_mentions()).drop("chunks")
        return told.unionByName(beside.select(*told.columns))

    def communities(self) -> DataFrame:
        """(owner_id, node, comm) of the whole entity graph, small communities merged."""
        graph = cut_lineage(cm.entity_graph(self.edges()))
        return cm.merge_small_communities(cm.louvain(graph), graph)


def index_files(documents: DataFrame, aliases: DataFrame, gazetteer: DataFrame | None = None,
                fuzzy: bool = True, canonical: DataFrame | None = None,
                key_vectors: DataFrame | None = None) -> FileTables:
    """Chunk ``documents`` (owner_id, file_id, text, ..), find names and relations in the chunks,
    and resolve them. The results are written, since several tables are derived from each."""
    chunks = cut_lineage(chunk_documents(documents, dedupe=True))
    told = eligible_chunks(chunks)
    found = ex.extract_mentions(told, gazetteer)
    place = F.row_number().over(W.partitionBy("owner_id", "file_id", "chunk_id").orderBy(
        "raw_name", "raw_type"))
    numbered = found.withColumn("ord", place).join(
        told.select("owner_id", "file_id", "chunk_id", "chunk_index"), ["owner_id", "file_id", "chunk_id"])
    # the order of files is part of the order of mentions, so batches and single files agree
    order = F.concat_ws(" ", "file_id", F.lpad(F.col("chunk_index").cast("string"), 9, "0"),
                        F.lpad(F.col("ord").cast("string"), 9, "0"))
    mentions = cut_lineage(cn.resolve_entities(
        numbered.withColumn("ord", order).drop("chunk_index"), aliases, fuzzy))

    def relations() -> DataFrame:
        raw = ex.comention_relations(told, found)
        return cn.rewrite_relations(raw, mentions, canonical, key_vectors).withColumn(
            "at", F.struct("chunk_id", "rel_ord"))

    return FileTables(chunks, mentions, relations)


def reindex_files(tables: FileTables, documents: DataFrame, aliases: DataFrame, **options) -> FileTables:
    """Index some files again: their old rows go, also where nothing new is found."""
    fresh = index_files(documents, aliases, **options)
    files = documents.select("owner_id", "file_id").distinct()

    def swapped(old: DataFrame, new: DataFrame) -> DataFrame:
        kept = old.join(files, ["owner_id", "file_id"], "left_anti").select(*old.columns)
        return replace_rows(kept, new.select(*old.columns))

    return FileTables(swapped(tables.chunks, fresh.chunks), swapped(tables.mentions, fresh.mentions),
                      lambda: swapped(tables.relations, fresh.relations))
