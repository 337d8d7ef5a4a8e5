"""Indexing a file again equals indexing everything at once."""

from corvane.operators.canonical import alias_table
from corvane.plans.index import index_files, reindex_files

SCHEMA = "owner_id string, file_id string, text string"
OLD = "Ann Lee works with Bob Ray at Acme Works today. Bob Ray knows Cy Dan of Blue Lake."
NEW = "Cy Dan left Acme Works and joined Green Hill with Dee Fox, as Ann Lee told us all here."


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_rebuild_equals_batch(spark):
    aliases = alias_table(spark)
    first = spark.createDataFrame([("o", "f1", OLD), ("o", "f2", OLD + " " + NEW), ("p", "f1", OLD)], SCHEMA)
    changed = spark.createDataFrame([("o", "f1", NEW)], SCHEMA)
    after = spark.createDataFrame([("o", "f1", NEW), ("o", "f2", OLD + " " + NEW), ("p", "f1", OLD)], SCHEMA)
    rebuilt = reindex_files(index_files(first, aliases), changed, aliases)
    batch = index_files(after, aliases)
    for name, columns in (("entities", ("owner_id", "entity_id", "name", "type")),
                          ("entity_mentions", ("owner_id", "file_id", "chunk_id", "entity_id")),
                          ("edges", ("owner_id", "src", "dst", "rel_type", "description"))):
        got, want = (rows(getattr(t, name)(), *columns) for t in (rebuilt, batch))
        assert got == want and want, name
    assert any("green hill" in r[1] for r in rows(batch.entities(), "owner_id", "entity_id"))
    emptied = reindex_files(batch, spark.createDataFrame([("p", "f1", "")], SCHEMA), aliases)
    assert not [r for r in rows(emptied.entities(), "owner_id", "name") if r[0] == "p"]


def test_relations_are_found_when_they_are_used(spark, monkeypatch):
    from corvane.operators import extraction as ex
    calls = []
    real = ex.comention_relations
    monkeypatch.setattr(ex, "comention_relations", lambda *a: calls.append(1) or real(*a))
    tables = index_files(spark.createDataFrame([("o", "f1", OLD)], SCHEMA), alias_table(spark))
    assert tables.entity_mentions().count() and not calls
    assert tables.edges().count() and tables.edges().count() and len(calls) == 1
