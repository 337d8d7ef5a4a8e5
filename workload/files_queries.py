"""Listing, routing, reading, assembly and catalogue maintenance."""

from pyspark.sql import functions as F

from corvane.functions import keys
from corvane.functions import lexicon as lx
from corvane.session import scratch_path
from corvane.sources import buckets
from corvane.sources import files as fs
from corvane.sources import store as st
from workload import beds
from workload.registry import query
from workload.sqlparts import DOCX, facts, in_list, trim

SUPPORTED = ("('application/pdf', '.pdf', 'PDF'), "
             f"('{DOCX}', '.docx', 'DOCX'), ('application/msword', '.doc', 'DOC')")


def listing(spark, sf):
    """Documents as files: one folder per language, trashed when labelled toxic."""
    d = beds.files(spark, sf)
    toxic = beds.table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("file_id"), F.lit(True).alias("t"))
    return d.join(toxic, "file_id", "left").select(
        "file_id", F.col("file_name").alias("name"), "mime_type", "size_bytes", "owner_id",
        F.array("owner_id").alias("parents"), F.coalesce("t", F.lit(False)).alias("trashed"))


LISTED = (
    "files join (select cast(doc_id as varchar) as file_id, max(toxic) as toxic from "
    "(select doc_id, 0 as toxic from documents union all select doc_id, toxic from labels) "
    "group by 1) using (file_id)"
)
LIST_FILTER = (f"mime_type in ('application/pdf', '{DOCX}', 'application/msword') and toxic = 0 "
               "and size_bytes between 100 and 50000000")


@query("list_files", facts("files") + f"select file_id, file_name as name, mime_type, size_bytes "
       f"from {LISTED} where {LIST_FILTER}")
def list_files(spark, sf):
    return fs.list_files(listing(spark, sf)).select("file_id", "name", "mime_type", "size_bytes")


@query("list_files_of_folder", facts("files") + f"select file_id, file_name as name from {LISTED} "
       f"where {LIST_FILTER} and owner_id = 'src7'")
def list_files_of_folder(spark, sf):
    return fs.list_files(listing(spark, sf), folder_id="src7").select("file_id", "name")


@query("file_preview", facts("files") + "select file_id, name, mime_type, "
       "coalesce(label, 'File') as type_label, total, least(total, 50) as showing from ("
       f"select file_id, file_name as name, mime_type, count(*) over () as total, row_number() "
       f"over (order by file_name, file_id) as rn from {LISTED} where {LIST_FILTER}) "
       f"left join (values {SUPPORTED}) t(m, e, label) on m = mime_type where rn <= 50")
def file_preview(spark, sf):
    return fs.file_preview(fs.list_files(listing(spark, sf)))


@query("mime_catalog", facts("files") + "select mime_type, m is not null as supported, "
       f"mime_type in {in_list(lx.SKIPPED_MIME)} as skip_listed, coalesce(e, '') as extension, "
       "coalesce(label, 'File') as label, mime_type like 'application/vnd.google-apps.%' as "
       "is_workspace, count(*) as n from files left join "
       f"(values {SUPPORTED}) t(m, e, label) on m = mime_type group by all")
def mime_catalog(spark, sf):
    used = beds.files(spark, sf).groupBy("mime_type").agg(F.count("*").alias("n"))
    return fs.mime_catalog(used.select("mime_type")).drop("export_mime", "export_extension").join(
        used, "mime_type")


@query("route_by_mime", facts("files") + "select file_id, case mime_type when 'application/pdf' "
       f"then 'pdf' when '{DOCX}' then 'docx' when 'application/msword' then 'doc' "
       "when 'image/png' then 'ocr' else 'text' end as reader from files")
def route_by_mime(spark, sf):
    odd = F.concat(F.lit(" "), F.upper("mime_type"), F.lit(" ; charset=utf-8"))
    return fs.route_by_mime(beds.files(spark, sf).withColumn("mime_type", odd)).select(
        "file_id", "reader")


@query("read_text", f"select page_id, sha256({trim('html')}) as text_hash, "
       f"length({trim('html')}) as n from pages")
def read_text(spark, sf):
    pages = beds.table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias(
        "content"))
    text = fs.read_text(pages)
    return text.select("page_id", F.sha2("text", 256).alias("text_hash"),
                       F.length("text").cast("bigint").alias("n"))


@query("csv_to_text", "select 'C' || o_custkey as file_id, string_agg(o_orderkey || chr(9) || "
       "o_orderstatus || chr(9) || o_orderpriority, chr(10) order by o_orderkey) as text "
       "from orders group by o_custkey")
def csv_to_text(spark, sf):
    """Each customer's orders as a CSV file, with a blank row that has to go."""
    o = beds.table(spark, sf, "orders")
    line = F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))
    rows = o.select(F.concat(F.lit("C"), F.col("o_custkey")).alias("file_id"),
                    F.posexplode(F.array(line, F.lit(",,"))).alias("p", "line"),
                    (F.col("o_orderkey") * 2).alias("k"))
    return fs.csv_lines_to_text(
        rows.select("file_id", (F.col("k") + F.col("p")).alias("row_no"), "line"))


@query("assemble_pages", "select 'V' || conv_id as file_id, string_agg('[Trang ' || (turn + 1) || "
       f"']' || chr(10) || {trim('text')}, chr(10) || chr(10) order by turn) as text "
       f"from conversations where {trim('text')} <> '' group by conv_id")
def assemble_pages(spark, sf):
    c = beds.table(spark, sf, "conversations")
    return fs.assemble_pages(c.select(
        F.concat(F.lit("V"), F.col("conv_id")).alias("file_id"),
        (F.col("turn") + 1).alias("page_no"), "text"))


@query("assemble_sheets", "select 'book' || s_nationkey as file_id, string_agg(line, chr(10) "
       "order by sheet_no, row_no) as text from (select s_nationkey, 0 as sheet_no, s_suppkey as "
       "row_no, s_suppkey || chr(9) || s_name as line from supplier union all "
       "select distinct s_nationkey, 0, -1, '[Sheet: suppliers]' from supplier union all "
       "select c_nationkey, 1, c_custkey, c_custkey || chr(9) || c_name from customer union all "
       "select distinct c_nationkey, 1, -1, '[Sheet: customers]' from customer) group by 1")
def assemble_sheets(spark, sf):
    """Suppliers and customers of a nation as two sheets of a workbook."""
    def sheet(table, key, name, nation, no, title):
        return beds.table(spark, sf, table).select(
            F.concat(F.lit("book"), F.col(nation)).alias("file_id"), F.lit(no).alias("sheet_no"),
            F.lit(title).alias("sheet"), F.col(key).alias("row_no"),
            F.array(F.col(key).cast("string"), F.col(name)).alias("cells"))

    return fs.assemble_sheets(
        sheet("supplier", "s_suppkey", "s_name", "s_nationkey", 0, "suppliers")
        .unionByName(sheet("customer", "c_custkey", "c_name", "c_nationkey", 1, "customers")))


@query("assemble_word_parts", "select 'nation' || c_nationkey as file_id, string_agg(c_name || "
       "' | ' || c_mktsegment, chr(10) || chr(10) order by c_custkey) as text "
       "from customer group by c_nationkey")
def assemble_word_parts(spark, sf):
    c = beds.table(spark, sf, "customer")
    return fs.assemble_word_parts(c.select(
        F.concat(F.lit("nation"), F.col("c_nationkey")).alias("file_id"),
        F.col("c_custkey").alias("part_no"),
        F.array(F.concat(F.lit(" "), "c_name"), F.lit("  "), "c_mktsegment").alias("cells")))


def indexed(spark, sf):
    """Catalogue of earlier runs: the documents that carry a quality label."""
    labelled = beds.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file_id"))
    return beds.files(spark, sf).join(labelled, "file_id", "left_semi")


INDEXED = "select cast(doc_id as varchar) from labels"


@query("skip_indexed", facts("files") + f"select owner_id, file_id from files "
       f"where file_id not in ({INDEXED})")
def skip_indexed(spark, sf):
    return st.skip_indexed(beds.files(spark, sf), indexed(spark, sf)).select("owner_id", "file_id")


@query("force_reindex", facts("files") + "select owner_id, file_id, case when file_id in "
       f"({INDEXED}) then 2 else 1 end as version, size_bytes from files")
def force_reindex(spark, sf):
    cols = ["owner_id", "file_id", "version", "size_bytes"]
    old = beds.files(spark, sf).withColumn("version", F.lit(1)).select(*cols)
    new = indexed(spark, sf).withColumn("version", F.lit(2)).select(*cols)
    return st.replace_rows(old, new)


@query("index_status", facts("files") + "select owner_id, file_id, file_name, case when reason in "
       "('skip_listed', 'unsupported', 'already_indexed') then 'skipped' when reason <> '' then "
       "'error' else 'success' end as status, reason, case when reason = '' then n else 0 end as "
       "chunks_count from (select *, case when mime_type = 'image/png' then 'skip_listed' "
       f"when mime_type not in ('application/pdf', '{DOCX}', 'application/msword') then "
       f"'unsupported' when file_id in ({INDEXED}) then 'already_indexed' "
       f"when {trim('text')} = '' then 'no_text' when n = 0 then 'no_chunks' else '' end as reason "
       "from (select *, cast(ceil(size_bytes / 512.0) as bigint) as n from files))")
def index_status(spark, sf):
    f = beds.files(spark, sf)
    counts = f.select("owner_id", "file_id",
                      F.ceil(F.col("size_bytes") / F.lit(512.0)).alias("chunks_count"))
    return st.index_status(f, indexed(spark, sf), counts)


def status_log(spark, sf):
    """Events as an index log: errors failed, views were skipped, the rest was indexed."""
    e = beds.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "view", "skipped").otherwise("success")
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("owner_id"),
                    F.col("event_id").cast("string").alias("file_id"), status.alias("status"),
                    F.concat(F.lit("reason "), "props").alias("reason"))


LOG = ("select 'u' || user_id as owner_id, case event_type when 'error' then 'error' when 'view' "
       "then 'skipped' else 'success' end as status, 'reason ' || props as reason from events")


@query("sync_rollup", f"select owner_id, count(*) as total_found, count(*) filter (status = "
       f"'success') as indexed, count(*) filter (status = 'skipped') as skipped, count(*) filter "
       f"(status = 'error') as errors from ({LOG}) group by owner_id")
def sync_rollup(spark, sf):
    return st.sync_rollup(status_log(spark, sf))


@query("top_errors", f"select substr(reason, 1, 80) as reason, count(*) as n from ({LOG}) "
       "where status = 'error' group by 1 order by n desc, reason limit 5")
def top_errors(spark, sf):
    return st.top_errors(status_log(spark, sf))


VECTORS_SQL = (facts("vecs") + "select owner_id, chunk_id, round(list_sum("
       "list_transform(emb, lambda x: case when label < 5 then -x else x end)), 6) as total, "
       "case when label < 5 then 2 else 1 end as version from vecs")


@query("upsert_vectors", VECTORS_SQL)
def upsert_vectors(spark, sf):
    """The vectors of half of the labels are written again with the sign turned."""
    v = beds.vectors(spark, sf)
    cols = ["owner_id", "chunk_id", "embedding", "version"]
    old = v.withColumn("version", F.lit(1)).select(*cols)
    new = v.filter("label < 5").withColumn("version", F.lit(2)).withColumn(
        "embedding", F.transform("embedding", lambda x: -x)).select(*cols)
    return st.upsert_vectors(old, new).select(
        "owner_id", "chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
        .alias("total"), "version")


NODES_SQL = ("select p_partkey as id, case when s is null then p_name else 'renamed' end "
       "as name, p_brand as brand, s as note from part left join (select l_partkey, "
       "max(l_returnflag) as s from lineitem where l_quantity > 49 group by 1) "
       "on p_partkey = l_partkey")


@query("upsert_nodes", NODES_SQL)
def upsert_nodes(spark, sf):
    """Parts ordered in large numbers are renamed and get a note; the brand is not touched."""
    old = beds.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias(
        "name"), F.col("p_brand").alias("brand"))
    new = beds.table(spark, sf, "lineitem").filter("l_quantity > 49").groupBy(
        F.col("l_partkey").alias("id")).agg(F.max("l_returnflag").alias("note")).withColumn(
        "name", F.lit("renamed"))
    return st.upsert_properties(old, new, ["id"]).select("id", "name", "brand", "note")


@query("upsert_documents", facts("files") + "select owner_id, file_id, file_name, case when file_id "
       f"in ({INDEXED}) then 'https://example.com/' || file_id else "
       "'https://drive.google.com/file/d/' || file_id || '/view' end as link from files")
def upsert_documents(spark, sf):
    f = beds.files(spark, sf)
    old = f.select("owner_id", "file_id", F.lit("old").alias("file_name"),
                   F.lit("").alias("link"))
    new = indexed(spark, sf).select("owner_id", "file_id", "file_name", F.concat(
        F.lit("https://example.com/"), "file_id").alias("link"))
    rest = f.join(new, ["owner_id", "file_id"], "left_anti").select(
        "owner_id", "file_id", "file_name", F.lit(None).cast("string").alias("link"))
    return st.upsert_documents(old, new.unionByName(rest)).select(
        "owner_id", "file_id", "file_name", "link")


@query("upsert_vectors_stored", VECTORS_SQL)
def upsert_vectors_stored(spark, sf):
    """The same update of a table in buckets, of which only those of the new vectors are rewritten."""
    v = beds.vectors(spark, sf)
    cols = ["owner_id", "chunk_id", "embedding", "version"]
    path = scratch_path(spark, "vectors")
    buckets.write_vectors(v.withColumn("version", F.lit(1)).select(*cols), path)
    buckets.upsert_vectors(spark, path, v.filter("label < 5").withColumn("version", F.lit(2)).withColumn(
        "embedding", F.transform("embedding", lambda x: -x)).select(*cols), version="version")
    return buckets.read_table(spark, path).select(
        "owner_id", "chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
        .alias("total"), "version")


@query("upsert_nodes_stored", NODES_SQL)
def upsert_nodes_stored(spark, sf):
    """Parts in buckets get new properties in two updates: the name, then the note."""
    path = scratch_path(spark, "nodes")
    buckets.write_table(beds.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.lit(None).cast("string").alias("note")), path, ["id"])
    new = beds.table(spark, sf, "lineitem").filter("l_quantity > 49").groupBy(
        F.col("l_partkey").alias("id")).agg(F.max("l_returnflag").alias("note"))
    buckets.upsert_properties(spark, path, new.select("id", F.lit("renamed").alias("name")), ["id"])
    buckets.upsert_properties(spark, path, new, ["id"])
    return buckets.read_table(spark, path).select("id", "name", "brand", "note")


@query("delete_stored", facts("files") + "select owner_id, file_id, file_name from files where file_id "
       "not in (select cast(doc_id as varchar) from labels where quality = 0)")
def delete_stored(spark, sf):
    """Badly rated documents are removed from a catalogue in buckets."""
    path = scratch_path(spark, "catalogue")
    f = beds.files(spark, sf).select("owner_id", "file_id", "file_name")
    buckets.write_table(f, path, st.FILE_KEY)
    bad = beds.table(spark, sf, "labels").filter("quality = 0").select(
        F.col("doc_id").cast("string").alias("file_id"))
    buckets.delete_keys(spark, path, f.join(bad, "file_id", "left_semi"), st.FILE_KEY)
    return buckets.read_table(spark, path)


@query("delete_document", facts("g_documents g_chunks g_mentions g_entities") +
       ", gone as (select owner_id, file_id from g_documents join customer on file_id = 'C' || "
       "c_custkey where c_acctbal < 0), dead as (select chunk_id from g_chunks join gone using "
       "(owner_id, file_id)), ent as (select owner_id, entity_id, count(*) filter (chunk_id in "
       "(from dead)) as lost, count(*) filter (chunk_id not in (from dead)) as rest from g_mentions "
       "group by 1, 2) "
       "select 'documents' as kind, count(*) as n from g_documents where (owner_id, file_id) not in "
       "(select owner_id, file_id from gone) union all select 'chunks', count(*) from g_chunks "
       "where chunk_id not in (from dead) union all select 'mentions', count(*) from g_mentions "
       "where chunk_id not in (from dead) union all select 'entities', count(*) from g_entities "
       "where (owner_id, entity_id) not in (select owner_id, entity_id from ent where lost > 0 "
       "and rest = 0)")
def delete_document(spark, sf):
    """Delete the documents of all customers in debt; count what is left of each kind."""
    docs = beds.graph_documents(spark, sf)
    debt = beds.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("file_id"))
    mentions = beds.graph_mentions(spark, sf)
    chunks = beds.graph_chunks(spark, sf)
    edges = mentions.select("owner_id", F.col("chunk_id").alias("src"),
                            F.col("entity_id").alias("dst"), F.lit("MENTIONS").alias("rel_type"))
    out = st.delete_documents(
        docs.join(debt, "file_id", "left_semi"), docs, chunks,
        chunks.select("owner_id", "chunk_id"), edges, beds.graph_entities(spark, sf))
    parts = [("documents", "documents"), ("chunks", "chunks"), ("mentions", "edges"),
             ("entities", "entities")]
    counts = [out[key].agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
              for kind, key in parts]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


@query("collection_info", facts("files") + "select owner_id, count(*) as count from files "
       "where owner_id <> 'src3' group by owner_id")
def collection_info(spark, sf):
    return st.collection_info(st.drop_collection(beds.files(spark, sf), "src3"))


@query("get_by_ids", facts("vecs") + "select owner_id, chunk_id, label from vecs where file_id in "
       "(select cast(doc_id as varchar) from labels where quality = 1)")
def get_by_ids(spark, sf):
    """Fetch the chunks of all well rated documents from newline lists of ids, one per rating."""
    lists = beds.table(spark, sf, "labels").filter("quality = 1").select(
        F.concat(F.lit(" "), F.col("doc_id"), F.lit("__chunk_0 \n\nmissing")).alias("ids"))
    return st.get_by_ids(beds.vectors(spark, sf), st.ids_from_text(lists)).select(
        "owner_id", "chunk_id", "label")


@query("list_documents", facts("files") + "select file_id, file_name from files where owner_id = "
       "'src7' order by file_name, file_id limit 100")
def list_documents(spark, sf):
    return st.list_documents(beds.files(spark, sf), "src7").select("file_id", "file_name")


@query("tenant_key", "select distinct 'kb_' || substr(regexp_replace(c_name || '@' || c_mktsegment, "
       "'[^\\p{L}\\p{N}_\\-]', '_', 'g'), 1, 128) as tenant from customer")
def tenant_key(spark, sf):
    c = beds.table(spark, sf, "customer")
    return c.select(keys.tenant_key(F.concat_ws("@", "c_name", "c_mktsegment")).alias("tenant")
                    ).distinct()


@query("load_questions", "select 'set' || conv_id as owner_id, 'q' || lpad(cast(row_number() over "
       "(partition by conv_id order by turn) as varchar), 2, '0') as question_id, case role when "
       "'user' then 'relationship' else 'factual' end as category, text as question, "
       "role = 'system' as should_refuse from conversations")
def load_questions(spark, sf):
    """Conversations as question sets in JSON, parsed with the declared schema."""
    c = beds.table(spark, sf, "conversations")
    item = F.struct(
        "turn", F.col("text").alias("question"),
        F.when(F.col("role") == "user", "RELATIONSHIP").otherwise("chat").alias("category"),
        F.when(F.col("role") == "system", True).alias("should_refuse"))
    sets = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("questions")).select(
        F.to_json(F.struct(F.concat(F.lit("set"), F.col("conv_id")).alias("owner_id"), "questions"))
        .alias("json"))
    parsed = sets.select(F.from_json("json", st.QUESTION_SET).alias("s")).select("s.*")
    return st.load_questions(parsed).select("owner_id", "question_id", "category", "question",
                                            "should_refuse")


@query("write_report", f"select owner_id, count(*) as total_found, count(*) filter (status = "
       f"'success') as indexed, 'nightly' as run from ({LOG}) group by owner_id")
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    rows = st.sync_rollup(status_log(spark, sf)).select("owner_id", "total_found", "indexed")
    st.write_report(rows, path, run="nightly")
    return spark.read.schema(rows.schema.add("run", "string")).json(path)
