"""Normal forms, tokens, hashes, keys, locations, snippets and answer checks over the tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import keys
from corvane.functions import lexicon as lx
from corvane.functions import text as tx
from corvane.operators.extraction import parse_extraction
from workload import beds
from workload.registry import query
from workload.sqlparts import (
    facts, in_list, norm_answer, norm_name, norm_text, plain_key, relation_key, snippet, tokens,
    trim, values,
)


def hashed(spark, sf, column):
    """Long results are compared by their hash."""
    return beds.texts(spark, sf).select("file_id", column.alias("out")).select(
        "file_id", F.sha2("out", 256).alias("hash"), F.length("out").cast("bigint").alias("n"))


def hashed_sql(expr, table="files"):
    return facts("files") + (f"select file_id, sha256(o) as hash, length(o) as n from "
                             f"(select file_id, {expr} as o from {table})")


@query("strip_accents", hashed_sql("strip_accents(text)"))
def strip_accents(spark, sf):
    return hashed(spark, sf, tx.strip_accents("text"))


@query("normalize_text", hashed_sql(norm_text("text")))
def normalize_text(spark, sf):
    return hashed(spark, sf, tx.normalize_text("text"))


@query("tokenize", facts("files") + "select token, count(*) as n, count(distinct file_id) as files "
       f"from (select file_id, unnest({tokens('text')}) as token from files) group by token")
def tokenize(spark, sf):
    t = beds.texts(spark, sf).select("file_id", F.explode(tx.tokenize("text")).alias("token"))
    per_file = t.groupBy("token", "file_id").agg(F.count("*").alias("k"))
    return per_file.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("files"))


@query("normalize_name", hashed_sql(norm_name("text")))
def normalize_name(spark, sf):
    return hashed(spark, sf, tx.normalize_name("text"))


@query("normalize_answer", f"select conv_id, turn, {norm_answer('text')} as answer "
       "from conversations")
def normalize_answer(spark, sf):
    return beds.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalize_answer("text").alias("answer"))


@query("clean_relation", f"select raw, {relation_key('raw')} as key, count(*) as n from ("
       "select o_orderpriority as raw from orders union all select ' ' || p_type || ' / ' || p_name "
       "from part union all select l_returnflag || '!!' from lineitem) group by raw")
def clean_relation(spark, sf):
    raw = beds.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw")).unionByName(
        beds.table(spark, sf, "part").select(
            F.concat(F.lit(" "), "p_type", F.lit(" / "), "p_name").alias("raw"))).unionByName(
        beds.table(spark, sf, "lineitem").select(F.concat("l_returnflag", F.lit("!!")).alias("raw")))
    counted = raw.groupBy("raw").agg(F.count("*").alias("n"))
    return counted.select("raw", tx.relation_key("raw").alias("key"), "n")


RAW_BY_STATUS = {"F": "Làm việc tại", "O": "leads to", "P": "frobnicates"}
_PAIRS = list(lx.RELATION_ALIASES.items())


@query("canonical_relation", "select raw, coalesce(t, k) as rel_type, coalesce(t, k) in "
       f"{in_list(lx.RELATION_TYPES)} as canonical, coalesce(t, k) not in "
       f"{in_list(lx.SYSTEM_RELATIONS)} as semantic, n from (select raw, n, {relation_key('raw')} "
       "as k from (select case o_orderstatus when 'F' then 'Làm việc tại' when 'O' then 'leads to' "
       "else 'frobnicates' end as raw, count(*) as n from orders group by 1 union all "
       "select event_type, count(*) from events group by 1)) left join "
       f"{values(_PAIRS)} a(al, t) on al = k")
def canonical_relation(spark, sf):
    """Order states and event types as raw relation texts."""
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", RAW_BY_STATUS["F"]).when(status == "O", RAW_BY_STATUS["O"]
                                                         ).otherwise(RAW_BY_STATUS["P"])
    rows = beds.table(spark, sf, "orders").groupBy(raw.alias("raw")).agg(
        F.count("*").alias("n")).unionByName(beds.table(spark, sf, "events").groupBy(
            F.col("event_type").alias("raw")).agg(F.count("*").alias("n")))
    return rows.select("raw", tx.relation_type("raw").alias("rel_type"),
                       tx.is_canonical_relation("raw").alias("canonical"),
                       tx.is_semantic_relation("raw").alias("semantic"), "n")


_LABELS = list(lx.LABEL_ALIASES.items())


@query("canonical_label", f"select raw, case when k in {in_list(lx.ENTITY_LABELS)} then k else "
       f"coalesce(t, 'OTHER') end as label, n from (select raw, n, {plain_key('raw')} as k from ("
       "select case p_type when 'ECONOMY' then 'company' when 'PROMO' then 'Work of art' when "
       "'LARGE' then 'Gpe' when 'SMALL' then 'person' else p_type end as raw, count(*) as n "
       f"from part group by 1)) left join {values(_LABELS)} a(al, t) on al = k")
def canonical_label(spark, sf):
    kind = F.col("p_type")
    raw = F.when(kind == "ECONOMY", "company").when(kind == "PROMO", "Work of art").when(
        kind == "LARGE", "Gpe").when(kind == "SMALL", "person").otherwise(kind)
    rows = beds.table(spark, sf, "part").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return rows.select("raw", tx.entity_label("raw").alias("label"), "n")


@query("strip_title", "select c_custkey, c_name as name from customer")
def strip_title(spark, sf):
    """Titles put in front of every customer name come off again."""
    n = F.col("c_nationkey")
    titled = F.when(n < 5, F.concat(F.lit("Ông/Bà: "), "c_name")).when(
        n < 10, F.concat(F.lit("Mr. "), "c_name")).when(
        n < 15, F.concat(F.lit("pgs.ts "), "c_name")).otherwise(F.col("c_name"))
    return beds.table(spark, sf, "customer").select("c_custkey", tx.strip_title(titled).alias("name"))


@query("content_hash", facts("files") + f"select file_id, sha256({trim('text')}) as content_hash "
       "from files")
def content_hash(spark, sf):
    return beds.files(spark, sf).select("file_id", tx.content_hash("text").alias("content_hash"))


@query("build_keys", facts("vecs") + "select chunk_id, chunk_id as built, chunk_id as referenced, "
       "file_id || '__chunk_0' as broken, owner_id || '__label_' || label as entity_id from vecs")
def build_keys(spark, sf):
    v = beds.vectors(spark, sf)
    return v.select(
        "chunk_id", keys.chunk_id("file_id", "chunk_index").alias("built"),
        keys.chunk_reference(F.concat(F.lit(" "), "chunk_id"), F.lit("x"), F.lit(3))
        .alias("referenced"),
        keys.chunk_reference(F.lit(""), "file_id", F.lit("many")).alias("broken"),
        keys.entity_id("owner_id", F.concat(F.lit("label_"), F.col("label"))).alias("entity_id"))


@query("location_columns", facts("placed") + "select f.file_id, chunk_index, 'Trang ' || "
       "page_estimate || ', dòng ' || case when line_end > line_start then line_start || '–' || "
       "line_end else line_start || '' end as location, case when mime_type = 'application/pdf' "
       "then 'https://drive.google.com/file/d/' || f.file_id || '/preview#page=' || page_estimate "
       "else 'https://drive.google.com/file/d/' || f.file_id || '/view' end as link "
       "from placed p join files f on p.owner_id = f.owner_id and p.file_id = f.file_id")
def location_columns(spark, sf):
    from workload.chunk_queries import chunks
    mime = beds.files(spark, sf).select("owner_id", "file_id", "mime_type")
    c = chunks(spark, sf).join(mime, ["owner_id", "file_id"])
    page, first, last = (keys.positive(x) for x in ("page_estimate", "line_start", "line_end"))
    return c.select(
        "file_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        keys.location_label(page, first, last).alias("location"),
        keys.location_link(F.lit(""), "file_id", page, "mime_type", F.lit("")).alias("link"))


@query("snippet", facts("files") + f"select file_id, {snippet('text', 120)} as snippet from files")
def make_snippet(spark, sf):
    return beds.texts(spark, sf).select("file_id", tx.snippet("text", 120).alias("snippet"))


def answers(spark, sf):
    """Assistant turns; every answer of a conversation that had a system turn is a refusal."""
    c = beds.table(spark, sf, "conversations")
    strict = c.filter("role = 'system'").select("conv_id").distinct().withColumn("s", F.lit(1))
    return c.filter("role = 'assistant'").join(strict, "conv_id", "left").select(
        "conv_id", "turn", F.when(F.col("s").isNotNull(), F.concat(
            F.lit("Tôi không TÌM thấy, "), "text")).otherwise(F.col("text")).alias("answer"))


ANSWERS = ("select conv_id, turn, case when conv_id in (select conv_id from conversations where "
           "role = 'system') then 'Tôi không TÌM thấy, ' || text else text end as answer "
           "from conversations where role = 'assistant'")


@query("detect_refusal", f"select conv_id, turn, regexp_matches({norm_answer('answer')}, "
       "'khong tim thay|khong co thong tin|khong co trong tai lieu|khong nam trong|"
       "i (?:could not|cannot|can''t) find|not found in (?:your )?documents|"
       f"no (?:relevant )?information') as refused from ({ANSWERS})")
def detect_refusal(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", tx.is_refusal("answer").alias("refused"))


@query("keyword_overlap", "select conv_id, turn, case when len(kw) > 0 then round(len(list_filter("
       f"kw, lambda k: contains({norm_answer('answer')}, strip_accents(lower(k))))) / len(kw), 4) "
       "end as overlap from (select a.conv_id, a.turn, a.text as answer, list_filter("
       "string_split_regex(u.text, '\\s+'), lambda k: k <> '') as kw from conversations a join "
       "conversations u on a.conv_id = u.conv_id and u.turn = a.turn - 1 "
       "where a.role = 'assistant')")
def keyword_overlap(spark, sf):
    """Words of the turn before each answer as its keywords."""
    c = beds.table(spark, sf, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = c.select("conv_id", "turn", "role", "text", before.alias("asked"),
                     F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("t0"))
    pairs = pairs.filter("role = 'assistant' and t0 = turn - 1")
    return pairs.select("conv_id", "turn", tx.keyword_overlap(
        "text", F.split("asked", r"\s+")).alias("overlap"))


@query("mentioned_in_text", facts("g_entities asked") + "select q.query_id, e.name, "
       "(contains(strip_accents(lower(question)), strip_accents(lower(name))) or len(list_filter("
       "string_split(strip_accents(lower(name)), ' '), lambda w: length(w) >= 4 and contains("
       "strip_accents(lower(question)), w))) > 0) as mentioned from asked q join "
       "t_made e on q.query_id = e.query_id".replace("t_made", "(select 'S' || s_suppkey as "
       "query_id, p_name || ' ' || p_partkey as name from (select distinct l_suppkey, l_partkey "
       "from lines) join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey)"))
def mentioned_in_text(spark, sf):
    """For each supplier's question, which of the supplier's parts are named in it."""
    parts = beds.order_lines(spark, sf).select("l_suppkey", "l_partkey").distinct().join(
        beds.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("query_id"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    q = beds.supplier_questions(spark, sf).select("query_id", "question")
    return parts.join(q, "query_id").select(
        "query_id", "name", tx.mentioned_in("name", "question").alias("mentioned"))


@query("parse_extraction", "select owner_id, file_id, chunk_index, pos, raw_name, raw_type, "
       "description from (select 'u' || user_id as owner_id, 'f' || event_id as file_id, "
       "0 as chunk_index, 0 as pos, 'user ' || user_id as raw_name, 'PERSON' as raw_type, '' as "
       "description, event_type from events union all select 'u' || user_id, 'f' || event_id, "
       "0, 1, event_type, case when event_type = 'click' then 'OTHER' else 'EVENT' end, props, "
       "event_type from events) where event_type <> 'error'")
def parse_extractions(spark, sf):
    """Events as model output: fenced, with synonym keys, and cut off for errors."""
    e = beds.table(spark, sf, "events")
    ents = F.array(
        F.struct(F.concat(F.lit(" user "), F.col("user_id")).alias("name"),
                 F.lit("PERSON").alias("type"), F.lit("GROUP").alias("label"),
                 F.lit(None).cast("string").alias("description")),
        F.struct(F.col("event_type").alias("name"), F.lit("").alias("type"),
                 F.when(F.col("event_type") == "click", "").otherwise("EVENT").alias("label"),
                 F.col("props").alias("description")))
    extra = F.struct(F.lit(7).alias("chunk_index"), ents.alias("entities"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("chunk_index"),
                                               ents.alias("entities")), extra).alias("chunks")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    output = F.when(F.col("event_type") == "error", F.substring(body, 1, 40)).when(
        F.col("event_type") == "view", body).otherwise(fenced)
    outputs = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("owner_id"),
                       F.concat(F.lit("f"), F.col("event_id")).alias("file_id"),
                       output.alias("output"))
    expected = outputs.select("owner_id", "file_id", F.lit(0).alias("chunk_index"))
    entities, _ = parse_extraction(outputs, expected)
    return entities.drop("subtype")


@query("humanize_relation", "select distinct event_type, lower(replace(upper(event_type) || "
       "'_OF', '_', ' ')) as relation from events")
def humanize_relation(spark, sf):
    e = beds.table(spark, sf, "events").select("event_type").distinct()
    return e.select("event_type", tx.humanize(F.concat(F.upper("event_type"), F.lit("_OF")))
                    .alias("relation"))
