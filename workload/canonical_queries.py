"""Blocking, aliases, similar names, merging, relation rewriting and nearest relations."""

from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.operators import canonical as cn
from corvane.operators import graph as gr
from corvane.session import by_shuffle, cut_lineage
from corvane.session import scratch_path
from workload import beds
from workload.registry import query
from workload.sqlparts import facts, in_list, norm_name, tokens, trim, values


@beds.stored
def part_mentions(spark, sf):
    """Line items as raw mentions of parts by name: many orders name the same 64 names.

    Type, description and upper case vary with the line; ``ord`` is (order, line).
    """
    li = beds.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                  "l_returnflag", "l_suppkey",
                                                  "l_extendedprice")
    o = beds.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = by_shuffle(beds.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    p = by_shuffle(beds.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"))
    owned = by_shuffle(o.join(c, F.col("o_custkey") == F.col("c_custkey")))
    rows = li.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).join(
        p, F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    return rows.select(
        F.col("c_mktsegment").alias("owner_id"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("file_id"),
        F.concat(F.lit("O"), F.col("l_orderkey")).alias("chunk_id"),
        F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"),
                 F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
                 F.col("l_extendedprice").alias("x")).alias("ord"),
        F.when(flag == "A", F.upper("p_name")).when(flag == "N", F.concat(
            F.lit(" "), "p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("raw_name"),
        F.when(flag == "A", "tool").when(flag == "N", "gadget").otherwise("Concept")
        .alias("raw_type"),
        F.lit("").alias("subtype"),
        F.concat_ws(" ", "p_brand", "o_orderpriority").alias("description"))


MENTIONS = (
    "select c_mktsegment as owner_id, 'C' || o_custkey as file_id, 'O' || l_orderkey as chunk_id, "
    "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord, case l_returnflag when 'A' then upper(p_name) "
    "when 'N' then ' ' || p_name || '!' else p_name end as raw_name, case l_returnflag when 'A' "
    "then 'tool' when 'N' then 'gadget' else 'Concept' end as raw_type, case l_returnflag when "
    "'A' then 'PRODUCT' when 'N' then 'OTHER' else 'CONCEPT' end as label, "
    "p_brand || ' ' || o_orderpriority as description from lineitem join orders on l_orderkey = "
    "o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey"
)
RESOLVED = f"select *, trim(raw_name) as name, {norm_name('raw_name')} as name_norm from ({MENTIONS})"
PRIO = "case label when 'PRODUCT' then 3 when 'CONCEPT' then 2 else 1 end"


def resolved(spark, sf):
    return cn.resolve_entities(part_mentions(spark, sf), cn.alias_table(spark), fuzzy=False)


@query("block_entities", facts("files") + "select file_id, token, n from (select file_id, "
       f"unnest({tokens('text', 1)}) as token, count(*) as n from files group by 1, 2) "
       f"where length(token) >= 2 and {norm_name('token')} <> '' and token not in "
       f"{in_list(lx.PRONOUNS)} and token not in {in_list(lx.GENERIC_NAMES)}")
def block_entities(spark, sf):
    """Words of every document as candidate names."""
    from corvane.functions.text import tokenize
    words = beds.texts(spark, sf).select("file_id", F.explode(tokenize("text", 1)).alias("token"))
    counted = words.groupBy("file_id", "token").agg(F.count("*").alias("n"))
    mentions = counted.withColumn("raw_name", F.col("token")).withColumn("raw_type", F.lit("thing"))
    return cn.block_entities(mentions).select("file_id", "token", "n")


CITIES = ["TP HCM", "Saigon", "Sai Gon", "Hanoi", "open-ai", "Facebook", "Da Nang", "elsewhere"]


@query("resolve_alias", "with a(no, al, d) as (select row_number() over () as no, * from "
       f"{values(lx.NAME_ALIASES)} v(al, d)), c as (select replace(al, ' ', '') as k, min_by(d, no) "
       "as d from a group by 1), n as (select c_custkey, [" + ", ".join(f"'{c}'" for c in CITIES)
       + f"][c_nationkey % 8 + 1] as raw from customer) select c_custkey, coalesce(a.d, c.d) as "
       f"alias_name from n left join a on a.al = {norm_name('raw')} left join c on c.k = "
       f"replace({norm_name('raw')}, ' ', '')")
def resolve_alias(spark, sf):
    """Nations as city names in several spellings."""
    from corvane.functions.text import normalize_name
    raw = F.element_at(F.array(*map(F.lit, CITIES)), F.col("c_nationkey") % 8 + 1)
    names = beds.table(spark, sf, "customer").select("c_custkey", normalize_name(raw).alias(
        "clean_norm"))
    return cn.resolve_alias(names, cn.alias_table(spark)).select("c_custkey", "alias_name")


@query("resolve_entities", f"select owner_id, file_id, chunk_id, raw_name, label, name, name_norm, "
       f"count(*) as n from ({RESOLVED}) group by all")
def resolve_entities(spark, sf):
    return resolved(spark, sf).groupBy("owner_id", "file_id", "chunk_id", "raw_name", "label",
                                       "name", "name_norm").agg(F.count("*").alias("n"))


@query("resolve_similar", "select owner_id, label, name_norm || ' ' || md5(name_norm) as name_norm, "
       f"count(*) as n from ({RESOLVED}) group by 1, 2, 3")
def resolve_similar(spark, sf):
    """All steps, the similar earlier name of the same file and label included.

    Every line names its part twice, the second time with the last letter doubled; that spelling
    has to come back to the first. A digest behind the names keeps other names apart.
    """
    m = part_mentions(spark, sf)
    base = F.lower(F.trim(F.regexp_replace("raw_name", "!$", "")))
    m = m.withColumn("raw_name", F.concat(base, F.lit(" "), F.md5(base)))
    twice = m.withColumn("raw_name", F.regexp_replace("raw_name", "(.)$", "$1$1")).withColumn(
        "ord", F.col("ord").withField("o", F.col("ord.o") + 1_000_000_000_000))
    found = cn.resolve_entities(m.unionByName(twice), cn.alias_table(spark))
    return found.filter("ord.o >= 1000000000000").groupBy("owner_id", "label", "name_norm").agg(
        F.count("*").alias("n"))


@query("fuzzy_match")
def fuzzy_match(spark, sf):
    """Names of parts, each also with a typo; blocked by their first letter."""
    parts = beds.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("n"))
    typos = parts.select(F.concat(F.substring("n", 1, 3), F.lit("x"), F.expr("substring(n, 4)"))
                         .alias("n"))
    from corvane.functions.text import normalize_name
    norm = normalize_name("n")
    names = parts.unionByName(typos).select(norm.alias("id")).distinct().select(
        F.substring("id", 1, 1).alias("owner_id"), "id", F.xxhash64("id").alias("pos"),
        cn.token_sorted("id").alias("text"))
    return cn.fuzzy_leaders(cut_lineage(names), ["owner_id"])


@query("merge_mentions", f"select owner_id, owner_id || '__' || name_norm as entity_id, name, "
       "name_norm, type, subtype, description, array_to_string(list_sort(list_filter(raws, "
       "lambda r: r <> name)), ';') as aliases from (select owner_id, name_norm, "
       f"arg_min(name, ord) as name, arg_min(label, (-({PRIO}), ord)) as type, "
       "coalesce(arg_min(raw_type, ord) filter (label = 'OTHER'), '') as subtype, "
       "arg_min(description, (-length(description), ord)) as description, "
       f"list(distinct trim(raw_name)) as raws from ({RESOLVED}) group by owner_id, name_norm)")
def merge_mentions(spark, sf):
    return cn.merge_mentions(resolved(spark, sf)).withColumn("aliases", F.array_join("aliases", ";"))


@query("stable_types", f"select owner_id, name_norm, stable_type, label, count(*) as n from ("
       f"select *, first_value(label) over (partition by owner_id, name_norm order by {PRIO} desc, "
       f"ord) as stable_type from ({RESOLVED})) group by all")
def stable_types(spark, sf):
    return cn.stable_types(resolved(spark, sf)).groupBy(
        "owner_id", "name_norm", "stable_type", "label").agg(F.count("*").alias("n"))


def raw_relations(spark, sf):
    """Neighbouring lines of an order as raw relations between the part names as written."""
    m = part_mentions(spark, sf)
    listed = m.groupBy("owner_id", "file_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "raw_name"))).alias("l"))
    pairs = listed.select("owner_id", "file_id", "chunk_id", F.posexplode("l").alias("i", "a"), "l")
    return pairs.filter(F.col("i") + 1 < F.size("l")).select(
        "owner_id", "file_id", "chunk_id", F.col("a.ord").alias("rel_ord"),
        F.col("a.raw_name").alias("from_raw"),
        F.upper(F.element_at("l", F.col("i") + 2)["raw_name"]).alias("to_raw"),
        F.lit("làm việc tại").alias("relation_raw"), F.lit("next line").alias("description"))


@query("rewrite_relations", f"with m as ({RESOLVED}), dict as (select chunk_id, key, "
       "arg_max((name, name_norm), ord) as hit from (select chunk_id, ord, name, name_norm, "
       "unnest([trim(raw_name), lower(trim(raw_name))]) as key from m) group by 1, 2), r as ("
       "select owner_id, chunk_id, ord, trim(raw_name) as f, upper(trim(lead(raw_name) over "
       "(partition by chunk_id order by ord))) as t from m) select r.owner_id, r.chunk_id, "
       "r.owner_id || '__' || a.n2 as src, r.owner_id || '__' || b.n2 as dst, 'WORKS_FOR' as "
       "rel_type, count(*) as n from r join (select *, hit[1] as n1, hit[2] as n2 from dict) a "
       "on a.chunk_id = r.chunk_id and a.key = r.f join (select *, hit[1] as n1, hit[2] as n2 "
       "from dict) b on b.chunk_id = r.chunk_id and b.key = (case when exists (select 1 from dict "
       "d where d.chunk_id = r.chunk_id and d.key = r.t) then r.t else lower(r.t) end) "
       "where r.t is not null and a.n1 <> b.n1 and a.n2 <> b.n2 group by all")
def rewrite_relations(spark, sf):
    out = cn.rewrite_relations(raw_relations(spark, sf), resolved(spark, sf))
    return out.groupBy("owner_id", "chunk_id", "src", "dst", "rel_type").agg(F.count("*").alias("n"))


@query("merge_entities", f"with m as ({RESOLVED}), e as (select owner_id, name_norm, "
       "case when chunk_id < 'O5' then 0 else 1 end as run, arg_min(name, ord) as name, "
       f"arg_min(label, (-({PRIO}), ord)) as type, arg_min(description, (-length(description), "
       "ord)) as description from m group by 1, 2, 3) select owner_id, owner_id || '__' || "
       "name_norm as entity_id, arg_max(name, run) as name, arg_max(type, run) as type, "
       "arg_min(description, (-length(description), run)) as description from e "
       "group by owner_id, name_norm")
def merge_entities(spark, sf):
    """Two runs over different orders, merged."""
    r = resolved(spark, sf)
    old = cn.merge_mentions(r.filter("chunk_id < 'O5'"))
    new = cn.merge_mentions(r.filter("chunk_id >= 'O5'"))
    return cn.merge_entities(old, new).select("owner_id", "entity_id", "name", "type", "description")


@query("relation_nearest", facts("vecs") + ", c as (select label, list(x order by i) as emb from ("
       "select label, i, avg(x) as x from (select label, unnest(emb) as x, generate_subscripts("
       "emb, 1) as i from vecs) group by 1, 2) group by 1), s as (select v.owner_id, chunk_id, "
       "c.label, list_cosine_similarity(v.emb, c.emb) as cos from vecs v, c) select owner_id, "
       "chunk_id, round(max(cos), 6) as score, case when max(cos) >= 0.75 then 'LABEL_' || "
       "arg_max(label, cos) else 'RELATED_TO' end as rel_type from s group by 1, 2")
def relation_nearest(spark, sf):
    """Label centroids as the canonical relation vectors, every vector as an unknown relation."""
    v = beds.vectors(spark, sf).select("owner_id", "chunk_id", "label", "embedding")
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg("x").alias("x"))
    canon = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias(
        "l")).select(F.concat(F.lit("LABEL_"), F.col("label")).alias("rel_type"),
                     F.transform("l", lambda s: s["x"]).alias("embedding"))
    out = cn.nearest_relation(v.drop("label"), canon)
    return out.withColumn("score", F.round("score", 6))


@query("mention_edges", facts("g_mentions") + "select distinct owner_id, chunk_id as src, "
       "entity_id as dst, 'MENTIONS' as rel_type from g_mentions")
def mention_edges(spark, sf):
    return gr.mention_edges(beds.graph_mentions(spark, sf))


@query("relation_edges", facts("lines") + "select owner_id, owner_id || '__' || replace(lower("
       "c_name), '#', '_') as src, owner_id || '__' || replace(lower(s_name), '#', '_') as dst, "
       "'COLLABORATES_WITH' as rel_type, arg_max(o_orderpriority, o_orderkey) as description "
       "from (select distinct owner_id, o_custkey, o_orderkey, l_suppkey from lines) l join orders "
       "o using (o_orderkey) join customer on l.o_custkey = c_custkey join supplier "
       "on l_suppkey = s_suppkey group by 1, 2, 3")
def relation_edges(spark, sf):
    li = beds.order_lines(spark, sf).select("owner_id", "o_custkey", "o_orderkey",
                                            "l_suppkey").distinct()
    o = beds.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    c, s = beds.table(spark, sf, "customer"), beds.table(spark, sf, "supplier")
    rows = li.join(o, "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        s, F.col("l_suppkey") == F.col("s_suppkey"))
    name = lambda n: F.concat_ws("__", "owner_id", F.lower(F.replace(n, F.lit("#"), F.lit("_"))))
    return gr.relation_edges(rows.select(
        "owner_id", name("c_name").alias("src"), name("s_name").alias("dst"),
        F.lit("COLLABORATES_WITH").alias("rel_type"), F.col("o_orderpriority").alias("description"),
        F.col("o_orderkey").alias("rel_ord")))


@query("cooccurrence_edges", facts("c_edges") + "select owner_id, src, dst, chunks from c_edges")
def cooccurrence_edges(spark, sf):
    return gr.cooccurrence_edges(beds.part_mentions(spark, sf)).select("owner_id", "src", "dst",
                                                                       "chunks")


@query("graph_build_stats", facts("g_chunks g_mentions") + "select owner_id, file_id, "
       "chunks_processed, coalesce(m, 0) as entity_upserts, coalesce(r, 0) as relation_upserts "
       "from (select owner_id, file_id, count(*) as chunks_processed from g_chunks group by 1, 2) "
       "left join (select owner_id, file_id, count(*) as m from g_mentions group by 1, 2) using "
       "(owner_id, file_id) left join (select owner_id, file_id, count(*) as r from (select "
       "distinct owner_id, file_id, chunk_id from g_mentions) group by 1, 2) using (owner_id, "
       "file_id)")
def graph_build_stats(spark, sf):
    m = beds.graph_mentions(spark, sf)
    return gr.graph_build_stats(beds.graph_chunks(spark, sf), m,
                                m.select("owner_id", "file_id", "chunk_id").distinct())


@query("rebuild_document_graph", facts("g_mentions") + "select owner_id, chunk_id as src, entity_id "
       "as dst, case when file_id in (select 'C' || c_custkey from customer where c_acctbal < 0) "
       "then 2 else 1 end as version from (select distinct * from g_mentions)")
def rebuild_document_graph(spark, sf):
    """The documents of customers in debt are built again; their old mentions go first."""
    from corvane.sources.store import replace_rows
    debt = beds.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("file_id"))
    m = beds.graph_mentions(spark, sf).distinct()
    old = m.withColumn("version", F.lit(1))
    new = m.join(debt, "file_id", "left_semi").select(*m.columns).withColumn("version", F.lit(2))
    return replace_rows(old, new).select("owner_id", F.col("chunk_id").alias("src"),
                                         F.col("entity_id").alias("dst"), "version")


@query("read_alias_map", "select lower(c_name) as alias_norm, c_name || '!' as display from customer")
def read_alias_map(spark, sf):
    """Customers as a caller's alias file, one JSON object a line."""
    path = f"{scratch_path(spark, 'aliases')}/aliases"
    pair = F.create_map(F.lower("c_name"), F.concat("c_name", F.lit("!")))
    beds.table(spark, sf, "customer").select(F.to_json(pair)).write.text(path)
    return cn.read_alias_lines(spark, path).select("alias_norm", "display")
