"""Weights, Louvain, merging, bundles, texts and the communities a question needs.

Nations stand in as communities where SQL has to agree; the detection itself runs on the
whole entity graph.
"""

from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.operators import communities as cm
from corvane.operators import context as cx
from corvane.session import by_shuffle, cut_lineage
from workload import beds
from workload.graph_queries import linked
from workload.registry import query
from workload.sqlparts import facts, tokens


@query("entity_graph", facts("g_edges") + "select owner_id, least(src, dst) as a, greatest(src, dst) "
       "as b, sum(case when rel_type = 'COOCCURS_WITH' then 1.0 else 2.5 end)::double as weight, "
       "arg_min(rel_type, (rel_type, description, src)) as rel_type, arg_min(description, "
       "(rel_type, description, src)) as description from g_edges where src <> dst "
       "group by 1, 2, 3")
def entity_graph(spark, sf):
    return cm.entity_graph(beds.graph_edges(spark, sf))


def telling_graph(spark, sf):
    return cut_lineage(cm.entity_graph(beds.telling_edges(spark, sf)))


def trade_graph(spark, sf):
    edges = beds.trade_edges(spark, sf)
    return cm.entity_graph(beds.in_parts(
        edges, beds.parts_of(edges), "owner_id", F.least("src", "dst"), F.greatest("src", "dst")))


def numbered_graph(spark, sf):
    """The whole graph by number, and its weights; parallel edges stay apart."""
    graph = beds.by_number(beds.graph_edges, spark, sf)
    return graph, cm.weighted_edges(graph.edges)


@beds.stored
def partition_numbers(spark, sf):
    """Communities of the whole entity graph of all owners, by number."""
    return cm.louvain(numbered_graph(spark, sf)[1])


@query("louvain")
def louvain(spark, sf):
    return numbered_graph(spark, sf)[0].named(partition_numbers(spark, sf), "node", "comm")


@query("louvain_settled", facts("g_edges") + "select owner_id, count(distinct node) as nodes, "
       "0::bigint as gaining from (select owner_id, src as node from g_edges where src <> dst union "
       "all select owner_id, dst from g_edges where src <> dst) group by 1")
def louvain_settled(spark, sf):
    """Every node has a community, and none would gain by moving."""
    graph, weights = numbered_graph(spark, sf)
    return graph.named(cm.gaining_nodes(weights, partition_numbers(spark, sf)))


@query("modularity", facts("t_edges members") + ", g as (select owner_id, least(src, dst) as a, "
       "greatest(src, dst) as b, sum(2.5) as w from t_edges group by 1, 2, 3), c as (select "
       "owner_id, owner_id || '__' || lower(r_name) as node, lower(r_name) as comm from (select "
       "distinct owner_id, r_name from o_nations) union select owner_id, owner_id || '__' || "
       "lower(n_name), lower(n_name) from o_nations union select owner_id, node, comm from members "
       "union select owner_id, src, dst from t_edges where rel_type = 'CREATED_BY'), k as (select "
       "owner_id, node, sum(w) as k from (select owner_id, a as node, w from g union all select "
       "owner_id, b, w from g) group by 1, 2) select i.owner_id, round(inside / m - sq / (4 * m * "
       "m), 6) as modularity from (select g.owner_id, sum(case when x.comm = y.comm then w else 0 "
       "end)::double as inside, sum(w)::double as m from g join c x on g.owner_id = x.owner_id and "
       "g.a = x.node join c y on g.owner_id = y.owner_id and g.b = y.node group by 1) i join "
       "(select owner_id, sum(tot * tot)::double as sq from (select k.owner_id, comm, sum(k) as tot "
       "from k join c using (owner_id, node) group by 1, 2) group by 1) s using (owner_id)")
def modularity(spark, sf):
    """Nations as communities, each part with the group of its maker; telling edges only."""
    return cm.modularity(telling_graph(spark, sf), makers_and_nations(spark, sf)).withColumn(
        "modularity", F.round("modularity", 6))


def makers_and_nations(spark, sf):
    """Members of nations and regions, and each part with the group of its maker."""
    made = beds.telling_edges(spark, sf).filter("rel_type = 'CREATED_BY'").select(
        "owner_id", F.col("src").alias("node"), F.col("dst").alias("comm"))
    e = beds.graph_entities(spark, sf).filter("type = 'LOCATION'").select(
        "owner_id", F.col("entity_id").alias("node"), F.col("name_norm").alias("comm"))
    return beds.nation_membership(spark, sf).unionByName(e).unionByName(made).distinct()


@query("modularity_whole", facts("g_edges members") + ", g as (select owner_id, least(src, dst) as a, "
       "greatest(src, dst) as b, sum(case when rel_type = 'COOCCURS_WITH' then 1.0 else 2.5 end) as w "
       "from g_edges where src <> dst group by 1, 2, 3), c as (select owner_id, owner_id || '__' || "
       "lower(r_name) as node, lower(r_name) as comm from o_nations union select owner_id, owner_id "
       "|| '__' || lower(n_name), lower(n_name) from o_nations union select owner_id, node, comm from "
       "members union select owner_id, src, dst from t_edges where rel_type = 'CREATED_BY'), ends as ("
       "select owner_id, a as node, w from g union all select owner_id, b, w from g), tots as (select "
       "owner_id, comm, sum(w) as tot from ends join c using (owner_id, node) group by 1, 2), s as ("
       "select owner_id, sum(tot * tot)::double as sq from tots group by 1), i as (select g.owner_id, "
       "sum(case when x.comm = y.comm then w else 0 end)::double as inside, sum(w)::double as m from g "
       "join c x on g.owner_id = x.owner_id and g.a = x.node join c y on g.owner_id = y.owner_id and "
       "g.b = y.node group by 1) select owner_id, round(inside / m - sq / (4 * m * m), 6) as modularity "
       "from i join s using (owner_id)")
def modularity_whole(spark, sf):
    """The same communities over telling and co-occurrence edges."""
    return cm.modularity(cm.weighted_edges(beds.graph_edges(spark, sf)), makers_and_nations(spark, sf)).withColumn(
        "modularity", F.round("modularity", 6))


@query("merge_small_communities")
def merge_small_communities(spark, sf):
    """Every maker with its parts is a community of the whole graph; the small ones join a neighbour."""
    graph, weights = numbered_graph(spark, sf)
    maker = graph.edges.filter("rel_type = 'CREATED_BY'").select(
        "owner_id", F.col("src").alias("node"), F.col("dst").alias("comm"))
    nodes = weights.select("owner_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    members = nodes.join(by_shuffle(maker), ["owner_id", "node"], "left").select(
        "owner_id", "node", F.coalesce("comm", "node").alias("comm"))
    return graph.named(cm.merge_small_communities(cut_lineage(members), weights), "node", "comm")


@query("detect_communities")
def detect_communities(spark, sf):
    """Detection from the graph to stored communities with ids and sizes."""
    graph, weights = numbered_graph(spark, sf)
    merged = cm.merge_small_communities(partition_numbers(spark, sf), weights)
    named = graph.named(merged, "node", "comm")
    return cm.memberships(named)[0].select("owner_id", "community_id", "member_count")


@query("community_edges", facts("trade_graph members") + "select g.owner_id, x.comm, a, b, "
       "weight::double as weight, rel_type, description from trade_graph g join members x on "
       "g.owner_id = x.owner_id and g.a = x.node join members y on g.owner_id = y.owner_id and "
       "g.b = y.node where x.comm = y.comm")
def community_edges(spark, sf):
    return cm.community_edges(trade_graph(spark, sf),
                              beds.nation_membership(spark, sf))


INNER = ("select g.owner_id, x.comm, a, b, weight, rel_type, description from trade_graph g join "
         "members x on g.owner_id = x.owner_id and g.a = x.node join members y on g.owner_id = "
         "y.owner_id and g.b = y.node where x.comm = y.comm")


@query("community_text", facts("trade_graph members g_entities") + f", i as ({INNER}), n as (select "
       "m.owner_id, comm, string_agg('- ' || name || ' [' || type || ']' || case when description <> '' "
       "then ': ' || description else '' end, chr(10) order by rn) as entities_block from (select *, "
       "row_number() over (partition by owner_id, comm order by node) as rn from members) m join "
       "g_entities e on m.owner_id = e.owner_id and m.node = e.entity_id where rn <= 15 group by "
       "all), r as (select i.owner_id, comm, string_agg('- ' || f.name || ' —[' || rel_type || ']→ ' "
       "|| t.name || ' (' || i.description || ')', chr(10) order by rn) as block from (select *, "
       "row_number() over (partition by owner_id, comm order by a, b) as rn from i) i join "
       "g_entities f on f.owner_id = i.owner_id and f.entity_id = i.a join g_entities t on "
       "t.owner_id = i.owner_id and t.entity_id = i.b where rn <= 20 group by all) select owner_id, "
       "comm, entities_block, coalesce(block, '(không có quan hệ nội bộ)') as relations_block from n "
       "left join r using (owner_id, comm)".replace("group by all", "group by 1, 2"))
def community_text(spark, sf):
    return cm.community_text(trade_graph(spark, sf),
                             beds.nation_membership(spark, sf), beds.graph_entities(spark, sf))


@query("community_summary", facts("trade_graph members g_entities") + f", i as ({INNER}), d as "
       "(select owner_id, comm, node, row_number() over (partition by owner_id, comm order by sum("
       "weight) desc, node) as rn from (select owner_id, comm, a as node, weight from i union all "
       "select owner_id, comm, b, weight from i) group by 1, 2, 3) select owner_id, comm, substr("
       "string_agg(name, ', ' order by rn) || ' (COLLABORATES_WITH)', 1, 2000) as summary from d "
       "join g_entities e using (owner_id) where e.entity_id = d.node and rn <= 5 group by 1, 2")
def community_summary(spark, sf):
    return cm.community_summary(trade_graph(spark, sf),
                                beds.nation_membership(spark, sf), beds.graph_entities(spark, sf))


COMM_IDS = ("select owner_id, comm, count(*)::integer as member_count, owner_id || '__community_' || "
            "substr(sha256(string_agg(node, chr(10) order by node)), 1, 12) as community_id "
            "from members group by 1, 2")


@query("community_memberships", facts("members") + f", c as ({COMM_IDS}) select owner_id, node as "
       "src, community_id as dst, 'BELONGS_TO' as rel_type from members join c using (owner_id, "
       "comm)")
def community_memberships(spark, sf):
    return cm.memberships(beds.nation_membership(spark, sf))[1]


@query("replace_communities", facts("members") + f", c as ({COMM_IDS}) select owner_id, "
       "community_id, case when owner_id in (select distinct c_mktsegment from customer where "
       "c_acctbal > 9990) then 2 else 1 end as version from c")
def replace_communities(spark, sf):
    """Owners with a very rich customer are detected again."""
    rich = beds.table(spark, sf, "customer").filter("c_acctbal > 9990").select(
        F.col("c_mktsegment").alias("owner_id")).distinct()
    c = cm.memberships(beds.nation_membership(spark, sf))[0].select("owner_id", "community_id")
    old = c.withColumn("version", F.lit(1))
    return cm.replace_communities(old, c.join(rich, "owner_id", "left_semi").withColumn(
        "version", F.lit(2)))


@query("community_run_stats", facts("members trade_graph g_entities") + "select owner_id, entities, "
       "edges, communities_created, entities_in_communities, '' as reason, 'success' as status from "
       "(select owner_id, count(*) as entities from g_entities group by 1) join (select owner_id, "
       "count(*) as edges from trade_graph group by 1) using (owner_id) join (select owner_id, "
       "count(*) as communities_created, cast(sum(n) as bigint) as entities_in_communities from "
       "(select owner_id, comm, count(*) as n from members group by 1, 2) where n >= 3 group by 1) "
       "using (owner_id)")
def community_run_stats(spark, sf):
    return cm.run_stats(beds.graph_entities(spark, sf),
                        trade_graph(spark, sf),
                        beds.nation_membership(spark, sf))


@query("list_communities", facts("members") + f", c as ({COMM_IDS}) select owner_id, community_id, "
       "member_count from (select *, row_number() over (partition by owner_id order by member_count "
       "desc, community_id) as rn from c) where rn <= 50")
def list_communities(spark, sf):
    return cm.list_communities(cm.memberships(beds.nation_membership(spark, sf))[0]).select(
        "owner_id", "community_id", "member_count")


RELEVANT = (", o as (select "
       "l.owner_id, l.query_id, m.comm, count(*) as overlap from linked l join g_entities e on "
       "l.owner_id = e.owner_id and l.name_norm = e.name_norm join members m on m.owner_id = "
       "e.owner_id and m.node = e.entity_id group by 1, 2, 3), t as (select distinct owner_id, "
       f"query_id, unnest({tokens('question', 3)}) as w from asked), h as (select t.owner_id, "
       "t.query_id, c.comm, count(*) as hits from t join nation_comms c on t.owner_id = c.owner_id "
       "where contains(replace(lower(c.summary), '_', ' '), w) group by 1, 2, 3), s as (select "
       "q.owner_id, q.query_id, c.comm, c.member_count, coalesce(overlap, 0) as overlap, "
       "coalesce(hits, 0) as hits from asked q join nation_comms c on q.owner_id = c.owner_id left "
       "join o on o.query_id = q.query_id and o.comm = c.comm left join h on h.query_id = "
       "q.query_id and h.comm = c.comm) select * from "
       "(select *, round(3.0 * overlap + hits + 0.1 * member_count, 3)::double as score, "
       "row_number() over (partition by owner_id, query_id order by round(3.0 * overlap + hits + "
       "0.1 * member_count, 3) desc, member_count desc, comm) as rn from s where overlap > 0 or "
       "hits > 0) where rn <= 2")
RELEVANT_NEEDS = "linked members nation_comms g_entities"


def relevant(spark, sf):
    return cm.relevant_communities(
        beds.supplier_questions(spark, sf), linked(spark, sf), beds.nation_communities(spark, sf),
        beds.nation_membership(spark, sf), beds.graph_entities(spark, sf))


@query("relevant_communities", facts(RELEVANT_NEEDS) + RELEVANT.replace(
    "select * from", "select owner_id, query_id, comm, overlap, hits, score from"))
def relevant_communities(spark, sf):
    return relevant(spark, sf).select("owner_id", "query_id", "comm", "overlap", "hits", "score")


@query("community_section", facts(RELEVANT_NEEDS) + RELEVANT.replace(
    "select * from", ", best as (select * from") + "), e as (select b.query_id, rn, '[1] ' || "
    "trim(c.summary) || chr(10) || '(Community — ' || c.member_count || ' entities)' as entry, "
    "c.member_count from best b join nation_comms c on b.owner_id = c.owner_id and b.comm = c.comm) "
    f"select query_id, '{lx.COMMUNITY_TITLE}' || chr(10) || chr(10) || case when length(entry) + "
    f"{len(lx.COMMUNITY_TITLE) + 1} > 120 then substr(entry, 1, {120 - len(lx.COMMUNITY_TITLE) - 1}) || "
    "'...' else entry end as text, member_count from e where rn = 1")
def community_section(spark, sf):
    """The community section of each question, 120 characters each."""
    found = relevant(spark, sf)
    params = found.select("owner_id", "query_id").distinct().select(
        "*", F.lit(120).alias("community_budget"), F.lit(1).alias("ref_start"))
    return cx.community_section(found, params).select("query_id", "text", "member_count")
