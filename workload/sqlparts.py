"""SQL building blocks that mirror the beds and text functions, written for DuckDB."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def norm_text(x: str) -> str:
    return (f"regexp_replace(regexp_replace(strip_accents(lower({x})), '[_.\\-]+', ' ', 'g'), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


def words(x: str, n: int) -> str:
    return f"list_filter(string_split_regex({trim(x)}, '\\s+'), lambda w: length(w) >= {n})"


def tokens(x: str, n: int = 2) -> str:
    return words(norm_text(x), n)


def norm_name(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(strip_accents(lower({trim(x)})), 'đ', 'd'), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")


def norm_answer(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g'))"


def plain_key(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(upper({trim(x)}), '[^A-Za-z0-9_]', '_', "
            f"'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')")


def relation_key(x: str) -> str:
    k = plain_key(f"strip_accents({x})")
    return (f"(case when {k} = '' then 'RELATED_TO' when regexp_matches({k}, '^[0-9]') then "
            f"regexp_replace(substr('REL_' || {k}, 1, 60), '^_+|_+$', '', 'g') "
            f"else regexp_replace(substr({k}, 1, 60), '^_+|_+$', '', 'g') end)")


def snippet(x: str, n: int) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return (f"(case when length({flat}) <= {n} then {flat} "
            f"else rtrim(substr({flat}, 1, {n - 1})) || '…' end)")


def values(pairs) -> str:
    quoted = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in p) + ")"
                       for p in pairs)
    return f"(values {quoted})"


def in_list(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def facts(names: str) -> str:
    """WITH clause of the named blocks and everything they need."""
    need, todo = [], names.split()
    while todo:
        n = todo.pop(0)
        if n not in need:
            need.append(n)
            todo.extend(NEEDS.get(n, "").split())
    ordered = [n for n in BLOCKS if n in need]
    return "with recursive " + ",\n".join(f"{n} as materialized ({BLOCKS[n]})" for n in ordered) + "\n"


DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

SENTENCES = (
    "list_filter(flatten(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || "
    "chr(1), 'g'), chr(1)), lambda s: list_transform(string_split(s, chr(10)), "
    f"lambda t: {trim('t')}))), lambda t: t <> '')"
)
PARAGRAPHS = (
    "list_filter(list_transform(string_split_regex(replace(replace(text, chr(13) || chr(10), "
    f"chr(10)), chr(13), chr(10)), '\\n{{2,}}'), lambda p: {trim('p')}), lambda p: p <> '')"
)


def _fold(size: int = 512, overlap: int = 50) -> str:
    flush = max(size // 2, 200)
    c1 = f"(a.has and a.n >= {flush})"
    done1 = f"(case when {c1} then list_append(a.done, a.buf) else a.done end)"
    buf1 = f"(case when {c1} then right(a.buf, {overlap}) else a.buf end)"
    n1 = f"(case when {c1} then length(right(a.buf, {overlap})) else a.n end)"
    c2 = f"(a.has and {n1} + length(x.buf) + 1 > {size})"
    done2 = f"(case when {c2} then list_append({done1}, {buf1}) else {done1} end)"
    buf2 = f"(case when {c2} then right({buf1}, {overlap}) else {buf1} end)"
    n2 = f"(case when {c2} then length({buf2}) else {n1} end)"
    return ("{'done': " + done2 + ", 'buf': case when a.has then " + buf2
            + " || ' ' || x.buf else x.buf end, 'n': " + n2
            + " + length(x.buf) + 1, 'has': true}")


_EMPTY = "{'done': []::VARCHAR[], 'buf': ''::VARCHAR, 'n': 0::BIGINT, 'has': false}"

BLOCKS: dict[str, str] = {
    "files": (
        "select source as owner_id, cast(doc_id as varchar) as file_id, 'doc_' || doc_id || "
        "case lang when 'en' then '.pdf' when 'fr' then '.docx' when 'de' then '.doc' "
        "when 'es' then '.png' else '.bin' end as file_name, "
        f"case lang when 'en' then 'application/pdf' when 'fr' then '{DOCX}' "
        "when 'de' then 'application/msword' when 'es' then 'image/png' "
        "else 'application/octet-stream' end as mime_type, n_chars as size_bytes, text "
        "from documents"
    ),
    "units": (
        "select owner_id, file_id, text, flatten(list_transform(" + PARAGRAPHS
        + ", lambda p: case when length(p) <= 512 then [p] else " + SENTENCES + " end)) as units "
        "from files"
    ),
    "packed": (
        "select owner_id, file_id, text, case when s.has then list_append(s.done, s.buf) else "
        "s.done end as chunks from (select *, list_reduce(list_transform(units, lambda u: "
        "{'done': []::VARCHAR[], 'buf': u, 'n': 0::BIGINT, 'has': false}), lambda a, x: "
        + _fold() + ", " + _EMPTY + ") as s from units)"
    ),
    "chunks": (
        "select owner_id, file_id, i - 1 as chunk_index, len(chunks) as total_chunks, "
        "chunks[i] as text from (select owner_id, file_id, chunks, "
        "unnest(range(1, len(chunks) + 1)) as i from packed)"
    ),
    "offsets": (
        "select owner_id, file_id, text as body, chunks, list_reduce(list_transform(chunks, "
        "lambda c: {'out': []::BIGINT[], 'c': c, 'f': 0::BIGINT}), lambda a, x: "
        "{'out': list_append(a.out, (case when instr(substr(text, a.f + 1), x.c) > 0 then "
        "a.f + instr(substr(text, a.f + 1), x.c) - 1 "
        "when instr(substr(text, a.f + 1), substr(x.c, 1, 100)) > 0 then "
        "a.f + instr(substr(text, a.f + 1), substr(x.c, 1, 100)) - 1 else a.f end)), 'c': '', "
        "'f': (case when instr(substr(text, a.f + 1), x.c) > 0 then "
        "a.f + instr(substr(text, a.f + 1), x.c) "
        "when instr(substr(text, a.f + 1), substr(x.c, 1, 100)) > 0 then "
        "a.f + instr(substr(text, a.f + 1), substr(x.c, 1, 100)) else a.f + 1 end)}, "
        "{'out': []::BIGINT[], 'c': '', 'f': 0::BIGINT}).out as starts from packed"
    ),
    "placed": (
        "select owner_id, file_id, i - 1 as chunk_index, len(chunks) as total_chunks, "
        "chunks[i] as text, starts[i] as char_start, starts[i] + length(chunks[i]) as char_end, "
        "body, starts[i] // 2500 + 1 as page_estimate, "
        "length(substr(body, 1, starts[i])) - length(replace(substr(body, 1, starts[i]), chr(10), "
        "'')) + 1 as line_start, "
        "length(substr(body, 1, starts[i] + length(chunks[i]))) - length(replace(substr(body, 1, "
        "starts[i] + length(chunks[i])), chr(10), '')) + 1 as line_end "
        "from (select *, unnest(range(1, len(chunks) + 1)) as i from offsets)"
    ),
    "kept": (
        "select *, file_id || '__chunk_' || chunk_index as chunk_id from (select *, row_number() "
        f"over (partition by owner_id, file_id, sha256({trim('text')}) order by chunk_index) as rn "
        "from placed) where rn = 1"
    ),
    "vecs": (
        "select owner_id, file_id || '__chunk_0' as chunk_id, file_id, file_name, "
        "embedding::DOUBLE[] as emb, label, text, mime_type from embeddings e join files f "
        "on cast(e.vec_id as varchar) = f.file_id"
    ),
    "topic_means": (
        "select owner_id, label, i, avg(x) as x from (select owner_id, label, unnest(emb) as x, "
        "generate_subscripts(emb, 1) as i from vecs) group by all"
    ),
    "topics": (
        "select m.owner_id, m.owner_id || '_' || m.label as query_id, m.label, "
        "list(m.x order by m.i) as emb, 'What is label_' || m.label || ' about? ' || "
        "coalesce(any_value(b.text), '') as question from topic_means m left join benchmark b "
        "on b.item_id = m.label group by m.owner_id, m.label"
    ),
    "hits": (
        "select * from (select *, row_number() over (partition by owner_id, query_id "
        "order by cosine desc, chunk_id) as vec_rank from (select q.owner_id, q.query_id, "
        "q.question, v.chunk_id, v.file_id, v.file_name, v.text, "
        "round(list_cosine_similarity(q.emb, v.emb), 10) as cosine from topics q join vecs v "
        "on q.owner_id = v.owner_id))"
    ),
    "scored": (
        "select *, round(greatest(0, 1 - (1 - cosine) / 2), 4) as vector_score, "
        "case when len(qw) = 0 then 0.0 else least(1.0, greatest(0.0, "
        "0.65 * (len(list_intersect(qw, tw)) / len(qw)) + 0.25 * (len(list_intersect(qw, fw)) / "
        "len(qw)) + 0.10 * (case when length(qn) >= 4 and contains(hay, qn) then 1.0 "
        "when length(qn) >= 3 and len(lw) > 0 and len(list_filter(lw, lambda w: not "
        "contains(hay, w))) = 0 then 0.6 else 0.0 end))) end as kw from (select *, "
        "list_filter(qw, lambda w: length(w) >= 4) as lw from (select *, "
        "list_distinct(" + words("qn", 2) + ") as qw, list_distinct(" + words("tn", 2)
        + ") as tw, list_distinct(" + words("fn", 2) + ") as fw, tn || ' ' || fn as hay from ("
        "select *, " + norm_text("question") + " as qn, " + norm_text("text") + " as tn, "
        + norm_text("file_name") + " as fn from hits)))"
    ),
    "reranked": (
        "select owner_id, query_id, question, chunk_id, file_id, file_name, text, vec_rank, "
        "cosine, vector_score, round(kw, 4) as keyword_score, "
        "round(round(0.8 * vector_score + 0.2 * kw, 10), 4) as combined_score from scored"
    ),
    "retrieved": (
        "select * from (select *, row_number() over (partition by owner_id, query_id order by "
        "combined_score desc, vec_rank) as rank from reranked where vec_rank <= 15 and "
        "combined_score >= 0.12) where rank <= 5"
    ),
    "retrieved10": (
        "select * from (select *, row_number() over (partition by owner_id, query_id order by "
        "combined_score desc, vec_rank) as rank from reranked where vec_rank <= 30 and "
        "combined_score >= 0.12) where rank <= 10"
    ),
    "tg_named": (
        "select owner_id, file_id, chunk_id, 'label_' || label as a, 'type ' || "
        "string_split(file_name, '.')[-1] as b from vecs"
    ),
    "tg_mentions": (
        "select owner_id, file_id, chunk_id, owner_id || '__' || a as entity_id from tg_named "
        "union all select owner_id, file_id, chunk_id, owner_id || '__' || b from tg_named"
    ),
    "tg_entities": (
        "select owner_id, entity_id, substr(entity_id, length(owner_id) + 3) as name, "
        "substr(entity_id, length(owner_id) + 3) as name_norm, 'CONCEPT' as type, "
        "'in ' || count(*) || ' chunks' as description from tg_mentions "
        "group by owner_id, entity_id"
    ),
    "tg_edges": (
        "select owner_id, owner_id || '__' || a as src, owner_id || '__' || b as dst, "
        "'RELATED_TO' as rel_type, count(*) || ' chunks' as description from tg_named "
        "group by owner_id, a, b"
    ),
    "tg_linked": (
        "select q.owner_id, q.query_id, e.name_norm, row_number() over (partition by q.owner_id, "
        "q.query_id order by length(e.name_norm) desc, e.name_norm) as place from topics q "
        "join tg_entities e on q.owner_id = e.owner_id where contains(' ' || "
        + norm_name("q.question") + " || ' ', ' ' || e.name_norm || ' ')"
    ),
    "lines": (
        "select c_mktsegment as owner_id, o_custkey, o_orderkey, l_partkey, l_suppkey from lineitem "
        "join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"
    ),
    "g_chunks": (
        "select c_mktsegment as owner_id, 'C' || o_custkey as file_id, 'O' || o_orderkey as "
        "chunk_id, cast(row_number() over (partition by o_custkey order by o_orderdate, "
        "o_orderkey) - 1 as integer) as chunk_index from orders join customer "
        "on o_custkey = c_custkey"
    ),
    "g_documents": (
        "select c_mktsegment as owner_id, 'C' || c_custkey as file_id, c_name || '.pdf' as "
        "file_name, 'application/pdf' as mime_type, 'https://drive.google.com/file/d/C' || "
        "c_custkey || '/view' as link from customer"
    ),
    "p_mentions": (
        "select distinct owner_id, 'C' || o_custkey as file_id, 'O' || o_orderkey as chunk_id, "
        "owner_id || '__' || lower(p_name || ' ' || p_partkey) as entity_id from lines join part "
        "on l_partkey = p_partkey"
    ),
    "g_mentions": (
        "select * from p_mentions union all select distinct owner_id, 'C' || o_custkey, "
        "'O' || o_orderkey, owner_id || '__' || lower(replace(s_name, '#', '_')) from lines "
        "join supplier on l_suppkey = s_suppkey"
    ),
    "o_suppliers": (
        "select distinct owner_id, s_suppkey, replace(s_name, '#', '_') as sn, s_nationkey "
        "from lines join supplier on l_suppkey = s_suppkey"
    ),
    "o_nations": (
        "select owner_id, n_name, r_name from (select c_mktsegment as owner_id, c_nationkey as k "
        "from customer union select owner_id, s_nationkey from o_suppliers) join nation "
        "on k = n_nationkey join region on n_regionkey = r_regionkey"
    ),
    "g_entities": (
        "select owner_id, owner_id || '__' || lower(name) as entity_id, name, lower(name) as "
        "name_norm, type, description from ("
        "select distinct owner_id, p_name || ' ' || p_partkey as name, 'PRODUCT' as type, p_brand "
        "|| ' ' || p_type as description from lines join part on l_partkey = p_partkey "
        "union all select owner_id, sn, 'ORGANIZATION', 'supplier' from o_suppliers "
        "union all select c_mktsegment, replace(c_name, '#', '_'), 'PERSON', '' from customer "
        "union all select owner_id, n_name, 'LOCATION', 'nation' from o_nations "
        "union all select distinct owner_id, r_name, 'LOCATION', 'region' from o_nations)"
    ),
    "t_edges": (
        "select owner_id, owner_id || '__' || lower(a) as src, owner_id || '__' || lower(b) as dst, "
        "rel_type, description from ("
        "select c_mktsegment as owner_id, replace(c_name, '#', '_') as a, n_name as b, "
        "'LOCATED_IN' as rel_type, '' as description from customer join nation "
        "on c_nationkey = n_nationkey "
        "union all select owner_id, sn, n_name, 'LOCATED_IN', '' from o_suppliers join nation "
        "on s_nationkey = n_nationkey "
        "union all select owner_id, n_name, r_name, 'PART_OF', '' from o_nations "
        "union all select owner_id, p_name || ' ' || p_partkey, replace(s_name, '#', '_'), "
        "'CREATED_BY', p_brand from (select owner_id, l_partkey, min(l_suppkey) as maker "
        "from lines group by all) join part on l_partkey = p_partkey join supplier "
        "on maker = s_suppkey)"
    ),
    "c_edges": (
        "select a.owner_id, a.entity_id as src, b.entity_id as dst, 'COOCCURS_WITH' as rel_type, "
        "'' as description, count(*) as chunks from p_mentions a join p_mentions b "
        "on a.owner_id = b.owner_id and a.chunk_id = b.chunk_id and a.entity_id < b.entity_id "
        "group by 1, 2, 3"
    ),
    "g_edges": (
        "select * from t_edges union all select owner_id, src, dst, rel_type, description "
        "from c_edges"
    ),
    "both_ways": (
        "select owner_id, src as node, dst as other, rel_type, description, 0 as back from g_edges "
        "union all select owner_id, dst, src, rel_type, description, 1 from g_edges "
        "where src <> dst"
    ),
    "asked": (
        "select owner_id, 'S' || s_suppkey as query_id, 'What is the relationship between ' || "
        "replace(s_name, '#', '_') || ' and ' || p_name || ' ' || p_partkey || ' for ' || "
        "replace(c_name, '#', '_') || '?' as question from (select l_suppkey, owner_id, l_partkey, "
        "o_custkey, row_number() over (partition by l_suppkey order by owner_id, l_partkey, "
        "o_custkey) as rn from lines) join supplier on l_suppkey = s_suppkey join part "
        "on l_partkey = p_partkey join customer on o_custkey = c_custkey where rn = 1"
    ),
    "linked": (
        "select * from (select owner_id, query_id, name_norm, row_number() over (partition by "
        "owner_id, query_id order by length(name_norm) desc, name_norm) as place from ("
        "select distinct q.owner_id, q.query_id, e.name_norm from (select *, "
        + norm_name("question") + " as qn from asked) q join g_entities e "
        "on q.owner_id = e.owner_id where length(e.name_norm) >= 3 and (contains(' ' || qn || ' ', "
        "' ' || e.name_norm || ' ') or (e.type in ('PERSON', 'ORGANIZATION') and "
        "len(list_filter(string_split(qn, ' '), lambda t: length(t) >= 3 and t not in "
        "@LINKSTOP@ and contains(' ' || e.name_norm || ' ', ' ' || t || ' '))) > 0)))) "
        "where place <= 20"
    ),
    "members": (
        "select owner_id, owner_id || '__' || norm as node, lower(n_name) as comm from ("
        "select c_mktsegment as owner_id, lower(replace(c_name, '#', '_')) as norm, c_nationkey "
        "as k from customer union all select owner_id, lower(sn), s_nationkey from o_suppliers) "
        "join nation on k = n_nationkey"
    ),
    "trades": (
        "select distinct owner_id, owner_id || '__' || lower(replace(c_name, '#', '_')) as src, "
        "owner_id || '__' || lower(replace(s_name, '#', '_')) as dst, 'COLLABORATES_WITH' as "
        "rel_type, o_orderpriority as description from lines join orders using (o_orderkey) "
        "join supplier on l_suppkey = s_suppkey join customer on lines.o_custkey = c_custkey"
    ),
    "trade_graph": (
        "select owner_id, least(src, dst) as a, greatest(src, dst) as b, sum(2.5) as weight, "
        "min(rel_type) as rel_type, min(description) as description from trades group by 1, 2, 3"
    ),
    "nation_comms": (
        "select owner_id, comm, cast(count(*) as integer) as member_count, "
        "'Customers and suppliers of ' || comm as summary from members group by 1, 2"
    ),
}

NEEDS = {
    "units": "files", "packed": "units", "chunks": "packed", "offsets": "packed",
    "placed": "offsets", "kept": "placed", "vecs": "files", "topic_means": "vecs",
    "topics": "topic_means", "hits": "topics vecs", "scored": "hits", "reranked": "scored",
    "retrieved": "reranked", "retrieved10": "reranked", "tg_named": "vecs",
    "tg_mentions": "tg_named", "tg_entities": "tg_mentions", "tg_edges": "tg_named",
    "tg_linked": "topics tg_entities", "p_mentions": "lines", "g_mentions": "p_mentions lines",
    "o_suppliers": "lines", "o_nations": "o_suppliers", "g_entities": "lines o_suppliers o_nations",
    "t_edges": "lines o_suppliers o_nations", "c_edges": "p_mentions", "g_edges": "t_edges c_edges",
    "both_ways": "g_edges", "asked": "lines", "linked": "asked g_entities",
    "members": "o_suppliers", "trades": "lines", "trade_graph": "trades",
    "nation_comms": "members",
}

from corvane.functions import lexicon as _lx  # noqa: E402

BLOCKS["linked"] = BLOCKS["linked"].replace("@LINKSTOP@", in_list(_lx.ENTITY_LINK_STOPWORDS))
