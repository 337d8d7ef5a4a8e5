"""Splitting, packing, positions, deduplication and the structural graph."""

from pyspark.sql import functions as F

from corvane.functions.text import normalize_name, upper_letters
from corvane.operators import chunking as ck
from corvane.operators import extraction as ex
from corvane.operators.canonical import alias_table
from corvane.plans.index import index_files, reindex_files
from workload import beds
from workload.registry import query
from workload.sqlparts import PARAGRAPHS, SENTENCES, facts, norm_name, tokens, trim


def chunks(spark, sf):
    return ck.chunk_documents(beds.texts(spark, sf))


def kept(spark, sf):
    return ck.chunk_documents(beds.texts(spark, sf), dedupe=True)


@query("split_paragraphs", facts("files") + "select file_id, i - 1 as pos, sha256(p[i]) as hash "
       f"from (select file_id, p, unnest(range(1, len(p) + 1)) as i from (select file_id, "
       f"{PARAGRAPHS} as p from files))")
def split_paragraphs(spark, sf):
    return beds.texts(spark, sf).select(
        "file_id", F.posexplode(ck.paragraphs("text")).alias("pos", "p")).select(
        "file_id", F.col("pos").cast("bigint").alias("pos"), F.sha2("p", 256).alias("hash"))


@query("split_sentences", facts("files") + "select file_id, i - 1 as pos, s[i] as sentence "
       "from (select file_id, s, unnest(range(1, len(s) + 1)) as i from (select file_id, "
       f"{SENTENCES.replace('(p,', '(text,')} as s from files))")
def split_sentences(spark, sf):
    return beds.texts(spark, sf).select(
        "file_id", F.posexplode(ck.sentences("text")).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos").cast("bigint"))


@query("chunk_text", facts("chunks") + "select file_id, chunk_index, total_chunks, text "
       "from chunks")
def chunk_text(spark, sf):
    t = beds.texts(spark, sf).select("file_id", ck.chunk_texts("text").alias("c"))
    return t.select("file_id", F.size("c").cast("bigint").alias("total_chunks"),
                    F.posexplode("c").alias("chunk_index", "text")).withColumn(
        "chunk_index", F.col("chunk_index").cast("bigint"))


def _longs(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


@query("chunk_offsets", facts("placed") + "select file_id, chunk_index, char_start, char_end "
       "from placed")
def chunk_offsets(spark, sf):
    return _longs(chunks(spark, sf).select("file_id", "chunk_index", "char_start", "char_end"),
                  "chunk_index", "char_start", "char_end")


@query("chunk_page", facts("placed") + "select file_id, chunk_index, page_estimate from placed")
def chunk_page(spark, sf):
    return _longs(chunks(spark, sf).select("file_id", "chunk_index", "page_estimate"),
                  "chunk_index", "page_estimate")


@query("chunk_lines", facts("placed") + "select file_id, chunk_index, line_start, line_end "
       "from placed")
def chunk_lines(spark, sf):
    return _longs(chunks(spark, sf).select("file_id", "chunk_index", "line_start", "line_end"),
                  "chunk_index", "line_start", "line_end")


@query("chunk_documents", facts("placed") + "select owner_id, file_id, file_id || '__chunk_' || "
       "chunk_index as chunk_id, chunk_index, total_chunks, text, page_estimate, char_start, "
       f"char_end, line_start, line_end, sha256({trim('text')}) as content_hash from placed")
def chunk_documents(spark, sf):
    return _longs(chunks(spark, sf).drop("file_name"), "chunk_index", "total_chunks",
                  "page_estimate", "char_start", "char_end", "line_start", "line_end")


@query("dedupe_chunks", facts("kept") + "select owner_id, chunk_id, chunk_index from kept")
def dedupe_chunks(spark, sf):
    return _longs(ck.dedupe_chunks(chunks(spark, sf)).select("owner_id", "chunk_id", "chunk_index"),
                  "chunk_index")


@query("dedupe_while_chunking", facts("kept") + "select owner_id, chunk_id, chunk_index from kept")
def dedupe_while_chunking(spark, sf):
    return _longs(kept(spark, sf).select("owner_id", "chunk_id", "chunk_index"), "chunk_index")


@query("structural_edges", facts("kept") + "select owner_id, file_id as src, chunk_id as dst, "
       "'CONTAINS' as rel_type from kept union all select * from (select owner_id, chunk_id, "
       "lead(chunk_id) over (partition by owner_id, file_id order by chunk_index) as dst, 'NEXT' "
       "from kept) where dst is not null")
def structural_edges(spark, sf):
    return ck.structural_edges(kept(spark, sf))


@query("chunk_nodes", facts("kept") + "select owner_id, file_id, chunk_id, chunk_index, "
       "page_estimate, substr(text, 1, 150) as preview from kept")
def chunk_nodes(spark, sf):
    return _longs(ck.chunk_nodes(kept(spark, sf)), "chunk_index", "page_estimate")


@query("eligible_chunks", facts("kept") + "select owner_id, chunk_id from kept "
       f"where length({trim('text')}) >= 50")
def eligible_chunks(spark, sf):
    return ck.eligible_chunks(kept(spark, sf)).select("owner_id", "chunk_id")


BATCHES = (
    "select owner_id, file_id, batch_no, count(*) as n_chunks, case when count(*) = 1 then "
    "max(substr(text, 1, 2000)) else string_agg('[CHUNK_' || chunk_index || ']' || chr(10) || "
    "substr(text, 1, 1200), chr(10) || chr(10) order by chunk_index) end as text from (select *, "
    "cast((row_number() over (partition by owner_id, file_id order by chunk_index) - 1) // 8 as "
    f"integer) as batch_no from kept where length({trim('text')}) >= 50) group by 1, 2, 3"
)


@query("model_batches", facts("kept") + f"select owner_id, file_id, batch_no, n_chunks, "
       f"sha256(text) as hash from ({BATCHES})")
def model_batches(spark, sf):
    return ck.model_batches(kept(spark, sf)).select(
        "owner_id", "file_id", "batch_no", "n_chunks", F.sha2("text", 256).alias("hash"))


@query("model_hook", facts("kept") + "select owner_id, file_id, batch_no, length(text) as n_chars, "
       f"upper(substr(text, 1, 5)) as head from ({BATCHES})")
def model_hook(spark, sf):
    """A stand-in model that reports the length and the beginning of each batch text."""
    def stub(texts):
        return [f"{len(t)}:{upper_letters(t[:5])}" for t in texts]

    out = ex.with_model(ck.model_batches(kept(spark, sf)), stub, "text", "answer", "string")
    return out.select("owner_id", "file_id", "batch_no",
                      F.split_part("answer", F.lit(":"), F.lit(1)).cast("bigint").alias("n_chars"),
                      F.regexp_replace("answer", "^[0-9]+:", "").alias("head"))


@query("extract_mentions", facts("kept") + "select distinct owner_id, file_id, chunk_id, raw_name, "
       "raw_type from (select owner_id, file_id, chunk_id, unnest(regexp_extract_all(' ' || "
       "text, '[^\\p{L}\\p{N}_](\\p{Lu}[\\p{L}\\p{N}_]+(?: \\p{Lu}[\\p{L}\\p{N}_]+)+)', 1)) as "
       "raw_name, 'OTHER' as raw_type from kept union all select owner_id, file_id, chunk_id, "
       "lang, 'CONCEPT' from (select owner_id, file_id, chunk_id, unnest(string_split("
       + norm_name("text") + ", ' ')) as w from kept) join (values ('the', 'THE'), "
       "('les', 'Les'), ('der', 'Der')) g(n, lang) on n = w)")
def extract_mentions(spark, sf):
    """Capitalised phrases, and three articles as a tiny gazetteer."""
    names = F.array(*[F.struct(F.lit(n).alias("name_norm"), F.lit(d).alias("name"))
                      for n, d in (("the", "THE"), ("les", "Les"), ("der", "Der"))])
    gazetteer = spark.range(1, numPartitions=1).select(F.inline(names)).withColumn(
        "type", F.lit("CONCEPT"))
    return ex.extract_mentions(kept(spark, sf), gazetteer).select(
        "owner_id", "file_id", "chunk_id", "raw_name", "raw_type")


PASSAGE_WORDS = "list_filter(string_split(" + norm_name("text") + ", ' '), lambda w: w <> '')"


@query("gazetteer_matches", facts("kept") + f", b as (select {PASSAGE_WORDS} as w from benchmark), "
       "g as (select distinct array_to_string(w[1:n], ' ') as name_norm from b, range(1, 13) t(n) "
       f"where len(w) >= n), k as (select owner_id, file_id, chunk_id, ' ' || array_to_string("
       f"{PASSAGE_WORDS}, ' ') || ' ' as spaced from kept) select owner_id, file_id, chunk_id, "
       "name_norm from k join g on contains(spaced, ' ' || name_norm || ' ')")
def gazetteer_matches(spark, sf):
    """The first one to twelve words of every benchmark passage as names."""
    return ex.gazetteer_matches(kept(spark, sf), passage_names(spark, sf))


@query("rebuild_index", facts("kept") + f", b as (select {PASSAGE_WORDS} as w from benchmark), g as ("
       "select distinct array_to_string(w[1:6], ' ') as name_norm from b where len(w) >= 6), k as (select "
       f"owner_id, file_id, chunk_id, ' ' || array_to_string({PASSAGE_WORDS}, ' ') || ' ' as spaced from kept "
       f"where length({trim('text')}) >= 50), p as (select owner_id, file_id, chunk_id, unnest(regexp_extract_all("
       "' ' || text, '[^\\p{L}\\p{N}_](\\p{Lu}[\\p{L}\\p{N}_]+(?: \\p{Lu}[\\p{L}\\p{N}_]+)+)', 1)) as n "
       f"from kept where length({trim('text')}) >= 50) select owner_id, file_id, chunk_id, owner_id || '__' || "
       "name_norm as entity_id from k join g on contains(spaced, ' ' || name_norm || ' ') union select owner_id, "
       f"file_id, chunk_id, owner_id || '__' || {norm_name('n')} from p")
def rebuild_index(spark, sf):
    """Index all documents, a fifth of them by their second half only, then index these again whole:
    the mentions are those of indexing everything at once. The names are beginnings of passages, and
    phrases of capitalised words.
    """
    docs = beds.files(spark, sf).select("owner_id", "file_id", "file_name", "text")
    names = passage_names(spark, sf).where("size(split(name_norm, ' ')) = 6").select(
        "name_norm", F.col("name_norm").alias("name"), F.lit("CONCEPT").alias("type"))
    changed = F.pmod(F.xxhash64("file_id"), F.lit(5)) == 0
    half = F.expr("substring(text, 1 + length(text) div 2)")
    before = docs.withColumn("text", F.when(changed, half).otherwise(F.col("text")))
    aliases = alias_table(spark)
    tables = index_files(before, aliases, names, fuzzy=False)
    after = reindex_files(tables, docs.filter(changed), aliases, gazetteer=names, fuzzy=False)
    return after.entity_mentions().select("owner_id", "file_id", "chunk_id", "entity_id")


def passage_names(spark, sf):
    words = F.filter(F.split(normalize_name("text"), " "), lambda w: w != "")
    return beds.table(spark, sf, "benchmark").select(words.alias("w")).select(
        "w", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n")).where("size(w) >= n").select(
        F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("name_norm"))


@query("comention_relations", facts("kept") + ", told as (select owner_id, file_id, chunk_id, "
       "unnest(range(len(p))) as sentence_no, unnest(p) as sentence from (select owner_id, file_id, "
       "chunk_id, string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), "
       "chr(10), chr(1)), chr(1)) as p from kept)), named as (select distinct owner_id, file_id, "
       "chunk_id, unnest(regexp_extract_all(text, '\\p{L}{10,}')) as n from kept), here as (select *, instr(sentence, n) as "
       "at, length(sentence) - length(n) + 2 - instr(reverse(sentence), reverse(n)) as last from told "
       "join named using (owner_id, file_id, chunk_id) where instr(sentence, n) > 0) select owner_id, "
       "file_id, chunk_id, (row_number() over (partition by owner_id, file_id, chunk_id order by "
       "sentence_no, a.at, a.n, b.n) - 1)::integer as rel_ord, a.n as from_raw, b.n as to_raw from here "
       "a join here b using (owner_id, file_id, chunk_id, sentence_no) where a.n <> b.n and (a.at < "
       "b.last or (a.at = b.last and a.n < b.n))")
def comention_relations(spark, sf):
    """All pairs of long words of one sentence; the given texts hold no phrases of capitalised words."""
    chunks = kept(spark, sf)
    words = F.regexp_extract_all("text", F.lit(r"\p{L}{10,}"), F.lit(0))
    named = chunks.select("owner_id", "file_id", "chunk_id", F.explode(words).alias("raw_name"))
    return ex.comention_relations(chunks, named).select(
        "owner_id", "file_id", "chunk_id", "rel_ord", "from_raw", "to_raw")


@query("hash_embeddings", facts("files") + ", w as (select file_id, cast(('0x' || substr(md5(t), 1, "
       "8)) as bigint) % 64 as slot, count(*) as n from (select file_id, unnest("
       + tokens("text") + ") as t from files) group by 1, 2), s as (select file_id, "
       "sqrt(sum(n * n)) as norm from w group by 1) select file_id, slot, round(n / norm, 6) as x "
       "from w join s using (file_id)")
def hash_embeddings(spark, sf):
    e = ex.hash_embeddings(beds.texts(spark, sf), ["file_id"])
    return e.select("file_id", F.posexplode("embedding").alias("slot", "x")).filter("x > 0").select(
        "file_id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("x"))
