"""Classification, parameters, inventory, history and prompts."""

from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.operators import questions as qs
from workload import beds
from workload.registry import query
from workload.sqlparts import facts, in_list, norm_name, trim


def asked(spark, sf):
    """All turns as questions; every third kind of conversation asks in a known way."""
    c = beds.table(spark, sf, "conversations")
    lead = F.when(F.col("role") == "user", "What is the relationship between them? Who is ").when(
        F.col("role") == "system", "Tóm tắt chủ đề, so sanh, overview: ").otherwise("")
    return c.select("conv_id", "turn", F.concat(lead, "text").alias("question"))


ASKED = ("select conv_id, turn, case role when 'user' then 'What is the relationship between them? "
         "Who is ' when 'system' then 'Tóm tắt chủ đề, so sanh, overview: ' else '' end || text as "
         "question from conversations")


def _score(patterns):
    # Accented patterns cannot match text without accents and are left out here.
    import unicodedata
    plain = [p for p in patterns if unicodedata.normalize("NFD", p) == p and "đ" not in p]
    return " + ".join(f"regexp_matches(n, '{p}')::integer" for p in plain)


_CHANGED = sorted({k for a, d in lx.NAME_ALIASES for k in (a, a.replace(" ", ""))
                   if " " not in k and d.lower() != k})
HINTS = (f"list_sum(list_transform(list_filter(string_split(n, ' '), lambda w: length(w) >= 3 and "
         f"w not in {in_list(lx.QUESTION_STOPWORDS)}), lambda w: (length(w) >= 5)::integer + "
         f"(w in {in_list(_CHANGED)})::integer))")
SCORED = (f"select *, fs + (h >= 1)::integer as f from (select *, coalesce({HINTS}, 0)::integer as h, "
          f"{_score(lx.FACTUAL_PATTERNS)} as fs, {_score(lx.DESCRIPTIVE_PATTERNS)} as d from (select "
          f"*, {norm_name('question')} as n from ({ASKED})))")
TYPED = (f"select *, case when f >= 2 and d >= 2 then 'combined' when abs(f - d) <= 1 and f >= 1 and "
         f"d >= 1 then 'combined' when d >= 2 and f <= 1 then 'descriptive' when f > d then 'factual' "
         f"when d > f then 'descriptive' else 'combined' end as query_type from ({SCORED})")


@query("classify_questions", "select conv_id, turn, query_type, f as factual_score, d as "
       "descriptive_score, round(least(1.0, abs(f - d) / greatest(f + d, 1) + 0.3), 3)::double as "
       f"confidence from ({TYPED})")
def classify_questions(spark, sf):
    return qs.classify_questions(asked(spark, sf)).select(
        "conv_id", "turn", "query_type", "factual_score", "descriptive_score", "confidence")


@query("entity_hints", f"select conv_id, turn, h as hints from ({SCORED})")
def entity_hints(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", qs.entity_hints("question").alias("hints"))


@query("query_params", "select conv_id, turn, case query_type when 'factual' then 0.3 when "
       "'descriptive' then 0.85 else 0.6 end::double as alpha, case query_type when 'factual' then 3 "
       "when 'descriptive' then 7 else 5 end as n, case query_type when 'factual' then 5200 when "
       f"'descriptive' then 6000 else 5500 end as vector_budget from ({TYPED})")
def query_params(spark, sf):
    return qs.query_params(qs.classify_questions(asked(spark, sf))).select(
        "conv_id", "turn", "alpha", "n", "vector_budget")


@query("relationship_questions", f"select conv_id, turn, contains({norm_name('question')}, "
       f"'relationship between') as relationship from ({ASKED})")
def relationship_questions(spark, sf):
    return asked(spark, sf).select(
        "conv_id", "turn", qs.is_relationship_question("question").alias("relationship"))


@query("corpus_inventory", facts("files") + ", l as (select owner_id, file_id, file_name, case "
       "mime_type when 'application/pdf' then 'PDF' when 'image/png' then 'PNG' else 'Word' end as "
       "label from files) select owner_id, label, files, names, '• ' || label || ' (' || files || "
       "' file): ' || names || case when files > 4 then ' (+' || (files - 4) || ' file)' else '' end "
       "as line, cast(row_number() over (partition by owner_id order by files desc, label) as "
       "integer) as place from (select owner_id, label, max(n) as files, string_agg(file_name, ', ' "
       "order by rn) filter (rn <= 4) as names from (select *, count(*) over (partition by owner_id, "
       "label) as n, row_number() over (partition by owner_id, label order by file_name, file_id) as "
       "rn from l) group by 1, 2)")
def corpus_inventory(spark, sf):
    return qs.corpus_inventory(beds.files(spark, sf))


@query("document_list", facts("files") + "select owner_id, max(n) as total, string_agg(rn || '. ' || "
       "file_name || ' (' || cast(ceil(size_bytes / 512.0) as bigint) || ' chunks)', chr(10) order by "
       "rn) filter (rn <= 30) || case when max(n) > 30 then chr(10) || '... ' || (max(n) - 30) else '' "
       "end as text from (select *, count(*) over (partition by owner_id) as n, row_number() over "
       "(partition by owner_id order by file_name, file_id) as rn from files) group by owner_id")
def document_list(spark, sf):
    return qs.document_list(beds.files(spark, sf).withColumn(
        "chunk_count", F.ceil(F.col("size_bytes") / F.lit(512.0))))


@query("inventory_route", "select conv_id, turn, case role when 'system' then 'documents' when 'user' "
       "then 'topics' end as route from conversations")
def inventory_route(spark, sf):
    c = beds.table(spark, sf, "conversations")
    text = F.when(F.col("role") == "system", "What files do I have?").when(
        F.col("role") == "user", "Bạn có thể trả lời những chủ đề gì?").otherwise(F.col("text"))
    return c.select("conv_id", "turn", qs.inventory_route(text).alias("route"))


HISTORY = ("select conv_id, turn, case when role = 'user' then 'user' else 'model' end as role, text "
           "from (select *, row_number() over (partition by conv_id order by turn desc) as rn from "
           f"conversations where {trim('text')} <> '') where rn <= 6")


@query("recent_history", HISTORY)
def recent_history(spark, sf):
    return qs.recent_history(beds.table(spark, sf, "conversations"))


@query("user_questions", "select conv_id, count(*) filter (role = 'user') as user_questions, "
       "count(*) as turns from conversations group by 1")
def user_questions(spark, sf):
    return qs.user_questions(beds.table(spark, sf, "conversations"))


@query("prompt_rows", f"select conv_id, h || chr(10) || 'user: === TÀI LIỆU THAM KHẢO (CONTEXT) ===' "
       "|| chr(10) || c || chr(10) || '=== HẾT CONTEXT ===' || chr(10) || chr(10) || 'Câu hỏi: ' || q "
       "as prompt from (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as h "
       f"from ({HISTORY}) group by 1) join (select conv_id, arg_min(text, turn) as q, arg_max(text, "
       "turn) as c from conversations group by 1) using (conv_id)")
def prompt_rows(spark, sf):
    """First turn as question, last turn as context."""
    c = beds.table(spark, sf, "conversations")
    ask = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"),
                                   F.max_by("text", "turn").alias("context"))
    return qs.prompt_rows(qs.recent_history(c), ask)
