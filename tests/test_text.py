from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.retrieval import with_keyword_score


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, tx.normalize_name("n"), n="LÊ ĐÌNH KHÔI") == "le dinh khoi"
    assert one(spark, tx.normalize_name("n"), n="Bà Rịa-Vũng Tàu") == "ba ria vung tau"
    assert one(spark, tx.normalize_name("n"), n="Đà Nẵng") == "da nang"
    assert one(spark, tx.normalize_name("n"), n="ﬁne Ａ½") == "fine a1 2"


def test_titles(spark):
    for given, kept in [("Ông/Bà: LÊ ĐÌNH KHÔI", "LÊ ĐÌNH KHÔI"),
                        ("Ông KIẾN ĐỨC THỊNH", "KIẾN ĐỨC THỊNH"),
                        ("Bà Nguyễn Thị A", "Nguyễn Thị A"), ("Conrad Lee", "Conrad Lee")]:
        assert one(spark, tx.strip_title("n"), n=given) == kept


def test_relations(spark):
    for raw, kind in [("works for", "WORKS_FOR"), ("employed_by", "WORKS_FOR"),
                      ("thuc_tap_tai", "WORKS_FOR"), ("làm việc tại", "WORKS_FOR"),
                      ("GIAM_DOC", "DIRECTOR_OF"), ("giám đốc", "DIRECTOR_OF"),
                      ("quản lý", "MANAGES"), ("hợp tác", "COLLABORATES_WITH"),
                      ("liên quan", "RELATED_TO"), ("frobnicates", "FROBNICATES"),
                      ("", "RELATED_TO"), ("!!!", "RELATED_TO")]:
        assert one(spark, tx.relation_type("r"), r=raw) == kind
    assert one(spark, tx.relation_key("r"), r="gây ra") == "GAY_RA"
    assert one(spark, tx.relation_key("r"), r="đứng đầu") == "DUNG_DAU"
    assert one(spark, tx.relation_key("r"), r="123 rel").startswith("REL_")
    assert len(one(spark, tx.relation_key("r"), r="A" * 200)) <= 60


def test_labels(spark):
    for raw, label in [("Company", "ORGANIZATION"), ("corporation", "ORGANIZATION"),
                       ("PERSON", "PERSON"), ("river", "OTHER"), ("", "OTHER")]:
        assert one(spark, tx.entity_label("r"), r=raw) == label


def test_refusal_and_overlap(spark):
    assert one(spark, tx.is_refusal("a"),
               a="Tôi không tìm thấy thông tin này trong tài liệu của bạn.")
    assert not one(spark, tx.is_refusal("a"), a="Hai hệ thống được kết hợp với nhau.")
    assert one(spark, tx.keyword_overlap("a", "k"), a="Hệ thống dùng Alpha và Beta cho tìm kiếm.",
               k=["Alpha", "Beta", "không có"]) == 0.6667
    assert one(spark, tx.keyword_overlap("a", F.array(F.lit(" "))), a="x") is None


def test_keyword_score_keeps_dstroke(spark):
    df = spark.createDataFrame([("báo cáo đồ án", "Nội dung không liên quan.", "Bao_cao_do_an.pdf")],
                               ["question", "text", "file_name"])
    assert round(with_keyword_score(df).first()["keyword_score"], 4) == 0.1875


def test_upper_letters_agree_with_sql():
    """For every code point of the first two planes."""
    import duckdb

    from corvane.functions.text import upper_letters

    assert upper_letters("straße") == "STRAẞE"
    letters = [chr(c) for c in range(1, 0x20000) if not 0xd800 <= c < 0xe000]
    told = dict(duckdb.connect().execute(
        "select c, upper(c) from (select unnest(?) as c)", [letters]).fetchall())
    differ = [c for c in letters if upper_letters(c) != told[c]]
    assert not differ


def test_plain_names_keep_their_form(spark):
    """Names in identity form take the short way; any other letter, blank or line end takes the long one."""
    from corvane.functions.text import normalize_name
    names = ["abc", "a1 b2", "a  b", " a", "abc\n", "a\nb", "Abc", "a-b", "a_b", "é", "đa", "", "²", "ab ", "a b"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    got = {r["n"]: r["m"] for r in df.select("n", normalize_name("n").alias("m")).collect()}
    assert got == {"abc": "abc", "a1 b2": "a1 b2", "a  b": "a b", " a": "a", "abc\n": "abc", "a\nb": "a b", "Abc": "abc",
                   "a-b": "a b", "a_b": "a_b", "é": "e", "đa": "da", "": "", "²": "2", "ab ": "ab", "a b": "a b",
                   None: None}


def test_large_tables_are_spread_by_size(spark, tmp_path, monkeypatch):
    """A table of one file was read by a fixed number of tasks, whatever its size."""
    from workload import beds
    spark.range(5000).selectExpr("id", "sha2(string(id), 256) as text").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(beds, "SPREAD_BYTES", 10_000)
    parts = beds.spread(df, "id").rdd.getNumPartitions()
    assert parts >= 20 and beds.spread(df, "id").count() == 5000
