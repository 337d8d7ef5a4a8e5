"""The stages of the pipeline, one after the other, against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import mixing, near_dedup, packing, secrets, toxicity
from corvane.llm.encoders import PieceEncoder, vocabulary
from tests.llm.test_mixing import draw
from tests.llm.test_near_dedup import brute
from tests.llm.test_secrets import base, linked, masked
from tests.llm.test_tokens import check_packing
from tests.llm.test_toxicity import made

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(folder, spark):
    rng = random.Random(2)
    rows, labels = made(7, 240)
    docs = []
    for i, text in rows:
        if i % 5 == 1:
            text = rows[i - 1][1].replace(".", " more.") if i % 10 == 1 else rows[i - 1][1]
        if i % 7 == 2:
            text += f" token = {rng.randrange(1 << 60):020x} end"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    toxic = dict(labels)
    labels = [(d, toxic[d - 1] if d % 5 == 1 else t) for d, t in labels]  # copies have their text's
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{folder}/labels.parquet")
    return docs, dict(labels)


def test_stages(spark, tmp_path):
    docs, toxic = corpus(str(tmp_path), spark)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    frame, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(frame)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == names
    rows = [sorted(map(tuple, s.collect()), key=str) for s in steps]

    want = [d for d in docs if not toxic.get(d[0])]
    assert rows[0] == sorted(want, key=str)
    kept = {r[0] for r in brute([(d[0], d[1]) for d in want], near_dedup.SHINGLE) if r[3]}
    want = [d for d in want if d[0] in kept]
    assert rows[1] == sorted(want, key=str)
    hidden = []
    for d in want:
        text = d[1] and masked(d[1], base(d[1]) + linked(d[1], secrets.SCOPE))
        hidden.append((d[0], text, d[2], d[3], d[4] if text == d[1] else len(text)))
    assert rows[2] == sorted(hidden, key=str) and hidden != want
    sizes = Counter(d[3] for d in hidden)
    whole = sum(n ** 0.5 for n in sizes.values())
    copies = [d for d in hidden for _ in range(draw(d[0], len(hidden) * sizes[d[3]] ** 0.5 / whole / sizes[d[3]]))]
    assert rows[3] == sorted(copies, key=str)
    check_packing(steps[4].collect(), steps[3], packing.CAPACITY)


def test_run_is_the_stages(spark, tmp_path):
    corpus(str(tmp_path), spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.where(F.col("offset") + F.col("length") > packing.CAPACITY).count() == 0


def test_stages_on_empty_documents(spark, tmp_path, no_documents):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, str(tmp_path)).count() == 0, name
    assert mixing.SEED and toxicity.FIT_ROWS and PieceEncoder(vocabulary(packing.VOCABULARY)).kind == "drop"
