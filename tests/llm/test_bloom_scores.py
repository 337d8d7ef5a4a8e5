"""Scores against exact counts, and a filter in many segments."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bloom_scores as bs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered) + [None]


def sample():
    words = [f"w{k}" for k in range(40)] + ["Äpfel", "äpfel", "x y", "a\x1cb", "Q", "q"]
    rows = []
    for i in range(90):
        draw = np.random.default_rng(i % 60)  # the last third repeats the first
        rows.append((i, " ".join(words[k] for k in draw.zipf(1.4, draw.integers(1, 60)) % len(words))))
    rows += [(200, None), (201, ""), (202, " \t\n "), (None, "w1 w2"), (3, "w1 w2"), (3, "w1 w2"),
             (203, "longword" * 20_000 + " w1"), (204, "W1\x0bw2\x0cw3\rw4")]
    return [(i, t, "en", "s", 0) for i, t in rows]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot_words, segment_bytes", [(bs.HOT_WORDS, bs.SEGMENT_BYTES), (1, 1)])
def test_scores(spark, monkeypatch, order, hot_words, segment_bytes):
    if segment_bytes == 1:
        monkeypatch.setattr(bs, "PART_NGRAMS", 500)  # several parts, so several segments
    rows = sample()
    docs = spark.createDataFrame(rows, DOCS)
    got = bs.score_documents(docs, held_out(), order, hot_words, segment_bytes).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    counts = Counter(t for (_, text, *_), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), h, len(t), sum(counts[w] > 0 for w in t), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6))
                  for (i, text, *_), h in zip(rows, held) for t in [tokens(text)])
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-6 for r in got)
    if order > 1:  # copies of training texts are likelier than by single words
        trained = [r for r in got if not r["held_out"] and r["n_tokens"] > 20]
        assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)


def test_segments_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(sample(), DOCS)
    monkeypatch.setattr(bs, "PART_NGRAMS", 500)
    one, many = ([(str(r["doc_id"]), round(r["score"], 9)) for r in
                  bs.score_documents(docs, held_out(), 3, segment_bytes=b).collect()] for b in (1 << 20, 1))
    assert sorted(one) == sorted(many)


def test_model_is_the_stated_interpolation():
    levels = np.array([[3, 2], [2, 0]], dtype=np.uint8)
    novel = np.full((2, len(bs.FLOORS) + 1), 0.25)
    e = bs.EXPECTED
    p = [(e[3] + 1) / 111, (e[2] + 1) / 111]
    want = [0.25 * p[0] + 0.75 * e[2] / e[4], 0.25 * p[1]]
    assert abs(bs.log_probabilities(levels, novel, 4, 100, 10) - sum(map(math.log10, want))) < 1e-12


def test_filter_never_lowers_a_level():
    draw = np.random.default_rng(2)
    keys = np.unique(draw.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = draw.zipf(1.5, len(keys)).clip(1, 10**12)
    words, events = bs.filter_part(keys, counts)
    segment = bs.Segment(1, 0, np.array([len(words)]), words)
    true = np.searchsorted(bs.FLOORS, counts, side="right")
    found = segment.levels(keys).astype(int)
    assert (found >= true).all() and (found == true).mean() > 0.9
    others = draw.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (segment.levels(others) > 0).mean() < 0.05
    assert events == true.sum()


def test_empty_tables_and_no_training_texts(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bs.score_documents(empty, held_out()).count() == 0
    alone = spark.createDataFrame([(1, "a b", "", "", 0)], DOCS).selectExpr("*", "1 as n_tokens", "2 as row")
    r = bs.score_documents(alone, F.lit(True)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
