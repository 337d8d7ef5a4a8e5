"""Alignment of both vocabularies against encoding each whole text, and the perfect hash."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import pair_counts as pc
from corvane.llm.encoders import vocabulary

DOCS = "doc_id long, text string, lang string"
PATHS = vocabulary(pc.VOCABULARY_A), vocabulary(pc.VOCABULARY_B)
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def expected(texts):
    """Rows by whole texts and two pointers."""
    a_model, b_model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    own, found, counts = pc.Aligner(*PATHS, True), [], Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        a = a_model.encode(data.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        parts = [own.bytes_a[x] for x in a], [own.bytes_b[x] for x in b]
        if not text or any(b"".join(p) != data for p in parts):
            found.append(None)
            continue
        links, groups, i, j, left, right, held = [], [], 0, 0, len(parts[0][0]), len(parts[1][0]), ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            for side, place, ids in ((0, i, a), (1, j, b)):
                if not held[side] or held[side][-1][0] != place:
                    held[side].append((place, str(ids[place])))
            step_a, step_b = left <= right, right <= left
            if step_a and step_b:
                groups.append("|".join(",".join(x for _, x in h) for h in held))
                held = ([], [])
            if step_a:
                i += 1
                left += len(parts[0][i]) if i < len(a) else 0
            if step_b:
                j += 1
                right += len(parts[1][j]) if j < len(b) else 0
        found.append((a, b, groups, links))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[k] == best[k[0]] for k in f[3]),
        sum(counts[k] for k in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


def texts():
    draw = random.Random(8)
    letters = ["a", "the", " ", "  ", "\n", "\t", " ", "é", "ß", "漢字", "🙂", "▁", "<s>", "<|endoftext|>",
               ".", ",", "'s", "12", "\x00", "\x1c", "\r\n", "Zürich", "　", "é"]
    odd = ["".join(draw.choices(letters, k=draw.randrange(1, 14))) for _ in range(250)]
    plain = [" ".join(draw.choices(["one", "two.", "three,", "four\nfive", "Straße", "naïve"], k=8)) for _ in range(30)]
    return [*odd, *plain, None, "", " ", "\n", "x", " x", "x ", "one two", "one two", "word" * 30_000, "a  b", "▁"]


@pytest.mark.parametrize("table_bytes", [pc.TABLE_BYTES, 1])
def test_rows_match_whole_texts(spark, table_bytes):
    rows = texts()
    if table_bytes == 1:
        rows = rows[::12]
    docs = spark.createDataFrame([(None if k == 7 else k % 300, t, "x") for k, t in enumerate(rows)], DOCS)
    docs = docs.selectExpr("*", "1 as n_a", "'x' as groups_sha256")
    got = pc.token_alignment(docs.repartition(3), table_bytes=table_bytes)
    want = Counter((None if k == 7 else k % 300, *row) for k, row in enumerate(expected(rows)))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == want


def test_empty_table_and_texts(spark):
    assert pc.token_alignment(spark.createDataFrame([], DOCS)).count() == 0
    r = pc.token_alignment(spark.createDataFrame([(1, None, "")], DOCS)).first()
    assert tuple(r[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "")


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n).astype(np.uint64))
    found = pc.PerfectHash.of(keys)
    assert sorted(found.find(keys).tolist()) == list(range(len(keys)))
    assert n < 1000 or len(found.words) * 64 < 5 * len(keys)


def test_lookup_verifies_keys():
    keys = np.arange(10, 4000, 7, dtype=np.uint64)
    own = pc.PerfectHash.of(keys)
    ordered = np.empty_like(keys)
    ordered[own.find(keys)] = keys
    table = pc.Counts(np.array(own.sizes, "<i8").tobytes(), own.words.tobytes(), ordered.tobytes(),
                      (ordered * np.uint64(3)).astype("<i8").tobytes())
    every = np.arange(5000, dtype=np.uint64)
    assert (table.lookup(every) == np.where(np.isin(every, keys), every.astype(np.int64) * 3, 0)).all()
