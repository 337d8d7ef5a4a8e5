"""Encoding, length histogram, packing and token files against encoding each whole text."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import packing, token_counts, token_files
from corvane.llm.encoders import PieceEncoder, slices, vocabulary

ODD = ["", " ", "  a  b", "a <|endoftext|> b", "x\n\ny z \n", "\tfoo bar", "foo\t bar", "it's we'll'd 12 3a",
       "²½ é ́x", None, "a\x1cb \x1c c\x85d   x", "foo \nbar", ". , .,", "a. b,", " a", "İstanbul ΣΑΣ Σ",
       "word" * 500, "中文 字 test", "a b c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    enc = PieceEncoder(vocabulary(name), memo=50)
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab ,.é\n'1S\t") for _ in range(rng.randrange(60))) for _ in range(300)]
    for texts in (ODD, mixed, mixed[::-1]):
        want = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in texts],
                                                          add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(texts)] == want


def test_slices_cover_everything():
    assert list(slices([5, 9, 1, 1, 30, 2], 10)) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)]
    assert list(slices([])) == []


def whole_ids(name, texts):
    tokenizer = PieceEncoder(vocabulary(name)).tokenizer
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_histogram_answers_every_limit(documents, no_documents, clashing):
    texts = [r["text"] for r in documents.collect()]
    lengths = [len(i) for i in whole_ids(token_counts.VOCABULARY, texts)]
    h = token_counts.length_histogram(token_counts.token_lengths(documents))
    rows = {r["length"]: r for r in h.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert r["docs_over"] == sum(n > k for n in lengths)
        assert r["tokens_over"] == sum(n for n in lengths if n > k)
        assert r["docs_upto"] == sum(n <= k for n in lengths)
        assert r["tokens_upto"] == sum(n for n in lengths if n <= k)
        assert r["truncated_tokens"] == sum(min(n, k) for n in lengths)
    for limit in (0, 1, 7, 100, 10 ** 6):
        kept = token_counts.kept_tokens(h, limit).first()
        assert kept["kept_tokens"] == sum(min(n, limit) for n in lengths)
        assert kept["docs_cut"] == sum(n > limit for n in lengths)
    assert token_counts.quantile(h, 0.5).first()["length"] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.length_histogram(token_counts.token_lengths(no_documents)).count() == 0
    assert token_counts.token_lengths(clashing, keep=("doc_id", "a")).columns == [
        "doc_id", "a", "n_tokens"]


def naive_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_runs_make_the_packing_of_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / (capacity / 3)))) for _ in range(400)]
    used = {}
    for length, begin, end, each, first, offset in packing.best_fit_runs(Counter(lengths), capacity):
        for r in range(end - begin):
            at = offset + r % each * length
            used.setdefault(first + r // each, []).append((at, at + length))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(capacity - s[-1][1] for s in used.values()) == naive_best_fit(lengths, capacity)


def check_packing(rows, docs, capacity):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for (doc, _), ids in zip(texts, whole_ids(packing.VOCABULARY, [t for _, t in texts])):
        ids = np.array([*ids, packing.END_ID], "<u4")
        want += [(doc, k, b, len(ids[b:b + capacity]), zlib.crc32(ids[b:b + capacity].tobytes()))
                 for k, b in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(filled) == len(naive_best_fit([w[3] for w in want], capacity))


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing(documents, no_documents, capacity, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    check_packing(packing.pack(documents, capacity=capacity).collect(), documents, capacity)
    assert packing.pack(no_documents).count() == 0


def test_sequences_hold_the_ids(clashing):
    packed = packing.pack(clashing, capacity=500, with_ids=True)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert rows[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (7, 300), (5000, 70_000), (300_000, 1 << 25)):
        ids = (rng.zipf(1.3, n) % top).astype(np.uint32) if n else np.empty(0, np.uint32)
        if n:
            ids[0] = top - 1
        ranked, control, data = token_files.encode_block(ids)
        assert (token_files.decode_block(ranked, control, data, n) == ids).all()
        assert len(control) == -(-n // 4)


@pytest.mark.parametrize("block_ids", [40, 2_000_000])
def test_token_files(documents, no_documents, spark, tmp_path, block_ids):
    path = str(tmp_path / "t")
    token_files.write_tokens(documents, path, block_ids=block_ids)
    got = token_files.read_tokens(spark, path, with_ids=True).collect()
    rows = sorted(documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0,
                                                      r["text"] or ""))
    begin, want = 0, []
    for r, ids in zip(rows, whole_ids(token_files.VOCABULARY, [r["text"] for r in rows])):
        ids = [*ids, token_files.END_ID]
        want.append((r["doc_id"], begin, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        begin += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_files(no_documents).count() == 0


def test_clashing_columns(clashing):
    assert token_files.token_files(clashing).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert packing.pack(clashing).filter(F.col("offset") < 0).count() == 0
