"""Phrase fingerprints: edited texts, order of documents, and local consistency."""

import hashlib
import random

import numpy as np

from corvane.llm import phrase_prints as pp


def words(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(4)
    text = words(rng, 2000)
    a, b, c = pp.fingerprints([text, "xyz " + text[1500:], words(rng, 2000)])
    assert pp.likeness(a, b) > 0.6
    assert pp.likeness(a, c) < 0.05
    names = [set(pp.phrase_names([t])[1].tolist()) for t in (text, "?" + text)]
    assert len(names[0] & names[1]) > 0.95 * len(names[0])


def test_batches_do_not_matter():
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(1, 300)) for _ in range(80)] + ["", "a", "aa", "a" * 5000, "abab" * 900]
    together = pp.fingerprints(texts)
    for text, print_ in zip(texts, together):
        alone = pp.fingerprints([text])[0]
        assert (alone == print_).all() and (np.diff(print_.astype(np.int64)) > 0).all()
        assert len(print_) <= pp.KEPT and (len(print_) > 0) == bool(text)


def test_likeness_bounds():
    a = np.array([1, 2, 3], np.uint32)
    none = np.empty(0, np.uint32)
    assert pp.likeness(a, a) == 1 and pp.likeness(none, none) == 1 and pp.likeness(a, none) == 0
    assert pp.likeness(a, np.array([2, 3, 4], np.uint32)) == 0.5


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        p, e, f = (pp.fingerprints([t])[0] for t in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), pp.written(p),
                    pp.written(e), pp.likeness(p, e), pp.likeness(p, f)))
    return sorted(out, key=str)


def test_neighbours(spark, documents, clashing):
    rng = random.Random(6)
    rows = [(7 * i, words(rng, rng.randrange(1, 60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, pp.edit_likeness(docs).collect()), key=str) == expected(rows)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for frame in (documents, clashing):
        assert sorted(map(tuple, pp.edit_likeness(frame).collect()), key=str) == expected(rows)


def test_few_rows(spark, no_documents):
    assert pp.edit_likeness(no_documents).count() == 0
    for rows in ([(1, "alone text")], [(1, None), (2, "a b c d e f")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, pp.edit_likeness(docs).collect()), key=str) == expected(rows)


def test_an_edit_is_nearer_than_another_text():
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(8, 400)) for _ in range(200)]
    follow = texts[1:] + texts[:1]
    edited = [pp.edited_text(a, b) for a, b in zip(texts, follow)]
    p, e = pp.fingerprints(texts), pp.fingerprints(edited)
    near = [pp.likeness(a, b) for a, b in zip(p, e)]
    other = [pp.likeness(a, b) for a, b in zip(p, p[1:] + p[:1])]
    assert sum(n > o for n, o in zip(near, other)) >= 198
    assert np.median(near) > 0.3 and np.median(other) < 0.02


def test_lengths_of_long_runs_count():
    lengths = [1, 2, 1021, 1022, 1023, 1024, 1500, 50_000]
    prints = pp.fingerprints([f"head {'-' * n} tail" for n in lengths] + [f"head {' ' * n}tail" for n in lengths])
    assert len({pp.written(p) for p in prints}) == 2 * len(lengths)
    again = pp.fingerprints([f"head {'-' * 50_000} tail", "other"])[0]
    assert (again == prints[7]).all()


def scalar_names(text):
    """The names of the phrases of one text, parsed symbol by symbol with Python integers."""
    full, (a, b) = (1 << 64) - 1, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
    places = [int(p) for p in pp.PLACES]

    def mix(x):
        x = (x ^ (x >> 30)) * a & full
        x = (x ^ (x >> 27)) * b & full
        return x ^ (x >> 31)

    def runs(symbols):
        out = []
        for symbol, span in symbols:
            if out and out[-1][0] == symbol:
                out[-1] = (symbol, out[-1][1] + 1, out[-1][2] + span)
            else:
                out.append((symbol, 1, span))
        return out

    def with_length(symbol, times, level):
        if times == 1:
            return symbol
        if level > 1:
            return mix((symbol * a + times) & full)
        if times > 1023:
            return mix(symbol << 40 | times) >> 33 | 1 << 31
        return symbol | times << 21

    least, names, level = min(8, len(text) // 8), [], 0
    symbols = [(ord(c), 1) for c in text]
    while True:
        level += 1
        symbols = [(with_length(s, n, level), span) for s, n, span in runs(symbols)]
        if len(symbols) == 1:
            return sorted([*names, mix((symbols[0][0] + 977) & full)])
        labels, top = [s for s, _ in symbols], (1 << 32 if level == 1 else 1 << 64) - 1
        for _ in range(4):
            fresh = []
            for k, label in enumerate(labels):
                differ = label ^ (labels[k - 1] if k else ~label & top)
                low = (differ & -differ).bit_length() - 1
                fresh.append(low * 2 + (label >> low & 1))
            labels, top = fresh, 255
        phrases = []
        for k, symbol in enumerate(symbols):
            peak = 0 < k < len(symbols) - 1 and labels[k - 1] < labels[k] > labels[k + 1]
            if not k or peak:
                phrases.append([])
            phrases[-1].append(symbol)
        symbols = [(mix((sum(s * places[k % 64] for k, (s, _) in enumerate(p)) + level) & full),
                    sum(span for _, span in p)) for p in phrases]
        names += [name for name, span in symbols if span >= least]


def test_scalar_parsing_gives_the_same_phrases():
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    texts += ["".join(rng.choice("ab😀é\n ") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    texts += ["a", "ab", "aa", "a" * 1023, "a" * 1024, "head " + "-" * 1500 + " tail", "abab" * 300,
              ("x" * 70 + "y") * 40, "\ud800 lone", words(rng, 3000)]
    docs, names = pp.phrase_names(texts)
    mix = pp.mixed(names) >> np.uint64(32)
    prints = pp.fingerprints(texts)
    for k, text in enumerate(texts):
        assert sorted(names[docs == k].tolist()) == scalar_names(text), text[:40]
        assert prints[k].tolist() == sorted(set(mix[docs == k].tolist()))[:pp.KEPT]
