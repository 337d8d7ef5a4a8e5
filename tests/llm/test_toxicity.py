"""The clause grammar, and held-out accuracy of the fitted score."""

import random
import time
import zlib

from corvane.llm import toxicity as tx

DATA = "/root/testdata/sf0.01"


def test_contexts_of_a_clause():
    insult = {"fool": 2.0}
    cases = {"he said the fool": "reported", "you are a fool": "targeted", "this is not a fool": "negated",
             "what a fool": "plain", 'the "fool" of': "reported", "not one of these may be a fool": "plain"}
    for clause, kind in cases.items():
        assert tx.contexts(clause, insult, []) == {
            k: 2.0 if k == kind else 0.0 for k in tx.CONTEXTS}, clause


def test_paths_match_beginnings_and_whole_words():
    grammar = tx.Grammar({"vek": 3.0, "fool$": 2.0})
    assert grammar.weight("vekarum") == 3.0 and grammar.weight("fool") == 2.0
    assert grammar.weight("fools") == grammar.weight("avek") == 0.0
    assert grammar.features("A vekarum. Avek, fools!")[5] > 0
    assert not grammar.features("Avek, fools!").any()
    assert tx.Grammar({}).features("I will kill you now")[5] > 0  # a threat needs no learned path
    assert not tx.Grammar({}).features(None).any()


def test_shorter_paths_stand_for_longer_ones():
    assert tx.shortest_paths({"vek": 4.0, "veka": 4.5, "vekar": 6.0, "foo$": 2.5}) == {
        "vek": 4.0, "vekar": 6.0, "foo$": 2.5}


def made(seed, n=600):
    """Clean and toxic rows over invented words; stems are not in any list of the code."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = [word() for _ in range(60)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["zuqx", "wywo"]) + word()
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_stems_catch_held_out_rows(spark):
    rows, labels = made(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    for r in tx.toxicity(docs, marks).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == truth[r["doc_id"]] == int(r["score"] >= tx.REJECT_FROM)
    kept = {r["doc_id"] for r in tx.drop_toxic(docs, marks).collect()}
    assert kept == {d for d, t in labels if not t}


def test_held_out_labels_are_not_used(spark):
    rows, labels = made(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [(d, t if zlib.crc32(str(d).encode()) % 3 != 1 else 1 - t) for d, t in labels]
    a, b = (tx.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, held))
    assert a.paths == b.paths and abs(a.scale - b.scale).max() < 1e-6


def test_given_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = tx.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if not r["toxic"]]
    bad = [r["score"] for r in rows if r["toxic"]]
    ranked = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert ranked > 0.9
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 1
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 0.8 * len(bad)


def test_edges(spark, documents, no_documents, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (4, 0, 0), (4, 0, 1), (99, 1, 1)],
                                "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = tx.toxicity(documents, labels).collect()
        assert len(got) == documents.count() and all(0 <= r["score"] <= 1 for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
        assert tx.toxicity(no_documents, labels).count() == 0
    assert tx.drop_toxic(clashing, none).columns == clashing.columns
    assert tx.drop_toxic(clashing, none).count() == documents.count()


def test_long_texts_take_time_in_proportion():
    own = tx.Grammar({"idiot": 1.0})

    def seconds(text):
        begin = time.process_time()
        found = own.features(text)
        return time.process_time() - begin, found

    for part in ('"idiot" ', "idiot i will kill you. "):
        (short, few), (long, many) = seconds(part * 5_000), seconds(part * 40_000)
        assert long < 40 * short + 0.5 and (many >= few - 1e-9).all()


def test_composed_machine_equals_all_paths_of_its_parts():
    """Every path through the four transducers, one after the other, on random clauses."""
    parts = [make() for make in tx.CHAIN]

    def every(symbols, at=0):
        if at == len(parts):
            yield symbols, [1.0] * len(symbols)
            return
        for out, factors in parts[at].paths(symbols):
            for last, rest in every(out, at + 1):
                yield last, [a * b for a, b in zip(factors, rest)]

    rng, machine, several = random.Random(11), tx.grammar_machine(), 0
    for _ in range(1000):
        symbols = [rng.choice([*tx.SYMBOLS, "insult", "harm", "person", "other"])
                   for _ in range(rng.randrange(9))]
        weights = [rng.randrange(1, 9) / 2 if s in ("insult", "harm", "fate") else 0.0 for s in symbols]
        paths = list(every(symbols))
        several += len(paths) > 1
        best = max(sum(w * f for w, f in zip(weights, factors)) for _, factors in paths)
        total, written = machine.heaviest(list(zip(symbols, weights)))
        assert abs(total - best) < 1e-9
        assert any(abs(sum(w * f for w, f in zip(weights, factors)) - best) < 1e-9
                   and written == [(o, w) for o, w in zip(out, weights) if w] for out, factors in paths)
    assert several > 100


def test_threats_and_contexts_end_with_their_reach():
    met = lambda clause: tx.clause_paths(clause, {"fool": 2.0}, {"zap": 3.0})[1]
    assert met("we will zap them") == met("te voy a zap") == [("targeted", 3.0)]
    assert met("zap yourself") == [("targeted", 3.0)]
    assert met("we will zap the paint") == met("zap them") == met("we will zap") == []
    assert met("he said that it was on one day that the fool came")[0][0] == "plain"
    assert met("fool , all of you") == [("targeted", 2.0)]
    assert met("fool and then it was all for you") == [("plain", 2.0)]


def test_words_of_harm_are_learned(spark):
    rows, labels = made(9)
    rows = [(d, t + (" i will then vorpal you" if toxic else " i will then vorp it and vorpal. you"))
            for (d, t), (_, toxic) in zip(rows, labels)]
    grammar = tx.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                     spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert grammar.weight("vorpal", harm=True) >= tx.LEAST_WEIGHT
    assert grammar.features("we will vorpal him")[1] > 0
    assert not grammar.features("vorpal. we will see")[:4].any()
