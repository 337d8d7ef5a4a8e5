"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols with weights by a prefix automaton over letters: insults and words of harm are
word beginnings whose weight (log odds of toxic against clean documents) is learned from labelled
rows, harm from the words that stand between an intent and a person; a few verbs of harm are given.
Four transducers read the symbols of a clause:

- threat: an intent, a word of harm and a person, or a demand, become a match; insults are matches;
- negation: a negator within ``REACH`` words before a match;
- reported speech: a verb of saying within ``TOLD_REACH`` words before, or quotation marks around it;
- target: a person within ``AIM`` words before a match, or guessed to come within as many after it.

They are composed to one machine once. Its heaviest path through a clause gives each match one
context: plain, targeted, negated or reported. The matches' weights by context, and the heaviest
clause, are the inputs of a logistic scale, which is fitted on the same bounded sample of rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import sliced
from corvane.llm.transducers import Transducer, build, compose

#: Labelled rows that the model is fitted on at most (about; chosen by a hash of doc_id).
FIT_ROWS = 20_000
#: A word beginning is a path if it occurs in this share of the toxic rows, and in this many.
LEAST_SHARE, LEAST_ROWS = 0.003, 5
#: Log odds from which a word beginning is a path.
LEAST_WEIGHT = 2.0
#: Letters of the beginnings that are counted; a whole word ends in "$".
BEGINNINGS = range(3, 8)
REACH, TOLD_REACH, AIM = 3, 6, 4
REJECT_FROM = 0.7

TARGETS = frozenset("you your yours u ya he she they him her them tu te toi vous votre ton ta "
                    "du dich dir ihr euch dein deine usted ustedes vosotros vos os los ti tus".split())
SELVES = frozenset("yourself yourselves".split())
NEGATORS = frozenset("not no never isn't aren't wasn't don't doesn't nobody without pas jamais aucun "
                     "sans nicht kein keine keinen nie niemals ohne nunca jamás sin ningún".split())
SAYERS = frozenset("said says say told wrote writes claimed claims quoted quote called reported "
                   "dit disait écrit prétend appelé sagte sagt schrieb behauptet nannte zitiert "
                   "dijo dice escribió afirma llamó citó".split())
INTENTS = frozenset("i we i'll we'll gonna going will shall vais va ich wir voy vamos".split())
HARMS = frozenset("kill hurt beat shoot stab destroy burn strangle tuer frapper détruire cogner bringe "
                  "mache schlage töte matar golpear destruir pegar".split())
URGES, FATES = frozenset("go drop".split()), frozenset("die dead".split())
THREAT_WEIGHT = 6.0
#: What a match counts for the weight of its clause.
CONTEXTS = ("plain", "targeted", "negated", "reported")
FACTORS = {"plain": 0.7, "targeted": 1.0, "negated": 0.3, "reported": 0.4}
#: Symbols of words, in the order in which they are tried, after insults and learned words of harm.
LISTS = {"harm": HARMS, "negator": NEGATORS, "sayer": SAYERS, "self": SELVES, "person": TARGETS,
         "intent": INTENTS, "urge": URGES, "fate": FATES}
SYMBOLS = ("insult", *LISTS, "quote", "other")
GAP = 2

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»]")
_ENDS = re.compile(r"[.!?;:\n]")
_LISTED = {w: name for name in reversed(LISTS) for w in LISTS[name]}


def threat() -> Transducer:
    """Insults and threats become "match".

    States: (met, words since an intent, person met since), named (a person is the last word), wait (a
    word of harm was read on the guess that a person follows), self (that "yourself" does), urged, idle.
    """
    plain = {"intent": "other", "self": "person", "harm": "other", "urge": "other", "fate": "other",
             "insult": "match"}

    def step(state, symbol):
        kind, out = state[0], plain.get(symbol, symbol)
        if symbol == "quote":
            yield state, out, 1.0
        elif kind in ("wait", "self"):
            if symbol == "self" or (kind == "wait" and symbol == "person"):
                yield ("named",), "person", 1.0
            elif kind == "wait" and state[1]:
                yield ("wait", state[1] - 1), out, float(symbol not in ("harm", "fate"))
        else:
            if symbol == "harm":
                if kind == "met":
                    yield (("idle",) if state[2] else ("wait", 1)), "match", 1.0
                yield ("self",), "match", 1.0
            if symbol == "fate" and kind == "urged":
                yield ("idle",), "match", 1.0
            person = symbol in ("person", "self")
            if symbol == "intent":
                to = ("met", 0, kind == "named" or (kind == "met" and state[2]))
            elif kind == "met" and state[1] < GAP:
                to = ("met", state[1] + 1, state[2] or person)
            else:
                to = ("named",) if person else ("urged",) if symbol == "urge" else ("idle",)
            yield to, out, float(symbol not in ("harm", "fate"))

    return build(("idle",), SYMBOLS, lambda s: s[0] not in ("wait", "self"), step)


def negation() -> Transducer:
    """A match within REACH words after a negator becomes "negated". State: words since one."""
    def step(since, symbol):
        after = since if symbol == "quote" else min(since + 1, REACH + 1)
        if symbol == "negator":
            yield 0, "other", 1.0
        elif symbol == "match" and after <= REACH:
            yield after, "negated", FACTORS["negated"]
        else:
            yield after, symbol, 1.0

    return build(REACH + 1, ("match", "person", "negator", "sayer", "quote", "other"),
                 lambda _: True, step)


def reported() -> Transducer:
    """A match after a sayer or in quotation marks becomes "reported". State: words left, in marks."""
    def step(state, symbol):
        left, marks = state
        rest = max(0, left - 1)
        if symbol == "quote":
            yield (left, not marks), "quote", 1.0
        elif symbol == "sayer":
            yield (TOLD_REACH, marks), "other", 1.0
        elif symbol in ("match", "negated") and (left or marks):
            yield (rest, marks), "reported", (
                FACTORS["reported"] / (FACTORS["negated"] if symbol == "negated" else 1.0))
        else:
            yield (rest, marks), symbol, 1.0

    return build((0, False), ("match", "negated", "person", "sayer", "quote", "other"),
                 lambda _: True, step)


def target() -> Transducer:
    """Other matches become "targeted" or "plain". State: words since a person, words until one must come."""
    def step(state, symbol):
        since, wait = state
        if symbol == "quote":
            yield state, symbol, 1.0
            return
        after = min(since + 1, AIM + 1)
        if symbol == "person":
            yield (0, 0), symbol, 1.0
        elif wait != 1:
            rest = max(0, wait - 1)
            if symbol != "match":
                yield (after, rest), symbol, 1.0
            elif after <= AIM or wait:
                yield (after, rest), "targeted", FACTORS["targeted"]
            else:
                yield (after, AIM), "targeted", FACTORS["targeted"]
                yield (after, 0), "plain", FACTORS["plain"]

    return build((AIM + 1, 0), ("match", "negated", "reported", "person", "quote", "other"),
                 lambda s: not s[1], step)


CHAIN = (threat, negation, reported, target)


@cache
def grammar_machine() -> Transducer:
    """The transducers of ``CHAIN`` as one; made once a process."""
    made = CHAIN[0]()
    for after in CHAIN[1:]:
        made = compose(made, after())
    return made


def beginnings(text: str) -> set[str]:
    """Word beginnings of a text in lower case, and its whole words with a mark.

    Those of words that stand where the threat transducer has a word of harm come again after "!".
    """
    listed = WORD.findall(text)
    words = set(listed)
    harm = set()
    for i, word in enumerate(listed):
        if word in INTENTS:
            for j in range(i + 1, min(i + 2 + GAP, len(listed))):
                if listed[j] not in _LISTED and not TARGETS.isdisjoint(
                        listed[max(0, i - 1):i] + listed[i + 1:j + 3]):
                    harm.add(listed[j])
    return ({w[:k] for w in words for k in BEGINNINGS if len(w) >= k} | {w + "$" for w in words}
            | {"!" + w[:k] for w in harm for k in BEGINNINGS if len(w) >= k}
            | {f"!{w}$" for w in harm})


def symbol_of(word: str, insult: Mapping[str, float], harm: Mapping[str, float]) -> tuple[str, float]:
    """Symbol and weight of a word or quotation mark."""
    if word in insult:
        return "insult", insult[word]
    if word in harm:
        return "harm", harm[word]
    symbol = _LISTED.get(word)
    if symbol:
        return symbol, THREAT_WEIGHT if symbol in ("harm", "fate") else 0.0
    return ("other" if word[0].isalpha() else "quote"), 0.0


def clause_paths(clause: str, insult: Mapping[str, float], harm: Mapping[str, float] | list
                 ) -> tuple[float, list[tuple[str, float]]]:
    """Weight of a clause, and its matches as (context, weight), by the composed machine.

    ``insult`` and ``harm`` give words of the clause their weight.
    """
    weight, written = grammar_machine().heaviest(
        symbol_of(m[0], insult, harm) for m in _TOKEN.finditer(clause))
    return weight, [(out, w) for out, w in written if out in CONTEXTS]


def contexts(clause: str, insult: Mapping[str, float], harm: Mapping[str, float] | list
             ) -> dict[str, float]:
    """Weight of a clause's matches by context."""
    out = dict.fromkeys(CONTEXTS, 0.0)
    for context, weight in clause_paths(clause, insult, harm)[1]:
        out[context] += weight
    return out


@dataclass
class Grammar:
    """Learned paths of insults and of words of harm, and the scale of the score."""

    paths: dict[str, float]
    scale: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    harm: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._scanner = None

    def __getstate__(self):
        return {"paths": self.paths, "scale": self.scale, "harm": self.harm}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._scanner = None

    def scanner(self):
        """Automaton over letters that finds all paths in one pass over a text."""
        if self._scanner is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for path in (*self.paths, *self.harm, *HARMS, *FATES):
                made.add_word(path.rstrip("$"), len(path.rstrip("$")))
            made.make_automaton()
            self._scanner = made
        return self._scanner

    def weight(self, word: str, harm: bool = False) -> float:
        """Weight of the heaviest path that accepts a word."""
        paths = self.harm if harm else self.paths
        return max((paths[p] for p in [*(word[:k] for k in BEGINNINGS), word + "$"] if p in paths),
                   default=0.0)

    def features(self, text: str | None) -> np.ndarray:
        """Inputs of the scale for one whole text: log of the weight by context, the heaviest
        clause, the number of matches, and matches among all words."""
        out = np.zeros(N_FEATURES)
        low = (text or "").lower()
        insult: dict[str, float] = {}
        harm: dict[str, float] = {}
        places: list[int] = []
        starts: dict[int, None] = {}
        for end, size in self.scanner().iter(low):
            at = end - size + 1
            joined = low[at - 1:at] == "'" and low[at - 2:at - 1].isalpha()
            if not (at and (low[at - 1].isalpha() or joined)):
                starts[at] = None
        for at in starts:
            found = WORD.match(low, at)
            word = found[0] if found else ""
            weight, threat_weight = self.weight(word), self.weight(word, harm=True)
            if weight:
                insult[word] = weight
            elif threat_weight and word not in _LISTED:
                harm[word] = threat_weight
            elif word not in HARMS and word not in FATES:
                continue
            places.append(at)
        if not places:
            return out
        matches, total, best, end = 0, dict.fromkeys(CONTEXTS, 0.0), 0.0, -1
        ends = [m.start() for m in _ENDS.finditer(low)]
        for at in sorted(places):
            if at < end:
                continue
            behind = bisect_left(ends, at)
            begin = ends[behind - 1] + 1 if behind else 0
            end = ends[behind] if behind < len(ends) else len(low)
            weight, found = clause_paths(low[begin:end], insult, harm)
            for context, w in found:
                total[context] += w
            matches += len(found)
            best = max(best, weight)
        if not matches:
            return out
        out[:4] = np.log1p([total[k] for k in CONTEXTS])
        out[4] = np.log1p(best)
        out[5] = np.log1p(matches)
        out[6] = np.log1p(100 * matches / (1 + low.count(" ")))
        return out

    def score(self, features: np.ndarray) -> float:
        z = float(features @ self.scale[:-1] + self.scale[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


N_FEATURES = 7


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last number is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + keep @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """text and toxic of at most about ``most`` labelled rows, chosen by a hash of doc_id.

    Rows whose crc32 of doc_id as text leaves 1 when divided by 3 are held out. A doc_id with
    several labels is toxic if one of them is.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    n = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    # at most about ``most`` rows of two numbers, so small enough to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Grammar:
    """Learn the paths, then the scale, from the sample.

    Word beginnings are counted in tasks and added up by Spark. The paths that reach the driver
    each occur in LEAST_SHARE of the toxic rows, so their number is bounded by the beginnings of
    a mean document divided by that share. Without toxic rows there are no paths.
    """
    sample = labelled_sample(docs, labels, most).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(),
                                   batch.column("toxic").to_pylist()):
                found[int(toxic > 0)].update(beginnings((text or "").lower()))
                found[int(toxic > 0)][""] += 1  # rows
            if sum(map(len, found.values())) > 300_000:
                yield emit(found)
                found = {0: Counter(), 1: Counter()}
        yield emit(found)

    def emit(found: dict[int, Counter]) -> pa.RecordBatch:
        rows = [(w, t, n) for t, c in found.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64())], ["path", "toxic", "n"])

    counts = sample.mapInArrow(count, "path string, toxic int, n long").groupBy("path").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    sizes = sample.groupBy("toxic").count().collect()
    bad_rows = sum(r["count"] for r in sizes if r["toxic"])
    good_rows = sum(r["count"] for r in sizes if not r["toxic"])
    least = max(LEAST_ROWS, LEAST_SHARE * bad_rows)
    odds = F.log((F.col("bad") + 0.5) / (bad_rows + 1)) - F.log((F.col("good") + 0.5) / (good_rows + 1))
    rows = counts.where((F.col("path") != "") & (F.col("bad") >= least)).withColumn(
        "odds", odds).where(F.col("odds") >= LEAST_WEIGHT).collect()
    odds_of = {r["path"]: r["odds"] for r in rows}
    grammar = Grammar(shortest_paths({p: w for p, w in odds_of.items() if p[0] != "!"}), harm=shortest_paths(
        {p[1:]: w for p, w in odds_of.items() if p[0] == "!"}))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())),
                                              batch.column("toxic")], ["x", "toxic"])

    measured = sample.mapInArrow(measure, "x array<double>, toxic int").collect()
    if measured:
        grammar.scale = fit_scale(np.array([r["x"] for r in measured]),
                                  np.array([r["toxic"] > 0 for r in measured], float))
    return grammar


def shortest_paths(odds: dict[str, float], slack: float = 0.7) -> dict[str, float]:
    """Paths without those that a shorter path replaces with about the same weight."""
    kept: dict[str, float] = {}
    for path in sorted(odds, key=lambda p: (len(p.rstrip("$")), p)):
        heads = [path[:k] for k in BEGINNINGS if k < len(path) and path[:k] in kept]
        if all(odds[path] > kept[h] + slack for h in heads):
            kept[path] = odds[path]
    return kept


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Only the text is an input of the score. Null and empty texts get the score of a text without
    matches. Rows with null doc_id are kept (held_out null); rows may repeat; an empty table
    gives no rows; other columns are not read. No shuffle.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            scores = [grammar.score(grammar.features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= REJECT_FROM) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                       "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of them."""
    return score_documents(docs, fit(docs, labels, most))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` whose score stays below ``REJECT_FROM``; columns as they were."""
    grammar = fit(docs, labels, most)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            clean = [grammar.score(grammar.features(t)) < REJECT_FROM
                     for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.select(*names).mapInArrow(keep, docs.schema)
