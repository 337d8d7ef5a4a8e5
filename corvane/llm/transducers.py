"""Weighted finite-state transducers over small sets of symbols: composition and heaviest paths.

A transducer reads symbols and writes one symbol for each. An arc has a factor, and a tape gives
each symbol a weight; a path weighs the sum of tape weight times factor. Several arcs may leave a
state by one symbol, so a path may guess what comes later; only paths that end in a final state count.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass

Arc = tuple[int, str, float]


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol]`` lists (next state, output, factor); the first state is 0."""

    arcs: list[dict[str, list[Arc]]]
    final: frozenset[int]

    def heaviest(self, tape: Iterable[tuple[str, float]]) -> tuple[float, list[tuple[str, float]]]:
        """Weight of the heaviest path, and its outputs with the tape's weight where that is not 0.

        Keeps one path for each state, so the work grows with the tape. Of equals the path found first
        stays; without a path to a final state the weight is 0 and nothing is written.
        """
        live: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for symbol, weight in tape:
            after: dict[int, tuple[float, tuple]] = {}
            for state, (total, trail) in live.items():
                for to, out, factor in self.arcs[state].get(symbol, ()):
                    reached = total + weight * factor
                    if to not in after or reached > after[to][0]:
                        after[to] = reached, (trail, out, weight) if weight else trail
            live = after
        ends = [path for state, path in live.items() if state in self.final]
        if not ends:
            return 0.0, []
        total, trail = max(ends, key=lambda path: path[0])
        written = []
        while trail:
            trail, out, weight = trail
            written.append((out, weight))
        return total, written[::-1]

    def paths(self, symbols: list[str]) -> Iterator[tuple[list[str], list[float]]]:
        """Outputs and factors of every path that ends in a final state."""
        def walk(state: int, place: int, out: list[str], factors: list[float]):
            if place == len(symbols):
                if state in self.final:
                    yield out, factors
                return
            for to, symbol, factor in self.arcs[state].get(symbols[place], ()):
                yield from walk(to, place + 1, [*out, symbol], [*factors, factor])

        return walk(0, 0, [], [])


def build(start: Hashable, symbols: Iterable[str], final: Callable[[Hashable], bool],
          step: Callable[[Hashable, str], Iterable[tuple[Hashable, str, float]]]) -> Transducer:
    """Transducer of the states that ``step`` reaches from ``start``, without dead ends."""
    symbols = list(symbols)
    place, found, arcs = {start: 0}, [start], []
    for state in found:  # grows while it is read
        row = []
        for symbol in symbols:
            for to, out, factor in step(state, symbol):
                if to not in place:
                    place[to] = len(found)
                    found.append(to)
                row.append((symbol, place[to], out, factor))
        arcs.append(row)
    back: list[list[int]] = [[] for _ in found]
    for i, row in enumerate(arcs):
        for _, to, _, _ in row:
            back[to].append(i)
    alive = {i for i, s in enumerate(found) if final(s)}
    waiting = list(alive)
    while waiting:
        for i in back[waiting.pop()]:
            if i not in alive:
                alive.add(i)
                waiting.append(i)
    table: list[dict[str, list[Arc]]] = [{} for _ in found]
    for i, row in enumerate(arcs):
        for symbol, to, out, factor in row:
            if to in alive:
                table[i].setdefault(symbol, []).append((to, out, factor))
    return Transducer(table, frozenset(i for i, s in enumerate(found) if final(s)))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that does what ``second`` does with the output of ``first``."""
    def step(state: tuple[int, int], symbol: str):
        for to, between, factor in first.arcs[state[0]].get(symbol, ()):
            for after, out, other in second.arcs[state[1]].get(between, ()):
                yield (to, after), out, factor * other

    symbols = sorted({s for row in first.arcs for s in row})
    return build((0, 0), symbols, lambda s: s[0] in first.final and s[1] in second.final, step)
