"""Token ids of whole texts with the ``tokenizers`` library, as flat numpy arrays.

Both vocabularies split a text at white space before they merge, so the ids of a text are those
of its space-separated pieces, put together. Pieces repeat far more often than texts, so each
process keeps the ids of pieces it has met. The memo is a cache of two generations: when the
younger is full, the older is dropped, which costs time and never changes a result. ``tests/llm/test_tokens.py`` holds the ids against
encoding each whole text.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Pieces in each of the two generations that a process remembers, about 0.2 KB each.
MEMO_PIECES = 400_000
#: Characters encoded at once; the pieces of a slice fit the caches of a processor.
SLICE_CHARS = 500_000


class PieceEncoder:
    """Ids of texts by one vocabulary file, without special tokens added.

    ``kind`` is how the vocabulary treats the space between two pieces: ``attach`` (it belongs to
    the piece behind it), ``drop`` (it is no token), or ``whole`` (unknown: no piece memo).
    """

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = memo
        self.kind = self._kind()
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.marks = {c: self._whole([c])[0] for c in (*".,", *("\n" if self.kind == "attach" else ""))}

    def _kind(self) -> str:
        import json

        spec = json.loads(self.tokenizer.to_str())
        split, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if (split.get("type") == "ByteLevel" and split.get("use_regex") and norm is None
                and not split.get("add_prefix_space")):
            return "attach"
        parts, steps = split.get("pretokenizers", []), (norm or {}).get("normalizers", [])
        if (parts and parts[0].get("type") == "Split" and parts[0].get("invert")
                and parts[0].get("behavior") == "Removed"
                and [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]):
            return "drop"
        return "whole"

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _recall(self, pieces: set[str]) -> dict[str, bytes | None]:
        """Ids of the pieces of a slice, from the memo or learned now."""
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {}
        young, old, found, fresh = self.young, self.old, {}, []
        for piece in pieces:
            if piece in young:
                found[piece] = young[piece]
            elif piece in old:
                found[piece] = young[piece] = old[piece]
            else:
                fresh.append(piece)
        learned = self._learn(fresh)
        young.update(learned)
        found.update(learned)
        return found

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes | None]:
        """Ids of pieces behind a space. Plain words go to the merges straight away.

        A piece that begins with a line break stands behind that instead of a space.
        """
        merge, marks, attach = self.tokenizer.model.tokenize, self.marks, self.kind == "attach"
        known, rest, code = {}, [], self.code
        for piece in pieces:
            broken = attach and piece[:1] == "\n"
            own = piece[1:] if broken else piece
            word = own[:-1] if own[-1:] in (".", ",") else own
            if word.isalpha() and (attach or max(word) < "İ"):
                text = word if attach else word.lower()
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
                if attach and not broken:
                    text = "Ġ" + text
                ids = array(code, [t.id for t in merge(text)]).tobytes()
                known[piece] = ((marks["\n"] if broken else b"") + ids
                                + (b"" if word is own else marks[own[-1]]))
            elif attach and (not own or own[0].isspace() or own[-1].isspace()):
                known[piece] = None  # its neighbours share the white space
            else:
                rest.append(piece)
        known.update(zip(rest, self._whole(
            [p if not attach or p[0] == "\n" else " " + p for p in rest])))
        return known

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids for each text; null counts as empty."""
        texts = [t or "" for t in texts]
        if self.kind == "whole":
            return [np.frombuffer(b, dtype=self.dtype) for b in self._whole(texts)]
        attach = self.kind == "attach"
        split = [t.replace("\n", " \n" if attach else " ").split(" ") for t in texts]
        heads = self._whole([s.pop(0) for s in split]) if attach else None
        get, out, left = self._recall(set().union(*split)).__getitem__, [], []
        for k, pieces in enumerate(split):
            try:
                if attach and pieces and shared_space(texts[k]):
                    raise TypeError("the first piece shares white space with the next")
                ids = b"".join(map(get, pieces))
                out.append(heads[k] + ids if attach else ids)
            except TypeError:  # a piece that can't stand alone: encode the text as one
                out.append(b"")
                left.append(k)
        if left:
            for k, ids in zip(left, self._whole([texts[k] for k in left])):
                out[k] = ids
        return [np.frombuffer(b, dtype=self.dtype) for b in out]


def shared_space(text: str) -> bool:
    """Whether the first piece of a text ends in white space, so that it shares it."""
    cuts = [c for c in (text.find(" "), text.find("\n")) if c >= 0]
    return bool(cuts) and min(cuts) > 0 and text[min(cuts) - 1].isspace()


#: The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves,
#: the others, in order, for 256 and on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Numbers(dict):
    """Numbers of pieces in the order they are met."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        number = self[piece] = len(self)
        return number


class NumberedEncoder(PieceEncoder):
    """As above, with one lookup per piece: pieces are numbered, and their ids found by number.

    The memo starts anew when it is full. Gives the ids of a text as bytes of ``dtype``.
    """

    def __init__(self, path: str, memo: int = 2 * MEMO_PIECES):
        super().__init__(path, memo)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.parts = Numbers(), []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if self.kind == "whole":
            return self._whole(texts)
        if len(self.numbers) > self.memo:
            self.forget()
        attach, number = self.kind == "attach", self.numbers.__getitem__
        split = [t.replace("\n", " \n" if attach else " ").split(" ") for t in texts]
        out = self._whole([s.pop(0) for s in split]) if attach else [b""] * len(texts)
        numbers = [list(map(number, s)) for s in split]
        if self.numbers.fresh:
            learned = self._learn(self.numbers.fresh)
            self.parts += map(learned.__getitem__, self.numbers.fresh)
            self.numbers.fresh = []
        left, part = [], self.parts.__getitem__
        for k, own in enumerate(numbers):
            try:
                if attach and own and shared_space(texts[k]):
                    raise TypeError("the first piece shares white space with the next")
                out[k] += b"".join(map(part, own))
            except TypeError:  # a piece that can't stand alone: encode the text as one
                left.append(k)
        for k, ids in zip(left, self._whole([texts[k] for k in left]) if left else ()):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def numbered_encoder(path: str) -> NumberedEncoder:
    """The numbered encoder of this process."""
    return NumberedEncoder(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The encoder of this process; tasks of one worker share its memo."""
    return PieceEncoder(path)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most ``most`` in sum, or of one."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
