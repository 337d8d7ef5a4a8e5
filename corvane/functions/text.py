"""Text columns: accents, normal forms, tokens, hashes, snippets and answer checks.

Everything here is ``Column -> Column`` on built-in functions, so it runs inside the
JVM next to scans and joins. Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII unless a
pattern carries ``(?U)``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx

BLANK = r"[\s\x1c-\x1f]"
BLANK_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=None)
def _letter_table(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters whose decomposition differs: one-to-one pairs for ``translate`` and the rest.

    Hangul syllables are left out: they decompose by a rule.
    """
    source, target, longer = [], [], []
    for code in range(0xA0, 0x30000):
        if 0xD800 <= code < 0xE000 or HANGUL[0] <= code <= HANGUL[1]:
            continue
        letter = chr(code)
        plain = "".join(
            x for x in unicodedata.normalize(form, letter) if unicodedata.category(x) != "Mn"
        )
        if plain == letter or not plain:
            continue
        if len(plain) == 1:
            source.append(letter)
            target.append(plain)
        else:
            longer.append((letter, plain))
    return "".join(source), "".join(target), tuple(longer)


#: First and last Hangul syllable, and the first letters of the three parts of one.
HANGUL = (0xAC00, 0xD7A3)
HANGUL_PARTS = ((0x1100, 19), (0x1161, 21), (0x11A7, 28))


def _hangul(letter: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    at = F.ascii(letter) - HANGUL[0]
    parts = [F.array(*[F.lit(chr(first + i) if first + i != 0x11A7 else "") for i in range(n)])
             for first, n in HANGUL_PARTS]
    return F.concat(F.element_at(parts[0], (at / 588).cast("int") + 1),
                    F.element_at(parts[1], (F.pmod(at, F.lit(588)) / 28).cast("int") + 1),
                    F.element_at(parts[2], F.pmod(at, F.lit(28)).cast("int") + 1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    A column that is named several times in a filter or inside a lambda is otherwise
    expanded, and evaluated, at each place.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip_accents(c: Column | str) -> Column:
    """Drop combining marks; ``đ`` has no decomposition and stays."""
    source, target, _ = _letter_table("NFD")
    return F.regexp_replace(F.translate(_col(c), source, target), r"\p{Mn}+", "")


def fold_compat(c: Column | str) -> Column:
    """Compatibility folding without combining marks (full-width forms, ligatures, superscripts).

    One-to-one letters are translated. Texts with a letter that becomes several are also
    looked up letter by letter; they are rare, so the lookup table is a literal.
    """
    source, target, longer = _letter_table("NFKD")
    out = F.translate(_col(c), source, target)
    table = F.create_map(*[F.lit(x) for pair in longer for x in pair])
    syllable = f"[{chr(HANGUL[0])}-{chr(HANGUL[1])}]"
    # a cheap class that holds all letters in question: the rare ones of Latin, and what lies
    # beyond it but for dashes and quotes
    rare = "[" + "".join(letter for letter, _ in longer if ord(letter) < 0x250) + (
        r"\x{250}-\x{200f}\x{2024}-\x{d7ff}\x{e000}-\x{10ffff}]")

    def expand(letter: Column) -> Column:
        return F.when(~letter.rlike(rare), letter).when(letter.rlike(syllable), _hangul(letter)
                                                        ).otherwise(
            F.coalesce(F.try_element_at(table, letter), letter))

    def spell(text: Column) -> Column:
        letters = F.transform(F.sequence(F.lit(1), F.length(text)),
                              lambda i: expand(F.substring(text, i, F.lit(1))))
        return F.when(text.rlike(rare), F.array_join(letters, "")).otherwise(text)

    return F.regexp_replace(let(out, spell), r"\p{Mn}+", "")


def trim_blank(c: Column | str) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.trim(_col(c), F.lit(BLANK_CHARS))


def squeeze(c: Column | str) -> Column:
    """Trim and turn each run of white space into one blank."""
    return trim_blank(F.regexp_replace(_col(c), rf"(?U){BLANK}+", " "))


def normalize_text(c: Column | str) -> Column:
    """Keyword form: lower case, no accents, separators and punctuation as blanks."""
    plain = strip_accents(F.lower(F.coalesce(_col(c), F.lit(""))))
    spaced = F.regexp_replace(plain, r"[_.\-]+", " ")
    return F.regexp_replace(spaced, r"(?U)[^\w\s]", " ")


def split_words(normalized: Column, min_length: int = 1) -> Column:
    """Words of an already normalised text."""
    words = F.split(trim_blank(normalized), rf"(?U){BLANK}+")
    return F.filter(words, lambda w: F.length(w) >= min_length)


def tokenize(c: Column | str, min_length: int = 2) -> Column:
    return split_words(normalize_text(c), min_length)


def normalize_name(c: Column | str) -> Column:
    """Identity form of a name: lower, folded, ``đ`` as ``d``, punctuation as blanks, squeezed.

    Most words have that form already, and only the others are worked on.
    """
    def shaped(name: Column) -> Column:
        folded = F.replace(fold_compat(F.lower(trim_blank(name))), F.lit("đ"), F.lit("d"))
        norm = squeeze(F.regexp_replace(folded, r"(?U)[^\w\s]", " "))
        return F.when(name.rlike(r"\A[a-z0-9]+( [a-z0-9]+)*\z"), name).otherwise(norm)

    return let(_col(c), shaped)


def normalize_answer(c: Column | str) -> Column:
    """Answer form: lower, folded, white space squeezed; punctuation and ``đ`` stay."""
    return squeeze(fold_compat(F.lower(F.coalesce(_col(c), F.lit("")))))


def plain_key(c: Column | str) -> Column:
    """UPPER_SNAKE key over ASCII letters and digits."""
    upper = F.upper(trim_blank(F.coalesce(_col(c), F.lit(""))))
    key = F.regexp_replace(F.regexp_replace(upper, "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(key, "^_+|_+$", "")


def relation_key(c: Column | str) -> Column:
    """Clean relation key; empty input gives the generic relation."""
    latin = F.translate(strip_accents(F.coalesce(_col(c), F.lit(""))), "đĐ", "dD")

    def shaped(key: Column) -> Column:
        named = F.when(key.rlike("^[0-9]"), F.concat(F.lit("REL_"), key)).otherwise(key)
        cut = F.regexp_replace(F.substring(named, 1, lx.MAX_RELATION_LENGTH), "^_+|_+$", "")
        return F.when(key == "", F.lit("RELATED_TO")).otherwise(cut)

    return let(plain_key(latin), shaped)


def lookup(key: Column | str, table: dict[str, str]) -> Column:
    """Constant lookup inside the expression: no join for tables of fixed size."""
    literals = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*literals), _col(key))


def relation_type(c: Column | str) -> Column:
    """Known variants become their canonical relation; unknown keys are kept."""
    return let(relation_key(c), lambda k: F.coalesce(lookup(k, lx.RELATION_ALIASES), k))


def is_canonical_relation(c: Column | str) -> Column:
    return relation_type(c).isin(lx.RELATION_TYPES)


def is_semantic_relation(c: Column | str) -> Column:
    return ~relation_type(c).isin(lx.SYSTEM_RELATIONS)


def entity_label(c: Column | str) -> Column:
    """Core label, directly or through an alias, else OTHER."""
    return let(plain_key(c), lambda k: F.coalesce(
        F.when(k.isin(lx.ENTITY_LABELS), k), lookup(k, lx.LABEL_ALIASES), F.lit("OTHER")))


def type_priority(c: Column | str) -> Column:
    pairs = [F.lit(x) for pair in lx.TYPE_PRIORITY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(_col(c))), F.lit(1))


def strip_title(c: Column | str) -> Column:
    """Remove leading person titles that end at a separator; keep the name if nothing is left."""
    titles = "|".join(sorted(lx.PERSON_TITLES, key=len, reverse=True))
    one = rf"(?:{titles})(?:\.\s*/?\s*|\s*/\s*|\s*:\s*|\s+)"
    name = trim_blank(c)
    rest = trim_blank(F.regexp_replace(name, rf"(?iuU)^(?:{one})+:?\s*", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), name)


def humanize(c: Column | str) -> Column:
    return trim_blank(F.lower(F.replace(_col(c), F.lit("_"), F.lit(" "))))


def content_hash(c: Column | str) -> Column:
    return F.sha2(trim_blank(c), 256)


def snippet(c: Column | str, limit: int = 120) -> Column:
    flat = squeeze(F.coalesce(_col(c), F.lit("")))
    cut = F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def count_matches(c: Column, patterns: list[str]) -> Column:
    """Number of patterns found at least once, ignoring case."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.when(c.rlike(f"(?iuU){pattern}"), 1).otherwise(0)
    return total


def matches_any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))


def fold_patterns(patterns: list[str]) -> list[str]:
    """Patterns in the form of normalised text, without duplicates."""
    folded = []
    for pattern in patterns:
        plain = "".join(
            x for x in unicodedata.normalize("NFKD", pattern) if not unicodedata.combining(x)
        ).replace("đ", "d")
        if plain not in folded:
            folded.append(plain)
    return folded


def is_refusal(answer: Column | str) -> Column:
    """The answer says that nothing was found; accented patterns are folded like the text."""
    patterns = list(dict.fromkeys(
        lx.REFUSAL_PATTERNS
        + ["".join(x for x in unicodedata.normalize("NFD", p) if not unicodedata.combining(x))
           for p in lx.REFUSAL_PATTERNS]
    ))
    return matches_any(normalize_answer(answer), patterns)


def keyword_overlap(answer: Column | str, keywords: Column | str) -> Column:
    """Share of non-blank keywords contained in the answer; null without keywords."""
    wanted = F.filter(_col(keywords), lambda k: trim_blank(k) != "")
    folded = F.transform(wanted, normalize_answer)

    def share(text: Column) -> Column:
        hits = F.filter(folded, lambda k: F.contains(text, k))
        return F.when(F.size(wanted) > 0, F.round(F.size(hits) / F.size(wanted), 4))

    return let(normalize_answer(answer), share)


def mentioned_in(name: Column | str, text: Column | str) -> Column:
    """The whole name, or one of its words of four letters or more, occurs in the text."""
    n = strip_accents(F.lower(_col(name)))
    parts = F.filter(F.split(n, rf"(?U){BLANK}+"), lambda w: F.length(w) >= 4)

    def named(t: Column) -> Column:
        word = F.exists(parts, lambda w: F.contains(t, w))
        return (n != "") & (t != "") & (F.contains(t, n) | word)

    return let(strip_accents(F.lower(_col(text))), named)


def upper_letters(text: str) -> str:
    """Upper case letter by letter, as SQL has it: the length stays, and ß becomes its capital form."""
    def one(letter: str) -> str:
        return next((x for x in (letter.upper(), letter.title()) if len(x) == 1),
                    "ẞ" if letter == "ß" else letter)

    return "".join(map(one, text))
