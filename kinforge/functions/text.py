"""Text normalization as Column functions.

Everything here stays in the JVM but ``strip_accents`` and ``transliterate_token``, which need Unicode data that Spark
lacks; those are Arrow functions, to be called on rows that need them (``needs_unicode``, ``has_brahmic``).
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LEGAL_FORMS, STREET_WORDS

_LATIN = (range(0x0000, 0x0250), range(0x1E00, 0x1F00))


def _fold(text: str) -> str:
    """Compatibility decomposition without the marks that follow a Latin character, recomposed."""
    kept, latin = [], False
    for c in unicodedata.normalize("NFKD", text):
        mark = unicodedata.combining(c)
        if not mark:
            latin = any(ord(c) in r for r in _LATIN)
        if not (mark and latin):
            kept.append(c)
    return unicodedata.normalize("NFKC", "".join(kept))


@cache
def _latin_table() -> tuple[str, str, str]:
    """Latin letters that fold to another single character, those characters, and the letters that fold to several."""
    folded = {c: _fold(c) for r in _LATIN for c in map(chr, r)}
    one = {c: f for c, f in folded.items() if f != c and len(f) == 1}
    return "".join(one), "".join(one.values()), "".join(c for c, f in folded.items() if len(f) != 1)


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def needs_unicode(text: Column) -> Column:
    """True if the text holds a character outside the Latin blocks (marks, other scripts, full-width forms...), or a
    Latin one that folds to several."""
    several = "".join(f"\\x{{{ord(c):04X}}}" for c in _latin_table()[2])
    return text.rlike(rf"[^\x{{0000}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]|[{several}]")


def strip_latin_accents(text: Column) -> Column:
    """``strip_accents`` for texts without a need of Unicode data: one translate()."""
    source, target, _ = _latin_table()
    return F.translate(text, source, target)


@F.pandas_udf(T.StringType())
def _strip_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else _fold(t))


def strip_accents(text: Column) -> Column:
    """Fold accents of Latin letters, keep the marks of other scripts, NFKC; any text, by an Arrow function."""
    return _strip_accents(F.coalesce(text, F.lit("")))


def clean_basic(folded: Column) -> Column:
    """Lower-case and turn separators into single blanks; the input's accents are already folded."""
    return squeeze_spaces(F.translate(F.lower(squeeze_spaces(folded)), ",/\\|_-()[]{}.:;#\"'`", " " * 19))


def join_single_letters(text: Column) -> Column:
    """Join runs of two to six single letters ("s a s" to "sas"); longer runs in sixes."""
    cut = F.regexp_replace(text, r"(?U)(\b(?:[a-z]\s+){5}[a-z])\s+(?=[a-z]\b)", "$1 \u0001 ")
    joined = F.regexp_replace(cut, r"(?U)(?<=\b[a-z])\s+(?=[a-z]\b)", "")
    return F.replace(joined, F.lit("\u0001"), F.lit(""))


def normalize_name(folded: Column, strip_legal_forms: bool = True) -> Column:
    """Cleaned name with joined initials, and without legal forms wherever they stand."""
    name = join_single_letters(clean_basic(folded))
    if strip_legal_forms:
        name = F.regexp_replace(name, r"(?U)\b(?:" + "|".join(LEGAL_FORMS) + r")\b", " ")
    return squeeze_spaces(name)


def normalize_address(folded: Column) -> Column:
    """Cleaned address with street words written out."""
    cleaned = clean_basic(folded)
    words = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    pieces = F.split(cleaned, r"(?U)\b")  # a street word is a whole piece between word boundaries
    return squeeze_spaces(F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at(words, t), t)), ""))


def tokens(text: Column) -> Column:
    """Words of a normalized text; none for ''."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def compressed_name(norm_name: Column) -> Column:
    """The name without blanks if it has two words or more, else ''."""
    return F.when(norm_name.contains(" "), F.replace(norm_name, F.lit(" "), F.lit(""))).otherwise("")


def extract_numbers(text: Column) -> Column:
    """Distinct whole-word digit runs, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\d+\b"), 0)))


def token_ngrams(words: Column, n: int = 2) -> Column:
    """Joined runs of n words; a shorter list is one joined token."""
    size = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(words, " "))).otherwise(many)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of the text without blanks; a shorter text is its only one."""
    solid = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")
    size = F.length(solid)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(solid, i, F.lit(n))))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(solid)).otherwise(many)


# --- Fixed values: letters of the Brahmic blocks by place in the block -------------------------------------------
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80)
SKELETON_CONSONANTS = {
    0x15: "k", 0x16: "k", 0x17: "g", 0x18: "g", 0x19: "n", 0x1A: "c", 0x1B: "c", 0x1C: "j", 0x1D: "j", 0x1E: "n",
    0x1F: "t", 0x20: "t", 0x21: "d", 0x22: "d", 0x23: "n", 0x24: "t", 0x25: "t", 0x26: "d", 0x27: "d", 0x28: "n",
    0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "b", 0x2E: "m", 0x30: "r", 0x32: "l", 0x33: "l", 0x35: "v",
    0x36: "s", 0x37: "s", 0x38: "s", 0x39: "h", 0x58: "k", 0x59: "k", 0x5A: "g", 0x5B: "j", 0x5C: "d", 0x5D: "d", 0x5E: "f",
}
SKELETON_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0F: "e", 0x10: "e", 0x13: "o", 0x14: "o"}
LATIN_REWRITES = (
    ("ph", "f"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ch", "c"), ("ck", "k"),
    ("q", "k"), ("x", "ks"), ("w", "v"), ("z", "j"), ("y", ""),
)
SPOKEN_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "k", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "d", 0x5D: "dh", 0x5E: "f",
}
SPOKEN_SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au",
}
SPOKEN_VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au",
}
NUKTA, VIRAMA, NASALS, VISARGA = 0x3C, 0x4D, (0x01, 0x02), 0x03
# ------------------------------------------------------------------------------------------------------------------


def has_brahmic(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{0DFF}]")


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def _block_table(*offsets: dict[int, str]) -> tuple[str, str]:
    """For translate(): mapped letters of every block first, then all other characters of the blocks, which go."""
    known = {b + o: letter for table in offsets for o, letter in table.items() for b in BLOCKS}
    rest = [c for b in BLOCKS for c in range(b, b + 0x80) if c not in known]
    return "".join(map(chr, known)) + "".join(map(chr, rest)), "".join(known.values())


def skeleton_latin(token: Column) -> Column:
    """Consonants after the rewrites, with an initial vowel kept and repeats squeezed."""
    word = F.lower(token)
    for old, new in LATIN_REWRITES:
        word = F.replace(word, F.lit(old), F.lit(new))
    word = F.translate(F.regexp_replace(word, "c(?=[eiy])", "s"), "c", "k")
    return _squeeze(F.concat(F.regexp_extract(word, "^[aeiou]?", 0), F.translate(word, "aeiou", "")))


def skeleton_brahmic(token: Column) -> Column:
    """Consonant letters by their place in the block; an independent vowel counts at the front only."""
    letters = lambda *tables: (lambda x: F.translate(x, *_block_table(*tables)))
    bare = F.regexp_replace(F.lower(F.substring(token, 2, 1 << 20)), r"[^\p{L}\p{N}\x{0900}-\x{0DFF}]", "")
    front = F.regexp_replace(F.lower(F.substring(token, 1, 1)), r"[^\p{L}\p{N}\x{0900}-\x{0DFF}]", "")
    return _squeeze(F.concat(letters(SKELETON_CONSONANTS, SKELETON_VOWELS)(front), letters(SKELETON_CONSONANTS)(bare)))


def phonetic_skeleton(token: Column) -> Column:
    """Script-independent consonant skeleton of one word; '' for ''."""
    return F.when(has_brahmic(token), skeleton_brahmic(token)).otherwise(skeleton_latin(token))


def _syllables() -> re.Pattern:
    """A consonant with nukta and sign or virama of its own block, or any other single character."""
    one = lambda block, offsets: "[" + "".join(chr(block + o) for o in offsets) + "]"
    forms = (f"{one(b, SPOKEN_CONSONANTS)}{chr(b + NUKTA)}?(?:{chr(b + VIRAMA)}|{one(b, SPOKEN_SIGNS)})?" for b in BLOCKS)
    return re.compile("|".join((*forms, "(?s:.)")))


_SYLLABLE = _syllables()


def spell_brahmic(token: str) -> str:
    """Latin spelling of one word as spoken: an inherent "a" after a bare consonant that does not end the word."""

    def spell(m: re.Match) -> str:
        unit = m[0]
        place = [(ord(c) - BLOCKS[0]) % 0x80 if BLOCKS[0] <= ord(c) < BLOCKS[-1] + 0x80 else -1 for c in unit]
        if place[0] < 0:
            return unit.lower()
        if place[0] in SPOKEN_CONSONANTS:
            vowel = "" if place[-1] == VIRAMA or m.end() == len(token) else "a"
            return SPOKEN_CONSONANTS[place[0]] + SPOKEN_SIGNS.get(place[-1], vowel)
        if place[0] in NASALS:
            return "n"
        return "h" if place[0] == VISARGA else SPOKEN_VOWELS.get(place[0], "")

    return _SYLLABLE.sub(spell, token)


@F.pandas_udf(T.StringType())
def _spell(token: pd.Series) -> pd.Series:
    return token.map(lambda t: None if t is None else spell_brahmic(t))


def transliterate_token(token: Column) -> Column:
    return _spell(token)
