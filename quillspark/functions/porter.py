"""Stemming by the published algorithm of Porter (1980), as tables of suffixes."""

from __future__ import annotations

import re

# Suffixes of steps 2, 3 and 4, and what they become.
STEP_2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _longest(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(pairs, key=lambda p: -len(p[0]))


_RULES_2 = _longest([tuple(x.split(" ")) for x in STEP_2.split(",")])
_RULES_3 = _longest([tuple(x.split(" ")) for x in STEP_3.split(",")])
_RULES_4 = _longest([(x, "") for x in STEP_4.split()] + [("ion", "")])


def _shape(stem: str) -> str:
    """A letter c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, letter in enumerate(stem):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            fits = measure(stem) > least and (end != "ion" or stem.endswith(("s", "t")))
            return stem + new if fits else word
    return word


def stem_word(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif measure(cut) == 1 and _closed(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _RULES_2, 0)
    word = _replace(word, _RULES_3, 0)
    word = _replace(word, _RULES_4, 1)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _closed(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
