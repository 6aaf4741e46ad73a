"""English stemming by the published Snowball "English" (Porter2) definition."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
#: Fixed values of the definition: words with a stem of their own, and words left as they are.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_R1_PREFIX = re.compile(r"^(gener|commun|arsen)")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
#: Fixed values of the definition: suffixes of steps 2, 3 and 4, longest first within a step.
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", None), ("li", None),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    m = _R1_PREFIX.match(w) or _REGION.search(w)
    r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _has_vowel(w: str) -> bool:
    return any(c in _VOWELS for c in w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").removeprefix("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if len(w) <= 2:
        return w
    # y at the start or behind a vowel is a consonant
    marked = list(w)
    for i, c in enumerate(marked):
        if c == "y" and (i == 0 or marked[i - 1] in _VOWELS):
            marked[i] = "Y"
    w = "".join(marked)
    r1, r2 = _regions(w)
    for tail in ("'s'", "'s", "'"):
        if w.endswith(tail):
            w = w[: -len(tail)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    # 1b
    for tail in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(tail):
            if tail in ("eed", "eedly"):
                if len(w) - len(tail) >= r1:
                    w = w[: -len(tail)] + "ee"
            elif _has_vowel(w[: -len(tail)]):
                w = w[: -len(tail)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for tail, put in _STEP2:
        if w.endswith(tail):
            at = len(w) - len(tail)
            if at >= r1:
                if put is not None:
                    w = w[:at] + put
                elif tail == "ogi" and w[at - 1 : at] == "l":
                    w = w[:-1]
                elif tail == "li" and w[at - 1 : at] and w[at - 1] in _LI:
                    w = w[:at]
            break
    # 3
    for tail, put in _STEP3:
        if w.endswith(tail):
            at = len(w) - len(tail)
            if at >= r1:
                if put is not None:
                    w = w[:at] + put
                elif at >= r2:
                    w = w[:at]
            break
    # 4
    for tail in _STEP4:
        if w.endswith(tail):
            at = len(w) - len(tail)
            if at >= r2 and (tail != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def may_share_stem(stems: list[str]) -> tuple[set[str], set[str]]:
    """First letters that a word with one of these stems must have, and the words it may be besides.

    Stemming leaves a word's first two letters alone, but for the words with a stem of their own.
    """
    return {s[:2] for s in stems}, {w for w, s in _SPECIAL.items() if s in set(stems)}
