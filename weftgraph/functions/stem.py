"""Porter's suffix stripping (1980) for English words."""

from __future__ import annotations

from functools import lru_cache

#: Fixed values of the published algorithm: suffixes and what they become, for a measure above 0.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
#: Suffixes that go for a measure above 1.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """``c`` and ``v`` for each letter; a y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, table: list[str]) -> str:
    for end, _, new in sorted((t.partition(":") for t in table), key=lambda t: -len(t[0])):
        if word.endswith(end):
            root = word[: -len(end)]
            return root + new if _measure(root) > 0 else word
    return word


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a to z, or of fewer than three, are their own."""
    if len(word) < 3 or len(word) > 64 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            root = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(root):
                if root.endswith(("at", "bl", "iz")):
                    word = root + "e"
                elif _double(root) and root[-1] not in "lsz":
                    word = root[:-1]
                else:
                    word = root + "e" if _measure(root) == 1 and _short_end(root) else root
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            root = word[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short_end(root)):
            word = root
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
