"""Porter's stemmer (M. F. Porter, 1980), for search by stems."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiou")

# The published suffix tables of steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for k, c in enumerate(w):
        out.append(c not in _VOWELS and not (c == "y" and k > 0 and out[k - 1]))
    return out


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    c = _consonants(w)
    return sum(not a and b for a, b in zip(c, c[1:], strict=False))


def _vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _short(w: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    c = _consonants(w)[-3:]
    return c == [True, False, True] and w[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and those with other signs stay."""
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((e for e, _ in table if w.endswith(e)), key=len, default=None)
        if hit and _measure(w[: -len(hit)]) > 0:
            w = w[: -len(hit)] + dict(table)[hit]
    hit = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[: -len(hit)].endswith(("s", "t"))):
        w = w[: -len(hit)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w
