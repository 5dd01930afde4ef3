"""Porter's published suffix stripping (1980) for one lower-case English word."""

from __future__ import annotations

import re

#: The suffixes of steps 2, 3 and 4 of the published algorithm, and what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v for each vowel and c for each other letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], measure: int) -> str:
    """The longest suffix decides; it is replaced if what stands before has more than measure."""
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if suffix == "ion" and not head.endswith(("s", "t")):
                return word
            return head + rules[suffix] if _measure(head) > measure else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        head = next((word[: -len(s)] for s in ("ing", "ed") if word.endswith(s)), None)
        if head is not None and "v" in _shape(head):
            word = head
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _ends_double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP_2, 0)
    word = _replaced(word, STEP_3, 0)
    word = _replaced(word, dict.fromkeys(STEP_4, ""), 1)
    if word.endswith("e"):
        head = word[:-1]
        if _measure(head) > 1 or (_measure(head) == 1 and not _ends_short(head)):
            word = head
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
