"""The English stemmer of the public Snowball description (Porter 2)."""

from __future__ import annotations

import re

_V = "aeiouy"
#: Words with stems of their own, words that stay, and words that stay after the first step.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings and what they become, the longest first.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _after(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    m = re.search(f"[{_V}][^{_V}]", word[start:])
    return start + m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(f"[{_V}][^{_V}]", word))


def english(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters and those with other signs than a-z and ' stay."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    word = word.removeprefix("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(f"(^|[{_V}])y", lambda m: m[1] + "Y", word)
    lead = re.match("gener|commun|arsen", word)
    r1 = lead.end() if lead else _after(word, 0)
    r2 = _after(word, r1)
    word = re.sub("'s'$|'s$|'$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word.lower()
    # 1b
    m = re.search("(eedly|eed)$", word)
    if m:
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", word)
        if m and re.search(f"[{_V}]", word[: m.start()]):
            word = word[: m.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif r1 >= len(word) and _short(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # 2
    for end, to in _STEP2:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ogi" or word[at - 1 : at] == "l") and (end != "li" or word[at - 1 : at] in tuple("cdeghkmnrt")):
                word = word[:at] + to
            break
    # 3
    for end, to in _STEP3:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                word = word[:at] + to
            break
    # 4
    for end in _STEP4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
