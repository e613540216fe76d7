"""The public English Snowball stemmer (Porter2), for one lower-case word at a time.

It is meant for distinct words, of which there are few, not for every occurrence.
"""

from __future__ import annotations

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Fixed: words with a stem of their own, and words that stay as they are once step 1a is done.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Fixed: suffixes of steps 2 to 4 and what stands for them.
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _after(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def stem(word: str) -> str:
    """The word's stem; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.lstrip("'")
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _after(word, 0) if r1 is None else r1
    r2 = _after(word, r1)
    vowel = lambda w: any(c in _VOWELS for c in w)
    for s in ("'s'", "'s", "'"):
        word = word.removesuffix(s)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and vowel(word[:-2]):
        word = word[:-1]
    if word in _STAY:
        return word
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if word.endswith(s):
            base = word[: -len(s)]
            if s in ("eed", "eedly"):
                word = base + "ee" if len(base) >= r1 else word
            elif vowel(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif _short_end(word) and r1 >= len(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    for s in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if word.endswith(s):
            base = word[: -len(s)]
            if len(base) >= r1:
                if s == "ogi":
                    word = base + "og" if base.endswith("l") else word
                elif s == "li":
                    word = base if base and base[-1] in _LI else word
                else:
                    word = base + _STEP2[s]
            break
    for s in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if word.endswith(s):
            base = word[: -len(s)]
            if len(base) >= r1:
                word = (base if len(base) >= r2 else word) if s == "ative" else base + _STEP3[s]
            break
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if word.endswith(s):
            base = word[: -len(s)]
            if len(base) >= r2 and (s != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or len(base) >= r1 and not _short_end(base):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
