"""English stemming after the published Porter2 rules, for one word."""

import re

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news",
    "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset(
    "inning outing canning herring earring proceed exceed succeed".split()
)
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able",
    "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive",
    "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
    "ogi": "og", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic",
    "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)

_region = re.compile(f"[{VOWELS}][^{VOWELS}]")
_has_vowel = re.compile(f"[{VOWELS}]")
_short_end = re.compile(f"(^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$")


def _region_after(word: str, start: int) -> int:
    found = _region.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    fitting = [e for e in endings if word.endswith(e)]
    return max(fitting, key=len) if fitting else None


def _swap(word: str, old: str, new: str) -> str:
    return word[: len(word) - len(old)] + new


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if _has_vowel.search(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    if ending.startswith("eed"):
        return _swap(word, ending, "ee") if len(word) - len(ending) >= r1 else word
    body = _swap(word, ending, "")
    if not _has_vowel.search(body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if body.endswith(DOUBLES):
        return body[:-1]
    if r1 >= len(body) and _short_end.search(body):
        return body + "e"
    return body


def stem(word: str) -> str:
    """The stem of one lower-case word; words with other letters stay as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that acts as a consonant is written Y until the end.
    word = re.sub(f"(^|[{VOWELS}])y", lambda m: m.group(1) + "Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region_after(word, 0)
    r2 = _region_after(word, r1)

    word = _plural(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    ending = _longest(word, STEP_2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: len(word) - len(ending)][-1:]
        blocked = (ending == "ogi" and before != "l") or (
            ending == "li" and before not in LI_ENDINGS
        )
        if not blocked:
            word = _swap(word, ending, STEP_2[ending])

    ending = _longest(word, STEP_3)
    if ending and len(word) - len(ending) >= r1:
        if ending != "ative" or len(word) - len(ending) >= r2:
            word = _swap(word, ending, STEP_3[ending])

    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2:
        if ending != "ion" or word[: -len(ending)].endswith(("s", "t")):
            word = _swap(word, ending, "")

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_end.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
