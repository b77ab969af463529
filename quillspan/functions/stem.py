"""English stems by the published Snowball (Porter2) rules, and tokens reduced to them.

Stems are worked out a batch of words at a time in Arrow; ``stems`` is for a column of words, each different word of a corpus best being
given once (the search index does so), not each occurrence.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the algorithm's definition.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOPS_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("ization", "ize"), ("izer", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"),
    ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_V}{_C}")
_SHORT_END = re.compile(f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$")


def _region(word: str, start: int = 0) -> int:
    """Where what follows the first vowel and consonant begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(f"(^|(?<={_V}))y", "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w)
    r2 = _region(w, r1)
    short = lambda x: bool(_SHORT_END.search(x)) and r1 >= len(x)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in STOPS_AFTER_1A:
        return w
    # 1b
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search(_V, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif short(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    ending = _longest(w, [e for e, _ in STEP_2])
    if ending and len(w) - len(ending) >= r1:
        before = w[: -len(ending)]
        if not (ending == "ogi" and not before.endswith("l")) and not (ending == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + dict(STEP_2)[ending]
    # 3
    ending = _longest(w, [e for e, _ in STEP_3])
    if ending and len(w) - len(ending) >= (r2 if ending == "ative" else r1):
        w = w[: -len(ending)] + dict(STEP_3)[ending]
    # 4
    ending = _longest(w, STEP_4)
    if ending and len(w) - len(ending) >= r2 and not (ending == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(ending)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(words: pa.Array) -> pa.Array:
    kinds = words.dictionary_encode()
    own = pa.array([None if w is None else stem(w) for w in kinds.dictionary.to_pylist()], pa.string())
    return own.take(kinds.indices)


def stems(word: Column) -> Column:
    """The stem of each word of a column of lower-case words; null of null."""
    return F.arrow_udf(_stems, StringType())(word)
