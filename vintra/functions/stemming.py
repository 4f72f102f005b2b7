"""English lexemes: words, stop words, and the Porter2 suffix-stripping stemmer."""

from __future__ import annotations

import re
from collections.abc import Callable

# English stop words, and the suffix tables and exceptions of the published stemming algorithm.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as they are once plurals are off.
FINAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
REGION_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

TOKEN = re.compile(r"[^\W_]+")
_VOWEL = "aeiouy"
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _ending(suffixes) -> Callable[[str], str | None]:
    """A function for the longest of the suffixes that a word ends in."""
    held, lengths = frozenset(suffixes), sorted({len(s) for s in suffixes}, reverse=True)

    def found(word: str) -> str | None:
        for n in lengths:
            if (s := word[-n:]) in held:
                return s
        return None

    return found


_PLURAL, _PAST = _ending(("sses", "ied", "ies", "us", "ss", "s")), _ending(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_STEP2, _STEP3, _STEP4 = _ending(STEP2), _ending(STEP3), _ending(STEP4)


def stem(word: str) -> str:
    """The stem of a lower-case word; words with other letters than a-z go by the same rules."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # a consonant y is written Y
    w = re.sub("(?<=[aeiouy])y", "Y", "Y" + word[1:] if word[0] == "y" else word)
    first = next((len(p) for p in REGION_PREFIXES if w.startswith(p)), None)
    if first is None:
        first = m.end() if (m := _REGION.search(w)) else len(w)
    second = m.end() if (m := _REGION.search(w, first)) else len(w)

    # plurals
    s = _PLURAL(w)
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in FINAL:
        return w

    # past and participles
    s = _PAST(w)
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= first:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _VOWEL for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif first >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"

    # derived forms
    s = _STEP2(w)
    if s and len(w) - len(s) >= first and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in LI_ENDINGS):
        w = w[: -len(s)] + STEP2[s]
    s = _STEP3(w)
    if s and len(w) - len(s) >= (second if s == "ative" else first):
        w = w[: -len(s)] + STEP3[s]
    s = _STEP4(w)
    if s and len(w) - len(s) >= second and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]

    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """word -> stem, None for stop words; each word is stemmed once, up to `most` of them are kept."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = None if word in STOP_WORDS else stem(word)
        return out


def lexemes(text: str | None, stems: Stems | None = None) -> list[tuple[int, str]]:
    """(place, lexeme) of the words of a text that aren't stop words; places count all words from 1."""
    known = Stems() if stems is None else stems
    return [(n, s) for n, w in enumerate(TOKEN.findall((text or "").lower()), 1) if (s := known[w]) is not None]
