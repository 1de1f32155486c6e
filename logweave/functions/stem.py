"""English stemming (the published Porter2 rules) for the search index."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# English stop words of the search index.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now
    """.split()
)

# Words the published rules list as exceptions.
_EXCEPTIONS = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_INVARIANT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())

# Suffix rewrites of steps 2, 3 and 4, longest suffix first within equal endings.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if r1 is None:
        r1 = _after_vowel_consonant(word, 0)
    return r1, _after_vowel_consonant(word, r1)


def _after_vowel_consonant(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(ch in _VOWELS for ch in part)


def _short_syllable_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return (
        len(word) > 2
        and word[-3] not in _VOWELS
        and word[-2] in _VOWELS
        and word[-1] not in _VOWELS + "wxY"
    )


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem one lower-case word. Words with letters outside a-z are returned unchanged."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if word in _INVARIANT:
        return word
    # A y that acts as a consonant is written Y.
    letters = list(word)
    for i, ch in enumerate(letters):
        if ch == "y" and (i == 0 or letters[i - 1] in _VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word.lower() in _INVARIANT_1A:
        return word.lower()
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _rewrite(word, _STEP2, r1, r2)
    word = _rewrite(word, _STEP3, r1, r2)
    suffix = next((s for s in _STEP4 if word.endswith(s)), None)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_syllable_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if not _has_vowel(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if base.endswith(_DOUBLES):
                return base[:-1]
            if len(base) <= r1 and _short_syllable_end(base):
                return base + "e"
            return base
    return word


def _rewrite(word: str, table: list[tuple[str, str]], r1: int, r2: int) -> str:
    for suffix, new in table:
        if not word.endswith(suffix):
            continue
        base = word[: -len(suffix)]
        allowed = len(base) >= (r2 if suffix == "ative" else r1)
        if suffix == "ogi":
            allowed = allowed and base.endswith("l")
        elif suffix == "li":
            allowed = allowed and base.endswith(tuple("cdeghkmnrt"))
        return base + new if allowed else word
    return word
