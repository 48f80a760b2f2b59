"""Stems by language pack: published suffix-stripping algorithms, token routing on the index and on the query side."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWEL = "aeiouy"

# Words that the published English algorithm treats by themselves.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Its suffixes and what they become in the first region.
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_SHORT = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWELLED, _Y_AS_CONSONANT = re.compile(f"[{_VOWEL}]"), re.compile(r"(^y)|(?<=[aeiouy])y")


def _by_last(suffixes: Sequence) -> dict[str, tuple]:
    """Suffixes (with what they become, if they come as pairs) by their last letter, so a word is tried with few of them."""
    last = lambda s: (s if isinstance(s, str) else s[0])[-1]
    return {c: tuple(s for s in suffixes if last(s) == c) for c in dict.fromkeys(map(last, suffixes))}


_STEP2_BY, _STEP3_BY, _STEP4_BY = _by_last(_STEP2), _by_last(_STEP3), _by_last(_STEP4)


@lru_cache(maxsize=8)
def _opens(vowels: str) -> re.Pattern:
    return re.compile(f"[{vowels}][^{vowels}]")


def _region(word: str, vowels: str = _VOWEL, at: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins, from a place on."""
    m = _opens(vowels).search(word, at)
    return m.end() if m else len(word)


def english(w: str) -> str:
    """English stems after the published algorithm, its second version."""
    if len(w) <= 2:
        return w
    if w in _SPECIAL or w in _KEPT:
        return _SPECIAL.get(w, w)
    w = w.replace("’", "'").removeprefix("'")
    if "y" in w:
        w = _Y_AS_CONSONANT.sub("Y", w)
    r1 = 5 if w.startswith(("gener", "arsen")) else 6 if w.startswith("commun") else _region(w)
    r2 = _region(w, at=r1)
    if "'" in w:
        w = re.sub(r"'(s'?)?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWELLED.search(w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w
    last = w[-1:]
    if last not in ("d", "g", "y"):
        pass
    elif ending := next((x for x in ("eedly", "eed") if w.endswith(x)), ""):
        w = w[: -len(ending)] + "ee" if len(w) - len(ending) >= r1 else w
    elif (ending := next((x for x in ("ingly", "edly", "ing", "ed") if w.endswith(x)), "")) and _VOWELLED.search(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for suffix, new in _STEP2_BY.get(w[-1:], ()):
        if w.endswith(suffix):
            w = w[: -len(suffix)] + new if len(w) - len(suffix) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
            w = w[:-2]
    for suffix, new in _STEP3_BY.get(w[-1:], ()):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            w = w[:at] + (new or "") if at >= (r2 if new is None else r1) else w
            break
    for suffix in _STEP4_BY.get(w[-1:], ()):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Vowels and ending groups of the published Russian algorithm; a group's first list needs а or я before it.
_RU_VOWELS = "аеиоуыэюя"
_RU_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_RU_ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_RU_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_RU_REFLEXIVE = ("ся", "сь")
_RU_VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
_RU_NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
_RU_DERIVED, _RU_SUPERLATIVE = ("ост", "ость"), ("ейш", "ейше")


def russian(w: str) -> str:
    """Russian stems after the published algorithm; ё counts as е."""
    w = w.replace("ё", "е")
    first = next((i + 1 for i, c in enumerate(w) if c in _RU_VOWELS), len(w))
    r1 = _region(w, _RU_VOWELS)
    r2 = _region(w, _RU_VOWELS, r1)

    def cut(endings: Sequence[str], word: str, after: str = "", least: int = first) -> str | None:
        for e in sorted(endings, key=len, reverse=True):
            at = len(word) - len(e)
            if word.endswith(e) and at >= least and (not after or at > least and word[at - 1] in after):
                return word[:at]
        return None

    def either(groups: tuple[Sequence[str], Sequence[str]], word: str) -> str | None:
        """The longest ending of both groups decides."""
        a, b = cut(groups[0], word, "ая"), cut(groups[1], word)
        return min((x for x in (a, b) if x is not None), key=len, default=None)

    out = either(_RU_GERUND, w)
    if out is None:
        bare = cut(_RU_REFLEXIVE, w)
        out = w if bare is None else bare
        adjective = cut(_RU_ADJECTIVE, out)
        if adjective is not None:
            participle = either(_RU_PARTICIPLE, adjective)
            out = adjective if participle is None else participle
        else:
            found = either(_RU_VERB, out)
            if found is None:
                found = cut(_RU_NOUN, out)
            out = out if found is None else found
    if out.endswith("и") and len(out) - 1 >= first:
        out = out[:-1]
    found = cut(_RU_DERIVED, out, least=max(r2, first))
    out = out if found is None else found
    if out.endswith("нн") and len(out) - 2 >= first:
        return out[:-1]
    found = cut(_RU_SUPERLATIVE, out)
    if found is not None:
        return found[:-1] if found.endswith("нн") else found
    return out[:-1] if out.endswith("ь") and len(out) - 1 >= first else out


@dataclass(frozen=True)
class Pack:
    """A language: its script, letters that no other language of the script has, and its stemmer with a version.

    A stem of ``head`` letters or more begins with as many of its word's (ё as е), but for those of ``irregular`` words; 0 promises nothing.
    """

    id: str
    script: str
    letters: str
    stem: Callable[[str], str]
    version: int = 1
    head: int = 0
    irregular: frozenset[str] = frozenset()


# The first pack of a script is its default.
PACKS = (Pack("en", "Latin", "", english, head=2, irregular=frozenset(_SPECIAL)), Pack("ru", "Cyrillic", "ыэъё", russian, head=2))
_SCRIPTS = {"Cyrillic": regex.compile(r"\p{Script=Cyrillic}"), "Latin": regex.compile(r"\p{Script=Latin}")}
_WORD, _ASCII_WORD = regex.compile(r"[\p{L}\p{N}_]+"), re.compile(r"[A-Za-z0-9_]+")
_CODE = regex.compile(r"[\d_]|\p{Ll}\p{Lu}")


def script_of(token: str) -> str | None:
    """A token with any Cyrillic letter counts as Cyrillic."""
    return next((name for name, letter in _SCRIPTS.items() if letter.search(token)), None)


def _by_letters(token: str, packs: Sequence[Pack]) -> Pack | None:
    low = token.lower()
    return next((p for p in packs if any(c in low for c in p.letters)), None)


def pack_of(token: str, language: str | None = None, packs: Sequence[Pack] = PACKS) -> Pack | None:
    """The pack of a token's own letters, else of the book's language, else its script's default."""
    mine = [p for p in packs if p.script == script_of(token)]
    if not mine:
        return None
    return _by_letters(token, mine) or next((p for p in mine if p.id == language), mine[0])


def stem(token: str, language: str | None = None, packs: Sequence[Pack] = PACKS) -> str:
    """A code token (a digit, an underline or an inner capital) is lower-cased only."""
    return _stem(token, language, tuple(packs))


@lru_cache(maxsize=1 << 16)
def _stem(token: str, language: str | None, packs: tuple[Pack, ...]) -> str:
    """Texts repeat their words, so a worker keeps the stems it made last."""
    pack = None if _CODE.search(token) else pack_of(token, language, packs)
    return token.lower() if pack is None else pack.stem(token.lower())


@lru_cache(maxsize=256)
def _heads(stems: frozenset[str], packs: tuple[Pack, ...]) -> tuple[int, frozenset[str], frozenset[str]]:
    """How many letters tell that a word can't have one of some stems, those letters, and the irregular words that have one."""
    head = min([p.head for p in packs] + [len(s) for s in stems])
    return head, frozenset(s.replace("ё", "е")[:head] for s in stems), frozenset(w for p in packs for w in p.irregular if p.stem(w) in stems)


def sought(words: Iterable[str], stems: frozenset[str], packs: Sequence[Pack] = PACKS) -> dict[str, str]:
    """Those of some words whose stem is one of ``stems``, with it; words that begin otherwise are not stemmed, as most of a text's are."""
    if not stems:
        return {}
    head, firsts, irregular = _heads(stems, tuple(packs))
    out = {}
    for w in words:
        low = w.lower().replace("ё", "е")
        if (low[:head] in firsts or low in irregular) and (s := stem(w, packs=packs)) in stems:
            out[w] = s
    return out


# Stems that a worker keeps for each language of its texts.
KNOWN = 1 << 17


class _Stems(dict):
    """Stems by word, made when they are first asked for; it starts anew when it is full, as the frequent words are soon back."""

    def __init__(self, language: str | None, packs: tuple[Pack, ...]):
        super().__init__()
        latin = [p for p in packs if p.script == "Latin"]
        self.language, self.packs = language, packs
        # The stemmer of words of plain Latin letters, if they can't be told by letters of their own.
        plain = next((p for p in latin if p.id == language), latin[0] if latin else None)
        self.plain = plain.stem if plain and not any(p.letters for p in latin) else None

    def __missing__(self, token: str) -> str:
        if len(self) >= KNOWN:
            self.clear()
        if self.plain and token.isascii() and token.isalpha() and (token[1:].islower() or len(token) == 1):
            s = self.plain(token.lower())
        else:
            s = _stem.__wrapped__(token, self.language, self.packs)
        self[token] = s
        return s


@lru_cache(maxsize=8)
def _stems_of(language: str | None, packs: tuple[Pack, ...]) -> _Stems:
    return _Stems(language, packs)


def stem_tokens(text: str, language: str | None = None, packs: Sequence[Pack] = PACKS) -> list[str]:
    known = _stems_of(language, tuple(packs))
    return [known[w] for w in (_ASCII_WORD if text.isascii() else _WORD).findall(text)]


@dataclass(frozen=True)
class Word:
    stems: tuple[str, ...]
    start: int
    end: int


def query_words(query: str, languages: frozenset[str | None] | None = None, packs: Sequence[Pack] = PACKS) -> list[Word]:
    """A query's words with a stem for each pack that the library's books may have been stemmed with.

    A word with letters of one pack takes that.  If the query shows letters of one pack of a script only, and the
    library has it, that pack takes all words of the script.  Without languages each script has its default.
    """
    found = list(_WORD.finditer(query))
    shown: dict[str, set[str]] = {}
    for m in found:
        own = [p for p in packs if p.script == script_of(m.group())]
        if not _CODE.search(m.group()) and (p := _by_letters(m.group(), own)):
            shown.setdefault(p.script, set()).add(p.id)

    def candidates(script: str) -> list[Pack]:
        own = [p for p in packs if p.script == script]
        if languages:
            other = any(x not in {p.id for p in own} for x in languages)
            own = [p for i, p in enumerate(own) if p.id in languages or i == 0 and other]
        else:
            own = own[:1]
        seen = shown.get(script, set())
        only = [p for p in own if p.id in seen]
        return only if len(seen) == 1 and only else own

    out = []
    for m in found:
        low, script = m.group().lower(), script_of(m.group())
        mine = [p for p in packs if p.script == script]
        if _CODE.search(m.group()) or not mine:
            stems = [low]
        elif p := _by_letters(m.group(), mine):
            stems = [p.stem(low)]
        else:
            stems = [p.stem(low) for p in candidates(script)] or [low]
        out.append(Word(tuple(dict.fromkeys(stems)), m.start(), m.end()))
    return out


def stem_version(packs: Sequence[Pack] = PACKS) -> str:
    """What an index's stems were made with."""
    return "|".join(f"{p.id}:{p.version}" for p in packs)


# Texts whose stems are Python objects at a time.
ROWS = 64


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(text: pa.Array, language: pa.Array) -> pa.Array:
    parts = []
    for at in range(0, len(text), ROWS):
        some = zip(text.slice(at, ROWS).to_pylist(), language.slice(at, ROWS).to_pylist())
        parts.append(pa.array([stem_tokens(t, lang) if t else [] for t, lang in some], pa.list_(pa.string())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))
