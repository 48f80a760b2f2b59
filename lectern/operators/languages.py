"""A book's language from its text: the script that most letters have, then letters that only one language has, then function words.

``detected`` is a column of built-in functions; ``language`` is the same rule for one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    id: str
    script: str
    letters: str
    words: frozenset[str]


# Languages, their own letters and function words (ё written as е when words are compared); of a script's languages the first is the default.
_EN = (
    "a an the and or but nor not no so if then than as at by for from in into of off on onto out "
    "over to up with about after before under between through during without within is am are was "
    "were be been being do does did doing done have has had having can could will would shall should "
    "may might must how what when where which who whom whose why this that these those there here it "
    "its they them their we our you your he she his her i me my all any some each every both few more "
    "most other such only own same too very just also use used using via vs"
)
_RU = (
    "и в во на с со к ко у о об от до по за из изо для без над под при про через между а но или либо "
    "да нет не ни же ли бы то это этот эта эти тот та те так как что чтобы кто где когда зачем почему "
    "какой какая какие чем там тут здесь уже еще ещё был была были было быть есть будет он она оно они "
    "мы вы ты я его ее её их им ему ей нас вас все всё весь вся всех свой своя свои также тоже очень "
    "можно нужно надо"
)
_UK = (
    "і й та або чи але а що щоб як коли де куди хто який яка яке які це цей ця ці той те ті там тут "
    "вже ще не ні так також теж дуже можна треба потрібно був була було були бути є буде він вона "
    "воно вони ми ви ти я його її їх їм йому їй нас вас все всі весь вся свій своя свої в у на з із "
    "зі до від по за для без над під при про через між"
)
LANGUAGES = (
    Language("en", "Latin", "", frozenset(_EN.split())),
    Language("ru", "Cyrillic", "ыэъё", frozenset(_RU.replace("ё", "е").split())),
    Language("uk", "Cyrillic", "іїєґ", frozenset(_UK.split())),
)
# A long text is read in three windows; letters decide if one language has three times as many as the next.
WINDOW, PLACES, DOMINANCE = 40_000, (0.25, 0.5, 0.75), 3
STOP = frozenset().union(*(x.words for x in LANGUAGES))


def _scripts(languages) -> list[str]:
    return list(dict.fromkeys(x.script for x in languages))


def sample(text: str) -> Column:
    """The text, or of a long one its windows, a blank between them."""
    t, n = F.col(text), F.length(text)
    parts = (F.substring(t, F.floor(n * p - WINDOW / 2).cast("int") + 1, F.lit(WINDOW)) for p in PLACES)
    return F.when(n <= WINDOW * len(PLACES), t).otherwise(F.concat_ws(" ", *parts))


def detected(text: str, languages: tuple[Language, ...] = LANGUAGES) -> Column:
    """The language's id; null for a text without a letter of any script.

    A script with one language decides alone; letters and words are only counted where a script has several.
    A text of ASCII has letters of one script, so one of them is enough.
    """
    few = sample(text)
    letters = {s: F.length(F.regexp_replace(few, rf"\P{{Is{s}}}+", "")) for s in _scripts(languages)}
    most = F.greatest(F.lit(0), *letters.values())
    out = F.lit(None).cast("string")
    for script in reversed(letters):
        own = [x for x in languages if x.script == script]
        out = F.when((letters[script] == most) & (most > 0), F.lit(own[0].id) if len(own) == 1 else _among(F.lower(few), script, own)).otherwise(out)
    latin = [x for x in languages if x.script == "Latin"]
    if len(latin) > 1:
        return out
    plain = F.lit(latin[0].id) if latin else F.lit(None).cast("string")
    return F.when(F.length(few) == F.octet_length(few), F.when(few.rlike("[A-Za-z]"), plain)).otherwise(out)


def _among(low: Column, script: str, own: list[Language]) -> Column:
    marks = [F.length(F.regexp_replace(low, f"[^{x.letters}]", "")) if x.letters else F.lit(0) for x in own]
    words = F.filter(F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), 1), lambda w: w.rlike(rf"\p{{Is{script}}}"))
    plain = F.transform(words, lambda w: F.translate(w, "ё", "е"))
    known = [_hits(plain, x) for x in own]
    by_words = F.lit(own[0].id)
    best = F.greatest(*known)
    for x, n in reversed(list(zip(own, known))):
        by_words = F.when(n == best, F.lit(x.id)).otherwise(by_words)
    out = by_words
    for i, x in reversed(list(enumerate(own))):
        next_ = F.greatest(F.lit(0), *(m for j, m in enumerate(marks) if j != i)) if len(own) > 1 else F.lit(0)
        out = F.when((marks[i] > 0) & (marks[i] >= DOMINANCE * next_), F.lit(x.id)).otherwise(out)
    return out


def _hits(words: Column, x: Language) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*sorted(x.words))))


def language(text: str, languages: tuple[Language, ...] = LANGUAGES) -> str | None:
    n = len(text)
    if n > WINDOW * len(PLACES):
        text = " ".join(text[at : at + WINDOW] for at in (int(n * p - WINDOW / 2) for p in PLACES))
    counts = {s: len(regex.findall(rf"\p{{Script={s}}}", text)) for s in _scripts(languages)}
    script = max(counts, key=lambda s: counts[s])
    if not counts[script]:
        return None
    own, low = [x for x in languages if x.script == script], text.lower()
    if len(own) == 1:
        return own[0].id
    marks = sorted(((sum(low.count(c) for c in x.letters), x) for x in own), key=lambda m: -m[0])
    if marks[0][0] and marks[0][0] >= DOMINANCE * marks[1][0]:
        return marks[0][1].id
    words = [w.replace("ё", "е") for w in regex.findall(r"\p{L}+", low) if regex.search(rf"\p{{Script={script}}}", w)]
    return max(own, key=lambda x: sum(w in x.words for w in words)).id
