"""Languages, snippet windows and highlights, against plain versions."""

import random
import re
import time
from collections import Counter

import pytest

from lectern.operators import languages, snippets, stemming

WORDS = "The raft log of consensus kept Raft logs and leaders. Who runs? It ends… a\nnew line, node node nodes. Консенсус журнала журналы! zebra".split(" ")
END = re.compile(r"[.!?…]\s+|\n")


def plain_start(body, at, width):
    low = max(0, at - snippets.LEAD)
    start = 0 if low == 0 else at
    for m in END.finditer(body[low:at]):
        start = low + m.end()
    if len(body) - start >= width:
        return start
    back = len(body) - width
    early = back if back == 0 or re.search(r"[.!?…]\s\Z|\n\Z", body[max(0, back - 2) : back]) else next((back + m.end() for m in END.finditer(body[back:start])), None)
    if early is not None and len(body) - early >= width * 2 / 3:
        return early
    if back == 0 or body[back - 1].isspace():
        return back
    m = re.search(r"\s", body[back:start])
    return back + m.end() if m else back


def plain_window(body, terms, width):
    """Every anchor's window weighed by itself."""
    if len(body) <= width:
        return 0
    hits = [(m.start(), m.end(), s) for m in stemming._WORD.finditer(body) if (s := stemming.stem(m.group())) in terms]
    if not hits:
        first = re.search(r"\S", body)
        if not first or not first.group().islower():
            return 0
        m = END.search(body[first.start() :])
        start = first.start() + m.end() if m else 0
        return start if start <= snippets.LEAD and len(body) - start >= width * 2 / 3 else 0
    n = Counter(s for *_, s in hits)
    best, most = 0, 0.0
    for at, _, s in hits:
        if 1 / n[s] >= max(1 / v for v in n.values()) * 0.5:
            start = plain_start(body, at, width)
            weight = sum(1 / n[t] for t in {t for a, z, t in hits if a >= start and z <= start + width})
            if weight > most + 1e-12:
                best, most = start, weight
    return best


def test_windows_equal_weighing_each():
    rng = random.Random(9)
    terms = snippets.topic_stems("how does the raft consensus log журнал work, zebra node?")
    assert {"raft", "consensus", "log", "zebra", "node"} <= terms and "the" not in terms and "how" not in terms
    for _ in range(400):
        body = "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", ". ", "\n", ".\n\n", "? \n"]) for _ in range(rng.randint(0, 220)))
        for width in (60, 320):
            start, text = snippets.window(body, terms, width)
            assert start == plain_window(body, terms, width), repr(body)
            assert text == ("…" if start else "") + body[start : start + width]


def test_windows_are_linear():
    body = "raft node. " * 40_000
    began = time.time()
    snippets.window(body, frozenset({"raft", "node"}))
    assert time.time() - began < 10


def test_windows_as_a_column(spark):
    df = spark.createDataFrame([(1, "x" * 400 + " The zebra runs."), (2, None), (3, "short")], "id int, body string")
    got = {r.id: tuple(r.w) for r in df.select("id", snippets.snippet("body", "zebra", 100).alias("w")).collect()}
    assert got[2] == (None, None) and got[3] == (0, "short") and got[1][1].startswith("…") and "zebra" in got[1][1]


@pytest.mark.parametrize("query,snippet,want", [
    ("event sourcing", "an >>event<< and >>sourcing<< of", "an >>event<< and >>sourcing<< of"),
    ("event", "no highlight of event here", "no highlight of event here"),
    ("event", "the event i>>s here<< and >>there<<", "the >>event<< is here and there"),
    ('"event sourcing" event', ">>of<< event sourcing, events", "of >>event sourcing<<, >>events<<"),
    ("sourc*", "a >>shifted<< sourcing source sou", "a shifted >>sourcing<< >>source<< sou"),
    ("event NOT sourcing", ">>sourcing<< of event", "sourcing of >>event<<"),
    ("event NOT (a OR sourcing) AND log", ">>a<< log event sourcing", "a >>log<< >>event<< sourcing"),
    ("event NOT NEAR(sourcing log, 5) tree", ">>log<< tree", "log >>tree<<"),
    ("NEAR(café log, 5)", "ca>>fe lo<<gs cafe cin >> x << out", "cafe logs >>cafe<< cin >> x << out"),
    ("use", "let >>us<< use it", "let us >>use<< it"),
    ("foo", ">>foo<<>>bogus<<foo bogusfoo", ">>foo<<bogus>>foo<< bogusfoo"),
    ("api", ">>apis<< >>theory<<", ">>apis<< theory"),
    ("журналы", "о >>том<< журнале", "о том >>журнале<<"),
    ("AND OR", ">>x<<", ">>x<<"),
])
def test_highlights(spark, query, snippet, want):
    assert snippets.repaired(snippet, snippets.query_units(query)) == want


def test_highlights_as_a_column(spark):
    df = spark.createDataFrame([(1, "the event i>>s here<<"), (2, None)], "id int, s string")
    assert [r.s for r in df.orderBy("id").select(snippets.repaired_snippets("s", "event").alias("s")).collect()] == ["the >>event<< is here", None]


TEXTS = {
    "the cat and the dog of it": "en", "il gatto e la volpe sono nel bosco": "en", "kissa ja koira ovat metsässä": "en", "Это было давно, и ещё было тихо. Рыба плыла.": "ru",
    "Їжак їхав у ліс, і ґава є.": "uk", "12 34 !?": None, "": None, "日本語": None, "он и она на работе": "ru", "та це або що щоб": "uk", "тут там": "ru", "a это": "ru", "abc где": "en",
    "він " * 50 + "ы": "uk", "і" * 5 + "ы" * 2 + " на работе": "ru",
}


def test_languages(spark):
    long = "the and of " * 15_000 + "это было " * 30_000 + "в лесу и " * 16_000
    texts = {**TEXTS, long: languages.language(long), "x" * 300_000 + "слово": "en"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    got = {r.id: r.lang for r in df.select("id", languages.detected("t").alias("lang")).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert got[i] == want == languages.language(t), t[:60]
    assert got[99] is None


def test_words_that_begin_otherwise_are_not_stemmed(monkeypatch):
    """A text's words are stemmed only if they begin as a sought stem, and none with such a stem is missed."""
    rng = random.Random(4)
    parts = ["", "y", "e", "s", "es", "ies", "ied", "ed", "ing", "eed", "eedly", "ingly", "ll", "tt", "ization", "ational", "fulness", "ogi", "li", "ness", "ement", "ion", "al", "e", "er"]
    endings = ["", "а", "ё", "ами", "ость", "ейше", "ившись", "ваться", "нный", "ях", "ет", "и", "ь", "ся"]
    root = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    words = [root("aeiouybdstlgnr", 4) + rng.choice(parts) + rng.choice(parts) for _ in range(8000)] + [root("аеёиоубвгдлнст", 4) + rng.choice(endings) + rng.choice(endings) for _ in range(4000)]
    words += [*stemming._SPECIAL, *stemming._KEPT, "Dying", "İng", "ΟΔΟΣ", "aΣb", "ёж1", "ЁЖ_1", "camelCase", "日本語", "K2"]
    words = sorted({w for w in words if w} | {w.title() for w in words if w})
    stems = {w: stemming.stem(w) for w in words}
    for some in (rng.sample(words, 40), list(stemming._SPECIAL), ["ёж1", "ΟΔΟΣ", "aΣb", "İng"], words):
        terms = frozenset(stems[w] for w in some if stems[w])
        assert stemming.sought(words, terms) == {w: s for w, s in stems.items() if s in terms}
        terms = frozenset(t for t in terms if len(t) >= snippets.STEM_CHARS)
        assert stemming.sought(words, terms) == {w: s for w, s in stems.items() if s in terms}
    other = (stemming.Pack("xx", "Latin", "", lambda w: w[::-1]),)
    assert stemming.sought(["raft", "node"], frozenset({"tfar"}), other) == {"raft": "tfar"}
    asked = []
    monkeypatch.setattr(stemming, "stem", lambda w, *a, **k: asked.append(w) or stems.get(w, w))
    snippets.window(" ".join(f"word{chr(97 + i % 26)}{i}" for i in range(500)) + " raft", frozenset({"raft"}))
    assert asked == ["raft"]
