import random

import corpus_pipeline
from lectern.llm import rules

from .helpers import WORD, near_components


def corpus(rng):
    line = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(k))
    rows, passage = [], line(60)
    for i in range(60):
        text = "\n".join(line(rng.randint(8, 40)) for _ in range(rng.randint(2, 6)))
        if i % 7 == 0:
            text += "\n" + passage
        if i % 11 == 0:
            text = "### " * 80
        if i % 13 == 5:
            text = rows[0][1] + "\n" + line(3)
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(text)))
    return [*rows, (60, rows[0][1], "en", "a", 5), (61, None, None, None, None), (62, "", "en", "b", 0)]


def test_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(corpus(random.Random(1)), schema)
    before, frame = {r.doc_id: r for r in docs.collect()}, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "")
        kept[name] = frame.collect()
        if name != "sentencepiece":
            assert frame.columns == docs.columns
        frame = spark.createDataFrame(kept[name], frame.schema)
    good = {r.doc_id for r in rules.apply_policy(rules.ledger(docs), rules.STANDARD).collect()}
    assert {r.doc_id for r in kept["quality_rules"]} == good
    passages = [r.doc_id for r in kept["line_dedup"] if r.doc_id % 7 == 0 and before[r.doc_id].text.split("\n")[-1] in r.text]
    assert len(passages) == 1 and 60 not in {r.doc_id for r in kept["line_dedup"]}
    want, _ = near_components([(r.doc_id, r.text) for r in kept["line_dedup"]])
    assert {r.doc_id for r in kept["near_duplicates"]} == {d for d, c in want.items() if d == c}
    assert {r.doc_id for r in kept["mix_sources"]} <= {r.doc_id for r in kept["near_duplicates"]}
    assert len(kept["sentencepiece"]) == len(kept["mix_sources"]) and all(r.round_trip and r.n_pieces >= len(WORD.findall("x")) for r in kept["sentencepiece"])


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "")
    assert frame.count() == 0
