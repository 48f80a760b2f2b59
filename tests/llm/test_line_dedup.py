import random
import re

from pyspark.sql import functions as F

from lectern.llm import line_dedup as ld

W = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_lines(docs, words):
    """Brute force: (doc, line) that lie in a run of so many words which occurred before."""
    seen, out = {}, set()
    for d, text in sorted(docs):
        lines = [(p, x.strip(" \t\x0b\x0c\r"), len(W.findall(x))) for p, x in enumerate(text.split("\n")) if W.search(x)]
        n = len(lines)
        for i in range(n):
            total = 0
            for j in range(i, n):
                total += lines[j][2]
                if total >= words:
                    run = tuple(x for _, x, _ in lines[i : j + 1])
                    if run in seen:
                        out.update((d, p) for p, _, _ in lines[i : j + 1])
                    else:
                        seen[run] = (d, i)
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    line = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    passages = [[line(rng.randint(1, 60)) for _ in range(rng.randint(1, 8))] for _ in range(8)]
    common = line(9)
    docs = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) - 1)
                lines += p[a : rng.randint(a, len(p)) + 1]
            elif kind < 0.6:
                lines += [common, ""]
            else:
                lines.append(line(rng.randint(0, 30)))
        docs.append((d, "\n".join(lines)))
    return docs


def test_brute_force(spark):
    for seed in (1, 2, 3):
        docs = corpus(seed)
        got = {r.doc_id: r for r in ld.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        must, may = repeated_lines(docs, ld.RUN_WORDS), repeated_lines(docs, ld.GRAM_WORDS)
        for d, text in docs:
            lines = text.split("\n")
            kept = got[d].text.split("\n") if got[d].text else []
            worded = [x for x in kept if W.search(x)]
            sure = [x for p, x in enumerate(lines) if W.search(x) and (d, p) not in may]
            possible = [x for p, x in enumerate(lines) if W.search(x) and (d, p) not in must]
            it = iter(worded)
            assert all(x in it for x in sure)
            it = iter(possible)
            assert all(x in it for x in worded)
            assert got[d].n_lines - got[d].n_removed == len(worded)


def test_defined_results(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (None, None, None), (None, long, "b"), (2, "", "c"), (3, f"own line\n{long}\n\nend", "d"), (4, "short", "e"), (5, "short", "e")]
    out = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string, lines string"))
    assert out.columns == ["doc_id", "text", "lines", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or -1, r.text, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(-1, None, 0), (-1, long, 0), (1, "", 1), (1, "", 1), (2, "", 0), (3, "own line\n\nend", 1), (4, "short", 0), (5, "short", 0)], key=str)
    assert ld.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_copies_take_linear_time(spark):
    """Two copies of one text of 5 MB: the probe that a join of all lines to each gram takes minutes for at a fifth of it."""
    import time

    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(8)) for i in range(90_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nown line of the second one")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in ld.dedup(df).collect()}
    assert got == {1: (90_000, 0), 2: (90_001, 90_000)} and time.time() - began < 240


def test_shorter_limits(spark):
    docs = [(1, "one two three four five\nsix seven"), (2, "other\none two three four five\nsix seven")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.text for r in ld.dedup(df, gram_words=3, run_words=5).orderBy("doc_id").collect()] == [docs[0][1], "other"]
    assert [r.n_removed for r in ld.dedup(df).collect()] == [0, 0]


def test_no_python_in_the_plan(spark):
    plan = ld.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string")).select(F.sum("n_removed"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
