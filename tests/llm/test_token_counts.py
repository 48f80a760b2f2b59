"""Token counts against the library that the vocabulary belongs to."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import queries, token_counts as tc

PIECES = ["the", " The", "\n", "\n\n", "  ", "\t", "'s", "'ll", "''s", "!'", "...", "1234", " 56", "\u00e9", "\u00df", "\u65e5\u672c", " \u041f\u0440", "\U0001f44d\U0001f3fd"]
PIECES += ["<|endoftext|>", "<|endof", "\u00a0", "\u2028", "\x1c", "\x85", "\u2177", "\u0531", "\u0558", "\ua48f\ua7d2x", "\U00010940", "e\u0301", "\ufffd", "\ufb01", "-", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    return [None, "", " ", "<|endoftext|>", *made, "x" * 3000, " ".join(f"w{i * 37 % 1009}" for i in range(120_000)), "no-blank" * 100_000, "é " * 200_000]


def test_counts_equal_the_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "null id", "c"), (7, "again", "c"), (7, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    enc = tc.encoder()
    for frequent in ({}, tc.frequent_lengths(df, enc, entries=200), tc.frequent_lengths(df, enc, sample_rows=50)):
        got = tc.counted(df, enc, frequent, ["doc_id", "text", "n_bytes"]).collect()
        assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
        for r in got:
            n = plain(library, r.text)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512), r.text[:80]


def test_known_characters_are_cut_alike(library):
    enc = tc.encoder()
    for cp in [*range(0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0), *range(0x3000, 0x3100), *range(0xFF00, 0xFFF0), *range(0x4E00, 0x9FA6, 7), *range(0xAC00, 0xD7A4, 7)]:
        for s in (f"a{chr(cp)}1", f"1{chr(cp)}!", f"!{chr(cp)} ", f" {chr(cp)}a"):
            assert not enc._foreign.search(s)
            assert list(enc.pretokens(s)) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)]


def test_pieces_join_to_the_text(library):
    text = " ".join(random.Random(1).choice(PIECES) + "x" for _ in range(4000))
    cut = list(tc.pieces(text, 50))
    assert "".join(cut) == text and len(cut) > 100
    assert sum(plain(library, p) for p in cut) == plain(library, text)


def test_cache_forgets_but_stays_right(library):
    lengths = tc.Lengths(tc.encoder(), {" word": 1}, room=5)
    words = [f" tok{i}" for i in range(40)] * 2
    assert [lengths[w] for w in words] == [plain(library, w) for w in words]
    assert len(lengths.young) <= 5 and len(lengths.old) <= 5 and list(lengths) == [" word"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    enc = tc.encoder()
    assert tc.counted(df, enc, tc.frequent_lengths(df, enc), ["doc_id"]).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:200])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, str(tmp_path)).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: plain(library, t) for i, t in rows}
