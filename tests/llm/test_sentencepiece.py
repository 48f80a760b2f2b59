import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import sentencepiece as sp
from lectern.llm import textblocks as tb

spm = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.read_model(sp.MODEL))


@pytest.fixture(scope="module")
def unigram_pair(tmp_path_factory):
    """The library told to run its unigram model, and our encoder, on the same pieces.

    Scores of -1e9 become -50000: the library adds single-precision scores, which next to 1e9 no longer differ.
    """
    data = open(sp.MODEL, "rb").read().replace(struct.pack("<f", -1e9), struct.pack("<f", -5e4))
    kind = data.rfind(b"\x18\x02\x20\x80\xfa\x01")  # model_type 2, vocab_size 32000
    data = data[:kind] + b"\x18\x01" + data[kind + 2 :]
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(data)
    return spm.SentencePieceProcessor(model_proto=data), sp.Encoder(sp.read_model(str(path)))


def encoded(encoder, texts):
    (block,) = tb.blocks(pa.array(texts), 1 << 30)
    flat, counts, scores = encoder.encode_block(block)
    data, sizes = encoder.decode_flat(flat, counts)
    cuts, ends = np.cumsum(counts), np.cumsum(sizes)
    return [flat[c - n : c].tolist() for c, n in zip(cuts, counts)], scores, [data[e - n : e].tobytes().decode() for e, n in zip(ends, sizes)]


TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "tab\tand\nline", "naïve café déjà", "日本語テキスト", "emoji 😀 end", "a▁b", "x" * 500, "word " * 50, "123,456.78", "\x00\x7f", "ŁŁŁ", "internationalization" * 20]


def test_round_trip_and_equal_units(encoder):
    ids, _, back = encoded(encoder, TEXTS)
    assert back == TEXTS
    alone = [encoded(encoder, [t])[0][0] for t in TEXTS]
    assert alone == ids


def test_matches_the_library_as_unigram(unigram_pair):
    library, encoder = unigram_pair
    rng = random.Random(5)
    words = ["the", "and", "Über", "naïve", "tion", "zzqx", "日本", "a", "Inter", "x1", "don't", "😀"]
    texts = [t for t in TEXTS if "▁" not in t and len(t) < 200] + [" ".join(rng.choice(words) + rng.choice(["", ".", "ly", "!"]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    ids, _, _ = encoded(encoder, texts)
    assert ids == [library.encode(t) for t in texts]


def test_vector_and_plain_viterbi_agree(encoder):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeé ñ日😀-") for _ in range(rng.randint(1, 100))) for _ in range(300)]
    ids, scores, _ = encoded(encoder, texts)
    for t, i, s in zip(texts, ids, scores):
        plain, score = encoder._long_unit(b" " + t.encode())
        assert score == s and sum(encoder.scores[plain]) <= score + 1e9 and len(plain) == len(i)


def test_double_array_finds_exactly_its_keys():
    rng = random.Random(7)
    keys = sorted({bytes(rng.choice(b"ab\xc3\xff\x00") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = sp.DoubleArray([(k, i) for i, k in enumerate(keys)])
    for _ in range(2000):
        text = bytes(rng.choice(b"ab\xc3\xff\x00z") for _ in range(8))
        assert sorted(i for _, i in trie.matches(text)) == [i for i, k in enumerate(keys) if text.startswith(k)]


def test_rows(spark, encoder):
    df = spark.createDataFrame([(1, "Hello  world", "s"), (1, "Hello  world", "s"), (None, None, None), (3, "", "t"), (4, "▁ x\n", "u")], "doc_id long, text string, score string")
    out = sp.encode(df.select("doc_id", "text"), ["doc_id"])
    rows = out.collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows)
    assert [len(r.ids) for r in rows if r.doc_id in (None, 3)] == [0, 0]
    back = sp.decode(out, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, ""), (1, "Hello  world"), (1, "Hello  world"), (3, ""), (4, "▁ x\n")]
    assert sp.encode(df.limit(0), ["doc_id"]).count() == 0
