"""Exact token counts of a byte-level BPE, from lengths of pre-tokens in two tiers.

A pre-token (a word with its blank, a run of digits, signs or blanks) always gives the
same tokens, so a text's count is the sum of its pre-tokens' lengths.  The first tier is
a hash table of the most frequent pre-tokens' lengths, which is broadcast: at most
FREQUENT entries of at most MAX_CHARS characters.  Which pre-tokens are frequent is read
off a random sample of about SAMPLE_ROWS documents, of which each task sends its KEEP
most frequent; the sample decides which tier answers, never what the answer is.  A miss
goes to the worker's own cache, the second tier (two generations of CACHE entries, which
tasks of one worker share), and from there to the encoder.  Pre-tokens are never
shuffled: a count is one map over the documents.

The pre-token pattern runs in Python's ``regex``, whose Unicode tables are newer than the
tokenizer's.  A piece of text with a character outside KNOWN, where the two agree on every
code point, is cut by the tokenizer's own pre-tokenizer instead.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special
tokens inside a text count one token each, as the tokenizer does by default; bytes that are no
UTF-8 count as U+FFFD in tokens and as themselves in bytes; rows that repeat and rows of null id are rows like any
other; whole texts are counted, PIECE characters at a time, cut where a pre-token ends; a
carried column of an output's name gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import carried, map_batches, tidy

LIMIT = 512
FREQUENT, KEEP, SAMPLE_ROWS = 16_384, 4_096, 2_000
CACHE, MAX_CHARS, PIECE = 65_536, 64, 1 << 18
#: Splits a text before the merges (fixed, as published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin, Greek, Cyrillic; punctuation, currency; kana, ideographs, Hangul, full-width forms.
KNOWN = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF)))
_CUT = regex.compile(r"[!-~](?= )")


@dataclass
class Encoder:
    """The tokenizer file's text, and what a worker makes of it."""

    source: str

    def __post_init__(self):
        spec = json.loads(self.source)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        if not plain or spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("a byte-level BPE without normalizer, prefix blank and dropout is needed")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in blanks or ask for word ends are not supported")
        # Of added tokens that start at one place the longest is taken.
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    @cached_property
    def _pattern(self):
        return regex.compile(PATTERN)

    @cached_property
    def _foreign(self):
        return regex.compile(f"[^{KNOWN}]")

    def length(self, token: str) -> int:
        return len(self.tokenizer.encode(token, add_special_tokens=False))

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and their number."""
        parts = self.added.split(text) if self.added else [text]
        return parts, len(parts) - 1

    def pretokens(self, piece: str) -> Iterator[str]:
        if piece.isascii() or not self._foreign.search(piece):
            # What can't be cut stays an iterator, so its list does not outgrow a piece.
            return iter(self._pattern.findall(piece)) if len(piece) <= 2 * PIECE else (m.group() for m in self._pattern.finditer(piece))
        return (piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts between a printable ASCII character and a blank; every pre-token ends there, whatever stands around it."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


@dataclass
class Lengths(dict):
    """Pre-token to tokens: the frequent ones are the dict's own items, others come from two generations of recent ones."""

    encoder: Encoder
    frequent: dict[str, int]
    room: int = CACHE
    young: dict[str, int] = field(default_factory=dict)
    old: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.update(self.frequent)

    def __missing__(self, token: str) -> int:
        n = self.young.get(token)
        if n is None:
            n = self.old.get(token)
            if n is None:
                n = self.encoder.length(token)
            if len(token) <= MAX_CHARS:
                if len(self.young) >= self.room:
                    self.old, self.young = self.young, {}
                self.young[token] = n
        return n

    def count(self, text: str) -> int:
        parts, total = self.encoder.parts(text)
        for part in parts:
            for piece in pieces(part):
                total += sum(map(self.__getitem__, self.encoder.pretokens(piece)))
        return total


_workers: dict[str, Lengths] = {}


def _lengths(shared) -> Lengths:
    """This worker's tables; they live as long as tasks ask for the same broadcast."""
    name, source, frequent = shared.value
    if name not in _workers:
        _workers.clear()
        _workers[name] = Lengths(Encoder(source), frequent)
    return _workers[name]


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def encoder(path: str | None = None) -> Encoder:
    """Reads a tokenizer file at the driver; executors get its text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return Encoder(f.read())


def frequent_lengths(df: DataFrame, enc: Encoder, text: str = "text", entries: int = FREQUENT, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, int]:
    """Lengths of the ``entries`` most frequent pre-tokens of a sample of about ``sample_rows`` documents."""
    share, source = sample_rows / max(1, df.select().count()), enc.source
    some = df.select(text) if share >= 1 else df.select(text).sample(share, seed)

    def tally(batches):
        mine, counts = Encoder(source), Counter()
        for batch in batches:
            for x in _texts(batch.column(0)):
                for part in mine.parts(x)[0]:
                    for piece in pieces(part):
                        counts.update(t for t in mine.pretokens(piece) if len(t) <= MAX_CHARS)
                if len(counts) > 8 * KEEP:
                    counts = Counter(dict(counts.most_common(4 * KEEP)))
        top = counts.most_common(KEEP)
        yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    total: Counter = Counter()
    for batch in some.mapInArrow(tidy(tally), "token string, n long").toArrow().to_batches():
        for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[t] += n
    best = sorted(total, key=lambda t: (-total[t], t))[:entries]
    return {t: enc.length(t) for t in best}


def counted(df: DataFrame, enc: Encoder, frequent: dict[str, int], carry: list[str], text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Carried columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""
    carry, schema = carried(df, carry, "n_bytes long, n_tokens long, over_limit boolean")
    spark: SparkSession = df.sparkSession
    name = f"{spark.sparkContext.applicationId}-{id(frequent)}-{hash(enc.source)}"
    shared = spark.sparkContext.broadcast((name, enc.source, frequent))

    def run(batch: pa.RecordBatch):
        lengths = _lengths(shared)
        n = [lengths.count(x) for x in _texts(batch.column(0))]
        yield {c: batch.column(i + 2) for i, c in enumerate(carry)} | {"n_bytes": batch.column(1), "n_tokens": n, "over_limit": [x > limit for x in n]}

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_t_bytes")
    return map_batches(df.select(text, size, *carry), run, schema)
