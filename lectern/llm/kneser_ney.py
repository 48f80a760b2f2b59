"""N-gram language model with interpolated modified Kneser-Ney smoothing, of order two or three.

Counting is distributed: tasks count a block of text with numpy, pre-aggregate,
and send packed sorted arrays by shard, so a shuffle row holds thousands of
counts.  The model is a set of sorted hash arrays in the shared folder that
scoring workers memory-map; the driver sees one row per shard.

* vocabulary: sorted 64-bit word hashes by hash range; a word's id is its place.
* bigrams: the key ``id1 << 32 | id2`` goes through a bijective mixer, so the
  sorted hashes identify bigrams exactly.  All bigrams of a context share a
  shard, but for frequent contexts, which spread over all shards; frequent means
  over 1/4 of a shard's mean share of tokens, so there are at most 4 * shards.
* contexts: how often words follow a context once, twice, thrice or more.
* continuations: in how many contexts a word was seen, dense by id.

With order three there are also

* trigrams: sorted 64-bit hashes of a pair's key and the word behind it, dealt evenly, with their counts.
* pairs: for each pair of words the total behind it, and how many follow it once, twice, thrice or more.  A pair's
  trigrams lie in all shards; each shard sends one row's worth of sums for it.

and the bigrams' counts become in how many contexts each was seen, but for those that open a text, which nothing precedes.

Everything grows with the corpus: nothing is pruned.  Tokens are the words of
the ASCII-lowered text, then one end token per document, which is also what the
first words are conditioned on.

Defined results: a null or empty text is the end token alone; repeated rows each
count and each score; null ids and other columns have no influence; an empty
table, or no training rows, gives a model without words (probability 1 for the
end of a text, base score 0).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sharedarrays as sa
from . import textblocks as tb
from .arrowmap import binary_rows, carried, map_batches, persisted, shared_dir, sorted_groups, tidy

_FLUSH = 1_500_000
_UNMIX1, _UNMIX2 = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64)), np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def unmix64(x: np.ndarray) -> np.ndarray:
    """Inverse of textblocks.mix64."""
    u = np.uint64
    x = x ^ (x >> u(31)) ^ (x >> u(62))
    x = x * _UNMIX2
    x = x ^ (x >> u(27)) ^ (x >> u(54))
    x = x * _UNMIX1
    return x ^ (x >> u(30)) ^ (x >> u(60))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> _32) * np.uint64(shards)) >> _32).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts.astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


class _Sender:
    """Gathers (key, count) pairs and gives them out as packed rows by shard once there are enough."""

    def __init__(self, shards: int, shard):
        self.shards, self.shard, self.keys, self.counts, self.n = shards, shard, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> list[dict]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        return self.flush() if self.n >= _FLUSH else []

    def flush(self) -> list[dict]:
        if not self.n:
            return []
        keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.n = [], [], 0
        shard = self.shard(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        at = np.searchsorted(shard, np.arange(self.shards + 1))
        used = np.flatnonzero(at[1:] > at[:-1])
        # Counts in as few bytes as the block's largest needs.
        width = np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65536 else np.uint32 if counts.max() < 1 << 32 else np.uint64
        small = counts.astype(width)
        return [{"shard": used.astype(np.int32), "width": np.full(len(used), small.itemsize, np.int32), "keys": [keys[at[s] : at[s + 1]].tobytes() for s in used], "counts": [small[at[s] : at[s + 1]].tobytes() for s in used]}]


_SENT = "shard int, width int, keys binary, counts binary"


def _merged(table: pa.Table, key_type) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(binary_rows(table.column("keys"), key_type))
    counts = np.concatenate([np.frombuffer(c, f"u{w}").astype(np.int64) for c, w in zip(table.column("counts").to_pylist(), table.column("width").to_pylist())])
    return _summed(keys, counts)


def _stream(df: DataFrame, per_block, schema: str, make_state) -> DataFrame:
    """mapInArrow over text blocks with a sender per task that is flushed at the task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)

    def run(batches):
        target, state = to_arrow_schema(parsed), make_state()
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                for out in per_block(state, block):
                    yield pack(out)
        for out in state.flush():
            yield pack(out)

    return df.mapInArrow(tidy(run), parsed)


def _by_shard(sent: DataFrame, shards: int, fn, schema: str) -> DataFrame:
    """Each shard's rows, whole, to fn(shard, table), which gives dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(parsed)
        for table in sorted_groups(batches, "shard"):
            for out in fn(table.column("shard")[0].as_py(), table):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(tidy(run), parsed)


@dataclass(frozen=True)
class Discounts:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""

    values: tuple[float, float, float]

    @staticmethod
    def of(n: list[int]) -> Discounts:
        n1, n2, n3, n4 = n
        if not (n1 and n2):
            return Discounts((0.5, 0.5, 0.5))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return Discounts(tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.array((0.0, *self.values))[np.minimum(counts, 3)]


@dataclass
class Model:
    """Where the arrays are, and the corpus's totals."""

    folder: str
    shards: int
    starts: list[int]  # first id of each vocabulary shard, then the number of words
    words: int  # training tokens without ends
    ends: int
    hot: np.ndarray  # sorted ids of frequent contexts
    hot_follow: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    types: int = 0  # distinct bigrams
    order: int = 2
    trigram: Discounts = Discounts((0.5, 0.5, 0.5))
    bigram: Discounts = Discounts((0.5, 0.5, 0.5))
    unigram: Discounts = Discounts((0.5, 0.5, 0.5))
    spare: float = 1.0  # mass that continuation discounting leaves to all words alike

    @property
    def size(self) -> int:
        return self.starts[-1]

    @property
    def tokens(self) -> int:
        return self.words + self.ends

    @property
    def distinct(self) -> int:
        return self.size + (self.ends > 0)

    @property
    def part_width(self) -> int:
        return max(1, -(-(self.size + 1) // self.shards))

    # ids: 0 to size - 1 are words, size is the end token, -1 an unknown word

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        unique, back = np.unique(hashes, return_inverse=True)
        shard = shard_of(unique, self.shards)
        at = np.searchsorted(shard, np.arange(self.shards + 1))
        out = np.full(len(unique), -1, np.int64)
        for s in np.flatnonzero(at[1:] > at[:-1]):
            if self.starts[s + 1] > self.starts[s]:
                part, known = unique[at[s] : at[s + 1]], sa.load(self.folder, f"words-{s}")
                place = np.searchsorted(known, part)
                place[place == len(known)] = 0
                out[at[s] : at[s + 1]] = np.where(known[place] == part, place + self.starts[s], -1)
        return out[back]

    def sequence(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens of a block, an end after each row's words; and the tokens of each row."""
        lowered = tb.LOWER[block.data]
        s, e, counts = tb.words(tb.Block(block.lo, block.hi, lowered, block.starts, block.ends, block.valid))
        ids = self.ids(tb.span_hashes(lowered, s, e))
        return np.insert(ids, np.cumsum(counts), self.size), counts + 1

    def bigram_shard(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        first = (keys >> _32).astype(np.int64)
        shard = shard_of(tb.mix64(first.astype(np.uint64) + np.uint64(1)), self.shards)
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            shard = np.where(self.hot[place] == first, shard_of(mixed, self.shards), shard)
        return shard

    def _gather(self, name: str, ids: np.ndarray, dtype, starts: np.ndarray) -> np.ndarray:
        """Values at ids of arrays that are dense by id; ids are any, known ones."""
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        at = np.searchsorted(sorted_ids, starts)
        out = np.zeros(len(ids), dtype)
        for p in np.flatnonzero(at[1:] > at[:-1]):
            out[order[at[p] : at[p + 1]]] = sa.load(self.folder, f"{name}-{p}")[sorted_ids[at[p] : at[p + 1]] - starts[p]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        word = (ids >= 0) & (ids < self.size)
        out[word] = self._gather("counts", ids[word], np.int64, np.array(self.starts))
        out[ids == self.size] = self.ends
        return out

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = ids >= 0
        edges = np.minimum(np.arange(self.shards + 1) * self.part_width, self.size + 1)
        out[known] = self._gather("continuations", ids[known], np.int64, edges)
        return out

    def _sorted_lookup(self, keys: np.ndarray, shard: np.ndarray, names: list[str]) -> list[np.ndarray]:
        """Values beside keys in the shards' sorted arrays; 0 where a key is absent."""
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        at = np.searchsorted(shard, np.arange(self.shards + 1))
        out = [np.zeros(len(keys), np.int64) for _ in names[1:]]
        for s in np.flatnonzero(at[1:] > at[:-1]):
            known = sa.load(self.folder, f"{names[0]}-{s}")
            if len(known):
                part = keys[at[s] : at[s + 1]]
                place = np.searchsorted(known, part)
                place[place == len(known)] = 0
                hit = known[place] == part
                for o, name in zip(out, names[1:]):
                    o[at[s] : at[s + 1]] = np.where(hit, sa.load(self.folder, f"{name}-{s}")[place], 0)
        return [_scattered(o, order) for o in out]

    def _bigram_probability(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        low = self.continuations(second)
        p = np.maximum(low - self.unigram(low), 0) / max(self.types, 1) + self.spare / (self.distinct + 1 if self.distinct else 1)
        context, both = first >= 0, (first >= 0) & (second >= 0)
        seen, seen_back = np.unique(first[context], return_inverse=True)
        names = ["contexts", "follow1", "follow2", "follow3"] + (["behind"] if self.order > 2 else [])
        follow = self._sorted_lookup(seen, shard_of(tb.mix64(seen.astype(np.uint64) + np.uint64(1)), self.shards), names)
        follow = np.stack(follow, 1).astype(float)
        if len(self.hot) and len(seen):
            place = np.minimum(np.searchsorted(self.hot, seen), len(self.hot) - 1)
            hit = self.hot[place] == seen
            follow[hit] = self.hot_follow[place[hit], : follow.shape[1]]
        total = (follow[:, 3] if self.order > 2 else self.counts(seen).astype(float))[seen_back]
        left = (follow[:, :3] @ np.array(self.bigram.values))[seen_back]
        keys, back = np.unique(_pair(first[both], second[both]), return_inverse=True)
        mixed = tb.mix64(keys)
        (found,) = self._sorted_lookup(mixed, self.bigram_shard(keys, mixed), ["bigrams", "times"])
        c = np.zeros(len(first), np.int64)
        c[both] = found[back]
        c = c[context]
        ok = total > 0
        p[context] = np.where(ok, (np.maximum(c - self.bigram(c), 0) + left * p[context]) / np.where(ok, total, 1), p[context])
        return p

    def probability(self, ids: np.ndarray) -> np.ndarray:
        """Of each token of a block, whose rows all end in an end token, after the ones before it."""
        first, before = contexts(ids, self.size)
        p = self._bigram_probability(first, ids)
        if self.order < 3:
            return p
        known = np.flatnonzero((before >= 0) & (first >= 0))
        pairs, back = np.unique(_pair(before[known], first[known]), return_inverse=True)
        mixed = tb.mix64(pairs)
        stats = np.stack(self._sorted_lookup(mixed, shard_of(mixed, self.shards), ["pairs", "pair_total", "pair1", "pair2", "pair3"]), 1).astype(float)[back]
        hashes, place = np.unique(_triple(pairs[back], ids[known]), return_inverse=True)
        (found,) = self._sorted_lookup(hashes, shard_of(hashes, self.shards), ["trigrams", "trigram_times"])
        c = np.where(ids[known] >= 0, found[place], 0)
        total, left = stats[:, 0], stats[:, 1:] @ np.array(self.trigram.values)
        ok = total > 0
        p[known] = np.where(ok, (np.maximum(c - self.trigram(c), 0) + left * p[known]) / np.where(ok, total, 1), p[known])
        return p


def contexts(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and the one before that; the end token stands before a row's first, twice."""
    first = np.concatenate(([end], ids[:-1]))
    before = np.concatenate(([end], first[:-1]))
    return first, np.where(first == end, end, before)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << _32 | b.astype(np.uint64)


def _triple(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    return tb.mix64(tb.mix64(pair) + (third.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _scattered(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def train(df: DataFrame, text: str = "text", folder: str | None = None, order: int = 2) -> Model:
    """Counts a corpus and writes the model's arrays."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = df.sparkSession
    folder = folder or shared_dir(spark, "lm")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(text)

    class Words(_Sender):
        ends = 0

        def flush(self):
            ends, self.ends = self.ends, 0
            return super().flush() + ([{"shard": [-1], "width": [8], "keys": [b""], "counts": [np.array([ends]).tobytes()]}] if ends else [])

    def count_words(state, block):
        lowered = tb.LOWER[block.data]
        s, e, _ = tb.words(tb.Block(block.lo, block.hi, lowered, block.starts, block.ends, block.valid))
        state.ends += len(block.starts)
        hashes, counts = np.unique(tb.span_hashes(lowered, s, e), return_counts=True)
        return state.add(hashes, counts)

    def keep_words(shard, table):
        if shard < 0:
            ends = int(sum(x[0] for x in binary_rows(table.column("counts"), np.int64)))
            yield {"shard": [-1], "n": [0], "total": [ends], "hot_at": [b""], "hot_n": [b""]}
            return
        hashes, counts = _merged(table, np.uint64)
        sa.save(folder, f"words-{shard}", hashes)
        sa.save(folder, f"counts-{shard}", counts)
        # A shard's most frequent words are the only ones that can be frequent in the corpus.
        top = np.argsort(-counts, kind="stable")[: 4 * shards]
        top = np.sort(top[counts[top] * 4 * shards >= counts.sum()])
        yield {"shard": [shard], "n": [len(hashes)], "total": [int(counts.sum())], "hot_at": [top.astype(np.int64).tobytes()], "hot_n": [counts[top].tobytes()]}

    sent = _stream(texts, count_words, _SENT, lambda: Words(shards, lambda h: shard_of(h, shards)))
    rows = _by_shard(sent, shards, keep_words, "shard int, n long, total long, hot_at binary, hot_n binary").collect()
    sizes, words, ends = np.zeros(shards, np.int64), 0, 0
    for r in rows:
        if r.shard < 0:
            ends += r.total
        else:
            sizes[r.shard] = r.n
            words += r.total
    starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    if starts[-1] >= 1 << 32:
        raise ValueError("the vocabulary has 2**32 words or more")
    often = [(starts[r.shard] + a, n) for r in rows if r.shard >= 0 for a, n in zip(np.frombuffer(r.hot_at, np.int64).tolist(), np.frombuffer(r.hot_n, np.int64).tolist())]
    hot = {i for i, n in often if n * 4 * shards > words + ends} | ({starts[-1]} if ends * 4 * shards > words + ends else set())
    model = Model(folder, shards, starts, words, ends, np.array(sorted(hot), np.int64), order=order)

    def count_bigrams(state, block):
        ids, lengths = model.sequence(block)
        # The end token before a row's first word is the one that closes the row before, or opens the block.
        keys, counts = np.unique(_pair(contexts(ids, model.size)[0], ids), return_counts=True)
        return state.add(keys, counts) if len(lengths) else []

    part = model.part_width

    def keep_bigrams(shard, table):
        keys, counts = _merged(table, np.uint64)
        mixed = tb.mix64(keys)
        order = np.argsort(mixed)
        sa.save(folder, f"bigrams-{shard}", mixed[order])
        sa.save(folder, f"times-{shard}", counts[order].astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
        first, second = (keys >> _32).astype(np.int64), (keys & _LOW).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        heads = first[at]
        follow = [np.add.reduceat((counts == k).astype(np.int64) if k < 3 else (counts >= 3).astype(np.int64), at) for k in (1, 2, 3)]
        behind = np.add.reduceat(counts, at)
        is_hot = np.isin(heads, model.hot)
        sa.save(folder, f"contexts-{shard}", heads[~is_hot])
        if model.order > 2:
            sa.save(folder, f"behind-{shard}", behind[~is_hot])
        for k in (1, 2, 3):
            sa.save(folder, f"follow{k}-{shard}", follow[k - 1][~is_hot].astype(np.uint32))
        ids, n = np.unique(second, return_counts=True)
        of = ids // part
        at = np.searchsorted(of, np.arange(shards + 1))
        used = np.flatnonzero(at[1:] > at[:-1])
        small = n.astype(np.uint16 if n.max() < 65536 else np.uint32)
        # What follows frequent contexts is summed over shards: one packed row, as for the totals.
        hot_follow = np.stack([*follow, behind], 1)[is_hot]
        totals = np.array([len(keys), *((counts == k).sum() for k in (1, 2, 3, 4))], np.int64)
        yield {
            "shard": [*used.tolist(), -1, -2],
            "width": [small.itemsize] * len(used) + [0, 0],
            "keys": [ids[at[s] : at[s + 1]].astype(np.uint32).tobytes() for s in used] + [heads[is_hot].tobytes(), np.int64(shard).tobytes()],
            "counts": [small[at[s] : at[s + 1]].tobytes() for s in used] + [hot_follow.astype(np.int64).tobytes(), totals.tobytes()],
        }

    def keep_continuations(shard, table):
        if shard == -1:
            ids = np.concatenate(binary_rows(table.column("keys"), np.int64))
            values = np.concatenate(binary_rows(table.column("counts"), np.int64)).reshape(-1, 4)
            unique, back = np.unique(ids, return_inverse=True)
            total = np.zeros((len(unique), 4), np.int64)
            np.add.at(total, back, values)
            yield {"kind": [-1], "a": [unique.tobytes()], "b": [total.tobytes()]}
        elif shard == -2:
            yield {"kind": [-2], "a": [b"".join(table.column("keys").to_pylist())], "b": [np.sum(binary_rows(table.column("counts"), np.int64), 0).astype(np.int64).tobytes()]}
        else:
            ids, n = _merged(table, np.uint32)
            dense = np.zeros(min(part, model.size + 1 - shard * part), np.uint32)
            dense[ids.astype(np.int64) - shard * part] = n
            sa.save(folder, f"continuations-{shard}", dense)
            yield {"kind": [0], "a": [b""], "b": [np.array([*((dense == k).sum() for k in (1, 2, 3, 4)), (dense > 2).sum()], np.int64).tobytes()]}

    if model.ends:
        sent = _stream(texts, count_bigrams, _SENT, lambda: _Sender(shards, lambda k: model.bigram_shard(k, tb.mix64(k)))) if order == 2 else _trigrams(model, texts)
        counted = _by_shard(sent, shards, keep_bigrams, _SENT)
        rows = _by_shard(counted, shards, keep_continuations, "kind int, a binary, b binary").collect()
        summed = next(r for r in rows if r.kind == -2)
        empty_shards(model, set(np.frombuffer(summed.a, np.int64).tolist()))
        totals = np.frombuffer(summed.b, np.int64)
        model.types, model.bigram = int(totals[0]), Discounts.of(totals[1:].tolist())
        low = np.sum([np.frombuffer(r.b, np.int64) for r in rows if r.kind == 0], 0)
        model.unigram = Discounts.of(low[:4].tolist())
        d = model.unigram.values
        model.spare = float(d[0] * low[0] + d[1] * low[1] + d[2] * low[4]) / model.types
        model.hot_follow = np.zeros((len(model.hot), 4))
        for r in rows:
            if r.kind == -1:
                at = np.searchsorted(model.hot, np.frombuffer(r.a, np.int64))
                model.hot_follow[at] = np.frombuffer(r.b, np.int64).reshape(-1, 4)
    return model


_TRIPLES = "shard int, keys binary, thirds binary, counts binary"


class _Triples:
    """Gathers (pair, third, count) and gives them out by shard of the trigram's hash."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.n = shards, [], 0

    def add(self, pairs: np.ndarray, thirds: np.ndarray, counts: np.ndarray) -> list[dict]:
        self.parts.append((pairs, thirds.astype(np.uint32), counts.astype(np.int64)))
        self.n += len(pairs)
        return self.flush() if self.n >= _FLUSH else []

    def flush(self) -> list[dict]:
        if not self.n:
            return []
        pairs, thirds, counts = _triples_summed(*map(np.concatenate, zip(*self.parts)))
        self.parts, self.n = [], 0
        shard = shard_of(_triple(pairs, thirds), self.shards)
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange(self.shards + 1))
        used = np.flatnonzero(at[1:] > at[:-1])
        cut = lambda x: [x[order[at[s] : at[s + 1]]].tobytes() for s in used]
        return [{"shard": used.astype(np.int32), "keys": cut(pairs), "thirds": cut(thirds), "counts": cut(counts.astype(np.uint32))}]


def _triples_summed(pairs: np.ndarray, thirds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((thirds, pairs))
    pairs, thirds = pairs[order], thirds[order]
    at = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (thirds[1:] != thirds[:-1]))))
    return pairs[at], thirds[at], np.add.reduceat(counts[order], at)


def _trigrams(model: Model, texts: DataFrame) -> DataFrame:
    """Writes the trigrams' and pairs' arrays; gives the bigrams with the number of their contexts, as rows of counted bigrams are."""
    spark, folder, shards = texts.sparkSession, model.folder, model.shards

    def count(state, block):
        ids, lengths = model.sequence(block)
        first, before = contexts(ids, model.size)
        ones = np.ones(len(ids), np.int64)
        return state.add(*_triples_summed(_pair(before, first), ids.astype(np.uint32), ones)) if len(lengths) else []

    def keep(shard, table):
        pairs = np.concatenate(binary_rows(table.column("keys"), np.uint64))
        thirds = np.concatenate(binary_rows(table.column("thirds"), np.uint32))
        counts = np.concatenate(binary_rows(table.column("counts"), np.uint32)).astype(np.int64)
        pairs, thirds, counts = _triples_summed(pairs, thirds, counts)
        hashes = _triple(pairs, thirds)
        order = np.argsort(hashes)
        width = np.uint16 if counts.max() < 65536 else np.uint32 if counts.max() < 1 << 32 else np.uint64
        sa.save(folder, f"trigrams-{shard}", hashes[order])
        sa.save(folder, f"trigram_times-{shard}", counts[order].astype(width))
        at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        sums = np.stack([np.add.reduceat(x, at) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1).astype(np.int64)
        heads = pairs[at]
        where = shard_of(tb.mix64(heads), shards)
        # A bigram that opens a text has no context but the end token: its count stands for their number.
        bigrams = (pairs & _LOW) << _32 | thirds.astype(np.uint64)
        opening = (pairs & _LOW) == np.uint64(model.size)
        low, n = _summed(bigrams, np.where(opening, counts, 1))
        to = model.bigram_shard(low, tb.mix64(low))
        totals = np.array([*((counts == k).sum() for k in (1, 2, 3, 4))], np.int64)
        out = {"kind": [], "shard": [], "keys": [], "values": []}
        for kind, keys, values, target in ((0, heads, sums, where), (1, low, n, to)):
            order = np.argsort(target, kind="stable")
            cuts = np.searchsorted(target[order], np.arange(shards + 1))
            for t in np.flatnonzero(cuts[1:] > cuts[:-1]):
                part = order[cuts[t] : cuts[t + 1]]
                out["kind"].append(kind)
                out["shard"].append(int(t))
                out["keys"].append(keys[part].tobytes())
                out["values"].append(np.ascontiguousarray(values[part]).astype(np.int64).tobytes())
        out["kind"].append(2)
        out["shard"].append(-1)
        out["keys"].append(np.int64(shard).tobytes())
        out["values"].append(totals.tobytes())
        yield out

    def keep_pairs(shard, table):
        keys = np.concatenate(binary_rows(table.column("keys"), np.uint64))
        values = np.concatenate(binary_rows(table.column("values"), np.int64)).reshape(-1, 4)
        unique, back = np.unique(tb.mix64(keys), return_inverse=True)
        total = np.zeros((len(unique), 4), np.int64)
        np.add.at(total, back, values)
        sa.save(folder, f"pairs-{shard}", unique)
        for i, name in enumerate(("pair_total", "pair1", "pair2", "pair3")):
            width = np.uint16 if total[:, i].max() < 65536 else np.uint32 if total[:, i].max() < 1 << 32 else np.uint64
            sa.save(folder, f"{name}-{shard}", total[:, i].astype(width))
        yield {"shard": [shard]}

    sent = _stream(texts, count, _TRIPLES, lambda: _Triples(shards))
    kept = persisted(_by_shard(sent, shards, keep, "kind int, shard int, keys binary, `values` binary"), folder, "kept")
    sums = kept.where("kind = 2").select("keys", "values").collect()
    pairs = _by_shard(kept.where("kind = 0").select("shard", "keys", "values"), shards, keep_pairs, "shard int").collect()
    model.trigram = Discounts.of(np.sum([np.frombuffer(r["values"], np.int64) for r in sums], 0).tolist())
    have = ({int(np.frombuffer(r["keys"], np.int64)[0]) for r in sums}, {r.shard for r in pairs})
    for written, names in zip(have, (("trigrams", "trigram_times"), ("pairs", "pair_total", "pair1", "pair2", "pair3"))):
        for s in set(range(shards)) - written:
            for name in names:
                sa.save(folder, f"{name}-{s}", np.zeros(0, np.uint64 if name in ("trigrams", "pairs") else np.int64))
    return kept.where("kind = 1").select("shard", F.lit(8).alias("width"), "keys", F.col("values").alias("counts"))


def empty_shards(model: Model, written: set[int]) -> None:
    """Shards that got no rows still get arrays, so a reader needs no case for them."""
    for s in set(range(model.shards)) - written:
        for name in ("bigrams", "times", "contexts", "follow1", "follow2", "follow3", *(["behind"] if model.order > 2 else [])):
            sa.save(model.folder, f"{name}-{s}", np.zeros(0, np.uint64 if name == "bigrams" else np.int64))


def score(df: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """Carried columns, n_tokens, n_known, base_score (add-one unigrams) and score, all log10."""
    carry, schema = carried(df, carry, "n_tokens long, n_known long, base_score double, score double")
    floor = np.log10(model.tokens + model.distinct + 1)

    def run(batch: pa.RecordBatch):
        for block in tb.blocks(batch.column(0)):
            ids, lengths = model.sequence(block)
            unique, back = np.unique(ids, return_inverse=True)
            counts = model.counts(unique)[back]
            at = np.cumsum(lengths) - lengths
            logs = np.log10(model.probability(ids)) if model.ends else np.zeros(len(ids))
            out = {c: batch.column(i + 1).slice(block.lo, block.hi - block.lo) for i, c in enumerate(carry)}
            yield out | {"n_tokens": lengths, "n_known": np.add.reduceat((counts > 0).astype(np.int64), at), "base_score": np.add.reduceat(np.log10(counts + 1.0) - floor, at), "score": np.add.reduceat(logs, at)}

    return map_batches(df.select(text, *carry), run, schema)


def perplexity(score_column: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_column / tokens)
