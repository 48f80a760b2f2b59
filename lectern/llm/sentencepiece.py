"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

Pieces and their log scores come from a model file; the best segmentation has
the largest sum of scores.  A character that no single piece covers costs the
least score minus 10 and becomes byte pieces.  A space is the whitespace marker
inside pieces (one byte in the trie), a text gets one marker in front, and
decoding turns markers into spaces and drops that first one.  A literal U+2581 in a text
goes to byte pieces, so decoding an encoding gives any text back.

No piece of such models spans the start of a run of markers, nor holds a
character that is in no piece, so texts fall apart there into units without
changing the optimum (if a model has such pieces, texts stay whole).  Equal units
of a block are segmented once, all at the same time: trie steps and Viterbi
relaxations are numpy operations over units.  Units of over LONG bytes go through
the same trie one by one.

Defined results: a null or empty text has no ids; ids of null decode to null;
repeated rows and null ids of documents pass through, and so do carried columns, but one of
an output's name gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .arrowmap import carried, map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LONG = 128
BLOCK = 2 << 20
_UNKNOWN_PENALTY = 10.0
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) of a SentencePiece model file, in order of ids."""
    pieces = []
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 3 and dict(_fields(value)).get(2):
            raise ValueError("models with a character map are not supported")
    return pieces


class DoubleArray:
    """A byte trie: the child of node s by byte c is base[s] + c + 1 if check there is s; value holds a piece's id or -1."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        tree: list[dict] = [{}]
        value = [-1]
        for key, number in entries:
            node = 0
            for c in key:
                node = tree[node].setdefault(c, len(tree))
                if node == len(tree):
                    tree.append({})
                    value.append(-1)
            value[node] = number
        size = 2 * len(tree) + 1024
        used = np.zeros(size, bool)
        used[0] = True
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        out = np.full(size, -1, np.int64)
        place, free, start_at, stack = {0: 0}, 1, 0, [0]
        while stack:
            node = stack.pop()
            at = place.pop(node)
            out[at] = value[node]
            codes = np.array(sorted(tree[node]), np.int64) + 1
            if not len(codes):
                continue
            if start_at + 1024 >= len(used) or free + 1024 >= len(used):
                grow = len(used)
                used, base = np.concatenate((used, np.zeros(grow, bool))), np.concatenate((base, np.zeros(grow, np.int64)))
                check, out = np.concatenate((check, np.full(grow, -1))), np.concatenate((out, np.full(grow, -1)))
            # Single children fill the holes that wider nodes, placed ever further on, leave behind.
            if len(codes) == 1:
                while used[free] or free < 257:
                    free += 1
                start = free - int(codes[0])
            else:
                start = start_at
                while used[start + codes].any():
                    start += 1
                start_at = start if start - start_at > 32 else start_at
            base[at] = start
            used[start + codes] = True
            check[start + codes] = at
            for c, child in sorted(tree[node].items()):
                place[child] = start + c + 1
                stack.append(child)
        end = int(np.flatnonzero(used)[-1]) + 258
        self.base, self.check, self.value = (np.resize(x, end) if len(x) < end else x[:end] for x in (base.astype(np.int32), check.astype(np.int32), out.astype(np.int32)))
        self.depth = max((len(k) for k, _ in entries), default=0)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of nodes by bytes; -1 where there is none."""
        to = np.minimum(self.base[nodes] + codes.astype(np.int32) + 1, len(self.check) - 1)
        return np.where(self.check[to] == nodes, to, -1)

    def matches(self, data: bytes):
        """(length, id) of all pieces that a byte string begins with."""
        node = 0
        for i, c in enumerate(data):
            to = int(self.base[node]) + c + 1
            if to >= len(self.check) or self.check[to] != node:
                return
            node = to
            if self.value[node] >= 0:
                yield i + 1, int(self.value[node])


def _char_lengths(first: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins with each byte; 0 for a continuation byte."""
    return np.select([first < 0x80, first < 0xC0, first < 0xE0, first < 0xF0], [1, 0, 2, 3], 4)


@dataclass
class Encoder:
    pieces: list[tuple[bytes, float, int]]

    def __post_init__(self):
        usable = [(p.replace(MARK, b" "), i) for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED) and p]
        self.trie = DoubleArray(usable)
        self.scores = np.array([s for _, s, _ in self.pieces], np.float64)
        self.unknown = float(min((self.scores[i] for _, i in usable), default=0.0)) - _UNKNOWN_PENALTY
        self.byte_ids = np.full(256, next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0), np.int64)
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        in_pieces = np.zeros(256, bool)
        self.cut_spaces = True
        for p, _ in usable:
            in_pieces[np.frombuffer(p, np.uint8)] = True
            self.cut_spaces &= b" " not in p.lstrip(b" ")
        self.foreign = ~in_pieces
        self.foreign[128:] = False
        # What each id stands for: its bytes, in one buffer.
        spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, b" ") for p, _, k in self.pieces]
        self.spelled_lengths = np.array([len(s) for s in spelled], np.int64)
        self.spelled_starts = np.cumsum(self.spelled_lengths) - self.spelled_lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)


    def _long_unit(self, data: bytes) -> tuple[list[int], float]:
        """Plain Viterbi of one unit."""
        n = len(data)
        best, back = [-np.inf] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        for p in range(n):
            if best[p] == -np.inf:
                continue
            width = max(1, int(_char_lengths(np.array([data[p]]))[0]))
            single = False
            for length, number in self.trie.matches(data[p : p + self.trie.depth]):
                single |= length == width
                if (s := best[p] + self.scores[number]) > best[p + length]:
                    best[p + length], back[p + length] = s, (length, number)
            if not single and p + width <= n and (s := best[p] + self.unknown) > best[p + width]:
                best[p + width], back[p + width] = s, (width, -1)
        ids: list[int] = []
        p = n
        while p:
            length, number = back[p]
            ids.extend([number] if number >= 0 else self.byte_ids[np.frombuffer(data[p - length : p], np.uint8)][::-1].tolist())
            p -= length
        return ids[::-1], float(best[n])

    def _units(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids of each unit, and score of each unit; units of up to LONG bytes, all at once."""
        n, length = len(s), e - s
        width = int(length.max()) if n else 0
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        took = np.zeros((n, width + 1), np.int16)
        number = np.zeros((n, width + 1), np.int32)
        # Trie walks from every character of every unit, by length.
        unit = np.repeat(np.arange(n), length)
        offset = np.arange(len(unit)) - np.repeat(np.cumsum(length) - length, length)
        byte = data[s[unit] + offset]
        chars = _char_lengths(byte)
        # A byte inside a character is only reached from the one before it, as a byte piece.
        took[unit, offset + 1] = 1
        number[unit, offset + 1] = self.byte_ids[byte]
        begin = np.flatnonzero(chars > 0)
        single = np.zeros(len(unit), bool)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        node, live = np.zeros(len(begin), np.int32), begin
        for k in range(self.trie.depth):
            inside = offset[live] + k < length[unit[live]]
            live, node = live[inside], node[inside]
            if not len(live):
                break
            node = self.trie.step(node, data[s[unit[live]] + offset[live] + k])
            live, node = live[node >= 0], node[node >= 0]
            value = self.trie.value[node]
            hit = value >= 0
            if hit.any():
                found.append((live[hit], value[hit], k + 1))
                at = live[hit]
                single[at[chars[at] == k + 1]] = True
        lost = begin[~single[begin]]
        edges = [(at, ids, np.full(len(at), k, np.int16)) for at, ids, k in found]
        edges.append((lost, np.full(len(lost), -1, np.int32), chars[lost].astype(np.int16)))
        at, ids, took_ = (np.concatenate(x) for x in zip(*edges))
        # Relaxed by place in the unit, then length: at most one edge of a unit in each step, shorter ones first.
        order = np.argsort(offset[at].astype(np.int64) * 512 + took_ * 2 + (ids < 0), kind="stable")
        at, ids, took_ = at[order], ids[order], took_[order]
        key = offset[at].astype(np.int64) * 512 + took_ * 2 + (ids < 0)
        gain = np.where(ids >= 0, self.scores[ids], self.unknown)
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            p, k = int(offset[at[a]]), int(took_[a])
            u = unit[at[a:b]]
            score = best[u, p] + gain[a:b]
            fits = p + k <= length[u]
            better = fits & (score > best[u, np.minimum(p + k, width)])
            u, score, new = u[better], score[better], ids[a:b][better]
            best[u, p + k] = score
            piece = new >= 0
            took[u, p + k] = np.where(piece, k, 1)
            number[u[piece], p + k] = new[piece]
            number[u[~piece], p + k] = self.byte_ids[data[s[u[~piece]] + p + k - 1]]
        place, live = length.copy(), np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            live = live[place[live] > 0]
            steps.append((live, number[live, place[live]]))
            place[live] -= took[live, place[live]]
        counts = np.zeros(n, np.int64)
        for u, _ in steps:
            counts[u] += 1
        flat = np.zeros(counts.sum(), np.int32)
        end = np.cumsum(counts)
        for k, (u, i) in enumerate(steps):
            flat[end[u] - 1 - k] = i
        return flat, counts, best[np.arange(n), length]

    def encode_block(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of a block, ids of each row, and score of each row."""
        rows = len(block.starts)
        filled = block.ends > block.starts
        data = np.insert(block.data, block.starts[filled], np.uint8(0x20))
        shift = np.cumsum(filled)
        starts, ends = block.starts + shift - filled, block.ends + shift
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64), np.zeros(rows)
        first = np.zeros(len(data), bool)
        first[starts[filled]] = True
        if self.cut_spaces:
            space = data == 0x20
            first[1:] |= space[1:] & ~space[:-1]
            odd = self.foreign[data]
            first |= odd
            first[1:] |= odd[:-1]
        s = np.flatnonzero(first)
        e = np.append(s[1:], len(data))
        unique, at, back = np.unique(tb.span_hashes(data, s, e), return_index=True, return_inverse=True)
        us, ue = s[at], e[at]
        counts, score = np.zeros(len(unique), np.int64), np.zeros(len(unique))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = ue - us
        edge = 0
        for limit in (8, 16, 32, LONG):
            group = np.flatnonzero((size > edge) & (size <= limit))
            edge = limit
            for piece in np.array_split(group, max(1, len(group) * limit // (1 << 20))):
                if len(piece):
                    flat, n, total = self._units(data, us[piece], ue[piece])
                    parts.append((piece, flat, n))
                    counts[piece], score[piece] = n, total
        for u in np.flatnonzero(size > LONG):
            ids, total = self._long_unit(data[us[u] : ue[u]].tobytes())
            parts.append((np.array([u]), np.array(ids, np.int32), np.array([len(ids)])))
            counts[u], score[u] = len(ids), total
        begin = np.cumsum(counts) - counts
        store = np.zeros(counts.sum(), np.int32)
        for piece, flat, n in parts:
            store[_ranges(begin[piece], n)] = flat
        per_unit = counts[back]
        flat = store[_ranges(begin[back], per_unit)]
        lo, hi = np.searchsorted(s, starts), np.searchsorted(s, ends)
        total = np.concatenate(([0], np.cumsum(per_unit)))
        scores = np.concatenate(([0.0], np.cumsum(score[back])))
        return flat, total[hi] - total[lo], scores[hi] - scores[lo]

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids, and bytes of each row, without the marker in front."""
        lengths = self.spelled_lengths[ids]
        data = self.spelled[_ranges(self.spelled_starts[ids], lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        end = np.cumsum(counts)
        size = total[end] - total[end - counts]
        start = np.cumsum(size) - size
        marked = np.flatnonzero(size > 0)
        marked = marked[data[start[marked]] == 0x20]
        size[marked] -= 1
        return np.delete(data, start[marked]), size


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, in one array."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, carry: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """Carried columns, ids, n_pieces, score, and round_trip: whether decoding the ids gives the text back."""
    shared = df.sparkSession.sparkContext.broadcast(Encoder(read_model(model)))
    carry, schema = carried(df, carry, "ids array<int>, n_pieces long, score double, round_trip boolean")

    def run(batch: pa.RecordBatch):
        for block in tb.blocks(batch.column(0), BLOCK):
            flat, counts, scores = shared.value.encode_block(block)
            data, sizes = shared.value.decode_flat(flat, counts)
            own = block.ends - block.starts
            if np.array_equal(sizes, own) and np.array_equal(data, block.data):
                same = np.ones(len(own), bool)
            else:
                cuts = np.cumsum(sizes)
                same = np.array([np.array_equal(data[c - n : c], block.data[a:b]) for c, n, a, b in zip(cuts, sizes, block.starts, block.ends)], bool)
            yield {c: batch.column(i + 1).slice(block.lo, block.hi - block.lo) for i, c in enumerate(carry)} | {"ids": _lists(flat, counts), "n_pieces": counts, "score": scores, "round_trip": same}

    return map_batches(df.select(text, *carry), run, schema)


def decode(df: DataFrame, carry: list[str], ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Carried columns and the text of rows of ids; bytes that are no UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(Encoder(read_model(model)))
    carry, schema = carried(df, carry, "text string")

    def run(batch: pa.RecordBatch):
        column = batch.column(0)
        counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        flat = np.asarray(column.flatten()).astype(np.int64)
        data, sizes = shared.value.decode_flat(flat, counts)
        cuts = np.cumsum(sizes)
        texts = [data[c - n : c].tobytes().decode("utf-8", "replace") if ok else None for c, n, ok in zip(cuts, sizes, np.asarray(column.is_valid()))]
        yield {c: batch.column(i + 1) for i, c in enumerate(carry)} | {"text": texts}

    return map_batches(df.select(ids, *carry), run, schema)
