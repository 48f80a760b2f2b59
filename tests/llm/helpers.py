"""Plain Python versions that the operators are held against."""

import math
import re
import struct

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(docs):
    """{doc_id: least reachable id} by comparing all pairs."""
    sets = {}
    for d, text in docs:
        if d is not None:
            sets[d] = shingle_set(text)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def plain_targets(sizes, weights=(5, 2, 1)):
    """{source: target} by filling up sources over their cap, one round after another."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, fixed = {s: weights[i % len(weights)] for i, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in fixed]
        left, total = 1.5 * sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in rest)
        share = {s: weight[s] * left / total for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in over}


def spark_hash(values, types, seed=42):
    """What xxhash64 makes of a row of longs, ints and strings; a null leaves the hash so far."""
    h = seed
    for v, t in zip(values, types):
        if v is not None:
            data = v.encode() if t == "string" else struct.pack("<i" if t == "int" else "<q", v)
            h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, types):
    """Rows (doc_id, text, lang, source, ...) as often as systematic sampling emits them, seed 0."""
    sizes, by = {}, {}
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        by.setdefault(r[3], []).append((r, n))
    targets, out = plain_targets(sizes), []
    for source, members in by.items():

        def place(x):
            r, n = x
            row = spark_hash(r, types)
            slot = spark_hash((r[0], row), ("long", "long")) % 256
            return math.floor(8 * math.log2(n + 1)), slot, r[0] is not None, r[0] or 0, n, row

        offset = spark_hash((0, "" if source is None else "s" + source), ("int", "string")) % (1 << 20) / (1 << 20)
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        for rank, (r, _) in enumerate(sorted(members, key=place)):
            out += [r] * min(2, math.floor((rank + 1) * rate + offset) - math.floor(rank * rate + offset))
    return out


def plain_pieces(pieces, text):
    """(ids, score) of the best segmentation by a plain Viterbi over all pieces of at most the longest length."""
    from lectern.llm import sentencepiece as sp

    table = {p.replace(sp.MARK, b" "): (i, s) for i, (p, s, k) in enumerate(pieces) if k in (sp.NORMAL, sp.USER_DEFINED) and p}
    byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == sp.BYTE}
    unknown, longest = min(s for _, s in table.values()) - 10, max(map(len, table))
    data = b" " + text.encode() if text else b""
    best, back, foreign = [0.0] + [-math.inf] * len(data), [None] * (len(data) + 1), "▁".encode()
    for p in range(len(data)):
        if best[p] == -math.inf or data[p] & 0xC0 == 0x80:
            continue
        width = 1 if data[p] < 0x80 else 2 if data[p] < 0xE0 else 3 if data[p] < 0xF0 else 4
        options = []
        for n in range(1, min(longest, len(data) - p) + 1):
            if (found := table.get(data[p : p + n])) is not None and foreign not in data[p : p + n]:
                options.append((n, found[1], [found[0]]))
        if not any(n == width for n, _, _ in options):
            options.append((width, unknown, [byte_ids[b] for b in data[p : p + width]]))
        for n, s, ids in options:
            if best[p] + s > best[p + n]:
                best[p + n], back[p + n] = best[p] + s, (p, ids)
    ids, at = [], len(data)
    while at:
        at, mine = back[at]
        ids = mine + ids
    return ids, best[len(data)]
