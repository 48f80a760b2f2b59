"""Secret scan by a trigram inverted index.

Each rule's pattern is parsed into a Boolean query over the trigrams that every
match must hold.  A block of documents gets an index that posts, for each
trigram that some query asks for, the documents holding it; the queries
intersect and unite these postings, and only the candidates are verified with
the pattern itself.  A rule without a mandatory trigram verifies all documents.
The index folds A-Z to a-z, so its candidates are a superset for either case.

Defined results: a null or empty text has no spans; every row of the input,
repeated or with a null id, gives one row; other columns are ignored; an empty
table gives no rows.  Texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .arrowmap import map_batches

_MANY, _WIDE = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds in their listed order, then public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

# A query is True (all documents), a trigram, ("and", parts) or ("or", parts).


def _all_of(parts: Iterable) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: Iterable) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(strings: Iterable[bytes]) -> object:
    return _any_of(_all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class _Facts:
    """What is known of a sub-pattern's matches: all of them, or how they begin and end; and a query that holds for each."""

    whole: frozenset[bytes] | None
    head: frozenset[bytes]
    tail: frozenset[bytes]
    query: object

    def open(self) -> _Facts:
        return self if self.whole is None else _Facts(None, self.whole, self.whole, _grams(self.whole))


_ANYTHING = _Facts(None, frozenset([b""]), frozenset([b""]), True)


def _known(strings: Iterable[bytes]) -> _Facts:
    strings = frozenset(strings)
    return _Facts(strings, strings, strings, True) if len(strings) <= _MANY else _ANYTHING


def _joined(a: _Facts, b: _Facts) -> _Facts:
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= _MANY:
        return _known(x + y for x in a.whole for y in b.whole)
    seam = _grams(x[-2:] + y[:2] for x in a.tail for y in b.head) if len(a.tail) * len(b.head) <= _MANY * 4 else True
    head = frozenset(x + y for x in a.whole for y in b.head) if a.whole is not None else a.head
    tail = frozenset(x + y for x in a.tail for y in b.whole) if b.whole is not None else b.tail
    query = _all_of([a.open().query, b.open().query, seam])
    limit = lambda s: s if len(s) <= _MANY else frozenset([b""])
    return _Facts(None, limit(head), limit(tail), query)


def _either(options: list[_Facts]) -> _Facts:
    if all(o.whole is not None for o in options):
        return _known(s for o in options for s in o.whole)
    options = [o.open() for o in options]
    return _Facts(None, frozenset().union(*(o.head for o in options)), frozenset().union(*(o.tail for o in options)), _any_of(o.query for o in options))


def _chars(items) -> list[int] | None:
    out: list[int] = []
    for op, arg in items:
        if op is rc.LITERAL:
            out.append(arg)
        elif op is rc.RANGE:
            out.extend(range(arg[0], arg[1] + 1))
        else:
            return None
        if len(out) > _WIDE * 2:
            return None
    return out


def _fold(code: int) -> bytes:
    return chr(code).encode().translate(tb.LOWER.tobytes())


def _facts(tree) -> _Facts:
    known = _known([b""])
    for op, arg in tree:
        if op is rc.LITERAL:
            part = _known([_fold(arg)])
        elif op is rc.IN and (chars := _chars(arg)) and len(chars) <= _WIDE:
            part = _known(map(_fold, chars))
        elif op is rc.SUBPATTERN:
            part = _facts(arg[3])
        elif op is rc.BRANCH:
            part = _either([_facts(t) for t in arg[1]])
        elif op is rc.AT:
            part = _known([b""])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, inner = arg
            once = _facts(inner)
            if least == 0:
                part = _either([_known([b""]), once]) if most == 1 else _ANYTHING
            else:
                part = once
                for _ in range(min(int(least), 3) - 1):
                    part = _joined(part, once)
                if int(most) > 1 and (least > 3 or most != least):
                    part = part.open()
        else:
            part = _ANYTHING
        known = _joined(known, part)
    return known


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that each match of a pattern fulfils; True if there is none."""
    return _facts(rp.parse(pattern)).open().query


def _named(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set(itertools.chain.from_iterable(map(_named, query[1])))


class TrigramIndex:
    """Postings of a block's rows for a fixed list of trigrams."""

    def __init__(self, trigrams: Iterable[bytes]):
        self.trigrams = sorted(trigrams)
        self.slot = np.full(1 << 24, -1, np.int16)
        for i, t in enumerate(self.trigrams):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, block: tb.Block) -> dict[bytes, np.ndarray]:
        d = tb.LOWER[block.data]
        if len(d) < 3 or not self.trigrams:
            return {}
        code = d[:-2].astype(np.int32)
        code <<= 8
        code |= d[1:-1]
        code <<= 8
        code |= d[2:]
        which = self.slot[code]
        at = np.flatnonzero(which >= 0)
        row = np.searchsorted(block.ends, at, "right")
        fits = at + 3 <= block.ends[row]
        pairs = np.unique(which[at[fits]].astype(np.int64) * len(block.ends) + row[fits])
        slots, rows = pairs // len(block.ends), pairs % len(block.ends)
        cuts = np.searchsorted(slots, np.arange(len(self.trigrams) + 1))
        return {t: rows[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.trigrams)}


def candidates(query: object, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows that fulfil a query."""
    none = np.zeros(0, np.int64)
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, none)
    parts = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
    return out


def scan(df: DataFrame, text: str = "text", carry: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each input row: the carried id and ``spans``, an array of (kind, start, end) by start, then rule order.

    Offsets count code points, the end is exclusive; matches of one rule don't overlap.
    """
    schema = f"{carry} {df.schema[carry].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    queries = [trigram_query(r.pattern) for r in rules]
    state: dict = {}

    def run(batch: pa.RecordBatch):
        if not state:
            state["index"] = TrigramIndex(set().union(*map(_named, queries)))
            state["regex"] = [re.compile(r.pattern, re.ASCII) for r in rules]
        ids = batch.column(1)
        for block in tb.blocks(batch.column(0)):
            n, postings = block.hi - block.lo, state["index"].postings(block)
            found: list[list] = [[] for _ in range(n)]
            texts: dict[int, str] = {}
            for order, (rule, query, regex) in enumerate(zip(rules, queries, state["regex"])):
                for row in candidates(query, postings, n).tolist():
                    if row not in texts:
                        texts[row] = block.row_text(row)
                    for m in regex.finditer(texts[row]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[row].append((m.start(), order, m.end()))
            spans = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(f)] for f in found]
            yield {carry: ids.slice(block.lo, n), "spans": spans}

    return map_batches(df.select(text, carry), run, schema)


def digests(spans: DataFrame, carry: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    from pyspark.sql import functions as F

    base = [r.kind for r in rules if r.base]
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(carry, *map(count, base), F.sha2(as_text(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
