"""Catalogue search language: text to a Column.

or < and (also side by side) < not < atom; an atom is ``field:value``, a bare
term or a bracketed expression.  A value is a word or a quoted phrase, with
``=`` exact, ``~`` pattern, ``> < >= <=`` comparison, ``true``/``false`` for
presence, and date words.  ``search:"=name"`` stands for a named expression.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QueryError(ValueError):
    """A query that can't be read, or names an unknown field or expression."""


_TOKEN = re.compile(r"""\s*(?:(\()|(\))|((?:[^\s()":]+:)?(?:[=~]|[<>]=?)?"(?:\\.|[^"\\])*"|(?:[^\s()":]+:)"(?:\\.|[^"\\])*"|[^\s()"]+))""")


@dataclass(frozen=True)
class Language:
    """Fields by name: a column each; arrays match if any element does. ``bare`` fields serve terms without a field."""

    schema: T.StructType
    fields: Mapping[str, str]
    bare: tuple[str, ...]
    named: Mapping[str, str] = ()  # type: ignore[assignment]
    today: dt.date | None = None

    def parse(self, text: str, path: tuple[str, ...] = ()) -> Column:
        tokens = self._tokens(text)
        if not tokens:
            return F.lit(True)
        out, rest = self._or(tokens, path)
        if rest:
            raise QueryError(f"unexpected {rest[0]!r}")
        return out

    def _tokens(self, text: str) -> list[str]:
        out, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at : at + 20]!r}")
            out.append(m.group(1) or m.group(2) or m.group(3))
            at = m.end()
        return out

    def _or(self, t: list[str], path):
        left, t = self._and(t, path)
        while t and t[0].lower() == "or":
            right, t = self._and(t[1:], path)
            left = left | right
        return left, t

    def _and(self, t: list[str], path):
        left, t = self._not(t, path)
        while t and t[0] != ")" and t[0].lower() != "or":
            if t[0].lower() == "and":
                t = t[1:]
            right, t = self._not(t, path)
            left = left & right
        return left, t

    def _not(self, t: list[str], path):
        if not t:
            raise QueryError("the query ends too early")
        if t[0].lower() == "not":
            inner, t = self._not(t[1:], path)
            return ~inner, t
        if t[0] == "(":
            inner, t = self._or(t[1:], path)
            if not t or t[0] != ")":
                raise QueryError("a bracket isn't closed")
            return inner, t[1:]
        if t[0] == ")":
            raise QueryError("a bracket isn't opened")
        if t[0].lower() in ("and", "or"):
            raise QueryError(f"{t[0]!r} needs something on both sides")
        return self._atom(t[0], path), t[1:]

    def _atom(self, token: str, path) -> Column:
        m = re.match(r'^([^\s":=~<>]+):(.*)$', token, re.DOTALL)
        if not m:
            return self._any([self._test(f, self._value(token)) for f in self.bare])
        field, value = m.group(1).lower(), m.group(2)
        if field == "search":
            name = self._value(value)[1]
            if name in path or name not in dict(self.named):
                raise QueryError(f"{'a cycle through' if name in path else 'no saved search'} {name!r}")
            return self.parse(dict(self.named)[name], (*path, name))
        if field not in self.fields:
            raise QueryError(f"no field {field!r}; there are {', '.join(sorted(self.fields))}")
        return self._test(field, self._value(value))

    @staticmethod
    def _value(text: str) -> tuple[str, str]:
        text = text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text
        m = re.match(r'^([=~]|[<>]=?)?("?)(.*?)\2$', text, re.DOTALL)
        return m.group(1) or "", m.group(3).replace('\\"', '"')

    @staticmethod
    def _any(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    def _test(self, field: str, value: tuple[str, str]) -> Column:
        op, text = value
        name = self.fields[field]
        kind, column = self.schema[name].dataType, F.col(name)
        if op == "" and text.lower() in ("true", "false"):
            empty = column.isNull() | (F.size(column) == 0 if isinstance(kind, (T.ArrayType, T.MapType)) else column.cast("string") == "")
            return empty if text.lower() == "false" else ~empty
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.exists(column, lambda x: self._scalar(x, kind.elementType, op, text)), F.lit(False))
        return F.coalesce(self._scalar(column, kind, op, text), F.lit(False))

    def _scalar(self, x: Column, kind: T.DataType, op: str, text: str) -> Column:
        if isinstance(kind, (T.DateType, T.TimestampType)):
            return self._date(x, op, text)
        if isinstance(kind, T.NumericType):
            try:
                number = float(text)
            except ValueError:
                return F.lit(False)
            return {"": x == number, "=": x == number, ">": x > number, "<": x < number, ">=": x >= number, "<=": x <= number}.get(op, F.lit(False))
        if op == "=":
            return F.lower(x) == text.lower()
        if op == "~":
            if len(text) > 200:
                raise QueryError("a pattern has more than 200 characters")
            try:
                re.compile(text)
            except re.error as e:
                raise QueryError(f"bad pattern: {e}") from e
            return x.rlike(f"(?i){text}")
        if op:
            return {">": x > text, "<": x < text, ">=": x >= text, "<=": x <= text}[op]
        return F.lower(x).contains(text.lower())

    def _date(self, x: Column, op: str, text: str) -> Column:
        today, day = self.today or dt.date.today(), x.cast("date")
        m = re.match(r"^(\d+)(days|months|years)ago$", text.lower())
        first = today.replace(day=1)
        words = {"today": (today, today), "thismonth": (first, today), "thisyear": (today.replace(month=1, day=1), today)}
        words["lastmonth"] = ((first - dt.timedelta(days=1)).replace(day=1), first - dt.timedelta(days=1))
        words["lastyear"] = (dt.date(today.year - 1, 1, 1), dt.date(today.year - 1, 12, 31))
        if m:
            n = int(m.group(1))
            months = today.year * 12 + today.month - 1 - n * (12 if m.group(2) == "years" else 1)
            then = today - dt.timedelta(days=n) if m.group(2) == "days" else dt.date(months // 12, months % 12 + 1, min(today.day, 28))
            lo = hi = then
        elif text.lower() in words:
            lo, hi = words[text.lower()]
        else:
            m = re.match(r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", text)
            if not m:
                return F.lit(False)
            y, mo, d = int(m.group(1)), int(m.group(2) or 1), int(m.group(3) or 1)
            lo = dt.date(y, mo, d)
            hi = lo if m.group(3) else (dt.date(y + (mo == 12), mo % 12 + 1, 1) - dt.timedelta(days=1)) if m.group(2) else dt.date(y, 12, 31)
        return {"": day.between(lo, hi), "=": day.between(lo, hi), ">": day > hi, "<": day < lo, ">=": day >= lo, "<=": day <= hi}.get(op, F.lit(False))


@dataclass(frozen=True)
class Scope:
    """A search limited to a named set, without the rows of exclusion markers (names that begin with -)."""

    language: Language
    bundle: str | None = None
    exclude: bool = True

    def markers(self) -> list[str]:
        if not self.exclude or (self.bundle or "").startswith("-"):
            return []
        return [n for n in dict(self.language.named) if n.startswith("-") and '"' not in n]

    def predicate(self, query: str) -> Column:
        out = self.language.parse(query)
        if self.bundle is not None:
            named = dict(self.language.named)
            if self.bundle not in named:
                raise QueryError(f"no set {self.bundle!r}; there are {', '.join(sorted(n for n in named if not n.startswith('-')))}")
            out = out & self.language.parse(named[self.bundle])
        for m in self.markers():
            out = out & ~self.language.parse(dict(self.language.named)[m])
        return out

    def excluded(self) -> Column:
        """Rows of the named set that the markers keep out."""
        parts = [self.language.parse(dict(self.language.named)[m]) for m in self.markers()]
        inside = self.language.parse(dict(self.language.named)[self.bundle]) if self.bundle is not None else F.lit(True)
        return inside & Language._any(parts) if parts else F.lit(False)
