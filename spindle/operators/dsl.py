"""Two small query languages, parsed to column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCREEN = re.compile(r"""\s*(?:(/\*.*?\*/)|("(?:[^"]*)")|([A-Za-z_][\w.]*)|(-?\d+(?:\.\d+)?)|(>=|<=|<>|!=|=|>|<)|([(),]))""", re.S)
_COMPARE = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__, "=": Column.__eq__, "<>": Column.__ne__, "!=": Column.__ne__}


def _tokens(pattern: re.Pattern, text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at : at + 20]!r}")
        out.append((m.lastindex, m.group(m.lastindex)))
        at = m.end()
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[int, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def next(self, expected: str | None = None) -> str:
        got = self.peek()
        if got is None or expected is not None and got != expected:
            raise ValueError(f"expected {expected or 'more'}, found {got}")
        self.at += 1
        return got


class Screen:
    """A parsed screen: its filters, the currency, and the universe's attributes.

    ``U(IN(Equity(active,public)))``, ``Field(Scale=6)>=1000``, ``IN(Field,"a","b")`` and
    ``CURN=USD``, with commas between and comments in ``/* */``.
    """

    def __init__(self, text: str):
        tokens = [t for t in _tokens(_SCREEN, text) if t[0] != 1]
        r = _Reader(tokens)
        self.universe: list[str] = []
        self.currency: str | None = None
        self.filters: list[tuple] = []  # (field, operator or IN, value or values, scale)
        while r.peek() is not None:
            self._term(r)
            if r.peek() is not None:
                r.next(",")

    def _term(self, r: _Reader) -> None:
        name = r.next()
        if name == "U":
            for word in ("(", "IN", "("):
                r.next(word)
            r.next()
            r.next("(")
            while r.peek() != ")":
                if r.peek() == ",":
                    r.next()
                self.universe.append(r.next())
            for _ in range(3):
                r.next(")")
        elif name == "IN":
            r.next("(")
            field, values = r.next(), []
            while r.peek() == ",":
                r.next()
                values.append(r.next().strip('"'))
            r.next(")")
            self.filters.append((field, "IN", values, 0))
        else:
            scale = 0
            if r.peek() == "(":
                r.next()
                while r.peek() != ")":
                    key = r.next()
                    if key == ",":
                        continue
                    r.next("=")
                    value = r.next()
                    scale = int(value) if key == "Scale" else scale
                r.next(")")
            op, value = r.next(), r.next()
            if op not in _COMPARE:
                raise ValueError(f"expected a comparison, found {op}")
            if name == "CURN":
                self.currency = value
            else:
                self.filters.append((name, op, value, scale))

    def condition(self, fields: dict[str, str], universe: dict[str, Column] | None = None) -> Column:
        """The screen as one predicate; ``fields`` names the column of each field."""
        parts = [(universe or {})[u] for u in self.universe if u in (universe or {})]
        for field, op, value, scale in self.filters:
            if field not in fields:
                raise KeyError(f"unknown field {field}")
            c = F.col(fields[field])
            if op == "IN":
                parts.append(c.cast("string").isin(*value))
            else:
                literal = value.strip('"') if value.startswith('"') else float(value)
                parts.append(_COMPARE[op](c / 10**scale if scale else c, F.lit(literal)))
        return reduce(Column.__and__, parts, F.lit(True))


_NEWS = re.compile(r"""\s*(?:("(?:[^"]*)")|([()])|([^\s()"]+))""")


def news_query(text: str, fields: dict[str, Column], words: Column, groups: dict[str, Column] | None = None) -> Column:
    """``R:code``, ``Language:code``, ``Topic:code``, named groups and words, with AND, OR, NOT and brackets.

    A field's column is compared or, if it is an array, searched; AND binds closer than OR.
    """
    r = _Reader(_tokens(_NEWS, text))

    def atom() -> Column:
        got = r.next()
        if got == "NOT":
            return ~atom()
        if got == "(":
            inner = either()
            r.next(")")
            return inner
        if groups and got in groups:
            return groups[got]
        name, colon, value = got.partition(":")
        if colon and name in fields:
            return fields[name].eqNullSafe(value)
        return F.contains(F.lower(words), F.lit(got.strip('"').lower()))

    def both() -> Column:
        out = atom()
        while r.peek() == "AND":
            r.next()
            out = out & atom()
        return out

    def either() -> Column:
        out = both()
        while r.peek() == "OR":
            r.next()
            out = out | both()
        return out

    out = either()
    if r.peek() is not None:
        raise ValueError(f"unexpected {r.peek()}")
    return out
