"""The boolean query language: lexer, parser, checks, and compilation to a predicate over token arrays.

NOT binds closer than AND, AND closer than OR; words side by side are joined by an AND that is looser than OR. A phrase stands
in double quotes, word* is a prefix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.stem import fold


class QueryError(ValueError):
    """A query that cannot be read; position is the character where it fails."""

    def __init__(self, message: str, position: int = 0):
        super().__init__(message)
        self.position = position


@dataclass(frozen=True)
class Term:
    word: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


_LEX = re.compile(r'\s*(?:(?P<quote>"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<word>[A-Za-z0-9_-]+\*?)|(?P<bad>\S))')


def _lex(query: str) -> list[tuple[str, str, int]]:
    out = []
    for m in _LEX.finditer(query):
        kind = m.lastgroup
        text = m.group(kind)
        if kind == "bad":
            raise QueryError("unmatched quote" if text == '"' else f"unexpected character {text}", m.start(kind))
        if kind == "word" and text.upper() in ("AND", "OR", "NOT"):
            kind = text.upper()
        out.append((kind, text, m.start(m.lastgroup)))
    return out


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, accents folded, as functions.text.tokens cuts texts."""
    return re.findall(r"[^\W_]+", fold(text))


class _Parser:
    def __init__(self, query: str):
        self.items, self.at, self.end = _lex(query), 0, len(query)

    def peek(self) -> str | None:
        return self.items[self.at][0] if self.at < len(self.items) else None

    def side_by_side(self) -> object:
        node = self.either()
        while self.peek() not in (None, "close"):
            node = Both(node, self.either())
        return node

    def either(self) -> object:
        node = self.both()
        while self.peek() == "OR":
            self.at += 1
            node = Either(node, self.both())
        return node

    def both(self) -> object:
        node = self.unary()
        while self.peek() in ("AND", "NOT"):
            if self.peek() == "AND":
                self.at += 1
            node = Both(node, self.unary())
        return node

    def unary(self) -> object:
        if self.peek() == "NOT":
            self.at += 1
            return Not(self.unary())
        if self.peek() is None:
            raise QueryError("the query ends where a term is due", self.end)
        kind, text, position = self.items[self.at]
        self.at += 1
        if kind == "open":
            node = self.side_by_side()
            if self.peek() != "close":
                raise QueryError("parenthesis is not closed", position)
            self.at += 1
            return node
        if kind == "quote":
            return Phrase(tuple(words(text)))
        if kind == "word":
            parts = words(text)
            if not parts:
                raise QueryError("no letters in term", position)
            return Term(parts[0], text.endswith("*")) if len(parts) == 1 else Phrase(tuple(parts))
        raise QueryError(f"{text} stands where a term is due", position)


def parse(query: str) -> object:
    """The tree of a query; QueryError for one that is empty, unbalanced, or begins or ends with an operator.

    A NOT alone is read, and lint() warns of it: it ranks nothing, so a search finds nothing by it.
    """
    p = _Parser(query)
    if not p.items:
        raise QueryError("empty query")
    node = p.side_by_side()
    if p.peek() is not None:
        raise QueryError("parenthesis was not opened", p.items[p.at][2])
    return node


def parse_or_words(query: str) -> object:
    """parse(), or for a query that cannot be read all its words joined by AND."""
    try:
        return parse(query)
    except QueryError:
        node = None
        for w in words(query):
            node = Term(w) if node is None else Both(node, Term(w))
        if node is None:
            raise
        return node


def lint(node: object, most_terms: int = 20, most_depth: int = 5) -> list[str]:
    """Warnings: too deep, too many terms, NOT of NOT, NOT alone."""
    out, terms = (["NOT alone"] if isinstance(node, Not) else []), 0

    def walk(x: object, depth: int) -> int:
        nonlocal terms
        if isinstance(x, (Term, Phrase)):
            terms += 1
            return depth
        if isinstance(x, Not):
            if isinstance(x.of, Not):
                out.append("double NOT")
            return walk(x.of, depth + 1)
        return max(walk(x.left, depth + 1), walk(x.right, depth + 1))

    if walk(node, 1) > most_depth:
        out.append("nested too deep")
    if terms > most_terms:
        out.append("too many terms")
    return out


def predicate(node: object, toks: str) -> Column:
    """The tree as a condition on an array of tokens."""
    if isinstance(node, Term):
        return F.exists(toks, lambda t: t.startswith(node.word)) if node.prefix else F.array_contains(toks, node.word)
    if isinstance(node, Phrase):
        joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
        return joined.contains(" " + " ".join(node.words) + " ")
    if isinstance(node, Not):
        return ~predicate(node.of, toks)
    a, b = predicate(node.left, toks), predicate(node.right, toks)
    return a & b if isinstance(node, Both) else a | b


def terms_of(node: object) -> list[str]:
    """The positive words of a query, for ranking its matches."""
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Phrase):
        return list(node.words)
    return [] if isinstance(node, Not) else terms_of(node.left) + terms_of(node.right)
