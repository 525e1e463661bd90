"""The boolean and positional query language (IR-3): text to a small tree.

    or    := and (OR and)*            and   := unary (AND unary)*
    unary := NOT unary | primary      primary := word | ( or )
           | NEAR ( k , word , word ) | ADJ ( word , word )
           | MSM ( w , word {, word} ) | FIRST ( word ) | LAST ( word )

Keywords are case-insensitive; EDGE_START and EDGE_END are FIRST and LAST.
There is no implicit AND, and a number is no word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

KEYWORDS = {"AND", "OR", "NOT", "NEAR", "ADJ", "MSM", "FIRST", "LAST", "EDGE_START", "EDGE_END"}
_LEXEME = re.compile(r"\s*(?:(?P<int>\d+)|(?P<word>[^\W\d]\w*)|(?P<mark>[(),]))")


class QueryError(ValueError):
    """The query does not parse."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Near:
    k: int
    a: str
    b: str


@dataclass(frozen=True)
class Adj:
    a: str
    b: str


@dataclass(frozen=True)
class Msm:
    width: int
    words: tuple[str, ...]


@dataclass(frozen=True)
class First:
    word: str


@dataclass(frozen=True)
class Last:
    word: str


Node = Term | Not | And | Or | Near | Adj | Msm | First | Last


def lexemes(text: str) -> list[tuple[str, str]]:
    """(kind, value): int, word, key or mark; words are lower-cased, keywords upper-cased."""
    out, at = [], 0
    while text[at:].strip():
        m = _LEXEME.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:].strip()[0]!r}")
        kind, value = m.lastgroup or "", m[m.lastgroup or 0]
        if kind == "word":
            kind, value = ("key", value.upper()) if value.upper() in KEYWORDS else ("word", value.lower())
        out.append((kind, value))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = [*lexemes(text), ("end", "")], 0

    def see(self, kind: str, value: str | None = None) -> bool:
        k, v = self.items[self.at]
        return k == kind and value in (None, v)

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.see(kind, value):
            raise QueryError(f"expected {value or kind}, found {self.items[self.at][1] or 'the end'!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def skip(self, kind: str, value: str) -> bool:
        found = self.see(kind, value)
        self.at += found
        return found

    def disjunction(self) -> Node:
        node = self.conjunction()
        while self.skip("key", "OR"):
            node = Or(node, self.conjunction())
        return node

    def conjunction(self) -> Node:
        parts = [self.negation()]
        while self.skip("key", "AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self) -> Node:
        return Not(self.negation()) if self.skip("key", "NOT") else self.primary()

    def arguments(self, number: bool, least: int, most: int | None) -> tuple[int, list[str]]:
        self.take("mark", "(")
        n = 0
        if number:
            n = int(self.take("int"))
            self.take("mark", ",")
        words = [self.take("word")]
        while self.skip("mark", ","):
            words.append(self.take("word"))
        self.take("mark", ")")
        if len(words) < least or most is not None and len(words) > most:
            raise QueryError(f"{len(words)} words where {least} are needed")
        return n, words

    def primary(self) -> Node:
        if self.see("word"):
            return Term(self.take("word"))
        if self.skip("mark", "("):
            node = self.disjunction()
            self.take("mark", ")")
            return node
        if self.skip("key", "NEAR"):
            k, (a, b) = self.arguments(True, 2, 2)
            return Near(k, a, b)
        if self.skip("key", "ADJ"):
            _, (a, b) = self.arguments(False, 2, 2)
            return Adj(a, b)
        if self.skip("key", "MSM"):
            width, words = self.arguments(True, 1, None)
            return Msm(width, tuple(words))
        for key, make in (("FIRST", First), ("EDGE_START", First), ("LAST", Last), ("EDGE_END", Last)):
            if self.skip("key", key):
                return make(self.arguments(False, 1, 1)[1][0])
        raise QueryError(f"unexpected {self.items[self.at][1] or 'end'!r}")


def parse(text: str) -> Node:
    reader = _Reader(text)
    node = reader.disjunction()
    reader.take("end")
    return node


def words_of(node: Node) -> Iterator[tuple[str, bool]]:
    """(word, under an odd number of NOTs) from left to right."""

    def walk(n: Node, negated: bool) -> Iterator[tuple[str, bool]]:
        match n:
            case Term(w) | First(w) | Last(w):
                yield w, negated
            case Near(_, a, b) | Adj(a, b):
                yield a, negated
                yield b, negated
            case Msm(_, words):
                yield from ((w, negated) for w in words)
            case Not(child):
                yield from walk(child, not negated)
            case And(children):
                for child in children:
                    yield from walk(child, negated)
            case Or(left, right):
                yield from walk(left, negated)
                yield from walk(right, negated)

    return walk(node, False)


def all_words(node: Node) -> list[str]:
    return list(dict.fromkeys(w for w, _ in words_of(node)))


def positive_words(node: Node) -> list[str]:
    """IR-14: the words that score, each once, in order."""
    return list(dict.fromkeys(w for w, negated in words_of(node) if not negated))
