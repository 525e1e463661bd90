"""A query tree as one boolean Column over position arrays (IR-4..12).

`at(word)` gives the column of a word's ascending positions in the document, an
empty array where it has none.  All operators are higher-order functions on the
row, so a query of any size is one projection and one filter: no joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.plans import query as q


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, as the variable of a lambda."""
    return F.transform(F.array(value), body)[0]


def near(a: Column, b: Column, k: int) -> Column:
    """Some |x - y| <= k: the closest two stand side by side in the merged order."""
    merged = F.array_sort(F.concat(F.transform(a, lambda x: x * 2), F.transform(b, lambda y: y * 2 + 1)))

    def close(m: Column) -> Column:
        def pair(i: Column) -> Column:
            x, y = F.get(m, i - 1), F.get(m, i)
            return (x % 2 != y % 2) & (F.floor(y / 2) - F.floor(x / 2) <= max(k, 0))

        return F.exists(F.sequence(F.lit(1), F.size(m) - 1), pair)

    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, bound(merged, close)).otherwise(F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.transform(a, lambda x: x + 1), b)


def within(width: int, needs: dict[str, int], at: Callable[[str], Column]) -> Column:
    """Some window of positions of this width holds every word as often as it is named.

    One pass over the merged positions: each is the right end of a window, and of
    each word the last few places, as many as it needs, are kept."""
    words = list(needs)
    tagged = [F.transform(at(w), _tag(i)) for i, w in enumerate(words)]
    merged = F.array_sort(F.concat(*tagged))
    far = -(1 << 30)
    start = F.struct(*[F.array(*[F.lit(far)] * needs[w]).alias(f"w{i}") for i, w in enumerate(words)], F.lit(False).alias("found"))

    def step(state: Column, hit: Column) -> Column:
        last = [
            F.when(hit["w"] == i, F.slice(F.concat(state[f"w{i}"], F.array(hit["p"])), 2, needs[w])).otherwise(state[f"w{i}"]) for i, w in enumerate(words)
        ]
        oldest = F.least(*[x[0] for x in last]) if len(last) > 1 else last[0][0]
        return F.struct(*[x.alias(f"w{i}") for i, x in enumerate(last)], (state["found"] | (oldest >= hit["p"] - width)).alias("found"))

    return F.aggregate(merged, start, step, lambda state: state["found"])


def _tag(i: int) -> Callable[[Column], Column]:
    return lambda p: F.struct(p.alias("p"), F.lit(i).alias("w"))


def predicate(node: q.Node, at: Callable[[str], Column], n_tok: Column) -> Column:
    match node:
        case q.Term(w):
            return F.size(at(w)) > 0
        case q.Not(child):
            return ~predicate(child, at, n_tok)
        case q.And(children):
            return reduce(Column.__and__, [predicate(c, at, n_tok) for c in children])
        case q.Or(left, right):
            return predicate(left, at, n_tok) | predicate(right, at, n_tok)
        case q.Near(k, a, b):
            return F.size(at(a)) > 0 if a == b else near(at(a), at(b), k)
        case q.Adj(a, b):
            return adjacent(at(a), at(b))
        case q.Msm(width, words):
            return within(width, dict(Counter(words)), at)
        case q.First(w):
            return F.array_contains(at(w), F.lit(0))
        case q.Last(w):
            return F.array_contains(at(w), n_tok - 1)
    raise TypeError(node)


def matches_without(node: q.Node) -> bool:
    """Whether a document that holds none of the query's words can satisfy it."""
    return evaluate(node, ["\0"])


def evaluate(node: q.Node, tokens: list[str]) -> bool:
    """The same over a list of tokens, in plain Python: the tests' second opinion (IR-13)."""
    places: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        places.setdefault(t, []).append(i)

    def walk(n: q.Node) -> bool:
        match n:
            case q.Term(w):
                return w in places
            case q.Not(child):
                return not walk(child)
            case q.And(children):
                return all(map(walk, children))
            case q.Or(left, right):
                return walk(left) or walk(right)
            case q.Near(k, a, b):
                return any(abs(x - y) <= k for x in places.get(a, []) for y in places.get(b, []))
            case q.Adj(a, b):
                return any(tokens[x + 1 : x + 2] == [b] for x in places.get(a, []))
            case q.Msm(width, words):
                return any(
                    not Counter(words) - Counter(tokens[x : x + width + 1]) for w in words for x in places.get(w, [])
                )
            case q.First(w):
                return tokens[:1] == [w]
            case q.Last(w):
                return tokens[-1:] == [w]
        raise TypeError(n)

    return walk(node)
