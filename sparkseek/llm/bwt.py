"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

All strings are inserted at once, from their last symbol to their first: round j
puts the suffix of length j of every string that has one in its place among the
suffixes already there.  The place follows from the transform itself: a suffix
c + s stands behind all suffixes that begin with a smaller symbol, in the order
in which the c's stand in the transform.  Its common prefix with the suffix
before it is one more than the least common prefix between s and the previous c,
and the same holds for the suffix behind it, whose value changes.

A round reads the columns front to back twice, CHUNK entries at a time, and
writes them front to back once.  The first pass finds places and common prefixes;
of what lies before a chunk it knows, for each symbol, how many there were and
the least common prefix since the last one.  The second merges the new suffixes
in.  Collections of more than IN_MEMORY entries have their columns in files of the
shared folder, under names of the attempt, and are built by the same passes; memory
then holds a chunk and some numbers for each string, besides the strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

from sparkseek.llm import common

IN_MEMORY = 16 << 20
CHUNK = 1 << 20
#: of each suffix: the symbol before it (0 where a string begins), its common prefix with the suffix before, its length and string
ROW = np.dtype([("bwt", "u1"), ("lcp", "u1"), ("length", "<u2"), ("who", "<u4")])


class Columns:
    """One state of the columns: written in order, then read in order."""

    def __init__(self, total: int, folder: str | None, limit: int):
        self.total, self.parts, self.name = total, [], None
        if folder is not None and total > limit:
            self.store, path = common.open_fs(f"{folder}-{uuid.uuid4().hex}")
            self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.name, self.out = path, self.store.open_output_stream(path)

    def put(self, rows: np.ndarray) -> None:
        if self.name is None:
            self.parts.append(rows)
        else:
            self.out.write(rows.data)

    def close(self) -> Columns:
        if self.name is not None:
            self.out.close()
        elif len(self.parts) != 1:
            self.parts = [np.concatenate([*self.parts, np.zeros(0, ROW)])]
        return self

    def drop(self) -> None:
        self.parts = []
        if self.name is not None:
            self.store.delete_file(self.name)

    def reader(self):
        """A function that gives the next k rows."""
        at = 0
        file = self.store.open_input_stream(self.name) if self.name is not None else None

        def take(k: int) -> np.ndarray:
            nonlocal at
            at += k
            return np.frombuffer(file.read(k * ROW.itemsize), ROW) if file else self.parts[0][at - k : at]

        return take

    def chunks(self, size: int) -> Iterator[np.ndarray]:
        take = self.reader()
        for a in range(0, self.total, size):
            yield take(min(size, self.total - a))


def _least(lcp: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """min of lcp[after + 1 .. to] for each pair."""
    if not len(after):
        return np.zeros(0, dtype=lcp.dtype)
    bounds = np.empty(2 * len(after), dtype=np.int64)
    bounds[0::2], bounds[1::2] = after + 1, to + 1
    return np.minimum.reduceat(np.append(lcp, np.uint8(0)), bounds)[0::2]


def _scan(columns: Columns, at: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the ascending entries `at`: its symbol, how many equal ones are before it, the
    common prefix of the suffix it makes and of the next one (0 and -1 where there is none before
    or after); and how often each symbol occurs."""
    symbol, before = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    own, following = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    seen, since, waiting, base = np.zeros(256, np.int64), np.full(256, 255, np.int64), np.full(256, -1, np.int64), 0
    for rows in columns.chunks(chunk):
        bwt, lcp = rows["bwt"].copy(), rows["lcp"].copy()
        lo, hi = np.searchsorted(at, (base, base + len(bwt)))
        here = at[lo:hi] - base
        order = np.argsort(bwt, kind="stable")
        count = np.bincount(bwt, minlength=256)
        first = np.cumsum(count) - count  # of each symbol, in order
        rank = np.empty(len(bwt), dtype=np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        c, r = bwt[here].astype(np.int64), rank[here]
        symbol[lo:hi], before[lo:hi] = c, seen[c] + r - first[c]
        inside = r > first[c]
        own[lo:hi][inside] = _least(lcp, order[r[inside] - 1], here[inside]).astype(np.int64) + 1
        there = np.flatnonzero(count)
        if base:  # the first of each symbol meets the last one of earlier chunks
            from_start = np.minimum.accumulate(lcp)
            value = np.where(seen[c] > 0, np.minimum(since[c], from_start[here]) + 1, 0)
            own[lo:hi][~inside] = value[~inside]
            met = there[waiting[there] >= 0]
            following[waiting[met]] = np.minimum(since[met], from_start[order[first[met]]]) + 1
            waiting[met] = -1
        inside = r + 1 < first[c] + count[c]
        following[lo + np.flatnonzero(inside)] = _least(lcp, here[inside], order[r[inside] + 1]).astype(np.int64) + 1
        if base + len(bwt) < columns.total:
            waiting[c[~inside]] = lo + np.flatnonzero(~inside)
            to_end = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255)).astype(np.int64)
            since = np.minimum(since, to_end[0])
            since[there] = to_end[order[first[there] + count[there] - 1] + 1]
        seen += count
        base += len(bwt)
    return symbol, before, own, following, seen


def _rows(bwt, lcp, length, who: np.ndarray) -> np.ndarray:
    out = np.empty(len(who), dtype=ROW)
    out["bwt"], out["lcp"], out["length"], out["who"] = bwt, lcp, length, who
    return out


def build(flat: np.ndarray, starts: np.ndarray, folder: str | None = None, limit: int = IN_MEMORY, chunk: int = CHUNK) -> Columns:
    """The columns of the strings flat[starts[i]:starts[i+1]], which hold no 0 and are at most
    254 long.  The first len(starts) - 1 entries are the empty suffixes, in the order of the
    strings, which also breaks ties."""
    lengths = np.diff(starts)
    n = len(lengths)
    who = at = np.arange(n)
    last = np.where(lengths > 0, flat[np.maximum(starts[1:] - 1, 0)] if len(flat) else 0, 0)
    columns = Columns(n, folder, limit)
    columns.put(_rows(last, 0, 0, who))
    columns.close()
    for length in range(1, int(lengths.max(initial=0)) + 1):
        symbol, before, own, following, seen = _scan(columns, at, chunk)
        begins = n + np.append(0, np.cumsum(seen[1:]))[:255]  # the first suffix of each symbol from 1 on
        goes = symbol > 0
        places = begins[symbol[goes] - 1] + before[goes]
        order = np.argsort(places)
        at, who, own, following = places[order], who[goes][order], own[goes][order], following[goes][order]
        left = starts[who + 1] - length - 1
        preceding = np.where(left >= starts[who], flat[np.maximum(left, 0)], 0)
        new = _rows(preceding, own, length, who).view("<u8")
        behind, changed = at[following >= 0] + 1, following[following >= 0]
        merged = Columns(columns.total + len(at), folder, limit)
        take = columns.reader()
        for a in range(0, merged.total, chunk):
            b = min(a + chunk, merged.total)
            lo, hi = np.searchsorted(at, (a, b))
            stays = np.ones(b - a, dtype=bool)
            stays[at[lo:hi] - a] = False
            both = np.empty(b - a, dtype="<u8")
            both[stays], both[at[lo:hi] - a] = take(b - a - (hi - lo)).view("<u8"), new[lo:hi]
            lo, hi = np.searchsorted(behind, (a, b))
            both.view(ROW)["lcp"][behind[lo:hi] - a] = changed[lo:hi]
            merged.put(both.view(ROW))
        columns.drop()
        columns = merged.close()
    return columns
