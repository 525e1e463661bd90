"""Copies of images that were cropped or edited, by local descriptors.

Images are 8-bit gray PGM files (P5) in a binary column.

1. Corners: maxima of the Harris response at LEVELS sizes, each half the last.
2. Each corner has an orientation (from the patch to its centre of gravity) and
   a descriptor of 128 comparisons of smoothed pixels, at places turned with it.
3. Tables: a descriptor is cut into TABLES parts, so two that differ in fewer
   bits than there are parts agree in one.  Corners match that agree in a part and
   differ in at most DIFFER bits.
4. Consensus: matches of an image with another vote for the turn, the size and
   the shift that would take one corner to the other.  The two are linked when enough
   corners agree on one.  Components of links are the classes.

All linked pairs are found, each file taken once: parts of the images are held against
all parts.  In the image of a pair with fewer corners, enough of these must agree, so some
of any that leave out fewer than enough do: the rarest are looked up, and only for pairs of
which FEW agree on a move the others are, too.  What this looks at grows with the
square of the images; the README has figures.  n_links counts the other images, copies
among them, that an image is linked to.

Identical files are linked by their hash and decided as the one of least id.  A null, empty or
unreadable image has no corners and is alone in its class; so is one of a single
gray.  Rows of one id are one image to each other.  Other columns are not read,
whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import blocks, common, encoding, graph, shingles

LEVELS = 2
RADIUS = 7  # of a patch
NEAR = 6  # a corner is the largest response this far around
LEAST = 0.01  # of the image's largest response
BITS, TABLES, TURNS = 128, 3, 32
SHIFT = 4.0  # pixels of one bin of shifts
DIFFER = 40  # bits of 128 in which matching descriptors may differ; by chance 64 do, fewer than 41 in one of 30,000 pairs
FEW = 3  # corners that must agree among those looked up
MATCHES, SHARE = 6, 0.25  # corners that must agree: so many, and so large a part of those of the image with fewer
BLOCK = 1 << 20
PART = 8 << 20  # bytes of images that are held against as many others at once
AT_ONCE = 1 << 16  # pixels that are described at once
LOOKED, CELLS = 1 << 19, 20  # matches looked at once, and bits of the cells that pairs of images are counted in
USUAL, SAMPLE = 17, 64  # bits of keys that are counted, over so many blocks, to tell rare ones
NULL_ID = -(1 << 63)
CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("level", "u1"), ("turn", "u1"), ("bits", "u1", (BITS // 8,))])
_LINES = 80  # characters of a rendered line


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a P5 file of 8 bits, or None."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head or int(head[3]) > 255:
        return None
    width, height = int(head[1]), int(head[2])
    pixels = np.frombuffer(data, np.uint8, offset=head.end())
    return pixels[: width * height].reshape(height, width) if width * height and len(pixels) >= width * height else None


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _box(x: np.ndarray) -> np.ndarray:
    """Mean of 3 x 3 around each pixel; edges repeat.

    Sums run over the flat array, which is far quicker than by rows; what they take from other rows or images is put right."""
    for axis in (1, 2):
        step = x.shape[2] if axis == 1 else 1
        out, flat = x.copy(), x.reshape(-1)
        sums, at, ends = out.reshape(-1), np.moveaxis(x, axis, 0), np.moveaxis(out, axis, 0)
        sums[step:] += flat[:-step]
        sums[:-step] += flat[step:]
        ends[0] = at[0] + at[0] + at[min(1, len(at) - 1)]
        ends[-1] = at[max(-2, -len(at))] + at[-1] + at[-1]
        x = out
    x *= np.float32(1 / 9)
    return x


def _largest(x: np.ndarray, reach: int) -> np.ndarray:
    """The largest value up to `reach` rows and columns around each pixel."""
    n, height, width = x.shape
    wide = width + 2 * reach
    p = np.full((n, height + 2 * reach, wide), -np.inf, dtype=x.dtype)
    p[:, reach : reach + height, reach : reach + width] = x
    best = p.reshape(-1)
    for step in (1, wide):
        span = 1  # largest of `span` from each place on, doubled until the window is covered
        while 2 * span <= 2 * reach + 1:
            best = np.maximum(best[: len(best) - span * step], best[span * step :])
            span *= 2
        rest = (2 * reach + 1 - span) * step
        best = np.maximum(best[: len(best) - rest], best[rest:])
    out = np.empty(p.size, dtype=x.dtype)
    out[: len(best)] = best
    return out.reshape(p.shape)[:, :height, :width]


def _tests() -> np.ndarray:
    """For each turn and comparison, two places in a patch as flat offsets."""
    rng = np.random.default_rng(7)
    pairs = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    angles = 2 * np.pi * np.arange(TURNS) / TURNS
    turned = np.stack([[np.cos(angles), -np.sin(angles)], [np.sin(angles), np.cos(angles)]]).transpose(2, 0, 1)
    places = np.rint(np.einsum("tij,bpj->tbpi", turned, pairs)).astype(np.int64) + RADIUS
    return places[..., 1] * (2 * RADIUS + 1) + places[..., 0]


_TESTS = _tests()
_SIDE = np.arange(-RADIUS, RADIUS + 1)
_DISC = (_SIDE[:, None] ** 2 + _SIDE**2 <= RADIUS**2).astype(np.float32)
_MOMENTS = np.stack([(_DISC * _SIDE).ravel(), (_DISC * _SIDE[:, None]).ravel()], axis=1)


def corners(stack: np.ndarray, heights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Corners (CORNER) of images of one width, and the number of each one's image.

    Rows of an image beyond its height are of 255, as all around it: they change nothing but what is cut here."""
    out, of = [], []
    ends = (heights if heights is not None else np.full(len(stack), stack.shape[1])) + 2 * (RADIUS + 1)
    level_image = np.pad(stack.astype(np.float32), ((0, 0), (RADIUS + 1,) * 2, (RADIUS + 1,) * 2), constant_values=255)
    for level in range(LEVELS):
        _, height, width = level_image.shape
        if min(height, width) <= 2 * RADIUS + 2:
            break
        smooth = _box(level_image)
        dy, dx, flat = np.zeros_like(smooth), np.zeros_like(smooth), smooth.reshape(-1)
        dy[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        np.subtract(flat[2:], flat[:-2], out=dx.reshape(-1)[1:-1])
        dx[:, :, 0] = dx[:, :, -1] = 0
        a, b, c = _box(dx * dx), _box(dy * dy), _box(dx * dy)
        response = a * b
        response -= c * c
        a += b
        a *= a
        a *= np.float32(0.05)
        response -= a
        top = response.max(axis=(1, 2), keepdims=True)
        found = response == _largest(response, NEAR)
        found &= response > np.maximum(LEAST * top, np.float32(1))
        found[:, :RADIUS] = False
        found &= (np.arange(height) < np.where(ends > 2 * RADIUS + 2, ends - RADIUS, 0)[:, None])[:, :, None]
        found[:, :, :RADIUS] = found[:, :, -RADIUS:] = False
        spot = np.flatnonzero(found)
        image, y, x = np.unravel_index(spot, found.shape)
        if len(image):
            patches = smooth.reshape(-1)[spot[:, None] + (_SIDE[:, None] * width + _SIDE).ravel()]
            moments = patches @ _MOMENTS
            turn = np.rint(np.arctan2(moments[:, 1], moments[:, 0]) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            begin = (np.arange(len(image)) * patches.shape[1])[:, None]
            bits = patches.reshape(-1)[_TESTS[turn, :, 0] + begin] < patches.reshape(-1)[_TESTS[turn, :, 1] + begin]
            found_here = np.zeros(len(image), dtype=CORNER)
            found_here["x"], found_here["y"] = (x - RADIUS - 1 if level == 0 else x) << level, (y - RADIUS - 1 if level == 0 else y) << level
            if level:
                found_here["x"] -= RADIUS + 1
                found_here["y"] -= RADIUS + 1
            found_here["level"], found_here["turn"] = level, turn
            found_here["bits"] = np.packbits(bits, axis=1)
            out.append(found_here)
            of.append(image)
        h, w = height // 2 * 2, width // 2 * 2
        even = level_image[:, :h, :w]
        level_image = (even[:, ::2, ::2] + even[:, 1::2, ::2] + even[:, ::2, 1::2] + even[:, 1::2, 1::2]) / np.float32(4)
        ends = ends // 2
    if not out:
        return np.zeros(0, CORNER), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def describe(images: list[bytes | None]) -> list[bytes | None]:
    """For each file: its 64-bit hash and its corners, or None."""
    pixels = [read_pgm(d) for d in images]
    order = sorted((i for i, p in enumerate(pixels) if p is not None), key=lambda i: pixels[i].shape[::-1])
    out: list[bytes | None] = [None] * len(images)
    while order:
        low, width = pixels[order[0]].shape
        tall = low + max(4, low // 8)  # what is stacked is filled up to the height of the last
        part = order[: max(1, AT_ONCE // (tall * width))]
        part = [i for i in part if pixels[i].shape[1] == width and len(pixels[i]) <= tall]
        order = order[len(part) :]
        heights = np.array([len(pixels[i]) for i in part])
        stack = np.full((len(part), heights[-1], width), 255, np.uint8)
        for k, i in enumerate(part):
            stack[k, : heights[k]] = pixels[i]
        found, of = corners(stack, heights)
        by_image = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by_image], np.arange(len(part) + 1))
        for k, i in enumerate(part):
            out[i] = xxhash.xxh3_64_digest(images[i]) + found[by_image[cuts[k] : cuts[k + 1]]].tobytes()
    return out


def _group_keys(bits: np.ndarray) -> np.ndarray:
    """TABLES keys of each descriptor."""
    width = BITS // 8
    edges = [width * i // TABLES for i in range(TABLES + 1)]
    keys = []
    for t in range(TABLES):
        part = np.zeros((len(bits), 8), dtype=np.uint8)
        part[:, : edges[t + 1] - edges[t]] = bits[:, edges[t] : edges[t + 1]]
        keys.append(shingles.mix(part.view("<u8").ravel() * np.uint64(TABLES + 1) + np.uint64(t)))
    return np.stack(keys, axis=1) if len(bits) else np.zeros((0, TABLES), np.uint64)


def _packed(corners: np.ndarray) -> np.ndarray:
    x, y, turn, level = (corners[n].astype(np.uint64) for n in ("x", "y", "turn", "level"))
    return x | y << np.uint64(16) | (turn | level << np.uint64(5)) << np.uint64(32)


def _place_columns(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low, five = np.uint64(0xFFFF), np.uint64(31)
    x, y = (places & low).astype(np.float64), (places >> np.uint64(16) & low).astype(np.float64)
    return x, y, (places >> np.uint64(37)).astype(np.int64), (places >> np.uint64(32) & five).astype(np.int64)


def agreeing(image: np.ndarray, corner: np.ndarray, other: np.ndarray, here: np.ndarray, there: np.ndarray, least: int = MATCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, other, corners) of each pair with `least` or more: the most corners that agree on one move."""
    names, other = np.unique(other, return_inverse=True)
    pairs, pair = np.unique(image * np.int64(max(len(names), 1)) + other, return_inverse=True)
    enough = np.bincount(pair, minlength=len(pairs))[pair] >= least
    pair, corner, here, there = pair[enough], corner[enough], here[enough], there[enough]
    x, y, level, turn = _place_columns(here)
    x2, y2, level2, turn2 = _place_columns(there)
    size = 2.0 ** (level - level2)
    turned = (turn - turn2) % TURNS
    angle = 2 * np.pi * turned / TURNS
    dx = x - size * (np.cos(angle) * x2 - np.sin(angle) * y2)
    dy = y - size * (np.sin(angle) * x2 + np.cos(angle) * y2)
    kind = ((pair * (2 * LEVELS - 1) + level - level2 + LEVELS - 1) * TURNS + turned).astype(np.int64) << 34  # and 17 bits for a shift each way
    best = np.zeros(len(pairs), dtype=np.int64)
    for ox in (0, 0.5):  # bins overlap by half
        for oy in (0, 0.5):
            move = kind + (np.floor(dx / SHIFT + ox).astype(np.int64) + (1 << 16) << 17) + np.floor(dy / SHIFT + oy).astype(np.int64) + (1 << 16)
            bin_ = (move.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS)).astype(np.int64)
            full = np.flatnonzero(np.bincount(bin_, minlength=1)[bin_] >= least)  # bins that share a number are sorted out below
            order = full[np.lexsort((corner[full], move[full]))]
            k, c = move[order], corner[order]
            cell = np.append(True, k[1:] != k[:-1])[: len(k)]
            fresh = cell | np.append(True, c[1:] != c[:-1])[: len(k)]  # a corner counts once
            votes = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(cell)) if len(k) else np.zeros(0, np.int64)
            np.maximum.at(best, pair[order][cell], votes)
    hit = np.flatnonzero(best >= least)
    return pairs[hit] // max(len(names), 1), names[pairs[hit] % max(len(names), 1)], best[hit]


def _enough(n: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    return n >= np.maximum(MATCHES, SHARE * np.minimum(size, other))


def linked(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether the images of each pair, given by all their corners, are linked."""
    good = np.zeros(len(pairs), dtype=bool)
    if not pairs:
        return good
    sizes = np.array([[len(x), len(y)] for x, y in pairs])
    left, right = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    of_left, of_right = (np.repeat(np.arange(len(pairs)), sizes[:, k]) for k in (0, 1))
    odd, found = np.uint64(0x9E3779B97F4A7C15), []
    keys_left, keys_right = (_group_keys(c["bits"]) + (of.astype(np.uint64) * odd)[:, None] for c, of in ((left, of_left), (right, of_right)))
    for t in range(TABLES):
        order = np.argsort(keys_right[:, t])
        held = keys_right[order, t]
        lo = np.searchsorted(held, keys_left[:, t])
        count = np.searchsorted(held, keys_left[:, t], "right") - lo
        one = np.repeat(np.arange(len(left)), count)
        found.append(one * len(right) + order[np.arange(len(one)) - np.repeat(np.cumsum(count) - count - lo, count)])
    match = np.unique(np.concatenate(found))
    i, j = match // max(len(right), 1), match % max(len(right), 1)
    apart = np.ascontiguousarray(left["bits"][i]).view("<u8") ^ np.ascontiguousarray(right["bits"][j]).view("<u8")
    near = (of_left[i] == of_right[j]) & (np.bitwise_count(apart).sum(axis=1) <= DIFFER)
    i, j = i[near], j[near]
    pair, _, n = agreeing(of_left[i], i, of_right[j], _packed(left[i]), _packed(right[j]))
    good[pair] = _enough(n, sizes[pair, 0], sizes[pair, 1])
    return good


def _most(corners: np.ndarray, image: np.ndarray, n_images: int) -> np.ndarray:
    """For each image, a bound of its corners (of one level and turn) that agree with one corner on one move."""
    kind = (image * LEVELS + corners["level"]) * TURNS + corners["turn"]
    order = np.argsort(kind << 16 | corners["y"], kind="stable")
    kind, x, y = kind[order], corners["x"][order].astype(np.int64), corners["y"][order].astype(np.int64)
    near, at, step = np.ones(len(order), dtype=np.int64), np.arange(len(order)), 1
    while len(at):
        at = at[: np.searchsorted(at, len(order) - step)]
        at = at[(kind[at] == kind[at + step]) & (y[at + step] - y[at] <= SHIFT)]
        close = at[np.abs(x[at] - x[at + step]) <= SHIFT]
        near[close] += 1
        near[close + step] += 1
        step += 1
    out = np.ones(n_images, dtype=np.int64)
    np.maximum.at(out, image[order], near)
    return out


def _least_votes(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Corners that must agree to link images of n and other corners."""
    return np.maximum(MATCHES, np.ceil(SHARE * np.minimum(n, other)).astype(np.int64))


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit keys: by their first bits and their places as one number, unless that leaves some out of order."""
    low = np.uint64(max(len(keys) - 1, 1).bit_length())
    both = (keys >> low << low) + np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    held = keys[order]
    return np.argsort(keys, kind="stable") if (held[1:] < held[:-1]).any() else order


class Part:
    """Images of MATCHES corners or more and their corners by key.

    Images are in runs by `most`, of 1, of 2 and above, those with fewer corners first in each.
    usual[i] is about how many corners have keys that begin with the bits of i; `rank` orders the
    corners of an image by that, rare ones first.  It settles what is looked at, not what is found.
    Entries are a corner and a table each, by key and then by image."""

    def __init__(self, ids: np.ndarray, files: list[bytes], usual: np.ndarray):
        held = [k for k in range(len(files)) if len(files[k]) >= 8 + MATCHES * CORNER.itemsize]
        n = np.array([(len(files[k]) - 8) // CORNER.itemsize for k in held], dtype=np.int64)
        corners = np.frombuffer(b"".join(files[k][8:] for k in held), CORNER)
        most = _most(corners, np.repeat(np.arange(len(held)), n), len(held))
        by = np.lexsort((n, np.minimum(most, 3)))
        held, starts = [held[k] for k in by], (np.cumsum(n) - n)[by]
        self.n, self.most = n[by], most[by]
        self.starts = np.cumsum(self.n) - self.n
        self.runs = [(int(x), int(y)) for x, y in itertools.pairwise(np.searchsorted(np.minimum(self.most, 3), [1, 2, 3, 4])) if x < y]
        corners = corners[encoding.gather(np.arange(len(corners)), starts, self.n)]
        self.corners = corners
        self.ids = np.asarray(ids, np.int64)[held]
        self.hashes = np.array([int.from_bytes(files[k][:8], "little", signed=True) for k in held], dtype=np.int64)
        self.image = np.repeat(np.arange(len(held), dtype=np.int32), self.n)
        self.words = np.ascontiguousarray(corners["bits"]).view("<u8").reshape(-1, 2)
        self.packed = _packed(corners)
        keys = _group_keys(corners["bits"])
        seen = usual[_bins(keys)].sum(axis=1)
        self.by_rank = np.argsort(self.image * (seen.max(initial=0) + 1) + seen, kind="stable").astype(np.int32)
        self.rank = np.empty(len(corners), dtype=np.int32)
        self.rank[self.by_rank] = np.arange(len(corners)) - self.starts[self.image]
        flat = keys.ravel()
        order = _in_order(flat)
        flat = flat[order]
        fresh = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        self.names = flat[fresh]
        self.entry_name = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.which = np.empty(len(order), dtype=np.int32)
        self.which[order] = self.entry_name
        self.which = self.which.reshape(-1, TABLES)
        self.entry = (order // TABLES).astype(np.int32)
        self.entry_table = (order % TABLES).astype(np.int8)
        self.entry_image = self.image[self.entry]
        self.entry_cell = self.entry_image.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.entry_known = [np.ascontiguousarray(self.which[:, t])[self.entry] for t in range(TABLES - 1)]
        self.place = self.entry_name * np.int64(max(len(held), 1)) + self.entry_image  # name and image in one number
        self.ptr = np.append(np.flatnonzero(fresh), len(order)).astype(np.int32)
        self._rarest: dict[int, np.ndarray] = {}
        self.ends = [np.searchsorted(self.place, np.arange(len(self.names)) * len(held) + end).astype(np.int32) for _, end in self.runs]

    def rarest(self, most: int) -> np.ndarray:
        """Entries of the corners that are looked up against images of which so many corners agree with one; kept for the next."""
        if most not in self._rarest:
            c = -(-_least_votes(self.n, self.n) // most)
            self._rarest[most] = np.flatnonzero((self.rank < (self.n - c + np.minimum(FEW, c))[self.image])[self.entry]).astype(np.int32)
        return self._rarest[most]

    def of(self, i: int) -> np.ndarray:
        return self.corners[self.starts[i] : self.starts[i] + self.n[i]]


def _same(q: Part, o: Part) -> np.ndarray:
    """For each name of q, the place of the same among those of o, or -1."""
    if len(q.names) > len(o.names):
        return _turned(_same(o, q), len(q.names))
    if not len(q.names):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(o.names, q.names), len(o.names) - 1)
    return np.where(o.names[at] == q.names, at, -1).astype(np.int32)


def _turned(same: np.ndarray, n: int) -> np.ndarray:
    """What _same() gives the other way round, for n names there."""
    out = np.full(n, -1, dtype=np.int32)
    known = np.flatnonzero(same >= 0)
    out[same[known]] = known
    return out


def _expanded(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each range and its places, for ranges of `count` from lo on."""
    kind = np.int32 if max(int(count.sum()), int(lo.max(initial=0))) < 1 << 30 else np.int64
    one = np.repeat(np.arange(len(count), dtype=kind), count)
    return one, np.arange(len(one), dtype=kind) + (lo - (np.cumsum(count) - count)).astype(kind)[one]


class _Pairs:
    """Links of the images of q with those of o that have as many corners or more, or as many and a smaller id.

    A link needs `least` agreeing corners of the image of larger id.  If that is the one of o, up to `most`
    of them agree with one corner of q, so c = least / most corners of q agree on its move; else c = least do.
    Of these, `few` at least are among any n - c + few of the n corners: the rarest are looked up, and
    pairs of which few agree there are decided by the other corners as well."""

    def __init__(self, q: Part, o: Part, same: np.ndarray):
        self.q, self.o, self.known = q, o, same[q.which]
        self.least = _least_votes(q.n, q.n)
        self.entry_name = same[q.entry_name]

    def needed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs: whether q's image has the larger id, the few that must agree, and how many corners are looked up."""
        later = self.q.ids[i] > self.o.ids[j]
        c = np.where(later, self.least[i], -(-self.least[i] // self.o.most[j]))
        few = np.minimum(FEW, c)
        return later, few, self.q.n[i] - c + few

    def looked(self, run: int) -> Iterator[tuple[np.ndarray, np.ndarray] | tuple[int, int]]:
        """Matches (corners of q and o) of pairs that may be linked, pairs whole; or a pair with more than LOOKED of them."""
        q, o, n_other = self.q, self.o, len(self.o.n)
        start, stop = o.runs[run]
        most = int(o.most[start:stop].max())
        few, some = min(FEW, -(-MATCHES // most)), q.rarest(most)
        name = self.entry_name[some]
        known = np.flatnonzero(np.append(o.ends[run] > o.ends[run - 1] if run else o.ends[run] > o.ptr[:-1], False)[name])  # -1 is the last
        some, name = some[known], name[known].astype(np.int64)
        image, end = q.entry_image[some], o.ends[run][name]
        first = start + np.searchsorted(o.n[start:stop], q.n)
        begin = np.searchsorted(o.place, name * n_other + first[image])
        full = np.flatnonzero(begin < end)
        if not len(full):
            return
        full = np.sort(image[full].astype(np.int64) << 32 | full) & 0xFFFFFFFF  # by image
        some, name, image, begin, end = some[full], name[full], image[full], begin[full], end[full]
        corner, table = q.entry[some], q.entry_table[some]
        rank = q.rank[corner]
        before = [np.where(table > t, self.known[corner, t], np.int32(-2)) for t in range(TABLES - 1)]
        cell = image.astype(np.uint32) * np.uint32(0x85EBCA77)
        total = np.cumsum(end - begin)
        cuts = np.unique(image[np.searchsorted(total, np.arange(0, total[-1], LOOKED // 2), "right")])
        todo = [(a, b, start, stop) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q.n)], strict=True)]
        while todo:
            a, b, c, d = todo.pop()
            own = slice(*np.searchsorted(image, (a, b)))
            lo, hi = begin[own], end[own]
            if (c, d) != (start, stop):
                lo = np.maximum(lo, np.searchsorted(o.place, name[own] * n_other + c))
                hi = np.minimum(hi, np.searchsorted(o.place, name[own] * n_other + d))
            count = np.maximum(hi - lo, 0)
            if count.sum() > LOOKED and (b - a > 1 or d - c > 1):
                half, middle = (a + b) // 2, (c + d) // 2
                todo += [(a, half, c, d), (half, b, c, d)] if b - a > 1 else [(a, b, c, middle), (a, b, middle, d)]
                continue
            if count.sum() > LOOKED:  # many equal patches: held against each other whole
                yield a, c
                continue
            e, at = _expanded(lo, count)
            again = np.zeros(len(e), dtype=bool)  # known by an earlier table
            for there, here in zip(o.entry_known, before, strict=True):
                again |= there[at] == here[own][e]
            e, at = e[~again], at[~again]
            for near in (False, True):
                if near:
                    i, j = image[own][e], o.entry_image[at]
                    later, _, limit = self.needed(i, j)
                    hit = ((q.n[i] < o.n[j]) | later) & (q.ids[i] != o.ids[j]) & (rank[own][e] < limit)
                    e, at = e[hit], at[hit]
                pair = (cell[own][e] + o.entry_cell[at] >> np.uint32(32 - CELLS)).astype(np.int64)
                hit = np.bincount(pair, minlength=1)[pair] >= few  # pairs that share a cell are sorted out below
                e, at = e[hit], at[hit]
            one, other = corner[own][e], o.entry[at]
            hit = np.bitwise_count(q.words[one] ^ o.words[other]).sum(axis=1) <= DIFFER
            if hit.any():
                yield one[hit], other[hit]

    def agreed(self, corner: np.ndarray, one: np.ndarray, other: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """agreeing() for matches; moves are of the image of smaller id, as in linked()."""
        q, o = self.q, self.o
        i, j = q.image[one].astype(np.int64), o.image[other]
        later = q.ids[i] > o.ids[j]
        here, there = np.where(later, q.packed[one], o.packed[other]), np.where(later, o.packed[other], q.packed[one])
        return agreeing(i, np.where(later, one, other) if corner is None else corner, j, here, there, least)

    def rest(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matches of pairs by the corners of q that were not looked up."""
        q, o, n_other = self.q, self.o, len(self.o.n)
        pair, at = _expanded(q.starts[i] + limit, q.n[i] - limit)
        one = q.by_rank[at]
        which = self.known[one]
        k, table = np.nonzero(which >= 0)
        place = which[k, table] * np.int64(n_other) + j[pair[k]]
        lo = np.searchsorted(o.place, place)
        found = np.flatnonzero(o.place[np.minimum(lo, len(o.place) - 1)] == place)
        k, table, lo, place = k[found], table[found], lo[found], place[found]
        e, at = _expanded(lo, np.searchsorted(o.place, place, "right") - lo)
        one, other, table, which = one[k][e], o.entry[at], table[e], which[k][e]
        good = np.bitwise_count(q.words[one] ^ o.words[other]).sum(axis=1) <= DIFFER
        for t in range(TABLES - 1):
            good &= (table <= t) | (which[:, t] != o.which[other, t])
        return one[good], other[good]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        q, o, n_other = self.q, self.o, len(self.o.n)
        for run, (start, stop) in enumerate(o.runs):
            few = min(FEW, -(-MATCHES // int(o.most[start:stop].max())))
            for one, other in self.looked(run):
                if isinstance(one, int):
                    i, j = np.array([one]), np.array([other])
                    if (q.ids[i] != o.ids[j]) & ((q.n[i] < o.n[j]) | (q.ids[i] > o.ids[j])):
                        yield (i, j) if linked([(q.of(one), o.of(other)) if q.ids[one] > o.ids[other] else (o.of(other), q.of(one))])[0] else (i[:0], j[:0])
                    continue
                i, j, n = self.agreed(one, one, other, few)
                later, enough, limit = self.needed(i, j)
                sure = later & (n >= self.least[i])
                yield i[sure], j[sure]
                open_ = np.flatnonzero(~sure & (n >= enough))
                if not len(open_):
                    continue
                i, j, limit = i[open_], j[open_], limit[open_]
                name, of = i * n_other + j, q.image[one].astype(np.int64) * n_other + o.image[other]
                size = np.cumsum(q.n[i] - limit)
                cuts = np.unique(np.append(0, np.searchsorted(size, np.arange(LOOKED, size[-1], LOOKED)))).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(i)], strict=True):
                    at = np.minimum(np.searchsorted(name[a:b], of), b - a - 1)
                    mine = np.flatnonzero(name[a:b][at] == of)
                    more, others = self.rest(i[a:b], j[a:b], limit[a:b])
                    x, y, n = self.agreed(None, np.concatenate([one[mine], more]), np.concatenate([other[mine], others]), MATCHES)
                    good = n >= self.least[x]
                    yield x[good], y[good]


def part_links(q: Part, o: Part, same: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of LINKS: the linked images found from q's side."""
    if len(q.n) and len(o.n):
        for i, j in _Pairs(q, o, _same(q, o) if same is None else same).links():
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q.ids[i], q.hashes[i], o.ids[j], o.hashes[j])], _NAMES)


LINKS = "a long, file_a long, b long, file_b long"
_NAMES = [x.split()[0] for x in LINKS.split(", ")]


def _bins(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - USUAL)).astype(np.int64)


def _usual(held: blocks.Blocks) -> np.ndarray:
    """How often keys that begin alike occur, by at most SAMPLE blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << USUAL, dtype=np.int64)
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                corners = np.frombuffer(b"".join(f[8:] for f in blocks.read(uri).column("text").to_pylist() if f), CORNER)
                total += np.bincount(_bins(_group_keys(corners["bits"])).ravel(), minlength=1 << USUAL)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 0xFFFF).astype("<u2").tobytes()])], ["counts"])

    some = held.table.orderBy(F.xxhash64("block"), "block").limit(SAMPLE).repartition(min(6, max(1, held.n)))
    total = np.zeros(1 << USUAL, dtype=np.int64)
    for row in some.select("uri").mapInArrow(common.trimmed(run), "counts binary").collect():  # in one job, of a few rows
        total += np.frombuffer(row["counts"], "<u2")
    return total


def copy_classes(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """A row per image: image_id, class_id (the least id of its class), n_links (images it is linked to)."""
    rows = images.select(F.col(id_col).cast("long").alias("doc_id"), F.col(image_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in encoding.slices(batch):
                found = pa.array(describe(part.column("text").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "text"])

    return _classes(rows.mapInArrow(common.trimmed(run), "doc_id long, text binary"))


def _files(held: blocks.Blocks) -> DataFrame:
    """block, uri, id and file (its hash; null without one) of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, uri in zip(batch.column("block").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                rows = blocks.read(uri)
                file = [int.from_bytes(f[:8], "little", signed=True) if f else None for f in rows.column("text").to_pylist()]
                columns = [pa.array([block] * len(file), pa.int64()), rows.column("doc_id").fill_null(NULL_ID).combine_chunks(), pa.array(file, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "id", "file"])

    spread = held.table.select("block", "uri").repartition(max(1, min(held.n, max(24, held.n // 8))))
    return common.stored(spread.mapInArrow(common.trimmed(run), "block long, id long, file long"), "media-files")


def _write_copies(files: DataFrame, folder: str) -> set[int]:
    """For each block with images whose file a smaller id has: a file of these, id and hash.  Returns these blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.array([[r["id"], r["file"]] for r in row["rows"]], dtype="<i8")
                common.write_file(f"{folder}/{row['block']}", pairs.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64())], ["block"])

    least = files.filter("file IS NOT NULL").groupBy("file").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last")
    copies = files.join(least, "file").filter("id > least").select("block", "id", "file").distinct()
    rows = copies.groupBy("block").agg(F.collect_list(F.struct("id", "file")).alias("rows"))
    return {r["block"] for r in common.stored(rows.mapInArrow(common.trimmed(run), "block long"), "media-copies").collect()}


def _read_part(members: list[tuple[int, str]], copied: set[int], folder: str, usual: np.ndarray) -> Part:
    """The images of some blocks, each file once."""
    ids, files, seen = [], [], set()
    for block, uri in members:
        if block in copied:
            seen.update(map(tuple, np.frombuffer(common.read_file(f"{folder}/{block}"), "<i8").reshape(-1, 2).tolist()))
        table = blocks.read(uri)
        for i, f in zip(table.column("doc_id").fill_null(NULL_ID).to_pylist(), table.column("text").to_pylist(), strict=True):
            name = (i, int.from_bytes(f[:8], "little", signed=True)) if f else None
            if name and name not in seen:
                seen.add(name)
                ids.append(i)
                files.append(f)
    return Part(np.array(ids, np.int64), files, usual)


def _linked_files(held: blocks.Blocks, files: DataFrame) -> DataFrame:
    """Rows of LINKS for all images, each file once: every part of the images is held against every part."""
    spark = files.sparkSession
    folder = common.work_dir(spark, "media-copies-of")
    copied, usual = _write_copies(files, folder), _usual(held)
    listed = held.table.select("block", "uri", "bytes").orderBy("block").collect()
    limit = min(PART, max(PART // 32, sum(r["bytes"] for r in listed) // 6))
    parts, size = [[]], 0
    for r in listed:
        if parts[-1] and size + r["bytes"] > limit:
            parts.append([])
            size = 0
        parts[-1].append((r["block"], r["uri"]))
        size += r["bytes"]
    n = len(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_parts: dict[int, Part] = {}
        for batch in batches:
            for k in batch.column("id").to_pylist():
                i = int((math.isqrt(8 * k + 1) - 1) // 2)
                both = (i, k - i * (i + 1) // 2)  # pair k of those with a first part not before the second
                for x in set(held_parts) - set(both):
                    del held_parts[x]
                for x in both:
                    if x not in held_parts:
                        held_parts[x] = _read_part(parts[x], copied, folder, usual)
                q, o = (held_parts[x] for x in both)
                same = _same(q, o)
                yield from part_links(q, o, same)
                if q is not o:
                    yield from part_links(o, q, _turned(same, len(o.names)))
                del q, o, same  # else held while the next are read

    pairs = n * (n + 1) // 2
    return common.stored(spark.range(0, pairs, 1, min(pairs, max(24, pairs // 16))).mapInArrow(common.trimmed(run), LINKS), "media-links")


def _link_counts(files: DataFrame, links: DataFrame) -> DataFrame:
    """id, links: how many other images each is linked to, by links between files.

    Links are counted by file.  Only those to files with copies are joined, to add the copies,
    and those of files of ids with several files, which count by id: copies are not paired."""
    own = files.filter("file IS NOT NULL").select("id", "file").distinct()
    several = own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("several"))
    own = common.stored(own.join(several, "id", "left").select("id", "file", F.coalesce("several", F.lit(False)).alias("several")), "media-own")
    by_file = own.groupBy("file").agg(F.count_if(~F.col("several")).alias("n"))
    next_to = links.select("file_a", "file_b").union(links.select("file_b", "file_a")).union(own.select("file", "file")).toDF("x", "file")
    next_to = common.stored(next_to.distinct(), "media-next")
    # of ids with one file: a neighbour each, and what files of more or fewer such ids add
    more = by_file.filter("n <> 1").select("file", (F.col("n") - 1).alias("n"))
    ones = next_to.groupBy("x").agg(F.count("*").alias("n")).union(next_to.join(more, "file").groupBy("x").agg(F.sum("n").alias("n")))
    many = own.filter("several").select("file", "id")
    others = next_to.join(many, "file").select("x", "id").distinct().groupBy("x").agg(F.count("*").alias("n"))
    per_file = ones.union(others).groupBy("x").agg((F.sum("n") - 1).alias("links"))  # but for itself
    single = own.filter("NOT several").join(per_file, F.col("file") == F.col("x")).select("id", "links")
    reached = many.withColumnRenamed("file", "x").join(next_to, "x").select("id", "file").distinct()
    one_of = reached.join(by_file, "file").groupBy("id").agg(F.sum("n").alias("n"))
    met = reached.join(many.withColumnRenamed("id", "other"), "file").select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return single.union(one_of.union(met).groupBy("id").agg((F.sum("n") - 1).alias("links")))


def _classes(described: DataFrame) -> DataFrame:
    held = blocks.write(described, "media-blocks", BLOCK)
    files = _files(held)
    links = _linked_files(held, files)
    least = files.filter("file IS NOT NULL").groupBy("file").agg(F.min("id").alias("b"))
    copies = files.join(least, "file").filter("id <> b").select(F.col("id").alias("a"), "b")
    classes = graph.components(links.select("a", "b").union(copies))
    mine = files.select(F.col("id").alias("a"))
    out = mine.join(classes, mine.a == classes.node, "left").join(_link_counts(files, links).withColumnRenamed("id", "a"), "a", "left")
    as_id = lambda c: F.when(c == F.lit(NULL_ID), F.lit(None)).otherwise(c)
    return out.select(
        as_id(F.col("a")).alias("image_id"),
        as_id(F.coalesce("component", "a")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


_INK = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.uint8) + np.uint8(32)
_INK[[9, 10, 11, 12, 13, 32]] = 255
_DROP = re.compile(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->")
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h\d|tr|table|article|nav|footer|section|header|blockquote)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")


def render(html: str | None) -> bytes | None:
    """A small picture of a page: its visible text in lines of _LINES characters,
    each a pixel wide and two high, of a gray that depends on the character."""
    if not html:
        return None
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub("", html)))
    lines = [line[a : a + _LINES] for line in map(str.strip, text.split("\n")) if line for a in range(0, len(line), _LINES)]
    if not lines:
        return None
    grid = "".join(line.ljust(_LINES) for line in lines)
    codes = np.frombuffer(grid.encode("utf-16-le", "surrogatepass"), "<u2")
    if len(codes) != len(lines) * _LINES:  # characters beyond 16 bits count as one
        codes = np.minimum(np.frombuffer(grid.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)
    return write_pgm(np.repeat(_INK[codes].reshape(len(lines), _LINES), 2, axis=0))


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """image_id and image (PGM) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in encoding.slices(batch):
                drawn = pa.array([render(h) for h in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("image_id"), drawn], ["image_id", "image"])

    rows = pages.select(F.col(id_col).cast("long").alias("image_id"), F.col(html_col).alias("text"))
    return rows.mapInArrow(common.trimmed(run), "image_id long, image binary")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = render_pages(common.table(spark, sf_dir, "pages"))
    return copy_classes(pictures, "image_id", "image").withColumnRenamed("image_id", "page_id")
