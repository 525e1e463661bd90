import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.llm import blocks, bwt, graph, lm, media, ngram_join, suffix_dedup


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = {}
    for g in range(12):
        base = [word() for _ in range(rng.choice((20, 80, 200)))]
        for _ in range(rng.choice((1, 2, 8, 30))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    texts[len(texts)] = "too few"
    texts[len(texts)] = "too few"
    texts[len(texts)] = ""
    texts[len(texts)] = None
    return texts


def brute_classes(texts):
    sets, links, root = sets_of(texts), collections.Counter(), {i: i for i in texts}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (top(i), links[i]) for i in texts}


@pytest.mark.parametrize("block", [256, 5])
def test_join_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_classes(df).collect()}
    assert got == brute_classes(texts)


def test_join_odd(spark, odd_documents, no_documents):
    rows = ngram_join.join_classes(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[0][0].class_id == by[5][0].class_id == 0 and {r.class_id for r in by[4]} == {4}
    assert [(r.class_id, r.n_links) for i in (1, 2, 3) for r in by[i]] == [(1, 0), (2, 0), (3, 0)]
    assert ngram_join.join_classes(no_documents).isEmpty()


def test_climb_reaches_the_target():
    """Each set stops where the least similarity it can have is found; longer sets climb to the threshold's depth."""
    for n in range(1, 70):
        possible = [a / (n + m - a) for m in range(1, 100) for a in range(1, min(n, m) + 1) if 5 * a >= 4 * (n + m - a)]
        if n < ngram_join._FINE:
            assert ngram_join.least_similarity(n, 0.8) == min(possible)
        assert all(ngram_join.recall(s, ngram_join.stop_depth(n)) >= ngram_join.TARGET for s in possible)
    assert len({ngram_join.stop_depth(n) for n in range(1, 70)}) > 1


@pytest.mark.parametrize("size,edits", [(100, 11), (100, 5), (6, 1), (40, 4)])
def test_recall_of_labels(size, edits):
    """Pairs at a similarity from 0.8 to 0.9 that share no prefix at the stop of either."""
    rng, factors, missed = np.random.default_rng(size + edits), ngram_join._factors(), 0
    for _ in range(400):
        own = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        other = np.concatenate([own[edits:], rng.integers(0, 1 << 63, edits if size > 6 else 0, dtype=np.uint64)])
        assert len(np.intersect1d(own, other)) / len(np.union1d(own, other)) >= 0.8
        depth = max(ngram_join.stop_depth(len(own)), ngram_join.stop_depth(len(other)))
        a, b = (ngram_join.signature(x, factors).reshape(ngram_join.TREES, ngram_join.DEPTH)[:, :depth] for x in (own, other))
        missed += not (a == b).all(axis=1).any()
    assert missed <= 2


@pytest.mark.parametrize("few", [1, 24, 1000])
def test_intersections(monkeypatch, few):
    monkeypatch.setattr(ngram_join, "RARE", few)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if i < 30 else 5000, rng.integers(1, 80)).astype(np.uint64)) for i in range(60)]
    links, root = ngram_join.Links(0.5).find(sets, np.arange(60))
    linked = [[j for j in range(60) if j != i and 3 * len(np.intersect1d(sets[i], sets[j])) >= len(sets[i]) + len(sets[j])] for i in range(60)]
    assert links.tolist() == [sum(x) for x in linked] and all(root[i] == root[j] for i in range(60) for j in linked[i])


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_at_random(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400, i) for i in range(401, 450)] + [(i, 450) for i in range(440, 450)]
    root = {i: i for p in pairs for i in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == root


SYMBOLS = st.lists(st.binary(max_size=9).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8)


def columns_of(strings, *args):
    built = bwt.build(np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings])).astype(np.int64), *args)
    rows = built.reader()(built.total)
    return [rows[name].tolist() for name in ("bwt", "lcp", "who", "length")]


@settings(deadline=None, max_examples=80)
@given(SYMBOLS, st.sampled_from([1, 2, 3, 7, 1000]))
def test_transform(strings, chunk):
    transform, prefix, who, length = columns_of(strings, None, 0, chunk)
    suffixes = sorted(((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: (x[0] + b"\0", x[1]))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert transform == [strings[i][k - 1] if k else 0 for _, i, k in suffixes]
    assert prefix == [0] + [common(a[0], b[0]) for a, b in itertools.pairwise(suffixes)]
    assert who == [i for _, i, _ in suffixes] and length == [len(s) for s, _, _ in suffixes]


def test_transform_by_files(tmp_path):
    """Files hold the same; one state of them is left when the next is written."""
    strings = [b"banana", b"", b"ananas", b"bandana"] * 5
    assert columns_of(strings) == columns_of(strings, f"file://{tmp_path}/own", 10, 4)
    assert len(list(tmp_path.iterdir())) == 1


def test_repeats_by_files(tmp_path, monkeypatch):
    monkeypatch.setattr(bwt.build, "__defaults__", (None, 50, 64))
    monkeypatch.setattr(bwt, "CHUNK", 64)
    rng = np.random.default_rng(1)
    pool = rng.integers(97, 100, 400).astype(np.uint8)
    strings = [pool[a : a + n] for a, n in zip(rng.integers(0, 280, 60), rng.integers(50, 114, 60), strict=True)]
    starts, least = np.append(0, np.cumsum([len(s) for s in strings])), rng.permutation(60)
    first = {}
    for s, i in zip(strings, least, strict=True):
        for k in range(len(s) - 49):
            first[s[k : k + 50].tobytes()] = min(i, first.get(s[k : k + 50].tobytes(), 99))
    expected = [first[s[k : k + 50].tobytes()] for s in strings for k in range(len(s) - 49)]
    assert suffix_dedup._ordered(np.concatenate(strings), starts, least, f"file://{tmp_path}/own").tolist() == expected
    assert not list(tmp_path.iterdir())


def brute_cut(rows):
    first, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] != i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cut(df):
    rows = suffix_dedup.remove_repeats(df).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in rows], key=repr)


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choices("abcdé \n", k=rng.choice((30, 55, 120, 400)))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcdef é\x00", k=rng.randrange(80))) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    rows += [(60, "ab" * 300), (61, "x" + "ab" * 300), (62, None), (63, "z" * 49), (64, "z" * 49)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == brute_cut(rows)


def test_repeats_that_end_or_begin_in_a_period(spark):
    """A shared passage beside a stretch of period up to 31, longer in one document than in the other."""
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choices("abcdefgh", k=n))
    rows = [(0, draw(40) + "Heading" + "-" * 25), (1, draw(40) + "Heading" + "-" * 20 + draw(5))]
    for period in [*range(1, 32)] * 8:
        passage, piece = draw(rng.randrange(15, 60)), draw(period)
        for _ in range(2):
            stretch = piece * 40
            cut_at = rng.randrange(20, 90)
            shared = passage + stretch[:cut_at] if period % 2 else stretch[-cut_at:] + passage
            rows.append((len(rows), draw(rng.randrange(30)) + shared + draw(rng.randrange(30))))
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == brute_cut(rows)


def test_repeats_of_all_bytes():
    """Strings that hold every byte value are ordered by half bytes."""
    rng = np.random.default_rng(0)
    strings = [rng.integers(0, 256, 60).astype(np.uint8) for _ in range(40)]
    strings[7][5:58] = strings[3][2:55]
    strings[7][:4] = strings[3][:4]
    starts = np.arange(41) * 60
    got = suffix_dedup._ordered(np.concatenate(strings), starts, np.arange(40), None).reshape(40, 11)
    expected = np.tile(np.arange(40)[:, None], 11)
    expected[7, 5:9] = 3
    assert (got == expected).all()


def test_repeats_odd(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if len(r.text or "") < 10_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(df) == brute_cut(rows)
    kept = suffix_dedup.remove_repeats(odd_documents, extra=("lang", "key", "score")).collect()
    assert len(kept) == odd_documents.count() and {r.n_removed for r in kept if r.doc_id == 4} == {0}
    assert suffix_dedup.remove_repeats(no_documents).isEmpty()


def brute_lm(rows, weights):
    words = {n: [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + [0] for n, (_, t) in enumerate(rows)}
    fold = {n: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for n, (i, _) in enumerate(rows)}
    c1, c2, c3, docs = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for n, t in words.items():
        if fold[n] != 1:
            docs += 1
            c1.update(t)
            s = [0, 0, *t]
            c2.update(zip(s[1:], s[2:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    total, distinct, out = sum(c1.values()), len(c1), []
    for n, t in words.items():
        base = [(c1[w] + 0.5) / (total + 0.5 * (distinct + 1)) for w in t]
        score, s = 0.0, [0, 0, *t]
        for k, b in enumerate(base):
            u, v, w = s[k : k + 3]
            cu, cv = (docs if k == 0 else c2[u, v]), (docs if k == 0 else c1[v])
            bucket = 65 + int(math.log2(cu)) if cu else 1 + int(math.log2(cv)) if cv else 0
            while bucket not in weights and bucket not in (0, 1, 65):
                bucket -= 1
            l3, l2, l1 = weights.get(bucket, (0, 0, 1))
            l3, l2 = l3 * (cu > 0), l2 * (cv > 0)
            p = l1 * b + (l2 * c2[v, w] / cv if cv else 0) + (l3 * c3[u, v, w] / cu if cu else 0)
            score += math.log10(p / (l1 + l2 + l3))
        out.append((rows[n][0], fold[n] == 1, len(t), sum(c1[w] > 0 for w in t), total, round(sum(map(math.log10, base)), 6), round(score, 6)))
    return sorted(out, key=repr)


def test_lm_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    phrases = ["The cat sat on", "a mat", "é", "on a cat", "u{}"]
    rows = [(i, " ".join(rng.choices(phrases, k=rng.randrange(20))).replace("{}", str(i))) if i % 7 else (i, "") for i in range(120)]
    rows += [(200, None), (201, ""), (None, "The cat"), (5, rows[5][1])]
    weights, learn = {}, lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells: weights.update(learn(cells)) or dict(weights))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got], key=repr) == brute_lm(rows, weights)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd(spark, odd_documents, no_documents):
    assert lm.score_documents(odd_documents).count() == odd_documents.count()
    assert lm.score_documents(no_documents).isEmpty()
    tests_only = odd_documents.filter("pmod(crc32(cast(doc_id as string)), 5) = 1")
    assert lm.score_documents(tests_only).count() == tests_only.count()


def test_weights_are_learned():
    cells = [(3, lm.NONE, 4 * lm.STEPS, 900), (3, lm.NONE, lm.NONE, 100)]
    l3, l2, l1 = lm.learn_weights(cells)[3]
    assert l2 > 0.8 and l3 < 0.01 and abs(l1 + l2 + l3 - 1) < 1e-9


def pictures(n=24):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(260))
        rows.append(media.read_pgm(media.render(f"<p>{words}</p>")))
    return rows


def test_copies(spark):
    base = pictures()
    rows = [(i, media.write_pgm(p)) for i, p in enumerate(base)]
    for k, p in enumerate(base[:12]):
        edited = p.astype(int).copy()
        match k % 4:
            case 0:
                edited = edited[7:, 9:]
            case 1:
                edited[10:18, 10:40] = 255
            case 2:
                edited = np.clip(edited * 0.9 + 12, 0, 255)
            case _:
                edited = np.rot90(edited)
        rows.append((100 + k, media.write_pgm(edited.astype(np.uint8))))
    rows += [(200, rows[3][1]), (300, None), (301, b""), (302, b"P5 not"), (303, media.write_pgm(np.full((40, 40), 255)))]
    got = {r.image_id: r.class_id for r in media.copy_classes(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()}
    assert sum(got[100 + k] == k for k in range(12)) >= 11 and got[200] == 3
    assert [got[i] for i in range(24)] == list(range(24)) and [got[i] for i in (300, 301, 302, 303)] == [300, 301, 302, 303]


def small_crops():
    """Crops of less than a quarter of the corners, of smaller and of larger id than the whole."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(6):
        words = " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(1500))
        whole = media.read_pgm(media.render(f"<p>{words}</p>"))
        pair = [whole[100:140], whole] if k % 2 else [whole, whole[100:140]]
        rows += [(10 * k + i, media.write_pgm(p)) for i, p in enumerate(pair)]
    return rows


def test_small_crops_in_both_orders(spark):
    rows = small_crops()
    sizes = [(len(c) - 8) // media.CORNER.itemsize for c in media.describe([image for _, image in rows])]
    assert all(4 * min(a, b) < max(a, b) for a, b in zip(sizes[::2], sizes[1::2], strict=True))
    got = {r.image_id: r.class_id for r in media.copy_classes(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def brute_links(rows):
    """All pairs of images, all pairs of their corners, one vote per corner and move."""
    found, files = set(), {i: x[8:] for (i, _), x in zip(rows, media.describe([image for _, image in rows]), strict=True) if x}
    held = {i: np.frombuffer(x, media.CORNER) for i, x in files.items()}
    width = media.BITS // 8
    for a, b in itertools.combinations(sorted(held), 2):
        x, y = held[b], held[a]
        if dict(rows)[a] == dict(rows)[b]:
            found.add((b, a))
            continue
        votes = collections.defaultdict(set)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            p, q = x["bits"][i], y["bits"][j]
            parts = [slice(width * t // media.TABLES, width * (t + 1) // media.TABLES) for t in range(media.TABLES)]
            if not any((p[s] == q[s]).all() for s in parts) or np.unpackbits(p ^ q).sum() > media.DIFFER:
                continue
            step, turn = int(x["level"][i]) - int(y["level"][j]), (int(x["turn"][i]) - int(y["turn"][j])) % media.TURNS
            c, s = math.cos(2 * math.pi * turn / media.TURNS) * 2.0**step, math.sin(2 * math.pi * turn / media.TURNS) * 2.0**step
            dx, dy = x["x"][i] - c * y["x"][j] + s * y["y"][j], x["y"][i] - s * y["x"][j] - c * y["y"][j]
            for ox, oy in itertools.product((0, 0.5), repeat=2):
                votes[step, turn, ox, oy, math.floor(dx / media.SHIFT + ox), math.floor(dy / media.SHIFT + oy)].add(i)
        if max(map(len, votes.values()), default=0) >= max(media.MATCHES, media.SHARE * min(len(x), len(y))):
            found.add((b, a))
    return found


def edited_pictures():
    rng, base = np.random.default_rng(3), pictures(6)
    rows = [(i, p) for i, p in enumerate(base)]
    for i, p in enumerate(base):
        rows += [(10 + i, p[: len(p) // 2]), (20 + i, np.clip(p + rng.normal(0, 6, p.shape), 0, 255)), (30 + i, np.rot90(p)), (40 + i, np.vstack([base[(i + 1) % 6][:16], p]))]
    return [(i, media.write_pgm(p.astype(np.uint8))) for i, p in rows] + [(50, media.write_pgm(base[2]))]


def test_links_against_all_pairs(spark):
    rows = edited_pictures()
    expected = brute_links(rows)
    assert len(expected) > 40
    out = media.copy_classes(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()
    both = collections.Counter(i for pair in expected for i in pair)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for b, a in expected:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.image_id: r.class_id for r in out} == root
    assert all(r.n_links == both[r.image_id] for r in out)


def test_an_image_of_smaller_id_with_the_same_patches_elsewhere(spark, monkeypatch):
    """Two copies are linked whatever else their groups hold."""
    rng = np.random.default_rng(1)
    corners = np.zeros(40, media.CORNER)
    corners["x"], corners["y"], corners["bits"] = rng.integers(0, 2000, 40), rng.integers(0, 2000, 40), rng.integers(0, 256, (40, 16))
    elsewhere = corners.copy()
    elsewhere["x"], elsewhere["y"] = rng.integers(0, 60000, 40), rng.integers(0, 60000, 40)
    rows = [(i, bytes([i] * 8) + c.tobytes()) for i, c in ((1, elsewhere), (2, corners), (3, corners))]
    got = {r.image_id: (r.class_id, r.n_links) for r in media._classes(spark.createDataFrame(rows, "doc_id long, text binary")).collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (2, 1)}


def described(n, k, rng):
    """Images whose corners are from a few, so that groups hold most images, some moved, some with corners side by side."""
    bits, rows = rng.integers(0, 256, (60, 16)), []
    for i in range(n):
        own = np.zeros(rng.integers(3, k), media.CORNER)
        own["bits"] = bits[(rng.zipf(1.3, len(own)) - 1) % 60]
        own["x"], own["y"], own["level"], own["turn"] = rng.integers(0, 60, len(own)), rng.integers(0, 40, len(own)), rng.integers(0, 2, len(own)), rng.integers(0, 2, len(own))
        if i % 4 and rows:
            other = np.frombuffer(rows[rng.integers(0, len(rows))][1], media.CORNER, offset=8)
            own = np.concatenate([own, other[: rng.integers(len(other) // 2, len(other) + 1)]])
            own["x"] += np.uint16(rng.integers(0, 9))
        rows.append((i, (i + 1).to_bytes(8, "little") + own.tobytes()))
    return rows


def all_links(rows):
    """Every pair of images by all their corners."""
    held = [(i, np.frombuffer(c, media.CORNER, offset=8)) for i, c in rows]
    pairs = [(x, y) for (_, y), (_, x) in itertools.combinations(held, 2)]
    names = [(j, i) for (i, _), (j, _) in itertools.combinations(held, 2)]
    return {n for n, good in zip(names, media.linked(pairs), strict=True) if good}


def test_no_link_is_lost_in_large_groups(spark, monkeypatch):
    """All linked pairs are found and counted, whatever the size of the groups and of what is looked at at once."""
    rows = described(120, 30, np.random.default_rng(6))
    expected = all_links(rows)
    assert 100 < len(expected) < 6000
    usual = np.zeros(1 << media.USUAL, np.int64)
    for looked, cells in ((media.LOOKED, media.CELLS), (50, 3)):
        monkeypatch.setattr(media, "LOOKED", looked)
        monkeypatch.setattr(media, "CELLS", cells)
        parts = [media.Part(np.array([i for i, _ in rows[k::2]]), [c for _, c in rows[k::2]], usual) for k in range(2)]
        found = [(max(r["a"], r["b"]), min(r["a"], r["b"])) for q in parts for o in parts for batch in media.part_links(q, o) for r in batch.to_pylist()]
        assert len(found) == len(set(found)) and set(found) == expected
    both = collections.Counter(i for pair in expected for i in pair)
    got = media._classes(spark.createDataFrame(rows, "doc_id long, text binary").repartition(3)).collect()
    assert {r.image_id: r.n_links for r in got} == {i: both[i] for i, _ in rows}


def test_parts_without_a_common_patch():
    """Parts that share no key have no links, and some of their images may share one corner with many."""
    rng, usual, parts = np.random.default_rng(5), np.zeros(1 << media.USUAL, np.int64), []
    for k in range(2):
        corners = np.zeros(20, media.CORNER)
        corners["bits"] = rng.integers(0, 256, (20, 16))
        parts.append(media.Part(np.array([2 * k, 2 * k + 1]), [bytes([k, i] * 4) + corners.tobytes() for i in range(2)], usual))
    found = [len(b) for q in parts for o in parts for b in media.part_links(q, o)]
    assert found == [1, 1]


def test_sampled_keys_are_counted_in_one_job(spark):
    """Not in one after the other for each block."""
    rows = described(60, 30, np.random.default_rng(7))
    held = blocks.write(spark.createDataFrame(rows, "doc_id long, text binary").repartition(12), "media-blocks")
    assert held.n > 8
    spark.sparkContext.setJobGroup("usual", "")
    try:
        usual = media._usual(held)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert usual.sum() == media.TABLES * sum((len(c) - 8) // media.CORNER.itemsize for _, c in rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("usual")) < held.n


def test_pictures_described_together_are_described_as_alone():
    """Pictures of one width are stacked, whatever their heights."""
    rng = np.random.default_rng(3)
    images = [media.write_pgm(rng.integers(0, 255, (h, w)).astype(np.uint8)) for h in (1, 2, 3, 15, 16, 17, 18, 30, 31, 33, 200, 201) for w in (80, 2, 80, 37)]
    together = media.describe([*images, None, b"P5"])
    assert together[:-2] == [media.describe([image])[0] for image in images] and together[-2:] == [None, None]
    assert sum(len(c) > 8 for c in together[:-2]) > 20


def test_links_of_many_copies(spark):
    """Copies of a file are counted, not paired; rows of one id are one image, with the links of all of them."""
    rng = np.random.default_rng(8)
    first = np.zeros(20, media.CORNER)
    first["x"], first["y"], first["bits"] = rng.integers(0, 2000, 20), rng.integers(0, 2000, 20), rng.integers(0, 256, (20, 16))
    second, few = first[:15].copy(), first[:2].copy()
    x, y, z = (bytes([k] * 8) + c.tobytes() for k, c in ((1, first), (2, second), (3, few)))
    rows = [(i, x) for i in range(30)] + [(i, y) for i in range(40, 45)] + [(50, z), (51, z), (52, z), (60, x), (60, z), (61, None)]
    got = {r.image_id: (r.class_id, r.n_links) for r in media._classes(spark.createDataFrame(rows, "doc_id long, text binary").repartition(4)).collect()}
    expected = {**{i: (0, 35) for i in [*range(30), *range(40, 45)]}, **{i: (0, 3) for i in (50, 51, 52)}, 60: (0, 38), 61: (61, 0)}
    assert got == expected


def test_copies_whose_corners_stand_in_full_groups(spark):
    """Two copies are linked though most of their corners are in groups that others fill, and few are their own."""
    rng = np.random.default_rng(2)
    common = np.zeros(40, media.CORNER)
    common["x"], common["y"], common["bits"] = rng.integers(0, 2000, 40), rng.integers(0, 2000, 40), rng.integers(0, 256, (40, 16))
    rows = []
    for i in range(20):
        other = common.copy()
        other["x"], other["y"] = rng.integers(0, 60000, 40), rng.integers(0, 60000, 40)
        rows.append((i, bytes([i] * 8) + other.tobytes()))
    own = common.copy()
    own["bits"][:4] = rng.integers(0, 256, (4, 16))
    rows += [(100, b"a" * 8 + own.tobytes()), (101, b"b" * 8 + own.tobytes())]
    got = {r.image_id: r.class_id for r in media._classes(spark.createDataFrame(rows, "doc_id long, text binary")).collect()}
    assert got == {**{i: i for i in range(20)}, 100: 100, 101: 100}


def test_media_odd(spark):
    """Null and repeated ids, a very large picture, columns of clashing names."""
    rng = np.random.default_rng(0)
    large = media.write_pgm(rng.integers(0, 255, (3000, 90)).astype(np.uint8))
    rows = [(None, large), (1, large), (1, large), (2, None), (2, b"P5 9 9 255 x"), (None, None), (3, b"")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "id long, image binary, text string, doc_id int, block long")
    got = sorted(repr((r.image_id, r.class_id, r.n_links)) for r in media.copy_classes(df, "id", "image").collect())
    assert got == sorted(map(repr, [(None, None, 1), (1, None, 1), (1, None, 1), (2, 2, 0), (2, 2, 0), (None, None, 1), (3, 3, 0)]))
    assert media.copy_classes(df.limit(0), "id", "image").isEmpty()


def test_links_count_for_both_images(spark):
    df = spark.createDataFrame([*small_crops(), (90, None)], "id long, image binary")
    got = {r.image_id: r.n_links for r in media.copy_classes(df, "id", "image").collect()}
    assert got == {**{10 * k + i: 1 for k in range(6) for i in range(2)}, 90: 0}


def test_pictures_of_pages(spark):
    df = spark.createDataFrame([(1, "<p>a</p><script>x</script>"), (2, None), (3, ""), (4, "<p>𝄞 é" + "b" * 200)], "page_id long, html string")
    drawn = {r.image_id: r.image for r in media.render_pages(df).collect()}
    assert media.read_pgm(drawn[1]).shape == (2, 80) and drawn[2] is None and drawn[3] is None
    assert media.read_pgm(drawn[4]).shape == (6, 80)
    assert media.copy_classes(media.render_pages(df.limit(0)), "image_id", "image").isEmpty()
