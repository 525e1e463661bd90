import collections
import math
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.llm import quality, sharding, toxicity


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark, odd_documents, no_documents):
    texts = ["a b c a b c a b c", "a a a a", "x\n\nx\n x\n", "#*$%&|<> 𝄞é", "a b\x0bc\x0cd　e", "one two"] + [r.text for r in odd_documents.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.describe(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.describe(no_documents).isEmpty()


def test_odd_tables(spark, odd_documents, no_documents, no_labels):
    judged = quality.judge(odd_documents, no_labels, extra=("text", "source", "score"))
    rows = judged.select("text", "source", "score", "n_words", "kept").collect()
    expected = sorted((repr(r.text), counts(r.text)[0]) for r in odd_documents.collect())
    assert sorted((repr(r.text), r.n_words) for r in rows) == expected
    assert all(r.kept == (r.n_words >= 50 and counts(r.text)[4] * 2 <= r.n_words) and (r.source, r.score) == ("src", 0.5) for r in rows)
    assert quality.judge(no_documents, no_labels).isEmpty()


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def words_of(seed, n=60, tail=""):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 50021}{tail}" for i in range(n))


def labelled(spark):
    """Good texts of "en" with few symbols, a tenth of them with some; junk with many; "xx" has too few labels."""
    rows, marks = [], []
    for i in range(900):
        junk = i % 4 == 0
        rows.append((i, words_of(i, tail="#" if junk else "") + (" # #" if i % 10 == 1 else ""), "en"))
        marks.append((i, int(not junk)))
    for i in range(900, 940):
        rows.append((i, words_of(i, tail="#" * (i % 2)), "xx"))
        marks.append((i, int(i % 2 == 0)))
    rows += [(1000 + i, rows[1][1], "en") for i in range(300)]  # one text: one piece of evidence
    marks += [(1000 + i, 1) for i in range(300)]
    marks += [(4, 1), (7, None), (None, 1)]  # both labels, and none
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_certified_levels(spark):
    docs, labels = labelled(spark)
    levels = quality.certified_levels(quality.describe(docs), labels).collect()
    holdout = lambda i: i % 1000003 * 7919 % 1009 % 2 == 1
    good = [i for i in range(900) if i % 4 and holdout(i)]
    for own in (sorted((r for r in levels if r.stratum == s), key=lambda r: r.level) for s in ("en", "xx")):
        worst = 0
        for r in own:
            assert abs(binomial_tail(r.k, r.n, quality.ALPHA) - r.p_value) < 1e-9 or (r.k > quality.ALPHA * r.n and r.p_value == 1)
            worst = max(worst, r.p_value)
            assert r.chain == worst and r.certified == (r.chain <= r.at)
    assert {r.n for r in levels if r.stratum == "en"} == {len(good)}
    assert {r.stratum for r in levels if r.certified} == {"en"}
    assert {r.at for r in levels} == {quality.DELTA / 2}


def test_holm_gives_on_what_a_whole_path_leaves(spark):
    """Two strata that pass to their ends leave all of DELTA to the third."""
    docs, labels = labelled(spark)
    plain = [(5000 + 1000 * s + i, words_of(9000 + 1000 * s + i), "abc"[s]) for s in range(3) for i in range(400)]
    docs, labels = docs.filter("lang = 'none'").union(spark.createDataFrame(plain, docs.schema)), spark.createDataFrame([(i, 1) for i, *_ in plain], labels.schema)
    levels = quality.certified_levels(quality.describe(docs), labels).collect()
    assert len({r.stratum for r in levels}) == 3 and all(r.certified for r in levels) and {r.at for r in levels} == {quality.DELTA}


def test_judge(spark):
    """The certified stratum loses its junk and no more than ALPHA of the good; the other keeps the base rule."""
    docs, labels = labelled(spark)
    judged = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert not any(judged[i] for i in range(0, 900, 4))
    assert sum(not judged[i] for i in range(900) if i % 4) <= quality.ALPHA * 675
    assert all(judged[i] for i in range(900, 940)) and len(judged) == docs.count()


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, n, load = (low + high) // 2, 1, 0
        for s in sizes:
            n, load = (n + 1, s) if load + s > c else (n, load + s)
        low, high = (low, c) if n <= shards else (c + 1, high)
    return low


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 8))
def test_capacity_against_brute_force(sizes, shards):
    ranges = [sharding.KeyRange(i, i, 1, s) for i, s in enumerate(sizes)]
    capacity, ends, unsure = sharding.smallest_capacity(ranges, shards)
    assert capacity == max(brute_capacity(sizes, shards), 1) and not unsure and len(ends) < shards


def test_sharding(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 4)  # forces ranges to be split
    rows = [(i, "t" * (i * i % 97) + str(i % 150)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.assign_shards(df, 8).collect()
    load, slots, place = collections.Counter(), collections.defaultdict(list), {}
    text = dict(rows)
    for r in out:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id].encode()))
        assert place.setdefault(text[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = spark.createDataFrame(rows, "doc_id long, text string").groupBy(F.xxhash64("text").alias("key")).agg(F.sum(F.length("text") + 1).alias("n")).orderBy("key")
    assert max(load.values()) == brute_capacity([r.n for r in groups.collect()], 8)
    assert sharding.assign_shards(odd_documents).count() == odd_documents.count()
    assert sharding.assign_shards(no_documents).isEmpty()


def test_a_group_above_the_fair_share(spark):
    rows = [(i, "copy") for i in range(300)] + [(300 + i, f"text {i:04d}") for i in range(200)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = sorted(r.n for r in out)
    assert len(sizes) == 8 and sizes[-1] == 1500 and sizes[-2] == 290


def test_toxicity(spark, sf_dir, odd_documents, no_documents, no_labels):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").filter(toxicity.common.fold("doc_id", 3) == 1).collect()
    hit = [r.score >= toxicity.THRESHOLD for r in scored if r.toxic]
    false = [r.score >= toxicity.THRESHOLD for r in scored if not r.toxic]
    assert sum(hit) / len(hit) > 0.7 and sum(false) / len(false) < 0.03
    odd = toxicity.score_documents(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.train(docs.limit(10), no_labels)
    assert {r.score for r in toxicity.score_documents(odd_documents, none).collect()} == {0.5}
    assert toxicity.score_documents(no_documents, model).isEmpty()


def plain_bins(text):
    """Bins of all distinct n-grams, one character at a time."""
    out, mask = set(), (1 << 64) - 1
    t = re.sub(r"\s+", " ", f" {text} ").lower()
    for n in toxicity.ORDERS:
        for i in range(len(t) - n + 1):
            h = ord(t[i])
            for c in t[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
            out.add(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> (64 - toxicity.BITS))
    return out


def plain_model(texts, toxic, share):
    """Log-count ratios and the regression by loops over sets."""
    held = [plain_bins(t) for t in texts]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    c1, c0 = (collections.Counter(b for h, y in zip(held, toxic, strict=True) if y == k for b in h) for k in (1, 0))
    r = {b: math.log((c1[b] + 1) / (n1 + 2)) - math.log((c0[b] + 1) / (n0 + 2)) for b in c1 | c0}
    r = {b: x for b, x in r.items() if abs(x) >= toxicity.MIN_RATIO and c1[b] + c0[b] >= toxicity.MIN_DOCS}
    w, b0, g, gb = dict.fromkeys(r, 0.0), 0.0, dict.fromkeys(r, 1e-8), 1e-8
    own = [[b for b in h if b in r] for h in held]
    for _ in range(toxicity.ROUNDS):
        error = [(1 / (1 + math.exp(-(b0 + sum(r[b] * w[b] for b in o)))) - y) / len(texts) for o, y in zip(own, toxic, strict=True)]
        slope = {b: toxicity.L2 * w[b] / len(r) for b in r}
        for o, e in zip(own, error, strict=True):
            for b in o:
                slope[b] += r[b] * e
        for b, x in slope.items():
            g[b] += x * x
            w[b] -= 0.05 * x / math.sqrt(g[b])
        x = sum(error)
        gb += x * x
        b0 -= 0.05 * x / math.sqrt(gb)
    b0 += math.log(share / (1 - share)) - math.log(n1 / n0)
    return lambda t: 1 / (1 + math.exp(-(b0 + sum(r[b] * w[b] for b in plain_bins(t) if b in r))))


def test_toxicity_against_plain_python():
    good = [f"a calm walk {x} by the river\n and  home" for x in "early late alone again slowly gladly often twice".split()]
    bad = [f"you {x} fool, shut up you fool {x}" for x in "utter rotten stupid lousy sorry total real damn".split()]
    texts, toxic = good + bad, [0] * len(good) + [1] * len(bad)
    model, plain = toxicity.fit(texts, toxicity.np.array(toxic), 0.2), plain_model(texts, toxic, 0.2)
    asked = [*texts, "", "ab", "the fool by the RIVER", "İ é 𝄞 you", "x" * 5000]
    assert all(abs(a - plain(t)) < 1e-9 for a, t in zip(model.score(asked).tolist(), asked, strict=True))
    assert all((s > 0.5) == bool(y) for s, y in zip(model.score(texts), toxic, strict=True))
