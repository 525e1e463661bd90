import math
import random
import shutil

import pytest

from sparkseek.operators import text as t
from sparkseek.plans import compile as c
from sparkseek.plans import query as q


@pytest.mark.parametrize("bad", ["ADJ(pear)", "ADJ(pear, fig, plum)", "NEAR(x, pear, fig)", "LAST(pear, fig)", "pear OR", "((pear)", "pear)", "   ", "7 AND 8", "pear fig AND plum", "pear & fig", "OR pear", "MSM(pear, 2)"])
def test_bad_queries(bad):
    with pytest.raises(q.QueryError):
        q.parse(bad)


def test_shapes():
    assert q.parse("груша OR NOT(слива AND вишня)") == q.Or(q.Term("груша"), q.Not(q.And((q.Term("слива"), q.Term("вишня")))))
    assert q.parse("fig AND plum OR pear") == q.Or(q.And((q.Term("fig"), q.Term("plum"))), q.Term("pear"))
    assert q.parse("Near(5, Fig, PLUM)") == q.Near(5, "fig", "plum")
    assert q.positive_words(q.parse("quince AND NOT (fig OR NOT plum) AND ADJ(pear, quince)")) == ["quince", "plum", "pear"]


def _docs(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")


def _stores(spark, texts):
    split = t.tokenized(_docs(spark, texts))
    return t.Scan(split), t.Index(split.drop("tokens"), t.postings(split, lengths=True))


CASES = [
    (["ripe figs and ripe plums", "plums before figs", "a basket of figs", ""], "NEAR(3, figs, plums) AND NOT LAST(figs)", {0}),
    (["green pear tree", "pear green tree", "green old pear"], "ADJ(green, pear)", {0}),
    (["one two three four", "one four"], "MSM(3, four, one)", {0, 1}),
    (["one two three four", "one four"], "MSM(2, four, one)", {1}),
    (["orchard gate", "the orchard"], "EDGE_START(orchard)", {0}),
    (["orchard gate", "gate post"], "LAST(gate)", {0}),
    (["plum", "pear"], "NEAR(1, plum, plum)", {0}),
    (["fig tree fig", "fig tree"], "MSM(9, fig, fig)", {0}),
    (["", None, "pear"], "NOT pear", {0, 1}),
    (["crab apple"], "crab_apple", set()),
]


@pytest.mark.parametrize("texts,query,expected", CASES)
def test_expected(spark, texts, query, expected):
    for store in _stores(spark, texts):
        assert {r.doc_id for r in t.search(store, query).collect()} == expected


def test_scan_and_index_agree_with_python(spark):
    rng = random.Random(5)
    words = ["fig", "plum", "pear", "near", "edge", "term"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))).replace("near", "nearly") for _ in range(40)]
    stores = _stores(spark, texts)

    def tree(depth):
        w = lambda: rng.choice(["fig", "plum", "pear", "edge", "term"])
        kind = rng.randint(0, 8 if depth else 4)
        match kind:
            case 0:
                return w()
            case 1:
                return f"NEAR({rng.randint(0, 3)}, {w()}, {w()})"
            case 2:
                return f"ADJ({w()}, {w()})"
            case 3:
                return f"MSM({rng.randint(0, 4)}, {w()}, {w()}, {w()})"
            case 4:
                return f"{rng.choice(['FIRST', 'LAST'])}({w()})"
            case 5 | 6:
                return f"({tree(depth - 1)} AND {tree(depth - 1)})"
            case 7:
                return f"({tree(depth - 1)} OR {tree(depth - 1)})"
            case _:
                return f"NOT ({tree(depth - 1)})"

    for _ in range(12):
        query = tree(3)
        node = q.parse(query)
        expected = {i for i, x in enumerate(texts) if c.evaluate(node, x.split())}
        for store in stores:
            assert {r.doc_id for r in t.search(store, query).collect()} == expected, query


def test_tokens(spark):
    row = t.tokenized(_docs(spark, ["Груша — дерево, СЛИВА тоже", "left_right R2"])).orderBy("doc_id").collect()
    assert row[0].tokens == ["груша", "дерево", "слива", "тоже"] and row[1].tokens == ["left", "right", "r2"]


FRUIT = ["fig plum fig", "plum plum fig pear", "pear quince", "quince", ""]


def _ranking(rows, words, k1=1.2, b=0.75):
    """BM25 by the formula, in plain Python."""
    split = [r.split() for r in rows]
    mean = sum(map(len, split)) / len(split)
    out = {}
    for i, own in enumerate(split):
        for w in words:
            tf, df = own.count(w), sum(w in x for x in split)
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / mean))
    return out


def test_ranking_and_index_files(spark, tmp_path):
    expected = _ranking(FRUIT, ["fig", "pear"])
    index, path = t.Index.build(_docs(spark, FRUIT)), str(tmp_path / "ix")
    t.save_index(index, path)
    again = t.open_index(spark, path)
    for store in (t.Scan(t.tokenized(_docs(spark, FRUIT))), index, again):
        ranked = {r.doc_id: r.score for r in t.bm25(store, "fig OR pear").collect()}
        assert ranked.keys() == expected.keys() and all(abs(ranked[i] - expected[i]) < 1e-9 for i in expected)
        assert {r.doc_id for r in t.bm25(store, "NOT plum").collect()} == {2, 3, 4}
    line = t.hit_lines(again, "fig OR pear").filter("doc_id = 1").first()
    assert (line.title, line.matched, line.total_tf) == ("(doc 1)", "fig×1, pear×1", 2)
    assert t.look_up(again.postings, "missing").isEmpty()
    assert {(r.term, r.df, r.tf) for r in again.terms.collect()} == {("fig", 2, 3), ("plum", 2, 3), ("pear", 2, 2), ("quince", 2, 2)}
    sizes = t.stored_sizes(spark, path).first()
    assert sizes.raw_bytes == 17 + 8 * 8 + 4 * 10 and sizes.stored_bytes > 0 and sizes.ratio > 0


def test_a_stored_index_is_pruned(spark, tmp_path):
    """A query that needs one of its words reads postings of its words and no documents."""
    path = str(tmp_path / "ix")
    t.save_index(t.Index.build(_docs(spark, FRUIT)), path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    positive, negative = (plan(t.search(t.open_index(spark, path), x)) for x in ("fig AND NOT plum", "NOT plum"))
    assert "PushedFilters: [In(term, [fig,plum])]" in positive
    assert positive.count("FileScan parquet") == 1 and negative.count("FileScan parquet") == 2
    ranked = plan(t.bm25(t.open_index(spark, path), "fig OR plum"))  # postings and term statistics
    assert ranked.count("FileScan parquet") == ranked.count("PushedFilters: [In(term, [fig,plum])]") == 2


def test_titles_are_cut_by_bytes(spark, tmp_path):
    titles = ["é" * 40_000, "a" + "é" * 40_000, "𝄞" * 20_000, "漢" * 30_000, "short"]
    docs = spark.createDataFrame([(i, x, "fig") for i, x in enumerate(titles)], "doc_id long, title string, text string")
    t.save_index(t.Index.build(docs), str(tmp_path / "ix"))
    got = {r.doc_id: r.title for r in t.open_index(spark, str(tmp_path / "ix")).docs.collect()}
    assert got == {i: x.encode()[:65_535].decode(errors="ignore") for i, x in enumerate(titles)}
    long = spark.createDataFrame([(0, "x" * 65_536)], "doc_id long, text string")
    with pytest.raises(Exception, match="65535"):
        t.save_index(t.Index.build(long), str(tmp_path / "long"))


def test_broken_indexes(spark, tmp_path):
    path = tmp_path / "ix"
    with pytest.raises(FileNotFoundError):
        t.open_index(spark, str(path))
    (path / "about").mkdir(parents=True)
    with pytest.raises(t.IndexError_, match="no index"):
        t.open_index(spark, str(path))
    t.save_index(t.Index.build(_docs(spark, FRUIT)), str(path))
    about = next((path / "about").glob("part*"))
    whole = about.read_text()
    for broken, why in (("not json", "no index"), (whole.replace('"version":2', '"version":1'), "version 1"), (whole.replace(t.FORMAT, "other"), "no index")):
        about.write_text(broken)
        (about.parent / f".{about.name}.crc").unlink(missing_ok=True)
        with pytest.raises(t.IndexError_, match=why):
            t.open_index(spark, str(path))
    about.write_text(whole)
    part = next(p for p in (path / "postings").glob("part*"))
    part.write_bytes(part.read_bytes()[:-20])
    with pytest.raises(t.IndexError_, match="cut or lost"):
        t.open_index(spark, str(path))
    shutil.rmtree(path / "terms")
    with pytest.raises(t.IndexError_, match="missing"):
        t.open_index(spark, str(path))
