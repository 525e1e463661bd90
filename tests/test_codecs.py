import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseek.functions import codecs
from sparkseek.operators import text as t

U32 = st.lists(st.integers(0, 2**32 - 1), max_size=400)


@settings(deadline=None, max_examples=40)
@given(U32)
def test_round_trips(values):
    v = np.array(values, dtype=np.uint64)
    for name, (encode, decode) in codecs.CODECS.items():
        assert decode(encode(v), len(v)).tolist() == values, name


def test_fixed_streams():
    v = [(i * i * 2654435761) % (1 << (4 + i % 29)) for i in range(333)] + [(1 << 32) - 1, 0]
    assert codecs.decode_pfordelta(codecs.encode_pfordelta(np.array(v))).tolist() == v
    assert len(codecs.encode_bitpack(np.array([0, 0]))) == 1
    with pytest.raises(ValueError):
        codecs.decode_optimal(b"\7", 0)


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_postings(version):
    docs, poss = [3, 4, 77, 70_000], [[2], [0, 1, 9, 400], [6, 8], [31, 33, 34]]
    assert codecs.decode_postings(codecs.encode_postings(docs, poss, version)) == (docs, poss)
    assert codecs.decode_postings(codecs.encode_postings([], [], version)) == ([], [])
    with pytest.raises(ValueError):
        codecs.decode_postings(codecs.encode_postings(docs, poss, version)[:9])


def test_sizes_and_seams(spark):
    docs = spark.createDataFrame([(i * 37, "a b" if i % 3 else "a c") for i in range(300)], "doc_id long, text string")
    index = t.postings(t.tokenized(docs))
    for chunk in (1 << 20, 500):  # lists cut by ranges of doc_id or not
        gaps = codecs.with_gaps(index, chunk)
        lists = {}
        for r in gaps.orderBy("term", "rank").collect():
            lists.setdefault(r.term, []).append(r.gap)
        for r in codecs.list_sizes(gaps).collect():
            v = np.array(lists[r.term])
            assert (r.varint, r.bitpack, r.pfordelta) == tuple(len(f(v)) for f in (codecs.encode_varint, codecs.encode_bitpack, codecs.encode_pfordelta))
    back = codecs.decode_index(codecs.encode_index(index, chunk=500))
    assert sorted(map(tuple, back.collect())) == sorted((r.term, r.doc_id, r.tf, r.poss) for r in index.collect())


def test_payload(spark):
    docs = spark.createDataFrame([(i, "a b a" if i % 3 else "a c") for i in range(300)], "doc_id long, text string")
    index = t.postings(t.tokenized(docs))
    lists = {}
    for r in index.orderBy("term", "doc_id").collect():
        own = lists.setdefault(r.term, ([], []))
        own[0].append(r.doc_id)
        own[1].append(r.poss)
    plain = sum(4 * (2 + len(p)) for _, poss in lists.values() for p in poss)
    for r in codecs.payload_bytes(index).collect():
        size = sum(len(codecs.encode_postings(*own, r.version)) for own in lists.values())
        assert (r.bytes, r.kb, r.ratio) == (size, size / 1024, size / plain)


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_many_lists_cost_no_more_calls(version, monkeypatch):
    rng = np.random.default_rng(version)
    sizes = rng.choice([1, 1, 1, 2, 127, 128, 129, 300], 500)
    docs = np.concatenate([np.sort(rng.choice(100_000, n, replace=False)) for n in sizes])
    counts = rng.choice([1, 2, 9], len(docs))
    flat = np.concatenate([np.sort(rng.choice(20_000, n, replace=False)) for n in counts])
    calls, own = [], codecs._bit_lengths
    monkeypatch.setattr(codecs, "_bit_lengths", lambda v: calls.append(1) or own(v))
    code, whole = codecs.encode_lists(docs, sizes, counts, flat, version)
    assert len(calls) <= 5  # not one for each list
    for found, expected in zip(codecs.decode_lists(code, whole), (docs, sizes, counts, flat), strict=True):
        assert found.tolist() == expected.tolist()
    poss, at = np.split(flat, np.cumsum(counts)[:-1]), np.cumsum(sizes) - sizes
    alone = [codecs.encode_postings(docs[a : a + n].tolist(), [p.tolist() for p in poss[a : a + n]], version) for a, n in zip(at, sizes, strict=True)]
    assert code.tobytes() == b"".join(alone)
    with pytest.raises(ValueError):
        codecs.decode_lists(code[:-1], np.append(whole[:-1], whole[-1] - 1))


def test_a_frequent_term_is_many_containers(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('a w', id) AS text")
    index = t.postings(t.tokenized(docs))
    coded = codecs.encode_index(index).cache()
    assert max(r.docs for r in coded.select("docs").collect()) <= 1 << 14
    assert coded.filter("term = 'a'").groupBy().sum("docs").first()[0] == 40_000
    assert codecs.decode_index(coded).exceptAll(index).count() == 0 == index.exceptAll(codecs.decode_index(coded)).count()
    coded.unpersist()


def test_payload_holds_no_list(spark):
    plan = codecs.payload_bytes(t.postings(t.tokenized(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_postings_are_made_of_few_tokens_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([[f"w{i % 900}" for i in range(2000)]] * 300)], ["doc_id", "tokens"])
    out = list(t.postings_of(batch))
    assert max(sum(b.column("tf").to_pylist()) for b in out) <= t.TOKENS_AT_ONCE < 600_000
    assert sum(sum(b.column("tf").to_pylist()) for b in out) == 600_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [i for i in range(300) for _ in range(900)]
