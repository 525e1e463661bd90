"""Every stage of the pipeline on its own input, against plain Python."""

import collections
import hashlib

import corpus_pipeline as pipeline
from sparkseek.llm import common, toxicity
from tests.llm.test_corpus import brute_classes, brute_cut


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and len(after) >= 0.5 * len(before)
        match name:
            case "toxicity":
                model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
                bad = {i for i, s in zip(before, model.score([t or "" for t in before.values()]), strict=True) if s >= toxicity.THRESHOLD}
                assert set(before) - set(after) == bad and bad
            case "quality":
                assert all(before[i] == t for i, t in after.items())
                assert all(len((before[i] or "").split()) >= 50 for i in after)
            case "ngram_join":
                assert set(after) == {top for top, _ in brute_classes(before).values()}
            case "suffix_dedup":
                kept = {i: digest for i, _, _, _, digest in brute_cut(list(before.items()))}
                same = [hashlib.sha256(t.encode()).hexdigest() == kept[i] for i, t in after.items()]
                assert sum(same) / len(same) > 0.9  # others lost half a character at a cut
        docs, before = out, after
    pieces = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert set(total) == set(before) and all(total[r.doc_id] == r.doc_tokens for r in pieces)


def test_odd_tables(spark, odd_documents, no_documents, sf_dir):
    """What each stage keeps of nulls, empty and long texts, ties and repeated rows."""
    docs = odd_documents.select(*pipeline.COLUMNS)
    rows = docs.collect()
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    clean = [r.doc_id for r, s in zip(rows, model.score([r.text or "" for r in rows]), strict=True) if s < toxicity.THRESHOLD]
    kept = {
        "toxicity": clean,
        "quality": [4, 4],  # the others have fewer than 50 words
        "ngram_join": [None, 0, 1, 2, 3, 4, 6, 7, 7],  # one of two equal rows, and of 0 and 5
        "suffix_dedup": [None, 0, 1, 2, 3, 4, 4, 6, 7, 7],  # 5 repeats 0 and is left empty; rows of one id do not count
    }
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.select("doc_id").collect() if name in kept else out.filter("start = 0").select("doc_id").collect()
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, kept.get(name, [r.doc_id for r in rows]))), name
        assert stage(spark, no_documents.select(*pipeline.COLUMNS), sf_dir).isEmpty()
