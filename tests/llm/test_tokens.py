import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkseek.llm import bpe, encoding, packing, token_files

WORDS = public.path("word_bpe_49k.json")
RANKS = public.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "á ́b  c d e 'S it's\x0b\x1c\x1dΣΑΣ İI ﬁ 12 3½ 　漢字 <|endoftext|>", "\x85a\x1fb... ,.x., y.,", None, "don't.", "İx. Ünd,", "a" * 3000, "é" * 500]
TEXT = st.text(st.sampled_from("ab.,' \ńİéΣ漢1½　<|>Z"), max_size=30)


def tokenizer():
    return Tokenizer.from_file(WORDS)


def ids_of(texts):
    ids, starts = encoding.chunk_encoder(WORDS).encode(pa.array(texts, pa.string()), 1)
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_chunks_equal_whole_texts():
    t = tokenizer()
    assert ids_of(ODD) == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in ODD]
    assert ids_of([]) == []


@settings(deadline=None, max_examples=60)
@given(st.lists(TEXT, max_size=6))
def test_chunks_equal_whole_texts_at_random(texts):
    t = tokenizer()
    assert ids_of(texts) == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public.path("byte_bpe_50k.json")
    own, t = encoding.ChunkEncoder(path), Tokenizer.from_file(path)
    assert not own.in_chunks and encoding.chunk_encoder(WORDS).in_chunks
    ids, starts = own.encode(pa.array(ODD, pa.string()), 7)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [t.encode(x or "", add_special_tokens=False).ids + [7] for x in ODD]


@pytest.fixture(scope="module")
def coder():
    return bpe.coder_for(RANKS, public.PATTERN)


@settings(deadline=None, max_examples=80)
@given(TEXT | st.text(max_size=40))
def test_bpe_as_tiktoken(text):
    coder = bpe.coder_for(RANKS, public.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_perfect_hash(coder):
    assert sorted(coder.hash.index(k) for k in coder.ranks) == list(range(len(coder.ranks)))
    assert coder.hash.index(b"no such token at all") == -1 and bpe.PerfectHash([]).index(b"x") == -1


def test_bpe_documents(spark, odd_documents, no_documents):
    out = bpe.decode_documents(bpe.encode_documents(odd_documents, RANKS, public.PATTERN), RANKS, public.PATTERN).collect()
    texts = sorted((r.text or "").encode() for r in odd_documents.collect())
    assert sorted(bytes(r.decoded) for r in out) == texts
    assert bpe.encode_documents(no_documents, RANKS, public.PATTERN).isEmpty()


def _expected(docs):
    t = tokenizer()
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]


def test_files(spark, odd_documents, no_documents, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    parts = token_files.write_tokens(odd_documents, folder, WORDS, length=64)
    rows = sorted(token_files.read_tokens(spark, folder, parts).collect(), key=lambda r: r.start)
    expected = sorted(_expected(odd_documents), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [e[0] for e in expected]
    assert sorted(bytes(r.ids) for r in rows) == sorted(np.array(e[1], "<u4").tobytes() for e in expected)
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    part = token_files.Part(folder, parts[0][0])
    ids, mask = part.sequence(0)
    assert len(ids) == 64 and len(mask) == 64 and not ids.flags.owndata  # a view of the mapped file
    assert token_files.write_tokens(no_documents, folder + "2", WORDS) == []
    assert token_files.read_tokens(spark, folder + "2", []).isEmpty()


def test_packing(spark, odd_documents, no_documents):
    more = [(20, "İ. and <|endoftext|> İstanbulİ, " * 40), (21, "word, " * 5000)]
    docs = odd_documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = packing.pack_documents(docs, WORDS).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert len(r.ids) == 4 * r.length
    padded = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        total = sum(r.length for r in own)
        assert total <= 2048
        padded += bool(total & (total - 1))
    assert padded <= docs.rdd.getNumPartitions()  # one for each partition at most
    expected = sorted((repr(i), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in _expected(docs))
    whole = []
    for (doc_id, _), own in by_doc.items():
        left = sorted(own, key=lambda r: (r.start, r.sequence_id, r.offset))
        while left:
            pieces = _next_whole(left)
            whole.append((repr(doc_id), zlib.crc32(b"".join(bytes(r.ids) for r in pieces))))
    assert sorted(whole) == expected
    assert packing.pack_documents(no_documents, WORDS).isEmpty()


def _next_whole(left):
    """Takes the pieces of one row, end to end, from those of all rows of its id and size."""
    out, at = [], 0
    while not out or at < out[0].doc_tokens:
        r = next(r for r in left if r.start == at)
        left.remove(r)
        out.append(r)
        at += r.length
    return out


def test_the_library_is_given_little_at_once():
    """What the library returns takes many times the size of its input, so a slice of text goes to it in runs."""
    encoder, seen = encoding.ChunkEncoder(WORDS), []
    library = encoder.tokenizer

    class Watched:
        def encode_batch_fast(self, chunks, **options):
            seen.append(sum(map(len, chunks)))
            return library.encode_batch_fast(chunks, **options)

    encoder.tokenizer = Watched()
    text = " ".join(f"{k:x}{'-' * (k % 7)} w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}xyz" for k in range(40000))
    ids, starts = encoder.encode(pa.array([text, None, "a b."]), 1)
    expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in (text, "", "a b.")]
    assert ids.tolist() == sum(expected, []) and starts.tolist() == [0, *np.cumsum([len(x) for x in expected]).tolist()]
    assert len(seen) > 4 and max(seen) < 2 * encoding.AT_ONCE
