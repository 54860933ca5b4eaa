import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from raremill.llm import token_files
from raremill.llm.bpe import Encoder, default_vocabulary

TEXTS = [
    "plain words here", "two  spaces", "line\nfeed", "line \n  feed\t\n x", " lead", "trail ", "",
    "\n\n", "it's don't 12 a1", "é ñ ß 中文 字", "<|endoftext|> in text", "\0 zero", "a\tb c",
    "word " * 30_000, "x\x85y z\u2003w",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_vocabulary())


def test_encoder_equals_the_library(plain):
    flat, counts = Encoder().encode(TEXTS)
    for text, ids in zip(TEXTS, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1 \n\t.'é\x85\u2003\x1c<|>sS"), max_size=30), max_size=5))
def test_any_text(texts):
    plain = Tokenizer.from_file(default_vocabulary()) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = plain
    flat, counts = Encoder().encode(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abéªЖ中1 \n.,$!*'"), max_size=30), max_size=5))
def test_words_with_marks(plain, texts):
    flat, counts = Encoder().encode(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


def test_words_are_encoded_without_the_pattern(plain):
    """Words, also after a line feed or before marks, go to the model in its own symbols."""
    own = Encoder()

    class Slow:
        def encode_batch(self, groups, **_):
            assert groups == [[""]]  # before the first word of a text
            return plain.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)

        def encode_batch_fast(self, texts, **_):
            return [plain.encode(t, add_special_tokens=False) for t in texts]

        def id_to_token(self, k):
            return plain.id_to_token(k)

    own._tokenizer = Slow()
    texts = [" Éa\nFor née", " one two three$$$ four\nfive"]
    flat, _ = own.encode(texts)
    assert flat.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


def test_files_read_back(spark, docs, plain, tmp_path):
    rows = [(9 - k, t) for k, t in enumerate(TEXTS)] + [(5, None), (5, "again"), (None, "no id")]
    path = str(tmp_path / "t")
    frame = docs(rows).withColumnRenamed("lang", "start").withColumnRenamed("source", "ids")
    token_files.write_tokens(frame.repartition(3), path)
    got = [tuple(r) for r in token_files.read_digests(spark, path).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_lookup_is_pushed_into_the_files(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(docs([(k, f"word {k}") for k in range(500)]), path)
    found = token_files.read_tokens(spark, path, where="doc_id = 321")
    assert [r.doc_id for r in found.collect()] == [321]
    assert "EqualTo(doc_id,321)" in found._jdf.queryExecution().toString()


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(docs([]), path)
    assert token_files.read_digests(spark, path).count() == 0


def test_remembering_is_bounded_and_harmless(plain, monkeypatch):
    from raremill.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    own = Encoder()
    for k in range(60):
        texts = [f"common words and number{j} new{k}x{j}, end." for j in range(5)]
        flat, counts = own.encode(texts)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
        assert len(own._kept["chunks"]) < 40 + 60
