"""Encoding and decoding against the library."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import op4_sentencepiece as op4

from .conftest import prose

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=op4.default_path())
ENCODER = op4.Encoder(op4.Vocabulary(op4.default_path()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  aeiouthnsrl=-_.0123456789\n\t▁日本のü"))), max_size=5))
def test_ids_and_texts_equal_the_library(texts):
    found = ENCODER.encode_all(texts)
    assert [x.tolist() for x in found] == [LIBRARY.encode(t) for t in texts]
    for x, t in zip(found, texts):
        assert ENCODER.decode(x) == LIBRARY.decode(x.tolist()) == t.replace(op4.SPACE, " ")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_any_ids_decode_without_failing(ids):
    assert isinstance(ENCODER.decode(np.array(ids, dtype=np.int64)), str)


def test_merging_alone_gives_the_same():
    for word in ["▁international", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁", "▁aaaaaaaaaaaa", "====----"]:
        assert ENCODER.v.ids(ENCODER.v.merge(word)[0]) == LIBRARY.encode(word.replace("▁", " ")[1:] if word[0] == "▁" else word)[0 if word[0] == "▁" else 1 :] or word[0] != "▁"


def test_documents(spark, documents, odd_rows):
    docs = documents(odd_rows)
    coded = op4.encode(docs, op4.default_path())
    want = sorted((str(i), LIBRARY.encode(t or "")) for i, t in odd_rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == want
    back = op4.decode(coded, op4.default_path()).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in odd_rows)
    assert all(r.round_trip for r in op4.digests(docs, op4.default_path()).collect())
    assert op4.encode(docs.limit(0), op4.default_path()).count() == 0
    assert op4.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), op4.default_path()).first().text is None


def test_seams_that_are_forgotten(monkeypatch):
    monkeypatch.setattr(op4, "REMEMBER", 3)
    own = op4.Encoder(ENCODER.v)
    for k in range(4):
        assert own.encode_all([prose(30, k)])[0].tolist() == LIBRARY.encode(prose(30, k))


def test_hashes_that_words_share(monkeypatch):
    monkeypatch.setattr(op4, "span_hashes", lambda code, start, end: (end - start).astype(np.uint64))
    texts = [prose(40, 3), "a bc de", "", "xy zw"]
    assert [x.tolist() for x in ENCODER.encode_all(texts)] == [LIBRARY.encode(t) for t in texts]


def test_ids_come_from_the_suffix_array(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op4.digests(docs, op4.default_path()).agg({"n_ids": "sum", "n_matched": "sum"}).first()
    assert rows["sum(n_matched)"] >= 0.99 * rows["sum(n_ids)"]


def test_other_models_are_refused(tmp_path):
    data = open(op4.default_path(), "rb").read()
    op4.refuse_others(op4.default_path())
    path = tmp_path / "other.model"
    for more, why in ((bytes([18, 2, 24, 1]), "no BPE"), (bytes([26, 2, 32, 1]), "removes spaces"), (bytes([26, 5, 18, 3, 1, 2, 3]), "normalises")):
        path.write_bytes(data + more)  # a later field of a message takes the place of the earlier one here
        with pytest.raises(ValueError, match=why):
            op4.Vocabulary(str(path))
