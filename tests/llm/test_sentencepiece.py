import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listingloom.llm import sentencepiece_bpe as s
from listingloom.llm.queries import piece_model

MODEL = piece_model()
VOCABULARY = s.Vocabulary(MODEL)


def library(text):
    return VOCABULARY.library.encode(text, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe TH\n\t▁é日🙂\x00.1aaab  thing"), max_size=80))
def test_any_text_is_encoded_as_by_the_library(text):
    chunks = VOCABULARY.chunks(text)
    together = VOCABULARY.encode_chunks(chunks)
    alone = [VOCABULARY.agenda(c) for c in chunks]
    ids = [i for c in together for i in c]
    assert together == alone and [*ids, VOCABULARY.end] == library(text)
    assert VOCABULARY.decode(ids) == VOCABULARY.library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=12))
def test_any_ids_are_decoded_as_by_the_library(ids):
    assert VOCABULARY.decode(ids) == VOCABULARY.library.decode(ids)


def test_long_chunks_have_their_own_agenda():
    text = "understanding" * 2000
    assert list(VOCABULARY.agenda(s.SPACE + text)) == library(text)[:-1]


def test_other_kinds_of_model_are_refused():
    model = s.model_pb2.ModelProto()
    model.ParseFromString(MODEL)
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        s.Vocabulary(model.SerializeToString())


def test_rows_and_digests(odd_docs, no_docs):
    rows = s.encoded(odd_docs.drop("a"), MODEL, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == library(r.text or "") and r.decoded == VOCABULARY.library.decode(r.ids)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in s.digests(odd_docs, MODEL, ["text"]).collect():
        ids = library(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(VOCABULARY.library.decode(ids))
    assert s.encoded(no_docs, MODEL, ["doc_id"]).count() == 0


def test_the_model_is_the_installed_one():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        assert file.read() == MODEL
