import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from gaugewright.llm import pieces
from gaugewright.llm.common import tokenizer_file

from . import samples

with open(tokenizer_file("piece_bpe_32k.model"), "rb") as _f:
    MODEL = _f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
OWN = pieces.Pieces(MODEL)
SUM = pieces.Pieces(MODEL, kind=1)


def best_sum(p, text):
    """The largest sum over all segmentations, without an automaton."""
    best = [0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            score = p.score.get(text[start:end])
            if score is None and end - start == 1:
                score = p.lost
            if score is not None and best[start] is not None and (best[end] is None or best[start] + score > best[end]):
                best[end] = best[start] + score
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("the andr.,'  \n\t019=_#"), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=60))
def test_bpe_equals_the_library_and_round_trips(text):
    ids = OWN.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert OWN.decode(ids) == text.replace(pieces.SPACE, " ")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="thean drigé漢", max_size=40))
def test_unigram_path_has_the_largest_sum(text):
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
    path = SUM.segments(marked)
    assert "".join(marked[a:b] for a, b, _ in path) == marked
    assert sum(SUM.score[marked[a:b]] if i >= 0 else SUM.lost for a, b, i in path) == best_sum(SUM, marked)


def test_odd_rows(spark):
    got = {(r.doc_id, r.decoded_chars): r for r in pieces.encode(samples.odd(spark)).collect()}
    assert len(pieces.encode(samples.odd(spark)).collect()) == len(samples.ODD) and all(r.same_text for r in got.values())
    for doc, text in samples.ODD:
        assert got[doc, len(text or "")].ids == LIBRARY.encode(text or "")
    assert pieces.encode(samples.empty(spark)).count() == 0
    back = pieces.decode(spark.createDataFrame([(LIBRARY.encode("ab 漢 c"),), (None,)], "ids array<long>")).collect()
    assert [r.decoded for r in back] == ["ab 漢 c", ""]
    assert OWN.decode(np.zeros(0, "<u4")) == ""


@pytest.mark.parametrize("change", [{"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"escape_whitespaces": False}, {"precompiled_charsmap": b"x"}])
def test_models_that_normalise_are_refused(change):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    for name, value in change.items():
        setattr(proto.normalizer_spec, name, value)
    with pytest.raises(ValueError, match="normalises"):
        pieces.Pieces(proto.SerializeToString())


def test_models_with_other_pieces_are_refused():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    proto.pieces[1000].piece = f"a{pieces.SPACE}b"
    with pytest.raises(ValueError, match="mark"):
        pieces.Pieces(proto.SerializeToString())
    proto.ParseFromString(MODEL)
    proto.pieces[1000].type = proto.pieces[1000].USER_DEFINED
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Pieces(proto.SerializeToString())
