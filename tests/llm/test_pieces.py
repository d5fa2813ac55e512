"""Pieces equal the library's, and spans point at the original bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

from evenload.llm import pieces
from evenload.llm.registry import model_bytes

TEXTS = ["", " ", "  a  b ", "Hello wörld", "a\tb\r\nc\n", "▁x ▁▁", "日本語 𝔘 é é", "<s> </s> <unk> <0x41>", "x" * 3000 + " y" * 3000]


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(model_bytes())


@pytest.mark.parametrize("text", TEXTS)
def test_normaliser_and_spans(own, text):
    data = text.encode()
    normal, starts, stops = own.normalise(data)
    assert normal.decode() == own.processor.normalize(text) and len(starts) == len(stops) == len(normal)
    ids = np.array(own.processor.encode(text), np.int64)
    if not len(ids):
        return
    begins, ends = own.spans(text, ids)
    assert begins[0] == 0 and ends[-1] == len(data) and (begins[1:] == ends[:-1]).all()
    for i, a, b in zip(ids, begins, ends, strict=True):
        piece = own.processor.id_to_piece(int(i))
        if not own.processor.is_byte(int(i)):
            assert data[a:b].decode().replace(" ", "▁") in (piece, piece[1:] if a == 0 else piece)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [True, False])
def test_compiled_character_maps(rule, extra):
    library = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=extra)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    mine = pieces.Pieces.__new__(pieces.Pieces)
    mine.spec, mine.suffix, mine.own = proto.normalizer_spec, False, []
    mine.map = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for text in [*TEXTS, "  ﬁne ＡＢＣ ½ Ⅷ ", "㌔ｶﾞ ẞ Straße x​ y", "é́́"]:
        normal, starts, stops = mine.normalise(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(starts) == len(stops) == len(normal) and (np.diff(starts) >= 0).all() and (starts <= stops).all()


def test_documents(odd, own):
    model = model_bytes()
    out = pieces.encode_documents(odd, model, decoded=True)
    assert out.columns == [*[c for c in odd.columns if c != "ids"], "ids", "begins", "ends", "decoded"]
    for r in out.withColumn("again", pieces.decode(model, F.col("ids"))).collect():
        ids = own.processor.encode(r.text or "")
        assert r.ids == ids and r.decoded == r.again == own.processor.decode(ids)
        assert len(r.begins) == len(r.ends) == len(ids)
    assert pieces.encode_documents(odd.limit(0), model).count() == 0


def mapped_model(rule):
    """The model with the character map of another normaliser."""
    proto, other = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model_bytes())
    other.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    return proto.SerializeToString()


def test_documents_of_a_model_with_a_character_map(spark):
    model = mapped_model("nmt_nfkc_cf")
    own = pieces.Pieces(model)
    assert own.map.units
    texts = [*TEXTS, "  ﬁne ＡＢＣ ½ Ⅷ ", "㌔ｶﾞ ẞ Straße x​ y", "Ångström   ÅNGSTRÖM", None]
    rows = pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, decoded=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (r.text or "").encode()
        assert r.ids == own.processor.encode(r.text or "") and r.decoded == own.processor.decode(r.ids)
        assert r.begins == sorted(r.begins) and r.ends == sorted(r.ends) and all(a <= b <= len(data) for a, b in zip(r.begins, r.ends, strict=True))
        for i, a, b in zip(r.ids, r.begins, r.ends, strict=True):
            piece = own.processor.id_to_piece(i).replace("▁", " ").strip()
            if piece and not own.processor.is_byte(i) and not own.processor.is_unknown(i):
                assert piece in own.processor.normalize(data[a:b].decode(errors="ignore")).replace("▁", " ")
