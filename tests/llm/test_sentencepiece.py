import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from geodelta.llm.sentencepiece_codec import Codec, decode, encode, round_trip
from hypothesis import given, settings
from hypothesis import strategies as st

from .util import empty_docs, odd_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = Codec(PATH)


def listed(codec, texts):
    return [ids.tolist() for ids in codec.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abe tiono hr\n\t é😀ñ▁½12.,'\x00中", max_size=40), max_size=6))
def test_like_the_library(texts):
    got = listed(CODEC, texts)
    assert got == MODEL.encode(texts)
    assert [CODEC.decode(g) for g in got] == [MODEL.decode(g) for g in got]


def test_odd_texts(spark):
    docs = odd_docs(spark)
    out = {r["doc_id"]: r for r in round_trip(docs, PATH).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        ids = MODEL.encode(text)
        o = out[r["doc_id"]]
        assert (o["n_ids"], o["ids_crc32"], o["same"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert round_trip(empty_docs(spark), PATH).count() == 0


def test_table_starts_anew(monkeypatch):
    from geodelta.llm import sentencepiece_codec

    monkeypatch.setattr(sentencepiece_codec, "KNOWN", 3)
    codec = Codec(PATH)
    texts = ["one two three four", "five six", "one six seven"]
    for _ in range(2):
        for t in texts:
            assert listed(codec, [t]) == [MODEL.encode(t)]


def test_long_segments():
    rng = np.random.default_rng(3)
    letters = np.array(list("etaoinshrdlucé😀中"))
    texts = ["".join(rng.choice(letters, n)) for n in (63, 64, 65, 300, 5000)] + ["a" * 200, "word " + "x-" * 90 + " end", " " * 100]
    assert listed(CODEC, texts) == MODEL.encode(texts)


def test_segments_longer_than_a_part(monkeypatch):
    """Cut at gaps, or relaxed as a whole where there are none."""
    from geodelta.llm import sentencepiece_codec

    monkeypatch.setattr(sentencepiece_codec, "PART", 150)
    codec, rng = Codec(PATH), np.random.default_rng(5)
    for letters in ("a", "ab", "abcdefgh", "etaoinshr", "aé😀z", "=", "a▁"):
        texts = ["".join(rng.choice(list(letters), n)) + end for n in (149, 150, 151, 700) for end in ("", " x y", " " * 320)]
        assert listed(codec, texts) == MODEL.encode(texts)


def test_encode_and_decode(spark):
    docs = odd_docs(spark).withColumnRenamed("digest", "filled").withColumnRenamed("n", "ids")
    encoded = encode(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "filled", "ids"]
    for r in encoded.collect():
        assert r["ids"] == MODEL.encode(r["text"] or "")
    back = decode(encoded.withColumnRenamed("text", "was"), PATH)
    assert all(r["text"] == (r["was"] or "") for r in back.collect())
    assert encode(empty_docs(spark), PATH).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert decode(nulls, PATH).collect()[0]["text"] is None
