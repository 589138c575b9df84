"""Dropout is drawn for every occurrence of a word, by document and place."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from lectern.llm import queries, sentencepiece_codec  # noqa: E402
from tests.llm.data import awkward, wide  # noqa: E402
from tests.llm.test_text import MODEL, texts  # noqa: E402

WORD = " international"


def codings(own, documents, times):
    """The segmentations of a repeated word."""
    return {own._part_ids(WORD, int(k)) for d in range(documents) for k in sentencepiece_codec._part_keys(d, times)}


def test_a_repeated_word_varies_by_place_and_document():
    own = sentencepiece_codec.Codec(MODEL, 0.1, 0)
    alone = {own.encode(WORD[1:], d) for d in range(300)}
    assert len(alone) > 4
    text = (WORD * 300)[1:]
    halves = own.encode(text, 1), own.encode(text, 2)
    assert halves[0] != halves[1] and own.decode(halves[0]) == own.decode(halves[1]) == text
    plain = np.frombuffer(sentencepiece_codec.Codec(MODEL, 0.0, 0).encode(WORD[1:]), "<u4")
    count = 300 * len(plain)
    assert len(halves[0]) // 4 > count
    assert len(codings(own, 10, 30)) > 4


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("block", [50, 1 << 17])
def test_side_by_side_agendas_equal_the_plain_one(monkeypatch, dropout, block):
    """Every part of every text, long ones cut at spaces included, has the ids that the plain agenda gives it with the same draws."""
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", block)
    own = sentencepiece_codec.Codec(MODEL, dropout, 7)
    some = [*texts(), "▁ literal▁literal▁ ▁", "x" * 500, (WORD * 50)[1:], "日本語𝔘🤖" * 9, " " * 70, "a " * 200]
    for document, (text, got) in enumerate(zip(some, own.encode_all(some, list(range(len(some)))))):
        parts = own.cut.findall(" " + text) if text else []
        keys = sentencepiece_codec._part_keys(own.key(document), len(parts))
        assert got.tobytes() == b"".join(own._part_ids(p, int(k)) for p, k in zip(parts, keys))
        assert own.decode(got.tobytes()) == text
    assert own.encode_all([], []) == []


def test_share_of_skipped_candidates():
    own = sentencepiece_codec.Codec(MODEL, 0.1, 3)
    keys = sentencepiece_codec._part_keys(5, 20_000)
    assert 0.09 < np.mean([own._skipped(4711, 2, int(k)) for k in keys]) < 0.11


def test_the_query_returns_ids(spark, tmp_path):
    wide(spark, awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op1_sentencepiece_dropout(spark, str(tmp_path))
    assert all(len(r.ids) == r.n_tokens and r.lossless for r in out.collect())
