"""Coding, packing, language and toxicity."""

import random
import struct
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from lectern.llm import language_id, packing, queries, sentencepiece_codec, toxicity  # noqa: E402
from lectern.llm.common import Scratch, crc32, id_crc32  # noqa: E402
from tests.llm.data import awkward, wide, words  # noqa: E402

ODD = ["", " ", "   ", "It's  a\ttest x ", "\n\n a.́ , . \r\n\x85 x", "日本語 ４ 𝔘🤖", " x", "a.b, ..., don't'll", "İstanbul ΟΔΟΣ. ΣΑΣ, éte", "<|endoftext|> ½ Ⅷ"]
MODEL = queries.tokenizer_path(queries.PIECE_MODEL)
TOKENIZER = queries.tokenizer_path(queries.PACKING_TOKENIZER)


def texts():
    rng = random.Random(1)
    return ODD + [words(rng, 200, "abcdefghij.,!ÀéZ\n") for _ in range(20)]


def test_no_dropout_is_the_models_own_segmentation():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentencepiece_codec.Codec(MODEL, 0.0, 0)
    for text in texts():
        assert list(np.frombuffer(own.encode(text), "<u4")) == model.encode(text)


def test_both_agendas_agree():
    for dropout in (0.0, 0.3, 0.9):
        own = sentencepiece_codec.Codec(MODEL, dropout, 4)
        for text in texts():
            for part in own.cut.findall(" " + text):
                symbols = part.replace(" ", sentencepiece_codec.SPACE)
                assert own._listed(list(symbols), own.key(0)) == own._heaped(list(symbols), own.key(0))


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_dropout_is_lossless_and_varies(dropout):
    own = sentencepiece_codec.Codec(MODEL, dropout, 1)
    other = sentencepiece_codec.Codec(MODEL, dropout, 2)
    for text in [*texts(), "▁ literal ▁"]:
        assert own.decode(own.encode(text)) == text
    some = texts()[-1]
    assert (own.encode(some) != other.encode(some)) == (0 < dropout < 1)
    assert own.encode(some) == sentencepiece_codec.Codec(MODEL, dropout, 1).encode(some)


def test_encode_and_decode_rows(spark):
    rows = awkward()
    docs = wide(spark, rows)
    coded = sentencepiece_codec.encode(docs, MODEL, seed=3)
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in coded.collect())
    back = sentencepiece_codec.decode(coded, MODEL)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, _ in rows)
    assert sentencepiece_codec.encode(wide(spark, []), MODEL).count() == 0


def test_word_ids_are_the_tokenizers():
    own = packing.WordIds(TOKENIZER, most=50)
    for _ in range(2):
        made = own.encode([t.encode() for t in texts()])
        for text, ids in zip(texts(), made):
            assert list(np.frombuffer(ids, "<u4")) == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rows = awkward()
    out = packing.pack_documents(wide(spark, rows), TOKENIZER).collect()
    own = packing.WordIds(TOKENIZER)
    want = Counter()
    for i, t, _ in rows:
        ids = own.encode([(t or "").encode()])[0] + struct.pack("<I", 0)
        for n, at in enumerate(range(0, len(ids), 8192)):
            want[(i, n, at // 4, len(ids[at : at + 8192]) // 4, crc32(ids[at : at + 8192]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in out) // 2048) + 1
    assert packing.pack_documents(wide(spark, []), TOKENIZER).count() == 0


def test_packing_in_rounds(spark):
    """Many small tasks, so that underfull bins are merged over several rounds."""
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randint(1, 2048), 0) for i in range(3000)]
    items = spark.createDataFrame(rows, "id long, piece int, start long, length long, crc long")
    out = packing.pack(items, Scratch(spark, "test"), task_items=100).collect()
    assert sorted(r.id for r in out) == list(range(3000))
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert len(fill) <= 1.06 * (sum(fill.values()) / 2048)


def test_best_fit():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins == [[0, 2], [1, 3, 4]]


def language_rows():
    rng = random.Random(8)
    sets = {"en": ["the", "and", "with", "that", "ing"], "de": ["der", "und", "nicht", "ung", "sch"], "fr": ["les", "que", "dans", "eau", "oui"]}
    return [(i, " ".join(rng.choice(sets[g]) for _ in range(rng.randint(5, 60))), g) for i, g in enumerate(list(sets) * 60)]


def test_packing_beside_full_pieces(spark):
    """Underfull bins are joined over tasks although nearly all pieces are full."""
    rows = [(i, 0, 0, 2048 if i % 50 else 1024, 0) for i in range(2000)]
    items = spark.createDataFrame(rows, "id long, piece int, start long, length long, crc long")
    out = packing.pack(items, Scratch(spark, "test-pack"), task_items=50)
    assert out.select("sequence_id").distinct().count() == 1960 + 20


def test_languages(spark):
    rows = language_rows()
    docs = wide(spark, rows)
    train = docs.where(F.pmod(id_crc32(F.col("doc_id")), F.lit(4)) != 2)
    prototypes = language_id.fit(train)
    assert set(prototypes) == {"en", "de", "fr"}
    odd = [(500, None, "en"), (501, "", "en"), (502, "123 !!", "de"), (503, "漢字", None), (None, "the and with", None), (504, "the and " * 50_000, "en"), (504, "the", "en")]
    out = language_id.predict(wide(spark, rows + odd), prototypes).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    held = [r for r in rows if crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == g for i, _, g in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    kept = language_id.keep_known(wide(spark, rows + odd), prototypes)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in rows}
    assert not {500, 501, 502} & {r.doc_id for r in kept.collect()}


def test_texts_like_no_language_are_rejected(spark):
    rows = language_rows()
    prototypes = language_id.fit(wide(spark, rows))
    rng = random.Random(12)
    noise = [(600 + i, "".join(rng.choice(list("漢字仮名交文書体語彙韻律")) for _ in range(400)), None) for i in range(20)]
    own = [(700, "the and with that " * 30, None), (701, "漢字", None), (702, "漢字", "xx")]
    kept = {r.doc_id: r.lang for r in language_id.keep_known(wide(spark, rows + noise + own), prototypes).collect()}
    assert {i for i, _, _ in rows + own} <= set(kept) and len(set(kept) & {i for i, _, _ in noise}) <= 4
    assert kept[700] == "en" and kept[701] in prototypes and kept[702] == "xx"
    assert language_id.keep_known(wide(spark, rows), {}).count() == 0


def plainly(text, dim, vector):
    """The bundle of a text from its letters, gram by gram."""
    letters = [" ", *"".join(c if c.isalpha() else " " for c in text.lower()), " "]
    letters = [c for n, c in enumerate(letters) if not n or c != " " or letters[n - 1] != " "]
    counts = Counter(zip(letters, letters[1:], letters[2:])) if any(c != " " for c in letters) else {}
    out = np.zeros(dim)
    for gram, n in counts.items():
        bound = np.ones(dim)
        for place, letter in enumerate(gram):
            bound = bound * np.roll(vector(0 if letter == " " else ord(letter)), place)
        out += n**0.5 * bound
    return out


def test_languages_against_plain_bundles_and_cosines(spark):
    """Prototypes and predictions recomputed without the operator's tables; rows that repeat an id and rows without one are fitted too."""
    rows = [(i // 2 if i % 3 else None, t, g) for i, t, g in language_rows()]
    docs = wide(spark, [*rows, (9, "", "en"), (9, None, "de"), (None, "12 !", "en")])
    got = language_id.fit(docs)
    vector, dim = language_id.Encoder().letter, language_id.DIM
    sums = {}
    for _, text, lang in rows:
        own = plainly(text, dim, vector)
        sums[lang] = sums.get(lang, 0) + own / np.linalg.norm(own)
    want = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    shared = np.mean(list(want.values()), axis=0)
    asked = [(i, t, None) for i, (_, t, _) in enumerate(rows)] + [(900, "Été des à", None)]
    made = {r.doc_id: r for r in language_id.predict(wide(spark, asked), got).collect()}
    for i, text, _ in asked:
        own = plainly(text, dim, vector)
        own = own - shared * (own @ shared) / (shared @ shared)
        cos = {k: own @ (v - shared) / np.linalg.norm(own) / np.linalg.norm(v - shared) for k, v in want.items()}
        assert abs(made[i].cosine - max(cos.values())) < 1e-3 and cos[made[i].lang_pred] > max(cos.values()) - 1e-3


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 2)
    with pytest.raises(ValueError):
        language_id.fit(wide(spark, language_rows()))


def test_letters_of_all_planes():
    coder = language_id.Encoder()
    assert len(coder.grams("\U00031350 \U0010ffff")) == 1 and not len(coder.grams("\U0010ffff 12 \ud800"))


def test_languages_without_training(spark):
    assert language_id.fit(wide(spark, [])) == {}
    assert language_id.fit(wide(spark, [(1, "abc", None)])) == {}
    assert language_id.predict(wide(spark, [(1, "abc", "en")]), {}).first()["lang_pred"] == "und"


def test_languages_held_out(spark):
    out = queries.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.join(truth, "doc_id").where("lang_pred = lang").count()
    assert right >= 0.95 * out.count()


def toxic_rows(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = words(rng, 60).split()
        if toxic:
            text += rng.sample(["vilex", "nastyq", "grubz", "trollo"], 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame(labels + [(3, None), (None, 1), (6, 1), (6, 1), (9999, 1)], "doc_id long, toxic int")
    held = F.pmod(id_crc32(F.col("doc_id")), F.lit(5)) == 0
    index = toxicity.fit(wide(spark, rows), table.where(~held), Scratch(spark, "test"))
    odd = [(700, None, None), (701, "", "en"), (None, "vilex nastyq", "en"), (702, "clean words " * 20_000, "en"), (702, "x", "en")]
    out = toxicity.score(wide(spark, rows + odd), index).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r for r in out}
    tested = [(i, y) for i, y in labels if crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == bool(y) for i, y in tested)
    assert got[700].score < 0.5 and got[701].score < 0.5 and not got[700].evidence
    toxic = next(i for i, y in tested if y)
    assert dict(labels)[got[toxic].evidence[0]] == 1


def test_toxicity_without_labels(spark):
    index = toxicity.fit(wide(spark, []), spark.createDataFrame([], "doc_id long, toxic int"), Scratch(spark, "test"))
    assert toxicity.score(wide(spark, [(1, "a", "en")]), index).first()["score"] == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    terms = [(f"t{i}", 1 + i / 10) for i in range(30)] + [(toxicity.OTHER, 1.0)]
    examples = []
    for i in range(700):
        own = sorted(rng.choice(30, rng.integers(1, 8), replace=False).tolist())
        examples.append((i, int(rng.integers(0, 2)), own, rng.integers(1, 5, len(own)).astype(float).tolist()))
    index = toxicity.Index(terms, examples, k=10)
    dense = np.zeros((700, 31))
    for row, i in enumerate(index.ids):
        _, _, own, n = examples[i]
        dense[row, own] = index._unit(np.array(own), np.array(n))
    for _, _, own, n in examples[:60]:
        weights = index._unit(np.array(own), np.array(n))
        at, cos = index.neighbours(np.array(own), weights)
        every = dense[:, own] @ weights
        best = np.lexsort((np.arange(700), -np.round(every, 12)))[:10]
        best = best[every[best] > 0]
        assert at.tolist() == best.tolist() and np.allclose(cos, every[best])
