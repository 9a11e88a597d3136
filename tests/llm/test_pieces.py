"""SentencePiece encoding and decoding against the library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tablelens.llm import pieces
from tests.llm.common import ODD, prose, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
STRANGE = st.lists(st.one_of(
    st.sampled_from(list("aeinrst  \n\t.,▁\x00<s>日本́ﬁ½Åé①　­​\x7f한글ｶﾞ")), st.sampled_from(["the", "thean", "an an", "of"]),
    st.characters(exclude_categories=["Cs"])), max_size=60).map("".join)


def variant(tmp, name, rule="identity", **settings_):
    """The model with other settings of its normaliser (no training: same pieces, another character map)."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    if rule != "identity":
        held = sentencepiece_model_pb2.ModelProto()
        held.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = held.normalizer_spec.precompiled_charsmap
    own = settings_.pop("own", [])
    for i, p in enumerate(own):
        proto.pieces[31990 + i].piece, proto.pieces[31990 + i].type = p, 4
    for k, v in settings_.items():
        holder = proto.trainer_spec if k in ("treat_whitespace_as_suffix", "byte_fallback") else proto.normalizer_spec
        setattr(holder, k, v)
    path = tmp / f"{name}.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("models")
    paths = [MODEL, variant(tmp, "nfkc", "nmt_nfkc", remove_extra_whitespaces=True), variant(tmp, "folded", "nfkc_cf"),
             variant(tmp, "bare", add_dummy_prefix=False), variant(tmp, "squeezed", remove_extra_whitespaces=True),
             variant(tmp, "own", "nmt_nfkc", own=["thean", "日本", "an an"])]
    return [(pieces.Pieces(p), sentencepiece.SentencePieceProcessor(model_file=p)) for p in paths]


def same(model, library, text):
    ids, begins, ends = model.encode(text)
    want = library.encode(text, return_type="proto")
    assert ids.tolist() == [p.id for p in want.pieces], text
    data = text.encode()
    assert [(int(b), int(e)) for b, e in zip(begins, ends)] == [(p.begin, p.end) for p in want.pieces], text
    assert [data[b:e].decode() for b, e in zip(begins, ends)] == [p.surface for p in want.pieces]
    assert model.decode(ids.tolist()) == library.decode(ids.tolist()), text


@settings(max_examples=1500, deadline=None)
@given(STRANGE)
def test_ids_spans_and_texts_are_the_librarys(models, text):
    for model, library in models:
        same(model, library, text)


def test_long_words_and_prose(models):
    for model, library in models:
        for text in (prose(3, 3000), "ab" * 20000, "日本語" * 3000, " " * 5000, "\n" * 100, prose(4, 50).replace(" ", "\n  "), ""):
            same(model, library, text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=30))
def test_any_ids_decode_as_in_the_library(models, ids):
    for model, library in models:
        assert model.decode(ids) == library.decode(ids)


def test_character_map_takes_the_longest_rule(models):
    rules = models[1][0].normalise.rules
    assert rules.longest("ﬁx".encode(), 0) == (3, b"fi")
    assert rules.longest(b"plain", 0) is None


def test_encode_and_decode_tables(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode_pieces(table(spark, ODD), MODEL, decoded=True)
    rows = got.collect()
    want = sorted((str(i), library.encode(t or "")) for i, t, _ in ODD)
    assert sorted((str(r.id), r.ids) for r in rows) == want
    assert all(r.decoded == library.decode(r.ids) and len(r.begins) == len(r.ends) == len(r.ids) for r in rows)
    back = pieces.decode_pieces(got.select("id", "ids", "decoded"), MODEL).collect()
    assert sorted((str(r.id), r.text) for r in back) == sorted((str(r.id), r.decoded) for r in rows)
    assert pieces.encode_pieces(table(spark, ODD).limit(0), MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [5, None, 6])], "id long, ids array<int>")
    assert {r.id: r.text for r in pieces.decode_pieces(nulls, MODEL).collect()} == {1: "", None: library.decode([5, 6])}


def test_query_digests(spark, sf_small):
    from tablelens.llm.queries import QUERIES
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = QUERIES["op12_piece_codec"](spark, sf_small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *sha)


def test_marks_after_a_word_are_units_of_their_own():
    """A word is merged once, whatever marks follow it, as no piece holds a letter beside a mark."""
    model = pieces.Pieces(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "wonder, wonder! wonder... (wonder) wonder"
    assert model.encode(text)[0].tolist() == library.encode(text)
    assert [u for u in model.known if "wonder" in u] == ["▁wonder", "wonder"]


def test_groups_of_characters():
    """Characters that a piece holds side by side are one group, also by way of others; the smallest groups are joined."""
    assert pieces._groups(["ab", "bc", "▁d", "d▁e", "x", ".,", "▁▁"])[0] == {"a", "b", "c"}
    assert sorted(map(sorted, pieces._groups(["ab", "▁d", ".,"]))) == [[",", "."], ["a", "b"], ["d"]]
    many = [chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i in range(50)]
    assert sorted(map(len, pieces._groups(many))) == [2] * (pieces.GROUPS - 1) + [100 - 2 * (pieces.GROUPS - 1)]
