"""Token counts, token files and languages against the libraries and held-out rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablelens.llm import language, token_count, token_files
from tests.llm.common import ODD, prose, table

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
STRANGE = st.text(st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]),
                            st.sampled_from(list("'sdtmlver  \n\t.,!<|>\x1c\x1d́ 　日本Σςİ½²")), st.characters(exclude_categories=["Cs"])))


@pytest.fixture(scope="module")
def split():
    return token_count.PreTokens(BYTE)


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(WORD, 2, "<u4")


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


def test_token_counts(spark, byte_tokenizer):
    got = sorted((str(r.id), r.n_bytes, r.n_tokens) for r in token_count.count_tokens(table(spark, ODD), BYTE).collect())
    want = sorted((str(i), len((t or "").encode()), len(byte_tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert got == want
    assert token_count.count_tokens(table(spark, ODD).limit(0), BYTE).count() == 0


def test_rare_pretokens_are_joined(spark, byte_tokenizer, monkeypatch):
    monkeypatch.setattr(token_count, "HEAD", 3)
    docs = table(spark, [(i, prose(i % 5, 80), "a") for i in range(20)])
    got = {r.id: r.n_tokens for r in token_count.count_tokens(docs, BYTE).collect()}
    assert got == {i: len(byte_tokenizer.encode(prose(i % 5, 80)).ids) for i in range(20)}


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_pretokens_carry_the_whole_count(split, text):
    assert sum(split.pieces(split.of(text))) == len(split.tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(STRANGE, max_size=4))
def test_chunks_give_the_librarys_ids(encoder, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_tokenizers_that_keep_white_space_get_whole_texts():
    encoder = token_files.Encoder(BYTE, 2, "<u4")
    texts = [prose(4, 30), "a  b\n c", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == [encoder.tokenizer.encode(t).ids + [2] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_packed_values_come_back(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert token_files.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark):
    rows = [x for x in ODD if x[0] is not None]
    got = sorted(token_files.encoded_documents(table(spark, rows), WORD, 2).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(WORD)
    want = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t, _ in sorted(rows, key=lambda x: x[0])]
    starts = np.cumsum([0, *(len(x) for _, x in want)])
    assert [(r.id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got] == [
        (i, s, len(x), zlib.crc32(x.tobytes())) for (i, x), s in zip(want, starts.tolist())]


def test_token_files_order_null_ids_last_and_take_empty_tables(spark):
    got = sorted(token_files.encoded_documents(table(spark, ODD), WORD, 2).collect(), key=lambda r: r.start)
    assert [r.id for r in got[-2:]] == [None, None] and len(got) == len(ODD)
    assert token_files.encoded_documents(table(spark, ODD).limit(0), WORD, 2).count() == 0


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_languages_of_held_out_texts(spark, sf_small):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.learn_text(docs.where(~out))
    pages = docs.where(out).select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"),
                                   F.concat(F.lit("<p>"), "text").alias("html"), "lang")
    got = language.identify(pages, model).join(pages.select(F.col("page_id").alias("id"), F.col("lang").alias("truth")), "id")
    assert got.count() == pages.count() and got.where("lang = truth").count() >= 0.97 * got.count()


def test_evidence_decides_where_the_text_is_silent(spark, sf_small):
    model = language.learn_text(spark.read.parquet(f"{sf_small}/documents.parquet"))
    words = {"fr": "le chien est dans la maison avec une eaux", "de": "der hund ist in dem haus und nicht ver"}
    rows = [(i, f"https://{x}.example.{x}/p{i}", f'<html lang="{x}"><body>{words[x] * 5}</body></html>') for x in words for i in range(40)]
    rows += [(1000, "https://fr.example.fr/none", "<html></html>"), (1001, "https://other.example.de/", '<html lang="de">'),
             (1002, None, None), (None, "no address", "<script>der hund</script>"), (1003, "https://fr.example.fr/x", '<html lang=de><p>1')]
    pages = spark.createDataFrame(rows + rows[-2:], "page_id long, url string, html string")
    got = language.identify(pages, model).collect()
    by = {r.id: r.lang for r in got}
    assert len(got) == len(rows) + 2 and by[1000] == "fr" and by[1001] == "de"
    assert all(0 < r.probability <= 1 for r in got)
    assert language.identify(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_language_query_learns_from_all_labels(spark, tmp_path, labelled):
    from tablelens.llm.queries import QUERIES
    rare = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(rare, "kwyjibo zqorp vexu " * 30, "xx", "a")] + [(i, "the house and the dog " * 30, "en", "a") for i in range(200, 230)]
    docs = spark.createDataFrame([(i, t, x if labelled else None, s) for i, t, x, s in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, None, "<p>" + "zqorp vexu kwyjibo " * 30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op3_language"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    by = {(r.doc_id, r.page_id): r.text_lang for r in got}
    assert by[rare, None] == by[None, 1] == ("xx" if labelled else None) and by[200, None] == ("en" if labelled else None)


@pytest.mark.parametrize("most", [2, 256])
def test_many_languages(spark, monkeypatch, most):
    monkeypatch.setattr(language, "MOST_LANGUAGES", most)
    n = 40 if most < 40 else 300
    rows = [(i, prose(i % n, 12) + " ", f"l{i % n:03}") for i in range(2 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = language.learn_text(docs)
    assert len(model.languages) == n and isinstance(model, language.SparseTextModel)
    got = language.identify(docs.withColumn("source", F.lit("a")), model, "doc_id", "source", "text", markup=False).collect()
    assert len(got) == 2 * n and all(r.text_lang == f"l{r.id % n:03}" for r in got)
    monkeypatch.setattr(language, "MOST_LANGUAGES", n)
    whole = language.learn_text(docs)
    assert model.log_likelihood(prose(7, 30)) == pytest.approx(whole.log_likelihood(prose(7, 30)), rel=1e-4)


def test_markup_and_addresses():
    assert language.visible("<style>p{}</style><p>a&amp;b<!-- c --></p><script>d</script>").split() == ["a&b"]
    assert language.address("https://u@Blog.Example.FR:80/x") == ("blog.example.fr", "example.fr", "fr")
    assert language.address("") == ("", "", "") and language.address("http://10.0.0.1/")[2] == ""


def test_languages_against_the_fusion_formula(spark, monkeypatch):
    """Every page's posterior, by plain loops; with the declared languages broadcast and joined in parts."""
    said = {"en": "the cat sat on the mat and the dog", "fr": "le chat est sur la table et le chien", "de": "der hund und die katze sind hier"}
    docs = spark.createDataFrame([(t, k) for k, t in said.items() for _ in range(2)] + [("odd", None), (None, "de"), ("", "fr")], "text string, lang string")
    pages = [(1, "http://a.x.fr/1", "<html lang=\"fr\">le chien"), (2, "http://a.x.fr/2", "<html lang=\"fr\">the dog sat"), (3, "http://b.x.fr/", "la table"),
             (4, "http://q.de", "der hund"), (4, "http://q.de", "der hund"), (5, None, None), (None, "http://b.x.fr/", ""), (7, "", "<html lang=\"fr\">zz")]
    table = spark.createDataFrame([(i, u, h, "?", "?") for i, u, h in pages], "page_id long, url string, html string, host string, share string")
    model = language.learn_text(docs)
    assert model.languages == ["de", "en", "fr"]
    for i, k in enumerate(model.languages):
        counts = np.full(language.PLACES, 0.5)
        for t in docs.where(F.col("lang") == k).toPandas()["text"].fillna(""):
            counts += np.bincount(language.trigrams(t), minlength=language.PLACES)
        assert np.allclose(model.log_share[i], np.log(counts / counts.sum()), atol=1e-5)
    likely = [model.log_likelihood(language.visible(h or "")) for _, _, h in pages]
    share = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in likely]
    places = [language.address(u or "") for _, u, _ in pages]
    declared = [m[1].lower() if (m := language.DECLARED.search(h or "")) else "" for _, _, h in pages]

    def others(i, values):  # shares of the other pages that have the same value
        return sum((share[j] for j in range(len(pages)) if j != i and values[j] == values[i]), np.zeros(3))
    want = []
    for i, (page, _, _) in enumerate(pages):
        rest = others(i, [0] * len(pages))
        prior = (rest + 1) / (rest + 1).sum()
        for level, weight in ((1, language.DOMAIN_WEIGHT), (0, language.HOST_WEIGHT)):
            seen = others(i, [p[level] for p in places]) * (places[i][0] != "")
            prior = (seen + weight * prior) / (seen.sum() + weight)
        logs = likely[i] + np.log(prior)
        for values in ([p[2] for p in places], declared):
            logs = logs + np.log((others(i, values) + language.ADDED) / (rest + language.ADDED * (len(set(values)) + 1)))
        shares = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        want.append((str(page), model.languages[int(shares.argmax())], round(float(shares.max()), 5)))
    for most in (64 << 20, 0):
        monkeypatch.setattr(language, "DECLARED_BYTES", most)
        got = language.identify(table, model).collect()
        found = sorted((str(r.id), r.lang, round(r.probability, 5)) for r in got)
        assert [x[:2] for x in found] == [x[:2] for x in sorted(want)]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in sorted(want)], abs=1e-4)


@pytest.mark.parametrize("kind", ["binary", "large_binary"])
def test_ids_of_a_column_are_counted_together(kind):
    """The ids of all rows of a batch (also a part of one, and of no rows) without a count of the vocabulary a row."""
    import pyarrow as pa
    rows = [np.array(r, "<u2").tobytes() for r in ([1, 2], [], [2, 5, 2], [7])]
    column = pa.array(rows, getattr(pa, kind)())
    assert token_files._ids_of(column, "<u2").tolist() == [1, 2, 2, 5, 2, 7]
    assert token_files._ids_of(column.slice(1, 2), "<u2").tolist() == [2, 5, 2]
    assert token_files._ids_of(column.slice(4), "<u2").tolist() == []
    got = list(token_files._frequencies("<u2", 9)(iter([pa.RecordBatch.from_arrays([column], names=["ids"])])))[0]
    assert got.to_pydict() == {"token": [1, 2, 5, 7], "n": [1, 3, 1, 1]}
