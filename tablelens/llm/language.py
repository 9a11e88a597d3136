"""Language identification of pages by Bayesian fusion of evidence.

A page's languages are weighed by four kinds of evidence: the likelihood of its
text (byte trigrams, counted per language over a labelled table), the language its
markup declares, the suffix of its address, and what the other pages of its host speak.
The latter three are learnt from the pages themselves by grouped aggregation of
the text's posteriors: how often pages of a language declare which language and
have which suffix, and host priors that are smoothed towards the domain's, which is
smoothed towards the corpus's.  A page's own share is taken out of every sum that is
used for it.  Sums are combined map-side, so a host with a third of all pages is one row per task.

Defined cases: null html and url count as empty; a page without text, declaration and host gets the corpus's prior;
null ids and repeated rows get a row each; of languages that are equally likely the first by code point is given; texts
are read whole, whatever their length; columns beyond the named ones are not read, so their names do not matter; labelled
rows without text or language teach nothing; without any labelled row every page's language and probability are null; an
empty table of pages gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of

#: Places that byte trigrams are hashed into, and languages of which a model holds all places (4 bytes each) and a task
#: all counts; of more languages only the counts that are there are held, and tasks write theirs out in between.
PLACES, MOST_LANGUAGES = 1 << 16, 256
#: Pages of evidence that a domain's and a host's prior weigh, and the added count of declarations and suffixes.
DOMAIN_WEIGHT, HOST_WEIGHT, ADDED = 5.0, 5.0, 0.5
#: Trigrams overlap, so each counts for a part of independent evidence.
TEXT_WEIGHT = 1 / 3
HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Hashed places of the byte trigrams of a lower-cased text, white space runs as one space."""
    symbols = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(symbols) < 3:
        return np.empty(0, np.uint32)
    codes = symbols[:-2] << np.uint32(16) | symbols[1:-1] << np.uint32(8) | symbols[2:]
    return codes * np.uint32(0x9E3779B1) >> np.uint32(16)


@dataclass
class TextModel:
    languages: list[str]
    log_share: np.ndarray  # languages x PLACES

    def log_likelihood(self, text: str) -> np.ndarray:
        return TEXT_WEIGHT * self.log_share[:, trigrams(text)].sum(axis=1, dtype=np.float64)


@dataclass
class SparseTextModel:
    """Of many languages: what a trigram that a language has adds to the share of one that it has not."""
    languages: list[str]
    unseen: np.ndarray    # log share of a trigram without a count, by language
    begin: np.ndarray     # where a place's counts begin
    language: np.ndarray
    gain: np.ndarray

    def log_likelihood(self, text: str) -> np.ndarray:
        place, times = np.unique(trigrams(text), return_counts=True)
        first, count = self.begin[place], np.diff(self.begin)[place]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
        gains = np.bincount(self.language[at], self.gain[at] * np.repeat(times, count), len(self.languages))
        return TEXT_WEIGHT * (times.sum() * self.unseen + gains)


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, own in sums.items():
        place = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), pa.array(place), pa.array(own[place])],
                                         names=["lang", "place", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in sums and len(sums) >= MOST_LANGUAGES:
                yield from _rows(sums)
                sums.clear()
            own = sums.setdefault(lang, np.zeros(PLACES, np.int64))
            own += np.bincount(trigrams(text.as_py()), minlength=PLACES)
    yield from _rows(sums)


def _packed(counts: pa.Table) -> pa.Table:
    """A language's counts (a group of at most ``PLACES`` rows) as one row of bytes: 8 for each trigram that it has."""
    place, n = counts["place"].to_numpy(), counts["n"].to_numpy()
    return pa.table({"lang": counts["lang"][:1], "total": [n.sum() + 0.5 * PLACES], "place": [place.astype("<u4").tobytes()],
                     "gain": [np.log((n + 0.5) / 0.5).astype("<f4").tobytes()]},
                    pa.schema([("lang", pa.string()), ("total", pa.float64()), ("place", pa.binary()), ("gain", pa.binary())]))


def learn_text(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel | SparseTextModel:
    """Trigram shares of each language, counted over all labelled documents.

    Counts are summed and packed on the executors; the driver reads a row of bytes a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    held = (counts.groupBy("lang").applyInArrow(_packed, "lang string, total double, place binary, gain binary")
            .orderBy("lang").collect())
    languages = [r["lang"] for r in held]
    unseen = np.log(0.5 / np.array([r["total"] for r in held], float))
    places, gains = ([np.frombuffer(r[c], kind) for r in held] for c, kind in (("place", "<u4"), ("gain", "<f4")))
    if len(languages) <= MOST_LANGUAGES:
        shares = np.repeat(unseen[:, None].astype(np.float32), PLACES, axis=1)
        for own, low, place, gain in zip(shares, unseen, places, gains):
            own[place] = low + gain
        return TextModel(languages, shares)
    at, number = np.concatenate(places), np.repeat(np.arange(len(languages), dtype=np.int32), [len(x) for x in places])
    order = np.argsort(at, kind="stable")
    return SparseTextModel(languages, unseen, np.searchsorted(at[order], np.arange(PLACES + 1)), number[order],
                           np.concatenate(gains)[order])


def visible(page: str) -> str:
    """The text of a page without markup."""
    return html.unescape(HIDDEN.sub(" ", page))


def address(url: str) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (its last label); empty without a host."""
    found = HOST.match(url)
    host = found[1].lower().rstrip(".") if found else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 and labels[-1].isalpha() else ""


def _softmax(logs: np.ndarray) -> np.ndarray:
    shares = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return shares / shares.sum(axis=-1, keepdims=True)


#: Numbers of one kind, about, that a batch of rows with a number for each of many languages holds.
BATCH_NUMBERS = 4_000_000
READ = "id {}, host string, domain string, suffix string, declared string, likely array<double>, share array<double>"


def _read(model, markup: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, doubles = model.value, pa.list_(pa.float64())
        step = max(BATCH_NUMBERS // len(own.languages), 1)
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            pages, origins = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            likely = [own.log_likelihood(visible(p) if markup else p) for p in pages]
            places = [address(u) if markup else (u, "", "") for u in origins]
            declared = [found[1].lower() if markup and (found := DECLARED.search(p)) else "" for p in pages]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in places], pa.string()) for i in range(3)), pa.array(declared, pa.string()),
                 pa.array(likely, doubles), pa.array([_softmax(x) for x in likely], doubles)],
                names=["id", "host", "domain", "suffix", "declared", "likely", "share"])
    return read


def _fuse(languages: list[str], corpus: np.ndarray, kinds: tuple[int, int]):
    """Posterior of each page; sums hold its own share too, which is taken out."""
    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, *columns = batch.columns
            if not batch.num_rows:
                continue
            likely, share, host, domain, suffix, declared = (
                np.asarray(c.flatten()).reshape(-1, len(languages)) for c in columns)
            rest = np.maximum(corpus - share, 0)
            prior = (rest + 1) / (rest + 1).sum(axis=1, keepdims=True)
            known = np.array(hosts.to_pylist(), object)[:, None] != ""
            for sums, weight in ((domain, DOMAIN_WEIGHT), (host, HOST_WEIGHT)):
                others = np.where(known, np.maximum(sums - share, 0), 0)
                prior = (others + weight * prior) / (others.sum(axis=1, keepdims=True) + weight)
            logs = likely + np.log(prior)
            for sums, n in ((suffix, kinds[0]), (declared, kinds[1])):
                logs += np.log((np.maximum(sums - share, 0) + ADDED) / (rest + ADDED * n))
            shares, text = _softmax(logs), share.argmax(axis=1)
            best = shares.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([languages[i] for i in best], pa.string()), pa.array(shares[np.arange(len(best)), best]),
                 pa.array([languages[i] for i in text], pa.string())], names=["id", "lang", "probability", "text_lang"])
    return fuse


def _sums(column: str, n: int) -> Column:
    """Sums of the ``n`` places of an array; many by one vector."""
    if n > MOST_LANGUAGES:
        return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


#: Bytes of the table of declared languages that a broadcast may have, and the parts that a join spreads a word over beyond.
DECLARED_BYTES, SALTS = 64 << 20, 64


def _with_declared(read: DataFrame, declared: DataFrame, size: int) -> DataFrame:
    """The sums of each page's declared language beside it; most pages may declare the same, or none."""
    if size <= DECLARED_BYTES:
        return read.join(F.broadcast(declared), "declared")
    salted = declared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (read.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
            .join(salted, ["declared", "salt"]).drop("salt"))


def identify(pages: DataFrame, model: TextModel | SparseTextModel, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html", markup: bool = True) -> DataFrame:
    """One row per page: id, lang, probability, text_lang (by the text alone).

    Without ``markup`` the texts are plain and ``url_col`` names their source,
    which has a prior as a host has."""
    spark, n = pages.sparkSession, len(model.languages)
    rows = pages.select(F.col(id_col).alias("id"), text_of(url_col).alias("url"), text_of(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    if not n:
        return rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"),
                                                                            ("text_lang", "string"))])
    read = materialise(rows.mapInArrow(_read(spark.sparkContext.broadcast(model), markup), READ.format(kind)), "read")

    def sums(rows: DataFrame, key: str, column: str, *more) -> DataFrame:
        return rows.groupBy(key, *more).agg(_sums(column, n).alias(f"of_{key}"))
    hosts = materialise(sums(read, "host", "share", "domain", "suffix"), "hosts")
    by_domain, by_suffix = sums(hosts, "domain", "of_host"), sums(hosts, "suffix", "of_host")
    declared = sums(read, "declared", "share")  # at most one row for each word of two or three letters
    hosts = hosts.join(by_domain, "domain").join(by_suffix, "suffix").select("host", "of_host", "of_domain", "of_suffix")
    shares = read.agg(_sums("share", n)).first()[0] or [0.0] * n
    totals = read.agg(F.count_distinct("suffix"), F.count_distinct("declared")).first()
    corpus = np.array([x or 0.0 for x in shares])
    joined = _with_declared(read.join(hosts, "host"), declared, 8 * n * totals[1])
    return joined.select("id", "host", "likely", "share", "of_host", "of_domain", "of_suffix", "of_declared").mapInArrow(
        _fuse(model.languages, corpus, (totals[0] + 1, totals[1] + 1)),
        f"id {kind}, lang string, probability double, text_lang string")
