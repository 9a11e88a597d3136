"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart.

Ids are replaced by their rank of corpus frequency, so common ids fit one byte.
A block holds whole documents: four values share a control byte that says how
many bytes each takes (1 to 4), and the value bytes follow in a stream of their
own (the layout of Stream VByte, Lemire et al. 2018).  Decoding looks the
lengths up in a table of all 256 control bytes and gathers, all in numpy.

Blocks are rows of Parquet files in ascending id order, written by range
partition with Spark's commit protocol, so a lost executor repeats its tasks
and no more, on any file system that Spark writes to; ``ranks`` beside them is one row with
the id of every rank.  A block knows its shard and where in it it starts.

Texts are split at white space where the tokenizer drops it (others get whole texts),
and each task encodes a distinct chunk once while it remembers it; a Latin word
is encoded once for all its cases and the marks that follow it, since the tokenizer folds case
and starts a new pre-token at the marks.

Defined cases: null text counts as empty (its end id only); a null id comes after all others;
repeated rows are written one after the other; other columns are not read; an
empty table writes no blocks.
"""

from __future__ import annotations

import functools
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, text_of, write_folder

#: Ids after which a block is closed; documents stay whole.
BLOCK_IDS = 1 << 16
#: Distinct chunks that a task remembers, and the characters that it splits at a time.
HELD, AT_ONCE = 1 << 19, 1 << 21
#: Words that are encoded as one text.
TOGETHER = 256
#: Characters that Python takes for white space and the tokenizer doesn't.
ODD = "\x1c\x1d\x1e\x1f"
#: Fixed value: ASCII marks that start a pre-token after a word (no apostrophe, no < | > of special tokens).
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Bytes of each of the four values, for all control bytes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned 32-bit numbers."""
    values = values.astype("<u4")
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 8))  # bytes that any of them takes
    more = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    for i in range(1, wide):
        more[:len(values)] += values >= 1 << 8 * i
    control = more[::4] | more[1::4] << 2 | more[2::4] << 4 | more[3::4] << 6
    more = more[:len(values)]
    begin = np.cumsum(more, dtype=np.int64) - more + np.arange(len(values))
    data = np.empty(len(values) + int(more.sum(dtype=np.int64)), np.uint8)
    data[begin] = values  # the lowest byte
    for i in range(1, wide):
        at = np.flatnonzero(more >= i)
        data[begin[at] + i] = values[at] >> 8 * i
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that :func:`pack` wrote."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(length, dtype=np.int64) - length
    held = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = held.take(begin).astype(np.uint32)
    for i in range(1, int(length.max(initial=1))):
        values |= (held.take(begin + i) * (length > i)).astype(np.uint32) << np.uint32(8 * i)
    return values


class Encoder:
    """Ids of whole texts by the tokenizers library, a distinct chunk at a time."""

    def __init__(self, path: str, end_id: int, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width, self.known = width, {}
        self.end = np.array([end_id], width).tobytes()
        both, one, two = self.library([" a\n bC. ", "a", "bC."])
        self.drops_white = both == one + two  # else a chunk's ids depend on the white space around it
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def library(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, self.width).tobytes() for e in encode(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one pre-token each: encoded as texts of many words
        and parted after the tokens that end a word."""
        texts = [" ".join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for text, ids in zip(texts, self.library(texts)):
            ids = np.frombuffer(ids, self.width)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * ids.itemsize
            if len(ends) != text.count(" ") + 1:
                return self.library(words)
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of new chunks; a word is encoded once, whatever its case and the marks after it."""
        known, parted, new, words = self.known, [], set(), set()
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():  # the most, which need no look at their end
                word = chunk.lower()
                if word != chunk:
                    parted.append((chunk, word, ""))
                if word not in known:
                    words.add(word)
                continue
            word = chunk.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word)):
                marks, word = chunk[len(word):], word.lower()
                parted.append((chunk, word, marks))
                if word not in known:
                    words.add(word)
                if marks and marks not in known:
                    new.add(marks)
            else:
                new.add(chunk)
        new, words = list(new), list(words)
        known.update(zip(new, self.library(new)))
        known.update(zip(words, self.words(words)))
        for chunk, word, marks in parted:
            known[chunk] = known[word] + known[marks] if marks else known[word]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        if not self.drops_white:
            yield from (ids + self.end for ids in self.library(texts))
            return
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < AT_ONCE):
                size += len(texts[to])
                to += 1
            known = self.known
            if len(known) > HELD:
                known.clear()
            gc.disable()  # many lists and pairs, none of them in a cycle
            try:
                chunks = [[t] if any(c in t for c in ODD) else t.split() for t in texts[at:to]]
                self.learn(set().union(*chunks).difference(known))
            finally:
                gc.enable()
            for own in chunks:
                yield b"".join(map(known.__getitem__, own)) + self.end
            at = to


@functools.lru_cache(1)
def encoder(path: str, end_id: int, width: str) -> Encoder:
    """One encoder, with what it remembers, for all tasks of a worker process."""
    return Encoder(path, end_id, width)


def _encode(path: str, end_id: int, width: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path, end_id, width)
        for batch in batches:
            ids = pa.array(encode_all(batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])
    return encode


def _ids_of(column: pa.BinaryArray, width: str) -> np.ndarray:
    """The ids of all rows one after the other, as the column holds them."""
    if not len(column):
        return np.empty(0, width)
    place = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], place)[column.offset:column.offset + len(column) + 1]
    begin, end = int(ends[0]), int(ends[-1])
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[begin:end].view(width)


def _frequencies(width: str, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_ids_of(batch.column(0), width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])
    return count


BLOCK = ("shard int, block long, start long, n_ids long, doc_ids array<{id}>, counts array<long>, "
         "control binary, data binary")


def _blocks(width: str, rank_of, id_type: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs, held, size, ranks = [], [], 0, rank_of.value

        def closed() -> pa.RecordBatch:
            control, data = pack(ranks[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block]), pa.array([start]), pa.array([size]),
                 pa.array([docs], pa.list_(id_type)), pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                 pa.array([control]), pa.array([data])],
                names=["shard", "block", "start", "n_ids", "doc_ids", "counts", "control", "data"])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                held.append(np.frombuffer(ids.as_py(), width))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield closed()
                    block, start, docs, held, size = block + 1, start + size, [], [], 0
        if docs:
            yield closed()
    return write


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write blocks in ascending id order under ``path``."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    encoded = materialise(texts.mapInArrow(_encode(tokenizer_path, end_id, width), f"id {kind}, ids binary"), "ids")
    seen = (encoded.select("ids").mapInArrow(_frequencies(width, size), "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).toPandas())  # at most a row per token of the vocabulary
    counts = np.zeros(size, np.int64)
    counts[seen["token"].to_numpy()] = seen["n"].to_numpy()
    token_of = np.argsort(-counts, kind="stable")
    rank_of = np.empty(size, np.uint32)
    rank_of[token_of] = np.arange(size)
    spark.createDataFrame([(bytearray(token_of.astype("<u4").tobytes()),)], "tokens binary").write.parquet(f"{path}/ranks")
    order = F.col("id").asc_nulls_last()
    blocks = encoded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order)
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
    (blocks.sortWithinPartitions(order, "ids")
     .mapInArrow(_blocks(width, spark.sparkContext.broadcast(rank_of), id_type), BLOCK.format(id=kind))
     .write.parquet(f"{path}/blocks"))


def _decode(token_of):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.frombuffer(token_of.value, "<u4")
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, docs, counts, control, data = (batch.column(i)[row] for i in range(6))
                ids = tokens[unpack(control.as_py(), data.as_py(), n.as_py())]
                ends = np.cumsum(np.asarray(counts.values))
                begins = ends - np.asarray(counts.values)
                raw = [ids[b:e].tobytes() for b, e in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(begins + start.as_py()), pa.array(ends - begins), pa.array(raw, pa.binary())],
                    names=["id", "start", "n_tokens", "ids"])
    return read


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    token_of = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/ranks").first()[0]))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row per file
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    placed = blocks.join(F.broadcast(before), "shard").select(
        (F.col("before") + F.col("start")).alias("start"), "n_ids", "doc_ids", "counts", "control", "data")
    return placed.mapInArrow(_decode(token_of), f"id {kind}, start long, n_tokens long, ids binary")


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    path = write_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
