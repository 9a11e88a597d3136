"""SentencePiece BPE encoding that keeps its place in the text, and decoding.

1. *Normalisation.*  The model's compiled character map (a double-array trie beside
   its replacement strings) is walked for the longest rule at each place; every character of the result
   remembers the byte of the source that its rule began at.  Stretches of characters with which
   no rule begins are copied whole.  White space, the dummy prefix and symbols the
   user defined follow the model's settings.
2. *Pieces.*  The best-scored neighbours merge first, the leftmost of equals.  Pieces hold a word mark only in
   front, and characters that stand side by side in no piece never merge, so a text parts into units that merge on
   their own (a word, and the marks after it); a worker merges a distinct unit once while it remembers it.  What the vocabulary lacks falls back to its bytes.
3. *Projection.*  The characters of each piece give its begin and end in the bytes of the source (a character in
   byte pieces belongs to the last of them, as in the library's own offsets).

Decoding joins the surfaces of the pieces: byte pieces are bytes again (U+FFFD for
each that is no UTF-8), marks are spaces, and the mark that the dummy prefix put in front goes.

Defined cases: null text counts as empty (no pieces, empty decoded text); texts of any length are read whole; repeated
rows and null ids are rows like others; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import array
import codecs
import functools
import heapq
import itertools
import operator
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import text_of

#: The word mark, and the kinds of pieces in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct units that a worker remembers, and pieces handed on at a time.
HELD, AT_ONCE = 1 << 19, 1 << 20
#: Groups of characters that units are parted by; the smaller ones count as one.
GROUPS = 8
#: Characters of a unit whose pairs are looked through at each merge; longer ones keep them in a heap.
SHORT = 64


def _one_by_one(error: UnicodeError):
    return ("�", error.start + 1) if isinstance(error, UnicodeDecodeError) else ("", error.end)


codecs.register_error("tablelens_bytes", _one_by_one)


class CharacterMap:
    """Longest-prefix rules of a compiled character map: UTF-8 bytes to their replacement."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4:4 + size], "<u4").tolist()
        self.strings = compiled[4 + size:]

    @staticmethod
    def _below(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 512 else 0)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest rule that the data has at a place."""
        units, node, found = self.units, self._below(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 1 << 31
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._below(unit)
            if unit & 256:  # a rule ends here
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.strings[found[1]:self.strings.index(b"\0", found[1])]

    def first_characters(self) -> set[str]:
        """The characters that rules begin with."""
        out, open_ = set(), [(b"", self._below(self.units[0]))]
        while open_:
            key, node = open_.pop()
            for byte in range(256):
                at = node ^ byte
                unit = self.units[at] if at < len(self.units) else 1 << 31
                if byte and unit & 0x800000FF == byte:
                    longer = key + bytes([byte])
                    lead = longer[0]
                    if len(longer) == 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0):
                        out.add(longer.decode("utf-8", "ignore"))
                    else:
                        open_.append((longer, at ^ self._below(unit)))
        return out - {""}


def _class(characters: set[str]) -> str:
    return "".join(map(re.escape, sorted(characters)))


def _groups(pieces: Iterable[str]) -> list[set[str]]:
    """Characters of longer pieces in groups, the largest first: those of two groups stand side by side in no piece."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        above.setdefault(c, c)
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c
    for piece in pieces:
        if len(piece) > 1:
            bare = piece.replace(MARK, "")
            for a, b in zip(bare[:1] + bare, bare):
                above[top(a)] = top(b)
    found: dict[str, set[str]] = {}
    for c in above:
        found.setdefault(top(c), set()).add(c)
    groups = sorted(found.values(), key=lambda g: (-len(g), min(g)))
    return groups[:GROUPS - 1] + ([set().union(*groups[GROUPS - 1:])] if len(groups) >= GROUPS else [])


class _Known(dict):
    """What ``make`` gives for each key, remembered."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Normaliser:
    """Normalised text with the source byte of each of its characters."""

    def __init__(self, spec, user_defined: list[str], suffix: bool):
        self.rules = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self.mark = MARK if spec.escape_whitespaces else " "
        begins = (self.rules.first_characters() if self.rules else set()) | {u[0] for u in user_defined}
        self.begin = re.compile(f"[{_class(begins)}]") if begins else None
        self.own = re.compile("|".join(map(re.escape, sorted(user_defined, key=len, reverse=True)))) if user_defined else None

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised, source): ``source[i]`` is the byte where the rule of character i began, and one more for the end."""
        if not text:
            return "", np.zeros(1, np.int32)
        out, source, lead = self._mapped(text)
        if self.squeeze:  # spaces in front and after a space go
            space = np.frombuffer(out.encode("utf-32-le", "surrogatepass"), "<u4") == 32
            keep = ~(space & np.r_[True, space[:-1]][:len(space)])
            out, source = "".join(itertools.compress(out, keep.tolist())), np.r_[source[:-1][keep], source[-1:]]
        out = out.replace(" ", self.mark)
        if self.prefix and not self.suffix:
            out, source = self.mark + out, np.r_[np.int32(lead if self.squeeze else 0), source]
        if self.squeeze:  # so do those at the end, which is then where the first of them began
            out = out.rstrip(self.mark)
            source = source[:len(out) + 1]
        return (out + self.mark, np.r_[source, source[-1:]]) if self.prefix and self.suffix and out else (out, source)

    def _mapped(self, text: str) -> tuple[str, np.ndarray, int]:
        """The text by the rules, its source, and the byte where the first rule begins that gives no single space."""
        places = _byte_places(text)
        if not self.begin:
            return text, places, int(places[len(text) - len(text.lstrip(" "))])
        data, parts, sources, at, lead = text.encode(), [], [], 0, None
        while at < len(text):
            hit = self.begin.search(text, at)
            to = hit.start() if hit else len(text)
            if to > at:  # no rule begins in here
                parts.append(text[at:to])
                sources.append(places[at:to])
                if lead is None and (rest := parts[-1].lstrip(" ")):
                    lead = int(places[to - len(rest)])
            if not hit:
                break
            own = self.own.match(text, to) if self.own else None
            found = None if own or not self.rules else self.rules.longest(data, int(places[to]))
            begin = int(places[to])
            if found:
                new, at = found[1].decode("utf-8", "replace"), int(np.searchsorted(places, begin + found[0]))
            else:
                new = own[0] if own else text[to]
                at = to + len(new)
            parts.append(new)
            sources.append(np.full(len(new), begin, np.int32))
            if lead is None and new != " ":
                lead = begin
        return "".join(parts), np.concatenate([*sources, places[-1:]]), lead or 0


def _byte_places(text: str) -> np.ndarray:
    """The first byte of each character in UTF-8, and the end."""
    if text.isascii():
        return np.arange(len(text) + 1, dtype=np.int32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
    return np.r_[0, np.cumsum(sizes)].astype(np.int32)


class Pieces:
    """A BPE model: texts to ids with spans, ids to texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError(f"{path} is no BPE model")
        self.fallback = model.trainer_spec.byte_fallback
        kinds = [p.type for p in model.pieces]
        names = [p.piece for p in model.pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(names, kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.scores = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.unused = {p for p, i in self.ids.items() if kinds[i] == UNUSED}
        own = [p for p, k in zip(names, kinds) if k == USER_DEFINED]
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE}
        self.normalise = Normaliser(model.normalizer_spec, own, model.trainer_spec.treat_whitespace_as_suffix)
        self.own = self.normalise.own
        joining = "|".join(f"[{_class(g)}]+" for g in _groups(self.ids))
        apart = not own and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.unit = re.compile(f"{MARK}+(?:{joining})?|{joining}|.", re.S) if apart and joining else None
        self.surface = [b"" if k == CONTROL else model.trainer_spec.unk_surface.encode() if k == UNKNOWN
                        else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(MARK, " ").encode()
                        for n, k in zip(names, kinds)]
        self.is_byte = [k == BYTE for k in kinds]
        self.marked = [k not in (CONTROL, UNKNOWN, BYTE) and n.startswith(MARK) for n, k in zip(names, kinds)]
        self.strips = self.normalise.prefix or self.normalise.squeeze
        self.known = _Known(self._unit)

    def merged(self, unit: str) -> list[str]:
        """The pieces of a unit: the best-scored pair of neighbours first, the leftmost of equals."""
        if self.own or self.unused or len(unit) > SHORT:
            return self._merged_by_heap(unit)
        score, none = self.scores.get, float("-inf")
        symbols = list(unit)
        pairs = [score(p, none) for p in map(operator.add, unit, unit[1:])]
        while pairs and (best := max(pairs)) != none:
            at = pairs.index(best)
            new = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + new, none)
            if at < len(pairs):
                pairs[at] = score(new + symbols[at + 1], none)
        return symbols

    def _merged_by_heap(self, unit: str) -> list[str]:
        """The same for long units, user-defined symbols (which never merge) and pieces that only serve to make longer ones."""
        symbols = [m[0] for m in re.finditer(self.own.pattern + "|.", unit, re.S)] if self.own else list(unit)
        frozen = [bool(self.own and self.own.fullmatch(s)) for s in symbols]
        scores, split = self.scores, {}
        right, left = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a < 0 or b >= len(symbols) or frozen[a] or frozen[b]:
                return
            pair = symbols[a] + symbols[b]
            score = scores.get(pair)
            if score is not None:
                heapq.heappush(heap, (-score, a, b, pair))
                if pair in self.unused:
                    split[pair] = symbols[a], symbols[b]

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or right[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, ""
            right[a] = right[b]
            if right[a] < len(symbols):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        out = [s for s in symbols if s]
        while any(s in split for s in out):
            out = [t for s in out for t in split.get(s, (s,))]
        return out

    def _unit(self, unit: str) -> bytes:
        """(id, characters) of each piece of a unit, as numbers of four bytes."""
        out = []
        for piece in self.merged(unit):
            id_ = self.ids.get(piece)
            if id_ is not None:
                out += [id_, len(piece)]
            elif self.fallback:
                data = piece.encode("utf-8", "replace")
                for i, byte in enumerate(data):
                    out += [self.bytes[byte], len(piece) if i + 1 == len(data) else 0]
            else:
                out += [self.unknown, len(piece)]
        return array.array("i", out).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): each piece with its span in the bytes of the text."""
        normal, source = self.normalise(text)
        units = self.unit.findall(normal) if self.unit else [normal] if normal else []
        known = self.known
        if len(known) > HELD:
            known.clear()
        ids, sizes = np.frombuffer(b"".join(map(known.__getitem__, units)), np.intc).reshape(-1, 2).T
        if not self.fallback and len(ids):  # neighbours that the vocabulary lacks are one piece
            first = np.flatnonzero(~((ids == self.unknown) & np.r_[False, ids[:-1] == self.unknown]))
            ids, sizes = ids[first], np.add.reduceat(sizes, first)
        ends = np.cumsum(sizes)
        return ids, source[ends - sizes], source[ends]

    def decode(self, ids: list[int]) -> str:
        surface, out, at, strip = self.surface, b"", 0, self.strips
        while at < len(ids) and not out and not self.is_byte[ids[at]]:  # the dummy prefix goes
            out = surface[ids[at]]
            if strip and self.marked[ids[at]]:
                out, strip = out[1:], self.normalise.squeeze
            at += 1
        out += b"".join(map(surface.__getitem__, ids[at:]))
        return out.decode("utf-8", "tablelens_bytes")


@functools.lru_cache(1)
def pieces_of(path: str) -> Pieces:
    """One model, with the units that it remembers, for all tasks of a worker process."""
    return Pieces(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int32)]).astype(np.int32)))


def _encode(path: str, decoded: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in batches:
            done, held, out, texts = 0, 0, [], []
            for at in range(batch.num_rows):
                out.append(model.encode(batch.column(1)[at].as_py()))
                if decoded:
                    texts.append(model.decode(out[-1][0].tolist()))
                held += len(out[-1][0])
                if held >= AT_ONCE or at + 1 == batch.num_rows:
                    columns = [batch.column(0).slice(done, at + 1 - done), *(_lists([o[i] for o in out]) for i in range(3))]
                    names = ["id", "ids", "begins", "ends"]
                    if decoded:
                        columns, names = [*columns, pa.array(texts, pa.string())], [*names, "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    done, held, out, texts = at + 1, 0, [], []
    return encode


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  decoded: bool = False) -> DataFrame:
    """One row per input row: id, ids, begins and ends (the span of each piece in the bytes of the
    text), and with ``decoded`` the text that the ids decode to."""
    rows = docs.select(F.struct(F.col(id_col).alias("own_id")).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["ids", "begins", "ends"] + ["decoded"] * decoded
    return rows.mapInArrow(_encode(model_path, decoded), f"id {kind}, ids array<int>, begins array<int>, ends array<int>"
                           + ", decoded string" * decoded).select(F.col("id.own_id").alias("id"), *names)


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for batch in batches:
            texts = [model.decode([i for i in ids.as_py() or [] if i is not None]) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])
    return decode


def decode_pieces(tokens: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text; null ids and null lists decode to nothing."""
    rows = tokens.select(F.struct(F.col(id_col).alias("own_id")).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decode(model_path), f"id {kind}, text string").select(F.col("id.own_id").alias("id"), "text")
