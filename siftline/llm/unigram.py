"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Model files of public tokenizers; the path is a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of words, and the most of one word, whose pieces a task remembers; a word counts as ten characters more.
REMEMBERED, SHORT = 4 << 20, 64
#: Characters that are encoded at once.
CHUNK = 1 << 18
#: Characters from which a text's words are cut in parts, and bytes from which a single word is searched in parts.
LONG = 1 << 21
HUGE = 1 << 18
UNKNOWN_PENALTY = 10.0

# Fixed values of the public model format: kinds of pieces, and the model kind that stores merge ranks.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
RANKED_MODEL = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Vocabulary:
    """Pieces by id with their log scores, and how text is prepared."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool = True
    squeeze: bool = False

    @property
    def unknown(self) -> int:
        return int(np.flatnonzero(self.kinds == UNKNOWN)[0])


def read_vocabulary(path: str) -> Vocabulary:
    """Read a model file. A model of log scores is taken as it is. The public one stores merge ranks instead; tokenizers aren't trained
    here, so its pieces get the log scores of Zipf's law, -log(rank + 2): the best pieces by these scores are not those of the
    merges. Models with a character map are refused: the text would be changed."""
    pieces, scores, kinds, ranked, options = [], [], [], False, {}
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                found = dict(_fields(value))
                pieces.append(found[1].decode("utf-8"))
                scores.append(struct.unpack("<f", found.get(2, b"\0\0\0\0"))[0])
                kinds.append(found.get(3, NORMAL))
            elif number == 2:
                ranked = dict(_fields(value)).get(3, 1) == RANKED_MODEL
            elif number == 3:
                options = dict(_fields(value))
    if options.get(2):
        raise ValueError("the model has a character map")
    kinds = np.array(kinds)
    scores = np.array(scores, np.float64)
    if ranked:
        scores = np.where(kinds == NORMAL, -np.log(2 - np.minimum(scores, 0)), scores)
    return Vocabulary(pieces, scores.astype(np.float32), kinds, bool(options.get(3, 1)), bool(options.get(4, 1)))


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s for byte c is t = base[s] + c + 1 if check[t] = s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = 2 * len(children) + 1024
        base, check, value, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), bytearray(size)
        used[0] = 1
        # `free` is the first free slot, for states of one child; wider ones are tried from `hint`, which leaves full stretches behind
        free, hint, todo = 1, 1, [(0, 0)]
        for node, state in todo:
            value[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while used[free]:
                free += 1
            at = begin = free if len(codes) == 1 else max(free, hint)
            while any(used[at - codes[0] + c] for c in codes):
                at += 1
                if at + 258 > len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    base, check, value = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(value, np.full(grow, -1, np.int32))
            if len(codes) > 1 and at - begin > 64:
                hint = at
            b = at - codes[0] - 1
            base[state] = b
            for c in codes:
                used[b + c + 1] = 1
                check[b + c + 1] = state
                todo.append((children[node][c], b + c + 1))
        self.base, self.check, self.value = base, check, value

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of every key that begins at one of `starts` and ends by the end given for it; all starts walk at once."""
        state, found = np.zeros(len(starts), np.int32), []
        depth = 0
        while len(starts):
            inside = starts + depth < ends
            starts, ends, state = starts[inside], ends[inside], state[inside]
            to = self.base[state] + data[starts + depth] + 1
            ok = self.check[np.clip(to, 0, len(self.check) - 1)] == state  # slot 0 is nobody's child
            starts, ends, state = starts[ok], ends[ok], to[ok]
            depth += 1
            value = self.value[state]
            hit = value >= 0
            found.append((starts[hit], np.full(int(hit.sum()), depth, np.int32), value[hit]))
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))


class Encoder:
    """Cuts text into the pieces with the largest sum of log scores."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        normal = v.kinds == NORMAL
        scores = v.scores.astype(np.float64)  # sums are of 64 bits however long a word is
        top = float(v.scores[normal].max(initial=0.0))
        for i in np.flatnonzero(v.kinds == USER_DEFINED):
            scores[i] = len(v.pieces[i]) * top - 0.1
        self.scores = scores
        self.unknown_score = float(v.scores[normal].min(initial=0.0)) - UNKNOWN_PENALTY
        self.trie = DoubleArray({v.pieces[i].encode(): int(i) for i in np.flatnonzero(normal | (v.kinds == USER_DEFINED)) if v.pieces[i]})
        by_byte = {v.pieces[i]: int(i) for i in np.flatnonzero(v.kinds == BYTE)}
        self.bytes = [by_byte.get(f"<0x{b:02X}>", v.unknown) for b in range(256)] if by_byte else None
        # No piece goes on from another character to a marker: then a text can be cut before each run of markers.
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in v.pieces)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.cuts else "(?s).+")
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.widest = max((len(p.encode()) for p in v.pieces), default=1)
        self.surface = [MARK if k == UNKNOWN else "" if k == CONTROL else p for p, k in zip(v.pieces, v.kinds.tolist(), strict=True)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes or []) if i != v.unknown}

    def prepare(self, text: str) -> str:
        v = self.vocabulary
        if v.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return ((" " if v.dummy_prefix and text else "") + text).replace(" ", MARK)

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers in native order; none for a null or empty text. Of a long text some words at a time are held."""
        short = self._pack([self.words.findall(self.prepare(t)) if t and len(t) <= LONG else [] for t in texts])
        return [self._long(t) if t and len(t) > LONG else p for t, p in zip(texts, short, strict=True)]

    def _long(self, text: str) -> bytes:
        words, parts = (m[0] for m in self.words.finditer(self.prepare(text))), []
        while some := list(islice(words, LONG // 8)):
            parts += self._pack([some])
        return b"".join(parts)

    def _pack(self, cut: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of words. Long words, as in text without spaces, are not remembered."""
        new = list({w for words in cut for w in words if w not in self.known})
        huge = {w for w in new if len(w) > HUGE // 4 and len(w.encode("utf-8", "replace")) > HUGE}
        new = [w for w in new if w not in huge]
        made = dict(zip(new, self._viterbi(new), strict=True)) | {w: self._huge(w) for w in huge}
        self.known.update(made)
        known = self.known.__getitem__
        out = [b"".join(map(known, words)) for words in cut]
        for w in made:
            if len(w) > SHORT:
                del self.known[w]
            else:
                self.held += len(w) + 10
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        return out

    def _huge(self, word: str) -> bytes:
        """Best pieces of one very long word. It is searched from left to right, HUGE bytes at a time, with sums in 64-bit floats; of the
        whole word only eight bytes a byte are kept, the last piece of the best way to each place and where it begins."""
        coded = word.encode("utf-8", "replace")
        back, came = np.full(len(coded) + 1, -1, np.int32), np.zeros(len(coded) + 1, np.int32)
        best = {0: 0.0}
        for begin in range(0, len(coded), HUGE):
            stop = min(len(coded), begin + HUGE)
            data = np.frombuffer(coded[begin : stop + self.widest], np.uint8).astype(np.int32)
            heads = np.flatnonzero((data[: stop - begin] & 0xC0) != 0x80).astype(np.int32)
            start, length, piece = self.trie.matches(data, heads, np.full(len(heads), len(data), np.int32))
            every = np.flatnonzero((np.append(data, 0) & 0xC0) != 0x80)
            width = dict(zip(heads.tolist(), (every[np.searchsorted(every, heads) + 1] - heads).tolist(), strict=True))
            order = np.lexsort((length, start))
            edges = zip(start[order].tolist(), length[order].tolist(), piece[order].tolist(), self.scores[piece[order]].tolist(), strict=True)
            edge = next(edges, None)
            for at in heads.tolist():
                here, single = best.pop(begin + at), False
                steps = []
                while edge is not None and edge[0] == at:
                    single |= edge[1] == width[at]
                    steps.append(edge[1:])
                    edge = next(edges, None)
                for n, p, score in steps if single else [*steps, (width[at], -1, self.unknown_score)]:
                    to = begin + at + n
                    if here + score > best.get(to, -np.inf):
                        best[to] = here + score
                        back[to], came[to] = p, begin + at
        ids, at = [], len(coded)
        while at:
            p = int(back[at])
            ids += [p] if p >= 0 else [self.bytes[b] for b in reversed(coded[came[at] : at])] if self.bytes else [self.vocabulary.unknown]
            at = int(came[at])
        return np.array(ids[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(texts)]

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Best pieces of each word as packed ids, all words at once. Of equal sums the one whose last piece is longest stays."""
        if not words:
            return []
        coded = [w.encode("utf-8", "replace") for w in words]
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int32)
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        heads = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        start, length, piece = self.trie.matches(data, heads, end[heads])
        score = self.scores[piece]
        width = np.diff(np.append(heads, np.int32(len(data))))
        single = np.zeros(len(data), bool)
        whole = np.zeros(len(data), np.int32)
        whole[heads] = width
        single[start[length == whole[start]]] = True
        lone = heads[~single[heads]]
        start, length = np.concatenate([start, lone]), np.concatenate([length, whole[lone]])
        piece, score = np.concatenate([piece, np.full(len(lone), -1, np.int32)]), np.concatenate([score, np.full(len(lone), self.unknown_score)])
        offset = start - begin[start]
        offset = offset.astype(np.uint16) if sizes.max() < 1 << 16 else offset  # short keys sort faster
        order = np.argsort(offset, kind="stable")
        offset, start, piece, score = offset[order], start[order], piece[order], score[order]
        # best[p + word] is that of the prefix ending before byte p; a word's end and the next one's start differ
        own = np.repeat(np.arange(len(words), dtype=np.int32), sizes)[start]
        source = start + own
        stop = start + length[order]
        target = source + length[order]
        best = np.full(len(data) + len(words), -np.inf)
        best[first + np.arange(len(words))] = 0
        back = np.full(len(best), -1, np.int32)
        steps = np.flatnonzero(np.append(True, offset[1:] != offset[:-1]))
        for a, b in pairwise([*steps.tolist(), len(start)]):
            to = target[a:b]
            got = best[source[a:b]] + score[a:b]
            up = np.flatnonzero(got > best[to])
            to = to[up]
            best[to] = got[up]
            back[to] = up + a
        at = first + sizes + np.arange(len(words))
        taken = []
        while len(at):
            edge = back[at]
            taken.append(edge)
            at = source[edge][start[edge] > first[own[edge]]]
        taken = np.concatenate(taken)
        taken = taken[np.argsort(start[taken], kind="stable")]
        counts = np.bincount(own[taken], minlength=len(words))
        ids, starts, stops = piece[taken], start[taken], stop[taken]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):  # a character outside the pieces becomes the ids of its bytes
            widths = np.ones(len(ids), np.int64)
            widths[unknown] = stops[unknown] - starts[unknown] if self.bytes else 1
            whole = np.repeat(ids, widths)
            first_of = np.cumsum(widths) - widths
            for k in unknown.tolist():
                at = first_of[k]
                whole[at : at + widths[k]] = [self.bytes[b] for b in data[starts[k] : stops[k]].tolist()] if self.bytes else self.vocabulary.unknown
            counts = np.add.reduceat(widths, np.cumsum(counts) - counts)
            ids = whole
        packed = ids.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: runs of byte pieces are read as UTF-8, markers become spaces, and the space put before the text goes."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(self.surface[i])
            text = "".join(parts) + run.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(read_vocabulary(path))


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in order, about CHUNK characters at a time."""
    part, held = [], 0
    for t in texts:
        part.append(t.as_py())
        held += len(part[-1] or "")
        if held >= CHUNK:
            yield part
            part, held = [], 0
    yield part


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (<id_col>, ids array<int>, n_tokens).

    Whole texts are encoded; null and empty texts have no ids. Characters outside the vocabulary become
    their UTF-8 bytes (the unknown id if the model has no byte pieces). Repeated rows each get a row,
    other columns are not read. No row is shuffled; a word is cut once a task while it is remembered. A text without spaces is one word, whatever its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # of the size of the vocabulary
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            at = 0
            for part in _chunks(batch.column(1)):
                ids = encoder.encode_packed(part)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists, pa.array(sizes)], ["id", "ids", "n_tokens"])
                at += len(part)
        encoder.known, encoder.held = {}, 0  # a worker lives on after its task

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the text of each list of ids (empty for no ids, null for null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        return pa.array([shared.value.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)], pa.string())

    return encoded.withColumn("decoded", run(ids_col))


def op7_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the hash of the text that they decode to."""
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decode(encoded).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
