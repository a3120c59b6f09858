"""SentencePiece encoding and decoding that keeps source offsets.

``Normalizer`` reads the compiled character map of a model (a double-array trie
and a pool of replacements), replaces the longest matching prefix at each
position and records for every normalised byte the source byte it came from.
``Codec`` then merges pieces by score and projects each piece back to the byte
span of the source it covers.  Begin and end marks get empty spans.

BPE models run here; a model of another kind is refused.  Merges never cross a
boundary before a run of word marks when no piece of the vocabulary does, nor a
line feed that no longer piece holds; such texts are encoded word by word, with
a bounded memo of words (only speed depends on it).

Distribution: one map over the documents, no shuffle; a task holds a few
megabytes of text, its ids and the memo.  Null text counts as empty.  Empty
text gives the begin and end ids alone.  Repeated rows give repeated rows, an
empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, Memo, held, map_arrow, slices, text_bytes

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Words remembered per Python worker.
MEMO_WORDS = 250_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format


def _fields(buf: bytes):
    """(field number, value) of a protobuf message; values are ints or bytes."""
    i, n = 0, len(buf)

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = buf[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, buf[i:i + size]
            i += size


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, proto: bytes):
        self.pieces, self.scores, self.types = [], [], []
        trainer, norm = {}, {}
        for no, value in _fields(proto):
            if no == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif no == 2:
                trainer = dict(_fields(value))
            elif no == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if USER in self.types or UNUSED in self.types or trainer.get(24, 0):
            raise ValueError("models with user-defined or unused pieces, or with word marks as suffixes, are not supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.remove_extra = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.unk = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.bos = self.pieces.index("<s>")
        self.eos = self.pieces.index("</s>")


class Normalizer:
    """Longest-prefix normalisation with alignment."""

    def __init__(self, model: Model):
        self.m = model
        self.units, self.pool = np.zeros(0, np.uint32), b""
        if model.charsmap:
            size = struct.unpack_from("<I", model.charsmap)[0]
            self.units = np.frombuffer(model.charsmap, "<u4", size // 4, 4)
            self.pool = model.charsmap[4 + size:]

    def _longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement in the pool) of the longest key at ``at``; (0, 0) if none."""
        units, best = self.units, (0, 0)
        if not len(units):
            return best
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = int(units[node])
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, int(units[node]) & 0x7FFFFFFF)
        return best

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest prefix at ``at`` and how many bytes it takes."""
        took, place = self._longest(text, at)
        if took:
            return self.pool[place:self.pool.index(b"\0", place)], took
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        char = text[at:at + size]
        try:
            char.decode()
        except UnicodeDecodeError:
            size = 0
        return (char, size) if size else ("�".encode(), 1)

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the source byte it comes from."""
        m = self.m
        out, origin = bytearray(), []
        space = MARK.encode() if m.escape else b" "
        at, end = 0, len(text)
        if m.remove_extra:
            while at < end:
                to, took = self._prefix(text, at)
                if to != b" ":
                    break
                at += took
        if at >= end:
            return b"", np.array([at])
        if m.dummy_prefix:
            out += space
            origin += [at] * len(space)
        after_space = m.remove_extra
        while at < end:
            to, took = self._prefix(text, at)
            while after_space and to.startswith(b" "):
                to = to[1:]
            if to:
                part = to.replace(b" ", space)
                out += part
                origin += [at] * len(part)
                after_space = to.endswith(b" ")
            at += took
            if not m.remove_extra:
                after_space = False
        if m.remove_extra:
            while out.endswith(space):
                del out[-len(space):]
                end = origin[len(out)]
                del origin[len(out):]
        return bytes(out), np.array([*origin, end])


class Codec:
    def __init__(self, proto: bytes, memo_words: int = MEMO_WORDS):
        m = self.m = Model(proto)
        self.normalizer = Normalizer(m)
        longer = [p for p in m.ids if len(p) > 1]
        #: Texts may be cut before runs of marks and around line feeds.
        self.by_word = m.escape and not any(MARK in p.lstrip(MARK) for p in longer) and not any("\n" in p for p in longer)
        #: Normalisation only writes word marks for spaces.
        self.identity = self.by_word and not m.charsmap and not m.remove_extra and m.dummy_prefix and m.byte_fallback
        self.chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.memo = Memo(lambda chunk: self._pack(self._merge(chunk)), memo_words)
        self.words = Memo(lambda word: self._pack(self._merge(MARK + word)), memo_words)
        # the normalised bytes of a piece, and its source bytes where a mark stands for a space
        self.norm_len = np.array([1 if t == BYTE else 0 if t == CONTROL else len(p.encode()) for p, t in zip(m.pieces, m.types)])
        self.orig_len = np.array([1 if t == BYTE else 0 if t == CONTROL else len(p.replace(MARK, " ").encode()) for p, t in zip(m.pieces, m.types)])
        self.surface = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else m.unk_surface.encode() if t == UNKNOWN
                        else p.replace(MARK, " ").encode() for p, t in zip(m.pieces, m.types)]

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge(self, text: str) -> list[int]:
        """Merge adjacent symbols, best score first, leftmost among equals; then look up the ids."""
        ids, scores = self.m.ids, self.m.scores
        parts = list(text)
        if len(parts) <= 64:
            rank = [ids.get(a + b) for a, b in zip(parts, parts[1:])]
            while True:
                best, at = None, -1
                for i, r in enumerate(rank):
                    if r is not None and (best is None or scores[r] > best):
                        best, at = scores[r], i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                del rank[at]
                if at:
                    rank[at - 1] = ids.get(parts[at - 1] + parts[at])
                if at < len(rank):
                    rank[at] = ids.get(parts[at] + parts[at + 1])
        else:
            parts = self._merge_long(parts)
        out: list[int] = []
        for p in parts:
            i = ids.get(p)
            if i is not None:
                out.append(i)
            elif self.m.byte_fallback:
                out += [self.m.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.m.unk)
        return out

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap, for texts without cuts."""
        ids, scores, n = self.m.ids, self.m.scores, len(parts)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(a, b):
            if a >= 0 and b >= 0 and (r := ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-scores[r], a, b, len(parts[a]) + len(parts[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def _ids(self, norm: str) -> bytes:
        if self.by_word:
            return b"".join(map(self.memo.__getitem__, self.chunks.findall(norm)))
        return self._pack(self._merge(norm))

    def encode(self, source: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end marks, and their (begin, end) byte spans in the source."""
        m = self.m
        if self.identity and source and b"  " not in source and source[0] != 32 and MARK.encode() not in source:
            # each space starts a word; the memo knows words by their text without the mark
            parts = []
            for i, line in enumerate(source.decode().split("\n")):
                words = line.split(" ")
                if i:
                    parts.append(self.memo["\n"])
                    if first := words[0]:
                        parts.append(self.memo[first])
                    del words[0]
                parts.extend(map(self.words.__getitem__, words))
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum(self.orig_len[ids]) - 1  # less the mark put in front
            begins = np.empty_like(ends)
            begins[:1], begins[1:] = 0, ends[:-1]
            n = len(source)
        else:
            norm, origin = self.normalizer.normalize(source)
            ids = np.frombuffer(self._ids(norm.decode()), "<u4")
            if not m.byte_fallback and len(ids):  # a run of unknown characters is one unknown
                lengths = self._unknown_lengths(ids, norm)
                fresh = np.ones(len(ids), bool)
                fresh[1:] = ~((ids[1:] == m.unk) & (ids[:-1] == m.unk))
                at = np.concatenate([[0], np.cumsum(lengths)])
                places = np.flatnonzero(fresh)
                edges = np.concatenate([at[places], at[-1:]])
                ids = ids[fresh]
            else:
                edges = np.concatenate([[0], np.cumsum(self.norm_len[ids])])
            edges = origin[edges]
            begins, ends, n = edges[:-1], edges[1:], len(source)
        spans = np.zeros((len(ids) + 2, 2), "<u4")
        spans[1:-1, 0], spans[1:-1, 1], spans[-1] = begins, ends, n
        return np.concatenate([[m.bos], ids, [m.eos]]).astype("<u4"), spans

    def _unknown_lengths(self, ids: np.ndarray, norm: bytes) -> np.ndarray:
        out, at = [], 0
        for i in ids.tolist():
            if i == self.m.unk:
                lead = norm[at]
                out.append(1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            else:
                out.append(int(self.norm_len[i]))
            at += out[-1]
        return np.array(out, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the space that the front mark stands for is left out."""
        m = self.m
        flat = ids.tolist()
        text = b"".join(map(self.surface.__getitem__, flat))
        try:
            text.decode()
        except UnicodeDecodeError:  # byte pieces that form no character
            text = b"".join(self._runs(flat))
        first = next((i for i in flat if m.types[i] != CONTROL), m.unk)
        if (m.dummy_prefix or m.remove_extra) and m.types[first] == NORMAL and m.pieces[first].startswith(MARK):
            text = text.lstrip(b" ") if m.remove_extra else text[1:]
        return text

    def _runs(self, ids: list[int]):
        run = bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.m.types[i] == BYTE:
                run += self.surface[i]
                continue
            while run:
                for size in (4, 3, 2, 1):
                    try:
                        if len(run[:size].decode()) == 1:
                            yield bytes(run[:size])
                            del run[:size]
                            break
                    except UnicodeDecodeError:
                        pass
                else:
                    yield "�".encode()
                    del run[0]
            if i >= 0:
                yield self.surface[i]


def codec(path: str) -> Codec:
    """One codec per Python worker and model; its memo lives on between tasks."""
    def make():
        with open(path, "rb") as f:
            return Codec(f.read())
    return held(("sentencepiece", path), make)


def encode(docs: DataFrame, model_path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ``ids`` (little-endian uint32), ``spans`` (uint32 pairs of source bytes, one per id);
    with ``decoded`` also the text that the ids decode to.

    model_path: a tokenizer file that lies at the same place on every node.
    """
    path = model_path or os.path.join(TOKENIZER_DIR, MODEL)

    def run(batches):
        c = codec(path)
        for b in slices(batches):
            coded = [c.encode(t) for t in text_bytes(b.column("text"))]
            cols = [b.column("doc_id"), pa.array([len(i) for i, _ in coded], pa.int64()),
                    pa.array([i.tobytes() for i, _ in coded], pa.binary()), pa.array([s.tobytes() for _, s in coded], pa.binary())]
            names = ["doc_id", "n_tokens", "ids", "spans"]
            if decoded:
                cols.append(pa.array([c.decode(i).decode("utf-8", "replace") for i, _ in coded], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    x = docs.select("doc_id", "text")
    kind = x.schema["doc_id"].dataType.simpleString()
    return map_arrow(x, run, f"doc_id {kind}, n_tokens long, ids binary, spans binary" + ", decoded string" * decoded)


def decode(coded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and the text of its ``ids``."""
    path = model_path or os.path.join(TOKENIZER_DIR, MODEL)

    def run(batches):
        c = codec(path)
        for b in slices(batches, column="ids"):
            texts = [c.decode(np.frombuffer(i or b"", "<u4")).decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    x = coded.select("doc_id", "ids")
    return map_arrow(x, run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, decoded string")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.crc32("spans").alias("spans_crc32"))
