"""Packing by power-of-two decomposition.

A document's tokens (its ids and one end id) are split into pieces whose
lengths are powers of two: as many of ``MAX_LENGTH`` as fit, then the binary
digits of the rest, longest first.  Each piece is a sequence by itself, so no
sequence crosses documents and none needs padding; pieces of one length share a
bucket, from which batches of equal shape are drawn.

One map over the documents, no shuffle.  Texts are tokenised word by word with
a bounded memo: the tokenizer's pattern never joins a blank, or a lone line
feed, to the word before it; texts with other runs of white space go through
the tokenizer whole.

Null text counts as empty: one piece with the end id.  Repeated rows are packed
each for itself, an empty table gives no pieces, other columns are ignored.
``sequence_id`` is unique within one result (``monotonically_increasing_id``).
"""

from __future__ import annotations

import base64
import os
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, Memo, held, map_arrow, slices

VOCABULARY = "byte_bpe_50k.json"
MAX_LENGTH = 2048
END_ID = 1
MEMO_WORDS = 200_000
#: How the vocabulary's tokenizer splits text before merging (fixed by the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = ",.!?;:*%$#&"


def lengths_of(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to n, none above ``longest`` (itself a power of two)."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes."""

    #: Texts where white space stands alone, never first or last, can be cut at blanks and line feeds.
    irregular = re.compile(r"\s\s|\A\s|\s\Z")

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, ranks: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        t.no_truncation()
        t.no_padding()
        self.ranks = self._ranks(path) if ranks else None
        self.first = Memo(self._word, memo_words // 8)
        self.later = Memo(self._later, memo_words)
        self.tails = Memo(self.whole, 10_000)
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _later(self, word: str) -> bytes:
        """A word after a blank. Letters and the marks after them are split by the tokenizer's pattern."""
        stem = word.rstrip(MARKS)
        if stem and len(stem) < len(word) and stem[-1].isalpha():
            return self.later[stem] + self.tails[word[len(stem):]]
        return self._word(" " + word)

    def _word(self, text: str) -> bytes:
        """A word, with or without a blank before it."""
        if self.ranks is None:
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        ids = self.ranks(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary as merge ranks, a faster way to the same ids for words of plain letters; None without the file."""
        import tiktoken

        beside = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(beside):
            return None
        with open(beside, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if not text or self.irregular.search(text):
            return self.whole(text)
        parts = []
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(self.first[words[0]])
            parts.extend(map(self.later.__getitem__, words[1:]))
            parts.append(self.feed)
        parts.pop()
        return b"".join(parts)


def encoder(path: str) -> Encoder:
    return held(("packing", path), lambda: Encoder(path))


def pack(docs: DataFrame, vocabulary_path: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, bucket (log2 of length),
    sequence_id and offset in the sequence (always 0)."""
    path = vocabulary_path or os.path.join(TOKENIZER_DIR, VOCABULARY)
    end = struct.pack("<I", end_id)

    def run(batches):
        e = encoder(path)
        for b in slices(batches, 2 << 20):
            which, start, length, ids, total = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                coded = e.encode(text or "") + end
                n, at = len(coded) // 4, 0
                for size in lengths_of(n, longest):
                    which.append(row)
                    start.append(at)
                    length.append(size)
                    ids.append(coded[4 * at:4 * (at + size)])
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(which, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(total, pa.int64()),
                 pa.array([n.bit_length() - 1 for n in length], pa.int32())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])

    x = docs.select("doc_id", "text")
    kind = x.schema["doc_id"].dataType.simpleString()
    out = map_arrow(x, run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, bucket int")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per bucket, ready to be read in batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset", "bucket")
