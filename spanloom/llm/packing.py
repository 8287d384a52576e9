"""Best-fit packing of token pieces into sequences (operator 9).

Documents are tokenised in Arrow batches and cut only where they are longer than a sequence; whole pieces of a sequence's
length stand alone. The rest goes through an online best-fit packer with a fixed number of open bins: a bitset has a bit
for each amount of free space that some open bin has, so the tightest fit is the lowest set bit at or above the piece's
length. When too many bins are open, the fullest closes first. Pieces are dealt by a hash of their row, so that null or repeated ids spread too; each task packs its own in hash
order, and only piece lengths (not tokens) are shuffled; a task holds open_bins bins, whatever the size of its input.

Nulls: a null text counts as empty, and is the single id 2. A null doc_id is packed like others. Repeated rows are packed as often as they come. An empty table
gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches, stored

LENGTH = 1024
END = 2
OPEN_BINS = 1024
#: Texts with runs of letters or of white space this long go to the slower library, which takes them in linear time.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")

_encoders: dict[str, tuple] = {}
_tokenizers: dict = {}


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fast(name: str):
    """A fast library's encoder of the tokenizer's vocabulary, which gives the same ids for ordinary text; and the special tokens."""
    if name not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        with open(_path(name), encoding="utf-8") as f:
            model = json.load(f)
        special = [t["content"] for t in model["added_tokens"]]
        byte_of = _byte_of_letter()
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        _encoders[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special
    return _encoders[name]


def _slow(name: str):
    """The tokenizer's own library, loaded where a text needs it."""
    if name not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[name] = Tokenizer.from_file(_path(name))
    return _tokenizers[name]


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself if it is one, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def encode(text: str, name: str = "byte_bpe_50k.json") -> list[int]:
    """The ids of the text, as Tokenizer.encode(text, add_special_tokens=False) gives them."""
    fast, special = _fast(name)
    if any(s in text for s in special) or len(text) >= 2000 and LONG_RUN.search(text):
        return _slow(name).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: the first may be shorter."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces_of(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH) -> DataFrame:
    """doc_id, row_id, piece, start, length, ids_crc32 of all pieces."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = array("I", encode(text or "", tokenizer))
                ids.append(END)
                raw = memoryview(np.frombuffer(ids, np.uint32).astype("<u4", copy=False)).cast("B")
                out += [(row, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids), length))]
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(cols[0])), batch.column("row_id").take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])],
                names=["doc_id", "row_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), "text")
    return rows.mapInArrow(tokenise, "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most = length, open_bins
        self.bits, self.bins, self.open, self.made = 0, [[] for _ in range(length + 1)], 0, 0

    def put(self, n: int) -> tuple[int, int]:
        """The number of the sequence that takes n ids, and the offset there."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.made
            self.made += 1
        left = free - n
        if left:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Each piece with its sequence_id and offset. Any frame with doc_id, row_id, piece and length will do."""
    dealt = pieces.repartition("doc_id", "row_id", "piece").sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "row_id", "piece")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = TaskContext.get().partitionId() << 40, Packer(length, open_bins)
        for batch in batches:
            spots = np.array([packer.put(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spots[0] + base), pa.array(spots[1])], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """All pieces of docs and their places in sequences."""
    small_arrow_batches(docs.sparkSession)
    return pack(stored(pieces_of(docs), "pieces")).drop("row_id")
