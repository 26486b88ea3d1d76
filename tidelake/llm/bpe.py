"""Byte-level BPE encoding by prefix dynamic programming, and decoding (operator 5).

For every prefix of a byte string there is exactly one token that can end the
encoding of that prefix. ``PrefixTable`` stores it, position by position: a
token may end a prefix if it is compatible with the last token of the shorter
prefix before it, which is so if encoding the two alone gives the two back. The
table makes appends exact, as earlier entries never change, and lets an edit
recompute only the entries near it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow, kept, pieces

#: Texts of these characters alone are split by a plainer pattern with the same matches.
_PLAIN = re.compile(r"[\t\n\v\f\r -~À-ÖØ-öø-ɏ]*")
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t\n\v\f\r 0-9{_L}]+|[\t\n\v\f\r ]+(?![^\t\n\v\f\r ])|[\t\n\v\f\r ]+")
#: Pieces over this many bytes are not kept, and caches are renewed at so many entries.
KEEP_BYTES, KEEP_PIECES, KEEP_PAIRS = 64, 100_000, 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines "base64 rank"."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Ranks, with the compatibility of neighbouring tokens, worked out as needed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes by merging, lowest rank first."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can be neighbours; ``left`` is -1 at the start."""
        if left < 0:
            if (found := self.alone.get(right)) is None:
                found = self.alone[right] = self.merged(self.bytes_of[right]) == [right]
            return found
        key = left << 32 | right
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found


class PrefixTable:
    """``last[j]`` is the token that ends the encoding of the first ``j`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes at the end; what is there stays."""
        start = len(self.data)
        self.data += data
        self.last += [-1] * len(data)
        self._fill(start, len(self.data))

    def _fill(self, start: int, until: int) -> None:
        """Works out the entries after ``start``, through ``until``, from the tokens that end there."""
        last, compatible, pairs = self.last, self.vocabulary.compatible, self.vocabulary.pairs.get
        first = max(0, start - self.vocabulary.longest + 1)
        for at, (token, length) in self.vocabulary.matches.iter(self.data[first:until].decode("latin-1")):
            j = first + at + 1
            if j > start and last[j] < 0:
                left = last[j - length]
                if left >= 0:
                    fits = pairs(left << 32 | token)
                    if fits or fits is None and compatible(left, token):
                        last[j] = token
                elif length == j and compatible(-1, token):
                    last[j] = token

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts ``data`` in place of bytes ``start`` to ``end``; returns how many entries were worked out.

        Entries to the left stay. Those to the right are worked out in blocks
        until a whole token length of them agrees with the old ones; from there
        on all of them do.
        """
        old, tail, longest = self.last[end + 1 :], self.data[end:], self.vocabulary.longest
        self.data = self.data[:start] + data + tail
        self.last = self.last[: start + 1] + [-1] * len(data)
        self._fill(start, len(self.last) - 1)
        done = 0
        while done < len(old):
            block = min(2 * longest, len(old) - done)
            at = len(self.last) - 1
            self.last += [-1] * block
            self._fill(at, at + block)
            done += block
            if block == 2 * longest and self.last[-longest:] == old[done - longest : done]:
                self.last += old[done:]
                break
        return len(data) + done

    def tokens(self) -> list[int]:
        found, at, length = [], len(self.data), self.vocabulary.bytes_of
        while at:
            found.append(self.last[at])
            at -= len(length[self.last[at]])
        return found[::-1]


class _Pieces(dict):
    """Packed ids of pieces; a piece that is missing is encoded and kept for a while."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            rank = self.vocabulary.ranks.get(data)
            ids = [rank] if rank is not None else PrefixTable(self.vocabulary, data).tokens()
            packed = np.array(ids, "<u4").tobytes()
            if len(data) > KEEP_BYTES:
                return packed
        if len(self) >= KEEP_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Codec:
    """Text to packed ids and back; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.plain = pattern == PATTERN
        self.pieces = _Pieces(self.vocabulary)

    def encode(self, text: str) -> bytes:
        split = _PLAIN_SPLIT.findall if self.plain and _PLAIN.fullmatch(text) else self.split
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


#: Fixed value: the pattern for which the plainer one stands in.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ENCODED = T.StructType([T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.BinaryType(), False)])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids, decoded`` for each row of ``docs``.

    ``ids`` are packed little-endian unsigned 32-bit integers and ``decoded``
    the bytes that they stand for. ``ranks_path`` is a file that the driver
    reads. A null or empty text has no tokens. Very long texts and pieces are
    encoded whole. Repeated rows give repeated rows; other columns are ignored.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # the vocabulary file, of fixed size
    key = ("codec", hash(data), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(key, lambda: Codec(read_ranks(shared.value), pattern))
        for batch in pieces(batches):
            ids = [codec.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"]
            )

    slim = docs.select(id_col, text_col)
    return in_arrow(slim, run, T.StructType([slim.schema[id_col], *ENCODED.fields]))
