"""Byte-level BPE by monoid tree reduction.

A text is cut into halves down to leaves. The code of a stretch of text is a monoid element: an
open head, ids that no neighbour can change, and an open tail. A space between two characters
that are no white space always starts a match of the pattern, whatever stands further off, so
what lies between two such spaces is settled; joining neighbours re-encodes only the window from
the last such space on the left to the first one on the right, and where a side has none the
window grows over that side up the tree.

A long match is halved likewise. Its halves are joined by re-encoding a window of tokens round
the seam, grown until the tokens at its edges and their outer neighbours keep apart when they
are encoded together: a sequence of tokens is the code of its bytes just when each two
neighbours are the code of theirs, so all outside the window is then settled. Decoding
concatenates up the same tree.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import whole_text
from inkweave.session import read_table

#: Characters of a leaf of the text's tree, bytes of a leaf of a match's tree, ids of a leaf in decoding.
TEXT_LEAF, MATCH_LEAF, ID_LEAF = 4096, 64, 4096
#: Entries of a cache at most, and the longest text that it keeps.
CACHED, CACHED_CHARS = 200_000, 48
#: Rows that are encoded or decoded together.
ROWS = 256
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Every code point that some library takes for white space.
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u180E\u2000-\u200F\u2028\u2029\u202F\u205F\u2060\u3000\uFEFF"
#: A space at which a match starts in any surroundings.
SETTLED = re.compile(f" (?<=[^{BLANK}] )(?=[^{BLANK}])")


class Codec:
    """Encodes and decodes with one rank file; kept by worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.bytes_to = [self.ranks[bytes([x])] for x in range(256)]
        self.pairs = {}  # two tokens' ranks to that of both together
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.matches = regex.compile(pattern).findall
        self.words, self.older_words = {}, {}  # packed ids of matches; the older half goes when the newer one is full
        self.apart: dict[int, bool] = {}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})

    # one match of the pattern

    def merged(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """The code of a short stretch: the pair of the lowest rank is merged, the leftmost of ties first, while more parts are left."""
        get, far = self.pairs.get, len(self.bytes_of)
        parts = [self.bytes_to[x] for x in piece]
        ranks = [get(a << 32 | b, far) for a, b in pairwise(parts)]
        while len(ranks) >= parts_left and (low := min(ranks)) < far:
            i = ranks.index(low)
            parts[i] = low
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | low, far)
            if i < len(ranks):
                ranks[i] = get(low << 32 | parts[i + 1], far)
        return parts

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The same for a long stretch, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def spine(self, token: int, right: bool) -> list[int]:
        """The parts at one end of a token as they grow, from its outer byte to itself."""
        if (known := self.spines[right].get(token)) is None:
            piece = self.bytes_of[token]
            if len(piece) == 1:
                known = [token]
            else:
                parts = self.merged(piece, 2)
                if len(parts) != 2 or max(parts) >= token:
                    raise ValueError("a token is not made of two of lower rank: these ranks are no byte-pair merges")
                known = [*self.spine(parts[right], right), token]
            self.spines[right][token] = known
        return known

    def keep_apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b are the code of their bytes together.

        Merges go by rising rank, so the parts that meet at the seam are known at each rank;
        they merge across it if their pair's rank comes before what changes either of them.
        """
        key = a << 32 | b
        if (known := self.apart.get(key)) is None:
            if len(self.apart) >= CACHED:
                self.apart.clear()
            left, right, bytes_of, get = self.spine(a, True), self.spine(b, False), self.bytes_of, self.ranks.get
            i, j, far = 0, 0, len(bytes_of)
            while True:
                grown_left = left[i + 1] if i + 1 < len(left) else far
                grown_right = right[j + 1] if j + 1 < len(right) else far
                pair = get(bytes_of[left[i]] + bytes_of[right[j]], far)
                if pair < grown_left and pair <= grown_right and pair < far:
                    known = False
                    break
                if grown_left == grown_right == far:
                    known = True
                    break
                if grown_left <= grown_right:
                    i += 1
                else:
                    j += 1
            self.apart[key] = known
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The code of two encoded stretches of a match."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged_by_heap(self.decoded(left[len(left) - i :] + right[:j]))
            more = i < len(left) and not self.keep_apart(left[-i - 1], window[0])
            less = j < len(right) and not self.keep_apart(window[-1], right[j])
            if not (more or less):
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 + more), j * (1 + less)

    def match_code(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= MATCH_LEAF:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.match_code(piece[:half]), self.match_code(piece[half:]))

    # texts

    def word(self, match: str) -> bytes:
        """The packed ids of one match."""
        known = self.words.get(match) or self.older_words.get(match)
        if known is None:
            ids = self.match_code(match.encode())
            known = pack(f"<{len(ids)}I", *ids)
        if len(match) <= CACHED_CHARS:
            if len(self.words) >= CACHED:
                self.words, self.older_words = {}, self.words
            self.words[match] = known
        return known

    def window(self, text: str) -> bytes:
        """The packed ids of a stretch whose matches are those of the whole text."""
        found = self.matches(text)
        ids = list(map(self.words.get, found))
        if None in ids:
            ids = [self.word(m) if i is None else i for m, i in zip(found, ids, strict=True)]
        return b"".join(ids)

    def leaf(self, text: str) -> tuple[str, bytes | None, str]:
        """(head, settled ids, tail); (text, None, "") if no place in it is settled."""
        first = SETTLED.search(text)
        if not first:
            return text, None, ""
        head, tail = first.start(), text.rfind(" ")
        while not SETTLED.match(text, tail):
            tail = text.rfind(" ", 0, tail)
        return text[:head], self.window(text[head:tail]), text[tail:]

    def combined(self, a: tuple[str, bytes | None, str], b: tuple[str, bytes | None, str]) -> tuple[str, bytes | None, str]:
        if a[1] is None and b[1] is None:
            return self.leaf(a[0] + b[0])
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.window(a[2] + b[0]) + b[1], b[2]

    def _tree(self, text: str) -> tuple[str, bytes | None, str]:
        if len(text) <= TEXT_LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.combined(self._tree(text[:half]), self._tree(text[half:]))

    def encoded(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        head, ids, tail = self._tree(text)
        return self.window(head) if ids is None else self.window(head) + ids + self.window(tail)

    def decoded(self, ids: list[int]) -> bytes:
        if len(ids) <= ID_LEAF:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) for each row of docs: ids holds the tokens of the whole text as little-endian unsigned 32-bit integers.

    path names a rank file on every executor. Null and empty texts have no ids; rows without an
    id and repeated rows are encoded as they are; an empty table gives an empty one.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encoded
        for b in _pieces(batches):
            ids = pa.array([encode(t.as_py()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids, decoded) for each row of encoded(id, ids); decoded holds the bytes. Null ids decode to nothing."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, pattern).decoded
        for b in _pieces(batches):
            out = pa.array([decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), out], ["id", "ids", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, decoded binary")


def token_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids as a list of integers) for each row of docs."""
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encoded
        for b in _pieces(batches):
            packed = [encode(t.as_py()) for t in b.column("text")]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), lists], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>")


def op8_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode_ids(encode_texts(read_table(spark, sf_dir, "documents")))
    return both.select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_bpe_monoid": op8_bpe_monoid}
ORACLES: dict[str, str] = {}
