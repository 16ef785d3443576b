"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is encoded by halves.  Halves of a text are cut where a non-space meets white space: no match of the
splitting pattern runs across such a place, so their results just follow one another; a worker remembers the pieces between
such places.  Within one match, halves of its bytes are encoded on their own, down to leaves of a few bytes, and joined: a window around
the seam is decoded and encoded again, and grows until the tokens at both of its edges are settled.

When are they settled?  Call tokens (a, b) compatible if the bytes a+b encode to exactly [a, b].  A sequence of tokens
is the encoding of its bytes if and only if all neighbours are compatible (merges that would cross a seam later would
have to show in the pair itself).  Tokens outside the window are neighbours of each other in an encoding, tokens inside too;
so only the two edges of the window have to be checked, and when both pairs are compatible the joined sequence is the
encoding.  If the window reaches an end of the halves, there is nothing to check on that side.

Decoding joins the bytes of the tokens up the same tree.

Defined results: null text counts as empty (no ids, no bytes); equal texts get equal ids; very long texts and very long
matches take memory in proportion to one text only; repeated rows stay; an empty table gives no rows; a column of the input
that has the name of a new one is an error.  Ranks are read once by each Python worker.
"""

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import new_column, table, text_or_empty

#: Characters of a text below which the tree stops and the splitting pattern runs.
LEAF_CHARS = 16_384
#: Bytes of a leaf, whose merges run one by one; every longer match without a token of its own is halved and joined.
LEAF_BYTES = 4
#: Bytes of a part of a match whose ids are remembered: halves of words recur in other words.
PART_BYTES = 6
#: Remembered pieces, matches, parts and pairs of a worker; a full memory is emptied, so it holds a bounded share of RAM.
REMEMBER = 300_000

_SEAM = regex.compile(r"(?<=\S)\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self._match: dict[str, str] = {}
        self._piece: dict[str, str] = {}
        self._piece_before: dict[str, str] = {}  # the pieces remembered before the last ``REMEMBER`` new ones
        self.joins = self.windows = 0  # neighbours joined, and those whose seam took a window
        self._part: dict[bytes, list[int]] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._of: dict[int, bytes] = {i: b for b, i in self.ranks.items()}

    # -- one match -------------------------------------------------------------------------------------------------
    def _merge(self, data: bytes) -> list[int]:
        """Merges one by one: always the pair with the lowest rank, the leftmost of equals."""
        ranks = self.ranks
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = ranks.get, 1 << 60
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for long windows: a heap of pairs over a linked list, n log n."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 if none begins there
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two has been merged meanwhile
            end[end[i]], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if end[i]]

    def _settled(self, a: int, b: int) -> bool:
        found = self._pair.get((a, b))
        if found is None:
            if len(self._pair) >= REMEMBER:
                self._pair.clear()
            found = self._pair[a, b] = self._merge(self._of[a] + self._of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        self.joins += 1
        if not left or not right or self._settled(left[-1], right[0]):
            return left + right
        self.windows += 1
        i, j = len(left), 0  # the window is left[i:] + right[:j]
        grow = 1
        while True:
            i, j = max(0, i - grow), min(len(right), j + grow)
            data = b"".join(self._of[t] for t in left[i:] + right[:j])
            window = self._merge(data)
            if (i == 0 or self._settled(left[i - 1], window[0])) and (j == len(right) or self._settled(window[-1], right[j])):
                return left[:i] + window + right[j:]
            grow *= 2

    def _tree(self, data: bytes) -> list[int]:
        found = self._part.get(data)
        if found is not None:
            return found
        if len(data) <= LEAF_BYTES:
            found = self._merge(data)
        else:
            half = len(data) // 2
            found = self.join(self._tree(data[:half]), self._tree(data[half:]))
        if len(data) <= PART_BYTES:
            if len(self._part) >= REMEMBER:
                self._part.clear()
            self._part[data] = found
        return found

    def match_ids(self, match: str) -> str:
        """Ids of one match of the pattern, in decimal, joined by commas."""
        data = match.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self._tree(data)
        found = ",".join(map(str, ids))
        if len(match) <= 64:
            if len(self._match) >= REMEMBER:
                self._match.clear()
            self._match[match] = found
        return found

    # -- a text ----------------------------------------------------------------------------------------------------
    def encode_text(self, text: str) -> str:
        """Ids of a text, in decimal, joined by commas."""
        return ",".join(x for x in self._encode(text) if x)

    def _encode(self, text: str) -> list[str]:
        if len(text) > LEAF_CHARS and (seam := _SEAM.search(text, len(text) // 2)):
            at = seam.start()
            return self._encode(text[:at]) + self._encode(text[at:])
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():  # no seam before the first space
            return [self._matches(text)]
        return [self._matches(first), *self._pieces(rest)]

    def _matches(self, text: str) -> str:
        known = self._match.get
        return ",".join([known(m) or self.match_ids(m) for m in self.find(text)])

    def _pieces(self, pieces: list[str]) -> list[str]:
        """Ids of pieces that each follow a space: a seam is before each space after a non-space, so they are encoded apart."""
        ids = list(map(self._piece.get, pieces))
        at = -1
        try:
            while True:
                at = to = ids.index(None, at + 1)
                while to < len(pieces) and (not pieces[to] or pieces[to][-1].isspace()):
                    to += 1  # the next space follows a space: no seam there
                if to == at:
                    ids[at] = self._new_piece(pieces[at])
                else:
                    ids[at] = self._matches(" " + " ".join(pieces[at : to + 1]))
                    ids[at + 1 : to + 1] = [""] * (min(to + 1, len(pieces)) - at - 1)
        except ValueError:  # no further new piece
            return ids

    def _new_piece(self, piece: str) -> str:
        found = self._piece.get(piece) or self._piece_before.get(piece)
        if found is None:
            found = self._matches(" " + piece)
        if len(piece) <= 64:
            if len(self._piece) >= REMEMBER:
                self._piece_before, self._piece = self._piece, {}
            self._piece[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode_ids(self, joined: str) -> bytes:
        return self._decode(joined.split(",")) if joined else b""

    def _decode(self, ids: list[str]) -> bytes:
        if len(ids) > LEAF_CHARS:
            half = len(ids) // 2
            return self._decode(ids[:half]) + self._decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_ids(",".join(map(str, ids)))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, *, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int)."""
    new_column(docs, ids_col)

    @pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for s in texts:
            yield pd.Series([own.encode(t) for t in s], dtype=object)

    return docs.withColumn(ids_col, ids(text_or_empty(text_col)))


def decode_documents(docs: DataFrame, *, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that a column of token ids stands for."""
    new_column(docs, bytes_col)

    @pandas_udf("binary")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for s in ids:
            yield pd.Series([own.decode(x) if x is not None else None for x in s], dtype=object)

    return docs.withColumn(bytes_col, decoded(F.col(ids_col)))


def encoding_digests(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, without sending the ids out of the worker."""

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, sha = codec(path, pattern), hashlib.sha256
        for s in texts:
            rows = []
            for t in s:
                ids = own.encode_text(t)
                rows.append((ids.count(",") + 1 if ids else 0, sha(ids.encode()).hexdigest(), sha(own.decode_ids(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(text_or_empty(text_col)).alias("__tw_x")).select(id_col, "__tw_x.*")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path, pattern = default_tokenizer()
    return encoding_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path=path, pattern=pattern)
