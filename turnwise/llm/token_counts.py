"""Token counts without the tokens: batches of text go through the tokenizer's library inside Arrow functions, and only lengths come back.

A task gets Arrow batches of bounded size.  Texts are split into pieces at safe boundaries, equal pieces of a batch are encoded once (a worker
remembers short ones), in encoding batches of about equal numbers of bytes (``ENCODE_BYTES`` at most, or one piece), and the pieces' lengths are
added up by text.  No ids leave the task, nothing is shuffled.

Safe boundaries.  A split is safe where no normalisation, pattern or merge of the tokenizer sees both sides:

* .json files that drop white space before merging (the kind ``records._BY_WORDS``): after every space, tab or line end;
* .json files of the byte-level kind, which keep one space with the word after it: in front of a single space between visible ASCII characters;
* .model files in which no piece goes on after a word's end: at a single space between other characters, which the next piece's own
  prefix stands for.  Only texts of over ``PIECE`` characters are split there.

The kind is read from the file (``_JSON_KINDS``, ``_model_splits``).  With any other file, whole texts are encoded; so is a text
without boundaries, however long.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; strings of special tokens in a text count as the library's
default has them; no begin, end or other special tokens are added, nothing is truncated or padded; repeated rows stay; an
empty table gives no rows; other columns pass through; a column of the input named as a new one is an error.
"""

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import new_column, prepare, table, text_or_empty
from .records import _BY_WORDS

LIMIT = 2048
#: Characters of a piece of a long text, and bytes that are encoded together.
PIECE = 1 << 15
ENCODE_BYTES = 1 << 20

#: Pieces that a worker remembers, twice, and the characters of the longest one.
REMEMBER = 300_000
SHORT = 64

_AT_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
Count = Callable[[list[str]], list[int]]


def _after_space(data: np.ndarray) -> np.ndarray:
    space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    return np.append(False, space[:-1])


def _before_single_space(data: np.ndarray) -> np.ndarray:
    visible = (data > 32) & (data < 127)
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 32) & visible[:-2] & visible[2:]
    return cut


#: Parts of .json files (fixed values), and which bytes of UTF-8 begin a piece if a file has them.
_JSON_KINDS = [
    (_BY_WORDS, _after_space),
    ({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, _before_single_space),
]


def pieces(text: str, boundary: re.Pattern, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of ``size`` characters or a little more; what the boundary matches is left out between them."""
    at = 0
    while len(text) - at > size and (cut := boundary.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def balanced(parts: list[str], most: int = ENCODE_BYTES) -> Iterator[list[str]]:
    """Runs of the parts with about equal numbers of bytes, ``most`` at the utmost unless one part alone has more."""
    sizes = [len(p.encode()) for p in parts]
    each = sum(sizes) / max(1, -(-sum(sizes) // most))
    got, held = [], 0
    for p, n in zip(parts, sizes, strict=True):
        if got and (held + n > most or held >= each):
            yield got
            got, held = [], 0
        got.append(p)
        held += n
    if got:
        yield got


def _summed(owner: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, lengths, n).astype(np.int64)


class Whole:
    """Counts by a library's function over whole texts, or over pieces of long ones."""

    def __init__(self, count: Count, boundary: re.Pattern | None = None):
        self.count, self.boundary = count, boundary

    def lengths(self, texts: pa.Array, piece: int = PIECE, encode_bytes: int = ENCODE_BYTES) -> np.ndarray:
        owner, parts = [], []
        for i, t in enumerate(texts.to_pylist()):
            own = list(pieces(t, self.boundary, piece)) if self.boundary else [t]
            parts += own
            owner += [i] * len(own)
        found = [n for run in balanced(parts, encode_bytes) for n in self.count(run)]
        return _summed(np.array(owner, np.int64), np.array(found, np.int64), len(texts))


class Pieces:
    """Counts over the distinct pieces of a batch; begins: which bytes begin a piece."""

    def __init__(self, count: Count, begins: Callable[[np.ndarray], np.ndarray]):
        self.count, self.begins = count, begins
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}  # what was known before the last ``REMEMBER`` new pieces

    def lengths(self, texts: pa.Array, encode_bytes: int = ENCODE_BYTES) -> np.ndarray:
        if pa.types.is_large_string(texts.type):  # as a session may ask for; batches are far smaller
            texts = texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(ends[0]), int(ends[-1])
        if first == last:
            return np.zeros(len(texts), np.int64)
        begin = self.begins(np.frombuffer(data, np.uint8)[first:last])
        starts = ends[:-1] - first
        begin[starts[starts < last - first]] = True
        at = np.flatnonzero(begin).astype(np.int32)
        own = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, np.int32(last - first))), data.slice(first, last - first)).dictionary_encode()
        distinct = self._distinct(own.dictionary.to_pylist(), encode_bytes)
        return _summed(np.searchsorted(ends, at + first, "right") - 1, distinct[own.indices.to_numpy()], len(texts))

    def _distinct(self, parts: list[str], encode_bytes: int) -> np.ndarray:
        found = list(map(self.known.get, parts))
        new = [i for i, n in enumerate(found) if n is None]
        for i in new:
            found[i] = self.before.get(parts[i])
        ask = [i for i in new if found[i] is None]
        counted = [n for run in balanced([parts[i] for i in ask], encode_bytes) for n in self.count(run)]
        for i, n in zip(ask, counted, strict=True):
            found[i] = n
        for i in new:
            if len(parts[i]) <= SHORT:
                self.known[parts[i]] = found[i]
        if len(self.known) > REMEMBER:
            self.before, self.known = self.known, {}
        return np.array(found, np.int64)


def _json_tokenizer(path: str) -> Whole | Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    plain = not any(re.search(r"\s", t.content) or t.normalized or t.lstrip or t.rstrip or t.single_word for t in own.get_added_tokens_decoder().values())
    fixed = plain and parts["model"].get("dropout") is None
    unlimited = parts | {"truncation": None, "padding": None}
    begins = next((b for kind, b in _JSON_KINDS if fixed and all(unlimited.get(k) == v for k, v in kind.items())), None)

    def count(texts: list[str]) -> list[int]:
        return [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    return Pieces(count, begins) if begins else Whole(count)


def _model_splits(own) -> bool:
    """Whether a word's pieces are the same alone as after another word and a space."""
    apart = not any(re.search("[^▁]▁", own.id_to_piece(i)) for i in range(own.get_piece_size()))
    return apart and own.encode("a b") == own.encode("a") + own.encode("b")


def _model_tokenizer(path: str) -> Whole:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return Whole(lambda texts: [len(x) for x in own.encode(texts, add_bos=False, add_eos=False, num_threads=1)], _AT_SINGLE_SPACE if _model_splits(own) else None)


@functools.cache
def tokenizer(path: str) -> Whole | Pieces:
    """What counts the tokens of a file's tokenizer; a worker loads it once."""
    kinds = {".json": _json_tokenizer, ".model": _model_tokenizer}
    kind = os.path.splitext(path)[1]
    if kind not in kinds:
        raise ValueError(f"{path}: tokenizer files end with {' or '.join(kinds)}")
    return kinds[kind](path)


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of a text column; path: a tokenizer file that all workers can open."""
    prepare(docs.sparkSession)
    new_column(docs, into)

    @arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(tokenizer(path).lengths(texts), pa.int64())

    return docs.withColumn(into, n_tokens(text_or_empty(text_col)))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
