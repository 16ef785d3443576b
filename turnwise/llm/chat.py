"""Chat formatting at the level of tokens.

A turn becomes ``TURN role TEXT content END``: role and content are encoded on their own, without special tokens, and the three
reserved ids are spliced in around them.  Reserved ids lie beyond the vocabulary, so no content can produce them.  In
the text form the ids stand for the control strings below; where a control string (ours or a common template's) occurs in
a role or content, a backslash goes after its first character, and one more for each that is there already, so it can be
taken out again.  The loss mask of a conversation is the prefix sum of +1 where an assistant's content begins and -1 after its
END, so it covers the content and the END that the model has to learn; END carries no text.

Turns are encoded where they are; then conversations are put together in order, streaming: a conversation comes out in
pieces of up to ``PIECE`` tokens, so even one with a third of all turns takes bounded memory.

Defined results: null text and role count as empty; turns with equal numbers go by role and text; null turns come first; null
conv_id is a conversation of its own; repeated rows are turns of their own; other columns are not read; an empty table gives no rows.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import prepare, table

#: The template's control strings, in the order of their reserved ids, then control strings of common templates.
OWN = ["<|turn|>", "<|text|>", "<|end|>"]
OTHERS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>"]
PIECE = 1 << 20
ASSISTANT = "assistant"

_ANY = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in OWN + OTHERS))
_SOME = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in OWN + OTHERS))


def escape(s: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    return _SOME.sub(lambda m: m[0][0] + m[0][2:], s)


@cache
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_turn(own, role: str, text: str) -> tuple[list[int], int]:
    """Ids of a turn, and the number of ids before its content."""
    turn, sep, end = range(own.n_vocab, own.n_vocab + 3)
    head = [turn, *own.encode_ordinary(escape(role)), sep]
    return [*head, *own.encode_ordinary(escape(text)), end], len(head)


def _turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("head", T.IntegerType())])

    @pandas_udf(kind)
    def encode(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        own = tokenizer(path, pattern)
        return pd.DataFrame([encode_turn(own, r, t) for r, t in zip(roles, texts, strict=True)], columns=["ids", "head"])

    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = encode(role, text)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), x.alias("x"), text.alias("text")).select("conv_id", "turn", "role", "x.ids", "x.head", "text")


_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])


def format_chats(turns: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """(conv_id, piece, input_ids, loss_mask), a conversation's pieces one after another.  turns: conv_id, turn, role, text."""
    spark = turns.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _turns(turns, path, pattern).repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, piece, state, after = None, False, 0, 0, 0  # state: the mask so far; after: 1 if the next token ends a loss span
        ids: list[np.ndarray] = []
        steps: list[np.ndarray] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal piece, state
            if ids:
                mask = state + np.cumsum(np.concatenate(steps))
                state = int(mask[-1])
                rows.append((now, piece, np.concatenate(ids), mask))
                piece += 1
                ids.clear()
                steps.clear()

        def flush() -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32())
            flat = lambda i, t: np.concatenate([np.empty(0, t), *(r[i] for r in rows)]).astype(t)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(ends, flat(2, np.int32)), pa.ListArray.from_arrays(ends, flat(3, np.int8))]
            rows.clear()
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _PIECES.types, strict=True)], schema=_PIECES)

        held = 0
        for b in batches:
            lists = b.column(3)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (conv, role, head) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if not begun or conv != now:
                    close()
                    now, begun, piece, state, after = conv, True, 0, 0, 0
                own = flat[at[i] : at[i + 1]]
                step = np.zeros(len(own), np.int64)
                step[0] -= after
                if after := int(role == ASSISTANT):
                    step[head] += 1
                ids.append(own)
                steps.append(step)
                held += len(own)
                if held >= PIECE:
                    close()
                    held = 0
                    yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(assemble, "conv_id long, piece int, input_ids array<int>, loss_mask array<tinyint>")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    """Reads one conversation back from its ids and mask, turn by turn."""

    def __init__(self, own, conv):
        self.own, self.conv, self.first = own, conv, own.n_vocab
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = (np.empty(0, np.int32), np.empty(0, np.int8))

    def _text(self, ids: np.ndarray) -> str:
        s = self.own.decode_bytes(ids.tolist()).decode()
        self.chars += len(s)
        return unescape(s)

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        ids, mask = np.concatenate([self.rest[0], ids]), np.concatenate([self.rest[1], mask])
        start = 0
        for end in np.flatnonzero(ids == self.first + 2).tolist():
            turn, seen = ids[start : end + 1], mask[start : end + 1]
            sep = int(np.flatnonzero(turn == self.first + 1)[0])
            role, text = self._text(turn[1:sep]), self._text(turn[sep + 1 : -1])
            self.turns.update(f"{role}\n{text}\n".encode())
            learned = turn[(seen == 1) & (turn < self.first)]
            if len(learned):
                s = unescape(self.own.decode_bytes(learned.tolist()).decode())
                self.loss.update(s.encode())
                self.loss_chars += len(s)
            self.n_turns += 1
            self.chars += sum(map(len, OWN))
            start = end + 1
        self.rest = (ids[start:], mask[start:])

    def row(self) -> tuple:
        if len(self.rest[0]):
            raise ValueError("a conversation ends within a turn")
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_chats(formatted: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """Digests of formatted conversations, read back from ids and masks alone: ``_READ``'s columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, rows = tokenizer(path, pattern), None, []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], schema=_READ)
            rows.clear()
            return got

        for b in batches:
            for conv, piece, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if piece == 0:
                    if now:
                        rows.append(now.row())
                    now = _Reader(own, conv)
                now.add(ids.values.to_numpy(), mask.values.to_numpy())
                if len(rows) > 1000:
                    yield flush()
        if now:
            rows.append(now.row())
        yield flush()

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_text(ids: list[int], *, path: str, pattern: str) -> str:
    """The text form of formatted ids."""
    own = tokenizer(path, pattern)
    out, part = [], []
    for i in ids:
        if i < own.n_vocab:
            part.append(i)
        else:
            out += [own.decode_bytes(part).decode(), OWN[i - own.n_vocab]]
            part = []
    return "".join([*out, own.decode_bytes(part).decode()])


#: The conversation that op6 adds to the table.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, ASSISTANT, "</s>[INST] ok [/INST]")]


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    path, pattern = default_tokenizer()
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    return read_chats(format_chats(turns, path=path, pattern=pattern), path=path, pattern=pattern)


OP6_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
         len(regexp_replace(regexp_replace(role || chr(1) || text, '(<)(\\*)(s>|/s>|<SYS>>|</SYS>>|\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>)', '\1\\\2\3', 'g'),
                            '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')) - 1 AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(len(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(n + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
