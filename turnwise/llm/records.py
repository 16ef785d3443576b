"""Token ids as length-delimited binary records, with a separate offset index.

A data file is a run of frames.  A frame is the payload's length (unsigned 64 bits), the masked CRC-32C of those eight bytes,
the payload, and the masked CRC-32C of the payload, all little-endian: the framing of TFRecord files.  A payload is
the document id (signed 64 bits), one byte of flags (1: the id is null; 4: ids take four bytes, else two), and the ids.
The index beside it has, for each frame, its offset, the number of ids before it in the file and the number of its
ids, so a reader that shuffles can fetch any record with two reads.

``write_records`` range-partitions documents by (doc_id, text), one range for about ``docs_per_file`` documents at any size, so that
equal or null ids, however many, are split too; each range is sorted, encoded and written as one file, or several if it is
uneven.  It returns the list of files as a table.  ``read_records`` reads them back, checks every checksum and gives each
document the ids before it: the files' numbers of ids are summed up in two steps, and a file is one row, so the list never comes
to the driver.  A file is written under a name of its own attempt and then renamed, so a lost executor or a second attempt
leaves no half file.  The folder's file system can be any that pyarrow opens.

Defined results: null text counts as empty (just the end id); null doc_ids come first; rows with equal doc_ids keep
together, by a hash of the text; very long texts take memory in proportion to one Arrow batch; extra columns are not written; an empty table
gives no files and no rows.
"""

import io
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, new_path, open_uri, prepare, table, text_or_empty

DOCS_PER_FILE = 8192
END_ID = 2
#: Words, twice, and pieces that a worker remembers with their ids.
REMEMBER = 300_000
_HEAD = struct.Struct("<qB")
_INDEX = np.dtype([("offset", "<u8"), ("ids_before", "<u8"), ("n_ids", "<u4")])


# -- CRC-32C ---------------------------------------------------------------------------------------------------------
@cache
def _tables() -> tuple[np.ndarray, list[list[int]]]:
    """The byte table of the Castagnoli polynomial, and four tables that move a state over ``_CHUNK`` zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    shift = []
    for k in range(4):
        s = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_CHUNK):
            s = t[s & 255] ^ (s >> np.uint32(8))
        shift.append(s.tolist())
    return t, shift


_CHUNK = 256


def crc32c_many(payloads: list[bytes]) -> list[int]:
    """CRC-32C of many byte strings of at least four bytes each: chunks in step with numpy, then joined for each string."""
    if not payloads:
        return []
    t, (s0, s1, s2, s3) = _tables()
    counts = [-(-len(p) // _CHUNK) for p in payloads]
    # zeros in front of a string don't change a state of 0; the initial state is the inversion of the first four bytes
    padded = b"".join(b"\0" * (n * _CHUNK - len(p)) + bytes(b ^ 255 for b in p[:4]) + p[4:] for p, n in zip(payloads, counts, strict=True))
    columns = np.frombuffer(padded, np.uint8).reshape(-1, _CHUNK).T.copy()
    state = np.zeros(columns.shape[1], np.uint32)
    for c in columns:
        state = t[(state ^ c) & 255] ^ (state >> np.uint32(8))
    parts, out, at = state.tolist(), [], 0
    for n in counts:
        crc = 0
        for x in parts[at : at + n]:
            crc = s0[crc & 255] ^ s1[crc >> 8 & 255] ^ s2[crc >> 16 & 255] ^ s3[crc >> 24] ^ x
        at += n
        out.append(crc ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


# -- frames ----------------------------------------------------------------------------------------------------------
def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = zip(lengths, crc32c_many(lengths), payloads, crc32c_many(payloads), strict=True)
    return [b"".join((n, struct.pack("<I", masked(a)), p, struct.pack("<I", masked(b)))) for n, a, p, b in sums]


def read_frames(f, batch_bytes: int = 4 << 20) -> Iterator[list[bytes]]:
    """Payloads of a data file, some MB at a time, every checksum checked."""

    def checked(got):
        ok = crc32c_many([x[0] for x in got]), crc32c_many([x[2] for x in got])
        for (_, a, _, b), x, y in zip(got, *ok, strict=True):
            if struct.pack("<I", masked(x)) != a or struct.pack("<I", masked(y)) != b:
                raise ValueError("a record's checksum doesn't match")
        return [x[2] for x in got]

    got, size = [], 0
    while head := f.read(12):
        if len(head) < 12:
            raise ValueError("a record is cut off")
        n = struct.unpack("<Q", head[:8])[0]
        body = f.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("a record is cut off")
        got.append((head[:8], head[8:], body[:n], body[n:]))
        size += n
        if size >= batch_bytes:
            yield checked(got)
            got, size = [], 0
    if got:
        yield checked(got)


def read_record(data, index, i: int) -> bytes:
    """Record ``i`` through the index: for reading in shuffled order.  data, index: seekable binary files."""
    index.seek(i * _INDEX.itemsize)
    data.seek(int(np.frombuffer(index.read(_INDEX.itemsize), _INDEX)[0]["offset"]))
    head = data.read(12)
    n = struct.unpack("<Q", head[:8])[0]
    return next(read_frames(io.BytesIO(head + data.read(n + 4))))[0]


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.size and int(ids.max()) > 0xFFFF
    return _HEAD.pack(doc_id or 0, (doc_id is None) | 4 * bool(wide)) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _HEAD.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 4 else "<u2", offset=_HEAD.size).astype("<u4")


# -- encoding --------------------------------------------------------------------------------------------------------
#: Words of Latin-1 letters, digits and marks: they are composed already, and each character's lower case is its own affair.
_PLAIN = regex.compile(r"[\x21-\x7e\u00a1-\u00ff]+").fullmatch
#: The tokenizer file's own pattern (a fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


def _byte_letters() -> list[str]:
    """The visible letter for each byte in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: The parts of a tokenizer file (fixed values) for which words can be encoded one by one: white space is dropped before any merge,
#: and neither normalisation nor pattern joins what spaces, tabs and line ends separate.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


class WordEncoder:
    """The tokenizers library over whole texts, remembering words and pieces where the tokenizer file allows it.

    If the file is of the kind ``_BY_WORDS``, the ids of a text are those of its words one after another, and those of a word
    are the ids that the library's merges give for its pieces.  Words with other letters than Latin-1, and those that contain
    an added token's string, go through the library's whole path.  With any other file whole texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        added = self.own.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        plain = not any(regex.search(r"\s", t.content) or t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        self.by_words = plain and all(parts.get(k) == v for k, v in _BY_WORDS.items()) and parts["model"].get("dropout") is None
        self.kind = "<u4" if self.own.get_vocab_size() > 0xFFFF else "<u2"
        self.code = "I" if self.kind == "<u4" else "H"
        self.merge, self.letters = self.own.model.tokenize, _byte_letters()
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the words remembered before the last ``REMEMBER`` new ones
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        letters = self.letters  # visible ASCII stands for itself
        own = piece if piece.isascii() else "".join([letters[b] for b in piece.encode()])
        found = array(self.code, [t.id for t in self.merge(own)]).tobytes()
        if len(self.pieces) >= REMEMBER:
            self.pieces.clear()
        self.pieces[piece] = found
        return found

    def _whole(self, w: str) -> bytes:
        return np.array(self.own.encode(w, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, w: str) -> bytes:
        """Ids of a word that isn't remembered, or only from before."""
        found = self.words.get(w)
        if found is not None:
            return found
        found = self.before.get(w)
        if found is None:
            get = self.pieces.get
            if any(t in w for t in self.added):
                found = self._whole(w)
            elif w.isalpha() and (w.isascii() or max(w) < "\u0100"):  # most words: one piece
                low = w.lower()
                found = get(low) or self._piece(low)
            elif not w:
                found = b""
            elif w[-1] in ".," and w[:-1].isalpha() and max(w) < "\u0100":  # one piece and a mark
                low = w[:-1].lower()
                found = (get(low) or self._piece(low)) + (get(w[-1]) or self._piece(w[-1]))
            elif _PLAIN(w):
                found = b"".join([get(p) or self._piece(p) for p in _PIECES(w.lower())])
            else:
                found = self._whole(w)
        if len(self.words) >= REMEMBER:
            self.before, self.words = self.words, {}
        self.words[w] = found
        return found

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        end, out = np.array([end_id], self.kind).tobytes(), []
        if not self.by_words:
            return [np.array([*e.ids, end_id], self.kind) for e in self.own.encode_batch(texts, add_special_tokens=False)]
        for t in texts:
            ws = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            ids = list(map(self.words.get, ws))
            at = -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    ids[at] = self._word(ws[at])
            except ValueError:  # no further new word
                pass
            ids.append(end)
            out.append(np.frombuffer(b"".join(ids), self.kind))
        return out


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- writing and reading ---------------------------------------------------------------------------------------------
_WRITTEN = pa.schema([("range", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64())])
_FILES = "range int, number int, path string, n_records long, n_ids long"
#: Ranges whose numbers of ids are added up before the running sum over all files.
RANGES_ADDED = 1024


class _File:
    def __init__(self, folder: str, range_: int, number: int):
        self.fs, base = filesystem(folder)
        self.name = f"part-{range_:08d}-{number:06d}"
        self.final, own = f"{base}/{self.name}", f"{base}/_{self.name}-{os.urandom(8).hex()}"
        self.own, self.uri, self.range, self.number = own, f"{folder}/{self.name}", range_, number
        self.data, self.index = self.fs.open_output_stream(own + ".rec"), self.fs.open_output_stream(own + ".idx")
        self.offset = self.ids = self.records = 0

    def add(self, payloads: list[bytes], n_ids: list[int]) -> None:
        rows = np.zeros(len(payloads), _INDEX)
        for i, (f, n) in enumerate(zip(frames(payloads), n_ids, strict=True)):
            rows[i] = (self.offset, self.ids, n)
            self.data.write(f)
            self.offset += len(f)
            self.ids += n
        self.index.write(rows.tobytes())
        self.records += len(payloads)

    def close(self) -> dict:
        for f, kind in ((self.data, ".rec"), (self.index, ".idx")):
            f.close()
            self.fs.move(self.own + kind, self.final + kind)
        return {"range": self.range, "number": self.number, "path": self.uri, "n_records": self.records, "n_ids": self.ids}


def write_records(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = END_ID, docs_per_file: int = DOCS_PER_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id order; returns (range, number, path, n_records, n_ids), one row for each file."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    n = max(1, -(-docs.select(id_col).count() // docs_per_file))
    # ranges are cut at (id, hash of the text), so that many rows with one id are split; within a range they order equal ids
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, range_, out, done = encoder(tokenizer), TaskContext.get().partitionId(), None, []
        for b in batches:
            ids = own.encode(b.column(1).to_pylist(), end_id)
            if out is None or out.records >= 2 * docs_per_file:
                if out:
                    done.append(out.close())
                out = _File(folder, range_, len(done))
            out.add([pack(i, x) for i, x in zip(b.column(0).to_pylist(), ids, strict=True)], [len(x) for x in ids])
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist(done, schema=_WRITTEN)

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    return cut(dealt.mapInArrow(write, _FILES), "record-files")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_records(files: DataFrame) -> DataFrame:
    """Per record of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    some = F.floor(F.col("range") / RANGES_ADDED).alias("some")
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the one window without partitions has a row for each RANGES_ADDED ranges
    bases = files.groupBy(some).agg(F.sum("n_ids").alias("n_ids")).select("some", upto(Window.partitionBy(F.lit(0)).orderBy("some")).alias("base"))
    placed = files.withColumn("some", some).join(bases, "some").withColumn("start", F.col("base") + upto(Window.partitionBy("some").orderBy("range", "number")))
    n = max(1, files.count())
    listed = placed.select("range", "number", "path", "start").repartitionByRange(n, "range", "number").select("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_uri(path + ".rec") as f:
                    for payloads in read_frames(f):
                        out = []
                        for doc_id, ids in map(unpack, payloads):
                            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ.types, strict=True)], schema=_READ)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_binary_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_records(write_records(docs, new_path(spark, "records"), tokenizer=public_tokenizers.path("word_bpe_49k.json")))
