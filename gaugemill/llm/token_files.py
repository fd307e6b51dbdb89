"""Token ids of a corpus as Simple-8b files, and the way back.

A file holds the ids of a run of documents, one after another: blocks of ``BLOCK`` ids (the last may have
fewer), each beginning at a word of its own, then a footer with the word at which each block begins and the
id and length of each document. The last 40 bytes say how many of all these there are.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, settle, table
from .simple8b import decode_blocks, encode_blocks
from .textops import slices

BLOCK = 4096
#: Blocks that are coded, written and read at once; ids or documents after which a file ends.
RUN_BLOCKS, FILE_IDS, FILE_DOCS = 256, 1 << 26, 1 << 20
#: Pieces of text whose ids a Python worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 1 << 19, 64
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
#: What a plain piece does not hold: bytes that are none of the above, and all but the composed letters of Latin-1.
ODD = re.compile(rb"[\x00-\x20'|\x7f]|\xc3[\x97\xb7]|(?<!\xc3)[\x80-\xff](?<!\xc3)")
MAGIC = b"GMS8B001"
_TAIL = struct.Struct("<QQQQ8s")  # ids, blocks, words, documents, magic
FILES = "file string, n_ids long, n_docs long"
DOCUMENTS = "file string, place long, doc_id long, n_tokens long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _kinds() -> np.ndarray:
    """White space, letters, digits, punctuation and all that is none of them, for each byte. An apostrophe can begin
    a word of its own and a bar stands in special tokens, so both are none of them."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = MARK
    for of, kind in ((b" \t\n\v\f\r", SPACE), (b"0123456789", DIGIT), (bytes(range(65, 91)) + bytes(range(97, 123)), LETTER), (b"'|", OTHER)):
        kinds[list(of)] = kind
    return kinds


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of many texts, one after another, and how many each text has.

    A run without white space is cut into words of letters (ASCII and the composed ones of Latin-1, in lower
    case), single digits and runs of punctuation. A run that holds any other character is one piece as it is.
    """
    kind = _kinds()[data]
    lead = np.flatnonzero(data == 0xC3)  # of U+00C0 to U+00FF
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead], kind[lead + 1] = LETTER, LETTER
    solid = kind != SPACE
    cut = np.ones(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    upper = (data >= 65) & (data <= 90)
    upper[lead + 1] = data[lead + 1] < 0x9F
    odd = np.flatnonzero(kind == OTHER)
    if len(odd):  # the whole run around each
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] |= solid[offsets[:-1][offsets[:-1] < len(data)]]
        begins = np.flatnonzero(begins)
        run = np.unique(np.searchsorted(begins, odd, "right") - 1)
        limit = np.append(begins, len(data))[run + 1]
        for a, b in zip(begins[run].tolist(), limit.tolist(), strict=True):
            cut[a + 1 : b] = False
            upper[a:b] = False
    cut &= solid
    low = (data + (upper.astype(np.uint8) << 5))[solid]
    at = np.flatnonzero(cut[solid])
    edges = np.append(at, len(low)).astype(np.int64)
    per_text = np.diff(np.searchsorted(np.flatnonzero(cut), offsets))
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(low)]), per_text


class Encoder:
    """Ids of whole texts by a tokenizers file that cuts at white space and drops it.

    Such a text has the ids of its ``pieces``, one after another, so every distinct piece of many texts goes
    through the library once, and a bounded number is remembered. Words, digits and punctuation go to the
    library's model at once; other pieces go through its whole chain, and so does all between white space if the
    file gives a few words other ids than the plain way does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.model, shown = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7)]
        self.shown = str.maketrans({c: shown.pre_tokenize_str(c)[0][0] for c in letters})
        tried = [*letters, *(f"{a}{c}{b}" for c in letters for a, b in (("Pre", "end."), ("", "s,"))), "A", "Words", "stra\u00dfe", "end.)", "x", "Why?!", "a1b23.4,", "A-B_c"]
        self.plain = True
        self.plain = self(pa.array(tried))[0].tobytes() == b"".join(self._whole([x.encode() for x in tried]))
        self.known, self.older = {}, {}

    def _whole(self, pieces: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False)] if pieces else []

    def _model(self, piece: bytes) -> bytes:
        word = piece.decode()
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, piece: bytes, ids: bytes) -> None:
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:  # what was not asked for since the last time is forgotten
                self.known, self.older = {}, self.known
            self.known[piece] = ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a null has none) and how many each has."""
        if self.plain:
            _, _, data, offsets = next(slices(texts, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
            found, per_text = pieces(data, offsets)
        else:
            split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
            found, per_text = split.flatten().cast(pa.large_binary()), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = found.dictionary_encode()
        piece, distinct, rows, odd, known, older = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), [], [], self.known.get, self.older.get
        kinds = _kinds()
        for k, x in enumerate(distinct):
            ids = known(x)
            if ids is None:
                if (ids := older(x)) is None:
                    if self.plain and (x[0] < 128 and kinds[x[0]] != OTHER or x[0] == 0xC3) and not ODD.search(x):
                        ids = self._model(x)
                    else:
                        odd.append(k)
                if ids is not None:
                    self._remember(x, ids)
                    known, older = self.known.get, self.older.get
            rows.append(ids)
        for k, ids in zip(odd, self._whole([distinct[k] for k in odd]), strict=True):
            rows[k] = ids
            self._remember(distinct[k], ids)
        flat, size = np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        n = size[piece]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[piece] - (ends - n), n) + np.arange(int(n.sum()))]
        return ids, np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """One file, written in runs of blocks as ids come; what it holds at once is a run and the footer."""

    def __init__(self, out):
        self.out, self.held, self.n_held, self.n_words = out, [], 0, 0
        self.starts, self.docs, self.n_ids = [], [], 0
        self.crc = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += zip(doc_ids, counts.tolist(), strict=True)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK * RUN_BLOCKS:
            self._write(self.n_held // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, n, BLOCK * RUN_BLOCKS):
            words, n_words = encode_blocks(ids[at : min(n, at + BLOCK * RUN_BLOCKS)], BLOCK)
            self._put(words.astype("<u8").tobytes())
            self.starts.append(self.n_words + np.cumsum(n_words) - n_words)
            self.n_words += len(words)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def _put(self, raw: bytes) -> None:
        self.crc = zlib.crc32(raw, self.crc)
        self.out.write(raw)

    def close(self) -> None:
        self._write(self.n_held)
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)])
        self._put(starts.astype("<u8").tobytes())
        self._put(np.array([i or 0 for i, _ in self.docs], "<i8").tobytes())
        self._put(np.array([i is None for i, _ in self.docs], np.uint8).tobytes())
        self._put(np.array([n for _, n in self.docs], "<u8").tobytes())
        self._put(_TAIL.pack(self.n_ids, len(starts), self.n_words, len(self.docs), MAGIC))


class Reader:
    """An open random-access file: its footer at once, its ids in runs of blocks from any block on."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.n_ids, self.n_blocks, self.n_words, self.n_docs, magic = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        footer, b, d = self._at(8 * self.n_words, 8 * self.n_blocks + 17 * self.n_docs), 8 * self.n_blocks, self.n_docs
        self.starts = np.append(np.frombuffer(footer[:b], "<u8").astype(np.int64), self.n_words)
        ids, null = np.frombuffer(footer[b : b + 8 * d], "<i8"), np.frombuffer(footer[b + 8 * d : b + 9 * d], np.uint8)
        self.doc_ids = pa.array(ids, pa.int64(), mask=null.astype(bool))
        self.counts = np.frombuffer(footer[b + 9 * d :], "<u8").astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids of the blocks from ``first`` up to ``end``."""
        words = np.frombuffer(self._at(8 * self.starts[first], 8 * int(self.starts[end] - self.starts[first])), "<u8")
        n = np.minimum(BLOCK, self.n_ids - BLOCK * np.arange(first, end))
        return decode_blocks(words, np.diff(self.starts[first : end + 1]), n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the document at place ``k``, from the blocks that hold them alone."""
        start, n = int(self.counts[:k].sum()), int(self.counts[k])
        return self.ids(start // BLOCK, -(-(start + n) // BLOCK))[start % BLOCK :][:n] if n else np.zeros(0, np.uint64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents to files under ``path``, a folder that all executors reach, and returns one row a
    file, materialised: ``file, n_ids, n_docs``; the order of names is the order of ids.

    Texts are range-partitioned and sorted by ``id_col`` (nulls first; rows that repeat an id by CRC-32 of the
    text), then encoded where they lie: each task writes its documents to one file, or to several of
    about ``FILE_IDS`` ids or ``FILE_DOCS`` documents, and a file appears by one rename, so a repeated task leaves only whole files,
    of which the returned rows name one for each. Null and empty texts have ``end_id`` alone (no id if
    that is None). A very long text is encoded in one task. Other columns are ignored, whatever their
    names. An empty table gives no files.
    """
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")))]

    def run(batches):
        from pyarrow import fs

        to, root = fs.FileSystem.from_uri(path)
        to.create_dir(root, recursive=True)
        part, tail, encode = TaskContext.get().partitionId(), [] if end_id is None else [end_id], encoder(tokenizer)
        writer, tmp, k = None, "", 0

        def ended():
            nonlocal writer, k
            writer.close()
            writer.out.close()
            name = f"{root}/ids-{part:07d}-{k:05d}-{writer.crc:08x}.s8b"
            to.move(tmp, name)
            row, writer, k = (name, writer.n_ids, len(writer.docs)), None, k + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in FILES.split(", ")])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, _, _ in slices(batch.column(1), 1 << 22):
                if writer is None:
                    tmp = f"{root}/.{uuid.uuid4().hex}"
                    writer = Writer(to.open_output_stream(tmp))
                ids, counts = encode(batch.column(1).slice(i, j - i))
                if tail:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                writer.add(doc_ids[i:j], ids, counts)
                if writer.n_ids >= FILE_IDS or len(writer.docs) >= FILE_DOCS:
                    yield ended()
        if writer is not None:
            yield ended()

    return settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, FILES))


def read_tokens(files: DataFrame, path: str) -> DataFrame:
    """Documents as the files that ``files`` names hold them: ``file, place`` (in the file, from 0), ``doc_id,
    n_tokens, ids_crc32`` (of the ids as little-endian unsigned 32-bit integers). A task reads a file in runs of blocks."""

    def read(batches):
        from pyarrow import fs

        there, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with there.open_input_file(name) as file:
                    yield from _documents(name, Reader(file))

    # Few rows beside what they stand for: a task for each file.
    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(read, DOCUMENTS)


def _documents(name: str, r: Reader):
    crc, done, at, left = 0, [], 0, r.counts.tolist()
    for first in range(0, max(1, r.n_blocks), RUN_BLOCKS):
        raw = r.ids(first, min(r.n_blocks, first + RUN_BLOCKS)).astype("<u4").tobytes() if r.n_blocks else b""
        seen, last = 0, first + RUN_BLOCKS >= r.n_blocks
        while at < r.n_docs and (seen < len(raw) or left[at] == 0):
            n = min(4 * left[at], len(raw) - seen)
            crc = zlib.crc32(raw[seen : seen + n], crc)
            seen += n
            left[at] -= n // 4
            if left[at] == 0:
                done.append(crc)
                crc, at = 0, at + 1
        if last and at < r.n_docs:
            raise ValueError(f"{name}: ids end before its documents do")
        if done:
            lo = at - len(done)
            columns = [pa.array([name] * len(done)), pa.array(range(lo, at), pa.int64()), r.doc_ids.slice(lo, at - lo), pa.array(r.counts[lo:at]), pa.array(done, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DOCUMENTS.split(", ")])
            done = []


def with_starts(read: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before each, from one total for each file and a running sum inside it.

    The totals are broadcast, a row for each file: what ``read`` reads from as few rows would else be taken for small and
    gathered by the driver, with a row for each document."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    totals = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_ids_before"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return read.join(F.broadcast(totals), "file").select(*read.columns, (F.col("_ids_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def op12_token_files(spark, sf_dir):
    """All documents with the end id 2, as read back from the files."""
    path = fresh_path(spark, "ids")
    files = write_tokens(table(spark, sf_dir, "documents"), path)
    return with_starts(read_tokens(files, path), files).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op12_token_files": op12_token_files}
SQL: dict[str, str] = {}
