"""Token ids of whole texts, and the Arrow file format that holds them.

Encoding. The byte-level pre-tokenizer always cuts before the last white-space character
of a run, so what lies between such cuts can be encoded alone. A worker keeps the ids of
the pre-tokens it has met (up to ``CACHE``), each once, puts longer pieces together from
them and asks the tokenizers library only for the others; the ids are the library's own. With ``added``, a text that holds an added token's
content (``<|endoftext|>``) goes to the library whole, which finds it there by default;
without, such content is encoded as other text is.

Files. The ids of all documents in ascending order, each with the end id, are one
stream. Each range of documents is one Arrow file whose record batches hold fixed-size
lists: ``ids`` (the smallest unsigned type that holds the vocabulary) and ``mask``. All
sequences have one length, so sequence i of a file is row i % BATCH of batch i // BATCH,
and a memory map reads it without a copy. A second file lists the documents' places.
"""

from __future__ import annotations

import ctypes
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import qualified
from .common import scratch_path

CACHE = 300_000  # pre-tokens that a worker remembers
SEQUENCE, BATCH = 2048, 64
FILE_BYTES = 128 << 20  # of text a file

# Fixed value: the byte-level pre-tokenizer's published pattern.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = ".,;:!?|#$%&*"
SPACE = "\u0120"  # as a byte-level vocabulary writes it
BEGIN = "\x01"  # before a text's first part; texts that hold it take another way
LEADS = BEGIN + "\n"
_PIECE = re.compile(r"\s*\S+|\s+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python, not to the pre-tokenizer
_encoders: dict[tuple[str, bool], Encoder] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc's


def _byte_names() -> dict[int, int]:
    """The letters by which a byte-level vocabulary writes bytes: visible Latin-1 is itself, the others follow 255 in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


class _Pretokens(dict):
    """Ids of pre-tokens, from the library's model."""

    def __init__(self, model) -> None:
        self.model, self.names = model, _byte_names()

    def __missing__(self, token: str) -> bytes:
        word = token[1:]
        if token[0] == " " and word.isascii() and word.isalpha():
            named = SPACE + word
        else:
            named = token.encode().decode("latin-1").translate(self.names)
        ids = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
        if len(self) < CACHE:
            self[token] = ids
        return ids


class Encoder:
    """Ids of texts as unsigned 32-bit arrays; ``added``: added tokens are found in texts."""

    def __init__(self, path: str, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        contents = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(contents)).search if contents else None
        self.size = self.tokenizer.get_vocab_size()
        self.split = regex.compile(PRETOKEN).findall
        self.tokens = _Pretokens(self.tokenizer.model)

    def piece(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.split(text)))

    def part(self, part: str) -> bytes:
        """Ids of a part with its space, or of a text's first part; letters and common marks need no pattern."""
        lead, core = (part[0], part[1:]) if part[0] in LEADS else (" ", part)
        word = core.rstrip(MARKS)
        if not word.isalpha():
            return self.piece(core if lead == BEGIN else lead + core)
        ids = self.tokens[" " + word] if lead == " " else self.tokens[word]
        if lead == "\n":
            ids = self.tokens["\n"] + ids
        return ids + self.tokens[core[len(word) :]] if len(word) < len(core) else ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A batch's different parts are looked up once each."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        lines, at = [], []
        for i, text in enumerate(texts):
            line = text.replace("\n", " \n")
            if not text:
                continue
            if self.added and self.added(text):
                out[i] = self._whole(text)
                continue
            if line[0] == " " or line[-1] in " \n" or "  " in line or "\n " in line or not text.replace("\n", " ").isprintable():
                out[i] = self._apart(text)  # other white space, or some beside another
            else:
                lines.append(BEGIN + line)
                at.append(i)
        if not lines:
            return out
        parts = pc.split_pattern(pa.array(lines, pa.string()), " ")
        coded = parts.values.dictionary_encode()
        codes, raw, cuts = coded.indices.to_numpy(), list(map(self.part, coded.dictionary.to_pylist())), parts.offsets.to_pylist()
        for i, a, b in zip(at, cuts[:-1], cuts[1:], strict=True):
            out[i] = np.frombuffer(b"".join(map(raw.__getitem__, codes[a:b].tolist())), "<u4")
        return out

    def _apart(self, text: str) -> np.ndarray:
        if _SEPARATORS.search(text):
            return self._whole(text)
        return np.frombuffer(b"".join(map(self.piece, _PIECE.findall(text))), "<u4")

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder a worker, kept from task to task."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed batches: an executor's workers share what its JVM leaves."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def release() -> None:
    """Drop this worker's encoders and what is kept of freed batches: workers are used again, and other operators' tasks need the memory."""
    _encoders.clear()
    give_back()


def batches(rows: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that long texts do not add up."""
    for batch in rows:
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows <= 64 and column.nbytes <= most:
            yield batch
            continue
        at, held = 0, 0
        for i, size in enumerate(np.cumsum([len(x) if x.is_valid else 0 for x in map(_buffer, column)])):
            if size - held > most and i > at:
                yield batch.slice(at, i - at)
                at, held = i, size
        yield batch.slice(at)


class _buffer:
    """A text's bytes by length alone."""

    def __init__(self, scalar) -> None:
        self.is_valid, self._n = scalar.is_valid, len(scalar.as_buffer()) if scalar.is_valid else 0

    def __len__(self) -> int:
        return self._n


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


class _Writer:
    """Appends ids and cuts them into equal sequences; the last is padded and masked."""

    def __init__(self, stream, dtype: str, sequence: int) -> None:
        self.sequence, self.dtype, self.held, self.n = sequence, dtype, [], 0
        kind = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.kind, self.out = kind, pa.ipc.new_file(stream, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.sequence * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.sequence * BATCH
        whole = len(flat) // step * step
        for i in range(0, whole, step):
            self._batch(flat[i : i + step], step)
        if last and len(flat) > whole:
            self._batch(flat[whole:], len(flat) - whole)
            whole = len(flat)
        self.held, self.n = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        size = -(-len(ids) // self.sequence) * self.sequence
        full = np.zeros(size, self.dtype)
        full[: len(ids)] = ids
        mask = pa.array(np.arange(size) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (pa.array(full, self.kind), mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write_files(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, sequence: int = SEQUENCE, added: bool = False) -> DataFrame:
    """Write ``docs`` as files in ``folder`` in ascending doc_id order; a row for each file.

    Rows: part, path, n_docs, n_tokens. A null text gives the end id alone; null ids come
    first; rows that share an id keep their order by text. An empty table writes no file. A task that
    runs again replaces its own files. A text of any length is one document. Files are of
    about ``FILE_BYTES`` of text, at least as many as tasks run at once.
    """
    folder = qualified(docs.sparkSession, folder)  # the session's file system, whatever a machine's own is
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.select(F.sum(F.octet_length(F.col(text)) + 8).alias("n")).first().n or 0
    parts_ = max(-(-size // FILE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))), 1)
    rows = rows.repartitionByRange(parts_, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(parts):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, enc = task.partitionId(), encoder(tokenizer, added)
        dtype = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}"
        mine = f"{base}/.try-{part:06d}-{task.taskAttemptId()}"
        out, index, end, at, n = None, None, np.asarray([end_id], dtype), 0, 0
        for batch in batches(parts, most=6 << 20):
            if out is None:
                stream, listed = files.open_output_stream(mine + ".arrow"), files.open_output_stream(mine + ".idx")
                out = _Writer(stream, dtype, sequence)
                schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(listed, schema)
            sizes = []
            for ids in enc.encode([x or "" for x in batch.column(1).to_pylist()]):
                out.add(ids.astype(dtype))
                out.add(end)
                sizes.append(len(ids) + 1)
            sizes = np.asarray(sizes, np.int64)
            starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index.write_batch(pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes)], schema=schema))
            at, n = at + int(sizes.sum()), n + len(sizes)
        if out is not None:
            out.close()
            index.close()
            stream.close()
            listed.close()
            files.move(mine + ".arrow", name + ".arrow")
            files.move(mine + ".idx", name + ".idx")
            yield pa.record_batch([pa.array([part]), pa.array([f"{folder}/part-{part:06d}"]), pa.array([n]), pa.array([at])], names=["part", "path", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    listing = scratch_path(spark, "files")
    rows.mapInArrow(write, "part long, path string, n_docs long, n_tokens long").write.parquet(listing)
    return spark.read.parquet(listing)


class Reader:
    """Random access to one file's sequences: ``reader.sequence(i)`` and ``reader.span(start, n)``."""

    def __init__(self, path: str) -> None:
        files, base = _filesystem(path)
        local = _local(path)
        if base == local and os.path.exists(local + ".arrow"):
            self.source = pa.memory_map(local + ".arrow")
        else:
            self.source = files.open_input_file(base + ".arrow")
        self.file = pa.ipc.open_file(self.source)
        self.width = self.file.schema.field("ids").type.list_size
        self.held = (-1, None, None)
        self.index_of = lambda: pa.ipc.open_file(files.open_input_file(base + ".idx"))

    def _batch(self, i: int):
        if self.held[0] != i:
            batch = self.file.get_batch(i)
            self.held = (i, batch.column(0).flatten().to_numpy(), batch.column(1))
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence ``i``; the ids are not copied."""
        _, ids, mask = self._batch(i // BATCH)
        at = i % BATCH
        return ids[at * self.width : (at + 1) * self.width], np.asarray(mask[at].as_py(), bool)

    def span(self, start: int, n: int) -> np.ndarray:
        step, out = self.width * BATCH, []
        while n > 0:
            ids = self._batch(start // step)[1][start % step : start % step + n]
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_documents(files: DataFrame, reduce, schema: str) -> DataFrame:
    """Read the listed files back: ``reduce(ids)`` of each document, with doc_id, start and n_tokens.

    ``start`` counts the ids of all documents before it, in all files. The listing has one
    row a file, which is all that the running sum over files gathers.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("before", before).select("path", "before")

    def read(parts):
        for batch in parts:
            for path, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(path)
                index = reader.index_of()
                for k in range(index.num_record_batches):
                    ids, starts, sizes = index.get_batch(k).columns
                    got = [reduce(reader.span(s, n)) for s, n in zip(starts.to_pylist(), sizes.to_pylist(), strict=True)]
                    yield pa.record_batch([ids, pa.array(np.asarray(starts) + offset, pa.int64()), sizes, pa.array(got)], names=["doc_id", "start", "n_tokens", "value"])

    n = max(1, min(files.count(), 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartition(n, "path").mapInArrow(read, schema)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
