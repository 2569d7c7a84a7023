"""Token ids of whole texts, and flat binary token files.

``encode`` gives the ids that the tokenizers library gives for the text. Texts of plain Latin
characters are cut by the tokenizer's own split pattern and each distinct piece is encoded by
the library once (a piece's ids do not depend on its neighbours); other texts, and those
that hold a special token, go to the library whole.

File format of ``write_files``: ``tokens-<part>.bin`` holds unsigned little-endian ids (16 bits
if the vocabulary has at most 65,536 ids, else 32) of the part's documents one after the
other, in ascending doc_id order within and across parts; ``offsets-<part>.bin`` holds
one more signed 64-bit little-endian number than documents, the place of each document's
first id in the part and then the part's length; ``ids-<part>.bin`` their doc_ids, 64-bit.
A part's base, the number of ids before it, is the prefix sum over the parts before it.

Defined cases: a null text is empty, so only the end id is written; rows that repeat an id
follow each other; rows with a null id come first; further columns are ignored; an empty
table makes no files and an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankline.llm.common import table, work_folder

END_ID = 2
CACHE_PIECES = 400_000  # pieces kept by a worker, about 300 bytes each; further ones are encoded each time
IDLE_PIECES = 100_000  # of these, kept when a task ends: the first ones, which are mostly the frequent ones
PART_BYTES = 256 << 20  # text of a part, about
ROWS = 8192  # documents of a batch read back

# The split pattern of the byte-level BPE, for texts of the plain characters below only.
PIECE = re.compile(r"'(?:[std]|re|ve|m|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xc0-ɏ]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """Ids by piece, straight from the library's model: a piece needs no cutting."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(1 << 16)]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        others = [b for b in range(256) if b not in shown]
        self.form = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        found = self.tokenize(piece.encode().decode("latin-1").translate(self.form))
        ids = b"".join([self.raw[t.id] for t in found])
        if len(self) < CACHE_PIECES:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit numbers; one per worker and file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        state = self.tok.pre_tokenizer.__getstate__().decode() if self.tok.pre_tokenizer else ""
        self.cuts = (self.tok.normalizer is None and self.tok.get_vocab_size() <= 1 << 16
                     and all(x in state for x in ('"ByteLevel"', '"use_regex":true', '"add_prefix_space":false')))
        self.pieces = Pieces(self.tok.model)

    def __call__(self, text: str) -> bytes:
        if not self.cuts or NOT_PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))


    def rest(self) -> None:
        """Called at the end of a task: a worker that waits keeps few pieces."""
        for piece in list(self.pieces)[IDLE_PIECES:]:
            del self.pieces[piece]


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path or tokenizer_path())


def encoded(texts: pa.Array, path: str | None = None, end_id: int = END_ID) -> Iterator[bytes]:
    """The ids of each text (null: empty) and the end id, as 32-bit little-endian numbers."""
    encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
    for t in texts:
        yield encode(t.as_py() or "") + end


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, vocabulary: int = 50_257) -> DataFrame:
    """Writes ``docs`` (doc_id, text) in ``folder``, a shared one; a row per part: part,
    name, n_docs, n_tokens, base. A part's files appear under a name of the attempt that wrote
    them, which the manifest carries, so a repeated task never leaves a part half written."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        n_docs, last = 0, 0
        with (fs.open_output_stream(f"{at}/tokens-{name}.bin") as tokens, fs.open_output_stream(f"{at}/offsets-{name}.bin") as offsets,
              fs.open_output_stream(f"{at}/ids-{name}.bin") as ids):
            offsets.write(np.array([0], dtype="<i8").tobytes())
            for b in batches:
                ids.write(b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                ends = np.empty(b.num_rows, dtype="<i8")
                for i, raw in enumerate(encoded(b.column(1), path, end_id)):
                    tokens.write(np.frombuffer(raw, dtype="<u4").astype(kind).tobytes())
                    last += len(raw) // 4
                    ends[i] = last
                offsets.write(ends.tobytes())
                n_docs += b.num_rows
        encoder(path).rest()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_tokens": last}], schema=pa.schema([
                ("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    order = ["doc_id", F.xxhash64("text")]  # rows that share an id, or have none, are spread by their texts
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = table(ordered.mapInArrow(run, "part int, name string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_files(manifest: DataFrame, folder: str, vocabulary: int = 50_257) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Local files are
    memory-mapped; others are read by ranges."""
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)

        def source(what: str, row: dict) -> pa.NativeFile:
            file = f"{at}/{what}-{row['name']}.bin"
            return pa.memory_map(file) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(file)

        def numbers(file: pa.NativeFile, lo: int, hi: int, kind: np.dtype) -> np.ndarray:
            file.seek(lo * kind.itemsize)
            return np.frombuffer(file.read_buffer((hi - lo) * kind.itemsize), dtype=kind)

        long = np.dtype("<i8")
        for b in batches:
            for row in b.to_pylist():
                with source("offsets", row) as at_offsets, source("ids", row) as at_ids, source("tokens", row) as at_tokens:
                    for lo in range(0, row["n_docs"], ROWS):
                        hi = min(lo + ROWS, row["n_docs"])
                        offsets, ids = numbers(at_offsets, lo, hi + 1, long), numbers(at_ids, lo, hi, long)
                        crc = np.array([zlib.crc32(numbers(at_tokens, x, y, kind).astype("<u4").tobytes())
                                        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids, mask=ids == np.iinfo(np.int64).min), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crc),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number of partitions that is given is kept: as many tasks as parts read
    some = manifest.select("part", "name", "base", "n_docs").repartitionByRange(max(1, manifest.count()), "part")
    return some.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the token files of ``docs`` into a new shared folder and reads them back."""
    folder = work_folder(docs.sparkSession)
    return read_files(write_files(docs, folder), folder)
