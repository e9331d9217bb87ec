"""Token ids in a binary file format of independent zstandard frames.

A file holds the ids of many documents in ascending order of their ids:

    header      8 bytes, MAGIC
    frames      zstandard frames, each the ids of whole documents (little-endian, 16 or 32 bits wide)
    seek table  one zstandard frame; for each frame its offset, size, CRC-32, documents and ids, then for each document
                its id, whether that is null, and its number of ids
    footer      offset, size and CRC-32 of the seek table, width of an id, MAGIC

A reader takes the footer, the table, and then only the frames that hold the documents asked for; checksums are
verified before a frame is decompressed. Documents are range-partitioned by id, one file a partition; a task writes
under a name of its own and then renames, so a task that is run again leaves one complete file. Files lie in the folder
given, by default in the shared folder of spark.checkpoint.dir.

Encoding splits a text before single spaces and looks units up among those already seen by the worker, which keeps one
tokenizer with its units (a bounded number) from task to task. Plain byte-level
BPE never merges across these places (checked for each text, else it is encoded whole), so ids equal those of the whole
text. With any other tokenizer (a normaliser, a prefix space, further pre-tokenisers, merges that work otherwise) texts
are always encoded whole.

Edge cases: ids are integers or cast to them. Null and empty text give the end id alone. Null ids come first; rows of equal id are ordered by text.
Repeated rows are repeated in the file. An empty table gives no file and no row. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_partitions, new_path, read, table

MAGIC = b"QTOKENS1"
MARKS = tuple(".,!?;:")
FOOTER, FOOTER_SIZE = "<QQIB8s", 29
FRAME = np.dtype([("offset", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("docs", "<u4"), ("ids", "<u8")])
DOC = np.dtype([("id", "<i8"), ("null", "<u1"), ("ids", "<u4")])


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) is byte-level BPE over the usual pattern and nothing else."""
    model = spec.get("model") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    pre = {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k != "trim_offsets"}
    return (
        pre == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and model.get("type") == "BPE"
        and not any(model.get(k) for k in odd) and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    )


class Encoder:
    """Text to bytes of little-endian ids, equal to tokenizer.encode(text, add_special_tokens=False)."""

    #: a space that isn't a boundary of its own, as it stands between or after other white space
    UNSAFE = re.compile(r"\s \s|\s \Z")

    def __init__(self, path: str, width: int, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.type, self.most = Tokenizer.from_file(path), f"<u{width}", most
        self.model, self.code = self.tokenizer.model, "H" if width == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = splits_at_spaces(json.loads(self.tokenizer.to_str()))
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in kept]
        self.symbols = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.seen: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def new_piece(self, text: str) -> bytes:
        tokens = self.model.tokenize(text.encode().decode("latin-1").translate(self.symbols))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of one piece of the pre-tokeniser's pattern."""
        found = self.known.get(text)
        if found is None:
            found = self.known[text] = self.new_piece(text)
        return found

    def unit(self, text: str) -> bytes:
        """Ids of text without a space in front."""
        if text.isalpha():  # letters are one piece
            return self.piece(text)
        return b"".join(map(self.piece, self.pieces.findall(text)))

    def spaced(self, text: str) -> bytes:
        """Ids of a space and text, kept in seen: with letters a space is one piece."""
        seen = self.seen
        found = seen.get(text)
        if found is None:
            if text.isalpha():
                found = self.new_piece(" " + text)
            elif text[-1:] in MARKS and text[:-1].isalpha():
                found = self.spaced(text[:-1]) + self.piece(text[-1])
            else:
                found = b"".join(map(self.piece, self.pieces.findall(" " + text)))
            seen[text] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not self.byte_level or self.UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *units = text.split(" ")
        seen = self.seen
        if len(seen) + len(self.known) > self.most:
            seen.clear()
            self.known.clear()
        for u in set(units).difference(seen):
            self.spaced(u)
        return self.unit(first) + b"".join(map(seen.__getitem__, units))


@functools.lru_cache(maxsize=1)
def _encoder(path: str, width: int, version: tuple[int, int]) -> Encoder:
    return Encoder(path, width)


def encoder(path: str, width: int) -> Encoder:
    """The worker's encoder for the tokenizer at path, as the file is now."""
    stat = os.stat(path)
    return _encoder(path, width, (stat.st_mtime_ns, stat.st_size))


class Writer:
    def __init__(self, out, width: int, frame_bytes: int) -> None:
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.at, self.frames, self.docs, self.open, self.open_docs, self.open_bytes = len(MAGIC), [], [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3)
        out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc or 0, doc is None, len(ids) // self.width))
        self.open.append(ids)
        self.open_docs, self.open_bytes = self.open_docs + 1, self.open_bytes + len(ids)
        if self.open_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            data = self.zstd.compress(b"".join(self.open))
            self.out.write(data)
            self.frames.append((self.at, len(data), zlib.crc32(data), self.open_docs, self.open_bytes // self.width))
            self.at, self.open, self.open_docs, self.open_bytes = self.at + len(data), [], 0, 0

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the file."""
        self.flush()
        frames, docs = np.array(self.frames, dtype=FRAME), np.array(self.docs, dtype=DOC)
        index = self.zstd.compress(struct.pack("<QQ", len(frames), len(docs)) + frames.tobytes() + docs.tobytes())
        self.out.write(index + struct.pack(FOOTER, self.at, len(index), zlib.crc32(index), self.width, MAGIC))
        return len(docs), int(docs["ids"].sum()), self.at + len(index) + FOOTER_SIZE


class Reader:
    """Random access to a file: documents are numbered in file order."""

    def __init__(self, file) -> None:
        self.file, end = file, file.size()
        at, size, crc, self.width, magic = struct.unpack(FOOTER, self.range(end - FOOTER_SIZE, FOOTER_SIZE))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = self.checked(at, size, crc)
        n_frames, n_docs = struct.unpack_from("<QQ", index)
        self.frames = np.frombuffer(index, FRAME, n_frames, 16)
        self.docs = np.frombuffer(index, DOC, n_docs, 16 + self.frames.nbytes)
        self.first = np.concatenate([[0], np.cumsum(self.frames["docs"], dtype=np.int64)])

    def range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def checked(self, at: int, size: int, crc: int) -> bytes:
        data = self.range(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"checksum mismatch at byte {at}")
        return zstandard.ZstdDecompressor().decompress(data)

    def frame(self, k: int) -> list[np.ndarray]:
        """Ids of each document of frame k."""
        f = self.frames[k]
        ids = np.frombuffer(self.checked(int(f["offset"]), int(f["size"]), int(f["crc"])), f"<u{self.width}")
        counts = self.docs["ids"][self.first[k] : self.first[k + 1]]
        return np.split(ids, np.cumsum(counts)[:-1])

    def document(self, n: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, n, side="right")) - 1
        return self.frame(k)[n - int(self.first[k])]


def _write(tokenizer: str, end_id: int, folder: str, width: int, frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, end = TaskContext.get().partitionId(), None, np.array([end_id], dtype=f"<u{width}").tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        path, own = f"{root}/{part:06d}.tok", f"{root}/_{part:06d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer, width)
        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(own)
                    writer = Writer(out, width, frame_bytes)
                writer.add(doc, (encode(text.as_py()) if text.is_valid else b"") + end)
        if writer:
            docs, ids, size = writer.close()
            out.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{part:06d}.tok"], "docs": [docs], "ids": [ids], "bytes": [size]}, schema=FILES)

    return run


FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None, files: int | None = None, frame_bytes: int = 1 << 18,
) -> DataFrame:
    """Encode and write all documents; one row per file written: part, file, docs, ids, bytes.

    tokenizer: path of a tokenizers JSON file, readable on the executors. files: how many at most, by default the
    number of shuffle partitions. A frame closes once it holds frame_bytes of ids.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files or n_partitions(spark), "id", "tie")
    rows = rows.sortWithinPartitions("id", "tie", "text").drop("tie")
    done = rows.mapInArrow(_write(tokenizer, end_id, folder, width, frame_bytes), "part int, file string, docs long, ids long, bytes long")
    return table(done, "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as f:
                reader = Reader(f)
                for k in range(len(reader.frames)):
                    parts = reader.frame(k)
                    docs = reader.docs[reader.first[k] : reader.first[k + 1]]
                    counts = docs["ids"].astype(np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs["id"], mask=docs["null"].astype(bool)),
                            pa.array(starts),
                            pa.array(counts),
                            pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()),
                        ],
                        ["id", "start", "n_tokens", "ids"],
                    )


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id_col, start (ids before it in all files), n_tokens and ids (32 bits each)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    files = files.repartition(n_partitions(files.sparkSession), "file")
    return files.mapInArrow(_read, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs, read the files back, and return doc_id, start, n_tokens and ids_crc32."""
    back = read_tokens(write_tokens(docs, tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
