"""SentencePiece encoding and decoding with a table of distinct chunks.

Merges join neighbouring characters that stand side by side in some piece. Where no piece holds another character before a
white-space marker, a text falls into marked words that are segmented apart. The vocabulary's other characters fall into
groups that no piece joins, too: in public_tokenizers' model letters on one side, punctuation on the other. A chunk is a
run of characters of the same side, with the markers before it, and a text's ids are its chunks' ids side by side. Each
distinct chunk of the corpus is segmented and decoded once:

1. Tasks cut texts into blocks of about `block_chars` characters. A block's distinct chunks are numbered and leave as rows
   (block, no, chunk). Its documents, as numbers of their marked words, and the chunks of each of these words go to two
   Parquet files in the shared folder.
2. The rows are shuffled and sorted by chunk. Equal chunks lie side by side, and the library segments and decodes the first.
   A chunk comes once per block, so no chunk, however frequent, holds more than a small share of the rows.
3. The rows go back to their blocks, where the numbers of each document are replaced, in place, by ids and decoded text.

Texts are read once and never shuffled; memory is bounded by the block, or one text where that is longer. Files of failed
attempts are never read, as a block's rows name the files that were written with them.

Edge cases: null and empty texts have the begin and end ids alone and decode to an empty text. Literal markers in a text
are what spaces become, as in the library. Repeated rows and null ids give a row each; an empty table gives none. Other
columns aren't read, so their names can't clash. Models with another normalisation, with pieces of the user's own, or with
pieces across markers are a ValueError, as chunks wouldn't be exact for them.
"""

from __future__ import annotations

import itertools
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, n_partitions, new_path, read, table

MARK = "▁"
WORD = re.compile(" +[^ ]*")
ROWS = pa.schema([("block", pa.int64()), ("no", pa.int32()), ("chunk", pa.string()), ("file", pa.string())])
FLUSH = 1 << 23


class Sides:
    """Which characters of a model's vocabulary no piece joins. ValueError if texts can't be cut at markers."""

    def __init__(self, model: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kind = spec.normalizer_spec, spec.SentencePiece
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        pieces = [p.piece for p in spec.pieces if p.type == kind.NORMAL]
        own = any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces)
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        if not plain or spec.trainer_spec.treat_whitespace_as_suffix or own or across:
            raise ValueError("the model's pieces depend on more than a marked word")
        group: dict[str, set[str]] = {}
        for piece in pieces:
            for a, b in itertools.pairwise(piece.lstrip(MARK)):
                one, two = group.setdefault(a, {a}), group.setdefault(b, {b})
                if one is not two:
                    one |= two
                    group.update(dict.fromkeys(two, one))
        main = max(group.values(), key=lambda g: (len(g), min(g)), default=set())
        other = sorted(set(group) - main)
        #: one of each side: put before a chunk without marker, it changes nothing in it
        self.main, self.other = min(main, default=""), min(other, default="")
        marks = "".join(map(re.escape, other))
        self.chunk = re.compile(f" *[{marks}]+| *[^ {marks}]+| +" if other else " *[^ ]+| +")
        self.is_other = re.compile(f"[{marks}]" if other else r"(?!)")


class Chunks:
    """Ids and decoded text of single chunks by the library."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model, self.sides = sentencepiece.SentencePieceProcessor(model_file=model), Sides(model)
        self.before = {c: len(self.model.encode(c)) for c in (self.sides.main, self.sides.other)}
        self.lone = self.model.encode("a ")[len(self.model.encode("a")) :]  # a marker without more, at a text's end

    def __call__(self, chunks: list[str]) -> tuple[list[list[int]], list[str]]:
        # the library puts the first marker before a text, and takes it off a decoded one
        front = ["" if c[0] == " " else self.sides.main if self.sides.is_other.match(c) else self.sides.other for c in chunks]
        coded = self.model.encode([c[1:] if not f else f + c for c, f in zip(chunks, front, strict=True)], num_threads=1) if chunks else []
        ids = [self.lone if c == " " else i[self.before[f] :] if f else i for c, f, i in zip(chunks, front, coded, strict=True)]
        decoded = self.model.decode(ids, num_threads=1) if ids else []
        return ids, [t if f else " " + t for f, t in zip(front, decoded, strict=True)]


def _lists(parts: list, kind) -> pa.LargeListArray:
    stops = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=stops[1:])
    values = np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return pa.LargeListArray.from_arrays(pa.array(stops), pa.array(values))


def _slices(column: pa.ChunkedArray) -> Iterator[list[int]]:
    """The lists of a column of number lists."""
    for part in column.chunks:
        values, stops = part.values.to_numpy(), part.offsets.to_numpy()
        for a, b in itertools.pairwise(stops):
            yield values[a:b].tolist()


def _cut(model: str, folder: str, block_chars: int):
    layout = {"compression": "zstd", "use_dictionary": False, "column_encoding": {"numbers.list.element": "BYTE_STREAM_SPLIT"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), Sides(model).chunk
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for k, rows in enumerate(blocks(batches)):
            words = defaultdict(itertools.count().__next__)
            found = []
            for text in rows["text"]:
                own = cut(text.replace(MARK, " ")) if text else ()
                found.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
            often = np.argsort(-np.bincount(np.concatenate(found), minlength=len(words)), kind="stable") if words else np.empty(0, np.int64)
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words))  # small numbers for frequent words, as they compress better
            chunks = defaultdict(itertools.count().__next__)
            own, units = list(words), []
            for i in often.tolist():
                w = own[i]
                units.append((chunks[" " + w],) if w.isalpha() and w.isascii() else tuple(map(chunks.__getitem__, chunk.findall(" " + w))))
            name = f"{part}-{k}-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{name}.docs") as out:
                pq.write_table(pa.table({"id": rows["id"], "numbers": _lists([rank[f] for f in found], np.uint32)}), out, **layout)
            with store.open_output_stream(f"{root}/{name}.words") as out:
                pq.write_table(pa.table({"numbers": _lists(units, np.uint32)}), out, **layout)
            block, size = part << 32 | k, len(chunks)
            yield pa.RecordBatch.from_pydict({"block": [block], "no": [-1], "chunk": [None], "file": [f"{folder}/{name}"]}, schema=ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)), pa.array(np.arange(size, dtype=np.int32)), pa.array(list(chunks), pa.string()), pa.nulls(size, pa.string())], schema=ROWS
            )

    def cut(text: str) -> list[str]:
        """Marked words without their first marker."""
        if text[0] == " " or "  " in text:
            return [w[1:] for w in WORD.findall(" " + text)]
        return text.split(" ")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, texts, held = [], [], 0
        for batch in batches:
            own = batch["text"].to_pylist()
            at = 0
            for i, text in enumerate(own):
                held += len(text or "")
                if held >= block_chars:
                    yield {"id": pa.concat_arrays([*ids, batch["id"].slice(at, i + 1 - at)]), "text": texts + own[at : i + 1]}
                    ids, texts, held, at = [], [], 0, i + 1
            ids.append(batch["id"].slice(at))
            texts += own[at:]
        if texts:
            yield {"id": pa.concat_arrays(ids), "text": texts}

    return run


CODED = pa.schema([("block", pa.int64()), ("no", pa.int32()), ("ids", pa.binary()), ("decoded", pa.string()), ("file", pa.string())])


def _segment(model: str, code: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, last = Chunks(model), None
        for batch in batches:
            equal = pc.run_end_encode(batch["chunk"])
            values = equal.values.to_pylist()
            known = [last] if last and values and values[0] == last[0] else []
            new = [c for c in values[len(known) :] if c is not None]
            coded = iter(zip(new, *chunks(new), strict=True))
            rows = known + [(c, i and array(code, i).tobytes(), t) for c, i, t in (next(coded) if c is not None else (None, None, None) for c in values[len(known) :])]
            last = rows[-1] if rows and rows[-1][0] is not None else last
            spread = pa.array(np.repeat(np.arange(len(rows)), np.diff(equal.run_ends.to_numpy(), prepend=0)))
            ids, decoded = (pa.array([r[k] for r in rows], kind).take(spread) for k, kind in ((1, pa.binary()), (2, pa.string())))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["no"], ids, decoded, batch["file"]], schema=CODED)

    return run


def _join(width: int, begin: int, end: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("ids", pa.binary()), ("decoded", pa.string())])

    def documents(file: str, ids: list[bytes], texts: list[str]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(f"{path}.words") as f:
            words = list(_slices(pq.read_table(f)["numbers"]))
        ids = [ids[w[0]] if len(w) == 1 else b"".join([ids[i] for i in w]) for w in words]
        texts = [texts[w[0]] if len(w) == 1 else "".join([texts[i] for i in w]) for w in words]
        with store.open_input_file(f"{path}.docs") as f:
            rows = pq.read_table(f)
        out, held = ([], [], []), 0
        first, last = (np.array([i], "<u4").tobytes() for i in (begin, end))
        for doc, numbers in zip(rows["id"], _slices(rows["numbers"]), strict=True):
            code = np.frombuffer(b"".join(map(ids.__getitem__, numbers)), f"<u{width}").astype("<u4").tobytes()
            text = "".join(map(texts.__getitem__, numbers))[1:]
            for a, v in zip(out, (doc, first + code + last, text), strict=True):
                a.append(v)
            held += len(code) + len(text)
            if held >= FLUSH:
                yield batch(out)
                out, held = ([], [], []), 0
        yield batch(out)

    def batch(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in out[0]], id_type), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, file, ids, texts = None, None, [], []
        for rows in batches:
            own = rows["block"].to_numpy()
            starts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
            for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
                if own[a] != block:
                    if file is not None:
                        yield from documents(file, ids, texts)
                    block, file, ids, texts = own[a], rows["file"][a].as_py(), [], []
                    a += 1  # the row that names the file comes first
                ids += rows["ids"].slice(a, b - a).to_pylist()
                texts += rows["decoded"].slice(a, b - a).to_pylist()
        if file is not None:
            yield from documents(file, ids, texts)

    return run


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 25) -> DataFrame:
    """(id_col, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers with begin and end, and their text.

    model: path of a SentencePiece model, readable on the executors.
    """
    import sentencepiece

    from pyspark.sql.pandas.types import to_arrow_type

    Sides(model)
    spark, library = docs.sparkSession, sentencepiece.SentencePieceProcessor(model_file=model)
    width, code = (2, "H") if library.get_piece_size() <= 1 << 16 else (4, "I")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = table(rows.mapInArrow(_cut(model, new_path(spark, "numbers"), block_chars), "block long, no int, chunk string, file string"), "chunks")
    n = n_partitions(spark)
    by_chunk = chunks.repartition(n, F.coalesce("chunk", F.col("block").cast("string"))).sortWithinPartitions("chunk")
    coded = table(by_chunk.mapInArrow(_segment(model, code), "block long, no int, ids binary, decoded string, file string"), "coded")
    drop_table(chunks)
    back = coded.repartition(n, "block").sortWithinPartitions("block", "no")
    join = _join(width, library.bos_id(), library.eos_id(), to_arrow_type(kind))
    return back.mapInArrow(join, f"id {kind.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
