"""Token ids in a compact binary format: canonical length-limited Huffman codes from the corpus's own counts.

Format, a folder with two tables, which any Spark reader opens and whose writing Spark's commit protocol protects:
`codes` (id, length): the code lengths, from which the canonical codes follow;
`blocks` (part, block, doc_ids, counts, n_tokens, checkpoints, payload): whole documents in order of (part, block); counts are the
documents' ids as uint32, checkpoints the bit offsets of every 128th id as uint32, payload the bits. A block is decoded on its own, and
each stretch after a checkpoint too. All numbers are little-endian.

Ids come from the tokenizers library. It cuts a text into pieces by a pattern first and merges within pieces only, so its model merges each
new piece once and the ids are kept in a bounded memory for the next time; whole texts take it over twice as long. With added=True, as the
query and the pipeline have it, texts that contain an added token's content go to the library whole, so ids are those of its default settings.

Defined results. A null text is an empty one: only the end id. Documents are in ascending order of doc_id, null doc_ids first, ties in the
order of their texts' hash. Repeated rows come out repeatedly. An empty table gives an empty one. One document lies in one
block; a block of over 512 MB of bits, more than a checkpoint can tell, raises an error. A doc_id that isn't an integer raises one too.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from string import punctuation as MARKS

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webextract.llm.common import Workspace, return_memory, text_of
from webextract.llm.huffman import Coder, code_lengths

BLOCK_IDS = 1 << 18
#: Words that an encoder remembers; about 150 bytes each. When there are more, those of up to SHORT characters stay, the commoner ones.
MEMORY, SHORT = 400_000, 8
#: Of these so many at most stay with a worker between its tasks.
KEPT = 100_000


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class PieceEncoder(dict):
    """Ids of texts by pieces. pattern: what the tokenizer's own pre-tokenizer, a byte-level one, cuts by. added: the contents of
    added tokens in a text are these tokens, else ordinary text.

    It is itself the memory: packed ids of words, which stand without the space before them; a new one is merged when it is looked up."""

    def __init__(self, path: str, pattern: str, added: bool = False) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cut = regex.compile(pattern).findall
        self.merge, self.letters, self.kind = self.tokenizer.model.tokenize, byte_letters(), "H" if self.type.itemsize == 2 else "I"
        self.space = self.letters[32]
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) if added else ()
        #: Of pieces that no space begins: words that begin a line, marks, white space.
        self.pieces: dict[str, bytes] = {}
        #: Whether a word was looked up that doesn't begin a piece.
        self.loose = False

    def merged(self, piece: str) -> bytes:
        """ASCII letters and marks are written as they are, so only others need the byte letters."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif " " in piece:
            piece = piece.replace(" ", self.space)
        return array(self.kind, [t.id for t in self.merge(piece)]).tobytes()

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.merged(piece)
            if len(piece) <= SHORT and len(self.pieces) < MEMORY // 10:
                self.pieces[piece] = got
        return got

    def __missing__(self, word: str) -> bytes:
        """What follows a space up to the next one. Letters are one piece with that space; the marks behind them are another one."""
        if word.isalpha():
            got = self.merged(" " + word)
        elif not word or word[0].isspace():
            self.loose = True  # what the space belongs to depends on what follows; not remembered
            return b""
        else:
            core = word.rstrip(MARKS)
            if core.isalpha():
                got = self[core] + self.piece(word[len(core) :])
            else:
                got = b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.piece(p) for p in self.cut(" " + word)])
        self[word] = got
        return got

    def by_pieces(self, text: str) -> bytes:
        return b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.piece(p) for p in self.cut(text)])

    def by_words(self, text: str) -> bytes:
        """The pattern always cuts before a space that a word follows, so a line without other spaces is its words with the spaces before
        them; and around a line break that has no other white space on either side."""
        lines = text.split("\n")
        if len(lines) > 1 and (any(not x or x[-1].isspace() for x in lines[:-1]) or any(x[:1].isspace() for x in lines[1:])):
            return self.by_pieces(text)
        out, at = [], self.__getitem__
        for line in lines:
            first, *words = line.split(" ")
            out.append((self.piece if first.isalpha() else self.by_pieces)(first) + b"".join(map(at, words)))
        if self.loose:
            self.loose = False
            return self.by_pieces(text)
        return out[0] if len(out) == 1 else self.piece("\n").join(out)

    def forget(self, most: int) -> None:
        """With more words than that, keeps half as many at most: of those of up to SHORT characters, the commoner ones, what came first."""
        if len(self) > most:
            kept = list(islice(((w, x) for w, x in self.items() if len(w) <= SHORT), most // 2))
            self.clear()
            self.update(kept)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out = []
        for text in texts:
            self.forget(MEMORY)
            if self.added and any(a in text for a in self.added):
                out.append(array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(self.by_words(text))
        return out


_ENCODERS: dict[tuple[str, str, bool], PieceEncoder] = {}


def _encoder(path: str, pattern: str, added: bool) -> PieceEncoder:
    if (path, pattern, added) not in _ENCODERS:
        _ENCODERS[path, pattern, added] = PieceEncoder(path, pattern, added)
    return _ENCODERS[path, pattern, added]


def id_blocks(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, order: list[Column], added: bool) -> DataFrame:
    """part, block, doc_ids, counts, ids: whole documents in the order given, a part for each partition; its block -1 has, as counts, how
    often each id of the vocabulary occurs in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"doc_id is an integer, not {kind}")
    source = docs.select("doc_id", text_of(docs).alias("text"), *(c.alias(f"o{i}") for i, c in enumerate(order)))
    by = [*(F.col(f"o{i}").asc_nulls_first() for i in range(len(order))), F.xxhash64("text")]
    dealt = source.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return_memory()
        encoder, part, block = _encoder(tokenizer, pattern, added), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=encoder.type).tobytes()
        ids: list = []
        packed: list[bytes] = []
        size = 0

        total = np.zeros(max(encoder.size, end_id + 1), dtype=np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, packed, size
            whole = b"".join(packed)
            total[:] += np.bincount(np.frombuffer(whole, encoder.type), minlength=len(total))
            counts = np.array([len(x) // encoder.type.itemsize for x in packed], dtype="<u4").tobytes()
            out = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts]), pa.array([whole], pa.binary())]
            block, ids, packed, size = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays(out, names=["part", "block", "doc_ids", "counts", "ids"])

        for batch in batches:
            for i in range(0, len(batch), 200):
                piece = batch.slice(i, 200)
                for doc_id, got in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    ids.append(doc_id)
                    packed.append(got + end)
                    size += len(packed[-1])
                    if size >= BLOCK_IDS * encoder.type.itemsize:
                        yield flush()
        if ids:
            yield flush()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([total.tobytes()]), pa.array([None], pa.binary())], names=["part", "block", "doc_ids", "counts", "ids"])
        # The worker serves other operators next.
        encoder.forget(KEPT)
        return_memory()

    return dealt.mapInArrow(run, "part int, block int, doc_ids array<bigint>, counts binary, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 2, order: list[Column] | None = None, added: bool = False) -> None:
    """Encodes docs (doc_id, text) and writes the format to `path`; by default in ascending order of doc_id."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    encoder = _encoder(tokenizer, pattern, added)
    kind, most = encoder.type.str, max(encoder.size, end_id + 1)
    saved = space.save(id_blocks(docs, tokenizer, pattern, end_id, order or [F.col("doc_id")], added), "ids", "snappy")
    plain = saved.where("block >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    # At most one row for each id of the vocabulary.
    rows = saved.where("block = -1").select("counts").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(most, dtype=np.int64)
    counts[np.array(rows.column("id"))] = np.array(rows.column("n"))
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                ids = np.frombuffer(row.column("ids")[0].as_py(), kind)
                payload, checkpoints = coder.encode(ids)
                if len(payload) >= 1 << 29:
                    raise ValueError("a block has more bits than a checkpoint can tell")
                out = [*row.columns[:-1], pa.array([len(ids)], pa.int64()), pa.array([checkpoints.astype("<u4").tobytes()]), pa.array([payload])]
                yield pa.RecordBatch.from_arrays(out, names=["part", "block", "doc_ids", "counts", "n_tokens", "checkpoints", "payload"])

    schema = "part int, block int, doc_ids array<bigint>, counts binary, n_tokens bigint, checkpoints binary, payload binary"
    plain.mapInArrow(encode, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    space.drop()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Reads the format back: part, block, at (in the block), doc_id, start (ids of all documents before), n_tokens, ids_crc32, in no order."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    ids, found = np.array(codes.column("id"), dtype=int), np.array(codes.column("length"))
    lengths = np.zeros(ids.max(initial=-1) + 1, dtype=np.uint8)
    lengths[ids] = found
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for b in batches:
            for row in b.to_pylist():
                n = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                raw = coder.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u4"), row["n_tokens"]).astype("<u4").tobytes()
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                m = len(n)
                out = [pa.array([row["part"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["part", "block", "at", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "block", "doc_ids", "counts", "n_tokens", "checkpoints", "payload").mapInArrow(decode, "part int, block int, at int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    # One row for each part: as many as the writing stage had tasks.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner")).join(parts, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(starts, ["part", "block"]).select("part", "block", "at", "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
