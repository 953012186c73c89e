"""Token ids of whole texts, and their binary store.

A store is a folder of shards in ascending document order. A shard is a seekable Zstandard file: independent frames, each
with its content checksum; a skippable frame that names the documents of each frame; last, the public seek table (a
skippable frame of compressed size, size and checksum of each frame), so a reader fetches the tail of the file and then
only the frames of the documents asked for.

A frame holds: uint32 documents, then int64 id and uint32 tokens of each, then all the ids (uint16, or uint32 where the
vocabulary needs it), everything little-endian. A null doc_id is written as the smallest int64 and sorts first; a null
text is empty; repeated doc_ids stay separate documents, ordered by a hash of their text, so rows that tie in both are equal. An
empty table gives an empty store and no rows; a very long text is one entry of a frame of its own size; other columns, whatever
their names, are ignored. The strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from . import textbuf as tb

END_ID = 2
ENCODE_BYTES = 6 << 20
CACHE_SEGMENTS = 500_000
JOINED = 400
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_LETTER = tb.byte_set([*range(65, 91), *range(97, 123)])
_AFTER_LETTER = tb.byte_set([10, *(b for b in range(33, 127) if b != 39 and not chr(b).isalpha())])
_PUNCT = tb.byte_set(b for b in range(33, 127) if not chr(b).isalnum())
_WHITE = tb.byte_set([*range(9, 14), *range(28, 33)])
_WHITE_LEAD = tb.byte_set([0xC2, 0xE1, 0xE2, 0xE3])
_WHITE_WIDE = [x.encode() for x in "\u0085                 　"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizer's ids of many texts, each distinct piece of text between safe cuts encoded once.

    A cut is safe where no pre-token of a byte-level tokenizer can cross it and where what stands on one side doesn't
    change the other: before a space that text follows, between an ASCII letter and ASCII punctuation or digit (not an
    apostrophe), and between punctuation and a line feed. Texts with a space before white space go whole.
    """

    _loaded: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = (RankEncoder if path.endswith(".tiktoken") else Encoder)(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # the strings of special tokens in a text are ordinary text
        self.model.encode_special_tokens = True
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.begin(max(vocab.values()) + 1, [i for x, i in vocab.items() if x[0] == "Ġ"])

    def begin(self, vocab_size: int, opening: list[int]) -> None:
        """opening: ids of tokens that begin with a space."""
        self.vocab_size = vocab_size
        self.opens_word = np.zeros(vocab_size, bool)
        self.opens_word[opening] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        spaced = [p for p in pieces if p[0] == 32 and len(p) > 1]
        rest = [p for p in pieces if p[0] != 32 or len(p) == 1]
        ids, counts = [], []
        for i in range(0, len(spaced), JOINED):
            group = spaced[i : i + JOINED]
            found = self.whole([b"".join(group).decode()])[0]
            first = np.flatnonzero(self.opens_word[found])
            if len(first) != len(group) or first[0]:
                each = self.whole([p.decode() for p in group])
                found, sizes = np.concatenate(each), np.array([len(x) for x in each])
            else:
                sizes = np.diff(np.append(first, len(found)))
            ids.append(found)
            counts.append(sizes)
        if rest:
            each = self.whole([p.decode() for p in rest])
            ids.append(np.concatenate(each))
            counts.append(np.array([len(x) for x in each]))
        new, sizes = np.concatenate(ids), np.concatenate(counts).astype(np.int64)
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(new), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        n = len(self.place)
        self.place.update(zip([*spaced, *rest], range(n, n + len(sizes)), strict=True))
        self.start = np.append(self.start, self.used + np.cumsum(sizes) - sizes)
        self.count = np.append(self.count, sizes)
        self.used += len(new)

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the documents and the offset of each document's first."""
        docs, n = len(off) - 1, len(buf)
        cut = np.zeros(n, bool)
        odd = np.zeros(docs, bool)
        if n:
            space = buf == 32
            cut |= space
            cut[1:] |= _LETTER[buf[:-1]] & _AFTER_LETTER[buf[1:]]
            cut[1:] |= _PUNCT[buf[:-1]] & (buf[1:] == 10)
            cut[off[:-1][off[:-1] < n]] = True
            at = np.flatnonzero(space)
            follows = buf[np.minimum(at + 1, n - 1)]
            last = np.isin(at + 1, off)
            bad = at[_WHITE[follows] | last]
            wide = at[_WHITE_LEAD[follows] & ~last]
            bad = np.append(bad, [p for p in wide.tolist() if any(buf[p + 1 : p + 1 + len(x)].tobytes() == x for x in _WHITE_WIDE)]).astype(np.int64)
            odd[np.searchsorted(off, bad, "right") - 1] = True
            if odd.any():
                cut &= ~np.repeat(odd, np.diff(off))
        pos = np.flatnonzero(cut)
        doc = np.searchsorted(off, pos, "right") - 1
        ends = np.minimum(np.append(pos[1:], n), off[doc + 1])
        if len(pos) and not np.array_equal(ends[:-1], pos[1:]):  # a document that goes whole stands between
            keep = ~np.repeat(odd, np.diff(off))
            buf_in = buf[keep]
            shift = np.cumsum(~keep)
            arrow_off = np.append(pos - shift[pos], len(buf_in)).astype(np.int32)
        else:
            buf_in, arrow_off = (buf, np.append(pos, n).astype(np.int32)) if len(pos) else (buf[:0], np.zeros(1, np.int32))
        if len(pos):
            arrow_off[-1] = len(buf_in) if not odd.any() else int((ends - pos).sum())
        pieces = pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(arrow_off), pa.py_buffer(np.ascontiguousarray(buf_in))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.place) + len(distinct) > CACHE_SEGMENTS:
            self.forget()
        new = [p for p in distinct if p not in self.place]
        if new:
            self.learn(new)
        codes = np.fromiter((self.place[p] for p in distinct), np.int64, len(distinct))[pieces.indices.to_numpy()] if len(pos) else np.zeros(0, np.int64)
        counts = self.count[codes]
        totals = np.bincount(doc, counts, minlength=docs).astype(np.int64) if len(pos) else np.zeros(docs, np.int64)
        whole = {}
        if odd.any():
            which = np.flatnonzero(odd)
            for d, ids in zip(which.tolist(), self.whole([buf[off[d] : off[d + 1]].tobytes().decode() for d in which]), strict=True):
                whole[d] = ids
                totals[d] = len(ids)
        extra = int(end_id is not None)
        out_off = np.concatenate([[0], np.cumsum(totals + extra)])
        out = np.empty(out_off[-1], np.uint32)
        target = np.ones(len(out), bool)
        if extra:
            out[out_off[1:] - 1] = end_id
            target[out_off[1:] - 1] = False
        for d, ids in whole.items():
            out[out_off[d] : out_off[d] + len(ids)] = ids
            target[out_off[d] : out_off[d] + len(ids)] = False
        out[target] = self.pool[tb.expand(self.start[codes], counts)]
        return out, out_off


class RankEncoder(Encoder):
    """The same of a file of ranks, whose texts are cut by the pattern that byte-level files name by kind."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begin(max(ranks.values()) + 1, [i for x, i in ranks.items() if x[:1] == b" "])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.model.encode_ordinary(t), np.uint32) for t in texts]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def versioned(path_or_name: str) -> str:
    """A tokenizer's file: a path, or the name of a public one."""
    import public_tokenizers

    return path_or_name if os.path.sep in path_or_name else public_tokenizers.path(path_or_name)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    encoder = Encoder.of(tokenizer)
    for batch in batches:
        for part in tb.chunks(batch, limit=ENCODE_BYTES):
            yield part, *encoder.encode(*tb.parts(part.column("text")))


# --- the store --------------------------------------------------------------


def _open(where: str):
    """File system and path of a URI, whatever its scheme; scratch.root() never gives a path without one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{where[5:]}" if where.startswith("file:/") and not where.startswith("file://") else where)


class ShardWriter:
    """Writes one shard, a frame at a time."""

    def __init__(self, out, vocab_size: int, frame_tokens: int, level: int):
        self.out, self.kind, self.frame_tokens = out, np.dtype("<u2" if vocab_size <= 1 << 16 else "<u4"), frame_tokens
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.docs, self.ids, self.pending, self.frames, self.index, self.total = [], [], 0, [], [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.ids.append(ids)
        self.pending += len(ids)
        if self.pending >= self.frame_tokens:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        head = np.array(self.docs, np.dtype([("doc", "<i8"), ("n", "<u4")]))
        raw = struct.pack("<I", len(head)) + head.tobytes() + np.concatenate(self.ids).astype(self.kind).tobytes()
        packed = self.press.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((self.docs[0][0], self.docs[-1][0], len(head), self.total))
        self.total += self.pending
        self.docs, self.ids, self.pending = [], [], 0

    def close(self) -> None:
        self.flush()
        index = struct.pack("<BI", self.kind.itemsize, len(self.index)) + b"".join(struct.pack("<qqIQ", *x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class ShardReader:
    """Reads single frames of a shard; a wrong checksum raises."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("not a token shard")
        table_at = size - 9 - 12 * n
        self.frames = [struct.unpack("<III", x) for x in _cut(source.read_at(12 * n, table_at), 12)]
        self.offsets = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype(np.int64)
        index_at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", source.read_at(8, index_at))
        body = source.read_at(length, index_at + 8)
        if magic != INDEX_FRAME:
            raise ValueError("the shard has no index frame")
        self.kind = np.dtype(f"<u{body[0]}")
        self.index = [struct.unpack("<qqIQ", x) for x in _cut(body[5:], 28)]
        self.unpress = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, offsets of their tokens in the frame, tokens."""
        size, raw_size, check = self.frames[k]
        raw = self.unpress.decompress(self.source.read_at(size, int(self.offsets[k])), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        n = struct.unpack_from("<I", raw)[0]
        head = np.frombuffer(raw, np.dtype([("doc", "<i8"), ("n", "<u4")]), n, 4)
        return head["doc"], np.concatenate([[0], np.cumsum(head["n"], dtype=np.int64)]), np.frombuffer(raw, self.kind, offset=4 + 12 * n)

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The tokens of the wanted documents; only the frames that can hold one are read."""
        ids = np.array(sorted(wanted), np.int64)
        for k, (low, high, _, _) in enumerate(self.index):
            if np.searchsorted(ids, low) < np.searchsorted(ids, high, "right"):
                docs, off, tokens = self.frame(k)
                for i in np.flatnonzero(np.isin(docs, ids)):
                    yield int(docs[i]), tokens[off[i] : off[i + 1]]


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, frame_tokens: int = 1 << 17, level: int = 1) -> DataFrame:
    """Encodes ``docs`` (doc_id, text, any more columns) into a store at ``folder``; one row per shard: shard, path, n_docs, n_tokens.

    The shards are ranges of doc_id (ties by a hash of the text), one shuffle of the texts; tasks stream and hold one frame.
    A retried task writes another file, and only the row of the attempt that counts names a path.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    n = scratch.parts(docs)

    def write(batches):
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        system, base = _open(folder)
        where, writer, out, docs_in = f"shard-{shard:06d}-{attempt}.zst", None, None, 0
        for part, ids, off in encoded(batches, tokenizer):
            if writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{where}", compression=None)
                writer = ShardWriter(out, max(Encoder.of(tokenizer).vocab_size, end_id + 1), frame_tokens, level)
            for i, doc in enumerate(part.column("k1").to_numpy()):
                writer.add(int(doc), ids[off[i] : off[i + 1]])
            docs_in += len(part)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{where}"], "n_docs": [docs_in], "n_tokens": [writer.total]})

    # the ranges are found by reading ids alone; rows of one id stay together, ordered by their texts' hash
    parts = scratch.keyed(docs).select("k1", "k2", "text").repartitionByRange(n, "k1").sortWithinPartitions("k1", "k2")
    return scratch.saved(parts.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_store(shards: DataFrame) -> DataFrame:
    """Per document of a store, from its files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    spark = shards.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for where, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, local = _open(where)
                with system.open_input_file(local) as source:
                    reader = ShardReader(source)
                    for k, (_, _, _, first) in enumerate(reader.index):
                        docs, off, tokens = reader.frame(k)
                        crc = [crc32(tokens[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, mask=docs == scratch.NULL_ID), pa.array(base + first + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    # one row per shard: the running total is over the list of files, not over documents
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("base", before).select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(shards: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and tokens of the listed documents, decompressing only the frames that hold one."""
    asked = {int(x) for x in wanted}

    def read(batches):
        for batch in batches:
            for where in batch.column("path").to_pylist():
                system, local = _open(where)
                with system.open_input_file(local) as source:
                    found = list(ShardReader(source).documents(asked))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found]), pa.array([t.tolist() for _, t in found], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return shards.select("path").mapInArrow(read, "doc_id long, tokens array<long>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(write_store(docs, scratch.path(spark, "tokens")))
