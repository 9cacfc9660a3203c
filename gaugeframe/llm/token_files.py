"""Token ids of documents as Arrow files of equal-length sequences.

Documents are dealt to tasks by ranges of their key, encoded in that order and laid end to end, each closed by ``end_id``. A
task cuts its stream into sequences of ``length`` ids and writes Arrow IPC files of them: ``ids`` and ``mask`` are
fixed-size lists in uncompressed batches of equally many sequences, so any sequence is two slices of the mapped file and
is never copied. ``mask``, a bit an id, is true for an id of a document and false for the padding of the last sequence of a file. ``keys`` and
``ends`` name the documents that end in a sequence and the place after their last id. A file ends with a document, so
files are read on their own; their schema tells their place in the order.

Spark's text writer puts the files in place, one row a file: what it adds after a row, its line separator, is the six
letters that close an Arrow file. Commits, retries and any store that Spark writes to are thereby Spark's own matter.
"""

from __future__ import annotations

import itertools
import json
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import stage
from .common import broadcast_if_small, thrifty

LENGTH, FILE_IDS, BATCH = 2048, 1 << 22, 64
MAGIC = b"ARROW1"  # fixed value: closes an Arrow file
#: before a space that a letter, digit or mark follows; that space always opens the next word of a byte-level vocabulary
_SAFE = rb"[!-~\xc3-\xdf\xe4-\xed\xf0-\xf4]"
_CUT = re.compile(rb"(?= " + _SAFE + rb")")
_OPENS = frozenset(b for b in range(256) if re.match(_SAFE, bytes([b])))
_first = operator.itemgetter(0)
#: within a chunk: letters, marks or digits up to another kind, one line end between two of them; else all that is left
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_PIECE = re.compile(rb" ?" + _LETTER + rb"++(?=[\x00-\x7f]|\Z)| ?[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9\n]|\Z)| ?[0-9]++(?=[\x00-\x7f]|\Z)"
                    rb"|(?<=[!-~])\n(?=[!-~]|\Z)|.+", re.DOTALL)
_WORD = re.compile(rb"( ?)" + _LETTER + rb"+")
CHUNKS, PIECES, REMEMBERED = 800_000, 400_000, 48  # chunks and pieces a worker keeps, none of more bytes than the last


class ByteEncoder:
    """Ids of whole texts by a byte-level BPE vocabulary, from remembered ids of their words.

    Texts are cut into chunks where the vocabulary's own splitting always cuts, at a space before a word, and unknown chunks
    into pieces likewise. Unknown words are encoded many at a time, with spaces or line ends between them.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        told = json.loads(spec)
        before = told.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or told.get("normalizer"):
            raise ValueError("the word memory needs a byte-level vocabulary that splits texts into words and leaves them as they are")
        self.tokenizer = Tokenizer.from_str(spec)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        if any(not re.fullmatch(rb"[!-~]+", t) for t in self.added) or any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("an added token that reaches beyond its own letters could stand across chunks")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.chunks: dict[bytes, bytes] = {}  # without the space they begin with
        self.pieces: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get, firsts, cut, gaps, new = self.chunks.get, [], [], [], {}
        for text in texts:
            first, *chunks = text.split(b" ")
            codes = list(map(get, chunks))
            if None in codes:
                missing = [k for k, code in enumerate(codes) if code is None]
                names = [chunks[k] for k in missing]
                if not (all(names) and _OPENS.issuperset(map(_first, names))):  # white space follows a space
                    first, *chunks = _CUT.split(text)
                    chunks = [c[1:] for c in chunks]
                    codes = list(map(get, chunks))
                    missing = [k for k, code in enumerate(codes) if code is None]
                    names = [chunks[k] for k in missing]
                new.update(dict.fromkeys(names))
                gaps.append((codes, missing, names))
            firsts.append(first)
            cut.append(codes)
        whole = any(t in text for text in texts for t in self.added)
        begun = self._learned([*dict.fromkeys(firsts)], whole)
        new = dict(zip(new, self._learned([b" " + c for c in new], whole).values()))
        for codes, missing, names in gaps:
            for k, name in zip(missing, names):
                codes[k] = new[name]
        room = CHUNKS - len(self.chunks)
        if room > 0:
            self.chunks.update(itertools.islice(((c, code) for c, code in new.items() if len(c) <= REMEMBERED), room))
        return [b"".join([begun[first], *codes]) for first, codes in zip(firsts, cut)]

    def _learned(self, chunks: list[bytes], whole: bool) -> dict[bytes, bytes]:
        """Ids of distinct chunks from those of their pieces; if ``whole``, a chunk that holds an added token is one piece."""
        known = self.pieces
        cut = list(map(_PIECE.findall, chunks))
        if whole:
            cut = [[c] if any(t in c for t in self.added) else pieces for c, pieces in zip(chunks, cut)]
        unknown = dict.fromkeys(p for p in itertools.chain.from_iterable(cut) if p not in known)
        kinds: dict[bytes | None, list[bytes]] = {b" ": [], b"": [], None: []}
        for piece in unknown:
            word = _WORD.fullmatch(piece)
            kinds[word[1] if word else None].append(piece)
        for lead, between in ((b" ", b""), (b"", b"\n")):
            for at in range(0, len(kinds[lead]), 512):
                part = kinds[lead][at: at + 512]
                ids = np.array(self._ids([between.join(part)])[0], "<u4")
                if lead:
                    begin = np.flatnonzero(self.opens[ids])
                    end = np.append(begin[1:], len(ids))
                else:
                    end = np.append(np.flatnonzero(ids == self.line_end), len(ids))
                    begin = np.append(0, end[:-1] + 1)
                if len(begin) != len(part):
                    raise ValueError("a word of letters is not apart from its neighbours in this vocabulary")
                code = ids.tobytes()
                unknown.update((p, code[4 * a: 4 * b]) for p, a, b in zip(part, begin.tolist(), end.tolist()))
        for at in range(0, len(kinds[None]), 512):
            part = kinds[None][at: at + 512]
            unknown.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(part, self._ids(part)))
        found = {c: b"".join([known[p] if p in known else unknown[p] for p in pieces]) for c, pieces in zip(chunks, cut)}
        room = PIECES - len(known)
        if room > 0:
            known.update(itertools.islice(((p, code) for p, code in unknown.items() if len(p) <= REMEMBERED), room))
        return found

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [c.ids for c in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


_encoders: dict[int, ByteEncoder] = {}


def byte_encoder(spec: str) -> ByteEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if hash(spec) not in _encoders:
        _encoders.clear()
        _encoders[hash(spec)] = ByteEncoder(spec)
    return _encoders[hash(spec)]


def file_bytes(keys: pa.Array, codes: list[bytes], length: int, id_type: np.dtype, order: tuple[int, int],
               batch: int = BATCH) -> bytes:
    """One Arrow file of the documents ``keys`` with their 32-bit ``codes``."""
    ids = np.frombuffer(b"".join(codes), "<u4").astype(id_type)
    many = -(-len(ids) // length)
    ends = np.cumsum([len(c) // 4 for c in codes])
    last = (ends - 1) // length  # the sequence a document ends in
    first = np.searchsorted(last, np.arange(many + 1)).astype(np.int32)
    mask = np.arange(many * length) < len(ids)
    ids = np.concatenate([ids, np.zeros(many * length - len(ids), id_type)])
    fixed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a), length)
    table = pa.table({
        "ids": fixed(ids), "mask": fixed(mask), "keys": pa.ListArray.from_arrays(pa.array(first), keys),
        "ends": pa.ListArray.from_arrays(pa.array(first), pa.array((ends - last * length).astype(np.int32)))})
    table = table.replace_schema_metadata({"slice": str(order[0]), "part": str(order[1]), "length": str(length)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=batch)
    return sink.getvalue().to_pybytes()


def write_sequences(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                    length: int = LENGTH, end_id: int = 0, file_ids: int = FILE_IDS) -> None:
    """Write every whole text's ids and then ``end_id``, by ascending ``key``, as Arrow files under ``path``.

    Null and empty texts are ``end_id`` alone. Null keys come first; rows with equal keys follow each other by a hash of their
    texts, equal rows are written as often as they occur, in as many tasks as they need. Ids are 16 bits wide if the
    vocabulary allows. Columns beside ``key`` and ``text`` are ignored; an empty table gives no file. A file holds
    ``file_ids`` ids and what the document that reaches them has more; a task holds one file.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec_text = file.read()
    spec = docs.sparkSession.sparkContext.broadcast(spec_text)
    told = json.loads(spec_text)
    top = max([*told["model"]["vocab"].values(), *[t["id"] for t in told.get("added_tokens", [])], end_id])
    id_type = np.dtype("<u2" if top < 1 << 16 else "<u4")
    end = np.array([end_id], "<u4").tobytes()
    key_type = to_arrow_type(docs.schema[key].dataType)

    def work(batches):
        from pyspark import TaskContext

        slice_number, part = TaskContext.get().partitionId(), 0
        encode = byte_encoder(spec.value).encode
        keys, codes, size = [], [], 0

        def flush():
            whole = file_bytes(pa.concat_arrays(keys), codes, length, id_type, (slice_number, part))
            return pa.RecordBatch.from_arrays([pa.array([whole[: -len(MAGIC)]], pa.binary())], names=["value"])

        for batch in thrifty(batches):
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                names, begun = some.column(0).cast(key_type), 0
                for row, code in enumerate(encode([t or b"" for t in some.column(1).to_pylist()])):
                    codes.append(code + end)
                    size += len(code) // 4 + 1
                    if size >= file_ids:
                        keys.append(names.slice(begun, row + 1 - begun))
                        yield flush()
                        keys, codes, size, part, begun = [], [], 0, part + 1, row + 1
                if begun < len(names):
                    keys.append(names.slice(begun))
        if codes:
            yield flush()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    order = ["key", "tie", "nth"]
    rows = rows.select("key", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("nth"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    files = rows.mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


class SequenceFile:
    """Random access to the sequences of one file, without copies: ``file[i]`` is ``(ids, mask)``.

    ``source`` is a local path, which is mapped into memory, or the bytes of a file.
    """

    def __init__(self, source):
        self._reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))
        told = {k.decode(): int(v) for k, v in self._reader.schema.metadata.items() if k in (b"slice", b"part", b"length")}
        self.length, self.order = told["length"], (told["slice"], told["part"])
        self.batches = [self._reader.get_batch(i) for i in range(self._reader.num_record_batches)]
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, at = self.batches[i // self.per_batch], (i % self.per_batch) * self.length
        return (batch.column("ids").flatten().slice(at, self.length).to_numpy(zero_copy_only=True),
                batch.column("mask").flatten().slice(at, self.length))

    def documents(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[int]]]:
        """Per batch: keys, starts in the file, lengths and check sums of the documents that end in it."""
        start, before, crc = 0, 0, 0  # of the document that is open
        for batch in self.batches:
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True).astype("<u4")
            real = batch.column("mask").flatten().true_count
            lists = batch.column("ends")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            ends = lists.flatten().to_numpy() + row * self.length
            sums, open_at = [], 0
            for to in ends.tolist():
                sums.append(zlib.crc32(ids[open_at:to], crc))
                crc, open_at = 0, to
            crc = zlib.crc32(ids[open_at:real], crc)
            ends = ends + before
            starts = np.concatenate([[start], ends])
            yield batch.column("keys").flatten(), starts[:-1], ends - starts[:-1], sums
            start, before = int(starts[-1]), before + real


def read_documents(spark: SparkSession, path: str, key_type: T.DataType, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document in the files: the ids of all documents before it, its own
    with the end id, and the CRC-32 of them as little-endian unsigned 32-bit integers.
    """
    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("part", T.LongType()), T.StructField("key", key_type),
                           T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def work(batches):
        for batch in thrifty(batches):
            for content in batch.column(0):
                file = SequenceFile(content.as_buffer())
                for keys, starts, lengths, sums in file.documents():
                    place = [pa.array(np.full(len(keys), k, np.int64)) for k in file.order]
                    yield pa.RecordBatch.from_arrays([*place, keys, pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())],
                                                     names=schema.names)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    found = stage(files.mapInArrow(work, schema), "token-documents")
    sizes = found.groupBy("slice", "part").agg(F.sum("n_tokens").alias("n"))
    ahead = W.partitionBy("slice").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "token-files")
    slices = sizes.groupBy("slice").agg(F.sum("n").alias("n"))
    slices = slices.select("slice", F.coalesce(F.sum("n").over(
        W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    starts = stage(sizes.join(slices, "slice").select("slice", "part", (F.col("before") + F.col("ahead")).alias("file_start")), "token-starts")
    return found.join(broadcast_if_small(starts, 24), ["slice", "part"]).select(
        F.col("key").alias(key), (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
