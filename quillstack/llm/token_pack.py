"""Token-ID output: Arrow IPC files of fixed-size-list batches, and their reader.

Documents are dealt by ranges of their key and sorted, so shard after shard holds the whole
corpus in order.  With `as_stored` the order is that of the rows in the Parquet files that the input is read from (the
mix's, in the pipeline).  There are as many shards as the input has partitions.  Each task encodes its
documents, appends the end id to each, packs the stream into sequences of `length` ids and
writes, under names made from the shard's number,

* ``NNNNN.arrow``: ``ids`` fixed_size_list<uint16|uint32>[length] and ``mask``
  fixed_size_list<bool>[length] (true: a token; false: padding behind the shard's last one),
* ``NNNNN.index.arrow``: the shard's documents (key, position of the first id, number of ids).

The files are not compressed: a reader maps one into memory and takes any sequence and its mask without
copying (a mask is a slice of the file's bits).  A shard's offset in the corpus follows from the totals of
the shards before it.  A file is moved in place when it is whole, over one that another attempt of the task
left there, so a lost or repeated task does no harm; one that fails removes what it has written.

Words are encoded by the tokenizers library and remembered; texts are cut at ASCII white space,
which this kind of vocabulary drops and never spans.  New words go to the library many at a time,
with a mark between them that is one token.

Defined results: a null text counts as empty and has the end id alone; null keys come first;
repeated keys are ordered by text hash, then by place in the input; repeated rows are written
each; an empty table makes no file and an empty result; other columns of the input are ignored;
`as_stored` for an input that is no scan of Parquet files: in order of the key.
"""

from __future__ import annotations

import bisect
import gc
import os
import re
import zlib
from itertools import compress, islice, repeat
from operator import is_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ASCII_LOWER, folder, move_over, opened, put_whole, scratch, ship, stored, table

VOCABULARY = "word_bpe_49k.json"
END = 1
LENGTH = 2048
#: (words that a task remembers with their ids, about 200 bytes each; words that its worker keeps for the next
#: task, those met first), and the same for a job whose workers do other stages' work, too.
WORDS, FEW_WORDS = (1_500_000, 1_500_000), (700_000, 200_000)
#: Words that are new are encoded in lines of so many, with a mark between them.
LINE = 256
MARK = "\x01"
#: Text encoded at once.
PIECE_BYTES = 1 << 20


#: A full stop or comma between an ASCII letter or digit and white space is a piece of its own.
STOP = re.compile(rb"(?<=[a-z0-9])(?=[.,](?:[ \t\r\n]|\Z))")

#: Every ASCII letter or digit becomes an a.
SHAPE = bytes(97 if chr(c).isalnum() and c < 128 else c for c in range(256))


def cut(text: bytes, lower: bool) -> list[bytes]:
    """Pieces of a text that the vocabulary never joins, with fewer variants of a word.

    A-Z are lower-cased, where the vocabulary lower-cases (`lower`) and that can't change what it
    sees: combining marks could compose with a small letter alone, and the strings of special
    tokens are in small letters.
    """
    if lower and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
        text = text.translate(ASCII_LOWER)
        shape = text.translate(SHAPE)
        if all(shape.count(b"a" + x) == shape.count(x) for x in (b". ", b", ")):  # the usual case, without a pattern
            text = text.replace(b". ", b" . ").replace(b", ", b" , ")
        else:
            text = STOP.sub(b" ", text)
    return text.split()


class Encoder:
    """Ids of texts by the tokenizers library; ids of words are remembered as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(np.uint32 if self.library.get_vocab_size() > 1 << 16 else np.uint16)
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        same = lambda a, b: self.library.encode(a).ids == self.library.encode(b).ids
        self.lower = same("A", "a") and same("B.\nC, 1.", "b .\nc , 1 .")
        self.ids: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        import numpy as np

        sole = [w for w in words if self.mark is None or len(w) > 200 or MARK.encode() in w or b"<" in w]
        odd = set(sole)
        plain = [w for w in words if w not in odd]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        texts = [f" {MARK} ".join(x.decode("utf-8", "replace") for x in line) for line in lines]
        for line, e in zip(lines, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark)
            raw, size = ids.tobytes(), self.dtype.itemsize
            ends = [*(cuts * size).tolist(), len(raw)]
            if len(ends) != len(line):
                raise ValueError("a word holds the mark")
            at = 0
            for w, end in zip(line, ends):
                self.ids[w] = raw[at:end]
                at = end + size
        for w in sole:
            self.ids[w] = np.array(self.library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()

    def forget(self, kept: int) -> None:
        """Keep the words that were met first."""
        if len(self.ids) > kept:
            self.ids = dict(islice(self.ids.items(), kept))

    def encode(self, texts: list[bytes], most: int = WORDS[0]):
        """Arrays of the texts' ids, one by one."""
        import numpy as np

        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= PIECE_BYTES):
                held += len(texts[end])
                end += 1
            words = [cut(t, self.lower) for t in texts[at:end]]
            found = [list(map(self.ids.get, w)) for w in words]
            new = set()
            for w, f in zip(words, found):
                new.update(compress(w, map(is_, f, repeat(None))))
            if new:
                if len(self.ids) + len(new) > most:
                    self.ids = {}
                    new = set().union(*words)
                self._learn(list(new))
            for w, f in zip(words, found):
                yield np.frombuffer(b"".join(map(self.ids.__getitem__, w) if None in f else f), self.dtype)
            at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Shard:
    """Streams one shard's ids into sequences: memory is bounded by a batch of sequences."""

    BATCH = 256

    def __init__(self, path: str, length: int, dtype):
        import numpy as np
        import pyarrow as pa

        self.np, self.pa = np, pa
        self.length, self.rest, self.n = length, [], 0
        self.held = 0
        self.dtype, self.kind = dtype, pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.store, self.path = opened(path)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{os.urandom(8).hex()}.tmp"
        self.out = self.store.open_output_stream(self.part, compression=None)
        self.writer = pa.ipc.new_file(self.out, self.schema)

    def add(self, ids) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.length * self.BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        np, pa = self.np, self.pa
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, self.dtype)
        full = len(flat) // self.length * self.length
        pad = -len(flat) % self.length if last else 0
        body = np.concatenate([flat, np.zeros(pad, flat.dtype)]) if last else flat[:full]
        self.rest, self.held = ([], 0) if last else ([flat[full:]], len(flat) - full)
        if len(body):
            mask = np.ones(len(body), bool)
            mask[len(body) - pad :] = False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (body, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        move_over(self.store, self.part, self.path)

    def drop(self) -> None:
        self.out.close()
        self.store.delete_file(self.part)


def stored_place(docs: DataFrame):
    """Columns (file's number, its name, row in it) that tell the order in which rows are stored; nothing where
    `docs` is no scan of Parquet files."""
    name = F.col("_metadata.file_name")
    place = [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long").alias("p1"), name.alias("p2"), F.col("_metadata.row_index").alias("p3")]
    try:
        docs.select(*place)
    except AnalysisException:
        return []
    return place


def write_packed(docs: DataFrame, vocabulary: str, to: str | None = None, end: int = END, length: int = LENGTH, shards: int | None = None, key: str = "doc_id", text: str = "text", as_stored: bool = False, words: tuple[int, int] = WORDS) -> DataFrame:
    """Write `docs` as packed shards under `to` and return the manifest: (shard, base, n_tokens,
    n_documents, path, index), in corpus order."""
    spark = docs.sparkSession
    ship(spark)
    scratch(spark)
    to = to or folder(spark, "packed")
    first = stored_place(docs) if as_stored else []
    narrow = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *first)
    shards = shards or max(spark.sparkContext.defaultParallelism, narrow.rdd.getNumPartitions())
    dealt = narrow.withColumn("h", F.xxhash64("t")).withColumn("place", F.monotonically_increasing_id())
    order = ["p1", "p2", "p3"] if first else [F.asc_nulls_first("k"), "h", "place"]
    dealt = dealt.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("k", F.col("t").cast("binary").alias("t"), F.spark_partition_id().alias("shard"))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        shard = None
        enc = encoder(vocabulary)
        keys: list = []
        sizes: list[int] = []
        gc.disable()  # millions of words, and no cycles among them
        try:
            for b in batches:
                for k, ids, s in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist(), words[0]), b.column(2).to_pylist()):
                    if shard is None:
                        number, data, index = s, f"{to}/{s:05d}.arrow", f"{to}/{s:05d}.index.arrow"
                        shard = _Shard(data, length, enc.dtype)
                    shard.add(ids)
                    shard.add(np.array([end], ids.dtype))
                    keys.append(k)
                    sizes.append(len(ids) + 1)
            if shard is None:
                return
            shard.close()
        except BaseException:
            if shard is not None:
                shard.drop()
            raise
        finally:
            enc.forget(words[1])
            gc.enable()
            pa.default_memory_pool().release_unused()
        n = np.array(sizes, np.int64)
        rows = pa.table({"key": pa.array(keys, b.schema.field(0).type), "start": np.cumsum(n) - n, "n_tokens": n})

        def fill(out):
            with pa.ipc.new_file(out, rows.schema) as w:
                w.write_table(rows)

        put_whole(index, fill)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "n_tokens": pa.array([int(n.sum())], pa.int64()), "n_documents": pa.array([len(n)], pa.int64()), "path": [data], "index": [index]})

    longs = [StructField(c, LongType()) for c in ("shard", "n_tokens", "n_documents")]
    made = stored(dealt.mapInArrow(work, StructType(longs + [StructField(c, StringType()) for c in ("path", "index")])), "packed-manifest")
    # One row for each shard: the running total is over a few numbers a shard, not over documents.
    rows = sorted(made.collect())
    base, manifest = 0, []
    for r in rows:
        manifest.append((r[0], base, r[1], r[2], r[3], r[4]))
        base += r[1]
    return spark.createDataFrame(manifest, "shard long, base long, n_tokens long, n_documents long, path string, index string")


class Packed:
    """Random access to the sequences of one file, without copies where its store can be mapped."""

    def __init__(self, uri: str):
        import pyarrow as pa

        store, path = opened(uri)
        self.source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.starts, n = [], 0
        for j in range(self.file.num_record_batches):
            self.starts.append(n)
            n += self.file.get_batch(j).num_rows

    def sequence(self, i: int):
        """(ids, mask) of sequence `i`: views of the file, as a numpy and an Arrow array of booleans."""
        b = bisect.bisect_right(self.starts, i) - 1
        batch = self.file.get_batch(b)
        at = i - self.starts[b]
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[at * self.length : (at + 1) * self.length]
        return ids, batch.column(1).values.slice(at * self.length, self.length)

    def tokens(self):
        """The shard's ids without padding, batch by batch."""
        for j in range(self.file.num_record_batches):
            b = self.file.get_batch(j)
            ids = b.column(0).values.to_numpy(zero_copy_only=True)
            pad = b.column(1).values.false_count
            yield ids[: len(ids) - pad] if pad else ids


def read_packed(manifest: DataFrame, key_type, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""
    spark = manifest.sparkSession
    ship(spark)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for m in batches:
            for base, path, index in zip(*(m.column(i).to_pylist() for i in range(3))):
                store, at = opened(index)
                with store.open_input_file(at) as f:
                    docs = pa.ipc.open_file(f).read_all()
                sizes = docs["n_tokens"].to_pylist()
                crcs, crc, left = [], 0, iter(sizes)
                need = next(left, 0)
                for ids in Packed(path).tokens():
                    ids = ids.astype("<u4")
                    i = 0
                    while i < len(ids):
                        take = min(need, len(ids) - i)
                        crc = zlib.crc32(ids[i : i + take], crc)
                        need -= take
                        i += take
                        if not need:
                            crcs.append(crc)
                            crc, need = 0, next(left, 0)
                if len(crcs) != len(sizes):
                    raise ValueError(f"{path} holds {len(crcs)} documents, its index {len(sizes)}")
                starts = np.asarray(docs["start"]) + base
                whole = pa.table({key: docs["key"], "start": starts, "n_tokens": docs["n_tokens"], "ids_crc32": pa.array(crcs, pa.int64())})
                yield from whole.combine_chunks().to_batches(10_000)

    schema = StructType([StructField(key, key_type), *(StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    rows = manifest.select("base", "path", "index")
    return rows.repartition(max(1, manifest.count()), "path").mapInArrow(work, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Write `docs`, read the files back: (key, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    manifest = write_packed(docs, vocabulary or public_tokenizers.path(VOCABULARY), key=key, text=text, **how)
    return read_packed(manifest, docs.schema[key].dataType, key)


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
