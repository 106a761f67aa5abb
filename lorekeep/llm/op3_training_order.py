"""Training-order materialisation: fixed-stride shards in a keyed random order.

Documents are encoded (their ids, then an end id) and each task's stream of ids
is cut into sequences of ``LENGTH``; only a task's last one is shorter.  The
sequences are staged once, compressed, each with its task and number; with the
counts of the tasks before it, every sequence has an index from 0 to N - 1.  A
keyed Feistel network over the least even number of bits that holds N, walked
until it lands below N, is a permutation of these indices: the sequence's global
slot.  Nothing about other sequences is needed to compute it.  A partition is a
range of slots, known from N without sampling, and holds whole shards; a shard is
a file of records of one size, written under another name and renamed, so a lost
task leaves no half shard.

Writing is an action: when ``write_shards`` returns, all shards are there, and
what it returns is read from the index written beside them.  The folder's
manifest names the key, the tokenizer, the lengths and a digest of the input's
rows.  A later run of the same manifest resumes: it takes the staged sequences and skips complete
shards.  Over a folder with another manifest, or with files but none, it raises,
or starts anew with ``replace``.

Record: doc_id (8 bytes) that the first id belongs to, how many ids of that
document come before it (4), number of ids (4), then ``LENGTH`` ids of 2 bytes,
zero after the last; all little-endian.  Slot s is at byte
(s mod PER_SHARD) * stride of shard s div PER_SHARD.

Edge cases: a null or empty text is the end id alone.  A null doc_id is written
as -1.  Repeated rows each have their ids.  An empty table gives no shard.
Other columns of the input are ignored.  Ids beyond 16 bits do not fit a record:
a tokenizer with more than 65,536 ids is refused.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_bytes, id_text, leanly, shared_dir, table
from .word_tokens import default_path, word_encoder

LENGTH = 4096  # ids of a training sequence, as op8 packs them
PER_SHARD = 512
END_ID = 49407  # the tokenizer's end-of-text id
KEY = 0x5EED
ROUNDS = 6
MOST_TASKS = 100_000
HEAD = "<qii"  # doc_id, start, number of ids


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift) of x under a round key."""
    x = x ^ np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each index below n under ``key``, or with ``inverse`` the index of each slot."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(_mix(np.array([r + 1], dtype=np.uint64), key)[0]) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


SEQUENCE = "doc_id long, start int, n_ids int, ids binary, part int, number long"


def sequences(docs: DataFrame, tokenizer_path: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """SEQUENCE's columns: the first id's document and place in it, the ids (compressed), and the task's numbering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(write_checksum=False, write_content_size=True).compress
        docs_, firsts, stream = [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u2")

        def cut(upto: int) -> pa.RecordBatch:
            nonlocal number
            starts = np.arange(0, upto, length)
            own = np.searchsorted(firsts, starts, "right") - 1
            parts = [stream[s : min(s + length, upto)] for s in starts]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            columns = [[docs_[i] for i in own], starts - firsts[own], list(map(len, parts)), [pack(x.tobytes()) for x in parts], [part] * len(parts), range(number, number + len(parts))]
            number += len(parts)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SEQUENCE.split(", ")])

        for batch in by_bytes(batches, 1, 1 << 20):
            each = [np.append(ids, END_ID).astype("<u2") for ids in encoder.encode_all(batch.column(1).to_pylist())]
            sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
            docs_ += batch.column(0).to_pylist()
            firsts = np.concatenate([firsts, len(stream) + np.cumsum(sizes) - sizes])
            stream = np.concatenate([stream, *each])
            if whole := len(stream) // length * length:
                yield cut(whole)
                keep = max(0, int(np.searchsorted(firsts, whole, "right")) - 1)
                docs_, firsts, stream = docs_[keep:], firsts[keep:] - whole, stream[whole:]
        if len(stream):
            yield cut(len(stream))

    return id_text(docs, id_col, text_col).mapInArrow(leanly(run, "words"), SEQUENCE)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def manifest_of(docs: DataFrame, tokenizer_path: str, length: int, per_shard: int, key: int, id_col: str, text_col: str) -> dict:
    """What the shards depend on; the input by its number of rows and two order-free sums of hashes of them."""
    h = F.xxhash64("doc_id", "text")
    rows = id_text(docs, id_col, text_col).agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.hash("text", "doc_id").cast("long"))).first()
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    size = Tokenizer.from_str(data.decode()).get_vocab_size()
    if max(size, END_ID + 1) > 1 << 16:
        raise ValueError(f"{tokenizer_path} has {size} ids; a record holds ids of 16 bits")
    return {"key": key, "length": length, "per_shard": per_shard, "end_id": END_ID, "tokenizer": hashlib.sha256(data).hexdigest(), "input": [str(x) for x in rows]}


def read_manifest(out_uri: str) -> dict | None:
    fs, root = _open(out_uri)
    if fs.get_file_info(f"{root}/manifest.json").type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def claim(out_uri: str, manifest: dict, replace: bool) -> None:
    """Makes the folder this manifest's, or raises if it is another's."""
    fs, root = _open(out_uri)
    found = read_manifest(out_uri)
    if found == manifest:
        return
    if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory and fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if not replace:
            differ = sorted(k for k in manifest if found is None or found.get(k) != manifest[k])
            raise ValueError(f"{out_uri} holds files of another run; it differs in {', '.join(differ)}")
        fs.delete_dir_contents(root)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/.manifest") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/.manifest", f"{root}/manifest.json")


def staged_once(rows: DataFrame, path: str) -> DataFrame:
    """The staged sequences; written unless an earlier run of this manifest has finished them."""
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/_SUCCESS").type != pyarrow.fs.FileType.File:
        rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_shards(
    docs: DataFrame, out_uri: str, tokenizer_path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", replace: bool = False
) -> DataFrame:
    """Writes the shards; a row for each sequence: slot, shard, byte_offset, doc_id, start, n_ids, ids_crc32."""
    spark = docs.sparkSession
    claim(out_uri, manifest_of(docs, tokenizer_path, length, per_shard, key, id_col, text_col), replace)
    staged = staged_once(sequences(docs, tokenizer_path, length, id_col, text_col), f"{out_uri}/staged")
    sizes = {r["part"]: r["n"] for r in staged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each task
    total = sum(sizes.values())
    before = np.zeros(max(sizes, default=0) + 2, dtype=np.int64)
    for part, n in sizes.items():
        before[part + 1] = n
    first = spark.sparkContext.broadcast(np.cumsum(before))
    stride = struct.calcsize(HEAD) + 2 * length
    shards = -(-total // per_shard)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            slot = permute(first.value[part] + number, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), *batch.columns[:4]], ["slot", "shard", *batch.schema.names[:4]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        fs, root = _open(out_uri)
        context = TaskContext.get()
        shard, stream, temp, want = -1, None, "", 0

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(temp, f"{root}/{shard_name(shard)}")

        for batch in batches:
            rows = []
            for slot, own, doc, start, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(packed)
                if own != shard:
                    close()
                    shard, want = own, min(per_shard, total - own * per_shard) * stride
                    done = fs.get_file_info(f"{root}/{shard_name(shard)}").size == want
                    temp = f"{root}/.{shard_name(shard)}.{context.taskAttemptId()}"
                    stream = None if done else fs.open_output_stream(temp)
                if stream is not None:
                    stream.write(struct.pack(HEAD, -1 if doc is None else doc, start, n) + ids.ljust(2 * length, b"\0"))
                rows.append((slot, own, slot % per_shard * stride, doc, start, n, zlib.crc32(ids)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["slot", "shard", "byte_offset", "doc_id", "start", "n_ids", "ids_crc32"])
        close()

    dealt = staged.mapInArrow(leanly(place), "slot long, shard long, doc_id long, start int, n_ids int, ids binary")
    # Slots are a permutation of 0 .. N - 1, so even ranges need no sample; a partition is a run of whole shards.
    each = max(1, -(-shards // MOST_TASKS))
    dealt = dealt.repartitionById(max(1, -(-shards // each)), (F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    index = "slot long, shard long, byte_offset long, doc_id long, start int, n_ids int, ids_crc32 long"
    dealt.mapInArrow(leanly(write), index).write.mode("overwrite").parquet(f"{out_uri}/index")
    fs, root = _open(out_uri)
    for left in fs.get_file_info(pyarrow.fs.FileSelector(root)):  # of tasks that were lost
        if left.base_name.startswith(".shard-"):
            fs.delete_file(left.path)
    return spark.read.schema(index).parquet(f"{out_uri}/index")


def read_shards(out_uri: str, start_slot: int = 0) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, start, ids) from a slot on, reading forward only."""
    fs, root = _open(out_uri)
    manifest = read_manifest(out_uri)
    length, per_shard = manifest["length"], manifest["per_shard"]
    stride = struct.calcsize(HEAD) + 2 * length
    slot = start_slot
    while (info := fs.get_file_info(f"{root}/{shard_name(slot // per_shard)}")).type == pyarrow.fs.FileType.File:
        with fs.open_input_file(info.path) as f:
            f.seek(slot % per_shard * stride)
            while len(record := f.read(stride)) == stride:
                doc, start, n = struct.unpack_from(HEAD, record)
                yield slot, doc, start, np.frombuffer(record, dtype="<u2", count=n, offset=struct.calcsize(HEAD))
                slot += 1
        if slot % per_shard:
            return


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), shared_dir(spark), default_path())
