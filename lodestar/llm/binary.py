"""Token ids in binary shards, found by key through minimal perfect hashes.

Each task appends the raw ids of its documents to a shard file and reports
where each lies. Those small rows are then shuffled by key into index buckets; a
bucket's keys get a minimal perfect hash (levels of bit arrays: a key sits at
the first level where it is alone), and its slots hold a fingerprint of the
key, the shard, the offset and the length. A lookup reads one bucket's index and one
span of one shard, whatever the number of documents.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _text as X
from lodestar.llm import _tokens
from lodestar.llm._spark import over_arrow, read
from lodestar.session import shared_dir

MAGIC = b"MPHI"
_known: dict[str, dict[str, bytes]] = {}


@dataclass(frozen=True)
class BinaryParams:
    """``keys`` of an index bucket, about; ``gamma`` bits of a level per key that it gets; ``words`` whose ids a worker remembers."""

    vocabulary: str = _tokens.VOCABULARY
    keys: int = 250_000
    gamma: float = 2.0
    words: int = 400_000


def build_hash(keys: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """(levels of bits as bytes 0/1, slot of each key): a minimal perfect hash of distinct 64-bit keys."""
    slots = np.full(len(keys), -1, np.int64)
    levels, rest, base = [], np.arange(len(keys)), 0
    while len(rest):
        size = max(64, int(gamma * len(rest)) + 63 & ~63)
        at = (X.mix(keys[rest], 101 + len(levels)) % X.U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        rank = np.cumsum(alone) - 1
        slots[rest[hit]] = base + rank[at[hit]]
        levels.append(alone)
        base += int(alone.sum())
        rest = rest[~hit]
    return levels, slots


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (X.mix(keys, 7) >> X.U(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, size: np.ndarray, names: list[str], gamma: float) -> tuple[bytes, np.ndarray]:
    """The index file of a bucket and each key's slot."""
    levels, slots = build_hash(keys, gamma)
    order = np.argsort(slots)
    out = io.BytesIO()
    head = json.dumps({"n": len(keys), "levels": [len(x) for x in levels], "names": names}).encode()
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for x in levels:
        out.write(np.packbits(x, bitorder="little").tobytes())
        # Ones before each block of 64 bits.
        out.write(np.concatenate([[0], np.cumsum(x.reshape(-1, 64).sum(1))[:-1]]).astype(np.uint32).tobytes())
    for values, kind in ((fingerprint(keys), np.uint32), (shard, np.uint32), (offset, np.uint64), (size, np.uint32)):
        out.write(values[order].astype(kind).tobytes())
    return out.getvalue(), slots


class Index:
    """A bucket's index, as read back."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not an index file")
        n = struct.unpack("<I", raw[4:8])[0]
        head, at = json.loads(raw[8 : 8 + n]), 8 + n
        self.n, self.names, self.levels = head["n"], head["names"], []

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, count, at)
            at += found.nbytes
            return found

        base = 0
        for size in head["levels"]:
            bits, ranks = take(size // 8, np.uint8), take(size // 64, np.uint32)
            self.levels.append((size, bits, ranks, base))
            base += int(np.unpackbits(bits).sum())
        self.finger, self.shard, self.offset, self.size = take(self.n, np.uint32), take(self.n, np.uint32), take(self.n, np.uint64), take(self.n, np.uint32)

    def slot(self, key: int) -> int | None:
        """The key's slot; None if its stored fingerprint differs. A strange key passes with probability 2**-32."""
        k = np.array([key], np.int64).view(np.uint64)
        for depth, (size, bits, ranks, base) in enumerate(self.levels):
            at = int(X.mix(k, 101 + depth)[0] % X.U(size))
            if bits[at >> 3] >> (at & 7) & 1:
                word = at >> 6
                before = int(np.unpackbits(bits[word * 8 : word * 8 + 8], bitorder="little")[: at & 63].sum())
                slot = base + int(ranks[word]) + before
                return slot if self.finger[slot] == fingerprint(k)[0] else None
        return None


class Reader:
    """Keyed access to a folder that ``write_ids`` filled."""

    def __init__(self, place: str):
        self.files, self.root = fs.FileSystem.from_uri(place)
        with self.files.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.indexes: dict[int, Index | None] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the document with this key, None if there is none."""
        bucket = int(bucket_of(np.array([key], np.int64), self.manifest["buckets"])[0])
        if bucket not in self.indexes:
            path = f"{self.root}/index-{bucket:06d}.bin"
            known = self.files.get_file_info(path).type == fs.FileType.File
            self.indexes[bucket] = Index(self.files.open_input_stream(path).read()) if known else None
        index = self.indexes[bucket]
        slot = index.slot(key) if index else None
        if slot is None:
            return None
        width = self.manifest["bytes"]
        with self.files.open_input_file(f"{self.root}/{index.names[index.shard[slot]]}") as f:
            raw = f.read_at(int(index.size[slot]) * width, int(index.offset[slot]) * width)
        return np.frombuffer(raw, np.uint16 if width == 2 else np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (X.mix(keys.view(np.uint64), 3) % X.U(buckets)).astype(np.int64)


def encoder(ranks: dict[bytes, int], words: int, name: str = ""):
    """text -> raw ids; words seen before are looked up, at most ``words`` of them."""
    own = _tokens.encoding(ranks)
    kind = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32
    seen = _known.setdefault(name, {})

    def encode(text: str) -> bytes:
        parts = []
        for c in _tokens.chunks(text):
            raw = seen.get(c)
            if raw is None:
                raw = np.array(own.encode_ordinary(c), kind).tobytes()
                if len(seen) < words:
                    seen[c] = raw
            parts.append(raw)
        return b"".join(parts)

    return encode


def write_ids(docs: DataFrame, place: str, params: BinaryParams = BinaryParams()) -> DataFrame:
    """Writes the shards, the index and a manifest under ``place`` and, once all are there, returns a row per key.

    The rows are doc_id, bucket, slot, fingerprint, shard, start (in ids) and
    n_tokens. A null text has no ids but a key; an empty one has 0 ids. Rows
    with a null doc_id are in a shard but can't be looked up, so they have no row. Ids are whole numbers; others are cast to them.
    Of rows with the same doc_id the first by shard and offset is indexed. A task
    that runs again writes a shard of another name, so an index never points to
    a half-written file. Extra columns are left out.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_tokens.load(params.vocabulary))
    width = 2 if max(ranks.value.values(), default=0) < 1 << 16 else 4
    files, root = fs.FileSystem.from_uri(place)
    files.create_dir(root, recursive=True)

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, params.words, params.vocabulary)
        task = TaskContext.get()
        name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
        own, path = fs.FileSystem.from_uri(place)
        at = 0
        with own.open_output_stream(f"{path}/{name}", compression=None) as f:
            for batch in batches:
                raw = [encode(t) if t else b"" for t in batch.column(1).to_pylist()]
                sizes = np.array([len(r) // width for r in raw], np.int64)
                f.write(b"".join(raw))
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(batch)), pa.array(starts), pa.array(sizes)], ["doc_id", "shard", "start", "n_tokens"])

    # Written once: the index must not be built from a second run of the tasks.
    over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), payload, "doc_id long, shard string, start long, n_tokens long").write.mode("overwrite").parquet(f"{place}/places")
    # An id that many rows have is one key before anything is shuffled.
    places = spark.read.parquet(f"{place}/places").filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("shard", "start", "n_tokens")).alias("p")).select("doc_id", "p.*")
    buckets = max(1, -(-places.count() // params.keys))
    with files.open_output_stream(f"{root}/manifest.json", compression=None) as f:
        f.write(json.dumps({"buckets": buckets, "bytes": width}).encode())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("bucket", pa.array(bucket_of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), buckets)))

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        keys = table["doc_id"].to_numpy().astype(np.int64).view(np.uint64)
        names = table["shard"].combine_chunks().dictionary_encode()
        bucket = table["bucket"][0].as_py()
        raw, slots = pack_index(keys, names.indices.to_numpy(), table["start"].to_numpy(), table["n_tokens"].to_numpy(), names.dictionary.to_pylist(), params.gamma)
        own, path = fs.FileSystem.from_uri(place)
        spare = f"{path}/.index-{bucket:06d}-{uuid.uuid4().hex}"
        with own.open_output_stream(spare, compression=None) as f:
            f.write(raw)
        own.move(spare, f"{path}/index-{bucket:06d}.bin")
        return pa.table({"doc_id": table["doc_id"], "bucket": table["bucket"], "slot": slots, "fingerprint": fingerprint(keys).astype(np.int64), "shard": table["shard"], "start": table["start"], "n_tokens": table["n_tokens"]})

    keyed = places.mapInArrow(numbered, "doc_id long, shard string, start long, n_tokens long, bucket long")
    # Acted on here, once: the rows that come back are those of the index that lies there.
    keyed.groupBy("bucket").applyInArrow(index, "doc_id long, bucket long, slot long, fingerprint long, shard string, start long, n_tokens long").write.mode("overwrite").parquet(f"{place}/rows")
    return spark.read.parquet(f"{place}/rows")


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into shards and returns the index row of each key."""
    return write_ids(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}")
