"""Content-addressed store of token ids.

Layout, all Parquet below one folder:

``chunks``    hash, n_ids, payload: each distinct chunk once; payload is little-endian unsigned
              integers of the store's width, hash the SHA-256 of the payload.
``recipes``   shard, at, doc_id, before, n_tokens, chunks (hash and end in ids, in order), root:
              one row a document, files in ascending doc_id order. A shard is a range of documents
              in that order; ``at`` counts the documents and ``before`` the ids in front within
              the shard. root is the SHA-256 of the chunk hashes in order, as lowercase hex.
``shards``    shard, docs0, ids0: documents and ids in front of each shard.
``manifest``  level, node, digest, n_children: Merkle tree over the roots in pos order, ``FANOUT``
              children a node; the one node of the top level stands for the whole store. A store
              without documents has no node.

Chunks end where a rolling hash over the last 32 ids has ``mask`` bits zero, so an insertion
moves only the cuts near it and documents that share a passage share its chunks.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bpe import byte_alphabet
from tessera.llm.common import blocks, map_batches
from tessera.llm.units import UnitMemo
from tessera.session import drop_path, move_path, work_path

FANOUT = 1024
WINDOW = 32
#: Units encoded in one call of the library.
TOGETHER = 4096
#: Mean chunk length is LEAST + MASK + 1 ids, save that a document's last chunk is shorter.
LEAST, MASK, MOST = 32, 127, 1024
#: Ids of texts that are cut in one go; a longer text is cut alone.
GROUP = 1 << 20
#: Bytes that the memo of a worker holds while it encodes a store.
MEMO = 128 << 20
#: Head of a packed recipe: whether there is a doc_id, that with its sign bit turned, root, row, n_tokens. Then the hashes, then the ends
#: as little-endian 64-bit integers. The first ``KEY`` bytes sort like (doc_id, nulls first; root).
CHUNK = "hash binary, n_ids int, payload binary"
HEAD, KEY = struct.Struct(">?Q32sQQ"), 41


def _gear(n: int = 1 << 16) -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each id modulo ``n`` (a multiplicative mix, not a table)."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def _possible(ids: np.ndarray) -> np.ndarray:
    """Places where the hash of the ``WINDOW`` ids before them lets a chunk end."""
    h, width = _GEAR[ids & 0xFFFF], 1
    while width < WINDOW:  # the hash of 2w ids from two hashes of w ids
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1


def _ends(possible: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids. A place before ``LEAST`` is never one, so no hash that began in front of the stream counts."""
    ends, last = [], 0
    for e in possible:
        while e - last > MOST:
            ends.append(last := last + MOST)
        if e - last >= LEAST:
            ends.append(last := e)
    while n - last > MOST:
        ends.append(last := last + MOST)
    if last < n:
        ends.append(n)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream, the last being its length."""
    return _ends(_possible(ids).tolist(), len(ids))


@functools.lru_cache(1)
def _library(path: str):
    """Encodes units with the tokenizers library. One a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    size = np.zeros(t.get_vocab_size(with_added_tokens=True), np.int64)
    alphabet, special = byte_alphabet(), {i: a.content for i, a in t.get_added_tokens_decoder().items()}
    for token, i in t.get_vocab(with_added_tokens=True).items():
        size[i] = len(special[i].encode()) if i in special else len(token)
    assert all(c in alphabet for token, i in t.get_vocab(with_added_tokens=False).items() if i not in special for c in token), "not a byte-level vocabulary"

    def encode(units: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        if not joined:
            found = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
            return np.concatenate(found), np.array([*map(len, found)], np.int64)
        # Such units don't change one another: many are encoded at a time, and parted where their bytes end.
        ids, many = [], []
        for some in blocks(units, TOGETHER):
            (e,) = t.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            many.append(np.diff(np.searchsorted(np.cumsum(size[ids[-1]]), ends) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(many)

    return encode


@functools.lru_cache(1)
def library_encoder(path: str, store: str = "") -> UnitMemo:
    """A memo of the library's ids. One a Python worker and store, so that no run profits from one before."""
    return UnitMemo(_library(path), MEMO)


def _encode(memo: UnitMemo, batch: pa.RecordBatch, end_id: int, width: str) -> pa.RecordBatch:
    """Payloads of the chunks of all documents, and a packed recipe of each."""
    wide, end = np.dtype(width).itemsize, np.array([end_id], np.uint32)
    chunks, recipes, parts, lengths, held = [], [], [], [], 0
    named = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist())

    def cut() -> None:
        ids = np.concatenate(parts)
        stops = np.cumsum(lengths)
        starts, possible = stops - lengths, _possible(ids)
        of = np.searchsorted(possible, [starts, stops], side="right").tolist()
        raw, offsets = memoryview(ids.astype(width).tobytes()), [0]
        for start, n, a, b, (row, doc_id) in zip(starts.tolist(), lengths, *of, named):
            ends = _ends((possible[a:b] - start).tolist(), n)
            offsets += [(start + e) * wide for e in ends]
            own = offsets[-len(ends) - 1 :]
            digests = b"".join([hashlib.sha256(raw[x:y]).digest() for x, y in zip(own, own[1:])])
            root = hashlib.sha256(digests.hex().encode()).digest()
            recipes.append(HEAD.pack(doc_id is not None, (doc_id or 0) + (1 << 63), root, row, n) + digests + np.array(ends, "<i8").tobytes())
        chunks.append(pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.array(offsets, np.int32)), pa.py_buffer(raw)]))
        parts.clear(), lengths.clear()

    for text in memo.streams(batch.column("text")):
        own = [*text, end]
        parts += own
        lengths.append(sum(map(len, own)))
        held += lengths[-1]
        if held > GROUP:
            cut()
            held = 0
    if parts:
        cut()
    payload = pa.concat_arrays([*chunks, pa.array(recipes, pa.binary())])
    doc = pa.array(np.arange(len(payload)) >= len(payload) - len(recipes))
    return pa.RecordBatch.from_arrays([doc, payload], ["doc", "payload"])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, id_bytes: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) and write the store at ``path``.

    A null text counts as empty: its stream is the end id alone. Rows with equal or null doc_id
    stay separate documents; null ids come first, equal ids in the order of their roots. Other
    columns are ignored. Encoding happens once: chunks and recipes leave it in the same rows and
    part when they are written, so no payload is staged.
    """
    if not 0 <= end_id < 256**id_bytes:
        raise ValueError("end_id does not fit the store's id width")
    spark, width = docs.sparkSession, f"<u{id_bytes}"
    encoded = map_batches(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"),
        lambda memo, batch: _encode(memo, batch, end_id, width),
        "doc boolean, payload binary",
        lambda: library_encoder(tokenizer, path),
    )
    # Copies of a chunk meet in the map-side half of this aggregate, so a chunk that fills a
    # third of the corpus still sends one row a task. A recipe has its row, so it has no copy.
    chunk = lambda value: F.when(~F.col("doc"), value)
    rows = encoded.distinct().select("doc", chunk(F.unhex(F.sha2("payload", 256))).alias("hash"), chunk((F.octet_length("payload") / id_bytes).cast("int")).alias("n_ids"), "payload")
    staged = f"{path}/encoded"
    rows.write.option("compression", "zstd").partitionBy("doc").parquet(staged)
    if not move_path(spark, f"{staged}/doc=false", f"{path}/chunks"):  # no documents
        spark.createDataFrame([], CHUNK).write.parquet(f"{path}/chunks")

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.substring("payload", 1, KEY)
    recipe = spark.read.schema(f"{CHUNK}, doc boolean").parquet(staged).where("doc").select("payload")
    ranged = recipe.repartitionByRange(n, key).sortWithinPartitions(key).select("payload", F.spark_partition_id().alias("shard"))
    schema = "shard int, at long, doc_id long, before long, n_tokens long, chunks array<struct<hash:binary,end:long>>, root string"
    ranged.mapInArrow(_numbered, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(spark, staged)
    sums = spark.read.parquet(f"{path}/recipes").groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard: as many as shuffle partitions
    sums.select("shard", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs0"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids0")).write.parquet(f"{path}/shards")
    level, nodes = 0, _recipes(spark, path).select(F.col("pos").alias("node"), F.col("root").alias("digest"))
    while True:
        level += 1
        nodes = _parents(nodes)
        nodes.select(F.lit(level).alias("level"), "node", "digest", "n_children").write.mode("append").parquet(f"{path}/manifest")
        nodes = spark.read.parquet(f"{path}/manifest").where(F.col("level") == level)
        if nodes.select(F.max("node")).head()[0] in (0, None):
            return


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one sorted shard, unpacked, with the documents and ids in front of them."""
    docs, ids = 0, 0
    for batch in batches:
        packed = batch.column("payload").to_pylist()
        heads = [HEAD.unpack_from(p) for p in packed]
        n = np.array([h[4] for h in heads], np.int64)
        before = ids + np.cumsum(n) - n
        at = docs + np.arange(len(n))
        docs, ids = docs + len(n), ids + int(n.sum())
        many = [(len(p) - HEAD.size) // 40 for p in packed]
        hashes = b"".join([p[HEAD.size : HEAD.size + 32 * k] for p, k in zip(packed, many)])
        ends = np.frombuffer(b"".join([p[HEAD.size + 32 * k :] for p, k in zip(packed, many)]), "<i8")
        hashes = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.arange(len(ends) + 1, dtype=np.int32) * 32), pa.py_buffer(hashes)])
        chunks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.StructArray.from_arrays([hashes, pa.array(ends)], ["hash", "end"]))
        doc_id = pa.array([h[1] - (1 << 63) if h[0] else None for h in heads], pa.int64())
        root = pa.array([h[2].hex() for h in heads], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(at), doc_id, pa.array(before), pa.array(n), chunks, root], ["shard", "at", "doc_id", "before", "n_tokens", "chunks", "root"])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """pos, doc_id, start, n_tokens, chunks, root."""
    shards = F.broadcast(spark.read.parquet(f"{path}/shards"))  # one row a shard
    return spark.read.parquet(f"{path}/recipes").join(shards, "shard").select((F.col("docs0") + F.col("at")).alias("pos"), "doc_id", (F.col("ids0") + F.col("before")).alias("start"), "n_tokens", "chunks", "root")


def _parents(nodes: DataFrame) -> DataFrame:
    """One Merkle level up; a group holds ``FANOUT`` digests at most."""
    return (
        nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "digest"))).alias("kids"))
        .select("node", F.sha2(F.array_join(F.col("kids.digest"), ""), 256).alias("digest"), F.size("kids").alias("n_children"))
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents again: pos, doc_id, start, n_tokens, ids (array of int), from the files."""
    chunks = spark.read.parquet(f"{path}/chunks")
    parts = _recipes(spark, path).select("pos", "doc_id", "start", "n_tokens", F.posexplode("chunks").alias("seq", "c")).select("pos", "doc_id", "start", "n_tokens", "seq", "c.hash")
    whole = parts.join(chunks.select("hash", "payload"), "hash").groupBy("pos", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = [], batch.column("n_tokens").to_pylist()
        for k, parts in zip(n, batch.column("parts").to_pylist()):
            raw = b"".join(p["payload"] for p in parts)
            found.append(np.frombuffer(raw, dtype=f"<u{len(raw) // max(k, 1)}").astype(np.int32))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pos", "doc_id", "start", "n_tokens")), pa.array(found, pa.list_(pa.int32()))], ["pos", "doc_id", "start", "n_tokens", "ids"])

    return map_batches(whole, unpack, "pos long, doc_id long, start long, n_tokens long, ids array<int>")


# CRC-32 of a whole stream from those of its parts. The polynomial is the one of zlib.crc32,
# bits reversed; a CRC followed by n zero bytes is multiplied by x^(8n) modulo it.
_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, reversed bits, element by element."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where((b >> np.uint64(bit)) & np.uint64(1) == 1, a, np.uint64(0))
        a = (a >> np.uint64(1)) ^ np.where(a & np.uint64(1) == 1, np.uint64(_POLY), np.uint64(0))
    return out


@functools.lru_cache(None)
def _behind(bit: int) -> np.ndarray:
    """What each byte of a CRC, lowest first, gives to the CRC with 2**bit zero bytes behind."""
    power = np.array([1 << 23], np.uint64)  # x^8
    for _ in range(bit):
        power = _times(power, power)
    return np.stack([_times(np.arange(256, dtype=np.uint64) << np.uint64(8 * j), np.repeat(power, 256)) for j in range(4)])


def crc_moved(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each CRC gives to the CRC of a stream in which ``zeros`` bytes follow its part."""
    out, left, bit = crc.astype(np.uint64), zeros.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            table, own = _behind(bit), out[odd].astype("<u8").view(np.uint8).reshape(-1, 8)
            out[odd] = table[0][own[:, 0]] ^ table[1][own[:, 1]] ^ table[2][own[:, 2]] ^ table[3][own[:, 3]]
        left, bit = left >> 1, bit + 1
    return out


def store_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over 32-bit ids), n_chunks, intact, from the files.

    Each chunk is read and checked against its hash once and gives the CRC of its ids; a
    document's CRC is the exclusive or of those, moved by the bytes that follow. So neither a
    long document nor a chunk in a third of all documents is gathered anywhere. ``intact`` says
    that all chunks were there, whole, and that the recipe's root is the one in its row and
    under the manifest.
    """

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, (_, offsets, data) = batch.column("n_ids").to_numpy(), batch.column("payload").buffers()
        at = batch.column("payload").offset
        offsets, view = np.frombuffer(offsets, np.int32)[at : at + len(n) + 1].astype(np.int64), memoryview(data or b"")
        pairs = [*zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        whole = [hashlib.sha256(view[a:b]).digest() == h for h, (a, b) in zip(batch.column("hash").to_pylist(), pairs)]
        size = np.diff(offsets)
        width = int(size[0] // max(n[0], 1))
        if width in (1, 2, 4) and (size == width * n).all():  # all ids as 32 bits at once
            ids = memoryview(np.frombuffer(view[offsets[0] : offsets[-1]], f"<u{width}").astype("<u4").tobytes())
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(((offsets[:-1] - offsets[0]) // width * 4).tolist(), ((offsets[1:] - offsets[0]) // width * 4).tolist())]
        else:
            crc = [zlib.crc32(np.frombuffer(view[a:b], f"<u{(b - a) // k}").astype("<u4")) if ok else 0 for (a, b), k, ok in zip(pairs, n.tolist(), whole)]
        return pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("n_ids"), pa.array(crc, pa.int64()), pa.array(whole, pa.bool_())], ["hash", "n_ids", "crc", "whole"])

    def moved(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = crc_moved(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after")))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pos", "whole", "n_ids")), pa.array(out.astype(np.int64))], ["pos", "whole", "n_ids", "crc"])

    recipes = _recipes(spark, path)
    chunks = map_batches(spark.read.parquet(f"{path}/chunks"), digest, "hash binary, n_ids int, crc long, whole boolean")
    parts = recipes.select("pos", "n_tokens", F.inline("chunks")).select("pos", "hash", (4 * (F.col("n_tokens") - F.col("end"))).alias("after"))
    found = map_batches(parts.join(chunks, "hash").select("pos", "whole", "n_ids", "crc", "after"), moved, "pos long, whole boolean, n_ids int, crc long")
    per_doc = found.groupBy("pos").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n_ids").alias("got"), F.count(F.lit(1)).alias("n_chunks"), F.bool_and("whole").alias("whole"))
    manifest = spark.read.parquet(f"{path}/manifest").where("level = 1")
    kept = _parents(recipes.select(F.col("pos").alias("node"), F.col("root").alias("digest"))).join(manifest.select("node", F.col("digest").alias("written")), "node", "left").select("node", F.coalesce(F.col("digest") == F.col("written"), F.lit(False)).alias("kept"))
    root = F.sha2(F.array_join(F.transform("chunks", lambda c: F.lower(F.hex(c.hash))), ""), 256)
    return (
        recipes.select("pos", "doc_id", "start", "n_tokens", (root == F.col("root")).alias("rooted"), F.floor(F.col("pos") / FANOUT).alias("node"))
        .join(per_doc, "pos", "left").join(kept, "node", "left")
        .select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", (F.col("whole") & F.col("rooted") & F.col("kept") & (F.col("got") == F.col("n_tokens"))).alias("intact"))
    )


def content_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and return :func:`store_digests` of it."""
    path = work_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, end_id)
    return store_digests(docs.sparkSession, path)
