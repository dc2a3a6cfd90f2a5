"""Token-id files coded with a static range asymmetric numeral system.

Layout of a segment file (little-endian):
  magic 8 bytes | table digest 32 bytes | lanes u32 | documents u64 | tokens u64 | blocks u64
  documents: present u8 each | doc_id i64 each | tokens u32 each
  checkpoints, one a block: first token u64, tokens u32, first word u64, words u32, crc32 of ids u32, crc32 of states and words u32
  states: u64 for each block and lane | words: u32
  crc32 u32 of all before it up to the states
Token t of a block belongs to lane t mod lanes; the lanes of a block share one stream of words. A
block needs only its checkpoint, states, words and the shared table, so blocks decode in parallel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"LGRANS1\n"
BITS = 20
LOW = np.uint64(1 << 31)
LANES = 32
BLOCK = 16_384
#: A segment ends with the document that brings it to so many tokens.
SEGMENT = 1_000_000
_HEAD = struct.Struct("<8s32sIQQQ")
_POINT = np.dtype([("first", "<u8"), ("n", "<u4"), ("word", "<u8"), ("words", "<u4"), ("ids_crc", "<u4"), ("crc", "<u4")])


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies with the sum 2**bits, at least 1 for each id that occurs; equal counts may differ by one."""
    counts = np.asarray(counts, dtype=np.float64)
    seen = counts > 0
    out = np.zeros(len(counts), dtype=np.int64)
    if not seen.any():
        return out
    total = 1 << bits
    if seen.sum() > total:
        raise ValueError("more ids than slots")
    out[seen] = np.maximum(1, np.floor(counts[seen] / counts.sum() * total)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[: int(seen.sum())]
    while (gap := total - int(out.sum())) != 0:
        if gap > 0:
            out[order[0]] += gap
        else:
            take = order[out[order] > 1]
            share = np.minimum(out[take] - 1, np.maximum(1, out[take] * -gap // int(out[take].sum())))
            upto = np.cumsum(share)
            share[upto > -gap] = 0
            if not share.any():
                share[0] = min(-gap, int(out[take[0]]) - 1)
            out[take] -= share
    return out


class Table:
    """The frequency table that all files share."""

    def __init__(self, freqs: np.ndarray):
        self.freq = np.asarray(freqs, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.digest = hashlib.sha256(self.freq.astype("<u4").tobytes()).digest()
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def _cut(n: int, block: int) -> np.ndarray:
    """Tokens of each block."""
    full, rest = divmod(n, block)
    return np.array([block] * full + [rest] * (rest > 0), dtype=np.int64)


def encode_ids(ids: np.ndarray, table: Table, block: int = BLOCK, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Checkpoints, states and words. All blocks advance together, a vector of (block, lane) states at a time."""
    sizes = _cut(len(ids), block)
    points = np.zeros(len(sizes), dtype=_POINT)
    if not len(sizes):
        return points, np.zeros((0, lanes), "<u8"), np.zeros(0, "<u4")
    steps = block // lanes
    padded = np.full(len(sizes) * block, ids[-1], dtype=np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(len(sizes), steps, lanes)
    state = np.full((len(sizes), lanes), LOW, dtype=np.uint64)
    words = np.zeros((steps, len(sizes), lanes), dtype=np.uint32)
    sent = np.zeros((steps, len(sizes), lanes), dtype=bool)
    used = -(-sizes // lanes)  # steps of each block
    for t in range(int(used.max()) - 1, -1, -1):
        live = used > t
        whole = bool(live.all())
        x = state if whole else state[live]
        s = grid[:, t] if whole else grid[live, t]
        f, start = table.freq[s], table.start[s]
        full = x >= (f << np.uint64(63 - BITS))
        w = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + start
        if whole:
            state, words[t], sent[t] = x, w, full
        else:
            state[live], words[t, live], sent[t, live] = x, w, full
    sent = sent.transpose(1, 0, 2)
    stream = np.ascontiguousarray(words.transpose(1, 0, 2))[sent].astype("<u4")
    points["n"] = sizes
    points["first"] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    points["words"] = sent.reshape(len(sizes), -1).sum(axis=1)
    points["word"] = np.concatenate([[0], np.cumsum(points["words"].astype(np.int64))[:-1]])
    state = state.astype("<u8")
    raw = ids.astype("<u4")
    for b, p in enumerate(points):
        points["ids_crc"][b] = zlib.crc32(raw[int(p["first"]) : int(p["first"]) + int(p["n"])])
        points["crc"][b] = zlib.crc32(stream[int(p["word"]) : int(p["word"]) + int(p["words"])], zlib.crc32(state[b]))
    return points, state, stream


def decode_ids(points: np.ndarray, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """Ids of the given blocks, in order; both checksums of each are verified. words: the whole stream of the file."""
    if not len(points):
        return np.zeros(0, "<u4")
    for b, p in enumerate(points):
        if zlib.crc32(words[int(p["word"]) : int(p["word"]) + int(p["words"])], zlib.crc32(np.ascontiguousarray(states[b]))) != p["crc"]:
            raise ValueError("a block's bytes do not match their checksum")
    lanes = states.shape[1]
    sizes = points["n"].astype(np.int64)
    used = -(-sizes // lanes)
    steps = int(used.max())
    out = np.zeros((len(points), steps, lanes), dtype="<u4")
    state = states.astype(np.uint64)
    at = points["word"].astype(np.int64)
    stream = np.concatenate([words, np.zeros(1, "<u4")]).astype(np.uint64)
    for t in range(steps):
        live = used > t
        whole = bool(live.all())
        x = state if whole else state[live]
        here = at if whole else at[live]
        slot = x & np.uint64((1 << BITS) - 1)
        s = table.symbol[slot.astype(np.int64)]
        x = table.freq[s] * (x >> np.uint64(BITS)) + slot - table.start[s]
        low = x < LOW
        nth = np.cumsum(low, axis=1)
        take = np.minimum(here[:, None] + nth - 1, len(stream) - 1)
        x = np.where(low, (x << np.uint64(32)) | stream[np.maximum(take, 0)], x)
        here = here + nth[:, -1]
        if whole:
            out[:, t], state, at = s, x, here
        else:
            out[live, t], state[live], at[live] = s, x, here
    flat = out.reshape(len(points), -1)
    ids = flat[np.arange(flat.shape[1])[None, :] < sizes[:, None]]
    for p, first in zip(points, np.concatenate([[0], np.cumsum(sizes)[:-1]])):
        if zlib.crc32(ids[first : first + int(p["n"])]) != p["ids_crc"]:
            raise ValueError("a block's ids do not match their checksum")
    return ids


def pack_segment(doc_ids: list, lengths: list, ids: np.ndarray, table: Table) -> bytes:
    points, states, words = encode_ids(ids, table)
    head = _HEAD.pack(MAGIC, table.digest, LANES, len(doc_ids), len(ids), len(points))
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    index = present.tobytes() + known.tobytes() + np.array(lengths, dtype="<u4").tobytes() + points.tobytes()
    return b"".join([head, index, states.tobytes(), words.tobytes(), struct.pack("<I", zlib.crc32(head + index))])


def unpack_segment(blob: bytes, table: Table) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment file."""
    magic, digest, lanes, docs, n, blocks = _HEAD.unpack_from(blob)
    if magic != MAGIC or digest != table.digest:
        raise ValueError("not a segment of this table")
    at = _HEAD.size
    end = at + docs * 13 + blocks * _POINT.itemsize
    if zlib.crc32(blob[:end]) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("the index does not match its checksum")
    present = np.frombuffer(blob, np.uint8, docs, at)
    known = np.frombuffer(blob, "<i8", docs, at + docs)
    lengths = np.frombuffer(blob, "<u4", docs, at + 9 * docs)
    points = np.frombuffer(blob, _POINT, blocks, at + 13 * docs)
    states = np.frombuffer(blob, "<u8", blocks * lanes, end).reshape(blocks, lanes)
    words = np.frombuffer(blob, "<u4", (len(blob) - 4 - end - states.nbytes) // 4, end + states.nbytes)
    parts = [decode_ids(points[b : b + 64], states[b : b + 64], words, table) for b in range(0, blocks, 64)]
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    if len(ids) != n:
        raise ValueError("tokens are missing")
    return [int(d) if p else None for d, p in zip(known, present)], lengths, ids


def put_file(path: str, blob: bytes) -> None:
    """Write whole or not at all, so a task that runs twice leaves one good file."""
    import uuid

    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    own = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(blob)
    store.move(own, name)


def tokenise(docs: DataFrame, path: str, end: int = tokens.END) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids (16-bit little-endian), with end appended; null text is empty. Fails on larger ids."""

    def run(batches):
        enc = tokens.encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for pdf in batches:
            wide = [np.frombuffer(enc.encode(t or "") + tail, "<u4") for t in pdf["text"]]
            if any(w.max() > 0xFFFF for w in wide):
                raise ValueError("the vocabulary has ids beyond 16 bits")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [w.astype("<u2").tobytes() for w in wide]})

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(_arrow(run, "doc_id long, ids binary"), "doc_id long, ids binary")


def _arrow(run, schema: str):
    """Frames keep 64-bit ids with nulls whole (pandas alone would make them floats)."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def over(batches):
        frames = (pd.DataFrame({n: b.column(n).to_pylist() for n in b.schema.names}, dtype=object) for b in batches)
        for out in run(frames):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name].tolist(), f.type) for f in fields], schema=fields)

    return over


def count_ids(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all of coded; at most size rows, the vocabulary, reach the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["ids"]), "<u2"), minlength=size)[:size]
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    rows = coded.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_files(coded: DataFrame, folder: str, table: Table, segment: int = SEGMENT) -> DataFrame:
    """Write coded (doc_id, ids) as segment files in ascending doc_id order (null last; repeated ids in the
    order of a hash of their ids). Returns the manifest: path, part, nth, docs, tokens."""
    parts = max(1, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]  # Spark samples this key to the driver, so not the ids themselves
    freqs = table.freq

    def run(batches):
        own = Table(freqs)
        part, nth = TaskContext.get().partitionId(), 0
        docs, lengths, blobs, held = [], [], [], 0

        def close():
            name = f"{folder}/part-{part:06d}-{nth:06d}.ans"
            put_file(name, pack_segment(docs, lengths, np.frombuffer(b"".join(blobs), "<u2"), own))
            return {"path": [name], "part": [part], "nth": [nth], "docs": [len(docs)], "tokens": [held]}

        for pdf in batches:
            for d, b in zip(pdf["doc_id"], pdf["ids"]):
                docs.append(None if d is None else int(d))
                lengths.append(len(b) // 2)
                blobs.append(b)
                held += len(b) // 2
                if held >= segment:
                    yield pd.DataFrame(close())
                    nth += 1
                    docs, lengths, blobs, held = [], [], [], 0
        if docs:
            yield pd.DataFrame(close())

    schema = "path string, part long, nth long, docs long, tokens long"
    dealt = coded.select("doc_id", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.save(dealt.mapInArrow(_arrow(run, schema), schema), "ans-manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, table: Table) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32, ids (32-bit little-endian)."""
    upto = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # one row a write task
    parts = parts.select("part", upto(Window.orderBy("part")).alias("part_at"))
    inner = manifest.select("part", F.substring_index("path", "/", -1).alias("name"), upto(Window.partitionBy("part").orderBy("nth")).alias("nth_at"))
    starts = inner.join(parts, "part").select("name", (F.col("part_at") + F.col("nth_at")).alias("at"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ans").load(folder)
    files = files.select(F.substring_index("path", "/", -1).alias("name"), "content").join(starts, "name")
    freqs = table.freq

    def run(batches):
        own = Table(freqs)
        for pdf in batches:
            for at, blob in zip(pdf["at"], pdf["content"]):
                docs, lengths, ids = unpack_segment(blob, own)
                stops = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * int(e - n) : 4 * int(e)] for n, e in zip(lengths, stops)]
                yield pd.DataFrame({"doc_id": docs, "start": (int(at) + stops - lengths).tolist(), "n_tokens": lengths.tolist(), "ids_crc32": [zlib.crc32(c) for c in cut], "ids": cut}, dtype=object)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return files.mapInArrow(_arrow(run, schema), schema)


def write_corpus(docs: DataFrame, path: str, size: int = 65_536) -> tuple[str, DataFrame, Table]:
    """Tokenise docs and write the files: folder, manifest, table. The table counts all documents."""
    coded = tokenise(docs, path)
    target = common.new_path(docs.sparkSession, "ans-ids")
    coded.write.option("compression", "zstd").parquet(target)
    coded = docs.sparkSession.read.schema(coded.schema).parquet(target)
    table = Table(scaled(count_ids(coded, size)))
    folder = common.new_path(docs.sparkSession, "ans-files")
    put_file(f"{folder}/table.bin", struct.pack("<II", size, BITS) + table.freq.astype("<u4").tobytes())
    return folder, write_files(coded, folder, table), table


def op4_rans(spark, sf_dir: str) -> DataFrame:
    """A row a row of documents, read back from the files: doc_id, start, n_tokens, ids_crc32. Null ids come last, repeated ids stand in
    the order of a hash of their token ids; null and empty texts have the end id only; other columns take no part; an
    empty table gives no rows."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    folder, manifest, table = write_corpus(docs, tokens.path_of("word_bpe_49k.json"))
    return read_files(spark, folder, manifest, table).drop("ids")
