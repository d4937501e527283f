"""Operator 4: token ids in a binary format of shuffled, compressed planes.

Ids of all documents stand one after another in ascending doc_id order, each
document's followed by an end id.  The format is a table of chunks, ordered by
(shard, chunk); its files are Parquet files in a shared folder, so any store that
Spark can write to will do, and a lost task is simply written again.  A chunk holds
whole documents, about ``CHUNK`` ids or one longer document:

    magic, mode, bytes an id, ids a block, number of blocks, documents, ids
    index: for each block and plane the length of its compressed bytes
    documents: ids and numbers of tokens, compressed
    planes: of each block of ``BLOCK`` ids the byte planes (all low bytes, then all
    high bytes ...) or bit planes, each compressed with zstandard

Each chunk can be read by itself: its index tells where any plane starts.

Defined results: null or empty text has the end id alone; null ids come first and
repeated ids are ordered by text; other columns do not matter.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.memo import Memo
from quern.llm.sized import small
from quern.llm.textkit import slices, views
from quern.scratch import new_path

BLOCK, CHUNK, LEVEL = 16_384, 1 << 20, 3
#: Bytes of text that are encoded together.
SLICE = 4 << 20
HEAD = struct.Struct("<4sBBHIIQ")
MAGIC = b"QTP1"
#: Kinds of bytes: white space, ASCII characters that are neither letters nor white space, letters, continuations, others.
_WHITE, _MARK, _LETTER, _REST = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _WHITE
KIND[0x21:0x7F] = _MARK
KIND[0x41:0x5B] = KIND[0x61:0x7B] = _LETTER
KIND[0x80:0xC0] = _REST
#: White space beyond ASCII, in UTF-8.
WIDE_SPACES = frozenset(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
NULL_ID = -(1 << 63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places where a segment may start: no token of byte-level BPE runs over them.

    A run of white space starts there, or a mark stands there after a letter.  Letters beyond ASCII count as such up to
    U+024F, white space beyond ASCII is looked at where it matters.
    """
    if len(raw) < 2:
        return np.empty(0, np.int64)
    kind = KIND[raw]
    now, before = kind[1:], kind[:-1]
    plain = ((now == _WHITE) & (before != _WHITE) & (before != _REST)) | ((now == _MARK) & (before == _LETTER))
    wide = np.flatnonzero((before == _REST) & ((now == _WHITE) | (now == _MARK))) + 1
    if len(wide):
        last, lead = raw[wide - 1], raw[wide - 2]
        three = np.where(wide >= 3, raw[wide - 3], 0)
        two = (lead.astype(np.int64) << 8) | last
        is_space = np.isin(two, [int.from_bytes(x, "big") for x in WIDE_SPACES if len(x) == 2])
        is_space |= np.isin((three.astype(np.int64) << 16) | two, [int.from_bytes(x, "big") for x in WIDE_SPACES if len(x) == 3])
        letter = ((lead >= 0xC3) & (lead <= 0xC8) & (two != 0xC397) & (two != 0xC3B7)) | ((lead == 0xC9) & (last <= 0x8F))
        mark = now[wide - 1] == _MARK
        plain[wide[np.where(mark, letter, ~is_space)] - 1] = True
    return np.flatnonzero(plain) + 1


def _cuttable(path: str) -> str | None:
    """The token that may stand between segments, if the tokenizer is byte-level BPE of the usual pattern and has one."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split, model = made.get("pre_tokenizer") or {}, made["model"]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made.get("normalizer") is None
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    added = [t["content"] for t in made.get("added_tokens", [])]
    single = len(added) == 1 and not any(made["added_tokens"][0].get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return added[0] if usual and plain and single else None


class Coder:
    """The library's tokenizer.  A text's ids are those of its segments (see ``cuts``), each distinct one encoded once.

    Fresh segments are encoded as one text with the special token between them, at which the library splits first.  A
    text that spells that token itself is one segment, and so is every text if the tokenizer's pattern is another one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner, self.between = Tokenizer.from_file(path), _cuttable(path)
        self.end = self.inner.token_to_id(self.between) if self.between else None
        self.memo = Memo(lambda text: [text], self._make, 600_000)

    def _make(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, n = [], np.zeros(len(texts), np.int64)
        held: list[int] = []
        size = 0

        def flush():
            ids = self._ids(self.between.join([texts[k] for k in held]))
            stops = np.flatnonzero(np.append(ids, self.end) == self.end)
            n[held] = np.diff(stops, prepend=-1) - 1
            codes.append(ids[ids != self.end])

        for k, text in enumerate(texts):
            if self.between is None or self.between in text:
                if held:
                    flush()
                    held, size = [], 0
                codes.append(self._ids(text))
                n[k] = len(codes[-1])
                continue
            held.append(k)
            size += len(text)
            if size > 1 << 16:
                flush()
                held, size = [], 0
        if held:
            flush()
        return np.concatenate(codes) if codes else np.empty(0, np.int32), n

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): those of text r at bounds[r]:bounds[r + 1]; null has none."""
        raw, offsets = views(texts)
        first = np.zeros(len(raw) + 1, bool)
        if self.between:
            first[cuts(raw)] = True
            whole = pc.fill_null(pc.match_substring(texts, self.between), False).to_numpy(zero_copy_only=False)
            for r in np.flatnonzero(whole).tolist():
                first[offsets[r] : offsets[r + 1]] = False
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first[:-1])
        n = np.diff(np.searchsorted(starts, offsets))
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(n) + 1, np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        return self.memo.encode_array(found.dictionary_encode(), n)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Coder:
    """A worker keeps it from task to task."""
    return Coder(path)


def planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The block's planes, lowest first."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [raw[:, k].tobytes() for k in range(width)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def joined(parts: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """The inverse of ``planes`` for n ids."""
    if not bits:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        raw = np.packbits(spread, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel()


def pack(docs: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: bool = False) -> bytes:
    """A chunk's bytes."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    parts = [squeeze(p) for at in range(0, len(ids), BLOCK) for p in planes(ids[at : at + BLOCK], width, bits)]
    rows = squeeze(docs.astype("<i8").tobytes() + counts.astype("<i8").tobytes())
    index = np.array([len(rows), *map(len, parts)], "<u4").tobytes()
    head = HEAD.pack(MAGIC, bits, width, BLOCK, (len(ids) + BLOCK - 1) // BLOCK, len(docs), len(ids))
    return b"".join([head, index, rows, *parts])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, token counts, ids) of a chunk."""
    magic, bits, width, block, n_blocks, n_docs, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a chunk of token planes")
    per = width * (8 if bits else 1)
    index = np.frombuffer(payload, "<u4", 1 + n_blocks * per, HEAD.size).astype(np.int64)
    ends = np.cumsum(index) + HEAD.size + 4 * len(index)
    expand = zstandard.ZstdDecompressor().decompress
    part = [expand(payload[e - k : e]) for e, k in zip(ends.tolist(), index.tolist(), strict=True)]
    rows = np.frombuffer(part[0], "<i8")
    ids = [joined(part[1 + b * per : 1 + (b + 1) * per], min(block, n - b * block), width, bool(bits)) for b in range(n_blocks)]
    return rows[:n_docs], rows[n_docs:], np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)


def write(documents: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, bits: bool = False) -> None:
    """Encode all texts and write the chunks."""
    vocabulary = tokenizer_path or default_tokenizer()

    def run(batches):
        coder = tokenizer(vocabulary)
        shard, chunk = TaskContext.get().partitionId(), 0
        docs, counts, ids, held = [], [], [], 0

        def flush():
            d, c, i = np.concatenate(docs), np.concatenate(counts), np.concatenate(ids)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "n_docs": pa.array([len(d)], pa.int64()), "n_ids": pa.array([len(i)], pa.int64()), "payload": pa.array([pack(d, c, i, bits)], pa.binary())})

        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                found, bounds = coder.encode(part.column(1))
                n = np.diff(bounds)
                out = np.full(len(found) + len(n), end_id, np.uint32)
                mask = np.ones(len(out), bool)
                mask[bounds[1:] + np.arange(len(n))] = False
                out[mask] = found
                docs.append(part.column(0).fill_null(NULL_ID).to_numpy())
                counts.append(n + 1)
                ids.append(out)
                held += len(out)
                if held >= CHUNK:
                    yield flush()
                    chunk += 1
                    docs, counts, ids, held = [], [], [], 0
        if docs:
            yield flush()

    rows = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    chunks = rows.mapInArrow(run, "shard long, chunk long, n_docs long, n_ids long, payload binary")
    chunks.write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from written chunks; without ``keep_ids`` no ids."""
    chunks = spark.read.parquet(path)
    # one row a shard and one a chunk of about CHUNK ids
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = chunks.select("shard", "chunk", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")).alias("inner"))
    starts = within.join(small(before), "shard").select("shard", "chunk", (F.col("base") + F.col("inner")).alias("first"))
    found = chunks.select("shard", "chunk", "payload").join(small(starts), ["shard", "chunk"]).select("first", "payload")

    def run(batches):
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, ids = unpack(payload.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(docs, mask=docs == NULL_ID), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def round_trip(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read from the files that were written."""
    path = new_path(documents.sparkSession, "tokens")
    write(documents, path, tokenizer_path)
    return read(documents.sparkSession, path, keep_ids=False)
