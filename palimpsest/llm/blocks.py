"""Blocks: some megabytes of texts as numbers into a dictionary of their own.

What the corpus must agree on about words then moves as one row per block and bucket of words, each distinct word of a block once.
A block's name is a hash of its contents, so a recomputed block is found again, and equal blocks may share what is said about their words.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
import zstandard

#: UTF-8 bytes of text in a block.
BLOCK = 4 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte planes apart, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = np.dtype(np.int64)
        if len(a) and a.min() >= 0:
            kind = np.min_scalar_type(int(a.max()))
        a = a.astype(kind)
        planes = a.view(np.uint8).reshape(len(a), kind.itemsize).T.tobytes() if len(a) else b""
        out.append(f"{kind.str} {len(a)}\n".encode() + planes)
    return zstandard.ZstdCompressor(3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        end = raw.index(b"\n", at)
        kind, n = raw[at:end].decode().split()
        kind, n = np.dtype(kind), int(n)
        at = end + 1 + n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, end + 1).reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
    return out


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(3).compress(len(words).to_bytes(8, "little") + lengths.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 8), dtype=np.int64) + (8 + 4 * n)
    starts = [8 + 4 * n, *ends[:-1].tolist()] if n else []
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def name_of(*parts: bytes) -> int:
    h = xxhash.xxh3_64()
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.intdigest() - (1 << 63)


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def by_bucket(words: list[bytes], buckets: int) -> list[np.ndarray]:
    """For each bucket the numbers of its words, sorted by word."""
    owner = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    owner = owner[order]
    order = order[np.argsort(owner, kind="stable")]
    ends = np.cumsum(np.bincount(owner, minlength=buckets))
    return [order[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def cut_blocks(batches, text_at: int, block: int = BLOCK):
    """(record batch, binary array of its texts) of about `block` bytes each; a null text is empty.

    A block may hold rows of several batches, so its size does not depend on how many rows a batch has.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0

    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        batch = table.to_batches()[0]
        return batch, pc.fill_null(batch.column(text_at).cast(pa.large_binary()), b"")

    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(n):
            ends = np.cumsum(n[start:])
            take = max(1 if not size else 0, int(np.searchsorted(ends, block - size, "right")))
            if take:
                held.append(batch.slice(start, take))
                size += int(ends[take - 1])
                start += take
            if start < len(n) or size >= block:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()
