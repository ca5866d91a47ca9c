"""Removal of repeated passages by fixed-block anchors.

A window of WINDOW = 13 words holds exactly one of its document's non-overlapping ANCHOR = 7-word blocks. So where a window occurs in two documents, a 7-word window of the one
equals a block of the other. All blocks are indexed and every rolling 7-word window probes the index; windows that meet a block of another document are hits. Hits are extended to both
sides: the 13-word windows around them are compared over the whole corpus, and neighbours that occur in a document with a smaller doc_id merge to maximal exact repeats, which are removed.

Both steps move hashes only, in blocks of texts. Probes go sorted, as differences of truncated hashes, each distinct one of a block once, to the bucket of their range, and one bit each comes
back; truncation lets some false hits through, which the second step ends. There windows have 96-bit hashes, each distinct one of a block once with the smallest doc_id that has it in the block, and
a bit says whether another block knows a smaller one. No pairs are made, and a passage in a third of all documents is one entry a block.

Nulls: a null text has no words; a row without doc_id is neither smaller nor larger than others and keeps its words. Rows with equal doc_id take nothing from each other.
Texts under 13 words stay whole. Very long texts are one block. Other columns pass through `remove_repeats`, but `kept_text`, `n_words` and `n_removed` are replaced.
"""

from __future__ import annotations

import io
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import cut_blocks, name_of, pack, unpack
from .common import cut, over_batches, over_group, steady, text_bytes

WINDOW, ANCHOR = 13, 7
#: Hashes in a bucket on average; bits of a probe's hash beyond the logarithm of all windows; bytes of text a word, at least.
BUCKET, SPARE_BITS, WORD_BYTES = 1 << 21, 10, 4
TEXT, PROBES, REPEATS = range(3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _rolling(values: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    m = len(values) - n + 1
    h = np.zeros(max(0, m), np.uint64)
    for j in range(n if m > 0 else 0):
        h = h * base + values[j : j + m]
    return _mix(h)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Words:
    """A block's words: their hashes, the text each is of, and the windows that lie within a text."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, known: np.ndarray):
        self.split = [t.split() for t in texts]
        self.n = np.fromiter(map(len, self.split), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        hashes = _Hashes()
        self.hash = np.fromiter((hashes[w] for ws in self.split for w in ws), np.uint64, int(self.starts[-1]))
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.ids, self.known = ids, known

    def windows(self, n: int) -> np.ndarray:
        """Where windows of n words start."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        first, last = self.doc[: len(self.doc) - n + 1], self.doc[n - 1 :]
        return np.flatnonzero((first == last) & self.known[first])


class Probes:
    """The distinct hashes of a block's rolling 7-word windows in order, cut to `bits`, and what each place's is."""

    def __init__(self, words: Words, bits: int):
        self.at = words.windows(ANCHOR)
        h = _rolling(words.hash, ANCHOR, _A)[self.at] >> np.uint64(64 - bits)
        self.values, self.number = np.unique(h, return_inverse=True)
        doc = words.ids[words.doc[self.at]]
        block = ((self.at - words.starts[words.doc[self.at]]) % ANCHOR) == 0
        self.is_block = np.zeros(len(self.values), bool)
        self.is_block[self.number[block]] = True
        low, high = np.full(len(self.values), np.iinfo(np.int64).max), np.full(len(self.values), np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, doc)
        np.maximum.at(high, self.number, doc)
        self.shared = low < high


class Repeats:
    """The distinct 13-word windows around hits, with the smallest doc_id of each."""

    def __init__(self, words: Words, hit: np.ndarray):
        """hit: whether the 7-word window that starts at a word meets a block of another document."""
        at = words.windows(WINDOW)
        seen = np.concatenate([[0], np.cumsum(hit)])
        self.at = at = at[seen[at + WINDOW - ANCHOR + 1] > seen[at]]
        a = _rolling(words.hash, WINDOW, _A)[at]
        b = _rolling(_mix(words.hash), WINDOW, _B)[at] >> np.uint64(32)
        doc = words.ids[words.doc[at]]
        order = np.lexsort((doc, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        first = order[new]
        self.a, self.b, self.doc = a[first], b[first], doc[first]


def _ranges(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin, and the end: buckets are ranges of the hash."""
    edges = [(i << bits) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]]).astype(np.int64)


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values[:1]).astype(np.uint64) if len(values) else values


def _unsigned(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values as two arrays of 32 bits, which pack() can hold."""
    return (values >> np.uint64(32)).astype(np.int64), (values & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with kept_text (what is left, words joined by one space), n_words, n_removed; the text itself is left behind."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    docs = steady(docs.drop("kept_text", "n_words", "n_removed"))  # read twice: for its probes and for its texts
    most = max(1, text_bytes(docs, text) // WORD_BYTES)
    bits = min(63, math.ceil(math.log2(most + 1)) + SPARE_BITS)
    buckets = max(16, -(-most // BUCKET))
    text_at, key_at = docs.columns.index(text), docs.columns.index(key)
    moving, names = "block bigint, kind int, bucket int, payload binary", ["block", "kind", "bucket", "payload"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def rows(cells: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(kinds)], names=names)

    def stored(batch) -> bytes:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        return sink.getvalue()

    def words_of(batch) -> Words:
        import pyarrow.compute as pc

        texts = pc.fill_null(batch.column(text_at).cast(pa.large_binary()), b"").to_pylist()
        ids = batch.column(key_at)
        return Words(texts, pc.fill_null(ids, 0).cast(pa.int64()).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False))

    def send_texts(batches):
        for batch, _ in cut_blocks(batches, text_at):
            payload = stored(batch)
            yield rows([(name_of(payload), TEXT, -1, payload)])

    def send_probes(batches):
        for batch, _ in cut_blocks(batches, text_at):
            block, p = name_of(stored(batch)), Probes(words_of(batch), bits)
            edges = _ranges(p.values, bits, buckets)
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                out.append((block, PROBES, k, pack(p.values[own][:1].astype(np.int64), _deltas(p.values[own]).astype(np.int64), np.packbits(p.is_block[own]), np.packbits(p.shared[own]))))
            if out:
                yield rows(out)

    def answer_probes(table: pa.Table) -> pa.Table:
        values, block_bits, shared_bits, sizes = [], [], [], []
        for payload in table.column("payload").to_pylist():
            first, deltas, is_block, shared = unpack(payload)
            n = len(deltas)
            values.append(np.cumsum(deltas.astype(np.int64)) + int(first[0]))
            block_bits.append(np.unpackbits(is_block.astype(np.uint8), count=n))
            shared_bits.append(np.unpackbits(shared.astype(np.uint8), count=n))
            sizes.append(n)
        v = np.concatenate(values)
        order = np.argsort(v, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]]))
        met = np.maximum.reduceat(np.concatenate(block_bits)[order], begin) & (np.maximum.reduceat(np.concatenate(shared_bits)[order], begin) | (np.diff(np.append(begin, len(v))) > 1))
        hit = np.empty(len(v), np.uint8)
        hit[order] = np.repeat(met, np.diff(np.append(begin, len(v))))
        return answered(table, PROBES, hit, sizes)

    def answered(table: pa.Table, kind: int, hit: np.ndarray, sizes: list[int]) -> pa.Table:
        ends = np.cumsum(sizes)
        out = [(b, kind, k, pack(np.packbits(own))) for b, k, own in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(hit, ends[:-1]), strict=True)]
        return pa.Table.from_batches([rows(out)])

    def bits_of(table: pa.Table, kind: int, edges: np.ndarray) -> np.ndarray:
        out, missing = np.zeros(int(edges[-1]), bool), set(np.flatnonzero(np.diff(edges)).tolist())
        for which, k, payload in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if which == kind:
                n = int(edges[k + 1] - edges[k])
                out[edges[k] : edges[k + 1]] = np.unpackbits(unpack(payload)[0].astype(np.uint8), count=n).astype(bool)
                missing.discard(k)
        if missing:
            raise RuntimeError("a block was read with its rows in another order")  # no answer is not an answer of no
        return out

    def batches_of(table: pa.Table) -> list:
        """The block, once for each time it is in the corpus."""
        out = [pa.ipc.open_stream(p).read_all().combine_chunks().to_batches() for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == TEXT]
        return [b[0] for b in out]

    def repeats_of(table: pa.Table, batch) -> tuple[Words, Repeats]:
        words = words_of(batch)
        p = Probes(words, bits)
        hit = np.zeros(len(words.doc) + 1, bool)
        hit[p.at] = bits_of(table, PROBES, _ranges(p.values, bits, buckets))[p.number]
        return words, Repeats(words, hit)

    def send_repeats(table: pa.Table) -> pa.Table:
        block, out = table.column("block")[0].as_py(), []
        for batch in batches_of(table)[:1]:
            _, r = repeats_of(table, batch)
            edges = _ranges(r.a, 64, buckets)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                out.append((block, REPEATS, k, pack(*_unsigned(r.a[own][:1]), *_unsigned(_deltas(r.a[own])), r.b[own].astype(np.int64), r.doc[own])))
        return pa.Table.from_batches([rows(out)])

    def answer_repeats(table: pa.Table) -> pa.Table:
        a, b, doc, sizes = [], [], [], []
        for payload in table.column("payload").to_pylist():
            h, low, dh, dl, extra, ids = unpack(payload)
            a.append(np.cumsum(_joined(dh, dl), dtype=np.uint64) + _joined(h, low)[0])
            b.append(extra.astype(np.int64))
            doc.append(ids.astype(np.int64))
            sizes.append(len(ids))
        a, b, doc = np.concatenate(a), np.concatenate(b), np.concatenate(doc)
        order = np.lexsort((b, a))
        begin = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]))
        least = np.empty(len(a), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(a))))
        return answered(table, REPEATS, (least < doc).astype(np.uint8), sizes)

    rest = StructType([f for f in docs.schema.fields if f.name != text])
    schema = StructType(rest.fields).add("kept_text", StringType()).add("n_words", LongType()).add("n_removed", LongType())
    arrow = to_arrow_schema(schema)

    def finish(table: pa.Table) -> pa.Table:
        out = []
        for batch in batches_of(table):
            words, r = repeats_of(table, batch)
            earlier = bits_of(table, REPEATS, _ranges(r.a, 64, buckets))
            gone = r.at[earlier[r.number] | (words.ids[words.doc[r.at]] > r.doc[r.number])]
            covered = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + WINDOW, -1)
            removed = np.cumsum(covered)[: len(words.doc)] > 0
            n = np.concatenate([[0], np.cumsum(removed)])
            n = n[words.starts[1:]] - n[words.starts[:-1]]
            kept = []
            for d, ws in enumerate(words.split):
                if n[d]:
                    ws = [w for w, x in zip(ws, removed[words.starts[d] : words.starts[d + 1]].tolist(), strict=True) if not x]
                kept.append(b" ".join(ws))
            columns = [batch.column(i).cast(arrow.field(k).type) for k, i in enumerate(i for i in range(batch.num_columns) if i != text_at)]
            out.append(pa.Table.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words.n), pa.array(n)], schema=arrow))
        return pa.concat_tables(out)

    texts = docs.mapInArrow(over_batches(send_texts), moving)
    hits = cut(docs.mapInArrow(over_batches(send_probes), moving).groupBy("bucket").applyInArrow(over_group(answer_probes), moving))
    known = texts.unionByName(hits)
    asked = known.groupBy("block").applyInArrow(over_group(send_repeats), moving)
    repeats = asked.groupBy("bucket").applyInArrow(over_group(answer_repeats), moving)
    return known.unionByName(repeats).groupBy("block").applyInArrow(over_group(finish), schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
