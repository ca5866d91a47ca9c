"""Byte-level BPE: encoding by a shuffle of distinct words, decoding by the token-byte table.

Texts are cut into pre-tokens by the vocabulary's pattern. A block of texts becomes numbers into its own dictionary, and each distinct pre-token of a block moves once, to
the bucket of its hash. There every distinct pre-token is encoded once; its ids go back to the blocks that asked, which put them in the places of their numbers.
So a word that fills a third of the corpus is one row a block, and what moves besides the numbers grows with distinct words only.

The pattern's matches are found on arrays of character classes; `split_reference` is the same by the pattern itself, and tests hold them against each other.

Nulls: a null text counts as empty and has no ids. Very long texts are encoded whole (a block then has one text). Repeated rows are encoded each.
Other columns pass through `encode` and `decode`.
"""

from __future__ import annotations

import base64
import functools
import io
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import by_bucket, cut_blocks, name_of, pack, pack_words, unpack, unpack_words
from .common import add_columns, buckets_for, over_batches, over_group, steady, text_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of distinct words that a bucket holds on average, if a quarter of a block's text is distinct words.
BUCKET = 8 << 20
#: In place of a bucket: a block's numbers, and its other columns.
NUMBERS, REST = -1, -2


def _path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


@functools.cache
def ranks(name: str = VOCABULARY) -> dict[bytes, int]:
    with open(_path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(name: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})


@functools.cache
def token_bytes(name: str = VOCABULARY) -> list[bytes]:
    """The token-byte table: id -> bytes."""
    table = ranks(name)
    out = [b""] * (max(table.values()) + 1)
    for b, i in table.items():
        out[i] = b
    return out


LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)


@functools.cache
def char_classes() -> np.ndarray:
    """code point -> class."""
    import regex

    every = "".join(map(chr, (i if not 0xD800 <= i < 0xE000 else 0 for i in range(0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def split_reference(text: str) -> list[str]:
    import public_tokenizers
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


def split_all(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(the texts with a character between, where pre-tokens start in that and the end, for each pre-token its text's number or -1 for the character between)."""
    joined = "\0".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(c)
    kind = char_classes()[c]
    gaps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1] - 1
    kind[gaps] = BREAK
    if not n:
        return joined, np.zeros(1, np.int64), np.zeros(0, np.int64)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[gaps] = True
    start[np.minimum(gaps + 1, n - 1)[gaps + 1 < n]] = True
    # The last white space before a word: a blank goes with the word, anything else stands alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
    start[last] = True
    start[last[c[last] == 0x20] + 1] = False
    # Contractions, where an apostrophe starts a pre-token.
    for p in np.flatnonzero(start & (c == 0x27)).tolist():
        a = joined[p + 1 : p + 3] if kind[p + 1 : p + 3].max(initial=0) != BREAK else joined[p + 1 : p + 2] if p + 1 < n and kind[p + 1] != BREAK else ""
        m = 2 if a[:1] in ("s", "t", "m", "d") and a else 3 if a in ("re", "ve", "ll") else 0
        if m:
            start[p + 1 : p + m] = False
            if p + m < n:
                start[p + m] = True
    at = np.flatnonzero(start)
    owner = np.searchsorted(gaps, at, "right")
    owner[kind[at] == BREAK] = -1
    return joined, np.append(at, n), owner


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def block_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their numbers in order of the texts, pre-tokens in each text)."""
    joined, at, owner = split_all([t.decode("utf-8", "replace") for t in texts])
    numbers = _Numbers()
    places = at.tolist()
    ids = np.fromiter((numbers[joined[a:b]] for a, b in zip(places, places[1:], strict=False)), np.int64, len(owner))
    inner = owner >= 0
    words, ids = list(numbers), ids[inner]
    # Frequent words get small numbers: they pack better. A word that only stood between texts goes.
    counts = np.bincount(ids, minlength=len(words))
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(order))
    return [words[i].encode("utf-8", "surrogatepass") for i in order], rank[ids], np.bincount(owner[inner], minlength=len(texts))


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep_text: bool = False, decoded: bool = False) -> DataFrame:
    """docs with token_ids: the ids as little-endian unsigned 32-bit numbers. The text itself is moved along only if keep_text.

    decoded: with the column of decode() too, made in the same pass, so that a task needs one Python worker and not two.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructType

    docs = steady(docs.drop("token_ids", *["decoded"] * decoded))  # read twice: for its words and for its numbers
    buckets = buckets_for(text_bytes(docs, text) // 4, BUCKET)
    text_at = docs.columns.index(text)
    moving, names = "block bigint, bucket int, payload binary", ["block", "bucket", "payload"]

    def name(batch) -> int:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        return name_of(sink.getvalue())

    def rows(*cells):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=names)

    def ask(batches):
        for batch, texts in cut_blocks(batches, text_at):
            words, _, _ = block_of(texts.to_pylist())
            block = name(batch)
            out = [(block, b, pack_words([words[i] for i in own])) for b, own in enumerate(by_bucket(words, buckets)) if len(own)]
            if out:
                yield rows(*out)

    def numbers(batches):
        for batch, texts in cut_blocks(batches, text_at):
            words, ids, n = block_of(texts.to_pylist())
            kept, sink = batch if keep_text else batch.drop_columns([text]), io.BytesIO()
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(kept)
            own, block = by_bucket(words, buckets), name(batch)
            yield rows((block, NUMBERS, pack(ids, n, np.concatenate([np.zeros(0, np.int64), *own]), np.array([len(x) for x in own], np.int64))), (block, REST, sink.getvalue()))

    def answer(table: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        encode_word = encoding(vocabulary).encode_ordinary
        out = []
        for payload in table.column("payload").to_pylist():
            found = []
            for w in unpack_words(payload):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(encode_word(w.decode("utf-8", "surrogatepass")), np.uint32)
                found.append(ids)
            out.append(pack(np.fromiter(map(len, found), np.int64, len(found)), np.concatenate([np.zeros(0, np.uint32), *found])))
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], names=names)

    rest = StructType([f for f in docs.schema.fields if keep_text or f.name != text])
    schema = StructType(rest.fields).add("token_ids", BinaryType())
    if decoded:
        schema = schema.add("decoded", BinaryType())
    arrow = to_arrow_schema(schema)

    def put_back(table: pa.Table) -> pa.Table:
        parts = {}
        blocks = []
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if bucket == REST:
                blocks.append(payload)
            else:
                parts[bucket] = payload
        ids, n, order, sizes = unpack(parts[NUMBERS])
        lengths, flat = [], []
        for b in np.flatnonzero(sizes).tolist():
            count, tokens = unpack(parts[b])  # a missing bucket is an error
            lengths.append(count)
            flat.append(tokens.astype("<u4"))
        lengths = np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *flat])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
        place = np.empty(len(order), np.int64)
        place[order.astype(np.int64)] = np.arange(len(order))
        edges, out = np.concatenate([[0], np.cumsum(n.astype(np.int64))]), []
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            w = place[ids[a:b]]
            m = lengths[w]
            at = np.repeat(starts[w] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum())) if b > a else np.zeros(0, np.int64)
            out.append(flat[at].tobytes())
        tokens = [pa.chunked_array([pa.array(out, pa.binary())])]
        if decoded:
            tokens.append(pa.chunked_array([pa.array((bytes_of(x, vocabulary) for x in out), pa.binary())]))
        tables = []
        for payload in blocks:
            batch = pa.ipc.open_stream(payload).read_all()
            tables.append(pa.Table.from_arrays([*[c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)], *tokens], schema=arrow))
        return pa.concat_tables(tables)

    answers = docs.mapInArrow(over_batches(ask), moving).groupBy("bucket").applyInArrow(over_group(answer), moving)
    return docs.mapInArrow(over_batches(numbers), moving).unionByName(answers).groupBy("block").applyInArrow(over_group(put_back), schema)


def bytes_of(token_ids: bytes, vocabulary: str = VOCABULARY) -> bytes:
    """Decoding: each id joins the token-byte table."""
    return b"".join(map(token_bytes(vocabulary).__getitem__, np.frombuffer(token_ids, "<u4").tolist()))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with decoded: the bytes of its token_ids; null ids count as none."""
    import pyarrow as pa

    def make(ids):
        return [pa.array([bytes_of(x, vocabulary) for x in ids.to_pylist()], pa.binary())]

    return add_columns(encoded, "decoded binary", make, "token_ids")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, decoded=True)
    return out.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
