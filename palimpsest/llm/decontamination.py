"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case with white space as single spaces. An item of w characters may sit in a document with up to
k = EDITS * w edits. By the q-gram lemma one edit destroys at most q of an item's q-grams, so of any chosen n of them n - q * k
survive; the n = q * k + SURVIVORS that are rarest in the benchmark are chosen. Their hits in a document are counted by item and diagonal (place in the text less
place in the item), in bands that overlap by half and are wide enough that all survivors of one occurrence share a band. Bands with SURVIVORS hits or more
are verified by an alignment within the band's diagonals.

The benchmark is read in blocks of bounded size; each block's index is what a task holds of it, and the documents stream past.
An item too short for this (fewer than q characters) must occur verbatim; an empty or null item matches nothing. A null or empty text has no leaks.
Equal items are each reported; repeated documents give repeated rows. An item that is in a text several times is reported once, at its first verbatim place, else where it has the fewest edits (of equals, the band that
starts first). Other columns pass through `find_leaks`.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut

#: q, the edits a character of an item, the hits that a band needs, the benchmark's bytes per block.
Q, EDITS, SURVIVORS, BLOCK = 8, 0.06, 20, 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from each place."""
    h, step = codes.astype(np.uint64), 1
    factor = _ODD
    while step < Q and len(h) > step:
        h = h[:-step] * factor + h[step:]
        factor = np.uint64(int(factor) * int(factor) & (1 << 64) - 1)
        step *= 2
    return h if len(codes) >= Q else h[:0]


def edit_budget(w: int) -> int:
    """Edits that an item of w characters may show: as many as EDITS allows and as the lemma can still filter."""
    return max(0, min(int(w * EDITS), (w - Q + 1 - SURVIVORS) // Q))


class Index:
    """The chosen q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [normal(t) for _, t in items]
        all_grams = [grams(_codes(t)) for t in self.texts]
        kinds, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *all_grams]), return_counts=True)
        hashes, owners, places = [], [], []
        self.need, self.budget, self.short = [], [], []
        for k, (t, g) in enumerate(zip(self.texts, all_grams, strict=True)):
            e = edit_budget(len(t))
            chosen = np.argsort(counts[np.searchsorted(kinds, g)], kind="stable")[: Q * e + SURVIVORS]
            self.budget.append(e)
            self.need.append(max(1, len(chosen) - Q * e))
            if t and not len(g):
                self.short.append(k)
            hashes.append(g[chosen])
            owners.append(np.full(len(chosen), k, np.int64))
            places.append(chosen.astype(np.int64))
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate([np.zeros(0, np.int64), *owners])[order], np.concatenate([np.zeros(0, np.int64), *places])[order]
        self.hash, self.first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hash * _ODD) >> np.uint64(64 - _TABLE_BITS)] = True
        self.need, self.budget = np.array(self.need, np.int64), np.array(self.budget, np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every shared q-gram."""
        h = grams(codes)
        at = np.flatnonzero(self.table[(h * _ODD) >> np.uint64(64 - _TABLE_BITS)])
        if not len(at) or not len(self.hash):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        same = self.hash[k] == h[at]
        at, k = at[same], k[same]
        n = self.n[k]
        rows = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[rows], self.place[rows]

    def bands(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> diagonals (first, last) of the bands that reach the item's bound."""
        at, item, place = self.hits(codes)
        out = defaultdict(list)
        if not len(at):
            return out
        # Survivors of one occurrence differ by k diagonals at most; bands of 2 (k + 1) diagonals that start every k + 1 hold them all.
        step = self.budget[item] + 1
        bin_ = (at - place) // step
        key = item * (1 << 40) + (bin_ + (1 << 30))
        kinds, counts = np.unique(key, return_counts=True)
        after = np.searchsorted(kinds, kinds + 1)
        inside = after < len(kinds)
        pair = counts + np.where(inside & (kinds[np.minimum(after, len(kinds) - 1)] == kinds + 1), counts[np.minimum(after, len(kinds) - 1)], 0)
        owner = kinds >> 40
        for k in np.flatnonzero(pair >= self.need[owner]):
            i = int(owner[k])
            s = int(self.budget[i]) + 1
            b = int(kinds[k] & ((1 << 40) - 1)) - (1 << 30)
            out[i].append((b * s, (b + 2) * s - 1))
        return out


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of item's best occurrence in text whose diagonals lie in [low, high], give or take the edits; None beyond `most` edits."""
    low, high = low - most, high + most
    width, w = high - low + 1, len(item)
    big = most + 1
    places = low + np.arange(width + 1)  # column c of row i: i characters of the item against text that ends at low + i + c
    row = np.where((places >= 0) & (places <= len(text)), 0, big)[:width].astype(np.int64)
    steps = np.arange(width)
    padded = np.concatenate([np.full(max(0, -low) + 1, 0xFFFFFFFF, np.int64), text.astype(np.int64), np.full(max(0, low + w + width - len(text)) + 1, 0xFFFFFFFF, np.int64)])
    shift = max(0, -low) + 1
    for i in range(1, w + 1):
        begin = low + i - 1 + shift
        cost = (padded[begin : begin + width] != item[i - 1]).astype(np.int64)
        new = np.minimum(row + cost, np.concatenate([row[1:], [big]]) + 1)
        ends = low + i + steps
        new[(ends < 0) | (ends > len(text))] = big
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return None
    best = int(row.argmin())
    return int(row[best]), int(low + w + best)


def leaks_in(texts: list[str], index: Index) -> list[list[tuple[int, int, int]]]:
    """For each text the (item, start, edits) found, the best of each item; places count in the normalised text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    plain = [normal(t) for t in texts]
    ends = np.cumsum([len(t) + 1 for t in plain])
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    # All texts are one line of characters; no q-gram of an item holds the character between them.
    for i, bands in index.bands(_codes("\0".join(plain))).items():
        t = index.texts[i]
        for low, high in bands:
            for d in range(int(np.searchsorted(ends, max(0, low), "right")), min(len(plain), int(np.searchsorted(ends, high + len(t), "right")) + 1)):
                if seen.get((d, i), (1, 0))[0] == 0:
                    continue
                begin = int(ends[d]) - len(plain[d]) - 1
                if (exact := plain[d].find(t)) >= 0:
                    seen[d, i] = (0, exact)
                elif (a := align(_codes(t), _codes(plain[d]), low - begin, high - begin, int(index.budget[i]))) and a[0] < seen.get((d, i), (1 << 30, 0))[0]:
                    seen[d, i] = (a[0], max(0, a[1] - len(t)))
    for (d, i), (edits, start) in seen.items():
        out[d].append((index.ids[i], start, edits))
    for k in index.short:
        for d, t in enumerate(plain):
            if (p := t.find(index.texts[k])) >= 0:
                out[d].append((index.ids[k], p, 0))
    return [sorted(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, block: int = BLOCK):
    """Lists of (item_id, text) of about `block` bytes each; the driver holds one at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null and text <> ''").select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= block:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with `leaks`, an array of (item_id, start, edits), a null or empty array for none.

    One block is looked for as the documents stream past. With more blocks, rows get a number first and each block's finds are a small table by that number, so a task never has more than one worker and one index.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("edits", pa.int64())]))
    field = "array<struct<item_id: bigint, start: bigint, edits: bigint>>"
    docs = docs.drop("leaks")

    def search(df: DataFrame, rows: list) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(rows)  # of BLOCK bytes

        def make(texts, held=[]):  # noqa: B006  the index is built once a task
            if not held:
                held.append(Index(shared.value))
            found = leaks_in([b.decode("utf-8", "replace") for b in texts.to_pylist()], held[0])
            return [pa.array([[{"item_id": i, "start": s, "edits": e} for i, s, e in f] for f in found], kind)]

        return add_columns(df, f"leaks {field}", make, text, piece=1 << 20)

    blocks = benchmark_blocks(benchmark, block)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.withColumn("leaks", F.expr(f"cast(array() as {field})"))
    if second is None:
        return search(docs, first)
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")))
    texts, found = numbered.select("_row", F.col(f"_doc.`{text}`").alias(text)), []
    for rows in itertools.chain([first, second], blocks):
        hits = cut(search(texts, rows).where(F.size("leaks") > 0).select("_row", "leaks"))
        found.append(hits)
    every = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))  # a row has as many as items are in its text
    return numbered.join(every, "_row", "left").select("_doc.*", "leaks")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every item found in a document; documents that are not named are clean."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", F.col("leak.item_id").alias("item_id"), F.col("leak.start").alias("start"), F.col("leak.edits").alias("edits"), F.lit(True).alias("contaminated"), F.lit(False).alias("kept"))
