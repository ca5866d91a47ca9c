"""Near-duplicates: MinHash bands propose, sequential Bayesian verification prunes, full sets confirm.

A text's set is its distinct 5-word shingles in lower case (A-Z), or its whole word sequence if it is shorter. Texts with equal sets are one class, found by a 128-bit hash of the set, so thousands
of copies are one row from there on. Classes are banded: BANDS bands of ROWS minima; two sets with a similarity of 0.75 share a band but for 5 in a million cases.

Candidates come without all pairs of a bucket. First each member of a bucket is paired with the bucket's leader, which every band draws anew. After links among those are confirmed and joined
to components, only members of one bucket that are in different components are compared further, by signature and full set, within tiles of bounded size: the smaller components of a bucket meet
the largest one's tiles and each other, and only links leave a tile. So every pair that shares a band ends compared or in one component. Where many unlike classes share a band, as documents do that share a long passage, a
bucket is banded again first: its members meet only where they share a second band too, of the 31 others, and so on until fewer than BIG are outside the largest component. That finds nearly all links, and the rest exactly: buckets
that are small once these have joined components go to tiles whole, and the members of those that are still big meet wherever they share one of their rarest shingles. Two sets of which one has n shingles share n - 0.75 n + 1
of these, rounded down, at a similarity of 0.75 in any order of shingles that is the same for both, so whoever shares none is proven unlike. The order is by counts in CELLS cells of hashes; it decides the cost alone.
What meets in this second turn is compared by full sets at once, without signatures: no verification that may err stands between two members of a big bucket.

Verification is sequential: after each STEP of signature bytes a pair is dropped if, given the matches so far and a flat prior, its similarity is 0.75 or more with a probability under MISS. Survivors are verified
exactly on their full sets. For a component one link is enough, so each class tries its best candidate first, and the rest is verified only if it still joins two components.

Nulls: a null, empty or blank text has an empty set and links with nothing; a row without doc_id shares its class's component, which is null if no row of it has one. Rows with equal doc_id are one node:
the links of any of them count for all. Very long texts count whole. `components` gives a row for each row; other columns are not needed and left behind.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import cut_blocks
from .common import cut, over_batches, over_group

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Signature bytes, bytes that are compared at once, and the probability with which a pair over the bound may be dropped at each step.
SIGNATURE, STEP, MISS = BANDS * ROWS, 16, 1e-6
#: Classes in a tile; classes outside the largest component from which on a bucket is banded again, and how often that is done at most (what is still big then goes to tiles as it is).
TILE, BIG, LEVELS = 256, 2048, 4
#: Cells in which shingles of members of big buckets are counted; shingles of a tile's texts that are in memory at once, where full sets are compared.
CELLS, PIECE = 1 << 20, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_COEFFICIENTS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, SIGNATURE), np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def sets_of(texts: list[bytes], hashes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' distinct shingles, sorted within a text; where texts begin, and the end)."""
    hashes = _Hashes() if hashes is None else hashes
    split = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate([[0], np.cumsum(n)])
    h = np.fromiter((hashes[w] for ws in split for w in ws), np.uint64, int(starts[-1]))
    doc = np.repeat(np.arange(len(split)), n)
    m = max(0, len(h) - SHINGLE + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(SHINGLE if m else 0):
        rolled = rolled * _BASE + h[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[SHINGLE - 1 :]) if m else np.zeros(0, np.int64)
    values, owner = _mix(rolled[at]), doc[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(b" ".join(split[d])) for d in short.tolist()], np.uint64)
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(split) + 1))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SIGNATURE minima of each nonempty set; a row for each set."""
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, SIGNATURE), np.uint64)
    begin = starts[:-1][full]
    if len(full):
        for k in range(SIGNATURE):
            out[full, k] = np.minimum.reduceat(values * (_COEFFICIENTS[0, k] | np.uint64(1)) + _COEFFICIENTS[1, k], begin)
    return _mix(out)


def least_matches(miss: float = MISS) -> np.ndarray:
    """For each step the matches below which a pair is dropped."""
    s = (np.arange(20_000) + 0.5) / 20_000
    match = s + (1 - s) / 256  # bytes of different minima may agree
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        need = n + 1
        for m in range(n, -1, -1):
            density = m * np.log(match) + (n - m) * np.log1p(-np.minimum(match, 1 - 1e-12))
            density = np.exp(density - density.max())
            if density[s >= PERCENT / 100].sum() / density.sum() < miss:
                break
            need = m
        out.append(need)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a and b that pass every step, their matches)."""
    at, found = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(need):
        own = slice(k * STEP, (k + 1) * STEP)
        found = found + (a[at, own] == b[at, own]).sum(1)
        keep = found >= least
        at, found = at[keep], found[keep]
    return at, found


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, n, set (16 bytes; null if empty), bands, signature."""
    import pyarrow as pa

    docs = docs.select(key, text)

    def run(batches):
        for batch, texts in cut_blocks(batches, 1):
            values, starts = sets_of(texts.to_pylist())
            rows = minima(values, starts)
            keys = np.zeros((len(starts) - 1, BANDS), np.uint64)
            for j in range(ROWS):
                keys = _mix(keys * _BASE + rows[:, j::ROWS] + np.arange(BANDS, dtype=np.uint64))
            n = np.diff(starts)
            empty = n == 0
            names = [None if e else xxhash.xxh3_128_digest(values[a:b].tobytes()) for e, a, b in zip(empty.tolist(), starts.tolist(), starts[1:].tolist(), strict=False)]
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel())
            sign = (rows & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(names, pa.binary()), bands, pa.array([r.tobytes() for r in sign], pa.binary())], names=["doc_id", "n", "set", "bands", "signature"])

    return docs.mapInArrow(over_batches(run), "doc_id bigint, n bigint, set binary, bands array<bigint>, signature binary")


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, matches of the pairs that sequential verification leaves."""
    import pyarrow as pa

    need = least_matches()

    def run(batches):
        for t in batches:
            if t.num_rows:
                at, found = survivors(_matrix(t.column(2)), _matrix(t.column(3)), need)
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(at)), t.column(1).take(pa.array(at)), pa.array(found)], names=["a", "b", "matches"])

    signed = classes.select("node", "signature")
    both = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(over_batches(run), "a bigint, b bigint, matches bigint")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough; texts: node, packed."""
    import pyarrow as pa

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for t in batches:
            for start in range(0, t.num_rows, 500):
                own = t.slice(start, 500)
                a, b = own.column(0).to_pylist(), own.column(1).to_pylist()
                packed: dict[int, bytes] = dict(zip(a, own.column(2).to_pylist(), strict=True)) | dict(zip(b, own.column(3).to_pylist(), strict=True))
                number = {x: i for i, x in enumerate(packed)}
                values, starts = sets_of([unzip.decompress(p) for p in packed.values()])
                keep = []
                for k, (x, y) in enumerate(zip(a, b, strict=True)):
                    u, v = values[starts[number[x]] : starts[number[x] + 1]], values[starts[number[y]] : starts[number[y] + 1]]
                    if similar(u, v):
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([own.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    both = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(over_batches(run), "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has a link. Alternates large and small stars until every edge leads to its component's smallest node."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        new = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Done when no node has two parents and no parent has one.
        if new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            roots = new.select(F.col("v").alias("node")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        edges = new


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only components that a link joins are looked at."""
    named = links
    for end in ("a", "b"):
        named = named.join(labels.toDF(end, f"c{end}"), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    found = cut(connected(named.select("a", "b")))
    moved = labels.join(found.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(found.join(labels.select("node"), "node", "left_anti"))


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs whose ends are in different components; a node without label is its own."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(labels.toDF(end, f"c{end}"), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return out.where("ca <> cb").select(*pairs.columns)


def similar(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two full sets, sorted, are similar enough."""
    both = np.concatenate([u, v])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return bool(len(u)) and 100 * common >= PERCENT * (len(u) + len(v) - common)


def _majors(members: DataFrame) -> DataFrame:
    """bucket, major (its largest component), top (that one's members), others (the rest's) of buckets with several components."""
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("bucket").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).where("components > 1")
    return most.select("bucket", F.col("top.component").alias("major"), F.col("top.n").alias("top"), (F.col("all") - F.col("top.n")).alias("others"))


def banded_again(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members of buckets with several components, none of them big unless LEVELS did not do: big buckets give way to those that their members' other bands make of them."""
    small, rows = [], members.withColumn("used", F.array("bucket"))
    for _ in range(LEVELS):
        majors = cut(_majors(rows))
        small.append(rows.join(majors.where(F.col("others") <= BIG).select("bucket"), "bucket", "left_semi").select(*members.columns))
        big = majors.where(F.col("others") > BIG).select("bucket")
        if big.isEmpty():
            rows = None
            break
        again = rows.join(big, "bucket", "left_semi").join(classes.select("node", "bands"), "node")
        again = again.withColumn("band", F.explode(F.array_except("bands", "used")))
        rows = cut(again.select(F.xxhash64("bucket", "band").alias("bucket"), "node", "component", F.concat("used", F.array("band")).alias("used")))
    if rows is not None:
        small.append(rows.select(*members.columns))
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    return out


def _sets(batches):
    """(record batch, its texts' shingles and where they begin), some hundred rows each; the last column is packed."""
    unzip = zstandard.ZstdDecompressor()
    for t in batches:
        for start in range(0, t.num_rows, 500):
            own = t.slice(start, 500)
            yield own, *sets_of([unzip.decompress(p) for p in own.column(own.num_columns - 1).to_pylist()])


def rarest(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those shingles of a set, the rarest, of which every similar enough set has one among its own."""
    order = np.lexsort((values, counts[values % np.uint64(CELLS)]))
    return values[order[: len(values) + (-PERCENT * len(values)) // 100 + 1]]


def by_rare_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, node, component for each of the rarest shingles of each member (node, component): whoever is similar enough meets in one of these buckets at least."""
    import pyarrow as pa

    def count(batches):
        found = np.zeros(CELLS, np.int64)
        for _, values, _ in _sets(batches):
            found += np.bincount((values % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["cell", "n"])

    rows = cut(members.join(texts, "node").select("node", "component", "packed"))
    cells = rows.mapInArrow(over_batches(count), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    known = members.sparkSession.sparkContext.broadcast(counts)

    def deal(batches):
        for t, values, starts in _sets(batches):
            own = [rarest(values[a:b], known.value) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), t.column(0).take(at), t.column(1).take(at)], names=["bucket", "node", "component"])

    return rows.mapInArrow(over_batches(deal), "bucket bigint, node bigint, component bigint")


def _residual(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between members of one bucket that are in different components, enough to join all that are similar; members: bucket, node, component."""
    big = cut(_majors(members).where(F.col("others") > BIG).select("bucket"))
    if big.isEmpty():
        return _in_tiles(members, classes, texts)
    found = cut(_in_tiles(cut(banded_again(members, classes)), classes, texts))
    # Members of big buckets that share no second band or that verification dropped: none is left uncompared but what rare shingles prove unlike.
    labels = cut(joined(members.select("node", "component").distinct(), found))
    rows = cut(members.join(big, "bucket", "left_semi").select("bucket", "node").join(labels, "node").select(*members.columns))
    majors = cut(_majors(rows).select("bucket", (F.col("others") > BIG).alias("big")))
    rest = rows.join(majors.where("not big"), "bucket", "left_semi")
    still = majors.where("big")
    if not still.isEmpty():
        rest = rest.unionByName(by_rare_shingles(rows.join(still, "bucket", "left_semi").select("node", "component").distinct(), texts))
    return found.unionByName(_in_tiles(cut(rest), classes, texts, exact=True))


def similar_pairs(packed, n: np.ndarray, may: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of all true cells of may whose texts' full sets are similar enough; n: sizes of the sets, by which texts come PIECE shingles at a time."""
    unzip, out = zstandard.ZstdDecompressor(), []

    def pieces(rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows, np.flatnonzero(np.diff(np.cumsum(n[rows]) // PIECE)) + 1) if len(rows) else []

    def sets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sets_of([unzip.decompress(packed[k].as_py()) for k in rows.tolist()])

    for right in pieces(np.flatnonzero(may.any(0))):
        values, starts = sets(right)
        order, size = np.argsort(values), np.diff(starts)
        ranked, owner = values[order], np.repeat(np.arange(len(right)), size)[order]
        for left in pieces(np.flatnonzero(may[:, right].any(1))):
            own, at = (values, starts) if np.array_equal(left, right) else sets(left)
            for k, u in zip(left.tolist(), np.split(own, at[1:-1]), strict=True):
                low = np.searchsorted(ranked, u)
                hits = np.searchsorted(ranked, u, "right") - low
                common = np.bincount(owner[np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())], minlength=len(right))
                out += [(k, o) for o in right[may[k, right] & (common > 0) & (100 * common >= PERCENT * (len(u) + size - common))].tolist()]
    return out


def _in_tiles(members: DataFrame, classes: DataFrame, texts: DataFrame, exact: bool = False) -> DataFrame:
    """a, b: links between members of one bucket that are in different components; members: bucket, node, component.

    Full sets come along, so a pair that survives is verified where it is found; exact: full sets alone decide. Once two components are joined within a tile their other pairs are not looked at; only links leave.
    """
    import pyarrow as pa

    need = least_matches()
    major = _majors(members).select("bucket", "major", F.ceil(F.col("top") / TILE).cast("int").alias("tiles"), F.ceil(F.col("others") / TILE).cast("int").alias("small_tiles"))
    rows = members.join(major, "bucket").join(classes.select("node", "n", "signature").join(texts, "node"), "node")
    is_major = F.col("component") == F.col("major")
    mine = F.pmod(F.xxhash64("node"), F.when(is_major, F.col("tiles")).otherwise(F.col("small_tiles")).cast("long")).cast("int")
    rows = rows.withColumns({"is_major": is_major, "mine": mine})
    # A tile of the largest component (kind 0) meets each tile of the others; tiles of the others meet each other (kind 1).
    meets = F.when(
        F.col("is_major"), F.transform(F.sequence(F.lit(0), F.col("small_tiles") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("mine").alias("i"), j.alias("j")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("mine").alias("j"))),
            F.transform(F.sequence(F.lit(0), F.col("small_tiles") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j"))),
        )
    )
    tiled = rows.withColumn("at", F.explode(meets)).select("bucket", "at.kind", "at.i", "at.j", "node", "component", "is_major", "n", "signature", "packed")

    def compare(t: pa.Table) -> pa.Table:
        unzip, sets, root = zstandard.ZstdDecompressor(), {}, {}
        node, component = t.column("node").to_pylist(), t.column("component").to_pylist()
        packed, sign = t.column("packed"), _matrix(t.column("signature"))
        largest, n = t.column("is_major").to_numpy(zero_copy_only=False), t.column("n").to_numpy(zero_copy_only=False)
        between = not t.column("kind")[0].as_py()

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = sets_of([unzip.decompress(packed[k].as_py())])[0]
            return sets[k]

        links = []

        def link(k: int, o: int) -> None:
            x, y = find(component[k]), find(component[o])
            root[max(x, y)] = min(x, y)
            links.append((node[k], node[o]))

        if exact:
            may = ~largest[:, None] & (largest if between else ~largest & np.tri(len(n), k=-1, dtype=bool).T)
            own = np.unique(component, return_inverse=True)[1]
            may &= (100 * n >= PERCENT * n[:, None]) & (100 * n[:, None] >= PERCENT * n) & (own != own[:, None])
            for k, o in similar_pairs(packed, n, may):
                if find(component[k]) != find(component[o]):
                    link(k, o)
        for k in [] if exact else np.flatnonzero(~largest).tolist():
            others = np.flatnonzero(largest) if between else np.flatnonzero(~largest[k + 1 :]) + k + 1
            others = others[(100 * n[others] >= PERCENT * n[k]) & (100 * n[k] >= PERCENT * n[others])]  # sets of other sizes are too unlike
            others = others[[find(component[o]) != find(component[k]) for o in others.tolist()]] if len(others) else others
            at, found = survivors(np.broadcast_to(sign[k], (len(others), SIGNATURE)), sign[others], need)
            for o in others[at[np.argsort(-found, kind="stable")]].tolist():
                if find(component[k]) != find(component[o]) and similar(set_of(k), set_of(o)):
                    link(k, o)
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return tiled.groupBy("bucket", "kind", "i", "j").applyInArrow(over_group(compare), "a bigint, b bigint")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (doc_id = component_id) of every row."""
    import pyarrow as pa

    signed = cut(signatures(docs, text, key))
    classes = cut(signed.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    linked = classes.where("node is not null")
    buckets = linked.select("node", F.explode("bands").alias("bucket"))
    # One leader a bucket, drawn anew in each; buckets of one class end here.
    leaders = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "bucket"), "node")).alias("leader")).where("n > 1")
    members = cut(buckets.join(leaders.select("bucket", F.col("leader.node").alias("leader")), "bucket"))
    pairs = members.where("node <> leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    left = cut(prune(pairs, linked))

    involved = members.select("node").distinct()

    def shrink(batches):
        zip_ = zstandard.ZstdCompressor(3)
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0).cast(pa.int64()), pa.array([zip_.compress(b" ".join((x or b"").lower().split())) for x in t.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["node", "packed"])

    own = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).where("node is not null").mapInArrow(over_batches(shrink), "node bigint, packed binary")
    texts = cut(own.join(involved, "node"))

    best = left.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
    links = cut(confirm(best, texts))
    labels = cut(connected(links))
    rest = labelled(left.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    more = cut(confirm(rest, texts))
    if not more.isEmpty():
        labels = cut(joined(labels, more))
    placed = members.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = cut(_residual(cut(placed.select("bucket", "node", "component")), linked, texts))
    if not more.isEmpty():
        labels = cut(joined(labels, more))

    named = classes.select("set", "node").join(labels, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n", "set").join(named, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
