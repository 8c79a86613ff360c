"""SimHash near-duplicates by a Gray-order hierarchical index (operator 5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lookup

BITS, SHINGLE, SEED = 64, 4, 42
#: Rows of one cell; a larger bucket is dealt over several parts, each pair of its parts a cell.
PART = 4096
#: Codes of a lowest node, nodes of the one above, pairs of nodes that are looked at at once.
LEAF, FAN, CHUNK = 16, 8, 2048
#: Rows over which one index is built: many cells, or one.
STRETCH = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of every word shingle of ``text``, repeats included; 0 if it has no word."""
    words = text.lower().split()  # of bytes: A-Z only, and space, \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: fp the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, as a signed long: the order is the sequence's, begun at its middle."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


class GrayIndex:
    """Codes of W words, sorted by cell and then by Gray rank, under nodes that hold the bits all their codes share.

    A lowest node has LEAF codes in a row, each node above FAN nodes of the level below. The bits in which the shared
    patterns of two nodes differ bound the distance of every pair below them from beneath, so whole pairs of groups go
    at once; so do pairs of nodes without a cell in common. ``pruned`` and ``compared`` count the pairs of nodes that
    went and the pairs of codes that were looked at.
    """

    def __init__(self, codes: np.ndarray, cell: np.ndarray):
        self.codes, self.cell, self.pruned, self.compared = codes, cell, 0, 0
        starts = np.arange(0, len(codes), LEAF)
        ones, zeros = np.bitwise_and.reduceat(codes, starts), np.bitwise_and.reduceat(~codes, starts)
        self.levels = [(ones, zeros, cell[starts], cell[np.minimum(starts + LEAF, len(codes)) - 1])]
        while len(self.levels[-1][0]) > 1:
            ones, zeros, first, last = self.levels[-1]
            starts = np.arange(0, len(ones), FAN)
            self.levels.append((np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts), first[starts], last[np.minimum(starts + FAN, len(ones)) - 1]))

    def leaf_pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of lowest nodes, the first not after the second, that may hold codes of one cell within ``radius``."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            depth, a, b = stack.pop()
            ones, zeros, first, last = self.levels[depth]
            keep = last[a] >= first[b]
            a, b = a[keep], b[keep]
            near = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b])).sum(axis=1, dtype=np.int64) <= radius
            self.pruned += len(a) - int(near.sum())
            a, b = a[near], b[near]
            if not depth:
                yield a, b
                continue
            below, kids = len(self.levels[depth - 1][0]), np.arange(FAN)
            for k in range(0, len(a), CHUNK // FAN):
                x = np.repeat(a[k : k + CHUNK // FAN, None] * FAN + kids, FAN, axis=1).ravel()
                y = np.tile(b[k : k + CHUNK // FAN, None] * FAN + kids, (1, FAN)).ravel()
                ok = (x <= y) & (y < below)
                stack.append((depth - 1, x[ok], y[ok]))

    def near(self, radius: int, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places and distances of pairs of one cell within ``radius`` whose ``group`` differs as their turn comes.

        ``group`` may be changed between the turns: two lowest nodes that are all of one group by then are not read.
        """
        n, own, starts = len(self.codes), np.arange(LEAF), np.arange(0, len(self.codes), LEAF)
        for all_a, all_b in self.leaf_pairs(radius):
            for k in range(0, len(all_a), CHUNK):
                a, b = all_a[k : k + CHUNK], all_b[k : k + CHUNK]
                low, high = np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)
                open_ = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
                p, q = (x[open_, None] * LEAF + own for x in (a, b))
                pi, qi = np.minimum(p, n - 1), np.minimum(q, n - 1)
                wanted = (p[:, :, None] < q[:, None, :]) & (q < n)[:, None, :] & (self.cell[pi][:, :, None] == self.cell[qi][:, None, :])
                wanted &= group[pi][:, :, None] != group[qi][:, None, :]
                row, i, j = np.nonzero(wanted)
                u, v = p[row, i], q[row, j]
                self.compared += len(u)
                apart = np.bitwise_count(self.codes[u] ^ self.codes[v]).sum(axis=1, dtype=np.int64)
                hit = apart <= radius
                yield u[hit], v[hit], apart[hit]

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within ``radius`` that span all components of such pairs, each cell by itself; near pairs first."""
        tree, found = np.arange(len(self.codes)), []
        for u, v, apart in self.near(radius, tree):
            order = np.argsort(apart, kind="stable")
            u, v = u[order], v[order]
            while len(u):
                a, b = tree[u], tree[v]
                keep = a != b
                u, v, high, low = u[keep], v[keep], np.maximum(a, b)[keep], np.minimum(a, b)[keep]
                # each tree hangs on a lower one by its first pair, so no circle comes about
                high, first = np.unique(high, return_index=True)
                tree[high] = low[first]
                found.append((u[first], v[first]))
                while not np.array_equal(up := tree[tree], tree):
                    tree[:] = up
        return tuple(np.concatenate(side) if found else np.empty(0, dtype=np.int64) for side in (list(zip(*found)) or [[], []]))


def masks(radius: int, blocks: int) -> list[int]:
    """Every choice of blocks - radius of the blocks: codes at ``radius`` or less agree on one of them."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search(rows: DataFrame, words: list[str], carried: list[str], step: Callable[[GrayIndex, dict], tuple[np.ndarray, np.ndarray]], part: int | None = None) -> DataFrame:
    """``rows(t, k, id, ...)`` -> ``(a, b)``: ids of the pairs of rows that ``step`` takes from an index of each cell.

    The rows of one (t, k) are a bucket, the index's top node; ``words`` are the columns of a code, ``carried`` those
    that ``step`` gets besides. A bucket above PART is dealt over parts by a hash of the id, and each pair of parts is a
    cell, so no task gets a bucket of any size as a whole. Cells are sorted by Gray rank by Spark.
    """
    part = part or PART
    large = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > part).select("t", "k", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    dealt = rows.join(large, ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.hash("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    columns = ["t", "k", "i", "j", "id", *words, *carried]
    cells = dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).withColumn("rank", gray_rank(F.col(words[0])))
    ordered = cells.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "rank").select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in _ahead(batches):
            if batch is not None:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rows += batch.num_rows
            if not rows or batch is not None and rows < STRETCH:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            stop = len(cols[0]) if batch is None else int(change[-1]) if len(change) else 0  # the last cell may go on
            held, rows = [[c[stop:] for c in cols]], len(cols[0]) - stop
            cell = np.zeros(stop, dtype=np.int64)
            cell[change[change < stop]] = 1
            cell = np.cumsum(cell)
            several = (np.bincount(cell) > 1)[cell] if stop else np.zeros(0, dtype=bool)
            if several.any():
                here = dict(zip(columns, (c[:stop][several] for c in cols)))
                index = GrayIndex(np.stack([here[w].view(np.uint64) for w in words], axis=1), cell[several])
                a, b = step(index, here)
                yield pa.RecordBatch.from_arrays([pa.array(here["id"][a]), pa.array(here["id"][b])], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(codes: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Distinct ``codes(fp)`` -> ``(a, b)``: a spanning forest of the links in each bucket, so components are exact.

    The top nodes are the codes that share one masked pattern: by pigeonhole, codes within ``radius`` agree on
    ``blocks - radius`` of the blocks. Below, the index by Gray rank decides. Fewer blocks are fewer copies of each
    code and larger buckets; by default there are the fewest whose buckets are a cell or less on average. Every choice
    gives the same components.
    """
    if blocks is None:
        n = codes.count()
        blocks = next((b for b in range(radius + 1, radius + 4) if n <= PART << (BITS * (b - radius) // b)), radius + 4)
    keyed = codes.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius, blocks)])).alias("t", "k"), F.col("fp").alias("id"), F.col("fp").alias("code"))
    return search(keyed, ["code"], [], lambda index, _: index.forest(radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, blocks: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row per row of ``docs``.

    Documents link when their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest id
    reachable. A null text counts as empty; texts without words have fingerprint zero and link like any other. A null
    id takes part in links but is never a component_id, unless no member has an id. Repeated ids keep their rows; an
    empty table gives none; other columns don't matter. Each distinct fingerprint is searched once, however many
    documents have it.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(classes.select("fp"), radius, blocks))
    joined = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    found = joined.join(least, "root").select("fp", "component_id", "copies")
    return lookup(prints, found, "fp", "copies", "doc_id").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
