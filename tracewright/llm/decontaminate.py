"""Benchmark decontamination by latent semantic retrieval (operator 3)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A passage of the corpus has CELLS cells of STEP words; passages start at each cell. An item's passage has so many words at most.
STEP, CELLS = 16, 2
#: Latent dimensions, extra ones of the range finder, power iterations.
RANK, EXTRA, ROUNDS = 192, 16, 2
#: A benchmark is searched in blocks of so many passages, so that RANK dimensions hold most of each and what is broadcast is bounded.
BLOCK_PASSAGES = RANK * 5 // 2
#: Blocks that one pass over the corpus searches for; their models are what is broadcast.
AT_ONCE = 16
#: For items of fewer words than a passage it falls with the root of their share of one.
MIN_COSINE = 0.4
#: Share of an item's words, in order, that proves a copy; that suffices if the answer is there as well.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Passages that a task holds against the items at once.
BATCH = 4096

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def answer_of(text: str) -> list[str]:
    """Words of an item's last sentence; of its last third if it is one sentence."""
    parts = [w for w in (words(s) for s in re.split(r"[.!?\n]+", text)) if w]
    return parts[-1] if len(parts) > 1 else words(text)[-max(1, len(words(text)) // 3) :]


def starts(n: int) -> range:
    """Where the passages of an item of ``n`` words start."""
    half = STEP * CELLS // 2
    return range(0, max(1, n - half), half)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit of an integer for each place of ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for y in b:
        hit = at.get(y)
        if hit:
            u = rows & hit
            rows = ((rows + u) | (rows - u)) & full
    return len(a) - rows.bit_count()


@dataclass
class Items:
    """A block of the benchmark: terms with their place, the items' words and answers, and their passages."""

    ids: list
    texts: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]
    passages: list[list[int]]
    owner: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        texts = [words(t) for _, t in rows]
        terms: dict[str, int] = {}
        for t in texts:
            for w in t:
                terms.setdefault(w, len(terms))
        passages, owner = [], []
        size = STEP * CELLS
        for i, t in enumerate(texts):
            for start in starts(len(t)):
                passages.append([terms[w] for w in t[start : start + size]])
                owner.append(i)
        return cls([i for i, _ in rows], texts, [answer_of(t) for _, t in rows], terms, passages, np.array(owner, dtype=np.int64))


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark's items, those without a word left out, in blocks of BLOCK_PASSAGES passages or one item."""
    held, n = [], 0
    for r in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        size = len(words(r[1]))
        if held and size and n + len(starts(size)) > BLOCK_PASSAGES:
            yield Items.of(held)
            held, n = [], 0
        if size:
            held.append((r[0], r[1]))
            n += len(starts(size))
    if held:
        yield Items.of(held)


def inverse_frequencies(docs: DataFrame, terms: dict[str, int]) -> np.ndarray:
    """Smoothed inverse document frequency of each term over all of ``docs(text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, rows = shared.value, np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                found = known.keys() & set(words(text))
                sums[[known[w] for w in found]] += 1
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int64()), pa.array([rows, *sums[used].tolist()], pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
    found = {r["term"]: r["n"] for r in counted}
    total = found.get(-1, 0)
    return np.array([math.log((1 + total) / (1 + found.get(i, 0))) + 1 for i in range(len(terms))])


def right_vectors(spark: SparkSession, passages: list[list[int]], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The first right singular vectors (terms x rank) of the unit TF-IDF rows of ``passages``.

    Randomised: the range of A'A is found from a random start by ROUNDS products, each a sum of the partitions'
    own A'(A X); a last one gives the projected Gram matrix. A partial product has the size of the result.
    """
    rows = spark.createDataFrame([(p,) for p in passages], "ids array<int>").repartition(max(1, min(8, len(passages) // 500)))
    r = min(rank + EXTRA, len(idf))

    def product(x: np.ndarray, gram: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast((x.astype(np.float32), idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, idf = shared.value
            out = np.zeros((x.shape[1], x.shape[1]) if gram else x.shape, dtype=np.float32)
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    terms, n = np.unique(ids, return_counts=True)
                    row = n * idf[terms]
                    row = (row / np.linalg.norm(row)).astype(np.float32)
                    y = row @ x[terms]
                    if gram:
                        out += np.outer(y, y)
                    else:
                        out[terms] += np.outer(row, y)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

        parts = rows.mapInArrow(run, "part binary").collect()  # 8 partitions at most
        shape = (x.shape[1], x.shape[1]) if gram else x.shape
        return sum((np.frombuffer(bytes(p["part"]), dtype=np.float32).reshape(shape).astype(float) for p in parts), np.zeros(shape))

    q, _ = np.linalg.qr(np.random.default_rng(42).standard_normal((len(idf), r)))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(product(q, False))
    values, vectors = np.linalg.eigh(product(q, True))
    keep = np.argsort(-values)[: min(rank, len(values))]
    return q @ vectors[:, keep]


class Retriever:
    """Finds a block's items in texts: passages by latent cosine, then by their words in order."""

    def __init__(self, items: Items, idf: np.ndarray, vectors: np.ndarray):
        self.items = items
        #: what a word adds to a passage: its latent vector and its square; then other words, which count as the
        #: items' middle one, and no word
        self.lift = np.zeros((len(idf) + 2, vectors.shape[1] + 1), dtype=np.float32)
        self.lift[: len(idf), :-1] = vectors * idf[:, None]
        self.lift[:-1, -1] = np.append(idf, np.median(idf)) ** 2
        latent = np.stack([self.lift[p, :-1].sum(axis=0) for p in items.passages])
        self.targets = (latent / np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))).T.astype(np.float32)
        lengths = np.array([len(items.texts[i]) for i in items.owner])
        self.least = (MIN_COSINE * np.sqrt(np.minimum(1, lengths / (STEP * CELLS)))).astype(np.float32)
        self.bags = [Counter(t) for t in items.texts]

    def search(self, tokens: list[list[str]]) -> list[dict[int, tuple[float, float, bool]]]:
        """For the words of each text the items found in it: (cosine, share of the item's words in order, answer found)."""
        known, other = self.items.terms, len(self.items.terms)
        found: list[dict] = [{} for _ in tokens]
        ids, docs = [], []
        for d, ws in enumerate(tokens):
            if ws:  # filled up to whole cells with what adds nothing
                ids.append(np.fromiter(map(known.get, ws, repeat(other)), dtype=np.int32, count=len(ws)))
                ids.append(np.full(-len(ws) % STEP, other + 1, dtype=np.int32))
                docs.append((d, -(-len(ws) // STEP)))
        if not docs:
            return found
        flat = np.concatenate(ids).reshape(-1, STEP)
        # in stretches, so that the words of a very long text take little memory
        flat = np.concatenate([self.lift[flat[k : k + BATCH]].sum(axis=1) for k in range(0, len(flat), BATCH)])
        doc = np.repeat([d for d, _ in docs], [n for _, n in docs])
        cell = np.concatenate([np.arange(n) for _, n in docs])
        passages = flat.copy()
        for k in range(1, min(CELLS, len(flat))):  # cells of the same text only
            passages[:-k] += flat[k:] * (doc[k:] == doc[:-k])[:, None]
        passages, norms = np.ascontiguousarray(passages[:, :-1]), np.sqrt(np.maximum(1e-9, passages[:, -1]))
        for a in range(0, len(passages), BATCH):
            cosine = passages[a : a + BATCH] @ self.targets / norms[a : a + BATCH, None]
            for p, t in zip(*np.nonzero(cosine >= self.least)):
                d, i = int(doc[a + p]), int(self.items.owner[t])
                self.verify(found[d], tokens[d], int(cell[a + p]) * STEP, i, float(cosine[p, t]))
        return found

    def verify(self, found: dict, ws: list[str], start: int, i: int, cosine: float) -> None:
        item = self.items.texts[i]
        best = found.get(i)
        if best and best[1] == 1.0:
            return
        region = ws[max(0, start - len(item)) : start + STEP * CELLS + len(item)]
        if sum([self.bags[i][w] for w in self.bags[i].keys() & set(region)]) < PARAPHRASE * len(item):
            return
        share = common_subsequence(item, region) / len(item)
        answer = self.items.answers[i]
        answered = common_subsequence(answer, region) >= ANSWER * len(answer)
        if (share >= COPY or share >= PARAPHRASE and answered) and (not best or share > best[1]):
            found[i] = (max(cosine, best[0] if best else 0.0), share, answered)


def retrievers(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator[list[Retriever]]:
    """The benchmark's blocks, AT_ONCE at once: two passes over the corpus for each such group."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    every = blocks(benchmark, item_col, item_text_col)
    while group := list(islice(every, AT_ONCE)):
        terms: dict[str, int] = {}
        for items in group:
            for w in items.terms:
                terms.setdefault(w, len(terms))
        idf = inverse_frequencies(texts, terms)
        own = [idf[[terms[w] for w in items.terms]] for items in group]
        yield [Retriever(items, i, right_vectors(spark, items.passages, i)) for items, i in zip(group, own)]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, common, answered)``: a row for each document and benchmark item found in it.

    Every item is searched in every passage of every whole text. Null and empty texts and items find nothing; ids that
    repeat or are null give a row each. Ids of items may be of any type. Empty tables give none; other columns don't matter.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id long, item_id {kind}, cosine double, common double, answered boolean")
    ids = benchmark.select(F.col(item_col).cast("string").alias(item_col), item_text_col)
    for group in retrievers(docs, ids, text_col, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    part = batch.slice(k, 64)
                    tokens = [words(t) for t in part.column(1).to_pylist()]
                    rows = [
                        (doc_id, retriever.items.ids[i], *got)
                        for retriever in shared.value
                        for doc_id, found in zip(part.column(0).to_pylist(), retriever.search(tokens))
                        for i, got in sorted(found.items())
                    ]
                    if rows:
                        kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "cosine", "common", "answered"])

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        found = rows.mapInArrow(run, "doc_id long, item_id string, cosine double, common double, answered boolean")
        out = out.union(found.withColumn("item_id", F.col("item_id").cast(kind)))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found; all columns and every other row stay."""
    for group in retrievers(docs, benchmark, text_col, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, texts = [], batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                for k in range(0, batch.num_rows, 64):
                    tokens = [words(t) for t in texts[k : k + 64]]
                    keep += [not any(found) for found in zip(*(retriever.search(tokens) for retriever in shared.value))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
