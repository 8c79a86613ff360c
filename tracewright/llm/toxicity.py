"""Toxicity by exact TF-IDF nearest neighbours over a block-max inverted index (operator 8)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Labelled examples taken at most of each class, in order of a hash of the id. All their words are terms.
FIT_TOXIC, FIT_CLEAN = 1000, 2500
#: Neighbours that vote, examples of a block, blocks that are read before any is skipped.
NEIGHBOURS, BLOCK, AHEAD = 25, 32, 8
#: A term is frequent if more than 1/DENSE of the examples have it; texts that are scored at once.
DENSE, BATCH = 32, 64
#: Rows that are given back at once.
OUT = 512
#: A neighbour's vote is its cosine to this power; as much prior weight as PRIOR exact neighbours have.
POWER, PRIOR = 2.0, 0.05
EVIDENCE = 5

_WORD = re.compile(r"\w+")


def texts_of(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow column, BATCH at once: a batch of 10,000 whole texts is not held a second time as strings."""
    for k in range(0, len(column), BATCH):
        yield column.slice(k, BATCH).to_pylist()


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


@dataclass
class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples, as postings by term with the largest weight of each block of examples.

    A term's weight is (1 + log tf) * idf * rf, with the inverse document frequency over all documents and the
    relevance frequency log2(2 + a / max(1, c)) of a toxic and c other examples that have it (tf.idf.rf), so that
    texts are near by what tells the classes apart. The postings of terms that more than 1/DENSE of the examples have
    are rows of a matrix, which a batch of queries is multiplied with. ``slope`` and ``shift`` turn the log odds of the
    votes into a calibrated probability.
    """

    place: dict[str, int]
    weight: np.ndarray
    labels: np.ndarray
    shares: np.ndarray
    ids: np.ndarray
    #: P(toxic) of the labelled documents
    base: float
    slope: float = 1.0
    shift: float = 0.0
    #: blocks of postings that were read, and that were skipped by their bound
    read: int = 0
    skipped: int = 0

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text, in order, and its unit vector over them."""
        known = sorted((self.place[w], n) for w, n in counts.items() if w in self.place)
        if not known:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        return self.unit(*np.array(known, dtype=np.int64).T)

    def unit(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms, in order, and the unit vector of their counts ``n``."""
        if not len(terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        order = np.argsort(terms)
        values = (1 + np.log(n[order])) * self.weight[terms[order]]
        return terms[order], values / np.linalg.norm(values)

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        terms, values = (np.concatenate([np.zeros(0, dtype=k), *(v[i] for v in vectors)]) for i, k in ((0, np.int64), (1, float)))
        examples = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        having = np.bincount(terms, minlength=len(self.place))
        often = np.flatnonzero(having > self.size / DENSE)
        #: the row of each frequent term, or -1
        self.dense = np.full(len(self.place), -1, dtype=np.int64)
        self.dense[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.size))
        is_often = self.dense[terms] >= 0
        self.matrix[self.dense[terms[is_often]], examples[is_often]] = values[is_often]
        order = np.lexsort((examples[~is_often], terms[~is_often]))
        terms, self.example, self.value = terms[~is_often][order], examples[~is_often][order], values[~is_often][order]
        key, first = np.unique(terms * max(1, self.blocks) + self.example // BLOCK, return_index=True)
        #: of term t the entries at[t] to at[t + 1]: block, largest weight in it, postings begin[e] to begin[e + 1]
        self.block, self.begin = key % max(1, self.blocks), np.append(first, len(terms))
        self.top = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.at = np.searchsorted(key // max(1, self.blocks), np.arange(len(self.place) + 1))

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to the cosines of each query with all examples."""
        q = np.zeros((len(queries), len(self.matrix)))
        for i, (terms, values) in enumerate(queries):
            row = self.dense[terms]
            q[i, row[row >= 0]] = values[row >= 0]
        return q @ self.matrix

    def search(self, terms: np.ndarray, values: np.ndarray, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 and their cosines, ties to the lower number; exact.

        ``sums`` are the query's row of ``frequent``. With the maxima of the other terms they bound the cosines of each
        block. The blocks of the highest bounds are read first; postings in blocks whose bound does not reach the k-th
        best cosine of those are never read.
        """
        if not len(terms) or not self.size:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        sums = self.frequent([(terms, values)])[0] if sums is None else sums.copy()
        sizes = self.at[terms + 1] - self.at[terms]
        ends = np.cumsum(sizes)
        entries = np.arange(ends[-1]) + np.repeat(self.at[terms] - ends + sizes, sizes)
        weights = np.repeat(values, sizes)
        blocks = self.block[entries]
        bounds = np.bincount(blocks, weights=self.top[entries] * weights, minlength=self.blocks)
        bounds = bounds + np.maximum.reduceat(sums, np.arange(0, self.size, BLOCK))
        first = np.zeros(self.blocks, dtype=bool)
        first[np.argsort(-bounds, kind="stable")[:AHEAD]] = True
        self.add(sums, entries[first[blocks]], weights[first[blocks]])
        seen = np.repeat(first, BLOCK)[: self.size]
        least = np.partition(sums[seen], -k)[-k] if seen.sum() >= k else 0.0
        rest = ~first & (bounds >= max(least, 1e-9) - 1e-9)
        self.add(sums, entries[rest[blocks]], weights[rest[blocks]])
        self.read += int(first.sum() + rest.sum())
        self.skipped += int(self.blocks - first.sum() - rest.sum())
        found = np.flatnonzero(np.repeat(first | rest, BLOCK)[: self.size] & (sums >= max(least - 1e-9, 1e-12)))
        cosines = np.round(sums[found], 12)
        best = np.lexsort((found, -cosines))[:k]
        return found[best], cosines[best]

    def add(self, sums: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> None:
        """Add the postings of ``entries`` times their weights to ``sums``."""
        if not len(entries):
            return
        sizes = self.begin[entries + 1] - self.begin[entries]
        ends = np.cumsum(sizes)
        postings = np.arange(ends[-1]) + np.repeat(self.begin[entries] - ends + sizes, sizes)
        sums += np.bincount(self.example[postings], weights=self.value[postings] * np.repeat(weights, sizes), minlength=self.size)

    def odds(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the votes of neighbours, each by its distance and by how many labelled documents it stands for."""
        votes = cosines**POWER * self.shares[found]
        toxic = float(votes[self.labels[found] == 1].sum()) + PRIOR * self.base
        clean = float(votes[self.labels[found] == 0].sum()) + PRIOR * (1 - self.base)
        return math.log(max(toxic, 1e-12) / max(clean, 1e-12))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """P(toxic) of each text and its closest examples as (id, cosine, label); without a neighbour the share of toxic documents."""
        out = []
        for k in range(0, len(texts), BATCH):
            queries = [self.vector(words(t)) for t in texts[k : k + BATCH]]
            for (terms, values), sums in zip(queries, self.frequent(queries)):
                found, cosines = self.search(terms, values, NEIGHBOURS, sums)
                if not len(found):
                    out.append((self.base, []))
                    continue
                z = max(-30.0, min(30.0, self.slope * self.odds(found, cosines) + self.shift))
                out.append((1 / (1 + math.exp(-z)), [(int(self.ids[i]), float(c), int(self.labels[i])) for i, c in zip(found[:EVIDENCE], cosines)]))
        return out


def calibrate(odds: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from log odds to labels, by Newton steps on a lightly held likelihood."""
    if not len(odds) or len(np.unique(labels)) < 2:
        return 1.0, 0.0
    beta, x = np.array([1.0, 0.0]), np.stack([odds, np.ones(len(odds))], axis=1)
    # as the curve is held to 1 and 0 by the weight of one document, cleanly parted classes have no infinite slope
    hold = np.array([1.0, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (shares * (labels - p)) - hold * (beta - np.array([1.0, 0.0]))
        bend = (x * (shares * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _frequencies(corpus: DataFrame, place: dict[str, int]) -> tuple[int, np.ndarray]:
    """How many rows ``corpus(text)`` has, and how many have each term; summed within tasks first."""
    shared = corpus.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, rows = shared.value, np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in (t for some in texts_of(batch.column(0)) for t in some):
                if text:
                    sums[[known[w] for w in known.keys() & set(_WORD.findall(text.lower()))]] += 1
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int64()), pa.array([rows, *sums[used].tolist()], pa.int64())], names=["term", "n"])

    counted = corpus.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
    terms, n = (counted.column(c).to_numpy() for c in ("term", "n"))
    found = np.zeros(len(place) + 1, dtype=np.int64)
    found[terms] = n  # -1 is the last
    shared.unpersist()
    return int(found[-1]), found[:-1]


def fit(docs: DataFrame, labels: DataFrame, everything: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> BlockMaxIndex:
    """An index of the labelled ``docs``; document frequencies are counted over ``everything``.

    Of each class FIT_* examples at most are kept; their share stands for all of it. An id with several labels is
    toxic if one of them is; of the rows that share an id, the text that is first by its hash is the example. Null
    labels and ids don't teach. Without examples every score is 0. Each example is scored by the others, and the
    curve from these votes to the labels is the calibration.
    """
    spark = docs.sparkSession
    none = np.zeros(0)
    marked = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y is not null").groupBy("k").agg(F.max(F.expr("int(y > 0)")).alias("y"))
    known = docs.select(F.col(id_col).alias("k")).filter("k is not null").distinct().join(marked, "k")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        index = BlockMaxIndex({}, none, none, none, none, 0.0)
        index.fill([])
        return index
    rank = F.xxhash64("k")
    drawn = known.filter("y = 1").orderBy(rank, "k").limit(FIT_TOXIC).union(known.filter("y = 0").orderBy(rank, "k").limit(FIT_CLEAN)).collect()  # FIT_* ids
    chosen = spark.createDataFrame([(r["k"], r["y"]) for r in drawn], "k long, y int")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    examples = docs.select(F.col(id_col).alias("k"), text.alias("text")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(one.alias("one"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [words(t) for t in batch.column(2).to_pylist()]
            each = [pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *each], names=["k", "y", "words", "ns"])

    counted = examples.select(F.col("k").cast("long").alias("k"), "y", "one.text").mapInArrow(count, "k long, y int, words array<string>, ns array<long>")
    place: dict[str, int] = {}
    got: list[tuple] = []  # (label, most frequent word, id, terms, counts)
    for r in counted.orderBy("k").toLocalIterator():  # words become numbers row by row, so that the driver holds no more
        first = min(zip((-n for n in r["ns"]), r["words"]), default=(0, ""))
        terms = np.array([place.setdefault(w, len(place)) for w in r["words"]], dtype=np.int32)
        got.append((r["y"], first, r["k"], terms, np.array(r["ns"], dtype=np.int32)))
    # toxic ones next to each other, and texts of like words: the blocks' maxima are tighter
    got.sort(key=lambda g: g[:3])
    y = np.array([g[0] for g in got])
    having = np.zeros((2, len(place)))
    for label, _, _, terms, _ in got:
        having[label, terms] += 1
    corpus = (docs if everything is None else everything).select(F.col(text_col).cast("string").alias("text"))
    rows, frequency = _frequencies(corpus, place)
    weight = (np.log((1 + rows) / (1 + frequency)) + 1) * np.log2(2 + having[1] / np.maximum(1, having[0]))
    taken = Counter(y.tolist())
    stands = np.array([sizes[int(v)] / taken[int(v)] for v in y])
    index = BlockMaxIndex(place, weight, y, stands, np.array([g[2] for g in got]), sizes.get(1, 0) / sum(sizes.values()))
    vectors = [index.unit(terms.astype(np.int64), n) for _, _, _, terms, n in got]
    del got
    index.fill(vectors)
    index.slope, index.shift = _calibration(spark, index, vectors)
    return index


def _calibration(spark, index: BlockMaxIndex, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """The curve from the votes of all other examples to each example's label."""
    shared = spark.sparkContext.broadcast((index, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, each = shared.value
        for batch in batches:
            out = []
            for e in batch.column(0).to_pylist():
                found, cosines = model.search(*each[e], NEIGHBOURS + 1)
                other = found != e
                found, cosines = found[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS]
                if len(found):
                    out.append((e, model.odds(found, cosines)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())], names=["e", "odds"])

    # the model goes out once more, calibrated, so this copy is dropped
    got = sorted(spark.range(len(vectors)).repartition(16).mapInArrow(run, "e long, odds double").collect())  # FIT_* rows
    shared.destroy()
    e = np.array([r["e"] for r in got], dtype=np.int64)
    return calibrate(np.array([r["odds"] for r in got]), index.labels[e], index.shares[e] / index.shares.mean())


def score(docs: DataFrame, index: BlockMaxIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, evidence)`` of every row of ``docs``, from the whole text; null texts count as empty.

    evidence: the closest examples with cosine and label. The index is broadcast; FIT_* examples bound its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("example_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [g for some in texts_of(batch.column(1)) for g in shared.value.score(some)]
            evidence = [[{"example_id": i, "cosine": c, "label": y} for i, c, y in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, evidence array<struct<example_id: long, cosine: double, label: int>>")


def predict(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)``: learned outside fold 0, said of every row."""
    own = fold(F.col("doc_id"), folds)
    index = fit(docs.filter(own != 0), labels.filter(own != 0), docs)
    return score(docs, index).select("doc_id", (own == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns and every other row stay.

    The score goes by the text, so rows of one id, and of none, stand or fall each by its own text; null and empty
    texts score as the labelled documents do on the whole, and stay unless half of those are toxic.
    """
    own = fold(F.col(id_col), folds)
    index = fit(docs.filter(own != 0), labels.filter(fold(F.col("doc_id"), folds) != 0).withColumnRenamed("doc_id", id_col), docs, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for k in range(0, batch.num_rows, OUT):  # no second copy of a whole batch, here or on its way back
                part = batch.slice(k, OUT)
                yield part.filter(pa.array([p < 0.5 for some in texts_of(part.column(at)) for p, _ in shared.value.score(some)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
