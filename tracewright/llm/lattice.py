"""Marginal document likelihood over a subword lattice (operator 6)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold

#: A word with more than 1/HOT_TOKENS of all tokens is scored in the pass over the texts; HOT_TOKENS at most.
HOT_TOKENS = 400_000
#: Distinct words that a task sums before it passes them on.
HELD = 300_000
#: The space marker of the vocabulary.
SPACE = "▁"
LOG10 = math.log(10)


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class Lattice:
    """All segmentations of a word into the pieces of an existing vocabulary, bytes included.

    ``logs``: natural log probability of each piece. A character may also be spelled by its bytes.
    """

    def __init__(self, logs: dict[str, float]):
        #: the pieces, and None for what only begins one
        self.steps: dict[str, float | None] = {p[:k]: None for p in logs for k in range(1, len(p))}
        self.steps |= logs
        self.bytes = [logs[f"<0x{b:02X}>"] for b in range(256)]
        self.spelled: dict[str, float] = {}

    def log_marginal(self, word: str) -> float:
        """Log of the sum, over all segmentations, of the product of their pieces' probabilities."""
        steps, spelled, exp, log, n = self.steps, self.spelled, math.exp, math.log, len(word)
        arriving: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = 0.0
        for start in range(n):
            if start:
                terms = arriving[start]
                top = max(terms)
                alpha = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top
            c = word[start]
            by_bytes = spelled.get(c)
            if by_bytes is None:
                by_bytes = spelled[c] = sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
            arriving[start + 1].append(alpha + by_bytes)
            for end in range(start + 1, n + 1):
                piece = word[start:end]
                if piece not in steps:
                    break
                p = steps[piece]
                if p is not None:
                    arriving[end].append(alpha + p)
        top = max(arriving[n], default=0.0)
        return top + log(sum([exp(t - top) for t in arriving[n]])) if n else 0.0


def count_words(docs: DataFrame) -> DataFrame:
    """``docs(t, taught)`` -> ``(word, c, n)``: occurrences in the rows that teach, and in all.

    The word is null for the end token, of which every text has one. Sums are made within a task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other, rows = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, taught in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows[0] += bool(taught)
                rows[1] += 1
                (held if taught else other).update(tokens(text))
                if len(held) + len(other) > HELD:
                    yield flush(held, other, [0, 0])
                    held, other = Counter(), Counter()
        yield flush(held, other, rows)

    def flush(held: Counter, other: Counter, rows: list[int]) -> pa.RecordBatch:
        words = [*held, *other, None]
        c = [*held.values(), *[0] * len(other), rows[0]]
        n = [*held.values(), *other.values(), rows[1]]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

    return docs.select("t", "taught").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_logs(spark: SparkSession, counts: DataFrame, vocabulary_path: str) -> dict[str, float]:
    """Natural log probability of every piece of the vocabulary, with one added to each count.

    The vocabulary's own scores choose the best segmentation of each distinct training word; the pieces used, times
    the word's count, are the unigram weights. Their number is the vocabulary's, whatever the corpus.
    """
    import sentencepiece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
        sums = np.zeros(model.get_piece_size(), dtype=np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            found = model.encode(words, num_threads=1)
            sizes = [len(f) for f in found]
            np.add.at(sums, [i for f in found for i in f], np.repeat(batch.column(1).to_numpy(), sizes))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(sums[used])], names=["piece", "n"])

    taught = counts.filter("word is not null and c > 0").select("word", "c")
    found = taught.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
    pieces = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    sums = {r["piece"]: r["n"] for r in found}
    total = sum(sums.get(i, 0) + 1 for i in pieces)
    return {model.id_to_piece(i): math.log((sums.get(i, 0) + 1) / total) for i in pieces}


def marginals(counts: DataFrame, logs: dict[str, float]) -> DataFrame:
    """``counts`` with ``lm``, the log marginal of each word."""
    shared = counts.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            lm = [lattice.log_marginal(SPACE + w.decode("utf-8", "surrogatepass")) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lm, pa.float64())], names=["word", "c", "n", "lm"])

    return counts.mapInArrow(run, "word binary, c long, n long, lm double")


def score(docs: DataFrame, taught: Column, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row, learned from those ``taught``.

    score is the log10 of the product, over the words, of the probability of going on with a word and of the word's
    marginal over its lattice, times the probability of the end. Words carry their mark of a start, so the
    segmentations of a text are those of its words, and the recursion over a distinct word serves all its
    occurrences. base_score: add-one unigrams over words and the end. Null texts are empty, i.e. one end token; rows
    of one id are scored each. Without rows that teach all counts are 0 and the model is uniform.

    Frequent words are summed in the pass over the texts; the rest go, a row for each text and word, to a join with
    the word's row. No key of that join has more than 1/HOT_TOKENS of the tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(taught, F.lit(False)).alias("taught"))
    counts = cut(count_words(rows))
    n, ends, distinct, every = counts.agg(F.sum("c"), F.sum(F.expr("if(word is null, c, 0L)")), F.sum(F.expr("if(c > 0, 1L, 0L)")), F.sum("n")).first()
    n, ends, distinct, every = n or 0, ends or 0, distinct or 0, every or 0
    table = cut(marginals(counts.filter("word is not null"), piece_logs(spark, counts, vocabulary_path)))
    frequent = table.filter(F.col("n") > every / HOT_TOKENS).select("word", "c", "lm").toPandas()  # HOT_TOKENS rows at most
    bottom = n + distinct + 1
    go_on, stop = math.log((n - ends + 1) / (n + 2)), math.log((ends + 1) / (n + 2))
    each = {w: (int(c > 0), math.log10((c + 1) / bottom), lm + go_on) for w, c, lm in zip(map(bytes, frequent["word"]), frequent["c"].tolist(), frequent["lm"].tolist())}
    shared = spark.sparkContext.broadcast(each)
    end_base = math.log10((ends + 1) / bottom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(tokens(text))
                total, known, base, lm = 1, int(ends > 0), end_base, stop
                for w, k in words.items():
                    total += k
                    got = hot.get(w)
                    if got is None:
                        out.append((row, None, w, k, 0, 0, 0.0, 0.0))
                    else:
                        known += k * got[0]
                        base += k * got[1]
                        lm += k * got[2]
                # the text's own row; no word has a space, so it joins nothing and is dealt out evenly
                out.append((row, doc_id, b" %d" % row, 0, total, known, base, lm))
                row += 1
                if len(out) > 100_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["row", "doc_id", "word", "k", "n_tokens", "known", "base", "lm0"])

    parts = rows.select("doc_id", "t").mapInArrow(run, "row long, doc_id long, word binary, k long, n_tokens long, known long, base double, lm0 double")
    joined = parts.join(table.filter(F.col("n") <= every / HOT_TOKENS).select("word", "c", "lm"), "word", "left")
    k, c = F.col("k"), F.coalesce("c", F.lit(0))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, k).otherwise(0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.when(k > 0, k * F.log10((c + 1) / bottom)).otherwise(0.0)).alias("base_score"),
        (F.sum(F.col("lm0") + F.when(k > 0, k * (F.col("lm") + go_on)).otherwise(0.0)) / LOG10).alias("score"),
    ).drop("row")


def predict(docs: DataFrame, vocabulary_path: str, folds: int = 7, held: int = 2) -> DataFrame:
    """``score`` of every document, learned outside fold ``held``, with ``held_out``."""
    own = fold(F.col("doc_id"), folds)
    got = score(docs, own != held, vocabulary_path)
    return got.withColumn("held_out", fold(F.col("doc_id"), folds) == held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
