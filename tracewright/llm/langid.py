"""Language identification by bit-sliced n-gram Bloom filters (operator 2)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Training rows of each language, as an expectation: rows are drawn by a hash at this rate over their number.
FIT_ROWS = 1500
ORDERS = (2, 3, 4)
SLOTS_LOG2, HASHES = 20, 3
#: A language takes an n-gram that at least this share of its training rows has ...
MIN_SHARE = 0.004
#: ... and that is not far rarer in it than in another language.
MIN_RATIO = 0.25
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _letters() -> np.ndarray:
    keep = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            keep[code] = 1
    return keep


_KEEP: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters than letters is one space, as are both ends."""
    if not _KEEP:
        _KEEP.append(_letters())
    x = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = x * _KEEP[0][x]
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])] if len(x) else x


def grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every n-gram of the orders, repeats included."""
    wide, out = x.astype(np.uint64) + np.uint64(1), []
    for n in ORDERS:
        if len(wide) >= n:
            h = np.full(len(wide) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ wide[i : len(wide) - n + 1 + i]) * _MIX[0]
                h ^= h >> np.uint64(29)
            out.append(h * _MIX[1])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


@dataclass
class Filters:
    """Row s of ``slices``: the languages that have a bit at slot s, as a bitmask of a byte for 8 languages."""

    langs: list[str]
    slices: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], members: list[np.ndarray]) -> Filters:
        bits = np.zeros((1 << SLOTS_LOG2, max(1, len(langs))), dtype=np.uint8)
        for i, hashes in enumerate(members):
            for slot in cls.places(hashes):
                bits[slot, i] = 1
        return cls(langs, np.packbits(bits, axis=1), bits.mean(axis=0) ** HASHES)

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << SLOTS_LOG2) - 1)
        return [((h >> np.uint64(i * SLOTS_LOG2 + 2)) & low).astype(np.int64) for i in range(HASHES)]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """For each language the share of the text's n-grams that it has, less the expected false positives."""
        total, counts = 0, np.zeros(len(self.langs), dtype=np.int64)
        for a in range(0, max(1, len(x)), 1 << 16):
            h = grams(x[a : a + (1 << 16) + max(ORDERS) - 1])
            if not len(h):
                continue
            one, *rest = self.places(h)
            mask = self.slices[one]
            for slot in rest:
                mask = mask & self.slices[slot]
            if mask.shape[1] == 1:
                seen = np.bincount(mask[:, 0], minlength=256)
                counts += (seen[:, None] * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).sum(axis=0)[: len(counts)]
            else:
                counts += np.unpackbits(mask, axis=1).sum(axis=0, dtype=np.int64)[: len(counts)]
            total += len(h)
        share = counts / max(1, total)
        return np.clip((share - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        x = codes(text or "")
        if not self.langs or not x.any():
            return "und", 0.0
        share = self.shares(x) ** 4  # sharpened, so that the score tells a clear case from a mixed text
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Filters from rows with a language; a bounded sample by hash of the id, at one rate within a language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters.build([], [])
    langs = sorted(sizes)
    rate = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, FIT_ROWS / sizes[k]))])
    # rows without an id are drawn by their texts
    own = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text"))
    drawn = rows.filter(F.pmod(own, F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows have an n-gram, by language; summed within the task as far as memory allows."""
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(np.unique(grams(codes(text))))
            if sum(len(h) for v in held.values() for h in v) > 4_000_000:
                yield from flush(held)
                held = {}
        yield from flush(held)

    def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(h), 0, dtype=np.int64))],
                names=["lang", "gram", "n", "rows"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([len(parts)], pa.int64())],
                names=["lang", "gram", "n", "rows"],
            )

    counted = drawn.mapInArrow(count, "lang string, gram long, n long, rows long").groupBy("gram", "lang").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    # the n-grams of a bounded sample that MIN_SHARE of its rows have are bounded too
    seen = {r["lang"]: r["rows"] for r in counted.filter("gram is null").collect()}
    langs = sorted(seen)
    if not langs:
        return Filters.build([], [])
    rows_of = F.create_map(*[F.lit(v) for k in langs for v in (k, float(seen[k]))])
    shared = counted.filter("gram is not null").withColumn("share", F.col("n") / rows_of[F.col("lang")])
    top = shared.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each"))
    kept = top.select("gram", F.expr(f"filter(each, e -> e.share >= {MIN_SHARE} and e.share >= {MIN_RATIO} * top).lang").alias("langs")).filter("size(langs) > 0")
    got = kept.toPandas()
    members = {k: [] for k in langs}
    for gram, having in zip(got["gram"], got["langs"]):
        for k in having:
            members[k].append(gram)
    return Filters.build(langs, [np.array(members[k], dtype=np.int64).view(np.uint64) for k in langs])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row; ``und`` with score 0 for a text that is null or has no letter.

    The filters are a broadcast of 2**SLOTS_LOG2 masks of a byte for 8 languages, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.decide(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame, folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from the documents outside fold 0, said of all.

    Null texts, texts without letters and an empty training part give ``und``. Repeated ids keep their rows, null ids stay
    null and are not held out; an empty table gives none. Languages tie to the first by name.
    """
    filters = fit(docs.filter(fold(F.col("doc_id"), folds) != 0))
    return identify(docs, filters).select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
