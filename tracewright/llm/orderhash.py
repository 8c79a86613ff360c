"""Order MinHash fingerprints (operator 10). DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let

#: Words of a k-mer, k-mers of a tuple, tuples of a fingerprint (a power of two).
KMER, TUPLE, SIZE = 2, 2, 64
#: A packed k-mer: 32 bits of its hash above 32 bits of its place, so that a plain sort of longs orders by hash.
PLACE = (1 << 32) - 1
#: Ids of one range in the search for neighbours, and ranges at most: more ids make larger ranges.
RANGE, RANGES = 50_000, 2000
#: A word: a letter of a script that is written without spaces, or up to WORD other characters but white space.
WORD = 12
_ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
_WORDS = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]{{1,{WORD}}}"


def _first_at_least(sorted_longs: Column, bound: Column, n: Column) -> Column:
    """How many entries are below ``bound``, by halving steps."""
    steps = F.sequence(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        ahead = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((ahead <= n) & (F.get(sorted_longs, ahead - 1) < bound), ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def signature(text: Column) -> Column:
    """SIZE ints whose share of agreement between two texts falls with their edit distance in words.

    A k-mer is KMER words in a row (all words of a shorter text) and the number of its occurrence, counted from the
    text's start. Words end at white space, after WORD characters, and around letters of scripts without spaces, so a
    text without any is not one word. Under each of SIZE orders the TUPLE least k-mers are taken, put back in text order
    and hashed. The orders are one hash read from SIZE starting points round its range, so a text is hashed and sorted
    once; short texts pay for that with a larger variance, as orders that start in one gap give one tuple.
    """
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))

    def hashed(ws: Column) -> Column:
        rows = F.slice(ws, 1, F.greatest(F.size(ws) - (KMER - 1), F.lit(0)))
        whole = F.transform(rows, lambda h, i: F.xxhash64(h, *[F.get(ws, i + j) for j in range(1, KMER)]))
        return F.when(F.size(ws) >= KMER, whole).otherwise(F.array(F.xxhash64(F.array_join(F.transform(ws, lambda h: h.cast("string")), " "))))

    def packed(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE)))))

    def numbered(s: Column) -> Column:
        """Each k-mer's hash with its occurrence; those of one hash are neighbours, in text order."""
        same = lambda x, i: F.get(s, i).bitwiseXOR(x).bitwiseAND(F.lit(~PLACE)) == 0

        def occurrence(x: Column, i: Column) -> Column:
            steps = F.sequence(F.floor(F.log2(i.cast("double"))).cast("int"), F.lit(0), F.lit(-1))

            def step(at: Column, k: Column) -> Column:
                ahead = at + F.call_function("shiftleft", F.lit(1), k)
                return F.when((ahead <= i) & same(x, i - F.least(ahead, i)), ahead).otherwise(at)

            return F.aggregate(steps, F.lit(0), step)

        def one(x: Column, i: Column) -> Column:
            count = F.when((i > 0) & same(x, F.greatest(i - 1, F.lit(0))), occurrence(x, F.greatest(i, F.lit(1)))).otherwise(0)
            return F.xxhash64(x.bitwiseAND(F.lit(~PLACE)), count).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))

        return F.sort_array(F.transform(s, one))

    def tuples(s: Column) -> Column:
        n = F.size(s)

        def one(j: Column) -> Column:
            start = _first_at_least(s, F.call_function("shiftleft", j.cast("long"), F.lit(64 - SIZE.bit_length() + 1)).bitwiseXOR(F.lit(-(1 << 63))), n)
            return let(start, lambda at: let(F.get(s, at % n), lambda a: let(F.get(s, (at + 1) % n), lambda b: in_order(a, b))))

        def in_order(a: Column, b: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.lit(PLACE))
            first, second = F.when(place(a) <= place(b), a).otherwise(b), F.when(place(a) <= place(b), b).otherwise(a)
            return F.xxhash64(first.bitwiseAND(F.lit(~PLACE)), second.bitwiseAND(F.lit(~PLACE))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

        return F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), one)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda ws: let(packed(hashed(ws)), lambda s: let(numbered(s), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the tuples on which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SIZE))


def text_form(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def neighbours(ids: DataFrame) -> DataFrame:
    """``ids(id, n)`` -> ``(id, prev_id, prev_n)``: whose next document in descending order each id is, round the end.

    Ids are dealt to RANGES ranges at most and led within each; only a row for each range is ordered as a whole.
    Null ids are in no order; of a repeated id, n is the largest.
    """
    unique = ids.filter("id is not null").groupBy("id").agg(F.max("n").alias("n"))
    count = unique.count()
    ranged = cut(unique.repartitionByRange(min(RANGES, max(1, math.ceil(count / RANGE))), F.desc("id")).withColumn("range", F.spark_partition_id()))
    tops = ranged.groupBy("range").agg(F.max("id").alias("top"))
    first = tops.agg(F.max("top")).first()[0]
    following = tops.select("range", F.coalesce(F.lead("top").over(W.orderBy("range")), F.lit(first)).alias("after"))
    inside = ranged.withColumn("next", F.lead("id").over(W.partitionBy("range").orderBy(F.desc("id"))))
    linked = inside.join(following, "range").select("id", "n", F.coalesce("next", "after").alias("next"))
    return linked.select(F.col("next").cast("long").alias("id"), F.col("id").alias("prev_id"), F.col("n").alias("prev_n"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id)``.

    The edited text has its last half of code points replaced by as many first ones of the next document, in
    descending order of ids and after the last the first. Null texts are empty; a text without words has the
    fingerprint of no words. A row without an id has an empty next document. Of rows that share an id, the one with
    the least text is the next document of the id before.

    Texts are shuffled once, with their fingerprints, and the prefixes that neighbours need once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    sizes = rows.select("id", F.length("text").alias("n"))
    repeated = bool(sizes.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).count())
    before = neighbours(sizes).select(F.col("id").cast("string").alias("key"), F.col("prev_id").cast("string").alias("prev_key"), "prev_n")
    # a row without an id matches nothing and is dealt by its text; the key is never null and both joins use all
    # columns, so that one shuffle of the texts, with their signatures, serves both
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none:"), F.xxhash64("text").cast("string")))
    known = rows.withColumn("sig", signature(F.col("text"))).withColumn("key", key)
    gifts = known.join(before.hint("shuffle_hash"), "key").select(
        F.col("prev_key").alias("key"), F.col("id").alias("next_doc_id"), F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("prefix"), F.col("sig").alias("next_sig"), F.col("text").alias("whole")
    )
    if repeated:
        gifts = gifts.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("whole"))).filter("place = 1").drop("place")
    joined = known.join(gifts.drop("whole"), "key", "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.coalesce(F.substring("prefix", F.lit(1), half), F.lit("")))
    done = joined.select("id", "next_doc_id", n.cast("long").alias("n_chars"), "sig", F.coalesce("next_sig", signature(F.lit(""))).alias("next_sig"), edited.alias("edited"))
    done = done.withColumn("edited_sig", signature(F.col("edited")))
    return done.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("sig")).alias("fingerprint"), text_form(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"), "next_doc_id",
    )
