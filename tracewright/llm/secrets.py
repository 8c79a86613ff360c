"""Secret scan with a randomness test battery (operator 1). DataFrame functions only."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")
#: A candidate is a whole run of encoding characters, so long at least, that has a letter.
MIN_RANDOM = 20
RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{RUN}){RUN}{{{MIN_RANDOM},}}"
#: A word of ordinary text: whole, and not a part of a run.
WORD = rf"(?<!{RUN})[A-Za-z][a-z]+(?!{RUN})"
#: The encodings a run may be of, the narrowest first: what it matches, its alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Share of ordinary runs that may be among the reported ones, within each band of length.
FALSE_SHARE = 0.05
#: A run whose battery is further out than this, in standard deviations of random runs, is not random.
MOST_UNEVEN = 4.0
#: Ordinary runs are made in these lengths, of the bands from FIRST_BAND on; longer ones count as the last.
FIRST_BAND, LENGTHS = 8, (20, 27, 38, 54, 76, 108, 152)
#: So many ordinary words at least are joined in one way, if a text has them.
BLOCK = 60
#: What ordinary runs score is taken to be, with the weight of HELD runs: a mean of LIFT * sqrt(length), less in an
#: alphabet of one case, and a standard deviation of SPREAD.
HELD, LIFT, LIFT_ONE_CASE, SPREAD = 100, 0.7, 0.4, 1.3
#: p-values are compared in steps of 1/STEPS of a decade, down to 10**-DECADES.
STEPS, DECADES = 16, 12
SPAN = "array<struct<start: long, end: long, kind: int>>"


def _running(a: Column) -> Column:
    """Sums of an array of numbers up to each place, by doubling steps."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(a), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, a, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("long"))))


def spans(text: Column, pattern: str, kind: int, gate: Column, least: int = 0, group: int = 0) -> Column:
    """Spans, in code points, of the leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    What the pattern splits off and what it matches alternate, so their lengths add up to the offsets.
    """
    none = F.array().cast(SPAN)

    def placed(m: Column) -> Column:
        lengths = F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["all"])), m["all"], lambda g, t: g + F.length(t))
        each = F.transform(_running(lengths), lambda end, i: F.struct((end - F.length(F.get(m["all"], i))).alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        if least:
            each = F.filter(each, lambda s, i: F.length(F.get(m["part"], i)) >= least)
        return F.when(F.size(m["all"]) == 0, none).otherwise(each.cast(SPAN))

    found = F.struct(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long")).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    return F.when(gate, let(found, placed)).otherwise(none)


def _lower_tail(z: Column) -> Column:
    """P(N < z) for a standard normal N, by a rational approximation good to 1e-7, at least 1e-12."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    far = 0.5 * poly * F.exp(-x * x)
    return F.greatest(F.when(z < 0, far).otherwise(1 - far), F.lit(10.0**-DECADES))


def battery(token: Column) -> Column:
    """STRUCT<score, k> of a run of characters: how uneven it is as a draw from its encoding's alphabet of k symbols.

    score is the sum of three tests over the root of 3, each a standard normal if the run is random and high if it is
    words: chi-squared of the symbol counts, of which mean and variance are exact at every length and the tail is that
    of the gamma distribution they give; too few runs above and below the middle of the alphabet, by the binomial
    number of changes; serial correlation at lag 1. Less than three characters score high.
    """

    def off_middle(letters: str) -> Column:
        """k, and by character code the distance from the middle of the alphabet, none of which is 0 as all alphabets are even."""
        k = len(letters)
        return F.struct(F.lit(float(k)).alias("k"), F.array(*[F.lit(letters.find(chr(i)) - (k - 1) / 2) for i in range(128)]).alias("off"))

    encoding = lambda bare: F.coalesce(*[F.when(bare.rlike(pattern), off_middle(letters)) for pattern, letters in ENCODINGS[:-1]], off_middle(ENCODINGS[-1][1]))

    def placed(v: Column) -> Column:
        table, none = v["e"]["off"], F.get(v["e"]["off"], F.lit(0))  # no alphabet has the character of code 0
        off = F.transform(v["symbols"], lambda c: F.coalesce(F.get(table, F.ascii(c)), none))
        return let(F.struct(v["symbols"].alias("symbols"), off.alias("off"), v["e"]["k"].alias("k"), v["bare"].alias("bare")), products)

    def products(v: Column) -> Column:
        off, n = v["off"], F.greatest(F.size(v["off"]) - 1, F.lit(0))
        lagged = F.zip_with(F.slice(off, F.lit(2), n), F.slice(off, F.lit(1), n), lambda x, y: x * y)
        return let(F.struct(lagged.alias("lagged"), v["symbols"].alias("symbols"), v["k"].alias("k"), v["bare"].alias("bare")), tests)

    def tests(v: Column) -> Column:
        lagged, k = v["lagged"], v["k"]
        length = F.length(v["bare"])
        n = length.cast("double")
        counts = F.transform(F.array_distinct(v["symbols"]), lambda c: length - F.length(F.replace(v["bare"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0), lambda s, c: s + c * c).cast("double")
        chi, mean, variance = squares * k / n - n, k - 1, 2 * (k - 1) * (n - 1) / n
        shape = 9 * mean * mean / variance
        z_chi = (F.pow(chi / mean, F.lit(1 / 3)) - 1 + 1 / shape) * F.sqrt(shape)
        changes = F.size(F.filter(lagged, lambda x: x < 0))
        z_runs = ((n - 1) - 2 * changes) / F.sqrt(n - 1)
        z_serial = F.aggregate(lagged, F.lit(0.0), lambda s, x: s + x) / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.struct(F.when(n < 3, 99.0).otherwise((z_chi + z_runs + z_serial) / math.sqrt(3)).alias("score"), k.cast("int").alias("k"))

    return let(F.regexp_replace(token, "=+$", ""), lambda bare: let(F.struct(bare.alias("bare"), F.split(bare, "").alias("symbols"), encoding(bare).alias("e")), placed))


def band(length: Column) -> Column:
    """Bands of length by powers of the square root of 2."""
    return F.floor(2 * F.log2(length.cast("double"))).cast("int")


def ordinary_run(text: Column) -> Column:
    """A run of ordinary words from somewhere in ``text``, as identifiers, slugs and paths are made; null without enough.

    A hash of the text chooses the place, one of LENGTHS, and how the whole words there are joined: in camel case, by an underline,
    a hyphen, a slash, or as they are. Every third word ends in a number.
    """
    h = F.xxhash64(text)
    length = F.get(F.array(*map(F.lit, LENGTHS)), F.pmod(h, F.lit(len(LENGTHS))).cast("int"))
    form = F.pmod(F.shiftrightunsigned(h, 8), F.lit(5))
    place = F.pmod(F.shiftrightunsigned(h, 16), F.greatest(F.length(text) - 4 * length, F.lit(1))).cast("int")
    ws = F.regexp_extract_all(F.substring(text, place + 1, 4 * length), F.lit(WORD), F.lit(0))
    ws = F.transform(F.slice(ws, 2, 100), lambda w, i: F.when(i % 3 == 2, F.concat(F.lower(w), F.pmod(F.xxhash64(w), F.lit(100)).cast("string"))).otherwise(F.lower(w)))
    joined = F.when(form == 0, F.array_join(F.transform(ws, F.initcap), ""))
    for i, mark in enumerate(("_", "-", "/", "")):
        joined = F.when(form == i + 1, F.array_join(ws, mark)).otherwise(joined)
    return let(joined, lambda j: F.when(F.length(j) >= length, F.substring(j, F.lit(1), length)))


def _evenly(n: Column, least: Column) -> Column:
    """Bounds that part ``n`` things into consecutive parts alike in size, of ``least`` each if there are so many."""
    sized = F.struct(n.cast("long").alias("n"), F.greatest(F.floor(n / least), F.lit(1)).cast("int").alias("parts"))
    return let(sized, lambda v: F.transform(F.sequence(F.lit(0), v["parts"]), lambda i: F.floor(i * v["n"] / v["parts"]).cast("int")))


def ordinary_runs(text: Column) -> Column:
    """All ordinary words of ``text`` as runs, as identifiers, slugs and paths are made; none without enough.

    Every whole word lies in a block of BLOCK words or more, and every character of a joined block in one run. A hash of
    the text and the block's place choose one of LENGTHS, which runs have at least if the block holds it, and how words
    are joined: in camel case, by an underline, a hyphen, a slash, or as they are. Every third word ends in a number.
    The text is hashed once, and each block's hash is taken of that.
    """

    def block(v: Column) -> Column:
        ws = F.transform(v["ws"], lambda w, i: let(F.lower(w), lambda x: F.when(i % 3 == 2, F.concat(x, F.pmod(F.xxhash64(w), F.lit(100)).cast("string"))).otherwise(x)))
        length = F.get(F.array(*map(F.lit, LENGTHS)), F.pmod(v["turn"], F.lit(len(LENGTHS))).cast("int"))
        form = F.pmod(F.shiftrightunsigned(v["turn"], 8), F.lit(5))
        joined = F.when(form == 0, F.array_join(F.transform(ws, F.initcap), ""))
        for i, mark in enumerate(("_", "-", "/", "")):
            joined = joined.when(form == i + 1, F.array_join(ws, mark))
        return let(joined, lambda j: let(_evenly(F.length(j), length), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda x, i: F.substring(j, x + 1, F.get(at, i + 1) - x))))

    def runs(v: Column) -> Column:
        part = lambda at, x, i: F.struct(F.slice(v["words"], x + 1, F.get(at, i + 1) - x).alias("ws"), F.xxhash64(v["hash"], i).alias("turn"))
        each = lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda x, i: let(part(at, x, i), block))
        return F.filter(F.flatten(let(_evenly(F.size(v["words"]), F.lit(BLOCK)), each)), lambda r: F.length(r) >= MIN_RANDOM)

    return let(F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.xxhash64(text).alias("hash")), runs)


def ordinary(runs: DataFrame) -> dict[tuple[int, int], tuple[float, float]]:
    """``runs(run)`` of ``ordinary_run`` or ``ordinary_runs`` -> mean and standard deviation of their scores by alphabet and band of length.

    Sums are by alphabet and band, a bounded number of rows; each takes in what ordinary runs are taken to score.
    """
    scored = runs.filter("run is not null").select(F.least(band(F.length("run")), F.lit(FIRST_BAND + len(LENGTHS) - 1)).alias("band"), battery(F.col("run")).alias("b")).select("band", "b.k", F.col("b.score").alias("s"))
    sums = {(r["k"], r["band"]): r for r in scored.groupBy("k", "band").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q")).collect()}
    found = {}
    for k in sorted({len(letters) for _, letters in ENCODINGS}):
        for i, length in enumerate(LENGTHS):
            r = sums.get((k, FIRST_BAND + i))
            mean = (LIFT if k > 36 else LIFT_ONE_CASE) * math.sqrt(length)
            square = mean * mean + SPREAD * SPREAD
            n = HELD + (r["n"] if r else 0)
            m, q = (HELD * mean + (r["s"] if r else 0)) / n, (HELD * square + (r["q"] if r else 0)) / n
            found[k, FIRST_BAND + i] = (m, math.sqrt(max(q - m * m, 1e-6)))
    return found


def first_bins(tested: DataFrame) -> dict[int, int]:
    """``tested(band, bin)``, a row for each distinct candidate -> the first bin of each band that is reported.

    Benjamini-Hochberg over the hypotheses "this is an ordinary run" of one band: the largest set of least p-values at
    which at most FALSE_SHARE of the set is expected to be ordinary. The p-values come as bins of a fixed number, each
    taken at its upper end, so no more than that reaches the driver.
    """
    by_band: dict[int, dict[int, int]] = defaultdict(dict)
    for r in tested.groupBy("band", "bin").count().collect():
        by_band[r["band"]][r["bin"]] = r["count"]
    found = {}
    for b, counts in by_band.items():
        total, seen, first = sum(counts.values()), 0, STEPS * DECADES + 1
        for step in sorted(counts, reverse=True):
            seen += counts[step]
            if 10 ** (-step / STEPS) <= FALSE_SHARE * seen / total:
                first = step
        found[b] = first
    return found


def _below(ordered: Column, bound: Column, upto: bool) -> Column:
    """How many of the ``ordered`` numbers are below ``bound``, or up to it; by halving steps."""
    n = F.size(ordered)
    steps = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        ahead = at + F.call_function("shiftleft", F.lit(1), k)
        x = F.get(ordered, ahead - 1)
        return F.when((ahead <= n) & ((x <= bound) if upto else (x < bound)), ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)`` of every row of ``docs``.

    spans: ``kind:start:end`` by start, then kind, in code points. Null texts are empty and have no span. The kind
    ``random`` is a run of encoding characters that the battery tells from ordinary runs of its alphabet and length, at
    a bounded share of false reports, and does not tell from random ones; it meets no span of the fixed patterns. What
    ordinary runs score is fitted to runs of words: if ``whole``, of all words of every document, else one of each. Rows
    that repeat are scanned each, rows without an id keep a null; a run that repeats counts once among the tests. An
    empty table gives none, and other columns don't matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(
        spans(text, ASSIGN, 0, text.rlike("(?i)password|passwd|secret|token|api_?key"), MIN_ASSIGN, 2),
        spans(text, ACCESS, 1, text.contains("AKIA"), MIN_ACCESS),
        spans(text, HEX, 2, text.rlike(HEX)),
    )
    runs = F.when(
        text.rlike(CANDIDATE),
        let(F.struct(spans(text, CANDIDATE, 3, F.lit(True)).alias("s"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("t")), lambda v: F.arrays_zip(v["s"].alias("s"), v["t"].alias("t"))),
    ).otherwise(F.array().cast("array<struct<s: struct<start: long, end: long, kind: int>, t: string>>"))
    null = ordinary(docs.select((F.explode(ordinary_runs(text)) if whole else ordinary_run(text)).alias("run")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array_sort(base).alias("base"), runs.alias("runs"))
    starts, ends = (F.sort_array(F.transform("base", lambda b: b[c])) for c in ("start", "end"))

    def free(r: Column) -> Column:
        return F.when(F.size("base") == 0, True).otherwise(_below(F.col("starts"), r["s"]["end"], False) == _below(F.col("ends"), r["s"]["start"], True))

    new = F.filter("runs", lambda r: r["t"].rlike("[A-Za-z]") & free(r))
    known = F.create_map(*[x for (k, b), (m, d) in sorted(null.items()) for x in (F.lit(1000 * k + b), F.array(F.lit(m), F.lit(d)))])

    def tried(r: Column) -> Column:
        limited = F.least(band(F.length(r["t"])), F.lit(FIRST_BAND + len(LENGTHS) - 1))

        def placed(b: Column) -> Column:
            p = let(known[1000 * b["k"] + limited], lambda m: _lower_tail((b["score"] - m[0]) / m[1]))
            step = F.least(F.floor(-F.log10(p) * STEPS), F.lit(STEPS * DECADES)).cast("int")
            return F.struct(r["s"].alias("s"), F.xxhash64(r["t"]).alias("t"), band(F.length(r["t"])).alias("band"), F.when(b["score"] > MOST_UNEVEN, 0).otherwise(step).alias("bin"))

        return let(battery(r["t"]), placed)

    held = cut(rows.withColumns({"starts": starts, "ends": ends}).withColumn("new", F.transform(new, tried)).drop("runs", "starts", "ends"))
    firsts = first_bins(held.select(F.explode("new").alias("r")).select("r.t", "r.band", "r.bin").distinct())
    kept = F.array().cast(SPAN)
    if firsts:
        first = F.create_map(*[F.lit(x) for pair in sorted(firsts.items()) for x in pair])
        kept = F.transform(F.filter("new", lambda r: r["bin"] >= first[r["band"]]), lambda r: r["s"])
    names = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    ordered = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    count = lambda a, k: F.size(F.filter(a, lambda s: s["kind"] == k)).cast("long")
    return held.withColumn("kept", kept).select(
        "doc_id", *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.size("kept").cast("long").alias("n_random"),
        F.sha2(joined(ordered("base")), 256).alias("base_sha256"), joined(ordered(F.concat("base", "kept"))).alias("spans"),
    )
