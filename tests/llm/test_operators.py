"""Each operator on small fixtures: brute force, round trips, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, langid, lattice, lines, meeting, orderhash, packing, queries, secrets, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " \t\n", "a", "same text here", "same text here", "x" * 30000, "é ́ ß 漢字 🙂 \x1c", "word " * 5000, "\n\n\n"]


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfglmn')}{rng.randrange(vocabulary)}a" for _ in range(n))


def test_hot_lookup_keeps_every_row(spark):
    left = spark.createDataFrame([(i, 7 if i < 3000 else i) for i in range(4000)], "id long, key long")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("key % 2 = 1")
    got = common.lookup(left, right, "key", "n", "id")
    assert got.count() == 4000 and got.filter("key = 7 and top = 2999").count() == 3000 and got.filter("key % 2 = 0 and top is not null").count() == 0


def test_components_are_exact(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {n: find(n) for p in pairs for n in p if find(n) != n or n in got} and all(v == find(k) for k, v in got.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def spans_of(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def slow_battery(token):
    bare = re.sub("=+$", "", token)
    letters = next(a for pattern, a in secrets.ENCODINGS if re.search(pattern, bare))
    k, codes = len(letters), [letters.index(c) for c in bare]
    n = len(codes)
    if n < 3:
        return 99.0, k
    chi = sum(c * c for c in collections.Counter(codes).values()) * k / n - n
    mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
    shape = 9 * mean * mean / variance
    z = ((chi / mean) ** (1 / 3) - 1 + 1 / shape) * math.sqrt(shape)
    z += ((n - 1) - 2 * sum((a < k / 2) != (b < k / 2) for a, b in zip(codes, codes[1:]))) / math.sqrt(n - 1)
    mid = (k - 1) / 2
    z += sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    return z / math.sqrt(3), k


def slow_ordinary_run(text):
    def signed(b):
        h = xxhash.xxh64_intdigest(b, 42)
        return h - (1 << 64) if h >> 63 else h

    h = signed(text.encode())
    length = secrets.LENGTHS[h % len(secrets.LENGTHS)]
    u = h % (1 << 64)
    form, place = (u >> 8) % 5, (u >> 16) % max(1, len(text) - 4 * length)
    ws = re.findall(secrets.WORD, text[place : place + 4 * length])[1:101]
    ws = [w.lower() + (str(signed(w.encode()) % 100) if i % 3 == 2 else "") for i, w in enumerate(ws)]
    joined = "".join(w.capitalize() for w in ws) if form == 0 else ["_", "-", "/", ""][form - 1].join(ws)
    return joined[:length] if len(joined) >= length else None


def slow_random_spans(texts):
    """The random spans of each text, by the rules of the operator and plain loops."""
    last = secrets.FIRST_BAND + len(secrets.LENGTHS) - 1
    sums = collections.defaultdict(list)
    for t in texts:
        run = slow_ordinary_run(t)
        if run:
            s, k = slow_battery(run)
            sums[k, int(2 * math.log2(len(run)))].append(s)

    def p(token):
        s, k = slow_battery(token)
        b = min(int(2 * math.log2(len(token))), last)
        length = secrets.LENGTHS[b - secrets.FIRST_BAND]
        mean = (secrets.LIFT if k > 36 else secrets.LIFT_ONE_CASE) * math.sqrt(length)
        found, n = sums[k, b], secrets.HELD + len(sums[k, b])
        m, q = (secrets.HELD * mean + sum(found)) / n, (secrets.HELD * (mean * mean + secrets.SPREAD**2) + sum(x * x for x in found)) / n
        return 1.0 if s > secrets.MOST_UNEVEN else max(1e-12, 0.5 * math.erfc(-(s - m) / math.sqrt(2 * max(q - m * m, 1e-6))))

    tested, runs = {}, []
    for t in texts:
        base = [tuple(map(int, x.split(":")[1:])) for x in spans_of(t).split(",") if x]
        own = [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
        own = [r for r in own if re.search("[A-Za-z]", r[2]) and not any(a < r[1] and r[0] < b for a, b in base)]
        runs.append(own)
        tested |= {r[2]: min(int(-math.log10(p(r[2])) * 16), 192) for r in own}
    first = {}
    for b in {int(2 * math.log2(len(t))) for t in tested}:
        bins = [v for t, v in tested.items() if int(2 * math.log2(len(t))) == b]
        first[b] = min([v for v in bins if 10 ** (-v / 16) <= secrets.FALSE_SHARE * sum(x >= v for x in bins) / len(bins)], default=999)
    return [[(a, b) for a, b, t in own if tested[t] >= first[int(2 * math.log2(len(t)))]] for own in runs]


B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ORDINARY = [
    "getUserAccountById2FromCache", "ISO8859_1_EncodingTableEntry", "/usr/local/lib/python3/site-packages", "my-very-long-article-slug-about-2024-elections",
    "INTERNAL_SERVER_ERROR_HANDLER", "HelloWorldThisIsCamelCase", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ACGTACGTTGCAACGTTTGACCA", "------------------------------",
    "AbstractSingletonProxyFactoryBean", "org/apache/spark/sql/catalyst/optimizer/Optimizer", "test_that_every_row_is_kept_2", "application/vnd-openxmlformats-officedocument",
]


def test_secrets_equal_brute_force(spark):
    rng = random.Random(3)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["é token = 'abcdef' PASSWORD:abc secret:token:abcdefg", "AKIA" + key("ABC123", 16) + " AKIAX " + key("0123456789abcdef", 24), 'API_KEY="' + key(B64, 30) + '"', *ODD]
    texts += [f"é🙂 {prose(i, 60)} {key(B64[rng.randrange(30) :], rng.randrange(20, 80))} and {rng.choice(ORDINARY)} " + key("abcdef", 5) for i in range(150)]
    texts += ["token = " + key(B64, 40) + " " + key(B64, 40) + "-" + key("0123456789abcdef", 30), "", "Zażółć" + key(B64, 50)]
    rows = secrets.scan(docs(spark, texts)).orderBy("doc_id").collect()
    want = slow_random_spans([t or "" for t in texts])
    for t, r, w in zip(texts, rows, want):
        assert r["base_sha256"] == hashlib.sha256(spans_of(t or "").encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.startswith("random")] == [f"random:{a}:{b}" for a, b in w] and r["n_random"] == len(w)
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == [x for x in spans_of(t or "").split(",") if x]
    assert sum(r["n_random"] for r in rows) > 50
    assert secrets.scan(empty(spark)).count() == 0


def test_false_reports_are_few_and_keys_are_found(spark):
    """Real words joined as names, slugs and paths against random keys, of each length."""
    rng = random.Random(4)
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    names, keys = [], []
    for _ in range(3000):
        ws = re.findall("[A-Za-z]{2,}", rng.choice(texts))[5:25]
        mark = rng.choice(["", "_", "-", "/"])
        ws = [w + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for w in ws]
        name = mark.join(w.capitalize() if not mark and rng.random() < 0.8 else w.lower() for w in ws)[: rng.randrange(20, 90)]
        if len(name) >= 20:
            names.append(name)
    keys = [("".join(rng.choice(B64[:62]) for _ in range(n))) for n in (20, 24, 32, 44, 64) for _ in range(200)]
    keys += ["".join(rng.choice(B64[:52]) for _ in range(44)) for _ in range(200)]  # without a digit
    df = docs(spark, [f"see {t} there" for t in names + keys])
    found = [r["n_random"] for r in secrets.scan(df).orderBy("doc_id").collect()]
    false, by_length = sum(found[: len(names)]), [sum(found[len(names) + i : len(names) + i + 200]) / 200 for i in range(0, 1200, 200)]
    print(f"{false} of {len(names)} ordinary runs and {by_length} of keys of 20, 24, 32, 44, 64 and 44 letters are reported")
    assert false <= 0.05 * sum(found) and by_length[3] >= 0.85 and by_length[4] >= 0.97 and by_length[5] >= 0.7


def test_a_text_of_very_many_matches_takes_little_time(spark):
    text = " ".join(f"token=abc{i:06d}" for i in range(64000)) + " " + "x1Y" * 9
    df = docs(spark, [text]).cache()
    df.count()
    secrets.scan(docs(spark, ["token=abcdefgh"])).collect()
    began = time.time()
    row = secrets.scan(df).collect()[0]
    took = time.time() - began
    print(f"64,000 matches in {took:.1f} s")
    assert row["n_assign"] == 64000 and row["base_sha256"] == hashlib.sha256(spans_of(text).encode()).hexdigest() and took < 10


# 2


def test_language_of_clear_texts_and_of_none(spark):
    rng = random.Random(5)
    said = {"en": ["the", "than", "thing", "with", "of", "ought"], "fr": ["eau", "queue", "étre", "oie", "dans"], "xx": ["zrk", "kzz", "rzk", "zzrk"]}
    rows = [(i, " ".join(rng.choice(said[k]) for _ in range(40)), k, "s", 1) for i, k in enumerate(list(said) * 60)]
    rows += [(1000, None, "en", "s", 0), (1001, "1 2 !!", "en", "s", 0), (1002, "", None, "s", 0)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, *_ in rows[:180]) and {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["held_out"] == (zlib.crc32(b"0") % 5 == 0)
    assert langid.predict(empty(spark)).count() == 0


def test_bloom_slices_return_every_language_of_a_gram():
    grams = [np.arange(k * 100, k * 100 + 150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(20)]
    f = langid.Filters.build([str(k) for k in range(20)], grams)
    mask = None
    for slot in f.places(grams[3]):
        mask = f.slices[slot] if mask is None else mask & f.slices[slot]
    bits = np.unpackbits(mask, axis=1)[:, :20]
    assert bits[:, 3].all() and bits[100:, 4].all() and bits.sum() < 150 + 100 + 60


def slow_languages(rows):
    """What ``predict`` says, by plain sets: every row teaches, as there are fewer than FIT_ROWS of a language."""
    def codes(t):
        return re.sub(r"(?:[\W\d_])+", " ", f" {t} ".lower()) if t else " "

    def hashes(t):
        x = langid.codes(t)
        return langid.grams(x)

    taught = [(k, set(hashes(t).tolist())) for i, t, k, *_ in rows if k and t is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({k for k, _ in taught})
    n = collections.Counter(k for k, _ in taught)
    having = collections.defaultdict(collections.Counter)
    for k, hs in taught:
        for h in hs:
            having[h][k] += 1
    members = {k: set() for k in langs}
    for h, c in having.items():
        top = max(c[k] / n[k] for k in langs)
        for k in langs:
            if c[k] / n[k] >= langid.MIN_SHARE and c[k] / n[k] >= langid.MIN_RATIO * top:
                members[k].add(h)
    said = {}
    for i, t, *_ in rows:
        hs = hashes(t or "").tolist()
        if not codes(t).strip():
            said[i] = ("und", 0.0, 0.0)
            continue
        share = [sum(h in members[k] for h in hs) / len(hs) for k in langs]
        order = sorted(share, reverse=True)
        said[i] = (langs[share.index(max(share))], max(share) ** 4 / max(1e-12, sum(x**4 for x in share)), order[0] - (order + [0])[1])
    return said


def test_languages_equal_plain_sets(spark):
    """Without Bloom filters: where two languages are not within the filters' error of each other, both say the same."""
    rng = random.Random(15)
    stems = {"en": "the and thing with ought".split(), "fr": "eau queue étre oie dans".split(), "de": "und nicht schön straße der".split(), "ja": "これは ペン です 日本 語".split()}
    rows = []
    for i in range(240):
        k = rng.choice(list(stems))
        mixed = stems[k] + rng.choice(list(stems.values()))[:2]
        rows.append((i, " ".join(rng.choice(mixed) + rng.choice(["", "a", "en"]) for _ in range(rng.randrange(1, 60))), k if rng.random() < 0.9 else None, "s", 1))
    rows += [(900 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, DOCS)).collect()}
    want = slow_languages(rows)
    clear = [i for i, w in want.items() if w[2] > 0.02 or w[0] == "und"]
    assert len(clear) > 200 and all(got[i]["lang_pred"] == want[i][0] and abs(got[i]["score"] - want[i][1]) < 0.02 for i in clear)


def test_rows_without_an_id_are_sampled_as_well(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 100)
    seen = []
    monkeypatch.setattr(langid.Filters, "build", classmethod(lambda cls, langs, members, real=langid.Filters.build: seen.append(sum(map(len, members))) or real(langs, members)))
    rng = random.Random(3)
    rows = [(None, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)), "en", "s", 1) for i in range(3000)]
    monkeypatch.setattr(langid, "MIN_SHARE", 0.0)
    langid.fit(spark.createDataFrame(rows, DOCS))
    everything = len(set(np.concatenate([langid.grams(langid.codes(r[1])) for r in rows]).tolist()))
    assert 0 < seen[0] < everything / 3


def test_held_out_languages_of_the_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.predict(df).filter("held_out").join(df.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    print(f"{right} of {n} held-out documents")
    assert n > 1000 and right >= 0.99 * n


# 3


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == lcs(a, b)


def test_leaks_and_paraphrases_are_found_and_others_left(spark):
    items = [(i, prose(100 + i, 18 + 3 * i) + ". " + prose(500 + i, 5)) for i in range(12)] + [(90, None), (91, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, truth = [*ODD], set()
    for i, (item, text) in enumerate(items[:12]):
        w = text.split()
        truth.add((len(texts), item))
        texts.append(prose(i, 400) + " " + text.upper() + " " + prose(i + 50, 300))
        changed = [x if j % 6 else "changed" for j, x in enumerate(w)]
        truth.add((len(texts), item))
        texts.append(prose(i + 900, 90) + "\n" + " ".join(changed[:-5] + w[-5:]))
        texts.append(prose(i + 700, 200) + " " + " ".join(w[: len(w) // 4]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, texts), bench).collect()}
    assert got == truth
    left = decontaminate.remove(docs(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in truth} and left.columns == docs(spark, []).columns
    assert decontaminate.find(docs(spark, texts), bench.limit(0)).count() == 0 and decontaminate.find(empty(spark), bench).count() == 0


def test_right_vectors_are_those_of_a_full_decomposition(spark):
    rng = random.Random(4)
    passages = [[rng.randrange(60) for _ in range(12)] for _ in range(40)]
    idf = np.linspace(1, 3, 60)
    a = np.zeros((40, 60))
    for i, p in enumerate(passages):
        for w in p:
            a[i, w] += idf[w]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = decontaminate.right_vectors(spark, passages, idf, 40)
    assert np.allclose(a @ v @ v.T, a, atol=1e-3)


# 4


def line_words(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).split()


def distance(a, b, most):
    """Edit distance over words, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def alike(x, y):
    most = int(max(len(x), len(y)) * 0.2 + 1e-9)
    # what two lines have in common bounds their distance, so that few are compared word by word
    return max(len(x), len(y)) - sum((collections.Counter(x) & collections.Counter(y)).values()) <= most and distance(x, y, most) <= most


def brute_lines(df):
    """Text by id after deduplication, every pair of distinct lines looked at; rows have an id of their own."""
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()))
    table = {}
    for _, t in rows:
        for line in (t or "").split("\n"):
            if line_words(line):
                table.setdefault(" ".join(line_words(line)), line_words(line))
    root = {k: k for k in table}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(table, key=lambda k: len(table[k]))
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(table[a]) < 0.8 * len(table[b]):
                break
            if find(a) != find(b) and alike(table[a], table[b]):
                root[find(a)] = find(b)
    seen, texts = set(), {}
    for i, t in rows:
        left = []
        for line in (t or "").split("\n"):
            group = find(" ".join(line_words(line))) if line_words(line) else None
            if group not in seen:
                left.append(line)
            if group:
                seen.add(group)
        texts[i] = "\n".join(left) if t is not None else None
    return texts


@pytest.mark.parametrize("few", [16, 2])
def test_lines_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(meeting, "FEW", few)
    rng = random.Random(6)
    base = [prose(i, 12, 300) for i in range(25)]
    texts = []
    for _ in range(60):
        out = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "other"
            out.append((" " * rng.randrange(1, 3)).join(w).title() if rng.random() < 0.3 else " ".join(w))
        texts.append("\n".join(out))
    df = docs(spark, [*texts, *[t for t in ODD if t != "same text here"], "same text here", "| a | b |", "| c | d |"])
    want = brute_lines(df)
    assert {r["doc_id"]: r["text"] for r in lines.deduplicate(df).collect()} == want
    assert sum((want[i] or "").count("\n") + 1 for i in range(60)) < sum(t.count("\n") + 1 for t in texts) - 60


def test_lines_with_clashing_columns_repeats_and_nothing(spark):
    names = "doc_id long, text string, line long, kept string, _doc int, doc int, places int, _places int, own int, again int, n_removed int, m map<string,int>"
    more = (1, 2, 3, 4, 5, 6, 7, {"a": 1})
    df = spark.createDataFrame([(1, "a b c d e\nq\n\n", 5, "x", *more), (1, "a b c d e\nq\n\n", 5, "x", *more), (None, "a b c d e", 6, "y", *more), (None, None, 6, "y", *more)], names)
    got = [tuple(r) for r in lines.deduplicate(df).collect()]
    want = [(1, "q\n\n", 5, "x", *more), (1, "\n", 5, "x", *more), (None, "a b c d e", 6, "y", *more), (None, None, 6, "y", *more)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.deduplicate(empty(spark)).count() == 0


def test_a_very_common_word_pair_makes_few_pairs(spark, monkeypatch):
    """Lines that share a pair and no more fall into small buckets, and those among them that are alike still meet."""
    made = []
    monkeypatch.setattr(lines, "_similar", lambda a, b, real=lines._similar: real(a, b))
    monkeypatch.setattr(meeting, "stored", lambda df, real=meeting.stored: made.append(real(df)) or made[-1])
    rng, texts = random.Random(12), []
    for i in range(600):
        w = [f"{rng.choice('bcdf')}{rng.randrange(10**6)}" for _ in range(20)]
        w[10:12] = ["extraordinarily", "commonplace"]
        texts.append(" ".join(w))
    texts += [t.replace("commonplace", "commonplace indeed") for t in texts[:20]]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(docs(spark, texts)).collect()}
    assert [i for i, t in got.items() if not t] == list(range(600, 620))
    assert made[-1].columns == ["a", "b"]


def test_very_many_removed_lines_take_little_time(spark):
    text = "\n".join(f"line number {i} of this text" for i in range(30000))
    began = time.time()
    got = lines.deduplicate(docs(spark, [text, text + "\nmore"]), counts=("n", "gone")).collect()
    assert {r["doc_id"]: (r["n"], r["gone"]) for r in got}[1] == (30001, 30000) and time.time() - began < 120


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_of_changed_lines_by_length(spark, share):
    """Real lines with a share of the words replaced, left out or doubled, each with its original: at least nine of ten meet at every length."""
    rng = random.Random(int(100 * share))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    pool = collections.defaultdict(list)
    for t in texts:
        for line in (t or "").split("\n"):
            n = len(line_words(line))
            if n >= 5:
                pool[min(n // 10, 4)].append(line_words(line))
    rows, of = [], {}
    for length, found in pool.items():
        for w in rng.sample(found, 250):
            copy = list(w)
            for at in sorted(rng.sample(range(len(w)), max(1, int(share * len(w)))), reverse=True):
                copy[at : at + 1] = [[rng.choice(rng.choice(found))], [], [copy[at], "more"]][rng.choice([0, 0, 1, 2])]
            if copy != w and alike(w, copy):
                of[len(rows) + 1] = length
                rows += [" ".join(w), " ".join(copy)]
    each = lines._occurrences(docs(spark, rows).select(F.col("doc_id").alias("id"), F.lit(0).alias("doc"), "text"))
    distinct = each.groupBy("line").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))
    root = {r["node"]: r["root"] for r in common.components(lines.links(each, distinct)).collect()}
    line = {r["id"]: root.get(r["line"], r["line"]) for r in each.select("id", "line").collect()}
    for length in pool:
        copies = [i for i, n in of.items() if n == length]
        met = sum(line[i] == line[i - 1] for i in copies)
        print(f"share {share} of the words, {10 * length} words and more: {met} of {len(copies)} meet")
        assert met >= 0.9 * len(copies) and len(copies) > 100


# 5


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand():
    for t in [*ODD, prose(1, 50), prose(2, 9000)]:
        assert simhash.fingerprint((t or "").encode()) == slow_print(t)


def components_of(codes, radius):
    label = np.arange(len(codes))
    near = [np.flatnonzero(np.bitwise_count(codes ^ c) <= radius) for c in codes]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def rank_of(codes):
    codes = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        codes ^= codes >> np.uint64(s)
    return codes


def check_forest(codes, cell, want):
    index = simhash.GrayIndex(codes[:, None], cell)
    a, b = index.forest(4)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (int(codes[x]) ^ int(codes[y])).bit_count() <= 4 and cell[x] == cell[y] and find(x) != find(y)
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(codes))] == want.tolist()
    return index


@pytest.mark.parametrize("size", [1, 2, 70, 700])
def test_index_forest_spans_the_links(size):
    rng = np.random.default_rng(size)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    codes = seeds[rng.integers(0, 12, size)]
    for _ in range(5):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64))
    codes = np.unique(codes)
    codes = codes[np.argsort(rank_of(codes))]
    check_forest(codes, np.zeros(len(codes), dtype=np.int64), components_of(codes, 4))
    cell = np.sort(rng.integers(0, 5, len(codes)))  # no pair of two cells is linked
    parts = [np.flatnonzero(cell == c) for c in range(5)]
    check_forest(codes, cell, np.concatenate([p[components_of(codes[p], 4)] for p in parts if len(p)]))


def test_index_decides_and_prunes_on_the_given_documents():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    codes = np.unique(np.array([simhash.fingerprint((t or "").encode()) for t in set(texts)], dtype=np.uint64))
    codes = codes[np.argsort(rank_of(codes))]
    index = check_forest(codes, np.zeros(len(codes), dtype=np.int64), components_of(codes, 4))
    # without masks, as one cell: what the shared patterns alone save
    assert 0 < index.compared < 0.75 * len(codes) ** 2 / 2 and index.pruned > 1000


@pytest.mark.parametrize("blocks", [None, 5, 6, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "PART", 40)  # so that buckets are dealt over parts
    texts = [*ODD]
    for i in range(12):
        w = prose(i, 120).split()
        for j in range(15):
            x = list(w)
            for _ in range(j % 4):
                x[(7 * j + 3 * _) % 120] = f"new{j}"
            texts.append(" ".join(x))
    df = docs(spark, texts)
    codes = np.array([slow_print(t) for t in texts], dtype=np.uint64)
    want = components_of(codes, 4)
    rows = simhash.near_duplicates(df, blocks=blocks).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in rows] == [f"{int(c):016x}" for c in codes] and [r["component_id"] for r in rows] == want.tolist()


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "a b", 1), (None, "q r", 2), (None, "q r", 2)], "doc_id long, text string, fp long")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (None, None): 2}
    assert simhash.near_duplicates(empty(spark)).count() == 0


# 6


def test_lattice_is_the_sum_of_all_segmentations():
    logs = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -3.0, "bca": -2.5, **{f"<0x{x:02X}>": -6.0 for x in range(256)}}
    m = lattice.Lattice(logs)

    def brute(w):
        if not w:
            return 1.0
        total = math.exp(-6.0 * len(w[0].encode())) * brute(w[1:])
        return total + sum(math.exp(logs[w[:k]]) * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in logs)

    for w in ["", "a", "abc", "abcab", "é", "bcabcé", "zzz"]:
        assert math.isclose(m.log_marginal(w), math.log(brute(w)), abs_tol=1e-9)


@pytest.mark.parametrize("hot", [400_000, 20])
def test_document_scores_add_up(spark, monkeypatch, hot):
    monkeypatch.setattr(lattice, "HOT_TOKENS", hot)
    texts = [*ODD, *[prose(i, 60, 50) for i in range(25)]]
    rows = {r["doc_id"]: r for r in lattice.predict(docs(spark, texts), PIECES).collect()}
    counts, ends = collections.Counter(), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in enumerate(texts):
        w, r = (t or "").encode().lower().split(), rows[i]
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*[counts[x] for x in w], ends])
        assert r["train_tokens"] == n and r["n_tokens"] == len(w) + 1 and r["n_known"] == 1 + sum(counts[x] > 0 for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert rows[4]["score"] == rows[5]["score"]
    assert lattice.predict(empty(spark), PIECES).count() == 0


def test_scores_are_those_of_the_whole_lattice(spark):
    """The score of a text: a recursion over the text as one string, with weights counted by the tokenizer itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["the cat sat on the mat", "A mat, a CAT!", "über die straße", "the the the", "", None, "unseenword xyzzy 漢字", "cat mat rat"]
    taught = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    used = collections.Counter()
    for t in taught:
        for w in t.encode().lower().decode().split():
            used.update(model.encode(w))
    pieces = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    total = sum(used[i] + 1 for i in pieces)
    logs = {model.id_to_piece(i): math.log((used[i] + 1) / total) for i in pieces}
    n = sum(len(t.split()) for t in taught)
    go_on, stop = math.log((n + 1) / (n + len(taught) + 2)), math.log((len(taught) + 1) / (n + len(taught) + 2))
    rows = {r["doc_id"]: r["score"] for r in lattice.predict(docs(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().decode().split()
        line = "".join("▁" + w for w in words)
        alpha = [1.0] + [0.0] * len(line)
        for end in range(1, len(line) + 1):
            for start in range(max(0, end - 20), end):
                piece = line[start:end]
                if "▁" not in piece[1:] and piece in logs:
                    alpha[end] += alpha[start] * math.exp(logs[piece])
            spelled = line[end - 1]
            alpha[end] += alpha[end - 1] * math.exp(sum(logs[f"<0x{b:02X}>"] for b in spelled.encode()))
        want = (math.log(alpha[-1]) + len(words) * go_on + stop) / math.log(10)
        assert math.isclose(rows[i], want, rel_tol=1e-9), t


# 7


def test_revisits_name_their_responses(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>" + "z" * 2000 if i % 2 else f"{i}") for i in range(20)]
    df = spark.createDataFrame([*rows, rows[0], rows[1]], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.archive(df, folder).count()
    found = []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").collect():
        found += [h for h, _ in warc.parse(zlib.decompress(bytes(r["content"]), 31))]
    ids = collections.Counter(h["warc-record-id"] for h in found)
    response = next(h for h in found if h["x-page-id"] == "19")
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert len(found) == 22 and len(revisits) == 10 and all(h["warc-refers-to"] == response["warc-record-id"] and h["warc-refers-to-date"] == response["warc-date"] for h in revisits)
    assert all(n == 1 for h, n in ids.items() if h in {r["warc-record-id"] for r in revisits}) and max(ids.values()) == 2  # the row that repeats page 0 as a whole


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nX: y", "<p>" + "ü" * 600 if i % 3 else f"<p>{i}" + "z" * 1200) for i in range(30)]
    rows += [(50, None, None), (51, "u", ""), (None, "n", "<p>" + "ü" * 600), (60, "s", "short"), (61, "s", "short"), (62, "nul", "a\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(df).collect()}
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            groups[h].append(i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(groups[h]) if len(raw) >= 1000 else i
        want = ("response", None) if i == top else ("revisit", top)
        assert (got[i]["record_type"], got[i]["refers_to"]) == want
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert warc.archive(df.limit(0)).count() == 0


def test_damaged_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"))


# 8


def random_index(rng, n_terms=300, n=900):
    names = [f"t{i}" for i in range(n_terms)]
    bags = [collections.Counter(rng.choices(names, k=rng.randrange(0, 9), weights=[1 / (i + 1) for i in range(n_terms)])) for _ in range(n)]
    index = toxicity.BlockMaxIndex({t: i for i, t in enumerate(names)}, np.array([1 + rng.random() for _ in names]), np.array([rng.randrange(2) for _ in bags]), np.ones(n), np.arange(n), 0.1)
    index.fill([index.vector(b) for b in bags])
    return index, bags, names


def test_block_max_search_is_exact():
    rng = random.Random(8)
    index, bags, names = random_index(rng)
    assert 0 < len(index.matrix) < len(names)
    full = np.zeros((len(bags), len(names)))
    for i, b in enumerate(bags):
        t, v = index.vector(b)
        full[i, t] = v
    for _ in range(60):
        t, v = index.vector(collections.Counter(rng.choices(names, k=rng.randrange(1, 6))))
        q = np.zeros(len(names))
        q[t] = v
        exact = np.round(full @ q, 10)
        want = [i for i in sorted(range(len(bags)), key=lambda i: (-exact[i], i)) if exact[i] > 0][:25]
        found, cosines = index.search(t, v, 25)
        assert np.allclose(cosines, exact[want]) and np.allclose(exact[found], exact[want]) and len(set(found.tolist())) == len(found)
    assert index.skipped > 0 and index.read > 0


def slow_toxicity(rows, labels, held):
    """Weights, votes and calibrated scores by plain loops over all examples; every labelled row is an example."""
    def bag(t):
        return collections.Counter(re.findall(r"\w+", (t or "").lower()))

    texts = dict(rows)
    known = {}
    for k, y in labels:
        if k is not None and y is not None and k in texts and zlib.crc32(str(k).encode()) % 5:
            known[k] = max(known.get(k, 0), int(y > 0))
    having = {y: collections.Counter(w for k, v in known.items() if v == y for w in bag(texts[k])) for y in (0, 1)}
    often = collections.Counter(w for _, t in rows for w in bag(t))
    weight = {w: (math.log((1 + len(rows)) / (1 + often[w])) + 1) * math.log2(2 + having[1][w] / max(1, having[0][w])) for w in set(having[0]) | set(having[1])}

    def vector(t):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in bag(t).items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {k: vector(texts[k]) for k in known}
    base = sum(known.values()) / len(known)

    def odds(v, without=None):
        near = sorted(((sum(x * vectors[k].get(w, 0) for w, x in v.items()), -k) for k in known if k != without), reverse=True)[:25]
        votes = [base * 0.05, (1 - base) * 0.05]
        for c, k in near:
            votes[1 - known[-k]] += c * c if c > 1e-12 else 0
        return math.log(votes[0] / votes[1]) if near and near[0][0] > 1e-12 else None

    taught = [(odds(vectors[k], k), y) for k, y in known.items()]
    taught = [(o, y) for o, y in taught if o is not None]
    slope, shift = toxicity.calibrate(np.array([o for o, _ in taught]), np.array([y for _, y in taught]), np.ones(len(taught)))
    out = {}
    for k, t in rows:
        o = odds(vector(t)) if vector(t) else None
        out[k] = base if o is None else 1 / (1 + math.exp(-max(-30, min(30, slope * o + shift))))
    return out


def test_toxicity_equals_plain_loops(spark):
    rng = random.Random(10)
    rows = [(i, prose(i, rng.randrange(1, 30), 40) + (" vile " * rng.randrange(1, 3) if i % 5 == 0 else "")) for i in range(150)] + [(900 + i, t) for i, t in enumerate(ODD)]
    labels = [(i, int(i % 5 == 0 or i % 17 == 0)) for i in range(0, 150)] + [(3, None), (None, 1), (4, 1), (4, 0)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    want = slow_toxicity(rows, labels, None)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_held_out_toxicity_of_the_given_documents(spark):
    """Accuracy, calibration and evidence on documents that taught nothing."""
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.predict(df, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic", F.size("evidence").alias("n")).toPandas()
    missed, false = ((got.predicted == 0) & (got.toxic == 1)).sum(), ((got.predicted == 1) & (got.toxic == 0)).sum()
    error = sum(abs((part.score - part.toxic).sum()) for _, part in got.groupby((got.score * 10).astype(int))) / len(got)
    print(f"{missed} of {(got.toxic == 1).sum()} toxic missed, {false} of {(got.toxic == 0).sum()} others marked, calibration error {error:.4f}, with evidence {(got.n > 0).mean():.4f}")
    assert missed <= 0.12 * (got.toxic == 1).sum() and false <= 0.01 * (got.toxic == 0).sum() and error < 0.02 and (got.n > 0).mean() > 0.95


def test_toxicity_is_learned(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        w = prose(i, 60, 500).split()
        if i % 4 == 0:
            w[10:10] = rng.sample(["vile", "scum", "foulness", "foul"], 3)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + k, t, "en", "s", 1) for k, t in enumerate(ODD)]
    labels += [(0, None, None), (0, 1, 0), (None, 1, 1), (5000, 1, 1)]
    df, lb = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.predict(df, lb).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 300) and all(r["predicted"] == 0 for r in got if r["doc_id"] >= 1000)
    assert all(0 <= r["score"] <= 1 for r in got)
    left = toxicity.reject(df, lb)
    assert left.count() == len(rows) - 75 and left.columns == df.columns
    assert toxicity.predict(empty(spark), lb).count() == 0 and toxicity.predict(df, lb.limit(0)).filter("score > 0").count() == 0


# 9


def test_packing_is_an_exact_cover(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, "it's <|endoftext|> A1, b.", "a.,b ,. don't'll", *[prose(i, 37 * i % 900) for i in range(60)]]
    ids = {i: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts).repartition(3), WORD_BPE).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0) and len({p["step_group"] for p in pieces}) == 1
    assert packing.pack(empty(spark), WORD_BPE).count() == 0


def test_every_tier_is_packed_at_its_size_without_padding():
    rng = random.Random(2)
    lengths = [(i, int(2 ** rng.uniform(0, 13.5))) for i in range(4000)]
    made = list(packing.windows(iter(lengths)))
    sizes = collections.Counter(size for size, _ in made)
    assert all(sum(n for *_, n in pieces) == size and size & (size - 1) == 0 for size, pieces in made)
    assert all(sizes[t] > 5 for t in packing.TIERS) and sum(n for s, n in sizes.items() if s < 256) <= 8
    at = {}
    for d, start, n in sorted(p for _, pieces in made for p in pieces):
        assert start == at.get(d, 0)
        at[d] = start + n
    assert at == dict(lengths)
    # a window's longest piece is of the window's tier, but for the few that a cut left
    own = sum(max(n for *_, n in pieces) * 2 > size for size, pieces in made if size >= 512)
    cuts = sum(len(pieces) for _, pieces in made) - len(lengths) - sum(n // 4096 - (n % 4096 == 0) for _, n in lengths)
    assert own > 0.9 * sum(size >= 512 for size, _ in made) and cuts < 0.6 * len(made)


def test_nulls_and_repeats_are_packed_each(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, None, 1), (3, "c", 1), (3, "c", 1), (3, "", 1)], "doc_id long, text string, start long")
    got = collections.Counter((r["doc_id"], r["doc_tokens"]) for r in packing.pack(df.coalesce(1), WORD_BPE).filter("start = 0").collect())
    assert got == {(None, 3): 1, (None, 1): 1, (3, 2): 2, (3, 1): 1}


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    ids = packing.WordIds(WORD_BPE)
    for t in ["a b c d e f g h", "b c x y z", "h g f e d c b a q", "<|endoftext|> x"]:
        assert np.frombuffer(ids.encode(t.encode()), dtype="<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


# 10


def test_order_minhash(spark):
    texts = [*ODD, *[prose(i, 200) for i in range(20)]]
    rows = {r["doc_id"]: r for r in orderhash.compare(docs(spark, texts)).collect()}
    n = len(texts)
    for i in range(n):
        t, nxt = texts[i] or "", texts[(i - 1) % n] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(t)
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[0]["fingerprint"] == rows[1]["fingerprint"] == rows[2]["fingerprint"]
    assert all(rows[i]["near_edited"] > rows[i]["near_next"] for i in range(len(ODD) + 1, n))
    assert rows[5]["near_next"] == 1.0
    assert orderhash.compare(empty(spark)).count() == 0


def test_order_and_occurrences_count(spark):
    w = prose(1, 120).split()
    swapped = w[60:] + w[:60]
    repeated = "x y " * 40
    df = spark.createDataFrame([(" ".join(w), " ".join(swapped)), (" ".join(w), " ".join(w)), (repeated, "x y " * 20)], "a string, b string")
    near = [r[0] for r in df.select(orderhash.likeness(orderhash.signature(F.col("a")), orderhash.signature(F.col("b")))).collect()]
    assert near[1] == 1.0 and 0.2 < near[0] < 0.95 and near[2] < 0.8


def slow_signature(text):
    def h(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def of(x, n=8):
        return (x % (1 << 8 * n)).to_bytes(n, "little")

    words = []
    for part in re.findall(r"[^ \t-\r]+", text):
        run = ""
        for c in part:
            if regex.match(f"[{orderhash._ALONE}]", c):
                words += [run[i : i + 12] for i in range(0, len(run), 12)] + [c]
                run = ""
            else:
                run += c
        words += [run[i : i + 12] for i in range(0, len(run), 12)]
    ws = [h(w.encode()) for w in words]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [h(of(b), h(of(a))) for a, b in zip(ws, ws[1:])] if len(ws) >= 2 else [h(" ".join(str(signed(w)) for w in ws).encode())]
    seen, kmers = collections.Counter(), []
    for place, x in enumerate(hashes):
        top = x >> 32 << 32
        numbered = h(of(seen[top], 4), h(of(top))) >> 32 << 32
        seen[top] += 1
        kmers.append((signed(numbered), place))
    kmers.sort(key=lambda k: (k[0] >> 32, k[1]))
    out = []
    for j in range(64):
        start = signed(((j << 58) ^ (1 << 63)) % (1 << 64))
        at = sum(k[0] + k[1] < start for k in kmers)
        pair = sorted((kmers[at % len(kmers)], kmers[(at + 1) % len(kmers)]), key=lambda k: k[1])
        out.append(h(of(pair[1][0]), h(of(pair[0][0]))) & 0x7FFFFFFF)
    return out


def test_signatures_equal_plain_loops(spark):
    texts = [*[t or "" for t in ODD], *[prose(i, 3 * i, 20) for i in range(30)], "漢字かな交じり文です。とても長い", "x y " * 300, "word" * 9 + " end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r[0]: list(r[1]) for r in df.select("id", orderhash.signature(F.col("t"))).collect()}
    assert all(got[i] == slow_signature(t) for i, t in enumerate(texts))


def test_texts_without_spaces_have_more_than_one_kmer(spark):
    rng = random.Random(6)
    pairs = []
    for letters in ("漢字仮名交文語日本人大小中国年会社", "abcdefghij"):
        text = "".join(rng.choice(letters) for _ in range(600))
        pairs.append((text, text[:300] + "".join(rng.choice(letters) for _ in range(300))))
    near = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(orderhash.likeness(orderhash.signature(F.col("a")), orderhash.signature(F.col("b")))).collect()]
    assert all(0.1 < x < 0.9 for x in near)


@pytest.mark.parametrize("n, most", [(10, 0.25), (100, 0.09), (400, 0.08)])
def test_spread_of_the_likeness(spark, n, most):
    """Standard deviation of the likeness of texts that share their first half, by length; 64 free orders would have 0.06."""
    pairs = []
    for i in range(300):
        w = prose(i, n, 10**6).split()
        pairs.append((" ".join(w), " ".join(w[: n // 2] + prose(10_000 + i, n - n // 2, 10**6).split())))
    near = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(orderhash.likeness(orderhash.signature(F.col("a")), orderhash.signature(F.col("b")))).collect()]
    print(f"{n} words: mean {np.mean(near):.3f}, standard deviation {np.std(near):.3f}")
    assert np.std(near) < most and 0.05 < np.mean(near) < 0.5


def test_neighbours_of_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(orderhash, "RANGE", 2)
    df = spark.createDataFrame([(5, "eeee"), (5, "dddd"), (3, "cccc"), (9, "iiii"), (None, "nnnn"), (-2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["next_doc_id"]) for r in orderhash.compare(df).filter("doc_id is not null").collect())
    assert [g[1:] for g in got] == [(-2, 9), (3, -2), (5, 3), (5, 3), (9, 5)]
    row = orderhash.compare(df).filter("doc_id is null").first()
    assert row["next_doc_id"] is None and row["edited_sha256"] == hashlib.sha256(b"nn").hexdigest()


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
