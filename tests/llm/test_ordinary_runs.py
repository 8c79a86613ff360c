"""The fit of the secret scan takes in all words of a text (operator 1)."""

import random

from pyspark.sql import functions as F

from tracewright.llm import secrets
from tracewright.llm.queries import op1_secrets


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 12))) for _ in range(n)]


def test_every_word_is_in_a_run(spark):
    texts = [prose(i, n) for i, n in enumerate((0, 1, 3, 59, 60, 61, 119, 120, 500, 5000))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in df.select("doc_id", secrets.ordinary_runs(F.col("text")).alias("runs")).collect():
        words, joined, at = texts[r["doc_id"]], "".join(r["runs"]).lower(), 0
        assert all(len(x) >= secrets.MIN_RANDOM for x in r["runs"])
        if len(words) >= 59:
            for w in words:  # in order, none left out
                at = joined.index(w, at) + len(w)
            assert len(joined) < 1.5 * sum(map(len, words)) and max(map(len, r["runs"])) < 2 * max(secrets.LENGTHS)
        elif len(words) < 2:
            assert not r["runs"]


def test_query_fits_to_all_words(spark, tmp_path, monkeypatch):
    """The sums of the query are those of all characters of the words, not of one run of each document."""
    seen, fit = [], secrets.ordinary

    def ordinary(runs):
        seen.append(runs.filter("run is not null").agg(F.sum(F.length("run"))).first()[0])
        return fit(runs)

    monkeypatch.setattr(secrets, "ordinary", ordinary)
    texts = [prose(i, 1000) for i in range(8)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op1_secrets(spark, str(tmp_path)).count() == 8
    assert seen[0] >= sum(len(w) for t in texts for w in t)


def test_a_text_is_hashed_once(spark):
    """Else each run of a block hashes the whole text again, and a long text costs the square of its length."""
    df = spark.createDataFrame([(" ".join(prose(7, 300)),)], "text string").select(F.explode(secrets.ordinary_runs(F.col("text"))).alias("run"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert df.count() > 5 and plan.count("xxhash64(text") == 1
