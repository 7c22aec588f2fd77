"""Words and pairs with very common keys."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from moodframe.operators import words as wd
from moodframe.session import hot_join, hot_keys, stage


def facts(spark, n=3000):
    """A third of all rows hold one key, one row in a hundred is null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700))
    return stage(spark.range(n).select("id", key.alias("a")), "facts")


def test_common_keys_are_found_and_met_by_broadcast(spark):
    rows = facts(spark)
    assert hot_keys(rows, "a", 1) == ["hot"]
    lookup = stage(rows.select("a").dropna().distinct().withColumn("v", F.length("a")), "lookup")
    joined = hot_join(rows, lookup, "a", 1)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(lookup, "a").collect()))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "rightHint=(strategy=broadcast)" in plan


def test_the_shuffled_side_has_no_common_key(spark):
    rows = facts(spark)
    rest = rows.filter(~F.col("a").isin(hot_keys(rows, "a", 1)))
    sizes = [r["n"] for r in rest.repartition(8, "a").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


def test_join_without_rows(spark):
    rows = facts(spark)
    lookup = rows.select("a").dropna().distinct().withColumn("v", F.length("a"))
    assert hot_keys(rows.limit(0), "a") == []
    assert hot_join(rows.limit(0), lookup, "a").count() == 0
    assert hot_join(rows, lookup.limit(0), "a").count() == 0


def test_plurals_move_only_to_singulars_that_occur(spark):
    counts = spark.createDataFrame([("x", "cat", 2), ("x", "cats", 3), ("x", "dogs", 4), ("x", "glass", 1), ("y", "cats", 5), ("x", "s", 1)], "c string, term string, n long")
    got = sorted(map(tuple, wd.merge_plurals(counts, by=("c",)).select("c", "term", "n").collect()))
    assert got == [("x", "cat", 5), ("x", "dogs", 4), ("x", "glass", 1), ("x", "s", 1), ("y", "cats", 5)]


def test_pairs_with_one_word_in_a_third_of_them(spark):
    """Counts of all words and passing pairs against plain Python."""
    texts = [f"alpha word{chr(97 + i % 26)} beta{chr(97 + i % 7)}" for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["term"]: r["n"] for r in wd.word_and_pair_counts(docs, "text", threshold=1e9).collect()}
    want = {}
    for t in texts:
        for w in t.split():
            want[w] = want.get(w, 0) + 1
    assert got == want


def brute_counts(texts, drops, threshold):
    """The same by plain Python, pairs by their definition."""
    lists = [[w.lower() for w in t.split()] for t in texts]
    uni, pair = Counter(w for ws in lists for w in ws if w not in drops), Counter()
    for ws in lists:
        pair.update(p for p in zip(ws, ws[1:]) if not set(p) & drops)
    plural = lambda w: w.endswith("s") and not w.endswith("ss")
    form = {w: w[:-1] if plural(w) and w[:-1] in uni else w for w in uni}
    c, total = Counter(), sum(uni.values())
    for w, n in uni.items():
        c[form[w]] += n
    merged = Counter()
    for (a, b), n in pair.items():
        merged[a, b[:-1] if plural(b) and (a, b[:-1]) in pair else b] += n
    part = lambda k, n, x: k * math.log(max(x, 1e-10)) + (n - k) * math.log(max(1 - x, 1e-10))
    passing = {}
    for (a, b), n in merged.items():
        c1, c2 = c[form[a]], c[form[b]]
        p, p1, p2 = c2 / total, n / c1, (c2 - n) / (total - c1)
        score = -2 * (part(n, c1, p) + part(c2 - n, total - c1, p) - part(n, c1, p1) - part(c2 - n, total - c1, p2))
        if score > threshold:
            passing[f"{a} {b}"] = n
    used = Counter()
    for p, n in passing.items():
        a, b = p.split()
        used[form[a]] += n
        used[form[b]] += n
    return {w: n - used[w] for w, n in c.items() if n > used[w]} | passing


def test_rare_words_plurals_and_stop_words_in_small_batches(spark, monkeypatch):
    """Most words lie beyond the common ones and texts beyond one batch: the same counts."""
    rng = random.Random(5)
    stems = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(120)]
    texts = [" ".join(rng.choice(stems[: rng.choice([4, 30, 120])]) + rng.choice(["", "", "s", "ss"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += ["s s as as s", "the cats the cat", "cats sleep cat sleeps", ""] * 3
    for i in range(0, 300, 3):
        texts[i] += " blue moons" if i % 2 else " blue moon"
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").coalesce(2)
    monkeypatch.setattr(wd, "LOOKUP_ROWS", 25)
    parts = {}
    for size in (50, 1 << 21):
        monkeypatch.setattr(wd, "BATCH_WORDS", size)
        parts[size] = wd._pair_parts(docs, "text", ["the"])
        parts[size] = sorted(map(tuple, parts[size].groupBy("a", "k", "plural").sum("n").fillna("-").collect()))
    assert parts[50] == parts[1 << 21]
    want = brute_counts(texts, {"the"}, 30)
    assert any(" " in t for t in want) and not all(" " in t for t in want)
    got = wd.word_and_pair_counts(docs, "text", ["the"])
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_pairs_are_shuffled_once(spark):
    """Pairs of common words never move after they are counted."""
    docs = spark.createDataFrame([("blue moon rise",)] * 50, "text string")
    plan = wd._pair_parts(docs, "text", [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    words = spark.createDataFrame([(f"w{i}", i % 7) for i in range(70)], "term string, c long")
    assert [wd.common_words(words, m).count() for m in (9, 10, 29, 30, 70)] == [0, 10, 20, 30, 70]
