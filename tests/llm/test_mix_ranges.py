"""Key ranges of the source mix, and columns that are named like those of an operator."""

from pyspark.sql import functions as F

from moodframe.llm import exact_substrings, source_mix
from moodframe.session import stage


def test_low_qualities_do_not_pile_up_in_one_range(spark):
    """Half of a source of quality 0.1: no range holds many more rows than another."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), F.lit(5).cast("long").alias("mix_size"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.9).alias("mix_quality"))
    sized = stage(rows, "sized")
    targets = source_mix.source_targets(sized).crossJoin(source_mix.key_rates(sized).select("mix_rates"))
    sizes = [r["count"] for r in source_mix._keyed(sized, targets, 42).groupBy("mix_range").count().collect()]
    assert sum(sizes) == 40_000 and 190 <= len(sizes) <= 201
    assert max(sizes) <= 300
    mixed = source_mix.mix_sources(sized)
    assert {tuple(r) for r in mixed.groupBy("source_size").agg(F.sum("taken").alias("t"), F.floor(F.max("target")).alias("g")).collect()} == {(200_000, 200_000, 200_000)}


def test_the_level_never_falls(spark):
    rates = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(r).alias("rate")) for s, r in ((0.25, 0.1), (0.75, 1.0))])
    got = [r[0] for r in spark.range(2000).orderBy("id").select(source_mix.key_level(F.col("id") / 10, rates)).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] <= 1


def test_clashing_names_keep_their_values(spark):
    names = ("mix_key", "mix_source", "source_rows", "mix_range", "mix_before", "mix_rates", "mix_size", "mix_words", "target", "taken", "source_size", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "carried_0", "block")
    rows = [(i, f"own words number {i}", "web", 5, *[f"{n}{i}" for n in names]) for i in range(6)] + [(None, None, None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for out in (exact_substrings.without_repeats(docs), source_mix.mixed_documents(docs)):
        assert out.columns == docs.columns
        found = {r["doc_id"]: tuple(r[n] for n in names) for r in out.collect() if r["doc_id"] is not None}
        assert found == {i: tuple(f"{n}{i}" for n in names) for i in range(6)}
    assert source_mix.mixed_documents(docs.limit(0)).count() == 0
