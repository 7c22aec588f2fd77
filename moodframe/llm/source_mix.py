"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

A document's key is an exponential variable divided by its quality weight: taking the smallest
keys first is weighted sampling without replacement. Inside each source documents are sorted by
key and prefix-summed up to the source's word budget. Complete epochs over a source come
first; only the rest is chosen by key, and the document at the border gives the words that are
still missing. Keys are hashes of the id, so reruns agree.

The prefix sum of a source runs over about sqrt(n) key ranges of about sqrt(n) documents, so a
source that holds a third of all rows is spread over all tasks. Ranges are even steps of the
keys' distribution, which follows from the qualities of the source: low qualities have large
keys, but do not pile up in a last range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.frames import under_neutral_names
from moodframe.session import stage

WORD = r"[^\x20\x09-\x0D]+"
JUNK = r"[0-9#*$%&|<>!]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with mix_size (words; null text: 0) and mix_quality (share of characters that
    are no digits or symbols, 0.1 at least; 1 for empty texts), which replace such columns."""
    body = F.col(text)
    share = F.length(F.regexp_replace(body, JUNK, "")) / F.length(body)
    quality = F.when(F.length(body) > 0, F.greatest(F.lit(0.1), share)).otherwise(1.0)
    return docs.withColumns({"mix_size": F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long"), "mix_quality": quality})


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(mix_source, source_size, source_rows, target): sources by code point, null last, take
    the weights in turn and share all words by weight; a target stops at ``max_epochs`` times
    its source and the excess goes to the others by weight. One row for each source."""
    sources = sized.groupBy(F.col("source").alias("mix_source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("mix_source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before) / rest
    levelled = ranked.withColumn("level", level)
    # below the first source whose cap the common level does not reach, all are full
    common = F.min(F.when(F.col("level") <= F.col("fill"), F.col("fill"))).over(Window.partitionBy())
    # of sources that tie there the first counts; the levels of the next subtract its cap, which is not full
    final = F.max(F.when((F.col("fill") == common) & (F.col("level") <= F.col("fill")), F.col("level"))).over(Window.partitionBy())
    return levelled.select("mix_source", "source_size", "source_rows", F.coalesce(F.least("cap", final * F.col("weight")), F.lit(0.0)).alias("target"))


def sampling_key(doc_id, quality, seed: int = SEED):
    """Column: an exponential variable from the id, divided by the quality weight."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    chance = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(chance) / quality


def key_rates(sized: DataFrame, classes: int = 10) -> DataFrame:
    """(mix_source, mix_rates): for each source the share of rows and the mean quality in each of
    ``classes`` classes of quality. A key of quality q exceeds x with the chance exp(-q x)."""
    place = F.least(F.lit(classes - 1), F.floor(F.col("mix_quality") * classes))
    own = [F.struct((F.count_if(place == i) / F.count("*")).alias("share"), F.coalesce(F.avg(F.when(place == i, F.col("mix_quality"))), F.lit(1.0)).alias("rate")) for i in range(classes)]
    return sized.groupBy(F.col("source").alias("mix_source")).agg(F.array(*own).alias("mix_rates"))


def key_level(key, rates):
    """Column: about the share of a source's keys that are smaller; it never falls with the key."""
    return 1 - F.aggregate(rates, F.lit(0.0), lambda total, c: total + c["share"] * F.exp(-c["rate"] * key))


def _keyed(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    base = sized.drop("source_size", "target", "taken", "mix_source", "source_rows", "mix_rates", "mix_key", "mix_range", "mix_before")
    joined = base.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    keyed = joined.withColumn("mix_key", sampling_key(F.col("doc_id"), F.col("mix_quality"), seed))
    return keyed.withColumn("mix_range", F.floor(key_level(F.col("mix_key"), F.col("mix_rates")) * F.ceil(F.sqrt("source_rows"))))


def mix_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, narrow: DataFrame | None = None) -> DataFrame:
    """``sized`` (from ``measured``, with doc_id and source) with source_size, target and taken:
    words of the document in the mix, repeats counted, at most ``max_epochs`` times its size.
    ``narrow`` has the same rows without texts (by default ``sized`` itself, which is better
    staged then): sizes by source and key range are taken from it and written as small tables,
    so the rows of ``sized`` move only once, into their key ranges.

    The taken words of a source sum to its target rounded down. Null sources are a source;
    null ids share one key; rows with equal keys are ordered by id and size; documents
    without words take nothing. No Python, no cap, one task holds about sqrt(n) rows."""
    narrow = sized if narrow is None else narrow
    rates = key_rates(narrow).withColumnRenamed("mix_source", "_s")
    targets = source_targets(narrow, weights, max_epochs)
    targets = stage(targets.join(rates, F.col("mix_source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    keyed = _keyed(sized, targets, seed)
    totals = _keyed(narrow, targets, seed).groupBy("mix_source", "mix_range").agg(F.sum("mix_size").alias("words"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(totals.select(F.col("mix_source").alias("_s"), F.col("mix_range").alias("_r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("mix_before")), "starts")
    placed = keyed.join(starts, F.col("mix_source").eqNullSafe(F.col("_s")) & (F.col("mix_range") == F.col("_r"))).drop("_s", "_r")
    inside = Window.partitionBy("mix_source", "mix_range").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("mix_before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    taken = F.col("mix_size") * epochs + F.greatest(F.lit(0), F.least(F.col("mix_size"), rest - prefix))
    return placed.withColumn("taken", taken.cast("long")).drop("mix_source", "source_rows", "mix_rates", "mix_key", "mix_range", "mix_before")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of the mix with the columns of ``docs`` (doc_id, text, source and any others):
    one row for each complete repeat of a document, and one with its first words for the
    document at a source's border, n_chars following the text. Null and empty texts have no
    words and leave; repeated rows are taken each; other columns keep their values whatever
    their names."""
    return under_neutral_names(docs, lambda plain: _mixed(plain, weights, max_epochs, seed))


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    columns = docs.columns
    narrow = stage(measured(docs).select("doc_id", "source", "mix_size", "mix_quality"), "sized")
    mixed = mix_sources(measured(docs), weights, max_epochs, seed, narrow).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("mix_size"))
    part = F.col("taken") % F.col("mix_size")
    copies = mixed.withColumn("mix_words", F.explode(F.concat(F.array_repeat(F.col("mix_size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("mix_words").cast("int")), " ")
    text = F.when(F.col("mix_words") < F.col("mix_size"), cut).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(columns)


SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.1, length(regexp_replace(text, '{JUNK}', '', 'g')) / length(text)) ELSE 1.0 END AS quality
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS fill, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, fill) FROM levels WHERE level <= fill)) AS target FROM levels),
keyed AS (
  SELECT d.*, t.source_size, t.target,
    -ln((('0x' || substr(md5('42|' || d.doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / d.quality AS key
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM keyed)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * epochs + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""
