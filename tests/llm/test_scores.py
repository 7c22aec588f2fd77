"""The quality classifier and the whitening against plain versions, on small tables with odd rows."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, lower, odd_rows, toxic_corpus, words

from moodframe.llm import quality_classifier as qc
from moodframe.llm import whitening
from moodframe.llm.textblocks import Hasher, mix64


def hashed(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return Hasher.of(data, 6).ranges(np.array([0]), np.array([len(data)]))[0]


def grams(word, sizes):
    marked = b"\0" + word.encode() + b"\0"
    return collections.Counter(marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1))


def test_bags_equal_a_plain_count():
    """Words and word pairs fall where their hashes say; as many grams as windows; shares sum to 1."""
    buckets = 1 << 40
    texts = [r[1] for r in odd_rows()]
    bounds, ids, shares = qc.document_bags(pa.array(texts, pa.string()), qc.SIZES, buckets)
    for i, text in enumerate(texts):
        own = words(text)
        found = dict(zip(ids[bounds[i] : bounds[i + 1]].tolist(), shares[bounds[i] : bounds[i + 1]].tolist(), strict=True))
        total = len(own) + max(len(own) - 1, 0) + sum(grams(w, qc.SIZES).total() for w in own)
        assert sum(found.values()) == pytest.approx(1.0 if own else 0.0)
        plain = collections.Counter(int(hashed(w) % np.uint64(buckets)) for w in own)
        with np.errstate(over="ignore"):
            plain += collections.Counter(0 if a == b else int(mix64(np.array([hashed(a) * np.uint64(3) + hashed(b)]))[0] % np.uint64(buckets)) for a, b in zip(own, own[1:], strict=False))
        assert all(found[k] == pytest.approx(n / total) for k, n in plain.items())


def test_training_step_is_the_gradient():
    """One step from equal vectors moves them against the numeric gradient of the softmax loss."""
    random = np.random.default_rng(1)
    bounds, ids, weights = np.array([0, 3]), np.array([0, 2, 5]), np.array([0.5, 0.25, 0.25])
    first = qc.train_sgd(bounds, ids, weights, np.array([1]), np.ones(1), 6, width=3, rounds=0, seed=4)
    output, bias = random.normal(size=(3, 2)), random.normal(size=2)

    def loss(vectors):
        logits = weights @ vectors[ids] @ output + bias
        return np.log(np.exp(logits).sum()) - logits[1]

    vectors, small = first[0], 1e-6
    numeric = np.zeros_like(vectors)
    for at in np.ndindex(vectors.shape):
        more, less = vectors.copy(), vectors.copy()
        more[at] += small
        less[at] -= small
        numeric[at] = (loss(more) - loss(less)) / (2 * small)
    chance = np.exp(weights @ vectors[ids] @ output + bias)
    error = chance / chance.sum() - np.array([0, 1])
    own = np.zeros_like(vectors)
    own[ids] = weights[:, None] * (output @ error)
    assert np.abs(own - numeric).max() < 1e-7
    one = qc.train_sgd(bounds, ids, weights, np.array([1]), np.ones(1), 6, width=3, rounds=1, rate=0.1, seed=4)
    assert one[2][1] > 0 > one[2][0] and np.abs(one[1]).max() > 0


def test_scores_equal_the_softmax_of_mean_vectors(spark):
    texts, marks = toxic_corpus(spark)
    model = qc.fit_quality_classifier(texts, marks, "toxic")
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    rows = qc.score_quality_classifier(docs, model).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {*docs.columns, "predicted"}
    bounds, ids, shares = qc.document_bags(pa.array([r["text"] for r in rows], pa.string()), qc.SIZES, qc.BUCKETS)
    for i, r in enumerate(rows):
        own = slice(bounds[i], bounds[i + 1])
        logits = (shares[own] @ model.vectors[ids[own]] if bounds[i + 1] > bounds[i] else np.zeros(qc.WIDTH)) @ model.output + model.bias
        chance = np.exp(logits - logits.max())
        assert r["score"] == pytest.approx(chance[1] / chance.sum(), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3)
    assert qc.score_quality_classifier(docs.limit(0), model).count() == 0
    labels = lambda own: spark.createDataFrame(own, "doc_id long, toxic int, quality int")
    for own, share in (([], 0.5), ([(i, None, 1) for i in range(60)], 1.0), ([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], 0.5)):
        scores = {r["score"] for r in qc.score_quality_classifier(docs, qc.fit_quality_classifier(texts, labels(own))).collect()}
        assert len(scores) == 1 and scores.pop() == pytest.approx(share, abs=1e-6)
    assert lower("A") == "a"


def test_classifier_is_right_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.fit_quality_classifier(docs, labels)
    rows = qc.score_quality_classifier(docs, model).join(labels, "doc_id").where(qc.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def vector_rows(n=70, d=12):
    random = np.random.default_rng(3)
    x = random.normal(size=(n, d)) * np.linspace(0.2, 3, d)
    x[:, 4] = x[:, 3] * 2  # rank below d
    x[:, 5] = 0.25  # no variance
    rows = [(i, [float(np.float32(v)) for v in own]) for i, own in enumerate(x)]
    bad = [(900, None), (901, [None] + [0.0] * (d - 1)), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] + [0.0] * (d - 1)), (904, [1.0, 2.0]), (905, [])]
    return rows + [rows[7], rows[7], (None, rows[9][1])], bad


@pytest.mark.parametrize("partitions", [1, 7])
def test_whitening_equals_plain_eigenvectors(spark, partitions):
    rows, bad = vector_rows()
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("n", F.lit("n")).repartition(partitions)
    got = whitening.whiten(table).toPandas()
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in own] for _, own in rows])
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    whole = centred @ vectors / np.sqrt(values)
    assert len(got) == 8 * n and set(got.n) == {n} and set(got.component) == set(range(1, 9))
    assert np.allclose(sorted(set(got.explained.round(12)), reverse=True), (values / np.trace(centred.T @ centred / n)).round(12))
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    far = {i: int(((n * x[i] - sums) ** 2).sum()) for i in range(70)}
    for component in range(1, 9):
        own = got[got.component == component].dropna(subset="vec_id").drop_duplicates("vec_id").set_index("vec_id").sort_index()
        assert own.index.tolist() == list(range(70)) and own.deviation.tolist() == [far[i] for i in range(70)]
        want = whole[:70, component - 1]
        assert np.abs(own.whitened.to_numpy() - want * np.sign(want @ own.whitened.to_numpy())).max() < 1e-9


def test_equal_variances_and_too_few_rows(spark):
    def run(own):
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(own)], "vec_id long, embedding array<float>")).toPandas()

    corners = [[s * (1.0 if k == i else 0.0) for k in range(10)] for i in range(10) for s in (1, -1)]
    got = run(corners)  # all ten variances equal: whitened rows of one component still are
    assert sorted(set(got.component)) == list(range(1, 9)) and got.identity_error[0] < 1e-9 and np.allclose(got.explained, 0.1)
    assert len(run([])) == 0 and len(run([[1.0, 2.0]])) == 0 and len(run([[1.0, 2.0]] * 5)) == 0 and len(run([[], []])) == 0
    two = run([[1.0, 2.0, 3.0], [2.0, 0.0, 3.0]])
    assert sorted(two.whitened.round(9)) == [-1.0, 1.0] and set(two.explained.round(12)) == {1.0}
    huge = run([[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])
    assert set(huge.component) == {1, 2} and (huge.deviation > 0).all()


def test_exact_deviations_beyond_64_bits():
    x = np.array([[1 << 31, 5], [-(1 << 31), 7]])
    for n in (2, 3_000_000, 5_000_000_000):
        sums = [0, 12 * n // 2]
        want = [min(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)), (1 << 63) - 1) for row in x]
        assert whitening.deviations(x, n, sums) == want
