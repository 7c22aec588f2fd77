"""The corpus operators against brute-force versions, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from moodframe.llm import exact_substrings, language_model, near_duplicates, packing, quality_rules, source_mix, token_files, toxicity, vector_search, warc
from moodframe.llm.queries import vocabulary
from moodframe.session import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, score string, kept string, range string, component string, rep long, bucket long, status int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def odd_rows():
    """Null, empty, blank, long, repeated and tied texts, null ids and sources, non-ASCII."""
    draw = random.Random(3)
    some = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta", "eta", "Théta", "iota", "kappa", "漢字", "x#y"]
    prose = lambda n: " ".join(draw.choice(some) + str(draw.randrange(40)) for _ in range(n))
    shared = prose(60)
    long = prose(6000)
    base = prose(120)
    near = base.split()
    near[50] = "changed"
    texts = [
        None, "", " \n\t ", "one", "one two", "One  TWO", base, base, " ".join(near), long, long + " tail",
        prose(30) + "\n" + shared + "\n" + prose(30), prose(10) + shared, "é" * 300, "é" * 300, "ab" * 400,
        "line\nline\nline\n\nother", "<|endoftext|> mid<|endoftext|>x", "a  b \n c  d　e", prose(55),
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "without an id " * 20, None, None, None), (40, base, None, "S", 1), (40, "another text of the same id", None, "S", 1)]
    return [(*r, 7, "score", "kept", "range", "component", 5, 6, 8) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return stage(spark.createDataFrame(odd_rows(), SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def toxic_corpus(spark, n=400):
    draw = random.Random(5)
    bad = ["grobnak", "grobnark", "zulfitt", "zulfitter"]
    texts, marks = [], []
    for i in range(n):
        own = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(60)]
        if i % 4 == 0:
            for k in (5, 25, 45):
                own[k] = draw.choice(bad)
        texts.append((i, " ".join(own)))
        marks.append((i, int(i % 4 == 0), int(i % 3 > 0)))
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4), labels(spark, marks)


def test_toxicity_finds_unseen_spellings(spark):
    texts, marks = toxic_corpus(spark)
    model = toxicity.fit_toxicity(texts, marks)
    scored = toxicity.score_toxicity(texts, model).join(marks, "doc_id").withColumn("out", toxicity.held_out(marks["doc_id"])).where("out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in scored]) > 0.95
    unseen = spark.createDataFrame([(1, "abc " * 40 + "grobnakk grobnarkk zulfitts"), (2, "abc " * 43)], "doc_id long, text string")
    high, low = (r["score"] for r in toxicity.score_toxicity(unseen, model).orderBy("doc_id").collect())
    assert high > 0.5 > low


def test_toxicity_odd_rows(spark, docs, empty):
    texts, marks = toxic_corpus(spark)
    model = toxicity.fit_toxicity(texts, marks)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0].asDict().keys() == {*docs.columns, "predicted"}
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(texts, labels(spark, []))
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0
    odd = toxicity.fit_toxicity(texts, labels(spark, [(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)]))
    assert toxicity.score_toxicity(docs, odd).count() == len(rows)


def counts_of(text):
    own, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(own, own[1:], own[2:], strict=False))
    marked = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_counts_and_verdict(spark, docs, empty):
    texts, marks = toxic_corpus(spark)
    model = quality_rules.fit_quality(texts, marks)
    rows = quality_rules.judge_quality(docs, model).collect()
    for r in rows:
        own = counts_of(r["text"])
        assert own == tuple(r[k] for k in quality_rules.COUNTS[:1] + quality_rules.COUNTS[1:])
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge_quality(empty, model).count() == 0
    alone = quality_rules.judge_quality(docs, quality_rules.fit_quality(texts, labels(spark, [])))
    assert alone.where("kept = base_failed").count() == 0


def test_quality_learns_held_out(spark, sf):
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit_quality(docs, marks, held_out=toxicity.held_out)
    judged = quality_rules.judge_quality(docs, model).join(marks, "doc_id").where(toxicity.held_out(F.col("doc_id"))).where("not base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in judged]) > 0.9


@pytest.mark.parametrize("n_words", [1, 2, 5])
def test_near_duplicates_equal_brute_force(docs, empty, n_words):
    rows = docs.collect()

    def shingles(text):
        own = words(text)
        return {tuple(own[i : i + n_words]) for i in range(len(own) - n_words + 1)} if len(own) >= n_words else {tuple(own)} if own else set()

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]
    assert plain(near_duplicates.near_duplicate_groups(docs, words=n_words).collect()) == plain(want)
    assert near_duplicates.near_duplicate_groups(empty, words=n_words).count() == 0


def test_near_duplicate_chains_and_crowds(spark):
    """A chain whose ends differ, and a hot bucket that does not hang together."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        own = list(base)
        for k in range(3 * i, 3 * i + 3):
            own[k % 100] = f"z{k}"
        base = own
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, "same start of all " + " ".join(f"q{i}_{k}" for k in range(3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_groups(docs, words=1).collect()}
    assert {out[1000 - i] for i in range(30)} == {971}
    assert all(out[2000 + i] == 2000 + i for i in range(60))


def test_crowded_bucket_of_strangers_finds_its_one_link(spark):
    """2,000 texts share half of their words and some elements outside the pivot, so they fall
    into its buckets; none is linked but one pair, whose members are not linked to the pivot. The
    pairs that are met again stay few, and no pair of the pivot's strangers is built in full."""
    draw = np.random.default_rng(8)
    common, outside = [f"c{i}" for i in range(60)], [f"o{i}" for i in range(10)]
    rows = [(i, " ".join([*common, *(outside if i else []), *(f"u{i}_{k}" for k in range(draw.integers(28, 34)))])) for i in range(2000)]
    twin = rows[700][1].split()
    rows.append((5000, " ".join([*twin[:-4], "other", "words", "at", "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    built = []
    plain_rim = near_duplicates.rim_pairs

    def seen(*args):
        built.append(stage(plain_rim(*args), "seen"))
        return built[-1]

    near_duplicates.rim_pairs = seen
    try:
        out = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_groups(docs, words=1).collect()}
    finally:
        near_duplicates.rim_pairs = plain_rim
    assert out.pop(5000) == 700 and all(k == v for k, v in out.items())
    assert built[0].count() < 20_000


@pytest.mark.parametrize("n_words", [2, 5])
def test_near_duplicates_equal_brute_force_on_documents(spark, sf, n_words):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    sets = {i: {tuple(own[k : k + n_words]) for k in range(len(own) - n_words + 1)} if len(own) >= n_words else {tuple(own)} if own else set() for i, own in texts.items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    out = near_duplicates.near_duplicate_groups(docs, words=n_words).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == group and any(k != v for k, v in group.items())


def test_sketch_estimates_similarity():
    draw = np.random.default_rng(1)
    common, a, b = (draw.integers(0, 1 << 62, n).astype(np.uint64) for n in (800, 100, 100))
    value = np.concatenate([common, a, common, b])
    owner = np.repeat([0, 1], 900)
    found = near_duplicates.sketch(owner, value, 3, 512)
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.06
    assert (found[:2] < np.iinfo(np.uint64).max).all() and (found[2] == np.iinfo(np.uint64).max).all()
    tiny = near_duplicates.sketch(np.array([0]), np.array([5], np.uint64), 1, 64)
    assert (tiny < np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeated_strings_equal_brute_force(docs, empty, crowd):
    length = 64
    rows = docs.collect()
    bodies = [(r["text"] or "").encode() for r in rows]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    want = []
    for r, b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        want.append((r["doc_id"], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    found = exact_substrings.remove_repeats(docs, length, gram=16, crowd=crowd)
    assert found.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert plain(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == plain(want)
    assert exact_substrings.remove_repeats(empty, length, gram=16).count() == 0


def test_cut_texts_keep_columns_and_whole_characters(docs):
    out = exact_substrings.without_repeats(docs, 101)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars <> length(text)").count() == 0
    assert out.where("text is null").count() == 1


def test_vector_search_equals_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.integers(-3, 3, 5)]) for i in range(0, 300, 2)]
    rows += [(i, [float(x) for x in draw.normal(size=3)]) for i in range(1000, 1400, 5)]
    rows += [(500, None), (600, [1.0, None, 2.0, 1.0, 1.0]), (700, [math.inf] * 5), (800, [math.nan] * 5), (900, []), (None, [1.0] * 5), (2, [1.0] * 5), (100, [0.5] * 5), (5000, [1e9, -1e9, 1e9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(good, key=lambda r: (r[0], len(r[1]), r[1])):
        if i % 100 == 0:
            asked.setdefault(i, v)
    want = []
    for q, v in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    for block in (4096, 2):
        assert plain(vector_search.exact_top_k(table, lambda v: v % 100 == 0, query_block=block).collect()) == plain(want)
    assert vector_search.exact_top_k(table.limit(0), lambda v: v % 100 == 0).count() == 0


def test_tree_boxes_hold_their_rows():
    rows = np.random.default_rng(3).integers(-50, 50, (1000, 6))
    order, first, last, left, low, high = vector_search.build_tree(rows, 16)
    assert sorted(order) == list(range(1000))
    for node in range(len(first)):
        own = rows[order[first[node] : last[node]]]
        assert (own.min(0) == low[node]).all() and (own.max(0) == high[node]).all()
        assert left[node] >= 0 or len(own) <= 16


@pytest.mark.parametrize("rest", [2, None])
def test_language_model_equals_brute_force(docs, empty, rest):
    held = language_model.default_held_out if rest else lambda doc_id: doc_id.isNull() | doc_id.isNotNull()
    rows = docs.collect()
    texts = [[*words(r["text"]), 0] for r in rows]
    out = [zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2 if rest else True for r in rows]
    single, pair, state = collections.Counter(), collections.Counter(), collections.Counter()
    for t, held_out in zip(texts, out, strict=True):
        if not held_out:
            single.update(t)
            pair.update(zip([1, *t], t, strict=False))
            state.update([1, *t[:-1]])
    n, v, k = sum(single.values()), len(single), language_model.SMOOTHING
    want = []
    for r, t, held_out in zip(rows, texts, out, strict=True):
        root = [(single[w] + 1) / (n + v + 1) for w in t]
        arcs = [(pair[h, w] + k * p) / (state[h] + k) for h, w, p in zip([1, *t], t, root, strict=False)]
        want.append((r["doc_id"], held_out, len(t), sum(single[w] > 0 for w in t), n, round(sum(map(math.log10, root)), 6), round(sum(map(math.log10, arcs)), 6)))
    found = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in language_model.score_texts(docs, held).collect()]
    assert plain(found) == plain(want)
    assert language_model.score_texts(empty, held).count() == 0


def test_automaton_chances_sum_to_one():
    counts, n, v, k = {"a": 5, "b": 2}, 7, 2, language_model.SMOOTHING
    pairs = {"a": 3, "b": 1}
    root = {w: (counts.get(w, 0) + 1) / (n + v + 1) for w in ("a", "b", "unknown")}
    assert math.isclose(sum((pairs.get(w, 0) + k * p) / (4 + k) for w, p in root.items()), 1)


def test_packing_is_gapless_and_whole(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*encode.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at, size, k = 0, (len(ids) - 1) % 64 + 1, 0
        while at < len(ids):
            want[r["doc_id"], k, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
            at, size, k = at + size, 64, k + 1
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    ends = collections.Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("shape", ["even", "large", "small", "none"])
def test_packing_plan_uses_up_the_histogram(shape):
    draw = np.random.default_rng(4)
    lengths = {"even": draw.integers(1, 1025, 20_000), "large": draw.integers(520, 1025, 3000), "small": draw.integers(1, 60, 5000), "none": np.zeros(0, np.int64)}[shape]
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.packing_plan(counts, 1024)
    used = np.zeros(1025, np.int64)
    for number, pattern in plan:
        assert sum(n * m for n, m in pattern) <= 1024
        for n, m in pattern:
            used[n] += number * m
    assert (used == counts).all()
    bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
    assert sum(n for n, _ in plan) <= 1.03 * bound + 1


def test_least_squares_meets_its_conditions():
    draw = np.random.default_rng(6)
    matrix, target = draw.normal(size=(40, 60)), draw.normal(size=40)
    x = packing.nonnegative_least_squares(matrix, target, 1e-6)
    slope = matrix.T @ (matrix @ x - target) + 1e-6 * x
    assert (x >= 0).all() and (slope > -1e-5).all() and abs(slope[x > 0]).max() < 1e-5


def test_token_files_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    rows = sorted(docs.collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*encode.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((-1 if r["doc_id"] is None else r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert plain(token_files.token_round_trip(docs, path).collect()) == plain(want)
    assert token_files.token_round_trip(empty, path).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [7] * 500, list(range(3000)), [0] * 100_000 + list(range(2000))])
def test_huffman_codes(ids):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    lengths = token_files.code_lengths(counts)
    assert lengths.max(initial=0) <= token_files.LIMIT
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    data = token_files.pack_block(np.array([4]), np.array([len(ids)]), ids, token_files.canonical_codes(lengths), lengths)
    assert token_files.unpack_block(data, token_files.decode_table(lengths))[2].tolist() == ids.tolist()


def test_limited_codes_are_optimal_without_a_limit_in_reach():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert token_files.code_lengths(counts).tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    assert token_files.code_lengths(counts, 4).max() == 4


def test_mix_equals_definition(docs, empty):
    sized = stage(source_mix.measured(docs), "sized")
    rows = source_mix.mix_sources(sized).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        above = {s for s in share if share[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    target = share | {s: 3 * sizes[s] for s in capped}
    taken = collections.Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["mix_size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["mix_size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert source_mix.mix_sources(stage(source_mix.measured(empty), "sized")).count() == 0
    again = source_mix.mix_sources(stage(source_mix.measured(docs.repartition(7)), "sized")).select("doc_id", "mix_size", "taken")
    assert plain(again.collect()) == plain((r["doc_id"], r["mix_size"], r["taken"]) for r in rows)


@pytest.mark.parametrize(("sizes", "weights", "epochs", "want"), [
    ((1000, 1000, 1000, 1000), (5, 2, 1), 3, (20000 / 13, 8000 / 13, 4000 / 13, 20000 / 13)),
    ((500, 200), (5, 2), 3, (500, 200)),
    ((500, 200, 1000), (5, 2, 1), 1, (500, 200, 1000)),
    ((100, 100, 100, 5000), (5, 1, 1, 1), 2, (200, 200, 200, 4700)),
])
def test_mix_keeps_all_words_when_sources_tie(spark, sizes, weights, epochs, want):
    """Sources with equal size by weight become full at the same level."""
    rows = [(100 * s + i, "word " * (size // 10), f"s{s}") for s, size in enumerate(sizes) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mix.mix_sources(stage(source_mix.measured(docs), "sized"), weights, epochs).collect()
    targets = {r["source"]: r["target"] for r in out}
    assert [targets[f"s{s}"] for s in range(len(sizes))] == pytest.approx(want)
    for s, target in enumerate(want):
        assert abs(sum(r["taken"] for r in out if r["source"] == f"s{s}") - target) <= 1
    mixed = source_mix.mixed_documents(docs, weights, epochs).collect()
    assert abs(sum(len(words(r["text"])) for r in mixed) - sum(sizes)) <= len(sizes)


def test_mixed_documents_carry_the_taken_words(docs):
    sized = stage(source_mix.measured(docs), "sized")
    taken = sum(r["taken"] for r in source_mix.mix_sources(sized).collect())
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r["text"])) for r in out.collect()) == taken


def test_mix_prefers_quality(spark):
    rows = [(i, "good words " * 50 if i % 2 else "b#d w0rd5 " * 50, "a") for i in range(400)] + [(1000, "filler " * 40_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mix.mix_sources(stage(source_mix.measured(docs), "sized"), weights=(1, 2)).where("source = 'a'").collect()
    extra = [sum(r["taken"] > r["mix_size"] * (r["target"] // r["source_size"]) for r in out if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert extra[1] >= extra[0]


def test_mix_plan_stays_in_the_jvm(docs):
    plan = source_mix.mix_sources(source_mix.measured(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


PAGES = "page_id long, url string, html string, digest string, payload string, record_type string"


def test_archives_round_trip(spark):
    long, copy = "é<p>" * 30_000, "same " * 40
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://b\r\nx", "short"), (4, "u", "short"), (9, "u", copy), (5, "u", copy), (7, "u", copy), (6, "u", long), (8, "u", long), (10, "u", "x" * 100_000), (None, "u", copy), (11, "u", "0\r\n\r\n" * 50), (5, "u", copy)]
    pages = spark.createDataFrame([(*r, "d", "p", "t") for r in rows], PAGES).repartition(3)
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i is not None and first.get(html, i) != i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert plain(warc.warc_round_trip(pages).collect()) == plain(want)
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_broken_archives_are_refused():
    body = warc.chunked(b"x" * 20_000)
    assert warc.unchunked(body) == b"x" * 20_000 and warc.unchunked(b"5;a=b\r\nhello\r\n0\r\nt: 1\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.unchunked(body[:5000])
    records = warc.page_records(1, "u", b"y" * 100_000, "d", None, "0:1")
    assert len(records) > 2 and b"WARC-Segment-Total-Length" in records[-1]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    kept = stage(corpus_pipeline.drop_toxic(spark, docs, sf), "kept")
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert docs.count() - len(left) <= 1.5 * len(toxic) + 5
    unique = stage(corpus_pipeline.drop_near_duplicates(spark, kept, sf), "unique")
    groups = near_duplicates.near_duplicate_groups(kept, words=5)
    assert unique.count() == groups.select("component_id").distinct().count()
    cut = stage(corpus_pipeline.cut_repeats(spark, unique, sf), "cut")
    assert cut.count() == unique.count() and cut.columns == docs.columns
    mixed = stage(corpus_pipeline.mix(spark, cut, sf), "mixed")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= left
    packed = corpus_pipeline.pack(spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count()


def test_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", x)[0] for x in names if re.match(r"op\d+_", x)}
    assert "pipeline" in names


@pytest.mark.parametrize(("name", "joined", "width"), [("byte_bpe_50k.json", True, 4), ("word_bpe_49k.json", False, 2)])
def test_pieces_give_the_ids_of_whole_texts(name, joined, width):
    from moodframe.llm.token_ids import PieceEncoder

    draw = random.Random(8)
    texts = ["don't I'll 'tis x's", "a_b `c` ^x", "ÀÉß µm ªº ÿ", "x<|endoftext|>y <|endoftext|> z", "(hello) world...\nNext line\n\nmore \n x", "1a2b3 12", "naïve—dash …", "é combining", " nbsp x", "tab\tx  y", "", "  ", "\n", "a\n", "\nb", "HELLO WÖRLD!!", "<x> =y= {z} ~ |"]
    texts += ["".join(draw.choice("abcÀé '\n.,<|>1 \t sS漢") for _ in range(40)) for _ in range(1500)]
    encoder = PieceEncoder(vocabulary(name), joined, width)
    want = [np.array(e.ids, f"<u{width}").tobytes() for e in encoder.encode.encode_batch(texts, add_special_tokens=False)]
    assert encoder.texts(texts) == want
    assert encoder.cuts


@pytest.mark.parametrize(("name", "joined", "width"), [("byte_bpe_50k.json", True, 4), ("word_bpe_49k.json", False, 2)])
def test_pieces_keep_their_ids_beside_wide_blanks_marks_and_special_tokens(name, joined, width, monkeypatch):
    """Also while the memory of a worker is emptied between blocks and texts share a block."""
    from moodframe.llm import token_ids

    monkeypatch.setattr(token_ids, "REMEMBERED", 50)
    monkeypatch.setattr(token_ids, "BLOCK", 2000)
    draw = random.Random(9)
    texts = ["<|endoftext|>", "a<|endoftext|>b, c", "<|startoftext|>,", "x <|endoftext|> y\n<|startoftext|>\n", "\u0301y", "a =\u0338 b=\u0338", "word " * 3000, "x" * 5000 + ", " + "漢" * 3000]
    texts += ["".join(draw.choice("abcÀéİſ '\n.,<|>1 \t sS漢\u00a0\u3000\u2009\u0301=\u0338\x1c~") for _ in range(30)) for _ in range(1500)]
    encoder = token_ids.PieceEncoder(vocabulary(name), joined, width)
    want = [np.array(e.ids, f"<u{width}").tobytes() for e in encoder.encode.encode_batch(texts, add_special_tokens=False)]
    assert encoder.texts(texts) == want


def test_other_tokenizer_files_get_whole_texts(tmp_path):
    """A file that splits in another way than the cuts rely on still gives its own ids."""
    import json

    from moodframe.llm.token_ids import PieceEncoder

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    texts = ["Hello world, again", "", " a  b\nc", "x, y"]
    for change in ({"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "use_regex": False}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        encoder = PieceEncoder(str(path), True, 4)
        assert not encoder.cuts
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.encode.encode_batch(texts, add_special_tokens=False)]
        assert encoder.texts(texts) == want
    assert not PieceEncoder(vocabulary("byte_bpe_50k.json"), False, 4).cuts
    assert not PieceEncoder(vocabulary("word_bpe_49k.json"), True, 4).cuts
