"""Stages of the pipeline on documents with columns named like those of the operators."""

import corpus_pipeline
import pytest

NAMES = ["mix_key", "mix_source", "source_rows", "mix_range", "mix_before", "target", "taken", "source_size", "mix_size", "mix_words", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


@pytest.mark.parametrize("stage", ["suffix_array_dedup", "source_mix"])
def test_clashing_columns_keep_their_values(spark, sf, stage):
    repeated = " ".join(f"again{i}" for i in range(60))
    texts = [f"own{i} words{i} here{i} " + (repeated if i < 2 else " ".join(f"u{i}_{k}" for k in range(60))) for i in range(6)] + [None, ""]
    rows = [(i, t, f"s{i % 2}", "en", len(t or ""), *(100 * i + k for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} long" for n in NAMES))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf)
    assert out.columns == docs.columns
    found = out.collect()
    ids = {r["doc_id"] for r in found}
    assert (ids and ids <= set(range(6))) if stage == "source_mix" else ids == set(range(8))
    assert all(r[n] == 100 * r["doc_id"] + k for r in found for k, n in enumerate(NAMES))
    if stage == "suffix_array_dedup":
        assert len(found) == 8 and all("again30" not in (r["text"] or "") for r in found) and all(r["text"] == texts[r["doc_id"]] for r in found if r["doc_id"] > 1)
