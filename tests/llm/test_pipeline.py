"""The pipeline, stage by stage and as a whole."""

import pytest
from test_operators import brute_mix
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from hanlens.llm import quality_classifier, sentencepiece_dropout
from hanlens.llm.common import table


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        before = corpus_pipeline.written(after, "test")
        sizes.append(before.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    assert all(r.lossless for r in before.select("lossless").collect())


def brute(rows, model):
    """(doc_id, ids) of every row that ``run`` must return for (doc_id, text, source) rows, stage by stage in plain loops."""
    rows = [r for r in rows if model.score(r[1] or "") >= 0.3]
    best = {}
    for d, t, s in rows:
        key = (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        best[key] = min(best.get(key, ((1, 0),)), ((-len(t or ""), d), (d, t, s)))
    rows = [r for _, r in best.values()]
    stay = brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])
    rows = [r for r, c in zip(rows, stay, strict=True) if r[0] == c]
    pieces, out = sentencepiece_dropout.Pieces(), []
    for (d, t, _), (*_, copies) in zip(rows, brute_mix(rows), strict=True):
        cuts = pieces.cut.findall(" " + t) if t else []
        for copy in range(copies):
            keys = pieces._keys(d, copy, len(cuts)).tolist()
            out.append((d, tuple(x for c, k in zip(cuts, keys, strict=True) for x in pieces._code(c, k)[0])))
    return sorted(out)


def test_run_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    got = sorted((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == brute(rows, model) and 0 < len(got) != len(rows)


def test_copies_of_a_mixed_document_draw_differently(spark, sf_dir):
    text = " ".join(f"understanding{k} remarkable" for k in range(50))
    docs = spark.createDataFrame([(k, text, "en", "s", len(text)) for k in (1, 1, 2)], table(spark, sf_dir, "documents").schema)
    assert len({tuple(r.piece_ids) for r in corpus_pipeline.encode(spark, docs, sf_dir).collect()}) == 3


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b c", "en", "s", 5), (3, " ".join(f"w{k}." for k in range(30_000)), "en", "s", 5)]])
@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows_pass_every_stage(spark, sf_dir, rows, extra):
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    if extra:
        docs = docs.selectExpr("*", "'x' AS _hanlens_rid", "'y' AS _copy", "'z' AS Piece_IDs", "1 AS size")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
    out = docs.collect()
    assert len(out) <= 2 * len(rows) and (not rows or all(len(r.text) > 9 for r in out if r.doc_id == 3))
