"""The pipeline's stages on the small table."""

import corpus_pipeline
from tests.llm.test_neardup import gram_set
from tests.llm.test_suffixes import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert docs.columns == columns and len(after) == len(rows) and after.keys() <= before.keys()
        if name == "suffix_dedup":
            cut = {k: v for k, *v in brute([(r.doc_id, r.text) for r in before.values()], 200)}
            assert after.keys() == before.keys() and all(cut[k][1] >= len(before[k].text.encode()) - len(r.text.encode()) >= cut[k][1] - 6 * max(1, cut[k][2]) and r.n_chars == len(r.text) for k, r in after.items())
        else:
            assert all(after[k] == before[k] for k in after)
        if name == "near_duplicates":
            sets = {k: gram_set(r.text) for k, r in before.items()}
            near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b) and a
            assert not any(near(sets[a], sets[b]) for a in after for b in after if a < b)
            assert all(any(near(sets[g], sets[k]) for k in before if k != g) for g in before.keys() - after.keys())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(before) and len(pieces) == corpus_pipeline.run(spark, SF).count()


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, h int, kept string"
    long = " ".join(f"word{i} and the" for i in range(3000))
    rows = [(1, None, None, None, None), (None, long, "en", None, 1), (2, long, "en", "s", 2), (2, long, "en", "s", 2), (3, "", "en", "s", 0), (4, long[:5000], None, None, 3)]
    docs = spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], schema)
    for some in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{i}-{some is docs}"
            stage(spark, some, SF).write.parquet(path)
            assert i == 4 or spark.read.parquet(path).columns == docs.columns
