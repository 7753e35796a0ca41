from collections import Counter

from common import awkward, frame
from test_dedup import A_Z, brute_leaks, brute_near, near_rows, planted

import corpus_pipeline
from studyloom.llm import entries


def tables(spark, path, docs, items, labels):
    frame(spark, docs, extra=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    docs, items = planted()
    rows = awkward() + [(i + 10_000 if i is not None else None, t) for i, t in docs] + [(i + 20_000, t) for i, t in near_rows(9) if i is not None and i >= 1000] + [(40_000, "you idiot moron"), (40_001, "You Idiot moron")]
    tables(spark, tmp_path, rows, items, [])
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = dict(corpus_pipeline.STAGES)
    assert list(at) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    got = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got[name] = Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert not got[name] - Counter(rows)
    assert set(Counter(rows) - got["toxicity"]) == {(40_000, "you idiot moron"), (40_001, "You Idiot moron")}
    norm = lambda t: (t or "").translate(A_Z)
    kept = Counter(norm(t) for _, t in got["exact_dedup"].elements())
    assert set(kept.values()) == {1} and set(kept) == {norm(t) for _, t in rows}
    near = {i for i, _, _, k in brute_near(rows, 5, 80, 100) if k}
    assert got["near_dedup"] == Counter(r for r in rows if r[0] in near)
    leaks = {i for i, _ in brute_leaks(rows, items)}
    assert got["decontamination"] == Counter(r for r in rows if r[0] not in leaks)


def test_run(spark, tmp_path):
    docs, items = planted()
    tables(spark, tmp_path, docs, items, [])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {i for i, _ in docs} and len(got) > 10


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(entries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(entries.oracle_sql()) <= set(names)
