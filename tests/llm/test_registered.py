"""The registered queries beside their SQL, and the pipeline."""

import pytest

import __spark_entry__ as entry_file
import check
import corpus_pipeline
from palisade.llm.queries import ORACLES, QUERIES


def test_all_and_the_pipeline_are_registered():
    names = entry_file.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and "pipeline" in names
    assert set(QUERIES) <= set(names) and set(ORACLES) <= set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    problem, rows = check.compare(spark, check.connect(data), data, name, QUERIES[name], ORACLES[name])
    assert problem is None and rows > 0


def test_native_operator_has_no_python(spark, data):
    plan = QUERIES["op3_quality_rules"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if w in plan]


def test_pipeline_stages(spark, data, small):
    docs, seen = small, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == small.columns
        seen.append((docs.count(), out.count(), docs, out))
        docs = out
    (before, good, _, _), (_, single, _, unique), (_, clean, _, _), (_, mixed, whole, mix) = seen
    assert before > good >= single >= clean > 0 and mixed > 0
    from palisade.llm import jaccard_join

    again = jaccard_join.near_duplicates(unique).collect()
    assert all(r["component_rows"] == 1 for r in again)
    words = lambda df: df.selectExpr("sum(size(filter(split(text, '[ \\\\t-\\\\r]+'), x -> x <> '')))").first()[0]
    assert abs(words(mix) - words(whole)) <= 64 * 3 * 25
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() == mixed


def test_pipeline_stages_take_odd_rows(spark, tmp_path, odd, none):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "short")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == odd.columns
            stage(spark, docs, folder).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
