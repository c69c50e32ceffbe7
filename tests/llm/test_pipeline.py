"""The pipeline stage by stage against what each stage must keep."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_partenum import brute
from test_stores import expected_tokens

from eventloom.llm import common, lsa_decontam, queries
from eventloom.llm.common import materialize


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "t-stage")
        assert docs.columns == columns, name
        seen.append(docs)
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    for before, after in zip(rows, rows[1:]):
        assert after.items() <= before.items()  # rows are dropped, never changed
    raw, good, single, clean, mixed = rows
    judged = {r.doc_id for r in queries.op7_quality_rules(spark, sf_dir).collect() if r.kept}
    assert set(good) == judged
    groups = brute([(i, r.text) for i, r in good.items()], 5, 80, 100)
    assert set(single) == {c for _, _, c in groups}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {i for i, r in single.items() if any(b in " ".join(r.text.lower().split()) for b in bench)}
    assert set(clean) == set(single) - dirty
    assert 0 < len(mixed) <= len(clean)
    expected = expected_tokens([(i, r.text) for i, r in mixed.items()])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected


def test_stages_take_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, contamination int, sampled int, kept int, _doc string"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, 2, 3, 4, "x"), (1, words, "en", "a", 1, 2, 3, 4, "x"), (2, words + " end", None, None, 1, 2, 3, 4, "x"), (None, re.sub("w", "v", words), "en", "a", 1, 2, 3, 4, "x"), (3, None, "en", "a", 1, 2, 3, 4, "x"), (4, "", "en", "a", 1, 2, 3, 4, "x")]
    docs = spark.createDataFrame(rows, schema)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "t-odd")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
        kept.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert kept[0] == ["1", "1", "2", "None"] and kept[1] == ["1", "None"] and kept[2] == ["1", "None"]
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_which_row_of_an_id_stays_does_not_depend_on_partitions(spark, sf_dir):
    rows = [(i % 5, f"text {i} " + " ".join(f"w{j}" for j in range(30)) if i % 2 else f"other words {i}", "en", "a", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs.repartition(n), sf_dir).collect())) for n in (1, 7)]
    assert kept[0] == kept[1] and len({r[0] for r in kept[0]}) == len(kept[0])


def test_decontamination_does_not_depend_on_which_ids_documents_have(spark, sf_dir, monkeypatch):
    """Its basis was that of 2,000 documents, chosen by their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    many = docs.crossJoin(spark.range(15).withColumnRenamed("id", "k")).selectExpr("doc_id + 1000000 * k AS doc_id", "concat_ws(' ', text, substring(text, 1 + 40 * k, 200)) AS text", "lang", "source")
    inner, seen = lsa_decontam.with_contamination, []
    monkeypatch.setattr(lsa_decontam, "with_contamination", lambda *a, **k: seen.append(inner(*a, **k)) or seen[-1])
    kept = []
    for shift in (0, 7):
        corpus_pipeline.decontamination(spark, many.withColumn("doc_id", F.col("doc_id") + shift), sf_dir)
        rows = seen[-1].select(F.col("doc_id") - shift, F.inline("contamination")).collect()
        kept.append({(r[0], r.item_id): r.cosine for r in rows})
    assert many.count() > 2000 and len(kept[0]) > 0
    assert kept[0] == pytest.approx(kept[1], abs=1e-4)


def texts_dealt_out(df):
    """Rows with a text that the exchanges of a collected table wrote."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and "text#" in node.output().toString():
                total += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.fixture
def no_broadcast(spark):
    """As with tables that are too large to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_that_stay_are_not_dealt_out_to_drop_copies(spark, sf_dir, no_broadcast):
    """All texts were, once their copies' ids were too many to be broadcast."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, words(i % 300), "en", "a", i) for i in range(320)] + [(None, words(0), "en", "a", 0)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "t-docs")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*range(300), None]))
    assert 20 <= texts_dealt_out(kept) <= 40


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_without_is_a_left_anti_join(spark, no_broadcast, monkeypatch, most, kind):
    monkeypatch.setattr(common, "MOST_BITS", most)
    docs = spark.range(-3000, 60_000).selectExpr(f"CAST(id AS {kind}) AS doc_id", "concat('t', id) AS text", "id % 3 AS `a.b`")
    docs = docs.union(spark.sql(f"SELECT CAST(null AS {kind}), 'n', 1")).union(docs.where("doc_id < 50"))
    for ids in (spark.range(-9000, 60_000, 3).toDF("doc_id"), spark.range(0).toDF("doc_id")):
        expected = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", "`a.b`")
        got = common.without(docs, ids, "doc_id")
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0 < got.count()
