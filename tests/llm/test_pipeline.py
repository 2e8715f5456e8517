"""The pipeline's stages on a small table, against what each operator decides."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from pagewright.llm import common, jaccard_join, knn_quality, line_frequency, soft_mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.written(stage(spark, before, SF))
        assert after.columns == names and 0 < after.count() <= before.count()
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality":
            model = knn_quality.fit(knn_quality.train_fold(before, spark.read.parquet(f"{SF}/labels.parquet")))
            assert kept == {r.doc_id for r in knn_quality.scored(before, model).where(f"score >= {knn_quality.THRESHOLD}").collect()}
        elif name == "rules":
            assert kept == {r.doc_id for r in line_frequency.judged(line_frequency.line_stats(before)).where("kept").collect()}
        elif name == "near_duplicates":
            assert kept == {r.doc_id for r in jaccard_join.near_components(before).where("doc_id = component_id").collect()}
        before = after
    out = pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, repeated ids with other texts, and columns named like those of the operators."""
    words = [f"w{i}" for i in range(200)]
    plain = " ".join(words)
    near = " ".join(["new", *words[1:]])
    rows = [(None, plain), (None, plain), (5, near), (3, plain), (3, plain), (3, "another text " + " ".join(reversed(words))), (None, "only here " + " ".join(words[::3] * 2)), (7, None), (None, ""), (8, " ".join(words[::2])), (9, " ".join(words[::2]))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "k", 1, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component string, rate int, kept boolean")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    labels.write.parquet(f"{folder}/labels.parquet")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, frame, folder).collect()]
    assert sorted(got, key=str) == sorted([(3, plain), rows[5], rows[6], (7, None), (None, ""), (8, rows[9][1])], key=str)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.schema == frame.schema and out.count() <= len(rows), name
    mixed = [(r.doc_id, r.text) for r in pipeline.mixing(spark, frame, folder).collect()]
    assert sorted(mixed, key=str) == sorted(rows, key=str)  # one class alone is the whole mix


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_sums_come_to_the_driver_once(spark, monkeypatch):
    """The arrays of many tasks are added up on executors: what is collected is one array, whatever the number of tasks."""
    rows = spark.range(0, 40, 1, 10)
    kind, sizes = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [sizes.append(len(r.part)) or r for r in collect(self)])
    dims = knn_quality.DIMS

    def arrays(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield i, np.arange(dims) * i

    assert (knn_quality._summed(rows, arrays, np.int64) == np.arange(dims) * sum(range(40))).all()
    assert sum(sizes) == 8 * dims


def test_rounds_have_no_shuffle(spark):
    """A round of the mix is one job of one stage: a row of sums a task comes to the driver."""
    soft = pipeline.written(spark.range(0, 300, 1, 6).selectExpr("id as doc_id", "id % 7 + 1 as n_tokens", "array(0.5D, 0.3D, 0.2D) as p"))
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "")
    steps = soft_mixing.solve(soft, {"clean": 0.9, "low": 0.1}, rounds=3, tolerance=0.0)[1]
    sc._jsc.clearJobGroup()
    jobs = [sc.statusTracker().getJobInfo(i) for i in sc.statusTracker().getJobIdsForGroup("rounds")]
    assert steps and len(jobs) == 1 + len(steps) and all(len(j.stageIds) == 1 for j in jobs)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_batches_are_bounded(spark, stage):
    """What goes to a Python worker at once is bounded in bytes, while a text above the bound goes whole."""
    texts = spark.range(0, 60, 1, 1).selectExpr("repeat('x', if(id = 40, 6000000, 300000)) as text")

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([sum(map(len, batch.column(0).to_pylist()))])], ["held", "letters"])

    def batches():
        return texts.mapInArrow(measured, "held long, letters long").collect()

    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
        got = batches()
        assert sum(r.letters for r in got) == 59 * 300_000 + 6_000_000
        assert sorted(r.held for r in got)[-2] < common.BATCH_BYTES + 400_000 and max(r.held for r in got) < common.BATCH_BYTES + 6_400_000
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
        assert len(batches()) > len(got)  # a smaller setting stays
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_small_tables_are_few_files(spark, monkeypatch):
    """Tables of near_components whose rows are known have a file a core at most, however many shuffle partitions there are;
    result and components are as with few partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    extra = docs.selectExpr("doc_id + 10000 as doc_id", "concat(text, ' more') as text").unionByName(docs.selectExpr("doc_id + 20000 as doc_id", "concat('first ', text) as text"))
    docs = docs.unionByName(extra)
    before = sorted(map(str, jaccard_join.near_components(docs).collect()))
    made, path = [], common.new_path
    monkeypatch.setattr(common, "new_path", lambda *a: made.append(path(*a)) or made[-1])
    shuffle, merge = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(shuffle, "24")
        spark.conf.set(merge, "false")
        assert sorted(map(str, jaccard_join.near_components(docs).collect())) == before
    finally:
        spark.conf.set(shuffle, "4")
        spark.conf.unset(merge)
    files = {kind: [len(list(Path(p.removeprefix("file://")).glob("part-*"))) for p in made if f"/{kind}-" in p] for kind in ("classes", "ids", "edges", "links")}
    assert files["classes"] and files["ids"] and len(files["edges"]) >= 3
    assert max(max(n, default=0) for n in files.values()) <= spark.sparkContext.defaultParallelism
    assert len({r.component_id for r in jaccard_join.near_components(docs).collect()}) < docs.count()


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    rows = spark.range(0, 200, 1, 40)
    assert [common.in_tasks(rows, n).rdd.getNumPartitions() for n in (1, 100, 200, 1000)] == [4, 10, 20, 40]
    assert sorted(r.id for r in pipeline.written(rows, rows=200).collect()) == list(range(200))
