import os
import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from treelens.llm import decontam, pii
from treelens.llm.common import table

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii_redaction", "source_mix"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(rows) <= docs.count()
    bench = [decontam.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert not any(b in decontam.normalise(r.text) for r in rows.values() for b in bench)
    left = spark.createDataFrame([(i, r.text) for i, r in rows.items()], "doc_id long, text string")
    assert pii.find(left).where("spans <> ''").count() == 0
    assert all(r.size == len(r.text.encode().split()) and 0 < r.taken <= 3 * r.size for r in rows.values())


def test_language_stage_rejects_what_has_no_language(spark):
    docs = table(spark, SF, "documents")
    texts = {r.lang: r.text for r in docs.where("n_chars between 800 and 3000").orderBy("doc_id").collect()}
    dice = random.Random(4)
    mixed = " ".join(" ".join(t.split()[:40]) for _, t in sorted(texts.items()))
    junk = " ".join("".join(dice.choice("bcdfghjklmnpqrstvwxz") for _ in range(dice.randint(3, 9))) for _ in range(80))
    bad = ["漢字 中文 文章 " * 20, "слово о полку игореве " * 20, junk, mixed, "123 !?"]
    rows = [(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(bad)]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF).collect()}
    assert len(texts) == 4 and not kept & {r[0] for r in rows}
    words = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert len(words - kept) <= 0.01 * len(words)


def test_stages_keep_the_columns_and_survive_nulls(spark):
    docs = table(spark, SF, "documents").limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, None, None, "s", 0)], table(spark, SF, "documents").schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        stage(spark, docs.limit(0), SF).count()
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_executors_need_no_repository(tmp_path):
    """A driver that alone has the repository on its path, in another directory."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
try:
    spark.range(1).mapInPandas(lambda b: (__import__("treelens") and x for x in b), "id long").collect()
    raise SystemExit("the executors have the repository")
except Exception as e:
    assert "No module named" in str(e)
from treelens.llm import queries
import corpus_pipeline
for name, query in (*queries.queries().items(), ("pipeline", corpus_pipeline.run)):
    print(name, query(spark, {SF!r}).count())
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stdout + done.stderr[-3000:]
