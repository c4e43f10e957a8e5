"""The stages against plain versions of their decisions, and the entry module without the subpackage."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gaugeline.llm import near_dedup, quality, toxicity

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_every_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            want = toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0")
        elif name == "quality":
            want = quality.score(docs, quality.fit(docs, labels)).where("predicted = 1")
        elif name == "near_dedup":
            want = near_dedup.near_duplicates(docs, 80).where("kept")
        else:
            want = docs
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(ids(docs))
        else:
            assert ids(out) == ids(want)
        if name == "pii":
            assert not out.where(r"text rlike '[a-z0-9]@mail[0-9]\\.example\\.com'").count()
        docs = out
    assert docs.select("doc_id", "piece", "start", "length", "ids_crc32").exceptAll(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")).count() == 0


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(oracle_sql()) <= set(names)


def test_the_entry_module_works_without_the_subpackage(tmp_path):
    (tmp_path / "gaugeline").mkdir()
    for p in (ROOT / "gaugeline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "gaugeline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, m, has = said.stdout.split()
    assert n == m and has == "False"


def test_nulls_empty_tables_and_extra_columns_pass_all_stages(spark, docs, tmp_path):
    rows = [(i, f"row {i} of plain words that say little about anything, told once more by {i}") for i in range(30)]
    rows += [(None, "no id at all"), (None, None), (31, None), (32, ""), (3, rows[3][1]), (5, "another text under an id that is taken"), (33, "word " * 30_000)]
    for k, d in enumerate((docs(rows), docs([]))):
        columns = d.columns
        for name, stage in corpus_pipeline.STAGES:
            d.write.parquet(str(tmp_path / f"{k}{name}"))
            d = stage(spark, spark.read.parquet(str(tmp_path / f"{k}{name}")), SF)
            if name != "packing":
                assert d.columns == columns
        assert k == 0 or d.count() == 0
