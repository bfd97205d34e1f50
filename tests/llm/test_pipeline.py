"""The pipeline: each stage's decisions take effect, and every registered query runs."""

import random

import corpus_pipeline
from facetmatch.llm import queries
from tests.llm.test_structures import SCHEMA, edited, prose


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(1)
    bench = prose(25, rng)
    token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    base = prose(200, rng)
    rows = [(i, prose(60, rng)) for i in range(30)] + [(100, base), (101, edited(base, 0.02, rng)), (102, base), (200, prose(10, rng) + " " + bench), (300, f'{prose(30, rng)} token = "{token}"'), (400, ""), (401, None), (402, "%%% 111")]
    data = [(i, t, "en" if t else None, "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(data, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = at.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns and at.dtypes == docs.dtypes
    ids = {k: {r["doc_id"] for r in v} for k, v in kept.items()}
    assert ids["language"] == {i for i, _ in rows} - {400, 401, 402}
    assert ids["near_duplicates"] == ids["language"] - {101, 102}
    assert ids["decontaminate"] == ids["near_duplicates"] - {200}
    assert ids["secrets"] == ids["decontaminate"]
    changed = {r["doc_id"]: r for r in kept["secrets"]}[300]
    assert token not in changed["text"] and "[SECRET]" in changed["text"] and changed["n_chars"] == len(changed["text"])
    assert ids["pack"] == ids["secrets"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, kept["pack"]))


def test_stages_on_odd_tables(spark, tmp_path):
    """Further columns with clashing names, null ids, repeated rows; and empty tables."""
    rng = random.Random(2)
    rows = [(i, prose(60, rng), "en", "s", 1) for i in range(12)] + [(None, prose(60, rng), "en", "s", 1), (3, "", "en", "s", 0), (20, None, None, None, None), (21, prose(4000, rng), None, None, None)]
    rows += [rows[0], rows[12]]
    plain = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = plain.selectExpr("*", "1 AS TEXT", "'x' AS Doc_Id", "2 AS score", "3 AS key")
    for docs in (clash, clash.limit(0)):
        odd = bool(docs.head(1))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = [r[0] if name != "pack" else r["doc_id"] for r in out.collect()]
            assert name == "pack" or out.columns == docs.columns
            want = [*range(12), None, 3, 20, 21, 0, None] if odd else []
            gone = {"language": [3, 20], "near_duplicates": [3, 0], "pack": [None, None, 3, 20]}.get(name, []) if odd else []
            for g in gone:
                want.remove(g)
            assert sorted(set(got) if name == "pack" else got, key=str) == sorted(set(want) if name == "pack" else want, key=str), name


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 11)] and names[-1] == "pipeline"
