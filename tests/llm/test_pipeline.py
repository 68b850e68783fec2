"""The pipeline and the registered queries over small tables, against brute force."""

import importlib
import re

import duckdb
import pytest

import corpus_pipeline as C
from codeflow.llm import common, queries as Q, toxicity as T

from .test_decontam import brute as contaminated
from .test_minhash import brute as near
from .test_packing import check as check_bins
from .test_secrets import KEY

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def sf_dir(spark, make, prose, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    items = [(i, prose(20 + i, 900 + i)) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        text = prose(30 + i % 40, i)
        toxic = i % 5 == 0
        if toxic:
            text += " vile scoundrel vile scoundrel"
        if i % 17 == 3:
            text += f" token=abcdefgh{i} and {KEY} end"
        if i % 19 == 4:
            text += " " + items[i % 6][1]
        docs.append((i, text))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    docs += [(500 + i, docs[i][1]) for i in range(1, 60, 7)] + [(600 + i, docs[2][1] + " more") for i in range(4)] + [(700, None), (701, ""), (None, prose(30, 77))]
    make(docs).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(120)], "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://x/{i}", f"<article><p>{prose(30, i)}</p></article><footer>x</footer>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


def test_stages(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"] and C.ORACLE_SQL is None
    docs = common.table(spark, sf_dir, "documents")
    labels, items = common.table(spark, sf_dir, "labels"), [tuple(r) for r in common.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    # each stage on all that its predecessor kept
    bad = {(r["doc_id"]) for r in T.score(docs, T.fit(docs, labels)).filter("predicted = 1").collect()}
    assert {i for i in bad if i is not None and i < 240} == {i for i in range(240) if i % 5 == 0}
    want = [x for x in rows(docs) if x[0] not in bad]
    now = common.cut(C.STAGES[0][1](spark, docs, sf_dir))
    assert rows(now) == want and now.columns == docs.columns
    parts = near([x for x in want if x[0] is not None], 5, 80)
    want = [x for x in want if x[0] is None or parts[x[0]][1] == x[0]]
    now = common.cut(C.STAGES[1][1](spark, now, sf_dir))
    assert rows(now) == want and now.columns == docs.columns
    found = {i for i, _ in contaminated([x for x in want if x[1]], items, 5, 0.8)}
    assert found
    want = [x for x in want if x[0] not in found]
    now = common.cut(C.STAGES[2][1](spark, now, sf_dir))
    assert rows(now) == want and now.columns == docs.columns
    want = [(i, t and re.sub(rf"token=\w+ and {KEY}", "[SECRET] and [SECRET]", t)) for i, t in want]
    now = common.cut(C.STAGES[3][1](spark, now, sf_dir))
    assert rows(now) == sorted(want, key=str) and any("[SECRET]" in (t or "") for _, t in want) and now.columns == docs.columns
    lengths = [len((t or "").split()) + 1 for _, t in want]
    check_bins(C.STAGES[4][1](spark, now, sf_dir).collect(), lengths, (256, 512, 1024, 2048, 4096))
    assert sorted(r["length"] for r in C.run(spark, sf_dir).collect()) == sorted(lengths)


def test_stages_on_empty_tables(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    for name in ("labels", "benchmark"):
        common.table(spark, sf_dir, name).limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in C.STAGES:
            now = common.cut(stage(spark, now, f"file://{tmp_path}"))
        assert (now.count() > 0) == (given is docs)


def test_registered_queries(spark, sf_dir):
    found = Q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    for name, f in found.items():
        assert f(spark, sf_dir).count() > 0, name
    entry = importlib.import_module("__spark_entry__")
    assert set(found) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_near_duplicate_sql(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").filter("doc_id is not null")
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(c.execute(Q.oracle_sql()["op8_minhash"]).fetchall())
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in Q.near_duplicates(docs, k=3, percent=85).collect())
    assert got == want
