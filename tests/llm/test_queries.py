"""Registered queries with SQL against it, and the pipeline's stages on their own input."""

import pytest

import corpus_pipeline
from folioflow.llm import decontamination, queries, quality, secrets, similar
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    r = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(r.fetchall())


def test_all_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in found if k.startswith("op")}


def test_stages(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = source
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DATA)
        if k == 4:
            got = {r["doc_id"]: r for r in out.collect()}
            assert {i: got[i]["decoded"] for i in got} == before and all(len(r["ids"]) == r["n_pieces"] for r in got.values())
            break
        assert out.columns == source.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if k == 0:
            assert set(after) == {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()} and after.items() <= before.items()
        elif k == 1:
            near = similar.near_duplicates(docs).collect()
            assert set(after) == {r["component_id"] for r in near} and len(after) < len(before)
        elif k == 2:
            hit = {r["doc_id"] for r in decontamination.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("n_hit > 0").collect()}
            assert hit and after == {i: t for i, t in before.items() if i not in hit}
        else:
            assert set(after) == set(before) and not any(secrets.base_spans(t) for t in after.values())
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_stages_take_odd_rows(spark):
    """Null, empty, repeated and long rows, null ids, and columns with names of the operators' own."""
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    clean = decontamination.clean_documents(quality.kept_documents(spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en'")), items)
    good = [r["text"] for r in clean.filter("length(text) between 300 and 3000").orderBy("doc_id").limit(50).collect()]
    good = list(dict.fromkeys(good))
    alone, good = good[-3:], good[:-3]
    item = items.filter("item_id = 1").head()["text"]
    made = [(i, t, "en") for i, t in enumerate(good)] + [(100, None, "en"), (101, "", None), (102, good[3], "en"), (103, good[3], "en"), (103, good[3], "en"), (None, good[5] + " one more", "en"), (104, alone[0] + " " + item, "en"), (105, " ".join(good) + alone[1], "en"), (106, alone[2] + ' token = "0123456789abcdef0123456789abcdef"', "en")]
    docs = spark.createDataFrame([(*r, 1, "k", [1], "x") for r in made], "doc_id long, text string, lang string, row long, items string, hi array<int>, `a b` string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, DATA)
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k in (0, 1, 2):
            left = list(map(repr, before))
            for r in map(repr, after):
                left.remove(r)
        ids = [r["doc_id"] for r in after]
        if k == 0:
            assert not {100, 101} & set(ids) and ids.count(103) == 2 and None in ids
        elif k == 1:
            assert not {102, 103} & set(ids) and 3 in ids and None in ids
        elif k == 2:
            assert 104 not in ids and {105, 106} <= set(ids) and None in ids
        elif k == 3:
            assert sorted(map(repr, ids)) == sorted(repr(r["doc_id"]) for r in before)
            assert next(r["text"] for r in after if r["doc_id"] == 106).endswith('token = "[assign removed]"')
        else:
            assert sorted((repr(r["doc_id"]), r["decoded"]) for r in after) == sorted((repr(r["doc_id"]), r["text"]) for r in before)
        docs = spark.createDataFrame(after, out.schema)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0
        docs = docs if "ids" in out.columns else out
