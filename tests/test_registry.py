"""Every registered query against its SQL on the smallest tables."""

import random

import pytest

from folioflow.functions import latex
from folioflow.plans import registry
from tests.conftest import DATA


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    sql = registry.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        assert got == rows_of([c[0] for c in r.description], r.fetchall())


def test_latex_spacing_takes_whole_texts(spark, tmp_path):
    texts = [None, "", "short", "word " * 40 + r"\beta _ { j } ( 1 . 5 ) { x y z }", "{" + " a" * 20_000 + " } \n" + "{" + "b " * 20_000 + "c}" + r" \in { d e }", "$$ x $"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["shown"] for r in registry.queries()["latex_spacing"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else latex.math_string(r"\alpha _ { i } ( 0 . 5 ) { a b c } " + t, True, False) for i, t in enumerate(texts)}
    assert got[3].endswith("β_j(1.5){xyz}$") and len(got[4]) > 40_000


def test_latex_without_python_says_the_same(spark):
    rng = random.Random(3)
    bits = ["\\", "{", "}", " ", "a", "b c", "\\le", "\\leq", "\\infty x", "\\mathrm{d}", "$", "_", "1 .", "{{a}}", "{ a b }", "{a b", "é", "\t", "\\\\alpha"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    made = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[latex.math_text("t", u, False).alias(f"u{int(u)}") for u in (False, True)])
    assert "EvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert all(r["u0"] == latex.math_string(r["t"], False, False) and r["u1"] == latex.math_string(r["t"], True, False) for r in made.collect())


def test_one_row_group_is_spread(spark, tmp_path):
    spark.range(40_000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert registry._read(spark, str(tmp_path), "t").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = registry._spread(spark, str(tmp_path), "t").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 40_000 and max(sizes) <= 11_000


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
