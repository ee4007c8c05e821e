import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_queries_give_what_their_sql_gives(spark, sf_dir, duck, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_smoke_query(spark):
    assert entry.entry(spark).count() > 0


def test_plans_prune_and_limit_early(spark, sf_dir):
    plan = lambda n: entry.queries()[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan("find_refs_locations") and "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan("find_refs_locations").replace("\n", "")
    assert "WindowGroupLimit" in plan("path_rank_topk")
    assert "CartesianProduct" not in "".join(plan(n) for n in ("find_context", "smallest_scope", "fair_limit", "verb_find"))


def test_words_are_classified_without_a_shuffle(spark, sf_dir):
    plan = entry.queries()["def_ref_classification"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_files_of_several_rows_are_classified_as_one(spark, tmp_path):
    texts = ["the cat the\ncat the\n\nthe-cat x\nthe", "cat cat\nthe é_1 é_1\r\n\n", None, "", " the\nthe  the", "a\n" * 3000 + "b " * 3000]
    docs = [(k, x, "en", "s") for k, x in enumerate(texts)] + [(0, texts[1], "en", "s"), (0, texts[0], "en", "s"), (None, texts[0], "en", "s"), (None, texts[1], "fr", None)]
    sql = entry.oracle_sql()["def_ref_classification"]
    for part in (docs, docs[:6]):
        spark.createDataFrame(part, "doc_id bigint, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        connection = duckdb.connect()
        connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        got, want = entry.queries()["def_ref_classification"](spark, str(tmp_path)).toPandas(), connection.sql(sql).df()
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns)) and len(got)
