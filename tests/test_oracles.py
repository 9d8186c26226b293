"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from larkspur.plans import ENTRY, ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, values):
    return sorted(repr(tuple(r[n] for n in names)) for r in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[got.schema[c].dataType.simpleString()] for c in names} == kinds
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


@pytest.mark.parametrize("name", ["evaluated_regions", "early_exit", "better_candidate_fold", "global_hypothesis"])
def test_scores_of_a_threshold_match_sql(spark, tmp_path, name):
    # Part 96900 scores 85 exactly, part 330088 too; as a sum of doubles one is a little less.
    places = [*range(11, 200, 11), 96900, 96910, 96911, 96912, 330088, 330090, 330091]
    parts = [(pos, text, "Brand#1", "PROMO", 1) for text in ("cold rod", "green gadget") for pos in places]
    spark.createDataFrame([(p + 716539 * 44 * k, *more) for k, (p, *more) in enumerate(parts)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLES[name])
    names = sorted(got.columns)
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert ENTRY(spark, DATA).count() > 0
