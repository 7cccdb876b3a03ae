"""Queries on keys of more than six digits against their SQL."""

import duckdb
import pytest

from tests.test_queries import plain


@pytest.mark.parametrize("name", ["ingest_names_industries", "src_csv_membership", "src_csv_membership_problems"])
def test_long_part_keys_equal_sql(spark, tmp_path, name):
    """Parts 100,000 to 100,059 and 1,000,000 to 1,000,599: codes are cut to six characters, so some of them stand for eleven parts."""
    from tidemark.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT k AS p_partkey, ['red', 'hot', 'old'][1 + k % 3] || ' ' || ['ring', 'bolt'][1 + k % 2] AS p_name, 'Brand#' || k % 4 AS p_brand, ['SMALL', 'LARGE'][1 + k % 2] AS p_type, CAST(1 + k * 7 % 50 AS INTEGER) AS p_size, 900e0 AS p_retailprice
      FROM (SELECT unnest(range(100000, 100060) || range(1000000, 1000600)) AS k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(plain(v) for v in r) for r in cur.fetchall())
    assert want and sorted(tuple(plain(r[c]) for c in cols) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
