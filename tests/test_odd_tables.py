"""Queries against their SQL on small tables that hold what the given ones lack."""

import duckdb
import pytest

from tests.test_queries import rows_of
from townkit.plans import catalogue, registry  # noqa: F401

SMALL = "/root/testdata/sf0.001"
CUSTOMERS = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL, over the given rows of one table and the nations."""

    def run(query, table, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        spark.read.parquet(f"{SMALL}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
        con = duckdb.connect()
        for name in (table, "nation"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        found = registry.QUERIES[query](spark, str(tmp_path))
        result = con.execute(registry.ORACLE_SQL[query])
        columns = [d[0] for d in result.description]
        return rows_of(columns, [r.asDict(recursive=True) for r in found.collect()]), rows_of(columns, [dict(zip(columns, r, strict=True)) for r in result.fetchall()])

    return run


def customer(key, balance=1.0):
    return (key, f"Customer#{key:09d}", key % 25, balance, "FURNITURE")


def test_points_on_the_sides_of_boxes(both):
    found, expected = both("bbox_join", "customer", CUSTOMERS, [customer(k) for k in (1520, 7520, 14360)])
    assert found == expected and len(found) == 2


def test_fees_of_nothing_and_no_fees(both):
    found, expected = both("venue_projection", "customer", CUSTOMERS, [customer(1, 0.0), customer(2, -0.5), customer(3, 12.3), customer(4, None)])
    assert found == expected and len(found) == 4


def test_chains_that_meet_a_cycle_have_no_end(both):
    found, expected = both("canonical_chain", "customer", CUSTOMERS, [customer(k) for k in range(120)])
    assert found == expected and sum("'canonical': None" in r or "[None" in r for r in found) == 5


def test_an_amount_is_read_once_a_row(spark):
    found = registry.QUERIES["price_triple"](spark, SMALL)
    assert found.columns == ["id", "price", "was", "discount"]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("try_to_number") + found._jdf.queryExecution().optimizedPlan().toString().lower().count("trytonumber") <= 3
