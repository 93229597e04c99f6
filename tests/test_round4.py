import duckdb

from quirespark.operators import store
from quirespark.plans.queries import ORACLE_SQL, QUERIES


def as_sql(name, at, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    return want.columns, sorted(want.fetchall(), key=repr)


def test_collections_have_their_place(spark, tmp_path):
    """each collection's place in the order of creation, over all collections."""
    rows = [(k * 37 % 1000, f"s{k % 300}") for k in range(1000)] + [(2000, None), (None, "z"), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["q_collections_by_creation"](spark, str(tmp_path))
    columns, want = as_sql("q_collections_by_creation", tmp_path, "documents")
    assert got.columns == columns == ["id", "created_at", "place"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sorted(r[2] for r in want) == [*range(1, 304)]


def test_place_in_ranges_and_own_columns(spark):
    rows = spark.createDataFrame([(str(k % 7), k // 3, k) for k in range(100)], "id string, created_at long, of_all long")
    got = store.by_creation(rows).collect()
    want = sorted((r.created_at, r.id) for r in rows.collect())
    assert [(r.created_at, r.id) for r in sorted(got, key=lambda r: r.place)] == want
    assert store.by_creation(rows.limit(0)).count() == 0


def test_every_order_deletes_its_customer(spark, tmp_path):
    """orders of every key count, and customers without any stay."""
    spark.createDataFrame([(k, k % 25) for k in range(60)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 45) for k in range(200) if k % 45 != 7], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["q_delete_rows"](spark, str(tmp_path))
    columns, want = as_sql("q_delete_rows", tmp_path, "customer", "orders")
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sorted(r[0] for r in want) == [7, *range(45, 60)]
