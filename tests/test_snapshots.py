from siltstone.operators import search, snapshots
from siltstone.operators.ordinals import with_ordinal

PARAM = "array<struct<name string, type string, required boolean>>".replace(" string", ": string").replace(" boolean", ": boolean")
SCHEMA = f"row_id bigint, project string, snapshot_no int, received_at bigint, protocol string, httpMethod string, path string, operationType string, fieldName string, name string, handler string, returnType string, parameters {PARAM}, key string"


def row(i, snap, path, handler="h", params=None, project="p", at=1, method="GET"):
    return (i, project, snap, at, "rest", method, path, None, None, None, handler, None, params, "clash")


def changes(spark, rows):
    return sorted(tuple(r) for r in snapshots.endpoint_changes(spark.createDataFrame(rows, SCHEMA)).collect())


def test_added_removed_modified_over_a_gap(spark):
    rows = [row(1, 1, "/a"), row(2, 1, "/b"), row(3, 3, " /a/ ", handler="x", method="get"), row(4, 3, "/c")]
    assert changes(spark, rows) == [("p", 3, "rest:GET:/a", "modified"), ("p", 3, "rest:GET:/b", "removed"), ("p", 3, "rest:GET:/c", "added")]


def test_latest_delivery_holds_and_parameter_order_is_no_change(spark):
    a, b = ("x", "int", True), ("y", None, None)
    rows = [row(1, 1, "/a", params=[a, b]), row(2, 2, "/a", params=[b, a], at=2), row(3, 2, "/a", handler="old", at=1), row(4, 1, "/n", params=None), row(5, 2, "/n", params=[]), row(6, 2, "/n", params=[])]
    assert changes(spark, rows) == []


def test_nulls_and_empty(spark):
    assert changes(spark, []) == []
    rows = [row(1, 1, "/a"), row(2, 2, None), row(3, None, "/z"), row(4, 2, "/z", project=None)]
    assert changes(spark, rows) == [("p", 2, "rest:GET:/a", "removed")]


def test_more_than_one_word_of_keys(spark):
    rows = [row(i, 1, f"/k{i}") for i in range(300)] + [row(1000 + i, 2, f"/k{i}", handler="new" if i % 3 == 0 else "h") for i in range(100, 400)]
    found = changes(spark, rows)
    assert len([c for c in found if c[3] == "added"]) == 100
    assert len([c for c in found if c[3] == "removed"]) == 100
    assert {c[2] for c in found if c[3] == "modified"} == {f"rest:GET:/k{i}" for i in range(100, 300) if i % 3 == 0}


def test_ordinals_are_dense_and_persistent(spark):
    df = spark.createDataFrame([("g", s, f"k{s}{i}") for s in (1, 2) for i in range(50)], "g string, s int, k string")
    both = {r["k"]: r["ordinal"] for r in with_ordinal(df, ["g"], ["s"], ["k"]).collect()}
    alone = {r["k"]: r["ordinal"] for r in with_ordinal(df.where("s = 1"), ["g"], ["s"], ["k"]).collect()}
    assert sorted(both.values()) == list(range(100))
    assert all(both[k] == o for k, o in alone.items())


def test_idf(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None)], "doc_id bigint, text string").where("text is not null")
    found = {r["term"]: round(r["idf"], 6) for r in search.idf(search.postings(docs, "doc_id", "text"), docs).collect()}
    assert found == {"alpha": 1.0, "beta": 1.405465}


def test_stored_ordinals_stay(spark):
    schema = "row_id bigint, received_at bigint, project string, snapshot_no int, key string, mark bigint"
    rows = spark.createDataFrame([(1, 1, "p", 2, "b", 1), (2, 1, "p", 2, "c", 1), (3, 1, "p", 4, "b", 2)], schema)
    known = snapshots.ordinals(rows)
    before = {r["key"]: r["ordinal"] for r in known.collect()}
    assert sorted(before.values()) == [0, 1]
    # A late row of an old snapshot brings a new key: it comes behind the known ones.
    late = rows.union(spark.createDataFrame([(4, 2, "p", 1, "a", 1), (5, 2, "q", 1, "z", 1)], schema))
    after = {(r["project"], r["key"]): r["ordinal"] for r in snapshots.ordinals(late.where("key <> 'c'"), known).collect()}
    assert after == {("p", "b"): before["b"], ("p", "c"): before["c"], ("p", "a"): 2, ("q", "z"): 0}
    want = {("p", 2, "a", "removed"), ("p", 2, "b", "added"), ("p", 2, "c", "added"), ("p", 4, "c", "removed"), ("p", 4, "b", "modified")}
    for stored in (None, known):
        assert {tuple(r) for r in snapshots.diff_snapshots(late, known=stored).collect()} == want
