from genolith.sources.sinks import TableSet


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_parts_and_changes(spark, tmp_path):
    root = str(tmp_path / "t")
    t = TableSet(spark, root)
    assert len(t) == 0 and "a" not in t
    t.put("a", spark.range(4).selectExpr("id", "'x' AS s"), "id")
    base = t.parts["a"][""][0]
    t.change("a", spark.createDataFrame([(1, "y", 5), (2, None, 6), (9, "z", 7)], "id long, s string, n int"), "id", "first")
    t.change("a", spark.createDataFrame([(2, 8)], "id long, n int"), "id", "second")
    want = [(0, "x", None), (1, "y", 5), (2, None, 8), (3, "x", None)]
    assert rows(t["a"]) == sorted(want, key=str) and t.parts["a"][""][0] == base  # the table was written once
    again = TableSet(spark, root)
    assert rows(again["a"]) == sorted(want, key=str) and list(again) == ["a"]
    # a step that runs again takes the place of what it wrote
    again.change("a", spark.createDataFrame([(3, "w", 1)], "id long, s string, n int"), "id", "first")
    assert rows(again["a"]) == sorted([(0, "x", None), (1, "x", None), (2, "x", 8), (3, "w", 1)], key=str)
    assert rows(TableSet(spark, root)["a"]) == rows(again["a"])
    before = rows(again["a"])
    again.compact()
    assert rows(again["a"]) == before and again.changes["a"] == {}
    again.put("a", spark.range(1).selectExpr("id", "'new' AS s"))
    assert rows(TableSet(spark, root)["a"]) == [(0, "new")]


def test_parts_are_replaced_by_name(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "t"))
    t.put("w", spark.range(2).selectExpr("id", "1 AS a"), part="one")
    t.put("w", spark.range(5, 7).selectExpr("id", "2 AS a", "3 AS b"), part="two")
    t.change("w", spark.createDataFrame([(1, 10), (5, 11)], "id long, c int"), "id", "x")
    assert rows(t["w"]) == sorted([(0, 1, None, None), (1, 1, None, 10), (5, 2, 3, 11), (6, 2, 3, None)], key=str)
    t.compact("w")
    t.put("w", spark.range(8, 9).selectExpr("id", "2 AS a", "3 AS b"), part="two")
    assert [r[0] for r in rows(t["w"])] == [0, 1, 8]


def test_a_write_that_fails_leaves_the_set_as_it_was(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "t"))
    t.put("a", spark.range(3))
    try:
        t.put("a", spark.range(3).selectExpr("raise_error('no') AS id"))
    except Exception:
        pass
    assert rows(TableSet(spark, str(tmp_path / "t"))["a"]) == [(0,), (1,), (2,)]
