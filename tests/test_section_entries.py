from lexmill.operators import segments


def test_sections_need_no_array_of_a_volume(spark):
    hints = spark.createDataFrame([("v", 1, "a"), ("v", 2, "b"), ("v", 3, "a"), ("v", 4, None), ("v", 5, "c"), ("w", 9, "b"), ("w", 7, "b")], "volume string, place int, section string")
    got = segments.one_way_sections(hints, "volume", "place", "section")
    assert sorted(map(tuple, got.collect())) == [("v", "a", 1), ("v", "b", 2), ("v", "c", 5), ("w", "b", 7)]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
