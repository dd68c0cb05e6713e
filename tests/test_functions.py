"""Column functions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarmac.functions import geo, numbers, tags, text, weather


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_round_tenth_is_pythons(spark):
    rng = random.Random(1)
    xs = [k / 20 for k in range(-400, 2001)] + [rng.uniform(-100, 100) for _ in range(3000)] + [k / 100 for k in range(0, 10_000, 5)] + [0.15, 0.25, 0.35, 2.675, 0.049999999999999996, -0.05]
    got = values(spark, [(x,) for x in xs] + [(None,)], "x double", "x", numbers.round_tenth(F.col("x")))
    assert [(x, y) for x, y in got if x is not None and y != round(x, 1)] == []
    assert got[-1] == (None, None)


def test_lines(spark):
    points = [(-5.0, 10.0), (0.0, 0.0), (10.0, 40.0), (20.0, 40.0), (30.0, 100.0)]
    got = values(spark, [(x,) for x in (-9.0, -5.0, -2.5, 0.0, 5.0, 15.0, 25.0, 99.0, None)], "x double", numbers.interpolate(F.col("x"), points))
    assert [g[0] for g in got] == [10.0, 10.0, 5.0, 0.0, 20.0, 40.0, 70.0, 100.0, None]
    back = values(spark, [(s,) for s in (0.0, 20.0, 40.0, 70.0, 100.0, 120.0, None)], "s double", numbers.first_reached(F.col("s"), points))
    assert [b[0] for b in back] == [0.0, 5.0, 10.0, 25.0, 30.0, 30.0, None]
    with pytest.raises(ValueError):
        numbers.interpolate(F.lit(1.0), [(1.0, 0.0), (1.0, 2.0)])


def test_compensated_sum_and_digits(spark):
    got = values(spark, [(1e16, 1.0, -1e16)], "a double, b double, c double", numbers.compensated_sum([F.col(c) for c in "abc"]), numbers.round_significant(F.lit(123_456.0)), numbers.round_significant(F.lit(0.0)))
    assert got == [(1.0, 123_500.0, 0.0)]


def test_geometry(spark):
    (row,) = values(spark, [(139.7, 35.6, 139.8, 35.7)], "a double, b double, c double, d double", geo.haversine_m(*map(F.col, "abcd")), geo.bearing_deg(*map(F.col, "abcd")), geo.tile_x(F.col("a"), 14), geo.tile_y(F.col("b"), 14))
    assert row[0] == pytest.approx(14_333, rel=0.01) and 35 < row[1] < 45
    assert row[2:] == (int((139.7 + 180) / 360 * 2**14), int((1 - math.asinh(math.tan(math.radians(35.6))) / math.pi) / 2 * 2**14))
    square = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    inside = values(spark, [(0.5, 0.5), (1.5, 0.5), (-0.1, 0.2), (0.2, 0.9)], "x double, y double", geo.ring_contains(square, F.col("x"), F.col("y")))
    assert [i[0] for i in inside] == [True, False, False, True]
    grades = values(spark, [(0.0,), (80.0,), (100.0,), (180.0,), (300.0,)], "t double", geo.effective_gradient(F.lit(4.0), F.lit(0.0), F.col("t")))
    assert [g[0] for g in grades] == [4.0, None, None, -4.0, 4.0]
    turns = values(spark, [(350.0, 10.0), (10.0, 350.0), (0.0, 180.0), (0.0, 181.0)], "a double, b double", geo.turn_deg(F.col("a"), F.col("b")), geo.folded_angle_deg(F.col("a"), F.col("b")))
    assert turns == [(20.0, 20.0), (-20.0, 20.0), (180.0, 180.0), (-179.0, 179.0)]


def test_tags(spark):
    rows = [(" Asphalt ", None, "residential"), ("rails", "grade4", "track"), (None, "grade2", "track"), (None, None, "track"), ("other", None, "service"), (None, None, None)]
    got = values(spark, rows, "s string, t string, h string", tags.surface_class(F.col("s")), tags.surface_estimate(*map(F.col, "sth")), tags.highway_rank(F.col("h")))
    assert got == [("paved", "paved", 1), ("other", "soil", 0), (None, "gravel", 0), (None, "unknown_track", 0), ("other", "unknown_road", 1), (None, None, 0)]
    numbers_ = values(spark, [("12",), (" 3.7 ",), ("0",), ("-2",), ("12 km/h",), ("",), (None,), ("99999999999",)], "n string", tags.positive_int(F.col("n")))
    assert [n[0] for n in numbers_] == [12, 3, None, None, None, None, None, None]
    flags = values(spark, [(1, "yes"), (1, None), (None, None)], "k int, v string", tags.absent_is_false(F.col("k").isNotNull(), F.col("v") == "yes"), tags.any_of([F.col("v"), F.lit(None)], ["yes"]))
    assert flags == [(True, True), (False, False), (None, False)]
    ways = values(spark, [("no", "yes", None), (None, "-1", None), (None, None, "roundabout"), (None, None, None), ("x", "1", None)], "b string, o string, j string", tags.travel_direction(*map(F.col, "boj")))
    assert [w[0] for w in ways] == ["both", "backward", "forward", "both", "forward"]


def test_text(spark):
    got = values(spark, [("ＡＢＣ Café-1", "+81 (0)3-1234-5678", "https://www.Ex.com/a/?x#y"), (None, "", None)], "n string, p string, w string", text.name_key(F.col("n")), text.phone(F.col("p")), text.website(F.col("w")))
    assert got == [("abccafé1", "0312345678", "ex.com/a/?x#y"), (None, None, None)]
    assert [text.written_number(t) for t in ("二十三", "百", "一二", "千二百", "x", "")] == [23, 100, 12, 1200, None, None]
    assert [text._address(t) for t in ("東京都　千代田区一丁目２番３号", "大字平井１２３番地", "二十三丁6", "霞ヶ関", "霞が関", "虎ノ門", "虎の門", "十", "〇五", "百二十", "ABC ー 1")] == ["東京都千代田区1-2番3号", "平井123番地", "23-6", "霞ケ関", "霞ケ関", "虎ノ門", "虎ノ門", "10", "5", "百20", "abc-1"]
    assert [r[0] for r in values(spark, [("A & B (x)!",), ("Ａ－ｂ・c d",)], "n string", text.name_key(F.col("n")))] == ["a&b(x)!", "abcd"]
    rows = [(["東京都", "西多摩郡", "日の出町", None, "大字平井"], ["prefecture", "county", "city", "ward", "oaza"], ["", "一丁目"]), ([None, ""], ["prefecture", "city"], [""])]
    got = values(spark, rows, "n array<string>, l array<string>, t array<string>", text.place_keys(F.col("n"), F.col("l"), F.col("t")))
    heads = ["東京都西多摩郡日ノ出町平井", "西多摩郡日ノ出町平井", "日ノ出町平井", "平井", "東京都日ノ出町平井"]
    assert set(got[0][0]) == {h + t for h in heads for t in ("", "1-")} and got[1][0] == []
    path = values(spark, [("separate", "x", None), ("track", "x", None), ("opposite_lane", "x", None), ("shared", "x", None), ("share_busway", "x", None), (None, "path", "designated"), (None, "cycleway", None)], "c string, h string, b string", tags.cycleway_class([F.col("c")], F.col("h"), F.col("b")))
    assert [r[0] for r in path] == [None, "separated", None, None, "shared", "shared", "separated"]
    assert values(spark, [(["a", "b", "c"],)], "p array<string>", text.search_keys(F.col("p"))) == [(["abc", "bc", "c"],)]


def test_weather(spark):
    speed, source = weather.wind_speed(F.lit(0.0), F.lit(-5.0)), weather.wind_from_deg(F.lit(0.0), F.lit(-5.0))
    (row,) = values(spark, [(1,)], "x int", speed, source, weather.head_wind(speed, source, F.lit(0.0)), weather.drag_ratio(F.lit(0.0), F.lit(0.0), F.lit(90.0), 6.0))
    assert row == pytest.approx((5.0, 0.0, 5.0, 1.0))
    fast = values(spark, [(-6.0,), (0.0,), (6.0,), (None,)], "g double", weather.balanced_speed(F.col("g"), F.lit(0.005), 120.0))
    assert fast[0][0] > fast[1][0] > fast[2][0] and fast[3][0] is None
    v = fast[1][0]
    assert (80 * 9.80665 * 0.005 + 0.5 * 1.2 * 0.32 * v * v) * v == pytest.approx(120, rel=0.01)
    assert math.isclose(values(spark, [(1000.0,)], "d double", weather.travel_seconds(F.col("d"), F.lit(5.0), [(F.lit(2.0), 21.0), (F.lit(None).cast("double"), 8.0)]))[0][0], 242.0)
