"""Positions, nearest stations and name lookups against brute force, on data that crowd or stretch them."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from venuescope.operators import places


@pytest.mark.parametrize("kind", ["dense", "clustered", "hashed", "outlier", "text", "ties"])
def test_positions_of_any_ordinals(spark, kind):
    draw = random.Random(1)
    ids = {
        "dense": list(range(3000)),
        "clustered": [*range(1000), *range(10**12, 10**12 + 2000)],
        "hashed": [draw.randrange(-(1 << 63), 1 << 63) for _ in range(3000)],
        "outlier": [*range(2999), 1 << 60],
        "text": [f"k{draw.randrange(10**6)}" for _ in range(3000)],
        "ties": [7] * 1500 + [None] * 900 + list(range(600)),
    }[kind]
    draw.shuffle(ids)
    rows = [(x, n, f"t{n}") for n, x in enumerate(ids)]
    df = spark.createDataFrame(rows, f"id {'string' if kind == 'text' else 'long'}, file int, place string").repartition(5)
    got = places.numbered(df, "id", "at").orderBy("at").collect()
    assert [r.at for r in got] == list(range(3000))
    assert sorted((r.file, r.place) for r in got) == sorted((n, t) for _, n, t in rows)
    known = [r.id for r in got if r.id is not None]
    assert known == sorted(known) and all(r.id is None for r in got[len(known) :])
    assert [r.at for r in places.numbered(df.limit(0), "id", "at").collect()] == []


@pytest.mark.parametrize("ids", [[*range(20_000), 1 << 60], [5] * 20_000, [None] * 20_000])
def test_no_range_holds_more_than_its_share(spark, monkeypatch, ids):
    seen = []
    monkeypatch.setattr(places, "written", lambda df, name, real=places.written: seen.append(real(df, name)) or seen[-1])
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    assert places.numbered(df, "id").count() == len(ids)
    sizes = [r["count"] for r in seen[0].groupBy(F.col("_metadata.file_name")).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * len(ids) / len(sizes)


def test_joined_texts_of_a_group(spark):
    """Every text counts, in order, whatever its batch; missing ones do not, and a group may have no name."""
    rows = [("a", n, f"t{n}") for n in range(25_000)] + [("a", 30_000, None), (None, 2, "y"), (None, 1, ""), ("b", 1, None), ("c", 1, "")]
    draw = random.Random(2)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "place string, review long, t string").repartition(6)
    want = {"a": "\n".join(f"t{n}" for n in range(25_000)), None: "\ny", "c": ""}
    got = places.joined_md5(df, ["place"], "t", "review").collect()
    assert {r.place: r.texts for r in got} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()} and len(got) == 3


def test_slice_by_position(spark):
    df = spark.createDataFrame([(n * n, n) for n in range(50)] + [(None, 99)], "ordinal long, n int")
    assert sorted(r.n for r in places.row_slice(df, 10, 13).collect()) == [10, 11, 12]
    assert [r.n for r in places.row_slice(df, 50, 60).collect()] == [99]


def metres(a, b):
    x, y = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(x / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(y / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brute(points, stations, reach):
    out = {}
    for p, lat, lng in points:
        best = None
        for s, kind, a, b, o in stations:
            if None not in (lat, lng, a, b) and (m := metres((lat, lng), (a, b))) <= (reach or 1e9):
                best = min(best or (9e9,), (math.floor(m * 1.4 / 67.0 * 10 + 0.5) / 10, o, s))
        out[p] = best and best[2]
    return out


def somewhere(draw, near=None, spread=0.0):
    lat, lng = near or (draw.uniform(-80, 80), draw.uniform(-180, 180))
    lat = max(-90.0, min(90.0, lat + draw.uniform(-spread, spread)))
    lng += draw.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))
    return lat, (lng + 180) % 360 - 180


CENTRES = [(37.5, 127.0), (65.0, 25.0), (80.0, -20.0), (-33.0, 179.9999), (10.0, -179.9999), (89.99, 40.0), (-89.9, 0.0)]


@pytest.mark.parametrize("reach", [100.0, 600.0, 3000.0, 50_000.0, None])
def test_nearest_against_all_pairs(spark, reach):
    draw = random.Random(str(reach))
    spread = (reach or 20_000.0) / 111_000 * 1.5
    points = [(n, *somewhere(draw, draw.choice(CENTRES), spread)) for n in range(120)] + [(500 + n, *somewhere(draw)) for n in range(30)] + [(900, None, 1.0)]
    stations = [(n, "subway", *somewhere(draw, draw.choice(CENTRES), spread), n * 7 % 200) for n in range(150)]
    stations += [(300 + n, "bus", *stations[n][2:4], 1000 + n) for n in range(20)] + [(700 + n, "bus", *somewhere(draw), 2000 + n) for n in range(20)] + [(999, "bus", None, None, 0)]
    a = spark.createDataFrame(points, "point long, lat double, lng double")
    b = spark.createDataFrame(stations, "station long, kind string, s_lat double, s_lng double, ordinal long")
    assert {r.point: r.station for r in places.nearest(a, b, reach).collect()} == brute(points, stations, reach)


def test_found_beyond_neighbouring_cells(spark):
    a = spark.createDataFrame([(1, 37.0, 127.0), (2, 65.0, 25.0)], "point long, lat double, lng double")
    b = spark.createDataFrame([(7, "s", 37.0198, 127.0, 1), (8, "s", 65.0, 25.0115, 2)], "station long, kind string, s_lat double, s_lng double, ordinal long")
    assert {r.point: r.station for r in places.nearest(a, b, 3000.0).collect()} == {1: 7, 2: 8}
    assert places.nearest(a, b.limit(0)).where("station is null").count() == 2 and places.nearest(a.limit(0), b).count() == 0


def test_crowded_city_meets_few(spark, monkeypatch):
    """Two thousand points and stations within half a kilometre: pairs stay far under four million."""
    draw = random.Random(6)
    points = [(n, *somewhere(draw, CENTRES[0], 0.003)) for n in range(2000)]
    stations = [(n, "bus", *somewhere(draw, CENTRES[0], 0.003), n) for n in range(2000)]
    a = spark.createDataFrame(points, "point long, lat double, lng double")
    b = spark.createDataFrame(stations, "station long, kind string, s_lat double, s_lng double, ordinal long")
    ring = places._first_ring(a, b, 3000.0)
    x, y = places._met(a, b, ring)
    assert x.join(y, "cell").count() < 2000 * 100
    got = {r.point: r.station for r in places.nearest(a, b, 3000.0).collect()}
    assert {p: got[p] for p in range(0, 2000, 40)} == brute(points[::40], stations, 3000.0)


def test_latitudes_beyond_the_poles(spark):
    """A line of places that goes on over both poles and round: it meets its neighbours, not all that lie beyond a pole."""
    draw = random.Random(8)
    line = [(n, 37.4 + 0.6 * n, 126.8 + draw.uniform(-0.01, 0.1)) for n in range(1500)] + [(1500 + n, -95.0 - 0.6 * n, 10.0) for n in range(100)]
    points, stations = [x for x in line if x[0] % 3], [(n, "bus", lat, lng, n) for n, lat, lng in line if n % 3 == 0]
    a = spark.createDataFrame(points, "point long, lat double, lng double")
    b = spark.createDataFrame(stations, "station long, kind string, s_lat double, s_lng double, ordinal long")
    x, y = places._met(a, b, 100_000.0)
    assert x.join(y, "cell").count() < 60 * len(points)
    assert {r.point: r.station for r in places.nearest(a, b, 100_000.0).collect()} == brute(points, stations, 100_000.0)


def test_prefix_matches_against_all_pairs(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab카") for _ in range(draw.randrange(5)))
    known = [(word(), draw.choice(["x", "y", None]), draw.choice(["n", "m", None]), n, 1.0 * n, 2.0) for n in range(300)]
    own = [(n, draw.choice([word(), None]), draw.choice(["x", "y", None]), draw.choice(["n", "m", None])) for n in range(300)] + [(7, "a", "x", None)]
    a = spark.createDataFrame(own, "place long, name string, district string, neighborhood string")
    b = spark.createDataFrame(known, "k_name string, k_district string, k_neighborhood string, ordinal long, lat double, lng double")
    want = {}
    for place, name, district, hood in own:
        for k, kd, kn, o, *_ in known:
            if name is not None and district is not None and kd == district and k.startswith(name) and (name or not k) and (hood is None or hood == kn):
                want[place] = min(want.get(place, (9, 0)), (1 if k == name else 2, o))
    got = {r.place: (r.tier, r.match) for r in places.matched(a, b).collect()}
    assert {p: m for p, m in got.items() if m[0]} == want and len(got) == 300
    plan = places.matched(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan


def test_districts_where_half_of_all_places_share_a_gram(spark, monkeypatch):
    draw = random.Random(4)
    known = [(f"cafe {draw.randrange(10**6)}", f"d{n % 5}", n) for n in range(400)] + [(f"tea{n}zq end", None if n % 9 == 0 else f"e{n}", 1000 + n) for n in range(30)]
    words = [f"cafe{n}" for n in range(200)] + ["tea7zq", "zq", "q", "caf", "xyz", "cafe 1"] + [k for k, _, _ in known[::50]] + ["", None]
    a = spark.createDataFrame([(w,) for w in words], "place string")
    b = spark.createDataFrame(known, "k_place string, district string, ordinal long")
    held = []
    monkeypatch.setattr(places, "written", lambda df, name, real=places.written: held.append((name, real(df, name))) or held[-1][1])
    got = {r.place: r.district for r in places.districts_of(a, b).collect()}
    firsts = {}
    for k, d, o in known:
        if d is not None:
            firsts[k] = min(firsts.get(k, (1 << 60, "")), (o, d))

    def want(w):
        if not w:
            return None
        first = w.split(" ")[0]
        return firsts[w][1] if w in firsts else firsts[first][1] if first in firsts else min((v for k, v in firsts.items() if first in k), default=(0, None))[1]

    assert got == {w: want(w) for w in words}
    # Words that begin with the common gram meet the places of a rarer one.
    assert {n for n, _ in held} == {"words", "grams", "gram-counts"}
