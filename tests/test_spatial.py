import math
import random

import pytest

from orebody.operators.spatial import points_within, regions_of_points
from tests.conftest import tuples

R = 6_371_000.0


def distance(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("centre", [(30.0, -120.0), (0.0, 0.001), (89.9999, 10.0), (-70.0, 179.9999), (-90.0, 0.0), (12.0, -180.0)])
@pytest.mark.parametrize("metres", [50.0, 700.0])
def test_brute_force(rows, centre, metres):
    rng = random.Random(hash(centre) % 1000)
    points = []
    for k in range(60):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-1, 1) * metres * 3e-5))
        shrink = max(0.001, math.cos(math.radians(lat)))
        lon = (centre[1] + rng.uniform(-1, 1) * metres * 3e-5 / shrink + 180) % 360 - 180
        points.append((f"p{k:02}", lat, lon))
    df = rows([*points, points[0], ("null", None, 1.0), ("zero", 0.0, 0.0), ("bad", 91.0, 0.0), (None, *centre), ("nan", float("nan"), 0.0)], "id string, latitude double, longitude double")
    got = points_within(df, df, metres, left_id="id", right_id="id", ordered=True)
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and distance(a[1:], b[1:]) <= metres}
    assert {(r.left_id, r.right_id) for r in got.collect()} == want


def test_hot_cell_is_salted(rows, monkeypatch):
    import orebody.operators.spatial as spatial

    monkeypatch.setattr(spatial, "hot_buckets", lambda *a, **k: list(range(4096)))
    df = rows([(f"p{k}", 10.0 + k * 1e-5, 20.0, "x") for k in range(30)], "id string, latitude double, longitude double, left_id string")
    got = points_within(df, df, 5.0, left_id="id", right_id="id")
    want = {(f"p{a}", f"p{b}") for a in range(30) for b in range(30) if distance((10 + a * 1e-5, 20), (10 + b * 1e-5, 20)) <= 5}
    assert {(r.left_id, r.right_id) for r in got.collect()} == want


def test_empty(rows):
    empty = rows([], "id string, latitude double, longitude double")
    assert points_within(empty, empty, 50.0, left_id="id", right_id="id").count() == 0
    assert regions_of_points(empty, rows([], "r string, ring array<struct<lat: double, lon: double>>"), point_id="id", region_id="r").count() == 0


def test_regions(rows):
    rng = random.Random(4)
    rings = {"square": [(10.0, 10.0), (10.0, 12.0), (12.0, 12.0), (12.0, 10.0)], "dart": [(0.0, 0.0), (20.0, 11.0), (0.0, 22.0), (5.0, 11.0)], "line": [(0.0, 0.0), (1.0, 1.0)]}
    points = [(f"p{k}", rng.uniform(-2, 22), rng.uniform(-2, 24)) for k in range(300)]

    def inside(ring, y, x):
        hit = False
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    want = sorted((p, r) for p, y, x in points for r, ring in rings.items() if len(ring) > 2 and inside(ring, y, x))
    got = regions_of_points(rows(points, "id string, latitude double, longitude double"), rows([(k, v) for k, v in rings.items()] + [("none", None)], "r string, ring array<struct<lat: double, lon: double>>"), point_id="id", region_id="r")
    assert tuples(got) == want
