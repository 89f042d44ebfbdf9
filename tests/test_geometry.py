import random

import pytest
from pyspark.sql import functions as F

from seasonlens.operators import geometry as GE


def cells(spark, text):
    """Codes as letters, one line of text per grid row; '.' is outside."""
    rows = [(r, c, v if v != "." else None) for r, line in enumerate(text.split()) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, code string")


def area_of(points):
    return sum(p.x * q.y - q.x * p.y for p, q in zip(points, points[1:])) / 2


MESH = """
    aaaabb
    aaaabb
    aacabb
    aaaadd
    ....dd"""


def lines(spark, text=MESH):
    return GE.arcs(GE.dissolve_edges(GE.cell_edges(cells(spark, text), "code")))


def test_inner_edges_cancel(spark):
    got = GE.dissolve_edges(GE.cell_edges(cells(spark, "aab aab"), "code")).collect()
    assert len(got) == 10 + 2  # sides of the outline, and of the border between the codes
    assert sorted((r.left, r.right or "-") for r in got) == [("a", "-")] * 6 + [("a", "b")] * 2 + [("b", "-")] * 4

@pytest.fixture(scope="module")
def mesh(spark):
    return lines(spark)


def test_arcs_end_at_junctions(mesh):
    got = mesh.collect()
    assert {(r.left, r.right, r.closed) for r in got} == {
        ("a", "b", False), ("a", "d", False), ("b", "d", False), ("a", None, False), ("b", None, False), ("d", None, False), ("a", "c", True)}
    assert sum(r.closed for r in got) == 1


def test_rings_have_the_area_of_their_cells(mesh):
    area = {}
    for r in GE.rings(mesh).collect():
        assert r.points[0] == r.points[-1] and r.area == pytest.approx(area_of(r.points))
        area.setdefault(r.code, []).append(r.area)
    assert {c: sorted(a) for c, a in area.items()} == {"a": [-1, 16], "b": [6], "c": [1], "d": [4]}


def test_corners_that_touch_stay_simple_rings(spark):
    got = GE.rings(lines(spark, "ab ba")).collect()
    assert sorted((r.code, r.area, len(r.points)) for r in got) == [("a", 1, 5), ("a", 1, 5), ("b", 1, 5), ("b", 1, 5)]


def components(grid, code):
    """Number of 4-connected pieces of a code (None counts the outside with a frame, 8-connected)."""
    todo = {k for k, v in grid.items() if v == code}
    n, near = 0, [(0, 1), (1, 0), (0, -1), (-1, 0)]
    while todo:
        n, stack = n + 1, [todo.pop()]
        while stack:
            y, x = stack.pop()
            for dy, dx in near:
                if (y + dy, x + dx) in todo:
                    todo.remove((y + dy, x + dx))
                    stack.append((y + dy, x + dx))
    return n


def test_random_mesh_against_brute_force(spark):
    rng = random.Random(8)
    grid = {(r, c): rng.choice("abc.") if rng.random() < 0.5 else "a" for r in range(12) for c in range(15)}
    df = spark.createDataFrame([(r, c, v if v != "." else None) for (r, c), v in grid.items()], "row int, col int, code string")
    got = GE.rings(GE.arcs(GE.dissolve_edges(GE.cell_edges(df, "code")))).collect()
    for code in "abc":
        mine = [r for r in got if r.code == code]
        assert sum(r.area for r in mine) == pytest.approx(sum(v == code for v in grid.values()))
        assert sum(r.area > 0 for r in mine) == components(grid, code)
        sides = [(p, q) for r in mine for p, q in zip(r.points, r.points[1:])]
        assert len(set(sides)) == len(sides)  # every border is walked once


def test_simplified_neighbours_stay_closed(spark):
    rng = random.Random(2)
    edge = [8 + round(rng.random() * 3) for _ in range(40)]
    text = " ".join("".join("a" if c < edge[r] else "b" for c in range(20)) for r in range(40))
    whole = lines(spark, text)
    thin = GE.simplify_arcs(whole, 2.0)
    n, m = (d.select(F.sum(F.size("points"))).first()[0] for d in (whole, thin))
    assert m < n / 4
    assert sum(r.area for r in GE.rings(thin).collect()) == pytest.approx(20 * 40)  # what one zone loses the other gains
    before = {b.arc: b.points for b in whole.collect()}
    for a in thin.collect():
        assert set(a.points) <= set(before[a.arc]) and (a.points[0], a.points[-1]) == (before[a.arc][0], before[a.arc][-1])


def test_small_zones_keep_an_area(mesh):
    thin = GE.simplify_arcs(mesh, 100.0)
    area = {}
    for r in GE.rings(thin).collect():
        area.setdefault(r.code, []).append(r.area)
    assert set(area) == {"a", "b", "c", "d"} and area["c"][0] > 0


def test_tolerance_is_kept():
    import numpy as np
    rng = np.random.default_rng(5)
    x, y = np.cumsum(rng.random(300)), rng.random(300) * 3
    k = GE._keep(x, y, 1.0, 0)
    assert k[0] == 0 and k[-1] == 299 and len(k) < 300
    for i, j in zip(k, k[1:]):
        assert j - i == 1 or -GE._farthest(x, y, i, j)[0] <= 1.0


def test_long_chains_and_circles(spark):
    links = [(i, i - 1 if i else None) for i in range(100)] + [(200 + i, 200 + (i - 1) % 37) for i in range(37)] + [(300, 300), (301, None)]
    got = {r.id: (r.head, r.pos, r.closed) for r in GE.chain(spark.createDataFrame(links, "id int, prev int")).collect()}
    want = {i: (0, i, False) for i in range(100)} | {200 + i: (200, i, True) for i in range(37)} | {300: (300, 0, True), 301: (301, 0, False)}
    assert got == want


def test_unknown_direction_is_found(spark):
    square = lambda seq, ring, pts, hole: [(seq, ring, hole, *map(float, (*pts[i], *pts[(i + 1) % 4]))) for i in range(4)]
    rows = square(1, 0, [(0, 0), (0, 9), (9, 9), (9, 0)], False) + square(1, 1, [(3, 3), (6, 3), (6, 6), (3, 6)], True)
    e = spark.createDataFrame(rows, "code int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double")
    turned = GE.directed(e, ["code", "ring"])
    assert sorted(r.area for r in GE.rings(GE.arcs(GE.dissolve_edges(turned))).collect()) == [-9, 81]


def test_overlap_is_an_error_and_empty_is_empty(spark):
    e = GE.cell_edges(cells(spark, "aa"), "code")
    with pytest.raises(Exception, match="two zones"):
        GE.dissolve_edges(e.unionByName(e)).collect()
    assert GE.rings(GE.simplify_arcs(GE.arcs(GE.dissolve_edges(e.limit(0))), 1.0)).count() == 0
