"""Grid, sources, connectivity, indexes, searches, federation and updates on small made-up sets."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridseek import STRATEGIES, Grid, catalogue, cells_of, connected, overlap_graph, profiles, read_csv_points, top_k_coverage, top_k_overlap
from gridseek.operators import coverage, federation, graph, index, overlap, pairs, profile, updates
from gridseek.operators.connect import is_connected
from gridseek.sources.points import Layout, layout_of, load_or_make_cells, read_cells, valid_points, write_cells

CELLS = "dataset_id long, cx long, cy long, cell_id long, density long"


def cells_frame(spark, sets, theta=12):
    return spark.createDataFrame([(i, x, y, (y << theta) + x, 1) for i, s in sets.items() for x, y in sorted(s)], CELLS)


def random_sets(seed, n=14, side=12, most=30):
    rng = random.Random(seed)
    out = {}
    for i in range(1, n + 1):
        x0, y0 = rng.randrange(side), rng.randrange(side)
        out[i] = {(x0 + rng.randrange(5), y0 + rng.randrange(5)) for _ in range(rng.randint(1, most))}
    return out


def touches(a, b, delta):
    if delta <= 1:
        return any(abs(x - u) <= 1 and abs(y - v) <= 1 for x, y in a for u, v in b)
    return any((x - u) ** 2 + (y - v) ** 2 <= delta * delta for x, y in a for u, v in b)


def greedy(sets, q, k, delta):
    covered, left, out = set(sets[q]), {i: s for i, s in sets.items() if i != q}, []
    for step in range(1, k + 1):
        gains = {i: len(s - covered) for i, s in left.items() if touches(s, covered, delta) and s - covered}
        if not gains:
            break
        best = min(gains, key=lambda i: (-gains[i], i))
        covered |= left.pop(best)
        out.append((step, best, len(covered)))
    return out


def greedy_graph(sets, q, k, delta):
    near = {i: len(s & sets[q]) for i, s in sets.items() if i != q and touches(s, sets[q], delta)}
    total, chosen, out = len(sets[q]), [], []
    for step in range(1, k + 1):
        gains = {}
        for i, s in sets.items():
            if i == q or i in chosen:
                continue
            shared = [len(s & sets[c]) for c in chosen if s & sets[c]] + ([near[i]] if i in near else [])
            if shared and len(s) - min(shared) > 0:
                gains[i] = len(s) - min(shared)
        if not gains:
            break
        best = min(gains, key=lambda i: (-gains[i], i))
        total += gains[best]
        chosen.append(best)
        out.append((step, best, total))
    return out


# grid and sources


def test_validity_and_cells(spark):
    rows = [("k", "10.5", "20.25", True), ("k", "-0", "0", True), ("k", "180", "0", False), ("k", "-180", "0", False), ("k", "10", "90", False), ("k", "10", "-90", False), ("k", "179.9999", "89.9999", True)]
    rows += [("k", x, "10", False) for x in ("1e1", "+10", ".5", "5.", " 5", "abc", "")] + [("k", "10", "1e1", True), ("k", "10", "abc", False), ("k", None, "1", False), ("k", "1", None, False)]
    for text_x, text_y, keep in [(r[1], r[2], r[3]) for r in rows]:
        raw = spark.createDataFrame([("d", text_x, text_y)], "dataset_id string, x string, y string")
        assert valid_points(raw).count() == int(keep), (text_x, text_y)
    raw = spark.createDataFrame([("d", "179.9999", "89.9999"), ("d", "-0", "0"), ("d", "-0", "0.0")], "dataset_id string, x string, y string")
    got = {(r.cx, r.cy, r.density) for r in cells_of(valid_points(raw), Grid(12)).collect()}
    assert got == {(4095, 4095, 1), (2048, 2048, 2)}
    assert cells_of(valid_points(raw.limit(0)), Grid(12)).count() == 0


@pytest.mark.parametrize("theta", [1, 10, 16])
def test_cells_resolve(spark, theta):
    grid = Grid(theta)
    points = spark.createDataFrame([("d", -179.5 + i * 0.71, -89.0 + i * 0.35) for i in range(500)], "dataset_id string, lng double, lat double")
    cells = cells_of(points, grid)
    cx, cy = grid.resolve(F.col("cell_id"))
    lng, lat = grid.lower_left(cx, cy)
    assert cells.where((cx != F.col("cx")) | (cy != F.col("cy"))).count() == 0
    assert cells.where((grid.cx(lng + 1e-9) != F.col("cx")) | (grid.cy(lat + 1e-9) != F.col("cy"))).count() == 0
    assert cells.agg(F.sum("density")).first()[0] == 500


def test_csv_sources_and_cache(spark, tmp_path):
    layouts = {"wide*": Layout(2, 1), "plain": Layout(0, 1)}
    assert layout_of("wide7", layouts) == Layout(2, 1) and layout_of("argoverse_a") == Layout(6, 7) and layout_of("baidu") == Layout(1, 2) and layout_of("nyu") == Layout(0, 1)
    (tmp_path / "wide7").mkdir()
    (tmp_path / "wide7/a.csv").write_text("id,lat,lng,more\n1,10,20,x\n2,10,20,y\n3,bad,20,z\n4,10\n")
    (tmp_path / "wide7/b.csv").write_text("other,names,here\n1,-10.5,30.25\n")
    points = read_csv_points(spark, str(tmp_path / "wide7"), "wide7", layouts)
    assert {(r.source_id, r.dataset_id, r.lng, r.lat) for r in points.collect()} == {("wide7", "a.csv", 20.0, 10.0), ("wide7", "b.csv", 30.25, -10.5)}
    cells = cells_of(points, Grid(10))
    write_cells(cells, str(tmp_path / "cache"), 10)
    again = read_cells(spark, str(tmp_path / "cache"), 10)
    assert sorted(map(str, again.select(*cells.columns).collect())) == sorted(map(str, cells.collect()))
    assert read_cells(spark, str(tmp_path / "cache"), 11).count() == 0


# geometry and indexes


@pytest.mark.parametrize("a, b, delta, want", [((0, 0), (0, 0), 0, True), ((0, 0), (1, 1), 0, True), ((0, 0), (2, 0), 1, False), ((0, 0), (3, 0), 3, True), ((0, 0), (3, 3), 4, False), ((5, 5), (2, 1), 5, True), ((5, 5), (2, 1), 4.9, False)])
def test_connectivity_cases(spark, a, b, delta, want):
    one, other = (cells_frame(spark, {1: {c}}) for c in (a, b))
    assert is_connected(one, other, delta) is want


@pytest.mark.parametrize("delta", [0, 1, 2, 2.5, 3, 7])
def test_connectivity_of_sets(spark, delta):
    sets = random_sets(11, n=12, side=40, most=6)
    cells = cells_frame(spark, sets)
    got = {r.dataset_id for r in connected(cells, cells.where("dataset_id = 1"), delta).collect()}
    assert got == {i for i, s in sets.items() if touches(s, sets[1], delta)}


def test_positional_lists(spark):
    sets = {1: {(1, 0), (200, 0), (100, 0)}, 2: {(5, 0), (2, 0)}, 3: {(2, 0)}, 4: {(101, 0), (2, 0), (1, 0)}}
    got = {(r.cell_id, r.dataset_id): (r.position, r["size"]) for r in index.positional_lists(cells_frame(spark, sets)).collect()}
    assert got == {(1, 1): (1, 3), (1, 4): (1, 3), (2, 2): (1, 2), (2, 3): (1, 1), (2, 4): (2, 3), (5, 2): (2, 2), (100, 1): (2, 3), (101, 4): (3, 3), (200, 1): (3, 3)}
    lists = {r.cell_id: r.dataset_ids for r in index.posting_lists(cells_frame(spark, sets)).collect()}
    assert lists == {1: [1, 4], 2: [2, 3, 4], 5: [2], 100: [1], 101: [4], 200: [1]}


@pytest.mark.parametrize("axis", ["x", "widest"])
def test_leaves_and_tree(spark, axis):
    sets = random_sets(5, n=40, side=60, most=4)
    prof = profiles(cells_frame(spark, sets))
    leafed = index.leaves(prof, capacity=3, axis=axis)
    rows = leafed.collect()
    assert len(rows) == len(sets)
    nodes = {r.node: r for r in index.tree_nodes(leafed).collect()}
    leaf_ids = {r.leaf_id for r in rows}
    assert {n for n, r in nodes.items() if r.is_leaf} == leaf_ids
    for n in leaf_ids:  # no leaf lies above another
        assert not any(m != n and m >> (m.bit_length() - n.bit_length()) == n for m in leaf_ids if m >= n)
    for r in rows:
        node = r.leaf_id
        while node:
            assert nodes[node].min_cx <= r.min_cx and nodes[node].max_cx >= r.max_cx and nodes[node].min_cy <= r.min_cy and nodes[node].max_cy >= r.max_cy
            node //= 2
    assert nodes[1].n_datasets == len(sets)
    if axis == "x":
        crowded = [n for n in leaf_ids if sum(r.leaf_id == n for r in rows) > 3]
        for n in crowded:  # only where one side would be empty
            own = [r for r in rows if r.leaf_id == n]
            middle = (min(r.min_cx for r in own) + max(r.max_cx for r in own)) / 2
            assert len({r.pivot_x >= middle for r in own}) == 1


def test_boxes(spark):
    sets = random_sets(3, n=20, side=30)
    cells = cells_frame(spark, sets)
    prof = profiles(cells)
    box = {i: (min(x for x, _ in s), min(y for _, y in s), max(x for x, _ in s), max(y for _, y in s)) for i, s in sets.items()}
    got = {r.dataset_id: (r.min_cx, r.min_cy, r.max_cx, r.max_cy) for r in prof.collect()}
    assert got == box and {r.dataset_id: r.n_cells for r in prof.collect()} == {i: len(s) for i, s in sets.items()}
    q = box[1]
    meet = {i: (min(b[2], q[2]) - max(b[0], q[0]) + 1) * (min(b[3], q[3]) - max(b[1], q[1]) + 1) for i, b in box.items() if b[0] <= q[2] and q[0] <= b[2] and b[1] <= q[3] and q[1] <= b[3]}
    query = cells.where("dataset_id = 1")
    assert {r.dataset_id: r.common for r in profile.box_candidates(prof, query).collect()} == meet
    bounds = {r.dataset_id: r.bound for r in overlap.upper_bounds(cells, query).collect()}
    assert all(len(s & sets[1]) <= bounds.get(i, 0) for i, s in sets.items())
    assert all(touches(s, sets[1], 3) <= (i in {r.dataset_id for r in profile.ball_candidates(prof, query, 3).collect()}) for i, s in sets.items())


# searches


@pytest.mark.parametrize("strategy", list(STRATEGIES))
def test_overlap_strategies_agree(spark, strategy):
    for seed, k in ((1, 3), (2, 10), (7, 1)):
        sets = random_sets(seed)
        cells = cells_frame(spark, sets)
        want = sorted(((-len(s & sets[1]), i) for i, s in sets.items() if s & sets[1]))[:k]
        got = [(-r.overlap, r.dataset_id) for r in top_k_overlap(cells, cells.where("dataset_id = 1"), k, strategy).collect()]
        assert got == want
        got = [(-r.overlap, r.dataset_id) for r in top_k_overlap(cells, cells.where("dataset_id = 1"), k, strategy, exclude=1).collect()]
        assert got == [x for x in sorted(((-len(s & sets[1]), i) for i, s in sets.items() if s & sets[1] and i != 1))][:k]


def test_overlap_of_nothing(spark):
    cells = cells_frame(spark, random_sets(1))
    far = cells_frame(spark, {99: {(4000, 4000)}})
    for strategy in STRATEGIES:
        assert top_k_overlap(cells, far, 3, strategy).count() == 0
        assert top_k_overlap(cells.limit(0), far, 3, strategy).count() == 0
    with pytest.raises(ValueError):
        top_k_overlap(cells, far, 3, "other")


def test_overlap_graph_and_batch(spark):
    sets = random_sets(4)
    cells = cells_frame(spark, sets)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.permutations(sets, 2) if sets[a] & sets[b]}
    edges = overlap_graph(cells)
    assert {(r.src, r.dst): r.w for r in edges.collect()} == want
    assert {(r.src, int(r.dst)): r.w for r in graph.graph_from_json(graph.graph_json(edges)).collect()} == want
    for r in graph.sorted_graph(edges).collect():
        assert r.rank == 1 + sum((-w, b) < (-r.w, r.dst) for (a, b), w in want.items() if a == r.src)
    batch = {}
    for r in overlap.overlap_batch(cells, cells, 2).collect():
        batch.setdefault(r.query_id, []).append((r.rank, r.dataset_id, r.overlap))
    for q in sets:
        best = sorted((-w, b) for (a, b), w in want.items() if a == q)[:2]
        assert sorted(batch.get(q, [])) == [(i + 1, b, -w) for i, (w, b) in enumerate(best)]


@pytest.mark.parametrize("delta", [0, 2.5])
def test_coverage_strategies(spark, delta):
    for seed in (1,) if delta == 0 else (6,):
        sets = random_sets(seed, n=10, side=16)
        cells = cells_frame(spark, sets)
        query = cells.where("dataset_id = 1")
        want = greedy(sets, 1, 4, delta)
        for strategy in ("sg", "gasm", "bounds"):
            assert [tuple(r) for r in top_k_coverage(cells, query, 4, delta, strategy, exclude=1).orderBy("step").collect()] == want, strategy
        assert [tuple(r) for r in top_k_coverage(cells, query, 4, delta, "gadm", exclude=1).orderBy("step").collect()] == greedy_graph(sets, 1, 4, delta)
        assert all(a[2] < b[2] for a, b in zip(want, want[1:]))


# several sources


def test_federation(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 3}", i, -10 + rng.random() * 4 + (60 if i % 3 == 2 else 0), 20 + rng.random() * 3) for i in range(12) for _ in range(40)]
    points = spark.createDataFrame(rows, "source_id string, dataset_id long, lng double, lat double")
    thetas = {"s0": 9, "s1": 10}
    cells = federation.source_cells(points, thetas, default=8)
    query = federation.query_at(points.where("dataset_id = 0"), [9, 10, 8])

    def at(p, theta):
        return int((p[2] + 180) // (360 / 2**theta)), int((p[3] + 90) // (180 / 2**theta))

    theta_of = {"s0": 9, "s1": 10, "s2": 8}
    sets = {i: {at(p, theta_of[p[0]]) for p in rows if p[1] == i} for i in range(12)}
    queries = {t: {at(p, t) for p in rows if p[1] == 0} for t in (8, 9, 10)}
    assert {r.source_id for r in federation.source_candidates(cells, query).collect()} == {"s0", "s1"}
    want = sorted((-len(sets[i] & queries[theta_of[f"s{i % 3}"]]), f"s{i % 3}", i) for i in range(12))
    want = [(s, i, -w) for w, s, i in want if w][:5]
    assert [tuple(r) for r in federation.federated_overlap(cells, query, 5).collect()] == want
    picks = []
    for s in ("s0", "s1"):
        own = {i: sets[i] for i in range(12) if f"s{i % 3}" == s and i != 0} | {-1: queries[theta_of[s]]}
        picks += [(s, *p) for p in greedy(own, -1, 3, 0)]
    want = sorted(picks, key=lambda p: (-p[3], p[0], p[2]))[:3]
    assert [tuple(r) for r in federation.federated_coverage(cells, query, 3, 0, exclude=0).collect()] == want
    with pytest.raises(ValueError):
        federation.global_coverage(cells, query, 2)
    one = cells.where("source_id = 's0'")
    got = federation.global_coverage(one, query.where("theta = 9"), 2).collect()
    assert [r.coverage for r in got] == [p[2] for p in greedy({i: sets[i] for i in range(0, 12, 3)} | {-1: queries[9]}, -1, 2, 0)]


# changes


def test_updates(spark):
    sets = random_sets(8)
    cells = cells_frame(spark, sets)
    changed = {2: {(1, 1)}, 3: sets[1] | {(50, 50)}, 99: set(list(sets[1])[:3])}
    after = sets | changed
    new = updates.upsert(cells, cells_frame(spark, changed))
    got = {}
    for r in new.collect():
        got.setdefault(r.dataset_id, set()).add((r.cx, r.cy))
    assert got == after
    kept = updates.delete(cells, spark.createDataFrame([(1,), (5,), (1000,)], "dataset_id long"))
    assert {r.dataset_id for r in kept.select("dataset_id").distinct().collect()} == set(sets) - {1, 5}
    entered = updates.standing_overlap(cells, cells_frame(spark, changed), cells.where("dataset_id = 1"), 3, exclude=1)

    def best(s):
        return {i for _, i in sorted((-len(c & sets[1]), i) for i, c in s.items() if c & sets[1] and i != 1)[:3]}

    assert {r.dataset_id for r in entered.collect()} == best(after) - best(sets)
    box = lambda s: (min(x for x, _ in s), min(y for _, y in s), max(x for x, _ in s), max(y for _, y in s))
    assert {r.dataset_id for r in updates.changed_boxes(cells, new).collect()} == {i for i in after if i not in sets or box(sets[i]) != box(after[i])}


TWO = "source_id string, dataset_id string, cx long, cy long, cell_id long, density long"


def two_frame(spark, sets):
    return spark.createDataFrame([(*key, x, y, (y << 12) + x, 1) for key, s in sets.items() for x, y in sorted(s)], TWO)


def test_sources_may_share_ids(spark):
    """Ids name a dataset only together with their source."""
    sets = {("S0", "a"): {(1, 1), (2, 1)}, ("S1", "a"): {(1, 1), (2, 1), (3, 1)}, ("S1", "b"): {(2, 1)}}
    cells, key = two_frame(spark, sets), lambda r: (r.source_id, r.dataset_id)
    change = {("S0", "a"): {(1, 1), (9, 9)}}
    after = updates.upsert(cells, two_frame(spark, change))
    got = {}
    for r in after.collect():
        got.setdefault(key(r), set()).add((r.cx, r.cy))
    assert got == sets | change
    assert {key(r) for r in updates.delete(cells, spark.createDataFrame([("S1", "a")], "source_id string, dataset_id string")).collect()} == {("S0", "a"), ("S1", "b")}
    assert {key(r) for r in updates.delete(cells, spark.createDataFrame([("a",)], "dataset_id string")).collect()} == {("S1", "b")}
    assert updates.changed_boxes(cells, cells).count() == 0
    assert [key(r) for r in updates.changed_boxes(cells, after).collect()] == [("S0", "a")]
    query = cells.where("source_id = 'S0'")
    for strategy in STRATEGIES:
        assert [key(r) for r in top_k_overlap(cells, query, 5, strategy, exclude=("S0", "a")).collect()] == [("S1", "a"), ("S1", "b")], strategy
        assert [key(r) for r in top_k_overlap(cells, query, 5, strategy, exclude="a").collect()] == [("S1", "b")]
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.permutations(sets, 2)}
    edges = overlap_graph(cells)
    assert {((r.src_source, r.src), (r.dst_source, r.dst)): r.w for r in edges.collect()} == want
    assert {r["rank"] for r in graph.sorted_graph(edges).collect()} == {1, 2}
    batch = {(r.query_source, r.query_id, r["rank"]): key(r) for r in overlap.overlap_batch(cells, cells, 1).collect()}
    assert batch == {("S0", "a", 1): ("S1", "a"), ("S1", "a", 1): ("S0", "a"), ("S1", "b", 1): ("S0", "a")}
    assert {(key(r), r["size"]) for r in index.positional_lists(cells).collect()} == {(k, len(s)) for k, s in sets.items()}
    assert {(r.source_id, r.cell_id): r.dataset_ids for r in index.posting_lists(cells).collect()}[("S1", (1 << 12) + 2)] == ["a", "b"]


def test_crowded_cells(spark, monkeypatch):
    """Cells of more datasets than one task meets with each other."""
    monkeypatch.setattr(overlap, "CROWD", 3)
    monkeypatch.setattr(graph, "CROWD", 3)
    sets = {i: {(0, 0), (i % 4, 1)} for i in range(20)}
    cells = cells_frame(spark, sets)
    assert {(r.src, r.dst): r.w for r in overlap_graph(cells).collect()} == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.permutations(sets, 2)}
    got = {(r.query_id, r["rank"]): (r.dataset_id, r.overlap) for r in overlap.overlap_batch(cells, cells, 1).collect()}
    assert got == {(i, 1): min(((j, len(sets[i] & sets[j])) for j in sets if j != i), key=lambda x: (-x[1], x[0])) for i in sets}


def test_tables_beyond_what_the_driver_holds(spark, monkeypatch):
    """The same answers where sides are too large to be held."""
    from gridseek.plans import lineage, sizes

    monkeypatch.setattr(sizes.collected, "__defaults__", (3,))
    monkeypatch.setattr(sizes.small_side, "__defaults__", (3,))
    monkeypatch.setattr(lineage.settled, "__defaults__", (3,))
    sets = random_sets(2, n=25)
    cells = cells_frame(spark, sets)
    query = cells.where("dataset_id = 1")
    want = sorted(((-len(s & sets[1]), i) for i, s in sets.items() if s & sets[1]))[:4]
    for strategy in ("sts3", "josie", "ibtree", "mbr_bound"):
        assert [(-r.overlap, r.dataset_id) for r in top_k_overlap(cells, query, 4, strategy).collect()] == want
    assert [tuple(r) for r in top_k_coverage(cells, query, 2, 2, "bounds", exclude=1).orderBy("step").collect()] == greedy(sets, 1, 2, 2)


def test_caches_and_random_queries(spark, tmp_path):
    points = spark.createDataFrame([("s", i, -10.0 + i, 20.0) for i in range(5)], "source_id string, dataset_id long, lng double, lat double")
    path = str(tmp_path / "cells")
    made = []

    def make():
        made.append(1)
        return points

    for theta in (9, 10, 9, 10):
        assert load_or_make_cells(spark, path, theta, make).count() == 5
    assert len(made) == 2
    cells = load_or_make_cells(spark, path, 9, make)
    for _ in range(2):
        assert graph.load_or_make_graph(spark, str(tmp_path / "graph"), cells).count() == overlap_graph(cells).count()
    drawn = {r.dataset_id for r in overlap.random_queries(cells, 2, seed=1).collect()}
    assert len(drawn) == 2 and drawn == {r.dataset_id for r in overlap.random_queries(cells.repartition(3), 2, seed=1).collect()}


def test_standing_queries_over_batches(spark, tmp_path):
    """Batches that are run again change nothing, and old versions go."""
    from gridseek.streaming.standing import StandingCoverage, StandingOverlap

    grid, at = Grid(12), lambda x, y: ((x + 0.5) * 360 / 4096 - 180, (y + 0.5) * 180 / 4096 - 90)
    sets = random_sets(8)
    batches = [{2: set(sets[1])}, {3: {(500, 500)}, 99: set(list(sets[1])[:3])}, {2: {(900, 900)}}]
    points = lambda b: spark.createDataFrame([(i, *at(x, y)) for i, s in b.items() for x, y in sorted(s)], "dataset_id long, lng double, lat double")
    start = cells_of(points(sets), grid)
    own = spark.createDataFrame(sorted(sets[1]), "cx long, cy long")
    overlap_ = StandingOverlap(spark, str(tmp_path / "o"), grid, lambda _: own, k=3, exclude=1)
    coverage_ = StandingCoverage(spark, str(tmp_path / "c"), grid, lambda _: own, k=2, delta=2, exclude=1)
    best = lambda s: [i for _, i in sorted((-len(c & sets[1]), i) for i, c in s.items() if c & sets[1] and i != 1)[:3]]
    picks = lambda s: [p[1] for p in greedy({**s, 1: sets[1]}, 1, 2, 2)]
    overlap_.start_with(start), coverage_.start_with(start)
    now, want_o, want_c = dict(sets), [], []
    for n, b in enumerate(batches):
        then, now = now, now | b
        want_o += [(n, i) for i in best(now) if i not in best(then)]
        want_c += [(n, i) for i in picks(now) if i not in picks(then)]
        for _ in range(2 if n == 1 else 1):
            overlap_(points(b), n), coverage_(points(b), n)
    assert sorted((r.batch, r.dataset_id) for r in overlap_.entered().collect()) == sorted(want_o) and want_o
    assert sorted((r.batch, r.dataset_id) for r in coverage_.entered().collect()) == sorted(want_c)
    got = {}
    for r in overlap_.cells(2).collect():
        got.setdefault(r.dataset_id, set()).add((r.cx, r.cy))
    assert got == now
    kept = {(p.parent.name, p.name) for p in (tmp_path / "o" / "cells").glob("*/part=*")}
    assert kept == {(str(v), f"part={p}") for n in (1, 2) for p, v in overlap_._named(n).items()}


def test_known_answers(spark, sf_dir):
    """Answers at the smallest scale that were worked out beforehand."""
    cells = catalogue.cells(spark, sf_dir).cache()
    assert cells.count() == 5564 and cells.agg(F.max("density")).first()[0] == 3
    query = cells.where("dataset_id = 1")
    assert [(r.dataset_id, r.overlap) for r in top_k_overlap(cells, query, 1, exclude=1).collect()] == [(2, 56)]
    size = query.count()
    gains = lambda s: [(r.dataset_id, r.coverage) for r in top_k_coverage(cells, query, 3, 0, s, exclude=1).orderBy("step").collect()]
    assert size == 592
    assert gains("sg") == [(0, size + 517), (7, size + 517 + 543), (5, size + 517 + 543 + 487)]
    assert gains("gadm") == [(0, size + 517), (7, size + 517 + 543), (2, size + 517 + 543 + 540)]
    edges = overlap_graph(cells)
    assert edges.count() == 14 and edges.agg(F.sum("w")).first()[0] == 416
    cells.unpersist()


@pytest.mark.parametrize("delta", [0, 3])
def test_gadm_counts_edges_of_picks_only(spark, monkeypatch, delta):
    """The whole graph isn't made, nor written, for the picks, which are those along a given graph."""
    sets = random_sets(11, n=30, side=20)
    cells = cells_frame(spark, sets)
    query, given = cells.where("dataset_id = 1"), overlap_graph(cells.where("dataset_id != 1"))
    want = greedy_graph(sets, 1, 4, delta)
    picks = lambda **more: [tuple(r) for r in top_k_coverage(cells, query, 4, delta, "gadm", exclude=1, **more).orderBy("step").collect()]
    assert len(want) == 4 and picks(edges=given) == want

    def whole(*_):
        raise AssertionError("the whole graph was made")

    monkeypatch.setattr(coverage, "overlap_graph", whole, raising=False)
    monkeypatch.setattr(graph, "overlap_graph", whole)
    assert picks() == want


def rows_written(spark, use):
    """What use() gives, and how many rows its stages wrote for shuffles and into tables."""
    context = spark.sparkContext._jsc.sc()
    store = context.statusStore()

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        every = [found.apply(i) for i in range(found.size())]
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() + x.outputRecords() for x in every}

    before = stages()
    out = use()
    return out, sum(n for key, n in stages().items() if key not in before)


@pytest.mark.parametrize("delta", [0, 3])
def test_gadm_writes_fewer_rows_than_pairs(spark, delta):
    """Datasets on one spot share cells two by two; disk follows their cells, not their pairs."""
    sets = random_sets(5, n=600, side=3)
    cells = cells_frame(spark, sets).coalesce(2)
    linked = sum(1 for a, b in itertools.combinations(sets.values(), 2) if a & b)
    got, rows = rows_written(spark, lambda: [tuple(r) for r in top_k_coverage(cells, cells.where("dataset_id = 1"), 3, delta, "gadm", exclude=1).orderBy("step").collect()])
    assert got == greedy_graph(sets, 1, 3, delta) and len(got) == 3
    assert sum(map(len, sets.values())) <= rows < linked / 2


@pytest.mark.parametrize("sparse", [0, 8, 1 << 40])
@pytest.mark.parametrize("size", [5, 64])
def test_pairs_of_blocks(monkeypatch, size, sparse):
    """Lists of two blocks, short and long, by products and one by one, a few at a time."""
    monkeypatch.setattr(pairs, "SPARSE", sparse)
    monkeypatch.setattr(pairs, "TILE", 7)
    monkeypatch.setattr(pairs, "EXPANDED", 50)
    rng, has = np.random.default_rng(size), []
    for block in (0, 1):
        has.append(rng.random((40, size)) < rng.random(40)[:, None] ** 3)
    has[0][:, 0] = True  # cells that the other block has, too
    lists = []
    for block, a in enumerate(has):
        cell, place = (np.concatenate((x, x[:9])) for x in np.nonzero(a))  # some rows twice
        batch = pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(cell), block)), "cell": pa.array(cell * (1 << 32) - 5), "place": pa.array(place, pa.int16())})
        rows = pa.Table.from_batches(list(pairs._encoded(size)([batch.slice(0, 11), batch.slice(11)])))
        assert rows.column("cell").value_counts().field("counts").to_pylist() == [1] * len(rows)
        lists.append(pairs._Lists(rows.column("cell").combine_chunks(), rows.column("list").combine_chunks(), size))
    first = 2
    out = np.zeros((size - first, size), np.int32)
    pairs._count(out, *lists, first)
    assert (out == (has[0].T.astype(int) @ has[1].astype(int))[first:]).all()


def test_graph_has_no_row_for_each_pair_of_a_cell(spark):
    """Pairs are counted where the lists are; what is counted isn't shuffled."""
    rng = random.Random(7)
    sets = {i: {(i % 3 * 4 + rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(1, 20))} for i in range(150)}
    edges = pairs.neighbours(cells_frame(spark, sets), size=16)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.permutations(sets, 2) if sets[a] & sets[b]}
    assert {(r.of_dataset_id, r.dataset_id): r.w for r in edges.collect()} == want
    above = overlap_graph(cells_frame(spark, sets))._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_ranked_graph_needs_no_shuffle_of_edges(spark):
    rng = random.Random(8)
    sets = {i: {(i % 3 * 4 + rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(1, 20))} for i in range(60)}
    cells = cells_frame(spark, sets)
    want = {tuple(r) for r in graph.sorted_graph(overlap_graph(cells)).collect()}
    ranked = graph.ranked_graph(cells)
    assert {tuple(r) for r in ranked.collect()} == want and len(want) > 1000
    assert ranked.columns == ["src", "dst", "w", "rank"]
    twos = {(f"S{i % 2}", str(i // 2)): s for i, s in sets.items()}
    cells = two_frame(spark, twos)
    assert {tuple(r) for r in graph.ranked_graph(cells).collect()} == {tuple(r) for r in graph.sorted_graph(overlap_graph(cells)).collect()}


def test_sorted_graph_query_ranks_where_it_counts(spark, sf_dir):
    plan = catalogue.QUERIES["overlap_graph_sorted"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Exchange" not in above and "Window" not in above


def test_json_of_cells_needs_no_shuffle_of_edges(spark, sf_dir):
    rng = random.Random(9)
    sets = {i: {(i % 3 * 4 + rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(1, 20))} for i in range(60)}
    cells = cells_frame(spark, sets)
    want = {tuple(r) for r in graph.graph_json(overlap_graph(cells)).collect()}
    assert {tuple(r) for r in graph.cells_json(cells).collect()} == want and len(want) == 60
    above = catalogue.QUERIES["overlap_graph_json"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_batch_ranks_where_it_counts(spark):
    """Other queries than the cells, some of which they lack; ties; no row for each pair of a cell is shuffled."""
    rng = random.Random(10)
    sets = {i: {(i % 3 * 4 + rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(1, 20))} for i in range(60)}
    asked = {i: {(x + i % 2, y) for x, y in s} for i, s in sets.items() if i % 4 == 0} | {100: {(50, 50)}, 101: sets[3]}
    batch = overlap.overlap_batch(cells_frame(spark, sets), cells_frame(spark, asked), 3)
    want = set()
    for q, s in asked.items():
        best = sorted((-len(s & t), i) for i, t in sets.items() if i != q and s & t)[:3]
        want |= {(q, n, i, -w) for n, (w, i) in enumerate(best, 1)}
    assert {tuple(r) for r in batch.collect()} == want and len(want) > 40
    above = batch._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Window" not in above


def test_stored_graph_holds_each_pair_once(spark, tmp_path):
    """By sources and text ids too; a graph that was stored in both directions is read as it is."""
    sets = random_sets(12, n=30)
    for name, cells in (("one", cells_frame(spark, sets)), ("two", two_frame(spark, {(f"S{i % 2}", str(i // 2)): s for i, s in sets.items()}))):
        want = sorted(tuple(r) for r in overlap_graph(cells).collect())
        for _ in range(2):
            got = graph.load_or_make_graph(spark, str(tmp_path / name), cells)
            assert got.columns == overlap_graph(cells).columns
            assert sorted(tuple(r) for r in got.collect()) == want
        assert 2 * spark.read.parquet(str(tmp_path / name)).count() == len(want) > 100
        overlap_graph(cells).write.parquet(str(tmp_path / f"{name}-old"))
        assert sorted(tuple(r) for r in graph.load_or_make_graph(spark, str(tmp_path / f"{name}-old"), cells).collect()) == want
