"""Hand cases and properties of grids, estimators, graphs and routes."""

import heapq
import random
import struct

import numpy as np
import pytest

from groundroute.jobs import sweep
from groundroute.operators import graph, grid, keypoints, metrics, report, routes, stencil, traversability as tv
from groundroute.sources import images, results


def pixels_of(spark, values, image=0):
    rows = [(image, y, x, int(v), int(v), int(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image long, y long, x long, r long, g long, b long")


def matrix_of(spark, values, image=0, r=3):
    cols = len(values[0])
    rows = [(image, r, i, j, i * cols + j, float(t)) for i, line in enumerate(values) for j, t in enumerate(line)]
    return spark.createDataFrame(rows, "image long, r int, i long, j long, k long, t double")


def test_bmp_read_and_pixels(spark, tmp_path):
    h, w = 3, 2
    rgb = np.arange(h * w * 3, dtype=np.uint8).reshape(h, w, 3)
    rows = b"".join(line[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for line in rgb[::-1])
    (tmp_path / "a.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)
    got = {(r.image, r.y, r.x): (r.r, r.g, r.b) for r in images.to_pixels(images.read_images(spark, str(tmp_path)), band_rows=2).collect()}
    assert got == {("a.bmp", y, x): tuple(int(v) for v in rgb[y, x]) for y in range(h) for x in range(w)}


def test_results_as_one_array(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"image": "a", "region_size": 6, "path_coordinates": [[1, 2], [3, 4]]},\n {"image": "b", "path_found": true}]')
    rows = {r.image: r for r in results.read_results(spark, str(tmp_path / "r.json")).collect()}
    assert rows["a"].path_coordinates == [[1, 2], [3, 4]] and rows["b"].path_found and rows["b"].region_size is None


def test_grid_crops_evenly_and_refuses_large_regions(spark):
    shape = spark.createDataFrame([(0, 10, 7)], "image long, h long, w long")
    cells = grid.grid(shape, [3]).collect()
    assert len(cells) == 6 and min(c.tly for c in cells) == 0 and min(c.tlx for c in cells) == 0
    shape = spark.createDataFrame([(0, 11, 8)], "image long, h long, w long")
    assert {c.tly for c in grid.grid(shape, [3]).collect()} == {1, 4, 7}
    with pytest.raises(Exception, match="larger"):
        grid.grid(shape, [9]).collect()


def test_flat_image_is_easy(spark):
    p = pixels_of(spark, [[9] * 6] * 6)
    s = images.shapes(p)
    for f in (tv.tf_gray, tv.tf_rgb):
        assert {r.t for r in f(tv.sums(tv.regions(p, s, [3]))).collect()} == {1.0}
    assert {r.t for r in tv.tf_superpixel(tv.regions(p, s, [3])).collect()} == {1.0}


def test_estimate_takes_columns_and_series(spark):
    from pyspark.sql import functions as F

    p = pixels_of(spark, [[1, 2], [3, 4]])
    cells = tv.regions(p, images.shapes(p), [2])
    assert tv.estimate(cells, lambda r, g, b: F.max(r)).first().t == 4
    assert tv.estimate(cells, lambda r, g, b: float(r.to_numpy().max())).first().t == 4


def test_bilateral_blocks_do_not_show(spark):
    rng = np.random.default_rng(1)
    p = pixels_of(spark, rng.integers(0, 255, (19, 23)))
    s = images.shapes(p)
    one, many = (sorted(map(tuple, stencil.bilateral(p, s, 7, block=b).collect())) for b in (64, 5))
    assert one == many and len(one) == 19 * 23


def brute_tree(edges, source):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, k = heapq.heappop(heap)
        if k not in dist:
            dist[k] = d
            for b, w in near.get(k, ()):
                if b not in dist:
                    heapq.heappush(heap, (d + w, b))
    return dist


def test_routes_equal_dijkstra(spark):
    random.seed(3)
    m = matrix_of(spark, [[random.choice([0, 0.3, 0.6, 1]) for _ in range(7)] for _ in range(7)])
    edges = graph.graph_edges(m, [0.2, 0.5])
    sources = spark.createDataFrame([(0, 3, c, s) for c in (0.2, 0.5) for s in (0, 24, 48)], "image long, r int, c double, s long")
    got = {}
    for r in routes.shortest_tree(edges, sources, steps=2).collect():
        got.setdefault((r.c, r.s), {})[r.k] = r.dist
    for c in (0.2, 0.5):
        flat = [(e.src, e.dst, e.w) for e in edges.where(f"c = {c}").collect()]
        assert {(b, a, w) for a, b, w in flat} == set(flat)
        for s in (0, 24, 48):
            assert got[c, s] == pytest.approx(brute_tree(flat, s))


def test_whole_way_on_a_wall(spark):
    values = [[50] * 12 for _ in range(12)]
    for y in range(12):
        for x in range(12):
            values[y][x] = 50 if x < 4 or x >= 8 else (y * 37 + x * 91) % 200
    p = pixels_of(spark, values)
    points = spark.createDataFrame([(0, "unreachable", 0, 1, 1), (0, "unreachable", 1, 1, 10), (0, "reachable", 0, 10, 1), (0, "reachable", 1, 1, 1), (0, "reachable", 2, 1, 2)], "image long, kind string, ord int, y long, x long")
    lab = spark.createDataFrame([(0, y, x, 255) for y in range(12) for x in range(12)], "image long, y long, x long, lab int")
    rows = {(r.path_existence, r.o1, r.o2): r for r in sweep.run_sweep(p, lab, points, ["tf_grayhist"], [2], [0.5], smooth=False, normalize=False).collect()}
    assert not rows[False, 0, 1].path_found and rows[False, 0, 1].path_score == 1 and rows[False, 0, 1].path_length == 2
    assert rows[True, 0, 1].path_found and rows[True, 0, 1].path_coordinates[0] == [11, 1]
    unlabelled = sweep.route_all(p, points, "tf_grayhist", 2, 0.5, smooth=False, normalize=False)
    assert {r.path_score for r in unlabelled.collect()} == {None}


def test_rdp_keeps_ends_and_corners():
    line = np.array([[0, 0], [0, 5], [0, 10], [5, 10], [10, 10]])
    assert routes.rdp(line, 1.0).tolist() == [True, False, True, False, True]
    loop = np.array([[0, 0], [4, 4], [0, 1], [0, 0]])
    keep = routes.rdp(loop, 1.0)
    assert keep[0] and keep[-1] and keep[2]
    assert routes.rdp(np.array([[3, 3]]), 1.0).tolist() == [True]


def test_error_of_a_matrix_with_itself(spark):
    m = matrix_of(spark, np.random.default_rng(2).random((9, 9)))
    pairs = metrics.compare(m, m)
    value = lambda n: metrics.error(pairs, n).first().value
    assert value("corr") == pytest.approx(1) and value("jaccard") == 1 and value("rmse") == 0 and value("nmae") == 0 and value("psnr") is None and value("ssim") == pytest.approx(1)


def test_clahe_in_range_and_padded(spark):
    m = matrix_of(spark, np.random.default_rng(4).random((10, 10)))
    out = tv.clahe(m).collect()
    assert len(out) == 100 and all(0 <= r.t <= 1 for r in out)


def test_blobs_too_small_or_thin_are_left_out(spark):
    rows = [(0, "reachable", y, x, 255 if (y < 6 and x < 6) or (y > 10 and y < 13 and x > 10 and x < 13) or (y == 20 and x < 25) else 0) for y in range(26) for x in range(26)]
    got = keypoints.find_blobs(spark.createDataFrame(rows, "image long, kind string, y long, x long, gray int")).collect()
    assert [(r.ord, r.y, r.x) for r in got] == [(0, 2, 2)]


def test_empty_results_give_empty_reports(spark):
    empty = spark.createDataFrame([], results.RESULT)
    assert report.detection_rates(empty, ["region_size"]).count() == 0 and report.time_series(empty).count() == 0
    heat = report.heatmap(empty, "quality", [6], [0.1]).first()
    assert heat.value == -1


@pytest.mark.parametrize("steps, tile", [(None, 65_536), (None, 5), (1, 9), (3, 49)])
def test_routes_over_tiles_equal_dijkstra(spark, steps, tile):
    random.seed(8)
    m = matrix_of(spark, [[random.choice([0, 0.3, 0.6, 0.9, 1]) for _ in range(8)] for _ in range(9)])
    edges = graph.graph_edges(m, [0.2])
    flat = [(e.src, e.dst, e.w) for e in edges.collect()]
    sources = spark.createDataFrame([(0, 3, 0.2, s) for s in (0, 30, 71)] * 2, "image long, r int, c double, s long")
    got = {}
    for r in routes.shortest_tree(edges, sources, steps=steps, tile=tile).collect():
        got.setdefault(r.s, {})[r.k] = r.dist
    assert got == {s: pytest.approx(brute_tree(flat, s)) for s in (0, 30, 71)}
    assert routes.shortest_tree(edges.limit(0), sources).count() == 3 and routes.shortest_tree(edges, sources.limit(0)).count() == 0


@pytest.mark.parametrize("r", [2, 3, 6, 8, 12])
def test_patch_values_equal_brute_force(spark, r):
    rng = np.random.default_rng(r)
    lab = rng.choice([0, 255], (20, 17), p=[0.2, 0.8])
    labels = spark.createDataFrame([(0, y, x, int(lab[y, x])) for y in range(20) for x in range(17)], "image long, y long, x long, lab int")
    shapes = spark.createDataFrame([(0, 20, 17)], "image long, h long, w long")
    points = [(0, r, y, x) for y in (0, 5, 10, 19) for x in (0, 8, 16)]
    got = {(p.row, p.col): p.t for p in metrics.patch_values(spark.createDataFrame(points + points[:3], "image long, r int, row long, col long"), labels, shapes).collect()}
    half, wanted = r // 2, {}
    for _, _, y, x in points:
        patch = lab[max(0, y - half) : min(19, y + half), max(0, x - half) : min(16, x + half)]
        if patch.size:
            low = [[patch[max(0, a - half // 2) : max(0, a - half // 2 + half), max(0, b - half // 2) : max(0, b - half // 2 + half)].min() for b in range(patch.shape[1])] for a in range(patch.shape[0])]
            wanted[y, x] = np.mean(low) / 255
    assert got == pytest.approx(wanted)


def test_large_blobs_count_and_a_limit_is_a_parameter(spark):
    rows = [(0, "reachable", y, x, 255 if y < 80 and x < 80 and not (20 <= y < 30 and 20 <= x < 24) else 0) for y in range(82) for x in range(82)]
    marks = spark.createDataFrame(rows, "image long, kind string, y long, x long, gray int")
    assert [(b.y, b.x) for b in keypoints.find_blobs(marks).collect()] == [(39, 39)]
    assert keypoints.find_blobs(marks, most_area=5000).count() == 0


def test_broadcast_is_bounded_in_bytes(spark):
    from groundroute import shared

    df = spark.createDataFrame([(1, "x" * 1000, [1, 2], [("ab", 1)]), (2, None, None, None)], "a long, b string, c array<long>, d array<struct<e: string, f: int>>")
    assert 1000 < shared.n_bytes(df) < 1500 and shared.n_bytes(df.limit(0)) == 0
    plan = lambda most: spark.range(5).withColumnRenamed("id", "a").join(shared.small(df, most), "a")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(5000).lower() and "broadcast" not in plan(500).lower()


def test_rounds_take_each_others_place_and_clusters_need_a_folder(spark, monkeypatch):
    import os

    from groundroute import shared

    kept = shared.Rounds(spark, "test-rounds")
    first = kept.write(spark.range(3))
    old = kept.last
    second = kept.write(first.union(spark.range(2)))
    assert second.count() == 5 and not os.path.exists(old.removeprefix("file://")) and os.path.exists(kept.last.removeprefix("file://"))

    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Cluster())


def test_accuracy_by_estimator(spark):
    a, b = (matrix_of(spark, np.random.default_rng(k).random((9, 9))) for k in (1, 2))
    rows = {(r.f, r.measure): r.value for r in report.accuracy_table({"one": a, "two": b}, a).collect()}
    assert len(rows) == 14 and rows["one", "corr"] == pytest.approx(1) and rows["one", "rmse"] == 0 and rows["two", "rmse"] > 0.1 and rows["one", "psnr"] is None


def test_own_errors_of_an_estimator_show(spark):
    p = pixels_of(spark, [[1, 2], [3, 4]])
    with pytest.raises(KeyError):
        tv.estimate(tv.regions(p, images.shapes(p), [2]), lambda r, g, b: {}["x"])


def plain_superpixels(rgb, segments=32, rounds=10, compactness=10.0):
    """k-means over place and colour, pixel by pixel."""
    h, w = len(rgb), len(rgb[0])
    side = max(1, round(segments**0.5))
    places = lambda n: sorted({round(k * (n - 1) / (min(side, n) - 1)) if min(side, n) > 1 else 0 for k in range(min(side, n))})
    scale = compactness / max(1.0, (h * w / segments) ** 0.5)
    data = {(y, x): (y * scale, x * scale, *map(float, rgb[y][x])) for y in range(h) for x in range(w)}
    centres = [data[y, x] for y in places(h) for x in places(w)]
    for _ in range(rounds):
        held = [[] for _ in centres]
        for p in data.values():
            held[min(range(len(centres)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, centres[k])), k))].append(p)
        centres = [tuple(sum(c) / len(g) for c in zip(*g)) if g else centres[k] for k, g in enumerate(held)]
    means = [[sum(p[c] for p in g) / len(g) for c in (2, 3, 4)] for g in held if g]
    spread = sum(np.var([m[c] for m in means]) for c in range(3))
    return 1.0 if spread == 0 else min(1.0, 3 / spread)


def test_superpixels_equal_plain_clusters(spark):
    halves = [[(0, 0, 0)] * 3 + [(100, 100, 100)] * 3 for _ in range(6)]
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 255, (6, 6, 3)).tolist()
    rows = [(n, y, x, *map(int, img[y][x])) for n, img in enumerate((halves, noise)) for y in range(6) for x in range(6)]
    p = spark.createDataFrame(rows, "image long, y long, x long, r long, g long, b long")
    cells = tv.regions(p, images.shapes(p), [6])
    got = {r.image: r.t for r in tv.tf_superpixel(cells, segments=4).collect()}
    assert got[0] == pytest.approx(3 / 7500) and got[1] == pytest.approx(plain_superpixels(noise, 4))
    assert {r.image: r.t for r in tv.tf_superpixel(cells).collect()}[1] == pytest.approx(plain_superpixels(noise))
