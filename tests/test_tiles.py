"""Bands, label tiles, tiles of graphs and of marks: what is cut must not show."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundroute import shared
from groundroute.jobs import sweep
from groundroute.operators import graph, integral, keypoints, metrics, routes, stencil, traversability as tv
from groundroute.sources import images
from tests.test_routes import brute_tree, matrix_of


def image_rows(spark, arrays):
    """read_images' columns of BGR arrays."""
    rows = [(n, *a.shape, bytearray(a.astype(np.uint8).tobytes())) for n, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image long, h int, w int, channels int, data binary")


def pixel_rows(spark, arrays):
    rows = [(n, y, x, *(int(v) for v in a[y, x, ::-1])) for n, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image long, y long, x long, r long, g long, b long")


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(7)
    return [rng.integers(0, 256, (23, 31, 3)), rng.integers(0, 256, (12, 9, 3)), np.full((9, 9, 3), 50)]


@pytest.mark.parametrize("ov", [1, 2, 4])
def test_summed_areas_equal_sums_of_pixels(spark, arrays, ov):
    pixels = pixel_rows(spark, arrays)
    wanted = {tuple(r[c] for c in integral.CELL): r for r in tv.sums(tv.regions(pixels, images.shapes(pixels), [3, 4, 7], ov)).collect()}
    for bands in (images.to_bands(image_rows(spark, arrays)), images.to_bands(image_rows(spark, arrays), 70), images.pack_bands(pixels, images.shapes(pixels), rows=5)):
        found = integral.region_sums(bands, [3, 4, 7], ov).collect()
        assert len(found) == len(wanted)
        for r in found:
            old = wanted[tuple(r[c] for c in integral.CELL)]
            assert all(r[c] == old[c] for c in ["n", *integral.TERMS])


def brute_label(a, r, ov):
    out = {}
    h, w = a.shape
    ey, ex, cols = (h % r) // 2, (w % r) // 2, w // r * ov
    for i in range(h // r * ov):
        for j in range(cols):
            y, x = (ey + i * r) // ov, (ex + j * r) // ov
            cell = a[y : y + r, x : x + r]
            q = cell.shape[0] // 2
            if not q:
                out[i * cols + j] = None
                continue
            y0, x0 = cell.shape[0] % q // 2, cell.shape[1] % q // 2
            means = [cell[y0 + m * q : y0 + m * q + q, x0 + n * q : x0 + n * q + q].mean() for m in range(cell.shape[0] // q) for n in range(cell.shape[1] // q)]
            out[i * cols + j] = min(means, default=None)
    return out


@pytest.mark.parametrize("ov", [1, 2])
def test_labels_in_bands_equal_sub_blocks(spark, ov):
    rng = np.random.default_rng(9)
    a = rng.choice([0, 255], (29, 22), p=[0.3, 0.7])
    rows = spark.createDataFrame([(0, y, x, int(a[y, x])) for y in range(29) for x in range(22)], "image long, y long, x long, lab int")
    shapes = images.shapes(rows)
    as_read = image_rows(spark, [np.repeat(a[..., None], 3, axis=2)])
    for r in (2, 3, 5, 8):
        wanted = {k: pytest.approx(v) for k, v in brute_label(a, r, ov).items()}
        for labels in (rows, as_read, images.pack_bands(rows, (29, 22), ("lab",), rows=3), images.to_bands(as_read, 22)):
            assert {c.k: c.t for c in tv.tf_label(labels, shapes, [r], ov).collect()} == wanted


def test_bands_tell_of_missing_pixels_and_large_regions(spark, arrays):
    pixels = pixel_rows(spark, arrays)
    with pytest.raises(Exception, match="lacks pixels"):
        images.pack_bands(pixels.where("not (image = 0 and y = 4 and x = 2)"), images.shapes(pixels)).collect()
    with pytest.raises(Exception, match="no larger than its image"):
        integral.region_sums(images.to_bands(image_rows(spark, arrays)), [10]).collect()
    back = sorted(map(tuple, images.band_pixels(images.to_bands(image_rows(spark, arrays), 50)).collect()))
    assert back == sorted(map(tuple, pixels.collect()))
    assert sorted(map(tuple, images.to_pixels(images.from_pixels(pixels)).collect())) == back
    assert integral.region_sums(images.to_bands(image_rows(spark, arrays)).limit(0), [3]).count() == 0


def test_images_and_pixel_rows_give_the_same_matrices(spark, arrays):
    read, pixels = image_rows(spark, arrays), pixel_rows(spark, arrays)
    shapes = images.shapes(pixels)
    assert sorted(map(tuple, images.band_pixels(stencil.smooth_bands(read, 7, block=8)).collect())) == sorted(map(tuple, stencil.bilateral(pixels, None, 7).collect()))
    for smooth in (True, False):
        one, two = (sorted(map(tuple, tv.traversability(pixels, shapes, [3], "tf_rgbhist", smooth=smooth, images=x).collect())) for x in (read, None))
        assert one == two and len(one) == 7 * 10 + 4 * 3 + 9


def test_pixels_that_know_their_sides_need_no_join(spark, arrays):
    from groundroute.operators import grid

    read, shapes = image_rows(spark, arrays), images.shapes(pixel_rows(spark, arrays))
    for ov in (1, 2):
        wanted = sorted(map(tuple, grid.assign_cells(images.to_pixels(read).drop("r"), shapes, [3, 4], ov).collect()))
        for pixels in (images.to_pixels(read, sides=True), images.band_pixels(images.to_bands(read, 50), sides=True)):
            found = grid.assign_cells(pixels.drop("r"), shapes, [3, 4], ov)
            assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, found.select(*grid.assign_cells(images.to_pixels(read).drop("r"), shapes, [3], ov).columns).collect())) == wanted


def test_no_pixels_leave_the_tasks_that_read_images(spark, arrays):
    read = image_rows(spark, arrays)
    plan = tv.tf_gray(integral.region_sums(images.to_bands(read), [3, 4]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "MapInArrow" in plan


def test_multiscale_sweeps_blend_all_scales(spark):
    a = np.random.default_rng(3).integers(0, 256, (48, 48, 3))
    pixels = pixel_rows(spark, [a])
    shapes = images.shapes(pixels)
    found = sweep.matrices(pixels, None, shapes, "tf_grayhist", [16], 1, True, False, False)
    assert tv.scales_of([16]) == list(tv.SCALES) and tv.scales_of([3, 6])[:3] == [3, 6, 8]
    each = {r: {(c.i, c.j): c.t for c in tv.traversability(pixels, shapes, [r], smooth=False, normalize=False).collect()} for r in (6, 8, 10, 12, 14, 16)}
    total = np.zeros((3, 3))
    for r, cells in each.items():
        n = 48 // r
        m = np.array([[cells[i, j] for j in range(n)] for i in range(n)])
        if r == 16:
            total += m
            continue
        for i in range(3):
            for j in range(3):
                taps = []
                for at in (i, j):
                    p = (at + 0.5) * n / 3 - 0.5
                    low = int(np.floor(p))
                    taps.append([(min(max(low, 0), n - 1), 1 - (p - low)), (min(max(low + 1, 0), n - 1), p - low)])
                total[i, j] += r * sum(u * v * m[y, x] for y, u in taps[0] for x, v in taps[1])
    got = {(c.i, c.j): c.t for c in found.collect()}
    assert got == {(i, j): pytest.approx(total[i, j] / total.max()) for i in range(3) for j in range(3)}
    with pytest.raises(ValueError, match="not among the scales"):
        tv.scales_of([7])
    with pytest.raises(ValueError, match="as small as"):
        tv.traversability_multiscale(pixels, shapes, 5)


def test_sliding_minima_and_patches_over_tiles(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 256, (3, 17, 5)).astype(np.uint8)
    for k in (2, 3, 4, 7, 30):
        wanted = np.stack([v[:, max(0, n - k // 2) : n - k // 2 + k].min(axis=1) for n in range(17)], axis=1)
        assert (metrics.sliding_least(v, k, 1) == wanted).all()
    lab = rng.choice([0, 255], (40, 33), p=[0.1, 0.9])
    rows = spark.createDataFrame([(0, y, x, int(lab[y, x])) for y in range(40) for x in range(33)], "image long, y long, x long, lab int")
    read = image_rows(spark, [np.repeat(lab[..., None], 3, axis=2)])
    shapes = spark.createDataFrame([(0, 40, 33)], "image long, h long, w long")
    points, wanted = [], {}
    for r in (1, 2, 3, 7, 8, 25):
        half = r // 2
        for y, x in [(0, 0), (7, 7), (8, 8), (15, 16), (39, 32), (20, 3), (31, 24), (-9, 60)]:
            points.append((0, r, y, x))
            patch = lab[max(0, y - half) : max(0, min(39, y + half)), max(0, x - half) : max(0, min(32, x + half))]
            if patch.size:
                low = [[patch[max(0, a - half // 2) : max(1, a - half // 2 + half), max(0, b - half // 2) : max(1, b - half // 2 + half)].min() if half > 1 else patch[a, b] for b in range(patch.shape[1])] for a in range(patch.shape[0])]
                wanted[r, y, x] = pytest.approx(np.mean(low) / 255)
    asked = spark.createDataFrame(points, "image long, r int, row long, col long")
    for labels, side in ((rows, 256), (rows, 8), (read, 8), (read, 5)):
        assert {(p.r, p.row, p.col): p.t for p in metrics.patch_values(asked, labels, shapes, side).collect()} == wanted


def flood(lit):
    label, marks = {}, sorted(zip(*np.nonzero(lit)))
    for start in marks:
        if start not in label:
            todo = [start]
            while todo:
                p = todo.pop()
                if p not in label and lit[p]:
                    label[p] = start
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= p[0] + a < lit.shape[0] and 0 <= p[1] + b < lit.shape[1]]
    return label


def test_blobs_over_tiles_equal_flooding(spark):
    rng = np.random.default_rng(4)
    spiral = np.zeros((33, 33), dtype=bool)
    y, x, dy, dx = 0, 0, 0, 1
    spiral[0, 0] = True
    while True:  # a line that turns inwards and never touches itself
        ahead = lambda n: (y + n * dy, x + n * dx)  # noqa: B023, E731
        inside = lambda p: 0 <= p[0] < 33 and 0 <= p[1] < 33
        if not inside(ahead(1)) or (inside(ahead(2)) and spiral[ahead(2)]):
            dy, dx = dx, -dy
            if not inside(ahead(1)) or spiral[ahead(1)] or (inside(ahead(2)) and spiral[ahead(2)]):
                break
        y, x = ahead(1)
        spiral[y, x] = True
    shapes = [spiral, rng.random((30, 26)) < 0.35, rng.random((21, 40)) < 0.6, np.ones((17, 17), dtype=bool)]
    rows = [(n, "reachable", int(a), int(b)) for n, lit in enumerate(shapes) for a, b in zip(*np.nonzero(lit))]
    bright = spark.createDataFrame(rows + rows[:5], "image long, kind string, y long, x long")
    for side in (256, 8, 5):
        got = {n: {} for n in range(len(shapes))}
        for r in keypoints.label_blobs(bright, side).collect():
            got[r.image][r.y, r.x] = (r.label >> 31, r.label & ((1 << 31) - 1))
        assert got == {n: flood(lit) for n, lit in enumerate(shapes)}
        assert len(set(got[0].values())) == 1 and len(got[0]) > 300
        sides = {r.image: r.n for r in keypoints.blob_runs(bright, side).groupBy("image").agg(F.sum("sides").alias("n")).collect()}
        for n, lit in enumerate(shapes):
            big = np.pad(lit, 1)
            assert sides[n] == sum(int((big & ~np.roll(big, s, axis)).sum()) for s in (-1, 1) for axis in (0, 1))
    assert keypoints.label_blobs(bright.limit(0)).count() == 0


def test_components_of_each_key(spark):
    random.seed(1)
    edges = [(k, a, b) for k in ("p", "q") for a, b in [(n, n + 1) for n in range(40 if k == "p" else 3)] + [(90, 80), (80, 90), (5, 5), (70, 80)]]
    random.shuffle(edges)
    got = {(r.k, r.node): r.root for r in shared.components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()}
    wanted = {("p", n): 0 for n in range(1, 41)} | {("q", n): 0 for n in range(1, 4)} | {(k, n): 70 for k in "pq" for n in (80, 90)}
    assert got == wanted


def test_many_sources_are_dealt_in_blocks(spark, monkeypatch):
    random.seed(12)
    monkeypatch.setattr(routes, "MERGED", 2)
    m = matrix_of(spark, [[random.choice([0, 0.3, 0.6, 0.9, 1]) for _ in range(9)] for _ in range(8)])
    edges = graph.graph_edges(m, [0.2])
    flat = [(e.src, e.dst, e.w) for e in edges.collect()]
    sources = spark.createDataFrame([(0, 3, 0.2, s) for s in range(40)], "image long, r int, c double, s long")
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = {}
    for r in routes.shortest_tree(edges, sources, tile=7, block=6).collect():
        got.setdefault(r.s, {})[r.k] = r.dist
    assert got == {s: pytest.approx(brute_tree(flat, s)) for s in range(40)}
    left = [f for f in set(os.listdir(folder)) - before if f.startswith(("told", "lowered", "best"))]
    assert len(left) <= 1 + routes.MERGED, left
    with pytest.raises(RuntimeError, match="not settled"):
        routes.shortest_tree(edges, sources, tile=7, rounds=1)


@pytest.mark.parametrize("tile", [65_536, 11, 3])
def test_paths_over_tiles_equal_walks(spark, tile):
    random.seed(21)
    m = matrix_of(spark, [[random.choice([0, 0.3, 0.6, 0.9, 1]) for _ in range(8)] for _ in range(9)])
    edges = graph.graph_edges(m, [0.2])
    tree = routes.shortest_tree(edges, spark.createDataFrame([(0, 3, 0.2, s) for s in (0, 35)], "image long, r int, c double, s long"))
    preds = routes.predecessors(edges, tree)
    pairs = spark.createDataFrame([(0, 3, 0.2, "reachable", 0, n, s, t) for s in (0, 35) for n, t in enumerate(range(72))], "image long, r int, c double, kind string, o1 int, o2 int, s long, t long")
    found = routes.routes(pairs, tree)
    before = {(r.s, r.k): r.pred for r in preds.collect()}
    wanted = {}
    for r in found.where("found").collect():
        path = [r.t]
        while path[-1] != r.s:
            path.append(before[r.s, path[-1]])
        wanted[r.s, r.t] = path[::-1]
    got = {}
    for r in sorted(routes.trace_paths(found, preds, tile).collect(), key=lambda r: r.seq):
        assert len(got.setdefault((r.s, r.t), [])) == r.seq
        got[r.s, r.t].append(r.k)
    assert got == wanted and len(got) > 20


def test_a_long_corridor_is_read_back(spark):
    n = 100_000
    preds = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("image"), F.lit(3).alias("r"), F.lit(0.2).alias("c"), F.lit(0).cast("long").alias("s"), F.col("id").alias("k"), (F.col("id") - 1).alias("pred"))
    found = spark.createDataFrame([(0, 3, 0.2, 0, n, True), (0, 3, 0.2, 0, 0, True), (0, 3, 0.2, 0, 7, False)], "image long, r int, c double, s long, t long, found boolean")
    path = routes.trace_paths(found, preds, 10_000)
    assert path.where(f"t = {n} and seq = k").count() == n + 1 and [tuple(r) for r in path.where("t <> 100000").select("t", "seq", "k").collect()] == [(0, 0, 0)]


def test_errors_of_a_column_estimator_show_at_once(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 1, 2, 3), (0, 0, 1, 4, 5, 6), (0, 1, 0, 1, 2, 3), (0, 1, 1, 4, 5, 6)], "image long, y long, x long, r long, g long, b long")
    cells = tv.regions(pixels, images.shapes(pixels), [2])
    with pytest.raises(TypeError):
        tv.estimate(cells, lambda r, g, b: F.max(r) + len(g), series=False)
    with pytest.raises(TypeError, match="no Column"):
        tv.estimate(cells, lambda r, g, b: 3.0, series=False)
    assert tv.estimate(cells, lambda r, g, b: float(len(r)), series=True).first().t == 4 and tv.estimate(cells, lambda r, g, b: F.max(b), series=False).first().t == 6


def test_painted_bands_keep_the_last_cell(spark):
    from groundroute.operators import grid

    rng = np.random.default_rng(6)
    shapes = spark.createDataFrame([(0, 23, 19), (1, 40, 8)], "image long, h long, w long")
    cells = grid.grid(shapes, [4, 7], 2)
    matrix = spark.createDataFrame([(*r, float(t)) for r, t in zip(map(tuple, cells.select("image", "r", "i", "j", "k").collect()), rng.random(10_000)) if r[4] % 5], "image long, r int, i long, j long, k long, t double")
    at = {(c.image, c.r, c.k): (c.tly, c.tlx) for c in cells.collect()}
    wanted = {}
    for image, h, w in ((0, 23, 19), (1, 40, 8)):
        for r in (4, 7):
            a = np.ones((h, w), dtype=int)
            for c in sorted(matrix.where(f"image = {image} and r = {r}").collect(), key=lambda c: c.k):
                y, x = at[image, r, c.k]
                a[y : y + r, x : x + r] = int(np.floor(c.t * 255))
            wanted |= {(image, r, y, x): int(a[y, x]) for y in range(h) for x in range(w)}
    assert {(p.image, p.r, p.y, p.x): p.v for p in grid.paint(matrix, shapes, None, [4, 7], 2).collect()} == wanted
    for rows in (6, 256):
        bands = grid.paint_bands(matrix, shapes, [4, 7], 2, rows)
        whole = images.from_bands(bands, "r").collect()
        assert {(*map(int, b.image.split("-")), n // b.w, n % b.w): v for b in whole for n, v in enumerate(b.data)} == wanted
    assert grid.paint_bands(matrix.limit(0), shapes, [4], 1).count() == 2


def test_appending_twice_adds_nothing_and_reads_what_it_must(spark, tmp_path):
    from groundroute.sources import results

    path = str(tmp_path / "stored")
    rows = [(f"a{k}", 6 + 2 * (k % 5), k % 3 / 10, k, k, k / 7) for k in range(40)]
    made = lambda part: spark.createDataFrame(part, "image string, region_size int, cut_threshold double, s int, t int, path_score double")
    results.append_files(made([r for r in rows if r[1] < 12] + [(None, None, None, None, None, 0.5)] * 2), path)
    first = {f: f.stat().st_mtime_ns for f in (tmp_path / "stored" / "region_size=6").glob("*.parquet")}
    new = made([r for r in rows if r[1] >= 10] + [(None, None, None, None, None, 0.9)])
    for _ in range(2):
        results.append_files(new, path)
        assert sorted(map(tuple, spark.read.parquet(path).select(new.columns).collect()), key=str) == sorted([*rows, (None, None, None, None, None, 0.5)], key=str)
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "stored" / "region_size=6").glob("*.parquet")} == first
    plan = results.touched(spark, path, new)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    with pytest.raises(ValueError, match="keys"):
        results.append_files(new.select("region_size", "path_score").withColumnRenamed("region_size", "size"), path)


def test_sweep_records_have_times_for_the_reports(spark, tmp_path):
    from groundroute.operators import report
    from groundroute.sources import results

    values = [[(y * 37 + x * 91) % 60 for x in range(12)] for y in range(12)]
    rows = [(0, y, x, v, v, v) for y, line in enumerate(values) for x, v in enumerate(line)]
    pixels = spark.createDataFrame(rows, "image long, y long, x long, r long, g long, b long")
    points = spark.createDataFrame([(0, "reachable", n, y, x) for n, (y, x) in enumerate([(1, 1), (1, 10), (10, 1)])], "image long, kind string, ord int, y long, x long")
    lab = pixels.select("image", "y", "x", F.lit(255).alias("lab"))
    found = sweep.run_sweep(pixels, lab, points, ["tf_grayhist"], [2, 3], [0.1, 0.9], smooth=False, normalize=False)
    path = str(tmp_path / "records")
    results.write_results(found.withColumn("image", F.col("image").cast("string")).select(*[f.split()[0] for f in results.RESULT.split(", ")]), path)
    read = results.read_results(spark, path, array=False)
    assert read.count() == 12
    for t in sweep.TIMES:
        assert read.where(f"{t} is null or {t} < 0").count() == 0 and read.agg(F.sum(t)).first()[0] > 0
    assert all(v is not None and v >= 0 for r in report.time_summary(read, ["region_size", "cut_threshold"]).collect() for v in r)
    assert report.time_series(read).count() == 16 and report.time_spread(read).count() == 16
    assert report.time_series_combined(read, read, ("a", "b")).count() == 32 and report.average_time(read, "tf_grayhist", 2, 0.1).first().n == 3


def test_written_tables_are_never_broadcast_by_the_size_of_their_files(spark):
    df = spark.range(1000).withColumnRenamed("id", "a")
    plan = lambda one, two: one.join(two, "a")._jdf.queryExecution().executedPlan().toString()
    for table in (shared.written(df, "test"), shared.Rounds(spark, "test").write(df)):
        assert "BroadcastHashJoin" not in plan(df, table.where("a > 3").groupBy("a").count()) + plan(table, df)
        assert "BroadcastHashJoin" in plan(df, shared.small(table))
    matrix = matrix_of(spark, np.full((4, 4), 0.5))
    edges = graph.graph_edges(matrix, [0.1])
    assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()


def test_a_side_too_large_to_broadcast_is_sorted(spark):
    few = shared.written(spark.range(5).selectExpr("id as a"), "test", sorts=False)
    plan = lambda side: spark.range(1000).selectExpr("id as a").join(side, "a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(shared.small(few))
    assert "BroadcastHashJoin" not in plan(shared.small(few, most=10))


def test_matrices_and_points_are_never_broadcast_by_the_size_of_their_files(spark):
    matrix = shared.written(matrix_of(spark, np.linspace(0.1, 1, 30).reshape(5, 6)), "test", sorts=False)
    marks = shared.written(spark.createDataFrame([(0, "a", n, n, 2 * n) for n in range(3)], "image long, kind string, ord int, y long, x long"), "test", sorts=False)
    shape = shared.written(spark.createDataFrame([(0, 5, 6)], "image long, h long, w long"), "test", sorts=False)
    made = [
        tv.clahe(matrix), tv.resize_bilinear(matrix, spark.range(1).selectExpr("id as image", "7 as rows", "8 as cols")),
        cells := keypoints.keypoint_cells(marks, shape, [1]), keypoints.keypoint_pairs(cells),
    ]
    assert not [n for n, df in enumerate(made) if "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()]
    assert [df.count() for df in made] == [30, 56, 3, 3]


@pytest.mark.parametrize("gathered", [1, 7, 1000])
def test_gathered_groups_are_whole_and_in_order(spark, gathered):
    def sums(table, first):
        key, n, at = (table[c].to_numpy(zero_copy_only=False) for c in ("k", "n", "at"))
        for a, b in zip(first, [*first[1:], len(n)]):
            assert len(set(key[a:b])) == 1 and list(at[a:b]) == sorted(at[a:b])
            yield table.slice(a, 1).select(["k"]).append_column("total", [[n[a:b].sum()]]).append_column("rows", [[b - a]])

    rows = [(f"g{n % 13 if n < 300 else 13}", n, -n) for n in range(600)]
    found = shared.in_groups(spark.createDataFrame(rows, "k string, n long, at long"), ["k"], sums, "k string, total long, rows long", order=["at"], gathered=gathered)
    wanted = {}
    for k, n, _ in rows:
        wanted.setdefault(k, []).append(n)
    assert sorted(map(tuple, found.collect())) == sorted((k, sum(v), len(v)) for k, v in wanted.items())


def test_routes_and_paths_take_many_small_groups_in_a_call(spark):
    one = matrix_of(spark, np.full((4, 4), 0.5))
    cells = one.crossJoin(spark.range(3).select(F.col("id").alias("n"))).withColumn("image", F.col("n")).drop("n")
    edges = graph.graph_edges(cells, [0.1])
    tree = routes.shortest_tree(edges, cells.where("k in (0, 5)").select("image", "r", F.lit(0.1).alias("c"), F.col("k").alias("s")))
    pairs = tree.where("k = 15").select("image", "r", "c", "s", F.col("k").alias("t"), F.lit(True).alias("found"))
    paths = routes.trace_paths(pairs, routes.predecessors(edges, tree))
    simple = routes.simplify_paths(paths.withColumns({"row": F.col("k") / 4, "col": F.col("k") % 4}))
    plans = "".join(df._jdf.queryExecution().executedPlan().toString() for df in (paths, simple))
    assert "FlatMap" not in plans and "InPandas" not in plans
    assert {(r.image, r.s, r.n) for r in simple.collect()} == {(n, s, 4 if s == 0 else 3) for n in range(3) for s in (0, 5)}


def test_scores_are_joined_without_a_broadcast_by_size(spark):
    points = spark.createDataFrame([(0, 3, 0.1, 0, 1, n, 4 + n, 5) for n in range(3)], "image long, r int, c double, s long, t long, seq int, row long, col long")
    labels = spark.createDataFrame([(0, y, x, 255) for y in range(12) for x in range(12)], "image long, y long, x long, lab int")
    scored = metrics.score_paths(points, labels, images.shapes(labels))
    assert "BroadcastHashJoin" not in scored._jdf.queryExecution().executedPlan().toString()
    assert [r.score for r in scored.collect()] == [1.0]


def test_times_of_paths_are_joined_without_a_broadcast(spark):
    pixels = spark.createDataFrame([(0, y, x, *[(y * 37 + x * 91) % 60] * 3) for y in range(12) for x in range(12)], "image long, y long, x long, r long, g long, b long")
    points = spark.createDataFrame([(0, "reachable", n, 1 + 9 * n, 1) for n in range(2)], "image long, kind string, ord int, y long, x long")
    found = sweep.run_sweep(pixels, None, points, ["tf_grayhist"], [2], [0.1], smooth=False, normalize=False)
    joins = [line.split("[")[1].split("]")[0] for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert joins and not [keys for keys in joins if len(keys.split(", ")) == len(routes.PATH)]
    assert [r.path_build_time > 0 for r in found.collect()] == [True]


def test_shapes_of_many_marks_take_one_call(spark):
    marks = [(n, "a", y, x, 255) for n in range(5) for y in range(2, 8) for x in range(3, 9 + 40 * (n == 4))]
    found = keypoints.find_blobs(spark.createDataFrame(marks, "image long, kind string, y long, x long, gray int"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(n, "a", 0, 4, 5) for n in range(4)]


def rows_shuffled(spark, df):
    """df's rows, and how many rows its stages wrote for shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    listed = lambda: (lambda found: {found.apply(n).stageId(): found.apply(n).shuffleWriteRecords() for n in range(found.size())})(stages())
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = max(listed(), default=-1)
    rows = df.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, sum(n for stage, n in listed().items() if stage > before)


def test_cells_are_shuffled_and_not_their_edges(spark):
    m = shared.written(matrix_of(spark, np.full((12, 12), 0.5)), "test")
    found, shuffled = rows_shuffled(spark, graph.base_edges(m, 2))
    assert len(found) == 1892 and shuffled == 144


def test_no_row_is_shuffled_for_each_edge_and_source(spark):
    m = matrix_of(spark, np.random.default_rng(4).choice([0.3, 0.6, 0.9, 1], (12, 12)))
    edges = shared.written(graph.graph_edges(m, [0.2], 2), "test")
    sources = spark.createDataFrame([(0, 3, 0.2, s) for s in range(30)], "image long, r int, c double, s long")
    tree = shared.written(routes.shortest_tree(edges, sources, kept=True), "test")
    found, shuffled = rows_shuffled(spark, routes.predecessors(edges, tree))
    assert len(found) == 30 * 143 and shuffled <= 1892 + 30 * 144 + 4


@pytest.mark.parametrize("side", [512, 4, 1])
@pytest.mark.parametrize("reach", [1, 2])
def test_edges_over_tiles_equal_brute_force(spark, side, reach):
    rng = np.random.default_rng(reach)
    values = rng.choice([0, 0.1, 0.3, 0.6, 1], (9, 7))
    got = sorted(tuple(e) for e in graph.base_edges(matrix_of(spark, values), reach, 0.1, side).select("src", "dst", "w", "tmin").collect())
    wanted = []
    for i, j in np.ndindex(9, 7):
        for a, b in {(s * x, s * y) for s in range(1, reach + 1) for x, y in graph.NEAR}:
            if 0 <= i + a < 9 and 0 <= j + b < 7 and min(values[i, j], values[i + a, j + b]) >= 0.1:
                one, two = float(values[i, j]), float(values[i + a, j + b])
                wanted.append((i * 7 + j, (i + a) * 7 + j + b, (100 / one) * (100 / one) + (100 / two) * (100 / two), min(one, two)))
    assert got == sorted(wanted)
    blocked = graph.base_edges(matrix_of(spark, [[0, 1]]), 1).select("src", "dst", "w", "tmin").collect()
    assert sorted(map(tuple, blocked)) == [(0, 1, float("inf"), 0), (1, 0, float("inf"), 0)]


@pytest.mark.parametrize("tile, block", [(65_536, 8), (7, 1), (11, 3)])
def test_predecessors_over_tiles_and_blocks_equal_brute_force(spark, tile, block):
    random.seed(31)
    cells = [matrix_of(spark, [[random.choice([0, 0.3, 0.6, 1]) for _ in range(7)] for _ in range(6)], image=n) for n in range(2)]
    edges = graph.graph_edges(cells[0].unionByName(cells[1]), [0.2, 0.5])
    sources = spark.createDataFrame([(n, 3, c, s) for n in range(2) for c in (0.2, 0.5) for s in range(0, 42, 4)], "image long, r int, c double, s long")
    tree = shared.written(routes.shortest_tree(edges, sources), "test")
    dist = {(*(r[c] for c in routes.GRAPH), r.s, r.k): r.dist for r in tree.collect()}
    wanted = {}
    for e in edges.collect():
        for s in range(0, 42, 4):
            at = (e.image, e.r, e.c, s)
            if e.dst != s and dist.get((*at, e.src), float("inf")) + e.w == dist.get((*at, e.dst)):
                wanted[*at, e.dst] = min(e.src, wanted.get((*at, e.dst), e.src))
    got = [tuple(r) for r in routes.predecessors(edges, tree, tile, block).select(*routes.NODE, "pred").collect()]
    assert {g[:-1]: g[-1] for g in got} == wanted and len(got) == len(wanted) > 500
    assert routes.predecessors(edges.limit(0), tree, tile, block).count() == 0 and routes.predecessors(edges, tree.limit(0), tile, block).count() == 0


def test_predecessors_looked_at_a_few_at_a_time_are_the_same():
    rng = np.random.default_rng(9)
    of, is_edge = np.sort(rng.integers(0, 5, 4000)), rng.random(4000) < 0.5
    a, k, v = rng.integers(0, 20, 4000), rng.integers(0, 20, 4000), rng.integers(1, 4, 4000).astype(float)
    keep = np.unique(np.c_[of, is_edge, a, k], axis=0, return_index=True)[1]
    of, is_edge, a, k, v = (x[np.sort(keep)] for x in (of, is_edge, a, k, v))
    wanted, dist = {}, {(g, s, n): d for g, e, s, n, d in zip(of, is_edge, a, k, v) if not e}
    for g, src, dst, w in zip(of[is_edge], a[is_edge], k[is_edge], v[is_edge]):
        for s in range(20):
            if dst != s and (g, s, src) in dist and dist[g, s, src] + w == dist.get((g, s, dst)):
                wanted[g, s, dst] = min(src, wanted.get((g, s, dst), src))
    for places in (1, 50, 1000, 1 << 22):
        got = [x for part in routes._before(of, is_edge, a, k, v, places) for x in zip(*part)]
        assert {g[:3]: g[3] for g in got} == wanted and len(got) == len(wanted) > 100


@pytest.mark.parametrize("tile", [65_536, 9])
def test_a_tree_of_one_round_has_its_predecessors(spark, tile):
    random.seed(17)
    edges = graph.graph_edges(matrix_of(spark, [[random.choice([0, 0.3, 0.6, 1]) for _ in range(7)] for _ in range(6)]), [0.2, 0.5], 2)
    sources = spark.createDataFrame([(0, 3, c, s) for c in (0.2, 0.5) for s in range(0, 42, 4)], "image long, r int, c double, s long")
    plain, told = (routes.shortest_tree(edges, sources, tile=tile, preds=p) for p in (False, True))
    assert plain.columns == [*routes.NODE, "dist"] and ("pred" in told.columns) == (tile > 42)
    assert sorted(map(tuple, told.drop("pred").collect())) == sorted(map(tuple, plain.collect()))
    found, wanted = (sorted(map(tuple, routes.predecessors(edges, tree).select(*routes.NODE, "pred").collect())) for tree in (told, plain))
    assert found == wanted and len(found) > 300


def test_sweeps_shuffle_no_distances_for_predecessors(spark, monkeypatch):
    def none(edges, tree):
        assert "pred" in tree.columns
        return predecessors(edges, tree)

    predecessors = routes.predecessors
    monkeypatch.setattr(sweep, "predecessors", none)
    pixels = spark.createDataFrame([(0, y, x, *[(y * 37 + x * 91) % 60] * 3) for y in range(12) for x in range(12)], "image long, y long, x long, r long, g long, b long")
    points = spark.createDataFrame([(0, "reachable", n, 1 + 9 * n, 1) for n in range(2)], "image long, kind string, ord int, y long, x long")
    found = sweep.run_sweep(pixels, None, points, ["tf_grayhist"], [2], [0.1], smooth=False, normalize=False).collect()
    assert [r.path_found for r in found] == [True] and found[0].path_coordinates[0] == [1, 1] and found[0].path_coordinates[-1] == [11, 1]
