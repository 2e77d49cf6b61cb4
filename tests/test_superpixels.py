"""Superpixels step by step against plain Python."""

import numpy as np
import pytest

from groundroute.operators import superpixels as sp, traversability as tv
from groundroute.sources import images


def plain_blur(a, sigma):
    reach = int(4 * sigma + 0.5)
    weights = [np.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    mirror = lambda p, n: min(p % (2 * n), 2 * n - 1 - p % (2 * n))
    out = a.astype(float)
    for axis in (0, 1):
        now, n = out.copy(), out.shape[axis]
        for p in range(n):
            line = sum(w * np.take(now, mirror(p + k, n), axis=axis) for k, w in zip(range(-reach, reach + 1), weights)) / sum(weights)
            if axis == 0:
                out[p] = line
            else:
                out[:, p] = line
    return out


def plain_segments(rgb, segments, rounds, compactness, sigma, window, least):
    h, w, _ = rgb.shape
    smooth = plain_blur(rgb, sigma) if sigma else rgb.astype(float)
    side = max(1.0, (h * w / segments) ** 0.5)
    centres = [(smooth[y, x], float(y), float(x)) for y in sp.seeds(h, segments) for x in sp.seeds(w, segments)]
    label = {}
    for _ in range(rounds):
        for y in range(h):
            for x in range(w):
                far = [(compactness / side) ** 2 * ((y - cy) ** 2 + (x - cx) ** 2) + float(((smooth[y, x] - c) ** 2).sum()) for c, cy, cx in centres]
                near = [k for k, (_, cy, cx) in enumerate(centres) if window is None or abs(y - cy) <= window * side and abs(x - cx) <= window * side]
                label[y, x] = min(near or range(len(centres)), key=lambda k: (far[k], k))
        for k in range(len(centres)):
            held = [p for p, v in label.items() if v == k]
            if held:
                centres[k] = (np.mean([smooth[p] for p in held], axis=0), np.mean([p[0] for p in held]), np.mean([p[1] for p in held]))
    if not least:
        return np.array([[label[y, x] for x in range(w)] for y in range(h)])
    own = {}
    for y in range(h):
        for x in range(w):
            if (y, x) not in own:
                todo, first = [(y, x)], y * w + x
                while todo:
                    p = todo.pop()
                    if own.setdefault(p, first) == first and p in label:
                        for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)):
                            if q in label and q not in own and label[q] == label[p]:
                                todo.append(q)
    sizes = {}
    for v in own.values():
        sizes[v] = sizes.get(v, 0) + 1

    def final(v):
        if v == 0 or sizes[v] >= least * h * w / segments:
            return v
        y, x = divmod(v, w)
        return final(own[y, x - 1] if x else own[y - 1, x])

    return np.array([[final(own[y, x]) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("sigma,window,least", [(0.0, None, 0.0), (0.0, 2.0, 0.0), (1.5, 2.0, 0.5), (5.0, 2.0, 0.5), (0.0, 1.0, 0.9)])
def test_segments_equal_plain_ones(sigma, window, least):
    rng = np.random.default_rng(11)
    for h, w, segments in ((12, 12, 8), (9, 14, 6), (6, 5, 32), (1, 7, 4)):
        rgb = np.stack([rng.integers(0, 60, (h, w, 3)) + 120 * (np.add.outer(np.arange(h), np.arange(w)) > k + 6)[..., None] for k in range(3)])
        got = sp.segmented(rgb, segments, 4, 10.0, sigma, window, least)
        for k in range(3):
            wanted = plain_segments(rgb[k], segments, 4, 10.0, sigma, window, least)
            assert (got[k] == wanted).all()
            means = [rgb[k][wanted == v].mean(axis=0) for v in np.unique(wanted)]
            assert sp.spread(rgb[k : k + 1], got[k : k + 1])[0] == pytest.approx(np.var(means, axis=0).sum())


def test_rows_of_regions_of_several_shapes(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20, 23, 3))
    rows = [(0, y, x, *map(int, a[y, x])) for y in range(20) for x in range(23)]
    pixels = spark.createDataFrame(rows, "image long, y long, x long, r long, g long, b long")
    cells = tv.regions(pixels, images.shapes(pixels), [5], 2)
    got = {(r.i, r.j): r.t for r in tv.tf_superpixel(cells, segments=6, **sp.SLIC).collect()}
    place = {(r.i, r.j): r for r in cells.groupBy("i", "j").agg({"y": "min", "x": "min"}).collect()}
    assert len(got) == len(place) == 64
    for (i, j), r in place.items():
        part = a[r["min(y)"] : r["min(y)"] + 5, r["min(x)"] : r["min(x)"] + 5]
        segment = plain_segments(part, 6, 10, 10.0, **sp.SLIC)
        v = np.var([part[segment == s].mean(axis=0) for s in np.unique(segment)], axis=0).sum()
        assert got[i, j] == pytest.approx(1.0 if v == 0 else min(1.0, 3 / v))
    found = sp.superpixel_rows(cells.where("i = 7"), segments=6, rounds=2, least=0.5).collect()
    assert len(found) == cells.where("i = 7").count() and {r.segment for r in found} <= set(range(25))
    with pytest.raises(ValueError, match="no estimator"):
        tv.traversability(pixels, images.shapes(pixels), [5], "tf_other", smooth=False)
