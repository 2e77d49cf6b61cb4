"""Registered queries of the route-planning operators, and their SQL.

Every query builds its images, labels and markers from the orders table (30 x 30 pixels an
image) and runs one operator, or a job, over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cell_id, cell_ij, gray
from ..operators import graph as G
from ..operators import grid as GR
from ..operators import keypoints as K
from ..operators import metrics as M
from ..operators import report as R
from ..operators import routes as RT
from ..operators import stencil as ST
from ..operators import traversability as T
from ..operators.superpixels import superpixel_rows
from ..shared import new_path, written
from ..sources import fixtures as FX
from ..sources import images as IM
from ..sources import results as RS
from . import sweep as SW
from .sql import SIMPLIFIED, SWEEPS, TRAVERSABILITY, sql

SIZES, CUTS = [3, 4, 6], [0.1, 0.2, 0.4]
R_SET, C_SET = list(range(6, 25, 2)), [c / 10 for c in range(1, 11)]
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None, *blocks: str):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle, *blocks)
        return f

    return add


class Images:
    """The fixture's tables for one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.pixels = FX.pixels(spark, sf_dir)
        self.labels = self.pixels.select("image", "y", "x", "lab")
        self.shapes = IM.shapes(self.pixels)
        self.keypoints = FX.keypoints(spark, sf_dir)
        self.bands = FX.bands(self.pixels)

    def sums(self, sizes, ov: int = 1) -> DataFrame:
        return T.region_sums(self.bands, sizes, ov)

    def matrix(self, sizes=(3,), ov: int = 1) -> DataFrame:
        return T.normalize_max(T.tf_gray(self.sums(sizes, ov)))

    def truth(self, sizes=(3,), ov: int = 1) -> DataFrame:
        return T.ground_truth(FX.bands(self.labels, ("lab",)), self.shapes, sizes, ov)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# sources and sinks


@query("to_pixels", "select image, y, x, r, g, b from pixels")
def to_pixels(spark, d):
    return IM.to_pixels(IM.from_pixels(FX.pixels(spark, d)))


@query("read_images", "select image, y, x, r, g, b from pixels")
def read_images(spark, d):
    folder = new_path(spark, "images")
    IM.write_images(IM.from_pixels(FX.pixels(spark, d)), folder).write.format("noop").mode("overwrite").save()
    return IM.to_pixels(IM.read_images(spark, folder)).withColumn("image", F.regexp_extract("image", r"^([0-9]+)\.bmp$", 1).cast("long"))


@query("select_images", "select distinct image from results where image in ('aerial01', 'aerial03', 'aerial08')")
def select_images(spark, d):
    wanted = spark.createDataFrame([("aerial08",), ("aerial03",), ("aerial01",), ("other",)], "image string")
    return IM.select_images(FX.results(spark, d), wanted)


_RECORDS = "image, traversability_function, region_size, cut_threshold, path_existence, matrix_build_time, graph_build_time, path_build_time, path_found, path_score, path_length"


def _records(spark, d):
    return FX.results(spark, d).select(*[c.strip() for c in _RECORDS.split(",")])


@query("read_results", f"select {_RECORDS} from results")
def read_results(spark, d):
    path = new_path(spark, "results")
    RS.write_results(_records(spark, d), path)
    return RS.read_results(spark, path, array=False).drop("path_coordinates")


@query("write_results", f"select {_RECORDS} from results")
def write_results(spark, d):
    path = new_path(spark, "results")
    RS.write_results(_records(spark, d), path, parquet=True)
    return spark.read.parquet(path).withColumn("region_size", F.col("region_size").cast("int"))


@query("append_results", "select id, image, path_score from results where id % 3 <> 2")
def append_results(spark, d):
    rows = FX.results(spark, d).select("id", "image", "path_score")
    return RS.append_results(rows.where("id % 3 = 0"), rows.where("id % 3 = 1 or id % 6 = 0"), ["id"])


_HALVES = "select id, image, path_score from results"


@query("append_results_whole", _HALVES)
def append_results_whole(spark, d):
    """Two halves that cover every record, some on both sides."""
    rows = FX.results(spark, d).select("id", "image", "path_score")
    return RS.append_results(rows.where("id % 2 = 0"), rows.where("id % 2 = 1 or id % 3 = 0"), ["id"])


@query("append_files", f"select {_RECORDS}, id from results")
def append_files(spark, d):
    """Appended to stored files, twice over."""
    path, rows = new_path(spark, "stored"), FX.results(spark, d).select(*[c.strip() for c in _RECORDS.split(",")], "id")
    RS.append_files(rows.where("id % 2 = 0"), path)
    for _ in range(2):
        RS.append_files(rows.where("id % 2 = 1 or id % 3 = 0"), path)
    return spark.read.parquet(path).withColumn("region_size", F.col("region_size").cast("int"))


# grids


@query("grid", "select image, r, i, j, k, tly, tlx from grid1")
def grid(spark, d):
    return GR.grid(Images(spark, d).shapes, SIZES).drop("ov")


@query("grid_overlap", "select image, r, i, j, k, tly, tlx from grid2")
def grid_overlap(spark, d):
    return GR.grid(Images(spark, d).shapes, SIZES, 2).drop("ov")


@query("assign_cells", "select image, r, y, x, k from cells1")
def assign_cells(spark, d):
    m = Images(spark, d)
    return GR.assign_cells(m.pixels.select("image", "y", "x"), m.shapes, SIZES).select("image", "r", "y", "x", "k")


@query("assign_cells_overlap", "select image, r, y, x, k from cells2")
def assign_cells_overlap(spark, d):
    m = Images(spark, d)
    return GR.assign_cells(m.pixels.select("image", "y", "x"), m.shapes, SIZES, 2).select("image", "r", "y", "x", "k")


@query("cell_id", "select image, r, i, j, i * cols + j as id, k // cols as i2, k % cols as j2 from grid1")
def cell_id_(spark, d):
    m = Images(spark, d)
    cells = GR.grid(m.shapes, SIZES).join(GR._geometry(m.shapes, SIZES, 1).select("image", "r", "cols"), ["image", "r"])
    i2, j2 = cell_ij(F.col("k"), F.col("cols"))
    return cells.select("image", "r", "i", "j", cell_id(F.col("i"), F.col("j"), F.col("cols")).alias("id"), i2.alias("i2"), j2.alias("j2"))


@query("gray", "select image, y, x, (3735 * r + 19235 * g + 9798 * b + 16384) // 32768 as gray, (9798 * r + 19235 * g + 3735 * b + 16384) // 32768 as gray_rgb from pixels")
def gray_(spark, d):
    c = [F.col(n) for n in "rgb"]
    return FX.pixels(spark, d).select("image", "y", "x", gray(*c).alias("gray"), gray(*c, "rgb").alias("gray_rgb"))


@query("bilateral", "select image, y, x, r, g, b from bilateral")
def bilateral(spark, d):
    m = Images(spark, d)
    return ST.bilateral(m.pixels, m.shapes)


@query("paint", "select image, r, y, x, v from (select p.image, g.r, p.y, p.x, coalesce(cast(floor(arg_max(m.t, m.k) * 255) as bigint), 1) as v from pixels p cross join sizes g left join cells2 c on c.image = p.image and c.r = g.r and c.y = p.y and c.x = p.x left join matrix2 m on m.image = c.image and m.r = c.r and m.k = c.k group by p.image, g.r, p.y, p.x)")
def paint(spark, d):
    m = Images(spark, d)
    return GR.paint(m.matrix(SIZES, 2), m.shapes, m.pixels, SIZES, 2)


_PAINTED = "select p.image, g.r, p.y, p.x, coalesce(cast(floor(arg_max(m.t, m.k) * 255) as bigint), 1) as v from pixels p cross join sizes g left join cells2 c on c.image = p.image and c.r = g.r and c.y = p.y and c.x = p.x left join matrix2 m on m.image = c.image and m.r = c.r and m.k = c.k group by p.image, g.r, p.y, p.x"


@query("paint_files", f"select image, r, y, x, v from ({_PAINTED})")
def paint_files(spark, d):
    """Painted images as files, read again."""
    m, folder = Images(spark, d), new_path(spark, "painted")
    painted = IM.from_bands(GR.paint_bands(m.matrix(SIZES, 2), m.shapes, SIZES, 2), "r")
    IM.write_images(painted, folder).write.format("noop").mode("overwrite").save()
    name = lambda n: F.regexp_extract("image", r"^(\d+)-(\d+)\.bmp$", n)
    return IM.to_pixels(IM.read_images(spark, folder)).select(name(1).cast("long").alias("image"), name(2).cast("int").alias("r"), "y", "x", F.col("b").alias("v"))


# traversability


@query("tf_gray", "select image, r, k, round(t, 6) as t from tf1")
def tf_gray(spark, d):
    m = Images(spark, d)
    return rounded(T.tf_gray(m.sums(SIZES)), "t").select("image", "r", "k", "t")


@query("tf_gray_overlap", "select image, r, k, round(t, 6) as t from tf2")
def tf_gray_overlap(spark, d):
    m = Images(spark, d)
    return rounded(T.tf_gray(m.sums(SIZES, 2)), "t").select("image", "r", "k", "t")


@query("tf_rgb", "select image, r, k, round(case when v = 0 then 1.0 else least(1.0, 3.0 / v) end, 6)::double as t from (select image, r, k, ((count(*) * sum(red * red) - sum(red) * sum(red)) + (count(*) * sum(g * g) - sum(g) * sum(g)) + (count(*) * sum(b * b) - sum(b) * sum(b)))::double / (count(*) * count(*)) as v from cells1 group by image, r, k)")
def tf_rgb(spark, d):
    m = Images(spark, d)
    return rounded(T.tf_rgb(m.sums(SIZES)), "t").select("image", "r", "k", "t")


@query("tf_label", "select image, r, k, round(t, 6) as t from label1")
def tf_label(spark, d):
    m = Images(spark, d)
    return rounded(T.tf_label(FX.bands(m.labels, ("lab",)), m.shapes, SIZES), "t").select("image", "r", "k", "t")


@query("tf_label_overlap", "select image, r, k, round(t, 6) as t from label2")
def tf_label_overlap(spark, d):
    m = Images(spark, d)
    return rounded(T.tf_label(FX.bands(m.labels, ("lab",)), m.shapes, SIZES, 2), "t").select("image", "r", "k", "t")


@query("tf_random", "select image, r, k, ('0x' || substr(md5('7|' || image || '|' || r || '|' || k), 1, 8))::bigint / 4294967296.0::double as t from grid1 where r = 3")
def tf_random(spark, d):
    m = Images(spark, d)
    return T.tf_random(T.regions(m.pixels, m.shapes, [3]), 7).select("image", "r", "k", "t")


@query("tf_superpixel")
def tf_superpixel(spark, d):
    m = Images(spark, d)
    return T.tf_superpixel(T.regions(m.pixels, m.shapes, [6])).select("image", "r", "k", "t")


_SEEN = "(select c.image, c.k, c.y, c.x, c.red, c.g, c.b, c.y - g.tly as v, c.x - g.tlx as u, c.r from cells1 c join grid1 g on g.image = c.image and g.r = c.r and g.k = c.k where c.r = 6)"


@query("superpixel_assign", f"""
select image, r, k, y, x, arg_min(s, row(d, s))::bigint as segment from (
  select p.image, p.r, p.k, p.y, p.x, (case q.v when 0 then 0 when 2 then 1 else 2 end) * 3 + (case q.u when 0 then 0 when 2 then 1 else 2 end) as s,
         (10.0::double / sqrt(4.5::double)) * (10.0::double / sqrt(4.5::double)) * ((p.v - q.v) * (p.v - q.v) + (p.u - q.u) * (p.u - q.u)) + (p.red - q.red) * (p.red - q.red) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b) as d
  from {_SEEN} p join {_SEEN} q on q.image = p.image and q.k = p.k and q.v in (0, 2, 5) and q.u in (0, 2, 5)
  where abs(p.v - q.v) <= 2 * sqrt(4.5::double) and abs(p.u - q.u) <= 2 * sqrt(4.5::double))
group by image, r, k, y, x""")
def superpixel_assign(spark, d):
    """One round of assignment to those of nine seeds a region that are in reach."""
    m = Images(spark, d)
    return superpixel_rows(T.regions(m.pixels, m.shapes, [6]), segments=8, rounds=1, window=2.0)


@query("estimate", "select image, r, k, (max(g) - min(g)) / 255.0::double as t from cells1 where r = 6 group by image, r, k")
def estimate(spark, d):
    m = Images(spark, d)
    cells = T.regions(m.pixels, m.shapes, [6])
    return T.estimate(cells, lambda r, g, b: float(g.max() - g.min()) / 255.0).select("image", "r", "k", "t")


@query("normalize_max", "select image, r, k, round(t, 6) as t from matrix1")
def normalize_max(spark, d):
    return rounded(Images(spark, d).matrix(SIZES), "t").select("image", "r", "k", "t")


@query("binarize", "select image, r, k, case when t > 0.25 then 1.0::double else 0.0::double end as t from matrix1")
def binarize(spark, d):
    return Images(spark, d).matrix(SIZES).select("image", "r", "k", T.binarize(F.col("t"), 0.25).alias("t"))


@query("clahe", "select image, r, k, t from clahe1")
def clahe(spark, d):
    return T.clahe(Images(spark, d).matrix(SIZES), scale="u8").select("image", "r", "k", "t")


@query("traversability", *TRAVERSABILITY)
def traversability(spark, d):
    m = Images(spark, d)
    return rounded(T.traversability(m.pixels, m.shapes, SIZES), "t").select("image", "r", "k", "t")


@query("resize_bilinear", "select image, r, i, j, round(t, 6) as t from resized where r in (4, 6)")
def resize_bilinear(spark, d):
    m = Images(spark, d)
    target = GR._geometry(m.shapes, [3], 1).select("image", "rows", "cols")
    return rounded(T.resize_bilinear(m.matrix([4, 6]), target), "t")


@query("traversability_multiscale", "select image, i, j, round(t, 6) as t from multiscale")
def traversability_multiscale(spark, d):
    m = Images(spark, d)
    return rounded(T.traversability_multiscale(m.pixels, m.shapes, 6, smooth=False, scales=SIZES, normalize=False), "t").select("image", "i", "j", "t")


@query("ground_truth", "select image, r, k, round(t, 6) as t from truth1")
def ground_truth(spark, d):
    return rounded(Images(spark, d).truth(SIZES), "t").select("image", "r", "k", "t")


@query("matrix_histogram", "select image, r, least(floor(t * 10), 9)::int as bin, count(*) / sum(count(*)) over (partition by image, r)::double as frequency from matrix1 group by image, r, least(floor(t * 10), 9)::int")
def matrix_histogram(spark, d):
    return T.matrix_histogram(Images(spark, d).matrix(SIZES))


# graphs and keypoints


@query("graph_nodes", "select image, r, c, k, round(case when t = 0 then 'inf'::double else (100.0 / t) * (100.0 / t) end, 4) as inv, t < c as cut from matrix1 cross join cuts where r = 3")
def graph_nodes(spark, d):
    return rounded(G.graph_nodes(Images(spark, d).matrix(), CUTS), "inv", places=4).select("image", "r", "c", "k", "inv", "cut")


@query("graph_edges", "select image, r, c, src, dst, round(w, 4) as w from edges")
def graph_edges(spark, d):
    return rounded(G.graph_edges(Images(spark, d).matrix(), CUTS), "w", places=4)


@query("graph_edges_reach2", "select a.image, a.r, 0.2::double as c, a.k as src, b.k as dst, round((100.0 / a.t) * (100.0 / a.t) + (100.0 / b.t) * (100.0 / b.t), 4) as w from matrix2 a join matrix2 b on a.image = b.image and a.r = b.r and a.r = 3 and a.k <> b.k and a.t >= 0.2 and b.t >= 0.2 and ((abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1) or (abs(a.i - b.i) in (0, 2) and abs(a.j - b.j) in (0, 2)))")
def graph_edges_reach2(spark, d):
    return rounded(G.graph_edges(Images(spark, d).matrix([3], 2), [0.2], 2), "w", places=4)


@query("find_blobs", "select image, kind, ord, y, x from keypoints")
def find_blobs(spark, d):
    return K.find_blobs(FX.markers(spark, d))


@query("keypoint_cells", "select image, kind, r, ord, k from kcells")
def keypoint_cells(spark, d):
    m = Images(spark, d)
    return K.keypoint_cells(m.keypoints, m.shapes, SIZES)


@query("keypoint_cells_overlap", "select image, kind, r, cast(row_number() over (partition by image, kind, r order by p, k) - 1 as int) as ord, k from (select p.image, p.kind, g.r, p.ord as p, g.k from keypoints p join grid2 g on g.image = p.image and p.y >= g.tly and p.y < g.tly + g.r / 2.0::double and p.x >= g.tlx and p.x < g.tlx + g.r / 2.0::double)")
def keypoint_cells_overlap(spark, d):
    m = Images(spark, d)
    return K.keypoint_cells(m.keypoints, m.shapes, SIZES, 2)


@query("keypoint_pairs", "select a.image, a.kind, a.r, a.ord as o1, b.ord as o2, a.k as s, b.k as t from kcells a join kcells b on a.image = b.image and a.kind = b.kind and a.r = b.r and a.ord < b.ord")
def keypoint_pairs(spark, d):
    m = Images(spark, d)
    return K.keypoint_pairs(K.keypoint_cells(m.keypoints, m.shapes, SIZES)).select("image", "kind", "r", "o1", "o2", "s", "t")


@query("sample_pair", "select image, kind, ord, y, x, pick from (select *, row_number() over (partition by image order by md5('7|' || image || '|' || kind || '|' || ord), kind, ord)::int as pick from keypoints) where pick <= 2")
def sample_pair(spark, d):
    return K.sample_pair(Images(spark, d).keypoints, 7)


# routes


def _searched(spark, d):
    m = Images(spark, d)
    matrix = written(m.matrix(), "matrix")
    return m, *SW.search(matrix, K.keypoint_cells(m.keypoints, m.shapes, [3]), CUTS)


@query("shortest_tree", "select image, r, c, s, k, round(dist, 4) as dist from tree")
def shortest_tree(spark, d):
    return rounded(_searched(spark, d)[3], "dist", places=4)


@query("routes", "select image, kind, c, s, t, dist is not null as found, round(dist, 4) as dist from pairs")
def routes(spark, d):
    return rounded(_searched(spark, d)[1], "dist", places=4).select("image", "kind", "c", "s", "t", "found", "dist")


@query("trace_paths", "select image, c, s, t, seq, k from traced")
def trace_paths(spark, d):
    _, pairs, edges, tree = _searched(spark, d)
    return RT.trace_paths(pairs, RT.predecessors(edges, tree)).select("image", "c", "s", "t", "seq", "k")


@query("predecessors", "select image, c, s, k, pred from preds")
def predecessors(spark, d):
    _, _, edges, tree = _searched(spark, d)
    return RT.predecessors(edges, tree).select("image", "c", "s", "k", "pred")


@query("path_centers", "select image, c, s, t, seq, k, row, col from centers")
def path_centers(spark, d):
    m, pairs, edges, tree = _searched(spark, d)
    paths = RT.trace_paths(pairs, RT.predecessors(edges, tree))
    return RT.path_centers(paths, GR.grid(m.shapes, [3])).select("image", "c", "s", "t", "seq", "k", "row", "col")


@query("unfound_paths", "select image, c, s, t, 0 as seq, s as k from pairs where dist is null union all select image, c, s, t, 1, t from pairs where dist is null")
def unfound_paths(spark, d):
    return RT.unfound_paths(_searched(spark, d)[1]).select("image", "c", "s", "t", "seq", "k")


def _straight(spark, d):
    """Polylines with known corners, from the keypoints: every image's four marks in order."""
    p = Images(spark, d).keypoints
    return p.select("image", F.lit(3).alias("r"), F.lit(0.1).alias("c"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("t"), F.col("ord").alias("seq"), (F.col("y") + F.col("image") % 5).alias("row"), F.col("x").alias("col"))


@query("simplify_paths", *SIMPLIFIED)
def simplify_paths(spark, d):
    m, pairs, edges, tree = _searched(spark, d)
    return RT.simplify_paths(RT.path_centers(RT.trace_paths(pairs, RT.predecessors(edges, tree)), GR.grid(m.shapes, [3])))


@query("resample_paths", "select image, seq, row, col from resampled")
def resample_paths(spark, d):
    return RT.resample_paths(_straight(spark, d).withColumn("n", F.lit(13).cast("long"))).select("image", "seq", "row", "col")


@query("smooth_paths", "select image, seq, coalesce(round_even((-3 * lag(row, 2) over w + 12 * lag(row, 1) over w + 17 * row + 12 * lead(row, 1) over w - 3 * lead(row, 2) over w) / 35.0::double, 0)::bigint, row) as row, coalesce(round_even((-3 * lag(col, 2) over w + 12 * lag(col, 1) over w + 17 * col + 12 * lead(col, 1) over w - 3 * lead(col, 2) over w) / 35.0::double, 0)::bigint, col) as col from resampled window w as (partition by image order by seq)")
def smooth_paths(spark, d):
    return RT.smooth_paths(RT.resample_paths(_straight(spark, d).withColumn("n", F.lit(13).cast("long")))).select("image", "seq", "row", "col")


@query("pack_paths", "select image, count(*)::int as path_length, string_agg('[' || row || ', ' || col || ']', ', ' order by seq) as path from resampled group by image")
def pack_paths(spark, d):
    packed = RT.pack_paths(RT.resample_paths(_straight(spark, d).withColumn("n", F.lit(13).cast("long"))))
    return packed.select("image", "path_length", F.array_join(F.transform("path_coordinates", lambda p: F.concat(F.lit("["), F.array_join(p.cast("array<string>"), ", "), F.lit("]"))), ", ").alias("path"))


# scores and errors


@query("patch_values", "select image, row, col, round(t, 6) as t from patches")
def patch_values(spark, d):
    m = Images(spark, d)
    return rounded(M.patch_values(_cell_points(m), m.labels, m.shapes), "t").select("image", "row", "col", "t")


def _cell_points(m: Images) -> DataFrame:
    """A path along the first column of 6-cells of each image."""
    cells = GR.grid(m.shapes, [6]).where("j = 1")
    return cells.select("image", "r", F.lit(0.1).alias("c"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("t"), F.col("i").cast("int").alias("seq"), (F.col("tly") + 3).alias("row"), (F.col("tlx") + 3).alias("col"))


@query("score_paths", "select c.image, round(greatest(0.0::double, 1 - 0.03::double * coalesce(sum(case when c.i > 0 and c.i < c.rows - 1 and p.t < 0.5 then 1 - p.t end), 0)), 6) as score from grid1 c left join patches p on p.image = c.image and p.row = c.tly + 3 and p.col = c.tlx + 3 where c.r = 6 and c.j = 1 group by c.image")
def score_paths(spark, d):
    m = Images(spark, d)
    return rounded(M.score_paths(_cell_points(m), m.labels, m.shapes), "score").select("image", "score")


@query("outcome_score", "select id, path_score from results")
def outcome(spark, d):
    return FX.results(spark, d).select("id", SW.outcome_score(F.col("path_existence"), F.col("path_found"), F.col("raw_score")).alias("path_score"))


_ERRORS = {
    "corr": "corr(a, b)", "jaccard": "sum(least(a, b)) / nullif(sum(greatest(a, b)), 0)", "rmse": "sqrt(avg((a - b) * (a - b)))",
    "nrmse": "sqrt(avg((a - b) * (a - b))) / nullif(avg(b), 0)", "psnr": "10 * log10(1.0 / nullif(avg((a - b) * (a - b)), 0))", "nmae": "avg(abs(a - b)) / 255",
}
for _name, _sql in _ERRORS.items():
    query(f"err_{_name}", f"select image, r, round({_sql}, 6) as value from compared group by image, r")(
        lambda spark, d, n=_name: rounded(M.error(M.compare((m := Images(spark, d)).matrix(SIZES), m.truth(SIZES)), n), "value")
    )


@query("err_ssim", "select image, r, round(avg(((2 * ma * mb + 0.0001) * (2 * cov + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))), 6)::double as value from ssim group by image, r")
def err_ssim(spark, d):
    m = Images(spark, d)
    return rounded(M.error(M.compare(m.matrix([3]), m.truth([3])), "ssim"), "value")


@query("err_mse_resized", "select m.image, m.r, round(avg((m.t - l.t / 255) * (m.t - l.t / 255)), 6)::double as value from matrix1 m join label_resized l on l.image = m.image and l.i = m.i and l.j = m.j where m.r = 3 group by m.image, m.r")
def err_mse_resized(spark, d):
    m = Images(spark, d)
    target = GR._geometry(m.shapes, [3], 1).select("image", "rows", "cols")
    labels = m.labels.select("image", F.lit(3).alias("r"), F.col("y").alias("i"), F.col("x").alias("j"), F.col("lab").cast("double").alias("t"))
    return rounded(M.mse_resized(m.matrix([3]), T.resize_bilinear(labels, target)), "value")


@query("accuracy_sweep", "select r, round(avg(v), 6) as value, count(v) as n from (select image, r, sqrt(avg((a - b) * (a - b))) as v from compared group by image, r) group by r")
def accuracy_sweep(spark, d):
    m = Images(spark, d)
    return rounded(R.accuracy_sweep(M.error(M.compare(m.matrix(SIZES), m.truth(SIZES)), "rmse")), "value")


def _measure_sql(f: str, pairs: str) -> str:
    plain = ", ".join(f"{e} as {m}" for m, e in _ERRORS.items())
    return f"select '{f}' as f, measure, r, round(avg(value), 6)::double as value, count(value) as n from (unpivot (select image, r, {plain} from {pairs} group by image, r) on {', '.join(_ERRORS)} into name measure value value) group by measure, r"


_RGB = "(select m.image, m.r, m.i, m.j, m.t / max(m.t) over (partition by m.image, m.r) as t, m.k from (select image, r, i, j, k, case when v = 0 then 1.0::double else least(1.0::double, 3.0::double / v) end as t from (select image, r, i, j, k, ((count(*) * sum(red * red) - sum(red) * sum(red)) + (count(*) * sum(g * g) - sum(g) * sum(g)) + (count(*) * sum(b * b) - sum(b) * sum(b)))::double / (count(*) * count(*)) as v from cells1 group by image, r, i, j, k)) m)"
_RGB_PAIRS = f"(select m.image, m.r, m.t as a, l.t as b from {_RGB} m join truth1 l on l.image = m.image and l.r = m.r and l.k = m.k)"


@query("accuracy_table", _measure_sql("tf_grayhist", "compared") + "\nunion all " + _measure_sql("tf_rgbhist", _RGB_PAIRS))
def accuracy_table(spark, d):
    m = Images(spark, d)
    sums = written(m.sums(SIZES), "sums")
    matrices = {"tf_grayhist": T.normalize_max(T.tf_gray(sums)), "tf_rgbhist": T.normalize_max(T.tf_rgb(sums))}
    return rounded(R.accuracy_table(matrices, m.truth(SIZES), list(_ERRORS)), "value")


@query("accuracy_ssim", "select 'tf_grayhist' as f, 'ssim' as measure, 3 as r, round(avg(v), 6)::double as value, count(v) as n from (select image, avg(((2 * ma * mb + 0.0001) * (2 * cov + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))) as v from ssim group by image)")
def accuracy_ssim(spark, d):
    m = Images(spark, d)
    return rounded(R.accuracy_table({"tf_grayhist": m.matrix([3])}, m.truth([3]), ["ssim"]), "value")


# results


@query("filter_results", "select id from results where image in ('aerial01', 'aerial02') and traversability_function = 'tf_grayhist' and region_size in (8, 10) and cut_threshold in (0.4, 0.5)")
def filter_results(spark, d):
    return R.filter_results(FX.results(spark, d), ["aerial01", "aerial02"], ["tf_grayhist"], [8, 10], [0.4, 0.5]).select("id")


_BY = ["region_size", "cut_threshold"]
_CONF = "count(*) filter (path_existence and path_found) as tp, count(*) filter (not path_existence and not path_found) as tn, count(*) filter (not path_existence and path_found) as fp, count(*) filter (path_existence and not path_found) as fn"


@query("confusion", f"select region_size, cut_threshold, {_CONF} from results group by all")
def confusion(spark, d):
    return R.confusion(FX.results(spark, d), _BY)


@query("detection_rates", f"select region_size, cut_threshold, round((tp + tn) / (tp + tn + fp + fn)::double, 6) as accuracy, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(tp / nullif(tp + fn, 0)::double, 6) as frdr, round(tn / nullif(tn + fp, 0)::double, 6) as irdr, round((tp + tn) / (tp + tn + fp + fn)::double, 6) as fdr from (select region_size, cut_threshold, {_CONF} from results group by all)")
def detection_rates(spark, d):
    return rounded(R.detection_rates(FX.results(spark, d), _BY), "accuracy", "precision", "recall", "frdr", "irdr", "fdr")


_TERMS = {"matrix": "matrix_build_time", "graph": "graph_build_time", "mapping": "matrix_build_time + graph_build_time", "route": "path_build_time", "total": "matrix_build_time + graph_build_time + path_build_time"}


@query("time_summary", "select region_size, cut_threshold, " + ", ".join(f"round(avg({e}), 6) as {n}_mean, round(stddev_pop({e}), 6) as {n}_std" for n, e in _TERMS.items()) + " from results group by region_size, cut_threshold")
def time_summary(spark, d):
    return rounded(R.time_summary(FX.results(spark, d), _BY), *[f"{n}_{x}" for n in _TERMS for x in ("mean", "std")])


@query("good_path_length", "select region_size, round_even(avg(case when path_existence and path_found and path_score > 0.7 then path_length end), 0)::bigint as length from results group by region_size")
def good_path_length(spark, d):
    return R.good_path_length(FX.results(spark, d), ["region_size"])


@query("quality_summary", "select region_size, cut_threshold, round(avg(path_score), 6) as score_mean, round(stddev_pop(path_score), 6) as score_std from results group by region_size, cut_threshold")
def quality_summary(spark, d):
    return rounded(R.quality_summary(FX.results(spark, d), _BY), "score_mean", "score_std")


_HEAT = {
    "quality": ("sum(path_score) filter (path_found)", "count(*) filter (path_found)", "-1.0"),
    "feasible": ("count(*) filter (path_existence and path_found)", "count(*) filter (path_existence)", "0.0"),
    "infeasible": ("count(*) filter (not path_existence and not path_found)", "count(*) filter (not path_existence)", "0.0"),
    "feasibility": ("count(*) filter (path_existence = path_found)", "count(*)", "0.0"),
}
for _name, (_hits, _n, _none) in _HEAT.items():
    query(f"heatmap_{_name}", f"select s.region_size, s.cut_threshold, round(case when coalesce(g.n, 0) = 0 then {_none} else coalesce(g.hits, 0) / (g.n + 1)::double end, 6)::double as value from (select unnest(range(6, 25, 2))::int as region_size, c / 10.0::double as cut_threshold from range(1, 11) t(c)) s left join (select region_size, cut_threshold, {_hits} as hits, {_n} as n from results group by all) g using (region_size, cut_threshold)")(
        lambda spark, d, n=_name: rounded(R.heatmap(FX.results(spark, d), n, R_SET, C_SET), "value")
    )


@query("heatmap_pivot", "select region_size, " + ", ".join(f"round(coalesce(sum(path_score) filter (path_found and cut_threshold = {c}) / (1 + count(*) filter (path_found and cut_threshold = {c}))::double, -1), 6)::double as \"c{n}\"" for n, c in enumerate(C_SET, 1)) + " from results group by region_size")
def heatmap_pivot(spark, d):
    wide = R.pivoted(R.heatmap(FX.results(spark, d), "quality", R_SET, C_SET), C_SET)
    return wide.select("region_size", *[F.round(F.col(f"`{c}`"), 6).alias(f"c{n}") for n, c in enumerate(C_SET, 1)])


_LONG = "(select region_size, cut_threshold, unnest(['matrix_build_time', 'graph_build_time', 'path_build_time', 'total_time']) as variable, unnest([matrix_build_time, graph_build_time, path_build_time, matrix_build_time + graph_build_time + path_build_time]) as v from results)"


@query("time_series", f"select variable, cut_threshold, region_size, round(avg(v), 6) as mean from {_LONG} group by all")
def time_series(spark, d):
    return rounded(R.time_series(FX.results(spark, d)), "mean")


@query("time_spread", f"select variable, cut_threshold, region_size, round(avg(m), 6) as mean, round(avg(v) filter (v >= m) - avg(m), 6) as up, round(avg(m) - avg(v) filter (v < m), 6) as down from (select *, avg(v) over (partition by variable, cut_threshold, region_size) as m from {_LONG}) group by variable, cut_threshold, region_size")
def time_spread(spark, d):
    return rounded(R.time_spread(FX.results(spark, d)), "mean", "up", "down")


@query("time_series_combined", f"select * from (select variable, cut_threshold, region_size, round(avg(v), 6) as mean, 'all' as label from {_LONG} group by all union all select variable, cut_threshold, region_size, round(avg(v), 6), 'small' from (select * from {_LONG} where region_size <= 12) group by all)")
def time_series_combined(spark, d):
    rows = FX.results(spark, d)
    return rounded(R.time_series_combined(rows, rows.where("region_size <= 12"), ("all", "small")), "mean")


@query("average_time", "select round(avg(matrix_build_time), 6) as matrix_build_time, round(avg(graph_build_time), 6) as graph_build_time, round(avg(path_build_time), 6) as path_build_time, count(*) as n from results where region_size = 8 and cut_threshold = 0.4")
def average_time(spark, d):
    return rounded(R.average_time(FX.results(spark, d), "tf_grayhist", 8, 0.4), *R.TIMES)


# whole jobs


def _sweep(spark, d, functions, sizes, cuts, **options):
    m = Images(spark, d)
    return rounded(SW.run_sweep(m.pixels, m.labels, m.keypoints, functions, sizes, cuts, **options), "path_score", "dist").drop("path_coordinates", *SW.TIMES)


@query("run_sweep", *SWEEPS["run_sweep"])
def run_sweep(spark, d):
    return _sweep(spark, d, ["tf_grayhist", "reference"], [3, 6], [0.2, 0.4])


@query("run_sweep_overlap", *SWEEPS["run_sweep_overlap"])
def run_sweep_overlap(spark, d):
    return _sweep(spark, d, ["tf_grayhist"], [6], [0.2], ov=2)


@query("run_sweep_multiscale", *SWEEPS["run_sweep_multiscale"])
def run_sweep_multiscale(spark, d):
    return _sweep(spark, d, ["tf_rgbhist"], [3, 6], [0.2], multiscale=True)


@query("run_sweep_overlap_multiscale", *SWEEPS["run_sweep_overlap_multiscale"])
def run_sweep_overlap_multiscale(spark, d):
    return _sweep(spark, d, ["tf_grayhist"], [3, 6], [0.2], ov=2, multiscale=True)


@query("route_all", *SWEEPS["route_all"])
def route_all(spark, d):
    m = Images(spark, d)
    return rounded(SW.route_all(m.pixels, m.keypoints, "tf_grayhist", 3, 0.2), "dist").drop("path_coordinates", *SW.TIMES)
