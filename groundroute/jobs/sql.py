"""DuckDB SQL of what the registered queries compute, from the orders table on."""

from __future__ import annotations

from ..sources.fixtures import KEYPOINTS_SQL, PIXELS_SQL, RESULTS_SQL


def _grid(ov: int) -> str:
    return f"""
geo{ov} as (select image, r, {ov} as ov, h, w, (h // r) * {ov} as rows, (w // r) * {ov} as cols, (h % r) // 2 as ey, (w % r) // 2 as ex from shapes cross join sizes),
grid{ov} as (select *, i * cols + j as k, (ey + i * r) // ov as tly, (ex + j * r) // ov as tlx
             from (select *, unnest(range(cols)) as j from (select *, unnest(range(rows)) as i from geo{ov}))),
cells{ov} as (select g.image, g.r, g.i, g.j, g.k, g.tly, g.tlx, g.h, g.w, p.y, p.x, p.r as red, p.g, p.b, p.lab, (3735 * p.r + 19235 * p.g + 9798 * p.b + 16384) // 32768 as gray
              from grid{ov} g join pixels p on p.image = g.image and p.y >= g.tly and p.y < g.tly + g.r and p.x >= g.tlx and p.x < g.tlx + g.r),
tf{ov} as (select image, r, i, j, k, case when s = 0 then 1.0::double else least(1.0::double, 1.0::double / s) end as t
           from (select image, r, i, j, k, sqrt((count(*) * sum(gray * gray) - sum(gray) * sum(gray))::double) / count(*) as s from cells{ov} group by image, r, i, j, k)),
matrix{ov} as (select image, r, i, j, k, t / max(t) over (partition by image, r) as t from tf{ov}),
lab{ov} as (select *, (nh // 2) as q from (select *, least(tly + r, h) - tly as nh, least(tlx + r, w) - tlx as nw from cells{ov})),
sub{ov} as (select image, r, i, j, k, lab, (y - tly - (nh % q) // 2) as dy, (x - tlx - (nw % q) // 2) as dx, q, nh // q as cy, nw // q as cx from lab{ov} where q > 0),
label{ov} as (select g.image, g.r, g.i, g.j, g.k, l.t from grid{ov} g left join (
                select image, r, k, min(m) as t from (
                  select image, r, k, avg(lab) as m from sub{ov} where dy >= 0 and dx >= 0 and dy < q * cy and dx < q * cx group by image, r, k, dy // q, dx // q) group by image, r, k) l
              on l.image = g.image and l.r = g.r and l.k = g.k),
truth{ov} as (select image, r, i, j, k, t / nullif(max(t) over (partition by image, r), 0) as t from label{ov})"""


_RESIZE = """
{name}_taps as (
  select s.image, s.r, i, j, y0.idx as si, x0.idx as sj, y0.weight * x0.weight as weight
  from (select image, r, max(i) + 1 as sr, max(j) + 1 as sc from {source} group by image, r) s,
       (select unnest(range(10)) as i) ti, (select unnest(range(10)) as j) tj,
       lateral (select greatest(0, least(floor((i + 0.5::double) * (sr::double / 10) - 0.5::double)::bigint + o, sr - 1)) as idx, case when o = 0 then 1 - f else f end as weight
                from (select (i + 0.5::double) * (sr::double / 10) - 0.5::double - floor((i + 0.5::double) * (sr::double / 10) - 0.5::double) as f), (select unnest([0, 1]) as o)) y0,
       lateral (select greatest(0, least(floor((j + 0.5::double) * (sc::double / 10) - 0.5::double)::bigint + o, sc - 1)) as idx, case when o = 0 then 1 - f else f end as weight
                from (select (j + 0.5::double) * (sc::double / 10) - 0.5::double - floor((j + 0.5::double) * (sc::double / 10) - 0.5::double) as f), (select unnest([0, 1]) as o)) x0),
{name} as (select a.image, a.r, a.i, a.j, sum(a.weight * m.t) as t from {name}_taps a join {source} m on m.image = a.image and m.r = a.r and m.i = a.si and m.j = a.sj group by a.image, a.r, a.i, a.j)"""

_CLAHE = """
ch_size as (select image, r, rows, cols, pr, pc, (rows + pr) // 3 as th, (cols + pc) // 3 as tw from (
  select *, case when rows % 3 = 0 and cols % 3 = 0 then 0 else 3 - rows % 3 end as pr, case when rows % 3 = 0 and cols % 3 = 0 then 0 else 3 - cols % 3 end as pc
  from (select image, r, max(i) + 1 as rows, max(j) + 1 as cols from matrix1 group by image, r))),
ch_v as (select m.image, m.r, m.i, m.j, m.k, floor(m.t * 255)::bigint as v from matrix1 m),
ch_rows as (select *, unnest(range(rows + pr)) as pi from ch_size),
ch_grid as (select *, unnest(range(cols + pc)) as pj from ch_rows),
ch_pad as (select g.image, g.r, g.pi // g.th as ty, g.pj // g.tw as tx, g.th * g.tw as area, c.v from ch_grid g
           join ch_v c on c.image = g.image and c.r = g.r and c.i = case when g.pi < g.rows then g.pi else 2 * g.rows - 2 - g.pi end and c.j = case when g.pj < g.cols then g.pj else 2 * g.cols - 2 - g.pj end),
ch_hist as (select t.image, t.r, t.ty, t.tx, t.area, s.v, (select count(*) from ch_pad p where p.image = t.image and p.r = t.r and p.ty = t.ty and p.tx = t.tx and p.v = s.v) as n
            from (select distinct image, r, ty, tx, area from ch_pad) t, (select unnest(range(256)) as v) s),
ch_clip as (select *, greatest(1, floor(3.0::double * area / 256)::bigint) as lim from ch_hist),
ch_over as (select *, sum(greatest(n - lim, 0)) over (partition by image, r, ty, tx) as over_ from ch_clip),
ch_even as (select *, least(n, lim) + over_ // 256 + case when over_ % 256 > 0 and v % greatest(256 // nullif(over_ % 256, 0), 1) = 0 and v // greatest(256 // nullif(over_ % 256, 0), 1) < over_ % 256 then 1 else 0 end as n2 from ch_over),
ch_lut as (select image, r, ty, tx, v, least(255, round_even(sum(n2) over (partition by image, r, ty, tx order by v) * (255.0::double / area), 0)) as out_ from ch_even),
clahe1 as (
  select image, r, i, j, k, round_even(round(sum(weight * out_), 6), 0) as t from (
    select c.image, c.r, c.i, c.j, c.k, l.out_, case when oy = 0 then 1 - fy else fy end * case when ox = 0 then 1 - fx else fx end as weight
    from (select c.*, s.th, s.tw, c.i / s.th::double - 0.5 - floor(c.i / s.th::double - 0.5) as fy, c.j / s.tw::double - 0.5 - floor(c.j / s.tw::double - 0.5) as fx,
                 floor(c.i / s.th::double - 0.5)::bigint as y1, floor(c.j / s.tw::double - 0.5)::bigint as x1 from ch_v c join ch_size s on s.image = c.image and s.r = c.r) c,
         (select unnest([0, 1]) as oy) a, (select unnest([0, 1]) as ox) b, ch_lut l
    where l.image = c.image and l.r = c.r and l.v = c.v and l.ty = greatest(0, least(c.y1 + oy, 2)) and l.tx = greatest(0, least(c.x1 + ox, 2)))
  group by image, r, i, j, k)"""

_BILATERAL = """
taps as (select dy, dx, dy * dy + dx * dx as d2 from (select unnest(range(-7, 8)) as dy), (select unnest(range(-7, 8)) as dx) where dy * dy + dx * dx <= 49),
mirror as (select v, case when v < 0 then -v when v > 29 then 58 - v else v end as src from (select unnest(range(-7, 37)) as v)),
wide as materialized (select p.image, a.v as y, b.v as x, p.r, p.g, p.b from pixels p join mirror a on a.src = p.y join mirror b on b.src = p.x),
asked as materialized (select p.image, p.y, p.x, p.r, p.g, p.b, p.y + t.dy as ny, p.x + t.dx as nx, t.d2 from pixels p cross join taps t),
bilateral as (
  select image, y, x, round_even(sum(k * r2) / sum(k), 0)::bigint as r, round_even(sum(k * g2) / sum(k), 0)::bigint as g, round_even(sum(k * b2) / sum(k), 0)::bigint as b
  from (select p.image, p.y, p.x, q.r as r2, q.g as g2, q.b as b2,
               exp(-p.d2 / 11250.0::double) * exp(-((abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) * (abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b))) / 11250.0::double) as k
        from asked p join wide q on q.image = p.image and q.y = p.ny and q.x = p.nx)
  group by image, y, x)"""

_GRAPH = """
m3 as (select * from matrix1 where r = 3),
edges as (select a.image, a.r, c.c, a.k as src, b.k as dst, (100.0 / a.t) * (100.0 / a.t) + (100.0 / b.t) * (100.0 / b.t) as w
          from m3 a join m3 b on a.image = b.image and a.k <> b.k and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 cross join cuts c where a.t >= c.c and b.t >= c.c),
kcells as (select p.image, p.kind, g.r, cast(row_number() over (partition by p.image, p.kind, g.r order by p.ord, g.k) - 1 as int) as ord, g.k
           from keypoints p join grid1 g on g.image = p.image and p.y >= g.tly and p.y < g.tly + g.r and p.x >= g.tlx and p.x < g.tlx + g.r),
kpairs as (select a.image, a.kind, a.r, a.k as s, b.k as t from kcells a join kcells b on a.image = b.image and a.kind = b.kind and a.r = b.r and a.ord < b.ord where a.r = 3),
dists(image, r, c, s, k, dist) using key (image, r, c, s, k) as (
  select distinct p.image, p.r, c.c, p.s, p.s as k, 0.0::double as dist from kpairs p cross join cuts c
  union
  select d.image, d.r, d.c, d.s, e.dst, min(d.dist + e.w) from dists d join edges e on e.image = d.image and e.r = d.r and e.c = d.c and e.src = d.k
  left join recurring.dists o on o.image = d.image and o.r = d.r and o.c = d.c and o.s = d.s and o.k = e.dst
  where o.dist is null or d.dist + e.w < o.dist group by d.image, d.r, d.c, d.s, e.dst),
tree as (select * from dists),
pairs as (select p.image, p.kind, p.r, c.c, p.s, p.t, case when m.t >= c.c then d.dist end as dist from kpairs p cross join cuts c
          join m3 m on m.image = p.image and m.k = p.s left join tree d on d.image = p.image and d.c = c.c and d.s = p.s and d.k = p.t),
preds as (select t.image, t.c, t.s, t.k, min(e.src) as pred from tree t join edges e on e.image = t.image and e.c = t.c and e.dst = t.k
          join tree b on b.image = t.image and b.c = t.c and b.s = t.s and b.k = e.src and b.dist + e.w = t.dist where t.k <> t.s group by t.image, t.c, t.s, t.k),
walk(image, c, s, t, n, k) as (
  select distinct image, c, s, t, 0, t from pairs where dist is not null
  union all
  select w.image, w.c, w.s, w.t, w.n + 1, p.pred from walk w join preds p on p.image = w.image and p.c = w.c and p.s = w.s and p.k = w.k),
traced as (select image, c, s, t, (max(n) over (partition by image, c, s, t) - n)::int as seq, k from walk),
centers as (select a.*, g.tly + 1 as row, g.tlx + 1 as col from traced a join grid1 g on g.image = a.image and g.r = 3 and g.k = a.k)"""

_PATHS = """
line as (select image, ord as seq, y + image % 5 as row, x as col from keypoints),
lined as (select *, sum(step) over (partition by image order by seq) as pos from (
  select *, coalesce(sqrt(((row - lag(row) over w) * (row - lag(row) over w) + (col - lag(col) over w) * (col - lag(col) over w))::double), 0) as step from line window w as (partition by image order by seq))),
seg as (select *, pos / max(pos) over (partition by image) as d0, lead(pos) over w / max(pos) over (partition by image) as d1, lead(row) over w as row1, lead(col) over w as col1
        from lined window w as (partition by image order by seq)),
resampled as (
  select image, q::int as seq, round_even(round(row + f * (row1 - row), 9), 0)::bigint as row, round_even(round(col + f * (col1 - col), 9), 0)::bigint as col
  from (select s.*, q, (q / 12.0::double - d0) / (d1 - d0) as f, row_number() over (partition by s.image, q order by s.seq desc) as pick
        from seg s join (select unnest(range(13)) as q) on q / 12.0::double >= d0 - 1e-10 and q / 12.0::double <= d1 + 1e-10 where d1 > d0) where pick = 1)"""

_PATCH = """
pts as (select distinct image, r, tly + 3 as row, tlx + 3 as col from grid1 where r = 6 and j = 1),
patch as (select t.image, t.row, t.col, p.y, p.x, p.lab from pts t join pixels p on p.image = t.image and p.y >= greatest(0, t.row - 3) and p.y < least(29, t.row + 3) and p.x >= greatest(0, t.col - 3) and p.x < least(29, t.col + 3)),
patches as (select image, row, col, avg(v) / 255 as t from (
  select a.image, a.row, a.col, a.y, a.x, min(b.lab) as v from patch a join patch b on b.image = a.image and b.row = a.row and b.col = a.col and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1
  group by a.image, a.row, a.col, a.y, a.x) group by image, row, col)"""

_COMPARE = """
compared as (select m.image, m.r, m.i, m.j, m.t as a, l.t as b from matrix1 m join truth1 l on l.image = m.image and l.r = m.r and l.k = m.k),
ssim as (select image, r, ma, mb, 49 / 48.0::double * (saa / 49 - ma * ma) as va, 49 / 48.0::double * (sbb / 49 - mb * mb) as vb, 49 / 48.0::double * (sab / 49 - ma * mb) as cov from (
  select c.image, c.r, c.i, c.j, sum(n.a) / 49 as ma, sum(n.b) / 49 as mb, sum(n.a * n.a) as saa, sum(n.b * n.b) as sbb, sum(n.a * n.b) as sab
  from compared c join compared n on n.image = c.image and n.r = c.r and abs(n.i - c.i) <= 3 and abs(n.j - c.j) <= 3 where c.r = 3 and c.i between 3 and 6 and c.j between 3 and 6 group by c.image, c.r, c.i, c.j)),
label_image as (select image, 3 as r, y as i, x as j, lab::double as t from pixels)"""

_MULTI = """
multi as (select image, i, j, round(sum(t), 12) as t from (
  select image, i, j, t from matrix1 where r = 6
  union all select a.image, a.i, a.j, a.r * sum(a.weight * m.t) from mtaps a join matrix1 m on m.image = a.image and m.r = a.r and m.i = a.si and m.j = a.sj where a.r < 6 group by a.image, a.r, a.i, a.j) group by image, i, j),
multiscale as (select image, i, j, t / max(t) over (partition by image) as t from multi)"""


# whole jobs: smoothing, matrices, equalisation, scales, search, shaping, scores


def _smoothed(p: str, ov: int, rgb: bool = False) -> str:
    """{p}m: the matrix of the smoothed pixels over the grid with this overlap."""
    var = lambda c: f"(count(*) * sum({c} * {c}) - sum({c}) * sum({c}))"
    if rgb:
        value = f"case when {var('red')} + {var('g')} + {var('b')} = 0 then 1.0::double else least(1.0::double, 3.0::double / (({var('red')} + {var('g')} + {var('b')})::double / (count(*) * count(*)))) end"
    else:
        value = f"case when {var('gray')} = 0 then 1.0::double else least(1.0::double, 1.0::double / (sqrt({var('gray')}::double) / count(*))) end"
    return f"""
{p}c as (select g.image, g.r, g.i, g.j, g.k, p.r as red, p.g, p.b, (3735 * p.r + 19235 * p.g + 9798 * p.b + 16384) // 32768 as gray
         from grid{ov} g join bilateral p on p.image = g.image and p.y >= g.tly and p.y < g.tly + g.r and p.x >= g.tlx and p.x < g.tlx + g.r),
{p}v as (select image, r, i, j, k, {value} as t from {p}c group by image, r, i, j, k),
{p}m as materialized (select image, r, i, j, k, t / nullif(max(t) over (partition by image, r), 0) as t from {p}v)"""


def _equalised(p: str, source: str) -> str:
    """{p}q: the source matrix equalised, 0 to 1."""
    text = _CLAHE.replace("matrix1", source).replace("ch_", f"{p}ch_").replace("clahe1", f"{p}u")
    return text + f",\n{p}q as materialized (select image, r, i, j, k, t / 255 as t from {p}u)"


def _scales(p: str, source: str, size: int, rows: int) -> str:
    """{p}t{size}: the multiscale matrix up to this size of the sweep's [3, 6], before equalisation."""
    resized = _RESIZE.format(name=f"{p}z{size}", source=f"{p}s{size}").replace("range(10)", f"range({rows})").replace("::double / 10)", f"::double / {rows})")
    return f"""
{p}s{size} as (select * from {source} where r < {size} and r = 3),{resized},
{p}w{size} as (select image, i, j, round(sum(t), 12) as t from (
  select image, i, j, t from {source} where r = {size} union all select image, i, j, r * t from {p}z{size}) group by image, i, j),
{p}t{size} as (select image, {size} as r, i, j, i * {rows} + j as k, t / nullif(max(t) over (partition by image), 0) as t from {p}w{size})"""


def sweep_blocks(p: str, matrix: str, ov: int, sizes: list[int], cuts: list[float]) -> str:
    """{p}rows: image, kind, r, c, s, t, o1, o2, dist, score, n of every pair: routes over the matrix, shaped and scored."""
    half = "" if ov == 1 else " / 2.0::double"
    far = "" if ov == 1 else " or (abs(a.i - b.i) in (0, 2) and abs(a.j - b.j) in (0, 2))"
    same = lambda x, y, names: " and ".join(f"{x}.{n} = {y}.{n}" for n in names.split())
    path, w = "image, r, c, s, t", "window w as (partition by image, r, c, s, t order by seq)"
    fit = lambda c: f"coalesce(round_even((-3 * lag({c}, 2) over w + 12 * lag({c}, 1) over w + 17 * {c} + 12 * lead({c}, 1) over w - 3 * lead({c}, 2) over w) / 35.0::double, 0)::bigint, {c}) as {c}"
    return f"""
{p}mm as materialized (select * from {matrix} where r in ({', '.join(map(str, sizes))})),
{p}cuts as (select unnest([{', '.join(f'{c}::double' for c in cuts)}]) as c),
{p}e as materialized (select a.image, a.r, c.c, a.k as src, b.k as dst, (100.0 / a.t) * (100.0 / a.t) + (100.0 / b.t) * (100.0 / b.t) as w
  from {p}mm a join {p}mm b on a.image = b.image and a.r = b.r and a.k <> b.k and ((abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1){far}) cross join {p}cuts c where a.t >= c.c and b.t >= c.c),
{p}kc as (select p.image, p.kind, g.r, cast(row_number() over (partition by p.image, p.kind, g.r order by p.ord, g.k) - 1 as int) as ord, g.k
  from keypoints p join grid{ov} g on p.image = g.image and p.y >= g.tly and p.y < g.tly + g.r{half} and p.x >= g.tlx and p.x < g.tlx + g.r{half} where g.r in ({', '.join(map(str, sizes))})),
{p}kp as (select a.image, a.kind, a.r, c.c, a.ord as o1, b.ord as o2, a.k as s, b.k as t from {p}kc a join {p}kc b on {same("a", "b", "image kind r")} and a.ord < b.ord cross join {p}cuts c),
{p}d(image, r, c, s, k, dist) using key (image, r, c, s, k) as (
  select distinct image, r, c, s, s as k, 0.0::double as dist from {p}kp
  union
  select d.image, d.r, d.c, d.s, e.dst, min(d.dist + e.w) from {p}d d join {p}e e on {same("e", "d", "image r c")} and e.src = d.k
  left join recurring.{p}d o on {same("o", "d", "image r c s")} and o.k = e.dst where o.dist is null or d.dist + e.w < o.dist group by d.image, d.r, d.c, d.s, e.dst),
{p}dd as materialized (select * from {p}d),
{p}pp as materialized (select p.*, case when m.t >= p.c then d.dist end as dist from {p}kp p left join {p}mm m on {same("m", "p", "image r")} and m.k = p.s left join {p}dd d on {same("d", "p", "image r c s")} and d.k = p.t),
{p}pr as materialized (select x.image, x.r, x.c, x.s, x.k, min(e.src) as pred from {p}dd x join {p}e e on {same("e", "x", "image r c")} and e.dst = x.k
  join {p}dd b on {same("b", "x", "image r c s")} and b.k = e.src and b.dist + e.w = x.dist where x.k <> x.s group by x.image, x.r, x.c, x.s, x.k),
{p}wk(image, r, c, s, t, n, k) as (
  select distinct image, r, c, s, t, 0, t from {p}pp where dist is not null
  union all
  select w.image, w.r, w.c, w.s, w.t, w.n + 1, p.pred from {p}wk w join {p}pr p on {same("p", "w", "image r c s k")}),
{p}ce as materialized (select x.image, x.r, x.c, x.s, x.t, (max(n) over (partition by x.image, x.r, x.c, x.s, x.t) - n)::int as seq, g.tly + g.r // 2 as row, g.tlx + g.r // 2 as col
  from {p}wk x join grid{ov} g on {same("g", "x", "image r k")}),
{p}iv(image, r, c, s, t, a, b) as (
  select {path}, min(seq), max(seq) from {p}ce group by {path}
  union all
  select {path}, unnest([a, m]), unnest([m, b]) from (
    select {path}, a, b, min(seq) filter (d2 = top) as m, max(top) as top from (
      select v.*, p.seq, d2, max(d2) over (partition by v.image, v.r, v.c, v.s, v.t, v.a, v.b) as top from {p}iv v
      join {p}ce p on {same("p", "v", "image r c s t")} and p.seq > v.a and p.seq < v.b join {p}ce x on {same("x", "v", "image r c s t")} and x.seq = v.a join {p}ce y on {same("y", "v", "image r c s t")} and y.seq = v.b,
      lateral (select (((p.col - x.col) * (y.row - x.row) - (p.row - x.row) * (y.col - x.col))::double * ((p.col - x.col) * (y.row - x.row) - (p.row - x.row) * (y.col - x.col))) / ((y.row - x.row) * (y.row - x.row) + (y.col - x.col) * (y.col - x.col)) as d2))
    group by {path}, a, b) where top >= (1.5 * r) * (1.5 * r)),
{p}si as materialized (select x.*, n from (select *, count(*) over (partition by {path}) as n from {p}ce) x join (select distinct {path}, seq from (select {path}, a as seq from {p}iv union all select {path}, b from {p}iv)) v on {same("v", "x", "image r c s t seq")}),
{p}li as (select *, sum(step) over (partition by {path} order by seq) as pos from (
  select *, coalesce(sqrt(((row - lag(row) over w) * (row - lag(row) over w) + (col - lag(col) over w) * (col - lag(col) over w))::double), 0) as step from {p}si {w})),
{p}se as (select *, lead(d0) over w as d1, lead(row) over w as row1, lead(col) over w as col1, lead(seq, 2) over w is null as last_
  from (select *, pos / nullif(max(pos) over (partition by {path}), 0) as d0 from {p}li) {w}),
{p}re as (select {path}, q::int as seq, round_even(round(row + f * (row1 - row), 9), 0)::bigint as row, round_even(round(col + f * (col1 - col), 9), 0)::bigint as col from (
  select *, (q / (n - 1)::double - d0) / (d1 - d0) as f from (
    select *, unnest(range(ceil(d0 * (n - 1) - 1e-9::double)::bigint, case when last_ then n else ceil(d1 * (n - 1) - 1e-9::double)::bigint end)) as q from {p}se where d1 > d0))
  union all select {path}, 0, row, col from {p}si where n = 1),
{p}sm as materialized (select {path}, seq, {fit("row")}, {fit("col")} from {p}re {w}),
{p}pt as (select distinct p.image, p.r, p.row, p.col, p.r // 2 as half, x.h, x.w from {p}sm p join shapes x using (image)),
{p}pa as materialized (select t.image, t.r, t.row, t.col, t.half, p.y, p.x, p.lab from {p}pt t join pixels p on p.image = t.image and p.y >= greatest(0, t.row - half) and p.y < least(t.h - 1, t.row + half) and p.x >= greatest(0, t.col - half) and p.x < least(t.w - 1, t.col + half)),
{p}va as (select image, r, row, col, avg(v) / 255 as t from (
  select a.image, a.r, a.row, a.col, a.y, a.x, min(b.lab) as v from {p}pa a join {p}pa b on {same("b", "a", "image r row col")} and b.y between a.y - a.half // 2 and a.y - a.half // 2 + a.half - 1 and b.x between a.x - a.half // 2 and a.x - a.half // 2 + a.half - 1
  group by a.image, a.r, a.row, a.col, a.y, a.x) group by image, r, row, col),
{p}sc as (select p.image, p.r, p.c, p.s, p.t, count(*) as n, greatest(0.0::double, 1 - 0.03::double * coalesce(sum(case when p.seq > p.lo and p.seq < p.hi and v.t < 0.5 then 1 - v.t end), 0)) as score
  from (select *, min(seq) over (partition by {path}) as lo, max(seq) over (partition by {path}) as hi from {p}sm) p left join {p}va v on {same("v", "p", "image r row col")} group by p.image, p.r, p.c, p.s, p.t),
{p}rows as (select p.*, x.score, coalesce(x.n, 2)::int as n from {p}pp p left join {p}sc x on {same("x", "p", "image r c s t")})"""


def sweep_select(p: str, tf: str, labelled: bool = True) -> str:
    score = "case when kind = 'reachable' then case when dist is not null then score else 0 end else case when dist is not null then 0 else 1 end end" if labelled else "null"
    return f"""select image, '{tf}' as traversability_function, r as region_size, c as cut_threshold, kind = 'reachable' as path_existence, dist is not null as path_found,
  round(({score})::double, 6) as path_score, n as path_length, s, t, o1, o2, round(dist, 6) as dist from {p}rows"""


_BLOCKS = ",".join(
    [
        PIXELS_SQL, KEYPOINTS_SQL, RESULTS_SQL,
        "\nsizes as (select unnest([3, 4, 6]) as r)", "\ncuts as (select unnest([0.1::double, 0.2::double, 0.4::double]) as c)",
        "\nshapes as (select image, max(y) + 1 as h, max(x) + 1 as w from pixels group by image)",
        _grid(1), _grid(2), _RESIZE.format(name="resized", source="matrix1"), _CLAHE, _BILATERAL, _GRAPH, _PATHS, _PATCH, _COMPARE,
        _RESIZE.format(name="label_resized", source="label_image"),
        _RESIZE.format(name="m5", source="matrix1").replace("range(10)", "range(5)").replace("::double / 10)", "::double / 5)").replace("m5_taps", "mtaps"), _MULTI,
    ]
)


def sql(text: str, *more: str) -> str:
    """A query over the blocks above, and more of them; only those it names are evaluated."""
    return f"with recursive {','.join([_BLOCKS, *more]).strip()}\n{text}"


def _both(p: str) -> str:
    return f"\n{p}all as (select * from {p}t3 union all select * from {p}t6)"


#: SQL of the registered sweeps: the blocks each needs, and what it selects.
SWEEPS = {
    "run_sweep": (
        sweep_select("f_", "tf_grayhist") + "\nunion all " + sweep_select("g_", "reference"),
        _smoothed("b1", 1), _equalised("b1", "b1m"), sweep_blocks("f_", "b1q", 1, [3, 6], [0.2, 0.4]), sweep_blocks("g_", "truth1", 1, [3, 6], [0.2, 0.4]),
    ),
    "run_sweep_overlap": (sweep_select("f_", "tf_grayhist"), _smoothed("b2", 2), _equalised("b2", "b2m"), sweep_blocks("f_", "b2q", 2, [6], [0.2])),
    "run_sweep_multiscale": (
        sweep_select("f_", "tf_rgbhist"), _smoothed("b1", 1, True), _scales("b1", "b1m", 3, 10), _scales("b1", "b1m", 6, 5), _both("b1"), _equalised("b1", "b1all"), sweep_blocks("f_", "b1q", 1, [3, 6], [0.2]),
    ),
    "run_sweep_overlap_multiscale": (
        sweep_select("f_", "tf_grayhist"), _smoothed("b2", 2), _scales("b2", "b2m", 3, 20), _scales("b2", "b2m", 6, 10), _both("b2"), _equalised("b2", "b2all"), sweep_blocks("f_", "b2q", 2, [3, 6], [0.2]),
    ),
    "route_all": (sweep_select("f_", "tf_grayhist", False), _smoothed("b1", 1), _equalised("b1", "b1m"), sweep_blocks("f_", "b1q", 1, [3], [0.2])),
}
TRAVERSABILITY = ("select image, r, k, round(t, 6) as t from b1q", _smoothed("b1", 1), _equalised("b1", "b1m"))
#: Routes of the plain matrix without their points near the line; columns as simplify_paths gives them.
SIMPLIFIED = ("select image, r, c, s, t, seq, row, col, n from f_si", sweep_blocks("f_", "matrix1", 1, [3], [0.1, 0.2, 0.4]))
