"""Exact shortest routes of many graphs and sources at once, and their shaping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div
from ..shared import Rounds, in_groups, shuffled, small, written

GRAPH = ["image", "r", "c"]
NODE = [*GRAPH, "s", "k"]


#: Cells of a tile (a band of an image's rows): what one task relaxes at a time.
TILE = 262_144
#: Sources of a graph that a task relaxes together, about: with TILE, what it holds and gives back.
SOURCES = 8
#: Rounds whose lowered distances are merged into one table.
MERGED = 4
#: What a row that a tile's task gets is: a distance known before, one told in this round; an edge.
OLD, FRESH, EDGE = 0, 1, 2


def relax(flat: np.ndarray, front: np.ndarray, row: np.ndarray, shift: np.ndarray, first: np.ndarray, to: np.ndarray, weight: np.ndarray, typical: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Lowers flat in place until no edge lowers it further, or for so many steps. flat: distances of all cells of a graph from one source, a row each source,
    row after row; row: each place's; shift: what a row's places lie after its cells' numbers. first, to, weight: edges by the cell they begin in; typical: an
    edge's weight in a row's graph. front: places to begin at; gives back those to go on from.

    A step looks at edges out of what was lowered, in all rows at once; and of this, while steps aren't counted, only at what lies within a
    typical edge's weight of the row's nearest, as what is farther may be lowered again before its turn comes."""
    degree = np.diff(first)
    waits = np.zeros(len(flat), dtype=bool)
    waits[front] = True
    while len(front) and steps != 0:
        now, later = front, front[:0]
        if steps is not None:
            steps -= 1
        else:
            of, least = row[front], np.full(len(shift), np.inf)
            np.minimum.at(least, of, flat[front])
            near = flat[front] <= (least + typical)[of]
            now, later = front[near], front[~near]
        waits[now] = False
        move = shift[row[now]]
        edge, k = _out_of(now - move, first, degree)
        at, value = np.repeat(move, k) + to[edge], np.repeat(flat[now], k) + weight[edge]
        lower = value < flat[at]
        at, value = at[lower], value[lower]
        np.minimum.at(flat, at, value)
        told = np.unique(at)
        told = told[~waits[told]]
        waits[told] = True
        front = np.concatenate([later, told])
    return front


def _out_of(cell: np.ndarray, first: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that begin in these cells, and how many each has."""
    k = degree[cell]
    return np.repeat(first[cell] - (np.cumsum(k) - k), k) + np.arange(k.sum()), k


#: Distances that a task lowers at a time.
PLACES = 1 << 22


def _last_steps(flat: np.ndarray, shift: np.ndarray, group: np.ndarray, source: np.ndarray, begins: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, cell and the smallest cell before it on a best route. flat: settled distances, a row each source; shift: what a row's places lie after its cells';
    group and source: each row's, cells; begins: where each group's cells begin; src, dst, w: edges in order of dst, then src. So many edges, each once for
    every source, are looked at at a time."""
    edges = np.searchsorted(dst, begins)
    n = np.diff(edges)[group]
    ends, low = np.cumsum(n), 0
    while low < len(group):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - n[low] + places, side="right")))
        many = n[low:high]
        row = np.repeat(np.arange(low, high), many)
        edge = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - edges[group[low:high]], many)
        to = flat[shift[row] + dst[edge]]
        met = np.flatnonzero((flat[shift[row] + src[edge]] + w[edge] == to) & (to < np.inf) & (dst[edge] != source[row]))
        row, edge = row[met], edge[met]
        new = np.ones(len(met), dtype=bool)  # edges are in order: the first into a cell begins in the smallest
        new[1:] = (row[1:] != row[:-1]) | (dst[edge[1:]] != dst[edge[:-1]])
        yield row[new], dst[edge[new]], src[edge[new]]
        low = high


def _relax_tiles(of: np.ndarray, what: np.ndarray, a: np.ndarray, k: np.ndarray, v: np.ndarray, steps: int | None, places: int = PLACES, preds: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Many groups (a graph's tile and a block of sources) at once; of: each row's group. Rows are known distances (what OLD or FRESH; a the source) and edges
    that begin in the tile (what EDGE; a where they lead). Yields group, source, cell, distance, told: distances of a tile's cells that
    were lowered (told 0), what its edges tell cells of other tiles (1), and cells it has yet to go on from (2); preds: and the cell before
    each lowered one by the tile's own edges (-1: none)."""
    is_edge, fresh = what == EDGE, what == FRESH
    known, groups = ~is_edge, int(of[-1]) + 1
    wide = int(max(a.max(), k.max())) + 1
    cells, at = np.unique(np.r_[of * wide + k, of[is_edge] * wide + a[is_edge]], return_inverse=True)
    begins, dst = np.searchsorted(cells, np.arange(groups + 1) * wide), at[len(k) :]
    src, w, start = at[: len(k)][is_edge], v[is_edge], at[: len(k)][known]
    own = np.zeros(len(cells), dtype=bool)
    own[at[: len(k)]] = True
    order = np.argsort(src, kind="stable")
    src, dst, w, stays = src[order], dst[order], w[order], own[dst[order]]
    inner, outer = ((np.searchsorted(src[m], np.arange(len(cells) + 1)), dst[m], w[m]) for m in (stays, ~stays))
    typical = np.zeros(groups)
    median = pd.Series(w[stays]).groupby(cells[src[stays]] // wide).median()
    typical[median.index.to_numpy()] = median.to_numpy()
    names, source = np.unique(of[known] * wide + a[known], return_inverse=True)
    group, dist, fresh = names // wide, v[known], fresh[known]
    size = np.diff(begins)[group]
    ends = np.cumsum(size)
    if preds:
        own_src = np.repeat(np.arange(len(cells)), np.diff(inner[0]))
        by_dst = np.lexsort((own_src, inner[1]))
        into = own_src[by_dst], inner[1][by_dst], inner[2][by_dst]
        home = np.minimum(np.searchsorted(cells, names), len(cells) - 1)
        home = np.where(cells[home] == names, home, -1)
    low = 0
    while low < len(names):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - size[low] + places, side="right")))
        mine, n = (source >= low) & (source < high), size[low:high]
        shift = np.cumsum(n) - n - begins[group[low:high]]
        row = np.repeat(np.arange(len(n)), n)
        place = shift[source[mine] - low] + start[mine]
        flat, before = np.full(len(row), np.inf), np.full(len(row), np.inf)
        np.minimum.at(flat, place, dist[mine])
        old = ~fresh[mine]
        np.minimum.at(before, place[old], dist[mine][old])
        left = relax(flat, np.unique(place[~old]), row, shift, *inner, typical[group[low:high]], steps)
        lowered = np.flatnonzero(flat < before)
        out = [(lowered[own[lowered - shift[row[lowered]]]], flat, 0), (left, flat, 2)]
        if len(outer[1]):
            # only edges out of lowered cells tell anything new
            move, one = shift[row[lowered]], np.full(len(row), np.inf)
            edge, many = _out_of(lowered - move, outer[0], np.diff(outer[0]))
            np.minimum.at(one, np.repeat(move, many) + outer[1][edge], np.repeat(flat[lowered], many) + outer[2][edge])
            out.append((np.flatnonzero(one < np.inf), one, 1))
        last = np.full(len(row) if preds else 0, -1)
        if preds:
            for r, to, before_to in _last_steps(flat, shift, group[low:high], home[low:high], begins, *into, places):
                last[shift[r] + to] = cells[before_to] % wide
        for where, values, told in out:
            r = row[where]
            pred = [last[where] if told == 0 else np.full(len(where), -1)] if preds else []
            yield group[low + r], names[low + r] % wide, cells[where - shift[r]] % wide, values[where], np.full(len(where), told, dtype=np.int32), *pred
        low = high


def _in_blocks(sources: DataFrame, edges: DataFrame, most: int, tile: int) -> DataFrame:
    """sources (image, r, c, s) with block: about ``most`` sources of a graph share one, or more if its cells fill no tile: as many as have no more
    distances. A block's task gets edges of its own, so they are there as often as there are blocks."""
    cells = edges.groupBy(*GRAPH).agg(F.least(F.max(F.greatest("src", "dst")) + 1, F.lit(tile)).alias("cells"))
    n = sources.groupBy(*GRAPH).agg(F.count(F.lit(1)).alias("n")).join(shuffled(cells), GRAPH, "left")
    n = n.select(*GRAPH, F.ceil(F.col("n") * F.coalesce("cells", F.lit(1)) / (most * tile)).cast("long").alias("blocks"))
    return sources.join(small(n), GRAPH).select(*GRAPH, "s", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("block"))


def shortest_tree(edges: DataFrame, sources: DataFrame, steps: int | None = None, rounds: int | None = None, tile: int = TILE, block: int = SOURCES, kept: bool = False, preds: bool = False) -> DataFrame:
    """image, r, c, s, k, dist: least weight from each source (image, r, c, s) to every cell it reaches.

    All graphs and sources relax together, by tiles and blocks of sources: a task takes the edges that begin in one tile of one graph and
    lowers the distances of all its cells from one block's sources until they settle (or for so many steps); what it tells cells of other tiles is
    the next round's work, if it is better than what they have. A round touches the tiles that were told something and no others. Rounds'
    tables go as soon as no later round reads them: lowered distances are merged into one table every few rounds. An image with no
    more cells than a tile takes one round. kept: edges is a written table already. rounds: an error after so many (none: as many as it takes).
    preds: if one round was all, with pred, what predecessors() would find (-1: none): the task that settles a tile has its edges at hand."""
    spark = edges.sparkSession
    band = lambda k: F.floor(F.col(k) / tile).cast("long").alias("tile")
    edges = edges.where(F.col("w") < float("inf")).select(*GRAPH, "src", "dst", "w")
    edges = edges if kept else written(edges, "edges")
    tellings, best_rounds, lowerings = Rounds(spark, "told"), Rounds(spark, "best"), []
    blocks = _in_blocks(written(sources.select(*GRAPH, "s").distinct(), "sources"), edges, block, tile)
    edges = edges.select(*GRAPH, band("src"), F.col("src").alias("k"), "dst", "w")
    told = tellings.write(blocks.select(*GRAPH, "block", "s", F.col("s").alias("k"), F.lit(0.0).alias("dist")))
    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = ", ".join(f"{n} {types[n]}" for n in GRAPH) + ", block int, s long, k long, dist double, told int"
    preds = preds and steps is None
    key, columns = [*GRAPH, "tile", "block"], [*GRAPH, "block", "s", "k", "dist"]

    def settle(table: pa.Table, first: np.ndarray, preds: bool) -> Iterator[pa.Table]:
        of = _numbered(table, first)
        for group, *found in _relax_tiles(of, *(table[n].to_numpy() for n in ("what", "a", "k", "v")), steps, preds=preds):
            graph = table.select([*GRAPH, "block"]).take(pa.array(first[group]))
            yield pa.table([*graph.columns, *found], names=[*columns, "told", *["pred"] * preds])

    best, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        as_rows = lambda df, what, a, v: df.select(*key, F.lit(what).alias("what"), F.col(a).alias("a"), "k", F.col(v).alias("v"))
        fresh = told.select(*columns, band("k"))
        active = small(fresh.select(*key).distinct())
        rows = as_rows(fresh, FRESH, "s", "dist").unionByName(as_rows(edges.join(active, [*GRAPH, "tile"]), EDGE, "dst", "w"))
        if best is not None:
            rows = rows.unionByName(as_rows(best.select(*columns, band("k")).join(active, key, "left_semi"), OLD, "s", "dist"))
        lowerings.append(Rounds(spark, "lowered"))
        only = preds and done == 1
        found = lowerings[-1].write(in_groups(rows, key, partial(settle, preds=only), schema + ", pred long" * only))
        lowered = found.where("told = 0").select(*columns)
        best = lowered if best is None else best.unionByName(lowered)
        best_now = best.groupBy(*NODE).agg(F.first("block").alias("block"), F.min("dist").alias("dist"))
        if not _none(found.where("told > 0")):
            news = found.where("told > 0").groupBy(*NODE).agg(F.first("block").alias("block"), F.min("dist").alias("dist"), F.max("told").alias("told"))
            least = shuffled(best_now.select(*NODE, F.col("dist").alias("least")))
            told = tellings.write(news.join(least, NODE, "left").where("least is null or dist < least or told = 2").select(*columns))
            if not _none(told):
                if len(lowerings) >= MERGED:
                    best = best_rounds.write(best_now.select(*columns))
                    for old in lowerings:
                        old.drop()
                    lowerings = []
                continue
        tellings.drop()
        if done > 1:  # read more than once: merged here, not by every reader; a single round has each distance once
            best = best_rounds.write(best_now.select(*columns))
            for old in lowerings:
                old.drop()
        return found.where("told = 0").select(*NODE, "dist", "pred") if only else best.select(*NODE, "dist")
    raise RuntimeError("distances not settled")


def _numbered(table: pa.Table, first: np.ndarray) -> np.ndarray:
    """The number of each row's group."""
    return np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]))


def _none(news: DataFrame) -> bool:
    return not news.limit(1).count()


def _before(of: np.ndarray, is_edge: np.ndarray, a: np.ndarray, k: np.ndarray, v: np.ndarray, places: int = PLACES) -> Iterator[tuple[np.ndarray, ...]]:
    """Many groups at once; of: each row's group. Rows are edges (where is_edge; from a to k) and known distances (a the source). Yields group, source, cell, the
    smallest cell before it on a best route; so many distances are looked at at a time."""
    known, wide = ~is_edge, int(max(a.max(), k.max())) + 1
    cells, at = np.unique(np.r_[of * wide + k, of[is_edge] * wide + a[is_edge]], return_inverse=True)
    begins, at, src = np.searchsorted(cells, np.arange(int(of[-1]) + 2) * wide), at[: len(k)], at[len(k) :]
    dst, w, start, dist = at[is_edge], v[is_edge], at[known], v[known]
    order = np.lexsort((src, dst))
    src, dst, w = src[order], dst[order], w[order]
    names, source = np.unique(of[known] * wide + a[known], return_inverse=True)
    home = np.minimum(np.searchsorted(cells, names), len(cells) - 1)
    home = np.where(cells[home] == names, home, -1)
    by_source = np.argsort(source, kind="stable")
    rows = np.searchsorted(source[by_source], np.arange(len(names) + 1))
    group = names // wide
    size = np.diff(begins)[group]
    ends, low = np.cumsum(size), 0
    while low < len(names):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - size[low] + places, side="right")))
        g, mine = group[low:high], by_source[rows[low] : rows[high]]
        shift = np.cumsum(size[low:high]) - size[low:high] - begins[g]
        flat = np.full(int(size[low:high].sum()), np.inf)
        flat[shift[source[mine] - low] + start[mine]] = dist[mine]
        for row, to, pred in _last_steps(flat, shift, g, home[low:high], begins, src, dst, w, places):
            yield g[row], names[low + row] % wide, cells[to] % wide, cells[pred] % wide
        low = high


def predecessors(edges: DataFrame, tree: DataFrame, tile: int = TILE, block: int = SOURCES) -> DataFrame:
    """image, r, c, s, k, pred: the last cell before k on a best route (the smallest on ties).

    A task takes the edges that lead into one tile of one graph, and the distances of both their ends from a block of sources: what is shuffled is a row an
    edge and a row a distance, not a row for each edge and source. Edges are there once a block; a graph has several only where its tile's distances are
    more than ``block`` sources would have in a whole tile. Cells that an edge leads out of are known in the next tile too. A tree that has
    pred already (see shortest_tree) is all it takes."""
    if "pred" in tree.columns:
        return tree.where("pred >= 0").select(*NODE, "pred")
    band = lambda c: F.floor(F.col(c) / tile).cast("long")
    types = {f.name: f.dataType.simpleString() for f in tree.schema}
    graph_tile, key = [*GRAPH, "tile"], [*GRAPH, "tile", "block"]
    into = edges.select(*GRAPH, "src", "dst", "w", band("dst").alias("tile"))
    out = small(into.where(band("src") != F.col("tile")).select(*GRAPH, F.col("src").alias("k"), "tile").distinct())
    own = tree.select(*NODE, "dist", band("k").alias("tile"))
    beside = tree.select(*NODE, "dist").join(out, [*GRAPH, "k"]).select(*own.columns)
    blocks = own.groupBy(*graph_tile).agg(F.ceil(F.count(F.lit(1)) / (block * tile)).cast("int").alias("blocks"))
    many = small(blocks.where("blocks > 1"))
    dealt = lambda df: df.join(many, graph_tile, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    as_rows = lambda df, is_edge, a, k, v: df.select(*key, F.lit(is_edge).alias("edge"), F.col(a).alias("a"), F.col(k).alias("k"), F.col(v).alias("v"))
    rows = as_rows(dealt(into).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), True, "src", "dst", "w")
    rows = rows.unionByName(as_rows(dealt(own.unionByName(beside)).withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")), False, "s", "k", "dist"))

    def find(table: pa.Table, first: np.ndarray) -> Iterator[pa.Table]:
        for group, s, k, pred in _before(_numbered(table, first), *(table[n].to_numpy() for n in ("edge", "a", "k", "v"))):
            yield pa.table([*table.select(GRAPH).take(pa.array(first[group])).columns, s, k, pred], names=[*NODE, "pred"])

    return in_groups(rows, key, find, ", ".join(f"{n} {types[n]}" for n in GRAPH) + ", s long, k long, pred long")


def routes(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs (image, r, c, kind, o1, o2, s, t) with dist and found: one search a distinct source,
    joined to every pair of it. s = t is found at distance 0 unless its cell is cut."""
    return pairs.join(shuffled(tree.withColumnRenamed("k", "t")), [*GRAPH, "s", "t"], "left").withColumn("found", F.col("dist").isNotNull())


def _chase(pred: np.ndarray, cells: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one tile: where each asked cell's way back leaves it (the first cell outside, or one without a predecessor),
    and after how many hops. Pointers are doubled: as many steps as the hops have binary digits."""
    every = np.unique(np.r_[cells, pred, asked])
    to = np.arange(len(every))
    to[np.searchsorted(every, cells)] = np.searchsorted(every, pred)
    hops = (to != np.arange(len(every))).astype(np.int64)
    while True:
        further = hops[to]
        if not further.any():
            break
        hops, to = hops + further, to[to]
    at = np.searchsorted(every, asked)
    return every[to[at]], hops[at]


#: Places of routes whose cells a task lists together.
WALKED = 1 << 14


def trace_paths(found: DataFrame, preds: DataFrame, tile: int = TILE) -> DataFrame:
    """image, r, c, s, t, seq, k: cells of each found route, from s.

    A way back is followed inside tiles first: of each cell where it enters one, a task gives the cell where it leaves it
    and the hops between. These pointers are doubled by joins (as many rounds as the tiles crossed have binary digits) until each route
    has its places on entering tiles; then every tile's task lists the cells between. A group is one tile of one source's tree.
    Where no way back leaves its tile, the tasks that list the cells are all."""
    spark = found.sparkSession
    tree, path = [*GRAPH, "s"], [*GRAPH, "s", "t"]
    group = [*tree, "tile"]
    types = {f.name: f.dataType.simpleString() for f in found.schema} | {"s": "long", "t": "long"}
    named = lambda names: ", ".join(f"{n} {types[n]}" for n in names)
    band = lambda k: F.floor(F.col(k) / tile).cast("long").alias("tile")
    asked = written(found.where("found").select(*path).distinct(), "asked")
    back = written(preds.select(*tree, band("k"), "k", "pred"), "preds")
    crossing = back.where(F.col("tile") != F.floor(F.col("pred") / tile)).select(*tree, F.col("pred").alias("k"))
    ways = back.select(*group, F.lit(True).alias("way"), "k", F.col("pred").alias("a"), F.lit(0).cast("long").alias("seq"))

    def leave(table: pa.Table, first: np.ndarray) -> Iterator[pa.Table]:
        of, way, k, a = _numbered(table, first), *(table[n].to_numpy() for n in ("way", "k", "a"))
        wide = int(max(k.max(), a.max())) + 1
        at, entry = of * wide + k, np.flatnonzero(~way)
        if len(entry):
            to, hops = _chase((of * wide + a)[way], at[way], at[entry])
            yield pa.table([*table.select([*tree, "k"]).take(pa.array(entry)).columns, to % wide, hops], names=[*tree, "k", "exit", "hops"])

    def walk(table: pa.Table, first: np.ndarray) -> Iterator[pa.Table]:
        of, way, k, a, at = _numbered(table, first), *(table[n].to_numpy() for n in ("way", "k", "a", "seq"))
        wide = int(max(k.max(), a.max())) + 1
        pred = of * wide + a
        cells, place = np.unique(np.r_[of * wide + k, pred[way]], return_inverse=True)
        to = np.full(len(cells), -1)
        to[place[: len(k)][way]] = place[len(k) :]
        tiles, sources = (table[c].to_numpy()[first][cells // wide] for c in ("tile", "s"))
        inside = (cells % wide // tile == tiles) & (cells % wide != sources)  # the source is a place of its own
        points = np.flatnonzero(~way)
        whole = at < 0  # routes that lie in this tile alone: counted here
        if whole.any():
            at = at.copy()
            at[whole] = _chase(pred[way], (of * wide + k)[way], (of * wide + k)[whole])[1]
        for low in range(0, len(points), WALKED):
            n = points[low : low + WALKED]
            now, seq, out = place[n], at[n], []
            while len(now):
                out.append((n, now, seq))
                kept = to[now] >= 0
                kept[kept] = inside[to[now[kept]]] | whole[n[kept]]
                now, n, seq = to[now[kept]], n[kept], seq[kept] - 1
            n, now, seq = (np.concatenate(x) for x in zip(*out))
            yield pa.table([*table.select([*tree, "a"]).take(pa.array(n)).columns, seq.astype(np.int32), cells[now] % wide], names=[*path, "seq", "k"])

    if _none(crossing):
        started = asked.select(*tree, band("t"), F.lit(False).alias("way"), F.col("t").alias("k"), F.col("t").alias("a"), F.lit(-1).cast("long").alias("seq"))
        return in_groups(started.unionByName(ways), group, walk, named(path) + ", seq int, k long")
    entries = asked.select(*tree, F.col("t").alias("k")).unionByName(crossing).distinct().withColumn("tile", band("k"))
    pointers = Rounds(spark, "pointers")
    asking = entries.select(*group, F.lit(False).alias("way"), "k", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("seq"))
    jump = pointers.write(in_groups(asking.unionByName(ways), group, leave, named(tree) + ", k long, exit long, hops long"))
    points, places = asked.select(*path, F.col("t").alias("k"), F.lit(0).cast("long").alias("back")), Rounds(spark, "places")
    while True:
        told = jump.where("hops > 0")
        ahead = points.join(told, [*tree, "k"]).select(*path, F.col("exit").alias("k"), (F.col("back") + F.col("hops")).alias("back"))
        points = places.write(points.unionByName(ahead).distinct())
        if _none(told.where("exit <> s")):
            break
        then = told.select(*tree, F.col("k").alias("exit"), F.col("exit").alias("next"), F.col("hops").alias("more"))
        jump = pointers.write(told.join(then, [*tree, "exit"], "left").select(*tree, "k", F.coalesce("next", "exit").alias("exit"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    pointers.drop()
    # of a route's places its source is the farthest back
    length = points.groupBy(*path).agg(F.max("back").alias("length"))
    started = points.join(length, path).select(*tree, band("k"), F.lit(False).alias("way"), "k", F.col("t").alias("a"), (F.col("length") - F.col("back")).alias("seq"))
    return in_groups(started.unionByName(ways), group, walk, named(path) + ", seq int, k long")


def path_centers(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """paths (…, r, k) with row and col of the cells' centres."""
    at = cells.select("image", "r", "k", (F.col("tly") + div(F.col("r"), 2)).alias("row"), (F.col("tlx") + div(F.col("r"), 2)).alias("col"))
    return paths.join(shuffled(at), ["image", "r", "k"])


def unfound_paths(pairs: DataFrame) -> DataFrame:
    """Pairs without a route as two-cell paths: source, target."""
    ends = F.posexplode(F.array("s", "t"))
    return pairs.where(~F.col("found")).select(*GRAPH, "s", "t", ends.alias("seq", "k"))


def rdp(points: np.ndarray, dist: float) -> np.ndarray:
    """Which points stay: ends, and the first farthest point of a stretch while its distance from
    the chord reaches dist (where a stretch's ends coincide: its last point but one)."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rest = (points[b] - points[a]).astype(float), (points[a + 1 : b] - points[a]).astype(float)
        length2 = float(chord @ chord)
        if length2 == 0:
            far, at = dist * dist, b - 1
        else:
            d2 = (rest @ np.array([-chord[1], chord[0]])) ** 2 / length2
            at = a + 1 + int(d2.argmax())
            far = float(d2.max())
        if far >= dist * dist:
            keep[at] = True
            todo += [(a, at), (at, b)]
    return keep


PATH = [*GRAPH, "s", "t"]


def simplify_paths(paths: DataFrame, factor: float = 1.5) -> DataFrame:
    """paths (image, r, c, s, t, seq, row, col) without the points within factor * r of the line, and n, the
    number of points before."""

    def simplify(table: pa.Table, first: np.ndarray) -> Iterator[pa.Table]:
        points, ends = np.c_[table["row"].to_numpy(), table["col"].to_numpy()], np.r_[first[1:], table.num_rows]
        reach = factor * table["r"].to_numpy()[first].astype(float)
        keep = np.concatenate([rdp(points[a:b], d) for a, b, d in zip(first, ends, reach)])
        n = np.repeat(ends - first, ends - first)
        yield table.append_column("n", pa.array(n)).filter(pa.array(keep))

    types = {f.name: f.dataType.simpleString() for f in paths.schema}
    names = [*PATH, "seq", "row", "col"]
    return in_groups(paths.select(*names), PATH, simplify, ", ".join(f"{n} {types[n]}" for n in names) + ", n long", order=["seq"])


def resample_paths(simple: DataFrame) -> DataFrame:
    """n points at even arc lengths along each polyline, rounded half to even: image, r, c, s, t, seq,
    row, col. A path of one point keeps it."""
    order = Window.partitionBy(*PATH).orderBy("seq")
    whole = Window.partitionBy(*PATH)
    step = F.sqrt((F.col("row") - F.lag("row").over(order)).cast("double") * (F.col("row") - F.lag("row").over(order)) + (F.col("col") - F.lag("col").over(order)).cast("double") * (F.col("col") - F.lag("col").over(order)))
    s = simple.withColumn("step", F.coalesce(step, F.lit(0.0)))
    s = s.withColumn("at", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("len", F.max("at").over(whole)).withColumn("d0", F.col("at") / F.nullif(F.col("len"), F.lit(0.0)))
    s = s.withColumn("d1", F.lead("d0").over(order)).withColumn("row1", F.lead("row").over(order)).withColumn("col1", F.lead("col").over(order)).withColumn("last", F.lead("seq", 2).over(order).isNull())
    segments = s.where("d1 is not null and d1 > d0")
    # the samples of a segment by arithmetic: no range join
    n1 = (F.col("n") - 1).cast("double")
    low = F.ceil(F.col("d0") * n1 - 1e-9)
    high = F.when(F.col("last"), F.col("n") - 1).otherwise(F.ceil(F.col("d1") * n1 - 1e-9) - 1)
    points = segments.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).where("low <= high").withColumn("q", F.explode(F.sequence("low", "high")))
    f = (F.col("q") / n1 - F.col("d0")) / (F.col("d1") - F.col("d0"))
    mid = lambda a: F.bround(F.round(F.col(a) + f * (F.col(a + "1") - F.col(a)), 9)).cast("long").alias(a)
    shaped = points.select(*PATH, F.col("q").cast("int").alias("seq"), mid("row"), mid("col"))
    still = s.where("(len = 0 or len is null) and step = 0").groupBy(*PATH).agg(F.min("row").cast("long").alias("row"), F.min("col").cast("long").alias("col")).select(*PATH, F.lit(0).alias("seq"), "row", "col")
    return shaped.unionByName(still)


def smooth_paths(paths: DataFrame) -> DataFrame:
    """Five-point quadratic least squares along each path; its first and last two points stay."""
    order = Window.partitionBy(*PATH).orderBy("seq")
    weights = {-2: -3, -1: 12, 0: 17, 1: 12, 2: -3}

    def fitted(c: str):
        total = sum(F.lit(w) * (F.lag(c, -o).over(order) if o < 0 else F.lead(c, o).over(order) if o else F.col(c)) for o, w in ((-o, w) for o, w in weights.items()))
        return F.coalesce(F.bround(total / 35.0).cast("long"), F.col(c)).alias(c)

    return paths.select(*PATH, "seq", fitted("row"), fitted("col"))


def pack_paths(paths: DataFrame) -> DataFrame:
    """image, r, c, s, t, path_coordinates (array of [row, col]), path_length."""
    points = F.array_sort(F.collect_list(F.struct("seq", "row", "col")))
    return paths.groupBy(*PATH).agg(F.transform(points, lambda p: F.array(p["row"].cast("int"), p["col"].cast("int"))).alias("path_coordinates")).withColumn("path_length", F.size("path_coordinates"))
