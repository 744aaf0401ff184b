"""Embedding near-dedup: exact cosine pairs by dual traversal of cover trees.

Vectors are scaled to unit length; cosine >= t is a chord of at most sqrt(2 - 2 t). The upper levels of the tree are grown on the
executors: a cell of more than CHUNK vectors gets centres from a sample of its own (a net with halving radii), each
vector goes to the nearest one, and so on until no cell is larger. Such a cell is a chunk, which has a tree of nested levels of
radius 2, 1, 1/2, ... of its own. Chunks meet in two steps. First only the nodes of radius NODE_RADIUS of all trees are
compared, in blocks: two chunks go on if the distance of some two of their nodes is no more than both covering radii plus the
chord. Then a unit of work traverses two chunks' trees together: a pair of nodes is dropped by the same bound, else all pairs
of their children follow. Nothing but links and forests leaves a unit (millrace.llm.units), so a group of near copies gives
no row for each pair.

Where vectors have no structure, as random ones in many dimensions, each is a node of its own and bounds prune little, so
the pairs of nodes compared grow with the square of the input; they are compared by matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.graph import connected_components
from millrace.llm.store import cut, drop
from millrace.llm.units import LINKED, deal, linked_rows, with_units

THRESHOLD = 0.95
SAMPLE = 1024  # vectors of a cell from which its centres come, about
PIVOTS = 64  # centres of a cell, at most
CHUNK = 4096
DEPTH = 12  # levels of cells
LEVELS = 5  # radii 2, 1, 1/2, 1/4, 1/8
NODE_LEVEL = 3
NODE_RADIUS = 2.0 ** (1 - NODE_LEVEL)
NODES = 2048  # nodes in a block
_BLOCK = 1 << 20  # centre pairs compared at once


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay in range
    return v / np.sqrt((v * v).sum(1))[:, None]


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def net(v: np.ndarray, most: int) -> np.ndarray:
    """At most `most` centres: those of the finest net with halving radii that has no more, and as many of the next finer one, which
    holds them, as there is room for. One centre only if all of v is within 1/64 of it."""
    centres, radius = [0], 2.0
    near = v @ v[0]
    while radius > 1 / 64 and len(centres) < most:
        radius /= 2
        while len(centres) < most and (far := np.flatnonzero(_chord(near) > radius)).size:
            centres.append(int(far[0]))
            near = np.maximum(near, v @ v[far[0]])
    return np.array(centres)


def cover_tree(v: np.ndarray) -> np.ndarray:
    """For each level and point, the point that is the centre of its node. A centre stays one at all finer levels."""
    path = np.zeros((LEVELS, len(v)), np.int32)
    for level in range(1, LEVELS):
        least = 1 - (2.0 ** (1 - level)) ** 2 / 2  # cosine at the level's radius
        above = path[level - 1]
        order = np.argsort(above, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(above[order]) != 0]))
        for points in np.split(order, starts[1:]):
            centre = above[points[0]]
            while len(points):
                near = v[points] @ v[centre] >= least
                near |= points == centre
                path[level, points[near]] = centre
                points = points[~near]
                centre = points[0] if len(points) else -1
    return path


class Tree:
    """Nodes of each level: centre, covering radius (of all points below), and children on the next level."""

    def __init__(self, v: np.ndarray, path: np.ndarray):
        self.v, self.centre, self.radius, self.first, self.child = v, [], [], [], []
        levels = [*path, np.arange(len(v))]
        numbers = []
        for level in levels:
            centre, number = np.unique(level, return_inverse=True)
            radius = np.zeros(len(centre))
            np.maximum.at(radius, number, _chord(np.einsum("ij,ij->i", v, v[level])))
            self.centre.append(centre)
            self.radius.append(radius + 1e-7)  # a chord is exact to about the root of the rounding error
            numbers.append(number)
        for level in range(len(levels) - 1):
            _, at = np.unique(numbers[level + 1], return_index=True)
            parent = numbers[level][at]
            self.child.append(np.argsort(parent, kind="stable"))
            self.first.append(np.searchsorted(np.sort(parent), np.arange(len(self.centre[level]) + 1)))


def _expand(first: np.ndarray, child: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[nodes + 1] - first[nodes]
    return n, child[np.repeat(first[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def dual(x: Tree, y: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points (of x, of y) with cosine >= threshold; where y is x, each pair once and none with itself."""
    chord, same = float(np.sqrt(2 - 2 * threshold)), x is y
    p = q = np.zeros(1, np.int64)
    last = len(x.centre) - 1
    for level in range(last):
        deep = level + 1
        xc, yc = x.v[x.centre[deep]], y.v[y.centre[deep]]
        nx = x.first[level][p + 1] - x.first[level][p]
        ny = y.first[level][q + 1] - y.first[level][q]
        out_p, out_q = [], []

        def keep(cp, cq, cosine, own):
            reach = threshold if deep == last else 1 - np.minimum(x.radius[deep][cp] + y.radius[deep][cq] + chord, 2.0) ** 2 / 2
            ok = cosine >= reach
            if same:  # a node with itself: its children's pairs come in both orders
                ok &= ~own | (cp < cq if deep == last else cp <= cq)
            out_p.append(cp[ok])
            out_q.append(cq[ok])

        big = nx * ny > 4096
        for i in np.flatnonzero(big).tolist():
            a = x.child[level][x.first[level][p[i]] : x.first[level][p[i] + 1]]
            b = y.child[level][y.first[level][q[i]] : y.first[level][q[i] + 1]]
            other = yc[b].T
            widest = y.radius[deep][b].max()
            rows = max(1, _BLOCK // len(b))
            for k in range(0, len(a), rows):
                part = a[k : k + rows]
                cosine = xc[part] @ other
                # A bound for all of the block first; the few that pass it are looked at one by one.
                reach = threshold if deep == last else 1 - min(x.radius[deep][part].max() + widest + chord, 2.0) ** 2 / 2
                i0, i1 = np.nonzero(cosine >= reach)
                keep(part[i0], b[i1], cosine[i0, i1], np.full(len(i0), p[i] == q[i]))
        small = np.flatnonzero(~big)
        at = 0
        ends = np.cumsum(nx[small] * ny[small])
        while at < len(small):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (_BLOCK >> 4), "right")))
            pick = small[at:to]
            n, cp = _expand(x.first[level], x.child[level], p[pick])
            pair = np.repeat(np.arange(len(pick)), n)
            m, cq = _expand(y.first[level], y.child[level], q[pick][pair])
            cp = np.repeat(cp, m)
            keep(cp, cq, np.einsum("ij,ij->i", xc[cp], yc[cq]), np.repeat((p == q)[pick][pair], m))
            at = to
        p, q = np.concatenate(out_p), np.concatenate(out_q)
        if not len(p):
            break
    return p, q


def _grow(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("node")
    v = unit(_matrix(table["vector"]))
    path = cover_tree(v)
    column = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(path.T).ravel()), LEVELS).cast(pa.list_(pa.int32()))
    at = path[NODE_LEVEL]
    reach = np.zeros(len(v))
    np.maximum.at(reach, at, _chord(np.einsum("ij,ij->i", v, v[at])))
    reach = pa.array(reach + 1e-7, mask=at != np.arange(len(v)))  # of centres only
    return pa.table({"node": table["node"], "dim": table["dim"], "chunk": table["chunk"], "copies": table["copies"], "vector": table["vector"], "path": column, "reach": reach})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _pairs(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        ids, copies, side = (table[c].to_numpy() for c in ("node", "copies", "side"))
        v, path = unit(_matrix(table["vector"])), _matrix(table["path"]).T
        if not side.any():
            tree = Tree(v, path)
            a, b = dual(tree, tree, threshold)
        else:
            one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            a, b = dual(Tree(v[one], path[:, one]), Tree(v[two], path[:, two]), threshold)
            a, b = one[a], two[b]
        return pa.table(linked_rows(ids, copies, a, b))

    return run


def _meeting(threshold: float):
    """(c1, c2): chunks some of whose nodes (owner, vector, reach) are too near to be told apart."""
    chord = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        owner, reach, side = (table[c].to_numpy() for c in ("owner", "reach", "side"))
        v = unit(_matrix(table["vector"]))
        one = np.flatnonzero(side <= 1)
        two = np.flatnonzero(side != 1)
        found = set()
        other, owners, reaches = v[two].T, owner[two], reach[two]
        rows = max(1, _BLOCK // max(1, len(two)))
        for k in range(0, len(one), rows):
            part = one[k : k + rows]
            least = 1 - np.minimum(reach[part][:, None] + reaches[None, :] + chord, 2.0) ** 2 / 2
            i, j = np.nonzero((v[part] @ other >= least) & (owner[part][:, None] != owners[None, :]))
            a, b = owner[part][i], owners[j]
            found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
        pairs = sorted(found)
        return pa.table({"c1": pa.array([p[0] for p in pairs], pa.int64()), "c2": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _centres(chunk: int, pivots: int):
    """(cell, k, centre) of a cell's sample."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        most = int(np.clip(2 * table["n"][0].as_py() // chunk, 2, pivots))
        at = net(unit(_matrix(table["vector"])), most)
        lists = table["vector"].combine_chunks().take(pa.array(at))
        return pa.table({"cell": pa.array([key[0].as_py()] * len(at), pa.int64()), "k": pa.array(np.arange(len(at)), pa.int32()), "centre": lists})

    return run


def _nearest(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Which of their cell's centres the points are nearest to; a cell with one centre isn't split any further."""
    points = points.combine_chunks()
    if not len(points):
        k, last = np.zeros(0, np.int32), np.zeros(0, bool)
    else:
        centres = centres.combine_chunks().sort_by("k")
        k = (unit(_matrix(points["vector"])) @ unit(_matrix(centres["centre"])).T).argmax(1).astype(np.int32)
        last = np.full(len(points), len(centres) == 1)
    return pa.table({c: points[c] for c in ("node", "copies", "vector", "dim", "cell", "piece")} | {"k": pa.array(k), "last": pa.array(last)})


def chunks_of(points: DataFrame) -> DataFrame:
    """points (node, copies, vector, dim) with the chunk each belongs to: cells of at most about CHUNK vectors of one length, near to each other.

    A level is one shuffle of the vectors of cells that are still too large. Such a cell is dealt over pieces of CHUNK rows, each of
    which meets a copy of the cell's centres, so that no task holds a cell. Where vectors are so near to each other that
    there is one centre only, a cell is dealt by hash.
    """
    kind = points.schema["vector"].dataType.simpleString()
    columns = ["node", "copies", "vector", "dim", "cell"]
    state = cut(points.withColumn("cell", F.xxhash64("dim")), "cover-cells")
    done = []
    for level in range(DEPTH + 1):
        sizes = cut(state.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / CHUNK).cast("int")), "cover-sizes")
        sized = state.join(sizes, "cell")
        piece = F.pmod(F.xxhash64("node", F.lit(17)), F.col("pieces")).cast("int")
        if level == DEPTH or not sizes.where("pieces > 1").head(1):
            done.append(cut(sized.select(*columns[:-1], F.xxhash64("cell", piece).alias("chunk")), "cover-done"))
            drop(state, sizes)
            break
        done.append(cut(sized.where("pieces = 1").select(*columns[:-1], F.xxhash64("cell", F.lit(0)).alias("chunk")), "cover-done"))
        wide = sized.where("pieces > 1").withColumn("piece", piece)
        some = wide.where(F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("n") / SAMPLE)) == 0)
        centres = cut(some.select("cell", "node", "n", "vector").groupBy("cell").applyInArrow(_centres(CHUNK, PIVOTS), f"cell long, k int, centre {kind}"), "cover-centres")
        copied = centres.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "k", "centre")
        split = wide.select(*columns, "piece").groupBy("cell", "piece").cogroup(copied.groupBy("cell", "piece")).applyInArrow(
            _nearest, f"node long, copies long, vector {kind}, dim int, cell long, piece int, k int, last boolean"
        )
        split = cut(split, "cover-split")
        done.append(cut(split.where("last").select(*columns[:-1], F.xxhash64("cell", "piece").alias("chunk")), "cover-done"))
        narrower = cut(split.where("not last").select(*columns[:-1], F.xxhash64("cell", "k", F.lit(level)).alias("cell")), "cover-cells")
        drop(state, sizes, centres, split)
        state = narrower
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def embedding_links(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Two vectors of the same length are linked if their cosine, in double precision, is at least `threshold` (0 < t < 1).
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable, kept whether it is the
    row's own. Null and empty vectors, zero vectors, and those with null or non-finite components link with nothing. Equal vectors
    are compared once and count as often as they occur. An empty table gives an empty one; other columns are left out, so their
    names can't clash. Rows that repeat a vec_id are rows of their own, linked with
    each other if their vectors are; null vec_ids take part, but name a component only where it has no other.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding").cast("array<double>")
    valid = F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))
    keyed = vectors.select("vec_id", "embedding", F.when(valid, F.xxhash64("embedding")).alias("node"))
    classes = cut(
        keyed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("embedding").alias("vector")), "cover-classes"
    )
    kind = classes.schema["vector"].dataType.simpleString()
    placed = chunks_of(classes.select("node", "copies", "vector", F.size("vector").alias("dim")))
    trees = cut(
        placed.groupBy("chunk").applyInArrow(_grow, f"node long, dim int, chunk long, copies long, vector {kind}, path array<int>, reach double"), "cover-trees"
    )
    nodes = trees.where("reach is not null").select("node", "dim", F.col("chunk").alias("owner"), "vector", "reach", F.lit(1).alias("one"))
    blocks = cut(deal(nodes, ["dim"], [("one", NODES)]).drop("one"), "cover-nodes")
    known = blocks.select("dim", "chunk").distinct()
    both = known.select("dim", F.col("chunk").alias("c1")).join(known.select("dim", F.col("chunk").alias("c2")), "dim").where("c1 < c2").select("c1", "c2")
    work = with_units(known.select("chunk"), both).join(blocks, "chunk").select("unit", "side", "owner", "vector", "reach")
    pairs = cut(work.groupBy("unit").applyInArrow(_meeting(threshold), "c1 long, c2 long").distinct(), "cover-pairs")
    drop(blocks)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = with_units(trees.select("chunk").distinct(), pairs)
    work = units.join(trees, "chunk").drop("chunk", "dim", "reach").repartition(tasks, "unit")
    linked = cut(work.groupBy("unit").applyInArrow(_pairs(threshold), LINKED), "cover-linked")
    drop(trees)
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")), "cover")
    full = (
        classes.select("node", "copies", "rep")
        .join(linked.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = full.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = cut(full.join(named, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "cover-table")
    out = keyed.select("vec_id", "node").join(table, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_cover_tree(spark, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
