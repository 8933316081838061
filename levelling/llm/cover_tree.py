"""Near-duplicate vectors by dual traversal of cover trees (operator 3).

Vectors are compared as directions: cosine >= c is distance <= t on the unit
sphere.  Identical vectors are first folded into one class, so copies are
never compared with each other.  The top level of the tree is a set of pivots
chosen farthest-first from a bounded sample of ``SAMPLE`` classes; every class
is then placed with its nearest pivot, cells keep their true covering radius,
and large cells are split into parts by hash.  Inside a part, nested nets with
halving radii (1, 1/2, 1/4, ...) form the lower levels.  Pairs of parts whose
cells can be within t of each other meet in one task each; a class travels to
a foreign cell only if its own distance to that cell's pivot allows a link.
There the trees are traversed together: node pairs beyond the reach of their
covering radii are dropped, node pairs wholly within t are counted at once,
and the rest descends to exact cosines in double precision.  A task returns
link counts and a spanning forest, both linear in its rows; the components are
joined by ``components``.

Defined results: a null, empty, all-zero or non-finite vector and a vector with a
null id link with nothing (n_links 0; component_id is the id itself; kept is
true unless the id is null); rows repeating an id are separate vectors, each with
links and a component of its own; vectors of different lengths never link; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stash
from .vectors import directions, matrix, usable

SAMPLE = 4096       # classes that the pivots are chosen from, per vector length
MAX_PIVOTS = 256    # pivots of one vector length
BLOCK = 4096        # rows of one cover tree inside a part
EPS = 1e-4          # slack of single-precision bounds; exact cosines decide inside it
SLACK = 2e-6        # of squared distances from single-precision products
RADII = (1.0, 0.5, 0.25, 0.125)


def farthest_first(u: np.ndarray, k: int) -> np.ndarray:
    """Indices of k rows, each the farthest from those before it."""
    pick = [0]
    near = u @ u[0]
    while len(pick) < min(k, len(u)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-9:
            break
        pick.append(i)
        near = np.maximum(near, u @ u[i])
    return np.array(pick)


def nets(u: np.ndarray) -> np.ndarray:
    """Node of each row at each level: the row number of the node's centre (levels x rows).

    Level by level every node is covered greedily by balls of the level's
    radius, beginning with its own centre, so centres stay centres below.
    """
    n = len(u)
    g = u @ u.T
    up = np.zeros(n, np.int64)
    out = []
    for r in RADII:
        cut = 1 - r * r / 2
        now = np.empty(n, np.int64)
        order = np.argsort(up, kind="stable")
        firsts = np.flatnonzero(np.diff(up[order], prepend=-1))
        for lo, hi in zip(firsts, np.append(firsts[1:], n)):
            left = order[lo:hi]
            if len(left) == 1:
                now[left] = left
                continue
            c = up[left[0]]
            while len(left):
                near = g[c, left] >= cut
                near |= left == c
                now[left[near]] = c
                left = left[~near]
                if len(left):
                    c = left[0]
        out.append(now)
        up = now
    return np.array(out)


class Tree:
    """A block of rows with its nested nodes: centres, covering radii, weights, children."""

    def __init__(self, ids, mult, exact, node):
        self.ids, self.mult, self.exact = ids, mult, exact
        self.u = exact.astype(np.float32)
        self.links = np.zeros(len(ids), np.int64)
        self.levels = []
        every = np.vstack([node, np.arange(len(ids))[None, :]])
        for row in every:
            centre, of = np.unique(row, return_inverse=True)
            d = np.linalg.norm(exact - exact[row], axis=1)  # a single-precision product loses short distances
            radius = np.zeros(len(centre), np.float32)
            np.maximum.at(radius, of, d)
            self.levels.append((centre, of, radius, np.bincount(of, self.mult, len(centre)).astype(np.int64)))
        self.kids = []
        for (_, of, _, _), (low, _, _, _) in zip(self.levels, self.levels[1:]):
            parent = of[low]
            order = np.argsort(parent, kind="stable")
            self.kids.append((order, np.searchsorted(parent[order], np.arange(len(of) and of.max() + 2))))


def _descend(a: Tree, b: Tree, lev: int, i, j, same: bool):
    """All child pairs of the node pairs (i, j); within one node each pair once."""
    (ka, oa), (kb, ob) = a.kids[lev], b.kids[lev]
    na, nb = oa[i + 1] - oa[i], ob[j + 1] - ob[j]
    total = na * nb
    of = np.repeat(np.arange(len(i)), total)
    k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
    x, y = ka[oa[i][of] + k // nb[of]], kb[ob[j][of] + k % nb[of]]
    if same:
        keep = (i[of] != j[of]) | (x <= y)
        x, y = x[keep], y[keep]
    return x, y


def _by_radius(r: np.ndarray):
    """Rows grouped by covering radius, so that one wide node does not widen the reach of all."""
    group = np.searchsorted([1e-6, RADII[-2]], r)
    return [np.flatnonzero(group == k) for k in np.unique(group)]


def _apart(a: Tree, b: Tree, lev: int, i, j, step: int = 1 << 18):
    ca, cb = a.levels[lev][0], b.levels[lev][0]
    d = np.empty(len(i), np.float32)
    for lo in range(0, len(i), step):
        s = slice(lo, lo + step)
        d[s] = np.einsum("ij,ij->i", a.u[ca[i[s]]], b.u[cb[j[s]]])
    return np.sqrt(np.maximum(0, 2 - 2 * d))


def dual(a: Tree, b: Tree, cos: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Add the links between two blocks (or within one) to their counts; edges that connect them."""
    t = math.sqrt(max(0.0, 2 - 2 * cos))
    same = a is b
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    (ca, _, ra, _), (cb, _, rb, _) = a.levels[0], b.levels[0]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows in _by_radius(ra):
        for cols in _by_radius(rb):
            near = a.u[ca[rows]] @ b.u[cb[cols]].T
            reach = ra[rows] + (rb[cols].max() + t + EPS)
            cut = 1 - reach * reach / 2 - EPS
            hot = np.flatnonzero(near.max(axis=1) >= cut)
            x, y = np.nonzero(near[hot] >= cut[hot, None])
            found.append((rows[hot[x]], cols[y]))
    i, j = (np.concatenate(x) for x in zip(*found))
    if same:
        i, j = i[i <= j], j[i <= j]
    for lev in range(len(a.levels) - 1):
        (ca, oa, ra, wa), (cb, ob, rb, wb) = a.levels[lev], b.levels[lev]
        d = _apart(a, b, lev, i, j)
        if same:
            d[i == j] = 0
        most = np.sqrt(d * d + SLACK)
        if same:
            most[i == j] = 0
        bound = most + ra[i] + rb[j]
        live = np.sqrt(np.maximum(0, d * d - SLACK)) <= ra[i] + rb[j] + t + EPS
        whole = live & (bound <= t - EPS)
        wi, wj = i[whole], j[whole]
        if len(wi):
            gain_a, gain_b = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
            np.add.at(gain_a, wi, wb[wj])
            cross = ~(wi == wj) if same else np.ones(len(wi), bool)
            np.add.at(gain_b, wj[cross], wa[wi[cross]])
            a.links += gain_a[oa]
            b.links += gain_b[ob]
            if same:  # a node's own rows: not the row's own class
                a.links[np.isin(oa, wi[~cross])] -= a.mult[np.isin(oa, wi[~cross])]
            edges.append((ca[wi], cb[wj]))
            for tree, centre, of, w, left in ((a, ca, oa, wi, True), (b, cb, ob, wj, False)):
                rows = np.flatnonzero(np.isin(of, w))
                edges.append((rows, centre[of[rows]]) if same else
                             ((rows, -1 - centre[of[rows]]) if left else (-1 - rows, centre[of[rows]])))
        live &= ~whole
        i, j = _descend(a, b, lev, i[live], j[live], same)
    if same:
        i, j = i[i != j], j[i != j]
    near = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 17):
        s = slice(lo, lo + (1 << 17))
        near[s] = np.einsum("ij,ij->i", a.exact[i[s]], b.exact[j[s]]) >= cos
    i, j = i[near], j[near]
    np.add.at(a.links, i, b.mult[j])
    np.add.at(b.links, j, a.mult[i])
    edges.append((i, j))
    return edges


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the edges (u, v)."""
    lab = np.arange(n)
    while len(u):
        m = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _trees(t: pa.Table) -> list[Tree]:
    """The blocks of one part, from its rows; none if only the other part sent rows."""
    if not len(t):
        return []
    block = t["block"].to_numpy()
    ids, mult = t["rep"].to_numpy(), t["m"].to_numpy()
    exact = directions(matrix(t["vec"], np.float64))
    node = matrix(t["node"], np.int64).T
    out = []
    for k in np.unique(block):
        rows = np.flatnonzero(block == k)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        # nodes are named by the centre's id; rows that were not sent leave nodes without a centre:
        # the first row present then stands for it, which keeps radii true
        lev = []
        for names in node[:, rows]:
            _, first, of = np.unique(names, return_index=True, return_inverse=True)
            centre = first[of]
            pos = np.searchsorted(ids[rows], names)
            there = (pos < len(rows)) & (ids[rows][np.minimum(pos, len(rows) - 1)] == names)
            lev.append(np.where(there, np.minimum(pos, len(rows) - 1), centre))
        out.append(Tree(ids[rows], mult[rows], exact[rows], np.array(lev)))
    return out


_ROUTED = "rep long, m long, dim int, cell int, d0 double, vec array<double>"
_SENT = "part int, to array<int>, block int, rep long, m long, node array<long>, vec array<double>"
_FOUND = "u long, v long, links long"


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id",
                    vec_col: str = "embedding", max_part: int = 16384) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    spark = vectors.sparkSession
    ok = usable(F.col(vec_col)) & F.col(id_col).isNotNull()
    ok = ok & F.exists(F.col(vec_col), lambda x: x.cast("double") != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.when(ok, F.transform(F.col(vec_col), lambda x: x.cast("double"))).alias("vec"))
    classes = stash(rows.where("vec is not null").groupBy("vec")
                    .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"))
                    .withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers are stored with the rows
    classes = classes.withColumn("dim", F.size("vec"))
    total = {r["dim"]: r["n"] for r in
             classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
    cores = spark.sparkContext.defaultParallelism
    part = {d: min(max_part, max(1024, -(-n // (2 * cores)))) for d, n in total.items()}
    pivots = {}
    for d, n in total.items():
        s = (classes.where(F.col("dim") == d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE)
             .select("vec").collect())
        u = directions(np.array([r["vec"] for r in s], np.float64))
        pivots[d] = u[farthest_first(u, min(MAX_PIVOTS, -(-n // part[d])))]
    shared = spark.sparkContext.broadcast(pivots)

    def route(batches):
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                r = b.filter(pa.array(dims == d))
                u = directions(matrix(r["vec"], np.float64))
                near = u @ shared.value[d].T if d in shared.value else np.zeros((len(u), 1)) - 1
                cell = near.argmax(axis=1)
                d0 = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(u)), cell]))
                yield pa.RecordBatch.from_arrays(
                    [r["rep"], r["m"], r["dim"], pa.array(cell, pa.int32()), pa.array(d0), r["vec"]],
                    names=["rep", "m", "dim", "cell", "d0", "vec"])

    routed = stash(classes.select("rep", "m", "dim", "vec").mapInArrow(route, _ROUTED), "routed")
    cells = routed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d0").alias("r")) \
        .orderBy("dim", "cell").collect()
    plan, parts = {}, 0  # (dim, cell) -> first part, number of parts, radius
    for c in cells:
        k = -(-c["n"] // part.get(c["dim"], max_part))
        plan[c["dim"], c["cell"]] = (parts, k, c["r"])
        parts += k
    plans = spark.sparkContext.broadcast(plan)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + EPS
    table = spark.createDataFrame([(d, c, f, k) for (d, c), (f, k, _) in plan.items()] or [(0, 0, 0, 1)],
                                  "dim int, cell int, first int, k int")
    dealt = (routed.join(F.broadcast(table), ["dim", "cell"])  # at most MAX_PIVOTS cells of a length
             .withColumn("part", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
             .drop("first", "k"))

    def send(key, t):
        """Build the part's nets and address its rows to every pair of parts they can link in."""
        own = key[0].as_py()
        t = t.sort_by("rep")
        ids = t["rep"].to_numpy()
        u = directions(matrix(t["vec"], np.float64))
        block = np.arange(len(ids)) // BLOCK
        node = np.empty((len(RADII), len(ids)), np.int64)
        for k in range(int(block[-1]) + 1 if len(ids) else 0):
            s = slice(k * BLOCK, (k + 1) * BLOCK)
            node[:, s] = ids[s][nets(u[s].astype(np.float32))]
        dim, cell = t["dim"][0].as_py(), t["cell"][0].as_py()
        piv = shared.value.get(dim)
        goes = np.zeros((len(ids), sum(k for (d, _), (_, k, _) in plans.value.items() if d == dim)), bool)
        names, at = [], 0
        for (d, c), (f, k, r) in plans.value.items():
            if d != dim:
                continue
            names += range(f, f + k)
            if c == cell:
                goes[:, at:at + k] = True
            elif np.sqrt(max(0, 2 - 2 * (piv[c] @ piv[cell]))) <= r + plans.value[dim, cell][2] + reach:
                far = np.sqrt(np.maximum(0, 2 - 2 * (u @ piv[c])))
                goes[:, at:at + k] = (far <= r + reach)[:, None]
            at += k
        to = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(goes.sum(axis=1))), pa.int32()),
            pa.array(np.array(names)[np.nonzero(goes)[1]], pa.int32()))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(ids) + 1) * len(RADII), pa.int32()), pa.array(node.T.ravel()))
        return pa.table({"part": pa.array(np.full(len(ids), own), pa.int32()), "to": to,
                         "block": pa.array(block, pa.int32()), "rep": t["rep"], "m": t["m"],
                         "node": lists, "vec": t["vec"]})

    def meet(key, t):
        lo, hi = key[0].as_py(), key[1].as_py()
        side = t["side"].to_numpy()
        left = _trees(t.filter(pa.array(side == 0)))
        right = left if lo == hi else _trees(t.filter(pa.array(side == 1)))
        base, n = {}, 0
        for tree in [*left, *([] if lo == hi else right)]:
            base[id(tree)] = n
            n += len(tree.ids)
        us, vs = [], []
        for x, a in enumerate(left):
            for b in (left[x:] if lo == hi else right):
                for u, v in dual(a, b, cosine):
                    # a negative row number -1-r names row r of the other block
                    us.append(np.where(u < 0, base[id(b)] - 1 - u, base[id(a)] + u))
                    if a is b:
                        vs.append(base[id(a)] + v)
                    else:
                        own = base[id(a)] - 1 - v
                        vs.append(np.where(v < 0, own, base[id(b)] + v))
        ids = np.concatenate([x.ids for x in [*left, *([] if lo == hi else right)]] or [np.zeros(0, np.int64)])
        links = np.concatenate([x.links for x in [*left, *([] if lo == hi else right)]] or [np.zeros(0, np.int64)])
        root = _forest(n, np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)]))
        rows = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.table({"u": ids[rows], "v": ids[root[rows]], "links": links[rows]})

    sent = (dealt.groupBy("part").applyInArrow(send, _SENT)
            .withColumn("other", F.explode("to"))
            .select(F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                    (F.col("part") > F.col("other")).cast("int").alias("side"),
                    "block", "rep", "m", "node", "vec"))
    found = stash(sent.groupBy("lo", "hi").applyInArrow(meet, _FOUND), "links")
    comp = components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    known = stash(classes.select("vec", "rep", "first", "m")
                  .join(links, F.col("rep") == F.col("u"), "left")
                  .join(comp, F.col("rep") == F.col("node"), "left")
                  .select("vec", "first", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                          F.coalesce("component", "rep").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select("vec", "n_links", "component_id")
    linked = rows.where("vec is not null").join(known, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
