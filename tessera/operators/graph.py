"""Similarity graphs as tables: edges (a, b, weight) with a < b, nodes (id)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegralType

from tessera.storage import contained, materialize


#: Edges of a block on average, and pairs of edges that are held at once, where triangles are counted.
EDGES, TOGETHER = 1 << 20, 1 << 21
#: Where ranks go round: nodes whose values a task holds as one vector (16 MB), edges of a packed row, values of a slice.
NODES, PACKED, SLICE = 1 << 21, 1 << 20, 1 << 16
#: Edges that a task holds beside its forest before it thins them out.
HELD = 1 << 22
#: Stands for no id beside whole numbers.
NONE = -(1 << 63)


def edges_from_pairs(pairs: DataFrame, k: int = 5, least: float = 0.32) -> DataFrame:
    """G1: pairs (source, target, similarity) among the k nearest of a source or at least ``least``, as undirected edges."""
    w = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    p = pairs.where("similarity > 0").withColumn("r", F.row_number().over(w))
    p = p.withColumn("near", F.col("r") <= k).withColumn("over", F.col("similarity") >= least).where("near or over")
    return p.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.max("similarity").alias("weight"), F.bool_or("over").alias("by_threshold"), F.bool_or("near").alias("by_top_k"), (F.count_if("near") == 2).alias("mutual_top_k")
    ).withColumn("distance", 1 - F.col("weight"))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("a", "b", *more).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))


def degrees(edges: DataFrame) -> DataFrame:
    """The edges are read once, and summed where they are read before anything is shuffled."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


@contained
def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(id, rank), weighted; dangling mass goes to all nodes alike.

    The edges are read once and packed where they are read, in one direction, as rows of up to PACKED edges between node
    numbers; no edge is shuffled. A round scans these rows: a task adds up what its edges send to either end in one vector
    of all nodes, and slices of the tasks' vectors are summed. Over NODES different nodes, or if their ids are no whole
    numbers, a round joins tables instead.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    kind, size = nodes.schema["id"].dataType, nodes.select("id").where("id is not null").distinct().count() + 1
    if size > NODES or not isinstance(kind, IntegralType):
        return _pagerank_by_tables(nodes, edges, n, rounds, damping, tolerance)
    known = materialize(_numbers(nodes), "nodes")
    packed = materialize(_packed(edges, known), "edges", rows_a_file=8)
    row = lambda what, v: pa.RecordBatch.from_arrays([pa.array([what]), pa.array([v.tobytes()], pa.binary())], ["what", "v"])

    def start(batches):
        held = _vectors(batches)
        degree, count = held["got"], held["count"].astype(float)
        scale = np.divide(count, degree, out=np.zeros(size), where=degree != 0)
        rank = np.full(size, 1.0 / n)
        yield from (row("scale", scale), row("rank", rank), row("y", rank * scale))

    def update(batches):
        held = _vectors(batches)
        old, scale, count = held["rank"], held["scale"], held["count"]
        loose = float((count * old)[scale == 0].sum())
        rank = (1 - damping) / n + damping * (held["got"] + loose / n)
        yield from (row("rank", rank), row("y", rank * scale), row("moved", np.array([float((count * np.abs(rank - old)).sum())])))

    def after(step, held, *more):
        tables = [_sent(packed, held.where("what = 'y'"), size), counts, *more]
        return materialize(reduce(DataFrame.unionByName, tables).repartition(1).mapInArrow(step, "what string, v binary"), "pagerank")

    counts = known.where("what = 'count'")
    state = after(start, known)
    scale = state.where("what = 'scale'")
    for _ in range(rounds):
        state = after(update, state, scale, state.where("what = 'rank'"))
        if tolerance is not None and np.frombuffer(state.where("what = 'moved'").first()["v"])[0] < n * tolerance:
            break

    def rows(batches):
        held = _vectors(batches)
        ids = np.append(held["ids"], 0)
        at = np.repeat(np.arange(size), held["count"])
        for a in range(0, len(at), 10_000):
            some = at[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], mask=some == size - 1), pa.array(held["rank"][some])], ["id", "rank"])

    return known.where("what in ('ids', 'count')").unionByName(state.where("what = 'rank'")).repartition(1).mapInArrow(rows, "id long, rank double").select(F.col("id").cast(kind).alias("id"), "rank")


def _vectors(batches) -> dict[str, np.ndarray]:
    """Rows (what, v) as vectors by name; the slices of ``got`` as one."""
    held, slices = {}, {}
    for batch in batches:
        for what, v in zip(batch.column("what").to_pylist(), batch.column("v"), strict=True):
            v = np.frombuffer(v.as_py(), np.int64 if what in ("ids", "count") else np.float64)
            if what.isdigit():
                slices[int(what)] = v
            else:
                held[what] = v
    if "count" in held:
        got = np.zeros(len(held["count"]))
        for a, v in slices.items():
            got[a : a + len(v)] = v
        got[-1] = 0  # what stands for ends that are no nodes, and for nodes without an id
        held["got"] = got
    return held


def _numbers(nodes: DataFrame) -> DataFrame:
    """(what, v): the different ids in order, how often each stands (last: how often none), and ones. Of bounded size."""

    def pack(batches):
        ids, count, none = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            there = batch.filter(batch.column(0).is_valid())
            none += sum(batch.column(1).to_pylist()) - sum(there.column(1).to_pylist())
            ids.append(there.column(0).to_numpy())
            count.append(there.column(1).to_numpy())
        ids, count = np.concatenate(ids), np.concatenate(count)
        order = np.argsort(ids)
        vectors = {"ids": ids[order], "count": np.append(count[order], none), "y": np.ones(len(ids) + 1)}
        yield pa.RecordBatch.from_arrays([pa.array(list(vectors)), pa.array([v.tobytes() for v in vectors.values()], pa.binary())], ["what", "v"])

    return nodes.groupBy(F.col("id").cast("long").alias("id")).count().repartition(1).mapInArrow(pack, "what string, v binary")


def _packed(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, w): edges between numbers of nodes, up to PACKED in a row; weights of six places as whole millionths."""

    def row(*columns):
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["a", "b", "w"])

    def pack(batches):
        held, count = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            count += batch.num_rows
            if count >= PACKED:
                yield row(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
        if count:
            yield row(*map(np.concatenate, zip(*held, strict=True)))

    def number(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("ids", "a", "b"))
                w, ends = np.frombuffer(batch.column("w")[k].as_buffer()), []
                for end in (a, b):
                    at = np.searchsorted(ids, end)
                    there = (at < len(ids)) & (end != NONE)
                    there[there] = ids[at[there]] == end[there]
                    ends.append(np.where(there, at, len(ids)))
                order = np.lexsort(ends[::-1])
                whole = np.clip(np.rint(w * 1e6), -(1 << 31) + 1, (1 << 31) - 1)
                w = whole.astype(np.int32) if np.array_equal(whole / 1e6, w) else w
                yield row(*(end[order].astype(np.int32) for end in ends), w[order])

    ends = [F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c) for c in "ab"]
    rows = edges.select(*ends, F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w")).mapInArrow(pack, "a binary, b binary, w binary")
    ids = known.where("what = 'ids'").select(F.col("v").alias("ids")).coalesce(1).hint("shuffle_replicate_nl")
    return rows.crossJoin(ids).mapInArrow(number, "a binary, b binary, w binary")


def _sent(packed: DataFrame, y: DataFrame, size: int) -> DataFrame:
    """(what, v): slices, by where they begin, of the adjacency times ``y`` (one row). A task holds two vectors of all nodes."""

    def send(batches):
        got, some = np.zeros(size), False
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in "ab")
                w, v = batch.column("w")[k].as_buffer(), np.frombuffer(batch.column("v")[k].as_buffer())
                w = np.frombuffer(w, np.int32) / 1e6 if len(w) == 4 * len(a) else np.frombuffer(w)
                got += np.bincount(a, w * v[b], size)
                got += np.bincount(b, w * v[a], size)
                some = True
        if some:
            yield from sliced({a: got[a : a + SLICE] for a in range(0, size, SLICE)})

    def sliced(parts):
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(k)]), pa.array([v.tobytes()], pa.binary())], ["what", "v"])

    def add(batches):
        held = {}
        for batch in batches:
            for k, v in zip(batch.column("what").to_pylist(), batch.column("v"), strict=True):
                v = np.frombuffer(v.as_buffer())
                held[k] = held[k] + v if k in held else v.copy()
        yield from sliced(held)

    met = packed.crossJoin(y.select("v").coalesce(1).hint("shuffle_replicate_nl"))
    return met.mapInArrow(send, "what string, v binary").repartition("what").mapInArrow(add, "what string, v binary")


def _pagerank_by_tables(nodes: DataFrame, edges: DataFrame, n: int, rounds: int, damping: float, tolerance: float | None) -> DataFrame:
    """Lineage is cut by written tables every round."""
    edges = materialize(edges.select("a", "b", "weight"), "edges")
    total = materialize(degrees(edges).select("id", "weighted_degree"), "degrees")
    out = materialize(both_ways(edges, "weight").join(total.withColumnRenamed("id", "a"), "a").select("a", "b", (F.col("weight") / F.col("weighted_degree")).alias("share")), "pagerank")
    rank = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        sent = out.join(rank.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = rank.join(total, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        new = nodes.select("id").join(sent, "id", "left").crossJoin(F.broadcast(loose)).join(rank.withColumnRenamed("rank", "old"), "id")
        new = materialize(new.select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"), "old"), "pagerank")
        rank = new.select("id", "rank")
        if tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
            break
    return rank


@contained
def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 5000, tolerance: float = 1e-10, basis: int = 24) -> DataFrame:
    """(id, x): the dominant eigenvector of the weighted adjacency, of length 1, from the uniform vector.

    Where plain iteration takes a join for each of hundreds of rounds, each join here adds a vector to a basis of up to
    ``basis`` (a node's row holds its component of each), and the best vector of their span is found from their inner
    products and those with their images, ``basis`` squared numbers each, on the driver. That vector starts the next cycle, until what the
    adjacency changes in it is below ``tolerance`` of the eigenvalue, or ``rounds`` joins are done. Nodes without edges
    tend to 0; a graph without edges keeps the uniform vector.
    """
    both = materialize(both_ways(edges, "weight"), "eigen")
    n = nodes.count()
    x, done = nodes.select("id", F.lit(n**-0.5 if n else 0.0).alias("x")), 0
    while True:
        held, q, t, gram = x.select("id", F.array("x").alias("v")), 0, np.zeros((basis, basis)), np.zeros((basis, basis))
        while q < basis:
            got = both.join(held.select(F.col("id").alias("b"), F.element_at("v", -1).alias("last")), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("last") * F.col("weight")).alias("w"))
            step = materialize(held.join(got, "id", "left").select("id", "v", F.coalesce("w", F.lit(0.0)).alias("w")), "eigen")
            dots = step.withColumn("last", F.col("v")[q]).agg(*(F.sum(F.col(c) * F.col("v")[i]) for c in ("w", "last") for i in range(q + 1)), F.sum(F.col("w") * F.col("w"))).first()
            if not dots[-1]:  # no nodes or no edges
                return x
            seen, size = np.array(dots[: q + 1]), dots[-1]
            t[: q + 1, q] = t[q, : q + 1] = seen
            gram[: q + 1, q] = gram[q, : q + 1] = dots[q + 1 : -1]
            q, done = q + 1, done + 1
            lower = np.linalg.inv(np.linalg.cholesky(gram[:q, :q]))  # the basis is orthogonal but for rounding; this takes that out
            value, vector = np.linalg.eigh(lower @ t[:q, :q] @ lower.T)
            vector = lower.T @ vector[:, -1]
            part = lower.T @ (lower @ seen)
            turned = F.col("w") - sum((F.col("v")[i] * float(d) for i, d in enumerate(part)), F.lit(0.0))
            rest = size - float(seen @ part)
            if rest < 1e-6 * size:  # the difference of two nearly equal numbers: summed itself
                rest = step.agg(F.sum(turned * turned)).first()[0]
            left = max(0.0, rest) ** 0.5
            if left * abs(vector[-1]) < tolerance * abs(value[-1]) or left < 1e-15 * size**0.5 or done >= rounds:
                break
            held = step.select("id", F.array_append("v", turned / left).alias("v"))
        best = sum((F.col("v")[i] * float(c) for i, c in enumerate(vector)), F.lit(0.0))
        raw = materialize(step.select("id", best.alias("x")), "eigen")
        size = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sum("x")).first()
        x = raw.select("id", F.greatest(F.col("x") / (size[0] * (1 if size[1] >= 0 else -1)), F.lit(0.0)).alias("x"))
        if left * abs(vector[-1]) < tolerance * abs(value[-1]) or left < 1e-15 * float(dots[-1]) ** 0.5 or done >= rounds:
            return x


def _forest(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges of the least spanning forest by (d, a, b), by Borůvka; they are in that order."""
    order = np.lexsort((b, a, d))
    ids, ends = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    component, live, kept = np.arange(len(ids)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = component[u[live]], component[v[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return order[np.sort(np.concatenate(kept))]
        first = np.full((2, len(ids)), len(a))
        first[0, x[::-1]], first[1, y[::-1]] = live[::-1], live[::-1]  # the last that is written is the first edge
        best = first.min(axis=0)
        c = np.flatnonzero(best < len(a))
        e = best[c]
        kept.append(np.unique(e))
        parent = np.arange(len(ids))
        parent[c] = np.where(component[u[e]] == c, component[v[e]], component[u[e]])
        mutual = c[(parent[parent[c]] == c) & (c < parent[c])]
        parent[mutual] = mutual
        while (parent != (up := parent[parent])).any():
            parent = up
        component = parent[component]


def thinned(edges: DataFrame) -> DataFrame:
    """Those edges (a, b, distance; whole ids) that are in the least spanning forest of what their task reads: a forest of all
    edges has no others. A task sends fewer edges than there are nodes, and holds as many and HELD."""

    def run(batches):
        held, count, least = [], 0, 0

        def thin():
            t = pa.Table.from_batches(held).combine_chunks()
            a, b = (t.column(c).to_numpy() for c in "ab")
            return t.take(pa.array(_forest(t.column("distance").fill_null(-np.inf).to_numpy(), a, b))).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count - least >= HELD:
                held = thin()
                count = least = sum(b.num_rows for b in held)
        if count:
            for batch in thin():
                for start in range(0, batch.num_rows, 10_000):
                    yield batch.slice(start, 10_000)

    rows = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "distance")
    return rows.mapInArrow(run, "a long, b long, distance double")


@contained
def linked(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the smallest id that it reaches.

    Each round gives a node the least label around it, then the label of its label (so long chains halve), until no
    label changes. Null ends are left out; loops and repeated edges do no harm; no edges give no rows.
    """
    known = edges.where("a is not null and b is not null and a <> b")
    kinds = edges.schema["a"].dataType, edges.schema["b"].dataType
    if kinds[0] == kinds[1] and isinstance(kinds[0], IntegralType):
        some = thinned(known.select("a", "b", F.lit(0.0).alias("distance")))
        known = some.select(*(F.col(c).cast(kinds[0]).alias(c) for c in "ab"))
    both = materialize(both_ways(known).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = materialize(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")), "step")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = materialize(step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        labels = moved.select("id", "component")
        if not moved.where("component <> old").limit(1).count():
            return labels


@contained
def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the smallest id reachable; a node without edges is its own."""
    return nodes.select("id").join(linked(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@contained
def core_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, core): each node's number falls from its degree to the most k for which k neighbours have k or more,
    round by round, until none changes; that fixed point is the core number. Neighbours are counted by value, so a node
    of many neighbours is a few rows. Loops and repeated edges do no harm; a node without edges has 0."""
    both = materialize(both_ways(edges.where("a is not null and b is not null and a <> b")).distinct(), "core")
    known = materialize(nodes.select("id").distinct().join(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("core")), "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core")), "core")
    at_least = Window.partitionBy("id").orderBy(F.desc("near"))
    while True:
        near = both.join(known.select(F.col("id").alias("b"), F.col("core").alias("near")), "b").groupBy(F.col("a").alias("id"), "near").agg(F.count("*").alias("n"))
        most = near.withColumn("n", F.sum("n").over(at_least)).groupBy("id").agg(F.max(F.least("near", "n")).alias("most"))
        step = materialize(known.withColumnRenamed("core", "old").join(most, "id", "left").select("id", F.least("old", F.coalesce("most", "old")).alias("core"), "old"), "core")
        known = step.select("id", "core")
        if not step.where("core < old").limit(1).count():
            return known


def _block_triangles(xy: list, yz: list, xz: list):
    """(ids, sums) at each corner of the triangles x, y, z whose sides lie in three blocks of edges (first, second, weight)."""
    (xs, at_x), (zs, at_z) = (np.unique(side, return_inverse=True) for side in xz[:2])
    ys = np.unique(yz[0])
    keys, inverse = np.unique(at_x * len(zs) + at_z, return_inverse=True)
    weight = np.bincount(inverse, xz[2])

    def known(edges, *ends):
        """The edges with their ends' places, of those that are among ``ends``."""
        places = [np.minimum(np.searchsorted(ids, side), len(ids) - 1) for side, ids in zip(edges, ends, strict=False)]
        keep = np.logical_and(*(ids[at] == side for side, at, ids in zip(edges, places, ends, strict=False)))
        return [c[keep] for c in (*places, edges[2])]

    x, y, w = known(xy, xs, ys)
    y2, z, w2 = known(yz, ys, zs)
    order = np.argsort(y2, kind="stable")
    y2, z, w2 = y2[order], z[order], w2[order]
    first = np.searchsorted(y2, y)
    count = np.searchsorted(y2, y, side="right") - first
    ends, sums = np.cumsum(count), [np.zeros(len(ids)) for ids in (xs, ys, zs)]
    start = 0
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
        n = count[start:stop]
        one = np.repeat(np.arange(start, stop), n)
        two = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[one]
        key = x[one] * len(zs) + z[two]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == key)
        one, two = one[hit], two[hit]
        g = w[one] * w2[two] * weight[at[hit]]
        for total, corner in zip(sums, (x[one], y[one], z[two]), strict=True):
            total += np.bincount(corner, g, len(total))
        start = stop
    yield from zip((xs, ys, zs), sums, strict=True)


def triangles(edges: DataFrame) -> DataFrame:
    """(id, t): the sum over a node's triangles of the product of their sides' ``w``, for edges (a, b, w) of whole ids.

    Nodes are dealt into blocks by hash and stand in the order of (block, id); a triangle's sides lie in three blocks of
    edges, which meet in one task. What is shuffled is each edge once for each block of nodes, never a pair of edges.
    """
    parts, count = 1, edges.count()
    while parts * (parts + 1) // 2 * EDGES < count:
        parts += 1
    end = lambda c: F.struct(F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(parts)).alias("block"), F.col(c).cast("long").alias("id"))
    e = edges.where("a <> b").select(F.least(end("a"), end("b")).alias("x"), F.greatest(end("a"), end("b")).alias("y"), "w").select(F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.col("x.id").alias("x"), F.col("y.id").alias("y"), "w")

    def runs(batches, keys):
        """The columns of each run of rows of the same keys, in the order that they come."""
        now, held = None, []
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            changed = np.logical_or.reduce([np.diff(c) != 0 for c in columns[:keys]])
            cut = [0, *(np.flatnonzero(changed) + 1).tolist(), b.num_rows]
            for start, stop in zip(cut, cut[1:], strict=False):
                if start == stop:
                    continue
                key = [int(c[start]) for c in columns[:keys]]
                if held and key != now:
                    yield now, [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                now = key
                held.append([c[start:stop] for c in columns[keys:]])
        if held:
            yield now, [np.concatenate(c) for c in zip(*held, strict=True)]

    def pack(batches):
        for (i, j), columns in runs(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([j], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["i", "j", "x", "y", "w"])

    def unpacked(batches):
        held = []
        for b in batches:
            for k in range(b.num_rows):  # three rows of a meeting follow each other
                role = b.column(1)[k].as_py()
                if held and held[0] != b.column(0)[k].as_py():
                    held = []
                held = held or [b.column(0)[k].as_py(), {}]
                held[1][role] = [np.frombuffer(b.column(2 + c)[k].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.float64))]
                if len(held[1]) == 3:
                    for ids, total in _block_triangles(*(held[1][r] for r in range(3))):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "t"])
                    held = []

    blocks = materialize(e.repartition(min(parts * (parts + 1) // 2, 1000), "i", "j").sortWithinPartitions("i", "j").mapInArrow(pack, "i long, j long, x binary, y binary, w binary"), "blocks")
    upto = lambda a, b: F.explode(F.sequence(a, b))
    last = F.lit(parts - 1).cast("long")
    name = lambda i, j, k: ((i * parts + j) * parts + k).alias("meeting")
    i, j, other, packed = F.col("i"), F.col("j"), F.col("other"), ("x", "y", "w")
    roles = (
        blocks.withColumn("other", upto(j, last)).select(name(i, j, other), F.lit(0).alias("role"), *packed),  # the sides x, y
        blocks.withColumn("other", upto(F.lit(0).cast("long"), i)).select(name(other, i, j), F.lit(1).alias("role"), *packed),  # y, z
        blocks.withColumn("other", upto(i, j)).select(name(i, other, j), F.lit(2).alias("role"), *packed),  # x, z
    )
    meetings = roles[0].unionByName(roles[1]).unionByName(roles[2])
    meetings = meetings.repartition(max(1, min(parts * (parts + 1) * (parts + 2) // 6, 1000)), "meeting").sortWithinPartitions("meeting", "role")
    return meetings.mapInArrow(unpacked, "id long, t double").groupBy("id").agg(F.sum("t").alias("t")).where("t > 0")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted clustering coefficient, triangles by the geometric mean of their weights over the largest weight."""
    top = edges.agg(F.max("weight").alias("top"))
    t = triangles(edges.crossJoin(F.broadcast(top)).select("a", "b", F.cbrt(F.col("weight") / F.col("top")).alias("w")))
    d = degrees(edges).select("id", "degree")
    ratio = 2 * F.col("t") / (F.col("degree") * (F.col("degree") - 1))
    return nodes.select("id").join(d, "id", "left").join(t, "id", "left").select("id", F.coalesce(F.when(F.col("degree") > 1, ratio), F.lit(0.0)).alias("clustering"))


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, of the weighted graph under ``groups`` (id, community)."""
    m = edges.agg(F.sum("weight").alias("m"))
    ga, gb = groups.selectExpr("id as a", "community as ca"), groups.selectExpr("id as b", "community as cb")
    inner = edges.join(ga, "a").join(gb, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    deg = degrees(edges).join(groups, "id").groupBy("community").agg(F.sum("weighted_degree").alias("d"))
    part = deg.join(inner, "community", "left").crossJoin(F.broadcast(m)).select((F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return part.agg(F.sum("q").alias("modularity"))


def between_groups(edges: DataFrame) -> DataFrame:
    """(la, lb, edges, weight, most): edges with the groups of their ends as a row for each two groups."""
    return edges.groupBy("la", "lb").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.max("weight").alias("most"))


def modularity_between(groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """As ``modularity``, from the written rows of ``between_groups``."""
    m = groups.agg(F.sum("weight").alias("m"))
    inner = groups.where("la = lb").select(F.col("la").alias("community"), F.col("weight").alias("w"))
    deg = groups.select(F.explode(F.array("la", "lb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("d"))
    part = deg.join(inner, "community", "left").crossJoin(F.broadcast(m)).select((F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return part.agg(F.sum("q").alias("modularity"))


@contained
def spanning_forest(nodes: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame:
    """Minimum spanning forest on ``distance`` by Borůvka; ties by (distance, a, b), so the forest is unique. ``whole``:
    all ends are known to be nodes, so the edges (then read once, of whole ids) are thinned out where they are read."""
    whole = whole and all(isinstance(edges.schema[c].dataType, IntegralType) for c in "ab") and isinstance(edges.schema["distance"].dataType, DoubleType)
    e = materialize(thinned(edges) if whole else edges.select("a", "b", "distance"), "forest")
    labels, picked = nodes.select("id", F.col("id").alias("component")), None
    while True:
        live = e.join(labels.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a").join(labels.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b").where("ca <> cb")
        live = materialize(live, "forest")
        if not live.limit(1).count():
            break
        ends = live.select(F.col("ca").alias("c"), "distance", "a", "b").unionByName(live.select(F.col("cb").alias("c"), "distance", "a", "b"))
        best = ends.groupBy("c").agg(F.min(F.struct("distance", "a", "b")).alias("e")).select("e.*").distinct()
        picked = materialize(best if picked is None else picked.unionByName(best), "forest")
        labels = components(nodes, picked)
    return picked if picked is not None else e.where("false").select("distance", "a", "b")


def exchange_rows(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables as graph tools read them from CSV."""
    e = edges.select(F.col("a").alias("Source"), F.col("b").alias("Target"), F.col("weight").alias("Weight"), F.lit("Undirected").alias("Type"), F.format_string("%d-%d", "a", "b").alias("Id"))
    return nodes.select(F.col("id").alias("Id"), F.col(label).alias("Label")), e


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as ordered text rows (part, key, line): write by part and key."""
    line = lambda part, key, text: (F.lit(part).alias("part"), key.alias("key"), text.alias("line"))
    n = nodes.select(*line(1, F.col("id").cast("string"), F.format_string('<node id="%d"/>', F.col("id"))))
    e = edges.select(*line(2, F.concat_ws("-", "a", "b"), F.format_string('<edge source="%d" target="%d"><data key="weight">%s</data></edge>', F.col("a"), F.col("b"), F.col("weight").cast("string"))))
    spark = nodes.sparkSession
    head = spark.range(1).select(*line(0, F.lit(""), F.lit('<graphml><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">')))
    return head.unionByName(n).unionByName(e).unionByName(spark.range(1).select(*line(3, F.lit(""), F.lit("</graph></graphml>"))))


def gexf(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """GEXF 1.2 as ordered text rows (part, key, line): write by part and key. Labels are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("key"), F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('" label="'), safe(F.coalesce(F.col(label).cast("string"), F.lit(""))), F.lit('"/>')).alias("line"))
    ends = F.concat_ws("-", "a", "b")
    e = edges.select(F.lit(3).alias("part"), ends.alias("key"), F.concat(F.lit('<edge id="'), ends, F.lit('" source="'), F.col("a").cast("string"), F.lit('" target="'), F.col("b").cast("string"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    fixed = lambda part, text: nodes.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(text).alias("line"))
    head = fixed(0, '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph mode="static" defaultedgetype="undirected"><nodes>')
    return head.unionByName(n).unionByName(fixed(2, "</nodes><edges>")).unionByName(e).unionByName(fixed(4, "</edges></graph></gexf>"))


def network_view(nodes: DataFrame, metrics: DataFrame, points: DataFrame, size: str, label: str) -> DataFrame:
    """(id, x, y, label, size) of every node: its place from ``points`` (id, x, y), its metric scaled to [0, 1];
    a node without metrics counts as the least."""
    from tessera.operators.tables import min_max

    j = nodes.select("id", label).join(points, "id", "left").join(metrics.select("id", size), "id", "left")
    low = metrics.agg(F.min(size).alias("_low"))
    j = j.crossJoin(F.broadcast(low)).withColumn(size, F.coalesce(size, "_low")).drop("_low")
    return min_max(j, size, "_size").select("id", "x", "y", F.col(label).alias("label"), F.col("_size").alias("size"))
