"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Nearness is the largest inner product. A shard's vectors get one more component
that brings them to one norm, so that the largest inner product is the smallest
distance and one graph serves both.

Building a shard's graph starts from random edges. For every node a greedy beam
search over the graph so far proposes neighbours; relaxed pruning goes through
them from near to far and drops each one that a kept neighbour is nearer to,
``alpha`` times over, so that edges point in different directions; the kept
edges are also added the other way round, and a full node is pruned again.
Queries are beam searches from the node nearest to the mean, in every shard;
what they find is scored again in double precision and merged.

Vectors are dealt to shards of about ``shard_size`` by a hash of the vector's
first id, queries to blocks of about ``block_size``; a task holds one shard and
one block. Equal vectors are one node with the ``k + 1`` smallest ids, which is
all that a result can hold of them, so no vector is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfade.sources.staging import stage

#: Partial lists of the ids of one vector, before the last one.
_SALTS = 32


@dataclass(frozen=True)
class Graph:
    """How graphs are built and searched."""

    degree: int = 24  # edges of a node after pruning
    room: int = 40  # edges of a node before it is pruned again
    build_beam: int = 48
    query_beam: int = 160
    alpha: float = 1.2
    batch: int = 512


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """Rows of one squared norm, in single precision."""
    rest = np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def _beam(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, products)`` of the nearest nodes that a beam search meets, nearest first; -1 pads.

    All queries take a step together: each looks at the neighbours of its
    ``ahead`` nearest nodes not looked at yet.
    """
    n, m = len(x), len(q)
    ids = np.full((m, width), -1, dtype=np.int32)
    near = np.full((m, width), -np.inf, dtype=np.float32)
    done = np.zeros((m, width), dtype=bool)
    ids[:, 0], near[:, 0] = entry, q @ x[entry]
    met = np.zeros((m, n + 1), dtype=bool)
    met[:, [entry, n]] = True  # node n stands for no edge
    rows = np.arange(m)
    while len(rows):
        todo = (ids[rows] >= 0) & ~done[rows]
        live = todo.any(axis=1)
        rows, todo = rows[live], todo[live]
        if not len(rows):
            break
        first = todo & (np.cumsum(todo, axis=1) <= ahead)
        done[rows] |= first
        at, column = np.nonzero(first)
        met_by, seen = rows[at], edges[ids[rows[at], column]]
        fresh = ~met[met_by[:, None], seen]
        at, met_by, seen = np.repeat(at, fresh.sum(axis=1)), np.repeat(met_by, fresh.sum(axis=1)), seen[fresh]
        pair = np.unique(at.astype(np.int64) * (n + 1) + seen)  # two nodes may share a neighbour
        at, seen = pair // (n + 1), (pair % (n + 1)).astype(np.int32)
        met_by = rows[at]
        met[met_by, seen] = True
        product = np.einsum("ij,ij->i", x[seen], q[met_by])
        slot = np.arange(len(at)) - np.searchsorted(at, at)
        most = int(slot.max()) + 1 if len(slot) else 0
        if not most:
            continue
        new_ids = np.full((len(rows), most), -1, dtype=np.int32)
        new_near = np.full((len(rows), most), -np.inf, dtype=np.float32)
        new_ids[at, slot], new_near[at, slot] = seen, product
        all_near = np.concatenate([near[rows], new_near], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        near[rows] = np.take_along_axis(all_near, order, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_ids], axis=1), order, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros_like(new_ids, bool)], axis=1), order, axis=1)
    return ids, near


def _prune(x: np.ndarray, norm2: float, nodes: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node out of ``ids``; ``len(x)`` pads."""
    n = len(x)
    own = x[nodes]
    known = (ids >= 0) & (ids < n) & (ids != nodes[:, None])
    ids = np.where(known, ids, 0)
    product = np.where(known, np.einsum("bcd,bd->bc", x[ids], own), -np.inf)
    order = np.argsort(-product, axis=1, kind="stable")
    ids, product = np.take_along_axis(ids, order, axis=1), np.take_along_axis(product, order, axis=1)
    alive = product > -np.inf
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]  # an id listed twice has one product
    theirs = x[ids]
    between = np.maximum(2 * norm2 - 2 * theirs @ theirs.transpose(0, 2, 1), 0)
    to_node = np.maximum(2 * norm2 - 2 * product, 0)
    kept = np.full((len(nodes), degree), n, dtype=np.int32)
    rows = np.arange(len(nodes))
    for slot in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        kept[some, slot] = ids[rows, pick][some]
        alive &= ~((alpha * alpha * between[rows, pick] <= to_node) & some[:, None])
        alive[rows, pick] = False
    return kept


def build(x: np.ndarray, how: Graph, seed: int = 11) -> tuple[np.ndarray, int]:
    """``(edges, entry)`` of the nodes ``x``, rows of one norm; ``len(x)`` pads the edges."""
    n = len(x)
    norm2 = float((x[0].astype(np.float64) ** 2).sum())
    rng = np.random.default_rng(seed)
    entry = int((x @ x.mean(axis=0)).argmax())
    edges = np.full((n, how.room), n, dtype=np.int32)
    if n <= 1:
        return edges, entry
    start = min(how.degree // 2, n - 1)
    edges[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    order = rng.permutation(n)
    for at in range(0, n, how.batch):
        nodes = order[at : at + how.batch]
        met, _ = _beam(x, edges, entry, x[nodes], how.build_beam)
        kept = _prune(x, norm2, nodes, np.concatenate([met, edges[nodes]], axis=1), how.degree, how.alpha)
        edges[nodes] = n
        edges[nodes, : how.degree] = kept
        slot = kept < n
        target, source = kept[slot], np.repeat(nodes, slot.sum(axis=1)).astype(np.int32)
        _add_back(x, norm2, edges, target, source, how)
    return edges, entry


def _add_back(x, norm2: float, edges: np.ndarray, target: np.ndarray, source: np.ndarray, how: Graph) -> None:
    """Edges ``target -> source``; nodes without room for theirs are pruned."""
    n = len(x)
    new = ~(edges[target] == source[:, None]).any(axis=1)
    target, source = target[new], source[new]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, many = np.unique(target, return_index=True, return_counts=True)
    used = (edges[nodes] < n).sum(axis=1)
    fits = used + many <= how.room
    slot = np.arange(len(target)) - np.repeat(first, many)
    ok = np.repeat(fits, many)
    edges[target[ok], (np.repeat(used, many) + slot)[ok]] = source[ok]
    for part in np.array_split(np.flatnonzero(~fits), max(1, int((~fits).sum()) // how.batch)):
        if not len(part):
            continue
        wide = np.full((len(part), int(many[part].max())), n, dtype=np.int32)
        for row, i in enumerate(part):
            wide[row, : many[i]] = source[first[i] : first[i] + many[i]]
        kept = _prune(x, norm2, nodes[part], np.concatenate([edges[nodes[part]], wide], axis=1), how.degree, how.alpha)
        edges[nodes[part]] = n
        edges[nodes[part], : how.degree] = kept


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vector)`` in double precision, without ids or vectors that take no part.

    These are NULL ids, and vectors that are NULL, empty, all zero, or have a
    NULL or non-finite component.
    """
    found = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return found.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False)))


def _nodes(rows: DataFrame, keep: int) -> DataFrame:
    """``(node, vector, ids)``: distinct vectors with their ``keep`` smallest ids."""
    rows = rows.select("vec_id", "vector", F.xxhash64("vector").alias("mark")).distinct()
    for salt in (F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)), F.lit(0)):
        of_vector = Window.partitionBy("mark", "salt", "vector").orderBy("vec_id")
        rows = rows.withColumn("salt", salt).withColumn("nth", F.row_number().over(of_vector)).filter(F.col("nth") <= keep)
    grouped = rows.groupBy("mark", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("node"), "vector", "ids")


def index(rows: DataFrame, k: int, how: Graph, shard_size: int = 8192) -> tuple[DataFrame, int]:
    """The written graph table of :func:`usable` rows, and its number of shards.

    ``(dim, shard, position, ids, vector, edges, entry)``: one row per distinct
    vector; vectors of another length are shards of their own.
    """
    nodes = stage(_nodes(rows, k + 1), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_size))

    def graph(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = _matrix(table["vector"])
        edges, entry = build(_lift(x, (x * x).sum(axis=1).max()), how)
        lists = pa.array([e[e < len(x)] for e in edges], pa.list_(pa.int32()))
        at = pa.array(np.arange(len(x), dtype=np.int32))
        columns = [table["dim"], table["shard"], at, table["ids"], table["vector"], lists, pa.array(np.full(len(x), entry, dtype=np.int32))]
        return pa.Table.from_arrays(columns, ["dim", "shard", "position", "ids", "vector", "edges", "entry"])

    dealt = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "ids", "vector")
    schema = "dim int, shard int, position int, ids array<bigint>, vector array<double>, edges array<int>, entry int"
    return stage(dealt.groupBy("dim", "shard").applyInArrow(graph, schema), "ann-graph"), shards


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * x[:, i]
    return total


def _search(k: int, how: Graph):
    """Task over one shard and one block of queries: each query's ``k`` nearest in the shard."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def search(graph: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(graph) or not len(queries):
            return empty
        graph = graph.sort_by("position")
        x, q = _matrix(graph["vector"]), _matrix(queries["vector"])
        n, width = len(x), how.query_beam
        if n <= width:  # the beam holds the shard
            found = np.broadcast_to(np.arange(n), (len(q), n))
        else:
            flat = graph["edges"].combine_chunks()
            many = np.diff(flat.offsets.to_numpy())
            edges = np.full((n, max(1, int(many.max()))), n, dtype=np.int32)
            edges[np.arange(edges.shape[1]) < many[:, None]] = flat.flatten().to_numpy()
            lifted = _lift(x, (x * x).sum(axis=1).max())
            flatq = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
            parts = [_beam(lifted, edges, graph["entry"][0].as_py(), flatq[i : i + how.batch], width)[0] for i in range(0, len(q), how.batch)]
            found = np.concatenate(parts)
        at, column = np.nonzero(found >= 0)
        node = found[at, column]
        score = _scores(q[at], x[node])
        ids = graph["ids"].combine_chunks()
        offsets, values = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        many = np.diff(offsets)[node]
        at, score = np.repeat(at, many), np.repeat(score, many)
        begin = np.repeat(offsets[node], many)
        vec = values[begin + np.arange(len(begin)) - np.repeat(np.cumsum(many) - many, many)]
        query = queries["vec_id"].to_numpy()[at]
        other = vec != query
        at, vec, score, query = at[other], vec[other], score[other], query[other]
        order = np.lexsort((vec, -score, at))
        at, vec, score, query = at[order], vec[order], score[order], query[order]
        top = np.arange(len(at)) - np.searchsorted(at, at) < k
        return pa.table({"query_id": query[top], "vec_id": vec[top], "score": score[top]})

    return search


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    how: Graph = Graph(),
    shard_size: int = 8192,
    block_size: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every query.

    Queries are the rows of ``vectors`` for which ``is_query`` (a condition on
    the column ``vec_id``) holds; candidates are all rows of another id and the
    same number of components. ``score`` is the inner product of the original
    vectors in double precision; ties go to the smaller id. Rows that repeat an
    id and its vector count once. An empty table, or one without a usable
    query, gives no rows; fewer than ``k`` candidates are all given.
    """
    rows = usable(vectors, id_col, vector_col)
    graph, shards = index(rows, k, how, shard_size)
    queries = stage(rows.filter(is_query).distinct().select("vec_id", "vector", F.size("vector").alias("dim")), "ann-queries")
    blocks = max(1, -(-queries.count() // block_size))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    held = graph.withColumn("block", each(blocks))
    keys = ("dim", "shard", "block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k, how), "query_id bigint, vec_id bigint, score double")
    of_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
