"""Operator 3, nearest neighbours by inner product: a navigable small-world graph for each shard.

A task cuts its rows into shards of at most ``SHARD_ROWS`` and builds one index for each, so indexing needs no
shuffle and no key can overload it. An index is flat arrays: distinct vectors, the ids that hold each, and
for every layer its nodes and ``width`` neighbours a node, -1 where there are fewer. Layers are built from
the top down; the nodes of a layer join it in growing blocks, each block searching the layer as it stands.
Neighbours are chosen for diversity, and full lists are cut by the same rule.

Inner products are no distance, so vectors go to shards by dimension and by the power of two of their
norm, and get one more component that makes all norms in the shard equal: the graph then sees angles, and a
query, with 0 there, still sees inner products. Found candidates are scored anew on the original vectors.

Searching: queries are cut into blocks, every block meets every shard once, and a shard gives a query its
``k`` best. These are merged by a ranked window whose partial form keeps k rows a task.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without an id,
take no part; a query meets vectors of its own dimension; rows with the query's id are its own; a query id on
several rows is asked once, with the least of its vectors; repeated rows are candidates each; ties go to
smaller ids; an empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import materialize
from spanloom.llm.text import mix

SHARD_ROWS = 16_384
WIDTH, EF_BUILD, EF_SEARCH, BLOCK = 16, 64, 96, 256
#: Queries in a block, and the open candidates that a search step expands at once.
QUERY_BLOCK, STEP = 4096, 4


@dataclass
class Layer:
    """Rows of the vector array in this layer, each row's place in it, and neighbours as places."""

    nodes: np.ndarray
    links: np.ndarray


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest places found for each query, nearest first (-1: none), and their inner products.

    All queries walk at once; each step expands the ``STEP`` best open candidates of every query.
    """
    n_q, n = len(queries), len(vectors)
    mark = np.zeros((n_q, n), np.int32)
    ids = np.full((n_q, ef), -1, np.int64)
    sims = np.full((n_q, ef), -np.inf, np.float32)
    still = np.zeros((n_q, ef), bool)

    def offer(rows: np.ndarray, found: np.ndarray) -> None:
        """Merge places ``found`` (a row each, -1: none) into the lists of ``rows``."""
        at = rows[:, None]
        stamp = np.arange(1, found.size + 1, dtype=np.int32).reshape(found.shape)
        new = (found >= 0) & (mark[at, found] == 0)
        r, c = np.nonzero(new)
        mark[rows[r], found[r, c]] = stamp[r, c]
        kept = mark[rows[r], found[r, c]] == stamp[r, c]  # one of the same place in a step
        r, c = r[kept], c[kept]
        got = np.full(found.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("ij,ij->i", vectors[found[r, c]], queries[rows[r]])
        all_sims = np.concatenate([sims[rows], got], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
        sims[rows] = np.take_along_axis(all_sims, best, axis=1)
        ids[rows] = np.where(np.isfinite(sims[rows]), np.take_along_axis(np.concatenate([ids[rows], found], axis=1), best, axis=1), -1)
        still[rows] = np.take_along_axis(np.concatenate([still[rows], np.isfinite(got)], axis=1), best, axis=1)

    offer(np.arange(n_q), entries)
    while True:
        rows = np.flatnonzero(still.any(axis=1))
        if not len(rows):
            return ids, sims
        first = np.argsort(~still[rows], axis=1, kind="stable")[:, :STEP]  # lists are nearest first
        good = np.take_along_axis(still[rows], first, axis=1)
        still[rows[:, None], first] = False
        places = np.where(good, np.take_along_axis(ids[rows], first, axis=1), 0)
        around = np.where(good[:, :, None], links[places], -1).reshape(len(rows), -1)
        offer(rows, around)


def diverse(vectors: np.ndarray, targets: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
    """``width`` of each target's candidates, nearest first (-1: none).

    A candidate that is nearer to a chosen one than to the target waits; room that is left goes to those.
    """
    there = vectors[np.maximum(found, 0)]
    own = np.where(found >= 0, np.einsum("ncd,nd->nc", there, vectors[targets]), -np.inf)
    between = np.matmul(there, there.transpose(0, 2, 1))
    closest = np.full(found.shape, -np.inf, np.float32)
    chosen, count = np.zeros(found.shape, bool), np.zeros(len(found), np.int64)
    for c in range(found.shape[1]):
        take = (found[:, c] >= 0) & (count < width) & (own[:, c] >= closest[:, c])
        chosen[take, c] = True
        count += take
        closest[take] = np.maximum(closest[take], between[take, :, c])
    rank = np.where(chosen, 0, np.where(found >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(found, order, axis=1)


def _padded(targets: np.ndarray, others: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct targets, and a row of the ``most`` nearest others for each, nearest first."""
    order = np.lexsort((others, -sims, targets))
    targets, others = targets[order], others[order]
    again = np.zeros(len(targets), bool)
    again[1:] = (targets[1:] == targets[:-1]) & (others[1:] == others[:-1])
    targets, others = targets[~again], others[~again]
    rows, first = np.unique(targets, return_index=True)
    rank = np.arange(len(targets)) - np.repeat(first, np.diff(np.append(first, len(targets))))
    out = np.full((len(rows), most), -1, np.int64)
    near = rank < most
    out[np.searchsorted(rows, targets[near]), rank[near]] = others[near]
    return rows, out


def _descend(vectors: np.ndarray, upper: list[Layer], queries: np.ndarray) -> np.ndarray:
    """Rows of the vector array near the queries, from the layers above."""
    rows = np.zeros((len(queries), 1), np.int64)
    for layer in upper:
        places = np.where(rows >= 0, np.searchsorted(layer.nodes, rows), -1)
        found, _ = beam(vectors[layer.nodes], layer.links, queries, places, STEP)
        rows = np.where(found >= 0, layer.nodes[found], -1)
    return rows


def build_layers(vectors: np.ndarray, width: int = WIDTH, ef: int = EF_BUILD) -> list[Layer]:
    """Layers from the top down to all vectors. Row 0 is in every layer and is the entry."""
    n = len(vectors)
    draw = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    level = np.floor(-np.log(np.maximum(draw, 1e-18)) / np.log(width)).astype(np.int64)
    if n:
        level[0] = level.max()
    layers: list[Layer] = []
    for at in range(int(level.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(level >= at)
        most = 2 * width if at == 0 else width
        layer = Layer(nodes, np.full((len(nodes), most), -1, np.int64))
        inside = vectors[nodes]
        # those of the layer above come first, so that every entry is in the graph already
        order = np.argsort(level[nodes] <= at, kind="stable")
        done = 0
        while done < len(order):
            block = order[done : done + min(BLOCK, max(1, done))]
            if done:
                entries = _descend(vectors, layers, inside[block]) if layers else np.zeros((len(block), 1), np.int64)
                places = np.where(entries >= 0, np.searchsorted(nodes, entries), -1)
                found, sims = beam(inside, layer.links, inside[block], places, ef)
                own = inside[block] @ inside[block].T  # the block's nodes may be neighbours too
                np.fill_diagonal(own, -np.inf)
                near = np.argsort(-own, axis=1)[:, : min(width, len(block) - 1)]
                found = np.concatenate([found, block[near]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, near, axis=1)], axis=1)
                best = np.argsort(-np.where(found >= 0, sims, -np.inf), axis=1, kind="stable")[:, :ef]
                links = diverse(inside, block, np.take_along_axis(found, best, axis=1), width)
                layer.links[block, : links.shape[1]] = links
                _link_back(inside, layer.links, block, links)
            done += len(block)
        layers.append(layer)
    return layers


def _link_back(vectors: np.ndarray, links: np.ndarray, block: np.ndarray, chosen: np.ndarray) -> None:
    """Each chosen neighbour also gets a link to the block's node; lists that overflow are cut."""
    to, who = chosen.reshape(-1), np.repeat(block, chosen.shape[1])
    to, who = to[to >= 0], who[to >= 0]
    hit = np.unique(to)
    old = links[hit]
    targets = np.concatenate([to, np.repeat(hit, links.shape[1])])
    others = np.concatenate([who, old.reshape(-1)])
    targets, others = targets[others >= 0], others[others >= 0]
    sims = np.einsum("ij,ij->i", vectors[targets], vectors[others])
    rows, lists = _padded(targets, others, sims, 2 * links.shape[1])
    most = links.shape[1]
    over = lists[:, most] >= 0
    links[rows[~over]] = lists[~over, :most]
    if over.any():
        links[rows[over]] = diverse(vectors, rows[over], lists[over], most)


def _flat(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def build_index(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """One shard's row: flat arrays as bytes. ``vectors`` are float64 of one dimension and similar norm."""
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.reshape(-1)
    shuffled = np.argsort(mix(np.arange(len(distinct), dtype=np.uint64)))  # sorted vectors would join the layers by direction
    distinct = distinct[shuffled]
    group = np.argsort(shuffled)[group]
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], np.arange(len(distinct) + 1))
    unit = distinct / np.abs(distinct).max()  # squares of components may exceed a double
    norms = np.linalg.norm(unit, axis=1)
    scale = norms.max()
    raised = np.concatenate([unit / scale, np.sqrt(np.maximum(0, 1 - (norms / scale) ** 2))[:, None]], axis=1).astype(np.float32)
    layers = build_layers(raised)
    return {
        "n": len(distinct), "dim": vectors.shape[1], "exact": _flat(distinct, "<f8"), "raised": _flat(raised, "<f4"), "ids": _flat(ids[order], "<i8"), "first": _flat(first, "<i8"),
        "layer_nodes": [_flat(x.nodes, "<i4") for x in layers], "layer_links": [_flat(x.links, "<i4") for x in layers],
    }


INDEX = "n long, dim long, exact binary, raised binary, ids binary, first binary, layer_nodes array<binary>, layer_links array<binary>"
_INDEX_TYPES = pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("exact", pa.binary()), ("raised", pa.binary()), ("ids", pa.binary()), ("first", pa.binary()), ("layer_nodes", pa.list_(pa.binary())), ("layer_links", pa.list_(pa.binary()))])


class Shard:
    """An index row, ready to search."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.exact = np.frombuffer(row["exact"], "<f8").reshape(n, dim)
        self.raised = np.frombuffer(row["raised"], "<f4").reshape(n, dim + 1)
        self.ids, self.first = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i8")
        nodes = [np.frombuffer(x, "<i4").astype(np.int64) for x in row["layer_nodes"]]
        self.layers = [Layer(x, np.frombuffer(y, "<i4").astype(np.int64).reshape(len(x), -1)) for x, y in zip(nodes, row["layer_links"], strict=True)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of each query, its own id left out."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(queries), BLOCK):
            q, own = queries[i : i + BLOCK], query_ids[i : i + BLOCK]
            level = q / np.abs(q).max(axis=1, keepdims=True)
            raised = np.concatenate([level / np.linalg.norm(level, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1).astype(np.float32)
            rows = _descend(self.raised, self.layers[:-1], raised)
            found, _ = beam(self.raised, self.layers[-1].links, raised, rows, max(ef, k + 1))
            r, c = np.nonzero(found >= 0)
            place = found[r, c]
            score = np.einsum("ij,ij->i", self.exact[place], q[r])
            held = np.minimum(np.diff(self.first)[place], k + 1)  # the smallest ids of equal vectors: more can't be among k
            row, value = np.repeat(r, held), np.repeat(score, held)
            step = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
            ids = self.ids[np.repeat(self.first[place], held) + step]
            other = ids != own[row]
            row, value, ids = row[other], value[other], ids[other]
            order = np.lexsort((ids, -value, row))
            row, value, ids = row[order], value[order], ids[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((own[row[near]], ids[near], value[near]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long"), vector.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0)).select("vec_id", F.col("v").alias("embedding"))


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def index_shards(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard, see INDEX."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[tuple[int, int], int] = {}

        def flush(key: tuple[int, int]) -> pa.RecordBatch:
            parts = waiting.pop(key)
            held.pop(key)
            row = build_index(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.RecordBatch.from_pylist([row], _INDEX_TYPES)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                vectors = _matrix(lists, own, dim)
                high = np.abs(vectors).max(axis=1)
                band = np.floor(np.log2(np.linalg.norm(vectors / high[:, None], axis=1)) + np.log2(high)).astype(np.int64)
                for b in np.unique(band).tolist():
                    some = np.flatnonzero(band == b)
                    for i in range(0, len(some), shard_rows):
                        part = some[i : i + shard_rows]
                        waiting.setdefault((dim, b), []).append((ids[own[part]], vectors[part]))
                        held[dim, b] = held.get((dim, b), 0) + len(part)
                        if held[dim, b] >= shard_rows:
                            yield flush((dim, b))
            if sum(held.values()) > 4 * shard_rows:  # many dimensions or norms: small shards
                yield flush(max(held, key=held.__getitem__))
        for key in list(waiting):
            yield flush(key)

    return usable(rows).mapInArrow(build, INDEX)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, nearest first."""
    shards = materialize(index_shards(rows, shard_rows).withColumn("shard", F.monotonically_increasing_id()), "index")
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked, "asked")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    ids = shards.select(F.col("shard").alias("s"), F.col("dim").alias("d")).distinct()
    spread = asked.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").cast("long").alias("d"), block.alias("block")).join(ids, "d").select("s", "block", "query_id", "embedding")
    each = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(index: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not index.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        row = index.select(["n", "dim", "exact", "raised", "ids", "first", "layer_nodes", "layer_links"]).to_pylist()[0]
        lists = wanted.column("embedding").combine_chunks()
        vectors = _matrix(lists, np.arange(wanted.num_rows), row["dim"])
        found = Shard(row).search(wanted.column("query_id").to_numpy(), vectors, k, ef)
        return pa.table([pa.array(x) for x in found], names=names)

    found = each.groupBy("shard", "block").cogroup(spread.groupBy("s", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(rows: DataFrame, n: int = 20) -> Column:
    """The stated query set: ids that are divisible by n."""
    return F.pmod(F.col("vec_id").cast("long"), F.lit(n)) == 0
