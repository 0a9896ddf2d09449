"""The most similar vectors of every vector: a hierarchical navigable small world per shard.

Vectors are split into shards by the nearest of a few centroids (fitted on a bounded
sample; every vector is indexed). Each shard's graph is built by inserting its vectors in
groups, each of which walks the graph built so far; it is stored as flat neighbour arrays in
the shared folder. Every query walks the graphs of its own and of the nearest shards, and
the shards' results are merged. Exact copies of a vector are one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sverka.session import fresh_path

#: Vectors a shard is meant to hold; one that would hold over three times as many is split by a hash.
SHARD = 20000
#: Shards walked for each query at most, and the part of a shard's vectors (of the sample) that may
#: lie nearer to its centre than the bound by which a shard too far from the query is passed over.
PROBES, CORE = 4, 0.6
#: Links of a node in the bottom layer; upper layers have half.
LINKS = 16
#: Candidates kept during a walk, and nodes expanded at once.
BEAM, STEP = 8, 4
#: Candidates kept while a node is inserted, and nodes inserted at once.
BUILD_BEAM, GROUP = 16, 2048
#: Bounds of the sample that centroids are fitted on (documented bound), and of their number.
SAMPLE_LEAST, SAMPLE_EACH, SAMPLE_MOST, CENTROIDS_MOST = 8192, 64, 262_144, 16_384
#: Up to so many centroids are fitted at once, more of them in two levels.
ONE_LEVEL = 512
#: A shard's queries choose among so many centroids nearest to its own.
NEAR_CELLS = 256
#: Lines that a row of similarities is folded into to find its greatest ones.
FOLD = 16
#: One node of a layer in so many is also in the layer above.
THIN = 16
#: A layer of at most so many nodes is looked through as one block.
BLOCK = 512
#: Vectors of the graphs that a worker holds at once.
HELD = 150_000


def unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


def _best(sims: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most greatest similarities of each row, greatest first, with their ids."""
    if sims.shape[1] > most:
        top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        sims, ids = np.take_along_axis(sims, top, 1), np.take_along_axis(ids, top, 1)
    o = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, o, 1), np.take_along_axis(ids, o, 1)


def _folded(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row what the most greatest similarities are surely among, with its places: rows are
    folded into lines, and the greatest lie in the columns of greatest maximum, as many as are wanted."""
    n, width = sims.shape
    columns = width // FOLD
    if width % FOLD or columns <= most:
        return sims, np.broadcast_to(np.arange(width), sims.shape)
    tops = sims.reshape(n, FOLD, columns).max(1)
    best = np.argpartition(-tops, most - 1, axis=1)[:, :most]
    places = (best[:, None, :] + (np.arange(FOLD) * columns)[None, :, None]).reshape(n, -1)
    return np.take_along_axis(sims, places, 1), places


def _diverse(v: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (nearest first; -inf fills) a node links to: those not nearer to a chosen one than to the node; the nearest few in any case."""
    c = v[near]
    between = c @ c.transpose(0, 2, 1)
    chosen = np.zeros(sims.shape, bool)
    for k in range(sims.shape[1]):
        chosen[:, k] = ~((between[:, k] > sims[:, k, None]) & chosen).any(1) & (chosen.sum(1) < most)
    chosen[:, : most // 2] = True
    return chosen & np.isfinite(sims)


class _Layer:
    """One layer while it is built: flat neighbour arrays with their similarities, -1 fills."""

    def __init__(self, v: np.ndarray, most: int):
        self.v, self.most = v, most
        self.links = np.full((len(v), most), -1, np.int32)
        self.sims = np.full((len(v), most), -np.inf, np.float32)

    def insert(self, new: np.ndarray, entry: np.ndarray) -> None:
        """Links new nodes: candidates are what a walk from the entry nodes (-1 fills) finds and the nearest of the group itself."""
        v, q = self.v, self.v[new]
        wide = min(self.most + self.most // 2, BUILD_BEAM + len(new) - 1)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        sims, at = _best(*_folded(own, min(wide, len(new))), min(wide, len(new)))
        ids = new[at]
        if entry.shape[1]:
            start = np.where(entry < 0, -np.inf, np.einsum("qd,qkd->qk", q, v[np.maximum(entry, 0)])).astype(np.float32)
            found, near = Graph._beam(q, v, self.links, entry, start, BUILD_BEAM)
            sims, ids = _best(np.concatenate([sims, near], 1), np.concatenate([ids, np.maximum(found, 0)], 1), wide)
        keep = _diverse(v, ids, sims, self.most)
        a, k = np.nonzero(keep)
        frm, to, w = new[a], ids[a, k], sims[a, k]
        # mutual: what a node links to links back; of more than it holds the diverse ones stay
        touched = np.unique(np.concatenate([frm, to]))
        r, k = np.nonzero(self.links[touched] >= 0)
        frm, to, w = np.concatenate([frm, to, touched[r]]), np.concatenate([to, frm, self.links[touched[r], k]]), np.concatenate([w, w, self.sims[touched[r], k]])
        _, once = np.unique(frm.astype(np.int64) * len(v) + to, return_index=True)
        frm, to, w = frm[once], to[once], w[once]
        o = np.lexsort((to, -w, frm))
        frm, to, w = frm[o], to[o], w[o]
        rank = np.arange(len(frm)) - np.searchsorted(frm, frm)
        wide = 2 * self.most  # of more candidates the farthest drop out
        ok = rank < wide
        frm, to, w, rank = frm[ok], to[ok], w[ok], rank[ok]
        row = np.searchsorted(touched, frm)
        ids, sims = np.full((len(touched), wide), -1, np.int32), np.full((len(touched), wide), -np.inf, np.float32)
        ids[row, rank], sims[row, rank] = to, w
        full = np.flatnonzero(sims[:, self.most] > -np.inf)
        for at in range(0, len(full), GROUP):
            some = full[at : at + GROUP]
            chosen = _diverse(v, np.maximum(ids[some], 0), sims[some], self.most)
            sims[some] = np.where(chosen, sims[some], -np.inf)
        sims, ids = _best(sims, ids, self.most)
        self.links[touched], self.sims[touched] = np.where(np.isfinite(sims), ids, -1), sims


class Graph:
    """Layers of flat neighbour arrays over the vectors of one shard; layer 0 holds all."""

    def __init__(self, v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.v, self.layers = v, layers

    @classmethod
    def build(cls, v: np.ndarray, links: int = LINKS, seed: int = 1) -> Graph:
        """Layers from the top down; in each the nodes of the layer above come first, then the others in groups."""
        rng = np.random.default_rng(seed)
        sets = [np.arange(len(v), dtype=np.int32)]
        while len(sets[-1]) > BLOCK:
            sets.append(np.sort(rng.choice(sets[-1], max(1, len(sets[-1]) // THIN), replace=False)))
        graph = cls(v, [(sets[-1], np.zeros((0, 0), np.int32))])
        for depth in range(len(sets) - 2, -1, -1):
            members, above = sets[depth], sets[depth + 1]
            layer = _Layer(v[members], links if depth == 0 else max(2, links // 2))
            first = np.searchsorted(members, above).astype(np.int32)
            rest = rng.permutation(np.setdiff1d(np.arange(len(members), dtype=np.int32), first))
            order = np.concatenate([first, rest])
            for at in range(0, len(order), GROUP):
                new = order[at : at + GROUP]
                if at < len(first):  # of the layer above: no way down to walk yet but what is in already
                    entry = np.broadcast_to(order[: min(at, 1)], (len(new), min(at, 1)))
                else:
                    entry = np.searchsorted(members, graph._down(v[members[new]], 4)).astype(np.int32)
                layer.insert(new, entry)
            graph = cls(v, [(members, layer.links), *graph.layers])
        return graph

    def search(self, q: np.ndarray, k: int, beam: int = BEAM, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the k nearest nodes of each query, best first; -1 fills.

        start: the node each query starts from, instead of the way down from the top layer.
        """
        k = min(k, len(self.v))
        beam = max(beam, k)
        ids, sims = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -np.inf, np.float32)
        step = max(64, min(1024, (1 << 24) // max(1, len(self.v))))
        for at in range(0, len(q), step):
            i, s = self._walk(q[at : at + step], beam, None if start is None else start[at : at + step])
            ids[at : at + step], sims[at : at + step] = i[:, :k], s[:, :k]
        return ids, sims

    def exact(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the k nearest nodes of each query by comparing all, in blocks."""
        k = min(k, len(self.v))
        step = max(1, (1 << 23) // max(1, len(self.v)))
        parts = []
        for at in range(0, len(q), step):
            s = q[at : at + step] @ self.v.T
            parts.append(_best(s, np.broadcast_to(np.arange(len(self.v)), s.shape), k))
        return np.concatenate([i for _, i in parts]).astype(np.int32), np.concatenate([s for s, _ in parts])

    def _down(self, q: np.ndarray, width: int) -> np.ndarray:
        """Some nodes of the lowest layer so far that are near each query."""
        return self._descend(q, width)[0][:, :width]

    def _descend(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        top = self.layers[-1][0]
        s = q @ self.v[top].T
        width = min(beam, len(top))
        first = np.argpartition(-s, width - 1, axis=1)[:, :width]
        ids, sims = top[first], np.take_along_axis(s, first, 1)
        for members, links in self.layers[-2::-1]:
            whole = len(members) == len(self.v)
            if not whole:
                ids = np.searchsorted(members, ids).astype(np.int32)
            ids, sims = self._beam(q, self.v if whole else self.v[members], links, ids, sims, beam if whole else 8)
            if not whole:
                ids = members[np.maximum(ids, 0)]
        return _best(sims, ids, sims.shape[1])[::-1]

    def _walk(self, q: np.ndarray, beam: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if start is None or len(self.layers) == 1:
            return self._descend(q, beam)
        ids = start[:, None].astype(np.int32)
        ids, sims = self._beam(q, self.v, self.layers[0][1], ids, np.einsum("qd,qd->q", q, self.v[start])[:, None], beam)
        return _best(sims, ids, sims.shape[1])[::-1]

    @staticmethod
    def _beam(q, v, links, ids, sims, beam):
        n, rows = len(v), np.arange(len(q))[:, None]
        if ids.shape[1] > beam:
            o = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        elif ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        seen = np.zeros((len(q), n + 1), bool)
        seen[rows, ids] = True  # -1 marks the extra column
        seen[:, n] = True
        done = np.isinf(sims)
        active = np.arange(len(q))
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-open_sims, STEP - 1, axis=1)[:, :STEP]
            good = np.take_along_axis(open_sims, pick, 1) > -np.inf
            going = good.any(1)
            if not going.all():
                active, pick, good = active[going], pick[going], good[going]
                if not len(active):
                    break
            a = active[:, None]
            done[a, pick] = True
            nodes = np.where(good, ids[a, pick], 0)
            near = np.where(good[:, :, None], links[nodes], -1).reshape(len(active), -1)
            near = np.where(seen[a, near], -1, near)
            # one node may be reached twice in a step: keep its first place
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[a, near] = True
            r, m = np.nonzero(near >= 0)  # often less than half: only these are compared
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, m] = np.einsum("nd,nd->n", q[active[r]], v[near[r, m]])
            all_ids = np.concatenate([ids[active], near], 1)
            all_sims = np.concatenate([sims[active], got], 1)
            all_done = np.concatenate([done[active], near < 0], 1)
            o = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active], done[active] = np.take_along_axis(all_ids, o, 1), np.take_along_axis(all_sims, o, 1), np.take_along_axis(all_done, o, 1)
        return ids, sims

    def arrays(self) -> dict[str, bytes]:
        """The graph as flat bytes."""
        return {"vectors": self.v.tobytes(), "members": b"".join(m.astype("<i4").tobytes() for m, _ in self.layers), "links": b"".join(a.astype("<i4").tobytes() for _, a in self.layers), "shape": np.array([x for m, a in self.layers for x in (len(m), *a.shape)], "<i4").tobytes()}

    @classmethod
    def load(cls, vectors: bytes, members: bytes, links: bytes, shape: bytes, dim: int) -> Graph:
        sizes = np.frombuffer(shape, "<i4").reshape(-1, 3)
        m, a, layers, at, to = np.frombuffer(members, "<i4"), np.frombuffer(links, "<i4"), [], 0, 0
        for n, r, c in sizes:
            layers.append((m[at : at + n], a[to : to + r * c].reshape(r, c)))
            at, to = at + n, to + r * c
        return cls(np.frombuffer(vectors, "<f4").reshape(-1, dim), layers)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample; many centroids are fitted in two levels."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    if count > ONE_LEVEL:
        coarse = fit_centroids(sample, int(np.sqrt(count)), rounds, seed)
        home = np.concatenate([(sample[k : k + 8192] @ coarse.T).argmax(1) for k in range(0, len(sample), 8192)])
        parts = [sample[home == c] for c in range(len(coarse))]
        return np.concatenate([fit_centroids(p, min(ONE_LEVEL, max(1, round(count * len(p) / len(sample)))), rounds, seed) for p in parts if len(p)])
    c = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[k : k + 8192] @ c.T).argmax(1) for k in range(0, len(sample), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        empty = np.bincount(near, minlength=count) == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = unit_rows(total)
    return c


def nearest_centroid(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, similarity to it) of each vector, in blocks."""
    step = max(1, (1 << 23) // len(centroids))
    found = [(s.argmax(1), s.max(1)) for k in range(0, len(v), step) for s in (v[k : k + step] @ centroids.T,)]
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, int), np.zeros(0, np.float32))


def _usable(batch: pa.RecordBatch, at: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of a batch's vectors that are finite and not all zero."""
    flat = batch.column(at).flatten()
    v = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)  # nulls become NaN
    rows = np.flatnonzero(np.isfinite(v).all(1) & (v != 0).any(1))
    return rows, v[rows]


def vectors_of(df: DataFrame, kind: str, key, vector: str, dim: int) -> DataFrame:
    """kind, key, v of the vectors of dim numbers; those with a null, NaN or infinite number or all zero drop out when they are placed."""
    v = F.col(vector)
    return df.where((F.size(v) == dim) & key.isNotNull()).select(F.lit(kind).alias("kind"), key.alias("key"), v.alias("v"))


def _plan(vectors: DataFrame, dim: int, shard: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """kind -> (centroids, sub-shards of each, angle within which the core of each lies); bounded by CENTROIDS_MOST."""
    counts = {r["kind"]: r["n"] for r in vectors.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    plan = {}
    wanted = {k: min(CENTROIDS_MOST, -(-n // shard)) for k, n in counts.items()}
    limits = {k: min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_EACH * c)) for k, c in wanted.items()}
    chance = {k: min(1.0, 1.2 * limits[k] / counts[k]) for k in counts}
    drawn = None
    for k in counts:
        some = vectors.where(F.col("kind") == k).where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(chance[k] * (1 << 20)) + 1).select("kind", "key", "v").limit(limits[k])
        drawn = some if drawn is None else drawn.unionByName(some)
    if drawn is None:
        return plan
    batch = drawn.toArrow().combine_chunks().to_batches()[0]
    rows, flat = _usable(batch, 2, dim)
    kinds, keys = (np.array(batch.column(c).to_pylist(), object)[rows] for c in (0, 1))
    order = np.argsort(keys, kind="stable")
    kinds, flat = kinds[order], flat[order]
    for k, n in counts.items():
        sample = unit_rows(flat[kinds == k])
        if not len(sample):
            continue
        c = fit_centroids(sample, wanted[k])
        home, own = nearest_centroid(sample, c)
        share = np.bincount(home, minlength=len(c)) / max(1, len(sample))
        angle = np.array([np.quantile(np.arccos(np.clip(own[home == x], -1, 1)), 1 - CORE) if (home == x).any() else np.pi for x in range(len(c))])
        plan[k] = (c, np.maximum(1, np.ceil(share * n / (3 * shard))).astype(np.int32), angle)
    return plan


def neighbour_pairs(vectors: DataFrame, k: int = 5, dim: int = 32, shard: int = SHARD, probes: int | None = PROBES) -> DataFrame:
    """kind, key, near_key: about the k nearest vectors of each vector, within its kind.

    probes: shards walked for a query; None compares every vector with all others, in
    blocks, and gives exactly the k nearest (of copies the k least keys).

    vectors: kind, key (string), v (array of dim numbers), as vectors_of gives them. By
    cosine, at a tie the smaller key is nearer; repeated rows count once. A kind of fewer
    than k + 1 vectors gives all pairs there are, an empty table none.
    """
    spark = vectors.sparkSession
    plan = _plan(vectors, dim, shard)
    if not plan:
        return spark.createDataFrame([], "kind string, key string, near_key string")
    shared = spark.sparkContext.broadcast(plan)  # at most CENTROIDS_MOST centroids a kind
    placed = "kind string, cell int, sub int, key string, extra boolean, v binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell of each vector; of many equal vectors in a batch all but the k + 2 least keys are extra."""
        for batch in batches:
            rows, v = _usable(batch, 2, dim)
            if not len(rows):
                continue
            kinds, keys = (np.array(batch.column(c).to_pylist(), object)[rows] for c in (0, 1))
            v = unit_rows(v)
            blob = v.view(f"V{4 * dim}")[:, 0]
            cell, sub = np.zeros(len(v), np.int32), np.zeros(len(v), np.int32)
            for kind in set(kinds):
                at = np.flatnonzero(kinds == kind)
                c, parts, _ = shared.value[kind]
                cell[at] = nearest_centroid(v[at], c)[0]
                mix = np.frombuffer(v[at].tobytes(), np.uint32).reshape(len(at), dim).astype(np.uint64)
                h = (mix * (np.arange(dim, dtype=np.uint64) * 2 + 2654435761)).sum(1) >> np.uint64(13)
                sub[at] = (h % parts[cell[at]].astype(np.uint64)).astype(np.int32)
            extra = np.zeros(len(v), bool)
            _, same, times = np.unique(blob, return_inverse=True, return_counts=True)
            if (times > k + 2).any():
                f = pd.DataFrame({"kind": kinds, "same": same, "key": keys})
                extra = f.groupby(["kind", "same"])["key"].rank(method="dense").to_numpy() > k + 2
            blobs = pa.Array.from_buffers(pa.binary(4 * dim), len(v), [None, pa.py_buffer(v.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(cell), pa.array(sub), pa.array(keys, pa.string()), pa.array(extra), blobs], names=["kind", "cell", "sub", "key", "extra", "v"])

    located = vectors.mapInArrow(place, placed)
    index = fresh_path(spark, "graphs")
    stored = "kind string, cell int, sub int, copied array<binary>, keys array<string>, sizes binary, vectors binary, members binary, links binary, shape binary"

    def build(table: pa.Table) -> pa.Table:
        """One row: the graph of a shard, a node for each different vector with its k + 1 least keys.

        copied: the vectors that have more keys than that. place() leaves k + 2 keys of each
        of them, so their number tells, however they are spread over batches.
        """
        flat = np.frombuffer(b"".join(table["v"].to_pylist()), "<f4").reshape(-1, dim)
        different, node = np.unique(np.ascontiguousarray(flat).view(f"V{4 * dim}")[:, 0], return_inverse=True)
        names = np.array(table["key"].to_pylist(), object)
        order = np.lexsort((np.argsort(np.argsort(names, kind="stable"), kind="stable"), node))
        node, names = node[order], names[order]
        once = np.ones(len(node), bool)
        once[1:] = (node[1:] != node[:-1]) | (names[1:] != names[:-1])
        node, names = node[once], names[once]
        copied = different[np.bincount(node, minlength=len(different)) > k + 1]
        held = np.arange(len(node)) - np.searchsorted(node, node) <= k
        node, names = node[held], names[held]
        sizes = np.bincount(node, minlength=len(different)).astype("<i4")
        v = np.frombuffer(different.tobytes(), "<f4").reshape(-1, dim)
        row = {"kind": table["kind"][0], "cell": table["cell"][0], "sub": table["sub"][0], "copied": [x.tobytes() for x in copied], "keys": names.tolist(), "sizes": sizes.tobytes()} | Graph.build(v).arrays()
        return pa.Table.from_pylist([{n: (x.as_py() if isinstance(x, pa.Scalar) else x) for n, x in row.items()}], schema=_arrow(stored))

    located.where("not extra").groupBy("kind", "cell", "sub").applyInArrow(build, stored).write.partitionBy("kind", "cell").parquet(index)
    graphs = spark.read.parquet(index)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Shards(index, dim)
        for part in parts:
            for r in part.itertuples():
                yield _shard_pairs(reader, shared.value[r.kind], r.kind, int(r.cell), int(r.sub), k, probes)

    n_shards = sum(int(parts.sum()) for _, parts, _ in plan.values())
    spread = graphs.select("kind", "cell", "sub").repartition(n_shards, "kind", "cell", "sub")
    found = spread.mapInPandas(walk, "kind string, key string, near_key string")
    if graphs.where("size(copied) > 0").isEmpty():  # no vector has more copies than its node holds
        return found
    return _with_copies(found, located, graphs.select("kind", F.explode("copied").alias("v")).distinct(), k)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in ddl.split(","))])


def _with_copies(found: DataFrame, located: DataFrame, many: DataFrame, k: int) -> DataFrame:
    """Adds the pairs of copies that were left out of the graphs: their nearest are the k least keys of their vector (of many: kind, v)."""
    members = located.join(many, ["kind", "v"]).select("kind", "v", "key").distinct()
    w = Window.partitionBy("kind", "v").orderBy("key")  # the limit on row_number also works before the shuffle
    top = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("kind", "v").agg(F.sort_array(F.collect_list("key")).alias("least"))
    own = members.join(top, ["kind", "v"]).select("kind", "key", F.explode(F.slice(F.array_remove("least", F.col("key")), 1, k)).alias("near_key"))
    return found.unionByName(own)


class _Shards:
    """Graphs read from the shared folder, the last few kept: at most HELD vectors and the cell asked for."""

    def __init__(self, uri: str, dim: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(uri)
        self.dim, self.have = dim, {}

    def cell(self, kind: str, cell: int) -> list[tuple[int, Graph, list, np.ndarray]]:
        at = (kind, cell)
        if at not in self.have:
            while self.have and sum(len(g.v) for c in self.have.values() for _, g, _, _ in c) > HELD:
                self.have.pop(next(iter(self.have)))
            t = []
            from pyarrow import fs

            for f in self.fs.get_file_info(fs.FileSelector(f"{self.base}/kind={kind}/cell={cell}", allow_not_found=True)):
                if f.path.endswith(".parquet"):
                    with self.fs.open_input_file(f.path) as opened:
                        t += pq.read_table(opened).to_pylist()
            self.have[at] = [(r["sub"], Graph.load(r["vectors"], r["members"], r["links"], r["shape"], self.dim), r["keys"], np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], "<i4"))])) for r in sorted(t, key=lambda r: r["sub"])]
        return self.have[at]


def _shard_pairs(reader: _Shards, plan, kind: str, cell: int, sub: int, k: int, probes: int | None) -> pd.DataFrame:
    """Nearest keys of every node of one shard, from its own graph and those of the nearest shards.

    Shards are walked from the nearest centre on; one whose core, seen from the query, lies
    beyond the k-th neighbour found so far is passed over.
    """
    centroids, _, core = plan
    own, keys, ends = next((g, ks, e) for s, g, ks, e in reader.cell(kind, cell) if s == sub)
    q, n = own.v, len(own.v)
    # its own cell comes first, then the cells nearest to a query among those nearest to its cell
    close = np.argsort(-(centroids @ centroids[cell]), kind="stable")[: len(centroids) if probes is None else NEAR_CELLS]
    angle = np.arccos(np.clip(q @ centroids[close].T, -1, 1))
    angle[:, close == cell] = -1
    rounds = len(close) if probes is None else min(probes, len(close))
    order = np.argsort(angle, axis=1)[:, :rounds]
    best_s, best = np.full((n, k + 1), -np.inf), np.full((n, k + 1), -1, np.int64)
    used: dict[tuple[int, int], int] = {}
    bases, names = [0], []
    for r in range(rounds):
        todo = close[order[:, r]]
        near = np.take_along_axis(angle, order[:, r : r + 1], 1)[:, 0] - core[todo] < np.arccos(np.clip(best_s[:, k], -1, 1))
        if probes is None:
            near[:] = True
        for c in np.unique(todo[near]) if r else [cell]:
            rows = np.flatnonzero(near & (todo == c)) if r else np.arange(n)
            for s, g, ks, e in reader.cell(kind, int(c)):
                if (c, s) not in used:
                    used[c, s] = bases[-1]
                    bases.append(bases[-1] + len(g.v))
                    names.append((ks, e))
                if probes is None:
                    ids = g.exact(q[rows], k + 1)[0]
                else:
                    ids = g.search(q[rows], k + 1, start=rows.astype(np.int32) if c == cell and s == sub else None)[0]
                sims = np.where(ids < 0, -np.inf, np.einsum("qd,qkd->qk", q[rows].astype(np.float64), g.v[np.maximum(ids, 0)].astype(np.float64)))
                if ids.shape[1] < k + 1:
                    pad = ((0, 0), (0, k + 1 - ids.shape[1]))
                    ids, sims = np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-np.inf)
                all_s, all_i = np.concatenate([best_s[rows], sims], 1), np.concatenate([best[rows], np.where(ids < 0, -1, ids + used[c, s])], 1)
                o = np.argsort(-all_s, axis=1, kind="stable")[:, : k + 1]
                best_s[rows], best[rows] = np.take_along_axis(all_s, o, 1), np.take_along_axis(all_i, o, 1)
    rounded = np.where(np.isinf(best_s), -np.inf, np.round(best_s, 12))
    # the usual case at once: every node here holds one key and no two similarities tie
    first = np.concatenate([np.array(ks, object)[e[:-1]] for ks, e in names])
    lone = np.concatenate([np.diff(e) == 1 for _, e in names])
    full = best >= 0
    me = used[cell, sub] + np.arange(n)
    plain = (lone[np.maximum(best, 0)] | ~full).all(1) & lone[me] & (rounded[:, 1:] != rounded[:, :-1]).all(1) & full.all(1)
    rows = np.flatnonzero(plain)
    other = best[rows] != me[rows, None]
    take = other & (np.cumsum(other, 1) <= k)
    i, j = np.nonzero(take)
    out_key, out_near = [first[me[rows[i]]]], [first[best[rows[i], j]]]
    slow_key, slow_near, base = [], [], np.array(bases)
    for i in np.flatnonzero(~plain):
        cand = []
        for b, s in zip(best[i], rounded[i]):
            if b >= 0:
                p = int(np.searchsorted(base, b, side="right")) - 1
                ks, e = names[p]
                node = b - base[p]
                cand += [(-s, key) for key in ks[e[node] : e[node + 1]]]
        cand.sort()
        for key in keys[ends[i] : ends[i + 1]]:
            got = [x for _, x in cand if x != key][:k]
            slow_key += [key] * len(got)
            slow_near += got
    key, near_key = (np.concatenate([*a, np.array(b, object)]) for a, b in ((out_key, slow_key), (out_near, slow_near)))
    return pd.DataFrame({"kind": kind, "key": key, "near_key": near_key})
