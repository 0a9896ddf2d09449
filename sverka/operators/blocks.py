"""The name gate in blocks: some queries against some documents a task, so that pairs are never shuffled.

The pairs that pass grow with the square of the library. Joined one condition at a time they
are written and shuffled again and again; here only what documents can be found by is
shuffled, and a block's pairs are told whole, with all flags, by look-ups of words, roots and pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sverka.operators import rows as R

#: Documents and queries of a block at most, on average; blocks of so few documents aren't split for more tasks; tasks wanted.
DOCUMENTS, QUERIES, FEW, TASKS = 16384, 32768, 512, 24
#: A name of so many letters may be held in another as a text.
HELD = 14
#: Bits of a pair.
FLAGS = {"by_name": 1, "by_code": 2, "by_marker": 4, "contained": 8, "by_vector": 16}
#: Pairs of an Arrow batch, names of which pieces are looked up at once, query vectors multiplied at once.
BATCH, NAMES, VECTORS = 1 << 16, 4096, 512
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Postings:
    """Which members (of ascending numbers) hold a key."""

    def __init__(self, keys: np.ndarray, members: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.members = np.ascontiguousarray(members[order], np.intp)
        found, starts = np.unique(keys[order], return_index=True)
        self.at = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])))

    def of(self, keys) -> list[np.ndarray]:
        return [self.members[slice(*self.at[k])] for k in keys if k in self.at]


class Pieces:
    """Hashes of all pieces of HELD letters of texts; owner: the number of the text, in ascending order."""

    def __init__(self, texts: list[str]):
        long = [k for k, x in enumerate(texts) if len(x) >= HELD]
        sizes = np.array([len(texts[k]) for k in long], np.intp)
        codes = np.frombuffer("".join(texts[k] for k in long).encode("utf-32-le"), np.uint32)
        n = max(0, len(codes) - HELD + 1)
        hashed = np.zeros(n, np.uint64)
        for k in range(HELD):
            hashed *= _BASE
            hashed += codes[k : n + k]
        left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)))[:n] >= HELD
        self.hashed, self.owner = hashed[left], np.repeat(np.array(long, np.intp), sizes)[:n][left]

    def rarest(self, often: np.ndarray) -> np.ndarray:
        """Places of each text's piece that is held least often."""
        if not len(often):
            return np.zeros(0, np.intp)
        firsts = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]])
        return (np.minimum.reduceat((often.astype(np.int64) << 32) + np.arange(len(often)), firsts) & 0xFFFFFFFF).astype(np.intp)


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the span, place) of all places of spans."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]


def _grouped(owner: np.ndarray, member: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, members) by owner below n."""
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(n + 1)), member[order]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes)].astype(np.intp), column.flatten().to_numpy(zero_copy_only=False)


def _by_text(keys: list[str], members: np.ndarray) -> dict[str, np.ndarray]:
    """The members that hold each key."""
    held: dict[str, list[int]] = {}
    for key, member in zip(keys, members.tolist()):
        held.setdefault(key, []).append(member)
    return {key: np.array(x, np.intp) for key, x in held.items()}


_NONE = np.zeros(0, np.intp)


class Side:
    """The documents of one side of a block and what they can be found by."""

    def __init__(self, told: pa.Table):
        code = told["doc_id"].combine_chunks().dictionary_encode()
        self.ids, docs, kind = code.dictionary, code.indices.to_numpy(), told["kind"].to_numpy()
        pick = lambda k: (docs[kind == k].astype(np.intp), told.filter(pa.array(kind == k)))
        self.doc, names = pick("name")
        names = names.combine_chunks()
        column = lambda t, c: t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
        self.names = column(names, "key").to_pylist()
        (self.word_at, self.words), (self.root_at, self.roots) = _lists(column(names, "words")), _lists(column(names, "roots"))
        self.domain = column(names, "domain").to_numpy(zero_copy_only=False).astype(bool)
        self.size = np.diff(self.word_at)
        self.keyed = {k: (d, column(t, "key").to_pylist()) for k in ("code", "marker") for d, t in [pick(k)]}
        self.told = np.isin(np.arange(len(self.ids)), docs[kind == "told"])
        self.vectors = {k: (d, _lists(column(t, "v"))[1].astype(float)) for k in ("name vector", "document vector") for d, t in [pick(k)]}


class Library(Side):
    """A side with its look-ups."""

    def __init__(self, told: pa.Table):
        super().__init__(told)
        entries = np.arange(len(self.names))
        word_of = np.repeat(entries, self.size)
        known, word = np.unique(self.words, return_inverse=True)
        pairs, repeats = np.unique(word_of * max(1, len(known)) + word, return_counts=True)
        held, holder = known[pairs % max(1, len(known))], pairs // max(1, len(known))
        self.holding = Postings(held, holder)  # each name once
        self.again = Postings(np.repeat(held, repeats - 1), np.repeat(holder, repeats - 1))  # a name as often as a word stands in it once more
        root_of = np.repeat(entries, np.diff(self.root_at))
        long = self.size[root_of] >= 3
        self.rooted = Postings(self.roots[long], root_of[long])
        told_root = long & self.domain[root_of]
        self.rooted_domain = Postings(self.roots[told_root], root_of[told_root])
        self.equal = _by_text(self.names, entries)
        self.docs_of = {kind: _by_text(keys, docs) for kind, (docs, keys) in self.keyed.items()}
        self.pieces = Pieces(self.names)
        self.order = np.argsort(self.pieces.hashed, kind="stable")
        self.sorted = self.pieces.hashed[self.order]
        often = np.empty(len(self.order), np.intp)
        often[self.order] = np.searchsorted(self.sorted, self.sorted, "right") - np.searchsorted(self.sorted, self.sorted, "left")
        rare = self.pieces.rarest(often)
        rare = rare[np.argsort(self.pieces.hashed[rare], kind="stable")]
        self.rare, self.rare_owner = self.pieces.hashed[rare], self.pieces.owner[rare]

    def held(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(starts by asked name, own names) that may hold an asked name as a text or be held in it."""
        asked = Pieces(names)
        lo, hi = (np.searchsorted(self.sorted, asked.hashed, side) for side in ("left", "right"))
        rare = asked.rarest(hi - lo)
        i, p = _spans(lo[rare], hi[rare])
        j, r = _spans(*(np.searchsorted(self.rare, asked.hashed, side) for side in ("left", "right")))
        owner = np.concatenate([asked.owner[rare][i], asked.owner[j]])
        return _grouped(owner, np.concatenate([self.pieces.owner[self.order[p]], self.rare_owner[r]]), len(names))


def _contained(q: Side, at: int, lib: Library, maybe: np.ndarray, mark: np.ndarray, cover: float) -> np.ndarray:
    """The library's names that hold an asked name or are held in it (rows.features_contain). mark: zeros, and again at the end."""
    key, size, hits = q.names[at], int(q.size[at]), []
    if (size or len(key) >= HELD) and key in lib.equal:
        hits.append(lib.equal[key])
    if not key.strip(" "):
        return np.concatenate(hits) if hits else _NONE
    if size >= 3:
        hits += (lib.rooted if q.domain[at] else lib.rooted_domain).of(set(q.roots[q.root_at[at] : q.root_at[at + 1]].tolist()))
        words = q.words[q.word_at[at] : q.word_at[at + 1]].tolist()
        different = set(words)
        if found := lib.holding.of(different):
            mine = theirs = np.bincount(np.concatenate(found), minlength=len(lib.names))  # words shared
            if len(different) < size:
                mine = theirs + sum(np.bincount(x, minlength=len(lib.names)) for w in different for x in lib.holding.of([w] * (words.count(w) - 1)))
            if repeated := lib.again.of(different):
                theirs = theirs + np.bincount(np.concatenate(repeated), minlength=len(lib.names))
            near = np.flatnonzero(np.maximum(mine, theirs) >= 3 * cover)
            other = lib.size[near]
            near, other = near[other >= 3], other[other >= 3]
            hits.append(near[np.where(size <= other, mine[near] / size, theirs[near] / np.maximum(1, other)) >= cover])
    for h in hits:
        mark[h] = 1
    left = np.unique(maybe[mark[maybe] == 0])
    held = [k for k in left.tolist() if (b := lib.names[k]).strip(" ") and ((len(key) >= HELD and key in b) or (len(b) >= HELD and b in key))]
    mark[held] = 1
    out = np.concatenate([*hits, np.array(held, np.intp)])
    out = out[mark[out] == 1]
    mark[out] = 0
    return out


def _near(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of vectors of unit length with a cosine of at least `least`; close calls are summed in the order of places."""
    ones, others = [_NONE], [_NONE]
    for k in range(0, len(a), VECTORS):
        i, j = np.nonzero(a[k : k + VECTORS] @ b.T >= least - 1e-9)
        exact = np.zeros(len(i))
        for x in range(a.shape[1]):
            exact += a[i + k, x] * b[j, x]
        ones.append(i[exact >= least - 1e-12] + k)
        others.append(j[exact >= least - 1e-12])
    return np.concatenate(ones), np.concatenate(others)


def _pairs(q: Side, lib: Library, cover: float, least: float, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, documents, flags) of the queries with pairs; of a query told by code those by code only."""
    (qd, qv), (ld, lv) = q.vectors["name vector"], lib.vectors["name vector"]
    one, other = _near(qv.reshape(-1, dim), lv.reshape(-1, dim), least)
    near_at, near = _grouped(qd[one], ld[other], len(q.ids))
    keyed = {k: _grouped(d, np.arange(len(d)), len(q.ids)) for k, (d, _) in q.keyed.items()}
    by = _grouped(q.doc, np.arange(len(q.doc)), len(q.ids))
    flags, mark = np.zeros(len(lib.ids), np.uint8), np.zeros(len(lib.names), np.uint8)
    todo: list[tuple[int, list[int]]] = []

    def told(part: list[tuple[int, list[int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        starts, maybe = lib.held([q.names[k] for _, names in part for k in names])
        n = 0
        for query, names in part:
            flags[:] = 0
            for kind, flag in (("code", 2), ("marker", 4)):
                for k in keyed[kind][1][keyed[kind][0][query] : keyed[kind][0][query + 1]].tolist():
                    flags[lib.docs_of[kind].get(q.keyed[kind][1][k], _NONE)] |= flag
            for k in names:
                flags[lib.doc[lib.equal.get(q.names[k], _NONE)]] |= 1
                flags[lib.doc[_contained(q, k, lib, maybe[starts[n] : starts[n + 1]], mark, cover)]] |= 8
                n += 1
            flags[near[near_at[query] : near_at[query + 1]]] |= 16
            docs = np.flatnonzero(flags & 2 if q.told[query] else flags)
            if len(docs):
                yield query, docs, flags[docs]

    held = 0
    for query in range(len(q.ids)):
        if q.told[query]:  # names don't matter if no document here shares a code
            codes = keyed["code"][1][keyed["code"][0][query] : keyed["code"][0][query + 1]].tolist()
            if not any(q.keyed["code"][1][k] in lib.docs_of["code"] for k in codes):
                continue
        todo.append((query, by[1][by[0][query] : by[0][query + 1]].tolist()))
        held += len(todo[-1][1])
        if held >= NAMES:
            yield from told(todo)
            todo, held = [], 0
    yield from told(todo)


def _best(q: Side, lib: Library, most: int, dim: int) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """Which of a query's documents can be among its `most` best of all blocks, by markers, exactness, document vectors and id."""
    (qd, qv), (ld, lv) = q.vectors["document vector"], lib.vectors["document vector"]
    qv, lv = qv.reshape(-1, dim), lv.reshape(-1, dim)
    of_query, of_doc = _grouped(qd, np.arange(len(qd)), len(q.ids)), _grouped(ld, np.arange(len(ld)), len(lib.ids))
    lib_markers = np.bincount(lib.keyed["marker"][0], minlength=len(lib.ids))
    mine: dict[int, list[str]] = {}
    for d, m in zip(q.keyed["marker"][0].tolist(), q.keyed["marker"][1]):
        mine.setdefault(d, []).append(m)
    norms = lambda v: np.sqrt(sum(v[:, x] * v[:, x] for x in range(dim)))
    qn, ln = norms(qv), norms(lv)
    ids, same = np.array(lib.ids.to_pylist(), object), dict(zip(q.ids.to_pylist(), range(len(q.ids))))
    own = np.array([same.get(x, -1) for x in ids])
    shared = np.zeros(len(ids), np.intp)

    def pick(query: int, docs: np.ndarray, flags: np.ndarray) -> np.ndarray:
        keep = np.flatnonzero(own[docs] != query)
        shared[:] = 0
        for m in mine.get(query, []):
            shared[lib.docs_of["marker"].get(m, _NONE)] += 1
        if len(keep) and shared[docs[keep]].max():  # of one query the recall goes with what is shared
            keep = keep[shared[docs[keep]] == shared[docs[keep]].max()]
            keep = keep[lib_markers[docs[keep]] == lib_markers[docs[keep]].min()]  # then precision and what is beyond go with the number of markers
        if (flags[keep] & 15).any():
            keep = keep[(flags[keep] & 15) > 0]
        if len(keep) <= most:
            return keep
        cosine = np.full(len(keep), -np.inf)
        which, places = _spans(of_doc[0][docs[keep]], of_doc[0][docs[keep] + 1])
        rows = of_doc[1][places]
        for k in of_query[1][of_query[0][query] : of_query[0][query + 1]]:
            dot = np.zeros(len(rows))
            for x in range(dim):
                dot += lv[rows, x] * qv[k, x]
            np.maximum.at(cosine, which, dot / (qn[k] * ln[rows]))
        bound = np.partition(cosine, len(cosine) - most)[len(cosine) - most] - 4e-9  # they are rounded to nine places later
        near = np.flatnonzero(cosine >= bound)
        near = near[np.lexsort((ids[docs[keep[near]]], -cosine[near]))]
        first = np.flatnonzero(np.r_[True, cosine[near][1:] != cosine[near][:-1]])
        return keep[near[np.arange(len(near)) - np.repeat(first, np.diff(np.r_[first, len(near)])) < most]]  # of equal vectors the least ids

    return pick


def _compared(cover: float, least: float, dim: int, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asked = table["asked"].combine_chunks()
        q, lib = Side(table.filter(asked)), Library(table.filter(pc.invert(asked)))
        del table, asked
        pick = _best(q, lib, most, dim) if most else None
        names = [*FLAGS]
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        count = 0

        def batch() -> pa.RecordBatch:
            queries = np.repeat([k for k, _, _ in held], [len(d) for _, d, _ in held])
            docs, flags = np.concatenate([d for _, d, _ in held]), np.concatenate([f for _, _, f in held])
            columns = [q.ids.take(pa.array(queries)), lib.ids.take(pa.array(docs)), *(pa.array((flags & FLAGS[x]) > 0) for x in names)]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", *names])

        for query, docs, flags in _pairs(q, lib, cover, least, dim):
            if pick:
                best = pick(query, docs, flags)
                docs, flags = docs[best], flags[best]
            held.append((query, docs, flags))
            count += len(docs)
            if count >= BATCH:
                yield batch()
                held, count = [], 0
        if count:
            yield batch()

    return run


def _spread(df: DataFrame, asked: bool, own: int, other: int) -> DataFrame:
    """Rows with the blocks they go to: their own number with every one of the other side."""
    mine, each = F.pmod(F.xxhash64("doc_id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    return df.select(F.lit(asked).alias("asked"), *df.columns, (mine if asked else each).alias("qb"), (each if asked else mine).alias("db"))


def passed(queries: DataFrame, library: DataFrame, told: DataFrame, vectors: dict[str, tuple[DataFrame, DataFrame]], least: float, dim: int, cover: float = 0.75, most: int | None = None) -> DataFrame:
    """query_id, doc_id and flags of the pairs that pass, each once.

    queries, library: doc_id, kind, key; told: doc_id of the queries of which only pairs by code
    count; vectors: doc_id, v of queries and library by kind ("name vector" of unit length,
    "document vector"). most: only pairs that can be among so many best of a query, never a document with itself.
    """
    f = R.name_features(F.col("key"))
    number = lambda a: F.transform(a, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def rows(keys: DataFrame, side: int) -> DataFrame:
        names = keys.where("kind = 'name'").select("doc_id", "kind", "key", f.alias("f")).select("doc_id", "kind", "key", number(F.col("f.words")).alias("words"), number(F.array_distinct("f.roots")).alias("roots"), F.col("f.domain").alias("domain"))
        blank = lambda df, kind, key, v: df.select("doc_id", kind.alias("kind"), key.alias("key"), none.alias("words"), none.alias("roots"), F.lit(False).alias("domain"), v.alias("v"))
        no, text = F.array().cast("array<double>"), F.lit(None).cast("string")
        out = names.withColumn("v", no).unionByName(blank(keys.where("kind <> 'name'"), F.col("kind"), F.col("key"), no))
        for kind, both in vectors.items():
            out = out.unionByName(blank(both[side], F.lit(kind), text, F.transform("v", lambda x: x.cast("double"))))
        return (out if side else out.unionByName(blank(told, F.lit("told"), text, no))).where("doc_id is not null")

    count = lambda df: df.agg(F.approx_count_distinct("doc_id")).first()[0]
    qn, ln = count(queries), count(library)
    qb, db = max(1, -(-qn // QUERIES)), max(1, min(TASKS, -(-ln // FEW)), -(-ln // DOCUMENTS))
    sent = _spread(rows(queries, 0), True, qb, db).unionByName(_spread(rows(library, 1), False, db, qb))
    spread = sent.repartition(min(4 * qb * db, 4000), "qb", "db")
    return spread.groupBy("qb", "db").applyInArrow(_compared(cover, least, dim, most), "query_id string, doc_id string, " + ", ".join(f"{x} boolean" for x in FLAGS))
