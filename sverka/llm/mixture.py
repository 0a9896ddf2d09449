"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source gets the same expected number of copies; its whole part is
given to all, its fraction is drawn. The draw moves the vector of inclusion probabilities
through the null space of the balancing equations (document count and tokens), so both
totals stay as they are while more and more probabilities become 0 or 1. That runs in
blocks; the few documents left in each block are gathered into new blocks until one is
left, and only a handful of documents remain for the landing.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sverka.session import checkpoint

#: Documents of a block of the flight.
BLOCK = 4000
_NEAR = 1e-9


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Moves probabilities until at most two are fractional; sum and size-weighted sum stay.

    Three fractional documents at a time move along the one direction that keeps both
    sums; one of them then becomes 0 or 1 and the next takes its place.
    """
    p, active = list(p), []
    for k in range(len(p)):
        if not _NEAR < p[k] < 1 - _NEAR:
            p[k] = round(p[k])
            continue
        active.append(k)
        if len(active) < 3:
            continue
        i, j, m = active
        u = (size[m] - size[j], size[i] - size[m], size[j] - size[i])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(active, u) if d)
        down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(active, u):
            p[k] = min(1.0, max(0.0, p[k] + step * d))
        still = []
        for k in active:
            if _NEAR < p[k] < 1 - _NEAR:
                still.append(k)
            else:
                p[k] = float(round(p[k]))
        active = still
    return p


def landing(p: list[float], size: list[float], swaps: int = 3) -> list[int]:
    """The nearest whole choice by tokens for the few documents left, then by count.

    What the few can't balance is evened out by swapping a chosen document with one that
    isn't, as close as may be to the tokens still wanted; the count stays.
    """
    left = [k for k, x in enumerate(p) if _NEAR < x < 1 - _NEAR]
    out = [round(x) for x in p]
    want, count = sum(p[k] * size[k] for k in left), sum(p[k] for k in left)
    best = min(itertools.product((0, 1), repeat=len(left)), key=lambda c: (abs(sum(c) - count) >= 1, abs(sum(x * size[k] for x, k in zip(c, left)) - want), c), default=())
    for k, x in zip(left, best):
        out[k] = x
    s, chosen = np.asarray(size, float), np.asarray(out, bool)
    lack = want - sum(x * size[k] for x, k in zip(best, left))
    for _ in range(swaps):
        ins, outs = np.flatnonzero(chosen), np.flatnonzero(~chosen)
        if not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(s[outs], kind="stable")]
        at = np.searchsorted(s[outs], s[ins] + lack)
        near = np.stack([np.clip(at - 1, 0, len(outs) - 1), np.clip(at, 0, len(outs) - 1)], 1)
        miss = np.abs(lack - (s[outs][near] - s[ins][:, None]))
        i, j = np.unravel_index(miss.argmin(), miss.shape)
        if miss[i, j] >= abs(lack):
            break
        a, b = ins[i], outs[near[i, j]]
        chosen[a], chosen[b] = False, True
        lack -= s[b] - s[a]
    return chosen.astype(int).tolist()


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """A row for each source of targets: share, whole copies, fraction, bounds; as many as targets has.

    Shares are the weights of the sources that hold tokens, brought to a sum of one. total
    is the tokens of the mixture; by default the most that no source's cap falls short of.
    If it is set higher, a source gives all its capped copies and falls short. Repeated or
    null rows of targets, weights that aren't positive and caps below one don't count.
    """
    fine = targets.where("source is not null and target_weight > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("cap"))
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in fine.join(have, "source", "left").orderBy("source").collect()]
    used = [r for r in rows if (r["tokens"] or 0) > 0]
    weight = sum(r["w"] for r in used)
    most = min((r["cap"] * r["tokens"] * weight / r["w"] for r in used), default=0.0)
    total = most if total is None else total
    for r in rows:
        r["share"] = r["w"] / weight if r in used else 0.0
        copies = min(r["cap"], total * r["share"] / r["tokens"]) if r in used else 0.0
        r["whole"] = int(copies + _NEAR)
        r["part"] = max(0.0, copies - r["whole"]) if r["whole"] < r["cap"] else 0.0
    return rows


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, repeats (1 or more) of the documents of the mixture.

    sizes: doc_id, source, n_tokens. Documents of other sources, of no source or without
    tokens aren't used; an empty table gives an empty mixture. A source of any size is
    drawn in blocks, no group of it goes to one task.
    """
    spark = sizes.sparkSession
    sizes = sizes.select("doc_id", "source", "n_tokens")
    rows = plan(sizes, targets, total)
    schema = "source string, whole int, part double"
    chosen = spark.createDataFrame([(r["source"], r["whole"], r["part"]) for r in rows], schema)
    known = sizes.where("n_tokens > 0").join(F.broadcast(chosen), "source")  # as many rows as targets has
    drawn = known.where("part > 0").select("doc_id", "source", F.col("n_tokens").cast("double").alias("n_tokens"), F.col("part").alias("p"))
    counts = {r["source"]: r["docs"] for r in rows if r["part"] > 0}
    kind = f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, source string, n_tokens double, p double"
    settled, level = [], 0

    def fly(last: bool):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("doc_id", kind="stable")
            p = flight(f["p"].tolist(), f["n_tokens"].tolist(), random.Random(f"{seed}/{level}/{f['source'].iat[0]}/{f['block'].iat[0]}"))
            return f.assign(p=[float(x) for x in landing(p, f["n_tokens"].tolist())] if last else p).drop(columns="block")

        return run

    open_docs = drawn
    while counts:
        blocks = {s: -(-n // BLOCK) for s, n in counts.items()}
        last = max(blocks.values()) == 1
        number = F.create_map(*(F.lit(x) for s, n in blocks.items() for x in (s, n)))[F.col("source")]
        blocked = open_docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), number))
        flown = checkpoint(blocked.groupBy("source", "block").applyInPandas(fly(last), kind))
        settled.append(flown.where("p = 1").select("doc_id", "source"))
        if last:
            break
        open_docs = flown.where("p > 0 and p < 1")
        counts = {r["source"]: r["n"] for r in open_docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
        level += 1
    extra = spark.createDataFrame([], f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, source string")
    for one in settled:
        extra = extra.unionByName(one)
    more = extra.groupBy("doc_id", "source").agg(F.lit(1).alias("extra"))
    full = known.join(more, ["doc_id", "source"], "left").withColumn("repeats", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return full.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(mixture: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source of targets: target and actual share of the mixture's tokens, tokens, documents, most repeats."""
    rows = plan(sizes, targets)
    wanted = mixture.sparkSession.createDataFrame([(r["source"], float(r["share"])) for r in rows], "source string, target_share double")
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("docs"), F.max("repeats").alias("most_repeats"))
    whole = mixture.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("whole"))
    out = wanted.join(got, "source", "left").crossJoin(whole)  # one row on the right
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
