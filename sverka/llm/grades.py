"""Reading level of documents by a Rasch model of word occurrence.

Every document has a level theta and every word an ease psi and a difficulty beta: a word
occurs in a document in proportion to exp(psi + beta * theta), shared out among the words
of its script (the Rasch model of counts; so the language of a text says nothing about its
level). The sum of its words' difficulties is all a document tells of its level. Estimation
alternates until the levels settle: levels given the words (the likelihood's peak, with a
prior), words given the levels (Newton's steps). The rated documents anchor the scale:
after each step levels are mapped so that documents of a rating have that level on average.
Words are hashed into a fixed number of places, so what a round exchanges is bounded
whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sverka.session import written

#: Places that words are hashed into, the first half for Latin words; bounds the model.
PLACES = 1 << 16
#: Weight of the prior that words have no difficulty, and variance of the prior of levels.
RIDGE, SPREAD = 2.0, 4.0
#: Levels are settled when they move less than this on average.
SETTLED = 0.01
#: Step of the grid on which likelihoods of levels are looked at.
STEP = 0.1
#: Log-ease of a word never seen.
UNSEEN = -30.0
_words = re.compile(r"[^\W\d_]+")


def place_of(word: str) -> int:
    """Place of a word: a hash within the half of its script."""
    half = PLACES // 2
    h = zlib.crc32(word.encode("utf-8", "replace")) % half
    return h if ord(word[0]) < 0x250 else h + half


def word_table(df: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    """key, words (places, ascending), counts of each text of at least least_words runs without white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keep, places, counts, ends = [], [], [], [0]
            for k, t in enumerate(batch.column(1).to_pylist()):
                if t is None or len(t.split()) < least_words:
                    continue
                found = _words.findall(t.lower())
                try:
                    ids = [known[w] for w in found]
                except KeyError:
                    if len(known) > 400_000:
                        known.clear()
                    for w in found:
                        known[w] = place_of(w)
                    ids = [known[w] for w in found]
                p, c = np.unique(np.array(ids, np.int32), return_counts=True)
                keep.append(k)
                places.append(p)
                counts.append(c)
                ends.append(ends[-1] + len(p))
            flat = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (places, counts))
            offsets = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *lists], names=[key, "words", "counts"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, words array<int>, counts array<int>")


def rated_levels(ratings: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """key, m: mean of a document's ratings within the scale; null ratings and exact copies don't count."""
    fine = ratings.where(F.col("grade").between(low, high) & F.col(key).isNotNull()).select(key, "rater", "grade").distinct()
    return fine.groupBy(key).agg(F.avg("grade").alias("m"))


@dataclass
class Scale:
    """The grid of levels, centred on the middle of the rating scale."""

    low: int
    high: int
    grid: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.middle = (self.low + self.high) / 2
        reach = (self.high - self.low) / 2 + 1
        self.grid = np.linspace(-reach, reach, round(2 * reach / STEP) + 1)

    def near(self, theta: np.ndarray) -> np.ndarray:
        """Nearest grid point of each level."""
        return np.clip(np.rint((theta - self.grid[0]) / STEP), 0, len(self.grid) - 1).astype(int)


class Words:
    """Ease and difficulty of the words of each place."""

    def __init__(self, psi: np.ndarray, beta: np.ndarray, scale: Scale):
        self.psi, self.beta, self.scale = psi, beta, scale
        self.log_total = self._log_total()

    def _log_total(self) -> np.ndarray:
        """(2 scripts, grid): log of the sum over the words of a script."""
        e = np.exp(self.psi[:, None] + self.beta[:, None] * self.scale.grid)
        half = PLACES // 2
        return np.log(np.stack([e[:half].sum(0), e[half:].sum(0)]) + 1e-300)

    def levels(self, batch: pa.RecordBatch) -> np.ndarray:
        """theta of each document by its words alone: the peak of likelihood and prior, between grid points by a parabola."""
        words, counts, row, sizes = _occurrences(batch)
        n, grid = len(sizes), self.scale.grid
        told = np.bincount(row, counts * self.beta[words], minlength=n)
        fit = told[:, None] * grid - sizes @ self.log_total - grid**2 / (2 * SPREAD)
        k, r = np.clip(fit.argmax(1), 1, len(grid) - 2), np.arange(n)
        left, here, right = fit[r, k - 1], fit[r, k], fit[r, k + 1]
        return grid[k] + STEP * np.clip(0.5 * (left - right) / np.minimum(left - 2 * here + right, -1e-9), -1, 1)

    def fitted(self, s0: np.ndarray, s1: np.ndarray, sizes: np.ndarray, steps: int = 6) -> Words:
        """Newton's steps for every word's ease and difficulty, all words at once.

        s0, s1: occurrences of each word and their sum of levels; sizes (2, grid): words of
        documents of a level, by script. Words that don't occur stay unseen.
        """
        grid, half, seen = self.scale.grid, PLACES // 2, s0 > 0
        start = np.log(np.maximum(s0, 1e-9) / max(1.0, s0.sum()))
        now = Words(np.where(seen, np.where(self.psi > UNSEEN, self.psi, start), UNSEEN), self.beta, self.scale)
        side = (np.arange(PLACES) >= half).astype(int)
        for _ in range(steps):
            w = sizes[side] * np.exp(now.psi[:, None] + now.beta[:, None] * grid - now.log_total[side])
            e0, e1, e2 = w.sum(1), w @ grid, w @ grid**2
            g0, g1 = s0 - e0, s1 - e1 - RIDGE * now.beta
            h00, h01, h11 = e0 + 1e-3, e1, e2 + RIDGE
            det = h00 * h11 - h01**2
            d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            psi = np.where(seen, now.psi + np.clip(d0, -1, 1), UNSEEN)
            now = Words(psi, np.where(seen, np.clip(now.beta + np.clip(d1, -1, 1), -4, 4), 0.0), self.scale)
        return now


def _occurrences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts, document row of each word, and (documents, 2 scripts) the sums of counts."""
    words, counts = batch.column("words").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(float)
    lengths = np.diff(batch.column("words").offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    other = words >= PLACES // 2
    sizes = np.stack([np.bincount(row[~other], counts[~other], minlength=len(lengths)), np.bincount(row[other], counts[other], minlength=len(lengths))], 1)
    return words, counts, row, sizes


def _mean(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("m").to_numpy(zero_copy_only=False).astype(float)


class Anchors:
    """Monotone map of free levels to the rating scale, through the average free level of each rating."""

    def __init__(self, free: list[float], rated: list[float]):
        self.free, self.rated = np.maximum.accumulate(np.array(free)), np.array(rated)

    def __call__(self, theta: np.ndarray) -> np.ndarray:
        x, y = self.free, self.rated
        if len(x) < 2 or x[-1] - x[0] < 1e-6:
            return theta
        slope = (y[-1] - y[0]) / (x[-1] - x[0]) / 2  # beyond the ends half as steep
        out = np.interp(theta, x, y)
        return np.where(theta < x[0], y[0] + (theta - x[0]) * slope, np.where(theta > x[-1], y[-1] + (theta - x[-1]) * slope, out))


def _settled(batch: pa.RecordBatch, words: Words, anchors: Anchors) -> np.ndarray:
    """theta of each document on the rating scale; a rated one lies halfway to its rating."""
    scale, theta = words.scale, anchors(words.levels(batch))
    given = _mean(batch) - scale.middle
    return np.clip(np.where(np.isnan(given), theta, (theta + given) / 2), scale.grid[0], scale.grid[-1])


def word_sums(table: DataFrame, scale: Scale, levels, before=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(s0, s1, sizes) as Words.fitted takes them, and how far levels moved from those of before on average.

    levels and before give the levels of a batch. Each task adds up its documents first, so at
    most PLACES rows and one row for each grid point leave it.
    """
    points = len(scale.grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s0, s1, sizes, moved, n = np.zeros(PLACES), np.zeros(PLACES), np.zeros((2, points)), 0.0, 0
        for batch in batches:
            theta = levels(batch)
            if before is not None:
                moved += float(np.abs(theta - before(batch)).sum())
            words, counts, row, own = _occurrences(batch)
            s0 += np.bincount(words, counts, minlength=PLACES)
            s1 += np.bincount(words, counts * theta[row], minlength=PLACES)
            at, n = scale.near(theta), n + len(theta)
            sizes += np.stack([np.bincount(at, own[:, k], minlength=points) for k in (0, 1)])
        at = np.flatnonzero(s0)
        place = np.concatenate([at, PLACES + np.arange(2 * points), [-1]]).astype(np.int32)
        a = np.concatenate([s0[at], sizes.ravel(), [moved]])
        b = np.concatenate([s1[at], np.zeros(2 * points), [n]])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(a), pa.array(b)], names=["place", "a", "b"])

    got = table.mapInArrow(run, "place int, a double, b double").groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()  # bounded by PLACES
    a, b = np.zeros(PLACES + 2 * points + 1), np.zeros(PLACES + 2 * points + 1)
    at = got["place"].to_numpy()
    a[at], b[at] = got["a"].to_numpy(), got["b"].to_numpy()
    return a[:PLACES], b[:PLACES], a[PLACES:-1].reshape(2, points), a[-1] / max(1.0, b[-1])


def rated_counts(rated: DataFrame, scale: Scale, levels) -> np.ndarray:
    """(ratings, grid): how many documents of a mean rating (rounded) have a level near a grid point."""
    count, points = scale.high - scale.low + 1, len(scale.grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, points))
        for batch in batches:
            np.add.at(total, (np.rint(_mean(batch)).astype(int) - scale.low, scale.near(levels(batch))), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "n"])

    got = rated.mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(count * points)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(count, points)


def _anchors(counts: np.ndarray, scale: Scale) -> Anchors:
    told = [k for k in range(len(counts)) if counts[k].any()]
    return Anchors([float(counts[k] @ scale.grid / counts[k].sum()) for k in told], [scale.low + k - scale.middle for k in told])


def cuts(counts: np.ndarray, scale: Scale) -> np.ndarray:
    """Levels between the grades: each where fewest rated documents lie on the wrong side, in the middle of a tie."""
    edges = np.concatenate([[-np.inf], scale.grid[:-1] + STEP / 2, [np.inf]])
    out = []
    for k in range(1, len(counts)):
        below, above = counts[:k].sum(0), counts[k:].sum(0)
        wrong = np.concatenate([[0], np.cumsum(above)]) + below.sum() - np.concatenate([[0], np.cumsum(below)])
        best = np.flatnonzero(wrong == wrong.min())
        out.append(edges[best[-1]] if not below.any() or not above.any() else edges[best[len(best) // 2]])
        if not above.any():
            out[-1] = np.inf
        elif not below.any():
            out[-1] = -np.inf
    return np.maximum.accumulate(np.array(out))


def grade(df: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 40, low: int = 1, high: int = 5, most: int = 30) -> DataFrame:
    """key, grade (int), level (double, on the rating scale) of each text of at least least_words words.

    ratings: key, rater, grade. Shorter, empty and null texts give no row. Repeated rows of
    df give repeated results. Without any usable rating nothing is known about the scale
    and every text gets the middle grade. Texts are read whole. Words and levels are
    estimated in turn until levels move less than SETTLED on average, at most `most` times
    (the last estimate then counts).
    """
    spark, scale = df.sparkSession, Scale(low, high)
    words = word_table(df, key, text, least_words).join(rated_levels(ratings, key, low, high), key, "left")
    table = written(words, "words")
    rated = written(table.where("m is not null"), "rated-words")
    kind = df.schema[key].dataType.simpleString()
    if rated.isEmpty():
        return table.select(key, F.lit((low + high) // 2).cast("int").alias("grade"), F.lit(scale.middle).alias("level"))
    context, middle = spark.sparkContext, scale.middle
    s0, s1, sizes, _ = word_sums(rated, scale, lambda batch: _mean(batch) - middle)
    model = Words(np.full(PLACES, UNSEEN), np.zeros(PLACES), scale).fitted(s0, s1, sizes)
    before = None
    for _ in range(most):
        shared = context.broadcast(model)  # PLACES x 2 numbers
        anchors = _anchors(rated_counts(rated, scale, lambda batch, w=shared: w.value.levels(batch)), scale)
        now = lambda batch, w=shared, a=anchors: _settled(batch, w.value, a)
        s0, s1, sizes, moved = word_sums(table, scale, now, before)
        if before is not None and moved < SETTLED:
            break
        model, before = model.fitted(s0, s1, sizes), now
    counts = rated_counts(rated, scale, lambda batch, w=shared: w.value.levels(batch))
    between = cuts(counts, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free, own = shared.value.levels(batch), _settled(batch, shared.value, anchors) + middle
            best, given = low + np.searchsorted(between, free), _mean(batch)
            both = np.where(np.isnan(given), best, np.floor((best + np.nan_to_num(given)) / 2 + 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both.astype(np.int32)), pa.array(own)], names=[key, "grade", "level"])

    return table.mapInArrow(run, f"`{key}` {kind}, grade int, level double")
