"""Garbled text from a wrong character encoding, found and restored.

A multinomial classifier on hashed byte bigrams is trained on records garbled on purpose:
clean records of the table, passed through every chain of a wrong decoding. It predicts
the chain of a record; the chain is inverted on every run of non-ASCII characters (all
encodings here agree on ASCII), and the result counts only if every run decodes strictly,
garbles back into what was there, and the same classifier takes it for clean text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the hashed space of byte bigrams.
SPACE = 1 << 13
#: At most so many clean records are taken for training (documented bound of the sample).
TRAIN_LIMIT = 4000
#: A restored text's mean log-likelihood a bigram must exceed the garbled one's by so much.
GAIN = 0.5
#: A text inverted as a whole is preferred by so much to one inverted in parts.
WHOLE = 0.2

_SINGLE = ["cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5"]
_WRONG = ["latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "mac-cyrillic", "iso8859-5"]
#: A chain is a tuple of (encoding the bytes were in, encoding they were read in), first mistake first.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *(((a, b),) for a in ["utf-8", *_SINGLE] for b in _WRONG if a != b),
    *((("cp1252", b),) for b in ("cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman")),
    *((("utf-8", a), ("utf-8", b)) for a in ("latin-1", "cp1252", "cp1251", "mac-roman") for b in ("latin-1", "cp1252", "cp1251", "mac-roman")),
]
# Bytes as they count: ASCII marks are spaces.
_counted = np.array([32 if c < 128 and not chr(c).isalnum() else c for c in range(256)], np.uint8)
_runs = re.compile(r"[^\x00-\x7f]+")
#: From the first to the last non-ASCII character, with the ASCII letter or digit beside.
_core = re.compile(r"[A-Za-z0-9]?[^\x00-\x7f](?:.*[^\x00-\x7f])?[A-Za-z0-9]?", re.S)
#: A question mark where no text has one stands for a lost character.
_lost = re.compile(r"\ufffd|\?(?=\?|[^\W\d_])")


class _Characters(dict):
    """A translation of characters; ASCII stays, what has none becomes U+FFFD."""

    def __missing__(self, code: int) -> str:
        return chr(code) if code < 128 else "\ufffd"


@lru_cache(maxsize=None)
def _tables(codec: str) -> tuple[_Characters, _Characters]:
    """(byte as a Latin-1 character to character, and back) of a one-byte codec; bytes without a character read as the control of that number."""
    there = {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)}
    return _Characters(there), _Characters({ord(c): chr(b) for b, c in there.items()})


def _as_bytes(text: str, codec: str) -> str:
    """The text's bytes in an encoding, as Latin-1 characters; U+FFFD for a character without any."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1") if codec == "utf-8" else text.translate(_tables(codec)[1])


def _as_text(data: str, codec: str) -> str:
    """Bytes (as Latin-1 characters) read in an encoding; ValueError if it can't be."""
    if codec == "utf-8":
        return data.encode("latin-1").decode("utf-8")
    return data.translate(_tables(codec)[0])


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The text after each step's bytes were read in the wrong encoding; ValueError if it can't be."""
    for written, read in chain:
        text = _as_text(_as_bytes(text, written), read)
        if "\ufffd" in text:
            raise ValueError("not in this encoding")
    return text


def ungarble(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """Inverse of garble; ValueError if it isn't strictly decodable."""
    for written, read in reversed(chain):
        text = _as_text(_as_bytes(text, read), written)
        if "\ufffd" in text:
            raise ValueError("not in this encoding")
    return text


@lru_cache(maxsize=None)
def _arrays(codec: str) -> tuple[np.ndarray, np.ndarray]:
    """The tables of a one-byte codec as arrays: byte to code point, code point to byte (-1: none)."""
    there = np.array([ord(c) for _, c in sorted(_tables(codec)[0].items())], np.uint32)
    back = np.full(0x10000, -1, np.int32)
    back[there] = np.arange(256)
    return there, back


def garbled_lines(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The lines of a text that a chain changes, garbled; lines it can't be applied to are left out."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for written, read in chain:
        if written == "utf-8":
            data = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        else:
            data = np.where(points < 0x10000, _arrays(written)[1][np.minimum(points, 0xFFFF)], -1)
        points = np.where(data < 0, 0xFFFD, _arrays(read)[0][data]).astype(np.uint32)
    bad = points.tobytes().decode("utf-32-le", "surrogatepass")
    return " ".join(b for b, t in zip(bad.split("\n"), text.split("\n")) if b != t and "\ufffd" not in b)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams of bytes that hold a byte over 127, and where they start; ASCII marks count as spaces."""
    data = _counted[data]
    at = np.flatnonzero((data[:-1] > 127) | (data[1:] > 127))
    pair = (data[at].astype(np.uint32) << 8) | data[at + 1]
    return ((pair * np.uint32(2654435761)) >> np.uint32(19)) & np.uint32(SPACE - 1), at


def features(text: str) -> np.ndarray:
    """Hashed byte bigrams that hold a byte of a non-ASCII character."""
    return _hashed(np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8))[0]


class ChainModel:
    """Multinomial model of hashed byte bigrams; classes 0 and 1 are clean Russian and western text, class k + 2 is chain k."""

    def __init__(self, russian: list[str], western: list[str]):
        counts = np.zeros((len(CHAINS) + 2, SPACE))
        clean = [" ".join(t.split()) for t in [*russian, *western]]
        lines = "\n".join(clean)
        for k, texts in enumerate((russian, western)):
            counts[k] = np.bincount(features(" ".join(texts)), minlength=SPACE)
        for k, chain in enumerate(CHAINS):
            counts[k + 2] = np.bincount(features(garbled_lines(lines, chain)), minlength=SPACE)
        seen = counts.sum(1, keepdims=True)
        self.log = np.log((counts + 0.05) / (seen + 0.05 * SPACE)).astype(np.float32)
        self.log[seen[:, 0] == 0] = -1e3
        own = self.clean_scores(clean) if clean else np.zeros(0)
        #: Mean log-likelihood a bigram that clean text has at least.
        self.least = float(np.percentile(own, 0.2)) - 0.5 if len(own) else -8.0
        #: A text restored in parts must be as likely as most clean ones for other chains not to be tried.
        self.usual = float(np.percentile(own, 20)) if len(own) else 0.0
        #: A text as likely as nearly all clean ones is clean, and a chain that gives one is the right one.
        self.sure = (self.usual + self.least) / 2

    def clean_scores(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood of a bigram of each text as the better of the two kinds of clean text."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        f, at = _hashed(np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8))
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        of = np.searchsorted(starts, at, side="right") - 1
        n = np.bincount(of, minlength=len(texts))
        sums = np.stack([np.bincount(of, self.log[k, f], minlength=len(texts)) for k in (0, 1)])
        return np.where(n > 0, sums.max(0) / np.maximum(1, n), 0.0)

    def clean_score(self, f: np.ndarray) -> float:
        """The same of one text's bigrams."""
        return float(self.log[:2, f].sum(1).max()) / len(f) if len(f) else 0.0

    def _classes(self, f: np.ndarray) -> np.ndarray:
        """Log-likelihood of every class; by counts for a long text, so memory doesn't follow its length."""
        return self.log @ np.bincount(f, minlength=SPACE).astype(np.float32) if len(f) > SPACE // 4 else self.log[:, f].sum(1)

    def restore_all(self, texts: list[str | None]) -> list[str | None]:
        """The originals of garbled texts; None for clean and for lost ones.

        Only the part between the first and the last non-ASCII character is looked at, each
        different one once; the clean ones are told all at once.
        """
        parts = [_core.search(t) if t is not None and not t.isascii() else None for t in texts]
        cores = list(dict.fromkeys(m[0] for m in parts if m))
        sure = self.clean_scores(cores) >= self.sure if cores else []
        done = {c: None if ok else self._restored(c) for c, ok in zip(cores, sure)}
        return [None if m is None or (x := done[m[0]]) is None or "\ufffd" in t else t[: m.start()] + x + t[m.end() :] for t, m in zip(texts, parts)]

    def restore(self, text: str | None) -> str | None:
        """The original of one garbled text; None for a clean or a lost one."""
        return self.restore_all([text])[0]

    def _restored(self, text: str) -> str | None:
        """The original of one text: chains are tried from the likeliest on, as long as they are likelier than clean text, until one gives a text as likely as nearly all clean ones."""
        if "\ufffd" in text:
            return None
        f = features(text)
        own = self.clean_score(f)
        scores = self._classes(f)
        order, best = np.argsort(-scores, kind="stable"), None
        for k in order[scores[order] > scores[:2].max()]:
            for whole in (True, False):
                got = self._invert(text, CHAINS[k - 2], whole)
                every = whole and got is not None and self._every(text, CHAINS[k - 2])
                score = self._reads(got, every) if got is not None else None
                if score is not None and (best is None or score + WHOLE * whole > best[0] + 1e-6):
                    best = (score + WHOLE * whole, got)
                right = best is not None and best[0] >= (self.sure if whole else self.usual) + WHOLE
                # runs that all decode as several bytes a character weren't clean by chance
                if every or right:
                    break
            if right:  # the next chains are less likely ones
                break
        return best[1] if best and best[0] > own + GAIN else None

    def _reads(self, text: str, every: bool) -> float | None:
        """Mean log-likelihood of a bigram as clean text; None if a character is lost, if it is far below clean text's or another class is likelier than the clean ones.

        every: all runs were strict UTF-8, which proves the chain's last step; the classes aren't asked then.
        """
        if _lost.search(text):
            return None
        f = features(text)
        score = self.clean_score(f)
        return score if not len(f) or (score >= self.least - 1 and (every or self._classes(f).argmax() < 2)) else None

    @staticmethod
    def _every(text: str, chain) -> bool:
        """Whether every run decodes strictly as UTF-8."""
        try:
            return chain[-1][0] == "utf-8" and all(ungarble(run, chain) for run in _runs.findall(text))
        except ValueError:
            return False

    def _invert(self, text: str, chain, whole: bool) -> str | None:
        """The text with the chain inverted on the runs it garbled; None if nothing changes or a garbled run is damaged.

        whole: on every run that can be inverted, else only where the result reads better.
        """
        changed = False
        for m in reversed(list(_runs.finditer(text))):
            run, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            try:
                back = ungarble(run, chain)
                exact = garble(back, chain) == run
            except ValueError:
                exact = False
            if exact and (whole or back.isascii() or self.clean_score(features(before + back + after)) > self.clean_score(features(before + run + after))):
                text = text[: m.start()] + back + text[m.end() :]
                changed = True
            elif len(run) > 3 and self.clean_score(features(before + run + after)) < self.least - 1:
                return None
        return text if changed else None


def train(df: DataFrame, columns: list[str], limit: int = TRAIN_LIMIT) -> ChainModel:
    """Model trained on at most limit clean values of some columns.

    Clean values for training hold, besides ASCII, only Russian letters and dashes, or only
    letters with the accents of western languages, no more than one side by side. The values
    are taken in the order of a hash, so the sample doesn't depend on partitioning; where
    there are none, some built-in words stand in.
    """
    values = df.select(F.explode(F.array(*columns)).alias("v")).where(F.col("v").rlike(r"[^\x00-\x7F]"))
    russian = F.col("v").rlike(r"^[\x00-\x7Fа-яА-ЯёЁ–—«»№]+$") & F.col("v").rlike("[а-яё]{3}") & ~F.col("v").rlike("[а-яё][А-ЯЁ]|[A-Za-z][а-яё]|[РС][РС]|[А-ЯЁ]{6}")
    western = F.col("v").rlike(r"^(?:[\x00-\x7F]|[éèêëàâäçñíóúáöüßÉÈÜÖÄÑôîï]{1,2}(?![^\x00-\x7F]))+$")
    picked = []
    for k, clean in enumerate((russian, western)):
        name = F.regexp_replace("v", r"^.*/[0-9a-fA-F-]{36}-", "")
        at = values.where(clean).select(name.alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(limit // 2)
        picked.append(sorted(r[0] for r in at.collect()))  # at most limit values
    return ChainModel(picked[0] or ["Описание изделия", "Технические характеристики"], picked[1] or ["Résumé technique", "Größentabelle", "Übersicht", "Ficha técnica"])


def restore(df: DataFrame, key: str, columns: list[str], model: ChainModel | None = None) -> DataFrame:
    """key, col_name, restored: one row per garbled field whose whole text can be recovered.

    Nulls, empty and pure ASCII texts aren't garbled; fields in which characters were lost
    give no row. Repeated rows count once; other columns are ignored. Only what was
    restored is shuffled.
    """
    model = model or train(df, columns)
    shared = df.sparkSession.sparkContext.broadcast(model)  # SPACE x (chains + 2) floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            fields = [batch.column(k + 1).to_pylist() for k in range(len(columns))]
            done = own.restore_all([t for field in fields for t in field])  # a batch's columns together: they often repeat each other
            for k, name in enumerate(columns):
                part = done[k * batch.num_rows : (k + 1) * batch.num_rows]
                at = [r for r, x in enumerate(part) if x is not None]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([name] * len(at), pa.string()), pa.array([part[r] for r in at], pa.string())], names=[key, "col_name", "restored"])

    odd = F.lit(False)
    for c in columns:
        odd = odd | F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.select(key, *columns).where(odd).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, col_name string, restored string").distinct()
