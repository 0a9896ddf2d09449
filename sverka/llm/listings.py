"""Product listings that describe the same item, grouped by product.

Every listing is read into tokens in normal form: article code, brand, the amounts with a
unit, the number per pack, and the concepts (kind and variant) that its words stand for.
No product words are known beforehand: which words tell something, which of them are
wordings of one concept, which words name brands and which rows state a kind's size are
learned from the listings themselves (see concepts). Listings of equal tokens are one
class. The classes are sorted by several orders of their tokens, neighbours in a sliding
window are compared by soft alignment, and the links go through correlation clustering.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sverka.functions.forms import consistent_text
from sverka.llm import concepts
from sverka.operators import attributes, units
from sverka.operators.order import sorted_neighbours
from sverka.session import checkpoint, written

#: Larger counts and amounts (in millionths) are taken as not told: no column holds them.
LARGEST = 10**17
#: A word of at least one text in so many is frequent, and at most so many of them are learned from.
FREQUENT, MOST_WORDS = 500, 512
#: Words that stand in quotes or after a trademark in this part of their uses are names.
NAMED = 0.05
#: Part of the names that state an amount of a dimension from which on rows of that dimension are read.
STATED = 0.01
#: Part of the documents in which a row and the name must state the same number, for the row to stand for the name.
AGREE = 0.8
# Words of counting, a trademark's mark before a name.
PIECES = "шт|штук|штука|штуки|ед|тестов|pcs|pieces"
TRADEMARK = "тм|tm|бренд|марка|brand"
_code = re.compile(r"(?<![^\W_])([a-z]{2})-?(\d{3,4})(?![\d.,×·^])")
_parted_code = re.compile(r"(?<![^\W_])([a-z]{2}) (\d{3,4})(?![\d.,×·^])")
_pack = [re.compile(p) for p in (r"\(уп/(\d+)\)", rf"\bуп\.? ?(\d[\d ]*\d|\d) ?(?:{PIECES})(?![^\W\d_])", rf"(?<![\w.,])(\d{{1,3}}(?: \d{{3}})+|\d+) ?(?:{PIECES})(?![^\W\d_])", r"(?<![^\W_])n ?(\d+)(?!\w|[.,]\d)")]
_joined_pack = re.compile(r"(?<![^\W_])n(\d+)(?!\w|[.,]\d)")
_number = re.compile(r"(?<![\w.,])" + units.NUMBER.replace(r"(?!\p{L})", r"(?![^\W\d_])"))
_code_letters = re.compile(r"(?<![^\W_])[a-z]{2} $")
_token = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_named = re.compile(rf'["«“„]([^"«»“”„]{{2,80}})["»”“]|(?<![^\W_])(?:{TRADEMARK}) ([^\W_]+)')
_letters = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_endings = re.compile(r"\.[a-z]{3,4}$")
_plain_number = re.compile(r"(?<![\d.,])" + units.NUMBER.replace(r"(?!\p{L})", r"(?![^\W\d_])"))
_not_amount = re.compile(r"(?<![^\W\d_])(?:п\.|пункт[^\W\d_]*|серия|№|no\.?|раздел[^\W\d_]*)\s*\d+(?:\.\d+)*")
_indicator_tail = re.compile(r"[,(\[{](.*)$", re.S)
_whole = re.compile(r"\d{1,3}(?: \d{3})+(?!\d)|\d+")
_latin = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", ["a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya"]))
_doubled = re.compile(r"(.)\1")


def sound_key(word: str) -> str:
    """A word in one script: Latin letters for Cyrillic ones, close spellings of one sound alike."""
    s = "".join(_latin.get(c, c) for c in word.lower())
    for a, b in (("ks", "x"), ("yu", "u"), ("ya", "a"), ("kh", "h"), ("j", "i"), ("y", "i"), ("w", "v")):
        s = s.replace(a, b)
    return _doubled.sub(r"\1", s)


def _value(text: str) -> float:
    head = re.match(r"[\d ]+(?:[.,]\d+)?", text)[0]
    power = re.search(r"[·×xх*]\s*10\^?(\d{1,2})(?!\d)", text)
    return float(head.replace(" ", "").replace(",", ".")) * 10.0 ** int(power[1] if power else 0) * (1e3 if "тыс" in text else 1e6 if "млн" in text else 1.0)


def _count(text: str) -> int | None:
    """A whole number; None for one that no column holds."""
    n = int(text.replace(" ", "")) if len(text) < 25 else LARGEST
    return n if n < LARGEST else None


def _millionths(text: str, unit: tuple[float, float]) -> int | None:
    """Millionths of a dimension's own unit; None for an amount that no column holds."""
    x = (_value(text) + unit[1]) * unit[0] * 1e6
    return round(x) if abs(x) < LARGEST else None


def read_listing(text: str | None) -> dict:
    """Tokens of one listing text in consistent form: code, pack, sizes (dimension -> millionths of its own unit), words and names.

    words: the other tokens that hold a letter; names: those of them in quotes or after a
    trademark's mark. Nothing told is None or empty.
    """
    out: dict = {"code": None, "pack": None, "sizes": {}, "words": [], "names": []}
    if not text:
        return out
    t = _endings.sub("", " ".join(text.lower().replace("_", " ").split()))

    def cut(m: re.Match, upto: int | None = None) -> str:
        return t[: m.start()] + " | " + t[m.end() if upto is None else upto :]

    if m := _code.search(t):
        out["code"], t = m[1] + m[2], cut(m)
    if m := _joined_pack.search(t):
        out["pack"], t = _count(m[1]), cut(m)
    at = 0
    while m := _number.search(t, at):
        found, at = units.unit_at(t, m.end()), m.end()
        if found is None:
            continue
        end, by = found
        if t[end : end + 1].isdigit() and t[end - 1].isalpha():  # the L of L3 is no litre
            continue
        if end - m.end() < 3 and _code_letters.search(t, max(0, m.start() - 4), m.start()):  # a code's number before a one-letter word
            continue
        for d, unit in by.items():
            out["sizes"].setdefault(d, _millionths(m[0], unit))
        at, t = m.start() + 3, cut(m, end)
    for p in _pack:
        if out["pack"] is None and (m := p.search(t)):
            out["pack"], t = _count(m[1]), cut(m)
    if out["code"] is None and (m := _parted_code.search(t)):
        out["code"], t = m[1] + m[2], cut(m)
    out["words"] = [w for w in dict.fromkeys(_token.findall(t)) if any(c.isalpha() for c in w)]
    for m in _named.finditer(t):
        out["names"] += _letters.findall(m[1] or m[2])
    return out


def read_amounts(value: str | None, unit: str | None, indicator: str | None) -> dict[str, int]:
    """Millionths by dimension that a quantity row states: the sum of the numbers with a unit, else the first number with the row's or indicator's unit."""
    text = _not_amount.sub(" ", value.lower()) if value else ""
    first, told = None, {}
    for m in _plain_number.finditer(text):
        first = first or m[0]
        for d, u in (units.unit_at(text, m.end()) or (0, {}))[1].items():
            told.setdefault(d, []).append(_millionths(m[0], u))
    if told:
        return {d: sum(x) for d, x in told.items() if None not in x and abs(sum(x)) < LARGEST}
    tail = _indicator_tail.search(indicator or "")
    for name in ((unit or "").lower(), tail[1].lower() if tail else ""):
        found = units.unit_at(name) if first and name else None
        if found:
            return {d: x for d, u in found[1].items() if (x := _millionths(first, u)) is not None}
    return {}


_SIZES = [f"size_{d}" for d in units.DIMENSIONS]
#: Places of the evidence of a document: name rows first, then the file name; other rows from the last to the first.
_FILE, _ROWS = 1 << 40, 1 << 41


_TOLD = "doc_id string, place bigint, attr string, number bigint, code string, pack bigint, " + ", ".join(f"{s} bigint" for s in _SIZES) + ", words array<string>, keys array<string>, names array<string>"
_NOTHING: dict = {"code": None, "pack": None, "sizes": {}, "words": None, "names": None}


def _told(doc_id: pa.Array, place: list[int], attr: list[str | None], number: list[int | None], read: list[dict]) -> pa.RecordBatch:
    """What was read of some rows as a batch of _TOLD."""
    texts = pa.list_(pa.string())
    keys = [None if r["words"] is None else [sound_key(w) for w in r["words"]] for r in read]
    names = [None if r["names"] is None else sorted({sound_key(w) for w in r["names"]}) for r in read]
    columns = [doc_id, pa.array(place, pa.int64()), pa.array(attr, pa.string()), pa.array(number, pa.int64()), pa.array([r["code"] for r in read], pa.string()), pa.array([r["pack"] for r in read], pa.int64())]
    columns += [pa.array([r["sizes"].get(d) for r in read], pa.int64()) for d in units.DIMENSIONS]
    columns += [pa.array([r["words"] for r in read], texts), pa.array(keys, texts), pa.array(names, texts)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in _TOLD.split(", ")])


def read_files(docs: DataFrame) -> DataFrame:
    """What the file names of documents (doc_id, file_name) tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield _told(batch.column(0), [_FILE] * n, [None] * n, [None] * n, [read_listing(consistent_text(t)) for t in batch.column(1).to_pylist()])

    return docs.where("file_name is not null").select("doc_id", "file_name").mapInArrow(run, _TOLD)


def read_rows(rows: DataFrame, spec: DataFrame, aliases: DataFrame, name: str, counts: list[str], sized: list[str]) -> DataFrame:
    """What the rows of some attributes tell: name rows their tokens, others a whole number or the amounts by dimension. One pass."""
    stated = attributes.attribute_rows(rows, spec, aliases, ["text", "integer", "quantity"], [name, *counts, *sized])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, indicator, value, unit, code = (batch.column(c).to_pylist() for c in ("row_ord", "indicator", "value_raw", "unit", "attr_code"))
            number, read = [None] * len(code), []
            for r, (i, v, u, c) in enumerate(zip(indicator, value, unit, code)):
                if c == name:
                    read.append(read_listing(v))
                    continue
                if c in counts:
                    m = _whole.search(v or "")
                    number[r] = _count(m[0]) if m else None
                read.append(_NOTHING if c in counts else _NOTHING | {"sizes": read_amounts(v, u, i)})
            place = [(o or 0) if c == name else _ROWS - (o or 0) for o, c in zip(order, code)]
            yield _told(batch.column("doc_id"), place, [None if c == name else c for c in code], number, read)

    return stated.select("doc_id", "row_ord", "indicator", "value_raw", "unit", "attr_code").mapInArrow(run, _TOLD)


def frequent_words(told: DataFrame) -> list[str]:
    """The words of at least one text (a row of _TOLD without attr) in FREQUENT that aren't names, most frequent first, at most MOST_WORDS."""
    used = told.select(F.explode(F.arrays_zip("words", "keys")).alias("x")).groupBy(F.col("x.words").alias("word"), F.col("x.keys").alias("key")).agg(F.count("*").alias("n"))
    named = told.select(F.explode("names").alias("key")).groupBy("key").agg(F.count("*").alias("named"))
    keys = used.groupBy("key").agg(F.sum("n").alias("all")).join(named, "key", "left")
    total = told.count()
    often = used.where(F.col("n") >= max(3, total / FREQUENT)).join(keys.where(F.coalesce("named", F.lit(0)) < NAMED * F.col("all")), "key", "left_semi")
    return [r[0] for r in often.orderBy(F.desc("n"), "word").limit(MOST_WORDS).select("word").collect()]


def _marked(told: DataFrame, words: list[str]) -> DataFrame:
    """told without its lists, with the frequent words as bits (w0, w1 and so on for names, f0, f1 for files) and the name it holds.

    The name is the longest one in quotes or after a trademark's mark, else the longest word
    of at least four letters that isn't frequent.
    """
    blocks = max(1, -(-len(words) // 63))
    ids = {w: k for k, w in enumerate(words)}
    bits = [f"{s}{k}" for s in "wf" for k in range(blocks)]
    kept = ["doc_id", "place", "code", "pack", *_SIZES]
    schema = "doc_id string, place bigint, code string, pack bigint, " + ", ".join(f"{s} bigint" for s in _SIZES) + ", brand string, " + ", ".join(f"{b} bigint" for b in bits)
    common = {sound_key(w) for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            marks, brands = np.zeros((2 * blocks, n), np.int64), []
            for r, (place, own, keys, names) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "words", "keys", "names")))):
                source = int(place == _FILE)
                for w in own:
                    if w in ids:
                        marks[blocks * source + ids[w] // 63, r] |= 1 << (ids[w] % 63)
                picked = [x for x in names if len(x) > 2 and x not in common] or [k for w, k in zip(own, keys) if len(w) >= 4 and w not in ids and _letters.fullmatch(w)]
                brands.append(max(picked, key=lambda x: (len(x), x)) if picked else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(brands, pa.string()), *(pa.array(m) for m in marks)], names=[*kept, "brand", *bits])

    return told.mapInArrow(run, schema)


def _bits(batch: pa.RecordBatch, source: str, count: int) -> np.ndarray:
    """(documents, words) of zeros and ones."""
    out = np.zeros((batch.num_rows, count), np.float32)
    for k in range(-(-count // 63)):
        held = batch.column(f"{source}{k}").to_numpy(zero_copy_only=False)
        for j in range(63 * k, min(count, 63 * k + 63)):
            out[:, j] = (held >> (j - 63 * k)) & 1
    return out


def _pair_counts(listed: DataFrame, count: int, told: np.ndarray | None = None, scores: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """kind -> (documents with two words anywhere, with one in the name and one in the file name, with one in the name, in the file name, documents).

    Without scores all documents are of kind 0. Each task adds its documents up first; at
    most kinds x words x words numbers leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x, y = _bits(batch, "w", count), _bits(batch, "f", count)
            z = np.maximum(x, y)
            kind = np.zeros(len(z), int) if scores is None else _kinds(z, told, scores)
            for k in np.unique(kind[kind >= 0]):
                at = kind == k
                add = [(z[at].T @ z[at]).astype(np.float64), (x[at].T @ y[at]).astype(np.float64), x[at].sum(0, dtype=np.float64), y[at].sum(0, dtype=np.float64), float(at.sum())]
                total[k] = add if k not in total else [a + b for a, b in zip(total[k], add)]
        for k, (met, cross, first, second, n) in total.items():
            flat = np.concatenate([met.ravel(), cross.ravel(), first, second, [n]])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["kind", "at", "n"])

    got = listed.mapInArrow(run, "kind int, at int, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()  # bounded by the words
    kind, at, n = (got[c].to_numpy() for c in ("kind", "at", "n"))
    out, square = {}, count * count
    for k in np.unique(kind):
        flat = np.zeros(2 * square + 2 * count + 1)
        flat[at[kind == k]] = n[kind == k]
        out[int(k)] = (flat[:square].reshape(count, count), flat[square : 2 * square].reshape(count, count), flat[2 * square : 2 * square + count], flat[2 * square + count : -1], int(flat[-1]))
    return out


def _kinds(z: np.ndarray, told: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Kind of each document by its words; -1 if they say nothing."""
    if not scores.shape[1]:
        return np.full(len(z), -1)
    total = (z * told) @ scores
    return np.where(total.max(1) > 0, total.argmax(1), -1)


def learn(listed: DataFrame, words: list[str]) -> concepts.Concepts:
    """Concepts of the words of the documents: kinds first, then the variants of each."""
    count = len(words)
    everywhere = _pair_counts(listed, count).get(0) if count else None
    if everywhere is None:
        return concepts.Concepts(np.zeros(count, bool), np.zeros((count, 0)), [])
    met, cross, first, second, total = everywhere
    told = concepts.telling(cross, first, second, total)
    found = concepts.kinds(met, np.diag(met), total, told)
    scores = concepts.kind_scores(met, np.diag(met), total, found)
    within = _pair_counts(listed, count, told, scores) if found else {}
    variants = []
    for k in range(len(found)):
        if k not in within:
            variants.append([])
            continue
        met, cross, first, second, total = within[k]
        own = told & concepts.telling(cross, first, second, total)
        variants.append(concepts.variants(np.where(own[:, None] & own[None, :], met, 0), np.where(own, np.diag(met), 0), total))
    return concepts.Concepts(told, scores, variants)


FIELDS = {"code": "string", "brand": "string", "kind": "string", "variant": "string", "size": "bigint", "pack": "bigint"}


@dataclass
class Stands:
    """What states the size and the pack of each kind: dimension of its size, and the rows that stand for the name's numbers, best first."""

    dimension: dict[int, str]
    sizes: dict[int, list[str]]
    packs: dict[int, list[str]]


def stands(listed: DataFrame, count: int, told: np.ndarray, scores: np.ndarray, sized: dict[str, str], counts: list[str]) -> Stands:
    """Learns by kind which dimension its names state and which attributes state the same numbers as its names."""
    columns = [*_SIZES, *sized, *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, same = {}, {}
        for batch in batches:
            kind = _kinds(np.maximum(_bits(batch, "w", count), _bits(batch, "f", count)), told, scores)
            held = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*columns, "pack"]}
            for c in columns:
                other = held[c] if c in _SIZES else held[f"size_{sized[c]}"] if c in sized else held["pack"]
                ok = ~np.isnan(held[c]) & ~np.isnan(other)
                for k in np.unique(kind[ok]):
                    at = ok & (kind == k)
                    both[k, c] = both.get((k, c), 0) + int(at.sum())
                    same[k, c] = same.get((k, c), 0) + int((held[c][at] == other[at]).sum())
        keys = sorted(both)
        yield pa.RecordBatch.from_arrays([pa.array([int(k) for k, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.string()), pa.array([both[k] for k in keys], pa.int64()), pa.array([same[k] for k in keys], pa.int64())], names=["kind", "c", "both", "same"])

    got = listed.mapInArrow(run, "kind int, c string, both bigint, same bigint").groupBy("kind", "c").agg(F.sum("both").alias("both"), F.sum("same").alias("same")).collect()  # kinds x columns
    table = {(r["kind"], r["c"]): (r["both"], r["same"]) for r in got}
    out = Stands({}, {}, {})
    for k in {k for k, _ in table}:
        stated = {s: table[k, s][0] for s in _SIZES if (k, s) in table}
        if stated:
            out.dimension[k] = max(stated, key=lambda s: (stated[s], s))
        fits = {c: (table[k, c][1] / table[k, c][0], table[k, c][1]) for c in [*sized, *counts] if (k, c) in table and table[k, c][1] >= AGREE * table[k, c][0] and table[k, c][1] > 1}
        best = sorted(fits, key=lambda c: (-fits[c][1], c))
        out.sizes[k] = [c for c in best if c in sized and f"size_{sized[c]}" == out.dimension.get(k)]
        out.packs[k] = [c for c in best if c in counts]
    return out


def _first(value: str, where: Column | None = None) -> Column:
    told = F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & where
    return F.min(F.when(told, F.struct("place", value)))[value]


def listing_fields(docs: DataFrame, rows: DataFrame, spec: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """doc_id and its fields: told by the name rows, else by the file name or by the rows that stand for them.

    docs: doc_id and file_name (readable); name is the attribute of the name rows. Of
    several rows of an attribute the last usable one counts. Repeated rows don't matter. A
    document that tells nothing has nulls; kind and variant are numbers of concepts. One
    shuffle with partial aggregation; no document's rows are collected.
    """
    of_unit = {r["attr_code"]: units.unit_at(r["base_unit"].lower()) for r in spec.where("value_type = 'quantity' and base_unit is not null").collect()}  # the fixed dictionary
    counts = sorted(r["attr_code"] for r in spec.where("value_type = 'integer'").collect())
    read = read_rows(rows, spec, aliases, name, counts, sorted(of_unit))
    everything = written(read.unionByName(read_files(docs)), "listing-texts")
    told, stated = everything.where("attr is null"), everything.where("attr is not null")
    words = frequent_words(told)
    named = told.where(F.col("place") < _FILE).agg(F.count("*").alias("n"), *(F.count(s).alias(s) for s in _SIZES)).first()
    usual = [d for d, s in zip(units.DIMENSIONS, _SIZES) if named[s] > STATED * named["n"]]
    sized = {a: next((d for d in usual if d in u[1]), None) for a, u in sorted(of_unit.items()) if u}
    sized = {a: d for a, d in sized.items() if d}
    marked = _marked(told, words)
    bits = [c for c in marked.columns if re.fullmatch(r"[wf]\d+", c)]
    union = marked.withColumn("attr", F.lit(None).cast("string")).unionByName(stated.select("doc_id", "place", "attr", "number", *_SIZES), allowMissingColumns=True)
    own = F.col("attr").isNull()
    told_by = [*(_first(c, own).alias(c) for c in ("code", "brand", "pack", *_SIZES)), *(F.coalesce(F.bit_or(b), F.lit(0)).alias(b) for b in bits)]
    told_by += [_first(f"size_{d}", F.col("attr") == a).alias(a) for a, d in sized.items()]
    told_by += [_first("number", F.col("attr") == a).alias(a) for a in counts]
    listed = written(union.groupBy("doc_id").agg(*told_by), "listed")
    learned = learn(listed, words)
    by = stands(listed, len(words), learned.telling, learned.scores, sized, counts)
    shared = listed.sparkSession.sparkContext.broadcast((learned, by))  # at most MOST_WORDS words and their kinds
    schema = "doc_id string, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())
    known = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stand = shared.value
        for batch in batches:
            z = np.maximum(_bits(batch, "w", known), _bits(batch, "f", known))
            kind = _kinds(z, model.telling, model.scores)
            held = {c: batch.column(c).to_pylist() for c in ("pack", *_SIZES, *sized, *counts)}
            variant, size, pack = [], [], []
            for r, k in enumerate(kind.tolist()):
                v = model.variant(k, np.flatnonzero(z[r])) if k >= 0 else None
                variant.append(None if v is None else f"{k}.{v}")
                d = stand.dimension.get(k)
                size.append(next((x for c in ([d] if d else []) + stand.sizes.get(k, []) if (x := held[c][r]) is not None), None))
                pack.append(next((x for c in ["pack", *stand.packs.get(k, [])] if (x := held[c][r]) is not None), None))
            kinds = pa.array([str(k) if k >= 0 else None for k in kind.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("code"), batch.column("brand"), kinds, pa.array(variant, pa.string()), pa.array(size, pa.int64()), pa.array(pack, pa.int64())], names=["doc_id", *FIELDS])

    return listed.mapInArrow(run, schema)


#: Neighbours on either side that a listing class is compared with in each pass.
WINDOW = 5
#: Orders of the tokens in the keys of the passes: name first, code first, words first, numbers first.
PASSES = [["brand", "kind", "variant", "size", "pack", "code"], ["code", "kind", "brand", "variant", "size", "pack"], ["kind", "variant", "size", "pack", "brand", "code"], ["size", "pack", "brand", "kind", "variant", "code"]]
#: Part of the aligned weight that must agree, and of the weight told by either that both must tell.
LEAST, TOLD = 0.9, 0.75


def weights(classes: DataFrame) -> dict[str, float]:
    """Weight of each token's agreement by its rarity: the negative logarithm of the chance that two classes agree in it."""
    out = {}
    for f in FIELDS:
        if f != "code":
            same = classes.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("n")).first()
            out[f] = max(1.0, -float(np.log2(same["s"] / same["n"] ** 2))) if same["n"] else 1.0
    return out


def aligned(a: str, b: str, weight: dict[str, float]) -> Column:
    """Soft alignment of two listing classes from -1 to 1; tokens that one of them doesn't tell count neither way.

    Brands one letter apart agree, other tokens must be equal; equal codes count as much as
    all other tokens but can't outweigh two that differ. Below TOLD of the weight told by
    either it is 0.
    """
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    near = (x("brand") == y("brand")) | ((F.least(F.length(x("brand")), F.length(y("brand"))) >= 6) & (F.levenshtein(x("brand"), y("brand"), 1) >= 0))
    agree = {f: near if f == "brand" else x(f) == y(f) for f in weight}
    both = {f: x(f).isNotNull() & y(f).isNotNull() for f in weight}
    one = {f: x(f).isNotNull() | y(f).isNotNull() for f in weight}
    zero = F.lit(0.0)
    total = sum((F.when(both[f], w).otherwise(0.0) for f, w in weight.items()), zero)
    told = sum((F.when(one[f], w).otherwise(0.0) for f, w in weight.items()), zero)
    score = sum((F.when(both[f], F.when(agree[f], w).otherwise(-w)).otherwise(0.0) for f, w in weight.items()), zero)
    code = F.when(x("code") == y("code"), sum(weight.values())).otherwise(0.0)
    return F.when((total + code > 0) & (total + code >= TOLD * (told + code)), (score + code) / (total + code)).otherwise(0.0)


def correlation_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node -> cluster by parallel pivots over positive links (a, b); every other pair counts as negative.

    A node of least random priority among its open neighbours is a pivot and takes them; at
    a tie of two pivots the lesser one wins. Rounds go on until no link is left between open
    nodes (the open node of least priority is always a pivot, so each round takes some);
    each is written to the shared folder. Nodes without links are their own cluster.
    """
    ways = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    both = links.where("a <> b").select(F.explode(ways).alias("l")).select("l.*").distinct()
    open_links = checkpoint(both.select("x", "y", F.xxhash64("x").alias("px"), F.xxhash64("y").alias("py")))
    clusters = None
    while not open_links.isEmpty():
        least = open_links.groupBy("x").agg(F.min(F.struct("py", "y")).alias("m"), F.min(F.struct("px", "x")).alias("own"))
        pivots = least.where("own < m").select(F.col("x").alias("p"))
        caught = open_links.join(pivots, F.col("y") == F.col("p")).groupBy("x").agg(F.min(F.struct("py", "y")).alias("m")).select("x", F.col("m.y").alias("cluster"))
        done = checkpoint(pivots.select(F.col("p").alias("x"), F.col("p").alias("cluster")).unionByName(caught))
        clusters = done if clusters is None else clusters.unionByName(done)
        gone = done.select("x")
        open_links = checkpoint(open_links.join(gone, "x", "left_anti").join(gone.withColumnRenamed("x", "y"), "y", "left_anti").select("x", "y", "px", "py"))
    if clusters is None:
        return nodes.select(F.col("class_id"), F.col("class_id").alias("cluster"))
    return nodes.select("class_id").join(clusters.withColumnRenamed("x", "class_id"), "class_id", "left").select("class_id", F.coalesce("cluster", "class_id").alias("cluster"))


def group_listings(fields: DataFrame) -> DataFrame:
    """doc_id, product_id: documents of one product share an id.

    fields: doc_id and the listing fields. A document that tells neither brand nor code is
    a product of its own. Equal listings are one class and compared once.
    """
    names = list(FIELDS)
    known = written(fields.withColumn("class_id", F.when(F.coalesce("brand", "code").isNull(), F.xxhash64(F.lit("alone"), "doc_id")).otherwise(F.xxhash64(*names))), "listings")
    classes = written(known.select("class_id", *names).distinct(), "listing-classes")
    weight, links = weights(classes), None
    for order in PASSES:
        key = F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in order))
        pairs = sorted_neighbours(classes, WINDOW, key, "class_id").where(aligned("a", "b", weight) >= LEAST).select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"))
        links = pairs if links is None else links.unionByName(pairs)
    clusters = correlation_clusters(classes.select("class_id"), links)
    return known.select("doc_id", "class_id").join(clusters, "class_id").select("doc_id", F.col("cluster").alias("product_id"))


def product_pairs(grouped: DataFrame) -> DataFrame:
    """doc_a < doc_b: all pairs of documents of one product."""
    left, right = grouped.select("product_id", F.col("doc_id").alias("doc_a")), grouped.select("product_id", F.col("doc_id").alias("doc_b"))
    return left.join(right, "product_id").where("doc_a < doc_b").select("doc_a", "doc_b")
