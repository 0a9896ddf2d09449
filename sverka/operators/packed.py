"""Several values packed in one field: a quote-aware finite-state tokenizer.

The tokenizer walks a value's lexemes and tracks three things: the quote it is inside, the
brackets that are open, and the number that the next list number must have. Delimiters
count only outside quotes and brackets; a comma or slash between digits belongs to a
number; a backslash takes the meaning off the mark after it. The state is one value's;
there is nothing to shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTES = {'"': '"', "«": "»", "“": "”", "„": "“"}
_OPEN, _CLOSE = "([{", ")]}"
_PAIR = dict(zip(_OPEN, _CLOSE))
_OPENER = dict(zip(_CLOSE, _OPEN))
# Lexemes that can change the state; the text between two of them is taken at once.
_lexeme = re.compile(r'\\[\\"«»“”„()\[\]{};|•,/+]|["«»“”„]|[()\[\]{}]|[;|\n\t•,/+\r]|(?<!\S)\d{1,3}[.)](?=\s)')
# Escaped marks stand as private characters until the item is done.
_masked = {c: chr(0xF0000 + ord(c)) for c in '\\"«»“”„()[]{};|•,/+'}
_unmask = {ord(m): c for c, m in _masked.items()}
_number = re.compile(r"(\d{1,3})[.)](?=\s)")
_bullet = re.compile(r"^(?:[-*—–•·▪●]\s+)+")
_numbered = re.compile(r"\s*1[.)]\s")
_inner_quote = re.compile(r'^(["«“„])(.*)(["»”“])$', re.S)


def _closed(open_marks: list[str], closer: str) -> None:
    """A closer closes the nearest opener of its kind and whatever was opened inside; without one it's plain text."""
    opener = _OPENER[closer]
    if opener in open_marks:
        while open_marks.pop() != opener:
            pass


def _enclosed(text: str) -> str:
    """Without one pair of brackets around the whole list."""
    body = text.strip().rstrip(";,|").rstrip()
    if len(body) < 2 or body[0] not in _OPEN or body[-1] != _PAIR[body[0]]:
        return text
    opened, quoted = [], False
    for m in _lexeme.finditer(body):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif quoted or c[0] == "\\":
            continue
        elif c in _OPEN:
            opened.append(c)
        elif c in _CLOSE:
            _closed(opened, c)
            if not opened and m.end() < len(body):
                return text
    return body[1:-1] if not opened and not quoted else text


def split_packed(text: str | None) -> list[str]:
    """The items of one value, in their order; null and empty texts have none.

    Outside quotes and brackets these delimit: ; | line break, tab, bullet, a comma or
    slash that isn't between digits, a plus between spaces, and the numbers 1. 2. 3. or
    1) 2) 3) of a numbered list, taken in sequence. Inside quotes a doubled quote is one
    quote. A mark after a backslash is plain text (the backslash goes); quotes and brackets
    that are never closed are too. Empty items don't count, repeated ones stay.
    """
    if text is None or not text.strip():
        return []
    text = _enclosed(text)
    numbered = bool(_numbered.match(text))
    due, items, held, opened, quote, at, n = 1, [], [], [], "", 0, len(text)
    last = {c: text.rfind(c) for c in {*_CLOSE, *_QUOTES.values()}}

    def end() -> None:
        items.append("".join(held))
        held.clear()

    while at < n:
        m = _lexeme.search(text, at)
        if not m:
            held.append(text[at:])
            break
        if m.start() > at:
            held.append(text[at : m.start()])
        token, k, at = m[0], m.start(), m.end()
        if token[0] == "\\":
            held.append(_masked[token[1]])
        elif token[0].isdigit():
            mark = token[:-1]
            if numbered and not quote and not opened and int(mark) == due:
                due += 1
                end()
            else:  # a number of the text; its bracket or point is looked at by itself
                held.append(mark)
                at = k + len(mark)
        elif quote:
            if token == quote:
                if token == '"' and text[at : at + 1] == '"':
                    held.append('""')
                    at += 1
                    continue
                quote = ""
            held.append(token)
        elif token in _QUOTES and last[_QUOTES[token]] >= at:
            quote = _QUOTES[token]
            held.append(token)
        elif token in _OPEN:
            if last[_PAIR[token]] >= at:
                opened.append(token)
            held.append(token)
        elif token in _CLOSE:
            _closed(opened, token)
            held.append(token)
        elif opened:
            held.append(token)
        elif token in ";|\n\t•\r":
            end()
        elif token in ",/":
            inside = text[k - 1 : k].isdigit() and text[at : at + 1].isdigit() and not (token == "," and numbered and _number.match(text, at))
            held.append(token) if inside else end()
        elif token == "+":
            spaced = text[k - 1 : k].isspace() and text[at : at + 1].isspace()
            end() if spaced else held.append(token)
        else:
            held.append(token)
    end()
    done = [item for raw in items if (item := _bare(raw))]
    return [item.translate(_unmask) for item in done] if "\\" in text else done


def _bare(item: str) -> str:
    """Without bullets, without the quotes around the whole item, doubled quotes as one."""
    item = _bullet.sub("", item.strip()).strip()
    if item in "-*—–·":
        return ""
    m = _inner_quote.match(item)
    if m and _QUOTES[m[1]] == m[3] and (m[1] != '"' or not re.search(r'(?<!")"(?!")', m[2].replace('""', ""))):
        item = m[2].replace('""', '"').strip() if m[1] == '"' else m[2].strip()
    return item


def unpack(rows: DataFrame, value: str = "value_raw", keys: list[str] | None = None, least: int = 1) -> DataFrame:
    """One row per item: keys, pos (int, from 1), item.

    Values with fewer than least items give no row; nulls and empty texts have no items.
    Repeated rows give repeated results. Columns besides the keys are dropped. The text
    of any length is tokenized whole.
    """
    keys = keys or ["doc_id", "row_ord"]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            split = part.iloc[:, -1].map(lambda v: x if len(x := split_packed(v)) >= least else [])
            out = part.iloc[:, :-1].assign(pos=split.map(lambda x: list(range(1, len(x) + 1))), item=split)
            out = out[split.map(len) > 0].explode(["pos", "item"])
            yield out.astype({"pos": "int32"})

    return rows.select(*keys, F.col(value).alias("_value")).where(F.col("_value").isNotNull()).mapInPandas(run, schema)
