"""Which attribute of a specification an indicator/value row states."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sverka.functions.forms import consistent_text

#: Values that state nothing (fixed values).
PLACEHOLDERS = ["", "-", "—", "–", "н/д", "по запросу", "уточняется", "см. инструкцию", "см. паспорт"]


#: A dictionary of more spellings than this isn't sent to the workers but refused.
MOST_ALIASES = 100_000
_after_head = re.compile(r"[,(\[{].*$", re.S)
_outer = " \t\n\r\f\v.:;-"


def attribute_key(indicator: str | None) -> str:
    """Comparable key of an indicator: of its consistent form, without what follows the first
    comma or opening bracket, without outer white space and outer . : ; -, runs of white
    space as one space, lower case. Null gives an empty key.
    """
    head = _after_head.sub("", consistent_text(indicator) or "").strip(_outer)
    return " ".join(head.split()).lower()


def attribute_dictionary(attributes: DataFrame, aliases: DataFrame) -> dict[str, tuple[str, str, str | None]]:
    """key -> (attr_code, value_type, base_unit); at a tie of keys the smallest code.

    The dictionary is a fixed table; its size is checked before it is collected.
    """
    known = aliases.join(attributes, "attr_code").select("alias", "attr_code", "value_type", "base_unit").where("alias is not null").distinct()
    rows = known.limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} attribute spellings")
    found: dict[str, tuple[str, str, str | None]] = {}
    for r in sorted(rows, key=lambda r: r["attr_code"], reverse=True):
        found[attribute_key(r["alias"])] = (r["attr_code"], r["value_type"], r["base_unit"])
    found.pop("", None)
    return found


def attribute_rows(rows: DataFrame, attributes: DataFrame, aliases: DataFrame, value_types: list[str], codes: list[str] | None = None) -> DataFrame:
    """Rows of the attributes of some value types (and codes, if given).

    Result: doc_id, row_ord, indicator, value_raw and unit in consistent form, attr_code,
    value_type, base_unit. Rows with a null indicator or one that is no known spelling
    are left out. Further columns of rows are ignored, whatever their names. Exact copies
    stay. Narrow: each batch looks its different indicators up in the dictionary.
    """
    wanted = {k: a for k, a in attribute_dictionary(attributes, aliases).items() if a[1] in value_types and (codes is None or a[0] in codes)}
    names = ["doc_id", "row_ord", "indicator", "value_raw", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple | None] = {}
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            hits = []
            for text in coded.dictionary.to_pylist():
                if text not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[text] = wanted.get(attribute_key(text))
                hits.append(seen[text])
            known = pa.array([h is not None for h in hits], pa.bool_())
            mask = pc.fill_null(pc.take(known, coded.indices), False) if len(hits) else pa.array([False] * batch.num_rows, pa.bool_())
            part = batch.filter(mask)
            if not part.num_rows:
                continue
            kept = pc.filter(coded.indices, mask)
            told = [pc.take(pa.array([h and h[k] for h in hits], pa.string()), kept) for k in range(3)]
            clean = pc.take(pa.array([consistent_text(t) for t in coded.dictionary.to_pylist()], pa.string()), kept)
            texts = [pa.array([consistent_text(t) for t in part.column(k).to_pylist()], pa.string()) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), clean, *texts, *told], names=[*names, "attr_code", "value_type", "base_unit"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names).mapInArrow(run, f"{kinds}, attr_code string, value_type string, base_unit string")
