"""Places for outside models: embedding of texts and judging of pairs by given functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Judge = Callable[[list[tuple[str, str]], list[tuple[str, str]]], dict | None]


def embed_texts(df: DataFrame, text: str, load: Callable[[], Embed], batch: int = 64) -> DataFrame:
    """text, embedding of each different text; load is called once per worker task, null texts have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            texts = part[text].tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])]
            yield pd.DataFrame({text: texts, "embedding": vectors})

    return df.where(F.col(text).isNotNull()).select(text).distinct().mapInPandas(run, f"`{text}` string, embedding array<double>")


def judge_pairs(pairs: DataFrame, load: Callable[[], Judge]) -> DataFrame:
    """query_id, doc_id, decision, confidence, similarity, explanation by a given judge.

    pairs: query_id, doc_id, query_rows and library_rows as arrays of struct(indicator,
    value_raw). A judge that gives nothing or no known decision leaves a null decision;
    numbers are brought into 0..1.
    """

    def unit(x) -> float:
        return min(1.0, max(0.0, float(x))) if isinstance(x, (int, float)) and x == x and abs(x) != float("inf") else 0.0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = load()
        for part in parts:
            out = []
            for r in part.itertuples():
                said = judge(*([(x["indicator"], x["value_raw"]) for x in side] for side in (r.query_rows, r.library_rows))) or {}
                decision = said.get("decision") if said.get("decision") in ("match", "no_match") else None
                out.append((r.query_id, r.doc_id, decision, unit(said.get("confidence")), unit(said.get("similarity")), str(said.get("explanation") or "")))
            yield pd.DataFrame(out, columns=["query_id", "doc_id", "decision", "confidence", "similarity", "explanation"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id"))
    return pairs.select("query_id", "doc_id", "query_rows", "library_rows").mapInPandas(run, f"{kinds}, decision string, confidence double, similarity double, explanation string")
