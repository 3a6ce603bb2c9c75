"""Registries of exchangeable parts: embedders, rerankers, parsers, chunkers, compilers, planners, graph stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import graph

KINDS = ("embedder", "sparse", "reranker", "loader", "parser", "chunker", "parent_builder", "indexer", "sql_compiler", "planner", "provider", "graph_store", "graph_cache")


class Registry:
    """Named parts by kind; asking for an unknown one names those there are."""

    def __init__(self):
        self._parts: dict[str, dict[str, Any]] = {k: {} for k in KINDS}

    def add(self, kind: str, name: str, part: Any) -> None:
        self._kind(kind)[name] = part

    def get(self, kind: str, name: str) -> Any:
        parts = self._kind(kind)
        if name not in parts:
            raise KeyError(f"no {kind} named {name}; there are: {', '.join(sorted(parts)) or 'none'}")
        return parts[name]

    def names(self, kind: str) -> list[str]:
        return sorted(self._kind(kind))

    def _kind(self, kind: str) -> dict[str, Any]:
        if kind not in self._parts:
            raise KeyError(f"unknown kind {kind}")
        return self._parts[kind]


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column) -> Column:
    """A column of vectors by a model that ``load`` makes once per worker, on Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            yield pd.Series(model(s.fillna("").tolist()))

    return run(text)


def scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: Column, text: Column) -> Column:
    """A reranker's column of scores for pairs of query and text, on Arrow batches."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return run(query, text)


def planned(model: Callable[[str], dict], check: Callable[[dict], list[str]], question: str, attempts: int = 3) -> dict | None:
    """A plan from a model: up to ``attempts`` tries, each told what was wrong with the last; None if all fail."""
    prompt = question
    for _ in range(attempts):
        try:
            plan = model(prompt)
            reasons = check(plan)
        except Exception as e:
            plan, reasons = None, [type(e).__name__]
        if not reasons:
            return plan
        prompt = f"{question}\nRejected: {', '.join(reasons)}"
    return None


class GraphStore(Protocol):
    """What graph retrieval needs of a store; all tables are DataFrames, so a call is a plan and runs for all seeds at once."""

    def entities(self, terms: DataFrame) -> DataFrame: ...

    def neighbours(self, seeds: DataFrame) -> DataFrame: ...

    def paths(self, pairs: DataFrame) -> DataFrame: ...


class TableGraphStore:
    """A graph in two tables: edges (source, target, edge_id, confidence) and names (entity_id, name, aliases)."""

    def __init__(self, edges: DataFrame, names: DataFrame):
        self.edges, self.names = edges, names

    def entities(self, terms: DataFrame) -> DataFrame:
        return graph.resolve_entities(terms, self.names)

    def neighbours(self, seeds: DataFrame) -> DataFrame:
        return graph.neighbours(seeds, self.edges)

    def paths(self, pairs: DataFrame) -> DataFrame:
        return graph.paths(pairs, self.edges)


class NoGraphCache:
    """A cache that keeps nothing."""

    def get(self, key: str) -> None:
        return None

    def put(self, key: str, rows: DataFrame) -> None:
        return None
