"""Query texts and how they become rows."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.checks import ensured
from lodestar.schemas import QUERIES


@dataclass(frozen=True)
class Query:
    """A query: its id, its text as given, and the text that models encode."""

    query_id: str
    original_query: str
    model_query: str

    def __post_init__(self):
        if not self.query_id:
            raise ValueError("a query needs an id")
        if not self.original_query.strip() or not self.model_query.strip():
            raise ValueError("query texts must not be blank")


class QueryProcessor(ABC):
    """Turns texts into queries; the place for rewriting them."""

    @abstractmethod
    def process(self, texts: Sequence[str]) -> list[Query]: ...


class Unchanged(QueryProcessor):
    """Ids q0001, q0002, ... in the order given; texts stay as they are, repeats too."""

    def process(self, texts: Sequence[str]) -> list[Query]:
        if not texts:
            raise ValueError("at least one query is needed")
        return [Query(f"q{i:04d}", t, t) for i, t in enumerate(texts, 1)]


def frame(spark: SparkSession, queries: Sequence[Query]) -> DataFrame:
    """(query_id, position, original_query, model_query)."""
    return spark.createDataFrame([(q.query_id, i, q.original_query, q.model_query) for i, q in enumerate(queries)], QUERIES)


def numbered(texts: DataFrame, position: str, text: str) -> DataFrame:
    """The same from a table that has each text's place from 0; blank texts fail."""
    at = F.col(position).cast("int")
    whole = ensured(F.col(text), F.length(F.trim(F.col(text))) > 0, "query texts must not be blank")
    return texts.select(F.format_string("q%04d", at + 1).alias("query_id"), at.alias("position"), whole.alias("original_query"), F.col(text).alias("model_query"))
