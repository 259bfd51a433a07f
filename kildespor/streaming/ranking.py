"""Ranking a stream of queries against a fixed corpus.

The reference has no streams; this lets a retriever serve one. Each micro-batch
of (ord, text) is ranked with the statistics that the retriever already has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from kildespor.operators.lexical import Retriever


def rank_stream(queries: DataFrame, retriever: Retriever, tokens: Callable[[Column], Column], sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 100) -> StreamingQuery:
    """Starts a query that gives sink(ranking, batch) each batch's (ord, doc_id, score, rank).

    A batch that is run again after a failure comes with the same number, so a
    sink that writes by number writes each batch once.
    """

    def rank(batch: DataFrame, number: int) -> None:
        asked = batch.select("ord", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        sink(retriever.search(asked, k), number)

    return queries.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).start()
