"""Judgments of a stream, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gavel.plans.judge import JudgmentSession, Spec


def judge_stream(stream: DataFrame, session: JudgmentSession, specs: list[Spec], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that judges each micro-batch and hands it to ``sink``; the session's cache reuses answers between batches."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(session.judge(df, *specs), n))
