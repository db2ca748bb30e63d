"""Table functions for SQL: groups in boxes, and classes of equivalent answers over a partitioned, ordered table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from .text import boxed_bodies, known_equal


@udtf(returnType="nth int, body string")
class BoxedGroups:
    """A row for each boxed group of a text, from left to right."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(boxed_bodies(text))


@udtf
class AnswerClasses:
    """A row for each answer of a table (qid, sample_idx, answer): qid, sample_idx, class and whether it began that class.

    The table comes partitioned by qid and ordered by sample_idx, which `analyze` asks for. An answer joins the first class
    whose first answer is equal to it as text, as a negation in either case or in value; null and empty answers join none.
    """

    @staticmethod
    def analyze(votes: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f.dataType for f in votes.dataType}
        if missing := [c for c in ("qid", "sample_idx", "answer") if c not in fields]:
            raise ValueError(f"columns missing: {missing}")
        schema = StructType().add("qid", fields["qid"]).add("sample_idx", LongType()).add("class", IntegerType()).add("answer", StringType()).add("first", BooleanType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("qid")], orderBy=[OrderingColumn("sample_idx")])

    def __init__(self) -> None:
        self.firsts: list[str] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        answer = row["answer"]
        if answer:
            same = lambda a, b: a == b or ("no " in a.lower() and "no " in b.lower()) or bool(known_equal(a, b)) or bool(known_equal(b, a))
            home = next((i for i, first in enumerate(self.firsts) if same(answer, first)), None)
            if home is None:
                self.firsts.append(answer)
            yield row["qid"], row["sample_idx"], len(self.firsts) - 1 if home is None else home, answer, home is None


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as boxed_groups and answer_classes."""
    spark.udtf.register("boxed_groups", BoxedGroups)
    spark.udtf.register("answer_classes", AnswerClasses)
