"""The log of questions: what users asked, as it is searched for, what they were answered, and how often a question comes.

    python -m jobs.question_log --source in/conversations --target out/questions --config jobs/question_log.json

Reads conversation turns, writes target by outcome: answered, unanswered (no turn or no text of the assistant follows),
rejected (blank, or too long for the gate). Each run writes the whole target anew, so a rerun gives the same.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from lexloom.functions import clean_answer, normalize_query, normalize_questions, question_ok, rewrite_query

logger = logging.getLogger("question_log")

SOURCE = "conv_id long, turn long, role string, text string"
QUESTIONS = "conv_id long, turn long, question string, search_text string, answer string, n_citations int, times_asked long, first_conv long, first_turn long"


@dataclass(frozen=True)
class Config:
    """Roles of the turns that ask and of those that answer."""

    question_role: str = "user"
    answer_role: str = "assistant"


def questions(turns: DataFrame, config: Config) -> DataFrame:
    """One row for each turn that asks, with its outcome."""
    asked = turns.where(F.col("role") == config.question_role).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    asked = normalize_questions(asked.withColumn("ok", question_ok(F.col("question"))))
    q = F.col("question")
    asked = asked.select("conv_id", "turn", "ok", F.when(F.col("ok"), normalize_query(q)).otherwise(q).alias("question"), F.when(F.col("ok"), rewrite_query(q)).alias("search_text"))
    # the turn after it: keys are (conversation, turn), so a conversation of any length is spread out
    answers = turns.where(F.col("role") == config.answer_role).groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.nullif(clean_answer(F.min("text")), F.lit("")).alias("answer"))
    rows = asked.join(answers, ["conv_id", "turn"], "left")
    # equal questions are counted where they are read before they meet
    key = F.when(F.col("ok"), F.lower("question"))
    times = asked.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("times_asked"), F.min(F.struct("conv_id", "turn")).alias("first")).where("key IS NOT NULL")
    rows = rows.withColumn("key", key).join(times, "key", "left")
    marks = F.size(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"))))
    return rows.select(
        "conv_id", "turn", "question", "search_text", F.when(F.col("ok"), F.col("answer")).alias("answer"), F.when(F.col("ok") & F.col("answer").isNotNull(), marks).alias("n_citations"),
        "times_asked", F.col("first.conv_id").alias("first_conv"), F.col("first.turn").alias("first_turn"),
        F.when(~F.col("ok"), "rejected").when(F.col("answer").isNull(), "unanswered").otherwise("answered").alias("outcome"),
    )


def run(spark: SparkSession, source: str, target: str, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Writes the questions of all turns and returns them read back.

    Turns without a role neither ask nor answer. A missing text is an empty one: as a question it is rejected, as an
    answer none. Where several rows answer one turn the least text counts. Repeated questions each have a row, repeated
    rows too; rejected ones are not counted. Other columns of the source are not read.
    """
    turns = spark.read.schema(SOURCE).parquet(source)
    roles = common.tally(turns, "role")
    questions(turns, config).write.mode("overwrite").partitionBy("outcome").parquet(target)
    written = spark.read.schema(QUESTIONS + ", outcome string").parquet(target)
    outcomes = common.tally(written, "outcome")
    logger.info("read %s from %s; wrote %s to %s", ", ".join(f"{n} turns of {r}" for r, n in roles.items()), source, ", ".join(f"{n} {o}" for o, n in outcomes.items()), target)
    return written


def main() -> None:
    given = common.arguments(__doc__, "source", "target")
    spark = common.session("question_log", given.shared)
    try:
        run(spark, given.source, given.target, common.config(spark, given.config, Config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
