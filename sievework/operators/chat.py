"""Question and answer records: validation, request bodies, reply parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import strip

SYSTEM_PROMPT = "Answer questions about the site's documents briefly; say so where you are not sure."


def ask_status(question: Column) -> Column:
    """400 for a question without text, else 200."""
    return F.when(F.coalesce(strip(question), F.lit("")) == "", 400).otherwise(200)


def request_body(question: Column, model: str, prompt: str = SYSTEM_PROMPT, temperature: float = 0.2, max_tokens: int = 512) -> Column:
    """JSON of a chat completion request: the prompt and one user message, no history."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(prompt)), message("user", question)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")))


def answer(status: Column, body: Column) -> Column:
    """The reply's first choice, stripped; null where the call failed or the body has another shape."""
    return F.when(status == 200, strip(F.get_json_object(body, "$.choices[0].message.content")))


def reply_status(status: Column, body: Column) -> Column:
    """502 for a network error (null status), another status than 200 or a body of another shape."""
    return F.when(answer(status, body).isNotNull(), 200).otherwise(502)


def error_detail(status: Column, body: Column) -> Column:
    """What went wrong with a call: no connection, the status and body of a refusal, or an unexpected shape; null for an answer."""
    refused = F.concat(F.lit("upstream answered "), status.cast("string"), F.lit(": "), F.coalesce(body, F.lit("")))
    return F.when(status.isNull(), F.concat(F.lit("upstream could not be reached"), F.coalesce(F.concat(F.lit(": "), body), F.lit("")))).when(status != 200, refused).when(answer(status, body).isNull(), "upstream answered in an unexpected shape")


def display_text(text: Column, fallback: str = "No answer was returned.") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def ask(questions: DataFrame, model: str, call: Callable[[str], tuple[int | None, str | None]], question_col: str = "question") -> DataFrame:
    """questions with status, answer and detail; ``call`` posts a request body and returns status and body, or no status and what failed."""
    judged = questions.withColumn("__status", ask_status(F.col(question_col))).withColumn("__request", F.when(F.col("__status") == 200, request_body(F.col(question_col), model)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [call(r) if isinstance(r, str) else (None, None) for r in b["__request"]]
            yield b.assign(__code=pd.Series([g[0] for g in got], dtype="Int64"), __body=pd.Series([g[1] for g in got], dtype="object"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema)
    done = judged.mapInPandas(run, f"{fields}, __code long, __body string")
    status = F.when(F.col("__status") == 400, 400).otherwise(reply_status(F.col("__code"), F.col("__body")))
    return done.select(*questions.columns, status.alias("status"), answer(F.col("__code"), F.col("__body")).alias("answer"), F.when(F.col("__status") == 400, "question is empty").otherwise(error_detail(F.col("__code"), F.col("__body"))).alias("detail"))
