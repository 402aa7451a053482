"""Batch contracts of models, with local defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
#: The character of place 0 where places are counted in a string; the next ones follow.
_FIRST = ord("0")


def tokens(c: str | Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")


def embed(text: str | Column, dim: int = DIM) -> Column:
    """A vector of hashed token counts; a null text is empty.

    The text is cut and hashed once a row: as the one element of an array it is bound to a name, and places are counted
    in a string of one character a token.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    mark = lambda k: chr(_FIRST + k)
    alphabet = F.lit("".join(map(mark, range(dim))))
    marks = F.array_join(F.transform(tokens(text), lambda w: F.substring(alphabet, F.pmod(F.xxhash64(w), F.lit(dim)).cast("int") + 1, F.lit(1))), "")
    count = lambda s, k: (F.length(s) - F.length(F.replace(s, F.lit(mark(k)), F.lit("")))).cast("double")
    return F.get(F.transform(F.array(marks), lambda s: F.array(*[count(s, k) for k in range(dim)])), F.lit(0))


def score_pairs(question: str | Column, content: str | Column) -> Column:
    """The share of the question's different tokens that the content has."""
    q = F.array_distinct(tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.array_distinct(tokens(content)))), F.size(q)), F.lit(0.0))


def generate(rows: DataFrame, model: Callable[[pd.Series], pd.Series | pd.DataFrame] | None = None) -> DataFrame:
    """rows with generated_answer, input_tokens, output_tokens, status and error_message.

    Without a model the chunk that has most of the question answers, and words count as tokens. A model takes a
    batch of prompts and gives answers, or a frame of answer, input_tokens and output_tokens (0 where it reports
    none). Where it fails for a batch it is asked again prompt by prompt, so only the rows that fail are errors.
    """
    if model is None:
        best = F.array_max(F.transform("chunks", lambda c: F.struct(score_pairs(F.col("question"), c["content"]).alias("s"), (-c["rank"]).alias("r"), c["content"].alias("content"))))
        answer = F.coalesce(best["content"], F.lit(""))
        asked = F.size(tokens("question")) + F.aggregate("chunks", F.lit(0), lambda n, c: n + F.coalesce(F.size(tokens(c["content"])), F.lit(0)))
        return rows.withColumns({"generated_answer": answer, "input_tokens": F.coalesce(asked, F.lit(0)).cast("long"), "output_tokens": F.size(tokens(answer)).cast("long"), "status": F.lit("ok"), "error_message": F.lit(None).cast("string")})

    def answers(prompts: pd.Series) -> pd.DataFrame:
        made = model(prompts)
        made = made if isinstance(made, pd.DataFrame) else pd.DataFrame({"answer": list(made)})
        made = made.reindex(columns=["answer", "input_tokens", "output_tokens"]).reset_index(drop=True)
        if len(made) != len(prompts):
            raise ValueError(f"{len(made)} answers to {len(prompts)} prompts")
        return made.assign(**{c: made[c].fillna(0).astype("int64") for c in ("input_tokens", "output_tokens")}, error=None)

    @F.pandas_udf("answer string, input_tokens long, output_tokens long, error string")
    def call(prompts: pd.Series) -> pd.DataFrame:
        try:
            return answers(prompts)
        except Exception as whole:  # noqa: BLE001 - errors become rows
            if len(prompts) == 1:
                return pd.DataFrame({"answer": [""], "input_tokens": [0], "output_tokens": [0], "error": [str(whole)]})
            return pd.concat([call.func(prompts.iloc[i : i + 1]) for i in range(len(prompts))], ignore_index=True)

    out = rows.withColumn("_a", call("prompt"))
    made = {"generated_answer": F.col("_a.answer"), "input_tokens": F.col("_a.input_tokens"), "output_tokens": F.col("_a.output_tokens")}
    return out.withColumns(made | {"status": F.when(F.col("_a.error").isNull(), "ok").otherwise("error"), "error_message": F.col("_a.error")}).drop("_a")


def score_answers(rows: DataFrame) -> DataFrame:
    """Lexical stand-ins for judged scores: token recall and precision between answer, contexts and truth."""
    truth, answer, context = F.array_distinct(tokens("ground_truth")), F.array_distinct(tokens("generated_answer")), F.array_distinct(tokens(F.array_join("contexts", " ")))
    share = lambda a, b: F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))
    return rows.withColumns({"faithfulness": share(answer, context), "context_recall": share(truth, context), "context_precision": share(context, truth), "answer_correctness": share(truth, answer), "answer_relevance": score_pairs("question", "generated_answer")})
