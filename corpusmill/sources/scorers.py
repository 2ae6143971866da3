"""Where a model plugs in: prompts to completions through mapInPandas; shipped are the answerers that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def score(prompts: DataFrame, complete: Callable[[list[str]], list[str]], batch: int = 64, retries: int = 3) -> DataFrame:
    """sample_id, completion, error for sample_id, prompt; a batch that keeps failing leaves its error, to be resumed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part, error = frame.iloc[at : at + batch], None
                for _ in range(retries):
                    try:
                        said, error = complete(part["prompt"].tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of the model's is data here
                        said, error = [None] * len(part), str(e)[:500]
                yield pd.DataFrame({"sample_id": part["sample_id"].tolist(), "completion": said, "error": [error] * len(part)})

    return prompts.select("sample_id", "prompt").mapInPandas(run, "sample_id string, completion string, error string")


def constant(questions: DataFrame, letter: str) -> DataFrame:
    return questions.withColumn("completion", F.lit(f"ANSWER: {letter}"))


def heuristic(questions: DataFrame) -> DataFrame:
    return questions.withColumn("completion", F.concat(F.lit("ANSWER: "), T.letter(T.heuristic_index("choices"))))
