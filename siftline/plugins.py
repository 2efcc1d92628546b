"""Where a caller's own code goes in: stages, models, verdict providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]
#: Bytes of texts that a model is called on at once; a longer text by itself.
TEXT_HELD = 4 << 20


def run_stages(findings: DataFrame, stages: list[Stage]) -> DataFrame:
    """findings passed through the stages in order, as one lazy plan."""
    for stage in stages:
        findings = findings.transform(stage)
    return findings


def model_scorer(model: Callable[[pd.Series], pd.Series]) -> Stage:
    """A stage that adds `score` from a model called on parts of Arrow batches of `text`, of about TEXT_HELD bytes, whatever a batch holds."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_HELD
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            scores = [pa.array(model(texts.slice(a, b - a).to_pandas()), pa.float64(), from_pandas=True) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.concat_arrays(scores) if scores else pa.array([], pa.float64())

    return lambda df: df.withColumn("score", score("text"))


def feature_model(model: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Stage:
    """A stage that adds struct `predicted`(klass, probability, confidence) from a model called on batches of feature columns."""

    @F.pandas_udf("klass int, probability double, confidence double")
    def predict(features: pd.DataFrame) -> pd.DataFrame:
        return model(features)

    return lambda df: df.withColumn("predicted", predict(F.struct(*columns)))


def verdict_provider(answer: Callable[[str], str], size: int = 5, parallel: int = 3) -> Stage:
    """A stage prompts(id, prompt) -> (id, body): each prompt's answer, or an error record if the provider fails. At most `parallel` tasks call it at once,
    `size` prompts at a time; they hand on an Arrow batch of answers at once, and what follows is dealt anew, so that no more than the calls waits for them."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts, bodies = batch["prompt"].tolist(), []
            for at in range(0, len(prompts), size):
                for prompt in prompts[at : at + size]:
                    try:
                        bodies.append(answer(prompt))
                    except Exception as error:  # noqa: BLE001  a provider may fail in any way; the record says so
                        bodies.append('{"error": "' + type(error).__name__ + '"}')
            yield pd.DataFrame({"id": batch["id"], "body": bodies})

    return lambda df: df.select("id", "prompt").repartition(parallel, "id").mapInPandas(ask, "id long, body string").repartition("id")
