"""Training and scoring of a text classifier with Spark ML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgraph.operators import corpus as C
from mailgraph.operators import evaluation as V

FEATURES = 1 << 16


def _stages(tokens: str) -> list:
    return [HashingTF(inputCol=tokens, outputCol="tf", numFeatures=FEATURES), IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(maxIter=10, regParam=0.01)]


def prepared(corpus: DataFrame) -> DataFrame:
    """De-duplicated corpus with its split and tokens. Ids are split; texts are joined to them afterwards."""
    kept = C.deduplicated(C.with_key(corpus).select("msg_id", "label", "key"))
    split = C.stratified_split(kept.select("msg_id", "label")).select("msg_id", "split")
    return RegexTokenizer(inputCol="text", outputCol="tokens", pattern="[^\\p{L}]+").transform(corpus.join(split, "msg_id"))


def train(corpus: DataFrame) -> PipelineModel:
    return Pipeline(stages=_stages("tokens")).fit(prepared(corpus).filter("split = 'train'"))


def probability(model: PipelineModel, tokens: DataFrame) -> DataFrame:
    return model.transform(tokens).withColumn("p", vector_to_array("probability")[1])


def held_out_report(corpus: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC area on the test split."""
    return V.auc(predictions(corpus).select("label", "p"))


def predictions(corpus: DataFrame) -> DataFrame:
    """(msg_id, label, p) of the test split, by a model of the training split."""
    data = prepared(corpus)
    model = Pipeline(stages=_stages("tokens")).fit(data.filter("split = 'train'"))
    return probability(model, data.filter("split = 'test'")).select("msg_id", "label", "p")


def score_worst_window(model: PipelineModel | Callable[[DataFrame], DataFrame], corpus: DataFrame) -> DataFrame:
    """Probability of each text's worst overlapping window, with the window and the tokens covered.

    ``model`` is a fitted pipeline or any function that adds a column ``p`` to rows with ``tokens``, so a model from elsewhere can be plugged in.
    """
    tokens = RegexTokenizer(inputCol="text", outputCol="all_tokens", pattern="[^\\p{L}]+").transform(corpus)
    windows = V.token_windows(tokens, F.col("all_tokens"), "msg_id")
    scored = probability(model, windows) if isinstance(model, PipelineModel) else model(windows)
    return V.worst_window(scored, F.round("p", 6), "msg_id")
