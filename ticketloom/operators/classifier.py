"""A trained classifier for the three labels, on MLlib."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import token_confidence

LABELS = ("category", "priority", "department")


@dataclass
class TicketClassifier:
    features: PipelineModel
    models: dict[str, PipelineModel]

    def score(self, df: DataFrame) -> DataFrame:
        """Add the predicted labels and a confidence from the three label probabilities."""
        scored = self.features.transform(df)
        for label, model in self.models.items():
            scored = model.transform(scored)
        top = F.array(*[F.array_max(vector_to_array(f"_{label}_probability")) for label in LABELS])
        return scored.withColumn("confidence", token_confidence(top, F.lit(True))).select(
            *df.columns, *[f"predicted_{label}" for label in LABELS], "confidence")


def fit(train: DataFrame, text: str = "review", features: int = 1 << 14, iterations: int = 20) -> TicketClassifier:
    """Fit one logistic regression per label on shared hashed text features."""
    shared = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
    ]).fit(train)
    prepared = shared.transform(train)
    models = {}
    for label in LABELS:
        indexer = StringIndexer(inputCol=label, outputCol=f"_{label}_index", handleInvalid="keep",
                                stringOrderType="alphabetAsc").fit(train)
        learned = LogisticRegression(
            featuresCol="_features", labelCol=f"_{label}_index", predictionCol=f"_{label}_prediction",
            probabilityCol=f"_{label}_probability", rawPredictionCol=f"_{label}_raw",
            maxIter=iterations, regParam=0.01).fit(indexer.transform(prepared))
        names = IndexToString(inputCol=f"_{label}_prediction", outputCol=f"predicted_{label}",
                              labels=list(indexer.labels) + ["unknown"])
        models[label] = PipelineModel(stages=[learned, names])
    return TicketClassifier(shared, models)
