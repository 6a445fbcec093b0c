"""Quality classifier (operator 6): which dictionary shortens a text more, the good or the bad one.

Two zstandard dictionaries are built from pieces of texts labelled good and bad. A text is cut into
pieces, each piece is compressed with either dictionary, and the sizes are summed over the whole
text. The normalised difference ``(bad - good) / (bad + good)`` and the normalised size
``good / bytes`` (text that repeats itself is short with any dictionary) go through a logistic curve
that is fitted on labelled texts kept apart, which makes the score a probability of label 1.

Labels are learned from at most ``SAMPLE`` labelled rows, chosen by a hash of their key. For the
dictionaries each is cut to ``SAMPLE_PIECES`` pieces spread over its text. The texts kept apart for the curve
are measured whole by the executors, as scoring does; only the measures come back.

Defined cases: a null text counts as empty; an empty text scores what the labelled empty texts, or
else the share of good labels, say; without labels of both kinds every text scores that share (0.5
without any label); of repeated label rows for a key the lowest quality counts; a null key has no
label; equal rows score alike; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .common import held_out, share_below

SAMPLE = 4000
SAMPLE_PIECES = 16
PIECE = 1024
DICTIONARY = 64 * 1024
LEVEL = 3
PREDICT_FROM = 0.3


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray  # for 1, the difference, the size; empty without two dictionaries
    empty_score: float

    def compressors(self) -> tuple:
        def one(data):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False)
        return one(self.good), one(self.bad)

    def score(self, text: str | None, compressors: tuple) -> float:
        found = measure(pieces(text), *compressors)
        if found is None:
            return self.empty_score
        return float(1 / (1 + np.exp(-np.clip(self.weights @ found, -30, 30))))


def measure(parts: list[bytes], good, bad) -> np.ndarray | None:
    """1, the normalised difference and the normalised size of a text's pieces; None for no text."""
    if not parts:
        return None
    with_good = sum(len(good.compress(p)) for p in parts)
    with_bad = sum(len(bad.compress(p)) for p in parts)
    return np.array([1.0, (with_bad - with_good) / (with_bad + with_good), with_good / sum(map(len, parts))])


def labelled_sample(df: DataFrame, key: str, text: str, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled texts outside the held-out fold. Labels, which are small rows, are
    drawn first, so the texts are scanned against a table of bounded size."""
    usable = labels.filter(~held_out(key) & F.col(key).isNotNull() & F.col(label).isNotNull())
    drawn = (usable.filter(share_below(F.col(key), 2 * rows, usable.count()))
             .groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
             .orderBy(F.xxhash64("_key"), "_key").limit(rows))
    texts = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(drawn), "_key").groupBy("_key").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = []
        for text in batch.column("_text"):
            parts = pieces(text.as_py())
            at = np.unique(np.linspace(0, len(parts) - 1, min(len(parts), SAMPLE_PIECES)).astype(int)) if parts else []
            chosen.append([parts[i] for i in at])
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array(chosen, pa.list_(pa.binary()))],
                                         names=["_key", "_label", "parts"])


def train(df: DataFrame, key: str, text: str, labels: DataFrame, label: str, rows: int = SAMPLE) -> Model:
    sample = stored(labelled_sample(df, key, text, labels, label, rows), "labelled")
    schema = T.StructType([sample.schema["_key"], T.StructField("_label", T.IntegerType()),
                           T.StructField("parts", T.ArrayType(T.BinaryType()))])
    found = sorted(sample.select("_key", "_label", "_text").mapInArrow(_spread, schema).collect(), key=lambda r: r["_key"])
    texts = [([bytes(p) for p in r["parts"]], r["_label"], r["_key"]) for r in found]
    share = (sum(y for _, y, _ in texts) + 0.5) / (len(texts) + 1)
    empty = [y for parts, y, _ in texts if not parts]
    empty_score = (sum(empty) + share) / (len(empty) + 1)
    texts = [x for x in texts if x[0]]
    # Every third text fits the curve, the others the dictionaries.
    fit, apart = [x for i, x in enumerate(texts) if i % 3], texts[::3]
    good, bad = ([p for parts, y, _ in fit if y == wanted for p in parts] for wanted in (1, 0))
    if not good or not bad or len({y for _, y, _ in apart}) < 2:
        return Model(b"", b"", np.array([np.log(share / (1 - share)), 0.0, 0.0]), empty_score)
    model = Model(_dictionary(good).as_bytes(), _dictionary(bad).as_bytes(), np.zeros(0), empty_score)
    measured = _whole_measures(sample, model, {k for *_, k in apart})
    model.weights = _logistic(np.array([x for x, _ in measured]), np.array([y for _, y in measured], dtype=float))
    return model


def _whole_measures(sample: DataFrame, model: Model, keys: set) -> list[tuple[list[float], int]]:
    """The measures of the whole texts of these keys, with their labels, in order of the key."""
    shared = sample.sparkSession.sparkContext.broadcast((model, keys))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        tools = known.compressors()
        for batch in batches:
            batch = batch.filter(pa.array([k in wanted for k in batch.column("_key").to_pylist()], pa.bool_()))
            found = [measure(pieces(t.as_py()), *tools).tolist() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array(found, pa.list_(pa.float64()))],
                                             names=["_key", "_label", "measures"])

    schema = T.StructType([sample.schema["_key"], T.StructField("_label", T.IntegerType()), T.StructField("measures", T.ArrayType(T.DoubleType()))])
    rows = sample.select("_key", "_label", "_text").mapInArrow(whole, schema).collect()
    return [(r["measures"], r["_label"]) for r in sorted(rows, key=lambda r: r["_key"])]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for a logistic curve with a little ridge, so that separable labels have a limit."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, ridge, w = x / scale, 1e-2 * np.eye(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def score(df: DataFrame, key: str, text: str, model: Model, predict_from: float = PREDICT_FROM) -> DataFrame:
    """key, ``score`` and ``predicted`` (1 from ``predict_from`` on), a row per row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tools = known.compressors()
        for batch in batches:
            scores = [known.score(text.as_py(), tools) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(scores, pa.float64()), pa.array([int(s >= predict_from) for s in scores], pa.int32())],
                names=[key, "score", "predicted"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return df.select(key, F.col(text).alias("_text")).mapInArrow(judge, schema)
