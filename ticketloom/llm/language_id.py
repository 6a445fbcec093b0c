"""Language ID (operator 3): averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, other characters than letters become spaces, and each run of 2 to 4 characters
that has no space inside is hashed into a bucket. The mean of the buckets' embeddings goes through a
softmax layer. Embeddings and layer are trained by stochastic gradient descent in numpy on the driver,
on at most ``PER_LANGUAGE`` texts of every language, and fewer if all languages together had more than
``TEXTS``; executors turn those texts into bucket counts, which reach the driver and stay there as bytes, some
2 KB a text. A temperature fitted on texts kept apart makes the softmax a probability.

A text is rejected on either of two scores. Its confidence is how far the best language's probability is
from even odds, 1/K for K languages, towards 1. Its familiarity is the mean log frequency of its subwords
in the best language's texts, relative to that language's own: text of an unlearned language, or letter
junk, is unfamiliar wherever the softmax puts it, also with one or two languages. The limits come from the
texts kept apart and ``JUDGED`` times ``PER_LANGUAGE`` more, whole and cut short, which executors judge by the trained model, by number of subwords: what ``REACH`` of the right predictions
reach, with room below since the texts are few. ``accept`` is the least confidence besides.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; a text is
read whole, in pieces of bounded length; a null key is a row like any other; ties go to the first
language in alphabetical order; without labelled rows every text is ``und``; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .common import held_out

BUCKETS = 1 << 15
DIMENSIONS = 16
LONGEST = 4
PER_LANGUAGE = 400
TEXTS = 80_000
FEWEST = 12
APART = 6
JUDGED = 3
FEW_LANGUAGES = 10_000
EPOCHS = 6
RATE = 0.2
SEED = 7
ACCEPT = 0.0
REACH = 0.999
ROOM = 0.4
SMOOTHING = 0.1
BEGINNINGS = (12, 30, 80, 250)
SIZES = 24
UNKNOWN = "und"
PIECE = 1 << 18
_HASH_SPACE = 1 << 32
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=bool)
        table[:0x33480] = [chr(i).isalpha() for i in range(0x33480)]
        _LETTERS.append(table)
    return _LETTERS[0]


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letter_table()[codes], codes, np.uint32(32))


def _piece_buckets(codes: np.ndarray) -> np.ndarray:
    space = codes == 32
    found, hashed, inside = [], codes * np.uint32(2654435761), np.zeros(len(codes), dtype=bool)
    for n in range(2, LONGEST + 1):
        if len(codes) < n:
            break
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(13))) * np.uint32(0x01000193) + codes[n - 1:]
        if n > 2:
            inside = inside[:-1] | space[n - 2:-1] if n > 3 else space[1:-1]
        wanted = ~inside if n > 2 else ~(space[:-1] & space[1:])
        mixed = hashed[wanted] * np.uint32(0x85EBCA6B)
        found.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def subword_buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's subwords, in pieces of bounded length that overlap by the longest
    subword less one."""
    if not text:
        return
    for start in range(0, len(text), PIECE):
        begin = start - (LONGEST - 1) if start else 0
        codes = _codes(text[begin:start + PIECE])
        if not (codes != 32).any():
            continue
        padded = np.concatenate(([np.uint32(32)] if not start else [], codes,
                                 [np.uint32(32)] if start + PIECE >= len(text) else [])).astype(np.uint32)
        yield _piece_buckets(padded)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times layer
    bias: np.ndarray
    temperature: float
    accept: float
    known: np.ndarray | None = None  # bucket x language: log frequency, less the language's mean
    least_confident: np.ndarray | None = None  # by log2 of the number of subwords
    least_familiar: np.ndarray | None = None

    def judge(self, text: str | None) -> tuple[int, float, bool] | None:
        """The best language, its probability, and whether the text is accepted."""
        if not self.languages or not text:
            return None
        if len(text) <= PIECE:
            used = next(subword_buckets(text), np.zeros(0, dtype=np.uint32))
            count, times = len(used), None
        else:
            counts = np.zeros(BUCKETS, dtype=np.int64)
            for piece in subword_buckets(text):
                counts += np.bincount(piece, minlength=BUCKETS)
            used = np.flatnonzero(counts)
            count, times = int(counts.sum()), counts[used].astype(np.float64)
        if not count:
            return None
        gather = lambda rows: rows.sum(axis=0, dtype=np.float64) if times is None else times @ rows
        likely = _softmax((gather(self.table[used]) / count + self.bias) / self.temperature)
        best = int(likely.argmax())
        familiar = float(gather(self.known[used, best])) / count
        size, sure = _size(count), _confidence(float(likely[best]), len(likely))
        return best, float(likely[best]), bool(sure >= max(self.accept, self.least_confident[size])
                                               and familiar >= self.least_familiar[size])


def _size(count: int) -> int:
    return min(SIZES - 1, max(int(count), 1).bit_length())


def _confidence(likely: float, languages: int) -> float:
    """0 at even odds and 1 at certainty; with a single language there are no odds."""
    return (likely - 1 / languages) / (1 - 1 / languages) if languages > 1 else 1.0


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _counts_of(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for piece in subword_buckets(text):
        counts += np.bincount(piece, minlength=BUCKETS)
    return counts


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each text and their counts, as bytes: the driver keeps them so."""
    for batch in rows:
        buckets, counted = [], []
        for text in batch.column("_text").to_pylist():
            counts = _counts_of(text)
            used = np.flatnonzero(counts)
            buckets.append(used.astype("<u2").tobytes())
            counted.append(counts[used].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_lang"), batch.column("_apart"),
                                          pa.array(buckets, pa.binary()), pa.array(counted, pa.binary())],
                                         names=["_order", "_lang", "_apart", "buckets", "counts"])


@dataclass
class _Text:
    """A training text on the driver: its packed buckets and counts, and the place of its language."""
    buckets: bytes
    counts: bytes
    label: int

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their shares of the text."""
        counts = np.frombuffer(self.counts, dtype="<u4")
        return np.frombuffer(self.buckets, dtype="<u2").astype(np.int64), (counts / counts.sum()).astype(np.float32).astype(np.float64)


def training_rows(df: DataFrame, key: str, text: str, lang: str, per_language: int,
                  max_languages: int | None = None) -> DataFrame:
    """Rows (_order, _lang, _text) to learn from and (_apart) to keep apart, see ``_drawn``."""
    return _drawn(df, key, text, lang, per_language, max_languages).filter("_learned").drop("_learned")


def _drawn(df: DataFrame, key: str, text: str, lang: str, per_language: int, max_languages: int | None = None) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, chosen by a hash of the key; fewer if
    there were more than ``TEXTS`` in all, but ``FEWEST`` of every language. ``max_languages`` takes
    only the commonest.

    These are marked ``_learned``. ``JUDGED`` times as many others, marked ``_apart`` as some of these are, only serve
    to set the limits: the trained model judges them where they are. Counts by language come first, so that the scan for
    texts passes on little more than it needs.
    """
    order = F.pmod(F.xxhash64(F.col(key)), F.lit(_HASH_SPACE))
    labelled = df.filter(~held_out(key) & F.col(lang).isNotNull()).select(
        order.alias("_order"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    counts = labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    if max_languages is not None:
        counts = counts.orderBy(F.desc("_n"), "_lang").limit(max_languages)
    counts = stored(counts, "languages")
    languages = counts.count()
    per_language = min(per_language, max(FEWEST, TEXTS // max(1, languages)))
    shares = counts.select("_lang", F.least(F.lit(1.0), F.lit(3.0 * (1 + JUDGED) * per_language) / F.col("_n")).alias("_share"))
    drawn = labelled.join(F.broadcast(shares) if languages <= FEW_LANGUAGES else shares, "_lang").filter(
        F.col("_order") < F.col("_share") * _HASH_SPACE)
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", F.xxhash64("_text")))
    learned = F.col("_place") <= per_language
    return drawn.filter(F.col("_text").isNotNull()).withColumn("_place", place).filter(
        F.col("_place") <= (1 + JUDGED) * per_language).select(
        "_order", "_lang", "_text", (~learned | (F.col("_place") % APART == 0)).alias("_apart"), learned.alias("_learned"))


def train(df: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE,
          max_languages: int | None = None, accept: float = ACCEPT) -> Model:
    rows = stored(_drawn(df, key, text, lang, per_language, max_languages), "training-texts")
    found = rows.filter("_learned").drop("_learned").mapInArrow(_features, "_order bigint, _lang string, _apart boolean, buckets binary, counts binary").toArrow()
    found = found.filter(pc.greater(pc.binary_length(found["buckets"]), 0)).sort_by([(c, "ascending") for c in ("_order", "_lang", "buckets", "counts")])
    languages = sorted(set(found["_lang"].to_pylist()))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, accept)
    place = {one: i for i, one in enumerate(languages)}
    data = [_Text(*one) for one in zip(found["buckets"].to_pylist(), found["counts"].to_pylist(), map(place.get, found["_lang"].to_pylist()))]
    # One text in APART of a language sets the temperature and the limits, unless there are too few.
    kept_apart = found["_apart"].to_pylist()
    apart = [one for one, is_apart in zip(data, kept_apart) if is_apart]
    fit = [one for one, is_apart in zip(data, kept_apart) if not is_apart] or data
    embeddings, layer, bias = _descend(fit, len(languages))
    table = embeddings @ layer
    logits = np.array([weights @ table[buckets] + bias for buckets, weights in map(_Text.read, apart or fit)])
    truth = np.array([one.label for one in apart or fit])
    grid = np.geomspace(0.05, 20, 80)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-9)).mean() for t in grid]
    model = Model(languages, table.astype(np.float32), bias, float(grid[int(np.argmin(losses))]), accept, _log_frequencies(fit, len(languages)))
    model.least_confident, model.least_familiar = _limits(model, _scores(rows.filter("_apart") if apart else rows, model))
    return model


def _scores(rows: DataFrame, model: Model) -> pa.Table:
    """(size, confidence, familiarity) of the texts that the model gets right, whole and cut short; it is applied where
    the texts are, and three numbers of each come back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = []
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
                for cut in (len(text), *(c for c in BEGINNINGS if c < len(text))):
                    counts = _counts_of(text[:cut])
                    used, size = np.flatnonzero(counts), int(counts.sum())
                    if not size:
                        continue
                    weights = counts[used] / size
                    likely = _softmax((weights @ known.table[used] + known.bias) / known.temperature)
                    best = int(likely.argmax())
                    if known.languages[best] == lang:
                        scores.append((_size(size), _confidence(float(likely[best]), len(likely)), float(weights @ known.known[used, best])))
            columns = zip(*scores) if scores else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.float64()))],
                                             names=["size", "confidence", "familiarity"])

    return rows.select("_text", "_lang").mapInArrow(judge, "size int, confidence double, familiarity double").toArrow()


def _log_frequencies(fit: list, n_languages: int) -> np.ndarray:
    counts = np.zeros((BUCKETS, n_languages))
    for one in fit:
        counts[np.frombuffer(one.buckets, dtype="<u2"), one.label] += np.frombuffer(one.counts, dtype="<u4")
    shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)
    logs = np.log(shares)
    return (logs - (shares * logs).sum(axis=0)).astype(np.float32)


def _limits(model: Model, scored: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The least confidence and familiarity that pass, by size.

    What ``REACH`` of the right predictions of a size reach, less ``ROOM`` of the way to even odds and to the
    familiarity of random subwords. No size asks for more than a larger one does; a size without texts asks
    for what the next smaller one does, and below all of them everything passes.
    """
    noise = model.known.mean(axis=0).max()
    limits = np.full((2, SIZES), np.nan)
    sizes = scored["size"].to_numpy()
    scores = np.column_stack([scored["confidence"].to_numpy(), scored["familiarity"].to_numpy()])
    for size in np.unique(sizes):
        low = np.quantile(scores[sizes == size], 1 - REACH, axis=0)
        limits[:, size] = low - ROOM * np.maximum(0, low - (0.0, noise))
    last = np.array([0.0, -np.inf])
    for size in range(SIZES):
        last = np.where(np.isnan(limits[:, size]), last, np.fmin.reduce(limits[:, size:], axis=1))
        limits[:, size] = last
    return limits[0], limits[1]


def _descend(data: list, n_languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer = rng.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, n_languages))
    bias = np.zeros(n_languages)
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            (buckets, weights), label = data[i].read(), data[i].label
            rate = RATE * (1 - done / steps)
            mean = weights @ embeddings[buckets]
            error = _softmax(mean @ layer + bias)
            error[label] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            # Divided by the squared weights, a step moves the mean as far in long texts as in short ones.
            embeddings[buckets] -= rate * np.outer(weights / (weights @ weights), back)
            done += 1
    return embeddings, layer, bias


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, ``lang_pred``, ``score`` (its calibrated probability) and ``accepted``, a row per row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.judge(value.as_py()) for value in batch.column("_text")]
            langs = [UNKNOWN if f is None else known.languages[f[0]] for f in found]
            scores = [0.0 if f is None else f[1] for f in found]
            accepted = [f is not None and f[2] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[key, "lang_pred", "score", "accepted"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return df.select(key, F.col(text).alias("_text")).mapInArrow(judge, schema)


def keep_accepted(df: DataFrame, text: str, model: Model) -> DataFrame:
    """The rows of ``df``, all columns, whose text is not rejected: one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.judge(value.as_py()) for value in batch.column(text)]
            yield batch.filter(pa.array([f is not None and f[2] for f in found], pa.bool_()))

    return df.mapInArrow(accepted, df.schema)
