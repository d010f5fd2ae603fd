"""Quality filtering by importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models over hashed n-grams: the target, from at most ``max_labelled`` documents
labelled good (smallest hash of the id first), and the raw text, from all documents.  A document's log ratio is
the sum over its n-grams; set against its length it is calibrated to log odds of being good on the
labelled sample, each eighth of which is weighed by a target model of the others, so that no document
vouches for itself.  The odds are the importance weights: adding Gumbel noise, which is a hash of the
row, to their logarithms and keeping the k largest sums draws k documents without replacement in
proportion to them.  k is the expected number of good documents, the sum of their probabilities.

N-grams are words, pairs of words, and pairs of word shapes with a mark for repetition.  The k-th
largest key comes from repeated histograms on the cluster; only bin counts reach the driver.

Defined cases: null text is empty, has the log odds of a ratio of 0, and is then decided by its noise; ties with the k-th key are
kept, so repeated rows share one fate; without labels of both kinds everything is kept; an empty
table stays empty; other columns pass through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.chunks import RunCache, mix, parts
from siltwork.llm.common import Scratch, record, text_or_empty

BUCKETS = 1 << 16
_SEED = 20_231


def _shape(run: str) -> bytes:
    """Letters by case, digits, and each other sign as itself; repeats once."""
    out, last = [], ""
    for ch in run:
        c = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if c != last:
            out.append(c)
            last = c
    return xxhash.xxh3_64_digest("".join(out).encode("utf-8", "surrogatepass"))


def _code(run: str) -> bytes:
    return xxhash.xxh3_64_digest(run.encode("utf-8", "surrogatepass")) + _shape(run)


def grams(raw: bytes) -> np.ndarray:
    """Buckets of all n-grams of a text, in order and with repetitions."""
    codes = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    if not len(codes):
        return np.zeros(0, np.int64)
    words, shapes = codes[:, 0], codes[:, 1]
    out = [words]
    if len(words) > 1:
        out.append(mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(0x9E3779B97F4A7C15)))
        repeated = (words[1:] == words[:-1]).astype(np.uint64)
        repeated[1:] += np.uint64(2) * (words[2:] == words[:-2])
        out.append(mix(shapes[:-1] * np.uint64(5) + shapes[1:] * np.uint64(0xD1B54A32D192ED03) + repeated * np.uint64(0xA24BAED4963EE407) + np.uint64(1)))
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64)


def _cache() -> RunCache:
    return RunCache(_code)


@dataclass
class Weights:
    """Log ratio per bucket, and the calibration of a document's weight to a probability."""

    ratio: np.ndarray
    calibration: tuple[float, float, float] = (0.0, 0.0, 50.0)

    def document(self, found: np.ndarray) -> float:
        return float(self.ratio[found].sum()) if len(found) else 0.0

    def log_odds(self, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return np.clip(a * weight / np.sqrt(size + 1) + b * weight / (size + 1) + c, -50, 50)


FOLDS = 8


def _counts(docs: DataFrame) -> np.ndarray:
    """Bucket counts per fold over all rows (fold, text): each task adds up its own, Spark adds the tasks'."""
    schema = pa.schema([("fold", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = _cache(), np.zeros((FOLDS, BUCKETS), np.int64)
        for batch in batches:
            folds, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in parts(map(len, texts), 1_000_000):
                for fold, raw in zip(folds[part], cache.join([t.split() for t in texts[part]])):
                    total[fold] += np.bincount(grams(raw), minlength=BUCKETS)
        fold, some = np.nonzero(total)
        yield record(schema, {"fold": fold.astype(np.int32), "bucket": some.astype(np.int32), "n": total[fold, some]})

    rows = docs.mapInArrow(run, "fold int, bucket int, n long").groupBy("fold", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((FOLDS, BUCKETS), np.int64)
    total[rows.column("fold").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of the two models' probabilities per bucket, the target smoothed towards the raw text."""
    prior = smoothing * BUCKETS * 0.01
    return np.log((target + prior * raw / max(1, raw.sum()) + 1e-3) / (target.sum() + prior + 1e-3 * BUCKETS)) - np.log((raw + 1e-3) / (raw.sum() + 1e-3 * BUCKETS))


def _cross_weights(sample: DataFrame, ratios: np.ndarray):
    """(quality, log_weight, n_grams) of the sample (fold, quality, text), each fold by a ratio of its own."""
    shared = sample.sparkSession.sparkContext.broadcast(ratios)
    schema = pa.schema([("quality", pa.int32()), ("log_weight", pa.float64()), ("n_grams", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, models = _cache(), [Weights(r) for r in shared.value]
        for batch in batches:
            folds, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            weights, sizes = [], []
            for part in parts(map(len, texts), 1_000_000):
                for fold, raw in zip(folds[part], cache.join([t.split() for t in texts[part]])):
                    found = grams(raw)
                    weights.append(models[fold].document(found))
                    sizes.append(len(found))
            yield record(schema, {"quality": batch.column(1), "log_weight": weights, "n_grams": sizes})

    return sample.mapInArrow(run, "quality int, log_weight double, n_grams long").toArrow()


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, smoothing: float = 1.0) -> Weights | None:
    """Models of both sides and the calibration; None without labels of both kinds."""
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    scratch = Scratch(spark, "quality")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = scratch.save("sample", sample.select(fold, "quality", "text"))
    kinds = {r.quality for r in sample.select("quality").distinct().collect()}
    if not {0, 1} <= kinds:
        return None
    targets = _counts(sample.where("quality = 1").select("fold", "text"))
    raw = _counts(docs.select(F.lit(0).alias("fold"), text_or_empty("text").alias("text"))).sum(0)
    target = targets.sum(0)
    weights = Weights(log_ratio(target, raw, smoothing))
    rows = _cross_weights(sample, np.stack([log_ratio(target - t, raw, smoothing) for t in targets]))
    weights.calibration = _calibrate(rows.column("log_weight").to_numpy(), rows.column("n_grams").to_numpy(), rows.column("quality").to_numpy())
    scratch.drop("sample")
    return weights


def _calibrate(weight: np.ndarray, size: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method on the weight per root length and per n-gram."""
    x = np.stack([weight / np.sqrt(size + 1), weight / (size + 1), np.ones(len(weight))], 1)
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    x = x / scale
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (p - good) + 1e-2 * beta)
        beta = beta - np.clip(step, -2, 2)
    return tuple((beta / scale).tolist())


def _noise(doc_id, text: str) -> float:
    """A standard Gumbel draw that is a function of the row."""
    bits = xxhash.xxh3_64_intdigest(f"{doc_id}\x00{text}".encode("utf-8", "surrogatepass"), _SEED) >> 11
    return float(-np.log(-np.log((bits + 0.5) / (1 << 53))))


def _weigh(docs: DataFrame, weights: Weights, *keep: str) -> DataFrame:
    """doc_id, kept columns, log_weight, n_grams, gumbel_key and the probability of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.select("doc_id", *keep, "text").schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != "text" and f.name != "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = _cache(), shared.value
        for batch in batches:
            texts, ids = batch.column(batch.num_columns - 1).to_pylist(), batch.column(0).to_pylist()
            found, sizes = [], []
            for part in parts(map(len, texts), 1_000_000):
                for raw in cache.join([t.split() for t in texts[part]]):
                    got = grams(raw)
                    found.append(model.document(got))
                    sizes.append(len(got))
            weight, size = np.asarray(found, float), np.asarray(sizes, np.int64)
            odds = model.log_odds(weight, size)
            keys = odds + np.asarray([_noise(i, t) for i, t in zip(ids, texts)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight), pa.array(size), pa.array(keys), pa.array(1 / (1 + np.exp(-odds)))], names=[*batch.schema.names[:-1], "log_weight", "n_grams", "gumbel_key", "p_good"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_or_empty("text").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, {kinds + ', ' if kinds else ''}log_weight double, n_grams long, gumbel_key double, p_good double")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, collect: int = 4096) -> float:
    """The k-th largest value, exactly, by histograms that narrow down to few rows."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    k = min(max(k, 1), n)
    inside, above = n, 0
    while inside > collect and high > low:
        width = (high - low) / bins
        part = rows.where(F.col(column).between(low, high))
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        table = part.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(table, key=lambda r: -r.bin):
            if above + row.n >= k:
                low, high, inside = row.low, row.high, row.n
                break
            above += row.n
    if high <= low:
        return low
    values = sorted((r[0] for r in rows.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
    return values[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key and kept for every document."""
    weights = fit(docs, labels, max_labelled=max_labelled)
    if weights is None:
        weights = Weights(np.zeros(BUCKETS))
    rows = Scratch(docs.sparkSession, "quality").save("keys", _weigh(docs, weights))
    n, expected = rows.agg(F.count(F.lit(1)), F.sum("p_good")).first()
    limit = kth_largest(rows, "gumbel_key", round(expected) if k is None else k) if n else 0.0
    return rows.select("doc_id", "log_weight", "n_grams", "gumbel_key", (F.col("gumbel_key") >= limit).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, k: int | None = None) -> DataFrame:
    """The documents, all columns, that the resampling keeps; keys are computed twice rather than shuffling texts."""
    weights = fit(docs, labels, max_labelled=max_labelled)
    if weights is None:
        return docs
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save("keys", _weigh(docs, weights).select("gumbel_key", "p_good"))
    n, expected = rows.agg(F.count(F.lit(1)), F.sum("p_good")).first()
    limit = kth_largest(rows, "gumbel_key", round(expected) if k is None else k) if n else 0.0
    scratch.drop("keys")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = _cache(), shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            ids = batch.column(id_at).to_pylist()
            weights, sizes = [], []
            for part in parts(map(len, texts), 1_000_000):
                for raw in cache.join([t.split() for t in texts[part]]):
                    found = grams(raw)
                    weights.append(model.document(found))
                    sizes.append(len(found))
            odds = model.log_odds(np.asarray(weights, float), np.asarray(sizes, np.int64))
            mask = [w + _noise(i, t) >= limit for w, i, t in zip(odds.tolist(), ids, texts)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
