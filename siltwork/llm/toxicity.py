"""Toxicity scores of a factorization machine over hashed terms.

Terms are the 32-bit hashes of each lower-cased word and of its first four and five letters, which
also catches inflected and compounded forms.  The machine has a bias, a weight and a vector per
term; a text's terms count once each however long it is, and the vectors' inner products score
pairs of terms, such as an insult beside a mention of a group, that a linear sum would miss.

It is fitted on at most ``max_labelled`` labelled documents, those with the smallest hash of their
id; terms enter by a likelihood-ratio test.  The fitted table is small (``max_terms`` rows at most)
and goes to the executors; scoring reads every text whole, in one pass without a shuffle.

Defined cases: null text is empty and scores the bias, as do texts without known terms; null labels
are left out and repeated ones count as toxic if any is; without usable labels the score is 0;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.chunks import RunCache, parts
from siltwork.llm.common import record, text_or_empty

_LETTERS = re.compile(r"[^\W\d_]+")


def _hash(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass"))


def run_terms(run: str) -> list[int]:
    out = []
    for word in _LETTERS.findall(run.lower()):
        out.append(_hash(word))
        out += [_hash(f"{n}^{word[:n]}") for n in (4, 5) if len(word) >= n]
    return out


@dataclass
class Machine:
    """Bias, and per term (sorted hashes) a weight and a vector."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score_terms(self, at: np.ndarray) -> float:
        """Probability for the set of terms at these places of the table."""
        return float(1 / (1 + np.exp(-np.clip(self.raw(at), -500, 500))))

    def raw(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.vectors[at]
        s = v.sum(0)
        return self.bias + float(self.weights[at].sum()) + 0.5 * float(s @ s - (v * v).sum())


def _screen(docs: list[np.ndarray], toxic: np.ndarray, least_docs: int, least_ratio: float, max_terms: int) -> np.ndarray:
    """Terms whose presence depends on the label, by the likelihood-ratio statistic."""
    terms, place = np.unique(np.concatenate(docs), return_inverse=True)
    of = np.repeat(toxic, [len(d) for d in docs])
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    a = np.bincount(place[of == 1], minlength=len(terms)).astype(float)
    b = np.bincount(place[of == 0], minlength=len(terms)).astype(float)

    def part(x, total, share):
        expected = total * share
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / expected), 0)

    have, miss = (a + b) / (n0 + n1), 1 - (a + b) / (n0 + n1) + 1e-12
    ratio = 2 * (part(a, n1, have) + part(b, n0, have) + part(n1 - a, n1, miss) + part(n0 - b, n0, miss))
    ok = np.flatnonzero((a + b >= least_docs) & (ratio >= least_ratio))
    ok = ok[np.argsort(-ratio[ok], kind="stable")[:max_terms]]
    return np.sort(terms[ok])


def fit(docs: list[np.ndarray], toxic: np.ndarray, *, rank: int = 8, epochs: int = 40, rate: float = 0.05, ridge: float = 1e-5, vector_ridge: float = 1e-3, least_docs: int = 4, least_ratio: float = 16.0, max_terms: int = 50_000, seed: int = 7) -> Machine:
    """Adam on the log loss, in mini-batches, with a ridge on weights and vectors."""
    toxic = np.asarray(toxic)
    n1 = int(toxic.sum()) if len(toxic) else 0
    if n1 == 0 or n1 == len(toxic):
        none = np.zeros(0, np.uint32)
        return Machine(500.0 if n1 else -500.0, none, np.zeros(0), np.zeros((0, rank)))
    terms = _screen(docs, toxic, least_docs, least_ratio, max_terms)
    rows = []
    for d in docs:
        at = np.searchsorted(terms, d)
        at[at == len(terms)] = 0
        rows.append(at[terms[at] == d] if len(terms) else np.zeros(0, np.int64))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), rank))
    bias = float(np.log(n1 / (len(toxic) - n1)))
    moments = [np.zeros(len(terms)), np.zeros(len(terms)), np.zeros_like(v), np.zeros_like(v)]
    m_bias = [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            take = order[k : k + 256]
            flat = np.concatenate([rows[i] for i in take])
            doc = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
            s = np.zeros((len(take), rank))
            np.add.at(s, doc, v[flat])
            square = np.bincount(doc, (v[flat] ** 2).sum(1), len(take))
            z = bias + np.bincount(doc, w[flat], len(take)) + 0.5 * ((s * s).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[take]) / len(take)
            gw = np.bincount(flat, g[doc], len(terms)) + ridge * w
            gv = np.zeros_like(v)
            np.add.at(gv, flat, g[doc, None] * (s[doc] - v[flat]))
            gv += vector_ridge * v
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, grad, m, q in ((w, gw, moments[0], moments[1]), (v, gv, moments[2], moments[3])):
                m *= 0.9
                m += 0.1 * grad
                q *= 0.999
                q += 0.001 * grad * grad
                x -= rate * fix * m / (np.sqrt(q) + 1e-8)
            gb = float(g.sum())
            m_bias = [0.9 * m_bias[0] + 0.1 * gb, 0.999 * m_bias[1] + 0.001 * gb * gb]
            bias -= rate * fix * m_bias[0] / (m_bias[1] ** 0.5 + 1e-8)
    return Machine(bias, terms, w, v)


def _term_sets(texts: list[str], cache: RunCache) -> list[np.ndarray]:
    return [np.unique(np.frombuffer(raw, "<u4")) for raw in cache.join([t.split() for t in texts])]


def labelled_terms(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of at most ``max_labelled`` documents (rows already restricted to the training fold)."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.binary())])
        cache = RunCache(lambda run: np.asarray(run_terms(run), "<u4").tobytes())
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in parts(map(len, texts), 1_000_000):
                terms = [t.tobytes() for t in _term_sets(texts[part], cache)]
                yield record(schema, {"doc_id": batch.column(0)[part], "toxic": batch.column(1)[part], "terms": terms})

    rows = joined.mapInArrow(run, "doc_id long, toxic int, terms binary").toArrow().sort_by("doc_id")
    return [np.frombuffer(b.as_buffer(), "<u4") for b in rows.column("terms")], rows.column("toxic").to_numpy().astype(int)


def held_out(column: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 12_000, **options) -> Machine:
    terms, toxic = labelled_terms(docs, labels, max_labelled)
    return fit(terms, toxic, **options)


def score(docs: DataFrame, machine: Machine, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted label of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
        model: Machine = shared.value
        place = {int(t): k for k, t in enumerate(model.terms)}
        cache = RunCache(lambda run: np.asarray([place[t] for t in run_terms(run) if t in place], "<u4").tobytes())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = []
            for part in parts(map(len, texts), 1_000_000):
                scores += [model.score_terms(at) for at in _term_sets(texts[part], cache)]
            yield record(schema, {"doc_id": batch.column(0), "score": scores, "predicted": [int(s >= threshold) for s in scores]})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_labelled: int = 12_000) -> DataFrame:
    """Fit outside the held-out fold, then score all documents."""
    machine = train(docs, labels.where(~held_out()), max_labelled=max_labelled)
    scored = score(docs, machine, threshold=threshold)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
