"""Operator 7: mixing to target weights with soft domain membership.

A classifier, fitted on a bounded sample of the labelled table (``SAMPLE`` rows a domain, picked by a hash of their ids),
gives every document posteriors p over the domains good, poor (low quality) and toxic. As the sample holds rare domains
more often than the table, posteriors are corrected to the domains' shares of all labelled rows. Nonnegative rates r, the
expected number of times that a document is used, are fitted so that the expected domain totals ``sum_i r_i t_i p_id`` (t:
tokens of whole texts by a public byte-level tokenizer) meet the target weights of the table's tokens, by nonnegative least
squares with a small ridge towards 1. Its optimum has the form ``max(0, 1 + p . slope)`` with one slope a domain; these
are found by projected Newton steps (damped where one does not lower the dual objective), and the ridge is lowered until
the residual is within ``TOLERANCE``. Each step is one aggregation of all documents to a few sums a domain, which are all
that the driver holds. No rate is capped. Targets that the ridge ``LEAST_RIDGE`` still misses, or that ``ITERATIONS``
steps do not meet, are warned of; ``Mixture.residual`` has the miss.

Copies are ``floor(rate + u)`` with u uniform by a hash of the id and the text, so that a row's fate is stable.

Null and empty texts have no tokens (the rate follows their posteriors, and weighs nothing); null ids are rated like
others and never labelled; repeated rows get equal rates; texts of any length are read whole; ``mix_documents`` keeps
extra columns, whatever their names, ``document_rates`` ignores them; without labels of two domains, or with fewer than six labelled rows, all rates are 1; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, byte_view, forget, write_out
from loomspark.llm.textbytes import word_hashes

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
SAMPLE = 2000
CELLS = 1 << 16
RIDGE = 1e-3
LEAST_RIDGE = 1e-10
ITERATIONS = 300
TOLERANCE = 2e-3


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=1)
def load_tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_KINDS = np.zeros(256, dtype=np.int8)
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[0x20, *range(0x09, 0x0E)]] = 4
_KINDS[128:] = 5


def _style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the share of bytes of each kind (other, small, capital, digit, space, beyond ASCII)."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 6))
    full = np.flatnonzero(n > 0)
    if len(full):
        kinds = _KINDS[data]
        for k in range(6):
            out[full, k] = np.add.reduceat((kinds == k).astype(np.int32), offsets[:-1][full]) / n[full]
    return out


@dataclass
class DomainModel:
    """Log-odds of hashed words for each domain, and a softmax over what they and the style say."""

    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    correction: np.ndarray  # added to the logits: log of the shares of all labelled rows over those of the sample

    def features(self, texts: pa.Array) -> np.ndarray:
        """Rows of features."""
        data, offsets = byte_view(texts)
        h, rows = word_hashes(data, offsets)
        n = len(offsets) - 1
        words = np.bincount(rows, minlength=n)
        at = np.concatenate(([0], np.cumsum(words)))
        cells = (h & np.uint64(CELLS - 1)).astype(np.int64)
        x = np.zeros((n, 2 + 6 + 3 * self.odds.shape[1]))
        x[:, 2:8] = _style(data, offsets)
        lines = [(t.as_py() or "").split("\n") for t in texts]
        for i in range(n):
            own = cells[at[i] : at[i + 1]]
            x[i, 0] = np.log1p(len(own))
            x[i, 1] = len(set(lines[i])) / len(lines[i])
            if len(own):
                own = np.unique(own)
                x[i, 1] += len(own) / (at[i + 1] - at[i])
                for d in range(self.odds.shape[1]):
                    v = self.odds[own, d]
                    top = np.partition(v, -3)[-3:] if len(v) > 3 else v
                    x[i, 8 + 3 * d : 11 + 3 * d] = top.max(), top.sum(), v.mean()
        return x

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale)) @ self.weights + self.correction
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_domains(rows: list[tuple[int, str | None]], shares: np.ndarray | None = None, domains: int = len(DOMAINS)) -> DomainModel | None:
    """``rows``: (domain, text), ``shares``: of the domains among all labelled rows. Words from two thirds of the rows, the
    softmax from the others."""
    if len({d for d, _ in rows}) < 2 or len(rows) < 6:
        return None
    first, second = [r for i, r in enumerate(rows) if i % 3 != 2], [r for i, r in enumerate(rows) if i % 3 == 2]
    df = np.zeros((CELLS, domains))
    for d, text in first:
        h, _ = word_hashes(*byte_view(pa.array([text or ""], pa.string())))
        df[np.unique(h & np.uint64(CELLS - 1)).astype(np.int64), d] += 1
    n = np.array([max(1, sum(1 for d, _ in first if d == k)) for k in range(domains)], dtype=float)
    rest, total = df.sum(axis=1, keepdims=True) - df, n.sum() - n
    odds = np.log((df + 0.5) / (n + 1)) - np.log((rest + 0.5) / (total + 1))
    odds[df.sum(axis=1) < 4] = 0.0
    model = DomainModel(odds, np.zeros(1), np.ones(1), np.zeros((1, domains)), np.zeros(domains))
    texts = pa.array([t or "" for _, t in second], pa.string())
    x = np.concatenate([model.features(texts.slice(a, b - a)) for a, b in bounded_batches(texts)])
    y = np.eye(domains)[[d for d, _ in second]]
    if shares is not None:
        model.correction = np.log(np.maximum(shares, 1e-9)) - np.log(np.maximum(y.mean(axis=0), 1e-9))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack((np.ones(len(x)), (x - model.mean) / model.scale))
    w = np.zeros((z.shape[1], domains))
    step = 2.0 / (np.linalg.norm(z, 2) ** 2 / len(z) + 0.01)
    for _ in range(500):
        s = z @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= step * (z.T @ (p - y) / len(z) + 0.002 * w)
    model.weights = w
    return model


@dataclass
class Mixture:
    model: DomainModel | None
    slope: list[float] = field(default_factory=lambda: [0.0] * len(DOMAINS))
    residual: list[float] = field(default_factory=list)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1 + p @ np.array(self.slope))


def _posteriors(model, tokenizer: str):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("p", pa.list_(pa.float64())), ("u", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m, encode = model.value, load_tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            for i, j in bounded_batches(batch.column(1)):
                part = batch.slice(i, j - i)
                tokens = [len(encode(t.as_py() or "")) for t in part.column(1)]
                p = m.posteriors(m.features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64())), part.column(2)], schema=schema)

    return run, "doc_id bigint, tokens bigint, p array<double>, u double"


def _p(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _totals(mixture):
    """A task's sums by domain of rate * tokens * p, then of tokens * p p' where the rate is above 0, then of tokens * rate^2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p, tokens = _p(batch.column(1)), batch.column(0).to_numpy()
                rate = mixture.value.rates(p)
                bend = (p * (tokens * (rate > 0))[:, None]).T @ p
                own = np.concatenate(((rate * tokens) @ p, bend.ravel(), [(tokens * rate**2).sum()]))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["d", "v"])

    return run, "d int, v double"


def _with_rate(mixture):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("p", pa.list_(pa.float64())), ("u", pa.float64()), ("rate", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(mixture.value.rates(_p(batch.column(2))))], schema=schema)

    return run, "doc_id bigint, tokens bigint, p array<double>, u double, rate double"


def _uniform(id_col: str, text_col: str):
    return (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic before poor before good."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(domain).alias("domain")).where("domain is not null")


def train_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DomainModel | None:
    known, order = labelled_domains(labels), F.xxhash64("doc_id")
    picked = None
    for k in range(len(DOMAINS)):  # at most SAMPLE ids each
        own = known.where(F.col("domain") == k).orderBy(order, "doc_id").limit(SAMPLE)
        picked = own if picked is None else picked.union(own)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("domain").alias("domain")).orderBy(order, "doc_id").select("domain", "text").collect()
    counts = dict(known.groupBy("domain").count().collect())  # one number a domain
    shares = np.array([counts.get(k, 0) for k in range(len(DOMAINS))], dtype=float)
    return fit_domains([(r[0], r[1]) for r in rows], shares / max(1.0, shares.sum()))


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> tuple[Mixture, DataFrame | None]:
    """The mixture, and the table (doc_id, tokens, p, u) of all documents; None if there is no model."""
    spark = docs.sparkSession
    model = train_domains(docs, labels, id_col, text_col)
    if model is None:
        return Mixture(None), None
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _uniform(id_col, text_col))
    table = write_out(rows.mapInArrow(*_posteriors(shared, tokenizer or default_tokenizer())), "posteriors")
    whole = float(table.agg(F.sum("tokens")).first()[0] or 0)
    want = np.array([(targets or TARGETS)[d] for d in DOMAINS])
    want = want / want.sum()
    mixture = Mixture(model)
    if not whole:
        return mixture, table
    n = len(DOMAINS)

    def sums_at(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        now = spark.sparkContext.broadcast(Mixture(None, slope.tolist()))
        sums = dict(table.select("tokens", "p").mapInArrow(*_totals(now)).groupBy("d").agg(F.sum("v")).collect())  # a few numbers
        v = np.array([sums.get(d, 0.0) for d in range(n + n * n + 1)]) / whole
        return v[:n] - want, v[n : n + n * n].reshape(n, n), v[-1] / 2 - slope @ want

    slope, ridge = np.zeros(n), RIDGE
    residual, bend, value = sums_at(slope)
    for _ in range(ITERATIONS):
        if np.abs(residual).max() < TOLERANCE:
            break
        gradient = residual + ridge * slope
        if np.abs(gradient).max() < TOLERANCE / 10:
            if ridge <= LEAST_RIDGE:
                break
            ridge /= 10
            continue
        step = -np.linalg.solve(bend + ridge * np.eye(n), gradient)
        before, part = value + ridge / 2 * slope @ slope, 1.0
        while True:
            ahead = slope + part * step
            tried = sums_at(ahead)
            if tried[2] + ridge / 2 * ahead @ ahead <= before + 1e-4 * part * gradient @ step or part < 1e-3:
                break
            part /= 2
        slope, (residual, bend, value) = ahead, tried
    mixture.slope, mixture.residual = slope.tolist(), residual.tolist()
    if np.abs(residual).max() >= TOLERANCE:
        warnings.warn(f"the target weights are missed by {dict(zip(DOMAINS, residual.round(4).tolist(), strict=True))}", stacklevel=2)
    return mixture, table


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, p_good, p_poor, p_toxic, rate, copies) for each row."""
    mixture, table = fit_mixture(docs, labels, targets)
    if table is None:
        one = F.lit(1.0)
        return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("tokens"), *(F.lit(None).cast("double").alias(f"p_{d}") for d in DOMAINS), one.alias("rate"), F.lit(1).cast("long").alias("copies"))
    rated = table.mapInArrow(*_with_rate(docs.sparkSession.sparkContext.broadcast(Mixture(None, mixture.slope))))
    return rated.select("doc_id", "tokens", *(F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round("rate", 6).alias("rate"), F.floor(F.col("rate") + F.col("u")).alias("copies"))


def _copies(mixture, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = mixture.value
        for batch in batches:
            for i, j in bounded_batches(batch.column(text_at)):
                part = batch.slice(i, j - i)
                x = m.model.features(part.column(text_at))
                n = np.floor(m.rates(m.model.posteriors(x)) + part.column(part.num_columns - 1).to_numpy()).astype(np.int64)
                keep = np.repeat(np.arange(len(n)), n)
                out = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(out.columns[:-1], names=names)

    return run


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says; texts are scored again in place rather than joined."""
    mixture, table = fit_mixture(docs, labels, targets, id_col, text_col)
    if table is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(mixture)
    schema = docs.schema
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select("*", _uniform(*(f"c{docs.columns.index(c)}" for c in (id_col, text_col))))
    return rows.mapInArrow(_copies(shared, docs.columns.index(text_col), docs.columns), schema)
