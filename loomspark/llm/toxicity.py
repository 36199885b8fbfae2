"""Operator 1: toxicity by compression distance.

Separate zstandard dictionaries are trained on toxic and on ordinary text. A text's windows are its overlapping runs of
words of about ``WINDOW`` bytes; each is compressed with the ordinary dictionary alone and with the toxic dictionary laid
before it, and the difference of the two lengths is what the toxic dictionary saves. Savings are compared with
thresholds that are calibrated on ordinary text (the savings that one window in a hundred, a thousand and ten thousand of
it exceeds), and a logistic calibration, fitted on labelled rows that trained no dictionary, turns the numbers and shares
of windows beyond each threshold into a score from 0 to 1.

Most windows of toxic texts are ordinary language. So the toxic dictionary is trained in ``ROUNDS``: first on all windows
of the toxic rows, then on those windows that save more than ordinary ones do, as measured by a dictionary of the other
half of the rows; what only one row (or its copies, which are left out) holds is thus not learnt.

Training reads a bounded sample of labelled rows (``TOXIC_ROWS`` and ``ORDINARY_ROWS``, picked by a hash of their ids, and
of their windows ``WINDOWS``, drawn at random); scoring covers whole texts. Null and empty texts are one empty window, and
get the score of a text without toxic wording. With fewer than six labelled rows of either kind nothing can be
calibrated and every score is 0. Null ids are never
labelled; repeated rows get equal scores; extra columns, whatever their names, are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOXIC_ROWS = 2500
ORDINARY_ROWS = 6000
WINDOWS = 80_000
WINDOW = 32
LEVEL = 9
ROUNDS = 3
#: Size in bytes, segment and piece lengths of the dictionaries: ordinary, toxic at first, toxic from windows that save.
ORDINARY_TRAINING = (500_000, 100, 8)
FIRST_TRAINING = (32_000, 24, 6)
TOXIC_TRAINING = (6_000, 16, 6)
#: Shares of ordinary windows that stay under each threshold.
CALM = (0.99, 0.999, 0.9999)
#: zstandard looks for no match that starts in the last eight bytes of its input.
END = b"\x01" * 8


def prepare(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Runs of words of ``size`` bytes and up to the next space (at most twice as many), each from about the middle of the last."""
    out, i, n = [], 0, len(text)
    while True:
        j = text.find(b" ", i + size, i + 2 * size) if n > i + size else n
        j = min(n, i + 2 * size) if j < 0 else j
        out.append(text[i:j])
        if j >= n:
            return out
        k = text.find(b" ", i + size // 2, j)
        i = k if k > i else j


def novel(texts: list[bytes], k: int = 4) -> list[bytes]:
    """The texts less those of which half the ``k``-word runs were in earlier ones."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        words = t.split()
        runs = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
        if 2 * len(runs & seen) < len(runs):
            out.append(t)
            seen |= runs
    return out


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary's bytes; too few samples to train on stand as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Savings:
    """For each window of a text the bytes that the toxic dictionary saves on top of the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = self._compress(ordinary), self._compress(toxic + ordinary)

    @staticmethod
    def _compress(content: bytes):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def of(self, parts: list[bytes]) -> np.ndarray:
        plain, both = self.plain, self.both
        return np.array([len(plain(w + END)) - len(both(w + END)) for w in parts], dtype=np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        return self.of(windows(text))


@dataclass
class ToxicityModel:
    toxic_dictionary: bytes
    ordinary_dictionary: bytes
    thresholds: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def measure(self) -> Savings:
        return Savings(self.ordinary_dictionary, self.toxic_dictionary)

    def features(self, saved: np.ndarray) -> list[float]:
        """The two largest savings, and the number (log) and share of windows beyond each threshold."""
        top = np.sort(saved)[::-1]
        hits = np.array([(saved > t).sum() for t in self.thresholds], dtype=np.float64)
        return [float(top[0]), float(top[1]) if len(top) > 1 else 0.0, *np.log1p(hits), *(100 * hits / len(saved)), float(np.log1p(len(saved)))]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton's method on standardised features, given back for raw ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(w[0] - (w[1:] * mean / scale).sum()), *(w[1:] / scale).tolist()]


def toxic_dictionary(toxic: list[bytes], ordinary: bytes, calm: list[bytes], rng: random.Random) -> bytes:
    """Trained on the windows of toxic texts that a dictionary of the other half of them finds toxic."""
    halves = [list(dict.fromkeys(w for t in toxic[h::2] for w in windows(t))) for h in (0, 1)]
    halves = [rng.sample(h, min(len(h), WINDOWS)) for h in halves]
    picked, training = halves, FIRST_TRAINING
    for _ in range(ROUNDS):
        measures = [Savings(ordinary, trained(own, *training)) for own in picked]
        least = max(2.0, *(float(np.quantile(m.of(calm), CALM[1])) for m in measures))
        found = [[w for w, s in zip(h, other.of(h), strict=True) if s >= least] for h, other in zip(halves, measures[::-1], strict=True)]
        if not all(found):
            break
        picked, training = found, TOXIC_TRAINING
    return trained(picked[0] + picked[1], *training)


def fit(toxic: list[str | None], ordinary: list[str | None]) -> ToxicityModel:
    """Dictionaries and thresholds from two thirds of the labelled texts, the logistic calibration from the others."""
    if len(toxic) < 6 or len(ordinary) < 6:
        return ToxicityModel(b"", b"")
    t, o = [prepare(x) for x in toxic], [prepare(x) for x in ordinary]
    own = lambda x, held: [v for i, v in enumerate(x) if (i % 3 == 2) == held]
    rng = random.Random(7)
    usual = novel(own(o, False))
    spans = [x[i : i + 400] for x in usual[::2] for i in range(0, max(1, len(x)), 400)]
    rng.shuffle(spans)
    base = trained(spans, *ORDINARY_TRAINING)
    calm = [w for x in usual[1::2] for w in windows(x)] or [b""]
    calm = rng.sample(calm, min(len(calm), WINDOWS // 2))
    model = ToxicityModel(toxic_dictionary(novel(own(t, False)), base, calm, rng), base)
    measure = model.measure()
    model.thresholds = [max(1.0, float(np.quantile(measure.of(calm), q))) for q in CALM]
    held = [(x, 1) for x in own(t, True)] + [(x, 0) for x in own(o, True)]
    x = np.array([model.features(measure(v)) for v, _ in held], dtype=np.float64)
    model.weights = _logistic(x, np.array([label for _, label in held], dtype=float))
    return model


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_windows", pa.int64()), ("top_saving", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        measure = m.measure()
        for batch in batches:
            rows, n, top = [], [], []
            for text in batch.column(1):
                saved = measure(prepare(text.as_py()))
                rows.append(m.features(saved))
                n.append(len(saved))
                top.append(int(saved.max()))
            score = m.score(np.array(rows, dtype=np.float64).reshape(len(n), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score), pa.array(n, pa.int64()), pa.array(top, pa.int64())], schema=schema)

    return run, "doc_id bigint, score double, n_windows bigint, top_saving bigint"


def held_out(id_col: str = "doc_id"):
    """Rows from which no label is learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> ToxicityModel:
    """A model from a bounded sample of the labelled rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text_col).alias("text"))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    sample = picked[0].union(picked[1])  # at most TOXIC_ROWS + ORDINARY_ROWS ids
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = texts.orderBy(order, "doc_id").select("toxic", "text").collect()
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows, top_saving) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(*_score(shared))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows", "top_saving")
