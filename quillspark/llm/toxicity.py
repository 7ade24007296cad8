"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings, trained in numpy from
confirmed toxic texts and unlabelled ones with the non-negative risk estimator: the risk
of calling unlabelled texts toxic, less the share that the class prior gives to toxic
ones, held at zero or above. Labels other than toxic ones serve for the class prior only.

The training sample is bounded: at most `positives` toxic and `unlabelled` other texts,
those with the smallest hash of their id. The class prior counts all labels of the
training part. Scoring covers whole texts.

Rows: null and empty texts score the classifier's intercept; a null doc_id counts as the
empty id text; repeated rows are scored each; with no toxic label to learn from all
scores are the class prior, and 0 without labels; extra columns pass through scored() as they
are, but for score and predicted, which it returns itself; an empty table gives an empty
result. A text is held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .storage import durable

#: fixed values: bytes of the word beginnings that are features beside whole words
STEMS = (4, 5, 6)
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SIEVE = 1 << 20
#: least share of the toxic sample that a feature marks; weight decay, in toxic texts of the sample
SHARE, DECAY = 0.02, 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def features(buf: np.ndarray, offs: np.ndarray):
    """(rows, hashes) of each kind of feature: whole words, then each word beginning that a word exceeds."""
    low = tn.LOWER[buf]
    s, e, r = tn.spans(low, offs, _NOT_LETTER)
    if not len(s):
        return
    h = tn.SubstringHash(low)
    yield r, h(s, e)
    for k in STEMS:
        long = np.flatnonzero(e - s > k)
        yield r[long], tn.mix(h(s[long], s[long] + k), k)


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    intercept: float

    def sieve(self) -> np.ndarray:
        out = np.zeros(_SIEVE, dtype=bool)
        out[(self.keys & tn.U64(_SIEVE - 1)).astype(np.int64)] = True
        return out


def found(buf: np.ndarray, offs: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into keys) of the features that a run of texts holds."""
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(keys):
        for r, h in features(buf, offs):
            likely = np.flatnonzero(sieve[(h & tn.U64(_SIEVE - 1)).astype(np.int64)])
            h, r = h[likely], r[likely]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            is_key = keys[at] == h
            rows.append(r[is_key])
            places.append(at[is_key])
    both = np.unique(np.concatenate(rows) * max(len(keys), 1) + np.concatenate(places))
    return both // max(len(keys), 1), both % max(len(keys), 1)


def fit(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by the non-negative risk. (rows, cols): present features; positive: by row."""
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=len(positive)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_as_negative = np.logaddexp(0, z)
        rest = loss_as_negative[~positive].sum() / n_u - prior * loss_as_negative[positive].sum() / n_p
        g = np.zeros(len(positive))
        if rest >= 0:
            g[positive] = prior * (p[positive] - 1) / n_p - prior * p[positive] / n_p
            g[~positive] = p[~positive] / n_u
        else:  # the negative part has gone below zero: step back along it
            g[positive] = prior * p[positive] / n_p
            g[~positive] = -p[~positive] / n_u
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=width) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, positives: int = 2000, unlabelled: int = 8000, least: int = 3) -> Model:
    """The classifier from the rows of docs and labels (doc_id, toxic) for which learn_from holds
    (by default those not held out). A feature stands in `least` toxic texts at least and is
    in a fiftieth of the sampled ones, and is likelier than three in ten to mark one, beyond four
    standard deviations of chance."""
    learn_from = ~held_out(F.col("doc_id")) if learn_from is None else learn_from
    labels = labels.where(learn_from)
    total = labels.agg(F.count("toxic").alias("n"), F.sum(F.col("toxic").cast("long")).alias("t")).first()
    if not total.t:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf if not total.n else _logit(0))
    prior = min(total.t / total.n, 0.999)
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    toxic = labels.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    others = docs.where(learn_from).select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled)

    texts = docs.select("doc_id", "text")
    # both lists of ids are bounded by their limits; the sample is written down, so what follows reads it alone
    sample = durable(texts.join(F.broadcast(toxic), "doc_id").select(F.lit(True).alias("toxic"), "text").union(texts.join(F.broadcast(others), "doc_id").select(F.lit(False), "text")))

    def hashes(batches):
        for b in batches:
            for _, _, buf, offs in tn.chunks(b.column(0)):
                every = list(features(buf, offs))
                r = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in every)])
                h = np.concatenate([np.zeros(0, tn.U64), *(x[1] for x in every)])
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], names=["h"])

    counted = sample.where("toxic").select("text").mapInArrow(hashes, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).toPandas()
    keys = counted["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, n = keys[order], counted["n"].to_numpy(np.int64)[order]

    def places(keys):
        """DataFrame of (toxic, the indexes of the keys that a text holds)."""
        shipped = docs.sparkSession.sparkContext.broadcast((keys, Model(keys, keys, 0.0).sieve()))

        def run(batches):
            for b in batches:
                out = []
                for _, _, buf, offs in tn.chunks(b.column(1)):
                    r, c = found(buf, offs, *shipped.value)
                    out += [x.astype(np.int32).tolist() for x in np.split(c, np.searchsorted(r, np.arange(1, len(offs) - 1)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "places"])

        return sample.mapInArrow(run, "toxic boolean, places array<int>")

    n_toxic, n_plain = (sample.where(c).count() for c in ("toxic", "not toxic"))
    in_plain = np.zeros(len(keys), dtype=np.int64)
    for r in places(keys).where("not toxic").select(F.explode("places").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect():
        in_plain[r.k] = r.n
    # share of the texts with a feature that are toxic, by the prior; smoothed by half a text
    telling = prior * (n / max(n_toxic, 1)) / ((in_plain + 0.5) / max(n_plain, 1)) >= 0.3
    # and more toxic texts with it than chance gives
    chance = n_toxic * in_plain / max(n_plain, 1)
    telling &= (n >= chance + 4 * np.sqrt(chance + 0.5)) & (n >= SHARE * n_toxic)
    keys = keys[telling]
    found_in = sorted((not r.toxic, r.places) for r in places(keys).collect())
    at = [p for _, p in found_in]
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
    w, b = fit(rows, cols, np.array([not plain for plain, _ in found_in], dtype=bool), len(keys), prior, decay=DECAY / max(n_toxic, 1))
    return Model(keys, w, b)


def _logit(p: float) -> float:
    return float("-inf") if p <= 0 else float(np.log(p / (1 - p)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (score of a half or more)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast((model, model.sieve()))

    def run(batches):
        m, sieve = shipped.value
        for b in batches:
            z = [np.zeros(0)]
            for _, _, buf, offs in tn.chunks(b.column(at)):
                r, c = found(buf, offs, m.keys, sieve)
                z.append(np.bincount(r, weights=m.weights[c], minlength=len(offs) - 1) + m.intercept)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -700, 700)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int"]))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
