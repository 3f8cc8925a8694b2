"""Toxicity by maximum-scoring segments of token log-odds.

Learning: document frequencies of words and word beginnings in toxic and clean
training texts, equal texts counted once, give log-odds.  A word's Dirichlet
prior is the rate of its beginning, whose prior is the rate of all; a score is
the log-odds less ``CAUTION`` standard deviations.  Words without a positive score pull
down by ``drift``.

Scoring: a linear scan finds all maximal segments (each a passage that no longer
or shorter one beats).  Segment scores follow an extreme-value law; its decay is
solved from the scores of clean texts, so that a passage's significance takes
the text's length into account.  The evidence of the best and of all significant
passages goes through a logistic curve that is fitted on the training texts.

Null and empty texts have no passages and get the curve's lowest score.  Without
any usable label every text gets 0.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm import common

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of their doc_id.
MAX_TRAINING_ROWS = 20_000
#: Entries of the word table, at most; the table is sent to all tasks.
MAX_ENTRIES = 50_000
SEEN_WORDS = 300_000
BEGINNING = 5
STRENGTH = 10.0
#: Standard deviations that a score is lowered by.
CAUTION = 1.8
SEEN = 3
DRIFT = 0.35
_EDGE = "\"'`´.,;:!?()[]{}<>*#$%&|/\\-_+=~^@«»“”‘’…"


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    decay: float = 1.0
    constant: float = 0.1
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)
    #: Scores of words that a worker has met; emptied when it grows over ``SEEN_WORDS``.
    seen: dict[bytes, float] = field(default_factory=dict, repr=False)


def plain(word: bytes) -> str:
    """A word in lower case without marks at its ends."""
    return word.decode("utf-8", "replace").lower().strip(_EDGE)


def _weights(distinct: list[bytes], model: Model) -> np.ndarray:
    """The score of each distinct word; 0 stands for the drift."""
    words, beginnings, seen, out = model.words, model.beginnings, model.seen, np.zeros(len(distinct))
    if len(seen) > SEEN_WORDS:
        seen.clear()
    for i, raw in enumerate(distinct):
        score = seen.get(raw)
        if score is not None:
            out[i] = score
            continue
        word = plain(raw)
        score = words.get(word)
        if score is None:
            score = beginnings.get(word[:BEGINNING], 0.0) if len(word) > BEGINNING else 0.0
        out[i] = seen[raw] = score
    return out


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) of a text of ``drift`` below zero but for ``score`` at ``at``.

    The scan keeps disjoint candidates with the sums before and behind them, and
    of each the last one whose sum before is lower; a new one is joined with
    those that it improves.  Only positive places are visited, and the links make
    the scan linear.
    """
    out: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum behind, last with a lower sum before
    total, done = 0.0, 0
    for place, value in zip(at, score):
        total -= drift * (place - done)
        before, total, done = total, total + value, place + 1
        first, k = place, len(out) - 1
        while True:
            while k >= 0 and out[k][2] >= before:
                k = out[k][4]
            if k < 0 or out[k][3] >= total:
                break
            first, _, before, _, link = out[k]
            del out[k:]
            k = link
        out.append((first, place, before, total, k))
    return [(a, b, high - low) for a, b, low, high, _ in out]


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, float]:
    """(best, all): minus the log of the best passage's chance, and the sum of what significant passages exceed it by."""
    if not found or n == 0:
        return 0.0, 0.0
    level = np.log(model.constant * max(n, 1))
    over = [model.decay * s - level for _, _, s in found]
    top = max(over)
    # The chance that a clean text of n words has a passage of that score: 1 - exp(-K n exp(-decay * score)).
    best = top if top > 30 else -np.log(-np.expm1(-np.exp(-top)))
    return float(min(best, 60.0)), float(min(sum(x for x in over if x > 0), 60.0))


def _scored(part: pa.RecordBatch, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], common.Words]:
    w = common.words_of(part.column("text"))
    weight = _weights(w.distinct.to_pylist(), model)
    per_word = weight[w.code] if len(w.code) else np.zeros(0)
    where = np.flatnonzero(per_word > 0)
    limits = np.searchsorted(where, w.first)
    n = len(w.first) - 1
    x = np.zeros((n, 2))
    passages: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    for d in np.flatnonzero(np.diff(limits)).tolist():
        mine = where[limits[d] : limits[d + 1]]
        found = segments((mine - w.first[d]).tolist(), per_word[mine].tolist(), model.drift)
        passages[d] = found
        x[d] = evidence(found, int(w.first[d + 1] - w.first[d]), model)
    return x, passages, w


def curve(x: np.ndarray, model: Model) -> np.ndarray:
    a, b, c = model.curve
    return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(x[:, 0]) + c * np.log1p(x[:, 1]), -50, 50)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        x, passages, w = _scored(part, model)
        scores = np.clip(curve(x, model), 0.0, 1.0)
        level = [np.log(model.constant * max(int(k), 1)) for k in np.diff(w.first)]
        listed = [[{"first": a, "last": b, "score": s} for a, b, s in found if model.decay * s > lv] for found, lv in zip(passages, level)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(listed, _PASSAGES)], names=["doc_id", "score", "passages"])


_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word (kind 0), beginning (1) and of the texts (2): toxic and clean texts that have it."""
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
            names=["kind", "token", "toxic", "clean"],
        )

    for part in common.slices(batches):
        w = common.words_of(part.column("text"))
        names = [plain(x) for x in w.distinct.to_pylist()]
        for d, label in enumerate(part.column("toxic").to_pylist()):
            words = {names[i] for i in set(w.code[w.first[d] : w.first[d + 1]].tolist())}
            to = toxic if label else clean
            to.update((0, x) for x in words)
            to.update((1, y) for y in {x[:BEGINNING] for x in words if len(x) > BEGINNING})
            to[(2, "")] += 1
        if len(toxic) + len(clean) > 400_000:
            yield flush()
            toxic.clear()
            clean.clear()
    yield flush()


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows outside the held-out fifth; equal texts are one row, toxic if most copies are."""
    open_rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS string)) % 5 <> 0").select("doc_id", "toxic")
    chosen = open_rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` pairs of numbers
    once = rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.avg("toxic").alias("rate"))
    return once.select("text", (F.col("rate") >= 0.5).alias("toxic"))


def _log_odds(rate: Column, base: float) -> Column:
    """Log-odds of toxic over the base rate with ``STRENGTH`` prior texts of ``rate``, less ``CAUTION`` standard deviations."""
    x, y = F.col("toxic") + STRENGTH * rate, F.col("clean") + STRENGTH * (1 - rate)
    return F.log(x / y) - float(np.log(base / (1 - base))) - CAUTION * F.sqrt(1 / x + 1 / y)


def learn(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_TRAINING_ROWS) -> Model:
    """Fits a model.  The corpus is read once per step; the driver gets a table of at most ``MAX_ENTRIES`` words."""
    shared = common.Shared(docs.sparkSession, "toxicity")
    rows = shared.put(training_rows(docs, labels, limit))
    counted = shared.put(rows.mapInArrow(_frequencies, "kind int, token string, toxic long, clean long").groupBy("kind", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    whole = counted.where("kind = 2").first()
    model = Model()
    if whole is None or not whole.toxic or not whole.clean:
        return model
    base = whole.toxic / (whole.toxic + whole.clean)
    of_all = F.lit(base)
    firsts = counted.where("kind = 1").select("token", ((F.col("toxic") + STRENGTH * base) / (F.col("toxic") + F.col("clean") + STRENGTH)).alias("rate"), _log_odds(of_all, base).alias("first_score"))
    firsts = firsts.withColumnRenamed("token", "first")
    model.beginnings = {r[0]: r[1] for r in firsts.where("first_score > 0").orderBy(F.desc("first_score"), "first").limit(MAX_ENTRIES).select("first", "first_score").collect()}
    first = F.when(F.length("token") > BEGINNING, F.substring("token", 1, BEGINNING))
    words = counted.where("kind = 0 AND toxic + clean >= 2 AND token <> ''").select("token", "toxic", "clean", first.alias("first")).join(firsts, "first", "left")
    words = words.select("token", _log_odds(F.coalesce("rate", of_all), base).alias("score"), (F.col("toxic") + F.col("clean") >= SEEN).alias("seen"), F.coalesce(F.col("first_score") > 0, F.lit(False)).alias("marked"))
    kept = words.where("score > 0 OR seen AND marked").orderBy(F.desc("score"), "token").limit(MAX_ENTRIES)
    model.words = {r[0]: max(0.0, r[1]) for r in kept.select("token", "score").collect()}
    _calibrate(model, rows)
    return model


def _hits(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Scores of words in clean texts, to thousandths, and how often each occurs."""
    found: Counter = Counter()
    for part in common.slices(batches):
        w = common.words_of(part.column("text"))
        weight = np.rint(_weights(w.distinct.to_pylist(), model) * 1000).astype(np.int64)
        values, counts = np.unique(weight[w.code] if len(w.code) else weight[:0], return_counts=True)
        found.update(dict(zip(values.tolist(), counts.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["score", "n"])


def _best(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Texts with a passage, and the sum of n exp(-decay * best) of all texts of n words.

    Their quotient is the likeliest constant K of the law exp(-K n exp(-decay * s)) of
    best scores; a text without a passage says that its best is at most 0.
    """
    for part in common.slices(batches):
        _, passages, w = _scored(part, model)
        best = np.array([max((s for _, _, s in found), default=0.0) for found in passages])
        mass = (np.diff(w.first) * np.exp(-model.decay * best)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([int((best > 0).sum())], pa.int64()), pa.array([float(mass)])], names=["found", "mass"])


def _evidences(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        x, _, _ = _scored(part, model)
        yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "best", "all"])


def _calibrate(model: Model, rows: DataFrame) -> None:
    counted = rows.where("NOT toxic").select("text").mapInArrow(lambda it: _hits(it, model), "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    # The decay solves E[exp(decay * score)] = 1 over the words of clean texts, and one more hit than was seen among them.
    top = max(model.words.values(), default=1.0)
    values = np.array([*(r[0] / 1000 if r[0] > 0 else -model.drift for r in counted), top])
    weight = np.array([*(float(r[1]) for r in counted), 1.0])
    low, high = 1e-3, 3.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = (weight * np.exp(mid * values)).sum() / weight.sum()
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.decay = low
    fit = rows.where("NOT toxic").select("text").mapInArrow(lambda it: _best(it, model), "found long, mass double").agg(F.sum("found").alias("found"), F.sum("mass").alias("mass")).first()
    if fit.found and fit.mass:
        model.constant = fit.found / fit.mass
    got = rows.mapInArrow(lambda it: _evidences(it, model), "toxic boolean, best double, all double").collect()  # three numbers a training row
    x = np.array([[r[1], r[2]] for r in got]).reshape(-1, 2)
    model.curve = _logistic(np.log1p(x), np.array([float(r[0]) for r in got]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, float, float]:
    """Newton steps on the regularised likelihood; slopes below zero are set to zero."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    penalty = ridge * np.array([0.0, 1.0, 1.0]) + 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - penalty * beta
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if (beta[1:] < 0).any():
        best = int(np.argmax(beta[1:]))
        if x[:, best].std() > 0 and not (beta[1:] < 0).all():
            single = np.zeros_like(x)
            single[:, best] = x[:, best]
            if (x != single).any():
                return _logistic(single, y, ridge, steps)
        beta[1:] = np.maximum(beta[1:], 0)
    return tuple(float(b) for b in beta)


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, score, passages) of every row of ``docs``; passages are word positions, last included."""
    fitted = model or learn(docs, labels)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, fitted), "doc_id long, score double, passages array<struct<first: long, last: long, score: double>>")


def _keep(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        x, _, _ = _scored(part, model)
        yield part.filter(pa.array(curve(x, model) < 0.5))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    return docs.mapInArrow(lambda it: _keep(it, model), docs.schema)
