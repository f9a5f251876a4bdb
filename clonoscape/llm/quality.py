"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs join a document labelled good with one labelled bad.  The
score of a document is linear in its features, and the weights minimise the
logistic loss on feature differences.  A monotone curve turns scores into
probabilities, and a quantile of the training scores gives the filter's
threshold.  All labelled documents are learned from: each is in several pairs, and
curve and threshold come from counts of all their scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, staged, table
from .textbatch import buffers, slices, words

#: Training rows that a task pairs (all of them are paired in one task or another), pairs of each, most Newton steps, ridge, and steps of the curve.
PART_ROWS, PAIRINGS, STEPS, RIDGE, BINS = 16_384, 4, 15, 1e-3, 4096
#: Bytes of text that a task looks at together.
SLICE = 1 << 19
#: predicted = 1 from this score on (fixed value).
CUT = 0.3
#: Byte classes whose shares are features: single ASCII punctuation, digits, upper case, lower case, other white space, non-ASCII.
_CLASS = np.zeros(256, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
for _i, _b in enumerate(_marks):
    _CLASS[_b] = _i + 1
_N = len(_marks) + 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[10], _CLASS[128:] = _N, _N + 1, _N + 2, _N + 3, _N + 4
N_CLASSES = _N + 5


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Features of each document of a UTF-8 buffer; all zero for an empty one."""
    n = len(offs) - 1
    size = np.diff(offs)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    kinds = _CLASS[data]
    share = np.bincount(doc * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / some[:, None]
    w = words(data, offs)
    count = w.counts
    total = np.maximum(count, 1)
    of = w.doc
    length = (w.ends - w.starts).astype(float)
    mean = np.bincount(of, length, minlength=n) / total
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, minlength=n) / total - mean**2, 0))
    short = np.bincount(of[length <= 3], minlength=n) / total
    long = np.bincount(of[length >= 20], minlength=n) / total
    first = data[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    caps = np.bincount(of[(first >= 65) & (first <= 90)], minlength=n) / total
    stop = np.bincount(of[(last == 46) | (last == 33) | (last == 63)], minlength=n) / total
    odd = np.bincount(of[(_CLASS[last] > 0) & (_CLASS[last] < _N)], minlength=n) / total
    repeat = np.zeros(n)
    if len(of) > 1:
        same = (of[1:] == of[:-1]) & (w.hashes[1:] == w.hashes[:-1])
        repeat = np.bincount(of[1:][same], minlength=n) / total
    distinct, common = np.ones(n), np.zeros(n)
    for d in np.flatnonzero(count):
        _, c = np.unique(w.hashes[w.first[d] : w.first[d + 1]], return_counts=True)
        distinct[d], common[d] = len(c) / np.sqrt(count[d]), c.max() / count[d]
    lines = np.bincount(doc[data == 10], minlength=n) / total
    out = np.column_stack([np.sqrt(share), mean, spread, short, long, caps, stop, odd, repeat, np.log1p(distinct), common, lines, np.log1p(count)])
    out[size == 0] = 0
    return out


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores at which the curve is given
    curve: np.ndarray  # probability of label 1 there
    threshold: float = CUT  # of the filter, a quantile of the training documents' scores

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.rank(x), self.knots, self.curve)


def monotone(y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Pool adjacent violators: the closest rising curve to 0/1 labels (or shares with weights) in order of score."""
    level: list[list[float]] = []
    for v, n in zip(y, np.ones(len(y)) if weight is None else weight, strict=True):
        level.append([float(v), float(n), 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, n2, k2 = level.pop()
            v1, n1, k1 = level.pop()
            level.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return np.concatenate([np.full(int(k), v) for v, _, k in level]) if level else np.zeros(0)


def labelled_features(docs: DataFrame, labels: DataFrame, training: Column) -> tuple[DataFrame, float]:
    """part, labels y and features x of every training row, a row for each part of some thousand, and the share of label 1 among them. No text is shuffled."""
    known = labels.where(training & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n, share = known.agg(F.count("*"), F.avg("quality")).first()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_", SLICE):
            x = features(*buffers(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("quality", "ascending")])
        return pa.table({"part": t["part"].slice(0, 1), "y": [t["quality"].to_numpy().astype(np.int8).tobytes()], "x": [t["x"].combine_chunks().flatten().to_numpy().tobytes()]})

    told = docs.select("doc_id", F.col("text").alias("text_")).mapInArrow(run, f"doc_id {kind}, x array<double>")
    h = F.xxhash64("doc_id", F.lit(8))
    rows = told.join(known.hint("merge"), "doc_id").select("quality", "x", h.alias("h"), F.pmod(h, F.lit(max(1, -(-n // PART_ROWS)))).alias("part"))
    return staged(rows.groupBy("part").applyInArrow(packed, "part long, y binary, x binary"), "quality"), 0.5 if share is None else float(share)


def _summed(rows: DataFrame, f) -> dict[str, np.ndarray]:
    """Sums over the parts of the rows of f(x, y): arrays by name, of bounded size whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, y, x in zip(*(b.column(i) for i in range(3)), strict=True):
                y = np.frombuffer(y.as_buffer(), np.int8)
                told = f(np.frombuffer(x.as_buffer(), float).reshape(len(y), -1), y)
                yield pa.RecordBatch.from_arrays([pa.array(list(told)), pa.array([part.as_py()] * len(told), pa.int64()), pa.array([np.ravel(v).astype(float).tolist() for v in told.values()], pa.list_(pa.float64()))], ["name", "part", "total"])

    parts = rows.select("part", "y", "x").mapInArrow(run, "name string, part long, total array<double>")
    sums = parts.select("name", "part", F.posexplode("total").alias("at", "v")).groupBy("name", "at").agg(F.array_sort(F.collect_list(F.struct("part", "v"))).alias("v"))  # in the order of the parts, so that sums repeat
    sums = sums.select("name", "at", F.aggregate("v", F.lit(0.0), lambda s, x: s + x["v"]).alias("v"), F.array_min(F.transform("v", lambda x: x["v"])).alias("low"), F.array_max(F.transform("v", lambda x: x["v"])).alias("high"))
    out: dict[str, list] = {}
    for r in sums.orderBy("name", "at").collect():
        out.setdefault(r["name"], []).append(r["low"] if r["name"] == "low" else r["high"] if r["name"] == "high" else r["v"])
    return {k: np.array(v) for k, v in out.items()}


def fit_pairs(rows: DataFrame, share_good: float) -> Quality:
    """Weights by logistic loss on feature differences of (good, bad) pairs of all rows; curve and threshold by all their scores."""
    width = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
    s = _summed(rows, lambda x, y: {"n": [len(y), y.sum()], "x": x.sum(0), "xx": (x * x).sum(0)})
    n, good = s.get("n", (0, 0))
    mean, scale = np.zeros(width), np.ones(width)
    if n:
        mean = s["x"] / n
        scale = np.sqrt(np.maximum(s["xx"] / n - mean**2, 0)) + 1e-6
    q = Quality(mean, scale, np.zeros(width), np.array([0.0]), np.array([share_good]))
    if not good or good == n:
        return q

    def slope(w: np.ndarray):
        def run(x: np.ndarray, y: np.ndarray) -> dict:
            z = np.clip((x - mean) / scale, -8, 8)
            one, other = z[y == 1], z[y == 0]
            count, g, h = 0, np.zeros(width), np.zeros((width, width))
            for k in range(PAIRINGS if len(one) and len(other) else 0):  # every row of either label comes in each of these
                at = np.arange(max(len(one), len(other)))
                d = one[at % len(one)] - other[(at + k * (len(other) // PAIRINGS + 1)) % len(other)]
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                count, g, h = count + len(at), g - p @ d, h + (d * (p * (1 - p))[:, None]).T @ d
            return {"count": [count], "g": g, "h": h}

        return run

    w = q.weights
    for _ in range(STEPS):
        s = _summed(rows, slope(w))
        m = max(1.0, s["count"][0])
        step = np.linalg.solve(s["h"].reshape(width, width) / m + RIDGE * np.eye(width), s["g"] / m + RIDGE * w)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    q.weights = w
    ends = _summed(rows, lambda x, y: {"low": [q.rank(x).min()], "high": [q.rank(x).max()]})
    low, wide = ends["low"][0], max(1e-9, ends["high"][0] - ends["low"][0])

    def counts(x: np.ndarray, y: np.ndarray) -> dict:
        r = q.rank(x)
        at = np.clip(((r - low) / wide * BINS).astype(np.int64), 0, BINS - 1)
        return {"all": np.bincount(at, minlength=BINS), "good": np.bincount(at, y, BINS), "rank": np.bincount(at, r, BINS)}

    s = _summed(rows, counts)
    some = s["all"] > 0
    every, of, knots = s["all"][some], s["good"][some], (s["rank"] / np.maximum(s["all"], 1))[some]
    rising = monotone(of / every, every)
    # The labels' shares among documents may differ from those among all labelled rows, to which weights bring them back.
    odds = (share_good / max(1e-9, 1 - share_good)) / (good / (n - good))
    prob = np.clip(rising * odds / (rising * odds + 1 - rising), 0.002, 0.998)
    tilt = 1e-3 * (knots - knots[0]) / max(1e-9, knots[-1] - knots[0])  # keeps apart the scores of a level
    q.knots, q.curve = knots, np.minimum(prob + tilt, 0.999)
    below = np.cumsum(of * share_good / good + (every - of) * (1 - share_good) / (n - good))
    q.threshold = min(CUT, float(q.curve[min(len(knots) - 1, int(np.searchsorted(below, 1 - share_good)))]))  # the quantile at the share of bad documents, never above the cut
    return q


def train(docs: DataFrame, labels: DataFrame, training: Column) -> Quality:
    """A model from all training rows of ``labels``; without two labels every score is their share."""
    return fit_pairs(*labelled_features(docs, labels, training))


def score_quality(docs: DataFrame, q: Quality, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (0 to 1) and rejected (score below the quantile threshold) of every whole text.

    Null texts score as empty ones; equal texts score alike, repeated rows are
    scored each; an empty table gives no rows.  Very long texts are read whole.
    No shuffle.
    """
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(q)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in slices(batches, "text_", SLICE):
            s = q.score(features(*buffers(b.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array(s < q.threshold)], [*keep, "score", "rejected"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, rejected boolean"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text_")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, q: Quality) -> DataFrame:
    """The documents whose score reaches the quantile threshold, with all their columns.

    Null texts count as empty ones; repeated rows are kept or dropped alike; very
    long texts are read whole; an empty table stays empty.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(q), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            yield b.filter(pa.array(sent.value.score(features(*buffers(b.column(at)))) >= sent.value.threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_bradley_terry_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    q = train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    out = score_quality(docs, q)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (~F.col("rejected")).alias("above_quantile"))
