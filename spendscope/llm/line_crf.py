"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import BLANK, segment_sums, slices, word_hashes

SAMPLE_DOCS = 3000  # labelled documents that the field is fitted on at most
SAMPLE_LINES = 40  # lines of each that fitting looks at, from a place that its digest names
STEPS = 150
THRESHOLD = 0.3

OWN = ("long", "word", "symbol", "pipe", "shout", "upper", "digit", "final", "comma", "again")
NEAR = ("symbol", "pipe", "shout", "upper", "again")
WIDTH = len(OWN) + 2 * len(NEAR) + 2 + 1


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_SYMBOL, _PIPE, _SHOUT = _class(b"#*$%&<>"), _class(b"|"), _class(b"!?")
_UPPER, _DIGIT, _COMMA = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b",;:")
_END = _class(b".!?:;\"')")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word (rows), their numbers of words, and where each text's lines begin and end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    seen = np.concatenate([[0], np.cumsum(first)])
    size = seen[ends] - seen[starts]
    spoken = size > 0
    starts, ends, size = starts[spoken], ends[spoken], size[spoken]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    if not len(size):
        return np.zeros((0, WIDTH)), size, bounds

    def count(table: np.ndarray) -> np.ndarray:
        return segment_sums(table[data], starts, ends)

    hashes, _ = word_hashes([data.tobytes()])
    repeats = np.zeros(len(hashes), dtype=bool)
    repeats[1:] = hashes[1:] == hashes[:-1]
    letters = segment_sums(solid, starts, ends)
    last = np.maximum.accumulate(np.where(solid, np.arange(len(data)), -1))[ends]
    own = {
        "long": np.minimum(np.log1p(size), 6) / 3,
        "word": np.minimum(letters / size, 20) / 10,
        "symbol": np.minimum(count(_SYMBOL) / size, 3),
        "pipe": np.minimum(count(_PIPE) / size, 1),
        "shout": np.minimum(count(_SHOUT) / size, 2),
        "upper": count(_UPPER) / letters,
        "digit": count(_DIGIT) / letters,
        "final": _END[data[last]].astype(float),
        "comma": np.minimum(count(_COMMA) / size, 1),
        "again": segment_sums(repeats, seen[starts], seen[ends]) / size,
    }
    opening = np.zeros(len(size), dtype=bool)
    opening[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    closing = np.roll(opening, -1)
    columns = [own[name] for name in OWN]
    for name in NEAR:
        columns.append(np.where(opening, 0, np.roll(own[name], 1)))
        columns.append(np.where(closing, 0, np.roll(own[name], -1)))
    columns += [opening, closing, np.ones(len(size))]
    return np.column_stack(columns).astype(float), size, bounds


def _padded(features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(bounds)
    width = int(count.max(initial=0))
    at = bounds[:-1, None] + np.arange(width)
    there = np.arange(width) < count[:, None]
    return np.where(there, at, 0), there


def marginals(emission: np.ndarray, there: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for chains of equal padding: probability of a good line and of each pair of states.

    ``emission`` is what a good line has over a bad one, ``change`` the 2 x 2 weights between neighbours.
    """
    rows, width = emission.shape
    weight = np.exp(change - change.max())
    push = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=2)
    push /= push.sum(axis=2, keepdims=True)
    ahead, back = np.empty((rows, width, 2)), np.ones((rows, width, 2))
    now = push[:, 0]
    for t in range(width):
        step = now if t == 0 else (now @ weight) * push[:, t]
        step = step / step.sum(axis=1, keepdims=True)
        now = np.where(there[:, t, None], step, now)
        ahead[:, t] = now
    for t in range(width - 2, -1, -1):
        step = (back[:, t + 1] * push[:, t + 1]) @ weight.T
        step /= step.sum(axis=1, keepdims=True)
        back[:, t] = np.where(there[:, t + 1, None], step, 1.0)
    both = ahead * back
    good = both[:, :, 1] / both.sum(axis=2)
    pairs = ahead[:, :-1, :, None] * weight * (push * back)[:, 1:, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return good, pairs


@dataclass(frozen=True)
class LineField:
    """Weights of the field and of the curve from the share of good text to the probability of label 1."""

    weights: np.ndarray
    change: np.ndarray
    slope: float
    offset: float
    prior: float  # for texts without words

    def shares(self, features: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities to be good, by text; nan without words."""
        found = np.full(len(bounds) - 1, np.nan)
        count = np.diff(bounds)
        emission = features @ self.weights
        order = np.argsort(count, kind="stable")
        order = order[count[order] > 0]
        at = 0
        while at < len(order):  # chains of like length together
            width = int(count[order[at]])
            limit = max(width + 8, width * 5 // 4)
            end = at + int(np.searchsorted(count[order[at:]], limit, side="right"))
            some = order[at:end]
            place = bounds[some, None] + np.arange(int(count[some].max()))
            there = np.arange(place.shape[1]) < count[some, None]
            place = np.where(there, place, 0)
            good, _ = marginals(emission[place], there, self.change)
            length = size[place] * there
            found[some] = (good * length).sum(axis=1) / length.sum(axis=1)
            at = end
        return found

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found = np.empty(len(texts))
        for start, end in slices(texts):
            found[start:end] = self.shares(*line_features(texts[start:end]))
        curve = 1 / (1 + np.exp(-(self.slope * np.nan_to_num(found) + self.offset)))
        return np.where(np.isnan(found), self.prior, curve)


def _ascend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam: ``steps`` steps up ``gradient`` from ``start``."""
    value, mean, square = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(value)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        value += rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return value


def fit_field(features: np.ndarray, size: np.ndarray, bounds: np.ndarray, good: np.ndarray, steps: int = STEPS) -> LineField:
    """Maximum likelihood of the chains whose lines all carry their document's label, then the curve.

    With one label only, or without any text, every score is the share of label 1 (0.5 without labels).
    """
    prior = float(good.mean()) if len(good) else 0.5
    if not len(size) or prior in (0.0, 1.0):
        return LineField(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    place, there = _padded(features, bounds)
    label = np.repeat(good[:, None], place.shape[1], axis=1).astype(float)
    paired = there[:, 1:]
    seen = np.array([[(~good[:, None] & paired).sum(), 0.0], [0.0, (good[:, None] & paired).sum()]])
    chains = len(good)

    def gradient(value: np.ndarray) -> np.ndarray:
        weights, change = value[:WIDTH], value[WIDTH:].reshape(2, 2)
        found, pairs = marginals((features @ weights)[place], there, change)
        error = ((label - found) * there).ravel()
        line = np.bincount(place.ravel(), weights=error, minlength=len(features))
        moved = seen - (pairs * paired[:, :, None, None]).sum(axis=(0, 1))
        return np.concatenate([features.T @ line, moved.ravel()]) / chains - 1e-3 * value

    value = _ascend(gradient, np.zeros(WIDTH + 4), steps, 0.1)
    field = LineField(value[:WIDTH], value[WIDTH:].reshape(2, 2), 1.0, 0.0, prior)
    share = field.shares(features, size, bounds)
    known = ~np.isnan(share)
    share, truth = share[known], good[known].astype(float)

    def curve(value: np.ndarray) -> np.ndarray:
        error = truth - 1 / (1 + np.exp(-(value[0] * share + value[1])))
        return np.array([(error * share).mean(), error.mean()]) - 1e-4 * value

    slope, offset = _ascend(curve, np.array([6.0, -3.0]), 400, 0.1)
    return LineField(field.weights, field.change, float(slope), float(offset), prior)


def learnable(doc_id: Column) -> Column:
    """Whether the label of a document may be learnt from: its id's checksum is no multiple of five."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> LineField:
    """Fit on at most ``sample_docs`` labelled documents, those with the smallest digests of their ids.

    Only rows of ``learnable`` ids are used. Null labels are left out; a document that is labelled twice
    takes its highest label, and of several texts under one id the one with the smallest digest is learnt from. The texts stay in the tasks: each sends the features of at most
    ``sample_lines`` neighbouring lines per document. Labels, languages, sources and ids are no features.
    """
    marked = labels.where(F.col("quality").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64(F.lit("line field"), F.col("doc_id"))
    chosen = marked.withColumn("_order", order).orderBy("_order", "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts = texts.groupBy("doc_id", "_order", "quality").agg(one)

    def run(batches):
        for batch in batches:
            coded = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for start, end in slices(coded):
                features, size, bounds = line_features(coded[start:end])
                rows = []
                for k in range(end - start):
                    low, high = bounds[k], bounds[k + 1]
                    if high - low > sample_lines:
                        low += (int(batch["_order"].iloc[start + k]) & 0x7FFFFFFF) % (high - low - sample_lines + 1)
                        high = low + sample_lines
                    rows.append((batch["_order"].iloc[start + k], batch["quality"].iloc[start + k],
                                 features[low:high].astype(np.float32).tobytes(), size[low:high].tobytes()))
                yield pd.DataFrame(rows, columns=["_order", "quality", "features", "size"])

    sent = texts.mapInPandas(run, "_order bigint, quality int, features binary, size binary")
    rows = sorted((tuple(r) for r in sent.collect()), key=lambda r: (r[0], bytes(r[2])))
    features = [np.frombuffer(r[2], dtype=np.float32).reshape(-1, WIDTH).astype(float) for r in rows]
    sizes = [np.frombuffer(r[3], dtype=np.int64) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
    good = np.array([r[1] == 1 for r in rows], dtype=bool)
    stacked = np.concatenate(features) if features else np.zeros((0, WIDTH))
    return fit_field(stacked, np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64), bounds, good)


def quality_score(field: LineField, text: Column) -> Column:
    """Score between 0 and 1 of a whole text; null and texts without words get the share of label 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(field.scores([t.encode("utf-8", "surrogatepass") for t in texts]))

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``. A null id is not held out."""
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_score(field, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns kept."""
    return docs.where(quality_score(field, F.col("text")) >= threshold)
