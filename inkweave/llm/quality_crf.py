"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are binned counts of its own and of its neighbours;
labels of neighbouring lines are tied by transition weights. The field is trained on the driver
from the features of a bounded sample of labelled documents, whose lines at first have their
document's label; lines of bad documents that the field takes for good ones are then relabelled.
Scoring runs forward and backward over each whole document; marginals weighted by line length
are brought to a probability by a logistic fit on the same sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import whole_text
from inkweave.session import read_table

#: Labelled documents of each label that are trained on, at most; those with the least hashes of their ids.
SAMPLE = 2000
#: Lines of the sample documents of each label at most: a document whose lines don't fit any more isn't trained on.
LINES = 150_000
#: Training: rounds of relabelling, steps of each, step size, weight of the squared parameters.
ROUNDS, STEPS, RATE, PENALTY = 3, 120, 0.15, 1e-3
#: A document is predicted good from this score on.
GOOD_FROM = 0.3
#: Rows scored together.
ROWS = 512
#: Bins of a feature; the last one stands for a neighbour beyond either end.
BINS = 8
EDGES = (
    (1, 8, 24, 60, 140, 400), (1, 2, 4, 8, 20, 60), (0.25, 0.45, 0.6, 0.75, 0.9, 0.999), (1e-9, 0.01, 0.03, 0.08, 0.2, 0.4), (1e-9, 0.01, 0.03, 0.1, 0.25, 0.5), (1e-9, 0.02, 0.05, 0.15, 0.4, 0.8),
    (1e-9, 0.004, 0.01, 0.03, 0.06, 0.12), (1e-9, 0.03, 0.08, 0.15, 0.3, 0.6), (2, 3, 4.5, 6, 8, 12), (1e-9, 0.03, 0.08, 0.15, 0.3, 0.5), (0.5,), (1.5, 2.5, 4.5, 9.5), (0.5, 1.5), (1.5, 2.5, 5.5, 12.5, 40.5),
    (0.05, 0.15, 0.3, 0.5, 0.7, 0.9), (1e-9, 0.02, 0.05, 0.1, 0.2, 0.4),
)
KINDS = len(EDGES)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"#*$%&<>@^~_=+\\{}[]|", b"0123456789", bytes(range(65, 91)), b"!?", b".,;:", b" \t\r\v\f", b"|"), 1):
        out[list(chars)] = k
    return out


CLASS = _classes()
LETTER = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
ENDING = re.compile(rb"[.!?:;\"')\]\x80-\xff]\s*$")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line, length of each line, lines of each text) of UTF-8 texts.

    Lines are what newlines part; an empty text is one empty line.
    """
    lines = [t.split(b"\n") for t in texts]
    count = np.array([len(x) for x in lines], np.int64)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    kinds = CLASS[buffer]
    kinds[ends] = 0

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64)

    pipes = total(kinds == 7)
    symbols, numbers, capitals, loud, stops, blanks = (total(kinds == k) for k in range(1, 7))
    letters = total(LETTER[buffer])
    words, distinct, alike, twice, ending, first = (np.zeros(len(ends)) for _ in range(6))
    at = 0
    for doc in lines:
        seen: dict[bytes, int] = {}
        for line in doc:
            seen[line] = seen.get(line, 0) + 1
        for line in doc:
            ws = line.split()
            if ws:
                words[at], distinct[at] = len(ws), len(set(ws))
                alike[at] = sum(map(bytes.__eq__, ws, ws[1:]))
                twice[at], ending[at] = seen[line], ENDING.search(line) is not None
                c = ws[0][0]
                first[at] = 2 if 65 <= c <= 90 or c == 0xC3 else 1 if 97 <= c <= 122 else 0
            at += 1
    n, w, a = np.maximum(size, 1), np.maximum(words, 1), np.maximum(letters, 1)
    values = (
        size, words, np.where(words > 0, distinct / w, 1.0), (symbols + pipes) / n, numbers / n, capitals / a, loud / n, stops / w, (n - blanks) / w, pipes / w, ending, twice, first,
        np.repeat(count, count).astype(float), letters / n, alike / w,
    )
    bins = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(EDGES, values, strict=True)], axis=1).astype(np.uint8)
    return bins, size, count


def places(bins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each line the parameters of its own features and of those of the lines before and after it."""
    ends = np.cumsum(count)
    starts = ends - count
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    before[starts[count > 0]] = BINS - 1
    after[ends[count > 0] - 1] = BINS - 1
    at = np.arange(3 * KINDS) * BINS
    return np.concatenate([bins, before, after], axis=1).astype(np.int32) + at.astype(np.int32)


@dataclass
class Field:
    """weights: what each feature's bin adds to bad; turns[a, b]: from a to b, with 1 for bad; slope and offset of the logistic fit."""

    weights: np.ndarray
    turns: np.ndarray
    slope: float = 0.0
    offset: float = 0.0


class Chains:
    """Lines of several texts, dealt out by their number within them: one step handles all texts that are so long."""

    def __init__(self, count: np.ndarray):
        order = np.argsort(-count, kind="stable")
        starts = (np.cumsum(count) - count)[order]
        longest = int(count.max(initial=0))
        active = np.searchsorted(-count[order], -np.arange(longest), side="left")
        self.steps = [starts[:m] + t for t, m in enumerate(active.tolist())]

    def marginals(self, bad: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability that a line is bad, expected turns over all texts) by forward and backward passes."""
        n = len(bad)
        score = np.stack([np.zeros(n), bad], axis=1)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        step = np.exp(turns - turns.max())
        forward, backward = np.empty((n, 2)), np.ones((n, 2))
        for t, here in enumerate(self.steps):
            f = score[here] if t == 0 else score[here] * (forward[self.steps[t - 1][: len(here)]] @ step)
            forward[here] = f / f.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            here = self.steps[t]
            prior = self.steps[t - 1][: len(here)]
            ahead = score[here] * backward[here]
            b = ahead @ step.T
            both = forward[prior][:, :, None] * step * ahead[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward[prior] = b / b.sum(axis=1, keepdims=True)
        p = forward * backward
        return p[:, 1] / p.sum(axis=1), expected


def good_share(bad: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability of good lines in each text, weighted by length; by number where all are empty."""
    starts = np.cumsum(count) - count
    weight = np.add.reduceat(size, starts)
    even = np.repeat(weight == 0, count)
    w = np.where(even, 1.0, size)
    return np.add.reduceat((1 - bad) * w, starts) / np.add.reduceat(w, starts)


def train(bins: np.ndarray, size: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Field:
    """The field of labelled texts; weight says how many texts of the corpus each stands for.

    Without texts of both labels every weight is zero, and the score of every text one half.
    """
    field = Field(np.zeros(3 * KINDS * BINS), np.zeros((2, 2)))
    if len(set(label.tolist())) < 2:
        return field
    at, chains = places(bins, count), Chains(count)
    starts = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    inner = np.ones(len(doc), bool)
    inner[starts] = False
    bad_doc = np.repeat(label == 0, count)
    bad = bad_doc.astype(float)
    for _ in range(ROUNDS):
        observed = np.zeros((2, 2))
        now, was = bad[inner].astype(int), bad[np.flatnonzero(inner) - 1].astype(int)
        np.add.at(observed, (was, now), 1)
        moment = [np.zeros_like(field.weights), np.zeros_like(field.turns)]
        square = [np.zeros_like(field.weights), np.zeros_like(field.turns)]
        for k in range(1, STEPS + 1):
            p, expected = chains.marginals(field.weights[at].sum(axis=1), field.turns)
            grown = np.bincount(at.ravel(), np.repeat(bad - p, at.shape[1]), minlength=len(field.weights))
            for j, (x, g) in enumerate(((field.weights, grown), (field.turns, observed - expected))):
                g = g / len(doc) - PENALTY * x
                moment[j] = 0.9 * moment[j] + 0.1 * g
                square[j] = 0.99 * square[j] + 0.01 * g * g
                x += RATE * (moment[j] / (1 - 0.9**k)) / (np.sqrt(square[j] / (1 - 0.99**k)) + 1e-8)
        p, _ = chains.marginals(field.weights[at].sum(axis=1), field.turns)
        worst = np.maximum.reduceat(p, starts)
        bad = (bad_doc & ((p >= 0.5) | (p == np.repeat(worst, count)))).astype(float)
    share = good_share(p, size, count)
    a, b, y = 0.0, 0.0, label.astype(float)
    for _ in range(50):  # Newton steps with a light penalty
        q = 1 / (1 + np.exp(-(a * share + b)))
        r, v = weight * (y - q), weight * q * (1 - q)
        ga, gb = (r * share).sum() - 0.01 * a, r.sum() - 0.01 * b
        haa, hab, hbb = (v * share**2).sum() + 0.01, (v * share).sum(), v.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a + scale * da, b + scale * db
    field.slope, field.offset = float(max(a, 0.0)), float(b)
    return field


def scores(field: Field, texts: list[bytes]) -> np.ndarray:
    """The score of each UTF-8 text, an empty one as one empty line."""
    if not texts:
        return np.zeros(0)
    bins, size, count = line_features(texts)
    p, _ = Chains(count).marginals(field.weights[places(bins, count)].sum(axis=1), field.turns)
    return 1 / (1 + np.exp(-(field.slope * good_share(p, size, count) + field.offset)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [line_features([t]) for t in b.column("text").cast(pa.binary()).to_pylist()]
        columns = [b.column("label"), pa.array([x[0].tobytes() for x in out], pa.binary()), pa.array([x[1].tobytes() for x in out], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["label", "bins", "size"])


def fitting(counts: list, most: int | None = None) -> list[tuple]:
    """(id, label) of the sample documents (id, label, lines, h) whose lines fit, by h."""
    most, kept, used = most or LINES, {}, {}
    for r in sorted(counts, key=lambda r: (r["h"], str(r["id"]))):
        if r["id"] not in kept and used.get(r["label"], 0) + r["lines"] <= most:
            used[r["label"]] = used.get(r["label"], 0) + r["lines"]
            kept[r["id"]] = r["label"]
    return list(kept.items())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field:
    """The field of a bounded sample of labelled documents that aren't held out.

    A document that is labelled more than once counts once, with the larger half of its
    labels, good on ties. Only binned features reach the driver, of sample documents and LINES
    lines at most for each label. Documents are taken in the order of a hash of their ids; one
    whose lines don't fit is left out of the training. Null texts are one empty line.
    """
    one = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull() & ~held_out(labels[id_col]))
    one = one.groupBy(labels[id_col].alias("id")).agg((F.avg(labels[label_col]) >= 0.5).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = one.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text"))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines")
    counts = texts.join(F.broadcast(chosen), "id").select("id", "label", lines).groupBy("id", "label").agg(F.sum("lines").alias("lines"), F.first(F.xxhash64("id")).alias("h")).collect()  # a row for each sample document
    chosen = docs.sparkSession.createDataFrame(fitting(counts), texts.select("id", F.lit(0).alias("label")).schema)
    found = texts.join(F.broadcast(chosen), "id").select("label", "text").mapInArrow(_packed, "label int, bins binary, size binary").collect()
    if not found:
        return train(np.zeros((0, KINDS), np.uint8), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    found.sort(key=lambda r: (r["label"], bytes(r["bins"]), bytes(r["size"])))
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(-1, KINDS) for r in found])
    size = np.concatenate([np.frombuffer(r["size"], np.float64) for r in found])
    count = np.array([len(r["size"]) // 8 for r in found], np.int64)
    label = np.array([r["label"] for r in found])
    weight = np.array([totals[k] / (label == k).sum() for k in label])
    return train(bins, size, count, label, weight * len(label) / weight.sum())


def quality_scores(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs, from its whole text alone.

    Null counts as an empty text, which is one empty line; rows without an id and repeated rows
    stay as they are; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for at in range(0, len(texts), ROWS):
                out = scores(field, texts.slice(at, ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, ROWS), pa.array(out, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), whole_text(docs[text_col]).alias("text")).mapInArrow(run, f"id {kind}, score double")


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


QUERIES = {"op6_quality_crf": op6_quality_crf}
ORACLES: dict[str, str] = {}
