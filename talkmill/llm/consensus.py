"""Consensus of several annotators: feature-assisted expectation-maximisation.

The model: an item's true label comes from a regularised softmax classifier over features of the item (words of its text and
its field); an annotator answers by their own confusion matrix. Both are fitted together: the E-step gives each item's label
distribution from the classifier's output (as prior) and the answers; the M-step counts the confusion matrices over *all*
items, in one distributed pass per round that returns annotators x labels x labels sums, and goes on training the classifier
on at most CLASSIFIER_ITEMS items (those with the smallest hashes), which is what bounds the driver.

Defined results: labels are compared by their letters; anything outside the vocabulary, null and blank is unusable; of one
annotator the latest usable judgement of an item counts, the larger annotation_id among equal times; null item or annotator
ids are left out; an exact tie goes to the label that comes first in LABELS; extra columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.common import lookup_rows, table, written
from talkmill.functions.values import value_key

LABELS = ("NO-OP", "VALUE", "ABSTAIN:insufficient", "ABSTAIN:ambiguous", "ABSTAIN:conflicting", "HEDGED")
CLASSIFIER_ITEMS, DIM = 8_000, 1 << 10
ROUNDS, STEPS, RATE, L2, SETTLED = 30, 10, 0.3, 2e-3, 1e-4
DIAGONAL, OFF = 2.0, 0.5  # what a confusion row holds before any answer
MIN_ANNOTATORS = 3


def letters(label: str) -> str:
    return "".join(ch for ch in label.lower() if ch.isalpha())


def label_code(c: Column) -> Column:
    """Place in LABELS of a label as written, null if unusable."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    out = F.lit(None).cast("int")
    for k, name in enumerate(LABELS):
        out = F.when(plain == letters(name), F.lit(k)).otherwise(out)
    return out


def features(text: str | None, field: str | None) -> list[int]:
    words = {re.sub(r"\d+", "0", w) for w in re.findall(r"\w+", (text or "").lower())}
    return sorted({zlib.crc32(f"f:{field}".encode()) % DIM, *(zlib.crc32(w.encode()) % DIM for w in words)})


def _features(text: pa.Array, field: pa.Array) -> pa.Array:
    return pa.array([features(t, f) for t, f in zip(text.to_pylist(), field.to_pylist())], pa.list_(pa.int32()))


_features.__annotations__ = {"text": pa.Array, "field": pa.Array, "return": pa.Array}


def latest(annotations: DataFrame) -> DataFrame:
    """One usable judgement of each (item, annotator): code, value, and the item's text and field."""
    rows = annotations.select("item_id", "annotator_id", label_code(F.col("label")).alias("code"), "value", "turn_text", "field_name", "labelled_at", "annotation_id")
    rows = rows.filter("item_id is not null and annotator_id is not null and code is not null")
    what = F.struct("code", "value", "turn_text", "field_name")
    last = rows.groupBy("item_id", "annotator_id").agg(F.max_by(what, F.struct(F.coalesce("labelled_at", F.lit("0001-01-01").cast("timestamp_ntz")), "annotation_id")).alias("x"))
    return last.select("item_id", "annotator_id", "x.*")


def packed(annotations: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per item: who answered what, and the item's features; and the annotators. Few annotators answer an item."""
    rows = written(latest(annotations))
    who = sorted(r[0] for r in lookup_rows(rows.select("annotator_id").distinct()))
    places = annotations.sparkSession.createDataFrame([(a, k) for k, a in enumerate(who)], "annotator_id string, ann int")
    rows = rows.join(F.broadcast(places), "annotator_id")  # no more than lookup_rows allows
    items = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ann", "code", "value"))).alias("answers"), F.max("turn_text").alias("t"), F.max("field_name").alias("f"))
    items = items.withColumn("features", F.arrow_udf(_features, "array<int>")(F.col("t"), F.col("f")))
    return written(items.select("item_id", F.col("answers.ann").alias("ann"), F.col("answers.code").alias("code"), F.col("answers.value").alias("value"), "features")), who


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element, and the elements."""
    offsets = np.asarray(a.offsets)
    return np.repeat(np.arange(len(a)), np.diff(offsets)), np.asarray(a.flatten())


def log_prior(n: int, frow: np.ndarray, feat: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log of the classifier's output. Features are scaled so that each item's have length one."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(frow, minlength=n), 1))
    logits = np.stack([np.bincount(frow, weights=w[feat, k], minlength=n) for k in range(w.shape[1])], axis=1) * scale[:, None] + w[-1]
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


def posterior(n: int, arow: np.ndarray, ann: np.ndarray, code: np.ndarray, prior: np.ndarray, log_conf: np.ndarray) -> np.ndarray:
    score = prior.copy()
    for k in range(score.shape[1]):
        score[:, k] += np.bincount(arow, weights=log_conf[ann, k, code], minlength=n)
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def counted(arow: np.ndarray, ann: np.ndarray, code: np.ndarray, post: np.ndarray, a: int) -> np.ndarray:
    """Annotators x true labels x given labels: expected numbers."""
    size = post.shape[1]
    out = np.zeros((a, size, size))
    for k in range(size):
        out[:, k, :] = np.bincount(ann * size + code, weights=post[arow, k], minlength=a * size).reshape(a, size)
    return out


def confusion(counts: np.ndarray) -> np.ndarray:
    size = counts.shape[1]
    c = counts + OFF + np.eye(size) * DIAGONAL
    return c / c.sum(axis=2, keepdims=True)


class Classifier:
    """Softmax over hashed features, trained on soft labels by Adagrad; the last row of `w` is the bias."""

    def __init__(self, feature_lists: list[list[int]]):
        self.n = len(feature_lists)
        self.row = np.repeat(np.arange(self.n), [len(f) for f in feature_lists])
        self.feat = np.array([x for f in feature_lists for x in f], np.int64)
        self.w, self.g2 = np.zeros((DIM + 1, len(LABELS))), np.full((DIM + 1, len(LABELS)), 1e-8)
        self.scale = (1 / np.sqrt(np.maximum(np.bincount(self.row, minlength=self.n), 1)))[self.row] if self.n else np.zeros(0)

    def train(self, target: np.ndarray) -> None:
        for _ in range(STEPS if self.n else 0):
            err = (np.exp(log_prior(self.n, self.row, self.feat, self.w)) - target) / self.n
            g = np.vstack([np.stack([np.bincount(self.feat, weights=err[self.row, k] * self.scale, minlength=DIM) for k in range(len(LABELS))], axis=1) + L2 * self.w[:-1], err.sum(axis=0, keepdims=True)])
            self.g2 += g * g
            self.w -= RATE * g / np.sqrt(self.g2)


def fit(items: DataFrame, annotators: int, *, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Confusion matrices and classifier weights."""
    size = len(LABELS)
    held = items.select("ann", "code", "features").orderBy(F.xxhash64("item_id"), "item_id").limit(CLASSIFIER_ITEMS).collect()
    clf = Classifier([r.features for r in held])
    arow = np.repeat(np.arange(len(held)), [len(r.ann) for r in held])
    ann, code = np.array([x for r in held for x in r.ann], np.int64), np.array([x for r in held for x in r.code], np.int64)
    conf = confusion(np.zeros((annotators, size, size)))

    for _ in range(rounds):
        if len(held):
            clf.train(posterior(len(held), arow, ann, code, log_prior(len(held), clf.row, clf.feat, clf.w), np.log(conf)))
        w, log_conf = clf.w.astype(np.float32), np.log(conf)

        def pass_over(batches: Iterator[pa.RecordBatch], w=w, log_conf=log_conf) -> Iterator[pa.RecordBatch]:
            total = np.zeros((annotators, size, size))
            for b in batches:
                (ar, an), (_, co), (fr, fe) = (_lists(b.column(c)) for c in ("ann", "code", "features"))
                post = posterior(b.num_rows, ar, an, co, log_prior(b.num_rows, fr, fe, w), log_conf)
                total += counted(ar, an.astype(np.int64), co.astype(np.int64), post, annotators)
            flat = total.reshape(-1)
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some], pa.float64())], ["k", "v"])

        sums = np.zeros(annotators * size * size)
        for r in items.select("ann", "code", "features").mapInArrow(pass_over, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[r.k] = r.v
        new = confusion(sums.reshape(annotators, size, size))
        moved, conf = np.abs(new - conf).max() if annotators else 0, new
        if moved < SETTLED:
            break
    return conf, clf.w


def consensus(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: item_id, label, confidence, agreement, n_annotators, value), (annotators: annotator_id, reliability, n_items)."""
    items, who = packed(annotations)
    conf, w = fit(items, len(who))
    log_conf, w32 = np.log(conf), w.astype(np.float32)
    trust = conf[:, range(len(LABELS)), range(len(LABELS))].mean(axis=1) if who else np.zeros(0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ar, an), (_, co), (fr, fe) = (_lists(b.column(c)) for c in ("ann", "code", "features"))
            n = b.num_rows
            post = posterior(n, ar, an, co, log_prior(n, fr, fe, w32), log_conf)
            best = np.round(post, 12).argmax(axis=1)
            size = np.bincount(ar, minlength=n)
            same = np.zeros(n)
            for k in range(len(LABELS)):
                c = np.bincount(ar, weights=co == k, minlength=n)
                same += c * (c - 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                agreement = np.where(size > 1, same / (size * (size - 1)), np.nan)
            values = []
            for k, (anns, codes, vals) in enumerate(zip(b.column("ann").to_pylist(), b.column("code").to_pylist(), b.column("value").to_pylist())):
                votes: dict[str, list] = {}
                if LABELS[best[k]] == "VALUE":
                    for a, c, v in zip(anns, codes, vals):
                        if c == best[k] and v is not None and v.strip():
                            held = votes.setdefault(value_key(v), [0.0, {}])
                            held[0] += trust[a]
                            held[1][v.strip()] = held[1].get(v.strip(), 0) + trust[a]
                top = min(votes.items(), key=lambda x: (-x[1][0], x[0]))[1][1] if votes else None
                values.append(min(top.items(), key=lambda x: (-x[1], x[0]))[0] if top else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), pa.array([LABELS[k] for k in best]), pa.array(post[np.arange(n), best]), pa.array(agreement, pa.float64(), from_pandas=True), pa.array(size, pa.int32()), pa.array(values, pa.string())],
                ["item_id", "label", "confidence", "agreement", "n_annotators", "value"],
            )

    out = items.mapInArrow(decide, "item_id string, label string, confidence double, agreement double, n_annotators int, value string")
    answers = items.select(F.explode("ann").alias("k")).groupBy("k").agg(F.count("*").alias("n_items"))
    spark = annotations.sparkSession
    known = spark.createDataFrame([(k, a, float(t)) for k, (a, t) in enumerate(zip(who, trust))], "k int, annotator_id string, reliability double")
    return out, known.join(answers, "k", "left").select("annotator_id", "reliability", "n_items")


def p5_found(spark, sf_dir: str) -> DataFrame:
    items, _ = consensus(table(spark, sf_dir, "annotations"))
    return items.filter(F.col("n_annotators") >= MIN_ANNOTATORS).select("item_id", "label")


def p5_consensus(spark, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "annotations"))[0]


def p5_annotators(spark, sf_dir: str) -> DataFrame:
    return consensus(table(spark, sf_dir, "annotations"))[1]
