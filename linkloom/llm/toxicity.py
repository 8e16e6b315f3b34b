"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A feature is a word, a pair of neighbours, or a pair one word apart, hashed into
``2^SPACE_BITS``; a text has it or hasn't.  Words are runs of letters, digits and
non-ASCII bytes, A-Z lower-cased.  FTRL-proximal keeps a learning rate for each
coordinate and an L1 term that leaves most weights at zero, so the model is a
short sorted list of (feature, weight), which is broadcast.

Fitting sees at most ``MOST_LABELLED`` labelled rows: the least by md5 of doc_id
among the rows of each label, toxic and not (``MOST_TOXIC`` of the first).  Their
features are made where the rows are, the gradient steps run in one task.  All
weights are broadcast: a coordinate needs gradients of more than ``L1`` in all, of
at most one for each of its examples and epochs, so with six epochs each of them
stands for two occurrences or more in that sample.  Scoring is one pass over all texts, without a shuffle.

Defined cases: a null, empty or wordless text scores as the bias alone; rows are
scored one by one, so ids may be null or repeat (a null id counts as '' in
crc32); labels that are null are ignored, a document labelled twice counts as
toxic if either label is; without labelled rows every score is 0; an empty table
gives an empty result; other columns are ignored.  A text must fit in one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._workspace import bounded

SPACE_BITS = 40
MOST_LABELLED, MOST_TOXIC = 9_000, 4_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 8.0, 0.0, 6
_KIND = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True


def features(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of a run of documents, with repeats."""
    blank = text.copy()
    blank[~_SOLID[text]] = 32
    starts, ends = B.words(blank, bounds)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = B.span_hash(B.prefix_hash(text, True), starts, ends)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
    docs, found = [doc], [w]
    for gap in (1, 2):
        if len(w) > gap:
            same = np.flatnonzero(doc[:-gap] == doc[gap:])
            docs.append(doc[same])
            found.append(B.mix(w[same] * _KIND[gap - 1] + w[same + gap]))
    return np.concatenate(docs), np.concatenate(found) >> np.uint64(64 - SPACE_BITS)


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    data, offsets = B.buffers(column)
    for a, b in B.slices(offsets):
        doc, f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.argsort(doc, kind="stable")
        doc, f = doc[order], f[order]
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(f[cuts[i] : cuts[i + 1]])


def ftrl(examples: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted features, their weights, and the bias."""
    if not examples:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), -1000.0
    names, where = np.unique(np.concatenate([x for _, x in examples]), return_inverse=True)
    cuts = np.cumsum([0, *(len(x) for _, x in examples)])
    where = where.astype(np.int64)
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    l1 = np.full(len(names) + 1, L1)
    l1[-1] = 0.0  # the bias
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        for e in order.permutation(len(examples)):
            y, ix = examples[e][0], np.append(where[cuts[e] : cuts[e + 1]], len(names))
            zi, ni = z[ix], n[ix]
            w = np.where(np.abs(zi) > l1[ix], -(zi - np.sign(zi) * l1[ix]) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            z[ix] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[ix] = ni + g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    kept = np.flatnonzero(w[:-1])
    return names[kept], w[kept].astype(np.float32), float(w[-1])


def _featured(batches):
    for batch in batches:
        packed = [x.tobytes() for x in _rows(batch.column("text"))]
        yield pa.record_batch([batch.column("place"), batch.column("toxic"), pa.array(packed, pa.binary())], names=["place", "toxic", "features"])


def _train(batches):
    rows = []
    for batch in batches:
        rows += [(p, y, x) for p, y, x in zip(batch.column("place").to_pylist(), batch.column("toxic").to_pylist(), batch.column("features").to_pylist(), strict=True)]
    rows.sort()
    names, weights, bias = ftrl([(y, np.frombuffer(x, np.uint64)) for _, y, x in rows])
    yield pa.record_batch([pa.array([names.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["names", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on ``labels`` (already without the held-out rows)."""
    bounded(docs.sparkSession)
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    place = F.md5(F.col("id").cast("string"))
    known = known.withColumn("place", place)
    toxic = known.where("toxic = 1").orderBy("place").limit(MOST_TOXIC)
    clean = known.where("toxic = 0").orderBy("place").limit(MOST_LABELLED - MOST_TOXIC)
    sample = toxic.union(clean)  # MOST_LABELLED rows at most: broadcast
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), "id").select("place", "toxic", "text").dropDuplicates(["place"])
    found = found.mapInArrow(_featured, "place string, toxic int, features binary").repartition(1)
    row = found.mapInArrow(_train, "names binary, weights binary, bias double").first()
    if row is None:
        return ftrl([])
    return np.frombuffer(row["names"], np.uint64), np.frombuffer(row["weights"], np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    shared = bounded(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        names, weights, bias = shared.value
        first = np.zeros(1 << 20, bool)
        first[(names >> np.uint64(SPACE_BITS - 20)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = B.buffers(batch.column("text"))
            total = np.full(len(offsets) - 1, bias)
            for a, b in B.slices(offsets):
                doc, f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                near = np.flatnonzero(first[(f >> np.uint64(SPACE_BITS - 20)).astype(np.int64)])
                doc, f = doc[near], f[near]
                at = np.minimum(np.searchsorted(names, f), max(len(names) - 1, 0))
                hit = names[at] == f if len(names) else np.zeros(0, bool)
                if hit.any():
                    pairs = np.unique(np.stack([doc[hit], at[hit]]), axis=1)
                    total[a:b] += np.bincount(pairs[0], weights[pairs[1]], b - a)
            yield pa.record_batch([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=["id", "score"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def held_out(column):
    """Whether crc32 of the id's text is divisible by 5."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5 == 0
