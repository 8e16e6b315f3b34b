"""Quality rules by weak supervision.

Each rule looks at a document and votes good, votes bad, or abstains.  No rule
is trusted: expectation-maximisation over the votes of all documents estimates
how often each rule gives each vote on good and on bad documents, and a document stays when the posterior
probability that it is good is at least ``keep_from``.

With R rules there are at most 3^R patterns of votes.  One pass measures the
documents; the driver gets the patterns' counts alone (at most ``3 ** len(RULES)``
rows, whatever the input) and fits.  ``judge`` writes its narrow rows before that
and looks their patterns up; ``filter_docs`` measures the texts once more rather
than write them.  No shuffle but that of the counts, no per-document state.

Defined cases: a null text counts as empty; an empty or wordless text fails the
base rules; each row is judged by its text alone, so ids may be null or repeat;
an empty table gives an empty result; other columns pass through ``filter_docs``
untouched and are ignored by ``judge``.  A text must fit in one task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._workspace import Workspace, bounded

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!")] = True
_NOT_INNER = (np.arange(256) & 0xC0) != 0x80
_END = np.zeros(256, bool)
_END[list(b'.!?:;"')] = True

#: (feature, bad from, good below): in between a rule abstains.
RULES = (
    ("symbols_per_word", 0.10, 0.02),
    ("upper_share", 0.30, 0.12),
    ("shouts_per_word", 0.10, 0.03),
    ("bare_symbol_words", 0.10, 0.01),
    ("dup_line_share", 0.30, 0.05),
    ("repeat_share", 0.30, 0.10),
    ("odd_word_length", 3.00, 2.00),
    ("unlettered_share", 0.35, 0.22),
)
#: What is expected of a rule beforehand: its rates of abstaining, bad and good votes on bad and on good
#: documents, counting as many votes of each class as ``BELIEF``, however many documents there are: it only
#: matters to tables of a few hundred rows.  A rule that votes at random is left with no more say than this.
EXPECTED, BELIEF = np.array([[0.10, 0.40, 0.50], [0.03, 0.02, 0.95]]), 100
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _seen_before(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (document, hash): whether it occurs again, and whether it is not the first."""
    order = np.lexsort((h, doc))  # stable: the first of equals comes first
    d, x = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    again, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, later


def measure(text: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that rules are made of, for each document of a run of bytes."""
    starts, ends = B.words(text, bounds)
    cuts = np.searchsorted(starts, bounds)
    n_words = np.diff(cuts)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    solid = ~B.SPACE[text] & _NOT_INNER[text]
    per_byte = lambda mask: _per(mask, bounds)
    out = {"n_words": n_words, "word_chars": per_byte(solid), "n_symbols": per_byte(SYMBOLS[text]), "upper": per_byte(_UPPER[text]), "letters": per_byte(_LETTER[text]), "shouts": per_byte(_SHOUT[text])}

    prefix = B.prefix_hash(text, False)
    # words inside 3-word windows that occur again
    n = len(starts) - 2
    inside = np.zeros(len(starts) + 1, np.int64)
    if n > 0:
        w = B.span_hash(prefix, starts, ends)
        mul = np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(doc[:n] == doc[2:])
        again, _ = _seen_before(doc[at], B.mix((w[at] * mul + w[at + 1]) * mul + w[at + 2]))
        hit = at[again]
        inside[hit] += 1
        np.add.at(inside, hit + 3, -1)
    out["n_repeat_words"] = _per(np.cumsum(inside[:-1]) > 0, cuts)
    # words without a letter or digit
    plain = np.concatenate([[0], np.cumsum(SYMBOLS[text], dtype=np.int64)])
    out["bare"] = _per(plain[ends] - plain[starts] == ends - starts, cuts)

    # lines: they end at a newline or at the document's end
    breaks = np.flatnonzero(text == 10)
    begin = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], breaks + 1]))
    begin = begin[begin < len(text)]
    owner = B.owners(begin, bounds) if len(begin) else begin
    stop = np.minimum(np.append(begin[1:], len(text)), bounds[owner + 1]) if len(begin) else begin
    stop = np.where((stop > begin) & (text[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(begin) else begin
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, owner = begin[worded], stop[worded], owner[worded]
    line_cuts = np.searchsorted(owner, np.arange(len(n_words) + 1))
    out["lines"] = np.diff(line_cuts)
    if len(begin):
        _, later = _seen_before(owner, B.span_hash(prefix, begin, stop))
        out["n_dup_lines"] = _per(later, line_cuts)
    else:
        out["n_dup_lines"] = np.zeros(len(n_words), np.int64)
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Each document's pattern of votes: one base-3 digit a rule, 0 abstains, 1 bad, 2 good."""
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    value = {
        "symbols_per_word": m["n_symbols"] / words,
        "upper_share": m["upper"] / np.maximum(m["letters"], 1),
        "shouts_per_word": m["shouts"] / words,
        "bare_symbol_words": m["bare"] / words,
        "dup_line_share": m["n_dup_lines"] / np.maximum(m["lines"], 1),
        "repeat_share": m["n_repeat_words"] / words,
        "odd_word_length": np.abs(m["word_chars"] / words - 5.5),
        "unlettered_share": 1 - np.minimum(m["letters"] / chars, 1),
    }
    code = np.zeros(len(words), np.int64)
    for name, bad, good in RULES:
        x = value[name]
        code = code * 3 + np.where(x >= bad, 1, np.where(x < good, 2, 0))
    return np.where(m["n_words"] > 0, code, 0)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def fit(patterns: dict[int, int], steps: int = 200) -> np.ndarray:
    """Posterior probability of good for each of the 3^R patterns, by EM over pattern counts.

    Starts from fewer bad votes being better, which says which of the two classes is the good one.
    """
    r = len(RULES)
    code = np.arange(3**r)
    digit = np.stack([code // 3 ** (r - 1 - i) % 3 for i in range(r)])
    count = np.zeros(3**r)
    for k, v in patterns.items():
        count[k] = v
    good = 0.9 / 3.0 ** (digit == 1).sum(0)
    total = max(count.sum(), 1.0)
    for _ in range(steps):
        weight = np.stack([count * (1 - good), count * good])
        prior = (weight.sum(1) + 1) / (total + 2)
        log = np.log(prior)[:, None] + np.zeros((2, len(code)))
        for i in range(r):
            odds = np.stack([weight[:, digit[i] == v].sum(1) for v in range(3)], 1) + BELIEF * EXPECTED
            odds /= odds.sum(1, keepdims=True)
            log += np.log(odds)[:, digit[i]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return good


def _runs(column: pa.Array):
    data, offsets = B.buffers(column)
    for a, b in B.slices(offsets):
        yield measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _patterns(batches):
    seen: dict[int, int] = {}
    for batch in batches:
        for m in _runs(batch.column("text")):
            for k, v in zip(*np.unique(votes(m), return_counts=True), strict=True):
                seen[int(k)] = seen.get(int(k), 0) + int(v)
    yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "docs"])


def posterior(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Fits the rules' accuracies over all of ``docs``."""
    bounded(docs.sparkSession)
    found = docs.select(docs[text_col].alias("text")).mapInArrow(_patterns, "code long, docs long")
    return fit({r["code"]: r["docs"] for r in found.groupBy("code").agg(F.sum("docs").alias("docs")).collect()})


def _measured(batches):
    for batch in batches:
        a = 0
        for m in _runs(batch.column("text")):
            n = len(m["n_words"])
            stats = [pa.array(m[c].astype(np.int64)) for c in STATS]
            yield pa.record_batch([batch.column("id").slice(a, n), *stats, pa.array(base_failed(m)), pa.array(votes(m))], names=["id", *STATS, "base_failed", "code"])
            a += n


def judge(docs: DataFrame, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts of ``STATS``, ``base_failed``, ``kept`` and ``p_good`` for every row."""
    spark = docs.sparkSession
    with Workspace(spark, "quality") as ws:
        source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        schema = f"id {dict(source.dtypes)['id']}, {', '.join(f'{c} long' for c in STATS)}, base_failed boolean, code long"
        rows = ws.table(source.mapInArrow(_measured, schema), "measured")
        seen = {r["code"]: r["docs"] for r in rows.groupBy("code").agg(F.count("*").alias("docs")).collect()}
        good = fit(seen)
        known = spark.createDataFrame([(k, float(good[k])) for k in seen], "code long, p_good double")  # 3^R rows at most
        out = rows.join(F.broadcast(known), "code", "left")
        kept = ~F.col("base_failed") & (F.col("p_good") >= keep_from)
        return ws.finish(out.select(F.col("id").alias(id_col), *STATS, "base_failed", kept.alias("kept"), "p_good"))


def filter_docs(docs: DataFrame, keep_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rules or the posterior reject."""
    good = posterior(docs, text_col)

    def run(batches):
        for batch in batches:
            keep = [~base_failed(m) & (good[votes(m)] >= keep_from) for m in _runs(batch.column(text_col))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
