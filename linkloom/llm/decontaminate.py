"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into windows of ``WINDOW`` normalised bytes, half
overlapping (a shorter item is its own window).  A document leaks an item when some
window matches a region of it with at most ``rate`` edits per byte.  An item of fewer
than ``SHORT`` normalised bytes must stand in the text as it is, as whole words.

Method
  1. Texts are normalised: A-Z lower-cased, every run of other ASCII than letters
     and digits one space.  All q-grams of all texts are looked up in the windows'.
  2. q-gram lemma: a region within ``e`` edits of a window of ``n`` bytes shares at
     least n - q + 1 - q * e q-grams with it, on diagonals that differ by at most
     ``e``.  Diagonals fall into bands 2e wide that begin every e, so each such
     region has all its hits in one band.  Bands with fewer hits are dropped.
  3. Retained bands are verified by banded alignment, all at once: the window
     against the text along the band's diagonals and ``e`` more on either side.

Documents are read once per block of ``BLOCK_BYTES`` of benchmark text, which is the
most that is broadcast at a time; nothing is shuffled.  A document's hits are found
in its own task.

Defined cases: null or empty texts and items, and items without a letter or digit,
have no match; items that repeat an
id, or have none, are matched each; rows are judged one by one, so doc_ids may be
null or repeat; an empty benchmark finds nothing, an empty table gives an empty
result; other columns pass through ``filter_docs`` and are ignored by ``leaks``.
A text must fit in one task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._workspace import bounded

Q, WINDOW, SHORT, RATE = 8, 100, 32, 0.10
BLOCK_BYTES = 2 << 20
_BITS = 22
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_PLAIN = np.where(_SOLID, B.LOWER, np.uint8(32)).astype(np.uint8)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their documents' bounds, and each one's place in ``text``."""
    solid = _SOLID[text]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[bounds[:-1][bounds[:-1] < len(text)]] = solid[bounds[:-1][bounds[:-1] < len(text)]]
    place = np.flatnonzero(keep)
    return _PLAIN[text[place]], np.searchsorted(place, bounds), place


def grams(text: np.ndarray) -> np.ndarray:
    """Each position's next Q = 8 bytes as one number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(text)
    return np.ndarray((len(raw) - Q + 1,), "<u8", raw.data, strides=(1,)).astype(np.uint64)


def budget(n: int, rate: float) -> int:
    """Edits allowed in a window of n bytes: at most so many that the lemma still asks for a hit."""
    return min(int(rate * n), (n - Q) // Q)


class Windows:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.item_ids = [i for i, _ in items]
        self.item, self.bytes, exact = [], [], []
        words: dict[int, dict[int, list[int]]] = {}  # items of fewer bytes than a gram: length, bytes, windows
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            norm, _, _ = normalise(raw, np.array([0, len(raw)])) if len(raw) else (raw, None, None)
            if len(norm) and norm[-1] == 32:
                norm = norm[:-1]
            if len(norm) and norm[0] == 32:
                norm = norm[1:]
            if not len(norm):
                continue
            if len(norm) < Q:
                words.setdefault(len(norm), {}).setdefault(int.from_bytes(norm.tobytes(), "little"), []).append(len(self.bytes))
            starts = sorted({*range(0, max(len(norm) - WINDOW, 0) + 1, WINDOW // 2), max(len(norm) - WINDOW, 0)})
            for s in starts:
                self.item.append(k)
                self.bytes.append(norm[s : s + WINDOW])
                exact.append(len(norm) < SHORT)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.exact = np.array(exact, bool)
        self.edits = np.array([0 if e else budget(n, rate) for n, e in zip(self.size.tolist(), exact, strict=True)], np.int64)
        self.least = np.maximum(self.size - Q + 1 - Q * self.edits, 1)
        self.words = {n: (np.array(sorted(found), np.uint64), [found[x] for x in sorted(found)]) for n, found in words.items()}
        found = [grams(b) for b in self.bytes] or [np.zeros(0, np.uint64)]
        every = np.concatenate(found)
        window = np.repeat(np.arange(len(self.bytes)), [len(g) for g in found][: len(self.bytes)])
        offset = np.concatenate([np.arange(len(g)) for g in found])
        order = np.argsort(every, kind="stable")
        self.window, self.offset = window[order], offset[order]
        self.gram, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        self.map = np.zeros(1 << _BITS, bool)
        self.map[(self.gram * _MUL >> np.uint64(64 - _BITS)).astype(np.int64)] = True


def align(w: Windows, window: np.ndarray, text: np.ndarray, low: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], wide: int) -> np.ndarray:
    """Least edits of each window along the diagonals ``low`` .. ``low + wide - 1`` of ``text``."""
    n = w.size[window]
    length = int(n.max())
    pattern = np.zeros((len(window), length), np.uint8)
    for i, k in enumerate(window.tolist()):
        pattern[i, : w.size[k]] = w.bytes[k]
    step = np.arange(wide)
    cost = np.zeros((len(window), wide), np.int32)
    best = np.full(len(window), length, np.int32)
    start, stop = bounds
    for i in range(length):
        at = low[:, None] + i + step
        byte = np.where((at >= start[:, None]) & (at < stop[:, None]), text[np.clip(at, 0, len(text) - 1)], 0)
        new = cost + (byte != pattern[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a byte of the window that the text lacks
        cost = (np.minimum.accumulate(new - step, axis=1) + step).astype(np.int32)  # bytes that the text has more
        ended = n == i + 1
        if ended.any():
            best[ended] = cost[ended].min(1)
    return best


def matches(w: Windows, raw: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """(doc, window, edits, start, stop) of verified bands of a run of documents; places are bytes of the texts."""
    names = ("doc", "window", "edits", "start", "stop")
    none = {k: np.zeros(0, np.int64) for k in names}
    if not len(w.bytes) or not len(raw):
        return none
    text, limits, place = normalise(raw, bounds)
    parts = [_regions(w, text, limits, place) if len(w.gram) else none, *_whole_words(w, text, limits, place)]
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


def _edges(text: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word begins, and whether one has ended, at each place of normalised texts."""
    begins, ended = np.zeros(len(text) + 1, bool), np.zeros(len(text) + 1, bool)
    begins[limits] = ended[limits] = True
    begins[1:] |= np.append(text == 32, False)[:-1]
    ended[:-1] |= text == 32
    return begins, ended


def _whole_words(w: Windows, text: np.ndarray, limits: np.ndarray, place: np.ndarray):
    """Matches of items that are too short for a gram."""
    if not w.words or not len(text):
        return
    begins, ended = _edges(text, limits)
    ahead = grams(np.concatenate([text, np.zeros(Q - 1, np.uint8)]))
    for n, (values, windows) in w.words.items():
        at = np.flatnonzero(begins[: len(text)] & np.append(ended[n:], np.zeros(n, bool))[: len(text)])
        at = at[at + n <= limits[B.owners(at, limits) + 1]]
        seen = ahead[at] & np.uint64((1 << 8 * n) - 1)
        found = np.minimum(np.searchsorted(values, seen), len(values) - 1)
        hit = np.flatnonzero(values[found] == seen)
        many = np.array([len(windows[f]) for f in found[hit].tolist()], np.int64)
        at, window = np.repeat(at[hit], many), np.array([x for f in found[hit].tolist() for x in windows[f]], np.int64)
        yield {"doc": B.owners(at, limits), "window": window, "edits": np.zeros(len(at), np.int64), "start": place[at] if len(at) else at, "stop": place[at + n - 1] + 1 if len(at) else at}


def _regions(w: Windows, text: np.ndarray, limits: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    none = {k: np.zeros(0, np.int64) for k in ("doc", "window", "edits", "start", "stop")}
    g = grams(text)
    at = np.flatnonzero(w.map[(g * _MUL >> np.uint64(64 - _BITS)).astype(np.int64)])
    found = np.minimum(np.searchsorted(w.gram, g[at]), len(w.gram) - 1)
    ok = w.gram[found] == g[at]
    at, found = at[ok], found[ok]
    doc = B.owners(at, limits)
    ok = at + Q <= limits[doc + 1]
    at, found, doc = at[ok], found[ok], doc[ok]
    # a window needs ``least`` hits in a band: what is too thin in any window's reach goes first
    reach = WINDOW + int(w.edits.max()) * 3
    near = np.searchsorted(at, at + reach, "right") - np.searchsorted(at, at - reach, "left")
    ok = near >= int(w.least.min())
    at, found, doc = at[ok], found[ok], doc[ok]
    many = w.count[found]
    if not many.sum():
        return none
    post = np.repeat(w.first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    at, doc = np.repeat(at, many), np.repeat(doc, many)
    window = w.window[post]
    wide = np.maximum(w.edits[window], 1)
    diagonal = at - w.offset[post] + (1 << 20)
    band = diagonal // wide
    bits = (len(text) + (1 << 20)).bit_length()
    # a band needs ``least`` hits by itself or with its neighbour: count single ones before doubling
    single = (doc * len(w.size) + window) * (1 << bits) + band
    order = np.argsort(single, kind="stable")
    single, at = single[order], at[order]
    cut = np.ones(len(single), bool)
    cut[1:] = single[1:] != single[:-1]
    first = np.flatnonzero(cut)
    key = single[first]
    hits = np.diff(np.append(first, len(single)))
    last = np.append(first[1:], len(single)) - 1
    follows = np.zeros(len(key), np.int64)
    follows[:-1] = np.where(key[1:] == key[:-1] + 1, hits[1:], 0)
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1] + 1
    window = key // (1 << bits) % len(w.size)
    kept = np.flatnonzero(hits + follows >= w.least[window])
    if not len(kept):
        return none
    key, window = key[kept], window[kept]
    doc, band = key // (1 << bits) // len(w.size), key % (1 << bits)
    wide = np.maximum(w.edits[window], 1)
    low = band * wide - (1 << 20) - wide
    edits = np.concatenate([align(w, window[i : i + 4096], text, low[i : i + 4096], (limits[doc[i : i + 4096]], limits[doc[i : i + 4096] + 1]), int(4 * wide[i : i + 4096].max())) for i in range(0, len(kept), 4096)])
    good = edits <= w.edits[window]
    if w.exact.any():  # the one place where a short item can stand is the band's first hit
        begins, ended = _edges(text, limits)
        begin = at[first[kept]]
        stop = np.minimum(begin + w.size[window], len(text))
        good &= ~w.exact[window] | (hits[kept] >= w.least[window]) & begins[begin] & ended[stop]
    seen = first[kept][good], last[kept][good]
    return {"doc": doc[good], "window": window[good], "edits": edits[good].astype(np.int64), "start": place[at[seen[0]]], "stop": place[np.minimum(at[seen[1]] + Q, len(place)) - 1] + 1}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float):
    """The benchmark in blocks of bounded size, as broadcasts."""
    bounded(benchmark.sparkSession)
    items = benchmark.select(benchmark[id_col].cast("long").alias("id"), benchmark[text_col].alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield benchmark.sparkSession.sparkContext.broadcast(Windows(rows, rate))


def _leaks(shared):
    names = ["id", "item_id", "n_windows", "edits", "start", "stop"]

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = B.buffers(batch.column("text"))
            for a, b in B.slices(offsets):
                base = offsets[a]
                m = matches(w, data[base : offsets[b]], offsets[a : b + 1] - base)
                found: dict = {}
                for doc, window, edits, start, stop in zip(*(m[k].tolist() for k in ("doc", "window", "edits", "start", "stop")), strict=True):
                    hit = found.setdefault((doc, w.item[window]), [set(), edits, start, stop])
                    hit[0].add(window)
                    hit[1:] = min(hit[1], edits), min(hit[2], start), max(hit[3], stop)
                if found:
                    rows = sorted(found.items())
                    ids = batch.column("id").take(pa.array([a + k[0] for k, _ in rows]))
                    of = [int(offsets[a + k[0]] - base) for k, _ in rows]
                    cols = [[w.item_ids[k[1]] for k, _ in rows], [len(v[0]) for _, v in rows], [v[1] for _, v in rows], [v[2] - o for (_, v), o in zip(rows, of, strict=True)], [v[3] - o for (_, v), o in zip(rows, of, strict=True)]]
                    yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in cols)], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each (document, item) that match: ``id_col``, ``item_id``, how many of the item's
    windows match, the fewest edits of one, and the bytes of the text from the first to the last hit."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, item_id long, n_windows long, edits long, start long, stop long"
    out = None
    for shared in _blocks(benchmark, item_col, item_text, rate):
        found = source.mapInArrow(_leaks(shared), schema)
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col)


def filter_docs(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item."""

    def clean(shared):
        def run(batches):
            for batch in batches:
                data, offsets = B.buffers(batch.column(text_col))
                keep = np.ones(batch.num_rows, bool)
                for a, b in B.slices(offsets):
                    keep[a + matches(shared.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])["doc"]] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _blocks(benchmark, item_col, item_text, rate):
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs
