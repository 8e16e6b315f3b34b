"""Exact removal of long repeats with per-shard suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere
else, in another text or the same one; overlaps count, and strings are judged on
the input.  Matches never cross texts.

Method
  1. Anchors.  Each position p of a text has a window of ``length`` bytes; the
     window's anchor is its least-hashed ``GRAM``-gram, the leftmost of equals.
     Equal windows have equal anchors at equal offsets.  Windows fall to (anchor,
     side): on the left side the anchor is far into the window, on the right side
     it is near its start, so that all windows of a side share a core of more than
     ``length / 2`` bytes.  A core's hash is the key under which alike windows meet.
  2. Keys that occur once are dropped: their windows repeat nowhere.  Where a key's
     contexts (all bytes of its windows) are equal, those windows all repeat, and
     one context stands for its like.
  3. What is left, different contexts of one key, goes to shards by key.  A shard
     builds a suffix array by Larsson-Sadakane refinement (ranks of doubling depth;
     only groups that are still unsorted are sorted again) and Kasai's common
     prefixes; windows whose neighbour shares ``length`` bytes repeat.
  4. A key with more than ``MOST_CONTEXTS`` contexts is cut into several shards.
     Their windows are merged across shards by their 128-bit fingerprints, dealt
     out by range: each row finds its range by binary search over the bounds.
  5. Texts that are equal as a whole are taken once; their copies go entirely.
  6. With ``passage``, a smaller length, ``repeats`` also gives the bytes that
     repeated strings of that length cover.  These are found first, over all bytes;
     whatever repeats over ``length`` bytes lies within them, so that the steps above
     then look at these stretches only.

Text is moved twice, deflated, and only of texts with a key that occurs again.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep
everything; ``length`` and ``passage`` are more than ``GRAM``; rows are judged by their text, so ids may be null or repeat (each
row then is a copy of its like); an empty table gives an empty result; other
columns pass through ``strip_repeats`` and are ignored by ``repeats``.  A text
must fit in one task's memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bitmap
from . import _bytes as B
from ._workspace import Workspace

GRAM = 48
#: Bytes of texts whose windows are looked at at once; a longer text is looked at by itself.
RUN = 1 << 19
#: Bytes of contexts that one suffix array covers, and contexts of one key that go to one shard.
SHARD, MOST_CONTEXTS = 1 << 20, 8_192
#: Bytes of contexts of one task, where the cluster's cores have several tasks each anyway.
TASK = 64 << 20
#: As many keys of many contexts are broadcast at most; of more, they are joined.
MOST_BROADCAST = 100_000


def text_id(raw: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.md5(raw, usedforsecurity=False).digest())


def window_anchors(text: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of a run of documents, gathered by (anchor, side).

    Returns first window, last window, core start, core end (positions in ``text``)
    and the prefix sums for hashes.  Each window of each document is in one row.
    """
    n, wide = len(text), length - GRAM + 1
    prefix = B.prefix_hash(text, False)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < length:
        return *none, prefix
    bits = int(n).bit_length()
    at = np.arange(n - GRAM + 1)
    h = B.span_hash(prefix, at, at + GRAM)
    h = (h >> np.uint64(bits)) << np.uint64(bits) | at.astype(np.uint64)
    # the least of each ``wide`` neighbours, by running minima within blocks from both ends
    pad = -len(h) % wide
    rows = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, wide)
    right = np.minimum.accumulate(rows, axis=1).ravel()
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = (np.minimum(left[: n - length + 1], right[wide - 1 : wide + n - length]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    p = np.arange(n - length + 1)
    inside = np.zeros(n + 1, np.int64)  # windows that stay in their document
    sizes = np.diff(bounds)
    long = sizes >= length
    inside[bounds[:-1][long]] += 1
    np.add.at(inside, bounds[1:][long] - length + 1, -1)
    ok = np.cumsum(inside[: len(p)]) > 0
    p, m = p[ok], m[ok]
    if not len(p):
        return *none, prefix
    half = (length - GRAM) // 2
    far = m - p >= half
    cut = np.ones(len(p), bool)
    cut[1:] = (m[1:] != m[:-1]) | (far[1:] != far[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(p)) - 1
    m, far = m[first], far[first]
    return p[first], p[last], np.where(far, m - half, m), np.where(far, m + GRAM, m + GRAM + (length - GRAM - half)), prefix


ITEM = "key long, context long, t1 long, t2 long, first int, last int"
#: ``deal`` says where an item goes: to its key, or, if it is known to repeat (``whole``), anywhere.
DEALT = ITEM + ", whole boolean, deal long"


def _items(pieces: list[np.ndarray], ids: list[tuple[int, int]], bases: list[int], length: int) -> pa.RecordBatch:
    """Items of pieces of texts; ``ids`` are the texts', ``bases`` the pieces' places in them."""
    text = np.concatenate(pieces)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
    first, last, lo, hi, prefix = window_anchors(text, bounds, length)
    doc = B.owners(first, bounds)
    t = np.array(ids, np.int64)[doc]
    key = B.span_hash(prefix, lo, hi) ^ np.where(lo - first == hi - GRAM - first, np.uint64(0), np.uint64(0x6A09E667F3BCC909))
    # the core's place in its window is not part of the key; the context's bounds are part of the context
    context = B.mix(B.span_hash(prefix, first, last + length) + (lo - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one, like, many = np.unique(B.mix(key ^ B.mix(context)), return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(many[like] > 1)
    pick = np.concatenate([np.sort(one), again])
    whole = np.arange(len(pick)) >= len(one)
    key, context = key.view(np.int64)[pick], context.view(np.int64)[pick]
    shift = np.array(bases, np.int64)[doc[pick]] - bounds[doc[pick]]
    t, first, last = t[pick], first[pick] + shift, last[pick] + shift
    deal = np.where(whole, B.mix(t[:, 0].view(np.uint64) + first.astype(np.uint64)).view(np.int64), key)
    columns = [pa.array(key), pa.array(context), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(whole), pa.array(deal)]
    return pa.record_batch(columns, names=["key", "context", "t1", "t2", "first", "last", "whole", "deal"])


def _anchors(length: int):
    """Every (anchor, side) of every distinct text of a task; first and last are offsets in its text.

    Items of equal context in one run of texts repeat for sure.  One of them goes on
    to its key; all go past it as ``whole``, so a passage or line that is everywhere
    does not gather at its key.
    """

    def run(batches):
        seen: set = set()
        for batch in batches:
            data, offsets = B.buffers(batch.column("text"))
            for a, b in B.slices(offsets, RUN):
                ids, keep = [], []
                for i in range(a, b):
                    if offsets[i + 1] - offsets[i] < length:
                        continue
                    t = text_id(data[offsets[i] : offsets[i + 1]].tobytes())
                    if t not in seen:
                        seen.add(t)
                        ids.append(t)
                        keep.append(data[offsets[i] : offsets[i + 1]])
                if len(seen) > 200_000:
                    seen.clear()  # a copy that is sent twice does no harm
                if keep:
                    yield _items(keep, ids, [0] * len(keep), length)

    return run


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of spans that overlap or touch."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _anchors_within(length: int):
    """The same of the stretches of texts that shorter repeats cover."""

    def run(batches):
        pieces, ids, bases, held = [], [], [], 0
        for batch in batches:
            for packed, spans, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("packed", "spans", "t1", "t2")), strict=True):
                raw = None
                for a, b in merged([(x["start"], x["stop"]) for x in spans]):
                    if b - a < length:
                        continue
                    raw = np.frombuffer(zlib.decompress(packed), np.uint8) if raw is None else raw
                    if held and held + b - a > RUN:
                        yield _items(pieces, ids, bases, length)
                        pieces, ids, bases, held = [], [], [], 0
                    pieces.append(raw[a:b].copy())
                    ids.append((t1, t2))
                    bases.append(a)
                    held += b - a
        if pieces:
            yield _items(pieces, ids, bases, length)

    return run


def _company(batches):
    """From items sorted by (key, context, text, place): windows known to repeat (whole), and one
    item for each of a key's contexts where it has several."""
    names = ["key", "context", "t1", "t2", "first", "last"]
    state: dict = {"key": None}
    pending = None

    def walk(rows):
        out = []
        for row in rows:
            key, context = row[0], row[1]
            if state["key"] != key:
                state.update(key=key, context=context, head=row, whole=False, sent=False, last=row)
                continue
            if row[:6] == state["last"][:6]:
                continue
            state["last"] = row
            if context != state["context"]:
                if not state["sent"]:
                    out.append((*state["head"], False))
                    state["sent"] = True
                out.append((*row, False))
                state.update(context=context, head=row, whole=False)
                continue
            if not state["whole"]:
                out.append((*state["head"], True))
                state["whole"] = True
            out.append((*row, True))
        if not out:
            return None
        kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.bool_(),)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*names, "whole"])

    for batch in batches:
        batch = batch.select([*names, "whole"])
        sure = batch.column("whole")
        if sure.true_count:
            yield batch.filter(sure)
            batch = batch.filter(pc.invert(sure))
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in names]
        if pending is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(pending, columns, strict=True)]
        key = columns[0]
        same = key[1:] == key[:-1]
        held = np.zeros(len(key), bool)
        held[1:] |= same
        held[:-1] |= same
        held[0] |= state["key"] == key[0]
        pending = [int(c[-1]) for c in columns]
        held[-1] = False
        if held.any() and (out := walk(list(zip(*(c[held].tolist() for c in columns), strict=True)))) is not None:
            yield out
    if pending is not None and (out := walk([tuple(pending)])) is not None:
        yield out


def _cut(length: int):
    """Contexts' bytes, from texts with their items."""

    def run(batches):
        for batch in batches:
            out = []
            for packed, items, t1, t2 in zip(batch.column("packed").to_pylist(), batch.column("items").to_pylist(), batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                out += [(x["key"], x["salt"], t1, t2, x["first"], raw[x["first"] : x["last"] + length]) for x in items]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "salt", "t1", "t2", "first", "bytes"])

    return run


def suffix_array(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of strings laid end to end, and each suffix's rank (equal suffixes by place).

    A suffix ends with its string.  Larsson-Sadakane: ranks for depth 8, then 16, 32,
    ..., where a group's rank is the place of its last member and only members of
    unsorted groups are sorted again, by the rank of the suffix ``depth`` further on.
    """
    n = len(text)
    sizes = np.diff(bounds)
    place = np.arange(n, dtype=np.int32)
    room = np.repeat(bounds[1:], sizes).astype(np.int32) - place
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    for i in range(1, 8):
        short = np.flatnonzero(room == i)
        word[short] = word[short] >> np.uint64(8 * (8 - i)) << np.uint64(8 * (8 - i))
    if text.all():  # without zero bytes, a word tells how long it is
        order = np.argsort(word, kind="stable").astype(np.int32)
        w = word[order]
        new = np.ones(n, bool)
        new[1:] = w[1:] != w[:-1]
    else:
        have = np.minimum(room, 8)
        order = np.lexsort((have, word)).astype(np.int32)
        w, r = word[order], have[order]
        new = np.ones(n, bool)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    del word, w, padded
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1

    def number(places, members, new):
        """Ranks of members at these places of the array, in runs that ``new`` begins."""
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(members)) - 1
        sizes = ends - starts + 1
        rank[members] = np.repeat(places[ends], sizes)
        return np.repeat(sizes > 1, sizes)

    places = place
    loose = number(places, order, new)
    depth, longest = 8, int(sizes.max()) if len(sizes) else 0
    while depth < longest and loose.any():
        places = places[loose]
        members = order[places]
        after = np.where(room[members] > depth, rank[np.minimum(members + depth, n)], -1)
        key = rank[members].astype(np.int64) << 32 | after + 1
        by = np.argsort(key, kind="stable")  # equal suffixes stay in the order of their places
        members, key = members[by], key[by]
        order[places] = members
        new = np.ones(len(members), bool)
        new[1:] = key[1:] != key[:-1]
        loose = number(places, members, new)
        depth *= 2
    rank = np.empty(n, np.int32)
    rank[order] = place
    return order, rank


def kasai(text: np.ndarray, bounds: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix (by place) with the one before it in the array.

    Kasai's bound, lcp(p + 1) >= lcp(p) - 1, is carried along all strings at once.
    Eight bytes are compared first, then 64 at a time where they are alike.
    """
    n = len(text)
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes).astype(np.int32)
    before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], np.int32(-1))
    padded = np.concatenate([text, np.zeros(72, np.uint8)])
    word = np.ndarray((n + 65,), "<u8", padded.data, strides=(1,)).astype(np.uint64)
    ahead = np.arange(0, 64, 8)
    lcp = np.zeros(n, np.int32)
    lanes = np.flatnonzero(sizes > 0)
    have = np.zeros(len(sizes), np.int32)

    def alike(apart):
        """Equal bytes at the start of words, from their exclusive or."""
        return np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3)

    for step in range(int(sizes.max()) if len(sizes) else 0):
        lanes = lanes[sizes[lanes] > step]
        p = bounds[lanes] + step
        q = before[p]
        l = np.where(q >= 0, have[lanes], 0)
        top = np.where(q >= 0, np.minimum(end[p] - p, end[np.maximum(q, 0)] - q), 0)
        go = np.flatnonzero(l < top)
        at = l[go]
        more = alike(word[p[go] + at] ^ word[q[go] + at])
        l[go] = np.minimum(at + more, top[go])
        go = go[(more == 8) & (l[go] < top[go])]
        while len(go):
            at = l[go]
            apart = word[(p[go] + at)[:, None] + ahead] ^ word[(q[go] + at)[:, None] + ahead]
            differs = apart != 0
            first = differs.argmax(1)
            more = np.where(differs.any(1), 8 * first + alike(apart[np.arange(len(go)), first]), 64)
            l[go] = np.minimum(at + more, top[go])
            go = go[(more == 64) & (l[go] < top[go])]
        lcp[p] = l
        have[lanes] = np.maximum(l - 1, 0)
    return lcp


def repeated_windows(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, whether it repeats) of each window of ``length`` bytes of the strings."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    order, rank = suffix_array(text, bounds)
    lcp = kasai(text, bounds, order, rank)
    near = lcp[order] >= length  # by place in the array: alike with the one before
    near = near | np.append(near[1:], False)
    sizes = np.diff(bounds)
    each = np.maximum(sizes - length + 1, 0)
    string = np.repeat(np.arange(len(sizes)), each)
    offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return string, offset, near[rank[bounds[string] + offset]]


SPANS = "t1 long, t2 long, start int, stop int, f1 long, f2 long"


def _shards(length: int):
    """Spans of repeated windows; for keys cut into shards, the fingerprints of all windows."""
    names = ["t1", "t2", "start", "stop", "f1", "f2"]

    def spans(rows):
        string, offset, again = repeated_windows([r[5] for r in rows], length)
        t1, t2, first = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
        salted = np.array([r[1] for r in rows]) >= 0
        out = []
        s, o = string[again], offset[again]
        if len(s):
            cut = np.ones(len(s), bool)
            cut[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
            a = np.flatnonzero(cut)
            b = np.append(a[1:], len(s)) - 1
            none = pa.nulls(len(a), pa.int64())
            out.append(pa.record_batch([pa.array(t1[s[a]]), pa.array(t2[s[a]]), pa.array((first[s[a]] + o[a]).astype(np.int32)), pa.array((first[s[b]] + o[b] + length).astype(np.int32)), none, none], names=names))
        loose = np.flatnonzero(salted[string])
        if len(loose):
            s, o = string[loose], offset[loose]
            text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])[s] + o
            f1 = B.span_hash(B.prefix_hash(text, False), at, at + length).view(np.int64)
            f2 = B.span_hash(B.prefix_hash(text[::-1], False), len(text) - at - length, len(text) - at).view(np.int64)
            start = (first[s] + o).astype(np.int32)
            out.append(pa.record_batch([pa.array(t1[s]), pa.array(t2[s]), pa.array(start), pa.array(start + np.int32(length)), pa.array(f1), pa.array(f2)], names=names))
        return out

    def run(batches):
        rows, held, key = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "t1", "t2", "first", "bytes")), strict=True):
                if held >= SHARD and row[:2] != key:  # a key's part is never cut here; it is bounded by MOST_CONTEXTS
                    yield from spans(rows)
                    rows, held = [], 0
                rows.append(row)
                key, held = row[:2], held + len(row[5])
        if rows:
            yield from spans(rows)

    return run


def _outcome(texts: bool):
    """What is left of each text without its long spans: its digest, and the text if asked for; and the bytes of all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                runs = merged([(x["start"], x["stop"]) for x in spans if x["long"]])
                covered = sum(b - a for a, b in merged([(x["start"], x["stop"]) for x in spans]))
                kept, removed, at = [], 0, 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    removed, at = removed + b - a, b
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((removed, len(runs), hashlib.sha256(left).hexdigest(), covered, left.decode("utf-8", "ignore").encode() if texts else b""))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([batch.column("t1"), batch.column("t2"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "covered", "kept"])

    return run


def _named(batches):
    """Rows with their text's id and size."""
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        ids = [text_id(x) for x in texts]
        sha = [hashlib.sha256(x).hexdigest() for x in texts]
        yield pa.record_batch([batch.column("id"), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(sha, pa.string())], names=["id", "t1", "t2", "n_bytes", "sha"])


def _packed(batches):
    """Texts by id, deflated."""
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        ids = [text_id(x) for x in texts]
        yield pa.record_batch([pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array([zlib.compress(x, 1) for x in texts], pa.binary())], names=["t1", "t2", "packed"])


def _identified(docs: DataFrame, text_col: str, shared=None, want: bool = True) -> DataFrame:
    """``docs`` with the ids t1 and t2 of their texts; with a map of ids, only rows whose bit is set, or isn't.

    Both in one step: each Python step of a stage has a worker of its own for every core of an executor.
    """

    def run(batches):
        for batch in batches:
            ids = np.array([text_id(x or b"") for x in batch.column(text_col).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=[*batch.schema.names, "t1", "t2"])
            yield out if shared is None else out.filter(pa.array(_bitmap.hit(shared, _bitmap.low_bits(ids[:, 0])) == want))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())]))


def _id_map(ids: DataFrame):
    """A broadcast map of texts' ids, which are hashes."""
    return _bitmap.build(ids, slots=_bitmap.low_bits(F.col("t1")))


def _packed_texts(texts: DataFrame, wanted: DataFrame, ws: Workspace) -> DataFrame:
    """(t1, t2, packed) of the distinct texts that ``wanted`` names."""
    chosen = _identified(texts, "text", _id_map(wanted))
    chosen = chosen.join(wanted, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).select("text")
    return ws.table(chosen.mapInArrow(_packed, "t1 long, t2 long, packed binary"), "texts")


def _with_salt(several: DataFrame, most_contexts: int) -> DataFrame:
    """``salt``: -1, or the shard of a key of more than ``most_contexts`` contexts."""
    hot = several.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_contexts).select("key", F.ceil(F.col("n") * 2 / most_contexts).cast("int").alias("parts"))
    hot = hot.checkpoint()
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    return several.join(hot, "key", "left").withColumn("salt", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod("context", F.col("parts")).cast("int")))


def _spans_of(items: DataFrame, length: int, ws: Workspace, name: str, texts: DataFrame, most_contexts: int, packed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, start, stop) of windows that repeat, and the texts that have any candidate."""
    items = items.repartition("deal").sortWithinPartitions("key", "context", "t1", "t2", "first")
    company = ws.table(items.mapInArrow(_company, ITEM + ", whole boolean"), f"company{name}")
    if packed is None:
        packed = _packed_texts(texts, company.select("t1", "t2").distinct(), ws)
    several = company.where("not whole")
    size = several.agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    tasks = max(-(-size // TASK), min(-(-size // SHARD), 4 * several.sparkSession.sparkContext.defaultParallelism), 1)
    several = _with_salt(several, most_contexts).groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "salt", "first", "last")).alias("items"))
    contexts = several.join(packed, ["t1", "t2"]).mapInArrow(_cut(length), "key long, salt int, t1 long, t2 long, first int, bytes binary")
    contexts = contexts.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt")
    spans = ws.table(contexts.mapInArrow(_shards(length), SPANS), f"spans{name}")

    loose = spans.where("f1 is not null")
    again = loose.repartitionByRange("f1", "f2").groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    across = loose.join(again, ["f1", "f2"], "left_semi").select("t1", "t2", "start", "stop")
    whole = company.where("whole").select("t1", "t2", F.col("first").alias("start"), (F.col("last") + length).cast("int").alias("stop"))
    return spans.where("f1 is null").select("t1", "t2", "start", "stop").union(across).union(whole), packed


def _find(texts: DataFrame, length: int, ws: Workspace, kept: bool = False, most_contexts: int = MOST_CONTEXTS, passage: int | None = None) -> DataFrame:
    """(t1, t2, n_removed, n_spans, kept_sha256, covered, kept) of the texts that share something with another or with themselves."""
    least = min(length, passage or length)
    if least <= GRAM:
        raise ValueError(f"repeats of at least {GRAM + 1} bytes can be found")
    every, packed = _spans_of(texts.mapInArrow(_anchors(least), DEALT), least, ws, "", texts, most_contexts)
    gather = lambda df: df.groupBy("t1", "t2").agg(F.collect_list(F.struct(*[c for c in df.columns if c not in ("t1", "t2")])).alias("spans")).join(packed, ["t1", "t2"])
    if least == length:
        every = every.withColumn("long", F.lit(True))
    else:
        every = ws.table(every, "short")
        within = gather(every).mapInArrow(_anchors_within(length), DEALT)
        longer, _ = _spans_of(within, length, ws, "-long", texts, most_contexts, packed)
        every = every.withColumn("long", F.lit(False)).union(longer.withColumn("long", F.lit(True)))
    return gather(every).mapInArrow(_outcome(kept), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, covered long, kept binary")


def repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS, passage: int | None = None) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` for every row of ``docs``.

    With ``passage`` (less than ``length``) also ``n_passage_bytes``: the bytes that strings of so many
    bytes cover which also start elsewhere; nothing is removed for them.
    """
    with Workspace(docs.sparkSession, "repeats") as ws:
        source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        found = _find(source.select("text"), length, ws, most_contexts=most_contexts, passage=passage).drop("kept")
        rows = ws.table(source.mapInArrow(_named, f"id {dict(source.dtypes)['id']}, t1 long, t2 long, n_bytes long, sha string"), "rows")
        copies = rows.where(F.col("n_bytes") >= min(length, passage or length)).groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2", F.lit(True).alias("copied"))
        out = rows.join(found.join(copies, ["t1", "t2"], "full"), ["t1", "t2"], "left")
        copied = F.coalesce("copied", F.lit(False))
        gone = copied & (F.col("n_bytes") >= length)
        covered = F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("n_passage_bytes")
        out = out.select(
            F.col("id").alias(id_col), "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            *[covered] * (passage is not None))
        return ws.finish(out)


def strip_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated bytes; rows of which no word is left go.

    Bytes are cut as they are found; a character that a cut parts goes with it.
    ``size_col``, if there is such a column, becomes the characters of what is left.
    """
    names, kinds = docs.columns, {f.name: f.dataType for f in docs.schema.fields}
    docs = docs.toDF(*[f"_{c}" for c in names])  # apart from the names used here
    text_col, size_kind, size_col = f"_{text_col}", kinds.get(size_col), f"_{size_col}"
    with Workspace(docs.sparkSession, "strip") as ws:
        texts = docs.select(docs[text_col].alias("text"))
        found = ws.table(_find(texts, length, ws, kept=True).select("t1", "t2", "kept"), "found")
        copies = _identified(texts.where(F.octet_length("text") >= length), "text").groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2", F.lit(True).alias("copied"))
        changed = ws.table(found.join(copies, ["t1", "t2"], "full").select("t1", "t2", F.when(F.col("copied"), F.lit(b"")).otherwise(F.col("kept")).alias("kept")), "changed")
        shared = _id_map(changed)
        same = _identified(docs, text_col, shared, False).drop("t1", "t2")
        left = _identified(docs, text_col, shared).join(changed, ["t1", "t2"], "left")
        text = F.when(F.col("kept").isNull(), F.col(text_col)).otherwise(F.col("kept").cast("string"))
        left = left.withColumn(text_col, text)
        if size_col in docs.columns:
            left = left.withColumn(size_col, F.when(F.col("kept").isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(size_kind))
        left = left.where(F.col("kept").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
        return ws.finish(same.unionByName(left.select(docs.columns)).toDF(*names))
