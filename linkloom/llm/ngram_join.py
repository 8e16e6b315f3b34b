"""N-gram Jaccard self-join by set relations.

Documents are sets of distinct word shingles; two link when their Jaccard
similarity is at least ``num / den``.  The result is each document's class
under links, exactly, and on request each row's number of links, exactly.

Method
  1. One pass hashes every document's shingles (64 bits) and gives its set's
     size and 128-bit digest; equal sets fold into one class.  The same pass
     counts shingles in a table of ``2^BITS`` cells, whose size does not depend
     on the data.  It only orders shingles, rare ones first; any order is right.
  2. Prefix index: a set of n shingles enters the lists of its first
     ``n - ceil(n * t) + 1`` ones.  A list is ordered by (set size, position), its
     index blocks.  Position and size bound the overlap two entries can have;
     where a block's best position falls short, the whole block is skipped.
  3. Set relations, first: each entry is verified against its list's best-placed
     earlier entry and its predecessor only.  A set that proves highly similar
     takes over the answers already known (the component) of its like.
  4. The rest: of all lists, those pairs that the bounds leave *and* whose
     components still differ are verified in full, so that no link is lost.
  5. Numbers of links (``ngram_jaccard_links``): a component's least set is its
     pivot P, and each member S is known by its difference from P alone: the
     elements it lacks and those it has more.  The answers for two members follow
     from the pivot's: |S & T| = |P| - lacks(S) - lacks(T) + shared, where shared is
     the size of the intersection of the two differences.  With the cost
     ``den * lacks + num * more`` of a member, S and T link exactly if
     ``(num + den) * shared >= cost(S) + cost(T) - (den - num) * |P|``.  Pairs whose
     right side is 0 or less link whatever they share: they are counted from the
     pivot's histogram of costs, never listed.  The others must share so many
     elements, which asks for a common element in short prefixes of their
     differences, rare elements first; candidates are decided on the differences.
     Step 4 has all pairs of different components.
  Steps 3 to 5 send texts, deflated, only of classes that have a candidate; of a
  pair, the text of the set that many others are compared with is joined last, so
  that it isn't copied for each of them.

Defined cases: a text of fewer than ``k`` words is one shingle (its whole
sequence); a null, empty or wordless text has ``n_shingles`` 0 and is linked with
nothing; rows that repeat a doc_id are one document, linked if any of its texts
is; rows without doc_id group by their text and get null where no document with
an id is in reach.  An empty table gives an empty result; other columns are
ignored.  A text must fit in one task's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bitmap
from . import _bytes as B
from ._graph import components
from ._workspace import Workspace, fresh

#: Cells of the table that orders shingles: 2^BITS counts of one byte are broadcast.
BITS, PART = 20, 1 << 14
#: Entries of an index block.
BLOCK = 256
_SHIFT = np.uint64(64 - BITS)


def _sets(batch: pa.RecordBatch, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, concatenated sorted sets, their bounds) for runs of a batch's documents."""
    data, offsets = B.buffers(batch.column("text"))
    for a, b in B.slices(offsets):
        h, doc, _ = B.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, lower)
        if len(doc) and (np.diff(doc) < 0).any():
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            h[cuts[i] : cuts[i + 1]].sort()
        if len(h):
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[fresh], doc[fresh]
            cuts = np.searchsorted(doc, np.arange(b - a + 1))
        yield a, h, cuts


def _digests(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(B.mix(h ^ np.uint64(salt)), out=total[1:])
        out.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def _describe(k: int, lower: bool):
    def run(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for a, h, cuts in _sets(batch, k, lower):
                n = len(cuts) - 1
                d1, d2 = _digests(h, cuts)
                counts += np.bincount((h >> _SHIFT).astype(np.int64), minlength=1 << BITS)
                none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
                yield pa.record_batch([batch.column("id").slice(a, n), pa.array(np.diff(cuts)), pa.array(d1), pa.array(d2), *none], names=["id", "n", "d1", "d2", "part", "counts"])
        parts = [i for i in range(0, 1 << BITS, PART) if counts[i : i + PART].any()]
        if parts:
            packed = [zlib.compress(counts[i : i + PART].astype(np.uint32).tobytes(), 1) for i in parts]
            yield pa.record_batch([*(pa.nulls(len(parts), pa.int64()) for _ in range(4)), pa.array([i // PART for i in parts], pa.int32()), pa.array(packed, pa.binary())], names=["id", "n", "d1", "d2", "part", "counts"])

    return run


def _add_counts(batches):
    """Sums the tasks' counts cell by cell; what leaves is one byte a cell: four times the log2."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
    levels = [np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["part", "counts"])


def _prefixes(k: int, lower: bool, num: int, den: int, levels):
    """Each set's prefix: keys are (level, 56 bits of the hash); equal keys only add candidates."""

    def run(batches):
        rank = levels.value
        for batch in batches:
            for a, h, cuts in _sets(batch, k, lower):
                n = len(cuts) - 1
                d1, d2 = _digests(h, cuts)
                keys = (rank[(h >> _SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                size = np.diff(cuts)
                most = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                kept = []
                for i in range(n):
                    mine = keys[cuts[i] : cuts[i + 1]]
                    if most[i] < len(mine):
                        mine = np.partition(mine, most[i] - 1)[: most[i]]
                    mine = mine[: most[i]]
                    mine.sort()
                    kept.append(mine)
                flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
                yield pa.record_batch([batch.column("id").slice(a, n), pa.array(size), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n", "d1", "d2", "keys"])

    return run


def _chains(num: int, den: int):
    """From entries sorted by (key, n, pos): those with company, each with its two first partners."""
    names = ["key", "node", "n", "pos", "before", "best"]

    def fits(m, p, n, q):
        """Whether entries of sizes m <= n at positions p and q can reach the threshold."""
        return m * den >= num * n and (1 + min(m - p - 1, n - q - 1)) * (num + den) >= num * (m + n)

    def run(batches):
        last = None  # the row that awaits company
        chain: dict = {"key": None}

        def live(rows):
            out = []
            for key, node, n, pos in rows:
                before = best = None
                if chain["key"] == key:
                    m, p, x = chain["last"]
                    before = x if x != node and fits(m, p, n, pos) else None
                    m, p, x = chain["best"]
                    if m * den < num * n:
                        chain["best"] = (n, pos, node)
                    else:
                        best = x if x not in (node, before) and fits(m, p, n, pos) else None
                        if pos < p:
                            chain["best"] = (n, pos, node)
                else:
                    chain.update(key=key, best=(n, pos, node))
                chain["last"] = (n, pos, node)
                out.append((key, node, n, pos, before, best))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names) if out else None

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names[:4]]
            if last is not None:
                columns = [np.concatenate([[x], c]) for x, c in zip(last, columns, strict=True)]
            key = columns[0]
            same = key[1:] == key[:-1]
            held = np.zeros(len(key), bool)
            held[1:] |= same
            held[:-1] |= same
            held[0] |= last is not None and chain["key"] == key[0]
            last = [c[-1] for c in columns]
            held[-1] = False  # it is looked at with the next batch
            if (out := live(list(zip(*(c[held].tolist() for c in columns), strict=True)))) is not None:
                yield out
        if last is not None and chain["key"] == last[0]:
            yield live([tuple(int(x) for x in last)])

    return run


def _chosen(bitmap):
    """Rows whose slot is set in a map of fixed size, their texts deflated."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_bitmap.hit(bitmap, batch.column("slot").to_numpy())))
            texts = [zlib.compress(x or b"", 1) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(texts, pa.binary())], names=["node", "packed"])

    return run


def _pairs_of_sets(k: int, lower: bool, batches):
    """(part of a batch, the sets of its ``x`` and of its ``y``).  Pairs come sorted by ``x``, so that its set is
    built once for all partners that follow."""
    known: dict = {}
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            px, py = part.column("px").to_pylist(), part.column("py").to_pylist()
            need = {p: None for p in [*px, *py] if p not in known}
            known = {p: known[p] for p in {*px, *py} if p in known}
            if need:
                texts = pa.record_batch([pa.array([zlib.decompress(p) for p in need], pa.binary())], names=["text"])
                order = list(need)
                for first, h, cuts in _sets(texts, k, lower):
                    for i in range(len(cuts) - 1):
                        known[order[first + i]] = h[cuts[i] : cuts[i + 1]].copy()
            yield part, [known[p] for p in px], [known[p] for p in py]


def _within(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each element of ``s`` whether it is in ``t``; both are sorted."""
    return t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s if len(t) else np.zeros(len(s), bool)


def _verify(k: int, lower: bool, num: int, den: int):
    """Pairs with both texts: whether their sets reach the threshold."""

    def run(batches):
        for part, left, right in _pairs_of_sets(k, lower, batches):
            ok = []
            for s, t in zip(left, right, strict=True):
                if len(s) > len(t):
                    s, t = t, s
                common = int(_within(s, t).sum())
                ok.append(common * den >= num * (len(s) + len(t) - common) and common > 0)
            yield pa.record_batch([part.column("x"), part.column("y"), pa.array(ok)], names=["x", "y", "linked"])

    return run


KIN = "node long, pivot long, cost long, most long, diff array<long>"


def _differences(k: int, lower: bool, num: int, den: int, levels):
    """Pairs of a pivot ``x`` and a member ``y``: the member's cost, the cost up to which two members surely link,
    and its difference from the pivot; what it has more stands first, and rare elements before others."""

    def run(batches):
        rank = levels.value
        for part, pivots, members in _pairs_of_sets(k, lower, batches):
            cost, most, found = [], [], []
            for p, s in zip(pivots, members, strict=True):
                lacks, more = p[~_within(p, s)], s[~_within(s, p)]
                found += [d[np.argsort(rank[(d >> _SHIFT).astype(np.int64)], kind="stable")] for d in (more, lacks)]
                cost.append(den * len(lacks) + num * len(more))
                most.append((den - num) * len(p))
            ends = np.cumsum([0, *(len(found[i]) + len(found[i + 1]) for i in range(0, len(found), 2))]).astype(np.int32)
            diff = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.record_batch([part.column("y"), part.column("x"), pa.array(cost, pa.int64()), pa.array(most, pa.int64()), diff], names=["node", "pivot", "cost", "most", "diff"])

    return run


def _node() -> Column:
    """The document: its id, or, without one, a number far below any id, made from its set."""
    return F.coalesce(F.col("id"), F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("d1", "d2"), 3))


def ngram_jaccard_groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` (long), ``component_id`` (long) for every row of ``docs``."""
    return _joined(docs, k, num, den, lower, id_col, text_col, links=False)


def ngram_jaccard_links(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``ngram_jaccard_groups`` and ``n_links`` (long): how many other rows' texts link with the row's.

    Where ids are null or repeat, rows are told apart by a number of their own, for which the table is
    written once; links are counted by row then, and classes by id.
    """
    with Workspace(docs.sparkSession, "links") as ws:
        if not docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
            return _joined(docs, k, num, den, lower, id_col, text_col, links=True)
        docs = ws.table(docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_row")), "docs")
        links = ws.table(_joined(docs, k, num, den, lower, "_row", text_col, links=True).join(docs.select("_row", F.col(id_col).alias("id")), "_row"), "links")
        some = links.where("n_shingles > 0").select("id", F.col("component_id").alias("part"))
        low = some.where("id is not null").groupBy("id").agg(F.min("part").alias("v"))
        tied = components(some.join(low, "id").select(F.col("part").alias("u"), "v")).toDF("part", "whole")
        parts = some.join(tied, "part", "left").withColumn("whole", F.coalesce("whole", "part"))
        least = parts.groupBy("whole").agg(F.min("id").alias("least"))
        of_part = parts.select("part", "whole").distinct().join(least, "whole").select(F.col("part").alias("component_id"), "least")
        named = links.where("n_shingles > 0").join(of_part, "component_id").select("id", "n_shingles", "least", "n_links")
        return ws.finish(named.union(links.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("least"), "n_links")).toDF(id_col, "n_shingles", "component_id", "n_links"))


def _joined(docs: DataFrame, k: int, num: int, den: int, lower: bool, id_col: str, text_col: str, links: bool) -> DataFrame:
    """With ``links``, ids are neither null nor repeated, so that a node is one set."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    with Workspace(spark, "ngram") as ws:
        described = ws.table(source.mapInArrow(_describe(k, lower), "id long, n long, d1 long, d2 long, part int, counts binary"), "described")
        rows = described.where("part is null").select("id", "n", "d1", "d2", _node().alias("node"))
        counts = described.where("part is not null").select("part", "counts").repartition(min(64, 1 << BITS >> 14), "part")
        levels = np.zeros(1 << BITS, np.uint8)
        for part, packed in counts.mapInArrow(_add_counts, "part int, counts binary").collect():  # 2^BITS bytes in all
            levels[part * PART : (part + 1) * PART] = np.frombuffer(packed, np.uint8)
        shared = spark.sparkContext.broadcast(levels)

        # the least id stands for a set; rows that repeat an id tie their sets together
        classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min("node").alias("other"), F.count("*").alias("copies"))
        classes = ws.table(classes.select("d1", "d2", F.coalesce("id", "other").alias("node"), "copies"), "classes")
        ties = rows.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).where("a <> b").select("id")
        ties = rows.where("n > 0").join(ties, "id", "left_semi").select("id", "d1", "d2").distinct()
        ties = ties.join(classes, ["d1", "d2"]).select(F.col("id").alias("u"), F.col("node").alias("v"))

        prefixes = source.mapInArrow(_prefixes(k, lower, num, den, shared), "id long, n long, d1 long, d2 long, keys array<long>")
        prefixes = prefixes.where("n > 0").withColumn("node", _node()).join(classes, ["node", "d1", "d2"], "left_semi")
        entries = prefixes.select("node", "n", F.posexplode("keys").alias("pos", "key")).select("key", "node", "n", "pos")
        entries = entries.repartition("key").sortWithinPartitions("key", "n", "pos", "node")
        live = ws.table(entries.mapInArrow(_chains(num, den), "key long, node long, n long, pos int, before long, best long"), "live")

        nodes = live.select("node").distinct()
        bitmap = _bitmap.build(nodes, "node")
        named = rows.where("n > 0").select("id", "d1", "d2", "node")
        if named.where("id is null").limit(1).count():  # such rows are known by their digests alone
            texts = source.mapInArrow(_texts_of_nameless(k, lower), "id long, d1 long, d2 long, text string").select(_node().alias("node"), "text")
        else:
            texts = source.where("id is not null").select(F.col("id").alias("node"), "text")
        texts = texts.select("node", "text", _bitmap.slot("node").alias("slot")).mapInArrow(_chosen(bitmap), "node long, packed binary")
        texts = ws.table(texts.join(nodes, "node", "left_semi").distinct(), "texts")

        def with_texts(pairs: DataFrame) -> DataFrame:
            """``x`` may be a set that many others are compared with."""
            return pairs.join(texts.toDF("y", "py"), "y").join(texts.toDF("x", "px"), "x").select("x", "y", "px", "py")

        def verified(pairs: DataFrame) -> DataFrame:
            checked = with_texts(pairs).mapInArrow(_verify(k, lower, num, den), "x long, y long, linked boolean")
            return checked.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("linked").alias("linked"))

        partners = live.select(F.col("before").alias("x"), F.col("node").alias("y")).union(live.select("best", "node")).where("x is not null")
        first = ws.table(verified(partners.distinct()), "first")
        linked = first.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        known = components(linked.union(ties))
        near = known.select("node", F.col("component").alias("pivot"))
        rest = _rest(live, near, num, den).join(first, ["x", "y"], "left_anti")
        more = ws.table(verified(rest).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")), "more")
        if more.limit(1).count():
            known = components(known.toDF("u", "v").union(more))

        number = F.lit(0).cast("long")
        if links:
            kin = with_texts(near.select(F.col("pivot").alias("x"), F.col("node").alias("y"))).mapInArrow(_differences(k, lower, num, den, shared), KIN)
            kin = ws.table(kin, "kin")
            pairs = ws.table(linked.union(more).union(_kindred(kin, num, den)).distinct(), "pairs")
            counts = ws.table(_counts(classes.select("node", "copies"), kin, pairs), "counts")
            classes = classes.join(counts, "node", "left")
            number = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
        of_class = classes.join(known, "node", "left").select("d1", "d2", F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"), number.alias("n_links"))
        out = rows.join(of_class, ["d1", "d2"], "left") if _has(rows) else rows.withColumns({"component": F.lit(None).cast("long"), "n_links": F.lit(0).cast("long")})
        group = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
        out = out.select(F.col("id"), F.col("n"), group.alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        # a component's number may be that of a nameless row: then its least id counts
        least = out.where("component < 0").groupBy("component").agg(F.min("id").alias("least")) if _nameless(rows) else None
        if least is not None:
            out = out.join(least, "component", "left").select("id", "n", "n_links", F.when(F.col("component") < 0, F.col("least")).otherwise(F.col("component")).alias("component"))
        result = ws.finish(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), *["n_links"] * links))
        shared.unpersist()
        bitmap.unpersist()
    return result


def _has(rows: DataFrame) -> bool:
    return bool(rows.where("n > 0").limit(1).count())


def _nameless(rows: DataFrame) -> bool:
    return bool(rows.where("id is null").limit(1).count())


def _texts_of_nameless(k: int, lower: bool):
    def run(batches):
        for batch in batches:
            for a, h, cuts in _sets(batch, k, lower):
                n = len(cuts) - 1
                d1, d2 = _digests(h, cuts)
                yield pa.record_batch([batch.column("id").slice(a, n), pa.array(d1), pa.array(d2), batch.column("text").slice(a, n)], names=["id", "d1", "d2", "text"])

    return run


def _kindred(kin: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): members of one pivot that link, of those pairs that their costs alone don't decide."""
    size, both = F.size("diff"), num + den
    # a pair needs c + d - most shared elements, times num + den; with d >= c that is 2c - most, and since nothing
    # shares more than its own difference, at least c - most over den whichever of the two costs more
    low = F.greatest(F.lit(1), F.ceil((F.col("cost") * 2 - F.col("most")) / both)).cast("int")
    high = F.greatest(F.lit(1), F.ceil((F.col("cost") - F.col("most")) / den)).cast("int")
    long = F.greatest(F.lit(0), size - high + 1)
    entries = kin.where(size > 0).select("pivot", "node", "cost", "most", size.alias("size"), (size - low + 1).alias("short"), F.posexplode(F.slice("diff", F.lit(1), long)).alias("pos", "key"))
    found = entries.where("pos < short").alias("a").join(entries.alias("b"), F.expr(f"""
        a.pivot = b.pivot and a.key = b.key and (a.cost < b.cost or (a.cost = b.cost and a.node < b.node)) and a.cost + b.cost > a.most
        and least(a.size - a.pos, b.size - b.pos) * {both} >= a.cost + b.cost - a.most"""))
    found = found.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
    side = lambda n: kin.select(F.col("node").alias(n), F.col("cost").alias(f"c{n}"), F.col("diff").alias(f"d{n}"))
    met = found.join(side("x"), "x").join(side("y").join(kin.select(F.col("node").alias("y"), "most"), "y"), "y")
    met = met.where(F.size(F.array_intersect("dx", "dy")) * both >= F.col("cx") + F.col("cy") - F.col("most"))
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def _counts(classes: DataFrame, kin: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, others): rows of other sets that link with the set; ``linked`` has all linked pairs that costs don't decide."""
    near = kin.select("node", "pivot", "cost", "most")
    # one row a pivot and cost: what its sets, however many, add up to
    steps = near.where("cost <= most").join(classes, "node").groupBy("pivot", "cost").agg(F.sum("copies").alias("copies"), F.first("most").alias("most"))
    # a set of cost c links with all sets of cost most - c at most: a running sum over costs, asked for at most - c
    told = steps.selectExpr("pivot", "cost as at", "0 as asks", "copies", "cost").union(steps.selectExpr("pivot", "most - cost", "1", "0L", "cost"))
    reach = told.withColumn("rows", F.sum("copies").over(Window.partitionBy("pivot").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)))
    sure = near.join(reach.where("asks = 1").select("pivot", "cost", "rows"), ["pivot", "cost"]).join(classes, "node")
    sure = sure.select("node", (F.col("rows") - F.when(F.col("cost") * 2 <= F.col("most"), F.col("copies")).otherwise(F.lit(0))).alias("others"))
    pairs = linked.toDF("u", "v").join(near.toDF("u", "pu", "cu", "most"), "u", "left").join(near.toDF("v", "pv", "cv", "_"), "v", "left")
    pairs = pairs.where("not coalesce(pu = pv and cu + cv <= most, false)").select("u", "v")
    each = pairs.union(pairs.select("v", "u")).toDF("u", "node").join(classes, "node").select(F.col("u").alias("node"), F.col("copies").alias("others"))
    return sure.union(each).groupBy("node").agg(F.sum("others").alias("others"))


def _rest(live: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of different components, from index blocks that the bounds don't skip."""
    entries = live.select("key", "node", "n", "pos").join(near, "node", "left").withColumn("pivot", F.coalesce("pivot", "node"))
    mixed = entries.groupBy("key").agg(F.min("pivot").alias("a"), F.max("pivot").alias("b")).where("a <> b").select("key")
    entries = entries.join(mixed, "key", "left_semi")
    block = F.expr(f"cast((row_number() over (partition by key, n order by pos, node) - 1) / {BLOCK} as int)")
    blocks = entries.withColumn("block", block).groupBy("key", "n", "block").agg(
        F.collect_list(F.struct("pos", "node", "pivot")).alias("items"), F.min("pos").alias("low"), F.min("pivot").alias("c1"), F.max("pivot").alias("c2"))
    pairs = blocks.alias("a").join(blocks.alias("b"), F.expr(f"""
        a.key = b.key and (a.n < b.n or (a.n = b.n and a.block <= b.block)) and a.n * {den} >= {num} * b.n
        and (1 + least(a.n - a.low - 1, b.n - b.low - 1)) * {num + den} >= {num} * (a.n + b.n)
        and not (a.c1 = a.c2 and b.c1 = b.c2 and a.c1 = b.c1)"""))
    sides = [F.col(f"{side}.items.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("pos", "node", "pivot")]
    return pairs.select(F.col("a.n").alias("m"), F.col("b.n").alias("n"), *sides).mapInArrow(_across(num, den), "x long, y long").distinct()


def _across(num: int, den: int):
    """Pairs of different components between two index blocks that the bounds leave."""

    def run(batches):
        for batch in batches:
            lists = {c: (batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in batch.schema.names if c not in ("m", "n")}
            found = []
            for k, (m, n) in enumerate(zip(batch.column("m").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                # both entries must have so many elements left, their own included
                left = -(-num * (m + n) // (num + den))
                side = {}
                for s, size in (("a", m), ("b", n)):
                    pos, node, pivot = (v[o[k] : o[k + 1]] for v, o in (lists[f"{c}_{s}"] for c in ("pos", "node", "pivot")))
                    ok = size - pos >= left
                    side[s] = node[ok], pivot[ok]
                i, j = np.nonzero(side["a"][1][:, None] != side["b"][1][None, :])
                found.append(np.stack([side["a"][0][i], side["b"][0][j]]))
            if found:
                both = np.concatenate(found, axis=1)
                both = np.unique(np.sort(both, axis=0), axis=1)
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["x", "y"])

    return run


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows: that of the least id.

    Rows without any word stay.  Where ids are null or repeat, rows are told apart
    by a number of their own, for which the table is written once.
    """
    with Workspace(docs.sparkSession, "keep-one") as ws:
        row = id_col
        if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
            row = fresh("_row", docs.columns)
            docs = ws.table(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
        groups = ngram_jaccard_groups(docs, k, num, den, lower, row, text_col)
        gone = groups.where(F.col(row) != F.col("component_id")).select(row)
        shared = _bitmap.build(gone, row)
        maybe = _bitmap.only(docs, shared, [row], True).join(gone, row, "left_anti").select(docs.columns)
        out = _bitmap.only(docs, shared, [row], False).unionByName(maybe)
        return ws.finish(out.drop(row)) if row != id_col else out
