"""Token counts that survive edits.

A document's pre-tokens are kept as a segment tree: a leaf covers up to twice ``LEAF``
pre-tokens and holds their characters and tokens, an inner node the sums of its
children.  An edit re-encodes a region only: from the leaf boundary before it (with
enough context that no earlier pre-token could have looked into it) to the first
pre-token after it that ends where an old leaf ended.  The region's pre-tokens are
dealt to the leaves that it had, and sums are updated along their paths; only a
region that outgrows its leaves makes new ones and the inner nodes anew.

``plant`` writes the trees' leaves beside the texts, a row a document; ``edit_trees``
takes such a table and a table of edits and returns the next such table, and
``counts`` sums a table's leaves.  ``count_tokens`` does it all in one pass.

Pre-tokens come from a left-to-right pattern whose matches look at most
``LOOK_AHEAD`` characters beyond their end and never back, so from equal
boundaries on, equal text gives equal pre-tokens.  A pre-token's tokens are
counted once per distinct pre-token and process, with a public tokenizer's ranks;
the vocabulary's path is a parameter.  Special tokens are ordinary text.

Defined cases: a null, empty or wordless text has as many tokens as its
characters give (0 for null and empty); rows are counted one by one, so ids may be
null or repeat; edits outside a text are clipped to it; an empty table gives an
empty result; other columns are ignored.  A text and its edits must fit in one
task's memory, since each edit refers to the text that the one before it left.
Kept trees are edited by id: rows of equal ids, null among them, take the same
edits; edits of an id without a tree change nothing; edits of equal ``seq`` go by
start, end and text; an edit without start or end is none, one without text a cut.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._workspace import bounded

LEAF, LOOK_AHEAD = 32, 4
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of distinct pre-tokens that a process keeps.
MOST_KNOWN = 1 << 19
Edit = tuple[int, int, str]  # start, end, replacement, in code points of the text before it


def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """A function from pre-tokens to their numbers of tokens."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(pieces: list[str]) -> list[int]:
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > MOST_KNOWN:
                known.clear()
            for i, n in enumerate(out):
                if n is None:
                    piece = pieces[i]
                    if (n := known.get(piece)) is None:
                        raw = piece.encode("utf-8", "surrogatepass")
                        n = 1 if raw in ranks else len(encoding.encode_single_piece(raw)) if hasattr(encoding, "encode_single_piece") else len(encoding._encode_single_piece(raw))
                        known[piece] = n
                    out[i] = n
        return out

    return count


_SPLIT = regex.compile(PATTERN)


class TokenTree:
    """Leaves of pre-tokens with sums of characters, pre-tokens and tokens above them."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], leaves: tuple[list[int], list[int], list[int]] | None = None):
        """``leaves``: those of a tree of the same text, kept; nothing is encoded then."""
        self.text, self.count, self.reencoded = text, count, 0
        self._build(*(self._leaves(_SPLIT.findall(text)) if leaves is None else leaves))

    @property
    def leaves(self) -> tuple[list[int], list[int], list[int]]:
        return tuple(self.levels[0].tolist())

    def _leaves(self, pieces: list[str]) -> tuple[list[int], list[int], list[int]]:
        if not pieces:
            return [], [], []
        tokens = self.count(pieces)
        at = range(0, len(pieces), LEAF)
        chars = [len("".join(pieces[i : i + LEAF])) for i in at]
        return chars, [min(LEAF, len(pieces) - i) for i in at], [sum(tokens[i : i + LEAF]) for i in at]

    def _build(self, chars: list[int], pieces: list[int], tokens: list[int]) -> None:
        leaves = np.array([chars, pieces, tokens], np.int64).reshape(3, -1)
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(self._above(self.levels[-1]))

    @staticmethod
    def _above(level: np.ndarray) -> np.ndarray:
        if level.shape[1] % 2:
            level = np.concatenate([level, np.zeros((3, 1), np.int64)], 1)
        return level[:, ::2] + level[:, 1::2]

    def _total(self, row: int) -> int:
        return int(self.levels[-1][row].sum())

    @property
    def n_pretokens(self) -> int:
        return self._total(1)

    @property
    def n_tokens(self) -> int:
        return self._total(2)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character: down from the root."""
        leaf, start = 0, 0
        for level in reversed(self.levels[:-1]):
            leaf *= 2
            if leaf + 1 < level.shape[1] and position >= start + level[0, leaf]:
                start += int(level[0, leaf])
                leaf += 1
        return leaf, start

    def edit(self, start: int, end: int, new: str) -> None:
        old = len(self.text)
        start = min(max(start, 0), old)
        end = min(max(end, start), old)
        self.text = self.text[:start] + new + self.text[end:]
        grown = len(new) - (end - start)
        n = self.levels[0].shape[1]
        if not old or not n:
            self.reencoded += len(pieces := _SPLIT.findall(self.text))
            self._build(*self._leaves(pieces))
            return
        first, begin = self._leaf_at(max(start - LOOK_AHEAD, 0))
        chars, after = self.levels[0][0], start + len(new)
        pieces, last = [], first
        edge = begin + grown + int(chars[first])  # where the leaf ends now, if it lies after the edit
        for m in _SPLIT.finditer(self.text, begin):
            pieces.append(m.group())
            at = m.end()
            while edge < at and last < n - 1:
                last += 1
                edge += int(chars[last])
            if edge == at >= after:
                break
        else:
            last = n - 1
        self.reencoded += len(pieces)
        self._replace(first, last, pieces)

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        leaves, slots = self.levels[0], last - first + 1
        if len(pieces) > 2 * LEAF * slots:
            fresh = np.array(self._leaves(pieces), np.int64).reshape(3, -1)
            self._build(*np.concatenate([leaves[:, :first], fresh, leaves[:, last + 1 :]], 1))
            return
        sums = np.zeros((3, len(pieces) + 1), np.int64)
        sums[:, 1:] = np.cumsum([list(map(len, pieces)), [1] * len(pieces), self.count(pieces)], axis=1)
        leaves[:, first : last + 1] = np.diff(sums[:, np.arange(slots + 1) * len(pieces) // slots], axis=1)
        low, high = first // 2, last // 2  # only paths to the root change
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            level[:, low : high + 1] = self._above(below[:, 2 * low : 2 * high + 2])
            low, high = low // 2, high // 2


def sample_edits(text: str) -> list[Edit]:
    """The query's edits, from the text's length alone: a cut, an insertion, a replacement at the end."""
    n = len(text)
    return [(n // 4, n // 4 + 17, ""), (n // 2, n // 2, " [edited 2024]"), (max(n - 20, 0), max(n - 10, 0), "isn't it?")]


def count_tokens(docs: DataFrame, edits: Callable[[str], Iterable[Edit]] = sample_edits, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row before and after its edits, and the pre-tokens that edits made to encode again.

    One pass, no shuffle.  ``edits`` gives a text's edits in the order in which they are made.
    """

    bounded(docs.sparkSession)

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for text in part.column("text").to_pylist():
                    tree = TokenTree(text or "", count)
                    before = tree.n_pretokens, tree.n_tokens
                    if text:
                        for e in edits(text):
                            tree.edit(*e)
                    out.append((*before, tree.n_pretokens, tree.n_tokens, tree.reencoded))
                yield pa.record_batch([part.column("id"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=["id", "n_pretokens", "n_tokens", "n_pretokens_after", "n_tokens_after", "n_reencoded"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n_pretokens long, n_tokens long, n_pretokens_after long, n_tokens_after long, n_reencoded long")
    return out.withColumnRenamed("id", id_col)


_LEAVES = ("leaf_chars", "leaf_pretokens", "leaf_tokens")
_KEPT = f"id {{}}, text string, {', '.join(f'{c} array<long>' for c in _LEAVES)}, n_reencoded long"


def _kept(ids: pa.Array, trees: list[TokenTree]) -> pa.RecordBatch:
    leaves = zip(*(t.leaves for t in trees), strict=True)
    columns = [pa.array([t.text for t in trees], pa.string()), *(pa.array(c, pa.list_(pa.int64())) for c in leaves), pa.array([t.reencoded for t in trees], pa.int64())]
    return pa.record_batch([ids, *columns], names=["id", "text", *_LEAVES, "n_reencoded"])


def plant(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept trees of all rows: ``id_col``, text (null: empty), the leaves' characters, pre-tokens and tokens, and
    n_reencoded, 0 here.  Write it: ``edit_trees`` starts from the table."""
    bounded(docs.sparkSession)

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield _kept(part.column("id"), [TokenTree(t or "", count) for t in part.column("text").to_pylist()])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, _KEPT.format(dict(source.dtypes)["id"])).withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """The trees of ``plant`` or of an earlier call after ``edits`` (``id_col``, seq, start, end, new), made in order of seq.

    n_reencoded says how many pre-tokens that took.  Edits are gathered by document and meet the trees by one
    equi-join; trees without edits pass as they are.
    """
    bounded(trees.sparkSession)
    made = edits.where("start is not null and end is not null").select(
        F.col(id_col).alias("_id"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), F.coalesce("new", F.lit("")).alias("new")).alias("e"))
    made = made.groupBy("_id").agg(F.array_sort(F.collect_list("e")).alias("edits"))
    source = trees.select(F.col(id_col).alias("id"), "text", *_LEAVES)
    source = source.join(made, F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id")

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for text, *leaves, todo in zip(*(part.column(c).to_pylist() for c in ("text", *_LEAVES, "edits")), strict=True):
                    tree = TokenTree(text, count, leaves)
                    for e in todo or ():
                        tree.edit(e["a"], e["b"], e["new"])
                    out.append(tree)
                yield _kept(part.column("id"), out)

    return source.mapInArrow(run, _KEPT.format(dict(source.dtypes)["id"])).withColumnRenamed("id", id_col)


def counts(trees: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_pretokens and n_tokens of kept trees, from their leaves."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    return trees.select(id_col, total("leaf_pretokens").alias("n_pretokens"), total("leaf_tokens").alias("n_tokens"))
