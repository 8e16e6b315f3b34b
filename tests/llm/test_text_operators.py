"""Each operator against brute force on small, awkward tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from datetime import date

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B
from linkloom.llm import chat, decontaminate, mixture, ngram_join, quality_rules, suffix_dedup, token_counts, toxicity, url_lists, warc
from linkloom.llm._workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, size int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, 3, None) for i, t, s in rows], DOCS)


def prose(rng, n, words=400):
    vocabulary = [f"w{rng.randrange(words)}{'é' if rng.random() < 0.1 else ''}" for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120)), f"s{rng.randrange(3)}") for i in range(n)]
    base = rows[5][1].split() + prose(rng, 80).split()
    for k in range(12):  # near copies
        near = base[:]
        for _ in range(k // 3):
            near[rng.randrange(len(near))] = f"new{k}"
        rows.append((100 + k, " ".join(near), "s1"))
    rows += [(200, rows[6][1], None), (201, rows[6][1].upper(), "s2"), (202, None, "s0"), (203, "", "s0"), (204, " \n\t ", "s0"), (205, "one", "s0"), (206, "one", "s0"), (207, "one two", "s1"), (208, "ONE  two", "s1")]
    rows += [(209, rows[7][1] + " " + " ".join(["tail"] * 3000), "s2"), (9, rows[9][1], rows[9][2]), (None, rows[8][1], "s0"), (None, "nothing like it at all here", "s0"), (8, "a second text of an id that repeats here", "s1")]
    return rows


def shingle_sets(rows, k):
    out = []
    for _, t, _ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    return out


def components_by_force(rows, k, num, den):
    sets = shingle_sets(rows, k)
    node = [("id", r[0]) if r[0] is not None else ("row", i) for i, r in enumerate(rows)]
    up = {n: n for n in node}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and sets[i] and sets[j] and both * den >= num * union:
                up[root(node[i])] = root(node[j])
    least = {}
    for n in up:
        if n[0] == "id":
            r = root(n)
            least[r] = min(least.get(r, n[1]), n[1])
    return [(r[0], len(s), least.get(root(n)) if s else r[0]) for r, s, n in zip(rows, sets, node, strict=True)]


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_groups(spark, k, num, den):
    rows = corpus()
    got = ngram_join.ngram_jaccard_groups(docs(spark, rows), k, num, den)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(components_by_force(rows, k, num, den), key=repr)


def test_ngram_groups_of_many_near_copies(spark):
    rng = random.Random(1)
    base = prose(rng, 150, 2000).split()
    rows = []
    for i in range(150):  # a chain: each differs a little more from the first
        near = base[:]
        for x in range(i // 3):
            near[(x * 7) % 150] = f"v{x}"
        rows.append((1000 - i, " ".join(near), "s"))
    got = {tuple(r) for r in ngram_join.ngram_jaccard_groups(docs(spark, rows), 3, 9, 10).collect()}
    assert got == set(components_by_force(rows, 3, 9, 10))


def links_by_force(rows, k, num, den):
    sets = shingle_sets(rows, k)
    return [sum(i != j and bool(s & t) and len(s & t) * den >= num * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5), (3, 1, 3), (3, 1, 1)])
@pytest.mark.parametrize("irregular", [True, False])
def test_ngram_links(spark, k, num, den, irregular):
    rows = corpus()
    if not irregular:  # unique ids
        rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    expected = [(*c, n) for c, n in zip(components_by_force(rows, k, num, den), links_by_force(rows, k, num, den), strict=True)]
    got = ngram_join.ngram_jaccard_links(docs(spark, rows), k, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_ngram_links_of_many_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 150, 2000).split()
    rows = []
    for i in range(150):  # a chain, and copies that each differ from the first
        near = base[:]
        for x in range(i // 3):
            near[(x * 7) % 150] = f"v{x}"
        rows.append((1000 - i, " ".join(near), "s"))
        near = base[:]
        for x in range(i % 4):
            near[rng.randrange(150)] = f"u{i}-{x}"
        rows.append((2000 + i, " ".join(near), "s"))
    got = {(r["doc_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_links(docs(spark, rows), 3, 9, 10).collect()}
    assert got == {(r[0], n) for r, n in zip(rows, links_by_force(rows, 3, 9, 10), strict=True)}


def test_keep_one(spark):
    rows = [r for r in corpus() if r[0] is not None]
    table = docs(spark, rows)
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    expected = components_by_force(rows, 5, 4, 5)
    assert len({r["doc_id"] for r in kept.collect()} - {9, 8}) == len({c for i, n, c in expected if n} | {i for i, n, _ in expected if not n} - {None}) - len({9, 8} & {c for _, _, c in expected})
    assert ngram_join.keep_one(docs(spark, corpus())).count() > 0  # null and repeated ids


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert ngram_join.ngram_jaccard_groups(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.filter_docs(none, bench).count() == 0
    assert quality_rules.judge(none).count() == 0 and quality_rules.filter_docs(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert suffix_dedup.repeats(none).count() == 0 and suffix_dedup.strip_repeats(none).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert mixture.mix_sources(none).count() == 0
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    entries = spark.createDataFrame([], "pattern string, at date, action string")
    assert url_lists.judge(spark.createDataFrame([], "page_id long, url string, fetched date"), entries).count() == 0


def measured_by_force(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark):
    rng = random.Random(2)
    rows = corpus() + [(300 + i, "".join(rng.choice(["a b c\n", "x|y ", "é ", "\n", "\r\n", "same line\n", " ", "q# w$ "]) for _ in range(rng.randint(0, 60))), "s") for i in range(60)]
    got = quality_rules.judge(docs(spark, rows)).collect()
    assert sorted([tuple(r)[:7] for r in got], key=repr) == sorted([(i, *measured_by_force(t)) for i, t, _ in rows], key=repr)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_posterior_tells_junk(spark):
    rng = random.Random(4)
    good = [(i, ". ".join(prose(rng, 12) for _ in range(8)), "s") for i in range(120)]
    junk = [(500 + i, " ".join(w + "***$$$" for w in prose(rng, 90).split()), "s") for i in range(25)]
    kept = {r["doc_id"] for r in quality_rules.judge(docs(spark, good + junk)).where("kept").collect()}
    assert kept == {i for i, _, _ in good}
    assert {r["doc_id"] for r in quality_rules.filter_docs(docs(spark, good + junk)).collect()} == kept


def test_em_against_a_plain_one():
    """Expectation-maximisation document by document, without patterns."""
    rng = random.Random(12)
    r = len(quality_rules.RULES)
    rows = []
    for _ in range(1500):  # bad documents, a tenth, fail two rules each; the last rule votes at random
        bad = rng.random() < 0.1
        which = rng.sample(range(r - 1), 2)
        rows.append([rng.randint(0, 2) if i == r - 1 else 1 if bad and i in which else 1 if rng.random() < 0.01 else 2 if rng.random() < 0.95 else 0 for i in range(r)])
    good = [0.9 / 3.0 ** v.count(1) for v in rows]
    for _ in range(200):
        prior = [(sum(1 - g for g in good) + 1) / (len(rows) + 2), (sum(good) + 1) / (len(rows) + 2)]
        rate = [[[quality_rules.BELIEF * quality_rules.EXPECTED[c][v] + sum((g if c else 1 - g) for g, x in zip(good, rows, strict=True) if x[i] == v) for v in range(3)] for i in range(r)] for c in range(2)]
        rate = [[[x / sum(of) for x in of] for of in each] for each in rate]
        odds = [math.log(prior[0] / prior[1]) + sum(math.log(rate[0][i][v] / rate[1][i][v]) for i, v in enumerate(x)) for x in rows]
        new = [1 / (1 + math.exp(min(max(o, -500), 500))) for o in odds]
        done, good = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9, new
        if done:
            break
    codes = [sum(v * 3 ** (r - 1 - i) for i, v in enumerate(x)) for x in rows]
    fitted = quality_rules.fit(dict(Counter(codes)))
    assert all(abs(fitted[c] - g) < 1e-6 for c, g in zip(codes, good, strict=True))


def removed_by_force(rows, length):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in raws:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def repeat_corpus():
    rng = random.Random(8)
    passage = prose(rng, 120)
    rows = corpus()
    for k in range(30):  # a shared passage in different surroundings, cut at different places
        rows.append((400 + k, prose(rng, rng.randint(0, 60)) + " " + passage[k * 3 : len(passage) - k * 5] + " " + prose(rng, rng.randint(0, 60)), "s"))
    rows += [(450, "ab" * 700, "s"), (451, "x" * 450, "s"), (452, passage[:420] + "!" + passage[:420], "s"), (453, "é" * 300 + prose(rng, 30), "s"), (454, prose(rng, 30) + "é" * 250, "s"), (455, "\0" * 500 + "z" * 5, "s")]
    return rows


@pytest.mark.parametrize("most", [suffix_dedup.MOST_CONTEXTS, 4])
def test_repeats(spark, most):
    """The second case cuts every key with more than four contexts into shards."""
    rows = repeat_corpus()
    got = suffix_dedup.repeats(docs(spark, rows), 400, most_contexts=most)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(removed_by_force(rows, 400), key=repr)


def test_passages(spark):
    rows = repeat_corpus()
    got = suffix_dedup.repeats(docs(spark, rows), 400, most_contexts=16, passage=200).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(removed_by_force(rows, 400), key=repr)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_passage_bytes"]) for r in got) == Counter(r[:3] for r in removed_by_force(rows, 200))
    with pytest.raises(ValueError, match="at least"):
        suffix_dedup.repeats(docs(spark, rows), 48)


def test_strip_repeats(spark):
    rows = [r for r in repeat_corpus() if r[0] not in (450, 451, 455)]
    table = docs(spark, rows).withColumn("t1", F.lit(1)).withColumn("kept", F.lit("clash"))
    left = suffix_dedup.strip_repeats(table, 400)
    assert left.columns == table.columns and {r["kept"] for r in left.select("kept").distinct().collect()} == {"clash"}
    lost = {(i, n - gone) for i, n, gone, _, _ in removed_by_force(rows, 400) if gone}
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    for i, size in lost:
        if i in texts and i is not None and i not in (8, 9):
            assert size - 6 <= len(texts[i].encode()) <= size


def python_steps_of_a_stage(df):
    """The most Python steps that one task of the plan of ``df`` passes rows through; each has a worker of its own."""
    most = 0

    def walk(node):
        nonlocal most
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        here = (max(below, default=0) if name == "Union" else sum(below)) + ("InArrow" in name)
        most = max(most, here)
        return 0 if "Exchange" in name else here

    walk(df._jdf.queryExecution().executedPlan())
    return most


def test_repeats_need_one_worker_a_core(spark, monkeypatch):
    steps = {}

    def noted(put):
        def run(ws, df, name="result"):
            steps[name] = python_steps_of_a_stage(df)
            return put(ws, df, name) if name != "result" else put(ws, df)

        return run

    for name in ("table", "finish"):
        monkeypatch.setattr(Workspace, name, noted(getattr(Workspace, name)))
    table = docs(spark, repeat_corpus())
    assert suffix_dedup.strip_repeats(table, 200).count()
    assert {"texts", "found", "result"} <= set(steps) and max(steps.values()) == 1
    steps.clear()
    assert suffix_dedup.repeats(table, 400, passage=200).count()
    assert {"texts", "rows"} <= set(steps) and max(steps.values()) == 1


def test_suffix_array_and_kasai():
    rng = random.Random(5)
    for _ in range(40):
        strings = ["".join(rng.choice("ab\0") for _ in range(rng.randint(0, 40))).encode() for _ in range(rng.randint(1, 9))]
        text = np.frombuffer(b"".join(strings), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        if not len(text):
            continue
        order, rank = suffix_dedup.suffix_array(text, bounds)
        suffix = [bytes(text[p : bounds[o + 1]]) for p, o in enumerate(B.owners(np.arange(len(text)), bounds))]
        assert order.tolist() == sorted(range(len(text)), key=lambda p: (suffix[p], p))
        lcp = suffix_dedup.kasai(text, bounds, order, rank)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while n < min(len(suffix[a]), len(suffix[b])) and suffix[a][n] == suffix[b][n]:
                n += 1
            assert lcp[b] == n


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 40, 900)) for k in range(12)] + [(50, "too short"), (51, None), (None, prose(rng, 40, 900))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def noisy(s):
        out = list(s)
        for _ in range(len(out) // 30):
            out[rng.randrange(len(out))] = rng.choice("qz")
        return "".join(out)

    rows = [(k, prose(rng, 60) + " " + (noisy(t).upper() if k % 2 else t) + " " + prose(rng, 50), "s") for k, t in items[:12]]
    rows += [(100 + k, prose(rng, 200), "s") for k in range(20)] + [(200, None, "s"), (201, "", "s"), (None, items[3][1], "s")]
    got = decontaminate.leaks(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(12)} | {(None, 3)}
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"]).encode()
        assert 0 <= r["start"] < r["stop"] <= len(text)
    kept = decontaminate.filter_docs(docs(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {100 + k for k in range(20)} | {200, 201}


def test_short_items_stand_as_words(spark):
    items = ["q7", "zz top", "too short by far", "x" * 10, "?!", "Q7."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["Q7", "a q7, b", "q77 aq7 q 7", "the zz  TOP!", "azz top", "zz topped", "is too short, by far", "is too short by fare", "x" * 10, "x" * 11, "too short by fa", "", "q7 zz top q7"]
    plain = [" " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " " for t in texts]
    wanted = {(k, j) for k, t in enumerate(plain) for j, i in enumerate(items) if (w := " ".join("".join(c if c.isalnum() else " " for c in i.lower()).split())) and f" {w} " in t}
    got = decontaminate.leaks(docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == wanted and len(got) == len(wanted)
    for r in got:
        assert 0 <= r["start"] < r["stop"] <= len(texts[r["doc_id"]])


def test_lemma_and_alignment_against_force():
    """Every region within the budget is found: windows of one item against all places of a text."""
    rng = random.Random(9)

    def distance(a, b):  # of a against the best stretch of b
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(25):
        item = "".join(rng.choice("abcdefgh ") for _ in range(100)).strip().replace("  ", " x")
        near = list(item)
        for _ in range(rng.randint(0, 16)):
            at = rng.randrange(len(near))
            near[at] = rng.choice(["", "q", near[at] + "z"])
        text = "".join(rng.choice("ijklmn ") for _ in range(80)) + "".join(near) + "".join(rng.choice("ijklmn ") for _ in range(80))
        w = decontaminate.Windows([(1, item)], 0.1)
        raw = np.frombuffer(text.encode(), np.uint8)
        norm = bytes(decontaminate.normalise(raw, np.array([0, len(raw)]))[0])
        expected = {k for k in range(len(w.size)) if distance(bytes(w.bytes[k]), norm) <= w.edits[k]}
        assert set(decontaminate.matches(w, raw, np.array([0, len(raw)]))["window"].tolist()) == expected


def test_token_trees():
    count = token_counts.counter(token_counts.VOCABULARY)
    rng = random.Random(1)
    pieces = ["a", "b", " ", "  ", "\n", " \n ", "'s", "'", "ll", "'ll", "1", "23", "é", "!", "?!", " the", " word", "का", " ", "<|endoftext|>"]

    def whole(s):
        found = regex.findall(token_counts.PATTERN, s)
        return len(found), sum(count(found))

    for _ in range(400):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 900)))
        tree = token_counts.TokenTree(s, count)
        for _ in range(4):
            a = rng.randint(0, len(s))
            b, new = a + rng.randint(0, 20), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
            s = s[:a] + new + s[b:]
            tree.edit(a, b, new)
            assert (tree.text, tree.n_pretokens, tree.n_tokens) == (s, *whole(s))


def test_token_counts_against_a_whole_encoder():
    """The public library splits and encodes whole texts by itself."""
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    encoder = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count, rng = token_counts.counter(token_counts.VOCABULARY), random.Random(2)
    for _, text, _ in corpus(5, 30):
        tree = token_counts.TokenTree(text or "", count)
        assert tree.n_tokens == len(encoder.encode_ordinary(tree.text))
        for _ in range(3):
            at = rng.randint(0, len(tree.text))
            tree.edit(at, at + rng.randint(0, 9), rng.choice(["", " é1", "isn't it?", "\n\n  "]))
            assert tree.n_tokens == len(encoder.encode_ordinary(tree.text))


def test_kept_token_trees(spark, tmp_path):
    count, rng = token_counts.counter(token_counts.VOCABULARY), random.Random(5)
    words = ["the", "isn't", "  ", "x1", "\n", "é", "東京", "...", "longer words"]
    rows = [(i, None if i == 3 else " ".join(rng.choices(words, k=rng.choice([0, 1, 40, 900])))) for i in range(30)] + [(7, "a copy of an id"), (None, "no id at all")]
    path = str(tmp_path / "trees")
    token_counts.plant(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(path)
    kept = spark.read.parquet(path)
    edits = []
    for i, _ in rows:
        for seq in range(rng.choice([0, 1, 6])):
            a = rng.randrange(0, 3000)
            edits.append((i, seq, a, a + rng.choice([0, 3, 400]), rng.choice([None, "", " new words here", "y" * 50, "\n " * 200])))
    edits += [(99, 0, 0, 1, "of no tree"), (1, 9, None, 4, "no start")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start long, end long, new string")
    expected = []
    for i, text in rows:
        text = text or ""
        for _, a, b, new in sorted(((s, a, b, new or "") for d, s, a, b, new in edits if d == i and a is not None), key=lambda e: e[:4]):
            a = min(a, len(text))
            text = text[:a] + new + text[max(min(b, len(text)), a) :]
        tree = token_counts.TokenTree(text, count)
        expected.append((i, text, tree.n_pretokens, tree.n_tokens))
    changed = token_counts.edit_trees(kept, table).persist()
    got = [(r["doc_id"], r["text"], sum(r["leaf_pretokens"]), sum(r["leaf_tokens"])) for r in changed.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert sorted(((r[0], r[1], r[2]) for r in token_counts.counts(changed).collect()), key=repr) == sorted(((i, p, t) for i, _, p, t in expected), key=repr)
    assert token_counts.edit_trees(kept, table.limit(0)).where("n_reencoded > 0").count() == 0
    assert token_counts.edit_trees(kept.limit(0), table).count() == 0


def test_edits_change_paths_only():
    """Many edits of a long text keep the tree's shape, and encode little."""
    count, rng = token_counts.counter(token_counts.VOCABULARY), random.Random(6)
    tree = token_counts.TokenTree("some words of a long text, " * 4000, count)
    shape = [x.shape for x in tree.levels]
    for _ in range(200):
        a = rng.randrange(len(tree.text))
        tree.edit(a, a + rng.randrange(12), rng.choice(["", "in", " two words"]))
    assert [x.shape for x in tree.levels] == shape
    assert tree.reencoded < 200 * 6 * token_counts.LEAF
    whole = token_counts.TokenTree(tree.text, count)
    assert (tree.n_pretokens, tree.n_tokens) == (whole.n_pretokens, whole.n_tokens)
    for below, above in zip(tree.levels, tree.levels[1:]):
        assert (token_counts.TokenTree._above(below) == above).all()


def test_token_counts_query(spark):
    rows = corpus()
    count = token_counts.counter(token_counts.VOCABULARY)

    def whole(s):
        found = regex.findall(token_counts.PATTERN, s)
        return len(found), sum(count(found))

    expected = []
    for i, t, _ in rows:
        after = t or ""
        for a, b, new in token_counts.sample_edits(after) if after else ():
            a = min(a, len(after))
            after = after[:a] + new + after[max(min(b, len(after)), a) :]
        expected.append((i, *whole(t or ""), *whole(after)))
    got = token_counts.count_tokens(docs(spark, rows)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(expected, key=repr)


def test_chat(spark):
    say = lambda c, *texts: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows = say(1, "hi") + say(2, "hi", "yes") + say(3, "hi", "yes", "no") + say(4, "hi", "yes", "no") + say(5, "hi", "other") + say(6, None, "x") + say(7, "", "x") + say(None, "alone")
    rows += [(8, 0, None, "t"), (8, 0, None, "t")] + [(9, k, "user", f"long {k}") for k in range(2500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = chat.render(table).collect()
    assert {r["conv_id"] for r in got} == {3, 5, 6, 7, 8, 9, None}
    assert [r["rendered"] for r in got if r["conv_id"] == 3] == ["<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nno<|end|>\n"]
    parts = sorted((r["part"], r["rendered"]) for r in got if r["conv_id"] == 9)
    assert [p for p, _ in parts] == [0, 1, 2]
    assert "".join(x for _, x in parts) == "".join(f"<|user|>\nlong {k}<|end|>\n" for k in range(2500))


def test_toxicity_learns(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(rng, rng.randint(30, 90)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (None, "vile rotten vile", "s")]
    labels += [(None, 1), (3, None), (5, 0), (5, 0)]
    table = docs(spark, rows)
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int").where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score(table, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    known = dict(labels[:600])
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 60 and np.mean([(r["score"] >= 0.5) == known[r["doc_id"]] for r in held]) > 0.95


def test_ftrl_against_a_plain_one():
    """The same rule, feature by feature in plain Python."""
    rng = random.Random(4)
    examples = [(y, np.unique(np.array([rng.randrange(40) + (100 * y if rng.random() < 0.7 else 0) for _ in range(rng.randint(1, 25))], np.uint64))) for y in (rng.randint(0, 1) for _ in range(200))]
    z, n = Counter(), Counter()

    def weight(f):
        l1 = 0.0 if f is None else toxicity.L1
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - (l1 if z[f] > 0 else -l1)) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(toxicity.EPOCHS):
        for e in order.permutation(len(examples)):
            y, fs = examples[e][0], [*examples[e][1].tolist(), None]
            w = {f: weight(f) for f in fs}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in fs:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA * w[f]
                n[f] += g * g
    names, weights, bias = toxicity.ftrl(examples)
    plain = {f: weight(f) for f in z if f is not None and weight(f)}
    assert plain.keys() == set(names.tolist()) and len(plain) < 80
    assert all(abs(plain[f] - w) < 1e-5 for f, w in zip(names.tolist(), weights.tolist(), strict=True))
    assert abs(bias - weight(None)) < 1e-9


def test_clashing_helper_names(spark):
    rows = [(1, "a b c d e f g h", "s"), (None, "a b c d e f g h", "s"), (2, "other words than these are here", "s")]
    table = docs(spark, rows).withColumns({"_row": F.lit("mine"), "_slot": F.lit("mine"), "_MIX": F.lit("mine"), "_of": F.lit("mine")})
    for left in (ngram_join.keep_one(table), mixture.mix_texts(table)):
        assert {"_row", "_slot", "_MIX", "_of"} <= set(left.columns)
        assert {tuple(r) for r in left.select("_row", "_slot", "_MIX", "_of").collect()} <= {("mine",) * 4}


def test_mixture(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(0, 400)), rng.choice(["b", "b", "b", "a", "é", "z", None])) for i in range(500)] + [(None, "a b c", "a"), (3, "again here", "a"), (3, "again here", "a"), (700, None, "only null")]
    table = docs(spark, rows)
    got = mixture.mix_sources(table, shard_docs=40, block_words=8).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixture.mix_sources(table.repartition(7), shard_docs=40, block_words=8).collect()), key=repr)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(sources, [3, 1, 2] * 9, strict=False))
    open_, left, target = set(sources), 1.5 * sum(sizes.values()), {}
    while open_:  # the excess of full sources is dealt out again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    by_id = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    taken, near = Counter(), {}
    for r in got:
        s = by_id[r["doc_id"], r["size"]]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
        near[s] = r["target"]
    for s, t in near.items():
        assert abs(taken[s] - t) <= 8 * (4 + sum(x[2] == s for x in rows) / 40), (s, taken[s], t)


def test_mix_is_listed(spark):
    rng = random.Random(12)
    rows = [(i, f" {prose(rng, rng.randint(0, 90))}\n", rng.choice(["a", "b", "b", "c", "c"])) for i in range(200)] + [(3, "again \t here", "a"), (None, "a  b c", "b"), (500, None, "c"), (501, " ", "a")]
    table = docs(spark, rows)
    how = {"shard_docs": 60, "block_words": 8}
    words = {(i, len(WORD.findall(t or ""))): WORD.findall(t or "") for i, t, _ in rows}
    spans = mixture.mix_spans(table, **how).collect()
    counts = {}
    for r in spans:
        times = [0] * r["size"]
        for a, b, n in r["spans"]:
            assert 0 <= a < b <= r["size"] and 1 <= n <= 2 and b - a <= max(8, r["size"] * (n == 2 or len(r["spans"]) == 1)) and not any(times[a:b])
            times[a:b] = [n] * (b - a)
        counts[r["doc_id"], r["size"]] = times
    assert len(spans) == len(rows) and {n for c in counts.values() for n in c} == {0, 1, 2}
    assert {(r["doc_id"], r["size"]): r["taken"] for r in mixture.mix_sources(table, **how).collect()} == {k: sum(c) for k, c in counts.items()}
    for some in (table, table.where("doc_id is not null and size(split(text, ' ')) > 3")):  # the second has no id twice
        whole = {(r["doc_id"], r["size"]): r["spans"] for r in mixture.mix_spans(some, **how).collect()}
        got = mixture.mix_texts(some, **how).collect()
        assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(k for k, v in whole.items() if v and k[0] is not None)
        for r in got:
            times = [0] * r["size"]
            for a, b, n in whole[r["doc_id"], r["size"]]:
                times[a:b] = [n] * (b - a)
            mine = words[r["doc_id"], r["size"]]
            assert WORD.findall(r["text"]) == [w for p in (1, 2) for w, n in zip(mine, times, strict=True) if n >= p]
            assert r["taken"] == sum(times) > 0 and r["n_chars"] == len(r["text"])
            if set(times) == {1}:
                assert r["text"] in {t for _, t, _ in rows}


def test_seats_are_the_highest_quotients(spark):
    rng = random.Random(12)
    votes = [(f"p{k}", float(rng.choice([0, 1, 3, 10, 50, 400, 1000])), rng.randrange(2)) for k in range(40)]
    table = spark.createDataFrame(votes, "name string, votes double, grp int").withColumn("total", F.lit(57).cast("long"))
    got = {(r["grp"], r["name"]): r["quota"] for r in mixture.seats(table, ["grp"], "votes", "total", ["name"]).collect()}
    for g in (0, 1):
        mine = sorted((n, v) for n, v, x in votes if x == g)
        best = sorted(((-v / (2 * k + 1), n) for n, v in mine if v for k in range(60)))[:57]
        won = Counter(n for _, n in best)
        assert {n: won[n] for n, _ in mine} == {n: got[g, n] for n, _ in mine}


def test_url_lists(spark):
    day = lambda k: date(2024, 1, k)
    history = [("Bad.example", day(5), "add"), ("bad.example", day(10), "remove"), ("bad.example", day(20), "add"), ("x.org/shop", day(3), "add"), ("odd.net", day(4), "remove"), ("both.net", day(6), "add"), ("both.net", day(6), "remove"), (None, day(1), "add")]
    entries = spark.createDataFrame(history, "pattern string, at date, action string")
    urls = ["http://bad.example/a", "https://u:p@www.BAD.example:80/a?b#c", "http://notbad.example/", "http://x.org/shop/item", "http://x.org/shopping", "http://x.org/shop", "http://odd.net", "http://both.net/", "nonsense", None]
    rows = [(100 * k + d, u, day(d)) for k, u in enumerate(urls) for d in (3, 4, 5, 9, 10, 19, 20, 25)] + [(1, "http://bad.example/a", None), (1, "http://bad.example/a", day(5)), (1, "http://bad.example/a", day(5))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("pattern", F.lit("clash"))

    def force(u, d):
        if u is None or d is None or "://" not in u:
            return 0
        host, _, path = u.split("://", 1)[1].partition("/")
        host = host.split("@")[-1].split(":")[0].lower()
        bad = (host == "bad.example" or host.endswith(".bad.example")) and (day(5) <= d < day(10) or d >= day(20))
        shop = host == "x.org" and path.split("?")[0].split("/")[0] == "shop" and d >= day(3)
        return int(bad) + int(shop)

    for most in (url_lists.MOST_BROADCAST, 0):  # by broadcast, and by a salted shuffle
        got = url_lists.judge(captures, entries, most).collect()
        assert sorted([(r["page_id"], r["n_active"], r["blocked"]) for r in got]) == sorted([(p, force(u, d), force(u, d) > 0) for p, u, d in rows])


def test_url_paths_below_domains(spark):
    entries = spark.createDataFrame([(p, date(2024, 1, 1), "add") for p in ("example.com/spam", "HTTPS://u@Shop.org:8080/Deals/?q#f", "http://plain.net./")], "pattern string, at date, action string")
    urls = {"http://www.example.com/spam/x": 1, "http://example.com/spam": 1, "http://www.example.com/spammer": 0, "http://notexample.com/spam": 0, "http://a.shop.org/deals": 1, "http://shop.org/": 0, "http://plain.net/a": 1}
    captures = spark.createDataFrame([(k, u, date(2024, 1, 2)) for k, u in enumerate(urls)], "page_id long, url string, fetched date")
    assert {r["url"]: r["n_active"] for r in url_lists.judge(captures, entries).collect()} == urls


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    rows = [(5, "http://a/ b", "<p>same é</p>"), (3, "http://b", "<p>same é</p>"), (9, None, "<p>same é</p>"), (1, "http://c", None), (2, "http://d", ""), (7, "u", "x" * 100_000), (3, "http://b", "<p>same é</p>"), (None, "n", "alone"), (None, "n", "<p>same é</p>"), (8, "u", "tiny"), (4, "u", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).repartition(3)
    got = sorted(map(tuple, warc.round_trip(spark, pages, least).collect()), key=repr)
    least_of = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= least:
            least_of.setdefault(raw, []).append(i)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = min(least_of.get(raw, [i]), key=lambda x: (x is None, x or 0))
        expected.append((i, len(raw), digest, "response" if first == i else "revisit", None if first == i else first))
    # a row that repeats the response's id is a revisit of it
    again = next(k for k, e in enumerate(expected) if e[0] == 3)
    expected[again] = (*expected[again][:3], "revisit", 3)
    assert got == sorted(expected, key=repr)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, s) for i, t, s in repeat_corpus() if i is not None]
    docs(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        last = table.count()
        table = stage(spark, table, str(tmp_path))
        assert set(corpus_pipeline.COLUMNS) <= set(table.columns) and table.count() <= last, name
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in table.collect())


def test_pipeline_against_force(spark, tmp_path):
    """Each stage's rows, from plain Python on the stage's own input."""
    import corpus_pipeline

    rng = random.Random(31)
    passage, item = prose(rng, 60, 4000), prose(rng, 50, 4000)
    rows = [(k, prose(rng, rng.randint(90, 160), 4000), "ab"[k % 2]) for k in range(24)]
    for k in range(24, 30):  # a passage in different surroundings
        rows.append((k, prose(rng, 90, 4000) + " " + passage + " " + prose(rng, 70, 4000), "c"))
    for k in range(30, 34):  # near copies: one word differs
        words = rows[k - 30][1].split()
        words[40] = "otherwise"
        rows.append((k, " ".join(words), "a"))
    rows += [(34, prose(rng, 80, 4000) + "\n" + item.upper() + "\n" + prose(rng, 80, 4000), "b"), (35, "buy now! " * 60, "b"), (36, "too short", "a"), (37, None, "a"), (38, "", None)]
    docs(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found, table = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
        found[name] = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    quality, near, repeats, leaks, mixed = found.values()
    assert {r[0] for r in quality} == set(range(35))
    assert sorted(r[0] for r in near) == sorted(i for i, _, least in components_by_force(quality, 5, 4, 5) if i == least)
    assert {30, 31, 32, 33}.isdisjoint(r[0] for r in near)
    left = {i: digest for i, size, gone, _, digest in removed_by_force(near, 200) if gone < size}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _ in repeats} == left
    assert all(passage not in t for _, t, _ in repeats) and sum(passage in t for _, t, _ in near) == 6
    assert sorted(leaks) == sorted(r for r in repeats if item.lower() not in r[1].lower()) and 34 not in {r[0] for r in leaks}
    before, sums = {i: (len(WORD.findall(t)), source) for i, t, source in leaks}, Counter()
    for r in table.collect():
        size, source = before[r["doc_id"]]
        assert r["size"] == size and r["taken"] == len(WORD.findall(r["text"])) <= 2 * size and r["n_chars"] == len(r["text"])
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(dict((i, t) for i, t, _ in leaks)[r["doc_id"]]))
        sums[source, r["target"]] += r["taken"]
    assert all(abs(n - target) <= 64 for (_, target), n in sums.items())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in whole.collect()) == sorted(mixed)
