"""Jaccard join, passages and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, jaccard_join, passage_dedup
from tessera.llm import textkit as K
from tests.llm.conftest import DOCS, make_docs, prose, space_words


def shingle_set(text):
    w = space_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """Component of each row by comparing all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    union = components.Union()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                union.join(i, j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[union.root(i)] += [r[0]] if r[0] is not None else []
    return sorted(((r[0], len(s), min(least[union.root(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, docs, small, monkeypatch):
    if small:  # every list is long, lists are split, blocks are small
        for name, value in {"PAIR_LIST": 2, "SPLIT_LIST": 2, "OFTEN": 2, "GROUP": 2, "SEARCHED": 500, "RANGE_POSTINGS": 50}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    found = jaccard_join.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(make_docs())


def test_jaccard_random_sets(spark):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(5, 40)).split(" ") for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abc")
        rows.append((i, " ".join(w)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows)


def test_jaccard_empty_and_keep_first(spark, docs, no_docs):
    assert jaccard_join.near_duplicates(no_docs).collect() == []
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    expected = {r[0] for r in brute_components(make_docs()) if r[0] is not None and r[0] == r[2]}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == expected
    assert ids.count(2) == 1 and ids.count(None) == 1  # repeated rows once; a row without an id goes as a copy of document 1


def test_keep_first_tells_texts_of_one_id_apart(spark):
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join([*a.split(" ")[:-1], "changed"])
    rows = [(1, a, "x", "g"), (5, near, "x", "g"), (5, b, "x", "g"), (6, c, "y", "g"), (6, c, "x", "h"), (7, b + " more", "x", "g"), (8, "", "x", "g"), (8, None, "x", "g"), (8, "", "x", "g"), (9, c[::-1], "x", "g"), (9, a[::-1], "x", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, rest string").repartition(3)
    kept = sorted(map(tuple, jaccard_join.keep_first(docs).collect()), key=repr)
    stay = [(1, a, "x", "g"), (5, b, "x", "g"), (6, c, "x", "h"), (8, "", "x", "g"), (8, "", "x", "g"), (8, None, "x", "g"), (9, c[::-1], "x", "g"), (9, a[::-1], "x", "g")]
    assert kept == sorted(stay, key=repr)


def test_members_of_a_list_that_others_can_link_to():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = rng.integers(1, 40, rng.integers(1, 12))
        left = np.array([rng.integers(1, x + 1) for x in n])
        expected = [any(i != j and min(left[i], left[j]) >= jaccard_join.least_overlap(n[i], n[j]) for j in range(len(n))) for i in range(len(n))]
        assert jaccard_join._wanted(n, left, 80).tolist() == expected


def test_windows_that_meet_find_a_partner():
    """Windows of one value and side, with any extents, in tasks of any size: each that meets an earlier one gets such a partner."""
    rng = np.random.default_rng(5)
    for t in range(150):
        least, n = 46, int(rng.integers(2, 14))
        windows = np.zeros(n, passage_dedup._WINDOW)
        windows["value"], windows["sides"], windows["doc"] = 7, 1, rng.permutation(n)
        windows["left"] = [60, 0] * (n // 2) + [60] * (n % 2) if t == 0 else rng.integers(0, 61, n)
        windows["right"] = np.maximum(0, least - 1 - windows["left"].astype(int)) + rng.integers(0, 3, n)
        held, pairs = int(rng.integers(1, n + 1)), []
        sent = []
        for a in range(0, n, held):
            some = windows[a : a + held]
            found, stands, _ = passage_dedup.join_windows(some, least)
            pairs += found.tolist()
            sent.append(some[stands])
        pairs += passage_dedup.join_windows(np.concatenate(sent), least)[0].tolist()
        meets = lambda x, y: min(x["left"], y["left"]) + min(x["right"], y["right"]) + 1 >= least
        by_doc = {int(w["doc"]): w for w in windows}
        assert all(a > b and meets(by_doc[a], by_doc[b]) for a, b in pairs)
        for a in by_doc:
            if any(b < a and meets(by_doc[a], by_doc[b]) for b in by_doc):
                assert any(x == a for x, _ in pairs)


def test_near_passages_are_found(spark):
    """Passages of 70 words with up to two changed words among other text, against the rule by brute force."""
    rng, rows = random.Random(17), []
    for t in range(40):
        passage = prose(rng, 70).split(" ")
        for i in range(3):
            own = list(passage)
            for _ in range(i):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join([*prose(rng, 40).split(" "), *own, *prose(rng, 40).split(" ")])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    found = {r["doc_id"] for r in passage_dedup.find_passages(docs).collect()}
    sequences, wanted = numbered(*[space_words(t) for _, t in rows]), set()
    for a in range(len(rows)):
        for b in range(a):
            x, y = np.array(sequences[a], np.uint32), np.array(sequences[b], np.uint32)
            if len(np.intersect1d(x, y)) >= 37 and passage_dedup.shared_passages(x, y, passage_dedup.shingle_places(y), 46, 0.8):
                wanted.add(a)
    assert len(wanted) >= 60 and len(wanted & found) >= 0.95 * len(wanted)


def test_near_passages_of_a_crowded_group(spark):
    """Two near copies of 54 words among texts that have 40 of these: neither the smallest one nor the one before."""
    rng, rows, wanted = random.Random(29), [], set()
    for t in range(60):
        template = prose(rng, 40).split(" ")
        near = [*prose(rng, 5).split(" "), *template, *prose(rng, 9).split(" ")]
        for i in range(7):
            own = near if i in (2, 5) else template
            if i == 5:
                own, wanted = [*near[:48], f"new{t}", *near[49:]], wanted | {len(rows)}
            rows.append((len(rows), " ".join([*prose(rng, 40).split(" "), *own, *prose(rng, 40).split(" ")])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    found = {(r["doc_id"], r["other_id"]) for r in passage_dedup.find_passages(docs).collect()}
    assert found == {(a, a - 3) for a in wanted}


def test_pairs_of_a_group_by_what_they_have_in_common():
    rng = np.random.default_rng(31)
    for _ in range(100):
        n, similar = int(rng.integers(2, 40)), float(rng.choice([0.3, 0.5, 0.8]))
        group, docs, labels, settled = np.sort(rng.integers(0, 3, n)), rng.permutation(n), rng.integers(0, 4, n), rng.random(n) < 0.5
        tokens = np.zeros((n, 25), np.uint16)
        for row in tokens:
            own = np.unique(np.concatenate([rng.integers(1, 6, 5), rng.integers(1, 60, rng.integers(1, 20))]))
            row[: len(own)] = own
        least = int(rng.integers(8, 20))
        hits = lambda i, j: np.isin(tokens[i], tokens[j][tokens[j] > 0])
        near = lambda i, j: any(hits(i, j)[k:m].mean() >= similar - 1e-9 for k in range(13) for m in range(max(13, k + least), 26))
        wanted = {(docs[i], docs[j]) for i in range(n) for j in range(n) if group[i] == group[j] and docs[j] < docs[i] and (labels[i] != labels[j] or not settled[i]) and near(i, j)}
        pairs, more = passage_dedup.near_pairs(group, docs, settled, labels, tokens, least, similar, 10**6)
        assert set(map(tuple, pairs.tolist())) == wanted and not more
        few, more = passage_dedup.near_pairs(group, docs, settled, labels, tokens, least, similar, 1)
        assert set(map(tuple, few.tolist())) <= wanted and (more or len(few) == len(pairs))


def test_blocks_of_a_group_give_all_its_pairs():
    """A large group is compared in pairs of blocks, so that no task holds it whole."""
    rng, least, similar = np.random.default_rng(41), 12, 0.8
    tokens = rng.integers(1, 60000, 25)[None, :].repeat(60, 0).astype(np.uint16)
    for row in tokens:
        row[rng.integers(0, 25, 4)] = rng.integers(1, 60000, 4)
    docs, labels, settled, block = rng.permutation(60), rng.integers(0, 3, 60), rng.random(60) < 0.5, np.arange(60) % 3
    whole, more = passage_dedup.near_pairs(np.zeros(60, int), docs, settled, labels, tokens, least, similar, 10**6)
    found = set()
    for i in range(3):
        for j in range(i, 3):
            some = np.flatnonzero((block == i) | (block == j))
            side = np.full(len(some), -1) if i == j else (block[some] == j).astype(int)
            pairs, rest = passage_dedup.near_pairs(np.zeros(len(some), int), docs[some], settled[some], labels[some], tokens[some], least, similar, 10**6, side)
            assert not rest and not found & set(map(tuple, pairs.tolist()))
            found |= set(map(tuple, pairs.tolist()))
    assert len(whole) > 300 and not more and found == set(map(tuple, whole.tolist()))


def test_partners_of_a_window_are_tried_in_turn(monkeypatch):
    """Of a large group of near windows no more pairs are compared and given on than a few each."""
    compared, near = [], passage_dedup._Crowd.near
    monkeypatch.setattr(passage_dedup._Crowd, "near", lambda rows, a, b: (compared.append(len(a)), near(rows, a, b))[1])
    rng, n = np.random.default_rng(43), 240
    tokens = rng.integers(1, 60000, 25)[None, :].repeat(n, 0).astype(np.uint16)
    tokens[np.arange(n), rng.integers(0, 25, n)] = np.arange(n)
    each = np.zeros(n, int)
    pairs, more = passage_dedup.near_pairs(each, np.arange(n), each > 0, np.arange(n), tokens, 12, 0.8, passage_dedup.FIRST_TRIED)
    assert more and {a for a, _ in pairs.tolist()} == set(range(1, n))
    assert len(pairs) <= n * passage_dedup.FIRST_TRIED and sum(compared) <= 4 * n * passage_dedup.FIRST_TRIED


@pytest.mark.parametrize("split", [10**6, 2])
def test_large_groups_over_several_tasks(spark, split, monkeypatch):
    """Near copies of templates that many texts have are found, whether a task compares a group whole or in blocks."""
    monkeypatch.setattr(passage_dedup, "SPLIT_ROWS", split)
    monkeypatch.setattr(passage_dedup, "BLOCK_ROWS", 2)
    rng, rows = random.Random(47), []
    for t in range(8):
        template = prose(rng, 40).split(" ")
        near = [*prose(rng, 5).split(" "), *template, *prose(rng, 9).split(" ")]
        for i in range(7):
            own = template if i not in (2, 5) else near if i == 2 else [*near[:48], f"new{t}", *near[49:]]
            rows.append((len(rows), " ".join([*prose(rng, 40).split(" "), *own, *prose(rng, 40).split(" ")])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    found = {(r["doc_id"], r["other_id"]) for r in passage_dedup.find_passages(docs).collect()}
    assert found == {(7 * t + 5, 7 * t + 2) for t in range(8)}


def test_pairs_of_a_group_with_repeated_tokens(monkeypatch):
    """Tokens count once in a stretch, as in the sets that are compared; rows in many groups' ways to their partners."""
    monkeypatch.setattr(passage_dedup, "OFTEN", (2, 4))
    monkeypatch.setattr(passage_dedup, "TURN", 20)
    rng, seen = np.random.default_rng(37), 0
    for _ in range(100):
        n, similar, least = int(rng.integers(2, 30)), 0.8, int(rng.integers(8, 20))
        group, docs, labels, settled = np.sort(rng.integers(0, 2, n)), rng.permutation(n), rng.integers(0, 3, n), rng.random(n) < 0.5
        tokens = np.zeros((n, 25), np.uint16)
        for row in tokens:
            own = np.repeat(rng.integers(1, 9, 25), rng.integers(1, 9, 25))[:25]
            row[: rng.integers(13, 26)] = own[0]
            row[:] = np.where(row > 0, own, 0)
        stretches = [(k, m) for k in range(13) for m in range(max(13, k + least), 26)]
        sets = [[set(row[k:m].tolist()) for k, m in stretches if row[k:m].all()] for row in tokens]
        near = lambda i, j: any(len(x & set(tokens[j].tolist())) >= similar * len(x) for x in sets[i])
        counts = lambda i, j: group[i] == group[j] and docs[j] < docs[i] and (labels[i] != labels[j] or not settled[i])
        pairs, more = passage_dedup.near_pairs(group, docs, settled, labels, tokens, least, similar, 10**6)
        found, every = set(map(tuple, pairs.tolist())), [(i, j) for i in range(n) for j in range(n) if counts(i, j)]
        # equal rows with equal labels stand for each other
        stands = {}
        for i in np.argsort(docs):
            stands.setdefault((group[i], settled[i], labels[i], tokens[i].tobytes()), i)
        kept = set(stands.values())
        wanted = {(docs[i], docs[j]) for i, j in every if i in kept and j in kept and near(i, j)}
        assert wanted <= found <= {(docs[i], docs[j]) for i, j in every} and not more
        seen += len(wanted)
        few, more = passage_dedup.near_pairs(group, docs, settled, labels, tokens, least, similar, 1)
        assert set(map(tuple, few.tolist())) <= found and (more or len(few) == len(pairs))
        assert {a for a, _ in few.tolist() if not settled[docs.tolist().index(a)]} == {a for a, _ in found if not settled[docs.tolist().index(a)]}
    assert seen > 500


def test_a_task_joins_windows_in_small_parts(spark, monkeypatch):
    """What a task holds before it joins windows stays small, as two tasks share an executor's memory with its heap."""
    held, join = [], passage_dedup.join_windows
    monkeypatch.setattr(passage_dedup, "join_windows", lambda windows, least: (held.append(len(windows)), join(windows, least))[1])
    rng = random.Random(41)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": [prose(rng, 800) for _ in range(1000)]})
    docs = spark.createDataFrame([], "doc_id long, text string")
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
    passage_dedup.post_windows(docs, 4, 46)
    assert sum(r.num_rows for r in run[0](iter([batch]))) and len(held) > 1 and max(held) <= 100_000


def test_cut_passages_cuts_only_the_text_it_was_found_in(spark):
    rng = random.Random(23)
    passage, own = prose(rng, 60), prose(rng, 150)
    rows = [(1, f"{prose(rng, 20)} {passage}", "a"), (2, f"{prose(rng, 20)} {passage}", "b"), (2, own, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut_spans string")
    left = {r["cut_spans"]: r["text"] for r in passage_dedup.cut_passages(docs, passage_dedup.find_passages(docs)).collect()}
    assert left["a"] == rows[0][1] and left["c"] == own and passage not in left["b"]


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(2)
    for _ in range(40):
        query = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        others = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(20)] + [query, query[:-2]]
        for percent in (30, 50, 80):
            expected = [i for i, s in enumerate(others) if 100 * len(np.intersect1d(query, s)) >= percent * len(np.union1d(query, s))]
            assert sorted(jaccard_join.divide_skip(query, others, percent)) == expected


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 900, rng.integers(1, 700)).astype(np.uint64)) for _ in range(2))
        a, b = K.mix(a), K.mix(b)
        assert jaccard_join.most_overlap(jaccard_join.bitmap(a), jaccard_join.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("held", [300_000, 10])
def test_components(spark, held, monkeypatch):
    monkeypatch.setattr(components, "EDGES", held)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 120) if i % 30] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    union = components.Union()
    for a, b in edges:
        union.join(a, b)
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()
    assert {r["node"]: r["label"] for r in found} == {x: union.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_compact_windows_are_tree_nodes():
    rng = np.random.default_rng(0)
    for t in range(30):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 60, 5))])
        v = rng.integers(0, 40 if t % 2 else 10**9, bounds[-1]).astype(np.uint64)
        least, expected = int(rng.integers(2, 12)), set()
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            for c in range(a, b):
                i = j = c
                while i > a and v[i - 1] > v[c]:
                    i -= 1
                while j < b - 1 and v[j + 1] >= v[c]:
                    j += 1
                if j - i + 1 >= least:
                    expected.add((c, c - i, j - c))
        assert set(zip(*(x.tolist() for x in passage_dedup.compact_windows(v, bounds, least)))) == expected


def repeated_words(rows):
    """Words of each document that lie in a 50-word stretch which a document with a smaller id has."""
    first, need = {}, defaultdict(set)
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        w = space_words(text)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if first.setdefault(g, i) != i:
                need[i].update(range(k, k + 50))
    return need


@pytest.mark.parametrize("held", [200_000, 40])
def test_passages(spark, docs, held, monkeypatch):
    monkeypatch.setattr(passage_dedup, "HELD_WINDOWS", held)
    monkeypatch.setattr(passage_dedup, "RANGE_WINDOWS", max(40, held // 10))
    rows = passage_dedup.find_passages(docs).collect()
    covered, texts = defaultdict(set), {r[0]: space_words(r[1]) for r in make_docs()}
    for r in rows:
        covered[r["doc_id"]].update(range(r["begin"], r["end"]))
        assert r["other_id"] < r["doc_id"] and r["end"] - r["begin"] >= 50 and r["similarity"] >= 0.8
        a, b = (shingle_set(" ".join(texts[r[d]][r[x] : r[y]])) for d, x, y in (("doc_id", "begin", "end"), ("other_id", "other_begin", "other_end")))
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"])
    need = repeated_words(make_docs())
    assert need and all(words <= covered[i] for i, words in need.items())
    alone = {i for i in range(4, 12)}
    assert not alone & set(covered)  # prose without copies is left alone


def run_stretches(x, y, least, similar):
    """Stretches of x between runs of common shingles that some stretch of y is similar to, by trying all."""
    common, out = set(y), []
    begins = [i for i in range(len(x)) if x[i] in common and (i == 0 or x[i - 1] not in common)]
    ends = [i + 1 for i in range(len(x)) if x[i] in common and (i + 1 == len(x) or x[i + 1] not in common)]
    for a in begins:
        for b in (b for b in ends if b - a >= least):
            mine, best = set(x[a:b]), 0
            for c in range(len(y)):
                theirs, both = set(), 0
                for z in y[c:]:
                    both += z in mine and z not in theirs
                    theirs.add(z)
                    best = max(best, both / (len(mine) + len(theirs) - both))
            out += [(a, b)] if best >= similar else []
    return out


def passages_of(x, y, least=46, similar=0.8):
    x, y = np.array(x, np.uint32), np.array(y, np.uint32)
    return passage_dedup.shared_passages(x, y, passage_dedup.shingle_places(y), least, similar)


def numbered(*texts):
    seen = {}
    return [[seen.setdefault(tuple(w[i : i + 5]), len(seen)) for i in range(len(w) - 4)] for w in texts]


def test_passage_with_words_inserted_in_its_middle():
    y = list(range(1000, 1090))
    x = [1, 2, 3] + y[:45] + list(range(10, 19)) + y[45:] + [4, 5, 6]
    assert [r[:2] for r in passages_of(*numbered(x, y))] == [(3, 98)]
    assert [r[:2] for r in passages_of(*numbered(y, x))] == [(0, 86)]  # deleted words


def test_passage_that_is_only_part_of_a_stretch():
    y = list(range(1000, 1070))
    x = list(y)
    x[25], x[50] = 1, 2  # runs of 21, 20 and 15 shingles, 0.737 in all; the first two 0.804
    assert [(*r[:4], round(r[4], 3)) for r in passages_of(*numbered(x, y))] == [(0, 46, 0, 46, 0.804)]


def test_passages_are_all_run_bounded_stretches():
    rng, wanted = random.Random(7), 0
    for t in range(120):
        words = range(6) if t % 4 == 0 else range(10_000)
        y = [rng.choice(words) for _ in range(rng.randint(25, 60))]
        x = list(y)
        for _ in range(rng.randint(1, 4)):
            k, n = rng.randrange(len(x)), rng.randint(1, 4)
            kind = rng.choice("idcm")
            if kind == "i":
                x[k:k] = [rng.randrange(20_000, 30_000) for _ in range(n)]
            elif kind == "d":
                del x[k : k + n]
            elif kind == "c":
                x[k] = rng.randrange(20_000, 30_000)
            else:  # moved
                x = x[k:] + x[:k]
        x, y = numbered(x, y)
        if len(x) < 12 or len(y) < 12:
            continue
        found = passages_of(x, y, 12)
        for a, b, c, d, value in found:
            mine, theirs = set(x[a:b]), set(y[c:d])
            assert b - a >= 12 and value >= 0.8 and len(mine & theirs) / len(mine | theirs) == pytest.approx(value)
        expected = run_stretches(x, y, 12, 0.8)
        wanted += len(expected)
        assert all(any(a <= i and j <= b for a, b, *_ in found) for i, j in expected)
    assert wanted > 100


@pytest.mark.parametrize("held", [200_000, 300])
def test_passages_of_a_common_template(spark, held, monkeypatch):
    """Many texts share 44 to 48 words, a few of them 50 or more; members with other tails lie between."""
    monkeypatch.setattr(passage_dedup, "HELD_WINDOWS", held)
    rng, rows = random.Random(12), []
    for t in range(6):
        template = prose(rng, 44).split(" ")
        tails = [prose(rng, 12).split(" ") for _ in range(12)]
        for i in range(60):
            words = template + rng.choice(tails)[: rng.choice([2, 4, 6, 8, 12])]
            rows.append((len(rows), " ".join([*prose(rng, 30).split(" "), *words, *prose(rng, 30).split(" ")])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    covered = defaultdict(set)
    for r in passage_dedup.find_passages(docs).collect():
        covered[r["doc_id"]].update(range(r["begin"], r["end"]))
    need = repeated_words(rows)
    assert len(need) > 100
    assert [i for i, words in need.items() if not words <= covered[i]] == []


def test_cut_passages(spark, docs, no_docs):
    cut = passage_dedup.cut_passages(docs, passage_dedup.find_passages(docs))
    assert cut.columns == docs.columns
    left = cut.collect()
    assert not repeated_words([(r["doc_id"], r["text"]) for r in left if r["doc_id"] not in (26, 27)])
    texts = {r["doc_id"]: r["text"] for r in left}
    assert 26 not in texts and 27 not in texts  # copies of document 0, of which nothing is left
    before = {r[0]: r[1] for r in make_docs()}
    assert all(texts[i] == before[i] for i in (0, 4, 5, 29, 30, 31, 36))
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in left)
    assert passage_dedup.cut_passages(no_docs, passage_dedup.find_passages(no_docs)).collect() == []


def alnum_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(rows, items, window=13):
    out = []
    for doc, text in rows:
        w, hit, ids = alnum_words(text), set(), set()
        for item, t in items:
            v = alnum_words(t)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, None), (2, ""), (3, "one two three"), (4, "One, TWO three!"), (5, "zz yy xx")]


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_decontamination(spark, docs, block):
    texts = [r[1] for r in make_docs()]
    items = ITEMS + [(6, " ".join(texts[5].split(" ")[10:40])), (7, " ".join(texts[6].split(" ")[5:18]) + " other words here"), (10, texts[-6]), (11, "tab and feed"), (11, "漢字 漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judge(decontaminate.find_contamination(docs, bench, block_words=block, keep=["doc_id"]))
    got = sorted(map(tuple, found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)
    assert got == brute_contamination([(r[0], r[1]) for r in make_docs()], items)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    bad = {g[0] for g in got if g[-1]}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in make_docs() if r[0] not in bad or (r[0] is None and r[1] is None)), key=repr) if None in bad else True


def test_decontamination_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(decontaminate.find_contamination(docs, none)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.find_contamination(no_docs, none).collect() == []


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 4, 80).astype(np.uint64)
    gap = np.zeros(80, bool)
    gap[[20, 33, 79]] = True
    words[gap] = 0
    shard = decontaminate.suffix_array(words, gap, 40)
    keys = [tuple(words[p : p + 64].tolist()) for p in shard.array]
    assert keys == sorted(keys) and len(keys) == 77


def brute_matches(text, items):
    """The longest match that begins at each word: its words, and whether some item has it so long."""
    w, vs, out = alnum_words(text), [alnum_words(t) for _, t in items], []
    for i in range(len(w)):
        best = 0
        for v in vs:
            for j in range(len(v)):
                k = 0
                while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def test_longest_matches_and_their_places():
    rng = random.Random(9)
    for t in range(60):
        words = "abc" if t % 2 else [f"w{i}" for i in range(30)]
        items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(4)]
        items += [("9", items[0][1])]
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + " " + " ".join(items[1][1].split(" ")[rng.randint(0, 3) :]) for _ in range(5)] + [None, ""]
        tests = decontaminate.TestSuffixes([i for i, _ in items], [x for _, x in items], 5)
        counts, hits = decontaminate.shard_hits(pa.array(texts), tests)
        assert counts.tolist() == [len(alnum_words(x)) for x in texts]
        expected = {doc: row for doc, row in zip(range(len(texts)), brute_contamination_spans(texts, items, 5)) if row[0]}
        assert {i: (h.spans, sorted(x for k in h.items for x in tests.names[k])) for i, h in hits.items()} == expected
        for i, h in hits.items():
            best = brute_matches(texts[i], items)
            w = alnum_words(texts[i])
            for (a, b), (item, item_begin, begin, length) in zip(h.spans, h.matches):
                v = alnum_words(dict(items)[tests.names[item][0]])
                assert w[begin : begin + length] == v[item_begin : item_begin + length] and length >= 1
                assert length <= max(best[a:b])
            if i == max(hits, key=lambda d: max(brute_matches(texts[d], items))) and max(brute_matches(texts[i], items)) >= 5:
                assert max(m[3] for m in h.matches) == max(brute_matches(texts[i], items))  # the longest of the shard is found


def window_grams(items, window):
    grams = defaultdict(set)
    for _, t in items:
        v = alnum_words(t)
        n = min(window, len(v))
        if n:
            grams[n] |= {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
    return grams


def brute_contamination_spans(texts, items, window):
    out = []
    for text in texts:
        w, cover, ids = alnum_words(text), [], set()
        for item, t in items:
            for n, grams in window_grams([(item, t)], window).items():
                found = [(k, k + n) for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams]
                cover += found
                ids |= {item} if found else set()
        cover = sorted(cover)
        out.append((decontaminate.merge(np.array([c[0] for c in cover]), np.array([c[1] for c in cover])), sorted(ids)))
    return out


@pytest.mark.parametrize("kind", ["copies of a long item", "equal items", "near-equal items", "one word over and over"])
def test_time_grows_with_the_words(kind):
    """Each took minutes, or did not end, with suffixes compared word by word."""
    import time

    rng = random.Random(1)
    long_ = " ".join(f"w{rng.randrange(5000)}" for _ in range(6000))
    short = long_.split(" ")[:500]
    if kind == "copies of a long item":
        items, texts = [long_], [long_] * 40
    elif kind == "equal items":
        items, texts = [" ".join(short)] * 1000, [" ".join(short)] * 40
    elif kind == "near-equal items":
        items, texts = [" ".join([*short[:i], "x", *short[i + 1 :]]) for i in range(300)], [" ".join(short)] * 40
    else:
        items, texts = ["a " * 6000], ["a " * 6000] * 40
    began = time.perf_counter()
    tests = decontaminate.TestSuffixes([str(i) for i in range(len(items))], items, 13)
    _, hits = decontaminate.shard_hits(pa.array(texts), tests)
    assert time.perf_counter() - began < 8
    assert len(hits) == 40 and all(len(h.spans) == 1 for h in hits.values())


def test_words_and_shingles_of_one_text_do_not_run_into_the_next():
    w = K.words(pa.array(["a b c d", "e f", None, "a b c d"]), K.SPACE_WORDS, lower=True)
    assert np.diff(w.first).tolist() == [4, 2, 0, 4]
    values, bounds = K.shingles(w.hash, w.first)
    assert np.diff(bounds).tolist() == [1, 1, 0, 1] and values[0] == values[2] != values[1]
    sliced = pa.array(["zz", "a b c d e f", "x"]).slice(1, 1)
    assert np.diff(K.words(sliced, K.SPACE_WORDS, lower=True).first).tolist() == [6]
