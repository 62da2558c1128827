"""Filter audit, fingerprints and phrase collocations against brute force and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, filter_audit, fingerprints
from tests.llm.conftest import DOCS, make_docs, space_words


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)))


def brute_audit(rows, labels):
    """By following each document through each order."""
    smallest = {}
    for r in rows:
        if r[0] is not None:
            smallest[r[1] or ""] = min(smallest.get(r[1] or "", r[0]), r[0])
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    out, share = defaultdict(lambda: [0] * 6), Counter()
    for r in rows:
        failed = {x for x, bad in zip("ABCD", fails(r[1] or "")) if bad} | ({"E"} if r[0] is not None and r[0] > smallest[r[1] or ""] else set())
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row = out[r[2] or "", "".join(order), step]
                bad = letter in failed
                row[1] += bad and not gone
                row[2] += bad and gone
                row[3] += failed == {letter}
                row[4] += bad and not gone and r[0] in good
                row[5] += bad and not gone and r[0] in toxic
                share[r[2] or "", letter] += bad and not gone
                gone = gone or bad
                row[0] += not gone
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("held", [filter_audit.HELD_BYTES, 1000])
def test_audit(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    rng = random.Random(3)
    rows = make_docs() + [(200 + i, rng.choice(["A copy | of many", "Another one", "x y z " * 90]), rng.choice(["en", "fr"]), "s", 1, 1, 0.5, "i", "s", "l") for i in range(80)]
    labels = [(i, i % 2, i % 3) for i in range(0, 250, 2)] + [(2, 1, 1), (None, 1, 1), (4, None, None)]
    found = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == brute_audit(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_colliding_hashes():
    """Different texts of one hash share a chain; each has its own smallest id."""
    chains = filter_audit._Chains(lambda text: 0, 16)
    gone = [x for doc, text in [(5, "a"), (3, "b"), (4, "a"), (9, "b"), (4, "a"), (7, "a")] for x in chains.meet(1, text, doc, {"en": 1})]
    assert gone == [(5, "en", 16, 1), (9, "en", 16, 1), (7, "en", 16, 1)]
    assert [(key, e[:2], e[3]) for key, e in chains.kept()] == [(1, ["a", 4], {"en": 2}), (1, ["b", 3], {"en": 1})]


def test_audit_of_text_ids_other_filters_and_nothing(spark, no_docs, labels):
    rows = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "other #")], "doc_id string, text string").selectExpr("*", "'p' AS lang")
    marks = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    found = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(rows, marks, filters={"S": lambda m: b"#" in m.raw}).collect()}
    assert len(found) == 4 and found["SE", 2]["removed"] == 1 == found["SE", 2]["good_lost"] and found["SE", 2]["kept"] == 1
    assert filter_audit.audit(no_docs, labels).collect() == []


def shingle_set(text):
    w = space_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_tail_edits(spark, docs, no_docs):
    rows = sorted((r for r in make_docs() if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    found = [r for r in fingerprints.tail_edits(docs).collect() if r["doc_id"] is not None]
    want = []
    for r, following in zip(rows, rows[1:] + rows[:1]):
        text, n = r[1] or "", len(r[1] or "") // 4
        changed = text[: len(text) - n] + (following[1] or "")[:n]
        want.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), text, changed, following[1] or ""))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == sorted(x[:3] for x in want)
    by_key = {(r["doc_id"], r["edited_sha256"]): r for r in found}
    for doc, _, sha, text, changed, following in want:
        r = by_key[doc, sha]
        for value, other in ((r["near_edited"], changed), (r["near_next"], following)):
            a, b = shingle_set(text), shingle_set(other)
            exact = len(a & b) / min(len(a), len(b)) if a and b else float(a == b)
            assert abs(value - exact) <= (0 if max(len(a), len(b)) <= fingerprints.FLOOR else 0.3), (doc, value, exact)
            assert text != other or value == 1
    same = defaultdict(set)
    for doc, _, sha, text, changed, _ in want:
        same[text].add(by_key[doc, sha]["fingerprint"])
        same[changed].add(by_key[doc, sha]["edited_fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    nameless = [r for r in fingerprints.tail_edits(docs).collect() if r["doc_id"] is None]
    assert len(nameless) == 2 and all(r["near_next"] is None and r["near_edited"] == 1 for r in nameless)
    assert fingerprints.tail_edits(no_docs).collect() == []


@pytest.mark.parametrize("kind", ["string", "int"])
def test_tail_edits_of_other_ids_and_one_row(spark, kind):
    rows = spark.createDataFrame([(str(i), f"text number {i} of ten") for i in range(1, 8)], "doc_id string, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text").repartition(3)
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.tail_edits(rows).collect()}
    assert len(found) == 7 and hashlib.sha256(b"text number 7 text ").hexdigest()[:8] != ""
    last = "7" if kind == "string" else 7
    text = "text number 7 of ten"
    assert found[last] == hashlib.sha256((text[:15] + "text number 1 of ten"[:5]).encode()).hexdigest()
    one = fingerprints.tail_edits(rows.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for n, m, both in ((10, 5, 3), (500, 200, 100), (9000, 600, 300), (4000, 4000, 3000), (20, 20, 20), (65, 65, 0)):
        pool = np.unique(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : n - both + m])
        x, y = fingerprints.Sketch.kept(a), fingerprints.Sketch.kept(b)
        merged, direct = x.merge(y), fingerprints.Sketch.kept(np.union1d(a, b))
        assert merged.whole == direct.whole and np.array_equal(merged.hashes, direct.hashes)
        back = fingerprints.Sketch.of(x.text())
        assert back.whole == x.whole and np.array_equal(back.hashes, x.hashes)
        if n <= fingerprints.FLOOR and m <= fingerprints.FLOOR:
            assert fingerprints.containment(x, y) == both / min(n, m)
        else:
            assert abs(fingerprints.containment(x, y) - both / min(n, m)) < 0.2
        assert (x.hashes <= np.uint64(x.whole)).all() and np.array_equal(x.hashes, a[a <= np.uint64(x.whole)])


def brute_collocations(rows, shown=2000, least=10, covered=50):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            longer = [b for (other, q), b in f.items() if other == lang and len(q) == 3 > len(p) and b >= least and p in (q[:2], q[1:])]
            if not any(100 * b >= covered * a for b in longer):
                cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -score) for lang, some in out.items() for i, (score, a, p, left, right) in enumerate(sorted(some)[:shown], 1))


def phrase_rows(seed=2):
    rng = random.Random(seed)
    words = ["der", "Ende", "of", "the", "new", "York", "état", "漢", "x" * 300, "#", "a-b"] + [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        w = [rng.choice(words[: rng.choice([6, 40])]) for _ in range(rng.randint(0, 60))]
        texts.append("".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " New york city "]) for x in w))
    texts += [None, "", " . ", "ha ha ha ha ha ha ha ha ha ha ha ha ha ha", "one", "a\x0bb\x0cc\rd"] + [texts[1]] * 30
    return [(t, rng.choice(["en", "fr", None, ""])) for t in texts]


@pytest.mark.parametrize("how", [{}, {"table": 12, "hot": 40, "bucket_words": 200}, {"table": 0, "hot": 1}, {"hot": 0, "bucket_words": 50}])
def test_collocations(spark, monkeypatch, how):
    if how:
        monkeypatch.setattr(collocations, "COUNT_BYTES", 3000)
        monkeypatch.setattr(collocations, "CUT_BYTES", 2000)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, 1.0, "p") for t, lang in rows], "text string, lang string, n long, score double, phrase string").repartition(3)
    found = collocations.collocations(docs, **how)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 40


def test_collocations_of_little(spark, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    few = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(few).collect() == []
    shown = collocations.collocations(spark.createDataFrame(phrase_rows(), "text string, lang string"), shown=3, min_count=5)
    assert sorted(map(tuple, shown.collect())) == brute_collocations(phrase_rows(), 3, 5)


def test_every_phrase_has_one_pivot():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 5, 300).astype(np.uint64)
    ids[rng.random(300) < 0.1] = collocations._GAP
    piece = np.cumsum(rng.random(300) < 0.1)
    found = Counter()
    for shape, rows in collocations.fragments(ids, piece):
        for phrases in collocations.owned(shape, rows):
            found.update(map(tuple, phrases.tolist()))
    want, gap = Counter(), int(collocations._GAP)
    for k in (2, 3):
        for i in range(300 - k + 1):
            p = ids[i : i + k].tolist()
            if gap not in p and piece[i] == piece[i + k - 1]:
                want[tuple(p + [gap] * (3 - k))] += 1
    assert found == want


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("CAST(900000000000 AS LONG) AS a", "CAST(999999999999 AS LONG) AS l", "CAST(999999999998 AS LONG) AS r")
    got = row.select(collocations._score(row["a"], row["l"], row["r"])).first()[0]
    assert got == 1_000_000 * 900000000000**2 // (999999999999 * 999999999998)


def test_words_are_told_apart():
    batch = pa.RecordBatch.from_pydict({"text": ["Same words", "same words. same"], "lang": ["en", "fr"]})
    r = collocations._runs(batch)
    assert len(set(r.hash.tolist())) == 4 and r.hash[2] == r.hash[4] and len(set(r.piece.tolist())) == 3
