"""Sentence places, headings and quotations against rules followed sign by sign, on hand-made cases and all test documents."""

from __future__ import annotations

import random
import re
import time

import pytest

from tessera.functions import spans
from tessera.operators import evidence
from tests.conftest import DATA


def texts_of(text, rules=spans.CHOOSING, start=0):
    return [text[a:b] for a, b in spans.sentences(text, rules, start)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One ends. Two ends! Three?", ["One ends.", "Two ends!", "Three?"]),
        ("By Dr. Smith et al. 2019 in Fig. 2. Next.", ["By Dr. Smith et al. 2019 in Fig. 2. Next."]),
        ("The U.S. Labs and the Ph.D. Students met. Yes.", ["The U.S. Labs and the Ph.D. Students met.", "Yes."]),
        ("We use J. Smith, C. elegans and Candida sp. Isolates. Then", ["We use J. Smith, C. elegans and Candida sp. Isolates.", "Then"]),
        ("Aim 1. Determine how. Aim 2. Test it.", ["Aim 1. Determine how.", "Aim 2. Test it."]),
        ("1. First thing. 2. Second thing.", ["1. First thing.", "2. Second thing."]),
        ("We found 12. Then we left.", ["We found 12.", "Then we left."]),
        ("It has parts: ii. Rivers. Phase IV. Banks.", ["It has parts: ii. Rivers.", "Phase IV. Banks."]),
        ("It was approx. the same. lower case goes on.", ["It was approx. the same. lower case goes on."]),
        ('He said "stop." (Really.) Go on...  Now', ['He said "stop."', "(Really.)", "Go on...", "Now"]),
        ("HEADING\n\nText in two\nlines. End", ["HEADING", "Text in two\nlines.", "End"]),
        ("  \n \n a.b c 1.5 mg.\t", ["a.b c 1.5 mg."]),
        ("", []), (None, []), (" \n\n ", []), (".", ["."]), ("...", ["..."]),
    ],
)
def test_sentences(text, want):
    assert texts_of(text) == want


def test_quoting_knows_fewer_abbreviations():
    assert texts_of("Aim 1. Determine. Candida sp. Isolates.", spans.QUOTING) == ["Aim 1.", "Determine.", "Candida sp.", "Isolates."]
    assert texts_of("Aim 1. Determine. More here", start=7) == ["Determine.", "More here"]


def stops_by_sign(text, rules):
    """The same edges by looking at every sign."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] in ".!?" and (i == 0 or text[i - 1] not in ".!?"):
            j = i
            while j < n and text[j] in ".!?":
                j += 1
            run = j - i
            while j < n and text[j] in "\"'”’)]":
                j += 1
            k = j
            while k < n and text[k].isspace():
                k += 1
            if k > j:
                a = i
                while a > 0 and not text[a - 1].isspace():
                    a -= 1
                word = text[a:i]
                if len(word) > 40:
                    word = word[-40:] if rules.labels else ""
                bare = word.lstrip("(\"'“‘[")
                before = text[:a].split()[-1:] or [None]
                label = before[0] is None or before[0][-1] in ".:;!?" or before[0][-40:].strip("(\"'“‘[.,:;#").casefold() in spans.LABELLING
                keep = run == 1 and text[i] == "." and (
                    (len(bare) == 1 and bare.isalpha()) or bare.casefold() in rules.abbreviations
                    or (rules.dotted and re.fullmatch(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}", bare))
                    or (rules.labels and label and (bare.isdigit() and len(bare) <= 2 or bare.casefold() in spans.ROMAN))
                    or text[k : k + 1].islower()
                )
                if not keep:
                    out.append((j, k))
                i = k
                continue
        line = re.compile(r"\n[ \t]*\n").match(text, i)
        if line:
            k = i
            while k < n and text[k].isspace():
                k += 1
            out.append((i, k))
            i = k
            continue
        i += 1
    return out


SCRAPS = ["Dr.", "e.g.", "U.S.", "1.", "12.", "iv.", "Aim", "aim 3.", "J.", "x.", "Word", "lower", "end.", "End!", "why?)", '."', "...", "(a.)", "[Fig.", "sp.", "Ph.D.", "\n\n", "\n", " \n \n", "  ", "😀.", "É.", "a" * 60 + ".", "etc.).", "?!", "goals:", "3.)"]


@pytest.mark.parametrize("rules", [spans.QUOTING, spans.CHOOSING])
def test_edges_as_sign_by_sign(rules):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(SCRAPS) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 14)))
        assert spans.boundaries(text, rules) == stops_by_sign(text, rules), text
        for a, b in spans.sentences(text, rules):
            assert text[a:b].strip() == text[a:b] != ""


def test_long_tokens_take_no_longer():
    long = "x" * 200_000 + " " + "Short one. " * 20_000
    began = time.perf_counter()
    assert len(spans.boundaries(long)) == 20_000 and len(spans.boundaries("." * 400_000 + " A")) == 1 and len(spans.boundaries("\n" * 400_000)) == 1
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "text,want",
    [
        ("PROJECT SUMMARY: Rivers", 17), ("Project Summary/Abstract The rivers", 25), ("PROJECT  SUMMARY / ABSTRACT\n\nRivers", 29), ("Modified Public Health Relevance Section: R", 42),
        ("PROJECT SUMMARY – RP2\nPan", 22), ("PROJECT SUMMARY – RP2 Pan", 0), ("PROJECT SUMMARY -" + "x" * 150 + "\nPan", 0), ("Abstract", 8), ("abstract Rivers run", 0), ("Abstract Rivers run", 9),
        ("Summary Statistics For Rivers", 0), ("ABSTRACT Rivers Run", 9), ("Abstracts of rivers", 0), ("Summary/Abstract Rivers", 0), ("DESCRIPTION: Rivers", 0), ("Narrative rivers", 0), ("  Narrative: rivers", 13), ("", 0), (None, 0),
    ],
)
def test_prose_begin(text, want):
    assert spans.prose_begin(text) == want


def utf16(text):
    return len(text.encode("utf-16-le")) // 2


def quoted(text, term, found):
    """Properties that every quotation has, counted again from the text."""
    assert found.sentence in text and found.sentence == found.sentence.strip()
    assert len(found.sentence) <= max(spans.QUOTED, 1)
    units = found.sentence.encode("utf-16-le")
    expression = re.compile(r"(?<!\w)" + r"\s+".join(map(re.escape, term.split())) + r"(?!\w)", 0 if spans.is_exact(term) else re.I)
    at = text.index(found.sentence)
    assert found.offsets and all(expression.fullmatch(units[2 * a : 2 * b].decode("utf-16-le")) for a, b in found.offsets)
    while at >= 0:  # somewhere the sentence stands, with just these places
        hits = [m.span() for m in expression.finditer(text) if at <= m.start() and m.end() <= at + len(found.sentence)]
        if found.offsets == [(utf16(text[at:a]), utf16(text[at:b])) for a, b in hits]:
            return
        at = text.find(found.sentence, at + 1)
    raise AssertionError(found)


def test_quotations_of_awkward_texts():
    rng = random.Random(8)
    pool = ["cell", "Cell", "cells", "AI", "ai", "C. elegans", "😀", "word", "long" * 20, "end.", "Start", "\n", "x" * 320, "machine\nlearning", "é😀", "(cell)", "𝛼-helix"]
    seen = 0
    for _ in range(1500):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))
        source = spans.Source(text)
        for term in ("cell", "AI", "C. elegans", "machine learning", "𝛼-helix", "x" * 320, "absent", ""):
            found = source.quote(term)
            hit = spans.term_expression(term) and spans.term_expression(term).search(text)
            assert (found is not None) == bool(hit and len(hit[0]) <= spans.QUOTED)
            if found:
                quoted(text, term, found)
                seen += 1
                begin = max((b for _, b in stops_by_sign(text, spans.QUOTING) if b <= hit.start()), default=0)
                end = min((e for e, b in stops_by_sign(text, spans.QUOTING) if b > hit.start() and e >= hit.end()), default=len(text))
                whole = text[begin:end].strip()
                assert found.sentence in whole and (found.truncated_start, found.truncated_end) == (not whole.startswith(found.sentence) or len(whole) > 300 and whole.index(found.sentence) > 0, not whole.endswith(found.sentence)) or len(whole) > 300
                assert len(whole) > 300 or found.sentence == whole
    assert seen > 1000


def test_windows_are_cut_where_words_end():
    text = "word " * 100 + "cell 😀 cell " + "tail " * 100
    found = spans.Source(text).quote("cell")
    assert found.truncated_start and found.truncated_end and found.sentence.startswith("word ") and found.sentence.endswith(" tail") and 290 < len(found.sentence) <= 300
    assert found.offsets[1][0] - found.offsets[0][0] == 8  # the sign between counts as two units
    tight = "a" * 400 + " cell " + "b" * 400
    assert spans.Source(tight).quote("cell").sentence == "cell"
    early = "cell " + "tail " * 100
    assert len(spans.Source(early).quote("cell").sentence) > 290 and not spans.Source(early).quote("cell").truncated_start


def test_fit_evidence(spark):
    terms = [("cell", "cv"), (" CELL ", "narrative"), ("river  bank", None), ("absent", "cv"), (None, "cv"), ("", "cv")]
    rows = [
        (1, terms, "A cell", "The cell. A river\nbank 😀 cell.", False), (2, terms, "A cell", "A  CELL", True), (3, terms, "A cell", "The cell.", True),
        (4, terms, "A cell", "The cell.", None), (5, None, "A cell", "The cell.", False), (6, [], None, None, False), (7, terms, None, "On the river bank.", False),
    ]
    awards = spark.createDataFrame(rows, "award long, terms array<struct<term:string,origin:string>>, title string, abstract string, generated boolean")
    found = {r["award"]: r for r in evidence.fit_evidence(awards).collect()}
    assert [(found[k]["basis"], found[k]["matched"], found[k]["total"]) for k in range(1, 8)] == [
        ("held_as_published", 2, 3), ("federal_description_only", 1, 3), ("llm_generated", None, 3), (None, None, None), ("held_as_published", None, None), ("held_as_published", 0, 0), ("held_as_published", 1, 3),
    ]
    first, second = found[1]["rows"]
    assert (first["term"], first["origin"], first["field"], first["sentence"]) == ("cell", "cv", "title", "A cell")
    assert (second["term"], second["sentence"], [tuple(o) for o in second["offsets"]]) == ("river bank", "A river\nbank 😀 cell.", [(2, 12)])
    assert found[3]["rows"] == [] and found[4]["rows"] is None
    assert evidence.fit_evidence(awards.limit(0)).collect() == []


def test_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in docs.select("doc_id", evidence.sentence_spans("text").alias("s"), evidence.sentences(docs["text"]).alias("x")).collect():
        text = texts[r["doc_id"]] or ""
        edges = stops_by_sign(text, spans.CHOOSING)
        begins = sorted({0, *(b for _, b in edges)})
        want = [text[a:b].strip() for a, b in zip(begins, [*(next(e for e, b in edges if b == x) for x in begins[1:]), len(text)])] if spans.prose_begin(text) == 0 else None
        assert want is None or r["x"] == [w for w in want if w]
        assert [text[s["begin"] : s["end"]] for s in r["s"]] == r["x"]


def test_batches_come_in_parts_of_bounded_size():
    import pyarrow as pa

    from tessera.functions.batches import parts

    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "x": ["a" * 100] * 4 + ["b" * 5000] + ["c"] * 4})
    cut = list(parts(batch, 600))
    assert [k for p in cut for k in p.column("k").to_pylist()] == list(range(9))
    assert all(p.nbytes <= 600 or p.num_rows == 1 for p in cut)
    assert list(parts(batch.slice(0, 0))) == []
    assert [v for p in parts(batch.column("x"), 600) for v in p.to_pylist()] == batch.column("x").to_pylist()


def test_a_text_without_the_term_is_not_split(spark):
    from pyspark.sql import functions as F

    from tessera.functions import sentences

    rows = spark.createDataFrame([("One here. The  river runs.\n\nMore",), ("No such word. At all.",), ("",), (None,)], "x string")
    found = rows.select(sentences.evidence(F.lit("river"), F.col("x"))["sentence"].alias("s"))
    assert [r["s"] for r in found.collect()] == ["The  river runs.", None, None, None]
