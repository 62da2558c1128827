"""Edge rows, and properties that hold for any input."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, lists, records, scores, sentences, text
from tessera.operators import cards, evidence, metrics, quality, retrieval, tables, terms
from tessera.sources import tables as sources
from tessera.streaming import funnel


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def each(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clamp_score(spark):
    assert each(spark, ["12.5", "13.5", "-4", "250", "x", None, "NaN"], "string", scores.clamp_score) == [12, 14, 0, 100, None, None, None]


def test_amount_state(spark):
    assert each(spark, [None, "0", "-1", "1", "text", "NaN"], "string", scores.amount_state) == ["not_published", "zero", "negative", "value", "not_published", "not_published"]


def test_cosine_guards(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [0.6, 0.8])], "vec_id int, embedding array<double>")
    found = retrieval.nearest(rows, [1.0, 0.0], 0.6).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in found] == [1, 4]  # strictly above; zero and null drop
    with pytest.raises(ValueError, match="STUDENT_EMBEDDING_MISSING"):
        retrieval.student_vector(rows, 2)
    with pytest.raises(ValueError):
        retrieval.student_vector(rows, 9)


def test_fit_width(spark):
    assert one(spark, scores.fit_width(scores.vector([3, 4, 9]), 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, scores.fit_width(scores.vector([0, 0, 9]), 2)) == [0, 0]
    assert one(spark, scores.fit_width(scores.vector([1]), 3)) == [1, 0, 0]


def test_tag_overlap_counts_repeats(spark):
    skills = F.array(F.lit("ai"))
    assert one(spark, scores.tag_overlap(F.array(F.lit("AI"), F.lit("ai"), F.lit("x")), skills)) == 67
    assert one(spark, scores.tag_overlap(F.array().cast("array<string>"), skills)) is None


def test_campus_match(spark):
    pairs = [("MIT", "Smith College"), ("MIT", "Massachusetts Institute of Technology"), ("Ohi", "Ohio University"), ("rice", "Rice University"), (None, "x"), (" ", "x")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    found = [r["x"] for r in rows.select("i", text.campus_match(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert found == [False, True, False, True, False, False]


def test_whole_word(spark):
    cases = [("ROS", "microscope", False), ("ROS", "ROS1", False), ("ROS", "éROS", False), ("ROS", "the ROS.", True), ("ROS", "the ros", False), ("C++", "in C++ and", True), ("machine learning", "Machine\nlearning", True), (r"a\Eb.c", r"x a\Eb.c y", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, s string, e boolean")
    assert [r["t"] for r in rows.where(F.regexp_like("s", text.whole_word(F.col("t"))) != F.col("e")).collect()] == []


def test_names(spark):
    assert each(spark, ["SMITH, JOHN A.", "o'brien-smith", "dr. lee", "", None], "string", text.person_name) == ["Dr. John Smith", "Dr. O'Brien-Smith", "Dr. Lee", text.UNRESOLVED_PI, text.UNRESOLVED_PI]
    assert each(spark, ["Dr. Ann Lee", "Ann", "Dr. Unknown Investigator", "the lab is here", None, "A B C D E", "Name not found"], "string", text.is_person_name) == [True, False, False, False, False, False, False]


def test_brief_abstract(spark):
    title, words = F.lit("A Study"), "word " * 25
    assert each(spark, [None, "", "a study .", "no abstract here", "word " * 24, words], "string", lambda c: text.is_brief(c, title)) == [True, True, True, True, True, False]


def test_display_title(spark):
    long = "x" * 50 + " " + "y" * 300
    label = "** OLD RULES ** 1. PROJECT TITLE: Rivers of the northern plains PROJECT PERIOD " + "z" * 300
    first = "This is the first sentence here. " + "z " * 200
    assert each(spark, [None, " short ", long, label, first], "string", text.display_title) == ["N/A", "short", "x" * 50 + "…", "Rivers of the northern plains", "This is the first sentence here."]


def test_html_and_utf16(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &amp; b&eacute;&#8217;</p>\n <b>c</b>d<>&lt;i&gt;"))) == "a & bé’ cd<>"
    assert one(spark, text.utf16_length(F.lit("a😀"))) == 3


def test_pages_keep_references_that_are_not_closed(spark, same_as_sql):
    from tessera.plans import texts
    from tessera.plans.base import SQL

    class Pages:
        pages = spark.createDataFrame([(1, "and &amp<p>a &amp; b</p>"), (2, "&amp;lt;i&gt; &am"), (3, "&eacute;&copy;&middot;&#39;"), (4, None)], "page_id long, html string")

    rows = ", ".join(f"({r.page_id}, {'NULL' if r.html is None else chr(39) + r.html + chr(39)})" for r in Pages.pages.collect())
    same_as_sql(texts.html_clean(Pages), f"WITH pages(page_id, html) AS (VALUES {rows}) {SQL['html_clean']}")


def test_funding_states(spark):
    day, today = datetime.date, F.lit(datetime.date(2024, 2, 29))
    cases = [(None, None, None, "no_end_date"), (None, day(2034, 3, 1), None, "implausible_end"), (None, day(2034, 2, 28), None, "funded"), (None, day(2024, 2, 28), day(2024, 2, 29), "ended"), (None, day(2024, 2, 28), day(2024, 2, 28), "end_on_file_passed"), (day(2024, 3, 1), day(2025, 1, 1), None, "starts_later"), (None, day(2024, 2, 29), None, "funded")]
    rows = spark.createDataFrame(cases, "s date, e date, c date, x string")
    assert rows.where(dates.funding_state(F.col("s"), F.col("e"), F.col("c"), today) != F.col("x")).collect() == []


def test_months(spark):
    day = datetime.date
    assert one(spark, dates.whole_months(F.lit(day(2024, 1, 31)), F.lit(day(2024, 2, 29)))) == 0
    assert one(spark, dates.whole_months(F.lit(day(2024, 1, 15)), F.lit(day(2025, 3, 15)))) == 14
    assert each(spark, [0, 7, 24, 29], "int", dates.time_left) == ["under 1 mo left", "7 mo left", "2 yr left", "2 yr 5 mo left"]
    assert each(spark, ["2026-02-30", "2026-02-28T01:00", "soon", None], "string", dates.iso_day) == [None, day(2026, 2, 28), None, None]
    assert each(spark, ["1/2/2024", "2024-01-02", None], "string", dates.us_date_text) == ["2024-01-02", "2024-01-02", None]


def test_lists(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, lists.distinct_ignoring_case(words("B", " b ", "", "a", "A"))) == ["B", "a"]
    assert one(spark, lists.without_overlap(words("natural language processing", "Natural Language", "muscle"), 5)) == ["natural language processing", "muscle"]
    assert one(spark, lists.without_overlap(words("a", "b", "c"), 2)) == ["a", "b"]
    ranges = F.array(*[F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end")) for a, b in ((5, 9), (0, 6), (6, 7))])
    assert [tuple(r) for r in one(spark, lists.disjoint_ranges(ranges))] == [(0, 6), (6, 7)]
    assert one(spark, lists.jaccard(words("a"), F.array().cast("array<string>"))) == 0


def walk(kept, offset, limit, batch, calls):
    """Batches one after the other, row by row."""
    page, at, n = [], offset, len(kept)
    for _ in range(calls):
        rows = kept[at : at + batch]
        for ok in rows:
            at += 1
            if ok:
                page.append(at)
                if len(page) == limit:
                    return page, at, at == n and len(rows) < batch
        if len(rows) < batch:
            return page, max(at, offset) if offset <= n else offset, True
    return page, at, False


def test_raw_offset_paging_equals_a_walk(spark):
    rng = random.Random(3)
    for _ in range(12):
        n, batch, calls, limit = rng.randint(0, 30), rng.randint(1, 6), rng.randint(1, 4), rng.randint(1, 6)
        offset, kept = rng.randint(0, n + 3), [rng.random() < 0.4 for _ in range(n)]
        rows = spark.createDataFrame([(i, k) for i, k in enumerate(kept)], "i int, keep boolean")
        page = retrieval.raw_offset_page(rows, F.col("keep"), limit, offset, batch, calls, [F.col("i")])
        state = page.state.first()
        expected, next_offset, exhausted = walk(kept, offset, limit, batch, calls)
        assert [r["i"] + 1 for r in page.rows.orderBy("i").collect()] == expected
        assert (state["next_offset"], state["exhausted"]) == (next_offset, exhausted), (n, batch, calls, limit, offset, kept)


def test_keepers_are_idempotent(spark):
    rows = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True), (4, None, True), (5, None, True), (6, "z", False)], "id int, k string, v boolean")
    pairs = tables.keepers(rows.where("k is not null"), [F.col("k")], [F.col("v")])
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (3, 2)]
    left = rows.join(pairs, rows.id == pairs.loser, "left_anti")
    assert tables.keepers(left.where("k is not null"), [F.col("k")], [F.col("v")]).count() == 0
    assert sorted(map(tuple, tables.keepers(rows, [tables.filled("k", "string")], [F.col("v")]).collect())) == [(1, 2), (3, 2), (5, 4)]


def test_repoint_never_loses_a_sole_match(spark):
    matches = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, "b", 11), (4, "b", 12)], "match_id int, student_id string, grant_id int")
    losers = spark.createDataFrame([(11, 10), (12, 10)], "loser int, keeper int")
    assert sorted(map(tuple, tables.repoint(matches, losers).collect())) == [(1, "a", 10), (3, "b", 10)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, s string, x int")
    new = spark.createDataFrame([(2, "B"), (3, None), (None, "m"), (None, "m")], "k int, s string")
    once = tables.upsert(old, new, ["k"])
    expected = [(None, "m", None), (None, "m", None), (None, "n", 0), (1, "a", 1), (2, "B", 2), (3, None, None)]
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(expected, key=repr)
    keyed = new.where("k is not null")
    assert sorted(map(tuple, tables.upsert(tables.upsert(old, keyed, ["k"]), keyed, ["k"]).collect()), key=repr) == sorted(map(tuple, tables.upsert(old, keyed, ["k"]).collect()), key=repr)


def test_batches_are_full_and_ordered(spark):
    rows = tables.batches(spark.range(95).repartition(7), 10, "id").groupBy("batch").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert [(r["a"], r["b"], r["n"]) for r in rows] == [(10 * k, min(10 * k + 9, 94), 10 if k < 9 else 5) for k in range(10)]


EVENTS = "event_id long, session_id string, event_type string, event_name string, page_name string, metadata string, created_at timestamp, referrer string, user_agent string"


def test_funnel_and_flags(spark):
    def event(i, session, name, page, meta):
        return (i, session, "action", name, page, json.dumps(meta), datetime.datetime(2026, 1, 1, 0, i), None, None)

    rows = [event(1, "a", "outreach_marked_sent", None, {"is_test": "True"}), event(2, "b", None, "onboarding", {"is_test": True}), event(3, "b", "x", None, {"is_test": False}), event(4, "c", "email_copied", None, {})]
    events = spark.createDataFrame(rows, EVENTS)
    assert [(r["stage"], r["sessions"], r["percent"]) for r in metrics.funnel(events).orderBy("stage").collect()] == [(1, 3, 100.0), (2, 2, 66.7), (3, 2, 66.7), (4, 2, 66.7), (5, 1, 33.3)]
    assert metrics.traffic(events, "test").count() == 2 and metrics.traffic(events, "real").count() == 2
    none = metrics.funnel(events.where("false")).orderBy("stage").collect()
    assert [(r["sessions"], r["percent"]) for r in none] == [(0, 100.0)] + [(0, 0.0)] * 4
    flags = ['{"f": true}', '{"f": "true"}', '{"f": null}', "{}", None, "broken"]
    assert each(spark, flags, "string", lambda c: metrics.is_true(c, "f")) == [True, False, False, False, False, False]
    assert each(spark, flags, "string", lambda c: metrics.has_key(c, "f")) == [True, True, True, False, False, False]
    assert {r["page"]: r["views"] for r in metrics.page_views(events).collect()} == dict.fromkeys(metrics.PAGES, 0)


def test_record_mapping(spark):
    nih = {"fiscal_year": "2024", "pref_terms": " a ; ;b", "phr_text": " Label: text ", "principal_investigators": [{"full_name": "A B", "profile_id": 1}, {"full_name": "C D", "profile_id": 2, "is_contact_pi": True, "title": " "}], "organization": {"org_name": "X"}, "is_active": True}
    row = spark.createDataFrame([(json.dumps(nih),)], "r string").select(*records.nih_columns(F.col("r"), F.lit("now"))).first()
    assert (row["fiscal_year"], row["agency_terms"], row["public_statement"], row["pi_name_published"], row["pi_title"], row["pi_source_id"]) == (2024, ["a", "b"], " Label: text ", "C D", None, "nih:2")
    assert [tuple(c) for c in row["co_pis"]] == [("A B", None, "nih:1")]
    empty = spark.createDataFrame([("{}",), ('{"principal_investigators": []}',)], "r string").select(*records.nih_columns(F.col("r"), F.lit("now"))).collect()
    assert empty[0]["co_pis"] is None and empty[0]["agency_terms"] is None and empty[1]["co_pis"] == []
    nsf = [{"id": "1", "activeAwd": "True"}, {"coPDPI": ["Ayana Arce a@x.edu"]}, {"coPDPI": None}, {}]
    found = spark.createDataFrame([(i, json.dumps(n)) for i, n in enumerate(nsf)], "i int, r string").select("i", *records.nsf_columns(F.col("r"), F.lit("now"))).orderBy("i").collect()
    assert found[0]["co_pis"] == [] and found[0]["source_is_active"] is True and found[1]["co_pis"][0]["name"] == "Ayana Arce" and found[2]["co_pis"] is None and found[3]["co_pis"] is None
    assert each(spark, ['{"a": null}', "{}", None], "string", lambda c: records.has_keys(c, ["a"])) == [True, False, False]


def test_sentences(spark):
    assert one(spark, sentences.split_sentences(F.lit("Dr. A. Lee works. It is e.g. good (see Fig. 2). Really? Yes!\n\nNew part"))) == ["Dr. A. Lee works.", "It is e.g. good (see Fig. 2).", "Really?", "Yes!", "New part"]
    assert one(spark, sentences.split_sentences(F.lit(""))) == []
    good = "The team will measure how river sediments carry heavy metals into coastal wetlands."
    cases = ["PROJECT SUMMARY", "Is this a question about the rivers of the north?", "Too short here.", "Because rivers carry many sediments the team will measure them in the wetlands.", "They will measure how river sediments carry heavy metals into coastal wetlands.", "The team will measure how DNA binds sediments and carries heavy metals into wetlands.", good]
    assert each(spark, cases, "string", sentences.rejection) == ["label_residue", "question", "too_short", "subordinator", "dangling_reference", "unexpanded_acronym", None]
    assert one(spark, sentences.select_sentence(F.lit(f"Short one. {good}"), F.lit("Other"))) == good
    found = one(spark, sentences.evidence(F.lit("DNA"), F.lit("No hit. A 😀 DNA and DNA here. DNA")))
    assert found["sentence"] == "A 😀 DNA and DNA here." and [tuple(o) for o in found["offsets"]] == [(5, 8), (13, 16)]
    assert one(spark, sentences.evidence(F.lit("C. elegans"), F.lit("The worm C. elegans is small.")))["sentence"] == "The worm C. elegans is small."
    assert one(spark, sentences.evidence(F.lit("zzz"), F.lit("text"))) is None


def test_summary_and_draft(spark):
    source = F.lit("We measure how 12 river sediments in Ohio carry heavy metals into wetlands.")
    faults = lambda s: one(spark, sentences.summary_faults(F.lit(s), F.lit("Sediments"), source))
    assert faults("Scientists there measure how river sediments carry heavy metals to wetlands.") == ["word_not_in_input"]
    assert faults("In Ohio people measure how river sediments carry metals into these wetlands.") == ["word_not_in_input"]
    assert faults("") == ["empty"]
    assert set(faults("We measure 13 river sediments in Texas; they carry metals.")) >= {"not_one_sentence", "first_person", "number_not_in_input", "name_not_in_input"}
    body = "Dear Dr. Grant,\n\nI am a student at Rice University. The grant gives $5. I attached my CV.\n\nx\n\ny"
    got = one(spark, sentences.draft_faults(F.lit("Hi"), F.lit(body), F.lit("T"), F.lit("Dr. Ann Grant"), F.lit("Rice University"), F.lit(False)))
    assert got["hard"] == ["dollar_amount", "attachment", "affiliation"] and got["soft"] == ["length"]


def test_terms(spark):
    awards = spark.createDataFrame([(i, ["Muscle", "muscle fiber", "Students"] if i == 0 else ["Common", "common"], "Muscle fibers" if i == 0 else "x", None, "muscle muscle") for i in range(100)], "award int, terms array<string>, title string, statement string, abstract string")
    frequency = spark.createDataFrame([("Muscle", 4), ("muscle fiber", 3), ("Common", 99), ("Students", 3)], "term string, awards long")
    scored = terms.term_scores(awards, frequency, 100)
    assert {r["term"] for r in scored.collect()} == {"Muscle", "muscle fiber"}
    assert terms.top_terms(scored).first()["chips"] == ["Muscle"] or terms.top_terms(scored).first()["chips"] == ["muscle fiber"]
    assert terms.document_frequency(awards, least=2).where("term = 'Common'").first()["awards"] == 99


def test_quality_reports(spark):
    rows = spark.createDataFrame([], "a int, b string")
    assert quality.health(rows, F.lit(True), F.lit(True), F.lit(True)).first()["generated_ratio"] == 0.0
    assert [(r["filled"], r["share"]) for r in quality.population(rows, ["a", "b"]).collect()] == [(0, 0.0)] * 2


def test_cards(spark):
    from tessera.functions import awards

    none = F.lit(None).cast("string")
    kind = lambda c: awards.award_kind(F.lit("NSF"), c, none, none, F.lit(False), none)["kind"]
    titles = ["REU Site: Collaborative Research: x", "Collaborative Research: MRI: x", "MRI", None, "CAREER: x", "EAGER: x", "Workshop: x", "Planning: Conference: x", "STTR: x", "Collaborative Research: " + "y" * 41 + ": CAREER: x", "CRII: RAPID: EAGER: Conference: CAREER: x"]
    assert each(spark, titles, "string", kind) == ["undergraduate_site", "equipment", None, None, "early_career_faculty", "research_project", None, None, "small_business", "research_project", "conference"]
    nih = lambda code, sub=None, name="Name", fetched=True: tuple(one(spark, awards.award_kind(F.lit("NIH"), F.lit("CAREER: x"), F.lit(code).cast("string"), F.lit(sub).cast("string"), F.lit(fetched), F.lit(name).cast("string"))))
    assert nih(" r25 ") == ("named_by_agency", "Name", True, "R25", "Name", "value") and nih("T32") == ("training", "Training program", False, "T32", "Name", "value")
    assert nih("P01", "12")[0] == "subproject" and nih("R01", " ")[:2] == ("research_project", None) and nih("R01", name=None)[-1] == "unknown" and nih("X99") == (None, None, False, "X99", "Name", "unknown")
    assert nih("R01", fetched=False)[-1] == "not_loaded" and nih(None)[-1] == "unknown" and nih(" ", "12")[-1] == "unknown"
    assert one(spark, cards.readable_text(F.lit(" "), F.lit("a"), F.lit(None).cast("boolean"))) is None
    assert one(spark, cards.readable_text(F.lit(None), F.lit("a"), F.lit(False)))["field"] == "abstract"


def test_sources(spark, tmp_path):
    (tmp_path / "b1.jsonl").write_text('{"id": "1", "sentence": "s", "terms": ["t"]}\nbroken\n{"id": "9", "sentence": "x"}\n')
    asked = spark.createDataFrame([("1", "b1"), ("9", "b2")], "id string, batch string")
    assert [tuple(r) for r in sources.answers(spark, str(tmp_path / "*.jsonl"), asked).collect()] == [("1", "s", ["t"])]
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "n.json").write_text('{"activity_code": "R01"}\n')
    got = sources.landing(spark, str(tmp_path / "landing"), "NIH").first()
    assert got["activity_code"] == "R01" and got["fields_fetched_at"]
    assert sources.landing(spark, str(tmp_path / "landing"), "DOE").first()["fields_fetched_at"] is None
    assert sources.with_columns(spark.range(1), {"x": "string", "id": "long"}).columns == ["id", "x"]
    (tmp_path / "f.json").write_text('{"built_at": "x", "awards": 5, "min_awards": 3, "terms": {"a": 4}}')
    assert [tuple(r) for r in sources.term_frequencies(spark, str(tmp_path / "f.json")).collect()] == [("a", 4)]
    spark.range(3).write.csv(str(tmp_path / "t.csv"), header=True)
    assert sources.read_any(spark, str(tmp_path / "t.csv"), "id long").count() == 3


def test_streaming_funnel(spark, tmp_path):
    schema = "event_id long, session_id string, event_name string, page_name string, ts timestamp_ntz"
    rows = [(i, f"s{i % 3}", "email_copied" if i % 3 else "x", "onboarding", datetime.datetime(2026, 1, 1 + i % 4)) for i in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = funnel.event_stream(spark, str(tmp_path / "in"), schema)
    funnel.run_once(funnel.stage_windows(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out")).groupBy("stage").agg(F.sum("events").alias("n")).orderBy("stage").collect()
    assert [(r["stage"], r["n"]) for r in done] == [(1, 1), (4, 2)]  # only windows that the watermark has passed
    name = funnel.furthest_stage(stream).writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    name.awaitTermination(120)
    assert {r["session_id"]: r["level"] for r in spark.table("levels").collect()} == {"s0": 1, "s1": 4, "s2": 4}


def test_small_text_rules(spark):
    assert each(spark, ["PROJECT SUMMARY: Rivers run.", "Project narrative: Rivers run.", "Rivers run.", ""], "string", evidence.prose_begin) == [17, 19, 0, 0]
    assert each(spark, ['```json\n{"sentence": "a"}\n```', "no", '{"terms": ["x"]}', None, "{broken}"], "string", lambda c: text.parse_answer(c)["terms"]) == [None, None, ["x"], None, None]
    assert one(spark, text.verbatim_in(F.lit("CRISPR"), [F.lit(None).cast("string"), F.lit("the crispr tool")])) == "crispr"
    assert one(spark, text.sorted_ignoring_case(F.array(F.lit("b"), F.lit("A"), F.lit("C")))) == ["A", "b", "C"]
    assert each(spark, ["One two. Three four. Five six.", "short", "x" * 40], "string", lambda c: sentences.cut_at_sentence_end(c, 22)) == ["One two. Three four.", "short", "x" * 22]


def test_model_stage_survives_failures(spark):
    from tessera.operators import model_stage

    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return prompt * 2

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, p string")
    assert [r["answer"] for r in model_stage.ask(rows, "p", call).orderBy("id").collect()] == ["aa", None, None]


def test_outreach_and_states(spark):
    m = spark.createDataFrame([(1, "emailed", "sent", None), (2, "saved", None, None), (3, "emailed", "replied", "t0")], "match_id int, status string, outreach_status string, responded_at string")
    c = spark.createDataFrame([(1, "joined"), (2, "joined"), (3, "interview")], "match_id int, outreach_status string")
    assert sorted(map(tuple, tables.outreach_change(m, c, F.lit("now")).collect())) == [(1, "emailed", "joined", "now"), (2, "saved", None, None), (3, "emailed", "interview", "t0")]
    shown = spark.createDataFrame([("s", 1, 5, "skipped", None, 0.333), ("s", 1, 6, "saved", None, 0.333), ("s", 2, 1, "odd", 9, 0.1)], "student_id string, grant_id int, at int, status string, score int, dot double")
    held = spark.createDataFrame([("s", 2, "saved", 40)], "student_id string, grant_id int, status string, score int")
    assert sorted(map(tuple, tables.match_states(held, shown).collect())) == [("s", 1, "saved", 33), ("s", 2, "saved", 40)]


def test_rules_are_applied_once_per_value(spark):
    from tessera.operators import tables as O

    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "b"), (4, "a", "b"), (5, None, None)], "k long, x string, y string")
    made = O.once_per_value(rows, ["x", "y"], lambda x, y: [F.concat_ws("-", x, y).alias("z")])
    assert made.columns == ["k", "x", "y", "z"]
    assert sorted((r["k"], r["z"]) for r in made.collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "a-b"), (5, "")]


def test_white_space_of_a_sentence_is_collapsed_once_for_all_reasons():
    """Beside the words, which collapse for themselves."""
    assert sentences.rejection(F.col("s"))._jc.toString().count(r"(?U)\s+") <= 2
