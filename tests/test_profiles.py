"""The fold of profile events: each rule by hand, order and repetition on random histories."""

from __future__ import annotations

import random

import pytest

from tessera.operators import profiles as P


def event(kind=P.EXTRACTION, at="1", **more):
    return dict.fromkeys(P.EVENT) | {"student": 1, "at": at, "kind": kind} | more


def fold(*events):
    profile = P.Profile()
    for e in events:
        profile.take(e)
    return profile


def shown(profile):
    return [(r["list"], r["term"], r["origin"]) for r in profile.view()]


def test_origins():
    p = fold(event(skills=["crispr", "AI", "Python", "python ", " "], domains=["Genomics", "CRISPR"], narrative="I used CRISPR. I like ai.", cv="Wrote Python."))
    assert shown(p) == [("skills", "crispr", P.NARRATIVE), ("skills", "AI", P.SUGGESTED), ("skills", "Python", P.CV), ("domains", "Genomics", P.SUGGESTED)]
    assert p.view()[0]["quote"] == "I used CRISPR." and p.view()[2]["quote"] is None
    p.take(event(skills=["Python", "AI"], narrative="Now AI and python."))
    assert shown(p) == [("skills", "Python", P.NARRATIVE), ("skills", "AI", P.NARRATIVE)]
    p.take(event(skills=["Python"], cv="Other."))
    kept = fold(event(skills=["Python"], cv="Python"), event(skills=["Python"]))
    assert shown(kept) == [("skills", "Python", P.CV)]  # the CV is not kept, so its word is


def test_what_a_student_added_survives():
    p = fold(event(skills=["a lab", "b lab"]), event(P.EDIT, add=["MRI", "B Lab"]), event(skills=["mri", "c lab", "b  lab"], domains=["mri"]))
    assert shown(p) == [("skills", "c lab", P.SUGGESTED), ("skills", "b lab", P.ADDED), ("skills", "MRI", P.ADDED)]


def test_what_a_student_took_out_stays_out():
    p = fold(event(skills=["x1", "y1"]), event(P.EDIT, remove=["X1", "unknown"]), event(skills=["x1", "z1"], domains=["X1"]))
    assert shown(p) == [("skills", "z1", P.SUGGESTED)] and p.removed == ["X1"]
    p.take(event(P.EDIT, add=["x1"]))
    assert ("skills", "x1", P.ADDED) in shown(p) and p.removed == []
    both = fold(event(skills=["x1"]), event(P.EDIT, add=["x1", "q1"], remove=["X1"]))
    assert shown(both) == [("skills", "q1", P.ADDED)]


def test_reviews():
    p = fold(event(skills=["x1"]), event(P.EDIT, at="2", add=["y1"]), event(skills=["x1"]))
    assert p.reviewed == "2"  # the same terms as those looked at
    p.take(event(skills=["x1", "z1"]))
    assert p.reviewed is None and p.source == P.EXTRACTION


def test_scans():
    p = fold(event(P.SCAN, skills=["Python"], narrative="I know Python."))
    assert shown(p) == [("skills", "Python", P.SCANNED)] and p.view()[0]["quote"] == "I know Python."
    assert shown(fold(event(P.SCAN, skills=["Python"]), event(skills=["Python"], narrative="Python."))) == [("skills", "Python", P.NARRATIVE)]
    assert shown(fold(event(P.SCAN, skills=["Python"]), event(P.EDIT, add=["python"]))) == [("skills", "Python", P.ADDED)]


def test_education():
    p = fold(event(education=" BSc  Biology "), event(P.EDIT, confirmed=True))
    assert (p.education, p.confirmed) == ("BSc Biology", True)
    p.take(event(education="MSc"))
    assert p.education == "BSc Biology" and p.confirmed  # a confirmed one stays
    p.take(event(P.EDIT, education="MSc Biology"))
    assert (p.education, p.confirmed) == ("MSc Biology", False)
    p.take(event(P.EDIT, education="", confirmed=True))
    assert (p.education, p.confirmed) == (None, False)
    assert fold(event(education="BSc"), event(education=None)).education == "BSc"


def test_limits():
    many = fold(event(skills=[f"t{i}" for i in range(45)]))
    many.take(event(P.EDIT, add=["one more"]))
    assert many.refused == 1 and len(many.skills) == 45 and many.source == P.EXTRACTION
    many.take(event(P.EDIT, remove=["t1"], add=["t2"]))
    assert many.refused == 1 and len(many.skills) == 44 and many.origins["t2"] == P.ADDED
    for bad in ({"add": ["x" * 81]}, {"add": [" "]}, {"education": "e" * 201}):
        many.take(event(P.EDIT, **bad))
    assert many.refused == 4
    long = fold(event(skills=["y" * 90]), event(P.EDIT, remove=["y" * 90]))
    assert long.refused == 0 and long.skills == []


def history(rng, n):
    words = ["AI", "ai", "Python", "python", "rivers", "Rivers ", "cell culture", "x" * 85, "MRI", ""]
    some = lambda k: [rng.choice(words) for _ in range(rng.randint(0, k))]
    return [event(rng.choice([P.EXTRACTION, P.SCAN, P.EDIT, P.EDIT]), at=f"{i:03}", skills=some(4), domains=some(3), add=[w for w in some(2) if rng.random() < 0.9 or w], remove=some(2), education=rng.choice([None, "", "BSc"]), confirmed=rng.choice([None, True]), narrative=rng.choice([None, "", "I like AI and rivers.", "Python and MRI."]), cv=rng.choice([None, "cell culture"])) for i in range(n)]


def test_the_same_event_twice_changes_nothing_more():
    rng = random.Random(3)
    for _ in range(400):
        events = history(rng, rng.randint(1, 8))
        once, twice = fold(*events), fold(*events, events[-1])
        if once.refused == twice.refused:
            # an edit's second run finds the terms it added, and a removal nothing to remove
            assert [t for _, t, _ in shown(once)] == [t for _, t, _ in shown(twice)] and once.removed == twice.removed and once.education == twice.education
        terms = [t for _, t, _ in shown(once)]
        assert len({t.casefold() for t in terms}) == len(terms) and not {t.casefold() for t in terms} & {t.casefold() for t in once.removed}


@pytest.mark.parametrize("parts", [1, 5])
def test_views_of_many_students(spark, parts):
    rng = random.Random(parts)
    events = [e | {"student": s} for s in range(30) for e in history(rng, rng.randint(0, 7))] + [event() | {"student": None}]
    kinds = "student int, at string, kind string, skills array<string>, domains array<string>, add array<string>, remove array<string>, education string, confirmed boolean, narrative string, cv string"
    rows = [tuple(e[c] for c in P.EVENT) for e in events]
    rng.shuffle(rows)
    views = P.profile_views(spark.createDataFrame(rows, kinds).repartition(parts))
    found = {}
    for r in views.collect():
        found.setdefault(r["student"], []).append(r)
    for s in range(30):
        own = fold(*sorted((e for e in events if e["student"] == s), key=lambda e: e["at"]))
        assert [(r["list"], r["term"], r["origin"], r["quote"], r["removed"], r["education"], r["refused"]) for r in sorted(found.get(s, []), key=lambda r: r["position"])] == [(v["list"], v["term"], v["origin"], v["quote"], v["removed"], v["education"], v["refused"]) for v in own.view()]
    letters = P.letter_terms(views).collect()
    assert letters and all(r["origin"] in P.LETTER_ORIGINS and (r["source"] != P.SCAN or r["reviewed"]) for r in letters)
    assert P.profile_views(spark.createDataFrame([], kinds)).collect() == []
