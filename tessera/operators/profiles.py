"""A student's terms as the outcome of all that happened to them, in order.

Events of a student are folded one after the other: what a model extracts from texts,
what a keyword scan finds, what the student edits. A later extraction neither takes
away what the student added nor brings back what they took out, so the order of
events counts; the same event twice changes nothing more.

Events are dealt by student and sorted; a task reads them as a stream and holds one
profile at a time, however many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import spans

#: Kinds of events, where a term can come from, and what a letter may name.
EXTRACTION, SCAN, EDIT = "ai_extracted", "fallback", "student_edited"
ADDED, SCANNED, NARRATIVE, CV, SUGGESTED = "student_added", "keyword_scan", "narrative", "cv", "ai_suggested"
LETTER_ORIGINS = (NARRATIVE, CV, ADDED)
LONGEST_TERM, MOST_TERMS, LONGEST_EDUCATION = 80, 40, 200

EVENT = ("student", "at", "kind", "skills", "domains", "add", "remove", "education", "confirmed", "narrative", "cv")
VIEW = "position int, list string, term string, origin string, quote string, source string, reviewed string, education string, education_confirmed boolean, removed array<string>, refused int"


def key(term: str) -> str:
    return term.casefold()


def distinct(values: list[str] | None, skip: set[str] = frozenset()) -> list[str]:
    """Collapsed terms in their first spelling, without blanks and without what is skipped."""
    found = {}
    for value in values or ():
        term = spans.collapsed(value)
        if term and key(term) not in skip:
            found.setdefault(key(term), term)
    return list(found.values())


class OwnText:
    """What a student wrote, with sentences found once."""

    def __init__(self, text: str | None):
        self.source = spans.Source(text) if text else None

    def sentence(self, term: str) -> str | None:
        """The sentence with a term; only terms of up to three signs must be spelt as they are."""
        found = self.source and self.source.quote(term, exact=len(term) <= 3)
        return found.sentence if found else None


@dataclass
class Profile:
    skills: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    origins: dict[str, str] = field(default_factory=dict)
    quotes: dict[str, str | None] = field(default_factory=dict)
    removed: list[str] = field(default_factory=list)
    education: str | None = None
    confirmed: bool = False
    source: str | None = None
    reviewed: str | None = None
    narrative: str | None = None
    refused: int = 0

    def keys(self) -> set[str]:
        return {key(t) for t in self.skills + self.domains}

    def take(self, event: dict) -> None:
        """Applies an event; an edit beyond a limit is refused whole."""
        if event["narrative"] is not None:
            self.narrative = event["narrative"]
        if event["kind"] == EDIT:
            if not self._edit(event):
                self.refused += 1
                return
        else:
            self._extract(event)
        self._settle(OwnText(self.narrative), event["cv"], event["kind"])

    def _edit(self, event: dict) -> bool:
        gone = {key(t) for t in distinct(event["remove"])}
        new = [t for t in distinct(event["add"]) if key(t) not in gone]
        grown = self.skills + [t for t in new if key(t) not in self.keys() - gone]
        left = [[t for t in some if key(t) not in gone] for some in (grown, self.domains)]
        education = None if event["education"] is None else spans.collapsed(event["education"])
        blank = any(v is None or not v.strip() for v in event["add"] or ())
        too_many = len(grown) > len(self.skills) and len({key(t) for some in left for t in some}) > MOST_TERMS
        if blank or too_many or any(len(t) > LONGEST_TERM for t in new) or len(education or "") > LONGEST_EDUCATION:
            return False
        held = self.keys()
        self.skills, self.domains = left
        self.origins.update({key(t): ADDED for t in new})
        back = {key(t) for t in new}
        self.removed = distinct([t for t in self.removed if key(t) not in back] + [t for t in distinct(event["remove"]) if key(t) in held])
        if education is not None:
            self.confirmed = self.confirmed and (education or None) == self.education
            self.education = education or None
        if event["confirmed"] is not None:
            self.confirmed = event["confirmed"]
        self.confirmed = self.confirmed and self.education is not None
        self.source, self.reviewed = EDIT, event["at"]
        return True

    def _extract(self, event: dict) -> None:
        before = self.keys()
        own = {k for k in before if self.origins.get(k) == ADDED}
        skip = own | {key(t) for t in self.removed}
        kept = [[t for t in some if key(t) in own] for some in (self.skills, self.domains)]
        self.skills = distinct(event["skills"], skip) + kept[0]
        self.domains = distinct(event["domains"], skip) + [t for t in kept[1] if key(t) not in {key(s) for s in kept[0]}]
        if event["kind"] != SCAN:  # it says how terms were found, which a model's reading replaces
            self.origins = {k: v for k, v in self.origins.items() if v != SCANNED}
        found = spans.collapsed(event["education"]) or None
        if not self.confirmed:
            self.education = found or self.education
        self.source = event["kind"]
        self.reviewed = self.reviewed if self.keys() == before else None

    def _settle(self, own: OwnText, cv: str | None, kind: str) -> None:
        """Where each term comes from, by the texts as they are now."""
        cv_text, origins = OwnText(cv), {}
        self.quotes = {}
        for term in self.skills + self.domains:
            k, before = key(term), self.origins.get(key(term))
            self.quotes[k] = quote = own.sentence(term)
            if before == ADDED or before == SCANNED or kind == SCAN:
                origins[k] = before if before == ADDED else SCANNED
            elif quote:
                origins[k] = NARRATIVE
            else:
                origins[k] = CV if cv_text.sentence(term) or (before == CV and not cv) else SUGGESTED
            if origins[k] == CV:
                self.quotes[k] = None
        self.origins = origins

    def view(self) -> list[dict]:
        """Each different term once, skills first."""
        skills = {key(t) for t in self.skills}
        listed = [("skills", t) for t in self.skills] + [("domains", t) for t in self.domains if key(t) not in skills]
        more = {"source": self.source, "reviewed": self.reviewed, "education": self.education, "education_confirmed": self.confirmed, "removed": self.removed, "refused": self.refused}
        return [{"position": i, "list": name, "term": t, "origin": self.origins[key(t)], "quote": self.quotes[key(t)]} | more for i, (name, t) in enumerate(listed)]


def profile_views(events: DataFrame) -> DataFrame:
    """(student and VIEW): the terms of each student after all events, in order of `at`.

    events: EVENT, of which those that an event does not have may be null. Events of one
    student and time are taken in the order of their kind and terms. Students whose
    profile holds no term have no row; events without a student are left out.
    """
    kind = events.schema["student"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, profile = None, None
        for batch in batches:
            rows = []
            for event in batch.to_pylist():
                if event["student"] != now:
                    rows += [{"student": now} | r for r in profile.view()] if profile else []
                    now, profile = event["student"], Profile()
                profile.take(event)
            yield table(rows, batch.schema.field("student").type)
            last = batch.schema.field("student").type
        if profile:
            yield table([{"student": now} | r for r in profile.view()], last)

    known = events.select(*EVENT).where(F.col("student").isNotNull())
    ordered = known.repartition("student").sortWithinPartitions("student", "at", "kind", F.to_json(F.struct("skills", "domains", "add", "remove")))
    return ordered.mapInArrow(run, f"student {kind}, {VIEW}")


def table(rows: list[dict], student: pa.DataType) -> pa.RecordBatch:
    types = {"position": pa.int32(), "education_confirmed": pa.bool_(), "removed": pa.list_(pa.string()), "refused": pa.int32()}
    names = ["student", *(x.split()[0] for x in VIEW.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], student if n == "student" else types.get(n, pa.string())) for n in names], names)


def letter_terms(views: DataFrame) -> DataFrame:
    """The terms that a letter may name: the student's own, and none of a keyword scan that the student has not looked at."""
    seen = (F.coalesce("source", F.lit("")) != SCAN) | F.col("reviewed").isNotNull()
    return views.where(F.col("origin").isin(*LETTER_ORIGINS) & seen)
