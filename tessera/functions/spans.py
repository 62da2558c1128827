"""Places in texts: where sentences begin and end, where prose begins, what is quoted around a term.

Plain functions of one text, called for the rows of Arrow batches (see
operators/evidence.py). All places are code points of the text itself, so a slice
always gives the text back; `Units` turns them into UTF-16 units. A text is read
once, word by word, whatever its words are like.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

QUOTED = 300  # longest quotation
LOOK_BACK = 40  # signs of a word that are compared with the lists

#: Words whose full stop ends no sentence; those after the break only where one sentence of a card is chosen.
ABBREVIATIONS = "dr prof mr mrs ms st fig figs eq ref refs no vs al etc inc ltd co approx ca cf e.g i.e u.s ph.d m.d jr sr".split()
CARD_ABBREVIATIONS = """
    drs profs eqs eqn eqns tab sec vol vols pp nos sp spp subsp ssp var viz resp est dept univ corp mt ft gen gov hon rev
    u.k u.s.a d.c a.m p.m b.s m.s b.a m.a sc.d d.o r.n
""".split()
#: Words after which a number or a roman numeral is a label, and these numerals.
LABELLING = """
    aim aims objective objectives goal goals step steps task tasks thrust thrusts phase phases project projects core cores specific sa
    hypothesis hypotheses part parts study experiment experiments question questions theme themes area areas component components
    module modules stage stages track activity activities approach focus direction pillar
""".split()
ROMAN = "i ii iii iv v vi vii viii ix x".split()
#: Headings that stand before an award's text.
HEADINGS = (
    "Modified Public Health Relevance Section", "Modified Project Summary Section", "Modified Project Summary/Abstract Section", "Project Narrative/Relevance",
    "Public Health Relevance", "Public Health Relevance Statement", "Public Health Relevance Section", "Project Summary", "Project Summary/Abstract",
    "Project Narrative", "Project Abstract", "Narrative", "Summary", "Abstract",
)
HEADING_LINE = 140  # longest rest of a heading's line after a dash

_OPENING, _CLOSING = "(\"'“‘[", "\"'”’)]"
_WORD = re.compile(r"\S+")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")
_DOTTED = re.compile(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}")


class Rules(NamedTuple):
    """Which full stops end no sentence."""

    abbreviations: frozenset[str]
    dotted: bool  # any dotted form is an abbreviation
    labels: bool  # numbers and numerals may be labels


QUOTING = Rules(frozenset(ABBREVIATIONS), False, False)
CHOOSING = Rules(frozenset(ABBREVIATIONS + CARD_ABBREVIATIONS), True, True)


def _labels(before: str | None) -> bool:
    """Whether a number after this word, or at the beginning of a text, is a label."""
    return before is None or before[-1] in ".:;!?" or before[-LOOK_BACK:].strip(_OPENING + ".,:;#").casefold() in LABELLING


def _stops(core: str, before: str | None, following: str, rules: Rules) -> bool:
    """Whether a single full stop behind `core` ends a sentence."""
    if following.islower():
        return False
    word = core[-LOOK_BACK:].lstrip(_OPENING) if len(core) <= LOOK_BACK or rules.labels else ""
    low = word.casefold()
    if low in rules.abbreviations or len(word) == 1 and word.isalpha() or rules.dotted and _DOTTED.fullmatch(word):
        return False
    number = word.isdigit() and len(word) <= 2 or low in ROMAN
    return not (rules.labels and number and _labels(before))


def boundaries(text: str, rules: Rules = QUOTING) -> list[tuple[int, int]]:
    """(end of a sentence, beginning of the next one), in order.

    A sentence ends at stops and closing signs before white space, or at a blank
    line behind a word without a stop.
    """
    out, words = [], _WORD.finditer(text)
    word, before = next(words, None), None
    first = word.start() if word else len(text)
    if line := _BLANK_LINE.search(text, 0, first):
        out.append((line.start(), first))
    while word:
        following = next(words, None)
        begin = following.start() if following else len(text)
        bare = word[0].rstrip(_CLOSING)
        core = bare.rstrip(".!?")
        if len(core) < len(bare):
            if begin > word.end() and (bare[len(core) :] != "." or _stops(core, before, text[begin : begin + 1], rules)):
                out.append((word.end(), begin))
        elif begin - word.end() > 1 and (line := _BLANK_LINE.search(text, word.end(), begin)):
            out.append((line.start(), begin))
        before, word = word[0], following
    return out


def trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    """A range without the white space at its ends."""
    inside = text[begin:end]
    begin += len(inside) - len(inside.lstrip())
    return begin, max(begin, begin + len(inside.strip()))


def sentences(text: str | None, rules: Rules = CHOOSING, start: int = 0) -> list[tuple[int, int]]:
    """The ranges of all sentences from a place on; what stands before the place still tells what its words are."""
    if not text:
        return []
    edges, at = [], min(max(start, 0), len(text))
    for end, begin in boundaries(text, rules):
        if end > at:
            edges.append((at, end))
        at = max(at, begin)
    found = (trimmed(text, a, b) for a, b in [*edges, (at, len(text))])
    return [(a, b) for a, b in found if b > a]


def _heading() -> re.Pattern:
    longest = sorted(HEADINGS, key=len, reverse=True)
    names = "|".join(re.escape(h).replace(r"\ ", r"\s+").replace("/", r"\s*/\s*") for h in longest)
    return re.compile(rf"[ \t\r\n]*(?P<name>{names})(?![\w/])(?P<gap>[ \t]*)(?P<colon>:?)[ \t]*", re.IGNORECASE)


_HEADING = _heading()


def prose_begin(text: str | None) -> int:
    """Where the text begins behind a known heading; 0 where no heading can be told from the text.

    A heading begins with a capital, and is followed by a colon, a line break, the rest
    of its line after a dash, or by what can begin a sentence. One word that is not all
    in capitals is one only before a sentence in the usual case.
    """
    found = _HEADING.match(text or "")
    if not found or not found["name"][0].isupper():
        return 0
    at = found.end()
    rest = text[at:]
    if not found["colon"] and rest[:1] and rest[0] in "-–—":
        line = rest.find("\n")
        if not 0 <= line <= HEADING_LINE:
            return 0
        rest = rest[line:]
        at = len(text) - len(rest)
    if not rest:
        return len(text)
    if found["colon"] or rest[0] in "\r\n":
        return len(text) - len(rest.lstrip())
    if at == found.end("name") or not (rest[0].isupper() or rest[0].isdigit() or rest[0] in "\"'“‘(["):
        return 0
    name = found["name"]
    if not name.isupper() and len(name.split()) == 1 and "/" not in name:
        second = re.match(r"\S+\s+(\S)", rest)
        if not second or second[1].isupper():
            return 0
    return at


class Units:
    """UTF-16 units before each place of a text."""

    def __init__(self, text: str):
        self.wide = None if text.isascii() or max(text) < "\U00010000" else [i for i, c in enumerate(text) if c >= "\U00010000"]

    def __call__(self, place: int) -> int:
        return place + (bisect_left(self.wide, place) if self.wide else 0)


def is_exact(term: str) -> bool:
    """Terms of three signs or fewer, and those all in capitals, must be spelt as they are."""
    return len(term) <= 3 or term == term.upper() != term.lower()


def term_expression(term: str, exact: bool | None = None) -> re.Pattern | None:
    """A term as a whole word, with any white space between its words; exact: as it is spelt, by default by is_exact."""
    words = term.split()
    if not words:
        return None
    body = r"\s+".join(map(re.escape, words))
    return re.compile(rf"(?<!\w){body}(?!\w)", 0 if (is_exact(" ".join(words)) if exact is None else exact) else re.IGNORECASE)


def window(text: str, sentence: tuple[int, int], hit: tuple[int, int], longest: int = QUOTED) -> tuple[int, int]:
    """At most `longest` signs of a sentence around a hit, cut only where words end.

    Both sides get half of the room; what one does not need goes to the other.
    """
    (begin, end), (a, b) = sentence, hit
    if end - begin <= longest:
        return sentence
    room = longest - (b - a)
    right = min(end - b, room - min(a - begin, room // 2))
    left = min(a - begin, room - right)
    low, high = a - left, b + right
    inside = lambda k: not text[k - 1].isspace() and not text[k].isspace()
    if low > begin and inside(low):
        words = _WORD.finditer(text, low, a)
        next(words, None)  # the cut one
        following = next(words, None)
        low = following.start() if following else a
    if high < end and inside(high):
        rest = text[b:high]
        kept = rest[: max((i for i, c in enumerate(rest) if c.isspace()), default=0)]
        high = b + len(kept.rstrip())
    return low, high


class Quotation(NamedTuple):
    """Part of a text around a term's first place; offsets: all places of the term in it, in UTF-16 units."""

    sentence: str
    offsets: list[tuple[int, int]]
    truncated_start: bool
    truncated_end: bool


class Source:
    """A text in which several terms are looked up; sentences and units are found once."""

    def __init__(self, text: str):
        self.text, self.units = text, Units(text)
        ends = boundaries(text, QUOTING)
        self.ends, self.begins = [e for e, _ in ends], [b for _, b in ends]

    def quote(self, term: str, longest: int = QUOTED, exact: bool | None = None) -> Quotation | None:
        """The sentence with the first place of a term. A stop inside the term ends no sentence."""
        expression = term_expression(term, exact)
        hits = [m.span() for m in expression.finditer(self.text)] if expression else []
        if not hits or hits[0][1] - hits[0][0] > longest:
            return None
        a, b = hits[0]
        k = bisect_left(self.begins, a + 1)  # so many sentences begin at or before the hit, besides the first
        begin = self.begins[k - 1] if k else 0
        k = max(k, bisect_left(self.ends, b))
        end = self.ends[k] if k < len(self.ends) else len(self.text)
        whole = trimmed(self.text, begin, end)
        low, high = trimmed(self.text, *window(self.text, whole, (a, b), longest))
        base = self.units(low)
        inside = [(self.units(x) - base, self.units(y) - base) for x, y in hits if low <= x and y <= high]
        return Quotation(self.text[low:high], inside, low > whole[0], high < whole[1])


def collapsed(value: str | None) -> str:
    return " ".join(value.split()) if value else ""


