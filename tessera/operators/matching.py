"""Which terms of a table stand in which texts, for tables of any size.

Each text is cut into words once. Terms of plain words meet the word sequences of
the texts in an equi-join on their lower-case form: case rules are checked on the
pairs that meet, and a plural is one more form of the term. Only terms with other
signs ("C++", "knock-in") need an expression, and only in texts that have their
first word.

Where every text has terms of its own, nothing is joined: a task counts the words of
a text once and looks its terms up there.

Counts are those of a whole-word expression searched from left to right: matches
of one term do not overlap. Null texts and blank terms meet nothing, nor do terms
without any letter, digit or underscore.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import ge

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.batches import parts

BROADCAST_ROWS = 200_000
KNOWN_TERMS = 20_000  # terms that a worker keeps ready
_WORD = re.compile(r"\w+")


def word_sequences(texts: DataFrame, key: str, fields: list[str], sizes: list[int]) -> DataFrame:
    """(key, field, gram): each run of words with only white space between them, as it is spelt, one space between words."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f")
    stretches = texts.select(key, each).select(key, "f.field", F.explode(F.split("f.text", text.NO_WORD_NOR_SPACE)).alias("s"))
    words = stretches.select(key, "field", F.split(text.collapse(F.col("s")), " ").alias("w")).where(F.element_at("w", 1) != "")

    def grams(n: int) -> Column:
        if n == 1:
            return F.col("w")
        if n == 2:
            return F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    return words.select(key, "field", F.explode(F.flatten(F.array(*[grams(n) for n in sizes]))).alias("gram"))


def _forms(term: Column, plural: bool) -> Column:
    """The spellings of a term's last word that count as the term, behind the words before it."""
    if not plural:
        return F.array(term)
    last = F.element_at(F.split(term, " "), -1)
    stem = F.substring(term, F.lit(1), F.length(term) - 1)
    return F.when(text.ends_like_plural(last), F.array(stem, term)).otherwise(F.array(term, F.concat(term, F.lit("s")), F.concat(term, F.lit("es"))))


def term_sizes(terms: DataFrame) -> list[int]:
    """How many words the terms have: as many numbers as the longest term has words, at most."""
    return sorted(r["n"] for r in terms.select(F.size(F.split(F.trim("term"), r"(?U)\s+")).alias("n")).distinct().collect() if r["n"])


def term_counts(texts: DataFrame, terms: DataFrame, key: str, fields: list[str], plural: bool = False) -> DataFrame:
    """(key, term, field, times) of every term that stands in a field of a text, and the terms' other columns.

    terms: a column `term`, each once; other columns are carried along. Short and
    all-capital terms must be spelt as they are; others meet in any case. With
    `plural` the last word may be in singular or plural.
    """
    more = [c for c in terms.columns if c != "term"]
    clean = terms.withColumn("c", text.collapse(F.col("term"))).where(F.col("c").rlike(text.WORD))
    clean = clean.withColumn("forms", _forms(F.col("c"), plural)).withColumn("words", F.split("c", " ")).withColumn("exact", text.is_case_sensitive(F.col("c")))
    # a term that can overlap itself ("ha ha") is left to an expression too
    head = F.transform(F.slice("words", 1, F.size("words") - 1), lambda w: F.lower(w))
    tails = F.transform("forms", lambda f: F.lower(F.element_at(F.split(f, " "), -1)))
    plain = F.col("c").rlike(rf"^{text.WORD}(?: {text.WORD})*$") & ~F.arrays_overlap(head, tails)
    # other terms ask for their first word, or for its forms if it is their last sign too
    first = lambda f: F.regexp_extract(f, f"({text.WORD})", 1)
    last_too = F.col("c").rlike(rf"^[^\p{{L}}\p{{N}}_]*{text.WORD}$")
    asked = F.when(plain, F.col("forms")).when(last_too, F.transform("forms", first)).otherwise(F.array(first(F.col("c"))))
    forms = clean.select("term", *more, "c", "exact", (~plain).alias("odd"), F.explode(asked).alias("form")).withColumn("low", F.lower("form"))

    grams = word_sequences(texts, key, fields, sorted({1, *term_sizes(terms)})).withColumn("low", F.lower("gram"))
    small = forms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # a small table goes to the words, and only those that it has are counted; to a large one they go once counted
    if not small:
        grams = grams.groupBy(key, "field", "low", "gram").agg(F.count("*").alias("times"))
    else:
        grams = grams.withColumn("times", F.lit(1).cast("long"))
    met = grams.join(F.broadcast(forms) if small else forms, "low")
    simple_hits = met.where(~F.col("odd") & (~F.col("exact") | (F.col("gram") == F.col("form")))).groupBy(key, "term", "field", *more).agg(F.sum("times").alias("times"))

    pattern = text.whole_word_or_plural if plural else text.whole_word
    candidates = met.where("odd").groupBy(key).agg(F.collect_set(F.struct("term", "c", *more)).alias("terms"))  # terms whose first word the text has
    counts = lambda t: F.array(*[F.struct(t["term"].alias("term"), F.lit(f).alias("field"), *[t[c].alias(c) for c in more], F.regexp_count(f, pattern(t["c"])).cast("long").alias("times")) for f in fields])
    odd_hits = texts.select(key, *fields).join(candidates, key).select(key, F.explode(F.flatten(F.transform("terms", counts))).alias("h")).select(key, "h.*").where(F.col("times") > 0)
    return simple_hits.unionByName(odd_hits)


class TextWords:
    """The word sequences of one text, counted when they are first asked for."""

    def __init__(self, text: str | None):
        self.text, self._exact, self._low, self._words = text or "", {}, {}, None

    def words(self) -> list[str]:
        if self._words is None:
            self._words = _WORD.findall(self.text)
        return self._words

    def exact(self, n: int) -> Counter:
        if n not in self._exact:
            if n == 1:
                self._exact[1] = Counter(self.words())
            else:
                stretches = (s.split() for s in re.split(r"[^\w\s]+", self.text))
                self._exact[n] = Counter(" ".join(w[i : i + n]) for w in stretches for i in range(len(w) - n + 1))
        return self._exact[n]

    def low(self, n: int) -> Counter:
        if n == 1 and n not in self._low:
            self._low[1] = Counter(map(str.lower, self.words()))
        elif n not in self._low:
            self._low[n] = found = Counter()
            for gram, times in self.exact(n).items():
                found[gram.lower()] += times
        return self._low[n]


class Term:
    """A term as it is searched for: forms to look up, or an expression where it has other signs or can overlap itself."""

    def __init__(self, term: str, plural: bool):
        words = term.split(" ")
        last = words[-1]
        stem = plural and len(last) > 3 and last.lower().endswith("s") and not last.lower().endswith("ss")
        self.exact = len(term) <= 3 or term == term.upper() != term.lower()
        self.n = len(words)
        forms = ([term[:-1], term] if stem else [term, term + "s", term + "es"]) if plural else [term]
        self.forms = forms if self.exact else [f.lower() for f in forms]
        self.pattern = None
        head = {w.lower() for w in words[:-1]}
        if not all(map(_WORD.fullmatch, words)) or head and not head.isdisjoint(f.lower().rpartition(" ")[2] for f in forms):
            tail = re.escape(last[:-1]) + "s?" if stem else re.escape(last) + ("(?:s|es)?" if plural else "")
            self.pattern = re.compile(r"(?<!\w)" + r"\s+".join([*map(re.escape, words[:-1]), tail]) + r"(?!\w)", 0 if self.exact else re.IGNORECASE)

    def times(self, words: TextWords) -> int:
        if self.pattern:
            return sum(1 for _ in self.pattern.finditer(words.text))
        found = words.exact(self.n) if self.exact else words.low(self.n)
        times = 0
        for form in self.forms:
            if form in found:
                times += found[form]
        return times


@lru_cache(maxsize=KNOWN_TERMS)
def _known(term: str, plural: bool) -> Term:
    return Term(term, plural)


def own_times(listed: list[str | None], values: list[str | None], plural: bool, least: list[int]) -> Iterator[tuple]:
    """(term, times in each value) of the terms that stand in some value `least` times."""
    texts, seen = [TextWords(v) for v in values], set()
    counts = {exact: [x.exact(1) if exact else x.low(1) for x in texts] for exact in (False, True)} if listed else {}
    for raw in dict.fromkeys(listed):
        term = " ".join(raw.split()) if raw else ""
        if not term or (low := term.lower()) in seen:
            continue
        seen.add(low)
        asked = _known(term, plural)
        if asked.n > 1 or asked.pattern:
            times = [asked.times(x) for x in texts]
        else:  # most terms are one word
            times = []
            for found in counts[asked.exact]:
                n = 0
                for form in asked.forms:
                    if form in found:
                        n += found[form]
                times.append(n)
        if any(map(ge, times, least)):
            yield (term, *times)


def own_term_counts(texts: DataFrame, terms: str, key: str, fields: list[str], plural: bool = False, least: list[int] | None = None) -> DataFrame:
    """(key, term, and for each field how often the term stands in it) for the array of terms that each text has.

    Terms are collapsed; of spellings that differ in case the first one counts. Only
    terms that stand somewhere come out, those with `least` of some field if that is
    given. Rules are those of term_counts.
    """
    bars = least or [1] * len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            rows = []
            for k, listed, *values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                rows += [(k, *found) for found in own_times(listed or (), values, plural, bars)]
            columns = list(zip(*rows)) if rows else [()] * (2 + len(fields))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), *[pa.array(c, pa.int64()) for c in columns[2:]]], [key, "term", *fields])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, terms, *fields).mapInArrow(run, ", ".join([f"`{key}` {kind}", "term string", *[f"`{f}` long" for f in fields]]))
