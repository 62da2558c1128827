"""The case of names that agencies publish in capitals: institutions, cities, people.

Letters are never added, dropped or moved. A name with any small letter is the
agency's own spelling and stays; in one that is all capitals each word is looked at
by itself, in the order of the rules: what is certain first, then the agencies' own
shortenings, then what cannot be known and stays as published, and the rest gets an
initial capital. All expressions run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Words that are small inside a name.
SMALL = "of and the for at in on".split()
#: Initialisms that stay capitals; those after the break can be told from words by no rule.
INITIALISMS = """
    NCI NIH NYU UT UCLA UCSF MIT USC SUNY CUNY LLC INC VA LSU OSU CWRU USD SRI DNA USA IHC IRB URL IRL ECOG ACRIN DBA
    IIAM ODMR AALMV BIPS
""".split()
#: Initialisms that a stored name keeps in any spelling.
NOT_RESTORED = "INC LLC DBA URL IRL DNA".split()
#: Ordinary words of up to three letters.
SHORT_WORDS = """
    new san los las st mt ft bay el la de del du des rio van von to by a an is up me eye ear sea ann lee art law zoo fox oak elm red
    old end bio lab max sam ada aga set pop via tex cal aim bar sky sun air one two six ten
""".split()
#: The agencies' shortenings.
SHORTENINGS = """
    CAN CTR CTRS INST INSTS UNIV COLL COL HLTH HOSP HOSPS SCH SCHS MED RES RSCH RSCS SCI SCIS FDN FOUND DEPT ASSOC ASSN CORP LTD CO
    SYS SVCS SRVS DIV BR NATL INTL BIOL HLTHCARE CHLDRN TECH ENGR ADMIN PROF GEN DEV DIS ADV MIL PUB REG SOC STA EDU PROG AGRI AGRIC
    AMER EXPER EDUC PSYCH CALIF MGMT SVC CLIN GRP
""".split()
#: The spelling that an agency itself publishes, and names with an inner capital that is not known.
ATTESTED = {"AGRILIFE": "AgriLife"}
INNER_CAPITAL = "ADVENTHEALTH MEDSTAR HEALTHPARTNERS DEBAKEY ABILITYLAB".split()
ROMAN = "II III IV VI VII VIII IX".split()
#: Parts of people's names that say nothing about case, and fillers that are no names.
SUFFIXES = "JR SR II III IV MD PHD DO DDS DVM".split()
FILLERS = "FNU LNU NFN NLN NMN".split()

_SEPARATOR = r"\s\-/,;:()\[\]\""
_PIECE = rf"(?U)[{_SEPARATOR}]+|[^{_SEPARATOR}]+"
_UNCERTAIN = r"^(?:MC|[ODL]['’])"  # a second capital may follow
_SURNAME = r"^(?:DE|LA|MAC|FITZ)[^AEIOUY]"
_VOWEL = r"[AEIOUY]"


def _in(value: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), value)


def _titled(word: Column) -> Column:
    return F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, 2, 2**30)))


def _pieces(name: Column) -> Column:
    """struct(piece, edge, word): words and what separates them, which words are the first or last one."""
    pieces = F.transform(F.regexp_extract_all(name, F.lit(_PIECE), F.lit(0)), lambda p, i: F.struct(p.alias("piece"), i.alias("at"), (~p.rlike(rf"(?U)^[{_SEPARATOR}]")).alias("word")))
    places = F.transform(F.filter(pieces, lambda p: p["word"]), lambda p: p["at"])
    return T.bound(F.struct(pieces.alias("all"), F.array_min(places).alias("first"), F.array_max(places).alias("last")), lambda x: F.transform(x["all"], lambda p: F.struct(p["piece"].alias("piece"), p["word"].alias("word"), p["at"].isin(x["first"], x["last"]).alias("edge"))))


def _core(word: Column) -> Column:
    """struct(core, tail): a word without the full stops behind it."""
    core = F.regexp_replace(word, r"\.+$", "")
    return F.struct(core.alias("core"), F.substring(word, F.length(core) + 1, F.length(word)).alias("tail"))


def _word(word: Column, edge: Column, city: bool) -> Column:
    """One word of a name in capitals."""

    def cased(x: Column) -> Column:
        core, tail = x["core"], x["tail"]
        low, titled = F.lower(core), F.concat(_titled(core), tail)
        letters = F.length(F.regexp_replace(core, "['’]", ""))
        small = F.when(~core.rlike("^[A-Z]+(?:['’][A-Z]*)*$"), word).when(_in(low, SMALL), F.when(edge, titled).otherwise(F.concat(low, tail))).when(F.length(core) == 1, word)
        if city:
            return small.when(core.rlike(_UNCERTAIN), word).otherwise(titled)
        known = small.when(_in(core, INITIALISMS), word)
        for published, spelt in ATTESTED.items():
            known = known.when(core == published, F.concat(F.lit(spelt), tail))
        unknown = known.when(_in(core, INNER_CAPITAL), word).when(_in(core, SHORTENINGS), titled).when(_in(core, ROMAN) | core.rlike(_UNCERTAIN), word)
        short = (letters <= 3) & ~low.rlike("['’]s$")
        return unknown.when(short, F.when(_in(low, SHORT_WORDS), titled).otherwise(word)).when(~core.rlike(_VOWEL), word).otherwise(titled)

    return T.bound(_core(word), cased)


def _has_small(value: Column) -> Column:
    return value.rlike(r"\p{Ll}")


def institution(value: Column, city: bool = False) -> Column:
    """A published name in readable case; a single word in capitals stays unless it is a city. Null for a blank."""

    def recased(pieces: Column) -> Column:
        joined = F.array_join(F.transform(pieces, lambda p: F.when(p["word"], _word(p["piece"], p["edge"], city)).otherwise(p["piece"])), "")
        return joined if city else F.when(F.size(F.filter(pieces, lambda p: p["word"])) >= 2, joined)

    clean = trimmed(value)
    return F.when(_has_small(clean), clean).otherwise(F.coalesce(T.bound(_pieces(clean), recased), clean))


def stored_institution(value: Column) -> Column:
    """A stored name that was put into title case, with small words, possessives and known initialisms mended."""

    def mended(p: Column) -> Column:
        def of(x: Column) -> Column:
            core, tail, upper = x["core"], x["tail"], F.upper(x["core"])
            title = core.rlike(r"^[A-Z][a-z'’]*[a-z][a-z'’]*$")
            out = F.when(~core.rlike("^[A-Za-z]+(?:['’][A-Za-z]*)*$"), p["piece"])
            out = out.when(title & _in(F.lower(core), SMALL), F.when(p["edge"], p["piece"]).otherwise(F.concat(F.lower(core), tail)))
            out = out.when(title & _in(upper, [w for w in INITIALISMS if w not in NOT_RESTORED]), F.concat(upper, tail))
            for published, spelt in ATTESTED.items():
                out = out.when(title & (upper == published), F.concat(F.lit(spelt), tail))
            head = F.regexp_replace(core, "['’]S$", "")
            return out.when(core.rlike(".['’]S$") & (head != F.upper(head)), F.concat(F.regexp_replace(core, "S$", "s"), tail)).otherwise(p["piece"])

        return F.when(p["word"], T.bound(_core(p["piece"]), of)).otherwise(p["piece"])

    clean = trimmed(value)
    return F.when(_has_small(clean), F.array_join(F.transform(_pieces(clean), mended), "")).otherwise(institution(clean))


def sentence_case(title: Column) -> Column:
    """A position in small letters with an initial capital, white space collapsed; null for a blank."""
    return T.bound(F.lower(T.or_none(title)), lambda low: F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 2**30)))


def person(value: Column) -> Column:
    """A published name; parts in capitals get small letters only if another part shows that the agency writes them.

    One part that cannot be known (initials run together, a second capital) leaves the
    whole name as published, and so does a filler. Null for a blank.
    """

    def of(pieces: Column) -> Column:
        first = F.array_min(F.transform(F.filter(pieces, lambda p: p["letters"]), lambda p: p["at"]))
        told = F.filter(pieces, lambda p: p["letters"] & (F.length(p["piece"]) >= 2) & ~_in(F.upper(p["piece"]), SUFFIXES))
        capitals = F.filter(told, lambda p: p["capitals"])
        blocked = lambda p: (F.length(p["piece"]) <= 3) | ~p["piece"].rlike(_VOWEL) | p["piece"].rlike(_UNCERTAIN) | ((p["at"] != first) & p["piece"].rlike(_SURNAME))
        keep = F.exists(told, lambda p: _in(F.upper(p["piece"]), FILLERS)) | (F.size(capitals) == 0) | ~F.exists(told, lambda p: _has_small(p["piece"])) | F.exists(capitals, blocked)
        changed = F.array_join(F.transform(pieces, lambda p: F.when(p["capitals"] & (F.length(p["piece"]) >= 2) & ~_in(F.upper(p["piece"]), SUFFIXES), _titled(p["piece"])).otherwise(p["piece"])), "")
        return F.when(~keep, changed)

    clean = trimmed(value)
    pieces = F.transform(F.regexp_extract_all(clean, F.lit(r"\p{L}+(?:['’]\p{L}+)*|\P{L}"), F.lit(0)), lambda p, i: F.struct(p.alias("piece"), i.alias("at"), p.rlike(r"^\p{L}").alias("letters"), ((p == F.upper(p)) & (p != F.lower(p))).alias("capitals")))
    return F.coalesce(T.bound(pieces, of), clean)


def trimmed(value: Column) -> Column:
    """Text without white space at its ends; null for a blank."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))
