"""Case of names against hand-made cases for every rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import names


def each(spark, values, rule):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


INSTITUTIONS = {
    "UNIVERSITY OF THE SOUTH": "University of the South", "OHIO STATE UNIVERSITY, THE": "Ohio State University, The", "NCI DIVISION AT UCSF": "NCI Division at UCSF",
    "HOSPITAL DE LA SALLE INC": "Hospital De La Salle INC", "AI LINEAR": "AI Linear", "GE MEDICAL SYSTEMS": "GE Medical Systems", "NEW YORK UNIV": "New York Univ", "BALTIMORE VA MEDICAL CENTER": "Baltimore VA Medical Center",
    "WEILL MEDICAL COLL OF CORNELL UNIV": "Weill Medical Coll of Cornell Univ", "SLOAN-KETTERING INST CAN RESEARCH": "Sloan-Kettering Inst Can Research", "TEXAS A&M AGRILIFE RESEARCH": "Texas A&M AgriLife Research",
    "MEDSTAR HEALTH INST": "MEDSTAR Health Inst", "MCGILL UNIVERSITY": "MCGILL University", "O'NEILL CENTER": "O'NEILL Center", "ST. JUDE'S HOSPITAL": "St. Jude's Hospital", "PARK VIII CENTER": "Park VIII Center", "NCTN GROUP": "NCTN Group",
    "MAINEHEALTH": "MAINEHEALTH", "O'Brien College": "O'Brien College", "ECOG-ACRIN  MEDICAL (FOUNDATION)": "ECOG-ACRIN  Medical (Foundation)", "WOMEN'S CO. OF N.J": "Women's Co. of N.J", "THE CITY 2 LAB": "The City 2 Lab",
    " SUNY AT BUFFALO ": "SUNY at Buffalo", "": None, "  ": None, None: None, "123 45": "123 45", "OF THE": "Of The", "ÉCOLE POLYTECHNIQUE": "ÉCOLE Polytechnique", "A B": "A B", "BROAD INSTITUTE, INC.": "Broad Institute, INC.", "LA JOLLA INSTITUTE": "La Jolla Institute",
    "DR'S LAB": "DR'S Lab", "ANN'S LAB": "Ann's Lab",
}


def test_institutions(spark):
    found = dict(zip(INSTITUTIONS, each(spark, list(INSTITUTIONS), names.institution)))
    assert found == INSTITUTIONS
    for given, shown in found.items():  # letters are never added, dropped or moved
        assert given is None or (shown or "").casefold() == given.strip().casefold()


def test_cities(spark):
    cities = {"BOSTON": "Boston", "BAR HARBOR": "Bar Harbor", "KING OF PRUSSIA": "King of Prussia", "MCALLEN": "MCALLEN", "Ann Arbor": "Ann Arbor", "ST. LOUIS": "St. Louis", "OF": "Of", None: None}
    assert dict(zip(cities, each(spark, list(cities), lambda c: names.institution(c, city=True)))) == cities


def test_stored_institutions(spark):
    stored = {
        "National Institute Of Diabetes And Digestive": "National Institute of Diabetes and Digestive", "Division Of Basic Sciences - Nci": "Division of Basic Sciences - NCI", "Magee-Women'S Res Inst": "Magee-Women's Res Inst",
        "The Broad Inc": "The Broad Inc", "Texas A&M Agrilife": "Texas A&M AgriLife", "UNIVERSITY OF MAINE": "University of Maine", "Mit": "MIT", "Of Mice And": "Of Mice And", "McGill University": "McGill University", "Dna Lab": "Dna Lab", "": None, None: None,
    }
    assert dict(zip(stored, each(spark, list(stored), names.stored_institution))) == stored


@pytest.mark.parametrize(
    "published, shown",
    [
        ("PRIYA Moorjani", "Priya Moorjani"), ("Sui HUANG", "Sui Huang"), ("MARY Kay WASHINGTON", "Mary Kay Washington"), ("CAROL J BULT", "CAROL J BULT"), ("Jennifer CF Leng", "Jennifer CF Leng"), ("AMM Nazmul Ahsan", "AMM Nazmul Ahsan"),
        ("FNU Sumit SAURABH", "FNU Sumit SAURABH"), ("DEEPAK Cyril D'SOUZA", "DEEPAK Cyril D'SOUZA"), ("Patricia DEVAUX", "Patricia DEVAUX"), ("DEBORAH Smith", "Deborah Smith"), ("Ann LARSON", "Ann LARSON"), ("LARRY Smith", "Larry Smith"),
        ("SHARON-LISE Normand", "Sharon-Lise Normand"), ("John SMITH III", "John Smith III"), ("JOHN SMITH MD", "JOHN SMITH MD"), ("JOHN Smith PHD", "John Smith PHD"), ("Ann NG", "Ann NG"), ("Ann J SMITH", "Ann J Smith"), ("Ann MCGILL", "Ann MCGILL"),
        ("Ann STRZRZ", "Ann STRZRZ"), ("ÉMILE Zola", "Émile Zola"), ("  Ann  SMITH ", "Ann  Smith"), ("", None), (None, None), ("Ann DEANGELIS", "Ann Deangelis"), ("O’Neill ANNE", "O’Neill Anne"),
    ],
)
def test_people(spark, published, shown):
    assert each(spark, [published], names.person) == [shown]


def test_positions(spark):
    assert each(spark, ["ASSISTANT  PROFESSOR", "Assistant Professor of Biology", " ", None, "x" * 20_000 + "Y"], names.sentence_case) == ["Assistant professor", "Assistant professor of biology", None, None, "X" + "x" * 19_999 + "y"]
