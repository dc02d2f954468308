import pytest
from pyspark.sql import functions as F

from textgate.functions import align
from textgate.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("token", "ok"), [("TiO2", True), ("InSb", True), ("Al2O3", True), ("NOW", True), ("CO", False), ("NO", False), ("USA", False)])
def test_formula(spark, token, ok):
    assert one(spark, T.is_formula(F.col("t")), t=token) is ok


def test_extractors(spark):
    t = "A film of 95.3 % at 550 nm and 2.41 [12] (Kim et al., 2020) 10.1000/xyz1 gave TiO2."
    assert one(spark, T.numbers(F.col("t")), t=t) == ["95.3", "550", "2.41"]
    assert "550 nm" in one(spark, T.quantities(F.col("t")), t=t)
    assert one(spark, T.citations(F.col("t")), t=t) == ["[12]", "(Kim et al., 2020)"]
    assert one(spark, T.formulas(F.col("t")), t=t) == ["TiO2"]
    assert one(spark, T.dois(F.col("t")), t=t) == ["10.1000/xyz1"]


def test_equations(spark):
    assert one(spark, T.equations(F.col("t")), t="We use E = mc² and the sum R² = 0.98 here.") == ["E = mc²", "R² = 0.98"]
    assert one(spark, T.equations(F.col("t")), t="plain prose without any sign") == []


def test_definitions_and_acronyms(spark):
    d = one(spark, T.definitions(F.col("t")), t="We used finite difference time domain (FDTD) and CV (cyclic voltammetry).")
    assert [(x.acronym, x.expansion) for x in d] == [("FDTD", "finite difference time domain"), ("CV", "cyclic voltammetry")]
    assert one(spark, T.acronyms(F.col("t")), t="FDTD and CV% in Si") == ["FDTD", "CV%"]


def test_words_sentences_lines(spark):
    assert one(spark, T.mining_words(F.col("t")), t="a co-op x 12 be") == ["co-op", "be"]
    assert len(one(spark, T.sentences(F.col("t"), 3), t="One two three. Four five six! Yes.")) == 2
    assert one(spark, T.lines(F.col("t")), t="a\r\nb c\n") == ["a", "b", "c"]
    assert one(spark, T.literal_count(F.col("t"), "et al."), t="by Kim et al. in et al.x") == 1


def test_normalize(spark):
    assert one(spark, T.normalize(F.col("t")), t="H₂O ﬁlm") == "H2O film"


def test_licence_slug_authors_passage(spark):
    assert one(spark, T.licence(F.col("t")), t="see https://creativecommons.org/licenses/by-nc/4.0/ .") == "CC BY-NC 4.0"
    assert one(spark, T.licence(F.col("t")), t="Creative Commons Attribution 4.0 International License") == "CC BY 4.0"
    assert one(spark, T.slug(F.col("t")), t="Optics and Photonics!") == "optics-and-photonics"
    assert one(spark, T.authors(F.col("t")), t="A; B;C ;D").endswith("et al.")
    assert one(spark, T.passage(F.col("t")), t="Too short. This one has five words. More.") == "This one has five words."


def test_alignment_functions():
    assert align.tokens("café 12%") == ["café", "12", "%"]
