from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.functions import nested as N
from sievework.functions import predicates as P
from sievework.functions import text as T
from sievework.functions import vectors as X
from sievework.operators import contacts


def value(spark, column, **literals):
    df = spark.range(1)
    for name, v in literals.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "found"),
    [("Summary", "Summary"), ("  Skills: ", "Skills"), ("WORK EXPERIENCE", "WORK EXPERIENCE"), ("Project", None), ("PROJECT", None), ("x" * 61, None), ("", None), ("SOME VERY LONG BANNER WITH SKILLS", None), ("Skills and more", None)],
)
def test_heading(spark, line, found):
    assert value(spark, T.heading_of("x"), x=line) == found


def test_emails_in_order_once(spark):
    text = "B@x.org, a@x.org; B@x.org ünï@exämple.de no@dot"
    assert value(spark, T.emails("x"), x=text) == ["B@x.org", "a@x.org", "ünï@exämple.de"]
    many = " ".join(f"a{i}@x.org" for i in range(20))
    assert len(value(spark, T.emails("x"), x=many)) == 10


@pytest.mark.parametrize(("term", "text", "hit"), [("sql", "SQL, Python", True), ("sql", "mysql", False), ("c++", "knows C++ well", True), ("a.b", "axb", False), ("schön", "SCHÖN!", True), ("x\\E", "x\\e", True)])
def test_whole_terms(spark, term, text, hit):
    assert value(spark, T.has_term("x", term), x=text) is hit


def test_terms(spark):
    assert value(spark, T.terms_of("x", ["Analyst"]), x="Which candidates know Python and C++. or 2024 analyst") == ["python", "c++"]
    assert value(spark, T.terms_of("x"), x='show "data lake" or "x y" python') == ["data lake", "x y"]


@pytest.mark.parametrize(("cell", "safe"), [("=1+1", "'=1+1"), ("  @x", "'  @x"), ("\tx", "'\tx"), ("a\x00b", "ab"), ("plain", "plain"), ("a=b", "a=b"), ("\nx", "'\nx")])
def test_sheet_safe(spark, cell, safe):
    df = spark.createDataFrame([(cell,)], "x string")
    assert df.select(T.sheet_safe("x")).first()[0] == safe


def test_sheet_cell_length(spark):
    assert len(value(spark, T.sheet_safe("x"), x="é" * 40000)) == 32000


def test_small_scalars(spark):
    assert value(spark, T.token_estimate("x"), x="abcd") == 2
    assert value(spark, T.token_estimate("x"), x="日本") == 4
    assert value(spark, T.initials("x"), x="  ada  lovelace king ") == "AL"
    assert value(spark, T.is_identifier("x"), x="a_1") is True
    assert value(spark, T.is_identifier("x"), x="a-1") is False
    assert value(spark, T.is_readable_name("x"), x="CV.DOCX") is True
    assert value(spark, T.iso_utc(F.timestamp_seconds("x")), x=0) == ""
    assert value(spark, T.iso_utc(F.timestamp_seconds("x")), x=86400) == "1970-01-02T00:00:00+00:00"
    assert value(spark, T.content_version(F.lit(""), F.lit(None), F.lit(3))) == "3"
    parts = value(spark, T.equal_parts("x"), x="y" * 2000)
    assert [len(p.text) for p in parts] == [900, 900, 200] and abs(sum(p.weight for p in parts) - 100) < 1e-9
    assert len(value(spark, T.equal_parts("x"), x="y" * 13500)) == 15 and value(spark, T.equal_parts("x"), x="y" * 13501) == [] and value(spark, T.equal_parts("x"), x="") == []


@pytest.mark.parametrize(("points", "threshold", "reason"), [(24.5, 25, "Incompatible resume: rubric score 24.5/100 is below the 25/100 review threshold. HR review required."), (25.0, 25, None), (0.0, 0, None), (100.0, 101, "Incompatible resume: rubric score 100/100 is below the 101/100 review threshold. HR review required.")])
def test_low_score(spark, points, threshold, reason):
    assert value(spark, P.low_score_reason(F.col("x"), threshold), x=points) == reason


@pytest.mark.parametrize(("score", "band"), [(0.0, "0–19"), (19.99, "0–19"), (20.0, "20–39"), (99.0, "80–100"), (100.0, "80–100"), (101.0, None)])
def test_bands(spark, score, band):
    assert value(spark, P.score_band(F.col("x")), x=score) == band


def test_waits(spark):
    assert [value(spark, P.backoff_seconds(F.col("x")), x=n) for n in (0, 1, 3, 20, 5000)] == [15, 30, 120, 3600, 3600]
    assert value(spark, P.following_tick(F.lit(100.0), F.lit(1000.0), 300)) == 1300
    assert value(spark, P.following_tick(F.lit(1000.0), F.lit(1000.0), 300)) == 1300
    assert value(spark, P.is_offline(F.lit(None).cast("double"), F.lit(1.0))) is True


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x]) if x else F.array().cast("array<double>")
    assert value(spark, X.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert [value(spark, X.cosine(a, b)) for a, b in ((v(1), v(1, 1)), (v(0, 0), v(1, 1)), (v(), v()))] == [0, 0, 0]
    assert value(spark, X.cosine(v(1), F.lit(None).cast("array<double>"))) == 0
    assert value(spark, X.is_valid(F.lit(None).cast("array<double>"))) is False
    assert value(spark, X.bag_of_words(F.lit("Python sql PYTHON c++"), ["python", "c++"])) == [2, 1, 1]
    assert value(spark, X.literal(v(1, 2.5))) == "[1.0,2.5]"


FINDINGS = "array<struct<criterion_id:string,level:string,evidence:array<struct<section_id:string,quote:string>>>>"


def test_evidence_errors(spark):
    rows = [
        ([("a", "supported", [("s1", "know SQL")]), ("b", "partial", [])], ["s1"], ["s1"]),
        ([("a", "supported", [("s1", "sql")]), ("a", "not_demonstrated", [])], ["s1", "s9"], []),
        ([("a", "supported", [("s1", "I know")]), ("b", "not_demonstrated", [])], ["s1"], ["s1"]),
    ]
    df = spark.createDataFrame(rows, f"f {FINDINGS}, covered array<string>, seen array<string>")
    sections = F.create_map(F.lit("s1"), F.lit("I know SQL"))
    found = [r[0] for r in df.select(N.evidence_errors(F.col("f"), F.array(F.lit("a"), F.lit("b")), sections, F.col("covered"), F.col("seen"))).collect()]
    assert found[0] == ["b: positive match needs evidence"]
    assert found[1] == ["Address each rubric criterion exactly once", "Read and cover all extracted sections", "a: citation is not in the inspected source section"]
    assert found[2] == []


def test_rubric_and_score(spark):
    df = spark.createDataFrame([([("python", "d", 60.0), ("sql", "d", 40.0)],), ([("x", "d", 60.0), ("x", "d", 41.0)],), ([],)], f"c array<{N.CRITERION}>")
    assert [r[0] for r in df.select(N.rubric_errors(F.col("c"))).collect()] == [[], ["identifiers repeat", "weights do not add up to 100"], ["1 to 15 criteria", "weights do not add up to 100"]]
    findings = F.array(*[F.struct(F.lit(c).alias("criterion_id"), F.lit(v).alias("level")) for c, v in (("python", "partial"), ("sql", "not_demonstrated"))])
    from sievework.functions.vocabulary import LEVEL_FACTORS

    assert df.select(N.weighted_score(F.col("c"), findings, LEVEL_FACTORS)).first()[0] == 30.0


def test_parsed_and_grounded(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "j string")
    assert [r[0] for r in df.select(N.parsed(F.col("j"), "struct<k:int>")["k"]).collect()] == [1, None, None]
    claims = spark.createDataFrame([([("x", ["c1", "c1"]), ("y", ["c9"]), ("z", [])],)], "c array<struct<text:string,citation_ids:array<string>>>")
    got = claims.select(N.grounded_claims(F.col("c"), F.array(F.lit("c1"))).alias("g")).first().g
    assert [c.text for c in got.kept] == ["x"] and got.dropped == 2


@pytest.mark.parametrize(
    ("text", "filename", "name"),
    [
        ("Full name: Jane Doe\nx", None, "Jane Doe"), ("Candidate\nJane Doe", None, "Jane Doe"), ("Name: not provided\nJane Doe", None, "Jane Doe"),
        ("Curriculum vitae\nJane Doe | jane@x.org | +1 555 123 4567", None, "Jane Doe"), ("محمد علي\nx", None, "محمد علي"), ("I am the only one\nBuilt with care", None, None),
        ("Experience: 5 years\nSkills", "123 - Jane_Doe CV.pdf", "Jane Doe"), ("", "report2024.pdf", None), ("Jane Doe - Engineer", None, "Jane Doe"), ("Name: =SUM(1)", None, "=SUM(1)"),
    ],
)
def test_names(spark, text, filename, name):
    df = spark.createDataFrame([(text, filename)], "text string, file string")
    assert df.select(contacts.name_of(F.col("text"), F.col("file"))).first()[0] == name


def test_contacts_column(spark):
    df = spark.createDataFrame([("Name: A B\na@x.org", "f.txt"), (None, "Max_Frisch.txt")], "text string, file string")
    rows = [r.contact for r in contacts.with_contacts(df, filename="file").collect()]
    assert [(r.name, r.emails, r.identity_verified) for r in rows] == [("A B", ["a@x.org"], False), ("Max Frisch", [], False)]
