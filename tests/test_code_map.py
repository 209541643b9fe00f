"""The code map: what a hand-edited file may hold, what it may not, and who owns a code."""

import warnings

import pytest
from conftest import as_dict
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelftally import Lake, schema
from shelftally.sources import code_map as cm


@pytest.fixture
def edited(tmp_path):
    def save(text):
        path = tmp_path / "map.csv"
        path.write_text(text, encoding="utf-8")
        return str(path)

    return save


def table(*rows):
    return "institution,marc_code,oclc_code,registry_name\n" + "\n".join(rows) + "\n"


def test_values_are_trimmed_of_any_white_space(spark, edited):
    path = edited(table(' oak\t, Oa-K ,,"Oak, Great"', "pine,, pn1 ,", '"pine",\tPiN　,,"Pine ""P"""'))
    rows = cm.read_code_map(spark, path).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [
        ("oak", "OA-K", True, "Oak, Great", 0),
        ("pine", "PN1", False, "", 1),
        ("pine", "PIN", True, 'Pine "P"', 2),
    ]


def test_another_org_column_and_no_names(spark, edited):
    path = edited("member,oclc_code,marc_code\noak,,OaK\n")
    assert tuple(cm.read_code_map(spark, path, org_column="member").first()) == ("oak", "OAK", True, "", 0)
    with pytest.raises(cm.CodeMapError, match="no column institution"):
        cm.read_code_map(spark, path)


@pytest.mark.parametrize(
    "rows, said",
    [
        (["oak,,Q1,", "elm,,q1,"], "OCLC symbol Q1 is claimed by elm and oak"),
        (["oak,Qa,,", "elm,QA,,"], "MARC code QA is claimed by"),
        (["oak,Oa,Q1,"], "row 1 gives both"),
        (["oak,Oa,,", "elm, , ,Elm"], "row 2 gives no code for elm"),
        ([" ,Oa,,"], "row 1 names no org"),
        (["oak,Oa,,", "elm,oa-b,,"], "OA-B of elm lies in the MARC family of oak"),
        (["oak,Oa,,", "elm,,OA-B-C,"], "OA-B-C of elm lies in the MARC family of oak"),
        ([], "nothing else"),
    ],
)
def test_faults(spark, edited, rows, said):
    with pytest.raises(cm.CodeMapError, match=said):
        cm.read_code_map(spark, edited(table(*rows)))


def test_all_faults_are_named(spark, edited):
    with pytest.raises(cm.CodeMapError) as refused:
        cm.read_code_map(spark, edited(table(*[f"org{i},,," for i in range(60)])))
    assert all(f"row {i + 1} gives no code for org{i}" in str(refused.value) for i in range(60))
    with pytest.raises(cm.CodeMapError) as refused:
        cm.read_code_map(spark, edited(table(*[f"{o},M{i},," for i in range(45) for o in ("oak", "elm")])))
    assert all(f"MARC code M{i} is" in str(refused.value) for i in range(45))


def test_neighbours_that_only_look_alike(spark, edited):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = cm.read_code_map(spark, edited(table("oak,Oa,,", "elm,,OaB,", "ash,OaC,,", "oak,Oa-X,,")))
    assert got.count() == 4


def test_a_code_in_both_namespaces_gives_a_warning(spark, edited):
    with pytest.warns(UserWarning, match=r"Q1 \(elm, oak\)"):
        cm.read_code_map(spark, edited(table("oak,Q1,,", "elm,,Q1,")))


def resolve(spark, claims, codes):
    lake = Lake(
        spark,
        spark.createDataFrame([], schema.RECORDS),
        spark.createDataFrame([], schema.RECORD_META),
        cm.code_map_from_rows(spark, claims),
    )
    return as_dict(cm.owners(lake, spark.createDataFrame([(c,) for c in codes], "code string")), "code", "owner")


def test_a_family_reaches_over_hyphens_only(spark):
    claims = [("oak", "Oa", True), ("elm", "Q1", False), ("ash", "As-h", True)]
    got = resolve(spark, claims, ["OA", "OA-", "OA-B-C", "OAB", "Q1", "Q1-X", "AS", "AS-H-1", "AS-HA", "-OA", ""])
    assert got == {"OA": "oak", "OA-": "oak", "OA-B-C": "oak", "Q1": "elm", "AS-H-1": "ash"}


def test_the_org_listed_first_wins(spark):
    claims = [("elm", "E", True), ("oak", "Z", True), ("elm", "Z", False)]
    assert resolve(spark, claims, ["Z", "Z-9"]) == {"Z": "elm", "Z-9": "oak"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("uvw"), st.text("XY-", min_size=1, max_size=4), st.booleans()), min_size=1, max_size=8),
    st.sets(st.text("XY-", min_size=1, max_size=6), min_size=1, max_size=12),
)
def test_owner_equals_prefix_comparison(spark, claims, codes):
    place = {org: i for i, (org, *_) in reversed(list(enumerate(claims)))}
    want = {}
    for code in codes:
        able = [org for org, claim, marc in claims if claim == code or (marc and code.startswith(f"{claim}-"))]
        if able:
            want[code] = min(able, key=place.get)
    assert resolve(spark, claims, codes) == want
