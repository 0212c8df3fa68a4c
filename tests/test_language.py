import pytest

from tallyframe.plans.dsl import QueryError, Ref, parse, parse_reference, tokenize
from tallyframe.plans.render import QueryResult
from tallyframe.schema import Categorical, Continuous, Schema, SchemaError, canonical_key


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("COMPARE x BETWEEN a:1 AND b:2", ["keyword", "name", "keyword", "ref", "keyword", "ref", "end"]),
        ("mi a, b at t:1;", ["keyword", "name", "comma", "name", "keyword", "ref", "end"]),
        ("show v at t:x:y top 3", ["keyword", "name", "keyword", "ref", "keyword", "number", "end"]),
        ("", ["end"]),
        ("STATS garbage", ["keyword", "name", "end"]),
    ],
)
def test_words(text, kinds):
    assert [t.kind for t in tokenize(text)] == kinds


def test_a_reference_is_split_at_its_first_colon():
    t = tokenize("t:x:y")[0]
    assert (t.text, t.value) == ("t", "x:y")
    with pytest.raises(QueryError):
        tokenize("t:")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("COMPARE v BETWEEN t:1 AND t:2 WHERE s:a AND r:b", dict(kind="compare", variable="v", a=Ref("t", "1"), b=Ref("t", "2"), where=(Ref("s", "a"), Ref("r", "b")))),
        ("compare v across d", dict(kind="across", dimension="d")),
        ("EXPLAIN t:1 VS t:2", dict(kind="explain", a=Ref("t", "1"))),
        ("TRACK v FROM time:2020 GRANULARITY monthly", dict(kind="track", granularity="monthly")),
        ("SHOW v AT t:1 BOTTOM 4", dict(kind="show", order="bottom", limit=4)),
        ("RANK v BY ENTROPY OVER d", dict(kind="rank", dimension="d")),
        ("MI a b AT t:1", dict(kind="mi", variable="a", other="b")),
        ("CMI a, b GIVEN d", dict(kind="cmi", dimension="d")),
        ("CORRELATIONS LIMIT 3 OVER d LIMIT 5", dict(kind="correlations", dimension="d", limit=5)),
        ("CORRELATIONS", dict(kind="correlations", dimension=None, limit=20)),
        ("PAIRWISE d ON v USING psi", dict(kind="pairwise", metric="psi")),
        ("NEAREST t:1 ON d USING hellinger LIMIT 2", dict(kind="nearest", metric="hellinger", limit=2)),
        ("DIMENSIONS time", dict(kind="dimensions", dimension="time")),
        ("STATS anything goes", dict(kind="stats")),
        ("SCHEMA;", dict(kind="schema")),
    ],
)
def test_statements(text, want):
    s = parse(text)
    assert {k: getattr(s, k) for k in want} == want


def test_export_nests():
    s = parse("EXPORT EXPORT STATS AS CSV AS JSON")
    assert (s.format, s.inner.format, s.inner.inner.kind) == ("json", "csv", "stats")


@pytest.mark.parametrize("text", ["", "v", "COMPARE", "COMPARE v", "COMPARE ALL", "COMPARE v BETWEEN t:1", "SHOW v AT t:1 TOP x", "RANK v BY OVER d", "EXPORT STATS", "EXPORT STATS AS XML", "TOP 3"])
def test_what_is_no_statement(text):
    with pytest.raises(QueryError):
        parse(text)


def test_references():
    assert parse_reference("time:2022/variable:foo/topic:a:b") == ({"time": "2022", "topic": "a:b"}, "foo")
    assert parse_reference("d:1/d:2") == ({"d": "2"}, None)
    for bad in ("", "x", "a:1//b:2", ":1"):
        with pytest.raises(QueryError):
            parse_reference(bad)
    assert canonical_key({"b": "2", "a": "1"}) == "a:1/b:2"


def test_schema_rules():
    s = Schema().define_variable("v", Continuous(4)).define_variable("c", Categorical(("x",))).define_dimension("t", "ts", "daily")
    for bad in (lambda: s.define_variable("v", Continuous(1)), lambda: s.define_variable("w", Continuous(0)), lambda: s.define_variable("w", Categorical(())), lambda: s.define_dimension("t"), lambda: s.define_joint("v", "nope")):
        with pytest.raises(SchemaError):
            bad()
    s.define_joint("v", "c").define_joint("c", "v")
    assert s.joints == [("c", "v")] and [x.name for x in s.axes(("c", "v"))] == ["c", "v"]
    assert Schema.from_json(s.to_json()).to_json() == s.to_json()
    assert Continuous(2).labels() == ["[0.00, 0.50)", "[0.50, 1.00)"]


def test_rendering():
    r = QueryResult(["a", "b"], [["x,1", 'q"q'], ["é", "l\nm"]])
    assert r.to_csv() == 'a,b\n"x,1","q""q"\né,"l\nm"\n'
    assert r.to_json() == '[{"a":"x,1","b":"q\\"q"},{"a":"é","b":"l\\nm"}]'
    assert r.to_text().splitlines()[1] == "───  ───"
    assert r.to_dicts()[0] == {"a": "x,1", "b": 'q"q'} and len(r) == 2
