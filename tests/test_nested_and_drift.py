import json

from tessaryn.operators import drift, nested
from tessaryn.operators.nested import element_rows, flat_tables

RECORDS = {
    1: {"a": {"b": [{"c": [{"d": 1}, "plain", {"d": 2}]}, 5, None, {"c": {"d": 3}}]}, "n": "x"},
    2: {"a": {"b": {"c": [{"d": 4}]}}},
    3: {"a": '{"b": "[{\\"c\\": []}]"}'},
    4: {"a": None, "b": [], "k": [[{"z": 1}], [2]]},
    5: {},
}


def rows(spark, extra=()):
    data = [(k, json.dumps(v)) for k, v in RECORDS.items()] + [(6, None), (7, '{"a": {"b": [{"c"'), (8, ""), (9, "[1]"), (10, '{"a": NaN}'), *extra]
    return spark.createDataFrame(data, "record_id bigint, payload string")


def test_elements(spark):
    got = sorted(tuple(r) for r in element_rows(rows(spark)).collect())
    assert got == sorted([
        (1, "", "a.b[0]"), (1, "a.b[0]", "a.b[0].c[0]"), (1, "a.b[0]", "a.b[0].c[2]"), (1, "", "a.b[3]"), (1, "a.b[3]", "a.b[3].c[0]"),
        (2, "", "a.b[0]"), (2, "a.b[0]", "a.b[0].c[0]"), (3, "", "a.b[0]"), (4, "k[0]", "k[0][0]"),
    ])
    assert element_rows(rows(spark).limit(0)).count() == 0


def test_repeated_record_and_deep_and_long(spark):
    deep = "1"
    for k in range(1500):
        deep = '{"x":' + deep + "}"
    deep = '{"r":[' + deep + ',{"y":[{}]}]}'
    extra = [(1, json.dumps(RECORDS[1])), (11, deep), (12, json.dumps({"t": "y" * 200_000, "a": {"b": [{"c": []}]}})), (13, '{"\\ud800": [{"q": "\\ud800"}]}'), (14, '{"a\\u001fb\\u0001\\u00102": [{}]}')]
    found = element_rows(rows(spark, extra))
    got = found.groupBy("record_id").count().collect()
    assert {r.record_id: r["count"] for r in got} == {1: 10, 2: 2, 3: 1, 4: 1, 11: 3, 12: 1, 13: 1, 14: 1}
    assert [r.element_path for r in found.where("record_id = 14").collect()] == ["a\x1fb\x01\x102[0]"]


def test_parsing_by_stack_is_parsing():
    texts = ['{"a": [1, -2.5e3, true, null, {"b": "x\\n\\u00e9"}], "c": {}, "d": []}', "[]", " 7 ", '"x"', "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "{", "[", '{"a":tru}', "01", "[1]]", "", '{"a":"b"', "[NaN]", "[[[]],{}]"]
    for t in texts:
        try:
            want = json.loads(t, parse_constant=nested._no_constant)
        except ValueError:
            want = ValueError
        try:
            got = nested._deep(t)
        except ValueError:
            got = ValueError
        assert got == want, t
    v = nested.parse("[" * 200_000 + "]" * 200_000)
    for _ in range(199_999):
        v = v[0]
    assert v == []


def test_flat_tables_keep_links_and_names(spark):
    t = flat_tables(rows(spark, [(20, '{"a": {"b": [{"record_id": 7, "c": []}]}, "p": {"q": {"r": true}}}')]))
    assert set(t) == {"", "a.b[]", "a.b[].c[]", "k[][]"}
    c = {(r.record_id, r.element_path): (r.parent_path, r.d) for r in t["a.b[].c[]"].collect()}
    assert c[1, "a.b[0].c[2]"] == ("a.b[0]", "2") and c[1, "a.b[3].c[0]"] == ("a.b[3]", "3") and len(c) == 4
    assert [r.record_id_ for r in t["a.b[]"].where("record_id = 20").collect()] == ["7"]
    assert [r["p.q.r"] for r in t[""].where("record_id = 20").collect()] == ["true"]
    dotted = nested.table_rows(rows(spark, [(21, '{"p": {"q": 1}, "p.q": 2, "s.t": [{"u.v": {"w": 3}}]}')])).where("record_id = 21").collect()
    assert {r.table_path: r["values"] for r in dotted} == {"": {"p.q": "1", "p\\.q": "2"}, "s.t[]": {"u\\.v.w": "3"}}


def feed(spark, files):
    data, i = [], 0
    for seq, records in enumerate(files, 1):
        for r in records:
            data.append((i, "f", f"f/{seq}", seq, r if r is None or isinstance(r, str) else json.dumps(r)))
            i += 1
    return spark.createDataFrame(data, "record_id bigint, feed_id string, source_file string, file_seq int, payload string")


def test_changes(spark):
    def rec(k, **more):
        return {"p": {"annual_income": 20000 + 371 * k % 50000}, "items": [{"kind": ["Rent", "Fuel", "Food"][k % 3]}], **more}

    one = [rec(k) for k in range(40)]
    two = [{"p": {"annualIncome": str(20000 + 613 * k % 50000)}, "items": [{"category": ["Rent", "Fuel", "Food"][k % 3]}], "code": f"AB-{k:04d}"} for k in range(40)]
    three = [{"p": {"annualIncome": 20000 + 917 * k % 50000}, "items": {"category": ["Rent", "Fuel", "Food"][k % 3]}, "code": None} for k in range(40)] + [None, "{"]
    got = sorted(tuple(r) for r in drift.changes(feed(spark, [one, two, three])).collect())
    assert got == sorted([
        ("f/2", "renamed", "p.annual_income", "p.annualIncome"), ("f/2", "retyped", "p.annual_income", "p.annualIncome"), ("f/2", "renamed", "items[].kind", "items[].category"),
        ("f/2", "added", "", "code"), ("f/3", "removed", "code", ""), ("f/3", "retyped", "p.annualIncome", "p.annualIncome"),
    ])


def test_alias_and_lifespans(spark):
    files = [[{"v": k, "w": "a"} for k in range(5)], [{"v": k} for k in range(5)], [{"v": k, "w": ["q", None]} for k in range(5)], [None]]
    foot = drift.footers(feed(spark, files)).cache()
    spans = sorted((r.path, r.kind, r.first_idx, r.last_idx) for r in drift.lifespans(drift.fields(foot)).collect())
    assert spans == [("v", "number", 1, 3), ("w", "array", 3, 3), ("w", "string", 1, 1)]
    assert sorted(tuple(r)[1:] for r in drift.changes(feed(spark, files)).collect()) == [("added", "", "w"), ("removed", "v", ""), ("removed", "w", ""), ("removed", "w", "")]
    assert drift.changes(feed(spark, [])).count() == 0


def test_names():
    assert drift.name_likeness("f.debt_to_income", "f.dti") > 0.9 > drift.name_likeness("f.annual_income", "f.yearly_income") > drift.name_likeness("f.annual_income", "f.bureau_score")


def test_aliases_follow_every_rename_and_give_one_table(spark):
    name = [f"f{i}" for i in range(9)]
    found = spark.createDataFrame([("x", f"file{i:02}", n, "number", i, 9) for i, n in enumerate(name, 1)] + [("y", f"y{i}", n, "string", i, 4) for i, n in enumerate("abac", 1)], "feed_id string, source_file string, path string, kind string, idx int, last_idx int")
    hops = [(f"file{i + 2:02}", name[i], name[i + 1]) for i in range(8)] + [("y2", "a", "b"), ("y3", "b", "a")]
    pairs = spark.createDataFrame(hops, "source_file string, old_path string, new_path string")
    got = {(r.feed_id, r.path): (r.column, r.cast) for r in drift.alias_table(pairs, found).collect()}
    assert {got["x", n] for n in name} == {("f8", "double")} and (got["y", "a"][0], got["y", "b"][0], got["y", "c"][0]) == ("a", "a", "c")
    df = feed(spark, [[{"f0": 1, "p": [{"q": True}, {"q": None}]}], [{"f5": "2.5"}], [{"f8": "none"}]])
    one = df.select("feed_id").first()[0]
    known = spark.createDataFrame([(one, n, "f8", "double") for n in name] + [(one, "p[].q", "p[].flag", "double")], "feed_id string, path string, column string, cast string")
    assert sorted((r.column, r.path, list(r.ords), r.number, r.text) for r in drift.consistent(df, known).collect()) == [("f8", "f0", [], 1.0, None), ("f8", "f5", [], 2.5, None), ("f8", "f8", [], None, "none"), ("p[].flag", "p[].q", [0], 1.0, None)]
