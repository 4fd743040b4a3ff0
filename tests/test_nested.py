import json

from seqloom.operators.nested import dewey_nodes, flat_tables, unparsed


def plain(body):
    """The rows by direct recursion over the three places named."""
    out = set()
    try:
        doc = json.loads(body or "null")
    except ValueError:
        return out

    def get(o, name):
        return [v for k, v in o.items() if k.replace("_", "").lower() == name] if isinstance(o, dict) else []

    def listed(o, name):
        for v in get(o, name):
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(x, dict):
                    yield i, x

    def subs(loc, path):
        for i, s in listed(loc, "sublocations"):
            out.add((path, f"{path}.sub_locations.{i}"))
            subs(s, f"{path}.sub_locations.{i}")

    for meta in get(doc, "meta"):
        for i, ref in listed(meta, "references"):
            out.add(("meta", f"meta.references.{i}"))
            for c in get(ref, "citation"):
                for j, _ in listed(c, "dbreference"):
                    out.add((f"meta.references.{i}", f"meta.references.{i}.citation.dbReference.{j}"))
    for i, f in listed(doc, "features"):
        for loc in get(f, "location"):
            subs(loc, f"features.{i}.location")
    return out


WANTED = ("meta.references[]", "meta.references[].citation.dbReference[]", "features[].location.sub_locations[]")


def found(df, **kw):
    return {(r[0], r[1], r[2]) for r in dewey_nodes(df, "entry_id", "body", **kw).where(f"table in {WANTED}").select("entry_id", "parent_path", "node_path").collect()}


def test_table_against_recursion(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/entry_json.parquet")
    want = {(r.entry_id, *x) for r in df.collect() for x in plain(r.body)}
    assert found(df) == want and len(want) > 100


def test_shapes(spark):
    deep = {"start": 0}
    for _ in range(60):
        deep = {"Sub_Locations": [None, deep]}
    bodies = [
        json.dumps({"META": {"References": {"Citation": {"DB_reference": {"id": 1}}}}, "features": {"location": deep}}),
        json.dumps({"meta": {"references": [None, {"citation": None}, {"citation": {"dbReference": [None, {"property": {"a": 1}}]}}]}}),
        None, "", "{", "[]", "3", '"x"', json.dumps({"meta": [], "features": [[], 1, None]}), json.dumps({"meta": {"references": []}}),
    ]
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in enumerate(bodies)], "entry_id long, body string, table string, segments string")
    assert found(df) == {(i, *x) for i, b in enumerate(bodies) for x in plain(b)}
    assert found(df.limit(0)) == set()
    props = dewey_nodes(df, "entry_id", "body").where("table = 'meta.references[].citation.dbReference[].property[]'").collect()
    assert [(p.node_path, p.parent_path) for p in props] == [("meta.references.2.citation.dbReference.1.property.0", "meta.references.2.citation.dbReference.1")]
    assert props[0].dewey[: len(props[0].parent_dewey)] == props[0].parent_dewey


def test_flat_tables_link(spark, sf):
    nodes = dewey_nodes(spark.read.parquet(f"{sf}/entry_json.parquet"), "entry_id", "body")
    t = flat_tables(nodes)
    refs, db = t[WANTED[0]], t[WANTED[1]]
    parents = refs.select("entry_id", refs.node_path.alias("parent_path"))
    assert db.count() > 0 and db.join(parents, ["entry_id", "parent_path"], "left_anti").count() == 0
    assert refs.where("members['title'] is not null").count() > 0


def members(document):
    """Every scalar of a document, however deep."""
    out, stack = [], [document]
    while stack:
        x = stack.pop()
        if isinstance(x, (dict, list)):
            stack += x.values() if isinstance(x, dict) else x
        elif x is not None:
            out.append(json.dumps(x))
    return sorted(out)


def test_nothing_is_lost(spark):
    """All scalars of a document are in its rows' payloads, and every parent is a row."""
    odd = {"meta": {"locus": {"name": "L", "deep": {"er": [1, [2, {"x": 3}]]}}, "tags": ["a", "b"], "references": [{"k": [{"z": 1}, 5, None]}]}, "more": [[{"q": 1}], []], "s": "t", "sub_locations": {"sub_locations": [{"u": 9}]}}
    known = [r.body for r in spark.read.parquet("/root/testdata/sf0.001/entry_json.parquet").select("body").collect()]
    df = spark.createDataFrame(list(enumerate([json.dumps(odd), "[[{\"a\": 1}], {\"b\": [2]}]", *known])), "id long, body string")
    bodies = {r.id: r.body for r in df.collect()}
    rows = dewey_nodes(df, "id", "body").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r)
    bad = {r.id: r.reason for r in unparsed(df, "id", "body").collect()}
    assert set(got) | set(bad) == set(bodies) and not set(got) & set(bad)
    for i, own in got.items():
        assert sorted(x for r in own for x in members(json.loads(r.payload))) == members(json.loads(bodies[i]))
        paths = {r.node_path for r in own}
        assert all(r.parent_path in paths or r.table.startswith("[]") or not r.node_path for r in own)
    assert {r.table for r in got[0]} == {"$", "meta", "meta.references[]", "meta.references[].k[]", "meta.locus.deep.er[][]", "more[][]", "sub_locations[]"}


def test_reasons(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "3"), (5, "[" * 100_000), (6, "{}")], "id long, body string")
    got = {r.id: r.reason for r in unparsed(df, "id", "body").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] == "no body" and got[3].startswith("not JSON") and got[4] == "neither object nor list" and got[5] == "nested too deep"
    assert [(r.table, r.node_path, r.payload) for r in dewey_nodes(df.where("id = 6"), "id", "body").collect()] == [("$", "", "{}")]
