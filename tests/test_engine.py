"""The language over a small harbour: ports, ships in them, sailors on ships, and badges that sailors bear."""

import pytest

from orrery.builder import Model, std
from orrery.plans.lexer import QueryError
from orrery.schema import Constraint, Link, ObjectType, Rewrite, Schema, SchemaError, Trigger
from orrery.session import Engine

TYPES = [
    ObjectType("Port", "port", properties={"name": "name"}),
    ObjectType("Ship", "ship", properties={"name": "name", "tons": "tons"}, links={"port": Link("Port", "port_id")}),
    ObjectType(
        "Sailor", "sailor", properties={"name": "name", "rank": "rank", "years": "years", "ashore": "ashore"},
        links={"ship": Link("Ship", "ship_id"), "badges": Link("Badge", through="worn", source_column="sailor", target_column="badge", properties={"since": "since"})},
        computed={"newest": "select .badges order by @since desc limit 1"},
    ),
    ObjectType("Badge", "badge", properties={"name": "name"}),
]
TABLES = {
    "port": ([(1, "Lisbon"), (2, "Narvik")], "id long, name string"),
    "ship": ([(1, "Petrel", 90, 1), (2, "Auk", 40, 1)], "id long, name string, tons long, port_id long"),
    "sailor": ([(1, "Ines", "mate", 12, False, 1), (2, "Odd", "mate", 7, False, 1), (3, "Rui", "cook", 3, True, 2), (4, "Siv", "cook", 20, False, None), (5, "Tor", None, 31, False, None)], "id long, name string, rank string, years long, ashore boolean, ship_id long"),
    "badge": ([(1, "knot"), (2, "star")], "id long, name string"),
    "worn": ([(1, 1, 2001.0), (1, 2, 1999.0), (2, 2, 2010.0)], "sailor long, badge long, since double"),
}


@pytest.fixture
def engine(spark):
    return Engine(spark, Schema(TYPES), {n: spark.createDataFrame(*t) for n, t in TABLES.items()})


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_groups(engine):
    got = rows(engine.query("select (group Sailor by .rank) { r := .key.rank, n := count(.elements), most := max(.elements.years) } order by .r"))
    assert got == [("cook", 2, 20), ("mate", 2, 12), (None, 1, 31)]
    bare = {r["key"]["ashore"]: sorted(e["id"] for e in r["elements"]) for r in engine.query("group Sailor by .ashore").collect()}
    assert bare == {False: [1, 2, 4, 5], True: [3]}
    shaped = engine.query("select (group Sailor by .rank) { r := .key.rank, crew := .elements { name } } order by .r limit 1").first()
    assert sorted(c["name"] for c in shaped["crew"]) == ["Rui", "Siv"]


def test_loops_over_groups(engine):
    assert sorted(rows(engine.query("for g in (group Sailor by .rank) union (select g.elements { name } order by .years limit 1)"))) == [("Odd",), ("Rui",), ("Tor",)]
    assert sorted(rows(engine.query("for g in (group Sailor by .ashore) union ({ a := g.key.ashore, y := sum(g.elements.years) })"))) == [(False, 70), (True, 3)]


def test_nested_loops(engine):
    assert sorted(rows(engine.query("for x in {1, 2} union (for y in {10, 20} union (x + y))"))) == [(11,), (12,), (21,), (22,)]


def test_unset_values_are_empty_in_paths_and_null_in_shapes(engine):
    assert len(rows(engine.query("select Sailor.rank"))) == 4 and len(rows(engine.query("select Sailor { rank }"))) == 5


def test_backlinks(engine):
    assert rows(engine.query("select Port { name } filter exists .<port[is Ship]")) == [("Lisbon",)]
    assert sorted(rows(engine.query("select Port { name, n := count(.<port[is Ship].<ship[is Sailor]) }"))) == [("Lisbon", 3), ("Narvik", 0)]


def test_quantifiers_over_nothing(engine):
    assert rows(engine.query("select Ship { name } filter all(.<ship[is Sailor].ashore)")) == [("Auk",)]
    assert rows(engine.query("select Port { name } filter any(.<port[is Ship].tons > 80)")) == [("Lisbon",)]
    assert rows(engine.query("select any(<bool>{})")) == [(False,)]


def test_multi_link_shapes_stay_arrays(engine):
    got = engine.query("select Sailor { name, badges: { name, @since } order by @since desc } order by .name limit 2").collect()
    assert [(r["name"], [(t["name"], t["since"]) for t in r["badges"]]) for r in got] == [("Ines", [("knot", 2001.0), ("star", 1999.0)]), ("Odd", [("star", 2010.0)])]
    one = {r["name"]: [b["name"] for b in r["badges"]] for r in engine.query("select Sailor { name, badges: { name } order by .name limit 1 }").collect()}
    assert one == {"Ines": ["knot"], "Odd": ["star"], "Rui": [], "Siv": [], "Tor": []}
    newest = {r["name"]: r["newest"] and r["newest"]["name"] for r in engine.query("select Sailor { name, newest: { name } }").collect()}
    assert newest == {"Ines": "knot", "Odd": "star", "Rui": None, "Siv": None, "Tor": None}


def test_single_link_shape(engine):
    got = {r["name"]: r["ship"] and r["ship"]["name"] for r in engine.query("select Sailor { name, ship: { name } }").collect()}
    assert got == {"Ines": "Petrel", "Odd": "Petrel", "Rui": "Auk", "Siv": None, "Tor": None}


def test_asserted_pointers(engine):
    assert len(engine.query("select Ship { name, crew := assert_exists(.<ship[is Sailor] { name }) }").collect()) == 2
    with pytest.raises(Exception, match="'crew' doesn't hold"):
        engine.query("select Port { crew := assert_exists(.<port[is Ship] { name }) }").collect()
    with pytest.raises(Exception, match="at most one"):
        engine.query("select assert_single(Sailor)").collect()


def test_bound_sets_in_filters(engine):
    assert sorted(rows(engine.query("with x := {4, 9, 16} select x filter x > 5"))) == [(9,), (16,)]
    assert rows(engine.query("with s := (select Sailor filter .rank = 'mate') select s { name } filter s.years > 10")) == [("Ines",)]


def test_ordered_array_agg(engine):
    assert rows(engine.query("select array_agg((select Sailor order by .years desc).name)")) == [(["Tor", "Siv", "Ines", "Odd", "Rui"],)]
    got = dict(rows(engine.query("select Ship { name, crew := array_agg((select .<ship[is Sailor] order by .years).name) }")))
    assert got == {"Petrel": ["Odd", "Ines"], "Auk": ["Rui"]}


def test_ties_of_an_ordered_array_agg_do_not_follow_the_layout(spark):
    crew = [(i, f"{i % 7}-{i}", "mate", i // 20, False, i % 2 + 1) for i in range(80)]
    got = []
    for order, parts in ((crew, 1), (crew[::-1], 1), (crew[40:] + crew[:40], 3)):
        tables = {n: spark.createDataFrame(*TABLES[n]) for n in TABLES if n != "sailor"}
        engine = Engine(spark, Schema(TYPES), {**tables, "sailor": spark.createDataFrame(order, TABLES["sailor"][1]).coalesce(parts)})
        whole = engine.query("select array_agg((select Sailor order by .years desc).name)").first()[0]
        got.append((whole, dict(rows(engine.query("select Ship { id, crew := array_agg((select .<ship[is Sailor] order by .years desc).name) }")))))
    want = sorted(crew, key=lambda c: (-c[3], c[1]))
    assert got == [([c[1] for c in want], {s: [c[1] for c in want if c[5] == s] for s in (1, 2)})] * 3


def test_sets_in_expressions(engine):
    assert sorted(rows(engine.query("select array_unpack([5, 6]) + 1"))) == [(6,), (7,)]
    assert rows(engine.query("select count(Port.name union Ship.name)")) == [(4,)]
    assert rows(engine.query("select count(detached Sailor)")) == [(5,)]


def test_order_puts_empties_last_unless_asked(engine):
    assert rows(engine.query("select Sailor { rank } order by .rank desc limit 1")) == [("mate",)]
    assert rows(engine.query("select Sailor { rank } order by .rank empty first limit 1")) == [(None,)]
    assert sorted(rows(engine.query("select Sailor { d := .rank ?? 'boy' }")))[0] == ("boy",)


def test_parameters_and_errors(engine):
    assert rows(engine.query("select Sailor { name } filter .years > $n order by .years limit 1", n=15)) == [("Siv",)]
    assert rows(engine.query("select <optional str>$w ?? 'none'")) == [("none",)]
    wrong = (
        ("select Nobody", "unknown type"), ("select Sailor { nam }", "no link or property"), ("select str_uper('a')", "did you mean 'str_upper'"), ("select Sailor filter .name = 1", "cannot be applied"),
        ("select Sailor filter .years > $n", "missing parameter"), ("select round(2.345, 2)", "no overload"), ("select Sailor for update", "row locks"), ("select str_len('a', 'b')", "no overload"), ("select postgis::buffer('POINT(0 0)', 1.0)", "geometry library"),
    )
    for text, part in wrong:
        with pytest.raises(QueryError, match=part):
            engine.query(text).collect()
    with pytest.raises(QueryError, match="unknown parameter"):
        engine.query("select 1", n=3)
    with pytest.raises(SchemaError):
        Schema([ObjectType("A", "a", links={"b": Link("B", "b_id")})])


def test_builder_makes_the_same_trees(engine):
    m = Model(engine, "Sailor").filter(lambda e: (e.years > 5) & ~(e.name == "Tor")).select("name", more=lambda e: e.years + 1).order_by("-years").limit(2)
    assert rows(m.df()) == rows(engine.query("select Sailor { name, more := .years + 1 } filter .years > 5 and not (.name = 'Tor') order by .years desc limit 2"))
    assert rows(Model(engine, "Port").select("name", n=lambda o: std.count(o.backlink("port", "Ship"))).order_by("name").df()) == [("Lisbon", 2), ("Narvik", 0)]
    with pytest.raises(TypeError):
        bool(std.count(1))


# --- writes


def test_rows_written(engine):
    engine.query("insert Badge { name := 'wave' }")
    assert rows(engine.query("select Badge { id, name } filter .name = 'wave'")) == [(3, "wave")]
    engine.query("insert Badge { id := 1, name := 'again' } unless conflict")
    engine.query("update Sailor filter .rank = 'mate' set { years := .years + 1 }")
    assert rows(engine.query("select sum(Sailor.years)")) == [(75,)]
    engine.query("delete Sailor filter .ashore")
    assert rows(engine.query("select { n := count(Sailor), t := count(Badge) }")) == [(4, 3)]
    with pytest.raises(QueryError, match="multi links"):
        engine.query("update Sailor set { years += 1 }")


def test_loops_insert(engine):
    assert engine.query("for n in {'fog', 'ice', 'sun'} union (insert Badge { name := n })").count() == 3
    assert rows(engine.query("select Badge { id, name } order by .id limit 2")) == [(1, "knot"), (2, "star")] and len(rows(engine.query("select distinct Badge.id"))) == 5
    engine.query("for s in (select Ship) union (insert Badge { name := s.name })")
    assert {"Petrel", "Auk"} <= {r[0] for r in rows(engine.query("select Badge.name"))}


def test_nested_insert_and_statements_as_sources(engine):
    engine.query("insert Ship { name := 'Tern', tons := 5, port := (insert Port { name := 'Cork' }) }")
    assert rows(engine.query("select Ship { port_name := .port.name } filter .name = 'Tern'")) == [("Cork",)]
    assert rows(engine.query("select (insert Port { name := 'Brest' }) { name }")) == [("Brest",)]
    assert rows(engine.query("select (delete Port filter .name = 'Brest') { name }")) == [("Brest",)]
    assert rows(engine.query("select count(Port)")) == [(3,)]
    assert engine.query("select (insert Port { name := 'No' }) if false else {}").count() == 0


def test_multi_links(engine):
    worn = "select Sailor { b := array_agg((select .badges order by .name).name) } filter .name = 'Odd'"
    engine.query("update Sailor filter .name = 'Odd' set { badges += (select Badge { @since := 2020.0 } filter .name = 'knot') }")
    assert rows(engine.query(worn)) == [(["knot", "star"],)]
    assert rows(engine.query("select Sailor { s := sum(.badges@since) } filter .name = 'Odd'")) == [(4030.0,)]
    engine.query("update Sailor filter .name = 'Odd' set { badges -= (select Badge filter .name = 'star') }")
    assert rows(engine.query(worn)) == [(["knot"],)]
    engine.query("update Sailor filter .name = 'Odd' set { badges := (select Badge) }")
    assert rows(engine.query(worn)) == [(["knot", "star"],)]
    engine.query("update Sailor filter .name = 'Odd' set { badges := {} }")
    assert rows(engine.query(worn)) == [([],)]


def test_links_are_removed_without_a_row_for_each_pair(spark, monkeypatch):
    from orrery.operators import mutate

    n = 300
    worn = [(s, b, 0.0) for s in range(n) for b in (s, s + 1, s + 1, n + 5, None)] + [(None, 1, 0.0), (n + 9, 1, 0.0)]
    tables = {
        **{t: spark.createDataFrame(*TABLES[t]) for t in ("port", "ship")},
        "sailor": spark.createDataFrame([(i, "x", "mate", i, False, None) for i in range(n)], TABLES["sailor"][1]),
        "badge": spark.createDataFrame([(i, f"b{i}") for i in range(n)], TABLES["badge"][1]), "worn": spark.createDataFrame(worn, TABLES["worn"][1]),
    }
    engine, made, whole = Engine(spark, Schema(TYPES), tables), [], mutate.frozen

    def counted(df):
        out = whole(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(mutate, "frozen", counted)
    engine.query("update Sailor filter .years < 250 set { badges -= (select Badge filter .id < 200) }")
    stay = [w for w in worn if None in w or not (w[0] < 250 and w[1] < 200)]
    assert sorted(rows(engine.table("worn")), key=repr) == sorted(stay, key=repr)
    assert max(made) <= n


def test_save_transactions_sql_dump(engine, tmp_path):
    ids = engine.save("Ship", {"name": "Skua", "tons": 3, "port": {"name": "Oban"}}, {"id": 1, "name": "Petrel II"})
    assert ids == [3, 1] and rows(engine.query("select Ship { p := .port.name } filter .name = 'Skua'")) == [("Oban",)]
    with pytest.raises(RuntimeError), engine.transaction():
        engine.query("delete Badge")
        raise RuntimeError
    assert rows(engine.sql("SELECT count(*) FROM badge WHERE name <> :n", n="knot")) == [(1,)]
    engine.dump(str(tmp_path / "d"))
    engine.query("delete Badge")
    engine.restore(str(tmp_path / "d"))
    assert rows(engine.query("select count(Badge)")) == [(2,)]
    assert "Scan" in "".join(r[0] for r in rows(engine.query("analyze select Port { name }")))
    assert rows(engine.query("select sequence_next('bell')")) + rows(engine.query("select sequence_next('bell')")) == [(1,), (2,)]
    assert rows(engine.query("select sequence_reset('bell', 9)")) == [(9,)]


def governed(spark, **link):
    types = [
        ObjectType("Port", "port", properties={"name": "name"}, constraints=(Constraint("exclusive", ("name",)), Constraint("min_len", ("name",), 3)), triggers=(Trigger(("insert",), "insert Note { text := __new__.name }"),)),
        ObjectType("Ship", "ship", properties={"name": "name", "tons": "tons"}, links={"port": Link("Port", "port_id", **link)}, defaults={"tons": "select 7"}, rewrites=(Rewrite("name", "select str_upper(.name)"),), constraints=(Constraint("max", ("tons",), 500), Constraint("readonly", ("tons",)))),
        ObjectType("Note", "note", properties={"text": "text"}),
    ]
    tables = {n: spark.createDataFrame(*TABLES[n]) for n in ("port", "ship")} | {"note": spark.createDataFrame([], "id long, text string")}
    return Engine(spark, Schema(types), tables)


def test_constraints_defaults_rewrites_triggers(spark):
    e = governed(spark)
    e.query("insert Port { name := 'Turku' }")
    assert rows(e.query("select Note.text")) == [("Turku",)]
    e.query("insert Ship { name := 'tern' }")
    assert rows(e.query("select Ship { name, tons } filter .id = 3")) == [("TERN", 7)]
    for text, part in (("insert Port { name := 'Lisbon' }", "second object"), ("insert Port { name := 'X' }", "min_len"), ("insert Ship { name := 'big', tons := 900 }", "constraint max"), ("update Ship set { tons := 1 }", "read-only")):
        with pytest.raises(QueryError, match=part):
            e.query(text)
    assert rows(e.query("select count(Port)")) == [(3,)]
    with pytest.raises(SchemaError, match="fire itself"):
        Schema([ObjectType("A", "a", properties={"x": "x"}, triggers=(Trigger(("insert",), "insert A { x := 1 }"),))])


def test_deletion_policies(spark):
    with pytest.raises(QueryError, match="still linked"):
        governed(spark, on_target_delete="restrict").query("delete Port filter .name = 'Lisbon'")
    e = governed(spark, on_target_delete="delete_source")
    e.query("delete Port filter .name = 'Lisbon'")
    assert rows(e.query("select { p := count(Port), s := count(Ship) }")) == [(1, 0)]
    e = governed(spark)
    e.query("delete Port filter .name = 'Lisbon'")
    assert rows(e.query("select Ship { p := .port.name } order by .id")) == [(None,), (None,)]
    e = governed(spark, on_source_delete="delete_target_if_orphan")
    e.query("delete Ship filter .name = 'Auk'")
    assert rows(e.query("select count(Port)")) == [(2,)]
    e.query("delete Ship")
    assert rows(e.query("select Port.name")) == [("Narvik",)]


# --- functions

GOLDEN = [
    ("[7,8,9][-1]", 9), ("'harbour'[-2]", "u"), ("re_replace('o','0','oolong')", "0olong"), ("re_replace('o','0','oolong', flags := 'g')", "00l0ng"), ("find([4,5,4,6],4,1)", 2), ("bit_count(<bytes>'zz')", 10), ("to_int64('2,048','9G999')", 2048),
    ("overlaps(range(2,6), range(5,7))", True), ("<str><datetime>'2031-05-06T07:08:09Z'", "2031-05-06T07:08:09+00:00"), ("cal::date_get(<cal::local_date>'2031-05-06','isodow')", 2.0), ("<int64>3.5", 4), ("round(0.5)", 0.0), ("-9 // 4", -3), ("-9 % 4", -1),
    ("str_split('', ',')", []), ("str_slice('anchor', 2, 4)", "ch"), ("'anchor'[1:-2]", "nch"), ("[3,4,5][:2]", [3, 4]), ("str_trim('  b ')", "b"), ("bit_count(<int16>-2)", 15), ("to_bytes(<int16>258, 'Little')", bytearray(b"\x02\x01")), ("math::log(1000.0)", 3.0),
    ("array_rotate([1,2,3,4], 1)", [2, 3, 4, 1]), ("(a := 4, b := 'q').b", "q"), ("(5, 6).1", 6), ("re_match('([a-z]+)([0-9]+)', 'xx42')", ["xx", "42"]), ("re_match('[0-9]', 'none')", []), ("b'a\\x01'", bytearray(b"a\x01")),
    ("contains(multirange([range(1, 3), range(2, 6)]), range(1, 6))", True), ("len(array_unpack([multirange([range(1, 3), range(3, 6)])])) ?? 0", 1), ("to_str(12.5, 'FM999.9')", "12.5"), ("duration_to_seconds(<duration>'PT1H30M') = 5400", True), ("duration_to_seconds(<duration>'90 minutes') = 5400", True),
    ("duration_to_seconds(duration_truncate(<duration>'PT1H30M', 'hours')) = 3600", True), ("cal::duration_normalize_days(cal::to_date_duration(days := 65)).months", 2), ("cal::duration_normalize_hours(cal::to_relative_duration(hours := 50)).days", 2),
    ("<str>json_get(json_set(to_json('{\"a\": {\"b\": 1}}'), 'a', 'b', value := to_json('5')), 'a', 'b')", "5"), ("<str>cal::to_local_time(<int64>7, 5, 9.0)", "07:05:09"), ("cal::time_get(<cal::local_time>'07:05:09', 'midnightseconds')", 25509.0),
    ("uuid_extract_version(uuid_generate_v7())", 7), ("sys::get_version().0", 0), ("crypto::crypt('password', '$1$abcdefgh')", "$1$abcdefgh$G//4keteveJp0qb8z2DxG/"),
    ("pgvector::euclidean_distance([0.0, 0.0], [3.0, 4.0])", 5.0), ("pgvector::neg_inner_product([1.0, 2.0], [3.0, 4.0])", -11.0),
]


@pytest.mark.parametrize(("text", "value"), GOLDEN)
def test_golden_scalars(engine, text, value):
    assert engine.query(f"select {{ v := {text} }}").first()["v"] == value


def test_hmac(engine):
    import hashlib
    import hmac

    assert bytes(engine.query("select crypto::hmac('data', 'key', 'sha256')").first()[0]) == hmac.new(b"key", b"data", hashlib.sha256).digest()


def test_out_of_bounds(engine):
    with pytest.raises(Exception, match="array index -4 is out of bounds"):
        engine.query("select { v := [1,2][-4] }").collect()
