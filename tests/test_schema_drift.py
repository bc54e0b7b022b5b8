import json
import random
from collections import defaultdict

import duckdb
import pytest

import oracle
from tidemark.operators import schema_drift as sd
from tidemark.plans import registry


def kind(v):
    return {bool: "boolean", int: "long", float: "double", str: "string", type(None): None}[type(v)]


def brute(rows):
    """Events of flat records, by walking each source and entity in order."""
    groups = defaultdict(lambda: defaultdict(list))
    for source, entity, seq, key, text in rows:
        groups[source, entity][seq].append((key, json.loads(text)))
    events = set()
    for group, by in groups.items():
        names, past, last = None, {}, defaultdict(dict)
        order = sorted(by)
        for seq in order:
            now = set().union(*(r for _, r in by[seq]))
            if names is not None and now != names:
                used = set()
                for old in sorted(names - now):
                    hit = None
                    for new in sorted(now - names - used):
                        first = {}
                        for s in order[order.index(seq) :]:
                            for key, r in by[s]:
                                if r.get(new) is not None:
                                    first.setdefault(key, r[new])
                        both = [k for k in first if k in last[old]]
                        if both and 2 * sum(str(first[k]) == str(last[old][k]) for k in both) >= len(both):
                            hit = hit or new
                    if hit:
                        used.add(hit)
                        events.add((*group, "renamed", old, hit, seq))
                        if old in past:
                            past[hit] = past.pop(old)
                    else:
                        events.add((*group, "removed", old, "", seq))
                events |= {(*group, "added", new, "", seq) for new in now - names - used}
            names = now
            for key, r in by[seq]:
                for n, v in r.items():
                    if kind(v):
                        if past.get(n, kind(v)) != kind(v):
                            events.add((*group, "retyped", n, "", seq))
                        past[n], last[n][key] = kind(v), v
    return events


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "source string, entity string, seq long, row_key string, record string, sig string, name string")
    got = [(r.source, r.entity, r.change_kind, r.field_name, r.new_name, r.seq) for r in sd.drift_events(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def history(rnd, source, n=120):
    """Records whose schema drifts at some positions; values belong to keys."""
    fields, out = {"id": "id", "a": "a", "b": "b", "c": "c"}, []
    typed = {"a": lambda v: v, "b": lambda v: v + 0.5, "c": lambda v: f"s{v}"}
    for seq in range(1, n):
        if seq % 25 == 0:
            what = rnd.choice(["add", "drop", "rename", "retype"])
            if what == "add":
                fields[f"new{seq}"] = f"new{seq}"
            elif what == "drop" and len(fields) > 2:
                fields.pop(rnd.choice([f for f in fields if f != "id"]))
            elif what == "rename":
                old = rnd.choice([f for f in fields if f != "id"])
                fields[f"{old}_v{seq}"] = fields.pop(old)
            else:
                typed["a"] = lambda v: str(v)
        key = f"{source}-{rnd.randrange(6)}"
        rec = {shown: key if real == "id" else None if rnd.random() < 0.1 and real != "id" else typed.get(real, lambda v: True)(hash_of(key, real)) for shown, real in fields.items()}
        out.append((source, "e", seq, key, json.dumps(rec)))
    return out


def hash_of(key, field):
    return sum(map(ord, key + field)) * 7919 % 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rnd = random.Random(seed)
    rows = [r for s in ("hot", "x", "y") for r in history(rnd, s, 400 if s == "hot" else 120)]
    rows += rnd.sample(rows, 60)
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_the_test_table(spark):
    root = f"{oracle.DATA}/sf0.001"
    got = {tuple(r) for r in registry.QUERIES["p1_found"](spark, root).select("source_db", "entity", "change_kind", "field_name", "new_name", "first_lsn").collect()}
    con = oracle.connect(root)
    keys = dict(con.execute("SELECT entity, field_name FROM entity_fields WHERE is_row_key").fetchall())
    rows = [(s, e, n, json.loads(r)[keys[e]], r) for s, e, n, r in con.execute("SELECT source_db, entity, lsn, record FROM cdc_changes WHERE op IN ('r', 'c', 'u') AND json_valid(record)").fetchall()]
    assert got == brute(rows)


def test_a_rename_needs_values_that_carry_over(spark):
    rows = [("s", "e", 1, "k", '{"id": "k", "a": "1"}'), ("s", "e", 2, "k", '{"id": "k", "b": "2"}'), ("s", "e", 3, "k", '{"id": "k", "b": "1"}')]
    assert run(spark, rows) == {("s", "e", "removed", "a", "", 2), ("s", "e", "added", "b", "", 2)}
    rows[1] = ("s", "e", 2, "k", '{"id": "k", "b": "1"}')
    assert run(spark, rows) == {("s", "e", "renamed", "a", "b", 2)}


def test_spelling_of_numbers_and_nulls(spark):
    rows = [("s", "e", 1, "k", '{"a": 4}'), ("s", "e", 2, "k", '{"a": null}'), ("s", "e", 3, "k", '{"a": 5}'), ("s", "e", 4, "k", '{"a": 5.0}'), ("s", "e", 5, "k", '{"a": true}'), ("s", "e", 6, "k", '{"a": "5"}')]
    assert run(spark, rows) == {("s", "e", "retyped", "a", "", n) for n in (4, 5, 6)}


def test_nested_fields_and_moves(spark):
    rows = [("s", "e", 1, "k", '{"id": "k", "o": {"x": 1, "y": "v"}, "p": {"q": 2}}'), ("s", "e", 2, "k", '{"id": "k", "o": null, "p": {"q": 2}}'), ("s", "e", 3, "k", '{"id": "k", "o": {"x": 1, "z": "v"}, "p": {"q": 2}}'), ("s", "e", 4, "k", '{"id": "k", "o": {"z": "v"}, "p": {"q": 2, "x": 1}}')]
    assert run(spark, rows) == {("s", "e", "renamed", "o.y", "o.z", 3), ("s", "e", "moved", "o.x", "p.x", 4)}


def test_empty_and_broken(spark):
    assert run(spark, []) == set()
    assert run(spark, [("s", "e", 1, None, "[1]"), ("s", "e", 2, None, "{"), ("s", "e", 3, None, "{}")]) == set()


def test_script_costs():
    paths = lambda *p: frozenset(x.replace(".", "\x1f") for x in p)
    assert sd.edit_script(paths("a", "b"), paths("a", "b"), {}) == (0.0, [])
    cost, ops = sd.edit_script(paths("a", "b"), paths("a", "c", "d"), {("b", "d"): 1.0})
    assert cost == 1.5 and sorted(ops) == [("add", "c", ""), ("rename", "b", "d")]
    cost, ops = sd.edit_script(paths("o", "o.x"), paths("q", "q.x"), {("o", "q"): 0.9})
    assert ops == [("rename", "o", "q")] and cost == pytest.approx(0.55)


def test_moves_keep_the_edits_within():
    paths = lambda *p: frozenset(x.replace(".", "\x1f") for x in p)
    old, new = paths("a", "a.o", "a.o.x", "a.o.y", "b"), paths("a", "b", "b.o", "b.o.x", "b.o.z")
    cost, ops = sd.edit_script(old, new, {})
    assert cost == 3.5
    assert {(o, p.replace("\x1f", "."), q.replace("\x1f", ".")) for o, p, q in ops} == {("move", "a.o", "b.o"), ("delete", "a.o.y", ""), ("add", "b.o.z", "")}
    assert sd.apply_script(old, ops, new) == new


@pytest.mark.parametrize("seed", range(5))
def test_scripts_turn_the_old_tree_into_the_new_one(seed):
    rnd = random.Random(seed)

    def tree():
        out = set()
        for _ in range(rnd.randrange(1, 12)):
            parts = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 4))]
            out |= {"\x1f".join(parts[: i + 1]) for i in range(len(parts))}
        return frozenset(out)

    for _ in range(200):
        old, new = tree(), tree()
        carried = {(x, y): 1.0 for x in old - new for y in new - old if x.count("\x1f") == y.count("\x1f") and rnd.random() < 0.3}
        cost, ops = sd.edit_script(old, new, carried)
        assert sd.apply_script(old, ops, new) == new, (old, new, ops)
        assert cost <= len(old - new) + len(new - old)


def test_a_returning_name_and_what_cannot_be_read(spark):
    declared = spark.createDataFrame([("e", "price", 1, "decimal(19,4)"), ("e", "n", 2, "int")], "entity string, field_name string, field_no int, target_type string")
    rows = [("s", "e", 1, "k", '{"price": "1,234.56", "n": 3}'), ("s", "e", 2, "k", '{"cost": "1,234.56", "n": 3.7}'), ("s", "e", 3, "k", '{"cost": "1.234,5", "price": 8, "n": "4.0"}')]
    df = spark.createDataFrame(rows, "source string, entity string, seq long, row_key string, record string")
    got = [(r["_seq"], str(r["price"]), r["n"], r["_unread"], r["price__3"]) for r in sd.unify(df, declared, "e").orderBy("_seq").collect()]
    assert got == [(1, "1234.5600", 3, 0, None), (2, "1234.5600", None, 1, None), (3, "1234.5000", 4, 0, "8")]


def test_unified_table(spark):
    declared = spark.createDataFrame([("e", "id", 1, "string"), ("e", "price", 2, "decimal(19,4)"), ("e", "at", 3, "timestamp"), ("e", "n", 4, "int")], "entity string, field_name string, field_no int, target_type string")
    rows = [("s", "e", 1, "k", '{"id": "k", "price": 1.5, "at": "2026-01-01T00:00:00Z", "n": 3}'), ("s", "e", 2, "k", '{"id": "k", "cost": 1.5, "at": 1767225600000, "n": "4"}'), ("s", "e", 3, "k", '{"id": "k", "cost": "2,25", "at": null, "n": "x", "colour": "red"}'), ("t", "e", 1, "k", '{"id": "k", "price": 9, "cost": 7}')]
    df = spark.createDataFrame(rows, "source string, entity string, seq long, row_key string, record string")
    got = sorted((r["_source"], r["_seq"], str(r["price"]), r["n"], r["colour"], r["cost"]) for r in sd.unify(df, declared, "e").collect())
    assert got == [("s", 1, "1.5000", 3, None, None), ("s", 2, "1.5000", 4, None, None), ("s", 3, "2.2500", None, "red", None), ("t", 1, "9.0000", None, None, "7")]
    assert len({r["at"] for r in sd.unify(df, declared, "e").where("_source = 's' AND _seq < 3").collect()}) == 1


def test_unified_tables_keep_every_record(spark):
    root = f"{oracle.DATA}/sf0.001"
    n = duckdb.connect().execute(f"SELECT count(*) FROM '{root}/cdc_changes.parquet' WHERE entity = 'products' AND op IN ('r', 'c', 'u') AND json_valid(record)").fetchall()[0][0]
    df = registry.QUERIES["p1_products_table"](spark, root)
    assert df.count() == n and df.where("product_id IS NULL OR created_at IS NULL").count() == 0
