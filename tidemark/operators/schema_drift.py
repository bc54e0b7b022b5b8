"""Schemas that drift between files (problem 1).

Each record's schema is a tree: field names and JSON types, nested objects as
subtrees. Where the tree of a source and entity changes between two positions
of the log, the minimum-cost script of adds, deletes, renames and moves turns
the old tree into the new one (unordered tree edit distance, siblings matched
by an assignment of least cost). A rename is worth its cost only if values
carry over: of the keys seen on both sides at least half keep the value.
Scripts are then compiled into a projection that reads every record into one
table per entity.

How it runs, with hot sources in mind:

1. Signature: names and JSON types of each record as text, reduced to the
   distinct ones of each position before the first shuffle.
2. Timeline: positions are range-partitioned and sorted by (source, entity,
   position), so a source with a third of all rows is spread over many tasks;
   each task streams its range and keeps only what changed. What a range's
   first rows repeat from the range before is dropped in step 4.
3. Evidence: only for names that go at a position where others come, the last
   value before and the first after are compared per key.
4. Script: per source and entity over the compact log.

Defined results: only complete records with one of the given operations and a
position count; a null value has no type; a field whose parent object is null
is not gone; rows of one position together show the union of their names; an
empty table gives no events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

ROW_OPS = ("r", "c", "u")
#: Share of the keys seen on both sides that must keep the value.
CARRIED = 0.5
ADD = DELETE = 1.0
MOVE = 1.5
_NEVER = 1e9

_LOG = "source string, entity string, seq long, kind string, name string, value string"
_LOG_ARROW = pa.schema([("source", pa.string()), ("entity", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string())])
_SIG_ARROW = pa.schema([("source", pa.string()), ("entity", pa.string()), ("seq", pa.int64()), ("sig", pa.string())])
_TYPES = {type(None): None, str: "string", bool: "boolean", int: "long", float: "double", list: "array"}


# --- Signatures -----------------------------------------------------------------


def _kind(value) -> str | dict | None:
    if isinstance(value, dict):
        return {k: _kind(v) for k, v in value.items()}
    return _TYPES[type(value)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (source, entity, seq, signature) of each batch of records.

    JSON's own spelling decides between long and double (4 and 4.0), which a
    variant does not keep, hence not in the JVM. The text is parsed once;
    signatures of flat records are looked up by names and types.
    """
    known: dict[tuple, str] = {}
    for b in batches:
        seen = {}
        source, entity, seq, record = (c.to_pylist() for c in b.columns)
        for i, text in enumerate(record):
            try:
                fields = json.loads(text)
            except (ValueError, RecursionError):
                continue
            if not isinstance(fields, dict):
                continue
            shape = (*fields, *map(type, fields.values()))
            sig = known.get(shape)
            if sig is None:
                sig = json.dumps(_kind(fields), sort_keys=True)
                if dict not in shape and len(known) < 50_000:
                    known[shape] = sig
            seen[source[i], entity[i], seq[i], sig] = None
        columns = list(zip(*seen)) if seen else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIG_ARROW)], schema=_SIG_ARROW)


def _flatten(tree: dict, prefix: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str | None]]:
    for name, kind in tree.items():
        path = (*prefix, name)
        if isinstance(kind, dict):
            yield path, "object"
            yield from _flatten(kind, path)
        else:
            yield path, kind


@lru_cache(maxsize=4096)
def _fields(sig: str) -> dict[tuple[str, ...], str | None]:
    return dict(_flatten(json.loads(sig)))


def _path_text(path: tuple[str, ...]) -> str:
    return path[0] if len(path) == 1 else "\x1f".join(path)


# --- Timeline -------------------------------------------------------------------


class _Stream:
    """What is known of one source and entity while its positions stream by."""

    def __init__(self) -> None:
        self.names: frozenset | None = None
        self.types: dict[tuple[str, ...], str] = {}

    def position(self, sigs: list[str]) -> Iterator[tuple[str, str, str]]:
        names, typed = set(), []
        for sig in sigs:
            fields = _fields(sig)
            names.update(fields)
            typed.append(fields)
        # A null object says nothing about the fields below it; a range's first rows leave that to _steps.
        void = {p for f in typed for p, t in f.items() if t is None}
        names.update(p for p in self.names or () if any(p[:i] in void for i in range(1, len(p))))
        new = frozenset(names)
        if new != self.names:
            for p in new - (self.names or frozenset()):
                self.types.pop(p, None)
            self.names = new
            yield "names", "", json.dumps([sorted(map(_path_text, new)), sorted(map(_path_text, void))])
        for fields in typed:
            for p, t in fields.items():
                if t is not None and self.types.get(p) != t:
                    self.types[p] = t
                    yield "type", _path_text(p), t


def _timeline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of names and types within a sorted range of (source, entity, seq, sig)."""
    held: list[tuple] = []
    group, seq, sigs, stream = None, None, [], _Stream()

    def close() -> None:
        for kind, name, value in stream.position(sigs):
            held.append((*group, seq, kind, name, value))

    for b in batches:
        for source, entity, s, sig in zip(*[c.to_pylist() for c in b.columns]):
            if (source, entity) == group and s == seq:
                sigs.append(sig)
                continue
            if group is not None:
                close()
            if (source, entity) != group:
                group, stream = (source, entity), _Stream()
            seq, sigs = s, [sig]
        if len(held) > 10_000:
            yield _log_batch(held)
            held = []
    if group is not None:
        close()
    yield _log_batch(held)


def _log_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_LOG_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LOG_ARROW)], schema=_LOG_ARROW)


def schema_log(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The compact log of (source, entity, seq, kind, name, value) changes.

    ``rows``: source, entity, seq, record.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.select("source", "entity", "seq", "record").mapInArrow(_signatures, "source string, entity string, seq long, sig string").distinct()
    seen = materialize(seen, "signatures")
    ordered = seen.repartitionByRange(ranges, "source", "entity", "seq").sortWithinPartitions("source", "entity", "seq", "sig")
    return materialize(ordered.mapInArrow(_timeline, _LOG), "schema-log")


# --- Rename evidence ------------------------------------------------------------


def _steps(log: list[tuple]) -> Iterator[tuple[int, frozenset, frozenset, list[tuple[str, str]]]]:
    """(seq, names before, names after, [(name, type)]) of a group's log in order."""
    by_seq: dict[int, tuple[list, list]] = {}
    for seq, kind, name, value in log:
        names, types = by_seq.setdefault(seq, ([], []))
        if kind == "names":
            names.append(value)
        else:
            types.append((name, value))
    before: frozenset | None = None
    for seq in sorted(by_seq):
        names, types = by_seq[seq]
        after = before
        if names:
            here, void = json.loads(names[0])
            hidden = {p for p in before or () for i, c in enumerate(p) if c == "\x1f" and p[:i] in void}
            after = frozenset(here) | hidden
        yield seq, before if before is not None else after, after, sorted(types)
        before = after


def _candidates(pdf):
    import pandas as pd

    out = []
    for seq, before, after, _ in _steps(list(zip(pdf["seq"], pdf["kind"], pdf["name"], pdf["value"]))):
        out += [(pdf["source"].iloc[0], pdf["entity"].iloc[0], int(seq), old, new) for old in sorted(before - after) for new in sorted(after - before) if old.count("\x1f") == new.count("\x1f")]
    return pd.DataFrame(out, columns=["source", "entity", "at", "old", "new"])


def _json_path(name: str) -> F.Column:
    return F.concat(F.lit("$['"), F.replace(F.col(name), F.lit("\x1f"), F.lit("']['")), F.lit("']"))


def rename_evidence(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(source, entity, at, old, new, both, kept): keys with a value on both sides, and those that keep it.

    ``rows``: source, entity, seq, row_key, record. The candidates are one row
    per pair of names that go and come at one position.
    """
    pairs = materialize(log.groupBy("source", "entity").applyInPandas(_candidates, "source string, entity string, at long, old string, new string"), "rename-pairs")
    facing = rows.where(F.col("row_key").isNotNull()).join(pairs, ["source", "entity"])
    early = F.col("seq") < F.col("at")
    valued = facing.select("source", "entity", "at", "old", "new", "row_key", "seq", early.alias("early"), F.call_function("get_json_object", F.col("record"), F.when(early, _json_path("old")).otherwise(_json_path("new"))).alias("v")).where(F.col("v").isNotNull())
    # As text ordered like the position, so that the extremes are hash-aggregated: last before, first after.
    per_key = valued.groupBy("source", "entity", "at", "old", "new", "row_key").agg(
        F.max(F.when(F.col("early"), F.struct("seq", "v"))).alias("b"),
        F.min(F.when(~F.col("early"), F.struct("seq", "v"))).alias("a"),
    )
    both = per_key.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy("source", "entity", "at", "old", "new").agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("a.v") == F.col("b.v")).alias("kept"))


# --- Tree edit distance ---------------------------------------------------------


def _assign(cost: list[list[float]]) -> list[int]:
    """Columns of a least-cost assignment of rows (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _tree(paths: frozenset) -> dict:
    root: dict = {}
    for p in sorted(paths):
        node = root
        for part in p.split("\x1f"):
            node = node.setdefault(part, {})
    return root


def _weight(tree: dict) -> int:
    return sum(1 + _weight(t) for t in tree.values())


def edit_script(old: frozenset, new: frozenset, carried: dict[tuple[str, str], float]) -> tuple[float, list[tuple[str, str, str]]]:
    """(cost, [(op, path, new path)]) of least cost; op: add, delete, rename or move.

    ``old`` and ``new`` are sets of paths (parts joined by \\x1f); ``carried``
    is the share of kept values by (old path, new path).
    """

    def match(a: dict, b: dict, pa_: str, pb: str) -> tuple[float, list]:
        common = sorted(a.keys() & b.keys())
        total, ops = 0.0, []
        for name in common:
            c, o = match(a[name], b[name], f"{pa_}{name}\x1f", f"{pb}{name}\x1f")
            total, ops = total + c, ops + o
        left, right = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
        if left:
            inner = {}
            size = len(left) + len(right)
            cost = []
            for i, x in enumerate(left):
                gone = DELETE * (1 + _weight(a[x]))
                line = []
                for j, y in enumerate(right):
                    share = carried.get((pa_ + x, pb + y), 0.0)
                    inner[i, j] = match(a[x], b[y], f"{pa_}{x}\x1f", f"{pb}{y}\x1f")
                    # Less than a delete and an add if enough values carry over, else never.
                    line.append(inner[i, j][0] + (1.0 - share / 2 if share >= CARRIED else _NEVER) - ADD * (1 + _weight(b[y])))
                cost.append(line + [gone if k == i else _NEVER for k in range(len(left))])
            chosen = _assign(cost)
        else:
            chosen = []
        taken = set()
        for i, j in enumerate(chosen):
            if j < len(right):
                taken.add(j)
                total += inner[i, j][0] + 1.0 - carried[pa_ + left[i], pb + right[j]] / 2
                ops.append(("rename", pa_ + left[i], pb + right[j]))
                ops += inner[i, j][1]
            else:
                total += DELETE * (1 + _weight(a[left[i]]))
                ops.append(("delete", pa_ + left[i], ""))
        for j, y in enumerate(right):
            if j not in taken:
                total += ADD * (1 + _weight(b[y]))
                ops.append(("add", pb + y, ""))
        return total, ops

    def at(tree: dict, path: str) -> dict:
        for part in path.split("\x1f"):
            tree = tree[part]
        return tree

    a, b = _tree(old), _tree(new)
    total, ops = match(a, b, "", "")
    # A subtree that goes in one object and comes under its name in another has moved, if that and the edits within cost less.
    gone, come = [o[1] for o in ops if o[0] == "delete"], [o[1] for o in ops if o[0] == "add"]
    if gone and come and any("\x1f" in p for p in (*gone, *come)):
        last = lambda p: p.rpartition("\x1f")[2]
        inner, cost = {}, []
        for x in gone:
            line = []
            for y in come:
                saved = _NEVER
                if last(x) == last(y):
                    inner[x, y] = match(at(a, x), at(b, y), f"{x}\x1f", f"{y}\x1f")
                    saved = MOVE + inner[x, y][0] - DELETE * (1 + _weight(at(a, x))) - ADD * (1 + _weight(at(b, y)))
                line.append(saved)
            cost.append(line + [0.0] * len(gone))
        for x, j in zip(gone, _assign(cost)):
            if j < len(come) and cost[gone.index(x)][j] < 0:
                y = come[j]
                total += cost[gone.index(x)][j]
                ops.remove(("delete", x, ""))
                ops.remove(("add", y, ""))
                ops += [("move", x, y), *inner[x, y][1]]
    return total, ops


def apply_script(old: frozenset, ops: list[tuple[str, str, str]], new: frozenset) -> frozenset:
    """The paths that a script makes of ``old``; what it adds is taken from ``new``.

    Paths that go are named as in the old tree, those that come as in the new
    one; what is renamed or moved takes what is below it along.
    """
    places = {p: to for op, p, to in ops if op in ("rename", "move")}
    deleted = {p for op, p, _ in ops if op == "delete"}

    def place(path: str) -> str | None:
        if path in deleted:
            return None
        if path in places:
            return places[path]
        above, _, name = path.rpartition("\x1f")
        if not above:
            return path
        there = place(above)
        return None if there is None else f"{there}\x1f{name}"

    out = {q for p in old if (q := place(p)) is not None}
    added = [p for op, p, _ in ops if op == "add"]
    return frozenset(out | {p for p in new for a in added if p == a or p.startswith(a + "\x1f")})


# --- Events ---------------------------------------------------------------------

_EVENTS = "source string, entity string, change_kind string, field_name string, new_name string, seq long"
_KINDS = {"add": "added", "delete": "removed", "rename": "renamed", "move": "moved"}


def _events(log, evidence):
    import pandas as pd

    out = []
    if len(log):
        source, entity = log["source"].iloc[0], log["entity"].iloc[0]
        shares: dict[int, dict] = {}
        for at, old, new, both, kept in zip(*(evidence[c] for c in ("at", "old", "new", "both", "kept"))):
            shares.setdefault(int(at), {})[old, new] = kept / both
        past: dict[str, str] = {}
        for seq, before, after, types in _steps(list(zip(log["seq"], log["kind"], log["name"], log["value"]))):
            if before != after:
                for op, name, to in sorted(edit_script(before, after, shares.get(seq, {}))[1]):
                    out.append((source, entity, _KINDS[op], _shown(name), _shown(to), seq))
                    if op in ("rename", "move"):
                        for old in [p for p in past if p == name or p.startswith(name + "\x1f")]:
                            past[to + old[len(name) :]] = past.pop(old)
            for name, kind in types:
                if past.get(name, kind) != kind:
                    out.append((source, entity, "retyped", _shown(name), "", seq))
                past[name] = kind
    return pd.DataFrame(out, columns=["source", "entity", "change_kind", "field_name", "new_name", "seq"])


def _shown(path: str) -> str:
    return path.replace("\x1f", ".")


def drift_events(rows: DataFrame) -> DataFrame:
    """(source, entity, change_kind, field_name, new_name, seq) of every change of a field.

    ``rows``: source, entity, seq, row_key, record, already limited to the
    records that count. Nested fields are named by dotted paths.
    """
    log = schema_log(rows)
    evidence = rename_evidence(rows.select("source", "entity", "seq", "row_key", "record"), log)
    return log.groupBy("source", "entity").cogroup(evidence.groupBy("source", "entity")).applyInPandas(_events, _EVENTS)


# --- Projection -----------------------------------------------------------------


def _aliases(events, log):
    """Every (actual name, from, to) with the name it has in the one table."""
    import pandas as pd

    out = []
    if len(log):
        source, entity = log["source"].iloc[0], log["entity"].iloc[0]
        renames: dict[int, dict] = {}
        for kind, name, to, seq in zip(*(events[c] for c in ("change_kind", "field_name", "new_name", "seq"))):
            if kind in ("renamed", "moved"):
                renames.setdefault(int(seq), {})[name] = to
        live: dict[str, tuple[str, int]] = {}
        for seq, _, after, _ in _steps(list(zip(log["seq"], log["kind"], log["name"], log["value"]))):
            tops = {p for p in after if "\x1f" not in p}
            carried = {to: live.get(name, (name, 0))[0] for name, to in renames.get(seq, {}).items()}
            for name in [n for n in live if n not in tops]:
                canonical, start = live.pop(name)
                out.append((source, entity, name, canonical, start, seq))
            for name in sorted(tops - live.keys()):
                canonical = carried.get(name, name)
                # A name that comes back while its first field lives on under another one is another field.
                if name not in carried and any(c == name for c, _ in live.values()):
                    canonical = f"{name}__{seq}"
                live[name] = (canonical, seq)
        out += [(source, entity, name, canonical, start, 2**63 - 1) for name, (canonical, start) in live.items()]
    return pd.DataFrame(out, columns=["source", "entity", "name", "canonical", "start", "stop"])


def unify(rows: DataFrame, declared: DataFrame, entity: str) -> DataFrame:
    """One consistent table of an entity: its declared columns, then those that came later.

    ``declared``: entity, field_name, field_no, target_type. The scripts are
    compiled into aliases (source, actual name, range of positions) ->
    canonical name, applied to each record as one map lookup. Declared fields
    are read by their target type whatever the JSON type was (a decimal comma,
    thousands marks, epoch milliseconds and quoted numbers included); what cannot be
    read, a whole number with a fraction included, is null and counted in
    ``_unread``. Later fields are text; a name that comes back as another field
    is a column of its own, named with its first position. Fields within objects
    stay in their object's text: their changes are reported, not applied.
    """
    own = rows.where(F.col("entity") == entity)
    log = schema_log(own)
    evidence = rename_evidence(own.select("source", "entity", "seq", "row_key", "record"), log)
    events = log.groupBy("source", "entity").cogroup(evidence.groupBy("source", "entity")).applyInPandas(_events, _EVENTS)
    compiled = events.groupBy("source", "entity").cogroup(log.groupBy("source", "entity")).applyInPandas(_aliases, "source string, entity string, name string, canonical string, start long, stop long")
    aliases = materialize(compiled, "aliases")
    fields = [(r.field_name, r.target_type) for r in declared.where(F.col("entity") == entity).orderBy("field_no").collect()]
    names = {n for n, _ in fields}
    # Column names of the result: schema metadata, one row per distinct later field.
    later = sorted(r[0] for r in aliases.select("canonical").distinct().collect() if r[0] not in names)
    changed = aliases.where(F.col("name") != F.col("canonical")).groupBy("source").agg(F.collect_list(F.struct("name", "canonical", "start", "stop")).alias("alias"))
    joined = own.join(changed, "source", "left").withColumn("raw", F.from_json("record", "map<string,string>"))
    live = F.filter("alias", lambda x: (F.col("seq") >= x["start"]) & (F.col("seq") < x["stop"]))
    renamed = F.map_from_entries(F.transform(live, lambda x: F.struct(x["canonical"], F.try_element_at("raw", x["name"]))))
    # A canonical name that a record also uses for an unrelated field gives way to the alias.
    values = joined.withColumn("renamed", F.coalesce(renamed, F.create_map().cast("map<string,string>")))

    def value(name: str) -> F.Column:
        hidden = F.exists(F.coalesce(F.col("alias"), F.array().cast("array<struct<name:string,canonical:string,start:bigint,stop:bigint>>")), lambda x: (x["name"] == name) & (F.col("seq") >= x["start"]) & (F.col("seq") < x["stop"]))
        return F.coalesce(F.try_element_at("renamed", F.lit(name)), F.when(~hidden, F.try_element_at("raw", F.lit(name))))

    columns = [_typed(value(n), t).alias(n) for n, t in fields] + [value(n).alias(n) for n in later]
    unread = [(value(n).isNotNull() & _typed(value(n), t).isNull()).cast("int") for n, t in fields]
    return values.select(F.col("source").alias("_source"), F.col("seq").alias("_seq"), sum(unread, F.lit(0)).alias("_unread"), *columns)


def _typed(text: F.Column, target: str) -> F.Column:
    if target == "timestamp":
        millis = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+]?\d+)?$"), text.try_cast("double"))
        return F.coalesce(F.timestamp_millis(millis.cast("long")), text.try_cast("timestamp"))
    # The last of commas and points is the decimal mark; one that repeats, or stands before the other, marks thousands.
    plain = (
        F.when(text.rlike(r",.*\.|,.*,"), F.replace(text, F.lit(","), F.lit("")))
        .when(text.rlike(r"\..*,|\..*\."), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(F.replace(text, F.lit(","), F.lit(".")))
    )
    if target.startswith("decimal"):
        return plain.try_cast(target)
    if target in ("int", "long", "bigint"):
        exact = plain.try_cast("decimal(38,10)")
        return F.when(exact == F.floor(exact), exact).try_cast(target)
    return text.try_cast(target)
