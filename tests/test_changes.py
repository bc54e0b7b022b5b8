import random

from pyspark.sql import functions as F

from tidemark.operators import cdc_apply, changes, dedup_index
from tidemark.session import scratch

KEYS = {"orders": "order_id", "products": "product_id"}
SCHEMA = "arrival_id long, source_db string, entity string, op string, source_ts_ms long, lsn long, record string, ts string, seq string, bucket string, hi string, prefix string"


def feed(spark, rows):
    return changes.with_row_key(spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA), KEYS)


def row(i, op, ts, lsn, key, db="d1", entity="orders", extra=""):
    field = KEYS.get(entity, "id")
    return (i, db, entity, op, ts, lsn, f'{{"{field}": "{key}"{extra}}}')


def state(spark, *deliveries, payload=False, buckets=3):
    table = cdc_apply.UpsertTable(spark, scratch(spark, "t"), buckets)
    for rows in deliveries:
        table.apply(cdc_apply.normalize_changes(feed(spark, rows), payload))
    return table


def alive(table):
    return {(r.source, r.entity, r.row_key): r.seq for r in table.rows().collect()}


def test_completeness_and_keys(spark):
    rows = [(1, "d", "orders", "c", 1, 1, '{"order_id": "a"}'), (2, "d", "orders", "c", 1, 1, '{"order_id": "a"'), (3, "d", "orders", "m", None, 1, None), (4, "d", "orders", "c", 1, 1, "{}"), (5, "d", "what", "c", 1, 1, '{"order_id": "a"}'), (6, "d", None, "c", 1, 1, '{"order_id": null}'), (7, "d", "products", "u", 1, 1, '{"product_id": 7}')]
    got = {r.arrival_id: (r.complete, r.row_key) for r in feed(spark, rows).collect()}
    assert got == {1: (True, "a"), 2: (False, None), 3: (True, None), 4: (True, None), 5: (True, None), 6: (True, None), 7: (True, "7")}


def test_any_order_and_repetition_gives_one_state(spark):
    rnd = random.Random(5)
    rows, i = [], 0
    for lsn in range(1, 200):
        i += 1
        rows.append(row(i, rnd.choice("cuudr"), lsn // 3, lsn, "hot" if lsn % 3 else f"k{rnd.randrange(9)}"))
    last = {}
    for r in rows:
        key = r[6].split('"')[3]
        if key not in last or (r[4], r[5]) > last[key][:2]:
            last[key] = (r[4], r[5], r[3])
    expected = {("d1", "orders", k): v[1] for k, v in last.items() if v[2] != "d"}
    for n in range(3):
        again = rows + rnd.sample(rows, 40)
        rnd.shuffle(again)
        cut = rnd.randrange(len(again))
        assert alive(state(spark, again[:cut], again[cut:], [])) == expected


def test_a_late_change_does_not_revive_a_deleted_row(spark):
    table = state(spark, [row(1, "d", 5, 50, "a")], [row(2, "u", 4, 40, "a"), row(3, "c", 1, 1, "b")])
    assert alive(table) == {("d1", "orders", "b"): 1}
    assert table.rows(tombstones=True).count() == 2
    table.apply(cdc_apply.normalize_changes(feed(spark, [row(4, "c", 6, 60, "a")]), False))
    assert alive(table)[("d1", "orders", "a")] == 60


def test_nulls_and_what_does_not_count(spark):
    rows = [row(1, "u", None, 9, "a"), row(2, "u", 1, 1, "a"), row(3, "m", 9, 9, "b"), (4, "d1", "orders", "c", 9, 9, '{"order_id": "c"'), row(5, None, 9, 9, "d"), row(6, "u", 5, None, "e"), row(7, "u", 5, 2, "f", db=None)]
    assert alive(state(spark, rows)) == {("d1", "orders", "a"): 1, ("d1", "orders", "e"): cdc_apply.OLDEST, ("", "orders", "f"): 2}
    # At equal sequence the delete wins.
    assert alive(state(spark, [row(1, "d", 1, 1, "a"), row(2, "u", 1, 1, "a")])) == {}
    assert alive(state(spark, [])) == {}


def test_payload_is_the_record_of_the_last_change(spark):
    table = state(spark, [row(1, "c", 1, 1, "a", extra=', "x": 1'), row(2, "u", 2, 2, "a", extra=', "x": 2')], payload=True)
    assert [r.payload for r in table.rows().collect()] == ['{"order_id": "a", "x": 2}']


def test_partial_states_are_handed_on(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cdc_apply, "PARTIAL_ROWS", 10)
    schema = cdc_apply._ARROW
    batches = [pa.RecordBatch.from_pylist([{"source": "s", "entity": "e", "row_key": str(i), "ts": 1, "seq": b, "dead": False, "payload": "", "slot": i} for i in range(60_000)], schema) for b in range(2)]
    out = pa.Table.from_batches(list(cdc_apply._partial(iter(batches))))
    assert out.num_rows == 120_000


def test_a_bucket_of_large_records_spills(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def batches():
        for at in range(0, 60_000, 4_000):
            rows = [{"source": "s", "entity": "e", "row_key": f"k{i}", "ts": 1, "seq": 1, "dead": False, "payload": f"{i:06d}" * 700, "slot": i} for i in range(at, at + 4_000)]
            yield pa.RecordBatch.from_pylist(rows, cdc_apply._ARROW).append_column("bucket", pa.array([0] * len(rows), pa.int32()))

    (out,) = cdc_apply._bucket(batches(), {}, 0, 1, f"file://{tmp_path}")
    assert pq.ParquetFile(out.column("file")[0].as_py().removeprefix("file://")).metadata.num_rows == 60_000
    assert out.column("bytes")[0].as_py() > 250_000_000


def test_buckets_split_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(cdc_apply, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(cdc_apply, "GROUP", 2)
    table = cdc_apply.UpsertTable(spark, scratch(spark, "t"), 2)
    expected, seen = {}, []
    for n in range(4):
        rows = [row(100 * n + i, "u", n, 100 * n + i, f"k{(37 * n + i) % 90}") for i in range(60)]
        expected |= {("d1", "orders", r[6].split('"')[3]): r[5] for r in rows}
        table.apply(cdc_apply.normalize_changes(feed(spark, rows), True))
        seen.append(table.current["buckets"])
        assert alive(table) == expected
    assert seen[0] < seen[-1] and len(table.current["groups"]) == -(-seen[-1] // 2)


def test_of_two_writers_one_is_refused(spark):
    import pytest

    from tidemark.sources.files import ConflictError

    path = scratch(spark, "t")
    one, two = (cdc_apply.UpsertTable(spark, path, 2) for _ in range(2))
    one.apply(cdc_apply.normalize_changes(feed(spark, [row(1, "c", 1, 1, "a")]), False))
    with pytest.raises(ConflictError):
        two.apply(cdc_apply.normalize_changes(feed(spark, [row(2, "c", 1, 2, "b")]), False))
    again = cdc_apply.UpsertTable(spark, path)
    again.apply(cdc_apply.normalize_changes(feed(spark, [row(2, "c", 1, 2, "b")]), False))
    assert alive(again) == {("d1", "orders", "a"): 1, ("d1", "orders", "b"): 2}


def dedup(spark, deliveries, prefixes=4):
    index = dedup_index.IdIndex(spark, scratch(spark, "i"), prefixes)
    out = []
    for rows in deliveries:
        df = spark.createDataFrame([(*r, *"xxx") for r in rows], "row long, a string, b long, hi string, lo string, file string")
        out.append({r.row_id: r.repeated for r in index.process(df, [F.col("a"), F.col("b")], F.col("row")).collect()})
    return index, out


def test_first_of_each_identifier_stays(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", "hot", f"a{rnd.randrange(40)}", None, ""]), rnd.choice([1, None])) for i in range(400)]
    seen, expected = set(), {}
    for i, a, b in rows:
        expected[i] = (a, b) in seen
        seen.add((a, b))
    for cuts in ([400], [100, 200, 300, 400], list(range(50, 401, 50))):
        parts, at = [], 0
        for c in cuts:
            parts.append(rows[at:c])
            at = c
        index, out = dedup(spark, parts)
        assert {k: v for o in out for k, v in o.items()} == expected
        assert all(len(r) <= dedup_index.MAX_RUNS + 1 for r in index.current["runs"].values())


def test_prefixes_split_and_runs_merge(spark, monkeypatch):
    monkeypatch.setattr(dedup_index, "PREFIX_IDS", 8)
    rnd = random.Random(4)
    rows = [(i, f"a{rnd.randrange(150)}", 1) for i in range(420)]
    seen, expected = set(), {}
    for i, a, b in rows:
        expected[i] = a in seen
        seen.add(a)
    index, out = dedup(spark, [rows[at : at + 60] for at in range(0, 420, 60)], 2)
    assert {k: v for o in out for k, v in o.items()} == expected
    assert index.current["prefixes"] > 8 and index.current["ids"] == len(seen)


def test_empty_batch_and_equal_hash_prefix(spark):
    index, out = dedup(spark, [[], [(1, "a", 1)], [], [(2, "a", 1), (3, "b", 1)]])
    assert out == [{}, {1: False}, {}, {2: True, 3: False}]


def test_binary_search_with_equal_high_halves():
    import numpy as np

    hi, lo = np.array([1, 1, 1, 4]), np.array([2, 5, 9, 0])
    found = dedup_index._seen([(hi, lo)], np.array([1, 1, 1, 4, 5]), np.array([9, 3, 2, 1, 0]))
    assert found.tolist() == [True, False, True, False, False]
