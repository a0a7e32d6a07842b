"""What a merge ends in: matching, list order, measures, and queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from slipwright.operators import items as I
from slipwright.plans import accuracy as C
from slipwright.plans import jobs
from slipwright.plans.storage import passing, shared_dir, stored
from slipwright import outcome_queries, print_queries  # noqa: F401  (they register their queries)
from slipwright.queries import ORACLES, QUERIES

NAMES = ["김밥", "참치김밥", "치즈김밥", "우동", "김치우동", "떡볶이", "라면", "콜라", None, ""]


def key(name):
    return "".join(c for c in name or "" if "가" <= c <= "힣")


def spelled(name):
    out = []
    for c in key(name):
        code = ord(c) - 0xAC00
        out += [("on", code // 588), ("vowel", code % 588 // 28), ("coda", code % 28)]
    return out


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    x, y = key(a), key(b)
    return bool(x and y) and (x in y or y in x or apart(spelled(x), spelled(y)) <= max(2, len(spelled(x)) // 3))


def plain_matches(seen, printed):
    """One receipt, line by line: (p, v, again)."""
    taken, nameless, out = set(), set(), []
    by_name = {v for v, (n, _) in seen.items() if any(alike(n, m) for m, _ in printed.values())}
    for p, (name, price) in sorted(printed.items()):
        if not name:
            free = [v for v in sorted(seen) if price is not None and seen[v][1] == price and v not in by_name | nameless]
            if free:
                nameless.add(free[0])
                out.append((p, free[0], False))
            continue
        equal = [v for v in sorted(seen) if price is not None and seen[v][1] == price]
        named = [v for v in sorted(seen) if alike(seen[v][0], name)]
        same = [v for v in named if key(seen[v][0]) == key(name)]
        tries = [[v for v in vs if v not in taken] for vs in (same, named, [v for v in equal if v not in by_name])] + [named, equal]
        pick = next(((vs[0], k > 2) for k, vs in enumerate(tries) if vs), None)
        if pick:
            taken.add(pick[0])
            out.append((p, *pick))
    return out


def test_match_items_equals_plain_version(spark):
    rng, seen, printed, want = random.Random(7), [], [], set()
    for rid in range(500):
        v = {k: (rng.choice(NAMES), rng.choice([1000, 2000, 3000, None])) for k in range(1, rng.randint(0, 5) + 1)}
        p = {k: (rng.choice(NAMES), rng.choice([1000, 2000, 3000, None])) for k in range(1, rng.randint(0, 6) + 1)}
        seen += [(rid, k, *x) for k, x in v.items()]
        printed += [(rid, k, *x) for k, x in p.items()]
        want |= {(rid, *m) for m in plain_matches(v, p)}
    schema = "rid long, item_no int, name string, price long"
    got = I.match_items(spark.createDataFrame(seen, schema), spark.createDataFrame(printed, schema))
    assert {tuple(r) for r in got.collect()} == want and sum(again for *_, again in want) > 50


def test_wrapped_name_adds_no_item(spark):
    schema = "rid long, item_no int, name string, price long"
    seen = spark.createDataFrame([(1, 1, "참치김밥", 3000)], schema)
    printed = spark.createDataFrame([(1, 1, "참치김밥", 3000), (1, 2, "참치김밥", 3000)], schema).withColumn("name_conf", F.lit(0.95))
    matches = I.match_items(seen, printed)
    assert sorted(tuple(r) for r in matches.collect()) == [(1, 1, 1, False), (1, 2, 1, True)]
    assert I.unmatched(printed, matches).count() == 0


def test_lines_without_an_item_of_their_own(spark):
    schema = "rid long, item_no int, name string, price long"
    # 1: the second line is like the taken item; 2: a line takes by price the item that a later line is named like
    seen = spark.createDataFrame([(1, 1, "참치김밥", 3000), (2, 1, "떡볶이", 2000), (3, 1, "우동", 1000), (3, 2, "우동", 1000)], schema)
    printed = spark.createDataFrame([(1, 1, "참치김밥", 3000), (1, 2, "치즈김밥", 2500), (2, 1, "콜라", 2000), (2, 2, "떡볶이", 2000), (3, 1, "우동", 1000), (3, 2, "우동", 1000)], schema).withColumn("name_conf", F.lit(0.95))
    matches = I.match_items(seen, printed)
    assert matches.count() == 6 and I.unmatched(printed, matches).count() == 0
    assert sorted((r.rid, r.item_no) for r in I.unmatched(printed, I.own_lines(matches)).collect()) == [(1, 2), (2, 2)]


def test_recovered_items_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    got = QUERIES["recovered_items"](spark, sf_dir).select("rid", "n").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLES["recovered_items"]).fetchall()) and len(got) > 300


def test_partners_take_the_first_discount_and_the_last_sure_price(spark):
    seen = spark.createDataFrame([(1, 1, "참치김밥", 3000)], "rid long, item_no int, name string, price long")
    lines = [(1, 1, "참치김밥", 3000, 0, []), (1, 2, "참치김밥", 3500, 200, [200]), (1, 3, "참치김밥", 0, 300, [100, 200])]
    printed = spark.createDataFrame(lines, "rid long, p_no int, name string, price long, discount long, discounts array<long>")
    matches = spark.createDataFrame([(1, k, 1, k > 1) for k in (1, 2, 3)], "rid long, p_no int, v_no int, again boolean")
    assert [tuple(r) for r in I.partners(seen, printed, matches).collect()] == [(1, 1, 1, 3500, 2, 200, [200], 2)]


def test_in_order_equals_insertion(spark):
    rng, rows, want = random.Random(11), [], {}
    for rid in range(200):
        listed = [(k, rng.choice([None, *range(1, 9)])) for k in range(1, rng.randint(0, 6) + 1)]
        places = rng.sample(range(1, 9), rng.randint(0, 4))
        back = [(I.RESTORED + k, p if rng.random() < 0.8 else None) for k, p in enumerate(places)]
        out = list(listed)
        for new in sorted(back, key=lambda b: (b[1] is None, b[1] or 0, b[0])):
            before = [k for k, (_, pos) in enumerate(out) if pos is not None and new[1] is not None and pos < new[1]]
            out.insert(len(out) if new[1] is None else before[-1] + 1 if before else 0, new)
        rows += [(rid, *x) for x in listed + back]
        want |= {(rid, n): seq for seq, (n, _) in enumerate(out, 1)}
    got = I.in_order(spark.createDataFrame(rows, "rid long, item_no int, pos int"))
    assert {(r.rid, r.item_no): r.seq for r in got.collect()} == want


def test_measures_of_nothing(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    rows = C.by_receipt(empty("rid long, total_amount long, discount long, delivery_fee long, total_verified boolean, items_verified boolean"), empty("rid long, price long, options long, discount long"), empty("rid long, name string, price long"), empty("rid long, total_amount long, net long"), empty("rid long, name string, price long"))
    assert C.measures(rows).first().asDict() == {"receipts": 0, "totals_verified": 0, "total_precision": None, "items_verified": 0, "items_precision": None, "true_options": 0, "found_options": 0, "option_recall": None, "with_options": 0, "with_all_options": 0}


def run(spark, *receipts):
    """A small merged run of (rid, day, total, verified)."""
    columns = "rid long, ok boolean, error string, store_name string, purchased_at string, payment_method string, total_amount long, discount long, delivery_fee long, total_verified boolean, items_verified boolean"
    rows = [(rid, True, None, None, day, None, total, 0, 0, good, good) for rid, day, total, good in receipts]
    items = [(rid, 1, "김밥", 1, total, 0, 0, 1) for rid, _, total, _ in receipts]
    audit = [(rid, "total_amount", "0", str(total), "reconciled") for rid, _, total, good in receipts if not good]
    return {
        "receipts": spark.createDataFrame(rows, columns),
        "items": spark.createDataFrame(items, "rid long, item_no int, name string, quantity int, price long, discount long, options long, seq int"),
        "options": spark.createDataFrame([], "rid long, item_no int, sub_no int, name string, price long"),
        "corrections": spark.createDataFrame(audit, "rid long, field string, before string, after string, reason string"),
    }


def test_runs_are_written_again_and_compared(spark, tmp_path):
    path = f"{tmp_path}/runs"
    first = run(spark, (1, "2024-03-05", 100, True), (2, "2024-04-01", 200, True), (3, None, 300, True))
    jobs.write_envelopes(first, path, {"prompt": "v1"})
    jobs.write_envelopes(run(spark, (1, "2024-03-05", 100, True), (2, "2024-04-01", 250, False)), path, {"prompt": "v2"})
    # March of the first run once more: its other months and the other run stay
    jobs.write_envelopes(run(spark, (1, "2024-03-05", 110, False), (4, "2024-03-09", 400, True)), path, {"prompt": "v1"})
    runs = jobs.read_runs(spark, path)
    assert list(runs) == ["prompt=v1", "prompt=v2"]
    got = {tuple(r) for r in runs["prompt=v1"].collect()}
    assert got == {(1, 110, False, 1), (4, 400, True, 0), (2, 200, True, 0), (3, 300, True, 0)}
    both = {r.rid: r for r in jobs.compare_runs(runs).collect()}
    assert not both[1].agree and not both[2].agree and both[2]["prompt=v2_edits"] == 1 and both[4]["prompt=v2_total"] is None


def test_passing_tables_are_removed(spark):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with passing(spark, "batch"):
        assert stored(spark.range(5), "numbers").count() == 5 and len(set(os.listdir(folder)) - before) == 1
        with passing(spark, "inner"):
            stored(spark.range(2), "numbers")
    assert set(os.listdir(folder)) == before
    assert "/batch" not in stored(spark.range(5), "numbers").inputFiles()[0]


@pytest.mark.parametrize("name", ["items_in_order", "verdict_branches", "audit_rollup", "accuracy_measures", "word_paths", "midnights_dropped", "payment_sections", "stray_fee_amounts", "receipt_discounts", "restorable_lines", "option_line_prices"])
def test_outcome_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    result, columns = con.sql(ORACLES[name]), sorted(df.columns)
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    clean = lambda row: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row))
    assert sorted(clean(r) for r in df.select(*columns).collect()) == sorted(clean([r[k] for k in place]) for r in result.fetchall())
