import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from kinspot.operators import replay as rp
from kinspot.operators.ordered import last_before, running_sum


def simulate(log, base=()):
    """The commands one by one against a real table."""
    db = sqlite3.connect(":memory:")
    db.execute(
        "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL UNIQUE, role TEXT NOT NULL, salary INTEGER NOT NULL)"
    )
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", base)
    out, lists = {}, {}
    for seq, tool, arguments in log:
        a = json.loads(arguments)
        message, salary, ok = None, None, True
        if tool == rp.ADD:
            try:
                new = db.execute("INSERT INTO t (name, role, salary) VALUES (:name, :role, :salary)", a).lastrowid
                message = f"Added {a['name']} with ID {new}"
            except sqlite3.IntegrityError:
                ok, message = False, f"Employee {a['name']} already exists"
        elif tool == rp.LIST:
            where = "WHERE role = :role" if a.get("role") else ""
            lists[seq] = db.execute(f"SELECT count(*), coalesce(sum(salary), 0) FROM t {where}", a).fetchone()
        else:
            found = db.execute("SELECT salary FROM t WHERE name = :name", a).fetchone()
            ok = found is not None
            if tool == rp.DELETE:
                db.execute("DELETE FROM t WHERE name = :name", a)
                message = f"Deleted {a['name']}"
            elif tool == rp.UPDATE:
                db.execute("UPDATE t SET salary = :salary WHERE name = :name", a)
                message = f"Updated {a['name']}'s salary to ${a['salary']}"
            elif ok:
                salary = found[0]
            if not ok:
                message = f"Employee {a['name']} not found"
        out[seq] = ("success" if ok else "error", message, salary)
    return out, lists, set(db.execute("SELECT id, name, role, salary FROM t").fetchall())


def random_log(rng, n, names, hot):
    log = []
    for seq in range(n):
        name = "hot" if rng.random() < hot else f"n{rng.randrange(names)}"
        tool = rng.choice([rp.ADD, rp.ADD, rp.DELETE, rp.UPDATE, rp.LOOKUP, rp.LIST])
        a = {
            rp.ADD: {"name": name, "role": rng.choice("xyz"), "salary": rng.randrange(1000)},
            rp.DELETE: {"name": name},
            rp.UPDATE: {"name": name, "salary": rng.randrange(1000)},
            rp.LOOKUP: {"name": name},
            rp.LIST: rng.choice([{}, {"role": "x"}, {"role": ""}, {"role": "nobody"}]),
        }[tool]
        log.append((seq, tool, json.dumps(a)))
    return log


@pytest.mark.parametrize(("seed", "span", "with_base"), [(1, 7, True), (2, 64, False), (3, 100_000, True)])
def test_replay_equals_one_by_one(spark, seed, span, with_base):
    rng = random.Random(seed)
    log = random_log(rng, 400, 12, hot=0.4)
    base = [(5 + i, f"n{i}", rng.choice("xyz"), rng.randrange(1000)) for i in range(6)] if with_base else []
    outcome, lists, table = simulate(log, base)
    commands = rp.validate(spark.createDataFrame(log, "seq bigint, tool string, arguments string"))
    start = spark.createDataFrame(base, "id bigint, name string, role string, salary bigint")
    done = rp.replay(commands, start if with_base else None, span=span)
    got = {r.seq: (r.status, r.message, r.salary) for r in rp.statuses(commands, done).collect()}
    assert got == outcome
    assert {tuple(r) for r in rp.final_table(done).collect()} == table
    seen = {r.seq: (r.n_rows, r.salary_total) for r in rp.list_calls_as_of(commands, done, span).collect()}
    assert seen == lists
    middle, versions = 200, rp.row_versions(done, span)
    _, _, then = simulate(log[:middle], base)
    assert {tuple(r) for r in rp.table_as_of(versions, F.lit(middle)).collect()} == then
    looked = {r.seq: (r.found, r.salary) for r in rp.lookups_as_of(done).collect()}
    assert looked == {s: (outcome[s][0] == "success", outcome[s][2]) for s, t, _ in log if t == rp.LOOKUP}


def test_one_key_fixture(spark):
    steps = [
        (rp.ADD, {"name": "a", "role": "r", "salary": 1}), (rp.ADD, {"name": "a", "role": "r", "salary": 2}),
        (rp.DELETE, {"name": "a"}), (rp.UPDATE, {"name": "a", "salary": 5}),
        (rp.ADD, {"name": "a", "role": "r", "salary": 3}), (rp.UPDATE, {"name": "a", "salary": 9}),
        (rp.LOOKUP, {"name": "a"}), (rp.DELETE, {"name": "a"}), (rp.LOOKUP, {"name": "a"}),
    ]
    log = [(i, t, json.dumps(a)) for i, (t, a) in enumerate(steps)]
    commands = rp.validate(spark.createDataFrame(log, "seq bigint, tool string, arguments string"))
    done = rp.replay(commands, span=2)
    got = [r for r in rp.statuses(commands, done).orderBy("seq").collect()]
    assert [r.status[0] for r in got] == list("sesesssse")
    assert got[0].message.endswith("ID 1") and got[4].message.endswith("ID 2") and got[6].salary == 9
    assert rp.final_table(done).count() == 0


def test_validation(spark):
    log = [
        ("init_db", "{}", None), ("drop", "{}", "Unknown tool: drop"), (rp.ADD, '{"name": ', "not a JSON object"),
        (rp.ADD, "[]", "not a JSON object"), (rp.ADD, '{"name": "a", "role": "r"}', "missing argument"),
        (rp.DELETE, '{"name": "a", "x": 1}', "unexpected argument"), (rp.DELETE, '{"name": null}', "bad value"),
        (rp.UPDATE, '{"name": "a", "salary": 1.5}', "bad value"), (rp.LIST, '{"role": null}', None),
        (rp.UPDATE, '{"name": "a", "salary": -5}', None),
    ]
    rows = [(i, t, a) for i, (t, a, _) in enumerate(log)]
    commands = rp.validate(spark.createDataFrame(rows, "seq bigint, tool string, arguments string"))
    for row, (_, _, error) in zip(commands.orderBy("seq").collect(), log):
        assert (row.error is None) if error is None else row.error.endswith(error)
    done = rp.replay(commands)
    status = {r.seq: (r.status, r.message) for r in rp.statuses(commands, done).collect()}
    assert len(status) == len(log) and status[0] == ("success", "Database initialized")
    assert {(r.tool, r.status, r.n_commands) for r in rp.summary(rp.statuses(commands, done)).collect()} >= {
        (rp.ADD, "error", 3), (rp.UPDATE, "error", 2)
    }


def test_batch_forms(spark, tmp_path):
    path = str(tmp_path / "table")
    assert rp.create_table(spark, path).count() == 0
    base = spark.createDataFrame([(1, "a", "r", 10), (4, "b", "s", 20)], rp.TABLE_SCHEMA)
    base.write.mode("append").parquet(path)
    assert rp.create_table(spark, path).count() == 2
    adds = spark.createDataFrame(
        [(1, "b", "r", 1), (2, "d", "r", 2), (3, "d", "r", 3), (4, "c", "r", 4)],
        "seq bigint, name string, role string, salary bigint",
    )
    assert {tuple(r) for r in rp.apply_adds(base, adds, span=2).collect()} == {(5, "d", "r", 2), (6, "c", "r", 4)}
    assert [r.name for r in rp.apply_deletes(base, adds).collect()] == ["a"]
    assert {(r.name, r.salary) for r in rp.apply_updates(base, adds.withColumn("name", F.lit("a"))).collect()} == {("a", 4), ("b", 20)}
    assert rp.filter_optional(base, "role", "s").count() == 1 and rp.filter_optional(base, "role", "").count() == 2
    asked = spark.createDataFrame([("a",), ("zz",)], ["name"])
    got = {r.name: (r.status, r.message, r.salary) for r in rp.point_lookups(base, asked, "name", "salary").collect()}
    assert got == {"a": ("success", None, 10), "zz": ("error", "Employee zz not found", None)}


@pytest.mark.parametrize("span", [1, 3, 50, 1000])
def test_ordered_state_does_not_depend_on_the_span(spark, span):
    rng = random.Random(span)
    rows = [(i, rng.choice("aab"), rng.choice([None, i]), rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, key string, mark bigint, amount bigint")
    last, total, every = {}, {}, 0
    want = set()
    for seq, key, mark, amount in rows:
        total[key] = total.get(key, 0) + amount
        every += amount
        want.add((seq, last.get(key), total[key], every))
        last[key] = mark if mark is not None else last.get(key)
    out = last_before(df, ["key"], "seq", {"before": F.col("mark")}, span)
    out = running_sum(out, ["key"], "seq", {"total": F.col("amount")}, span)
    out = running_sum(out, [], "seq", {"every": F.col("amount")}, span)
    assert {(r.seq, r.before, r.total, r.every) for r in out.collect()} == want


def test_spans_hold_rows_however_sparse_positions_are(spark):
    """One hot name, positions in microseconds one second apart."""
    from pyspark.sql import functions as F

    from kinspot.operators import ordered

    rows = spark.range(20_000).select(F.lit("hot").alias("name"), (F.col("id") * 1_000_000 + 1_700_000_000_000_000).alias("at"), (F.col("id") % 7).alias("v"))
    spans = ordered.spanned(rows, "at", 1000)
    assert spans.select(ordered.SPAN).distinct().count() <= 20
    got = ordered.running_sum(rows, [], "at", {"total": F.col("v")}, span=1000).orderBy(F.desc("at")).first()
    assert got.total == sum(i % 7 for i in range(20_000))
    before = ordered.last_before(rows, ["name"], "at", {"odd": F.when(F.col("v") == 3, F.col("at"))}, span=1000).orderBy(F.desc("at")).first()
    assert before.odd == 1_700_000_000_000_000 + 1_000_000 * max(i for i in range(19_999) if i % 7 == 3)


def test_a_log_from_one_file_is_read_in_tasks_by_its_number_of_events(spark, tmp_path, monkeypatch):
    from checks.data import TestData

    rows = [(i, i % 3, ["signup", "view", "click"][i % 3], float(i), '{"k": 1}') for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(TestData, "TASK_EVENTS", 10)
    data = TestData(spark, str(tmp_path))
    for log in (data.log, data.hard_log):
        first_half = log.where(F.col("seq") < 20)
        filled = first_half.rdd.glom().map(len).collect()
        assert sum(n > 0 for n in filled) > 1 and sum(filled) == 20
    assert sorted(r.seq for r in data.log.collect()) == list(range(40))
