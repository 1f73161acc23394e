"""Tables at many positions, logs that continue, and the order of equal rows."""

import random

import pytest
from pyspark.sql import functions as F

from kinspot.operators import ordered
from kinspot.operators import replay as rp
from kinspot.operators.timeline import tables_as_of
from kinspot.operators.transcript import assemble
from kinspot.plans import continuing as ct
from test_replay import random_log, simulate

LOG = "seq bigint, tool string, arguments string"
VERSIONS = "id bigint, name string, role string, salary bigint, valid_from bigint, valid_to bigint"


def random_versions(rng, n, end):
    out = []
    for i in range(n):
        at = rng.randrange(-1, end)
        while at < end:
            upto = rng.choice([None, at + rng.randrange(1, end)])
            out.append((i, f"n{i}", rng.choice("xyz"), rng.randrange(100), at, upto))
            if upto is None:
                break
            at = upto + rng.randrange(3)
    return out


@pytest.mark.parametrize(("step", "span"), [(1, 100_000), (10**15, 7)])
def test_tables_as_of_equal_a_look_at_every_version(spark, step, span):
    rng = random.Random(step)
    far = lambda at: None if at is None else at * step if at > 0 else at
    versions = [(*v[:4], far(v[4]), far(v[5])) for v in random_versions(rng, 40, 200)]
    asked = [(far(rng.randrange(-5, 260)), rng.choice([None, "", "x", "y", "nobody"])) for _ in range(90)] + [(None, None), (far(50), None), (far(50), None)]
    want = {
        (p, role or None, *v[:4])
        for p, role in asked if p is not None
        for v in versions
        if v[4] < p and (v[5] is None or v[5] >= p) and (not role or v[2] == role)
    }
    got = tables_as_of(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(asked, "position bigint, role string"), span).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_totals_are_those_of_the_rows(spark):
    rng = random.Random(3)
    versions = [(*v[:2], rng.choice([v[2], None]), *v[3:]) for v in random_versions(rng, 40, 200)]
    versions += [(7, None, "x", None, 3, 90), (8, "n1", "x", 5, 3, 90), (8, "n1", "x", 5, 3, 90)]
    asked = [(rng.randrange(-5, 260), rng.choice([None, "", "x", "y", "nobody"])) for _ in range(90)] + [(None, None), (50, None), (50, None)]
    made = spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(asked, "position bigint, role string")
    want = tables_as_of(*made).groupBy("position", "asked_role", "role").agg(
        F.count("*"), F.sum("id"), F.sum("salary"), F.min("name"), F.max("name")
    )
    got = tables_as_of(*made, span=7, totals=True)
    assert got.columns == ["position", "asked_role", "role", "n_rows", "id_total", "salary_total", "first_name", "last_name"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and want.count() > 50


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_positions(spark, n):
    versions = spark.createDataFrame([(1, "a", "x", 1, 0, None), (2, "b", "x", 2, 5, 6)], VERSIONS)
    got = tables_as_of(versions, spark.createDataFrame([(6, None), (1, "x")][:n], "position bigint, role string"))
    assert {(r.position, r.name) for r in got.collect()} == {0: set(), 1: {(6, "a"), (6, "b")}, 2: {(6, "a"), (6, "b"), (1, "a")}}[n]
    assert tables_as_of(versions.where("false"), spark.createDataFrame([(6, None)], "position bigint, role string")).count() == 0


def test_a_lasting_version_meets_positions_of_its_role_only(spark):
    versions = spark.createDataFrame([(i, f"n{i}", "x" if i else "y", i, -1, None) for i in range(50)], VERSIONS)
    asked = spark.createDataFrame([(p, "y") for p in range(200)], "position bigint, role string")
    df = tables_as_of(versions, asked)
    assert df.count() == 200
    # rows that leave the join, before anything could filter them
    text = df._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text and "Filter" not in text.split("== Physical Plan ==")[1].split("Join")[0]


def test_rows_of_list_calls_have_their_sums(spark):
    log = random_log(random.Random(7), 300, 10, hot=0.3)
    commands = rp.validate(spark.createDataFrame(log, LOG))
    done = rp.replay(commands)
    calls = commands.where((F.col("tool") == rp.LIST) & F.col("error").isNull()).select(F.col("seq").alias("position"), "role")
    rows = tables_as_of(rp.row_versions(done), calls).groupBy("position").agg(F.count("*").alias("n"), F.sum("salary").alias("s")).collect()
    _, lists, _ = simulate(log)
    assert {r.position: (r.n, r.s) for r in rows} == {p: v for p, v in lists.items() if v[0]}


# --- logs that continue ----------------------------------------------------------------


@pytest.mark.parametrize(("with_base", "span"), [(False, 100_000), (True, 16)])
def test_parts_of_a_log_equal_one_run(spark, tmp_path, with_base, span):
    rng = random.Random(5)
    log = random_log(rng, 360, 15, hot=0.3)
    base = [(5 + i, f"n{i}", rng.choice("xyz"), rng.randrange(1000)) for i in range(6)] + [(90, "quiet", "x", 7)] if with_base else []
    outcome, lists, final = simulate(log, base)
    path = str(tmp_path / "table")
    if with_base:
        ct.start_table(spark.createDataFrame(base, rp.TABLE_SCHEMA), path)
    statuses, calls = {}, {}
    for first, last in ((0, 100), (100, 101), (101, 101), (101, 360)):
        run = ct.run_log(spark.createDataFrame(log[first:last], LOG), path, span)
        statuses |= {r.seq: (r.status, r.message, r.salary) for r in run.statuses.collect()}
        calls |= {r.seq: (r.n_rows, r.salary_total) for r in run.list_calls.collect()}
    assert statuses == outcome
    assert {p: (n, s or 0) for p, (n, s) in calls.items()} == lists
    state = ct.load_state(spark, path)
    assert {tuple(r) for r in state.table.collect()} == final and state.last_seq == 359
    sums = {}
    for _, _, role, salary in final:
        n, s = sums.get(role, (0, 0))
        sums[role] = (n + 1, s + salary)
    assert {r.role: (r["rows"], r.total) for r in state.sums.collect()} == sums
    ids = [int(m.rsplit(" ", 1)[1]) for ok, m, _ in outcome.values() if ok == "success" and m and m.startswith("Added")]
    assert state.max_id == max(ids)


def test_a_later_log_reads_only_the_state(spark, tmp_path):
    path = str(tmp_path / "table")
    add = lambda name: f'{{"name": "{name}", "role": "x", "salary": 1}}'
    first = ct.run_log(spark.createDataFrame([(i, rp.ADD, add(f"n{i}")) for i in range(50)], LOG), path)
    second = ct.run_log(spark.createDataFrame([(3, rp.DELETE, '{"name": "n1"}'), (60, rp.DELETE, '{"name": "n2"}'), (61, rp.LIST, "{}")], LOG), path)
    assert second.replayed.count() == 2  # the row it mentions and the command
    assert {(r.seq, r.status, r.message) for r in second.statuses.collect()} == {(3, "error", ct.LATE), (60, "success", "Deleted n2"), (61, "success", None)}
    assert [tuple(r) for r in second.list_calls.collect()] == [(61, None, 49, 49)]
    assert (first.state.version, second.state.version, second.state.max_id) == (1, 2, 50)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        ct._left(path, 1, first.state.table, first.state.sums, 0, 0)
    with pytest.raises(ValueError, match="there is a table"):
        ct.start_table(first.state.table, path)


def test_replay_writes_the_log_twice(spark, monkeypatch):
    names = []
    for module in (rp, ordered):
        monkeypatch.setattr(module, "written", lambda df, name, path=None, _w=module.written: names.append(name) or _w(df, name, path))
    log = random_log(random.Random(2), 60, 5, hot=0.3)
    assert rp.replay(rp.validate(spark.createDataFrame(log, LOG))).count() > 0
    assert sorted(names) == ["judged_commands", "spans"]


# --- order -----------------------------------------------------------------------------


def test_equal_and_null_places_have_one_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 2, 3]), i, {"m": i}) for i in range(60)]
    seen = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "key string, at int, v int, m map<string,int>").repartition(seed + 1)
        out = ordered.running_sum(df, ["key"], "at", {"total": F.col("v")}, span=9)
        out = ordered.last_before(out, ["key"], "at", {"before": F.col("v")}, span=9, then=["v"])
        out = ordered.last_before(out, ["key"], "at", {"after": F.col("v")}, span=9, then=["v"], backwards=True)
        seen.append({(r.key, r.at, r.v, r.total, r.before, r.after) for r in out.collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 60
    for key in "ab":
        line = sorted((r for r in seen[0] if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r[4] for r in line] == [None] + [r[2] for r in line[:-1]] and [r[5] for r in line] == [r[2] for r in line[1:]] + [None]


def test_equal_turns_are_ordered_by_role_and_content(spark):
    rows = [("c", 1, "user", "b"), ("c", 1, "user", "a"), ("c", 1, "assistant", "z"), ("c", None, "user", "first"), ("c", 2, "user", "last")]
    for n in (1, 4):
        messages = spark.createDataFrame(rows, "conv_id string, turn int, role string, content string").repartition(n)
        got = assemble(messages, "s").orderBy("position").collect()
        assert [(r.position, r.content) for r in got] == list(enumerate(["s", "first", "z", "a", "b", "last"]))
