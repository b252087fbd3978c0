import json
import random
import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavel.functions import sql as functions
from gavel.functions.sql import register
from gavel.functions.values import CHOICE, NOUL, WHITE, JudgmentError, Request, text_state
from gavel.operators.asking import crossings, ends, pack_numbers, packs, sizes
from gavel.plans import judge
from gavel.plans.judge import JudgmentSession, choice, prob, yes
from gavel.queries import byte_packing
from gavel.sources.providers import Http, Mock
from gavel.streaming.bridge import judge_stream
from stub import Stub
from workload import EXPECTED, workload


@pytest.fixture
def serve(conf, monkeypatch):
    stubs = []

    def start(scenario="ok", provider="remote", executionMode="optimized", **settings):
        s = Stub(scenario)
        stubs.append(s)
        monkeypatch.setenv("JEV_API_KEY", "secret-1")
        monkeypatch.setenv("JEV_LOCAL_API_KEY", "secret-2")
        conf(provider=provider, apiUrl=s.url, executionMode=executionMode, **settings)
        return s

    yield start
    for s in stubs:
        s.close()


def rows(spark, n=40):
    return spark.range(n).select("id", F.format_string("0.%d", F.col("id") % 10).alias("s"))


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT jev_prob('hello', 'is it a greeting?') a, jev_bool('hello', 'is it a greeting?') b, jev_prob(named_struct('a', 1, 'b', null), 'q') c, jev_prob(named_struct('a', 1), 'q') d, jev_prob(null, ' ') e, jev_choice('x', null, array('a')) f").first()
    assert tuple(r) == (0.404799, False, 0.642144, 0.327953, None, None)
    for bad in ("jev_prob('x', ' ')", "jev_choice('x', 'q', array('a'))", "jev_choice('x', 'q', array('a', 'a'))", "jev_prob(1, 'q')", "jev_prob(named_struct('d', date'2020-01-01'), 'q')", "jev_prob(named_struct('x', double('NaN')), 'q')"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT {bad}").collect()
    assert spark.sql("SELECT jev_prob(:s, 'q') p", args={"s": "s"}).first()[0] == 0.333046


def test_verbs_equal_functions(spark, conf):
    register(spark)
    conf(executionMode="optimized")
    df = rows(spark).withColumn("s", F.when(F.col("id") % 7 != 0, F.col("s")))
    labels = F.array(F.lit("a"), F.lit("b"))
    got = JudgmentSession(spark).judge(df, prob("p", F.col("s"), F.lit("q")), yes("b", F.col("s"), F.lit("q")), choice("c", F.col("s"), F.lit("w"), labels))
    want = df.selectExpr("*", "jev_prob(s, 'q') p", "jev_bool(s, 'q') b", "jev_choice(s, 'w', array('a', 'b')) c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_requests_are_unique_judgments(spark, serve):
    stub = serve("echo")
    session = JudgmentSession(spark)
    out = session.judge(rows(spark), prob("p", F.col("s"), F.lit("q")), yes("b", F.col("s"), F.lit("q"))).collect()
    assert all(r.p == float(r.s) and r.b == (r.p >= 0.5) for r in out) and len(out) == 40
    assert stub.requests == 10 and stub.auth == "Bearer secret-1"
    counts = json.loads(session.last_profile())["counts"]
    assert counts["input_rows"] == 80 and counts["unique_judgments"] == 10 and counts["external_requests"] == 10 and counts["deduplicated_rows"] == 70
    assert "secret" not in session.last_profile() and "0.1" not in session.last_profile().replace("0.1e", "")


def test_batches(spark, serve, conf):
    stub = serve("echo", batch_enabled="true", batch_maxJudgments="4")
    session = JudgmentSession(spark)
    assert all(r.p == float(r.s) for r in session.judge(rows(spark), prob("p", F.col("s"), F.lit("q"))).collect())
    assert stub.requests == 3
    stub.scenario = "drift"
    with pytest.raises(JudgmentError, match="model"):
        session.judge(rows(spark), prob("p", F.col("s"), F.lit("q")))
    conf(model="other")
    with pytest.raises(JudgmentError, match="batches"):
        session.judge(rows(spark), prob("p", F.col("s"), F.lit("q")))


@pytest.mark.parametrize("scenario", ["out-of-range", "negative", "wrong-type", "missing", "extra", "unauthorized", "error", "huge", "redirect"])
def test_faults_fail_once_without_leaks(spark, serve, scenario):
    stub = serve(scenario)
    other = Stub()
    stub.elsewhere = other.url
    session = JudgmentSession(spark)
    with pytest.raises(JudgmentError) as e:
        session.judge(rows(spark, 1), prob("p", F.col("s"), F.lit("q")))
    other.close()
    assert other.requests == 0 and other.auth is None  # a redirect is not followed, and no credential leaves
    assert stub.requests == 1 and "leak" not in str(e.value) and "xxx" not in str(e.value)
    assert json.loads(session.last_profile())["status"] == "failed"


def test_invalid_rows_fail_before_any_request(spark, serve):
    stub = serve()
    with pytest.raises(JudgmentError, match="criterion"):
        JudgmentSession(spark).judge(rows(spark), prob("p", F.col("s"), F.when(F.col("id") == 39, " ").otherwise("q")))
    with pytest.raises(JudgmentError, match="unsupported"):
        JudgmentSession(spark).judge(rows(spark), prob("p", F.col("id"), F.lit("q")))
    assert stub.requests == 0


def test_cache(spark, serve, conf):
    stub = serve("echo", model="jev-1.13.0", cache_enabled="true")
    session = JudgmentSession(spark)
    for _ in range(2):
        assert session.judge(rows(spark), prob("p", F.col("s"), F.lit("q"))).where("p = double(s)").count() == 40
    assert stub.requests == 10
    assert session.cache_clear() == 10 and session.cache_clear() == 0
    session.judge(rows(spark), prob("p", F.col("s"), F.lit("q")))
    assert stub.requests == 20


def test_selfhosted(spark, serve):
    stub = serve("truncated", provider="selfhosted")
    with pytest.raises(JudgmentError, match="truncated"):
        JudgmentSession(spark).judge(rows(spark, 1), prob("p", F.col("s"), F.lit("q")))
    labels = F.array(*[F.lit(str(i)) for i in range(256)])
    with pytest.raises(JudgmentError, match="255"):
        JudgmentSession(spark).judge(rows(spark, 1), choice("c", F.col("s"), F.lit("q"), labels))
    assert stub.requests == 1 and stub.auth == "Bearer secret-2"


def test_request_byte_limit(spark, conf):
    conf(executionMode="optimized", maxRequestBytes="2000")
    with pytest.raises(JudgmentError, match="maxRequestBytes"):
        JudgmentSession(spark).judge(spark.range(1).select(F.repeat(F.lit("x"), 500).alias("s")), prob("p", F.col("s"), F.lit("q")))


def test_requests_are_full_and_in_flight_together(spark, serve):
    """ceil(n / 16) requests for any n; as many at once as the cap allows, and no more."""
    stub = serve("echo", batch_enabled="true")
    df = spark.range(10_000).select(F.format_string("%.4f", F.col("id") / 10_000).alias("s"))
    session = JudgmentSession(spark)
    assert session.judge(df, prob("p", F.col("s"), F.lit("q"))).where("p = double(s)").count() == 10_000
    assert stub.requests == 625 and stub.peak <= 4
    histogram = json.loads(session.last_profile())["counts"]["batch_size_histogram"]
    assert histogram == {"16": 625}


def test_byte_packing_beyond_one_chunk(spark):
    """Five names to a request, also where the names fill several chunks."""
    assert tuple(byte_packing(spark, "/root/testdata/sf0.01").first()) == (100, 20)


@pytest.mark.parametrize("provider", [Mock(), Http("remote", model="jev-1.13.0", credential="x")])
@pytest.mark.parametrize(("limit", "max_bytes"), [(16, 4_000), (16, 1_000_000), (120, 9_000), (3, 3_000), (16, 1)])
def test_segments_cut_like_one_pass(provider, limit, max_bytes):
    rng = random.Random(limit)
    work = [Request(NOUL, text_state("x" * rng.choice([1, 9, 90, 400])), "q") for _ in range(700)]
    length, entry, before, got = 2 * limit, 0, 0, []
    bytes_of = np.array([sizes(r, limit, provider) for r in work])
    for start in range(0, len(work), length):
        own = min(length, len(work) - start)
        end = ends(bytes_of[start : start + length + limit - 1], own, limit, max_bytes)
        taken, started = crossings(end, limit)
        got += pack_numbers(end.tolist(), entry, before)
        entry, before = taken[entry], before + started[entry]
    assert got == [i for i, pack in enumerate(packs(work, limit, max_bytes, provider)) for _ in pack]


@pytest.mark.parametrize("max_bytes", [3_000, 100_000])
def test_requests_that_bytes_limit(spark, serve, conf, monkeypatch, max_bytes):
    """Two questions over states of many lengths, dealt to many segments: the requests of one pass, whatever is in flight."""
    monkeypatch.setattr(judge, "CHUNK", 32)
    stub = serve("echo", batch_enabled="true", model="jev-1.13.0", maxRequestBytes=str(max_bytes))
    df = spark.range(1_000).select(F.concat(F.format_string("%.4f", F.col("id") / 1_000), F.repeat(F.lit("0"), (F.col("id") * F.col("id") % 400).cast("int"))).alias("s"))
    ordered = [r.s for r in df.select("s", F.expr("pmod(xxhash64(s, 0L), 1000 div 32 + 1) AS deal")).orderBy("deal", "s").collect()]
    questions = [(NOUL, "q", ()), (CHOICE, "which?", ("a", "b"))]
    want = Counter(len(p) for k, q, c in questions for p in packs([Request(k, text_state(s), q, c) for s in ordered], 16, max_bytes, Http("remote", model="jev-1.13.0", credential="x")))
    session = JudgmentSession(spark)
    for inflight in ("1", "8"):
        conf(maxInflight=inflight)
        stub.reset()
        out = session.judge(df, prob("p", F.col("s"), F.lit("q")), choice("c", F.col("s"), F.lit("which?"), F.array(F.lit("a"), F.lit("b"))))
        assert out.where("p = double(s) AND c = 'a'").count() == 1_000
        assert stub.requests == sum(want.values()) and stub.peak <= int(inflight)
        assert json.loads(session.last_profile())["counts"]["batch_size_histogram"] == {str(n): m for n, m in want.items()}


def test_no_task_gets_a_whole_question(spark, conf, monkeypatch):
    """Every table between the distinct judgments of one question and their answers is written by several tasks, none of which has most rows."""
    monkeypatch.setattr(judge, "CHUNK", 32)
    monkeypatch.setattr(judge.Workspace, "drop_all_but", lambda *_: None)
    tables, write = [], judge.Workspace.write
    monkeypatch.setattr(judge.Workspace, "write", lambda self, df: tables.append(write(self, df)) or tables[-1])
    conf(executionMode="optimized", batch_enabled="true")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for max_bytes in ("262144", "5000"):
            conf(maxRequestBytes=max_bytes)
            JudgmentSession(spark).judge(spark.range(1_000).select(F.col("id").cast("string").alias("s")), prob("p", F.col("s"), F.lit("q")))
    finally:
        for k in off:
            spark.conf.unset(k)
    shares = [[r["count"] for r in t.groupBy(F.input_file_name()).count().collect()] for t in tables]
    assert sum(sum(x) == 1_000 for x in shares) == 11 and all(max(x) < 500 for x in shares if sum(x) == 1_000)


def test_text_states_are_checked_like_requests(spark):
    texts = ["q", " ", "", WHITE, "\x1c", "\u3000q"]
    labels = [["a", "b"], ["a"], [], ["a", None], ["a", "a"], ["a", "\u2003\x85"], ["a", "\x1f"], ["", ""], [" ", None]]
    df = spark.createDataFrame([(t, c) for t in texts for c in labels], "q string, c array<string>")
    codes = [judge._text_code(kind, F.lit("s"), F.col("q"), F.col("c"), F.lit(True))["error"] for kind in (NOUL, CHOICE)]
    for q, c, *errors in df.select("q", "c", *codes).collect():
        for kind, error in zip((NOUL, CHOICE), errors):
            try:
                Request(kind, text_state("s"), q, () if kind == NOUL else tuple(c)).check()
                want = None
            except JudgmentError as e:
                want = e.message
            assert error == want


@pytest.mark.parametrize("mode", ["optimized", "row"])
def test_peak(spark, serve, conf, mode):
    stub = serve("slow", executionMode=mode)
    df = spark.range(100).select(F.format_string("0.%d", F.col("id")).alias("s"))
    JudgmentSession(spark).judge(df, prob("p", F.col("s"), F.lit("q")))
    assert stub.requests == 100 and 1 < stub.peak <= 4
    stub.reset()
    conf(maxInflight="1")
    JudgmentSession(spark).judge(df.limit(20), prob("p", F.col("s"), F.lit("q")))
    assert stub.requests == 20 and stub.peak == 1


def test_absent_rows_and_clashing_columns(spark, conf):
    names = ["row", "uid", "j0", "own", "key", "p", "label", "_p", "_label", "_own", "_key", "_j0", "kind", "text", "choices", "out0"]
    df = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, "s").alias("s"), *[F.lit(n).alias(n) for n in names])
    got = JudgmentSession(spark).judge(df, prob("result", F.col("s"), F.lit("q")), choice("c", F.col("s"), F.col("kind"), F.array(F.lit("a"), F.lit("b"))))
    assert got.columns == [*df.columns, "result", "c"] and got.count() == 30
    for r in got.collect():
        assert all(r[n] == n for n in names) and (r.result is None) == (r.c is None) == (r.s is None)
    with pytest.raises(JudgmentError, match="column"):
        JudgmentSession(spark).judge(df, prob("P", F.col("s"), F.lit("q")))
    conf(executionMode="nonsense")  # unread where nothing is to be judged
    assert JudgmentSession(spark).judge(df.where("s is null"), prob("r", F.col("s"), F.lit(" "))).where("r is null").count() == 10


def test_sql_shares_judgments(spark, serve, conf):
    """Three functions over 2500 rows: 7500 requests in row mode, 4 in optimized mode."""
    stub = serve("echo", maxInflight="16", executionMode="row")
    session = register(spark, session=JudgmentSession(spark))
    spark.range(2500).select("id", F.when(F.col("id") % 2 == 0, "0.2").otherwise("0.8").alias("s")).createOrReplaceTempView("identity_rows")
    query = "SELECT jev_prob(s, 'is it high?') p, jev_bool(s, 'is it high?') b, jev_choice(s, 'which?', array('0.2', '0.8')) c FROM identity_rows"
    by_row = spark.sql(query).collect()
    assert stub.requests == 7500
    stub.reset()
    conf(executionMode="optimized")
    assert spark.sql(query).collect() == by_row == [(0.8, True, "0.8") if i % 2 else (0.2, False, "0.2") for i in range(2500)]
    assert stub.requests == 4
    counts = json.loads(spark.sql("SELECT jev_last_profile()").first()[0])["counts"]
    assert (counts["input_rows"], counts["unique_judgments"], counts["deduplicated_rows"], counts["external_requests"]) == (7500, 4, 7496, 4)
    stub.reset()
    conf(batch_enabled="true", model="jev-1.13.0")
    got = spark.sql("WITH t(id, a, b) AS (VALUES (0, '0.2', 'bird'), (1, '0.8', 'shark')) SELECT jev_prob(a, 'high?') p, jev_bool(a, 'high?') b, jev_choice(b, 'which?', array('bird', 'shark')) c FROM t ORDER BY id").collect()
    counts = json.loads(session.last_profile())["counts"]
    assert got == [(0.2, False, "bird"), (0.8, True, "shark")] and counts["unique_judgments"] == 4
    assert stub.requests == counts["external_requests"] <= 4 and "secret" not in session.last_profile() and "shark" not in session.last_profile()


@pytest.mark.parametrize("n", [1_000, 10_000])
def test_workload_requests(spark, serve, conf, n):
    """Requests of the reference workload: distinct judgments, full batches, none with a warm cache; in row mode, valid rows."""
    valid, unique = EXPECTED[n]
    stub = serve("echo", model="jev-1.13.0")
    session = register(spark, session=JudgmentSession(spark))
    df = spark.createDataFrame(workload(n), "id long, state string, criterion string").repartition(4)
    df.createOrReplaceTempView("workload")
    full = sum(-(-r["n"] // 16) for r in df.where("state is not null and criterion is not null").groupBy("criterion").agg(F.count_distinct("state").alias("n")).collect())
    verb = lambda: session.judge(df, prob("p", F.col("state"), F.col("criterion"))).where("p = double(state)").count()
    sql = lambda: spark.sql("SELECT state, jev_prob(state, criterion) AS p FROM workload").where("p = double(state)").count()
    for run in (verb, sql):
        for requests, settings in ((unique, {}), (full, {"batch_enabled": "true"}), (unique, {"batch_enabled": "false", "cache_enabled": "true"}), (0, {})):
            conf(**settings)
            stub.reset()
            assert run() == valid
            # SQL packs each task's share of each question by itself.
            assert requests <= stub.requests <= requests + (16 if run is sql and requests == full else 0)
            if not settings:
                conf(cache_enabled="false")
        session.cache_clear()
    if n == 1_000:
        conf(executionMode="row")
        stub.reset()
        assert verb() == valid and stub.requests == valid


def test_sql_in_flight_cap(spark, serve, conf):
    stub = serve("slow", executionMode="row", maxInflight="1")
    register(spark)
    assert len(spark.range(40, numPartitions=4).selectExpr("jev_prob(cast(id as string), 'q') p").collect()) == 40
    assert stub.requests == 40 and stub.peak == 1
    stub.reset()
    conf(maxInflight="4")
    assert len(spark.range(40, numPartitions=2).selectExpr("jev_prob(cast(id as string), 'q') p").collect()) == 40
    assert stub.requests == 40 and 1 < stub.peak <= 4


def test_sql_honours_settings(spark, serve, conf):
    stub = serve("echo", model="jev-1.13.0", cache_enabled="true", executionMode="optimized")
    session = register(spark, session=JudgmentSession(spark))
    for _ in range(2):
        assert spark.range(30).selectExpr("jev_prob(concat('0.', id % 10), 'q') p").distinct().count() == 10
    assert stub.requests == 10 and json.loads(session.last_profile())["counts"]["cache_hit_judgments"] == 10
    assert [r[0] for r in spark.sql("SELECT jev_cache_clear() FROM range(3)").collect()] == [10] * 3 and session.cache_clear() == 0
    conf(maxRequestBytes="1")
    with pytest.raises(Exception, match="maxRequestBytes"):
        spark.sql("SELECT jev_prob('0.2', 'one') p").collect()
    assert stub.requests == 10 and json.loads(session.last_profile())["status"] == "failed"
    conf(maxRequestBytes="262144", cache_enabled="false", batch_enabled="true", model="other")
    with pytest.raises(Exception, match="batches"):
        spark.sql("SELECT jev_prob('0.2', 'one') p").collect()
    conf(batch_enabled="false", provider="selfhosted")
    with pytest.raises(Exception, match="255"):
        spark.sql("SELECT jev_choice('s', 'q', transform(sequence(1, 256), i -> cast(i as string))) c").collect()
    with pytest.raises(Exception, match="criterion"):
        spark.sql("SELECT jev_prob('s', '  ') p").collect()
    counts = json.loads(session.last_profile())
    assert counts["status"] == "failed" and counts["counts"]["input_rows"] == 1 and counts["counts"]["valid_rows"] == 0 and stub.requests == 10


def test_task_memory_does_not_grow_with_texts(monkeypatch):
    """Long texts are read a few at a time, and those whose answers are remembered stay within the bound."""
    monkeypatch.setattr(functions, "REMEMBERED_CHARS", 20_000, raising=False)
    monkeypatch.setattr(functions, "READ", 10_000, raising=False)
    monkeypatch.setattr(functions.Task, "conf", lambda self: {})
    task, tallies, held, read = functions.Task(("", 0), b""), [], [], functions.read
    monkeypatch.setattr(task, "count", lambda counts, failed=False: tallies.append((counts, failed)))
    monkeypatch.setattr(functions, "read", lambda *args: held.append(read(*args)) or held[-1])
    texts = [None if i % 7 == 0 else f"{i % 150} " + "x" * (i % 5 * 400) for i in range(200)] + ["y" * 30_000, "short", "short"]
    ask = lambda texts, q: task.judge(NOUL, pa.float64(), pa.array(texts, pa.string()), pa.array([q] * len(texts)))
    got = ask(texts, "q").to_pylist()
    assert got == [None if t is None else Mock().judge([Request(NOUL, text_state(t), "q")]).answers["r0"] for t in texts]
    assert sum(len(r.state.canonical) for r in task.known) <= 20_000
    assert max(sum(len(r.state.canonical) for r in x if r) for x in held if len(x) > 1) <= 10_000
    (counts, failed), nulls = tallies.pop(), texts.count(None)
    assert not failed and (counts["input_rows"], counts["null_rows"], counts["valid_rows"]) == (203, nulls, 203 - nulls)
    task.known.clear()
    with pytest.raises(JudgmentError, match="criterion"):
        task.judge(NOUL, pa.float64(), pa.array(texts), pa.array(["q"] * 202 + [" "]))
    assert not task.known and tallies == [({"input_rows": 203, "null_rows": 0, "valid_rows": 0}, True)]  # no row was judged


def test_sql_cancel(spark, serve):
    """A cancelled query stops asking, and says so in its profile."""
    stub = serve("stuck", executionMode="row", maxInflight="1")
    session = register(spark, session=JudgmentSession(spark))

    def run():
        with pytest.raises(Exception):  # noqa: B017
            spark.range(50, numPartitions=1).selectExpr("jev_prob(cast(id as string), 'q') p").collect()

    t = threading.Thread(target=run)
    t.start()
    while not stub.requests:
        time.sleep(0.1)
    spark.sparkContext.cancelAllJobs()
    t.join(30)
    deadline = time.time() + 20
    while session.last_profile() is None and time.time() < deadline:
        time.sleep(0.1)
    assert json.loads(session.last_profile())["status"] == "cancelled" and stub.requests < 5


def test_empty_input(spark, serve):
    stub = serve()
    assert JudgmentSession(spark).judge(rows(spark, 0), prob("p", F.col("s"), F.lit("q"))).count() == 0 and stub.requests == 0


def test_stream(spark, conf, tmp_path):
    conf(executionMode="optimized")
    rows(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    got = []
    q = judge_stream(stream, JudgmentSession(spark), [prob("p", F.col("s"), F.lit("q"))], lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert len(got) == 40 and all(r.p is not None for r in got)
