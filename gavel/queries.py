"""Queries of the judgment engine, by name, with the SQL each is compared with.

The offline provider is arithmetic on bytes, so DuckDB can compute its answers: an FNV-1a hash over the canonical state,
the kind, the question and the choices.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.sql import register
from gavel.functions.values import state_reader
from gavel.operators.workspace import Workspace
from gavel.plans.judge import JudgmentSession, choice, prob, yes
from gavel.sources.providers import Http, Mock
from gavel.streaming.bridge import judge_stream

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")
LABELS = ("low", "normal", "high")


def _fold(text: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::UTINYINT::UHUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _p(state: str, criterion: str) -> str:
    return f"(({_fold(f'{state} || {chr(39)}noul{criterion}{chr(39)}')} % 1000001)::DOUBLE / 1000000.0)"


def _c(state: str, question: str, labels: tuple[str, ...]) -> str:
    tail = "".join(f" || chr(31) || '{x}'" for x in labels)
    fold = _fold(f"{state} || 'choice{question}'{tail}")
    return f"list_extract([{', '.join(f'{chr(39)}{x}{chr(39)}' for x in labels)}], ({fold} % {len(labels)})::INT + 1)"


def _struct(**fields: str) -> str:
    inner = " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in sorted(fields.items()))
    return f"""('{{"canonical_version":1,"state":{{"t":"struct","f":{{' || {inner} || '}}}}}}')"""


def _int(c: str) -> str:
    return f"""'{{"t":"int","v":"' || {c} || '"}}'"""


def _float(c: str) -> str:
    return f"""'{{"t":"float","v":' || {c}::VARCHAR || '}}'"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(name: str, spark_sql: str, oracle: str | None = None, args: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in spark_sql}
        return spark.sql(spark_sql, args=args, **frames)

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


LIST = "array('low', 'normal', 'high')"
_sql("prob_text", "SELECT item_id, jev_prob(text, 'is it clear?') AS p FROM {benchmark}", f"SELECT item_id, {_p('text', 'is it clear?')} AS p FROM benchmark")
_sql("bool_filter", "SELECT event_type, count(*) AS n FROM {events} WHERE jev_bool(event_type, 'is it a sale?') GROUP BY event_type", f"WITH t AS (SELECT DISTINCT event_type, {_p('event_type', 'is it a sale?')} AS p FROM (SELECT DISTINCT event_type FROM events)) SELECT event_type, count(*) AS n FROM events JOIN t USING (event_type) WHERE p >= 0.5 GROUP BY event_type")
_sql("choice_text", f"SELECT c_custkey, jev_choice(c_mktsegment, 'which level?', {LIST}) AS label FROM {{customer}}", f"WITH t AS (SELECT c_mktsegment, {_c('c_mktsegment', 'which level?', LABELS)} AS label FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, label FROM customer JOIN t USING (c_mktsegment)")
_STATE = _struct(quantity=_float("l_quantity"), discount=_float("l_discount"), line=_int("l_linenumber"))
_LINE = "named_struct('quantity', l_quantity, 'discount', l_discount, 'line', l_linenumber)"
_DISTINCT = "(SELECT DISTINCT l_quantity, l_discount, l_linenumber FROM lineitem)"
_sql("prob_struct", f"SELECT l_orderkey, l_linenumber, jev_prob({_LINE}, 'is it large?') AS p FROM {{lineitem}}", f"WITH t AS (SELECT *, {_p(_STATE, 'is it large?')} AS p FROM {_DISTINCT}) SELECT l_orderkey, l_linenumber, p FROM lineitem JOIN t USING (l_quantity, l_discount, l_linenumber)")
_sql("choice_struct", f"SELECT l_linenumber, jev_choice({_LINE}, 'which level?', {LIST}) AS label, count(*) AS n FROM {{lineitem}} GROUP BY ALL", f"WITH t AS (SELECT *, {_c(_STATE, 'which level?', LABELS)} AS label FROM {_DISTINCT}) SELECT l_linenumber, label, count(*) AS n FROM lineitem JOIN t USING (l_quantity, l_discount, l_linenumber) GROUP BY ALL")
_sql("prob_struct_null", "SELECT p_partkey, jev_prob(named_struct('size', nullif(p_size, 7), 'brand', p_brand), 'is it big?') AS p FROM {part}", f"""SELECT p_partkey, {_p(_struct(brand="'{\"t\":\"text\",\"v\":\"' || p_brand || '\"}'", size="CASE WHEN p_size = 7 THEN '{\"t\":\"null\"}' ELSE " + _int('p_size') + " END"), 'is it big?')} AS p FROM part""")
_sql("nulls", "SELECT c_custkey, jev_prob(nullif(c_mktsegment, 'BUILDING'), 'q') AS a, jev_bool(c_name, cast(NULL AS string)) AS b, jev_choice(c_name, 'q', cast(NULL AS array<string>)) AS c FROM {customer}", f"WITH t AS (SELECT c_mktsegment, {_p('c_mktsegment', 'q')} AS p FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, CASE WHEN c_mktsegment != 'BUILDING' THEN p END AS a, NULL::BOOLEAN AS b, NULL::VARCHAR AS c FROM customer JOIN t USING (c_mktsegment)")
_sql("prefilter", "SELECT o_orderkey, jev_prob(o_orderpriority, 'is it urgent?') AS p FROM {orders} WHERE o_totalprice > 100000 AND jev_prob(o_orderpriority, 'is it urgent?') >= 0.2", f"WITH t AS (SELECT o_orderpriority, {_p('o_orderpriority', 'is it urgent?')} AS p FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, p FROM orders JOIN t USING (o_orderpriority) WHERE o_totalprice > 100000 AND p >= 0.2")
_sql("topk", "SELECT s_suppkey, jev_prob(s_name, 'is it reliable?') AS p FROM {supplier} ORDER BY p DESC, s_suppkey LIMIT 10", f"SELECT s_suppkey, {_p('s_name', 'is it reliable?')} AS p FROM supplier ORDER BY p DESC, s_suppkey LIMIT 10")
_sql("group_by_label", f"SELECT jev_choice(o_orderstatus, 'which level?', {LIST}) AS label, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {{orders}} GROUP BY ALL", f"WITH t AS (SELECT o_orderstatus, {_c('o_orderstatus', 'which level?', LABELS)} AS label FROM (SELECT DISTINCT o_orderstatus FROM orders)) SELECT label, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN t USING (o_orderstatus) GROUP BY label")
_sql("avg_prob", "SELECT p_brand, count_if(jev_bool(p_type, 'is it metal?')) AS yes, round(avg(jev_prob(p_type, 'is it metal?')), 9) AS mean FROM {part} GROUP BY p_brand", f"WITH t AS (SELECT p_type, {_p('p_type', 'is it metal?')} AS p FROM (SELECT DISTINCT p_type FROM part)) SELECT p_brand, count_if(p >= 0.5)::BIGINT AS yes, round(avg(p), 9) AS mean FROM part JOIN t USING (p_type) GROUP BY p_brand")
_sql("window_rank", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY jev_prob(s_name, 'q') DESC, s_suppkey) AS r FROM {supplier}", f"SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY {_p('s_name', 'q')} DESC, s_suppkey) AS r FROM supplier")
_sql("join_judged", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey AND jev_bool(concat(n_name, '/', r_name), 'is it coastal?')", f"SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE {_p('(n_name || chr(47) || r_name)', 'is it coastal?')} >= 0.5")
_sql("union_judged", "SELECT n_name AS name, jev_prob(n_name, 'q') AS p FROM {nation} UNION ALL SELECT r_name, jev_prob(r_name, 'q') FROM {region}", f"SELECT n_name AS name, {_p('n_name', 'q')} AS p FROM nation UNION ALL SELECT r_name, {_p('r_name', 'q')} FROM region")
_sql("cte_case", "WITH t AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE s_name END AS state FROM {supplier}) SELECT s_suppkey, jev_prob(state, 'is it sound?') AS p FROM t", f"WITH t AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE s_name END AS state FROM supplier) SELECT s_suppkey, {_p('state', 'is it sound?')} AS p FROM t")
_sql("bool_eq_prob", "SELECT event_id FROM {events} WHERE jev_bool(event_type, 'q') != (jev_prob(event_type, 'q') >= 0.5)", "SELECT event_id FROM events WHERE false")
_sql("empty_input", "SELECT count(*) AS n FROM (SELECT jev_prob(o_orderstatus, 'q') AS p FROM {orders} WHERE 1 = 0) WHERE p > 0", "SELECT 0::BIGINT AS n")
_sql("bound_parameters", "SELECT s_suppkey, jev_prob(s_name, :question) AS p FROM {supplier} WHERE jev_prob(s_name, :question) >= :least", f"SELECT s_suppkey, {_p('s_name', 'is it reliable?')} AS p FROM supplier WHERE {_p('s_name', 'is it reliable?')} >= 0.4", {"question": "is it reliable?", "least": 0.4})


@contextmanager
def _session(spark: SparkSession, **conf: str) -> Iterator[JudgmentSession]:
    """A session in optimized mode; its settings end with it."""
    conf = {f"spark.jev.{k.replace('_', '.')}": v for k, v in {"executionMode": "optimized", **conf}.items()}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield JudgmentSession(spark)
    finally:
        for k in conf:
            spark.conf.unset(k)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(session: JudgmentSession, **names: str) -> DataFrame:
    """One row: the last profile's counts under the given column names."""
    counts = json.loads(session.last_profile())["counts"]
    return session.spark.range(1).select(*[F.lit(counts[count]).cast("long").alias(name) for name, count in names.items()])


def verb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three verbs over one table share their judgments."""
    state, levels = F.col("event_type"), F.array(*[F.lit(x) for x in LABELS])
    with _session(spark) as session:
        events = _table(spark, sf_dir, "events").select("event_id", "event_type")
        return session.judge(events, prob("p", state, F.lit("q")), yes("b", state, F.lit("q")), choice("label", state, F.lit("which level?"), levels)).drop("event_type")


def distinct_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the profile counts for one judged column over events: valid rows, judgments, rows saved, requests in packs of 16."""
    with _session(spark, batch_enabled="true") as session:
        session.judge(_table(spark, sf_dir, "events").select("user_id"), prob("p", F.col("user_id").cast("string"), F.lit("q")))
        return _counts(session, n="input_rows", valid="valid_rows", judgments="unique_judgments", saved="deduplicated_rows", requests="provider_invocations")


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are packed for each question: two questions over one column never share a request."""
    state = F.col("s_name")
    with _session(spark, batch_enabled="true") as session:
        session.judge(_table(spark, sf_dir, "supplier").select("s_name"), prob("p", state, F.lit("q")), yes("b", state, F.lit("r")))
        return _counts(session, judgments="unique_judgments", requests="provider_invocations")


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null states are counted as rows but never judged."""
    with _session(spark) as session:
        session.judge(_table(spark, sf_dir, "customer").select("c_mktsegment"), prob("p", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("q")))
        return _counts(session, n="input_rows", absent="null_rows", valid="valid_rows", judgments="unique_judgments", saved="deduplicated_rows", failed="failed_requests")


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second query is answered by the cache; clearing it returns how many answers it held."""
    with _session(spark, cache_enabled="true") as session:
        for _ in range(2):
            session.judge(_table(spark, sf_dir, "customer").select("c_mktsegment"), prob("p", F.col("c_mktsegment"), F.lit("q")))
        counts = _counts(session, hits="cache_hit_judgments", judgments="unique_judgments", requests="provider_invocations")
        return counts.withColumn("cleared", F.lit(session.cache_clear()).cast("long"))


def _kept(session: JudgmentSession, df: DataFrame) -> DataFrame:
    """The frame computed under the settings of now."""
    return Workspace(session.spark, "query").write(df)


def sql_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three SQL functions over one column cost in optimized mode: the distinct judgments of all of them together."""
    with _session(spark) as session:
        register(spark, session=session)
        _kept(session, spark.sql(f"SELECT jev_prob(event_type, 'q'), jev_bool(event_type, 'q'), jev_choice(event_type, 'which level?', {LIST}) FROM {{events}}", events=_table(spark, sf_dir, "events")).toDF("p", "b", "label"))
        return _counts(session, n="input_rows", judgments="unique_judgments", saved="deduplicated_rows", asked="provider_invocations")


def sql_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions give the same in optimized mode, with batches and cache."""
    with _session(spark, batch_enabled="true", cache_enabled="true") as session:
        register(spark, session=session)
        return _kept(session, spark.sql(f"SELECT event_id, jev_prob(event_type, 'q') AS p, jev_bool(event_type, 'q') AS b, jev_choice(event_type, 'which level?', {LIST}) AS label FROM {{events}}", events=_table(spark, sf_dir, "events")))


def sql_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second SQL query is answered by the cache; jev_cache_clear() and jev_last_profile() as functions."""
    with _session(spark, cache_enabled="true") as session:
        register(spark, session=session)
        for _ in range(2):
            _kept(session, spark.sql("SELECT jev_prob(c_mktsegment, 'q') AS p FROM {customer}", customer=_table(spark, sf_dir, "customer")))
        return _kept(session, spark.sql("SELECT cast(get_json_object(jev_last_profile(), '$.counts.cache_hit_judgments') AS bigint) AS hits, get_json_object(jev_last_profile(), '$.status') AS status, jev_cache_clear() AS cleared"))


def many_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are full whatever the number of judgments: over 4096 of one question."""
    with _session(spark, batch_enabled="true") as session:
        session.judge(_table(spark, sf_dir, "lineitem").select("l_orderkey"), prob("p", F.col("l_orderkey").cast("string"), F.lit("q")))
        return _counts(session, n="input_rows", judgments="unique_judgments", requests="provider_invocations")


def byte_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that bytes limit: five names of 18 characters fit where sixteen judgments would be allowed."""
    with _session(spark, batch_enabled="true", maxRequestBytes=str(1024 + 5 * (512 + 6 * (18 + 1 + 2)))) as session:
        session.judge(_table(spark, sf_dir, "supplier").select("s_name"), prob("p", F.col("s_name"), F.lit("q")))
        return _counts(session, judgments="unique_judgments", requests="provider_invocations")


def stream_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files, judged by micro-batches."""
    with _session(spark) as session:
        work = Workspace(spark, "stream")
        work.write(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
        stream = spark.readStream.schema("c_custkey long, c_mktsegment string").parquet(f"{work.root}/1")
        sink = lambda df, n: df.write.mode("append").parquet(f"{work.root}/out")
        judge_stream(stream, session, [prob("p", F.col("c_mktsegment"), F.lit("q"))], sink).option("checkpointLocation", f"{work.root}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{work.root}/out").drop("c_mktsegment")


def host_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judged table written as Parquet, rows added to it, and read by a prepared statement over a view and VALUES."""
    register(spark)
    work = Workspace(spark, "host")
    judged = "SELECT n_name AS name, jev_prob(n_name, 'q') AS p FROM {nation} WHERE n_regionkey %s 2"
    for test in ("<", ">="):
        spark.sql(judged % test, nation=_table(spark, sf_dir, "nation")).write.mode("append").option("parquet.block.size", 2048).parquet(f"{work.root}/nations")
    spark.read.parquet(f"{work.root}/nations").createOrReplaceTempView("judged_nations")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT name, p, jev_prob(name, ?) AS r FROM judged_nations UNION ALL SELECT name, jev_prob(name, ?) AS p, null AS r FROM VALUES (''Atlantis''), (''Utopia'') AS t(name)' USING 'r', 'q'")


#: Calls that are refused, by a name, and the error of each.
REFUSED = {
    "blank criterion": ("jev_prob(x, ' ')", "criterion must not be empty or whitespace"),
    "blank question": ("jev_choice(x, '', array('a', 'b'))", "question must not be empty or whitespace"),
    "one choice": ("jev_choice(x, 'q', array('a'))", "choices must contain at least two labels"),
    "blank choice": ("jev_choice(x, 'q', array('a', ' '))", "choices must not contain empty or whitespace labels"),
    "equal choices": ("jev_choice(x, 'q', array('a', 'a'))", "choices must not contain duplicate labels"),
    "null choice": ("jev_choice(x, 'q', array('a', null))", "choices must not contain NULL labels"),
    "no list": ("jev_choice(x, 'q', 'a')", "choices must be a list"),
    "scalar state": ("jev_prob(1, 'q')", "unsupported state type: expected STRUCT or VARCHAR"),
    "nested state": ("jev_prob(named_struct('a', array(1)), 'q')", "unsupported STRUCT field type"),
    "not a number": ("jev_prob(named_struct('a', double('NaN')), 'q')", "state contains a non-finite floating point value"),
    "null beside a fault": ("jev_prob(cast(null AS string), ' ')", "none"),
}
#: Settings that are refused: the setting, its value, and the error.
SETTINGS_REFUSED = [
    ("provider", "oracle", "spark.jev.provider must be 'mock', 'remote' or 'selfhosted'"),
    ("executionMode", "Row", "spark.jev.executionMode must be 'row' or 'optimized'"),
    ("timeoutMs", "0", "spark.jev.timeoutMs must be greater than 0"),
    ("maxInflight", "-1", "spark.jev.maxInflight must be greater than 0"),
    ("batch.enabled", "true", "spark.jev.batch.enabled requires spark.jev.executionMode='optimized'"),
    ("cache.enabled", "true", "spark.jev.cache.enabled requires spark.jev.executionMode='optimized'"),
]


def _error(df: DataFrame) -> str:
    try:
        df.collect()
        return "none"
    except Exception as e:  # noqa: BLE001  whatever the engine wraps it in
        return next((m for m in [*(m for _, m in REFUSED.values()), *(m for *_, m in SETTINGS_REFUSED)] if m in str(e)), str(e)[:200])


def refused_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each faulty call over region's names."""
    register(spark)
    regions = _table(spark, sf_dir, "region").withColumnRenamed("r_name", "x")
    return spark.createDataFrame([(name, _error(regions.selectExpr(f"{call} AS y"))) for name, (call, _) in REFUSED.items()], "name string, error string")


def refused_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each faulty setting, and that NULL rows do not meet it."""
    register(spark)
    regions, out = _table(spark, sf_dir, "region"), []
    for name, value, _ in SETTINGS_REFUSED:
        spark.conf.set(f"spark.jev.{name}", value)
        try:
            out.append((name, _error(regions.selectExpr("jev_prob(r_name, 'q') AS y")), _error(regions.selectExpr("jev_prob(nullif(r_name, r_name), 'q') AS y"))))
        finally:
            spark.conf.unset(f"spark.jev.{name}")
    return spark.createDataFrame(out, "name string, error string, null_error string")


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider may be asked, and which answers may be kept."""
    rows = [(p.name, getattr(p, "model", ""), p.external, p.batch, p.max_choices, p.cache_model() is not None) for p in (Mock(), *(Http(n, model=m) for n, m in (("remote", "jev-latest"), ("remote", "jev-1.13.0"), ("remote", "jev-2"), ("remote", "jev-1.14"), ("selfhosted", "jev-1.13.0"))))]
    return spark.createDataFrame(rows, "provider string, model string, external boolean, batch string, max_choices int, cacheable boolean")


def canonical_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of orders as structs: decimals, booleans, floats, integers, texts and nulls."""
    state = "named_struct('total', cast(o_totalprice AS decimal(14, 2)), 'open', o_orderstatus = 'O', 'price', o_totalprice, 'key', o_custkey, 'flag', nullif(o_orderstatus, 'F')) AS state"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader = state_reader(batch.column(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader(x).canonical for x in batch.column(1)], pa.string())], names=["o_orderkey", "canonical"])

    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey", state).mapInArrow(encode, "o_orderkey long, canonical string")


def prob_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as states; SQL is too slow on texts of this length."""
    register(spark)
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", "jev_prob(text, 'is it clear?') AS p")


QUERIES |= {f.__name__: f for f in (sql_shared, sql_optimized, sql_cache, many_judgments, byte_packing, stream_judged, host_tables, refused_calls, refused_settings, capabilities, canonical_states, prob_documents)}
ORACLE_SQL["sql_shared"] = "SELECT 3 * count(*) AS n, 2 * count(DISTINCT event_type) AS judgments, 3 * count(*) - 2 * count(DISTINCT event_type) AS saved, 2 * count(DISTINCT event_type) AS asked FROM events"
ORACLE_SQL["sql_cache"] = "SELECT count(DISTINCT c_mktsegment) AS hits, 'completed' AS status, count(DISTINCT c_mktsegment) AS cleared FROM customer"
ORACLE_SQL["many_judgments"] = "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS judgments, ceil(count(DISTINCT l_orderkey) / 16.0)::BIGINT AS requests FROM lineitem"
ORACLE_SQL["byte_packing"] = "SELECT count(DISTINCT s_name) AS judgments, ceil(count(DISTINCT s_name) / 5.0)::BIGINT AS requests FROM supplier"
ORACLE_SQL["stream_judged"] = f"WITH t AS (SELECT c_mktsegment, {_p('c_mktsegment', 'q')} AS p FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, p FROM customer JOIN t USING (c_mktsegment)"
ORACLE_SQL["host_tables"] = f"SELECT n_name AS name, {_p('n_name', 'q')} AS p, {_p('n_name', 'r')} AS r FROM nation UNION ALL SELECT name, {_p('name', 'q')} AS p, NULL AS r FROM (VALUES ('Atlantis'), ('Utopia')) AS t(name)"
ORACLE_SQL["refused_calls"] = f"SELECT * FROM (VALUES {', '.join(str((n, m)) for n, (_, m) in REFUSED.items())}) AS t(name, error)"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
ORACLE_SQL["refused_settings"] = "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(n)}, {_quoted(m)}, 'none')" for n, _, m in SETTINGS_REFUSED) + ") AS t(name, error, null_error)"
ORACLE_SQL["capabilities"] = "SELECT * FROM (VALUES ('mock', '', false, 'Verified', NULL::INT, true), ('remote', 'jev-latest', true, 'Verified', NULL, false), ('remote', 'jev-1.13.0', true, 'Verified', NULL, true), ('remote', 'jev-2', true, 'Unknown', NULL, false), ('remote', 'jev-1.14', true, 'Unknown', NULL, true), ('selfhosted', 'jev-1.13.0', true, 'Unsupported', 255, false)) AS t(provider, model, external, batch, max_choices, cacheable)"
ORACLE_SQL["canonical_states"] = "SELECT o_orderkey, " + _struct(total="""'{"t":"decimal","v":"' || o_totalprice::DECIMAL(14, 2) || '"}'""", open="""'{"t":"bool","v":' || (o_orderstatus = 'O') || '}'""", price=_float("o_totalprice"), key=_int("o_custkey"), flag="""CASE WHEN o_orderstatus = 'F' THEN '{"t":"null"}' ELSE '{"t":"text","v":"' || o_orderstatus || '"}' END""") + " AS canonical FROM orders"
QUERIES |= {"verb_dedup": verb_dedup, "distinct_identity": distinct_identity, "batch_plan": batch_plan, "profile_counts": profile_counts, "cache_reuse": cache_reuse}
ORACLE_SQL["verb_dedup"] = f"WITH t AS (SELECT event_type, {_p('event_type', 'q')} AS p, {_c('event_type', 'which level?', LABELS)} AS label FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, p, p >= 0.5 AS b, label FROM events JOIN t USING (event_type)"
ORACLE_SQL["sql_optimized"] = ORACLE_SQL["verb_dedup"]
ORACLE_SQL["distinct_identity"] = "SELECT count(*) AS n, count(*) AS valid, count(DISTINCT user_id) AS judgments, count(*) - count(DISTINCT user_id) AS saved, ceil(count(DISTINCT user_id) / 16.0)::BIGINT AS requests FROM events"
ORACLE_SQL["batch_plan"] = "SELECT 2 * count(DISTINCT s_name) AS judgments, 2 * ceil(count(DISTINCT s_name) / 16.0)::BIGINT AS requests FROM supplier"
ORACLE_SQL["profile_counts"] = "SELECT count(*) AS n, count_if(c_mktsegment = 'BUILDING')::BIGINT AS absent, count_if(c_mktsegment != 'BUILDING')::BIGINT AS valid, count(DISTINCT nullif(c_mktsegment, 'BUILDING')) AS judgments, count_if(c_mktsegment != 'BUILDING')::BIGINT - count(DISTINCT nullif(c_mktsegment, 'BUILDING')) AS saved, 0::BIGINT AS failed FROM customer"
ORACLE_SQL["cache_reuse"] = "SELECT count(DISTINCT c_mktsegment) AS hits, count(DISTINCT c_mktsegment) AS judgments, 0::BIGINT AS requests, count(DISTINCT c_mktsegment) AS cleared FROM customer"
