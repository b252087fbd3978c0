"""Judgments as a plan: encode and check all rows, judge each distinct identity once, join the answers back.

A judgment's identity is the full content: kind, state, question and ordered choices, compared as columns, never as a hash.  All
verbs of one call share their judgments.  Errors travel as rows, so that nothing is retried and either all answers are
published or none; so do the counts of the profile.  A service is called by ``spark.jev.maxInflight`` tasks, one request at a time each.
"""

from __future__ import annotations

import hmac
import secrets
import time
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gavel.functions.batches import distinct, read
from gavel.functions.values import CHOICE, NOUL, WHITE, JudgmentError, Request, State, invalid
from gavel.operators import profile
from gavel.operators.asking import Outcome, ask, crossings, ends, pack_numbers, preflight, sizes
from gavel.operators.cache import JudgmentCache, Key, Policy
from gavel.operators.workspace import Workspace
from gavel.sources.providers import REMOTE_URL, SETTINGS, Config, Provider, Reply, make_provider, read_config

IDENTITY = ["kind", "is_text", "canonical", "text", "choices"]
QUESTION = ["kind", "text", "choices"]
ANSWER = "kind string, is_text boolean, canonical string, text string, choices array<string>, p double, label string, error_kind string, error string, sent boolean, size long, model string, input_tokens long, output_tokens long, seconds double, serialize double"
SEGMENT = "kind string, text string, choices array<string>, segment long"
#: Judgments of one question that are dealt to one task at most, to be numbered or to be packed into requests.
CHUNK = 4096


@dataclass(frozen=True)
class Spec:
    """One output column: verb is prob, bool or choice."""

    out: str
    verb: str
    state: Column
    text: Column
    choices: Column | None = None


def prob(out: str, state: Column, criterion: Column) -> Spec:
    return Spec(out, "prob", state, criterion)


def yes(out: str, state: Column, criterion: Column) -> Spec:
    return Spec(out, "bool", state, criterion)


def choice(out: str, state: Column, question: Column, choices: Column) -> Spec:
    return Spec(out, "choice", state, question, choices)


def _encoder(kind: str):
    kinds = pa.struct([("is_text", pa.bool_()), ("canonical", pa.string()), ("error", pa.string())])

    def encode(state: pa.Array, text: pa.Array, choices: pa.Array, present: pa.Array) -> pa.Array:
        first, back = distinct(state, text, choices, present)
        out = []
        for i in first:
            if not present[int(i)].as_py():  # a guarded Python function still runs on every row
                out.append(None)
                continue
            try:
                (r,) = read(kind, [i], state, text, choices if kind == CHOICE else None)
                out.append({"is_text": r.state.is_text, "canonical": r.state.canonical, "error": None})
            except JudgmentError as e:
                out.append({"is_text": None, "canonical": None, "error": e.message})
        return pa.array(out, kinds).take(pa.array(back))

    return F.arrow_udf(encode, "is_text boolean, canonical string, error string")


def _text_code(kind: str, state: Column, text: Column, choices: Column, present: Column) -> Column:
    """What the encoder gives for text states, without Python: they are canonical as they are, and only the question can be wrong."""
    blank = lambda c: F.trim(c, F.lit(WHITE)) == ""
    error = F.when(blank(text), f"{'criterion' if kind == NOUL else 'question'} must not be empty or whitespace")
    if kind == CHOICE:
        error = (
            error.when(F.exists(choices, lambda c: c.isNull()), "choices must not contain NULL labels")
            .when(F.size(choices) < 2, "choices must contain at least two labels")
            .when(F.exists(choices, blank), "choices must not contain empty or whitespace labels")
            .when(F.size(F.array_distinct(choices)) < F.size(choices), "choices must not contain duplicate labels")
        )
    return F.when(present, F.struct(F.lit(True).alias("is_text"), state.cast("string").alias("canonical"), error.alias("error")))


def _judge_chunk(config: Config, secret: str):
    """Judges the work of one question, request by request."""
    most = config.max_request_bytes if config.mode == "optimized" else None
    added = [pa.field("p", pa.float64()), *(pa.field(n, pa.string()) for n in ("label", "error_kind", "error")), pa.field("sent", pa.bool_()), pa.field("size", pa.int64()), pa.field("model", pa.string()), *(pa.field(n, pa.int64()) for n in ("input_tokens", "output_tokens")), *(pa.field(n, pa.float64()) for n in ("seconds", "serialize"))]

    def run(table: pa.Table) -> pa.Table:
        provider = make_provider(config, secret)
        table = table.sort_by("no")
        kind, text, choices = (table[n][0].as_py() for n in QUESTION)
        states = [State(*x) for x in zip(table["is_text"].to_pylist(), table["canonical"].to_pylist())]
        bounds = [0, *(np.flatnonzero(np.diff(table["pack"].to_numpy())) + 1).tolist(), len(states)]
        rows: list[tuple] = []
        for start, end in zip(bounds, bounds[1:]):
            out = ask(provider, [Request(kind, x, text, tuple(choices), f"r{i}") for i, x in enumerate(states[start:end])], most)
            usage = out.reply.usage if out.reply and out.reply.usage else (None, None)
            model, error = out.reply.model if out.reply else None, (out.error.kind, out.error.message) if out.error else (None, None)
            for i in range(end - start):
                value = out.reply.answers[f"r{i}"] if out.reply else None
                # What belongs to the request stands in its first row.
                request = (out.sent, end - start, model, *usage, out.seconds, out.reply.serialize_seconds if out.reply else 0.0) if i == 0 else (None, None, model, *[None] * 4)
                rows.append((value if kind == NOUL else None, value if kind == CHOICE else None, *error, *request))
        own = {n: table[n] for n in IDENTITY[:-1]} | {"choices": pc.cast(table["choices"], pa.list_(pa.field("element", table["choices"].type.value_type)))}
        return pa.table(own | {f.name: pa.array(x, f.type) for f, x in zip(added, zip(*rows))})

    return run


def _sizes(config: Config, secret: str, limit: int):
    def run(*columns: pa.Array) -> pa.Array:
        provider = make_provider(config, secret)
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([sizes(Request(k, State(t, c), x, tuple(ch)), limit, provider) for k, t, c, x, ch in rows], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")


def _places(limit: int) -> list[int]:
    """The places of a full request to which each of a judgment's sizes applies."""
    return [1, *(min(limit, 10 ** (d + 1)) - 10**d for d in range(len(str(limit - 1))))]


def _cut_segment(length: int, limit: int, max_bytes: int):
    """One row for a segment: its packs from every place where one may start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        end = ends(np.stack(pdf["bytes"]), int((pdf["no"] // length == pdf["segment"]).sum()), limit, max_bytes)
        kind, text, choices, segment = pdf[[*QUESTION, "segment"]].iloc[0]
        return pd.DataFrame([(kind, text, list(choices), segment, end, *crossings(end, limit))], columns=[*QUESTION, "segment", "end", "taken", "started"])

    return run


def _follow_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where a question's packs enter each segment, and the packs before it."""
    pdf, entry, before, rows = pdf.sort_values("segment"), 0, 0, []
    for taken, started in zip(pdf["taken"], pdf["started"]):
        rows.append((entry, before))
        entry, before = int(taken[entry]), before + int(started[entry])
    pdf["entry"], pdf["before"] = zip(*rows)
    pdf["packs"] = before
    return pdf[[*QUESTION, "segment", "entry", "before", "packs"]]


def _pack_numbers(end: pa.Array, entry: pa.Array, before: pa.Array) -> pa.Array:
    return pa.array([pack_numbers(*row) for row in zip(end.to_pylist(), entry.to_pylist(), before.to_pylist())], pa.list_(pa.int64()))


class JudgmentSession:
    """A SparkSession's judgments: verbs, cache, and the profile of the last query."""

    def __init__(self, spark: SparkSession):
        self.spark, self.cache, self.profile = spark, None, None
        self.salt, self.scope = secrets.token_bytes(32), None

    def config(self) -> Config:
        return read_config(lambda k: self.spark.conf.get(k, None))

    def last_profile(self) -> str | None:
        return self.profile

    def cache_clear(self, config: Config | None = None) -> int:
        config = config or self.config()
        if self.cache is None:
            return 0
        if config.cache_enabled:
            self.cache.reconcile(Policy(config.cache_max_entries, config.cache_max_bytes, config.cache_ttl_ms))
        return self.cache.clear()

    def open_cache(self, config: Config, provider: Provider) -> JudgmentCache:
        """The cache under the current limits; a new one once the credential differs, of which only a keyed hash is held."""
        policy = Policy(config.cache_max_entries, config.cache_max_bytes, config.cache_ttl_ms)
        scope = hmac.digest(self.salt, getattr(provider, "credential", "").encode(), "sha256")
        if self.cache is None or scope != self.scope:
            self.cache, self.scope = JudgmentCache(policy), scope
        self.cache.reconcile(policy)
        return self.cache

    def cache_key(self, provider: Provider, request: Request) -> Key | None:
        """The name of a judgment in the cache; None where the provider's answers must not be cached."""
        model = provider.cache_model()
        return None if model is None else Key(provider.name, getattr(provider, "url", ""), getattr(provider, "model", ""), model, request)

    def judge(self, df: DataFrame, *specs: Spec) -> DataFrame:
        """The frame with one column for each spec; the answers are computed now, and once.

        A NULL state, question or list of choices gives NULL and asks nothing; where all rows are so, settings are not even
        read.  Input columns keep their values, whatever their names; a spec may not have the name of one.  An empty frame gives one.
        """
        began, get = time.perf_counter(), lambda k: self.spark.conf.get(SETTINGS[k], None) or ""
        query = profile.begin((get("provider") or "mock").strip().lower(), get("profile_enabled").lower() == "true", (get("api_url") or REMOTE_URL) == REMOTE_URL)
        query["status"] = "failed"
        try:
            out = self._judge(df, specs, query)
            query["status"] = "completed"
            return out
        except Exception as e:
            if "cancelled" in str(e).lower() and not isinstance(e, JudgmentError):
                query["status"] = "cancelled"
            raise
        finally:
            query["wall"] = time.perf_counter() - began
            if query["input_rows"]:
                self.profile = profile.render(query)

    def _judge(self, df: DataFrame, specs: tuple[Spec, ...], query: dict) -> DataFrame:
        taken = [c.lower() for c in df.columns]
        for s in specs:
            if s.out.lower() in taken:
                raise invalid(f"the frame has a column {s.out} already")
            taken.append(s.out.lower())
        work = Workspace(self.spark, "judge")
        none = F.expr("cast(array() as array<string>)")
        columns = []
        for i, s in enumerate(specs):
            kind = CHOICE if s.verb == "choice" else NOUL
            labels = s.choices if s.choices is not None else none
            state_type = df.select(s.state).schema[0].dataType
            if not isinstance(state_type, (StringType, StructType)) and state_type.typeName() != "void":
                raise invalid("unsupported state type: expected STRUCT or VARCHAR")
            present = s.state.isNotNull() & s.text.isNotNull() & labels.isNotNull()
            encode = _encoder(kind) if isinstance(state_type, StructType) else partial(_text_code, kind)
            code = encode(s.state, F.coalesce(s.text.cast("string"), F.lit("")), F.coalesce(labels, none), present)
            columns.append(F.struct(F.lit(kind).alias("kind"), code.alias("code"), s.text.alias("text"), labels.alias("choices"), present.alias("present")).alias(f"j{i}"))
        row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")
        encoded = work.write(df.select(row, F.monotonically_increasing_id().alias("uid"), *columns))
        parts = []
        counted = [(F.count_if(F.col(f"j{i}.present")).alias(f"valid{i}"), F.min(F.when(F.col(f"j{i}.present"), F.col(f"j{i}.code.error"))).alias(f"error{i}")) for i in range(len(specs))]
        counts = encoded.agg(F.count(F.lit(1)).alias("n"), *[c for pair in counted for c in pair]).first()
        query["input_rows"] = counts["n"] * len(specs)
        valid = sum(counts[f"valid{i}"] for i in range(len(specs)))
        query["null_rows"] = query["input_rows"] - valid
        for i in range(len(specs)):  # every row is checked before the first request
            if counts[f"error{i}"] is not None:
                raise invalid(counts[f"error{i}"])
        query["valid_rows"] = valid
        if not valid:
            return self._publish(encoded, specs, None)
        config = self.config()
        provider = make_provider(config)
        query["requested_model"] = getattr(provider, "model", None)
        limit = preflight(config, provider)
        for i in range(len(specs)):
            j = F.col(f"j{i}")
            parts.append(encoded.where(j["present"]).select(j["kind"].alias("kind"), j["code"]["is_text"].alias("is_text"), j["code"]["canonical"].alias("canonical"), j["text"].alias("text"), j["choices"].alias("choices")))
        asked = parts[0]
        for p in parts[1:]:
            asked = asked.unionByName(p)
        if provider.max_choices and not asked.where(F.size("choices") > provider.max_choices).isEmpty():
            raise invalid(f"provider supports at most {provider.max_choices} choices")
        if config.mode == "optimized":
            asked = asked.distinct().withColumn("copy", F.lit(0).cast("long"))
        else:
            asked = asked.withColumn("copy", F.monotonically_increasing_id())
        asked = work.write(asked)
        query["unique_judgments"] = asked.count()
        query["deduplicated_rows"] = valid - query["unique_judgments"]
        hits = self._hits(asked, provider, config, query, work) if config.cache_enabled else None
        todo = asked.join(hits.select(*IDENTITY), IDENTITY, "left_anti") if hits is not None else asked
        answers = work.write(self._ask(todo, config, provider, limit, work))
        self._count(answers, provider, query)
        bad = answers.where("error is not null").select("error_kind", "error").limit(1).collect()
        if bad:
            raise JudgmentError(bad[0][0], bad[0][1])
        if config.cache_enabled:
            self._remember(answers, provider)
        found = answers.select(*IDENTITY, "p", "label")
        if hits is not None:
            found = found.unionByName(hits)
        found = work.write(found if config.mode == "optimized" else found.dropDuplicates(IDENTITY))
        work.drop_all_but(encoded, found)
        return self._publish(encoded, specs, found)

    def _ask(self, todo: DataFrame, config: Config, provider: Provider, limit: int, work: Workspace) -> DataFrame:
        """The answers of judgments, each question's numbered from 0 and cut in this order into requests as full as ``limit`` and
        bytes allow, so that only its last one is not full."""
        # Numbers: judgments are dealt by a hash, counted by deal and ranked inside their deal.  A question of fewer than CHUNK
        # judgments has one deal; the others are few enough to be sent to all tasks, so that no task gets a whole question.
        secret = getattr(provider, "credential", "")
        counts = work.write(todo.groupBy(*QUESTION).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("canonical")).cast("long").alias("longest")))
        large = F.broadcast(counts.where(F.col("n") >= CHUNK).drop("longest"))
        dealt = todo.join(large, QUESTION, "left").withColumn("deal", F.pmod(F.xxhash64("canonical", "copy"), F.expr(f"coalesce(n, 0) div {CHUNK} + 1"))).drop("n")
        short = limit > 1 and self._may_be_short(counts, config, secret, limit)
        if short:
            dealt = dealt.withColumn("bytes", _sizes(config, secret, limit)(*IDENTITY))
        dealt = work.write(dealt)
        whole = Window.partitionBy(*QUESTION)
        before = F.sum("m").over(whole.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1))
        deals = dealt.groupBy(*QUESTION, "deal").agg(F.count(F.lit(1)).alias("m")).select(*QUESTION, "deal", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n"))
        place = F.row_number().over(Window.partitionBy(*QUESTION, "deal").orderBy("canonical", "copy")) - 1
        numbered = dealt.withColumn("place", place).join(deals, [*QUESTION, "deal"]).withColumn("no", F.col("before") + F.col("place")).drop("before")
        reach = self._reach(dealt, limit, config.max_request_bytes) if short else None
        if reach:
            packed, limit = self._pack_by_bytes(work.write(numbered), reach, config.max_request_bytes, work), reach
        else:
            packed = numbered.withColumn("pack", F.expr(f"no div {limit}")).withColumn("packs", F.expr(f"ceil(n / {limit})"))
        # Chunks of whole requests: as many as may be in flight, or more.
        most = max(1, CHUNK // limit)
        per = F.expr(f"least({most}, ceil(packs / {config.max_inflight}))").cast("long")
        chunks = packed.drop("bytes").withColumn("chunk", F.col("pack") - F.pmod("pack", per)).withColumn("turn", F.expr("chunk") / per)
        keys = ["chunk", *QUESTION]
        if provider.external:
            # Chunks take turns in exactly as many tasks as requests may be in flight.
            slots = self._slots(config.max_inflight)
            turn = F.pmod(F.col("turn").cast("long") + F.xxhash64(*QUESTION), F.lit(config.max_inflight)).cast("int")
            chunks = chunks.withColumn("slot", F.get(F.array(*[F.lit(x) for x in slots]), turn)).repartition(config.max_inflight, "slot")
            keys = ["slot", *keys]
        return chunks.groupBy(*keys).applyInArrow(_judge_chunk(config, secret), ANSWER)

    def _may_be_short(self, counts: DataFrame, config: Config, secret: str, limit: int) -> bool:
        """Whether the longest state of a question, ``limit`` times, might not fit a request; a byte of a state takes 6 at most."""
        empty = _sizes(config, secret, limit)("kind", F.lit(True), F.lit(""), "text", "choices")
        full = sum(F.get("bytes", F.lit(d)) * n for d, n in enumerate(_places(limit))) + 6 * limit * F.col("longest")
        return not counts.withColumn("bytes", empty).where(full > config.max_request_bytes).isEmpty()

    def _reach(self, dealt: DataFrame, limit: int, max_bytes: int) -> int | None:
        """The most judgments that bytes may let into one request, if they may let in fewer than ``limit``; else None."""
        largest = sum(F.max(F.get("bytes", F.lit(d))) * n for d, n in enumerate(_places(limit)))
        found = dealt.groupBy(*QUESTION).agg(largest.alias("full"), F.min(F.array_min("bytes")).alias("least")).agg(F.max("full").alias("full"), F.min("least").alias("least")).first()
        return min(limit, 1 + max_bytes // found["least"]) if found["full"] is not None and found["full"] > max_bytes else None

    def _pack_by_bytes(self, numbered: DataFrame, limit: int, max_bytes: int, work: Workspace) -> DataFrame:
        """Each judgment's request, as one pass over its question's judgments would cut them.

        Segments are cut in parallel for every place where the first request may start, of which a question's segments in
        their order then choose one.  A segment also sees the bytes of the judgments after it that its last request may take.
        """
        length = max(1, CHUNK // limit) * limit
        numbered = numbered.withColumn("segment", F.expr(f"no div {length}"))
        seen = F.array_compact(F.array("segment", F.when((F.col("segment") > 0) & (F.col("no") % length < limit - 1), F.col("segment") - 1)))
        cut = numbered.select(*QUESTION, F.explode(seen).alias("segment"), "no", "bytes").groupBy(*QUESTION, "segment")
        cut = work.write(cut.applyInPandas(_cut_segment(length, limit, max_bytes), f"{SEGMENT}, end array<int>, taken array<int>, started array<int>"))
        entries = cut.drop("end").groupBy(*QUESTION).applyInPandas(_follow_segments, f"{SEGMENT}, entry long, before long, packs long")
        numbers = F.arrow_udf(_pack_numbers, "array<long>")("end", "entry", "before")
        found = cut.select(*QUESTION, "segment", "end").join(entries, [*QUESTION, "segment"]).select(*QUESTION, "segment", "packs", numbers.alias("numbers"))
        return numbered.join(found, [*QUESTION, "segment"]).withColumn("pack", F.get("numbers", (F.col("no") % length).cast("int"))).drop("numbers")

    def _slots(self, n: int) -> list[int]:
        """A number for each of n partitions that Spark's hash puts there."""
        found = self.spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
        return [dict(map(tuple, found)).get(i, i) for i in range(n)]

    def _publish(self, encoded: DataFrame, specs: tuple[Spec, ...], answers: DataFrame | None) -> DataFrame:
        out = encoded
        for i, s in enumerate(specs):
            kind = {"prob": "double", "bool": "boolean", "choice": "string"}[s.verb]
            if answers is None:
                out = out.withColumn(f"out{i}", F.lit(None).cast(kind))
                continue
            j = F.col(f"j{i}")
            # Rows that ask nothing get keys of their own, which match nothing and are spread like others.
            own = F.when(j["present"], F.struct(j["kind"].alias("kind"), j["code"]["is_text"].alias("is_text"), j["code"]["canonical"].alias("canonical"), j["text"].alias("text"), j["choices"].alias("choices")))
            absent = F.struct(F.lit("").alias("kind"), F.lit(False).alias("is_text"), F.col("uid").cast("string").alias("canonical"), F.lit("").alias("text"), F.expr("cast(array() as array<string>)").alias("choices"))
            value = {"prob": F.col("p"), "bool": F.col("p") >= 0.5, "choice": F.col("label")}[s.verb]
            found = answers.select(F.struct(*IDENTITY).alias("key"), value.alias(f"out{i}"))
            out = out.withColumn("own", F.coalesce(own, absent)).join(found, F.col("own") == F.col("key"), "left").drop("own", "key")
        return out.select("row.*", *[F.col(f"out{i}").alias(s.out) for i, s in enumerate(specs)])

    def _count(self, answers: DataFrame, provider: Provider, query: dict) -> None:
        """Adds up what the requests report of themselves."""
        requests = answers.where("size is not null").groupBy("size", F.col("error").isNotNull().alias("bad"), "sent", "model", F.col("input_tokens").isNotNull().alias("usage"))
        for r in requests.agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("seconds").alias("s"), F.sum("serialize").alias("z")).collect():
            reply = None if r["bad"] else Reply({}, r["model"], (r["i"], r["o"]) if r["usage"] else None, r["z"] or 0.0)
            profile.record(query, r["size"], Outcome(reply, JudgmentError("Provider", "") if r["bad"] else None, r["sent"], r["s"] or 0.0), provider.external, r["n"])

    # ---- cache: a driver-side object, as large as its policy allows -----------------------------------------------

    def _hits(self, work: DataFrame, provider: Provider, config: Config, query: dict, tables: Workspace) -> DataFrame:
        cache, sample = self.open_cache(config, provider), self.cache_key(provider, Request(NOUL, State(True, ""), ""))
        known = {k.request: k for k in cache.entries if sample is not None and k[:4] == sample[:4]}
        rows = [(r.kind, r.state.is_text, r.state.canonical, r.text, list(r.choices), v if r.kind == NOUL else None, v if r.kind == CHOICE else None) for r, k in known.items() for v in [cache.entries[k][0]]]
        cached = self.spark.createDataFrame(rows, "kind string, is_text boolean, canonical string, text string, choices array<string>, p double, label string")
        hits = tables.write(work.join(cached, IDENTITY).select(*IDENTITY, "p", "label"))
        for r in hits.select(*IDENTITY).limit(config.cache_max_entries).collect():
            cache.get(known[Request(r[0], State(r[1], r[2]), r[3], tuple(r[4]))])
        query["cache_hit_judgments"] = hits.count()
        return hits

    def _remember(self, answers: DataFrame, provider: Provider) -> None:
        for r in answers.limit(self.cache.policy.max_entries).select(*IDENTITY, "p", "label", "model").collect():
            key = self.cache_key(provider, Request(r["kind"], State(r["is_text"], r["canonical"]), r["text"], tuple(r["choices"])))
            if key is not None and provider.cache_model(r["model"]) is not None:
                self.cache.put(key, r["p"] if r["kind"] == NOUL else r["label"])
