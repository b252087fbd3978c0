"""jev_prob, jev_bool, jev_choice, jev_cache_clear and jev_last_profile as functions of Spark SQL.

Settings are read at each execution, from the properties Spark hands to its tasks.  NULL arguments give NULL and ask nothing.
In row mode each valid row is one call; a provider that is a function of its arguments runs in the task, once for each distinct
judgment.  Everything that goes to a service, and every query in optimized mode, is asked through the session's broker.
"""

from __future__ import annotations

from multiprocessing.connection import Client, Connection
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gavel.functions.batches import distinct, read, slices, spread
from gavel.functions.values import CHOICE, NOUL, JudgmentError, Request
from gavel.operators.broker import Broker
from gavel.plans.judge import JudgmentSession
from gavel.sources.providers import SETTINGS, Provider, make_provider, read_config

#: Judgments whose answers a task remembers, and the most characters they hold.
REMEMBERED, REMEMBERED_CHARS = 100_000, 16 << 20
#: Bytes of an Arrow batch that are read at a time.
READ = 4 << 20


class Task:
    """A Python worker's side: the connection to the broker, and what the task has judged itself."""

    def __init__(self, address: tuple[str, int], key: bytes):
        self.address, self.key = address, key
        self.link: Connection | None = None
        self.known: dict[Request, object] = {}
        self.chars = 0
        self.mute = False

    def __reduce__(self):
        return Task, (self.address, self.key)

    def setting(self, name: str) -> str | None:
        from pyspark import TaskContext

        task = TaskContext.get()
        return task.getLocalProperty(name) if task else None

    def conf(self) -> dict:
        return {k: v for k in SETTINGS.values() if (v := self.setting(k)) is not None}

    def call(self, what: str, *args):
        query = self.setting("spark.sql.execution.root.id") or self.setting("spark.sql.execution.id") or ""
        try:
            if self.link is None:
                self.link = Client(self.address, authkey=self.key)
            self.link.send((what, query, self.conf(), *args))
            done, *reply = self.link.recv()
        except (OSError, EOFError):
            raise JudgmentError("Provider", "the session's broker cannot be reached") from None
        if not done:
            raise JudgmentError(*reply)
        return reply[0]

    def count(self, counts: dict, failed: bool = False) -> None:
        """Adds to the profile; judging goes on without one if the driver cannot be reached."""
        if not self.mute:
            try:
                self.call("count", counts, failed)
            except JudgmentError:
                self.mute = True

    def answer(self, provider: Provider, r: Request) -> object:
        """The answer of a provider that runs in the task; what is remembered for it is bounded by number and length."""
        value = provider.judge([r]).answers[r.key]
        chars = len(r.state.canonical) + len(r.text) + sum(map(len, r.choices))
        if len(self.known) >= REMEMBERED or self.chars + chars > REMEMBERED_CHARS:
            self.known.clear()
            self.chars = 0
        if chars <= REMEMBERED_CHARS:
            self.known[r] = value
            self.chars += chars
        return value

    def judge(self, kind: str, result: pa.DataType, state: pa.Array, text: pa.Array, choices: pa.Array | None = None) -> pa.Array:
        """A batch's answers.  Long texts are read in slices, each of which is let go before the next."""
        whole = [c for c in (state, text, choices) if c is not None]
        counts = {"input_rows": len(state), "null_rows": 0, "valid_rows": 0}

        def requests_of(part: list[pa.Array]) -> tuple[list[Request | None], np.ndarray]:
            first, back = distinct(*part)
            return read(kind, first, *part[:2], part[2] if len(part) > 2 else None), back

        parts, null_rows = slices(whole, READ), 0
        try:
            for part in parts:  # every row is checked before the first is judged
                requests, back = requests_of(part)
                null_rows += int(np.array([r is None for r in requests], bool)[back].sum())
            counts["null_rows"] = null_rows
            if null_rows == len(state):
                self.count(counts)
                return pa.nulls(len(state), result)
            config = read_config(self.conf().get)
            provider = make_provider(config, "") if config.provider.strip().lower() == "mock" else None
        except JudgmentError:
            self.count(counts, True)
            raise
        counts["valid_rows"] = len(state) - null_rows
        if config.mode == "row" and provider is not None:
            out, asked = [], 0
            for part in parts:
                if len(parts) > 1:
                    requests, back = requests_of(part)
                values = []
                for r in requests:
                    value = None if r is None else self.known.get(r)
                    if r is not None and value is None:
                        value, asked = self.answer(provider, r), asked + 1
                    values.append(value)
                out.append(spread(values, back, result))
            self.count(counts | {"unique_judgments": counts["valid_rows"], "provider_invocations": asked})
            return pa.concat_arrays(out)
        if len(parts) > 1:
            requests, back = requests_of(whole)
        if config.mode == "row":  # a call for each row
            requests, back = [requests[i] for i in back], np.arange(len(back))
        answers = iter(self.call("judge", counts, [(r.kind, r.state.is_text, r.state.canonical, r.text, r.choices) for r in requests if r is not None]))
        return spread([None if r is None else next(answers) for r in requests], back, result)


BROKERS: WeakKeyDictionary[SparkSession, Broker] = WeakKeyDictionary()


def register(spark: SparkSession, nondeterministic: bool = False, session: JudgmentSession | None = None) -> JudgmentSession:
    """Registers the functions and returns the session that keeps their cache and profile: ``session``, or the one before.

    The judgments are deterministic by default, so that Spark prunes, reuses and moves them like its own functions.
    """
    if spark not in BROKERS:
        BROKERS[spark] = Broker(spark, session or JudgmentSession(spark))
    broker = BROKERS[spark]
    broker.session = session or broker.session
    task = Task(broker.address, broker.key)

    def jev_prob(state: pa.Array, criterion: pa.Array) -> pa.Array:
        return task.judge(NOUL, pa.float64(), state, criterion)

    def jev_bool(state: pa.Array, criterion: pa.Array) -> pa.Array:
        return pc.greater_equal(task.judge(NOUL, pa.float64(), state, criterion), 0.5)

    def jev_choice(state: pa.Array, question: pa.Array, choices: pa.Array) -> pa.Array:
        return task.judge(CHOICE, pa.string(), state, question, choices)

    for f, kind in ((jev_prob, "double"), (jev_bool, "boolean"), (jev_choice, "string")):
        udf = F.arrow_udf(f, kind)
        spark.udf.register(f.__name__, udf.asNondeterministic() if nondeterministic else udf)
    spark.udf.register("jev_cache_clear", F.udf(lambda: task.call("clear"), "long").asNondeterministic())
    spark.udf.register("jev_last_profile", F.udf(lambda: task.call("profile"), "string").asNondeterministic())
    return broker.session
