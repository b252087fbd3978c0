"""The judgments of SQL functions, asked by the driver on behalf of all tasks of a session.

Tasks send the distinct judgments of an Arrow batch to the driver over an authenticated connection.  There each judgment of a
query is asked once, whichever function, task or batch wants it first (optimized mode), or once for each row (row mode); the cap on
requests in flight, request packing, cache and profile hold for the session as a whole, and credentials never leave the driver.
What is asked here goes to a service that takes ``spark.jev.maxInflight`` requests at a time, so that the driver does not limit it.
Answers of the last queries are kept, at most ``SHARED`` of each; one that was dropped is asked again if it is wanted again.
"""

from __future__ import annotations

import secrets
import threading
import time
from collections import OrderedDict, defaultdict
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, Future, ThreadPoolExecutor, wait
from multiprocessing import AuthenticationError
from multiprocessing.connection import Connection, Listener

from pyspark.sql import SparkSession

from gavel.functions.values import JudgmentError, Request, State
from gavel.operators import profile
from gavel.operators.asking import Outcome, ask, packs, preflight
from gavel.sources.providers import REMOTE_URL, Provider, make_provider, read_config

SHARED, QUERIES = 1_000_000, 8


class Permits:
    """A cap on requests in flight that may change from one request to the next."""

    def __init__(self):
        self.active, self.free = 0, threading.Condition()

    def hold(self, limit: int, work: Callable[[], Outcome]) -> Outcome:
        with self.free:
            while self.active >= limit:
                self.free.wait()
            self.active += 1
        try:
            return work()
        finally:
            with self.free:
                self.active -= 1
                self.free.notify_all()


class Query:
    """What is known of one running or finished query."""

    def __init__(self, tally: dict):
        self.tally, self.began, self.failed, self.cleared = tally, time.perf_counter(), None, None
        self.answers: OrderedDict[Request, Future] = OrderedDict()


class Broker:
    def __init__(self, spark: SparkSession, session):
        """``session``: keeps the cache and the profile."""
        conf = spark.sparkContext.getConf()
        local = spark.sparkContext.master.startswith("local")
        host = "127.0.0.1" if local else conf.get("spark.driver.bindAddress") or conf.get("spark.driver.host")
        self.session, self.key = session, secrets.token_bytes(32)
        self.listener = Listener((host, 0), backlog=1024, authkey=self.key)
        self.address = (host if local else conf.get("spark.driver.host"), self.listener.address[1])
        self.queries: OrderedDict[str, Query] = OrderedDict()
        self.lock, self.permits = threading.RLock(), Permits()
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                link = self.listener.accept()
            except (AuthenticationError, EOFError, ConnectionError):
                continue
            except OSError:
                return
            threading.Thread(target=self._serve, args=(link,), daemon=True).start()

    def _serve(self, link: Connection) -> None:
        """Messages are (what, query, settings, ...); replies are (True, value) or (False, kind, message)."""
        query_id = None
        try:
            while True:
                what, query_id, conf, *rest = link.recv()
                try:
                    reply = (True, getattr(self, f"on_{what}")(link, query_id, conf, *rest))
                except JudgmentError as e:
                    reply = (False, e.kind, e.message)
                link.send(reply)
        except (EOFError, OSError):
            link.close()

    def _query(self, query_id: str, conf: dict) -> Query:
        with self.lock:
            if query_id not in self.queries:
                name = conf.get("spark.jev.provider", "mock").strip().lower()
                url = conf.get("spark.jev.apiUrl", REMOTE_URL)
                self.queries[query_id] = Query(profile.begin(name, conf.get("spark.jev.profile.enabled", "").lower() == "true", url == REMOTE_URL))
                while len(self.queries) > QUERIES:
                    self.queries.popitem(last=False)
            return self.queries[query_id]

    def _publish(self, query: Query) -> None:
        query.tally["wall"] = time.perf_counter() - query.began
        if query.tally["input_rows"]:
            self.session.profile = profile.render(query.tally)

    # ---- messages ------------------------------------------------------------------------------------------------

    def on_profile(self, link: Connection, query_id: str, conf: dict) -> str | None:
        return self.session.profile

    def on_clear(self, link: Connection, query_id: str, conf: dict) -> int:
        """Clears the cache once for each query, however many rows ask."""
        with self.lock:
            query = self._query(query_id, conf)
            if query.cleared is None:
                query.cleared = self.session.cache_clear(read_config(conf.get))
            return query.cleared

    def on_count(self, link: Connection, query_id: str, conf: dict, counts: dict, failed: bool) -> None:
        """Rows of a batch that were judged, or refused, without the driver."""
        query = self._query(query_id, conf)
        with self.lock:
            for k, n in counts.items():
                query.tally[k] += n
            if failed:
                query.tally["status"] = "failed"
            self._publish(query)

    def on_judge(self, link: Connection, query_id: str, conf: dict, counts: dict, rows: list[tuple]) -> list:
        """The answers of checked judgments (kind, is_text, canonical, text, choices), in order."""
        query, requests = self._query(query_id, conf), [Request(k, State(t, c), x, ch) for k, t, c, x, ch in rows]
        with self.lock:
            for k, n in counts.items():
                query.tally[k] += n
        try:
            if query.failed:
                raise query.failed
            config = read_config(conf.get)
            provider = make_provider(config)
            query.tally["requested_model"] = getattr(provider, "model", None)
            limit = preflight(config, provider)
            over = provider.max_choices and any(len(r.choices) > provider.max_choices for r in requests)
            if over:
                raise JudgmentError("InvalidInput", f"provider supports at most {provider.max_choices} choices")
            if config.mode == "row":
                with self.lock:
                    query.tally["unique_judgments"] += len(requests)
                return self._run(link, query, config.max_inflight, provider, [[r] for r in requests], None)
            mine, wanted = self._claim(query, requests)
            with self.lock:
                query.tally["unique_judgments"] += len(mine)
                query.tally["deduplicated_rows"] += counts["valid_rows"] - len(mine)
            self._answer(link, query, config, provider, limit, mine)
            return [f.result() for f in wanted]
        except JudgmentError as e:
            with self.lock:
                query.tally["status"] = "cancelled" if e.kind == "Cancelled" else "failed"
                query.failed = query.failed or e
            raise
        finally:
            with self.lock:
                self._publish(query)

    # ---- asking --------------------------------------------------------------------------------------------------

    def _claim(self, query: Query, requests: list[Request]) -> tuple[dict[Request, Future], list[Future]]:
        """The judgments that nobody has asked yet in this query, which the caller must ask; and what answers each request."""
        with self.lock:
            mine = {}
            for r in requests:
                if r not in query.answers:
                    query.answers[r] = mine[r] = Future()
            wanted = [query.answers[r] for r in requests]
            while len(query.answers) > SHARED and next(iter(query.answers.values())).done():
                query.answers.popitem(last=False)
            return mine, wanted

    def _answer(self, link: Connection, query: Query, config, provider: Provider, limit: int, mine: dict[Request, Future]) -> None:
        """Gives each of its judgments an answer or the error: errors are shared like answers, and never asked again."""
        keys = {}
        try:
            if config.cache_enabled:
                with self.lock:
                    cache = self.session.open_cache(config, provider)
                    for r in mine:
                        keys[r] = self.session.cache_key(provider, r)
                        if keys[r] is not None and (found := cache.get(keys[r])) is not None:
                            mine[r].set_result(found)
                            query.tally["cache_hit_judgments"] += 1
            contexts = defaultdict(list)
            for r in mine:
                if not mine[r].done():
                    contexts[r.kind, r.text, r.choices].append(r)
            todo = [p for rows in contexts.values() for p in packs(rows, limit, config.max_request_bytes, provider)]
            answers = self._run(link, query, config.max_inflight, provider, todo, config.max_request_bytes)
            for r, (value, model) in zip((r for p in todo for r in p), answers):
                if keys.get(r) is not None and provider.cache_model(model) is not None:
                    with self.lock:
                        cache.put(keys[r], value)
                mine[r].set_result(value)
        except JudgmentError as e:
            for f in mine.values():
                if not f.done():
                    f.set_exception(e)
            raise

    def _run(self, link: Connection, query: Query, inflight: int, provider: Provider, todo: list[list[Request]], max_bytes: int | None) -> list:
        """Asks packs, ``inflight`` at a time; stops at the first error, and when the task that asks has gone."""
        stop = threading.Event()

        def one(pack: list[Request]) -> Outcome | None:
            out = self.permits.hold(inflight, lambda: None if stop.is_set() else ask(provider, pack, max_bytes))
            if out is not None:
                with self.lock:
                    profile.record(query.tally, len(pack), out, provider.external)
                if out.error is not None:
                    stop.set()
                    raise out.error
            return out

        if not todo:
            return []
        with ThreadPoolExecutor(min(inflight, len(todo))) as pool:
            futures = [pool.submit(one, p) for p in todo]
            left = set(futures)
            while left and not stop.is_set():
                _, left = wait(left, 0.05, FIRST_EXCEPTION)
                if left and _gone(link):
                    stop.set()
                    for f in left:
                        f.cancel()
                    raise JudgmentError("Cancelled", "the query was cancelled")
        for f in futures:
            if f.exception():
                raise f.exception()
        answers = [(f.result().reply.answers[f"r{i}"], f.result().reply.model) for f, p in zip(futures, todo) for i in range(len(p))]
        return [a for a, _ in answers] if max_bytes is None else answers


def _gone(link: Connection) -> bool:
    """Whether the other side, which sends nothing while it waits, has closed the connection."""
    try:
        return link.poll(0)
    except OSError:
        return True
