"""Providers of judgments: a deterministic offline one, and HTTP services."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from gavel.functions.values import CHOICE, NOUL, JudgmentError, Request, check_answers

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
MOCK_MODEL = "gavel-deterministic-mock-v1"
REMOTE_URL, LOCAL_URL = "http://127.0.0.1:8765/v1/judge", "http://127.0.0.1:8080/v1/judge"
#: Requested model aliases for which rows may share a request, and the model that must answer.
BATCH_MODELS, BATCH_REPORTED = ("jev-latest", "jev-1.13.0"), "jev-1.13.0"


@dataclass
class Reply:
    """Results by request key, and what the service said about itself."""

    answers: dict[str, object]
    model: str | None = None
    usage: tuple[int, int] | None = None
    serialize_seconds: float = 0.0


@dataclass
class Provider:
    name: str
    external: bool = False
    batch: str = "Unknown"  # Verified, Unsupported or Unknown
    max_choices: int | None = None
    max_batch: int | None = None

    def added(self, r: Request, place: int) -> int:
        """Upper bound of the bytes that a judgment adds to a request that holds ``place`` others; beyond the first place, only
        the digits of the place count."""
        return (0 if place else 1024) + 512 + 6 * (len(r.state.data) + len(r.text.encode()) + sum(len(c.encode()) for c in r.choices) + len(f"r{place}"))

    def estimate(self, requests: list[Request]) -> int:
        """Upper bound of the bytes of a request."""
        return sum(self.added(r, i) for i, r in enumerate(requests))

    def cache_model(self, reported: str | None = None) -> str | None:
        """The model under which answers may be cached; None: not at all."""
        return None

    def judge(self, requests: list[Request]) -> Reply:
        raise NotImplementedError


def fnv(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    return h


@dataclass
class Mock(Provider):
    name: str = "mock"
    batch: str = "Verified"

    def cache_model(self, reported: str | None = None) -> str | None:
        return MOCK_MODEL

    def judge(self, requests: list[Request]) -> Reply:
        answers = []
        for r in requests:
            if r.kind == NOUL:
                answers.append((r.key, NOUL, fnv(r.state.data + b"noul" + r.text.encode()) % 1_000_001 / 1_000_000))
            else:
                h = fnv(r.state.data + b"choice" + r.text.encode() + b"".join(b"\x1f" + c.encode() for c in r.choices))
                answers.append((r.key, CHOICE, r.choices[h % len(r.choices)]))
        return Reply(check_answers(requests, answers), MOCK_MODEL)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """A redirect is an error like any other status: the credential goes to the configured address only."""

    def redirect_request(self, *_):
        return None


def _json(x) -> bytes:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()


@dataclass
class Http(Provider):
    """A service that takes typed questions about rows and answers by key."""

    url: str = REMOTE_URL
    model: str = "jev-latest"
    timeout_ms: int = 30_000
    max_response: int = 1_048_576
    credential: str = field(default="", repr=False)
    external: bool = True
    opener: urllib.request.OpenerDirector | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        if self.name == "selfhosted":
            self.batch, self.max_choices = "Unsupported", 255
        else:
            self.batch = "Verified" if self.model in BATCH_MODELS else "Unknown"

    def cache_model(self, reported: str | None = None) -> str | None:
        fixed = self.name != "selfhosted" and re.fullmatch(r"jev-\d+(\.\d+)+", self.model)
        return self.model if fixed and reported in (None, self.model) else None

    def body(self, requests: list[Request]) -> bytes:
        first = requests[0]
        if any((r.kind, r.text, r.choices) != (first.kind, first.text, first.choices) for r in requests):
            raise JudgmentError("InvalidInput", "rows of a request must share their question")
        return _json(self._frame(first) | {"state": {"rows": [r.state.wire() for r in requests], **self._condition(first)}, "questions": {r.key: self._question(r, i) for i, r in enumerate(requests)}})

    def _frame(self, r: Request) -> dict:
        return {"model": self.model, "state": {"rows": [], **self._condition(r)}, "questions": {}}

    def _condition(self, r: Request) -> dict:
        return {"condition": r.text} if r.kind == NOUL else {}

    def _question(self, r: Request, place: int) -> dict:
        row = f"rows[{place}]"
        if r.kind == NOUL:
            return {"type": NOUL, "instructions": f"How likely does the condition hold for {row}?"}
        return {"type": CHOICE, "instructions": f"{r.text} Answer for {row}.", "criteria": dict.fromkeys(r.choices)}

    def added(self, r: Request, place: int) -> int:
        """Exact: a row and its question with their separators, and for the first one what is around them."""
        around = 2 if place else len(_json(self._frame(r)))
        return around + len(_json(r.state.wire())) + len(_json({f"r{place}": self._question(r, place)})) - 2

    def judge(self, requests: list[Request]) -> Reply:
        began = time.perf_counter()
        body = self.body(requests)
        serialized = time.perf_counter() - began
        call = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.credential}"})
        began = time.perf_counter()
        try:
            self.opener = self.opener or urllib.request.build_opener(_NoRedirect)
            with self.opener.open(call, timeout=self.timeout_ms / 1000) as response:
                data = response.read(self.max_response + 1)
                truncated = response.headers.get("x-local-jev-truncated", "").lower() == "true"
        except urllib.error.HTTPError as e:
            hint = "; check the credential" if e.code in (401, 403) else ""
            raise JudgmentError("Provider", f"provider returned HTTP status {e.code}{hint}") from None
        except OSError:
            raise JudgmentError("Provider", "provider request failed or timed out") from None
        if time.perf_counter() - began > self.timeout_ms / 1000:
            raise JudgmentError("Provider", "provider request failed or timed out")
        if len(data) > self.max_response:
            raise JudgmentError("Provider", "provider response exceeds the size limit")
        if self.name == "selfhosted" and truncated:
            raise JudgmentError("InvalidResponse", "provider truncated its input")
        reply = self.parse(requests, data)
        reply.serialize_seconds = serialized
        return reply

    def parse(self, requests: list[Request], data: bytes) -> Reply:
        bad = JudgmentError("InvalidResponse", "provider response is not valid")
        try:
            found = json.loads(data)
        except ValueError:
            raise bad from None
        if not isinstance(found, dict) or not isinstance(found.get("answers"), dict):
            raise bad
        if len(requests) > 1 and found.get("model") != BATCH_REPORTED:
            raise JudgmentError("InvalidResponse", "provider reported another model than batching was verified for")
        answers = []
        for key, a in found["answers"].items():
            kind = a.get("type") if isinstance(a, dict) else None
            answers.append((key, kind, a.get(kind) if kind in (NOUL, CHOICE) else None))
        usage = found.get("usage") if isinstance(found.get("usage"), dict) else {}
        tokens = tuple(usage.get(k) for k in ("input_tokens", "output_tokens"))
        return Reply(check_answers(requests, answers), found.get("model"), tokens if all(isinstance(x, int) for x in tokens) else None)


@dataclass(frozen=True)
class Config:
    """The session's spark.jev.* settings, frozen for one execution."""

    provider: str = "mock"
    api_url: str = REMOTE_URL
    local_api_url: str = LOCAL_URL
    model: str = ""
    timeout_ms: int = 30_000
    max_response_bytes: int = 1_048_576
    mode: str = "row"
    batch_enabled: bool = False
    batch_max_judgments: int = 16
    max_request_bytes: int = 262_144
    max_inflight: int = 4
    cache_enabled: bool = False
    cache_max_entries: int = 10_000
    cache_max_bytes: int = 67_108_864
    cache_ttl_ms: int = 60_000
    profile_enabled: bool = False


#: Setting, by field of Config.
SETTINGS = {
    "provider": "spark.jev.provider", "api_url": "spark.jev.apiUrl", "local_api_url": "spark.jev.localApiUrl", "model": "spark.jev.model", "timeout_ms": "spark.jev.timeoutMs", "max_response_bytes": "spark.jev.maxResponseBytes",
    "mode": "spark.jev.executionMode", "batch_enabled": "spark.jev.batch.enabled", "batch_max_judgments": "spark.jev.batch.maxJudgments", "max_request_bytes": "spark.jev.maxRequestBytes", "max_inflight": "spark.jev.maxInflight",
    "cache_enabled": "spark.jev.cache.enabled", "cache_max_entries": "spark.jev.cache.maxEntries", "cache_max_bytes": "spark.jev.cache.maxBytes", "cache_ttl_ms": "spark.jev.cache.ttlMs", "profile_enabled": "spark.jev.profile.enabled",
}


def read_config(get) -> Config:
    """get: setting name -> text or None."""
    values: dict = {}
    for name, key in SETTINGS.items():
        raw, kind = get(key), type(getattr(Config, name))
        if raw is None:
            continue
        if kind is bool:
            if str(raw).lower() not in ("true", "false"):
                raise JudgmentError("Configuration", f"{key} must be true or false")
            values[name] = str(raw).lower() == "true"
        elif kind is int:
            if not re.fullmatch(r"\d+", str(raw)) or int(raw) <= 0:
                raise JudgmentError("Configuration", f"{key} must be greater than 0")
            values[name] = int(raw)
        else:
            values[name] = str(raw)
    c = Config(**values)
    if c.provider.strip().lower() not in ("mock", "remote", "selfhosted"):
        raise JudgmentError("Configuration", f"{SETTINGS['provider']} must be 'mock', 'remote' or 'selfhosted'")
    if c.mode not in ("row", "optimized"):
        raise JudgmentError("Configuration", f"{SETTINGS['mode']} must be 'row' or 'optimized'")
    for on, name in ((c.batch_enabled, "batch_enabled"), (c.cache_enabled, "cache_enabled")):
        if on and c.mode == "row":
            raise JudgmentError("Configuration", f"{SETTINGS[name]} requires {SETTINGS['mode']}='optimized'")
    return c


#: Environment variables of credentials, first found first; credentials are never settings.
CREDENTIALS = {"remote": ("JEV_API_KEY_OVERRIDE", "JEV_API_KEY"), "selfhosted": ("JEV_LOCAL_API_KEY",)}


def credential(kind: str) -> str:
    return next((v for k in CREDENTIALS.get(kind, ()) if (v := os.environ.get(k, "")).strip()), "")


def make_provider(c: Config, secret: str | None = None) -> Provider:
    kind = c.provider.strip().lower()
    if kind == "mock":
        return Mock()
    secret = credential(kind) if secret is None else secret
    if kind == "remote":
        if not secret:
            raise JudgmentError("Configuration", f"the remote provider needs a credential in {CREDENTIALS['remote'][1]}")
        return Http("remote", url=c.api_url, model=c.model or "jev-latest", timeout_ms=c.timeout_ms, max_response=c.max_response_bytes, credential=secret)
    url = c.api_url if c.api_url != REMOTE_URL else c.local_api_url
    return Http("selfhosted", url=url, model=c.model or "nli-deberta-large", timeout_ms=c.timeout_ms, max_response=c.max_response_bytes, credential=secret)
