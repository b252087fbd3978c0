"""The session's cache of judgments: bounded by entries and bytes, expiring, least recently used first out.  Memory only."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass
from typing import NamedTuple

from gavel.functions.values import JudgmentError, Request


@dataclass(frozen=True)
class Policy:
    max_entries: int
    max_bytes: int
    ttl_ms: int

    def __post_init__(self):
        if min(self.max_entries, self.max_bytes, self.ttl_ms) <= 0:
            raise JudgmentError("Configuration", "cache limits must be greater than 0")


class Key(NamedTuple):
    """A judgment's identity: where and under which model it was asked, and its full content."""

    provider: str
    url: str
    model: str
    effective_model: str
    request: Request


def entry_bytes(key: Key, result) -> int:
    """Estimated size: 512, six times the identity's texts, and the result."""
    r = key.request
    texts = [r.state.canonical, r.text, *r.choices, key.provider, key.url, key.model, key.effective_model]
    return 512 + 6 * sum(len(x.encode()) for x in texts) + (len(result.encode()) if isinstance(result, str) else 8)


class JudgmentCache:
    def __init__(self, policy: Policy, clock=lambda: time.monotonic() * 1000):
        self.policy, self.clock = policy, clock
        self.entries: OrderedDict[Key, tuple[object, float, int]] = OrderedDict()  # result, expiry, bytes
        self.bytes = 0

    def _remove(self, key: Key) -> None:
        self.bytes -= self.entries.pop(key)[2]

    def get(self, key: Key):
        found = self.entries.get(key)
        if found is None:
            return None
        if self.clock() >= found[1]:
            self._remove(key)
            return None
        self.entries.move_to_end(key)
        return found[0]

    def put(self, key: Key, result) -> None:
        """Successful results only."""
        if key in self.entries:
            self._remove(key)
        size = entry_bytes(key, result)
        if size <= self.policy.max_bytes:
            self.entries[key] = (result, self.clock() + self.policy.ttl_ms, size)
            self.bytes += size
            self._evict()

    def reconcile(self, policy: Policy) -> None:
        """Applies changed limits before anything is served: a shorter time to live counts for what is there already."""
        if policy.ttl_ms < self.policy.ttl_ms:
            latest = self.clock() + policy.ttl_ms
            self.entries = OrderedDict((k, (r, min(e, latest), b)) for k, (r, e, b) in self.entries.items())
        self.policy = policy
        now = self.clock()
        for key in [k for k, (_, e, _) in self.entries.items() if now >= e]:
            self._remove(key)
        self._evict()

    def _evict(self) -> None:
        while len(self.entries) > self.policy.max_entries or self.bytes > self.policy.max_bytes:
            self._remove(next(iter(self.entries)))

    def clear(self) -> int:
        n = len(self.entries)
        self.entries.clear()
        self.bytes = 0
        return n
