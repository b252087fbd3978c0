"""Packing of judgments into requests, and asking a provider one request."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

from gavel.functions.values import JudgmentError, Request, invalid
from gavel.sources.providers import Config, Provider, Reply


class Outcome(NamedTuple):
    """What one request came to: a reply or an error, and whether anything was sent."""

    reply: Reply | None
    error: JudgmentError | None
    sent: bool
    seconds: float


def preflight(config: Config, provider: Provider) -> int:
    """Judgments a request may hold; an error if batches are asked of a provider that is not verified for them."""
    if not config.batch_enabled:
        return 1
    if provider.batch != "Verified":
        raise JudgmentError("Configuration", "the provider is not verified for batches")
    return min(config.batch_max_judgments, provider.max_batch or config.batch_max_judgments)


def packs(work: Iterable[Request], limit: int, max_bytes: int, provider: Provider) -> Iterator[list[Request]]:
    """Judgments of one question in order, as many to a request as number and bytes allow."""
    pack: list[Request] = []
    size = 0
    for r in work:
        more = provider.added(r, len(pack))
        if pack and (len(pack) >= limit or size + more > max_bytes):
            yield pack
            pack, size, more = [], 0, provider.added(r, 0)
        pack.append(r)
        size += more
    if pack:
        yield pack


def sizes(r: Request, limit: int, provider: Provider) -> list[int]:
    """The bytes that a judgment adds to a request, by the digits of its place: at 0, 1 to 9, 10 to 99 ... below ``limit``."""
    return [provider.added(r, 0), *(provider.added(r, 10**d) for d in range(len(str(limit - 1))))]


def ends(sizes: np.ndarray, own: int, limit: int, max_bytes: int) -> np.ndarray:
    """Where a pack ends that starts at each of the first ``own`` judgments; the rest is what follows these."""
    at, total, end = np.arange(own), sizes[:own, 0], np.arange(1, own + 1, dtype=np.int32)
    for place in range(1, limit):
        inside = at + place < len(sizes)
        at, total = at[inside], total[inside]
        total = total + sizes[at + place, len(str(place))]
        at, total = at[total <= max_bytes], total[total <= max_bytes]
        if not len(at):
            break
        end[at] += 1
    return end


def crossings(end: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """For packs that leave the first 0, 1 ... ``limit`` - 1 judgments to the segment before: how many of the next segment
    the last pack takes, and the packs that start here."""
    own = len(end)
    taken, started = [0] * (own + 1), [0] * (own + 1)
    for i, e in zip(range(own - 1, -1, -1), end[::-1].tolist()):
        taken[i], started[i] = (taken[e], started[e] + 1) if e < own else (e - own, 1)
    return taken[:limit], started[:limit]


def pack_numbers(end: list[int], entry: int, before: int) -> list[int]:
    """The pack of each judgment, where ``entry`` ones belong to the last of the ``before`` packs started earlier."""
    out, number, start = [], before - 1, entry
    for i, e in enumerate(end):
        if i == start:
            number, start = number + 1, e
        out.append(number)
    return out


def ask(provider: Provider, pack: list[Request], max_bytes: int | None) -> Outcome:
    """One request, its rows keyed r0, r1 ...; larger ones than ``max_bytes`` are not sent."""
    keyed = [r if r.key == f"r{i}" else Request(r.kind, r.state, r.text, r.choices, f"r{i}") for i, r in enumerate(pack)]
    began, sent = time.perf_counter(), False
    try:
        if max_bytes is not None and sum(provider.added(r, i) for i, r in enumerate(keyed)) > max_bytes:
            raise invalid("request exceeds spark.jev.maxRequestBytes")
        if provider.max_choices and any(len(r.choices) > provider.max_choices for r in keyed):
            raise invalid(f"provider supports at most {provider.max_choices} choices")
        sent = True
        return Outcome(provider.judge(keyed), None, True, time.perf_counter() - began)
    except JudgmentError as e:
        return Outcome(None, e, sent, time.perf_counter() - began)
