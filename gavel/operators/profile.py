"""The redacted profile of a query that judged rows: counts, timings, usage and cost; no states, questions or secrets."""

from __future__ import annotations

import json

from gavel.operators.asking import Outcome

COUNTS = ("input_rows", "null_rows", "valid_rows", "unique_judgments", "deduplicated_rows", "cache_hit_judgments", "provider_invocations", "external_requests", "batched_requests", "failed_requests")
#: The price of the remote service's default endpoint, and where and when it was seen.
RATE, UNIT, SOURCE, SEEN = 0.042, "USD per 1,000,000 input tokens", "published price list", "2026-09-23"


def begin(provider: str, detailed: bool, default_endpoint: bool = False, model: str | None = None) -> dict:
    """A query's tally."""
    return dict.fromkeys(COUNTS, 0) | {"provider": provider, "status": "completed", "detailed": detailed, "default_endpoint": default_endpoint, "requested_model": model, "reported_models": set(), "batch_sizes": {}, "replies": 0, "usage_missing": 0, "input_tokens": 0, "output_tokens": 0, "serialize": 0.0, "roundtrip": 0.0, "wall": 0.0}


def record(query: dict, size: int, outcome: Outcome, external: bool, times: int = 1) -> None:
    """Counts requests of ``size`` judgments; seconds and usage are those of all of them together."""
    if outcome.error is not None:
        query["failed_requests"] += times if outcome.sent else 0
        query["status"] = "failed"
    if not outcome.sent:
        return
    query["provider_invocations"] += times
    reply = outcome.reply
    if reply and reply.model:
        query["reported_models"].add(reply.model)
    if not external:
        return
    query["external_requests"] += times
    query["batched_requests"] += times if size > 1 else 0
    query["batch_sizes"][size] = query["batch_sizes"].get(size, 0) + times
    query["roundtrip"] += outcome.seconds
    if reply:
        query["replies"] += times
        query["serialize"] += reply.serialize_seconds
    if reply and reply.usage:
        query["input_tokens"] += reply.usage[0]
        query["output_tokens"] += reply.usage[1]
    else:
        query["usage_missing"] += times


def render(query: dict) -> str:
    priced = query["provider"] == "remote" and query["default_endpoint"]
    known = query["external_requests"] > 0 and not query["usage_missing"]
    reason = None
    if not priced:
        reason = "provider_has_no_known_pricing"
    elif not query["external_requests"]:
        reason = "no_external_requests"
    elif query["failed_requests"]:
        reason = "failed_requests"
    elif not known:
        reason = "incomplete_usage"
    timed = query["detailed"] and query["external_requests"]
    return json.dumps(
        {
            "schema_version": 1,
            "status": query["status"],
            "provider": query["provider"],
            "requested_model": query["requested_model"],
            "reported_models": sorted(query["reported_models"]),
            "counts": {k: int(query[k]) for k in COUNTS} | {"batch_size_histogram": {str(k): n for k, n in sorted(query["batch_sizes"].items())}},
            "timing_ms": {
                "query_wall": round(1000 * query["wall"], 3),
                "serialization_sum": round(1000 * query["serialize"], 3) if timed and query["replies"] == query["external_requests"] else None,
                "external_roundtrip_sum": round(1000 * query["roundtrip"], 3) if timed else None,
                "server_inference_sum": None,  # no service says how long it thinks
                "pure_network_sum": None,
            },
            "usage": {"input_tokens": query["input_tokens"] if known else None, "output_tokens": query["output_tokens"] if known else None, "missing_response_count": query["usage_missing"]},
            "cost_estimate": {"amount": None if reason else query["input_tokens"] * RATE / 1e6, "unknown_reason": reason, **dict(zip(("currency", "billing_unit", "unit_rate", "rate_source", "rate_observed_at"), ("USD", UNIT, RATE, SOURCE, SEEN) if priced else (None,) * 5))},
        },
        sort_keys=True,
    )
