"""Judgment states, their canonical encoding, requests, and the checks on both sides of a provider."""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa

NOUL, CHOICE = "noul", "choice"
#: Unicode White_Space; Python's str.strip() would also take U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class JudgmentError(Exception):
    """kind: InvalidInput, InvalidResponse, Provider or Configuration.  Messages never hold states or secrets."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message

    def __reduce__(self):
        return JudgmentError, (self.kind, self.message)


def invalid(message: str) -> JudgmentError:
    return JudgmentError("InvalidInput", message)


# ---- values of a struct state ------------------------------------------------------------------------------------


def float_text(x: float) -> str:
    """Shortest digits that read back the same, with a plain exponent (1e16, 1e-5)."""
    mantissa, _, exponent = repr(float(x)).partition("e")
    return f"{mantissa}e{int(exponent)}" if exponent else mantissa


def node(kind: pa.DataType, value) -> str:
    """The canonical text of one field."""
    t = pa.types
    supported = t.is_boolean(kind) or t.is_integer(kind) or t.is_float32(kind) or t.is_float64(kind) or t.is_string(kind) or t.is_large_string(kind) or t.is_decimal(kind) or t.is_null(kind)
    if not supported:  # before the NULL check: a NULL of an unsupported type is an error too
        raise invalid("unsupported STRUCT field type")
    if value is None:
        return '{"t":"null"}'
    if t.is_boolean(kind):
        return '{"t":"bool","v":%s}' % ("true" if value else "false")
    if t.is_integer(kind):
        return '{"t":"%s","v":"%d"}' % ("uint" if t.is_unsigned_integer(kind) else "int", value)
    if t.is_floating(kind):
        if not math.isfinite(value):
            raise invalid("state contains a non-finite floating point value")
        return '{"t":"float","v":%s}' % float_text(value)
    if t.is_decimal(kind):
        return '{"t":"decimal","v":"%s"}' % format(Decimal(value), "f")
    return '{"t":"text","v":%s}' % json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class State:
    """A canonical state: text as it is, or a struct with its fields in the order of their names' bytes."""

    is_text: bool
    canonical: str

    @property
    def data(self) -> bytes:
        return self.canonical.encode()

    def wire(self):
        return self.canonical if self.is_text else json.loads(self.canonical)["state"]

    def envelope(self) -> bytes:
        """Self-describing bytes: magic, version, kind, length, payload."""
        return b"GVST" + struct.pack(">IBQ", 1, 1 if self.is_text else 2, len(self.data)) + self.data


def text_state(text: str) -> State:
    return State(True, text)


def struct_state(fields: list[tuple[str, pa.DataType, object]]) -> State:
    names = [f[0] for f in fields]
    if len(set(names)) < len(names):
        raise invalid("STRUCT state has duplicate field names")
    inner = ",".join(f"{json.dumps(n, ensure_ascii=False)}:{node(k, v)}" for n, k, v in sorted(fields, key=lambda f: f[0].encode()))
    return State(False, '{"canonical_version":1,"state":{"t":"struct","f":{' + inner + "}}}")


def state_reader(kind: pa.DataType):
    """Reads one non-null value of an Arrow type as a state."""
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return lambda scalar: text_state(scalar.as_py())
    if pa.types.is_struct(kind):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return lambda scalar: struct_state([(f.name, f.type, v) for f, v in zip(fields, _cells(scalar, fields))])
    raise invalid("unsupported state type: expected STRUCT or VARCHAR")


def _cells(scalar: pa.StructScalar, fields: list[pa.Field]) -> list:
    return [scalar[i].as_py() for i in range(len(fields))]


# ---- requests ----------------------------------------------------------------------------------------------------


def blank(text: str) -> bool:
    return not text.strip(WHITE)


@dataclass(frozen=True)
class Request:
    kind: str
    state: State
    text: str  # the criterion or the question
    choices: tuple[str, ...] = ()
    key: str = "r0"

    def check(self) -> Request:
        if blank(self.text):
            raise invalid(f"{'criterion' if self.kind == NOUL else 'question'} must not be empty or whitespace")
        if self.kind == CHOICE:
            if any(c is None for c in self.choices):
                raise invalid("choices must not contain NULL labels")
            if len(self.choices) < 2:
                raise invalid("choices must contain at least two labels")
            if any(blank(c) for c in self.choices):
                raise invalid("choices must not contain empty or whitespace labels")
            if len(set(self.choices)) < len(self.choices):
                raise invalid("choices must not contain duplicate labels")
        return self


# ---- results -----------------------------------------------------------------------------------------------------


def check_probability(p) -> float:
    if isinstance(p, bool) or not isinstance(p, (int, float)) or not math.isfinite(p) or not 0 <= p <= 1:
        raise JudgmentError("InvalidResponse", "probability must be finite and within [0, 1]")
    return float(p)


def check_label(label, choices: tuple[str, ...]) -> str:
    if not isinstance(label, str) or label not in choices:
        raise JudgmentError("InvalidResponse", "label is not one of the choices")
    return label


def check_answers(requests: list[Request], answers: list[tuple[str, str, object]]) -> dict[str, object]:
    """Results by request key of (key, kind, value): exactly one valid answer for each request."""
    wanted = {r.key: r for r in requests}
    if len(wanted) < len(requests):
        raise invalid("request keys must be unique")
    out: dict[str, object] = {}
    if len(answers) != len(requests):
        raise JudgmentError("InvalidResponse", "the number of answers differs from the number of requests")
    for key, kind, value in answers:
        if key in out or key not in wanted:
            raise JudgmentError("InvalidResponse", "duplicate or unknown answer key")
        if kind != wanted[key].kind:
            raise JudgmentError("InvalidResponse", "answer type does not match the request")
        out[key] = check_probability(value) if kind == NOUL else check_label(value, wanted[key].choices)
    return out
