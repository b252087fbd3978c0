from decimal import Decimal

import pyarrow as pa
import pytest

from gavel.functions.values import CHOICE, NOUL, JudgmentError, Request, check_answers, check_probability, float_text, struct_state, text_state
from gavel.functions.batches import distinct
from gavel.operators.cache import JudgmentCache, Key, Policy, entry_bytes
from gavel.sources.providers import Http, Mock, fnv, read_config


def test_canonical_struct():
    s = struct_state([("price", pa.float64(), 101.5), ("load", pa.float64(), 0.82), ("wind", pa.float64(), 12.0)])
    assert s.canonical == '{"canonical_version":1,"state":{"t":"struct","f":{"load":{"t":"float","v":0.82},"price":{"t":"float","v":101.5},"wind":{"t":"float","v":12.0}}}}'
    t = struct_state([("a", pa.int8(), 1), ("b", pa.string(), None), ("c", pa.decimal128(10, 2), Decimal("1.50")), ("d", pa.bool_(), True), ("e", pa.uint64(), 2**64 - 1)])
    assert '"a":{"t":"int","v":"1"},"b":{"t":"null"},"c":{"t":"decimal","v":"1.50"},"d":{"t":"bool","v":true},"e":{"t":"uint","v":"18446744073709551615"}' in t.canonical
    assert struct_state([("a", pa.int32(), 1)]) != struct_state([("a", pa.int32(), 1), ("b", pa.null(), None)])
    assert text_state("ab").envelope() == b"GVST\x00\x00\x00\x01\x01" + b"\x00" * 7 + b"\x02ab"


@pytest.mark.parametrize("x, text", [(1e16, "1e16"), (1e-5, "1e-5"), (0.1, "0.1"), (12.0, "12.0"), (1e15, "1000000000000000.0")])
def test_floats(x, text):
    assert float_text(x) == text


@pytest.mark.parametrize("kind, value", [(pa.date32(), None), (pa.list_(pa.int32()), None), (pa.float64(), float("nan")), (pa.float64(), float("inf"))])
def test_rejected_fields(kind, value):
    with pytest.raises(JudgmentError):
        struct_state([("x", kind, value)])


@pytest.mark.parametrize("kind, text, choices, message", [
    (NOUL, " \t", (), "criterion"), (CHOICE, "", ("a", "b"), "question"), (CHOICE, "q", ("a",), "two"), (CHOICE, "q", ("a", "a"), "duplicate"), (CHOICE, "q", ("a", " "), "whitespace"), (CHOICE, "q", ("a", None), "NULL"),
])
def test_request_rules(kind, text, choices, message):
    with pytest.raises(JudgmentError, match=message):
        Request(kind, text_state("s"), text, choices).check()


def test_answers():
    r = [Request(NOUL, text_state("s"), "q", (), "r0"), Request(CHOICE, text_state("s"), "q", ("a", "b"), "r1")]
    assert check_answers(r, [("r1", CHOICE, "b"), ("r0", NOUL, 1)]) == {"r0": 1.0, "r1": "b"}
    for bad in ([("r0", NOUL, 0.5)], [("r0", NOUL, 0.5), ("r0", NOUL, 0.5)], [("r0", NOUL, 0.5), ("r1", CHOICE, "c")], [("r0", CHOICE, "a"), ("r1", CHOICE, "a")]):
        with pytest.raises(JudgmentError):
            check_answers(r, bad)
    for p in (-0.1, 1.1, float("nan"), "0.5", True, None):
        with pytest.raises(JudgmentError):
            check_probability(p)


def test_mock_golden_values():
    assert fnv(b"") == 0xCBF29CE484222325
    ask = lambda s, q: Mock().judge([Request(NOUL, text_state(s), q)]).answers["r0"]
    assert [ask("hello", "is it a greeting?"), ask("", "q"), ask("s", "q")] == [0.404799, 0.876798, 0.333046]


def test_config_rules():
    for bad in ({"spark.jev.provider": "x"}, {"spark.jev.timeoutMs": "0"}, {"spark.jev.executionMode": "Row"}, {"spark.jev.batch.enabled": "true"}, {"spark.jev.cache.enabled": "true"}):
        with pytest.raises(JudgmentError):
            read_config(bad.get)
    assert read_config({"spark.jev.provider": " MOCK "}.get).max_inflight == 4


def key(text):
    return Key("mock", "", "", "m", Request(NOUL, text_state(text), "q"))


def test_cache_bytes():
    long = Key("remote", "http://x", "jev-1.0", "jev-1.0", Request(CHOICE, text_state("sé"), "q?", ("a", "bc")))
    assert entry_bytes(long, "bc") == 512 + 6 * 3 + 6 * (2 + 3 + 6 + 8 + 7 + 7) + 2 and entry_bytes(key("s"), 0.5) == 512 + 6 + 6 * 6 + 8


def test_added_bytes_are_exact():
    for kind, choices in ((NOUL, ()), (CHOICE, ("ä", 'b"'))):
        rows = [Request(kind, s, "is it\nso?", choices, f"r{i}") for i, s in enumerate([text_state('é "x"'), struct_state([("a", pa.int32(), 1)]), *[text_state("z" * i) for i in range(12)]])]
        for n in (1, 2, len(rows)):
            assert Http("remote").estimate(rows[:n]) == len(Http("remote").body(rows[:n]))


def test_distinct_rows():
    state = pa.array([{"a": 1, "b": 0.0}, None, {"a": 1, "b": -0.0}, {"a": 1, "b": 0.0}, {"a": None, "b": None}, {"a": 1, "b": 0.0}])
    text, choices = pa.array(["q"] * 5 + ["r"]), pa.array([["x", "y"]] * 6)
    first, back = distinct(state, text, choices)
    assert len(first) == 5 and back[0] == back[3] and len(set(back)) == 5
    ragged = pa.array([["x"], ["x", "y"], None, ["x"], ["x", None], ["x", "y"]])
    assert len(set(distinct(text, ragged)[1])) == 5 and list(distinct(pa.array([], pa.string()))[1]) == []


def test_cache():
    now = [0.0]
    c = JudgmentCache(Policy(2, 10_000, 100), lambda: now[0])
    c.put(key("a"), 0.1)
    c.put(key("b"), 0.2)
    assert c.get(key("a")) == 0.1
    c.put(key("c"), "x")
    assert c.get(key("b")) is None and c.get(key("c")) == "x"  # least recently used went
    now[0] = 100
    assert c.get(key("a")) is None  # the boundary is expired
    c.put(key("d"), 0.3)
    c.reconcile(Policy(2, 10_000, 50))
    now[0] = 151
    assert c.get(key("d")) is None
    c.put(key("e"), 0.3)
    c.reconcile(Policy(1, entry_bytes(key("e"), 0.3) - 1, 50))
    assert c.clear() == 0
    with pytest.raises(JudgmentError):
        Policy(0, 1, 1)
