"""Odd arguments, schemas and dependency graphs of the tool-call operator."""

import json
import random

import pytest

from spindle.llm import chat

SCHEMAS = {"f": {"type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"enum": [1, "x"]}}}}


def _linked(spark, calls, results=(), schemas=SCHEMAS, **more):
    df, res = spark.createDataFrame(calls, chat.CALLS), spark.createDataFrame(list(results), chat.RESULTS)
    return chat.link_tool_calls(df, res, schemas, **more).collect()


def test_odd_arguments(spark):
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    cases = {
        '{"a": 1e999}': (False, '{"a": 1e999}'),
        '{"a": NaN}': (False, '{"a": NaN}'),
        '{"a": null}': (True, {"a": None}),
        '{"a": 2.0}': (True, {"a": 2}),
        '{"a": 2.5}': (False, {"a": 2.5}),
        '{"a": true}': (False, {"a": True}),
        '{"b": true}': (False, {"b": True}),
        '{"b": 1.0}': (True, {"b": 1}),
        deep: (False, deep),
        "[" * 100_000: (False, "[" * 100_000),
        '{"c": "\\ud800"}': (True, {"c": "\ud800"}),
        '{"c": "' + "x" * 3_000_000 + '"}': (True, {"c": "x" * 3_000_000}),
        "": (False, ""),
        "9" * 5000: (False, "9" * 5000),
    }
    got = _linked(spark, [(1, i, f"c{i}", "f", text, []) for i, text in enumerate(cases)])
    for row, (text, (fits, arguments)) in zip(sorted(got, key=lambda r: r.turn), cases.items()):
        assert row.valid == fits and json.loads(row.json)["arguments"] == arguments, text[:40]
    assert '"a":2,' in [r.json for r in got if r.turn == 3][0].replace("}", ",")  # whole numbers have one form


def test_unknown_types_are_refused(spark):
    with pytest.raises(ValueError, match="unknown type"):
        _linked(spark, [(1, 1, "c", "f", "{}", [])], schemas={"f": {"properties": {"a": {"type": "date"}}}})


@pytest.mark.parametrize("task_calls", [100_000, 3])
def test_levels_in_a_task_and_in_rounds(spark, task_calls):
    r, calls, want = random.Random(2), [], {}
    for conv in range(3):
        order = list(range(9))
        r.shuffle(order)
        for place, call in enumerate(order):
            needs = [f"n{c}" for c in order[:place] if r.random() < 0.4]
            calls.append((conv, call, f"n{call}", "f", "{}", needs))
        of = {f"n{c}": [n for x in calls if x[0] == conv and x[2] == f"n{c}" for n in x[5]] for c in order}
        level = lambda n: 1 + max((level(m) for m in of[n]), default=-1)  # noqa: B023, E731
        ranked = sorted(of, key=lambda n: (level(n), int(n[1:])))
        want |= {(conv, n): at for at, n in enumerate(ranked)}
    calls += [(9, t, f"x{t}", "f", "{}", [f"x{t + 1}"]) for t in range(6)] + [(10, 0, "p", "f", "{}", ["q"]), (10, 1, "q", "f", "{}", ["p", "p"]), (10, 2, "s", "f", "{}", [])]
    want |= {(9, f"x{t}"): 5 - t for t in range(6)} | {(10, "p"): None, (10, "q"): None, (10, "s"): 0}
    got = _linked(spark, calls, task_calls=task_calls)
    assert {(x.conv_id, x.call_id): x.position for x in got} == want


def test_a_long_reversed_conversation(spark):
    n = 3000
    got = _linked(spark, [(1, t, f"x{t:05}", "f", "{}", [f"x{t + 1:05}"]) for t in range(n)])
    assert all(x.position == n - 1 - x.turn for x in got)
