"""Flat tables of nested records."""

import json
import random

import pytest

from textloom.operators import flatten as L


def json_bodies():
    rnd = random.Random(5)

    def value(depth):
        kind = rnd.randrange(8 if depth < 4 else 5)
        if kind >= 6:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        if kind == 5:
            return {rnd.choice(["a", "b\n", "ü\\", '"q', "d", "é"]): value(depth + 1) for _ in range(rnd.randrange(4))}
        return rnd.choice([None, True, False, 0, -3, 2.5, "", "x", 'a "b" \\ c', "\u20ac\n", "{[", "]}"])

    for i in range(40):
        yield json.dumps([value(0)], ensure_ascii=bool(i % 2), indent=rnd.choice([None, 2]))


def paths(body):
    return {(g, o) for _, g, o, _, _ in L.triples(body, L.DOCUMENT)}


def values(body):
    return [x for x in L.records(body, {"a"})]


def test_outermost_value():
    assert values('Sure. {"a": 1}\n\nbye') == [[(("a",), "1")]]
    assert values('```json\n{"a": "}"}\n```') == [[(("a",), "}")]]
    nested = [[(("a", 0), "1")]]
    assert values(json.dumps(json.dumps({"a": [1]}))) == nested
    assert values("text\n" + json.dumps(json.dumps({"a": [1]}))) == nested
    assert values(json.dumps({"out": json.dumps({"a": [1]})})) == nested
    assert values('[{"a": 1}, {"b": {"a": null}}]') == [[(("a",), "1")], [(("a",), None)]]
    for none in (None, "", "null", "no json here", '{"a": 1', '{"a": "', json.dumps(json.dumps({"a": [1]}))[:-4], '[{"a": 1}, ', '{"a": 1,}', '{"a" 1}', '{"a": [1}]', '{"a": "\\x"}', "[1 2]", "{}", "[]"):
        assert values(none) == []


@pytest.mark.parametrize("body", [*json_bodies()])
def test_events_are_those_of_the_public_parser(body):
    def walk(x, path=()):
        todo = [(x, path)]
        while todo:
            v, at = todo.pop()
            if isinstance(v, (dict, list)):
                todo += [(w, (*at, k)) for k, w in (v.items() if isinstance(v, dict) else enumerate(v))]
            else:
                yield at, v if isinstance(v, str) else None if v is None else json.dumps(v), isinstance(v, str)

    assert sorted(L.events(body) or [], key=str) == sorted(walk(json.loads(body)), key=str)


@pytest.mark.parametrize("depth", [1_000, 20_000])
def test_depth_never_ends_the_job(depth):
    """Up to 4 000 levels are read; a deeper record gives nothing."""
    steps = '{"description": "x", "substeps": [' * depth + "]}" * depth
    got = paths('{"solution": {"troubleshooting_steps": [' + steps + "]}}")
    assert len(got) == (0 if 2 * depth > L.LEVELS else depth)
    for body in ("[" * depth, '{"a":' * depth, "[" * depth + "]" * depth, '{"problem": {"symptoms": ' + "[" * depth + "1" + "]" * depth + "}}"):
        assert len(paths(body)) <= 1


def test_records_of_one_text_keep_apart(spark):
    body = json.dumps([{"problem": {"symptoms": ["a", "b"]}}, {"problem": {"symptoms": ["c"]}}])
    found = L.parse_triples(spark.createDataFrame([(1, body)], "rec_id long, body string"), L.DOCUMENT)
    assert {(r.doc, r.ordinal, r.value) for r in L.pivot_group(found, "symptom", ["value"]).collect()} == {(0, "0", "a"), (0, "1", "b"), (1, "0", "c")}


def test_typed_documents_as_their_json(spark):
    """Exploded columns and the parsed JSON of the same documents give the same rows."""
    rows = [(1, {"symptoms": ["a", None, " ", "b"]}, {"troubleshooting_steps": [{"description": " ", "command": None, "result": "r"}, None, {"description": "d", "command": "c", "result": None}]}, {"environment": {"os.x": "1", "k": " "}}, "clash")]
    rows += [rows[0], (2, None, None, None, None), (3, {"symptoms": None}, {"troubleshooting_steps": []}, {"environment": {}}, None)]
    schema = "record_id long, problem struct<symptoms array<string>>, solution struct<troubleshooting_steps array<struct<description string, command string, result string>>>, metadata struct<environment map<string,string>>, ordinal string"
    docs = spark.createDataFrame([(a, b and (b["symptoms"],), c and ([x and (x["description"], x["command"], x["result"]) for x in c["troubleshooting_steps"]],), e and (e["environment"],), f) for a, b, c, e, f in rows], schema)
    bodies = spark.createDataFrame([(a, json.dumps({"problem": b, "solution": c, "metadata": e})) for a, b, c, e, _ in rows], "rec_id long, body string")
    for group, columns in (("step", ["description", "command", "result"]), ("symptom", ["value"]), ("env", ["value"])):
        one, two = (sorted(map(str, L.pivot_group(t, group, columns).collect())) for t in (L.document_triples(docs), L.parse_triples(bodies, L.DOCUMENT)))
        assert one == two and one


def test_steps_symptoms_environment():
    body = {
        "result": {
            "problem": {"symptoms": ["a", None, " ", {"text": "b", "since": None}, {"text": ""}]},
            "solution": {"troubleshootingSteps": [{"description": "x", "substeps": ["", {"command": ["c", "d"], "sub_steps": "e"}]}, None, {"description": " ", "result": {"status": "ok"}}, {"description": "", "command": None}, "plain"]},
            "metadata": {"environment": {"os": {"name": "n", "version": ""}, "cpu": "1", "patch": " ", "gpu": None}},
        }
    }
    assert paths(json.dumps(body)) == {
        ("symptom", "0"), ("symptom", "3"), ("step", "0"), ("step", "0.1"), ("step", "0.1.0"), ("step", "2"), ("step", "4"), ("env", "os.name"), ("env", "cpu"),
    }


def test_single_values_and_lists_of_entries():
    body = {"problem": {"symptoms": "one"}, "solution": {"troubleshooting_steps": {"description": "s"}}, "metadata": {"environment": [{"name": "os", "value": "x"}, {"name": "k", "value": None}]}}
    assert paths(json.dumps(body)) == {("symptom", "0"), ("step", "0"), ("env", "os")}


def test_operator_on_rows(spark):
    rows = [(1, '{"solution": {"troubleshooting_steps": [{"description": "d", "command": ["a", "b"], "substeps": ["s"]}]}}', "extra"), (1, '{"solution": {"troubleshooting_steps": [{"description": "d", "command": ["a", "b"], "substeps": ["s"]}]}}', "extra"), (2, None, None), (None, "{}", None)]
    found = L.parse_triples(spark.createDataFrame(rows, "rec_id long, body string, value string"), L.DOCUMENT)
    table = {(r.rec_id, r.ordinal, r.parent, r.position, r.description, r.command, r.value) for r in L.pivot_group(found, "step", ["description", "command", "value"]).collect()}
    assert table == {(1, "0", None, 0, "d", "a\nb", None), (1, "0.0", "0", 0, None, None, "s")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "rec_id long, body string")
    assert L.pivot_group(L.parse_triples(empty, L.DOCUMENT), "env", ["value"]).count() == 0


def test_deep_and_long_records():
    step = {"description": "x"}
    for _ in range(60):
        step = {"description": "x", "substeps": [step]}
    assert ("step", ".".join(["0"] * 61)) in paths(json.dumps({"solution": {"troubleshooting_steps": [step]}}))
    assert len(paths(json.dumps({"problem": {"symptoms": ["s"] * 20000}}))) == 20000
