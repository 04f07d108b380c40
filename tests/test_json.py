"""What is JSON: texts against Python's parser, and documents of any length in line tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gistline.functions import jsontext as J
from gistline.operators import formats, scan


def refuse(_):
    raise ValueError


def depth(x):
    inner = x.values() if isinstance(x, dict) else x
    return 1 + max(map(depth, inner), default=0) if isinstance(x, (dict, list)) else 0


def fits(x):
    """Numbers are doubles, and strings hold no half of a surrogate pair."""
    if isinstance(x, dict):
        return all(fits(k) and fits(v) for k, v in x.items())
    if isinstance(x, list):
        return all(map(fits, x))
    try:
        return math.isfinite(float(x)) if isinstance(x, (int, float)) else x is None or bool(x.encode() or True)
    except (OverflowError, UnicodeEncodeError):
        return False


def is_document(text):
    try:
        value = json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return text.strip() == text.strip(" \t\r\n") and depth(value) <= J.MAX_DEPTH and fits(value)


def some_text(rng, deep):
    def space():
        return rng.choice(["", "", " ", "\n", "\t "])

    if not deep or rng.random() < 0.4:
        return rng.choice(["1", "-0", "0.5", "1e5", '"a"', '"[,\\"{"', "true", "null", '""', '"\\u12aB"', '"\\\\"'])
    items = [some_text(rng, deep - 1) + space() for _ in range(rng.randint(0, 4))]
    if rng.random() < 0.5:
        return "[" + space() + ("," + space()).join(items) + "]"
    return "{" + ",".join(space() + rng.choice(['"k"', '"a"', '"x:"']) + space() + ":" + space() + i for i in items) + space() + "}"


def texts(n, seed):
    """Documents and documents with a letter too few, too many or a part missing."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text = some_text(rng, rng.randint(0, 5))
        out.append(text)
        for _ in range(2):
            i, j = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
            out.append(rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("{}[],:\"0 \n\\x'stv!") + text[i:], text[:i] + text[j:]]))
    return out


FIXED = [
    "", '{"a":1,"a":2}', "[1e999]", "[1e308]", "1" * 400, "[" * 127 + "]" * 127, "[" * 128 + "]" * 128, '{"a":' * 127 + "1" + "}" * 127,
    "[]" * 2, "[s]", "s", "x", "[x]", '"\\ud800"', '"\\ud83d\\ude00"', "{'a':1}", '"\t"', "\u0001", "[\u0001]", "-", "NaN", "1}, {\"x\":2]",
    "1], [2", "[1]\x0b", "[" + ",".join(["[1]"] * 300) + "]", '{"a":"' + "z" * 100_000 + '"}', "[" + '"a\\n",' * 20_000 + "1]",
]


@pytest.fixture(scope="module")
def many(spark):
    every = texts(400, 5) + FIXED
    return every, spark.createDataFrame(list(enumerate(every)), "i int, text string").repartition(4)


def test_documents(many):
    every, df = many
    got = {r.i: r.v for r in df.select("i", J.json_valid(F.col("text")).alias("v")).collect()}
    assert [t for i, t in enumerate(every) if got[i] != is_document(t)] == []


def test_folding_pieces_is_folding_the_whole(many):
    every, df = many
    form = J.tokens(F.col("text"))
    cut = F.transform(F.split("text", "\n"), lambda line: J.folded(J.tokens(line)))
    for r in df.select("i", J.folded(form).alias("whole"), J.folded(F.array_join(cut, "")).alias("parts"), J.depths(form)["top"].alias("top")).collect():
        assert r.whole == r.parts
        if every[r.i].lstrip()[:1] in ("{", "["):
            assert (r.whole == "x" and r.top <= J.MAX_DEPTH) == is_document(every[r.i])


def test_forms_stay_short(spark):
    """A piece of any length folds to some letters a level."""
    pieces = ["[" + "1," * 5000, '{"a":1,' * 3 + '"b":2,' * 5000, "}," * 1 + "{}," * 5000, '"a":{"b":[' * 60, "[" * 200, "]" * 200, "[1}," * 500]
    df = spark.createDataFrame([(p,) for p in pieces], "text string")
    lengths = [len(r.f) for r in df.select(J.folded(J.tokens(F.col("text"))).alias("f")).collect()]
    assert max(lengths) <= 8 * J.MAX_DEPTH and lengths[4:] == [1, 1, 1] and max(lengths[:3]) < 30


def test_documents_in_line_tables(spark, monkeypatch):
    """Four neighbours at a time, so that a document of a few lines takes many rounds."""
    monkeypatch.setattr(scan, "FOLD_BITS", 6)
    monkeypatch.setattr(scan, "FOLD_ROUNDS", 10)
    long = {"rows": ["["] + ['{"id": 7, "tags": ["a", "b"]},'] * 3000 + ["{}", "]"], "key": ["{", '"a"', ":", "1", "}"],
            "broken": ["["] + ["[1, 2],"] * 2000 + ["]"], "crossed": ["[", "{", "]", "}"], "deep": ["["] * 127 + ["]"] * 127, "deeper": ["["] * 128 + ["]"] * 128}
    every = {**{str(i): t.split("\n") for i, t in enumerate(texts(60, 9)) if t.lstrip()[:1] in ("{", "[")}, **long}
    lines = [(s, i, 0, x) for s, ls in every.items() for i, x in enumerate(ls)]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame(lines, "session_id string, line_no long, sub_no int, text string").repartition(7)
    got = {r.session_id for r in formats.json_documents(df).collect()}
    assert got == {s for s, ls in every.items() if is_document("\n".join(ls))} and {"rows", "key", "deep"} <= got


def test_equal_keys_keep_the_last(spark):
    from gistline.session import configure

    df = configure(spark).createDataFrame([('{"a":1,"b":0,"a":{"c":2}}',)], "text string")
    assert J.json_path_keep(df, "text", ["$.a.c"]).first().text == '{"$.a.c":2}'
    assert J.json_path_drop(df, "text", ["$.b", "$.b.c"]).first().text == '{"a":{"c":2}}'


def plain_segments(path):
    import re

    out = []
    for part in re.findall(r"\.[^.\[]*|\[[^\]]*\]?|[^.\[].*", path[1:] if path.startswith("$") else path):
        if part.startswith("."):
            out.append(part)
        elif part.startswith("[") and part[1:].rstrip("]").isdigit():
            out.append(f"#{int(part[1:].rstrip(']'))}")
        else:
            return None
    return out


def plain_get(value, parts):
    for p in parts:
        if p[0] == "." and isinstance(value, dict) and p[1:] in value:
            value = value[p[1:]]
        elif p[0] == "#" and isinstance(value, list) and int(p[1:]) < len(value):
            value = value[int(p[1:])]
        else:
            return KeyError
    return value


def plain_drop(value, path):
    rest = path[1:] if path.startswith("$") else path
    if "." in rest:
        parent, last = rest.rsplit(".", 1)
        walked = [f"#{p}" if p.isdigit() else f".{p}" for p in parent.replace("[", ".").replace("]", ".").split(".") if p]
        holder = plain_get(value, walked)
        if isinstance(holder, dict):
            holder.pop(last, None)
    return value


PATHS = ["$", "$.a", "a.b", ".k", "$.k[0]", "$.k[01].a", "$[1]", "$[x]", "$.k.", "$.'x'", '$.q"', "$.k.a.k", "$.k[999999999999]", "$.x:", "$[0][0].k", "$.0.a", "", "$.\\", "$.a'\"b.c"]


def test_paths_as_columns(spark):
    """Each document with its own path list, against plain walks; one plan for all."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        text = some_text(rng, 5) if i % 7 else json.dumps({"a": {"b": [1, {"k": None}]}, "k": [{"a": {"k": i}}, [i]], 'q"': 1, "0": {"a": 2}, "": 3, "\\": 4, "a'\"b": {"c": 5, "d": 6}})
        rows.append((i, text, rng.sample(PATHS, rng.randint(0, 4)) if i % 11 else None))
    df = spark.createDataFrame(rows, "i int, text string, paths array<string>")
    kept = {r.i: r.text for r in J.json_path_keep(df, "text", F.col("paths")).collect()}
    dropped = {r.i: r.text for r in J.json_path_drop(df, "text", F.col("paths")).collect()}
    for i, text, paths in rows:
        if paths is None:
            assert kept[i] == dropped[i] == text
            continue
        found = {p: plain_get(json.loads(text), plain_segments(p)) for p in sorted(paths) if plain_segments(p) is not None}
        assert json.loads(kept[i]) == {p: v for p, v in found.items() if v is not KeyError}
        value = json.loads(text)
        for p in paths:
            value = plain_drop(value, p)
        assert json.loads(dropped[i]) == value


def sets_of_paths(spark, n):
    from gistline import schema
    from gistline.session import local_frame

    rows = [{"profile_id": i, "fingerprint": f"f{i}", "version": "1", "schema": "1.0", "provenance": "synthesized", "status": "active", "created_at": 1,
             "format_claim": "json", "rules": [{"kind": ("json_path_keep", "json_path_drop")[i % 2], "paths": [f"$.k{i}.a", "$.z"]}],
             "invariants": []} for i in range(n)]
    return local_frame(spark, rows, schema.PROFILES)


def test_a_thousand_rule_sets_with_their_own_paths(spark):
    from gistline.plans import reduce

    table = reduce.compile_rules(sets_of_paths(spark, 1000))
    sessions = spark.createDataFrame(
        [(f"s{i}", f"f{i}", f'{{"k{i}": {{"a": {i}, "b": 1}},\n\n "z": [{i}]}}\n' if i % 5 else "no\n\njson\n") for i in range(1000)],
        "session_id string, fingerprint string, text string").repartition(3)
    reduced = reduce.reduce_sessions(sessions, table)
    got = {}
    for r in sorted(reduced.collect(), key=lambda r: (r.session_id, r.line_no)):
        got.setdefault(r.session_id, []).append(r.text)
    for i in range(1000):
        if i % 5 == 0:
            assert got[f"s{i}"] == ["no", "", "json"]
        elif i % 2:
            assert got[f"s{i}"] == [f'{{"k{i}":{{"b":1}}}}']
        else:
            assert got[f"s{i}"] == [f'{{"$.k{i}.a":{i},"$.z":[{i}]}}']
    plan = reduced._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") <= 1 and plan.count("[session_id") < 60


def test_json_steps_in_line_tables(spark):
    """Sessions too long for one task: documents become one line, others are told apart without being put together."""
    from gistline.plans import reduce

    table = reduce.compile_rules(sets_of_paths(spark, 3))
    long = {"doc": ["{", '"k0":', '{"a":[1,', "2]},", '"x":0', "}"], "not": ["{", '"k0":', "}", ","] * 3, "one": ["7"] + ["", " "] * 4}
    rows = [(s, i, 0, x, False, "f0") for s, ls in long.items() for i, x in enumerate(ls)]
    df = spark.createDataFrame(rows, "session_id string, line_no long, sub_no long, text string, is_placeholder boolean, fingerprint string")
    for limit in (4, 100):
        got = {}
        for r in sorted(reduce.reduce_lines(df, table, max_lines=limit, parts=3).collect(), key=lambda r: (r.session_id, r.line_no)):
            got.setdefault(r.session_id, []).append(r.text)
        assert got == {"doc": ['{"$.k0.a":[1,2]}'], "not": long["not"], "one": ["{}"]}
