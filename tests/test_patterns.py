"""Patterns that backtrack too far are refused before they meet a line, in tables of any size."""

import itertools
import re

import pytest

from gistline import schema
from gistline.functions import ambiguity as A
from gistline.functions.regex import PatternError, translate
from gistline.plans import reduce
from gistline.session import local_frame
from gistline.sources.rulesets import RULESETS

DOUBLING = [
    r"(a+)+$", r"(a*)*b", r"(a|a)*b", r"(\d|\w)*;", r"(\d+|\w+)*;", r"(.*)*x", r"(\w+\s?)+:", r"(x+x+)+y", r"([a-z]+)*=", r"(a|ab|b)*c",
    r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(?:\s*\w*)*!", r"^(.*?,){11}P", r"([^,]*,?)+;", r"(?i)(A|a)+Z", r"([[:alpha:]]+)+[[:digit:]]", r"(a*b*)*c",
]
GROWING = {r".*a.*b.*c.*d.*e": 5, r"\s*\s*\s*\s*x": 4, r"^.*,.*,.*,.*;$": 4, r"(?:a*){4}b": 4}
TAME = {
    r"^error\[E[0-9]+\]: .*$": 1, r"\w+:\w+:\w+:\w+:\w+": 1, r"^(\S+ ){5}x": 1, r"(a|b|c)*d": 1, r"(?i)^\s*(warn|error)\b.*": 1, r"a.*b.*c": 2,
    r"(a|ab)*c": 1, r"([^,]*,)+;": 1, r"(\w+ )*\w+$": 1, r"[[:digit:]]{1,3}(\.[0-9]{1,3}){3}": 0, r"\pL+\z": 1, r"(?P<k>\w+)=(?P<v>\S*)": 1, "": 0,
}


@pytest.mark.parametrize("pattern", [*DOUBLING, *GROWING])
def test_refused(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


def test_growth():
    named = {p: A.growth(p) for p in [*DOUBLING, *GROWING, *TAME] if "[[:" not in p}
    assert named == {p: g for p, g in {**{p: A.EXPONENTIAL for p in DOUBLING}, **GROWING, **TAME}.items() if "[[:" not in p}
    assert all(translate(p) for p in TAME)


@pytest.mark.parametrize("bad", ["(", "a)", "[b", "*", "a{2,1}", r"\p"])
def test_no_patterns(bad):
    with pytest.raises(PatternError):
        translate(bad)


def ways(pattern, word):
    """Ways to read a whole word, by counting walks over places."""
    places = A.Places(pattern)
    now = {p: 1 for p in range(len(places.reads)) if word[0] in places.reads[p]}
    for c in word[1:]:
        after = {}
        for p, n in now.items():
            for q in places.after[p]:
                if c in places.reads[q]:
                    after[q] = after.get(q, 0) + n * places.follow[p, q]
        now = after
    return sum(now.values())


def test_growth_is_the_growth_of_ways():
    """Over all short words repeated: doubling patterns multiply, others keep to their power."""
    for pattern, g in [(r"(a+)+$", 99), (r"(a|ab|b)*c", 99), (r"(a|ab)*c", 1), (r"a*b*a*", 2), (r"(ab)*(ba)*a*", 1), (r"a*(b|a)*b", 2), (r"(aab|aa)*b?", 1)]:
        assert A.growth(pattern) == g
        most = 1.0
        for word in ("".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)):
            few, many = ways(pattern, word * 12), ways(pattern, word * 24)
            if few:
                most = max(most, many / few)
        assert most > 1000 if g == 99 else most < 2 ** (g + 0.5)


def test_own_rule_sets_pass():
    texts = re.findall(r"""'(?:pattern|pattern2|enter)': '((?:[^'\\]|\\.)*)'""", repr(RULESETS))
    assert len(texts) > 40 and all(A.growth(t.encode().decode("unicode_escape")) <= 2 for t in texts)


def profiles(spark, n, rule, invariants=()):
    rules = [{"kind": "keep_lines", "pattern": "^a.*$"}, rule]
    rows = [{"profile_id": i, "fingerprint": f"f{i}", "version": "1", "schema": "1.0", "provenance": "synthesized", "status": "active", "created_at": 1,
             "format_claim": "plain", "rules": rules if i == n - 1 else rules[:1], "invariants": list(invariants) if i == n - 1 else []} for i in range(n)]
    return local_frame(spark, rows, schema.PROFILES)


@pytest.mark.parametrize("n", [1, 64, 65, 300])
@pytest.mark.parametrize("bad", ["x(?=a)", "(", "(a+)+b"])
def test_every_pattern_of_every_rule_set_is_checked(spark, n, bad):
    state = {"name": "s", "enter": "a", "keep": ["a"], "drop": []}
    places = [
        {"kind": "drop_lines", "pattern": bad}, {"kind": "collapse_between", "pattern": "a", "pattern2": bad, "placeholder": "x"},
        {"kind": "state_machine", "states": [{**state, "enter": bad}]}, {"kind": "state_machine", "states": [{**state, "keep": ["a", bad]}]},
        {"kind": "state_machine", "states": [{**state, "drop": [bad]}]},
    ]
    for rule in places if n in (1, 65) else places[2:3]:
        with pytest.raises(PatternError):
            reduce.compile_rules(profiles(spark, n, rule))
    invariant = {"name": "v", "check": "first_line_matches", "pattern": bad}
    good = {"kind": "state_machine", "states": [state]}
    with pytest.raises(PatternError):
        reduce.compile_rules(profiles(spark, n, good, [invariant]))
    assert reduce.compile_rules(profiles(spark, n, good, [{**invariant, "pattern": "a"}])).steps
