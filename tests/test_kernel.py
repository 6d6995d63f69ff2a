"""The permutation kernel against a plain version of its rules."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.operators import kernel as K
from loomspark.plans import kernel_queries as Q


def changes(text):
    out, word = [], ""
    for c in text:
        if c in "-xX":
            out += [word, c] if word else [c]
            word = ""
        elif c == ".":
            out += [word] if word else []
            word = ""
        elif not c.isspace():
            word += c
    return out + ([word] if word else [])


def change(row, c):
    row, k = list(row), 0
    stays = set() if c in K.CROSS else {K.ORDER.find(x.upper()) for x in c}
    while k < len(row) - 1:
        if k not in stays and k + 1 not in stays:
            row[k], row[k + 1] = row[k + 1], row[k]
            k += 1
        k += 1
    return "".join(row)


def lead(notation, stage, rule="mirror_drop_last", start=None):
    parts = notation.split(",")
    a = changes(parts[0])
    if len(parts) > 1:
        b = changes(parts[1])
        a = {"mirror_drop_last": a + a[:-1][::-1] + b, "mirror_full": a + a[::-1] + b, "mirror_drop_first": a + a[1:][::-1] + b, "b_between": a + b + a[:-1][::-1]}[rule]
    rows = [start or K.ORDER[:stage]]
    for c in a:
        rows.append(change(rows[-1], c))
    return rows


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["-36-14", "x16x16", "3.1.5.1.5", "", " 3 . 1-1 4", "-", "12.34-"])
def test_split(spark, text):
    assert one(spark, K.split_changes(F.lit(text))) == changes(text)


@pytest.mark.parametrize("row,c,after", [("123456", "-", "214365"), ("123456", "12", "124365"), ("123456", "14", "132465"), ("123456", "36", "213546"), ("123456", "16", "132546"), ("12345", "3", "21354"), ("12345", "1", "13254")])
def test_changes(spark, row, c, after):
    assert "".join(one(spark, K.apply_change(F.split(F.lit(row), ""), F.lit(c)))) == after


@pytest.mark.parametrize("symbol,place", [("1", 0), ("0", 9), ("E", 10), ("e", 10), ("T", 11), ("t", 11), ("A", 12), ("D", 15), ("Z", None), ("-", None), (" ", None)])
def test_places(spark, symbol, place):
    assert one(spark, K.place_of(F.lit(symbol))) == place


def test_expansion(spark):
    assert one(spark, K.expand(F.lit("-36-14,12"))) == ["-", "36", "-", "14", "-", "36", "-", "12"]
    assert one(spark, K.expand(F.lit("3.1.5.1.5.1"))) == ["3", "1", "5", "1", "5", "1"]


def test_lead_heads_and_rules(spark):
    got = {r["title"]: r["lead_head"] for r in Q.lead_head(spark, "").collect()}
    assert got == {t: h for t, _, _, h in Q.GOLDEN} == {t: lead(x, s)[-1] for t, s, x, _ in Q.GOLDEN}
    right = {rule: sum(lead(x, s, rule)[-1] == h for _, s, x, h in Q.GOLDEN) for rule in K.EXPANSIONS}
    assert {r["rule"]: r["right"] for r in Q.expand_rules(spark, "").collect()} == right


@settings(max_examples=15, deadline=None)
@given(stage=st.integers(3, 12), places=st.lists(st.integers(0, 11), max_size=4))
def test_a_change_is_its_own_inverse(spark, stage, places):
    c = "".join(K.ORDER[p] for p in places) or "-"
    row = F.split(F.lit(K.ORDER[:stage]), "")
    once, twice = spark.range(1).select(K.apply_change(row, F.lit(c)), K.apply_change(K.apply_change(row, F.lit(c)), F.lit(c))).first()
    assert "".join(once) == change(K.ORDER[:stage], c) and "".join(twice) == K.ORDER[:stage]


def rows_of_heads():
    from itertools import permutations

    return {"1" + "".join(p): lead(Q.MINOR + "," + Q.CALLS["p"], 6, start="1" + "".join(p))[1:] for p in permutations("23456")}


def test_false_heads_and_music(spark):
    rows, holders = rows_of_heads(), defaultdict(set)
    for head, own in rows.items():
        for r in own:
            holders[r].add(head)
    want = {(a, b) for own in holders.values() for a in own for b in own if a != b}
    assert {(r["head"], r["false_head"]) for r in K.false_heads(K.head_rows(K.course_heads(spark, 6), Q.MINOR, Q.CALLS["p"], 6)).collect()} == want
    score = lambda r: ("56" in r) + 2 * r.startswith("1234") + 5 * (r == "142536")
    assert {r["head"]: r["score"] for r in K.musicality(K.head_rows(K.course_heads(spark, 6), Q.MINOR, Q.CALLS["p"], 6), 6).collect()} == {h: sum(map(score, own)) for h, own in rows.items()}


def test_long_parting_costs(spark):
    apart = "17345682"
    rows = [("h", k, apart) for k in range(60)] + [("g", k, apart if k % 2 else "12345678") for k in range(60)]
    got = {r["head"]: r["score"] for r in K.musicality(spark.createDataFrame(rows, "head string, place int, row string"), 8).collect()}
    assert got["h"] == pytest.approx(-1.0) and got["g"] == pytest.approx(30 * (1 + 2 + 1.5))


def test_found_paths_are_true_and_come_round(spark):
    found = Q.composition_search(spark, "").collect()
    assert found and all(r["complete"] for r in found)
    assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    score = lambda r: ("56" in r) + 2 * r.startswith("1234") + 5 * (r == "142536")
    for r in found:
        start, heads = "123456", []
        for c in r["calls"]:
            heads.append(start)
            start = lead(Q.MINOR + "," + Q.CALLS[c], 6, start=start)[-1]
        plain = [x for h in heads for x in rows_of_heads()[h]]
        assert start == "123456" and len(plain) == len(set(plain)) and len(heads) == r["leads"]
        assert r["score"] == sum(map(score, plain))


def test_no_path_comes_round_when_truth_is_tested_first(spark):
    from loomspark.operators.search import search

    assert not any(r["complete"] for r in search(spark, Q.MINOR, Q.CALLS, 6, 2, 6, 5, literal=True).collect())


def test_truth(spark):
    df = spark.createDataFrame([("a", "12"), ("a", "21"), ("b", "12"), ("b", "12")], "composition string, row string")
    assert {r["composition"]: r["true"] for r in K.truth(df).collect()} == {"a": True, "b": False}


@pytest.fixture(scope="module")
def major():
    """Rows of the plain lead of Cambridge Surprise Major from each of the 5,040 heads."""
    from itertools import permutations

    turns = [[int(b) - 1 for b in r] for r in lead("-38-14-1258-36-14-58-16-78,12", 8)[1:]]
    heads = ["1" + "".join(p) for p in permutations("2345678")]
    return {h: ["".join(h[i] for i in t) for t in turns] for h in heads}


def major_score(rows):
    score, run, longest = 0.0, 0, 0
    for r in rows:
        score += ("5678" in r) + 2 * r.startswith("1234") + 5 * (r == "15263748") + (2 if r.endswith("8765") else 1.5 if r.endswith("5678") else 0)
        run = run + 1 if abs(r.index("7") - r.index("8")) > 1 else 0
        longest = max(longest, run)
    return score - max(0, longest - 50) * 0.1


def test_recorded_heads_are_those_of_eight_bells(spark, major):
    from loomspark.plans import registry

    holders = defaultdict(set)
    for head, own in major.items():
        for r in own:
            holders[r].add(head)
    want = {(a, b) for own in holders.values() for a in own for b in own if a != b}
    assert {(r["head"], r["false_head"]) for r in registry.QUERIES["false_heads"](spark, "").collect()} == want
    assert {r["head"]: r["score"] for r in registry.QUERIES["head_music"](spark, "").collect()} == pytest.approx({h: major_score(own) for h, own in major.items()})
    assert len(major) == 5040


def test_recorded_search_is_that_of_the_reference(spark, major):
    from loomspark.plans import registry

    found = registry.QUERIES["composition_search"](spark, "").collect()
    assert found and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    for r in found:
        start, heads = "12345678", []
        for c in r["calls"]:
            heads.append(start)
            start = lead("-38-14-1258-36-14-58-16-78," + Q.CALLS[c], 8, start=start)[-1]
        if r["complete"]:
            assert start == "12345678" and 39 <= len(heads) <= 42
        else:
            heads.append(start)
        rows = [x for h in heads for x in major[h]]
        assert len(rows) == len(set(rows)) and len(heads) == r["leads"] and r["head"] == start
        assert r["score"] == pytest.approx(sum(major_score(major[h]) for h in heads))
