import random

import pytest

from millrace.operators.similarity import edit_cost, edit_costs, with_edit_cost


@pytest.mark.parametrize(
    ("a", "b", "cost"),
    [("", "", 0), ("abc", "ABC", 0), ("a1", "a2", 0.5), ("a", "ab", 0.9), ("ab", "a", 10), ("a", "b", 10), ("", "xyz", 2.7),
     ("a b", "ab", 0.2), ("ab", "a-b", 0.2), ("a-b", "a b", 0.4), ("-", "", 0.2)],
)
def test_costs(a, b, cost):
    assert edit_cost(a, b) == pytest.approx(cost)


def brute(a, b, memo=None):
    """The definition, cell by cell."""
    def plain(c):
        return c.isdecimal() or c.isalpha()

    memo = {} if memo is None else memo
    if (a, b) not in memo:
        options = [] if a or b else [0.0]
        if a:
            options.append(brute(a[1:], b, memo) + (10 if plain(a[0]) else 0.2))
        if b:
            options.append(brute(a, b[1:], memo) + (0.9 if plain(b[0]) else 0.2))
        if a and b:
            same = a[0].upper() == b[0].upper()
            change = 0 if same else 0.5 if a[0].isdecimal() and b[0].isdecimal() else 10
            options.append(brute(a[1:], b[1:], memo) + change)
        memo[a, b] = min(options)
    return memo[a, b]


def test_against_the_definition():
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abAB12 -é", k=rng.randrange(9))), "".join(rng.choices("abAB12 -É", k=rng.randrange(9)))) for _ in range(300)]
    found = edit_costs([a for a, _ in pairs], [b for _, b in pairs])
    assert found.tolist() == pytest.approx([brute(a, b) for a, b in pairs])


def test_pairs(spark):
    df = spark.createDataFrame([("a", "A"), (None, "x"), ("x1", "x2"), ("a", "")], "a string, b string")
    assert [r.cost for r in with_edit_cost(df, "a", "b", cells=1).collect()] == [0.0, None, 0.5, 10.0]
    assert with_edit_cost(df.limit(0), "a", "b").count() == 0
