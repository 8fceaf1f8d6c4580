import random

from hypothesis import given, settings
from hypothesis import strategies as st

from wherry.llm import differencing
from wherry.llm.leakage import lcs_length


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", ""]), max_size=14), st.lists(st.sampled_from(["a", "b", "c", "d", ""]), max_size=14))
def test_alignment_is_a_longest_one(a, b):
    found = differencing.aligned(a, b)
    lines = [a[k] for k in found]
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in lines) and "" not in lines
    assert len(found) == lcs_length([x for x in a if x], [x for x in b if x])


def test_long_pages():
    lines = [f"line {k}" for k in range(20_000)]
    assert len(differencing.aligned(lines, ["x", *lines[:10_000], "y", *lines[10_000:]])) == 20_000
    assert differencing.aligned([], ["a"]) == [] == differencing.aligned(["", ""], ["", ""])


def test_neighbours(spark):
    rng = random.Random(2)
    pages = [(k, "h", f"/a/{k // 10}/{k % 10}", f"menu\n text {k} \nfooter") for k in range(40)] + [(50, "alone", "/", "menu\nx"), (51, None, "/", "x"), (52, "h", None, "x"), (53, "h", "/z", None), (54, "i", "/", ""), (55, "i", "/", "")]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, host string, path string, text string").selectExpr("*", "1 as neighbour_id")
    got = {r["page_id"]: r for r in differencing.differenced(df).collect()}
    assert set(got) == {*range(40), 50, 54, 55}
    assert all(got[k]["text"] == f" text {k} " and abs(got[k]["neighbour_id"] - k) == 1 and got[k]["n_shared"] == 2 for k in range(40))
    assert got[50]["text"] == "menu\nx" and got[50]["neighbour_id"] is None and got[54]["n_shared"] == 0
    assert differencing.differenced(df.limit(0)).collect() == []
