"""Product links by number: against brute force, and what they send through the shuffle."""

import itertools
import random

import pytest

from tidemark.operators import catalogue
from tests.test_meetings import shuffled


@pytest.mark.parametrize("block, tasks", [(10_000, 20_000_000), (7, 500)])
def test_links_of_a_number_are_not_shuffled(spark, monkeypatch, block, tasks):
    """all links, each once, also of products with several numbers; the records sent grow with the products."""
    monkeypatch.setattr(catalogue, "BLOCK", block)
    monkeypatch.setattr(catalogue, "LINKS_A_TASK", tasks)
    r = random.Random(6)
    numbers = [(i, f" Number-{i % 4} ") for i in range(400)] + [(i, f"second-{i % 3}") for i in range(0, 100, 2)] + [(5, "number-1"), (7, None), (8, "n/a"), (9, "abc")]
    some = [(r.randrange(400), r.randrange(450)) for _ in range(120)] + [(3, 3)]
    has = {}
    for i, k in numbers:
        if k and len(k.strip()) >= 4:
            has.setdefault(k.strip().lower(), set()).add(i)
    expected = {p: 0 for s in has.values() for p in itertools.permutations(s, 2)} | {p: 1 for a, b in some if a != b for p in ((a, b), (b, a))}
    df = catalogue.links(spark.createDataFrame(some, "product_id long, other_id long"), spark.createDataFrame(numbers, "product_id long, number string"))
    got, records = shuffled(spark, df.collect)
    assert {(x.product_id, x.other_id): x.curated for x in got} == expected and len(got) == len(expected) > 35_000
    assert records < (6_000 if block == 10_000 else 35_000)
