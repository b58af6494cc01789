from __future__ import annotations

import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquetry.llm import names

SYLLABLES = st.lists(st.sampled_from(["ben", "gri", "bach", "lun", "ro", "dak", "ei", "nel", "y", "sch"]), min_size=1, max_size=5).map("".join)


@pytest.mark.parametrize("a,b", [("lunenelgrodak", "lunbenelgrodak"), ("bengrieribach", "bengrigribach")])
def test_one_letter_that_changes_two_sounds(spark, a, b):
    assert names.close_family(a, b) and not set(names.codes(a)) & set(names.codes(b))
    df = spark.createDataFrame([(a, None), (b, None), ("quist", None)], "typed string, confirmed string")
    family = {r.typed: r.family for r in names.families(df).collect()}
    assert family[a] == family[b] != family["quist"]


@settings(max_examples=400, deadline=None)
@given(token=SYLLABLES, seed=st.integers(0, 10**9))
def test_no_close_pair_escapes_the_blocks(token, seed):
    rnd, other = random.Random(seed), token
    for _ in range(2):
        i, c = rnd.randrange(len(other) + 1), rnd.choice(string.ascii_lowercase)
        other = rnd.choice([other[:i] + c + other[i:], other[:i] + other[i + 1 :], other[:i] + c + other[i + 1 :], other[:i] + other[i : i + 2][::-1] + other[i + 2 :]])
        if other and names.close_family(token, other):
            assert set(names.block_keys(token)) & set(names.block_keys(other))
