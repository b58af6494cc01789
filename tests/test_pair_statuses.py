from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from marquetry.operators import similarity


def test_pair_statuses_from_exact_means(spark):
    rnd = random.Random(3)
    rows = [("edge", "m1", 40.95), ("edge", "m2", 40.04), ("low", "m1", 0.0), ("low", "m2", 80.9999), ("even", "m1", 40.5), ("even", "m2", 40.5), ("even", "m3", 70.5), ("even", "m4", 70.5), ("one", "m1", 90.0)]
    rows += [("any", f"a{i}", rnd.choice([rnd.randint(0, 1_000_000), rnd.randint(404_000, 406_000), rnd.randint(704_000, 706_000), 405_000, 705_000]) / 10_000) for i in range(300)]
    want: Counter = Counter()
    for (g, _, a), (h, _, b) in combinations(rows, 2):
        if g == h:
            total = round(a * 10_000) + round(b * 10_000)  # the score is half of it, rounded half up
            want[g, "high" if total >= 1_410_000 else "medium" if total >= 810_000 else "low"] += 1
    got = similarity.pair_status_counts(spark.createDataFrame(rows, "grp string, member string, mean_value double"))
    assert {(r.grp, r.status): r.pairs for r in got.collect()} == want
    assert want["edge", "low"] == 1
