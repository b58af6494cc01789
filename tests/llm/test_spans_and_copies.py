from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from marquetry.llm import copies, history, near_duplicates, shared_spans

SCHEMA = "id string, kind string, text string, extra int"
WORD = re.compile(r"[^\W_]+")


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1) for r in rows], schema)


def texts(seed=1, n=30):
    """Texts that share stretches: inside a record, between records, at the very ends, twice, with hot boilerplate."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    body = lambda k: " ".join(word() for _ in range(k))
    blocks = [body(30) + "\r\nü😀\n" for _ in range(6)]
    header = body(60)
    out = {}
    for i in range(n):
        parts = [body(r.randint(0, 40)) for _ in range(3)] + [r.choice(blocks)[r.randint(0, 40) :] for _ in range(r.randint(0, 3))]
        if i % 3 == 0:
            parts.append(header)
        r.shuffle(parts)
        out[f"r{i:03}"] = "|".join(parts)
    out["copy"] = out["r001"]
    out["selfonly"] = (body(45) + "#") * 2
    out["periodic1"], out["periodic2"] = "ab" * 400, "ba" * 300
    return out


def brute_spans(rows, length):
    where = {}
    for i, t in rows.items():
        for j in range(len(t) - length + 1):
            where.setdefault(t[j : j + length], set()).add(i)
    out = set()
    for i, t in rows.items():
        end = start = None
        for j in range(len(t) - length + 1):
            if len(where[t[j : j + length]]) > 1:
                if start is not None and j <= end:
                    end = j + length
                else:
                    if start is not None:
                        out.add((i, start, end - start))
                    start, end = j, j + length
        if start is not None:
            out.add((i, start, end - start))
    return out


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 60, 24, 20_000), (2, 60, 24, 2), (3, 200, 96, 3), (4, 20, 20, 1), (5, 20, 1, 20_000)])
def test_spans_equal_brute_force(spark, seed, length, gram, hot):
    rows = texts(seed)
    given = [(i, "a", t) for i, t in rows.items()] + [("copy", "a", rows["copy"]), ("n", "a", None), ("e", "a", ""), ("b", "a", "   \n"), (None, "a", rows["copy"])]
    got = [tuple(r) for r in shared_spans.shared_spans(table(spark, given), 40, length, gram, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, length)


def test_spans_of_nothing(spark):
    assert shared_spans.shared_spans(table(spark, []), 0).collect() == []
    df = table(spark, [("a", "a", "x" * 500), ("b", "a", "y" * 500)])
    assert shared_spans.shared_spans(df, 2).collect() == []
    part = {r.record_id: (r.shared_chars, r.shared_percent) for r in shared_spans.shared_part(shared_spans.shared_spans(table(spark, [("a", "a", "x" * 500), ("b", "a", "x" * 250)]), 2), df).collect()}
    assert part == {"a": (500, 100.0), "b": (250, 50.0)}


def test_very_long_text_goes_in_slices(spark, monkeypatch):
    t = "".join(random.Random(3).choice("abcdef") for _ in range(6000))
    whole = {(i, s, n) for i, s, n in brute_spans({"a": t, "b": t[100:5000]}, 200)}
    old = shared_spans._chunks
    monkeypatch.setattr(shared_spans, "_chunks", lambda x, length, gram: old(x, length, gram, 700))
    import pyarrow as pa

    pack = pa.table({"pack": [0, 0], "id": ["a", "b"], "text": [t, t[100:5000]]})
    sent = shared_spans._send_anchors(1, 200, 96)(pack)
    batch = sent.select(["bucket", "pack", "payload"]).to_batches()[0]
    verdicts = pa.Table.from_batches(list(shared_spans._decide(10**6)(iter([batch]))))
    marked = shared_spans._mark(1, 200, 96)((0,), pack, verdicts)
    runs = pa.Table.from_batches(list(shared_spans._compare(200)(iter(marked.to_batches()))))
    got = shared_spans._stretches(runs).to_pylist()
    assert {(r["record_id"], r["span_start"], r["span_chars"]) for r in got} == whole


FIELDS = ["title: Do It\nowner: me 2\npoints: 3", '{"points": 3, "owner": "me 2", "title": "do it"}', "OWNER = me 2; Title=do-it; points=3;", "- Points : 3.\r\n- Title : do it.\r\n- Owner : Me 2", "[title]\tdo it\n\n[points]\t3\n\n[owner]\tme 2\n", "<title>do it</title>\n<owner>me 2</owner>\n<points>3</points>"]


def test_copies_equal_brute_force(spark):
    rows = [(f"f{i}", "text", t) for i, t in enumerate(FIELDS)] + [("f9", "text", "title: do it\nowner: me 3\npoints: 3"), ("code", "python", FIELDS[0])]
    rows += [("a", "java", "int  X=1;"), ("b", "a", "INT x = 1"), ("c", "a", "x int = 1"), ("p", "a", "!!"), ("q", "a", "--- ;"), ("n", "a", None), ("e", "a", " \n"), (None, "a", "int x 1"), ("a", "java", "int  X=1;")]
    got = sorted(tuple(r) for r in copies.same_text_pairs(table(spark, rows), entries=2).collect())
    want = set(itertools.combinations([f"f{i}" for i in range(6)], 2)) | {("a", "b"), ("p", "q"), ("code", "f0")}
    assert got == sorted(want)
    done = {r.record_id: r.copies for r in copies.collapsed(table(spark, rows), entries=2).collect()}
    assert done == {"code": 7, "f9": 1, "a": 2, "c": 1, "p": 2}
    assert copies.same_text_pairs(table(spark, [])).collect() == [] and copies.collapsed(table(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_components_of_the_pairs(spark, seed):
    r = random.Random(seed)
    rows = [("x1", "text", "a: 1\nb: 2"), ("x2", "a", "a 1 b 2"), ("x3", "text", "a 1, b 2"), ("x4", "text", "b = 2\na = 1")]
    for i in range(60):
        fields = [f"{k}: {r.randint(1, 2)}" for k in ("key", "owner", "points")[: r.randint(2, 3)]]
        r.shuffle(fields)
        rows.append((f"r{i:02}", r.choice(["text", "text", "a"]), r.choice(["\n", "; "]).join(fields)))
    df = table(spark, rows)
    root = {i: i for i, _, _ in rows}
    pairs = [tuple(p) for p in copies.same_text_pairs(df).collect()]
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: list(root.values()).count(k) for k in root.values()}
    assert {x.record_id: x.copies for x in copies.collapsed(df, entries=3).collect()} == want and want["x1"] == 4


def test_radix_splits_until_it_fits(spark):
    keys = spark.createDataFrame([(f"i{i}", bytearray(b"sAAA" + bytes([i % 7]) + b"x" * 12)) for i in range(70)] + [(f"h{i}", bytearray(b"sB" + b"y" * 15)) for i in range(50)], "id string, key binary")
    levels = copies.radix_levels(keys, 20)
    buckets = {bytes(x.p): x.n for level in levels for x in level.collect() if not x.split}
    got = copies.with_buckets(keys, levels).groupBy("bucket").count().collect()
    assert {bytes(x.bucket): x["count"] for x in got} == buckets
    assert buckets[b"sB"] == 50 and all(n <= 20 or p == b"sB" for p, n in buckets.items()) and sum(buckets.values()) == 120
    assert sorted(r.copies for r in copies.count_keys(keys, 20).collect()) == [10] * 7 + [50]


def test_trie_counts():
    t, r = copies.Trie(), random.Random(2)
    keys = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))).encode() for _ in range(400)]
    for i, k in enumerate(keys):
        t.add(k, 1, f"{i:03}")
    assert {(k, n, i) for k, n, i in t.items()} == {(k, keys.count(k), f"{keys.index(k):03}") for k in set(keys)}


def test_group_pairs_salted(spark):
    m = spark.createDataFrame([(bytearray(b"k"), f"{i:02}", 25) for i in range(25)], "key binary, id string, copies bigint")
    got = sorted(tuple(r) for r in copies.group_pairs(m, block=4).collect())
    assert got == sorted(itertools.combinations([f"{i:02}" for i in range(25)], 2))


def near_rows(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for c in range(12):
        base = [r.choice(words) for _ in range(r.randint(5, 90))]
        for k in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 8))):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 2)] = [r.choice(words)] * r.randint(0, 2)
            out.append((f"c{c}_{k}", "a", " ".join(t)))
    out += [("s1", "a", "one two"), ("s2", "a", "One, two!"), ("s3", "a", "two one"), ("dup", "a", out[0][2].upper()), ("dup", "a", out[0][2].upper()), ("n", "a", None), ("e", "a", ""), (None, "a", out[0][2]), ("perm", "a", "a b c a b c a b"), ("perm2", "a", "b c a b c a b c")]
    return out


def brute_near(rows, threshold):
    w = {i: WORD.findall(t.casefold()) for i, _, t in rows if i and t and t.strip()}
    s = {i: set(zip(x, x[1:], x[2:])) for i, x in w.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(w), 2) if w[a] == w[b] or (s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold)}


@pytest.mark.parametrize("seed,threshold", [(1, 0.6), (2, 0.8), (3, 0.3)])
def test_near_pairs_equal_brute_force(spark, seed, threshold):
    rows = near_rows(seed)
    got = [tuple(r) for r in near_duplicates.near_pairs(table(spark, rows), 60, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows, threshold)


@pytest.mark.parametrize("hot,block", [(1, 1), (3, 2)])
def test_hot_triples_and_many_copies_are_split_alike(spark, hot, block):
    rows = near_rows(5)
    rows += [(f"k{i}_{c}", "a", " ".join(["h1 h2 h3 h4", *(f"x{j}" for j in range(20)), f"own{i}"])) for i in range(9) for c in range(1 + i % 4)]
    got = [tuple(r) for r in near_duplicates.near_pairs(table(spark, rows), 60, 0.6, block, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows, 0.6)


def test_gaps_round_trip():
    r = random.Random(1)
    for n, top in ((0, 10), (1, 2**32 - 1), (5, 2**32 - 1), (5000, 2**32 - 1), (300, 300)):
        v = np.array(sorted(r.randint(0, top) for _ in range(n)), np.uint32)
        data = near_duplicates.gaps(v)
        back, used = near_duplicates.from_gaps(data + b"tail", n)
        assert (back == v).all() and used == len(data)


def test_near_groups(spark):
    rows = near_rows(2)
    pairs = brute_near(rows, 0.6)
    ids = sorted({i for i, _, t in rows if i and t and t.strip()})
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.record_id: r for r in near_duplicates.near_groups(table(spark, rows), 60).collect()}
    assert {i: r.group_id for i, r in got.items()} == root
    assert got["s1"].copies == got["s2"].copies == 2 and got["s3"].copies == 1 and got["dup"].copies == 2
    assert near_duplicates.near_groups(table(spark, []), 0).collect() == []


def test_near_pairs_of_nothing(spark):
    assert near_duplicates.near_pairs(table(spark, []), 0).collect() == []


@pytest.mark.parametrize("fixed_after", [10**9, 20, 1])
def test_batches_against_history(spark, tmp_path, monkeypatch, fixed_after):
    monkeypatch.setattr(history, "ORDER_SETS", fixed_after)
    rows = near_rows(4)
    r = random.Random(1)
    months = ["2024-01-05", "2024-02-05", "2024-02-25", "2024-03-01", None]
    dated = [(i, "text" if i and i.startswith("c3") else "a", t, f"{months[sum(map(ord, i or ''))% 5]} 10:00:00" if months[sum(map(ord, i or '')) % 5] else None) for i, _, t in rows]
    dated += [("f1", "text", FIELDS[0], "2024-01-09 00:00:00"), ("f2", "text", FIELDS[2], "2024-03-09 00:00:00")]
    dated.append(("f1", "text", FIELDS[0], "2024-02-09 00:00:00"))  # delivered again in another month: counts in the first only
    r.shuffle(dated)
    df = spark.createDataFrame(dated, "id string, kind string, text string, at string").selectExpr("id", "kind", "text", "cast(at as timestamp_ntz) as created_at")
    bulk = {x.file_id for x in history.seen_before(df).collect()}
    dated.remove(("f1", "text", FIELDS[0], "2024-02-09 00:00:00"))
    df = df.filter("not (id = 'f1' and month(created_at) = 2)")
    month = {i: (at or "")[:7] for i, _, _, at in dated if i and at}
    code = [(i, k, t) for i, k, t, at in dated if k != "text" and at]
    pairs = brute_near(code, 0.6) | {("f1", "f2")} | {(min(a, b), max(a, b)) for (a, k, t, x), (b, l, u, y) in itertools.combinations(dated, 2) if a and b and a != b and x and y and t and u and t.strip() and u.strip() and WORD.findall(t.casefold()) == WORD.findall(u.casefold())}
    want = {max(p, key=lambda i: month[i]) for p in pairs if month[p[0]] != month[p[1]]}
    assert bulk == want
    h, found = history.History(spark, str(tmp_path / "h")), set()
    for m in sorted(set(month.values())):
        batch = df.filter(f"date_format(created_at, 'yyyy-MM') = '{m}'")
        found |= {x.id for x in h.check(batch).collect()}
        h.accept(batch)
    assert found == want


def test_a_set_of_many_packs_is_stored_and_indexed_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"i{k}", "a", text) for k in range(40)] + [("n", "a", f"{text} more")]
    j = near_duplicates.SetJoin(table(spark, rows), 60)
    index = spark.read.parquet(*{f.rpartition("/kind=")[0] for f in j.sets.inputFiles()})
    assert index.filter("kind = 1").count() == 2 and j.members.count() == 41
    assert j.links.count() == 1


def test_candidates_are_verified_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ROUND_SETS", 0.3)
    rows = near_rows(6)
    got = [tuple(r) for r in near_duplicates.near_pairs(table(spark, rows), 60).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows, 0.6)


def test_a_month_of_the_replay_appends_no_keys(spark, tmp_path, monkeypatch):
    appended, append = [], history.History._append
    monkeypatch.setattr(history.History, "_append", lambda self, df, table, *n: (appended.append(table), append(self, df, table, *n))[1])
    rows = [("a1", "a", "x y z w", "2024-01-05"), ("b1", "a", "p q r s", "2024-02-05"), ("c1", "a", "X, y; z w", "2024-03-05")]
    df = spark.createDataFrame(rows, "id string, kind string, text string, at string").selectExpr("id", "kind", "text", "cast(at as timestamp_ntz) as created_at")
    assert [x.file_id for x in history.seen_before(df, path=str(tmp_path / "h")).collect()] == ["c1"]
    assert appended.count("keys") == 1 and spark.read.parquet(str(tmp_path / "h" / "keys")).count() == 2
