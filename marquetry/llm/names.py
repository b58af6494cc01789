"""Variant spellings of people's names, linked to the person they mean.

1. Every name is parsed: titles, remarks in brackets, accents and letter case go; a comma, the address, a nickname table and the
   number of different partners a token has tell the family name from the given name.
2. Family names are blocked by the phonetic codes of their tokens (and the codes with one sound left out) and by the tokens with
   one or two letters left out, which no close pair escapes, compared by Jaro-Winkler similarity and edit distance, and
   clustered by connected components. A spelling that the owner's own address
   confirms is never linked to another confirmed one; it is where unconfirmed ones may lead to.
3. Inside a family, given names are matched with the nickname table, as initials where only one person fits, and by
   Jaro-Winkler. Family and given name together are the person; relatives stay apart.

The address is a hint only: it is used where its letters are close to the name typed beside it, so shared, foreign, anonymous
and missing addresses do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.components import components
from marquetry.llm.copies import group_pairs
from marquetry.session import written

# Words before or behind a name that are no part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam herr frau jr sr ii iii phd msc bsc".split())
# Sounds of consonants; vowels, h and y have none.
SOUNDS = {c: s for s, cs in {"p": "pb", "f": "fvw", "k": "ckqx", "g": "gj", "s": "sz", "t": "td", "l": "l", "m": "m", "n": "n", "r": "r"}.items() for c in cs}
#: Least Jaro-Winkler similarity of family names two edits apart (one edit is enough alone from 7 letters on), and of given names.
CLOSE = 0.85
GIVEN_CLOSE = 0.78
#: Blocks of sounds with more tokens than this are not walked; the blocks of letters hold their close pairs.
HOT_SOUNDS = 1_000
#: So many different partners, and three times those of the other token, make a token a given name.
PARTNERS = 5


def plain(s: str) -> str:
    """Lower case without accents and bracketed remarks."""
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def phonetic(token: str) -> str:
    """Sounds of the consonants, repeats of a sound without another one between them written once."""
    out, last = [], ""
    for c in token:
        s = SOUNDS.get(c, "" if c in "aeiouyh" else c)
        if s and s != last:
            out.append(s)
        last = s or last
    return "".join(out)


def codes(token: str) -> list[str]:
    """The phonetic code and those with one sound left out."""
    p = phonetic(token)
    return sorted({p, *(p[:i] + p[i + 1 :] for i in range(len(p)))} - {""}) or [token[:1]]


def shortened(token: str) -> set[str]:
    """The token, and it with one letter left out; from 8 letters on with two as well.

    Two tokens that `close_family` accepts always share one: each edit, a transposition too, costs either side one letter at most.
    """
    out = {token}
    for _ in range(1 if len(token) < 8 else 2):
        out |= {t[:i] + t[i + 1 :] for t in out for i in range(len(t))}
    return out - {""}


def block_keys(token: str) -> list[int]:
    """Hashes of the phonetic codes and of the shortened tokens: the blocks of a family name."""
    keys = [f"/{c}" for c in codes(token)] + sorted(shortened(token))
    return [int.from_bytes(blake2b(k.encode(), digest_size=8).digest(), "big", signed=True) for k in keys]


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with transpositions of neighbours; most + 1 stands for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:  # an edit changes at most two of the letters that occur
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last2, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def close_family(a: str, b: str) -> bool:
    n, d = min(len(a), len(b)), edits(a, b, 2)
    return d == 0 or (d == 1 and n >= 7) or (d <= (1 if n < 8 else 2) and jaro_winkler(a, b) >= CLOSE)


def _from_address(email: str, tokens: list[str], initials: str) -> tuple[str | None, str | None]:
    """(family name, given name) that an address suggests, if close to a token of the name."""
    local = re.sub(r"\d+", "", plain(email).split("@")[0])
    parts = [p for p in re.split(r"[^a-z]+", local) if p]
    if not parts or max(map(len, parts)) < 4:
        return None, None
    fits = lambda f: [(edits(t, f, 3), t) for t in tokens if len(t) > 3 and len(f) > 3 and edits(t, f, 3) <= max(1, min(3, len(f) // 4))]
    if len(parts) > 1:  # given.family is the custom; the other way round only where that can't be
        for family, given in ((parts[-1], parts[0]), (parts[0], parts[-1])):
            if fits(family):
                return family, given
        return None, None
    first = {t[0] for t in [*tokens, *initials]}
    found = [(d - 0.5 * (cut_off and parts[0][0] in first - {t[0]}), cut_off, f) for f, cut_off in ((parts[0], False), (parts[0][1:], True)) for d, t in fits(f)]
    return (min(found)[2], None) if found else (None, None)


_PARSED = "id string, name string, first string, last string, comma boolean, initials string, family string, given string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first and last: the two tokens of more than one letter (last null where there is one); family, given: by the address."""
    for b in batches:
        rows = []
        for i, name, email in zip(*(c.to_pylist() for c in b.columns)):
            p = plain(name)
            head = p.split(",")[0] if "," in p else ""
            tokens = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", p)
            words = [t for t in tokens if len(t) > 1 and t not in TITLES]
            initials = "".join(t for t in tokens if len(t) == 1)
            if not words:
                words, initials = (tokens[:1], initials[1:]) if tokens else ([p.strip()], "")
            comma = bool(head) and any(t in head for t in words)
            family, given = _from_address(email or "", words, initials)
            # several family or given words: the outer ones carry the name
            first, last = words[0], words[-1] if len(words) > 1 else None
            rows.append((i, name, first, last, comma, initials, family, given))
        names = [c.split()[0] for c in _PARSED.split(", ")]
        types = [pa.string()] * 4 + [pa.bool_()] + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in zip(types, zip(*rows) if rows else [[]] * 8)], names=names)


def _roles(nick: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    known = set(nick) | set(nick.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_known = lru_cache(100_000)(lambda t: any(edits(t, k, 2) <= (1 if min(len(t), len(k)) < 7 else 2) for k in known))
        for b in batches:
            rows = []
            for i, name, first, last, comma, initials, family, given, n_first, n_last in zip(*(c.to_pylist() for c in b.columns)):
                if last is None:
                    f, g = first, None
                elif family:
                    f, g = (first, last) if edits(first, family, 3) < edits(last, family, 3) else (last, first)
                elif comma:
                    f, g = first, last
                elif (first in known) != (last in known):
                    f, g = (last, first) if first in known else (first, last)
                elif max(n_first, n_last) >= PARTNERS and max(n_first, n_last) >= 3 * min(n_first, n_last):
                    f, g = (last, first) if n_first > n_last else (first, last)
                elif near_known(first) != near_known(last):
                    f, g = (last, first) if near_known(first) else (first, last)
                elif abs(len(first) - len(last)) > 1:
                    f, g = (last, first) if len(first) < len(last) else (first, last)
                else:
                    f, g = last, first
                rows.append((i, name, f, family if family else None, g, initials, given))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 7)], names=["id", "name", "typed", "confirmed", "given", "initials", "address_given"])

    return run


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(x, y, jaro_winkler(x, y)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if close_family(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "s"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tokens their block keys: token, k, and whether it is a key of sounds."""
    for b in batches:
        tokens, keys, sounds = [], [], []
        for t in b.column(0).to_pylist():
            n, mine = len(codes(t)), block_keys(t)
            tokens += [t] * len(mine)
            keys += mine
            sounds += [True] * n + [False] * (len(mine) - n)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(keys, pa.int64()), pa.array(sounds, pa.bool_())], names=["token", "k", "sound"])


def blocks(tokens: DataFrame, hot: int = HOT_SOUNDS) -> DataFrame:
    """token, k: the blocks of different tokens (one column). A block of sounds that holds more than `hot` tokens is left out:
    sounds say little there, and every close pair has a block of shortened tokens, which by their letters can't be large."""
    keyed = tokens.select(F.col(tokens.columns[0]).alias("token")).mapInArrow(_keyed, "token string, k bigint, sound boolean")
    many = keyed.filter("sound").groupBy(F.col("k").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h", F.lit(True).alias("s"))
    return keyed.join(many, (F.col("k") == F.col("h")) & (F.col("sound") == F.col("s")), "left_anti").select("token", "k")


def families(spellings: DataFrame) -> DataFrame:
    """typed, family for (typed, confirmed): the cluster of each spelling of a family name.

    A confirmed spelling is its own cluster. One that its owners' addresses correct leads to what they say most often. The
    others are blocked and compared: they lead to the closest confirmed spelling, or, without any, form components.
    """
    s = spellings.groupBy("typed", "confirmed").agg(F.count("*").alias("n"))
    sure = s.filter("confirmed is not null").select(F.col("confirmed").alias("sure")).distinct()
    said = s.filter("confirmed is not null").groupBy("typed").agg(F.max_by("confirmed", F.struct("n", "confirmed")).alias("said"))
    typed = s.select("typed").distinct().join(sure, F.col("typed") == F.col("sure"), "left").join(said, "typed", "left")
    typed = written(typed.select("typed", F.coalesce("sure", "said").alias("known")))
    loose = typed.filter("known is null").select("typed")
    keyed = lambda df, c: blocks(df).toDF(c, f"k_{c}")
    to_sure = keyed(loose, "typed").join(keyed(sure, "sure"), F.col("k_typed") == F.col("k_sure")).select("typed", "sure").distinct()
    best = to_sure.mapInArrow(_close_pairs, "a string, b string, s double").groupBy("a").agg(F.max_by("b", F.struct("s", "b")).alias("best"))
    typed = written(typed.join(best, F.col("typed") == F.col("a"), "left").select("typed", F.coalesce("known", "best").alias("known")))
    rest = typed.filter("known is null").select("typed")
    one, two = keyed(rest, "typed"), keyed(rest.withColumnRenamed("typed", "other"), "other")
    edges = one.join(two, (F.col("k_typed") == F.col("k_other")) & (F.col("typed") < F.col("other"))).select("typed", "other").distinct().mapInArrow(_close_pairs, "a string, b string, s double")
    comp = components(rest.select(F.col("typed").alias("node")), edges)
    return typed.join(comp, F.col("typed") == F.col("node"), "left").select("typed", F.coalesce("known", "component").alias("family"))


_FORM = ["family", "given", "initials", "address_given"]


class Close:
    """Given names by their forms with up to two letters left out: the closest one to a token, without a walk over all."""

    def __init__(self, names: Iterator[str] | set[str] | dict[str, str] = ()) -> None:
        self.index: dict[str, set[str]] = {}
        for n in names:
            self.add(n)

    @staticmethod
    def forms(t: str) -> set[str]:
        out = {t}
        for _ in range(1 if len(t) < 5 else 2):
            out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
        return out

    def add(self, name: str) -> None:
        for f in self.forms(name):
            self.index.setdefault(f, set()).add(name)

    def nearest(self, t: str) -> str | None:
        """The name of highest similarity within one edit (two where both have five letters), the greatest of equal ones."""
        some = set().union(*(self.index[f] for f in self.forms(t) if f in self.index))
        s = [(jaro_winkler(t, o), o) for o in some if edits(t, o, 2) <= (1 if min(len(t), len(o)) < 5 else 2)]
        s = [x for x in s if x[0] >= GIVEN_CLOSE]
        return max(s)[1] if s else None


def _named(rows: list[dict], nick: dict[str, str], near_full: Callable, near_nick: Callable) -> None:
    """Sets `person` of a family's rows (given, initials, address_given, n; each combination once); None: nobody fits alone."""
    # 1. given names that are certain: by table, or said by the address beside a fitting name
    certain: set[str] = set()
    for r in rows:
        g, a = r["given"], r["address_given"]
        r["person"] = None
        if a and len(a) > 1 and ((g and (edits(g, a, 2) <= 2 or nick.get(g) == a or near_nick(g) == a)) or (not g and r["initials"][:1] == a[0])):
            r["person"] = a
        elif g:
            r["person"] = nick.get(g)
        if r["person"]:
            certain.add(r["person"])
    # 2. typed otherwise: close to one that is certain here, then to the table, else a name of its own (most used first)
    close, shorts = Close(certain), Close(k for k, v in nick.items() if v in certain)
    full_of: dict[str, list[str]] = {}
    for k, v in nick.items():
        full_of.setdefault(v, []).append(k)
    for r in sorted((r for r in rows if r["given"] and not r["person"]), key=lambda r: (-r["n"], r["given"])):
        g = r["given"]
        short = shorts.nearest(g)
        r["person"] = close.nearest(g) or (nick[short] if short else None) or near_full(g) or near_nick(g) or g
        if r["person"] not in certain:
            certain.add(r["person"])
            close.add(r["person"])
            for k in full_of.get(r["person"], ()):
                shorts.add(k)
    # 3. initials: the one person of the family they fit
    starting: dict[str, list[str]] = {}
    for p in sorted(certain):
        starting.setdefault(p[0], []).append(p)
    second: dict[str, set[str]] = {}
    for o in rows:
        if o["given"] and o["initials"]:
            second.setdefault(o["initials"][0], set()).add(o["person"])
    for r in rows:
        if not r["person"]:
            i = r["initials"][:1]
            fit = starting.get(i, []) if i else []
            if len(fit) > 1 and len(r["initials"]) > 1:
                by = [p for p in fit if p in second.get(r["initials"][1], ())]
                fit = by if len(by) == 1 else fit
            if len(fit) == 1:
                r["person"] = fit[0]
            elif i and not fit:
                r["person"] = f"{i}."
            elif not i and len(certain) <= 1:
                r["person"] = next(iter(certain), ".")


def _given_names(nick: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    full, short = Close(set(nick.values())), Close(nick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_full = lru_cache(100_000)(full.nearest)
        near_nick = lru_cache(100_000)(lambda t: nick.get(short.nearest(t)))

        def done(rows: list[dict]) -> pa.RecordBatch:
            _named(rows, nick, near_full, near_nick)
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in [*_FORM, "person"]], names=[*_FORM, "person"])

        held: list[dict] = []  # a family may go on in the next batch
        for b in batches:
            for r in b.to_pylist():
                if held and r["family"] != held[-1]["family"]:
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    return run


def people(entries: DataFrame, nicknames: DataFrame) -> DataFrame:
    """id, name, family, person of entries (id, name, email); person is null where nobody fits alone.

    Null ids, null names and names of white space only are left out; repeated rows of an id become one. nicknames (given_name,
    short_form) is a small fixed table. Extra columns are ignored.
    """
    nick = {plain(r.short_form).strip(): plain(r.given_name).strip() for r in nicknames.select("given_name", "short_form").na.drop().orderBy("short_form", "given_name").collect()}
    nick = {g: g for g in nick.values()} | nick
    e = entries.select("id", "name", "email").filter(F.col("id").isNotNull() & F.col("name").rlike(r"\S")).dropDuplicates(["id"])
    parsed = written(e.mapInArrow(_parse, _PARSED))
    # how many different partners a token has: given names have many, family names few
    both = parsed.filter("last is not null").select("first", "last").distinct()
    partners = both.unionByName(both.select(F.col("last").alias("first"), F.col("first").alias("last"))).distinct().groupBy("first").agg(F.count("*").alias("n"))
    forms = parsed.join(partners.select(F.col("first").alias("t1"), F.col("n").alias("n_first")), F.col("first") == F.col("t1"), "left").join(partners.select(F.col("first").alias("t2"), F.col("n").alias("n_last")), F.col("last") == F.col("t2"), "left")
    forms = forms.select("id", "name", "first", "last", "comma", "initials", "family", "given", F.coalesce("n_first", F.lit(0)), F.coalesce("n_last", F.lit(0)))
    roles = written(forms.mapInArrow(_roles(nick), "id string, name string, typed string, confirmed string, given string, initials string, address_given string"))
    fam = families(roles.select("typed", "confirmed"))
    known = written(roles.join(fam, "typed").select("id", "name", F.coalesce("confirmed", "family").alias("family"), "given", "initials", "address_given"))
    shapes = known.groupBy("family", "given", "initials", "address_given").agg(F.count("*").alias("n"))
    # sorted by family and streamed: a family's distinct forms are together, and the number of tasks is fixed, not by bytes
    parts = 4 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = shapes.repartition(parts, "family").sortWithinPartitions("family").mapInArrow(_given_names(nick), "family string, given string, initials string, address_given string, person string")
    same = lambda c: F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}"))
    return known.alias("k").join(named.alias("p"), (F.col("k.family") == F.col("p.family")) & same("given") & same("initials") & same("address_given")).select("k.id", "k.name", "k.family", "p.person")


def variant_pairs(entries: DataFrame, nicknames: DataFrame) -> DataFrame:
    """id_a, id_b: all pairs of entries that mean one person under names that are not equal strings."""
    p = written(people(entries, nicknames).filter("person is not null").select(F.concat_ws("|", "family", "person").alias("key"), "id", "name"))
    n = p.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("copies"), F.min("name").alias("low"), F.max("name").alias("high")).filter("low <> high")
    members = p.join(n, F.col("key") == F.col("k")).select("key", "id", "copies", "name")
    return group_pairs(members, differ="name")
