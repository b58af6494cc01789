"""Long exact spans shared between records.

A character is marked where it lies in a window of `length` characters whose content also stands in another record. All
windows of all texts are decided exactly, without an index of all positions:

1. Winnowing. Each window names as its anchor the k-gram of least hash inside it. Equal windows have equal anchors, and the
   windows of one anchor are neighbours, so a text of n characters has about 2n/(length-k) anchors. Only anchors travel,
   one entry for each anchor hash of a pack (its regions' and records' hashes, or their ranges where there are several), in packed
   blocks; a region is the text that an anchor's windows cover.
2. Per anchor hash: seen in one record only - its windows match nothing. All regions equal - all its windows are shared.
   Else undecided. The verdict goes back to the packs that asked.
3. Packs recompute their anchors, mark what is decided, and send the text of undecided regions to the anchor's bucket, where
   the hashes of all windows in them are compared. An anchor that many records hold with different surroundings (a common
   header) sends single window hashes instead, keyed by themselves and combined per pack, so no task gets its whole group.
4. Marked windows are merged into maximal stretches per record.

A broadcast suffix automaton of reference shards gives the same spans; see the README for why it is not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.kernels import CHUNK_CHARS, Rolling, U, code_points, id_hash, merge_intervals, text_chunks, window_minima
from marquetry.llm.records import packed, rows_of

LENGTH = 200
GRAM = 96
#: An anchor hash with more entries than this (after combining per pack) is hot and takes the window path.
HOT_REGIONS = 20_000
_I = np.int64


class _Anchors:
    """Anchors of a chunk of texts: text, first and last window, anchor hash, region hash."""

    def __init__(self, texts: list[str], length: int, gram: int) -> None:
        c, off = code_points(texts)
        self.roll, self.off, self.length = Rolling(c), off, length
        if len(c) < length:
            self.doc = self.first = self.last = np.zeros(0, _I)
            self.hash = self.region = np.zeros(0, U)
            return
        m = window_minima(self.roll.grams(gram), length - gram + 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(off))[: len(m)]
        whole = np.arange(len(m)) + length <= off[doc + 1]
        same = (m[1:] == m[:-1]) & (doc[1:] == doc[:-1]) & whole[1:] & whole[:-1]
        self.first = np.flatnonzero(whole & np.concatenate([[True], ~same]))
        self.last = np.flatnonzero(whole & np.concatenate([~same, [True]]))
        self.doc, self.hash = doc[self.first], m[self.first]
        self.region = self.roll.ranges(self.first, self.last + length)


def _chunks(texts: list[str], length: int, gram: int, slice_chars: int = 4 * CHUNK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], _Anchors]]:
    """Anchors chunk by chunk with the text number and offset of each piece; very long texts go in slices that overlap by a window."""
    pieces, number, offset = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), slice_chars):
            pieces.append(t[at : at + slice_chars + length - 1])
            number.append(i)
            offset.append(at)
    number, offset = np.array(number, _I), np.array(offset, _I)
    for a, b in text_chunks(pieces):
        yield number[a:b], offset[a:b], pieces[a:b], _Anchors(pieces[a:b], length, gram)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(40)) % U(buckets)).astype(np.int32)


def _split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the entries of each bucket that has any."""
    b = _bucket(keys, buckets)
    order = np.argsort(b, kind="stable")
    b = b[order]
    start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, _I)
    for a, z in zip(start, [*start[1:], len(b)]):
        yield int(b[a]), order[a:z]


def _once(table: pa.Table) -> tuple[list[str], list[str], np.ndarray]:
    """ids, texts and id hashes of a pack's records, repeated rows left out."""
    ids, texts = rows_of(table)
    return ids, texts, id_hash(ids)


def _combined(*keys: np.ndarray) -> np.ndarray:
    """Per distinct (all keys but the last) the entries with the least and the greatest last key, as sorted positions."""
    o = np.lexsort(keys[::-1])
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys[:-1]:
        new[1:] |= k[o][1:] != k[o][:-1]
    last = np.concatenate([new[1:], [True]])
    return o[new | last]


def _send_anchors(buckets: int, length: int, gram: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        pack = table.column("pack")[0].as_py()
        _, texts, d = _once(table)
        h, r, who = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, U)]
        for number, _, _, a in _chunks(texts, length, gram):
            h.append(a.hash), r.append(a.region), who.append(d[number[a.doc]])
        h, r, who = map(np.concatenate, (h, r, who))
        keep = _combined(h, r, who)
        out = [(b, x) for b, x in _summaries(h[keep], r[keep], who[keep], buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "pack": pa.array([pack] * len(out), pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})

    return run


def _summaries(h: np.ndarray, r: np.ndarray, who: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket what a pack says of its anchors (h sorted): of those in one place only hash, region and record; of the others
    the range of regions and of records and the number of entries. However many regions a pack has for an anchor, it sends one entry."""
    if not len(h):
        return
    _, first, last = _groups(h)
    n = last - first + 1
    low_r, high_r = np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)
    low_d, high_d = np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)
    h = h[first]
    for b, x in _split(h, buckets):
        one, more = x[n[x] == 1], x[n[x] > 1]
        yield b, len(one).to_bytes(8, "little") + np.stack([h[one], low_r[one], low_d[one]]).tobytes() + np.stack([h[more], low_r[more], high_r[more], low_d[more], high_d[more], n[more].astype(U)]).tobytes()


def _read_summaries(data: bytes) -> np.ndarray:
    """Rows: hash, least and greatest region, least and greatest record, entries."""
    k = int.from_bytes(data[:8], "little")
    one, more = np.frombuffer(data, U, 3 * k, 8).reshape(3, k), np.frombuffer(data, U, offset=8 + 24 * k).reshape(6, -1)
    return np.concatenate([np.stack([one[0], one[1], one[1], one[2], one[2], np.ones(k, U)]), more], 1)


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted h: group of each entry, first and last entry of each group."""
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, first, np.concatenate([first[1:] - 1, [len(h) - 1]])


def _decide(hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per anchor hash: 1 shared with all its windows, 2 undecided, 3 undecided and hot; hashes of one record are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, packs = [], []
        for b in batches:
            for pack, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts.append(_read_summaries(payload))
                packs.append(np.full(parts[-1].shape[1], pack, np.int32))
        if not parts:
            return
        rows, pack = np.concatenate(parts, 1), np.concatenate(packs)
        del parts
        o = np.argsort(rows[0], kind="stable")
        (h, low_r, high_r, low_d, high_d, n), pack = rows[:, o], pack[o]
        group, first, last = _groups(h)
        spread = np.maximum.reduceat(high_d, first) != np.minimum.reduceat(low_d, first)
        alike = np.maximum.reduceat(high_r, first) == np.minimum.reduceat(low_r, first)
        verdict = np.where(spread, np.where(alike, 1, np.where(np.add.reduceat(n, first) > hot, 3, 2)), 0).astype(np.uint8)[group]
        keep = verdict > 0
        h, pack, verdict = h[keep], pack[keep], verdict[keep]
        o = np.lexsort((h, pack))
        h, pack, verdict = h[o], pack[o], verdict[o]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (pack[1:] != pack[:-1])
        h, pack, verdict = h[once], pack[once], verdict[once]
        if not len(h):
            return
        _, first, last = _groups(pack)
        rows = [(int(pack[a]), h[a : z + 1].tobytes() + verdict[a : z + 1].tobytes()) for a, z in zip(first, last)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["pack", "payload"])

    return run


_OUT = "kind int, bucket int, id string, at bigint, payload binary"
_NAMES = ["kind", "bucket", "id", "at", "payload"]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, t, c in zip(_NAMES, _TYPES, zip(*rows) if rows else [[]] * 5)})


def _runs(start: np.ndarray, end: np.ndarray) -> bytes:
    s, e = merge_intervals(start.astype(_I), end.astype(_I))
    return np.stack([s, e]).tobytes()


def _mark(buckets: int, length: int, gram: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Rows of kind 0: decided intervals of a record; 1: an undecided region's text; 2: window hashes of hot anchors.

    A region or window that several records of the pack share is proven here and marked for all of them; one copy of it is
    still sent, for the records of other packs.
    """

    def run(_key: tuple, table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not verdicts.num_rows or not table.num_rows:
            return _rows([])
        hs, vs = [], []
        for p in verdicts.column("payload").to_pylist():
            n = len(p) // 9
            hs.append(np.frombuffer(p, U, n))
            vs.append(np.frombuffer(p, np.uint8, n, 8 * n))
        known, verdict = np.concatenate(hs), np.concatenate(vs)
        o = np.argsort(known)
        known, verdict = known[o], verdict[o]
        pack = table.column("pack")[0].as_py()
        ids, texts, d = _once(table)
        marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_h, open_r, open_doc, open_at, open_text = [], [], [], [], []
        win_h, win_doc, win_at = [np.zeros(0, U)], [np.zeros(0, _I)], [np.zeros(0, _I)]
        for number, offset, pieces, a in _chunks(texts, length, gram):
            at = np.minimum(np.searchsorted(known, a.hash), len(known) - 1)
            v = np.where(known[at] == a.hash, verdict[at], 0)
            doc, shift = number[a.doc], offset[a.doc] - a.off[a.doc]
            first, end = a.first + shift, a.last + shift + length
            yes = v == 1
            marks.append((doc[yes], first[yes], end[yes]))
            for i in np.flatnonzero(v == 2):
                open_h.append(a.hash[i]), open_r.append(a.region[i]), open_doc.append(doc[i]), open_at.append(first[i])
                piece, low = pieces[a.doc[i]], a.off[a.doc[i]]
                open_text.append(piece[a.first[i] - low : a.last[i] - low + length])
            hot = np.flatnonzero(v == 3)
            if len(hot):
                n = a.last[hot] - a.first[hot] + 1
                each = np.repeat(hot, n)
                start = a.first[each] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                win_h.append(a.roll.ranges(start, start + length)), win_doc.append(doc[each]), win_at.append(start + shift[each])
        rows: list[tuple] = []
        if open_h:
            h, r, doc, at = np.array(open_h, U), np.array(open_r, U), np.array(open_doc, _I), np.array(open_at, _I)
            o = np.lexsort((d[doc], r, h))
            new = np.ones(len(o), bool)
            new[1:] = (h[o][1:] != h[o][:-1]) | (r[o][1:] != r[o][:-1])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:] - 1, [len(o) - 1]])
            local = (doc[o[first]] != doc[o[last]])[group]
            size = np.array([len(open_text[i]) for i in o], _I)
            marks.append((doc[o[local]], at[o[local]], at[o[local]] + size[local]))
            b = _bucket(h, buckets)
            # repeats of a region inside one record need an answer each; of a region proven here one copy is enough
            for i in o[new | ~local]:
                rows.append((1, int(b[i]), ids[doc[i]], int(at[i]), open_text[i].encode("utf-8", "surrogatepass")))
        h, doc, at = np.concatenate(win_h), np.concatenate(win_doc), np.concatenate(win_at)
        if len(h):
            o = np.lexsort((doc, h))
            h, doc, at = h[o], doc[o], at[o]
            group, first, last = _groups(h)
            local = (doc[first] != doc[last])[group]
            marks.append((doc[local], at[local], at[local] + length))
            new = np.zeros(len(h), bool)
            new[first] = True
            send = new | ~local
            h, doc, at = h[send], doc[send], at[send]
            for b, x in _split(h, buckets):
                names, code = np.unique(doc[x], return_inverse=True)
                head = "\n".join(ids[i] for i in names).encode()
                rows.append((2, b, None, len(head), head + np.stack([h[x], code.astype(U), at[x].astype(U), d[doc[x]]]).tobytes()))
        doc, start, end = (np.concatenate(x) for x in zip(*marks))
        o = np.argsort(doc, kind="stable")
        doc, start, end = doc[o], start[o], end[o]
        if len(doc):
            _, first, last = _groups(doc)
            rows += [(0, pack % buckets, ids[doc[a]], None, _runs(start[a : z + 1], end[a : z + 1])) for a, z in zip(first, last)]
        return _rows(rows)

    return run


def _compare(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In a bucket: windows of the undecided regions (and single hot windows) that stand in two or more records, as intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, who, at = [np.zeros(0, U)], [np.zeros(0, _I)], [np.zeros(0, _I)]

        def regions(owner: list[int], starts: list[int], texts: list[str]) -> None:
            c, off = code_points(texts)
            n = np.maximum(np.diff(off) - length + 1, 0)
            each = np.repeat(np.arange(len(texts)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = off[each] + inside
            h.append(Rolling(c).ranges(begin, begin + length))
            who.append(np.array(owner, _I)[each])
            at.append(np.array(starts, _I)[each] + inside)

        number: dict[str, int] = {}
        owner, starts, texts, size = [], [], [], 0
        for b in batches:
            done = b.filter(pc.equal(b.column(0), 0))
            if done.num_rows:
                yield done
            kinds, _, ids, ats, payloads = (x.to_pylist() for x in b.filter(pc.greater(b.column(0), 0)).columns)
            for kind, i, begin, payload in zip(kinds, ids, ats, payloads):
                if kind == 1:
                    owner.append(number.setdefault(i, len(number))), starts.append(begin), texts.append(payload.decode("utf-8", "surrogatepass"))
                    size += len(payload)
                    if size > CHUNK_CHARS:
                        regions(owner, starts, texts)
                        owner, starts, texts, size = [], [], [], 0
                else:
                    own = np.array([number.setdefault(x, len(number)) for x in payload[:begin].decode().split("\n")], _I)
                    hh, code, aa, _ = np.frombuffer(payload, U, offset=begin).reshape(4, -1)
                    h.append(hh), who.append(own[code.astype(_I)]), at.append(aa.astype(_I))
        if texts:
            regions(owner, starts, texts)
        names = list(number)
        h, who, at = np.concatenate(h), np.concatenate(who), np.concatenate(at)
        if not len(h):
            return
        o = np.argsort(h, kind="stable")
        h, who, at = h[o], who[o], at[o]
        group, first, _ = _groups(h)
        both = (np.maximum.reduceat(who, first) != np.minimum.reduceat(who, first))[group]
        who, at = who[both], at[both]
        if not len(who):
            return
        o = np.argsort(who, kind="stable")
        who, at = who[o], at[o]
        _, first, last = _groups(who)
        rows = [(0, None, names[who[a]], None, _runs(at[a : z + 1], at[a : z + 1] + length)) for a, z in zip(first, last)]
        yield from _rows(rows).to_batches()

    return run


def _stretches(table: pa.Table) -> pa.Table:
    ids, start, size = [], [], []
    by: dict[str, list[np.ndarray]] = {}
    for i, p in zip(table.column("id").to_pylist(), table.column("payload").to_pylist()):
        by.setdefault(i, []).append(np.frombuffer(p, _I).reshape(2, -1))
    for i, runs in by.items():
        s, e = merge_intervals(*np.concatenate(runs, 1))
        ids += [i] * len(s)
        start.append(s), size.append(e - s)
    z = np.zeros(0, _I)
    return pa.table({"record_id": pa.array(ids, pa.string()), "span_start": pa.array(np.concatenate([z, *start])), "span_chars": pa.array(np.concatenate([z, *size]))})


def shared_spans(df: DataFrame, rows: int, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_REGIONS) -> DataFrame:
    """Maximal stretches of characters in runs of `length` or more that stand verbatim in another record.

    df: id, text; rows: about its number of rows (for sizing only). Result: record_id, span_start (from 0), span_chars, in code
    points. Rows of equal id are one record (should their texts differ, the greatest counts), null ids and blank texts are ignored, texts shorter than `length` match nothing;
    what repeats only inside a record is no case; an empty table gives no rows. Extra columns are ignored.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    texts, packs, parts = packed(df.select("id", "text").filter("id is not null and text is not null"), rows)
    buckets = max(parts, packs // 4)
    anchors = texts.groupBy("pack").applyInArrow(_send_anchors(buckets, length, gram), "bucket int, pack int, payload binary")
    verdicts = anchors.repartitionById(buckets, F.col("bucket")).mapInArrow(_decide(hot), "pack int, payload binary").repartition(parts, "pack")
    marked = texts.groupBy("pack").cogroup(verdicts.groupBy("pack")).applyInArrow(_mark(buckets, length, gram), _OUT)
    # decided intervals pass through the same exchange, so nothing is computed or stored twice
    compared = marked.repartitionById(buckets, F.col("bucket")).mapInArrow(_compare(length), _OUT)
    runs = compared.select("id", "payload", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack"))
    return runs.groupBy("pack").applyInArrow(_stretches, "record_id string, span_start bigint, span_chars bigint")


def shared_part(spans: DataFrame, df: DataFrame) -> DataFrame:
    """One row per record of df: record_id, chars, spans, shared_chars, shared_percent (0 for none)."""
    sizes = df.filter("id is not null and text is not null").groupBy(F.col("id").alias("record_id")).agg(F.max(F.length("text")).cast("bigint").alias("chars"))
    s = spans.groupBy("record_id").agg(F.count("*").alias("spans"), F.sum("span_chars").alias("shared_chars"))
    out = sizes.join(s, "record_id", "left").na.fill(0, ["spans", "shared_chars"])
    return out.withColumn("shared_percent", F.round(F.col("shared_chars") * 100.0 / F.greatest("chars", F.lit(1)), 2))
