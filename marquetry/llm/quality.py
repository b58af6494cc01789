"""Per-document text quality statistics, and a Gaussian mixture over them that tells prose from lists, tables and junk."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.session import written

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LINE_END = re.compile("\r\n|[\r\n\v\f\x85\u2028\u2029]")
_ITEM = re.compile(r"\s*(?:[-*•·‣▪◦–—+>o]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)\]]|\[[ xX]?\]|\#\d+)\s+\S")
_GAP = re.compile(r"\t|\||;|,(?! )| {2,}(?=\S)")
_RULE = re.compile(r"[\s|+:=\-_]{3,}")
_FIGURE = re.compile(r"[\d.,:%+-]*\d[\d.,:%+-]*$")
_END = re.compile(r"""[.!?…:。！？؟।]["'”’)\]»]*\s*$""")

# Figures per document in this order.
FEATURES = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "item_lines", "short_lines", "words_per_line", "line_length_spread",
    "cells_per_line", "aligned_lines", "figure_cells", "repeated_lines", "distinct_words", "sentence_words", "comma_ratio", "letter_words", "odd_letters", "char_entropy", "capitals", "loose_lines",
)
CLASSES = ("prose", "list", "table", "junk")


def statistics(text: str, common: dict[str, set[str]]) -> list[float]:
    """The figures of one text that is not blank; all are finite. See FEATURES.

    common: words by language; the share of common words is that of the language where it is largest, whatever is declared.
    """
    n = len(text)
    lines = [x for x in _LINE_END.split(text) if x.strip()] or [text]
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    counts = Counter(text)
    space = letters = digits = upper = 0
    for c, v in counts.items():
        if c.isalpha():
            letters += v
            upper += v if c.isupper() else 0
        elif c.isspace():
            space += v
        elif c.isdigit():
            digits += v
        elif c.isupper():
            upper += v
    solid = n - space
    symbols = solid - letters - digits
    plain_marks = sum(counts[c] for c in ".,;:!?'\"()-’“”«»¿¡…")
    nw, nl = max(1, len(words)), len(lines)
    seen = Counter(low)
    share = max((sum(map(seen.__getitem__, ws & seen.keys())) for ws in common.values()), default=0) / nw
    wide = [len(x.strip()) for x in lines]
    per = [len(_WORD.findall(x)) for x in lines]
    cells = [[c for c in _GAP.split(x.strip().strip("|"))] for x in lines]
    width = Counter(len(c) for c in cells if not _RULE.fullmatch("".join(c) or "---"))
    usual, at = max(((k, v) for k, v in width.items() if k > 1), key=lambda kv: (kv[1], kv[0]), default=(1, 0))
    flat = [c.strip() for row in cells for c in row if len(row) > 1 and c.strip()]
    rules = sum(bool(_RULE.fullmatch(x)) for x in lines)
    sentences = max(1, len(re.findall(r"[.!?…。！？]+(?=\s|$)", text)))
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values()) if n else 0.0
    mean_line = sum(wide) / nl
    spread = math.sqrt(sum((w - mean_line) ** 2 for w in wide) / nl) / max(1.0, mean_line)
    alpha = odd = 0
    for w, v in seen.items():
        if w.isalpha():
            alpha += v
            if len(w) > 2 and not (_pronounceable if len(w) <= 32 else _pronounceable.__wrapped__)(w):  # remembered unless long
                odd += v
    odd /= max(1, alpha)
    commas = text.count(",") + text.count(";")
    # lines that start in lower case or with a figure and end without a sign: parts of a list without marks, not of sentences
    loose = sum(1 for x, p in zip(lines, per) if p <= 9 and not _END.search(x)) / nl
    return [
        math.log1p(len(words)), min(20.0, sum(map(len, words)) / nw), (symbols - plain_marks) / max(1, solid), digits / max(1, solid), sum(bool(_END.search(x)) for x in lines) / nl,
        share, sum(bool(_ITEM.match(x)) for x in lines) / nl, sum(p <= 8 for p in per) / nl, math.log1p(len(words) / nl), min(3.0, spread),
        math.log1p(sum(map(len, cells)) / nl), at / max(1, nl - rules), sum(bool(_FIGURE.match(c)) for c in flat) / max(1, len(flat)), 1 - len({x.strip() for x in lines}) / nl,
        len(seen) / nw, math.log1p(min(200.0, len(words) / sentences)), commas / nw, alpha / nw, odd, entropy,
        upper / max(1, letters), loose,
    ]


_VOWELS = set("aeiouyáàâäãåéèêëíìîïóòôöõøúùûüæœ")


@lru_cache(1 << 16)
def _pronounceable(word: str) -> bool:
    """Has a vowel, and no run of more than four consonants, if it is of the Latin script; other scripts pass."""
    if not word[0].isascii() and word[0] not in _VOWELS:
        return True
    run = longest = vowels = 0
    for c in word:
        if c in _VOWELS:
            run, vowels = 0, vowels + 1
        else:
            run += 1
            longest = max(longest, run)
    return vowels > 0 and longest <= 4


# --- Gaussian mixture -------------------------------------------------------------------------------------------------------

#: Labelled examples used to start and to name components: at most this many, by least hash of doc_id.
EXAMPLES = 4_000
#: Components started per class, if it has enough examples.
COMPONENTS = {"prose": 10, "list": 8, "table": 6, "junk": 8}
#: Rounds of expectation-maximization at most, and the gain in log-likelihood a document below which they end.
ROUNDS, LEAST_GAIN = 12, 0.02
#: Variance added to every standardised figure, and weight (in documents) of the pooled covariance in each component's.
RIDGE, POOL = 0.02, 20.0


class Mixture:
    """Components (weight, mean, covariance) over standardised figures, and the class of each."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray, center: np.ndarray, scale: np.ndarray, names: np.ndarray | None = None) -> None:
        self.weight, self.mean, self.cov, self.center, self.scale, self.names = weight, mean, cov, center, scale, names
        roots = [np.linalg.cholesky(c) for c in cov]
        self.whiten = [np.linalg.inv(r) for r in roots]
        self.log = np.log(np.maximum(weight, 1e-12)) - np.array([np.log(np.diag(r)).sum() for r in roots])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8)

    def _weighed(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        ll = np.stack([lg - 0.5 * ((w @ (z - m).T) ** 2).sum(0) for lg, m, w in zip(self.log, self.mean, self.whiten)], 1)
        top = ll.max(1, keepdims=True)
        p = np.exp(ll - top)
        total = p.sum(1, keepdims=True)
        return p / total, float((top + np.log(total)).sum())

    def posterior(self, z: np.ndarray) -> np.ndarray:
        return self._weighed(z)[0]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sufficient statistics of the rows, one row per component: n, sums, sums of products; in the last row the log-likelihood."""
        z = self.standard(x)
        p, ll = self._weighed(z)
        products = np.stack([((z * p[:, [k]]).T @ z).ravel() for k in range(p.shape[1])])
        out = np.concatenate([p.sum(0)[:, None], p.T @ z, products], 1)
        last = np.zeros((1, out.shape[1]))
        last[0, 0] = ll
        return np.concatenate([out, last])

    def stepped(self, sums: np.ndarray) -> Mixture:
        d = len(self.center)
        n = sums[:, 0]
        live = n > 1e-6
        mean = np.where(live[:, None], sums[:, 1 : 1 + d] / np.maximum(n, 1e-6)[:, None], self.mean)
        raw = sums[:, 1 + d :].reshape(-1, d, d) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        return Mixture(n / n.sum(), mean, shrunk(raw, n), self.center, self.scale, self.names)

    def classes(self, x: np.ndarray) -> np.ndarray:
        p = self.posterior(self.standard(x))
        score = np.stack([p[:, self.names == i].sum(1) for i in range(len(CLASSES))], 1)
        return score.argmax(1)


def shrunk(scatter: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Covariances from scatter matrices, drawn towards the pooled one by POOL documents."""
    d = scatter.shape[1]
    pooled = np.diag(np.diag(scatter.sum(0) / max(1.0, n.sum()))) + RIDGE * np.eye(d)
    return (scatter + POOL * pooled) / (n + POOL)[:, None, None] + RIDGE * np.eye(d)


def started(z: np.ndarray, y: np.ndarray, center: np.ndarray, scale: np.ndarray) -> Mixture:
    """A mixture from labelled examples: k-means inside each class, started from points far from each other."""
    centres, names, member = [], [], np.zeros(len(z), int)
    for c, name in enumerate(CLASSES):
        rows = np.flatnonzero(y == c)
        if not len(rows):
            continue
        x = z[rows]
        k = max(1, min(COMPONENTS[name], len(rows) // 4))
        at = x[[np.argmin(((x - x.mean(0)) ** 2).sum(1))]]
        while len(at) < k:
            far = ((x[:, None] - at[None]) ** 2).sum(2).min(1)
            at = np.concatenate([at, x[[far.argmax()]]])
        for _ in range(20):
            own = ((x[:, None] - at[None]) ** 2).sum(2).argmin(1)
            at = np.stack([x[own == i].mean(0) if (own == i).any() else at[i] for i in range(len(at))])
        member[rows] = len(names) + own
        centres += list(at)
        names += [c] * len(at)
    mean, k = np.array(centres), len(names)
    n = np.bincount(member, minlength=k).astype(float)
    scatter = np.stack([(z[member == i] - mean[i]).T @ (z[member == i] - mean[i]) for i in range(k)])
    return Mixture(np.maximum(n, 1) / np.maximum(n, 1).sum(), mean, shrunk(scatter, n), center, scale, np.array(names))


def named(model: Mixture, x: np.ndarray, y: np.ndarray) -> Mixture:
    """Classes of components by the examples that fall into them, weighted by how well; a component without any keeps the
    class it was started for."""
    p = model.posterior(model.standard(x))
    votes = np.stack([p[y == c].sum(0) for c in range(len(CLASSES))], 1)
    model.names = np.where(votes.sum(1) >= 0.5, votes.argmax(1), model.names)
    return model


# --- over tables ------------------------------------------------------------------------------------------------------------

_D = len(FEATURES)
SLOTS = 16


def _figures(common: dict[str, set[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            x = [statistics(t, common) if t is not None and t.strip() else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return run


def document_figures(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id and x, the array of FEATURES; x is null for null and blank texts. Any other columns are ignored.

    common_words (lang, word) is a small fixed table that does not grow with the documents; it goes along with the tasks.
    """
    common: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").filter("lang is not null and word is not null").distinct().collect():
        common.setdefault(r.lang, set()).add(r.word.lower())
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_figures(common), "doc_id bigint, x array<double>")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    c = batch.column("x").drop_null()
    return np.asarray(c.flatten()).reshape(-1, _D)


def _gathered(figures: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of a matrix computed from blocks of rows; added up in the tasks, then in SLOTS tasks, then here.

    Always in order of the partitions, so the same table gives the same bits, whichever task ends first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _rows(b)
            if len(x):
                s = of(x)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for b in batches:
            for at, s in zip(b.column("part").to_pylist(), b.column("s").to_pylist()):
                v = np.frombuffer(s)
                total, first = (v, at) if total is None else (total + v, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "s"])

    parts = figures.mapInArrow(part, "part int, s binary").repartition(SLOTS, F.pmod("part", F.lit(SLOTS))).sortWithinPartitions("part").mapInArrow(add, "part int, s binary").collect()
    return sum(np.frombuffer(bytes(r.s)) for r in sorted(parts)) if parts else None


def fitted(figures: DataFrame, labels: DataFrame, rounds: int = ROUNDS, examples: int = EXAMPLES) -> Mixture | None:
    """The mixture: started from examples, fitted by expectation-maximization over all rows of figures, named by examples.

    Means and spreads that standardise the figures are those of all documents. labels: doc_id, label; other labels than CLASSES
    and labels of unknown or blank documents are ignored. None where there is no example.
    """
    lab = labels.filter(F.col("label").isin(*CLASSES)).dropDuplicates(["doc_id"]).join(figures.filter("x is not null"), "doc_id").select("label", "x", "doc_id")
    known = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()
    total = _gathered(figures, lambda x: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if not known or total is None:
        return None
    n, center = total[0], total[1 : 1 + _D] / total[0]
    scale = np.maximum(np.sqrt(np.maximum(total[1 + _D :] / n - center**2, 0)), 1e-3)
    x, y = np.array([r.x for r in known]), np.array([CLASSES.index(r.label) for r in known])
    model = started(np.clip((x - center) / scale, -8, 8), y, center, scale)
    before = None
    for _ in range(rounds):
        sums = _gathered(figures, lambda v, m=model: m.sums(v).ravel()).reshape(len(model.names) + 1, -1)
        model = model.stepped(sums[:-1])
        likelihood = sums[-1, 0] / n
        if before is not None and likelihood - before < LEAST_GAIN:
            break
        before = likelihood
    return named(model, x, y)


def classified(figures: DataFrame, model: Mixture | None) -> DataFrame:
    """doc_id, x and class (null for blank texts, and everywhere without a model)."""
    if model is None:
        return figures.withColumn("class", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, None, object)
            x = _rows(b)
            if len(x):
                out[np.asarray(b.column("x").is_valid())] = np.array(CLASSES, object)[model.classes(x)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("x"), pa.array(out, pa.string())], names=["doc_id", "x", "class"])

    return figures.select("doc_id", "x").mapInArrow(run, "doc_id bigint, x array<double>, class string")


def judged(documents: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    """classified for a table of documents; the figures are computed once and written to the shared folder."""
    figures = written(document_figures(documents, common_words))
    return classified(figures, fitted(figures, labels))


def as_columns(df: DataFrame) -> DataFrame:
    """The array x as one column per figure, rounded to 6 places."""
    return df.select("doc_id", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(FEATURES)], "class")
