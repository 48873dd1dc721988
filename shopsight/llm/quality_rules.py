"""Quality rules: statistics of whole texts, a fixed base rule, and gradient-boosted
trees over the statistics for what passes it.

Each text is measured in one pass; the measures (some numbers a document) are written
to the shared folder.  The trees are fitted on labelled documents by histograms of
the log loss, each split and leaf held to the monotonic constraints: ``Rule.trend``
-1 means that a larger value never raises the score, +1 that it never lowers it.  A
forest is one set of numpy node arrays; all rows walk all trees at once.

The fit uses about ``sample_rows`` labelled documents, chosen by the hash of their id,
so that it has a fixed size (of rows of one id, the one of least counts); documents of
one fold (checksum of the id) are never used, so that they can test the result.  All else is computed over all
documents.

Defined results: a null or empty text has zero counts and fails the base rule; a null
label is no label; several labels of one id count as good if all are; repeated rows
are measured and judged alike; null ids are never learned from; without labels of
both classes the score is the good share of what there is (1 if there is none); very
long texts are measured whole, as a slice of their own; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm._lexicon import number_words
from shopsight.llm._store import written
from shopsight.llm._text import _SPACE, buffer, document_columns, id_crc, text_slices

#: Fixed by the contract: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_digits", "n_upper", "n_marks"]


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


_IS_SYMBOL, _IS_DIGIT = _flags(SYMBOLS), _flags(b"0123456789")
_IS_UPPER, _IS_MARK = _flags(bytes(range(65, 91))), _flags(b".,;:!?")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _repeat_words(numbers: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words of each text inside a ``width``-word window that its text holds twice or more."""
    n = len(numbers)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    code = text * (int(numbers.max(initial=0)) + 1) + numbers
    begin = np.arange(n)
    for k in range(1, width):  # windows as exact numbers, one word longer at a time
        begin = begin[begin + k < first[1:][text[begin]]]
        if not len(begin):
            return np.zeros(len(first) - 1, np.int64)
        whole = np.zeros(n, np.int64)
        whole[begin] = _numbered(code[begin] * (int(numbers.max()) + 1) + numbers[begin + k])
        code = whole
    again = np.bincount(code[begin])[code[begin]] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin[again], 1)
    np.add.at(edge, begin[again] + width, -1)
    return _per_text(np.cumsum(edge[:-1]) > 0, first)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The columns ``COUNTS`` of each text of a slice."""
    numbers, first, _ = number_words(data, offsets)
    heads = (data & 0xC0) != 0x80
    lines = np.array([_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64).reshape(-1, 2)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    width = int(numbers.max(initial=0)) + 1
    distinct = np.bincount(np.unique(text * width + numbers) // width, minlength=len(first) - 1)
    return np.stack([_per_text(heads, offsets), np.diff(first), _per_text(heads & ~_SPACE[data], offsets), _per_text(_IS_SYMBOL[data], offsets), lines[:, 0], lines[:, 1],
                     _repeat_words(numbers, first, 3), distinct, _per_text(_IS_DIGIT[data], offsets), _per_text(_IS_UPPER[data], offsets), _per_text(_IS_MARK[data], offsets)], axis=1)


@dataclass(frozen=True)
class Rule:
    """A feature of the trees: a ratio of two counts, and its constraint."""

    name: str
    over: str
    under: str
    trend: int = 0


RULES = (
    Rule("symbol_share", "n_symbols", "n_words", -1),
    Rule("dup_line_share", "n_dup_lines", "n_lines", -1),
    Rule("repeat_share", "n_repeat_words", "n_words", -1),
    Rule("word_length", "word_chars", "n_words"),
    Rule("distinct_share", "n_distinct", "n_words"),
    Rule("digit_share", "n_digits", "n_chars"),
    Rule("upper_share", "n_upper", "n_words"),
    Rule("mark_share", "n_marks", "n_words"),
    Rule("words_a_line", "n_words", "n_lines"),
)


def features(counts: np.ndarray, rules: Sequence[Rule] = RULES) -> np.ndarray:
    at = {c: counts[:, k].astype(float) for k, c in enumerate(COUNTS)}
    return np.stack([at[r.over] / np.maximum(at[r.under], 1) for r in rules], axis=1)


@dataclass
class Forest:
    """All trees as node arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray  # a row goes left if its value is at most this
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.base)
        for at in range(0, len(x) if len(self.roots) else 0, block):
            part = x[at:at + block]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at:at + block] += self.value[node].sum(1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -700, 700)))


def _best_split(g: np.ndarray, h: np.ndarray, trend: np.ndarray, low: float, high: float, ridge: float, least: float) -> tuple[float, int, int, float, float] | None:
    """The split of greatest gain of a node: (gain, feature, bin, left weight, right
    weight), from sums of slopes and curvatures by feature and bin."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    gr, hr = gt - gl, ht - hl
    wl, wr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
    own = np.clip(-gt / (ht + ridge), low, high)

    def gain(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -(a * w + 0.5 * (b + ridge) * w * w)

    total = gain(gl, hl, wl) + gain(gr, hr, wr) - gain(gt, ht, own)
    allowed = (hl >= least) & (hr >= least) & ((wr - wl) * trend[:, None] >= 0)
    total = np.where(allowed, total, -np.inf)
    f, b = np.unravel_index(int(np.argmax(total)), total.shape) if total.size else (0, 0)
    if not total.size or total[f, b] <= 1e-6:
        return None
    return float(total[f, b]), int(f), int(b), float(wl[f, b]), float(wr[f, b])


def fit_forest(x: np.ndarray, good: np.ndarray, trend: Sequence[int], *, trees: int = 80, depth: int = 3, rate: float = 0.15,
               bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Boosted trees for the log loss of ``good``, monotonic in each feature whose
    trend is not 0: a split against the trend is not made, and a split's middle bounds
    the weights on either side of it, so that no deeper leaf goes against it either."""
    p = float(good.mean()) if len(good) else 1.0
    none = np.zeros(0, np.int64)
    if p in (0.0, 1.0):
        return Forest(none, np.zeros(0), none, none, np.zeros(0), none, 0, np.inf if p else -np.inf)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
    wide, sign = bins + 1, np.asarray(trend)
    feature, threshold, left, right, value, roots = ([] for _ in range(6))

    def leaf(weight: float) -> int:
        feature.append(0)
        threshold.append(0.0)
        left.append(len(left))
        right.append(len(right))
        value.append(rate * weight)
        return len(left) - 1

    margin = np.full(len(x), base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        slope, curve = q - good, q * (1 - q)
        root = leaf(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(x)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            weight = float(np.clip(-slope[rows].sum() / (curve[rows].sum() + ridge), low, high))
            found = None
            if level < depth:
                spot = binned[rows] + np.arange(x.shape[1]) * wide
                g, h = (np.bincount(spot.ravel(), np.repeat(w[rows], x.shape[1]), x.shape[1] * wide).reshape(-1, wide) for w in (slope, curve))
                found = _best_split(g, h, sign, low, high, ridge, least)
            if not found or found[2] >= len(cuts[found[1]]):
                value[node] = rate * weight
                margin[rows] += rate * weight
                continue
            _, f, b, wl, wr = found
            a, c = leaf(0.0), leaf(0.0)
            feature[node], threshold[node], left[node], right[node] = f, float(cuts[f][b]), a, c
            goes, middle = binned[rows, f] <= b, (wl + wr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(sign[f]), ((low, high), (low, high)))
            todo.append((a, rows[goes], *bounds[0], level + 1))
            todo.append((c, rows[~goes], *bounds[1], level + 1))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def measured(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` of every whole text."""
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            counts = measure(*buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in counts.T)], names=["doc_id", *COUNTS])

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def train(counts: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, sample_rows: int = 20_000,
          rules: Sequence[Rule] = RULES, **trees: float) -> Forest:
    """The forest of the labelled rows of ``counts`` (ids of fold 0 left out)."""
    marked = (labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("good")).where("doc_id is not null and good is not null")
              .where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != 0).groupBy("doc_id").agg(F.min("good").alias("good")))
    # about sample_rows ids, by the hash of the id alone: no task sends more than its share
    most = int(min(1.0, sample_rows / max(marked.count(), 1)) * (1 << 30))
    some = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < most)
    rows = counts.join(some, "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "c.*", "good").toPandas().sort_values("doc_id")
    return fit_forest(features(rows[COUNTS].to_numpy(dtype=np.int64), rules), rows["good"].to_numpy() > 0, [r.trend for r in rules], **trees)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5,
            sample_rows: int = 20_000, rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, score (of being good) and kept of every document."""
    counts = written(measured(docs, id_col=id_col, text_col=text_col))
    forest = train(counts, labels, id_col=id_col, label_col=label_col, folds=folds, sample_rows=sample_rows, rules=rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = features(np.stack([part.column(c).to_numpy() for c in COUNTS], axis=1), rules)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.scores(x))], names=[*part.schema.names, "score"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    judged = counts.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
