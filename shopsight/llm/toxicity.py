"""Toxicity: a linear-chain conditional random field over the words of a text.

Labels mark documents, so training tokens are labelled by distant supervision: in
a toxic training document a word is toxic if it, or its beginning, is tied to
toxic documents beyond chance (likelihood ratio); all other words are clean.  The
chain has two states; a word's features are itself and its first bytes (word
endings vary).  Forward-backward gives each word's marginal; a document's score is
a logistic function of the largest marginal and of their sum, fitted by cross-fit:
each training document has the marginals of a chain of the other folds.  Offending
spans are runs of words with a marginal of one half or more.

The fit uses at most ``toxic_rows`` and ``clean_rows`` labelled training documents
(those with the least hash of their id, of at most ``row_bytes`` bytes each), so
that it has a fixed size; class shares are counted over all training labels.  The chain
has the ``keep`` strongest features at most, and is fitted on all stretches of
``CHAIN`` words that hold one and as many others (the first, 1,000 at least).
Scoring reads every text whole, in chains of ``CHAIN`` words.

Defined results: null and empty texts get the score of a text without toxic
words; a null label is no label; several labels of one id count as toxic if any
is; repeated rows are scored alike; null ids count as held out; without labels of
both classes the score is the toxic share of what there is (0 if there is none);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm._text import BYTE_CODE, NO_LETTER, Spans, buffer, document_columns, id_crc, lower, ranges, text_slices, words

CHAIN = 64
_PREFIXES = (0, 3, 4, 5, 6, 7, 8, 10)  # bytes; 0: the whole word
_SALT = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(12)]


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A hash for each word and kind of feature (0: the word is too short)."""
    spans, out = Spans(BYTE_CODE[lower(data)]), []
    for k in _PREFIXES:
        if k == 0:
            out.append(spans.hash(starts, ends) ^ _SALT[0])
        else:
            h = spans.hash(starts, np.minimum(starts + k, ends)) ^ _SALT[k]
            h[ends - starts < k] = 0
            out.append(h)
    return out


def _chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of each chain."""
    counts = np.diff(first)
    per = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), per)
    nth = ranges(np.zeros(len(counts), np.int64), per)
    begin = first[:-1][text] + nth * CHAIN
    return begin, np.minimum(CHAIN, first[1:][text] - begin), text


def _forward_backward(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 for padded chains, the expected moves between states
    and the expected first state.  ``emission``: log odds of state 1."""
    n, width = emission.shape
    odds = np.exp(np.clip(emission.T, -30, 30))  # a row for each place, a column for each chain
    first, move = np.exp(start), np.exp(step)
    ahead, back = np.empty((2, width, n)), np.full((2, width, n), 0.5)
    clean, toxic = np.full(n, first[0]), first[1] * odds[0]
    for t in range(width):
        if t:
            clean, toxic = clean * move[0, 0] + toxic * move[1, 0], (clean * move[0, 1] + toxic * move[1, 1]) * odds[t]
        total = clean + toxic
        ahead[0, t], ahead[1, t] = clean, toxic = clean / total, toxic / total
    for t in range(width - 1, 0, -1):
        seen = odds[t] * back[1, t]
        clean, toxic = move[0, 0] * back[0, t] + move[0, 1] * seen, move[1, 0] * back[0, t] + move[1, 1] * seen
        total = clean + toxic
        inside = t < lengths
        back[0, t - 1], back[1, t - 1] = np.where(inside, clean / total, 0.5), np.where(inside, toxic / total, 0.5)
    inside = np.arange(width)[:, None] < lengths
    both = ahead * back
    marginal = np.where(inside, both[1] / both.sum(0), 0)
    seen = back[:, 1:].copy()
    seen[1] *= odds[1:]
    pair = [ahead[i, :-1] * move[i, j] * seen[j] for i in (0, 1) for j in (0, 1)]
    total = sum(pair)
    moves = np.array([(x / total)[inside[1:]].sum() for x in pair]).reshape(2, 2)
    return marginal.T, moves, np.array([n - marginal[0].sum(), marginal[0].sum()])


@dataclass
class Tagger:
    """The chain's weights and the document score's."""

    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray
    score: np.ndarray  # constant, largest marginal, log of their sum

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(features[0]), self.bias)
        if len(self.keys):
            for h in features:
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                out += np.where(self.keys[at] == h, self.weights[at], 0.0)
        return out

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word.  Chains without any feature differ by length only."""
        begin, length, _ = _chains(first)
        out = np.empty(len(emission))
        if not len(begin):
            return out
        active = np.add.reduceat(emission != self.bias, begin) > 0
        blank = _forward_backward(np.full((CHAIN, CHAIN), self.bias), np.arange(1, CHAIN + 1), self.start, self.step)[0]
        plain = ~active
        out[ranges(begin[plain], length[plain])] = blank[np.repeat(length[plain] - 1, length[plain]), ranges(np.zeros(plain.sum(), np.int64), length[plain])]
        for at in range(0, int(active.sum()), 4096):
            who = np.flatnonzero(active)[at:at + 4096]
            words_ = ranges(begin[who], length[who])
            row, place = np.repeat(np.arange(len(who)), length[who]), ranges(np.zeros(len(who), np.int64), length[who])
            padded = np.zeros((len(who), CHAIN))
            padded[row, place] = emission[words_]
            out[words_] = _forward_backward(padded, length[who], self.start, self.step)[0][row, place]
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest marginal and sum of marginals; the words' bytes and
        marginals."""
        starts, ends, first = words(data, offsets, NO_LETTER)
        p = self.marginals(self.emissions(_features(data, starts, ends)), first)
        largest, total = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            largest[full] = np.maximum.reduceat(p, first[:-1][full])
            total[full] = np.add.reduceat(p, first[:-1][full])
        return largest, total, starts, ends, p

    def scores(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score[0] + self.score[1] * largest + self.score[2] * np.log1p(total), -35, 35)))


def _associations(features: Iterable[np.ndarray], text: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that are commoner in toxic documents beyond chance: hash and
    likelihood ratio."""
    a_all, b_all = float(toxic.sum()), float((~toxic).sum())
    keys, ratios, tried = [], [], 0
    for h in features:
        h, doc = h[h != 0], text[h != 0]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        key, number = np.unique(h[once], return_inverse=True)
        bad = toxic[doc[once]]
        a, b = np.bincount(number[bad], minlength=len(key)).astype(float), np.bincount(number[~bad], minlength=len(key)).astype(float)
        share = (a + b) / (a_all + b_all)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = sum(2 * np.where(n > 0, n * np.log(n / np.maximum(m, 1e-12)), 0) for n, m in ((a, share * a_all), (b, share * b_all), (a_all - a, (1 - share) * a_all), (b_all - b, (1 - share) * b_all)))
        good = (a / a_all > 10 * b / b_all) & (a >= 2)
        tried += int((a + b >= 2).sum())
        keys.append(key[good])
        ratios.append(g[good])
    keys_, ratios_ = np.concatenate(keys), np.concatenate(ratios)
    # as many features were tried, the strongest by chance is near twice the logarithm of their number
    sure = np.flatnonzero(ratios_ > 2 * np.log(max(tried, 2)))
    sure = sure[np.argsort(keys_[sure])]
    return keys_[sure], ratios_[sure]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _fit_chain(features: list[np.ndarray], first: np.ndarray, toxic: np.ndarray, use: np.ndarray, rounds: int, keep: int) -> Tagger:
    """The chain of the texts that ``use`` marks; its document score is open."""
    tagger = Tagger(np.zeros(0, np.uint64), np.zeros(0), -8.0, np.zeros(2), np.zeros((2, 2)), np.zeros(3))
    if not toxic[use].any() or toxic[use].all():
        return tagger
    text = np.repeat(np.arange(len(toxic)), np.diff(first))
    mine = np.flatnonzero(use[text])
    keys, ratios = _associations((h[mine] for h in features), (np.cumsum(use) - 1)[text[mine]], toxic[use])
    if len(keys) > keep:
        keys = np.sort(keys[np.argsort(-ratios)[:keep]])
    if not len(keys):
        return tagger
    # each word's features: the word and the feature's number
    word, number = [], []
    for h in features:
        at = np.minimum(np.searchsorted(keys, h[mine]), len(keys) - 1)
        same = np.flatnonzero(keys[at] == h[mine])
        word.append(mine[same])
        number.append(at[same])
    word, number = np.concatenate(word), np.concatenate(number)
    busy_word = np.zeros(len(text), bool)
    busy_word[word] = True
    begin, length, owner = _chains(first)
    begin, length = begin[use[owner]], length[use[owner]]
    busy = np.add.reduceat(busy_word.astype(np.int64), begin)
    # ``begin`` leaves out the chains of other texts, whose words are not marked
    who = np.concatenate((np.flatnonzero(busy), np.flatnonzero(busy == 0)[:max(1000, int((busy > 0).sum()))]))
    begin, length = begin[who], length[who]
    spot = ranges(begin, length)
    row, place = np.repeat(np.arange(len(begin)), length), ranges(np.zeros(len(begin), np.int64), length)
    where = np.full(len(text), -1, np.int64)
    where[spot] = np.arange(len(spot))
    word = where[word]  # every chain with a feature is among them
    y = np.zeros((len(begin), CHAIN))
    y[row, place] = (busy_word & toxic[text])[spot]
    inside = np.arange(CHAIN) < length[:, None]
    seen_moves = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & inside[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)])
    seen_first = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()], float)
    k = len(keys)
    theta = np.concatenate((np.zeros(k), [-2.0], np.zeros(2), np.zeros(4)))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(1.0, float(length.sum()))
    for r in range(1, rounds + 1):  # Adam on the whole batch
        padded = np.zeros((len(begin), CHAIN))
        padded[row, place] = theta[k] + np.bincount(word, theta[number], len(spot))
        p, moves, starts_ = _forward_backward(padded, length, theta[k + 1:k + 3], theta[k + 3:].reshape(2, 2))
        error = (y - p)[row, place]
        slope = np.concatenate((np.bincount(number, error[word], k), [error.sum()], seen_first - starts_, (seen_moves - moves).ravel()))
        slope = slope / scale - 1e-6 * theta
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        theta += 0.2 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
    return Tagger(keys, theta[:k], float(theta[k]), theta[k + 1:k + 3], theta[k + 3:].reshape(2, 2), np.zeros(3))


def fit(texts: list[str], toxic: np.ndarray, shares: tuple[float, float], *, rounds: int = 120, keep: int = 20_000, folds: int = 3) -> Tagger:
    """A tagger from labelled texts.  ``shares``: how many training labels of each
    class (clean, toxic) there are in all; ``keep``: features of the chain at most
    (the strongest).  The document score is fitted on the marginals that each text
    gets from a chain of the other folds; the chain that is given is of all texts."""
    total = sum(shares)
    if not toxic.any() or toxic.all():
        p = min(max(shares[1] / total if total else 0.0, 1e-9), 1 - 1e-9)
        return Tagger(np.zeros(0, np.uint64), np.zeros(0), -8.0, np.zeros(2), np.zeros((2, 2)), np.array([np.log(p / (1 - p)), 0.0, 0.0]))
    parts, counts = [], []
    for at in range(0, len(texts), 256):  # a bounded buffer at a time
        data, offsets = _joined(texts[at:at + 256])
        starts, ends, first = words(data, offsets, NO_LETTER)
        parts.append(_features(data, starts, ends))
        counts.append(np.diff(first))
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    features = [np.concatenate([p.pop(0) for p in parts]) for _ in _PREFIXES]
    fold = np.empty(len(texts), np.int64)  # the classes are dealt to the folds evenly
    for some in (np.flatnonzero(toxic), np.flatnonzero(~toxic)):
        fold[some] = np.arange(len(some)) % folds
    largest, sums = np.zeros(len(texts)), np.zeros(len(texts))
    for k in range(folds):
        other, own = _fit_chain(features, first, toxic, fold != k, rounds, keep), np.flatnonzero(fold == k)
        for at in range(0, len(own), 256):
            some = own[at:at + 256]
            largest[some], sums[some] = other.documents(*_joined([texts[i] for i in some]))[:2]
    tagger = _fit_chain(features, first, toxic, np.ones(len(texts), bool), rounds, keep)
    x = np.stack([np.ones(len(texts)), largest, np.log1p(sums)], axis=1)
    target = toxic.astype(float)
    weight = np.where(toxic, shares[1] / toxic.sum(), shares[0] / (~toxic).sum()) / total
    beta = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3) * 1e-4
        beta += np.linalg.solve(curve, x.T @ (weight * (target - p)) - 1e-4 * beta)
    tagger.score = beta
    return tagger


def train(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          toxic_rows: int = 1_200, clean_rows: int = 3_600, row_bytes: int = 64 << 10) -> Tagger:
    """A tagger from ``labels`` whose id satisfies ``training`` (a condition on a
    column ``doc_id``).  Only the bounded sample goes to the driver."""
    marked = (labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
              .where(training).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    shares = {int(r["toxic"] > 0): r["n"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    short = document_columns(docs, id_col, text_col).where(F.octet_length("text") <= row_bytes)
    # more ids than wanted, as some have no (short) text; of a fixed number
    wanted = [marked.where(f"toxic {op} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for op, n in ((">", toxic_rows), ("<=", clean_rows))]
    rows = short.join(F.broadcast(wanted[0].union(wanted[1])), "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    rows = rows.iloc[np.argsort([zlib.crc32(f"fold {i}".encode()) for i in rows["doc_id"]], kind="stable")]
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy(dtype=int) > 0, (shares.get(0, 0), shares.get(1, 0)))


def tag_documents(df: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and toxic_spans (characters from, to, and the largest marginal
    in between) of every document."""
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 2 << 20):
            data, offsets = buffer(part.column("text"))
            largest, total, starts, ends, p = tagger.documents(data, offsets)
            hot = np.flatnonzero(p >= 0.5)
            text = np.searchsorted(offsets, starts[hot], "right") - 1
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            before = -2
            for w, k in zip(hot.tolist(), text.tolist()):
                a, b, raw = int(offsets[k]), int(ends[w]), data
                if w == before + 1 and spans[k]:
                    spans[k][-1]["to"] = b - a
                    spans[k][-1]["marginal"] = max(spans[k][-1]["marginal"], float(p[w]))
                else:
                    spans[k].append({"from": int(starts[w]) - a, "to": b - a, "marginal": float(p[w])})
                before = w
            for k in set(text.tolist()):  # bytes to characters
                heads = np.concatenate(([0], np.cumsum((raw[offsets[k]:offsets[k + 1]] & 0xC0) != 0x80)))
                for s in spans[k]:
                    s["from"], s["to"] = int(heads[s["from"]]), int(heads[s["to"]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tagger.scores(largest, total)), pa.array(spans, span)], names=["doc_id", "score", "toxic_spans"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double, toxic_spans array<struct<from:bigint,to:bigint,marginal:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **sample: int) -> DataFrame:
    """doc_id, held_out, score, predicted and toxic_spans of every document; the
    labels of one fold (by checksum of the id) are never seen."""
    tagger = train(docs, labels, F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != 0, id_col=id_col, text_col=text_col, **sample)
    tagged = tag_documents(docs, tagger, id_col=id_col, text_col=text_col)
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == 0
    return tagged.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **sample: int) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, each row by itself."""
    tagger = train(docs, labels, F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != 0, id_col=id_col, text_col=text_col, **sample)
    columns, at = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index(text_col)
    rows = docs.toDF(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pa.RecordBatch.from_arrays([*b.columns, pc.fill_null(b.column(at), "")], names=[*columns, "text"]) for b in batches)
        for part in text_slices(texts, "text", 2 << 20):
            largest, total = tagger.documents(*buffer(part.column("text")))[:2]
            yield part.select(columns).filter(pa.array(tagger.scores(largest, total) < 0.5))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
