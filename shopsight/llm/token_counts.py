"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split at safe boundaries, where the tokenizer cannot join what
stands on both sides, so the count of a text is the sum over its pieces.  Equal
pieces of many texts are encoded once: the pieces that a task has not met yet
are joined into batches of about equal bytes, encoded with the library's batch
call, and each token is dealt to its piece by its offset.

Defined results: null text counts as empty (0 tokens); rows with repeated or
null ids each keep their row; ties do not arise; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm._text import buffer, document_columns, text_slices

#: Where a text may be cut, by public file.  "drop": the tokenizer drops white
#: space, so a blank or line feed is a cut that vanishes.  "lead": a single blank
#: between two characters that are not white space starts the next piece.
CUTS = {"word_bpe_49k.json": "drop", "byte_bpe_50k.json": "lead"}
_LEAD = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    """A file's place on this machine: as given, or among the public files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(text: str, cut: str | None) -> list[str]:
    """The text cut at safe boundaries."""
    if cut == "drop":
        return text.replace("\n", " ").split(" ")
    if cut == "lead":
        first, *rest = _LEAD.split(text)
        return [first, *(" " + x for x in rest)] if first or rest else []
    return [text] if text else []


@functools.lru_cache(maxsize=4)
def counter(name: str, cut: str | None, batch_bytes: int, keep: int) -> Counter:
    """One counter for all tasks of a worker process."""
    return Counter(name, cut, batch_bytes, keep)


class Counter:
    """Tokens of texts by one tokenizer file; keeps the counts of pieces it has
    seen, up to ``keep`` of them."""

    def __init__(self, name: str, cut: str | None, batch_bytes: int, keep: int):
        path = tokenizer_path(name)
        self._cut, self._bytes, self._keep, self._seen = cut, batch_bytes, keep, {}
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: tokenizer.encode_batch(texts, add_special_tokens=False)
            self._lengths = self._joined if cut == "drop" else lambda texts: [len(x) for x in self._encode(texts)]

    def _joined(self, parts: list[str]) -> list[int]:
        """Counts of pieces that may be joined with a blank between them."""
        groups, size = [[]], 0
        for x in parts:
            if size > self._bytes:
                groups.append([])
                size = 0
            groups[-1].append(x)
            size += len(x) + 1
        out: list[int] = []
        for i in range(0, len(groups), 256):
            some = groups[i:i + 256]
            for group, encoded in zip(some, self._encode([" ".join(g) for g in some])):
                ends = np.cumsum([len(x) + 1 for x in group])
                at = np.fromiter((x[0] for x in encoded.offsets), np.int64, len(encoded))
                out += np.bincount(np.searchsorted(ends, at, "right"), minlength=len(group)).tolist()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if self._cut is None:
            return self._lengths(texts)
        cut = [pieces(x, self._cut) for x in texts]
        seen = self._seen
        if len(seen) > self._keep:
            seen.clear()
        new = list({p for parts in cut for p in parts if p not in seen})
        if new:
            seen.update(zip(new, self._lengths(new)))
        return [sum(map(seen.__getitem__, parts)) for parts in cut]


def token_counts(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 cut: str | None = None, slice_bytes: int = 2 << 20, batch_bytes: int = 2 << 10, keep: int = 800_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of
    every text.  ``cut`` names the safe boundary (default: the one known for the
    file; an unknown file's texts are encoded whole).  ``keep`` bounds a task's
    memory for counts of pieces."""
    cut = cut or CUTS.get(os.path.basename(tokenizer))
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(tokenizer, cut, batch_bytes, keep).counts
        for part in text_slices(batches, "text", slice_bytes):
            sizes = np.diff(buffer(part.column("text"))[1])
            counts = counts_of(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
