"""Token counts of whole texts with a sentencepiece model, returning lengths only.

In this model family no piece holds the word-start mark after another character, so no merge crosses the point
before a run of blanks. A text is therefore cut there into units, whose counts add up. Units are counted by the
library itself; counts of recent units are kept in a bounded table in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship

#: Bytes of text that go through one library call at most (a longer unit goes alone).
BATCH_BYTES = 1 << 20
#: Units whose counts a worker keeps.
KEEP = 400_000
#: Units longer than this are not kept.
KEEP_CHARS = 64

MARK = "▁"
_units = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_counters: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens of texts with one model; the table of known units is cleared when full."""

    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.keep = keep
        self.known: dict[str, int] = {}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.safe = not any(MARK in piece.lstrip(MARK) for piece in pieces)

    def _learn(self, units: list[str]) -> dict[str, int]:
        """Counts of units (each without its first blank), in library calls of bounded size."""
        found: dict[str, int] = {}
        start = size = 0
        for at, unit in enumerate(units):
            size += len(unit.encode())
            if size >= BATCH_BYTES or at == len(units) - 1:
                part = units[start : at + 1]
                found.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
                start, size = at + 1, 0
        if "" in found:
            found[""] = 1  # a lone blank is one mark; an empty text never gets here
        return found

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        cut: list[list[str]] = []
        missing: dict[str, None] = {}
        known = self.known
        for text in texts:
            if not text:
                cut.append([])
                continue
            units = text.split(" ")
            if MARK in text or "" in units:
                units = [u[1:] for u in _units.findall(" " + text)]
            cut.append(units)
            for u in units:
                if u not in known:
                    missing[u] = None
        fresh = self._learn(list(missing)) if missing else {}
        short = {u: n for u, n in fresh.items() if len(u) <= KEEP_CHARS}
        if len(known) + len(short) > self.keep:
            # Counts needed for this batch stay reachable below while the table starts anew.
            fresh = known | fresh
            self.known = known = short if len(short) <= self.keep else {}
        else:
            known.update(short)
        if len(short) == len(fresh) and known is self.known and fresh.keys() <= known.keys():
            look = known.__getitem__
        else:
            both = known | fresh
            look = both.__getitem__
        return [sum(map(look, units)) for units in cut]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _balanced(texts: list[str], sizes: list[int]) -> Iterator[list[str]]:
    """Runs of texts of about BATCH_BYTES bytes each; a longer text goes alone or ends its run."""
    part: list[str] = []
    size = 0
    for text, own in zip(texts, sizes):
        if part and size + own > BATCH_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += own
    if part:
        yield part


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text.

    A null text counts as empty: no bytes, no tokens. Every input row gives one row, repeated rows and null ids
    included; other columns are ignored. Texts of any length are counted whole. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())  # Arrow knows the bytes of a string
            tokens = [n for part in _balanced(texts, sizes.to_pylist()) for n in count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return only(docs, id_col, text_col).withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(lengths, schema)
