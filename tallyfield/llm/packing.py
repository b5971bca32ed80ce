"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Each partition packs the examples that it holds; nothing is shuffled. A partition keeps a bounded pool of pending
examples. The open sequence takes, of the examples that fit whole, the one whose demand has the largest dot product
with what is left of the limits (each limit weighted by the mean demand for it); when none fits whole, the one whose
longest start that fits has the largest, and that start. A sequence that a limit other than the tokens leaves short is
cut at the largest power of two it holds, a size that needs no padding, and the rest returns to the pool; the last
tokens of a partition go out as powers of two as well.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only, ship, tool

#: Pending examples in a partition's pool.
POOL = 512
#: Words, and runs of letters, whose ids a worker keeps.
KEEP = 500_000
KEEP_BYTES = 64


#: The share of a document's tokens, at its start, that counts as its prompt and bears no loss.
PROMPT = 0.25


@dataclass(frozen=True)
class Limits:
    """Loss-bearing tokens may fill seven eighths of a sequence, and a sequence has 16 segments at most, so that all three limits bind."""

    tokens: int = 2048
    segments: int = 16
    loss: int = 1792


@dataclass
class Piece:
    """Tokens start to end of one example; the last `loss` tokens of the example bear loss."""

    key: int
    start: int
    end: int
    total: int
    loss: int

    @property
    def length(self) -> int:
        return self.end - self.start

    def bearing(self) -> int:
        return max(0, self.end - max(self.start, self.total - self.loss))

    def head(self, tokens: int, bearing: int) -> int:
        """The longest start of this piece with at most so many tokens and loss-bearing tokens."""
        plain = max(0, self.total - self.loss - self.start)
        return min(tokens, self.length, plain + bearing)

    def cut(self, length: int) -> tuple["Piece", "Piece"]:
        middle = self.start + length
        return Piece(self.key, self.start, middle, self.total, self.loss), Piece(self.key, middle, self.end, self.total, self.loss)


class Packer:
    """Streams examples into sequences; done() is called with the pieces of each finished sequence."""

    def __init__(self, limits: Limits, done: Callable[[list[Piece]], None]):
        if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
            raise ValueError("limits must be positive")
        self.limits, self.done = limits, done
        self.pool: list[Piece] = []
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, key: int, total: int, loss: int | None = None) -> None:
        piece = Piece(key, 0, total, total, total if loss is None else loss)
        while piece.length >= self.limits.tokens:
            size = piece.head(self.limits.tokens, self.limits.loss)
            if size < self.limits.tokens:
                break
            whole, piece = piece.cut(size)
            self.done([whole])
        if piece.length:
            self.pool.append(piece)
        if len(self.pool) >= POOL:
            self._pack(POOL // 2)

    def finish(self) -> None:
        self._pack(0)

    def _demand(self, piece: Piece) -> tuple[int, int]:
        """Tokens of a piece, and those of them, at its start, that bear no loss."""
        return piece.length, min(piece.length, max(0, piece.total - piece.loss - piece.start))

    def _pack(self, least: int) -> None:
        """Fill sequences until at most `least` examples are pending."""
        if not self.pool:
            return
        length, plain = (np.array(x, np.int64) for x in zip(*map(self._demand, self.pool)))
        here = np.ones(len(self.pool), bool)
        weight = np.array([length.mean(), 1.0, (length - plain).mean()]) / self.full
        while here.sum() > least:
            self._fill(length, plain, here, weight)
        self.pool = [p for p, keep in zip(self.pool, here) if keep]

    def _fill(self, length: np.ndarray, plain: np.ndarray, here: np.ndarray, weight: np.ndarray) -> None:
        """One sequence from the pending examples; what is cut off stays pending in its place."""
        left = [self.limits.tokens, self.limits.segments, self.limits.loss]
        taken: list[tuple[int, Piece]] = []
        while left[0] and left[1]:
            open_ = np.flatnonzero(here)
            if not len(open_):
                break
            tokens, first = length[open_], plain[open_]
            head = np.minimum(np.minimum(tokens, left[0]), first + left[2])
            whole = head == tokens
            value = weight / self.full * left / self.full
            gain = head * value[0] + value[1] + np.maximum(head - first, 0) * value[2]
            gain[head == 0] = -1.0
            at = int(np.argmax(np.where(whole, gain, -1.0) if whole.any() else gain))
            size = int(head[at])
            if not size:
                break
            at = int(open_[at])
            here[at] = False
            taken.append((at, self.pool[at].cut(size)[0]))
            left = [left[0] - size, left[1] - 1, left[2] - max(0, size - int(plain[at]))]
        total = sum(p.length for _, p in taken)
        if total < self.limits.tokens:
            over = total - (1 << total.bit_length() - 1)
            while over:
                at, last = taken.pop()
                if last.length > over:
                    taken.append((at, last.cut(last.length - over)[0]))
                    break
                here[at] = True
                over -= last.length
        for at, piece in taken:
            whole_piece = self.pool[at]
            if piece.end < whole_piece.end:
                self.pool[at] = whole_piece.cut(piece.length)[1]
                (length[at], plain[at]), here[at] = self._demand(self.pool[at]), True
        self.done([p for _, p in taken])


# Token ids of texts.

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")

#: The characters for which lower-casing and composing change nothing beyond Python's lower(), and the
#: split that the tokenizer file states, written for them. Anything else goes through the library whole.
_plain = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Kept(dict):
    """A bounded table that computes what it lacks and starts anew when full."""

    def __init__(self, compute: Callable, keep: int):
        self.compute, self.keep = compute, keep

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEEP_BYTES:
            if len(self) >= self.keep:
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit numbers; words between ASCII blanks are independent of each other."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.runs = _Kept(self._run, keep)
        self.words = _Kept(self._word, keep)

    def _run(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():
            return self._run(text.lower())
        if "<|" in text or not _plain.fullmatch(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.runs.__getitem__, _parts.findall(text.lower())))

    def ids(self, text: str | None) -> bytes:
        data = (text or "").encode()
        if b"<|" not in data:  # the library lower-cases all but special tokens, so this only makes equal words meet
            data = data.lower()
        return b"".join(map(self.words.__getitem__, data.split()))


def encoder(path: str) -> WordIds:
    return tool(("word ids", path), lambda: WordIds(path))


COLUMNS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "loss": pa.int64()}


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", prompt: float = PROMPT) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence, a checksum of its ids, and its loss-bearing tokens.

    A document is the ids of its whole text and end_id; a null or empty text is end_id alone. The first `prompt` share
    of a document's tokens bears no loss. Texts are encoded whole however long. Repeated rows and null ids are documents of their own. Sequences are numbered within their partition,
    whose number is in the upper bits. Other columns are ignored whatever their names; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COLUMNS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        codes = encoder(tokenizer_path)
        closing = np.array([end_id], "<u4").tobytes()
        held: dict[int, tuple[object, bytes, int]] = {}  # key: id, ids, tokens not yet placed
        rows: list[tuple] = []
        seen = 0

        def done(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                own, ids, open_ = held[p.key]
                rows.append((own, p.start, p.length, zlib.crc32(memoryview(ids)[4 * p.start : 4 * p.end]), p.total, sequence, offset, p.bearing()))
                offset += p.length
                if open_ == p.length:
                    del held[p.key]
                else:
                    held[p.key] = (own, ids, open_ - p.length)
            sequence += 1

        packer = Packer(limits, done)
        kind = None

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(COLUMNS.values(), 1))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[id_col, *COLUMNS])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = codes.ids(text) + closing
                held[seen] = (own, ids, len(ids) // 4)
                total = len(ids) // 4
                packer.add(seen, total, total - int(total * prompt))
                seen += 1
            if rows:
                yield out()
        packer.finish()
        if rows:
            yield out()

    return only(docs, id_col, text_col).mapInArrow(packed, schema)


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """Pieces of examples given by their token counts and the count of loss-bearing tokens at their end.

    Null counts are zero, a loss count above the tokens is the tokens, and examples without tokens give no pieces.
    """
    ship(examples.sparkSession)
    names = ["start", "length", "loss", "sequence_id", "offset"]
    schema = f"`{id_col}` {examples.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        owners: dict[int, list] = {}

        def done(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                owner = owners[p.key]
                rows.append((owner[0], p.start, p.length, p.bearing(), sequence, offset))
                offset += p.length
                owner[1] -= p.length
                if not owner[1]:
                    del owners[p.key]
            sequence += 1

        packer, seen, kind = Packer(limits, done), 0, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if tokens and tokens > 0:
                    owners[seen] = [own, tokens]
                    packer.add(seen, tokens, max(0, min(loss or 0, tokens)))
                seen += 1
            if rows:
                yield out()
        packer.finish()
        if rows:
            yield out()

    return only(examples, id_col, tokens_col, loss_col).mapInArrow(packed, schema)
