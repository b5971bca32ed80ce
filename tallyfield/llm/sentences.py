"""Repeated passages, found as sliding runs of consecutive sentences.

A text is cut into sentences at stops and line ends. A sentence of more than WHOLE words is the exception: it is divided
at its commas, colons, semicolons and bars, and what is still longer after words whose checksum says so, which depends
on the word alone, so that copies of a passage are cut alike wherever they stand. A run starts at every sentence and
takes the fewest that make at least RUN sentences and RUN_WORDS words; the shortest run that ends the text is added. The
first occurrence of a run, by document id, text hash and place, stays; sentences that any other occurrence covers are
removed. Runs are equal if 128 bits of a cryptographic digest of their words are.

Flow: a task digests the runs of a chunk of documents, CHUNK bytes of text at a time, and marks all but the first of runs
that repeat within the chunk. So a run in a third of all documents meets the others once for each chunk, not for each
document. One shuffle by digest ranks the rest by place; what is not first goes back to its document. Chunks are of one
size and rows are in proportion to sentences, so tasks are alike however large the corpus.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

RUN = 3
RUN_WORDS = 30
#: A text of at least so many words that has no run, for lack of sentences, is one run as a whole.
WHOLE_WORDS = 15
#: A sentence of more words is divided at its marks, then after one word in CUT, then after every LONGEST_WORDS-th word (every WHOLE-th if that is more).
WHOLE = 16
CUT = 5
LONGEST_WORDS = 20
#: Bytes of text that are cut at a time, and bytes of a chunk; a longer text goes alone.
STEP = 3_000_000
CHUNK = 16_000_000

_blank = np.zeros(256, bool)
_blank[[*range(9, 14), 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_stops = np.zeros(256, bool)
_stops[list(b".!?")] = True
_marks = np.zeros(256, bool)
_marks[list(b",:;|")] = True


@dataclass
class Parts:
    """The sentences of texts laid end to end: of each text the first sentence (and one past the last), of each sentence its bytes and words."""

    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray  # words before each sentence, and their number
    said: bytes  # all words in lower case, a blank after each
    said_at: np.ndarray  # bytes of said before each sentence, and their number

    def runs(self) -> tuple[np.ndarray, ...]:
        """Of every run the text, its label there, the first sentence and one past the last, in order of text and label.

        A run's label is the place of its first sentence in the text. Where the last run leaves the end of a text out, the
        shortest run that ends there follows, under the number of sentences.
        """
        n = len(self.start)
        last = np.repeat(self.texts[1:], np.diff(self.texts))
        at = np.arange(n)
        end = np.maximum(np.searchsorted(self.words, self.words[:-1] + RUN_WORDS), at + RUN)
        fits = end <= last
        first, stop = self.texts[:-1], self.texts[1:]
        counts = np.concatenate(([0], np.cumsum(fits)))
        none = (counts[stop] == counts[first]) & (self.words[stop] - self.words[first] >= WHOLE_WORDS)
        fits[first[none]], end[first[none]] = True, stop[none]
        at, end = at[fits], end[fits]
        text = np.searchsorted(self.texts, at, side="right") - 1
        final = np.flatnonzero(np.append(np.diff(text) != 0, True)) if len(text) else text
        short = final[end[final] < stop[text[final]]]
        more = text[short]
        begin = np.minimum(np.searchsorted(self.words, self.words[stop[more]] - RUN_WORDS, side="right") - 1, stop[more] - RUN)
        text, at, end, label = (np.concatenate(x) for x in ((text, more), (at, begin), (end, stop[more]), (at - first[text], stop[more] - first[more])))
        order = np.lexsort((label, text))
        return text[order], label[order], at[order], end[order]

    def digests(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128-bit digests of the words of runs, as pairs of 64-bit numbers."""
        said = memoryview(self.said)
        own = [hashlib.blake2b(said[a:b], digest_size=16).digest() for a, b in zip(self.said_at[at].tolist(), self.said_at[end].tolist())]
        return np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)


def _units(stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words, the last of units marked: each word's place in its unit, and the unit's length."""
    opens = np.concatenate(([0], np.flatnonzero(stop[:-1]) + 1))
    sizes = np.diff(np.append(opens, len(stop)))
    return np.arange(len(stop)) - np.repeat(opens, sizes), np.repeat(sizes, sizes)


def cut(data: np.ndarray, offsets: np.ndarray, whole: int = WHOLE, every: int = CUT) -> Parts:
    """The sentences of the texts that stand in data (bytes) between offsets; sentences cover a text that has words."""
    size, texts = len(data), len(offsets) - 1
    inside = ~_blank[data]
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < size]] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    count = len(starts)
    if not count:
        none = np.zeros(0, np.int64)
        return Parts(np.zeros(texts + 1, np.int64), none, none, np.zeros(1, np.int64), b"", np.zeros(1, np.int64))
    # Every word in lower case with one blank: the blank that follows it, or a new one where a text ends with the word.
    lengths = ends - starts
    said_at = np.concatenate(([0], np.cumsum(lengths + 1)))
    kept = inside.copy()
    kept[ends[ends < size]] = True
    closes = (ends == size) | np.append(inside, True)[ends]
    said = np.where(inside, _lower[data], np.uint8(32))[kept]
    said = np.insert(said, said_at[1:][closes] - 1 - np.arange(int(closes.sum())), np.uint8(32)).tobytes()

    per_text = np.searchsorted(starts, offsets)
    stop = _stops[data[ends - 1]]
    stop[per_text[1:][np.diff(per_text) > 0] - 1] = True
    lines = np.searchsorted(starts, np.flatnonzero(data == 10)) - 1
    stop[lines[lines >= 0]] = True
    stop |= _marks[data[ends - 1]] & (_units(stop)[1] > whole)
    long = np.flatnonzero(_units(stop)[1] > whole)
    stop[long] |= np.fromiter((zlib.crc32(said[a:b]) % every == 0 for a, b in zip(said_at[long].tolist(), (said_at[long + 1] - 1).tolist())), bool, len(long))
    most = max(whole, LONGEST_WORDS)
    stop |= _units(stop)[0] % most == most - 1
    opens = np.concatenate(([0], np.flatnonzero(stop[:-1]) + 1))

    of_text = np.searchsorted(opens, per_text)
    start = starts[opens].astype(np.int64)
    heads = of_text[:-1][np.diff(of_text) > 0]
    start[heads] = offsets[:-1][np.diff(of_text) > 0]  # blanks in front belong to the first sentence
    end = np.append(start[1:], 0)
    tails = of_text[1:][np.diff(of_text) > 0] - 1
    end[tails] = offsets[1:][np.diff(of_text) > 0]
    bounds = np.append(opens, count)
    return Parts(of_text, start, end, bounds.astype(np.int64), said, said_at[bounds])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a text column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP bytes; a longer text goes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, side="right")) - 1)
        yield at, min(to, n)
        at = to


def _each(column: pa.Array, whole: int = WHOLE, every: int = CUT) -> Iterator[tuple[int, np.ndarray, np.ndarray, Parts]]:
    """(first text, data, offsets, sentences) of parts of a text column."""
    data, offsets = _bytes(column)
    for a, b in _steps(offsets):
        own = data[offsets[a] : offsets[b]]
        places = offsets[a : b + 1] - offsets[a]
        yield a, own, places, cut(own, places, whole, every)


def sentences(text: str, whole: int = WHOLE, every: int = CUT) -> list[tuple[int, int]]:
    """(start, end) in bytes of the sentences of one text."""
    for _, _, _, parts in _each(pa.array([text]), whole, every):
        return list(zip(parts.start.tolist(), parts.end.tolist()))
    return []


def _runs(docs: DataFrame, id_col: str, text_col: str, whole: int, every: int, chunk_bytes: int) -> DataFrame:
    """(own, h, at, d0, d1, again): the runs of every document, with their digests; again where an earlier document of the chunk has the run."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # In order of id and text, so that the first of equal runs in the chunk is the first by that order; a document once.
            table = pa.table({"id": batch.column(0), "text": batch.column(1), "h": pc.fill_null(batch.column(2), 0)})
            table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("h", "ascending")], null_placement="at_start")).combine_chunks()
            own, h = table["id"].chunk(0) if table["id"].num_chunks else pa.array([], batch.schema.field(0).type), table["h"].to_numpy()
            same_id = np.array(pc.fill_null(pc.equal(own[1:], own[:-1]), False)) | (np.array(own[1:].is_null()) & np.array(own[:-1].is_null()))
            new = np.concatenate(([True], ~(same_id & (h[1:] == h[:-1])))) if len(h) else np.zeros(0, bool)
            table = table.filter(pa.array(new)).combine_chunks()
            found: list[tuple[np.ndarray, ...]] = []
            size = 0
            texts = table["text"].chunk(0) if table["text"].num_chunks else pa.array([], pa.string())
            for a, data, offsets, parts in _each(texts, whole, every):
                doc, label, at, end = parts.runs()
                found.append((doc + a, label, parts.digests(at, end)))
                size += len(data)
                if size >= chunk_bytes or a + len(offsets) - 1 == len(texts):
                    yield chunk(table, *(np.concatenate(x) for x in zip(*found)))
                    size, found = 0, []

    def chunk(docs: pa.Table, doc: np.ndarray, at: np.ndarray, digest: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((digest[:, 1], digest[:, 0]))  # stable: of equal runs the first comes first
        again = np.zeros(len(doc), bool)
        again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]).all(axis=1)
        own = docs.select(["id", "h"]).take(pa.array(doc)).combine_chunks()
        ids, hs = (own[c].chunk(0) if own[c].num_chunks else pa.array([], own.schema.field(c).type) for c in ("id", "h"))
        columns = [ids, hs, pa.array(at.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(again)]
        return pa.RecordBatch.from_arrays(columns, names=["own", "h", "at", "d0", "d1", "again"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(hashed, f"own {kind}, h long, at int, d0 long, d1 long, again boolean")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE, every: int = CUT, chunk_bytes: int = CHUNK) -> DataFrame:
    """(own, h, ats): for each document, by id and hash of its text, the labels of its non-first repeated runs."""
    ship(docs.sparkSession)
    runs = settle(_runs(docs, id_col, text_col, whole, every, chunk_bytes), "sentence-runs")
    place = F.rank().over(Window.partitionBy("d0", "d1").orderBy("own", "h", "at"))
    later = runs.where("not again").select("own", "h", "at", place.alias("place")).where("place > 1").select("own", "h", "at")
    return later.unionByName(runs.where("again").select("own", "h", "at")).groupBy("own", "h").agg(F.collect_set("at").alias("ats"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE, every: int = CUT, chunk_bytes: int = CHUNK) -> DataFrame:
    """(id, text, n_sentences, n_removed, removed): every document without the sentences that others said first.

    Sentences of up to `whole` words are never divided; longer ones after one word in `every`. With whole=0
    and every=3 all are divided, which finds more of a passage that begins and
    ends within sentences, and may leave parts of them. removed lists start:end in code points of the old text,
    neighbours joined. A null text stays null with no sentences. Rows with equal id and text are one document and get equal results; of null ids each text is one.
    Words are told apart by blanks and compared with A-Z lower-cased. Texts with fewer than WHOLE_WORDS words, and
    repeats shorter than a run, stay. Ids may be of any type that Arrow sorts. Texts are taken whole however long, one at a time if need be. Other columns are
    ignored whatever their names; an empty table gives no rows.
    """
    found = repeated_runs(docs, id_col, text_col, whole, every, chunk_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").alias("mine"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("my_h"))
    joined = own.join(found, F.col("mine").eqNullSafe(F.col("own")) & (F.col("my_h") == F.col("h")), "left").select("mine", "text", "ats")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            left, counts, gone_counts, shown = [], [], [], []
            texts = batch.column(1)
            for first, data, offsets, parts in _each(texts, whole, every):
                owner, labels, begin, end = parts.runs()
                of_text = np.searchsorted(owner, np.arange(len(offsets)))
                counts += np.diff(parts.texts).tolist()
                for k in range(len(offsets) - 1):
                    ats = lists[first + k]
                    if not ats:
                        left.append(texts[first + k].as_py())
                        gone_counts.append(0)
                        shown.append("")
                        continue
                    own_first, own_last = int(parts.texts[k]), int(parts.texts[k + 1])
                    place = of_text[k] + np.searchsorted(labels[of_text[k] : of_text[k + 1]], ats)
                    edge = np.zeros(own_last - own_first + 1, np.int64)
                    np.add.at(edge, begin[place] - own_first, 1)
                    np.add.at(edge, end[place] - own_first, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    cuts = [(int(parts.start[own_first + a]), int(parts.end[own_first + b - 1])) for a, b in turns.reshape(-1, 2)]
                    low, high = int(offsets[k]), int(offsets[k + 1])
                    signs = np.concatenate(([0], np.cumsum((data[low:high] & 0xC0) != 0x80)))
                    left.append(b"".join(data[x:y].tobytes() for x, y in zip([low, *(c[1] for c in cuts)], [*(c[0] for c in cuts), high])).decode())
                    gone_counts.append(int(gone.sum()))
                    shown.append(",".join(f"{signs[x - low]}:{signs[y - low]}" for x, y in cuts))
            columns = [pa.array(left, pa.string()), pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "text", "n_sentences", "n_removed", "removed"])

    return joined.mapInArrow(rebuilt, f"`{id_col}` {kind}, text string, n_sentences long, n_removed long, removed string")
