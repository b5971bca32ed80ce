"""Katz backoff language model of word pairs, trained and applied in one pass of the corpus through hash buckets.

P(w | h) = d(r) r / c(h) for a pair seen r > 0 times, and alpha(h) P(w) otherwise; P(w) backs off to the mass of unseen
words in the same way. d are Good-Turing discounts up to LARGEST counts, and alpha(h) is what the discounts free,
divided by what the seen words leave of the lower order, so that every distribution sums to one exactly. Where nothing
is discounted (all counts large), one unseen event is added to the total. The history of a first word is the start.

Flow: documents are encoded in chunks with a dictionary of their own. Distinct words of a chunk go to the bucket of the
word, which counts them over the corpus and answers with ids and counts. Distinct pairs of a chunk go to the bucket of
the history (of the whole pair, for histories with more than a bucket's share of the tokens), which counts them, stores
the table of its pairs, and reduces every document to sums that need only the global discounts. So text is encoded
once, each distinct word and pair of a chunk is sent once, and no key gathers all its occurrences in one task.

save() keeps the counts as tables of words and pairs partitioned by bucket, and the backoff weights of all histories;
evaluate() looks up each distinct pair of any texts in these tables once, and sums what their tokens score.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import id_bucket, settle, ship
from .packed import pack, unpack

#: Largest count that is discounted.
LARGEST = 5
#: Bytes of text in a chunk, and in the share of a bucket; at least so many buckets. Chunks and shares grow together with
#: the square root of the text, so that a message of a chunk to a bucket stands for ROW bytes and their number is linear.
CHUNK = 6_000_000
SHARE = 16_000_000
ROW = 20_000
BUCKETS = 48
START = 0xFFFFFFFF
#: A word that no text holds: the end of a text.
END = b""

ENCODED = "chunk long, bucket int, words binary, counts binary, ids array<{id}>, held array<boolean>, lengths binary, tokens binary, places binary"
ANSWERS = "chunk long, bucket int, word_ids binary, word_counts binary, words binary, stats array<long>"
PAIRS = "chunk long, bucket int, pairs binary, occurrences binary, ids array<{id}>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"
PARTS = "chunk long, bucket int, kind string, whole binary, real binary, stats array<long>, ids array<{id}>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"


def discounts(ones: list[int] | np.ndarray) -> np.ndarray:
    """d(0..LARGEST) from the numbers of types seen 1, 2, ... LARGEST + 1 times; d(0) is 1.

    Where Good-Turing gives nothing strictly between 0 and 1, half a count is taken off.
    """
    n = [0, *map(float, ones)]
    k = LARGEST
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = [1.0]
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LARGEST, d[np.minimum(counts, LARGEST)], 1.0)


class Words:
    """The lowest order: probabilities of words by their training counts; count 0 stands for all unseen words together."""

    def __init__(self, total: int, kinds: int, ones: list[int]):
        self.total, self.kinds, self.d = total, kinds, discounts(ones)
        freed = sum((1 - self.d[r]) * r * ones[r - 1] for r in range(1, LARGEST + 1))
        self.norm = total if freed > 0 else total + 1
        self.unseen = (self.norm - total + freed) / self.norm

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts.astype(np.int64), self.d) / self.norm, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.kinds + 1)))


def freed(small: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Count mass that discounts free, from the numbers of types seen 1 to LARGEST times (last axis)."""
    return (small * ((1 - d[1:]) * np.arange(1, LARGEST + 1))).sum(axis=-1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _encoded(docs: DataFrame, id_col: str, text_col: str, folds: int, buckets: int, chunk_bytes: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(id_bucket(own, folds) == 0, F.lit(False)).alias("held"))

    def chunk_rows(chunk: int, ids: list, held: list[bool], texts: list[str]) -> Iterator[dict]:
        index: dict[bytes, int] = {END: 0}
        add = index.setdefault
        parts = []
        for text in texts:
            parts.append(np.array([*[add(w, len(index)) for w in text.encode().lower().split()], 0], np.uint32))
        lengths = np.array([len(p) for p in parts])
        tokens = np.concatenate(parts)
        train = np.repeat(~np.array(held, bool), lengths)
        rank = np.argsort(-np.bincount(tokens, minlength=len(index)), kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        tokens = place[tokens]
        counts = np.bincount(tokens[train], minlength=len(index))
        listed = list(index)
        words = [listed[i] for i in rank]
        hashed = np.array([xxhash.xxh64_intdigest(w) % buckets for w in words], np.uint32)
        order = np.argsort(hashed, kind="stable")
        edges = np.flatnonzero(np.diff(hashed[order])) + 1
        for part in np.split(order, edges):
            blob = zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[i] for i in part))
            yield {"chunk": chunk, "bucket": int(hashed[part[0]]), "words": blob, "counts": pack(counts[part])}
        yield {"chunk": chunk, "bucket": -1, "ids": ids, "held": held, "lengths": pack(lengths), "tokens": pack(tokens), "places": pack(hashed)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, held, texts, size, schema = [], [], [], 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(list(chunk_rows(chunk, ids, held, texts)), schema)

        for batch in batches:
            id_type = batch.schema.field(0).type
            schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("places", pa.binary())])
            for own, text, out_ in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(own)
                texts.append(text or "")
                held.append(out_)
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield out()
                    chunk, ids, held, texts, size = chunk + 1, [], [], [], 0
        if ids:
            yield out()

    return settle(rows.mapInArrow(encode, ENCODED.format(id=kind)), "encoded", compression="zstd")


def _answers(encoded: DataFrame, buckets: int) -> DataFrame:
    """Ids and corpus counts of each chunk's words, and a row of statistics for each bucket."""

    def count(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        index: dict[bytes, int] = {}
        add = index.setdefault
        places, counts = [], []
        for words, own in zip(table["words"].to_pylist(), table["counts"].to_pylist()):
            places.append(np.array([add(w, len(index)) for w in zstandard.ZstdDecompressor().decompress(words).split(b"\n")], np.int64))
            counts.append(unpack(own)[0])
        if len(index) * buckets >= START:
            raise OverflowError("more distinct words than 32-bit ids")
        total = np.bincount(np.concatenate(places), weights=np.concatenate(counts)).astype(np.int64)
        ones = np.bincount(total[(total > 0) & (total <= LARGEST + 1)], minlength=LARGEST + 2)[1:]
        ends = int(total[index[END]]) if END in index else 0
        rows = [{"chunk": c, "bucket": bucket, "word_ids": pack(p * buckets + bucket), "word_counts": pack(total[p])} for c, p in zip(table["chunk"].to_pylist(), places)]
        listed = zstandard.ZstdCompressor(level=1).compress(b"\n".join(index))
        rows.append({"chunk": -1, "bucket": bucket, "words": listed, "word_counts": pack(total), "stats": [int(total.sum()), int((total > 0).sum()), ends, *map(int, ones)]})
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("word_ids", pa.binary()), ("word_counts", pa.binary()), ("words", pa.binary()), ("stats", pa.list_(pa.int64()))]))

    return settle(encoded.where("bucket >= 0").select("chunk", "bucket", "words", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, ANSWERS), "word-counts", compression="zstd")


def _sums(table: DataFrame) -> list[int]:
    """Element-wise sums of the statistics."""
    rows = table.where("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    return [r["n"] for r in sorted(rows, key=lambda r: r["pos"])]


def _pairs(encoded: DataFrame, answers: DataFrame, words: Words, trained: int, share: int, buckets: int, id_type: str) -> DataFrame:
    """Distinct pairs of each chunk by bucket, and a row with the documents' word scores."""

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        out_schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("occurrences", pa.binary()), ("ids", left.schema.field("ids").type), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))])
        rows = []
        answered = sorted(zip(right["bucket"].to_pylist(), right["word_ids"].to_pylist(), right["word_counts"].to_pylist()))
        for chunk, ids, held, lengths, tokens, places in zip(*(left[c].to_pylist() for c in ("chunk", "ids", "held", "lengths", "tokens", "places"))):
            (lengths,), (tokens,), (places,) = unpack(lengths), unpack(tokens), unpack(places)
            order = np.argsort(places, kind="stable")
            word_ids, counts = np.empty(len(places), np.uint64), np.empty(len(places), np.int64)
            word_ids[order] = np.concatenate([unpack(x[1])[0] for x in answered])
            counts[order] = np.concatenate([unpack(x[2])[0] for x in answered])
            doc = np.repeat(np.arange(len(lengths)), lengths)
            first = np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64)))
            c = counts[tokens]
            base = np.bincount(doc, weights=words.base(c), minlength=len(lengths))
            known = np.bincount(doc, weights=c > 0, minlength=len(lengths))
            w = word_ids[tokens]
            h, ch = np.empty_like(w), np.empty_like(c)
            h[1:], ch[1:] = w[:-1], c[:-1]
            h[first], ch[first] = START, trained
            key = h << np.uint64(32) | w
            bucket = (np.where(ch > share, _mix(key), _mix(h)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(key, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            train = np.repeat(~np.array(held, bool), lengths)[order]
            key, bucket, c, ch, doc = key[order], bucket[order], c[order], ch[order], doc[order]
            start = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(bucket) != 0)) + 1))
            times = np.diff(np.concatenate((start, [len(key)])))
            seen = np.add.reduceat(train.astype(np.int64), start)
            owner = bucket[start]
            for lo, hi in zip(*_runs(owner)):
                a, b = start[lo], start[hi] if hi < len(start) else len(key)
                u = key[start[lo:hi]]
                hs = (u >> np.uint64(32)).astype(np.int64)
                step = np.diff(hs, prepend=0)
                pairs = pack(step, u & np.uint64(START), c[start[lo:hi]], ch[start[lo:hi]], times[lo:hi], seen[lo:hi])
                rows.append({"chunk": chunk, "bucket": int(owner[lo]), "pairs": pairs, "occurrences": pack(doc[a:b])})
            rows.append({"chunk": chunk, "bucket": -1 - chunk % buckets, "ids": ids, "held": held, "n_tokens": lengths.tolist(), "n_known": known.astype(int).tolist(), "base": base.tolist()})
        return pa.Table.from_pylist(rows, out_schema)

    docs = encoded.where("bucket < 0").select("chunk", "ids", "held", "lengths", "tokens", "places")
    asked = answers.where("chunk >= 0").select("chunk", "bucket", "word_ids", "word_counts")
    return docs.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(build, PAIRS.format(id=id_type))


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    edges = (np.flatnonzero(np.diff(x)) + 1).tolist()
    return [0, *edges] if len(x) else [], [*edges, len(x)] if len(x) else []


def _reduced(pairs: DataFrame, words: Words, share: int, buckets: int, id_type: str) -> DataFrame:
    """Counts of pairs by bucket (kind table), their statistics, and each document's sums (kinds below).

    sums: documents, log10 of the undiscounted part, and tokens by count 1 to LARGEST.
    left: tokens of unseen pairs with a known history, and those histories.
    far: the same for histories that are spread over buckets; stiff: their tokens seen more than LARGEST times where
    no type in the bucket is seen less; spread: the bucket's share in them.
    """

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.string()), ("whole", pa.binary()), ("real", pa.binary()), ("stats", pa.list_(pa.int64())), *[(n, table.schema.field(n).type) for n in ("ids", "held", "n_tokens", "n_known", "base")]])
        if bucket < 0:
            rows = table.select(["chunk", "bucket", "ids", "held", "n_tokens", "n_known", "base"]).to_pylist()
            return pa.Table.from_pylist([r | {"kind": "docs"} for r in rows], schema)
        rows: list[dict] = []
        chunks = table["chunk"].to_pylist()
        got = [unpack(p) for p in table["pairs"].to_pylist()]
        sizes = [len(g[0]) for g in got]
        h = np.concatenate([np.cumsum(g[0].astype(np.uint32), dtype=np.uint32) for g in got]).astype(np.uint64)
        w, c, ch, times, seen = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(1, 6))
        del got
        key, inverse = np.unique(h << np.uint64(32) | w.astype(np.uint64), return_inverse=True)
        r = np.bincount(inverse, weights=seen).astype(np.int64)
        one = np.empty(len(key), np.int64)
        one[inverse] = np.arange(len(inverse))  # an entry that shows each pair
        kh, kc, kp = (key >> np.uint64(32)).astype(np.int64), ch[one], words.p(c[one])
        lo, hi = _runs(kh)
        lo = np.array(lo)
        small = np.stack([np.add.reduceat((r == k).astype(np.int64), lo) for k in range(1, LARGEST + 1)], axis=1)
        taken = np.add.reduceat(np.where(r > 0, kp, 0.0), lo)
        total = kc[lo]
        spread = total > share
        stiff = small.sum(axis=1) == 0
        norm = np.where(stiff & ~spread, total + 1, total)
        of = np.repeat(np.arange(len(lo)), np.array(hi) - lo)  # history of each pair
        keep = r > 0
        rows.append({"chunk": -1, "bucket": bucket, "kind": "table", "whole": pack(kh[keep], key[keep] & np.uint64(START), r[keep])})
        ones = np.bincount(r[(r > 0) & (r <= LARGEST + 1)], minlength=LARGEST + 2)[1:]
        rows.append({"chunk": -1, "bucket": bucket, "kind": "stats", "stats": [int(keep.sum()), *map(int, ones)]})
        if spread.any():
            rows.append({"chunk": -1, "bucket": bucket, "kind": "spread", "whole": pack(kh[lo][spread], total[spread], *small[spread].T), "real": taken[spread].tobytes()})
        with np.errstate(divide="ignore"):
            known = np.where(keep, np.log10(np.maximum(r, 1)) - np.log10(np.maximum(norm[of], 1)), np.log10(kp))
        at = 0
        for chunk, size, occurrences in zip(chunks, sizes, table["occurrences"].to_pylist()):
            pair = np.repeat(inverse[at : at + size], times[at : at + size])
            at += size
            (doc,) = unpack(occurrences)
            docs, slot = np.unique(doc, return_inverse=True)
            score = np.bincount(slot, weights=known[pair])
            by = np.zeros((len(docs), LARGEST + 1), np.int64)
            np.add.at(by, (slot, np.where(r[pair] <= LARGEST, r[pair], 0)), 1)
            rows.append({"chunk": chunk, "bucket": bucket, "kind": "sums", "whole": pack(docs, *by.T[1:]), "real": score.tobytes()})
            past = of[pair]
            unseen = ~keep[pair] & (total[past] > 0)
            near = unseen & ~spread[past]
            if near.any():
                needed, place = np.unique(past[near], return_inverse=True)
                rows.append({"chunk": chunk, "bucket": bucket, "kind": "left", "whole": pack(doc[near], place, total[needed], norm[needed], *small[needed].T), "real": taken[needed].tobytes()})
            for kind, chosen in (("far", unseen & spread[past]), ("stiff", keep[pair] & spread[past] & stiff[past])):
                if chosen.any():
                    rows.append({"chunk": chunk, "bucket": bucket, "kind": kind, "whole": pack(doc[chosen], kh[lo][past[chosen]])})
        return pa.Table.from_pylist(rows, schema)

    return settle(pairs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, PARTS.format(id=id_type)), "pair-counts", compression="zstd")


def _spread_histories(parts: DataFrame, d: np.ndarray) -> DataFrame:
    """(h, far, shift): of each history spread over buckets the log of its backoff weight, and what its seen pairs lose where nothing is discounted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, real in zip(*(c.to_pylist() for c in batch.columns)):
                h, total, *small = unpack(whole)
                columns = [pa.array(x.astype(np.int64)) for x in (h, total, *small)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.frombuffer(real, float))], names=["h", "total", *counts, "taken"])

    counts = [f"n{i}" for i in range(1, LARGEST + 1)]
    found = parts.where("kind = 'spread'").select("whole", "real").mapInArrow(rows, "h long, total long, " + ", ".join(f"{n} long" for n in counts) + ", taken double")
    one = found.groupBy("h").agg(F.max("total").alias("total"), *[F.sum(n).alias(n) for n in counts], F.sum("taken").alias("taken"))
    norm = F.when(sum((F.col(n) for n in counts), F.lit(0)) > 0, F.col("total")).otherwise(F.col("total") + 1)
    loose = sum((F.col(n) * float((1 - d[i]) * i) for i, n in enumerate(counts, 1)), F.lit(0.0))
    far = F.log10((norm - F.col("total") + loose) / norm) - F.log10(1 - F.col("taken"))
    return one.select("h", far.alias("far"), (F.log10("total") - F.log10(norm)).alias("shift"))


def _log_alpha(total: np.ndarray, norm: np.ndarray, small: np.ndarray, taken: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of the backoff weight: what is free of the history's mass over what the seen words leave of the lower order."""
    return np.log10((norm - total + freed(small, d)) / norm) - np.log10(1 - taken)


SCORED = "chunk long, kind string, docs binary, hs binary, scores binary"


def _of_chunks(parts: DataFrame, spread: DataFrame) -> DataFrame:
    """(chunk, kind, docs, hs, scores): for each chunk the values of the spread histories that it meets, as a row of kind values."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(chunk, np.unique(unpack(whole)[1]).astype(np.int64)) for chunk, whole in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([c for c, _ in got], [len(h) for _, h in got]), pa.int64()), pa.array(np.concatenate([h for _, h in got]) if got else [], pa.int64())], names=["chunk", "h"])

    met = parts.where("kind in ('far', 'stiff')").select("chunk", "whole").mapInArrow(asked, "chunk long, h long").distinct().join(spread, "h")
    lists = met.groupBy("chunk").agg(F.collect_list(F.struct("h", "far", "shift")).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, v in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.array([(x["far"], x["shift"]) for x in v], float)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array(["values"]), pa.nulls(1, pa.binary()), pa.array([pack(np.array([x["h"] for x in v]))]), pa.array([values.tobytes()])], names=["chunk", "kind", "docs", "hs", "scores"])

    return lists.mapInArrow(packed, SCORED)


def _final(parts: DataFrame, d: np.ndarray, train_tokens: int, id_col: str, id_type: str) -> DataFrame:
    log_d = np.log10(d[1:])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, kind, whole, real in zip(*(c.to_pylist() for c in batch.columns)):
                x = [a.astype(np.int64) for a in unpack(whole)]
                if kind in ("far", "stiff"):
                    out.append((chunk, kind, pack(x[0]), pack(x[1]), None))
                    continue
                if kind == "sums":
                    doc, score = x[0], np.frombuffer(real, float) + np.stack(x[1:], axis=1) @ log_d
                else:
                    alpha = _log_alpha(x[2], x[3], np.stack(x[4:], axis=1), np.frombuffer(real, float), d)
                    doc, score = x[0], alpha[x[1]]
                docs, slot = np.unique(doc, return_inverse=True)
                out.append((chunk, "sums", pack(docs), None, np.bincount(slot, weights=score).tobytes()))
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["chunk", "kind", "docs", "hs", "scores"])

    def combine(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        score = np.zeros(len(row["ids"]))
        known, values = np.zeros(0, np.int64), np.zeros((0, 2))
        rows = right.to_pylist()
        for r in rows:
            if r["kind"] == "values":
                known, values = unpack(r["hs"])[0].astype(np.int64), np.frombuffer(r["scores"], float).reshape(-1, 2)
        order = np.argsort(known)
        known, values = known[order], values[order]
        for r in rows:
            if r["kind"] == "sums":
                score[unpack(r["docs"])[0].astype(np.int64)] += np.frombuffer(r["scores"], float)
            elif r["kind"] != "values":
                own = values[np.searchsorted(known, unpack(r["hs"])[0].astype(np.int64)), 0 if r["kind"] == "far" else 1]
                np.add.at(score, unpack(r["docs"])[0].astype(np.int64), own)
        n = len(score)
        return pa.Table.from_arrays(
            [pa.array(row["ids"], left.schema.field("ids").type.value_type), pa.array(row["held"]), pa.array(row["n_tokens"], pa.int64()), pa.array(row["n_known"], pa.int64()), pa.array([train_tokens] * n, pa.int64()), pa.array(row["base"], pa.float64()), pa.array(score)],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    scored = parts.where("kind in ('sums', 'left', 'far', 'stiff')").select("chunk", "kind", "whole", "real").mapInArrow(evaluate, SCORED)
    scored = scored.unionByName(_of_chunks(parts, _spread_histories(parts, d)))
    docs = parts.where("kind = 'docs'").select("chunk", "ids", "held", "n_tokens", "n_known", "base")
    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(combine, schema)


@dataclass
class Trained:
    """What one pass over the training documents leaves: written parts, the words' order, and the discounts of pairs."""

    answers: DataFrame
    parts: DataFrame
    words: Words
    discounts: np.ndarray
    documents: int
    buckets: int


def _trained(docs: DataFrame, id_col: str, text_col: str, folds: int, share_bytes: int, least_buckets: int) -> Trained:
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    even = math.isqrt(size * ROW)
    buckets = max(least_buckets, -(-size // max(share_bytes, even)))
    encoded = _encoded(docs, id_col, text_col, folds, buckets, max(CHUNK, even))
    answers = _answers(encoded, buckets)
    total, kinds, trained, *ones = _sums(answers) or [0] * (LARGEST + 4)
    words = Words(total, kinds, ones)
    share = max(1, total // (4 * buckets))
    parts = _reduced(_pairs(encoded, answers, words, trained, share, buckets, id_type), words, share, buckets, id_type)
    return Trained(answers, parts, words, discounts((_sums(parts) or [0] * (LARGEST + 2))[1:]), trained, buckets)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, share_bytes: int = SHARE, least_buckets: int = BUCKETS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text, in log10.

    The model learns from the documents outside the held-out fold. A null text is empty and has one token, the end; a
    null id is never held out. Repeated rows are documents of their own. Without training documents all unseen mass is
    one and scores are 0. Texts are taken whole, the longest as a chunk of its own. Other columns are ignored whatever
    their names; an empty table gives no rows.
    """
    own = _trained(docs, id_col, text_col, folds, share_bytes, least_buckets)
    return _final(own.parts, own.discounts, own.words.total, id_col, docs.schema[id_col].dataType.simpleString())


# The stored model.

WORDS, FOLLOWED, HISTORIES = "word string, id long, n long, bucket int", "h long, w long, n long, bucket int", "h long, norm long, log_alpha double, bucket int"


def _kept(n: Column, by: list[float]) -> Column:
    """What the discounts leave of counts."""
    return n * F.when(n <= LARGEST, F.get(F.array(*map(F.lit, by)), n.cast("int"))).otherwise(1.0)


def _histories(words: DataFrame, pairs: DataFrame, model: Row, buckets: int) -> DataFrame:
    """(h, norm, log_alpha, bucket) of every history that training words follow."""
    p = _kept(F.col("n"), model["word_discounts"]) / model["norm"]
    seen = pairs.join(words.select(F.col("id").alias("w"), p.alias("p")), "w").groupBy("h").agg(F.sum("n").alias("times"), F.sum("p").alias("taken"), F.sum(F.col("n") - _kept(F.col("n"), model["pair_discounts"])).alias("freed"), F.count_if(F.col("n") <= LARGEST).alias("small"))
    norm = F.col("times") + F.when(F.col("small") == 0, 1).otherwise(0)
    alpha = F.log10((norm - F.col("times") + F.col("freed")) / norm) - F.log10(1 - F.col("taken"))
    return seen.select("h", norm.alias("norm"), alpha.alias("log_alpha"), (F.col("h") % buckets).cast("int").alias("bucket"))


def save(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, share_bytes: int = SHARE, least_buckets: int = BUCKETS) -> None:
    """Write the model of the documents outside the held-out fold: words (word, id, n), pairs (h, w, n) and histories (h, norm, log_alpha), partitioned by bucket, and a row of totals.

    Words that only held-out documents have, and pairs likewise, are not in it. An empty table gives empty tables. A
    folder that holds a model already is an error.
    """
    spark = docs.sparkSession
    own = _trained(docs, id_col, text_col, folds, share_bytes, least_buckets)
    buckets = own.buckets

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n = unpack(counts)[0].astype(np.int64)
                texts = zstandard.ZstdDecompressor().decompress(words).decode().split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), bucket, np.int32)), pa.array(texts, pa.string()), pa.array(np.arange(len(n)) * buckets + bucket), pa.array(n)], names=["bucket", "word", "id", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, whole in zip(*(c.to_pylist() for c in batch.columns)):
                h, w, n = (pa.array(x.astype(np.int64)) for x in unpack(whole))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), bucket, np.int32)), h, w, n], names=["bucket", "h", "w", "n"])

    words = own.answers.where("words is not null").select("bucket", "words", "word_counts").mapInArrow(listed, "bucket int, word string, id long, n long").where("n > 0")
    words.write.partitionBy("bucket").parquet(f"{path}/words")
    table = own.parts.where("kind = 'table'").select("bucket", "whole").mapInArrow(pairs, "bucket int, h long, w long, n long")
    table.write.partitionBy("bucket").parquet(f"{path}/pairs")
    row = (own.words.total, own.words.kinds, own.documents, [float(x) for x in own.words.d], float(own.words.norm), float(own.words.unseen), [float(x) for x in own.discounts])
    spark.createDataFrame([row], "total long, kinds long, documents long, word_discounts array<double>, norm double, unseen double, pair_discounts array<double>").write.parquet(f"{path}/model")
    model = spark.read.parquet(f"{path}/model").first()
    stored = [spark.read.schema(t).parquet(f"{path}/{name}") for name, t in (("words", WORDS), ("pairs", FOLLOWED))]
    _histories(*stored, model, buckets).write.partitionBy("bucket").parquet(f"{path}/histories")


def evaluate(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of texts under a model that save() wrote: for each token its pair's own estimate, or else the history's backoff weight times the word's.

    Null texts are empty, repeated rows and null ids give a row each, other columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.read.parquet(f"{path}/model").first()
    # With their schemas, so that tables without rows can be read too.
    words, pairs, histories = (spark.read.schema(t).parquet(f"{path}/{name}").drop("bucket") for name, t in (("words", WORDS), ("pairs", FOLLOWED), ("histories", HISTORIES)))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    said = F.concat(F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), ""), F.array(F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("own"), said.alias("said"))
    # Rows are told apart by a number, which is written so that it stays the same wherever a task runs again.
    rows = settle(rows, "said")
    # The word before each word; the first has none, which stands for the start.
    placed = rows.select("row", F.posexplode(F.arrays_zip(F.col("said").alias("word"), F.concat(F.array(F.lit(None).cast("string")), F.col("said")).alias("before"))).alias("at", "t")).where("t.word is not null")
    placed = placed.select("row", "t.word", "t.before")
    # Each distinct pair is looked up once, so that no frequent word meets the tables for all its tokens.
    ids = words.select(F.col("word").alias("before"), F.col("id").alias("h"))
    asked = placed.select("before", "word").distinct().join(words.select("word", F.col("id").alias("w"), "n"), "word", "left").join(ids, "before", "left")
    asked = asked.withColumn("h", F.when(F.col("before").isNull(), F.lit(START)).otherwise(F.col("h")))
    met = asked.join(pairs.select("h", "w", F.col("n").alias("r")), ["h", "w"], "left").join(histories, "h", "left")
    p = F.coalesce(_kept(F.col("n"), model["word_discounts"]) / model["norm"], F.lit(model["unseen"]))
    own = F.when(F.col("r").isNotNull(), F.log10(_kept(F.col("r"), model["pair_discounts"]) / F.col("norm"))).when(F.col("norm").isNotNull(), F.col("log_alpha") + F.log10(p)).otherwise(F.log10(p))
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (model["total"] + 0.1 * (model["kinds"] + 1)))
    scored = met.select(F.col("before").alias("h_said"), F.col("word").alias("said"), F.col("n").isNotNull().alias("known"), base.alias("base"), own.alias("score"))
    found = placed.join(scored, F.col("before").eqNullSafe(F.col("h_said")) & (F.col("word") == F.col("said")))
    sums = found.groupBy("row").agg(F.count("*").alias("n_tokens"), F.count_if("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return rows.select("row", "own").join(sums, "row").select(F.col("own").alias(id_col), "n_tokens", "n_known", "base_score", "score")
