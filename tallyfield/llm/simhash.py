"""SimHash near-duplicates through segment bit counts.

A 64-bit fingerprint is embedded as the bit counts of 32 two-bit segments. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints. The segments form seven blocks; two embeddings at distance 4
or less agree in at least three whole blocks, so each fingerprint enters one grid cell for every choice of three
blocks (its counts there), and only members of one cell are compared: first by Manhattan distance, then exactly.
A cell emits each link once, or a star per group when the cell is large, never all pairs of a large group.

Counts of one are twice as frequent as the others, so the likeliest cells grow with the corpus. A cell that is expected
to hold more than DIVIDE fingerprints is divided before the shuffle: its members go to one part for each of five equal
bit ranges, by their bits there. Two fingerprints within four bits share one of the ranges, so no link is lost, and
members of one cell are divided alike, as the cell alone decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, only, settle, ship

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Two-bit segments in each block; 32 in all.
BLOCKS = (5, 5, 5, 5, 4, 4, 4)
#: Cells up to this size compare members pairwise; larger ones grow groups from seeds.
PAIRWISE = 32
#: Cells beyond this size, expected or real, are first divided by equal bit ranges (start, width) of the fingerprints.
DIVIDE = 20_000
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_STEP = 1 << 16
#: Texts that are sent to Python at once.
TEXTS = 1000

_EVEN = np.uint64(0x5555555555555555)


def _block_masks() -> list[int]:
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << 2 * width) - 1) << at)
        at += 2 * width
    return masks


BLOCK_MASKS = _block_masks()
CHOICES = list(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
CHOICE_MASKS = [sum(BLOCK_MASKS[b] for b in choice) for choice in CHOICES]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, highest first: a bit is set where over half of the shingle hashes have it; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _STEP):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + _STEP], last[at : at + _STEP])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(first)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): one row per document, fp being the fingerprint as a signed long."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=[id_col, "fp"])

    return only(docs, id_col, text_col).mapInArrow(hashed, f"`{id_col}` {id_type}, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its own two bits."""
    return fp - ((fp >> np.uint64(1)) & _EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over segments of the difference of counts (0 to 2 each)."""
    low = _EVEN
    a0, a1, b0, b1 = a & low, (a >> np.uint64(1)) & low, b & low, (b >> np.uint64(1)) & low
    # Counts are 0, 1 or 2, that is (high, low) of 00, 01, 10: they differ by 2 where only the high bits differ.
    high, differ = a1 ^ b1, a0 ^ b0
    return np.bitwise_count(differ | high).astype(np.int64) + np.bitwise_count(high & ~differ)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    near = manhattan(embed(a), embed(b)) <= DISTANCE
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= DISTANCE
    return near


def _stars(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (member, seed) that connect the members of every group among distinct fps."""
    left = np.sort(fps)
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue = [np.array([seed])]
        while queue and len(left):
            for one in queue.pop():
                hit = np.bitwise_count(left ^ one) <= DISTANCE
                if hit.any():
                    new = left[hit]
                    left = left[~hit]
                    queue.append(new)
                    yield new, np.full(len(new), seed)
                if not len(left):
                    break


def _large(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(fps) <= DIVIDE:
        yield from _stars(fps)
        return
    # Of five bit ranges, two fingerprints within four bits share at least one.
    for low, width in RANGES:
        part = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
        order = np.argsort(part, kind="stable")
        for piece in np.split(fps[order], np.flatnonzero(np.diff(part[order])) + 1):
            if len(piece) > 1:
                yield from _stars(piece)


def _cell_links(choice: np.ndarray, cell: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the runs of equal (choice, cell, part)."""
    edge = np.flatnonzero((np.diff(choice) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(fp)])))
    for at, size in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        yield from _large(fp[at : at + size])
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)[small]
    f, c = fp[small], choice[small]
    masks = np.array(BLOCK_MASKS, np.uint64)
    rank = {chosen: i for i, chosen in enumerate(CHOICES)}
    for gap in range(1, min(PAIRWISE, len(f))):
        at = np.flatnonzero(run[gap:] == run[:-gap])
        if not len(at):
            break
        at = at[close(f[at], f[at + gap])]
        if len(at):
            a, b = f[at], f[at + gap]
            same = ((embed(a) ^ embed(b))[:, None] & masks[None, :]) == 0
            first = np.array([rank[tuple(np.flatnonzero(row)[: len(CHOICES[0])].tolist())] for row in same])
            own = first == c[at]  # each pair is reported by the first cell that it shares
            if own.any():
                yield b[own], a[own]


def _parted(distinct: DataFrame, divide: int) -> DataFrame:
    """(choice, cell, part, fp): every fingerprint in its cell of each choice of blocks, or in five parts of a cell that is likely to be large."""
    fp = F.col("fp")
    upper, even = F.shiftrightunsigned(fp, 1), F.lit(int(_EVEN))
    counts = fp.bitwiseXOR(upper).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(even), 1))
    each = enumerate(zip(CHOICES, CHOICE_MASKS))
    cells = F.array(*[F.struct(F.lit(i).alias("choice"), counts.bitwiseAND(F.lit(_signed(m))).alias("cell"), F.lit(2 * sum(BLOCKS[b] for b in chosen)).alias("bits")) for i, (chosen, m) in each])
    placed = distinct.select("fp", F.explode(cells).alias("c")).select("c.*", "fp")
    # A segment counts one with probability 1/2 and none or two with 1/4 each: a cell's share is 2 to the power of minus this.
    rarity = F.col("bits") - F.bit_count(F.col("cell").bitwiseAND(even))
    large = F.lit(float(distinct.count())) / F.pow(F.lit(2.0), rarity) > divide
    parts = [F.lit(k * (1 << 13) + 1) + F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) for k, (low, width) in enumerate(RANGES)]
    part = F.when(large, F.array(*[p.cast("int") for p in parts])).otherwise(F.array(F.lit(0)))
    return placed.select("choice", "cell", F.explode(part).alias("part"), "fp")


def links(distinct: DataFrame, divide: int = DIVIDE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect every two within DISTANCE bits."""
    parted = _parted(distinct, divide).repartition("choice", "cell", "part").sortWithinPartitions("choice", "cell", "part", "fp")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the run that may go on in the next batch

        def out(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _cell_links(*columns):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = (*(batch.column(i).to_numpy() for i in range(3)), batch.column(3).to_numpy().view(np.uint64))
            turn = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in now[:3]]))
            tail = int(turn[-1]) + 1 if len(turn) else 0
            goes_on = bool(held) and all(x[-1] == y[0] for x, y in zip(held[-1][:3], now))
            if held and (tail or not goes_on):
                whole = [np.concatenate(x) for x in zip(*held, *([tuple(x[:tail] for x in now)] if tail else []))]
                yield from out(*whole)
                held = []
            elif tail:
                yield from out(*(x[:tail] for x in now))
            held.append(tuple(x[tail:] for x in now))
        if held:
            yield from out(*[np.concatenate(x) for x in zip(*held)])

    return parted.mapInArrow(joined, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components of (a, b) links by alternating large and small stars.

    Each round is written to the shared folder. Nodes without links do not appear; root is the least node.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = state(edges)
    for _ in range(rounds):
        if not now[0]:
            break
        all_ways = both(edges)
        least = all_ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = all_ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settle(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if now[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Documents whose fingerprints differ in at most four bits are linked, and component_id is the least id that can
    be reached, the document's own included. A null or wordless text has fingerprint zero and links like any other.
    Repeated rows give repeated equal rows. A null id takes no part in the minimum; component_id is null only if all
    ids of the component are null. Whole texts are hashed however long, in steps of bounded size. Other columns are
    ignored whatever their names; an empty table gives no rows.
    """
    with batches_of(docs.sparkSession, TEXTS):
        prints = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("least")), "distinct-fingerprints")
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
