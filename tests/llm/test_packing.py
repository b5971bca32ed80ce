import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyfield.llm.packing import Limits, Packer, WordIds, pack_documents, pack_examples

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", " ", "It's we'll !'s 'tis", "Élan ÑANDÚ ß ÿ", "<|startoftext|> a<|endoftext|>b", "日本 é ́x İ Σας", "a b c\x1cd\x85e", "12345 x9y ²½", "z" * 2000, "a_b-c*** d### !!", "×÷ µª", "\x00 \x7f"]


def want(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    codes = WordIds(PATH, keep=20)
    for text in ODD + ODD:
        assert np.frombuffer(codes.ids(text), "<u4").tolist() == want(text), text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abS'tlÉß ñ.,!<|>\ń Σ9²")), max_size=25))
def test_ids_of_any_text(text):
    assert np.frombuffer(WordIdsOnce.ids(text), "<u4").tolist() == want(text)


WordIdsOnce = WordIds(PATH, keep=50)


def check_pieces(rows, limits, totals):
    """rows: (key, start, length, sequence, offset)"""
    by_key, by_seq = defaultdict(list), defaultdict(list)
    for key, start, length, seq, offset in rows:
        assert length > 0
        by_key[key].append((start, length))
        by_seq[seq].append((offset, length))
    assert set(by_key) == {k for k, n in totals.items() if n}
    for key, parts in by_key.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == totals[key]
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 700), st.integers(0, 700)), max_size=80), st.integers(1, 5), st.integers(20, 128))
def test_limits_hold(items, segments, loss):
    limits = Limits(128, segments, loss)
    rows, bearing = [], []
    def done(pieces, seq=[0]):  # noqa: B006
        offset = 0
        for p in pieces:
            rows.append((p.key, p.start, p.length, seq[0], offset))
            offset += p.length
        bearing.append(sum(p.bearing() for p in pieces))
        seq[0] += 1
    packer = Packer(limits, done)
    for i, (n, l) in enumerate(items):
        packer.add(i, n, min(n, l))
    packer.finish()
    assert check_pieces(rows, limits, {i: n for i, (n, _) in enumerate(items)}) == 0
    assert max(bearing, default=0) <= loss


def plain_sequences(items, limits):
    """(key, start, end) by sequence, from the rule: whole examples by dot product, else the best start; short sequences cut to a power of two."""
    pending = [[k, 0, n, n - l] for k, n, l in items if n]  # key, start, end, tokens without loss at the start
    full = (limits.tokens, limits.segments, limits.loss)
    free = lambda p: max(0, p[3] - p[1])
    demand = lambda p, n: (n, 1, max(0, n - free(p)))
    mean = [sum(demand(p, p[2] - p[1])[d] for p in pending) / len(pending) / full[d] for d in range(3)] if pending else []
    out = []
    while pending:
        left, taken = list(full), []
        while left[0] and left[1] and len(taken) < len(pending):
            best = None
            for at, p in enumerate(pending):
                if any(at == t for t, _ in taken):
                    continue
                head = min(p[2] - p[1], left[0], free(p) + left[2])
                gain = sum(demand(p, head)[d] / full[d] * mean[d] * left[d] / full[d] for d in range(3))
                key = (head == p[2] - p[1], round(gain, 12))
                if head and (best is None or key > best[0]):
                    best = (key, at, head)
            if best is None:
                break
            _, at, head = best
            left = [a - b for a, b in zip(left, demand(pending[at], head))]
            taken.append((at, head))
        total = sum(n for _, n in taken)
        over = 0 if total == limits.tokens else total - (1 << total.bit_length() - 1)
        while over:
            at, n = taken.pop()
            if n > over:
                taken.append((at, n - over))
            over = max(0, over - n)
        out.append([(pending[at][0], pending[at][1], pending[at][1] + n) for at, n in taken])
        for at, n in taken:
            pending[at][1] += n
        pending = [p for p in pending if p[1] < p[2]]
    return out


def test_choice_equals_the_rule():
    draw = random.Random(12)
    bound = [0, 0, 0]
    for _ in range(60):
        limits = Limits(64, draw.choice([3, 5, 64]), draw.choice([40, 56, 64]))
        items = [(k, n, draw.randint(0, n)) for k, n in enumerate(draw.randint(1, 63) for _ in range(draw.randint(1, 30)))]
        got = []
        packer = Packer(limits, lambda pieces: got.append([(p.key, p.start, p.end) for p in pieces]))  # noqa: B023
        for k, n, l in items:
            packer.add(k, n, l)
        packer.finish()
        assert got == plain_sequences(items, limits)
        loss = {k: n - l for k, n, l in items}
        for seq in got:
            used = [sum(b - a for _, a, b in seq), len(seq), sum(max(0, b - max(a, loss[k])) for k, a, b in seq)]
            bound = [x + (u == f) for x, u, f in zip(bound, used, (limits.tokens, limits.segments, limits.loss))]
    assert min(bound) > 10, bound  # every limit binds somewhere


def test_all_limits_bind_on_documents(spark):
    draw = random.Random(5)
    texts = ["word " * draw.choice([3, 5, 8, 300]) for _ in range(2000)] + ["many words " * draw.randint(800, 4000) for _ in range(120)]
    got = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), PATH).collect()
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        by[r.sequence_id] = [x + y for x, y in zip(by[r.sequence_id], (r.length, 1, r.loss))]
    full = [sum(v[d] == f for v in by.values()) for d, f in enumerate((2048, 16, 1792))]
    assert all(v[0] <= 2048 and v[1] <= 16 and v[2] <= 1792 for v in by.values()) and min(full) > 3, full
    assert sum(r.loss for r in got) == sum(n - n // 4 for n in {r.doc_id: r.doc_tokens for r in got}.values())


def test_documents(spark):
    draw = random.Random(1)
    texts = [None, "", *ODD, "word " * 9000] + [" ".join(draw.choices(["alpha", "beta", "gamma.", "Été"], k=draw.randint(1, 900))) for _ in range(300)]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3), PATH).collect()
    ids = {i: want(t or "") + [1] for i, t, _ in rows}
    assert check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], Limits(), {i: len(x) for i, x in ids.items()}) == 0
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
    twice = spark.createDataFrame([(7, "a"), (7, "a"), (None, "a")], "doc_id long, text string")
    assert pack_documents(twice, PATH).count() == 3
    assert pack_documents(twice.limit(0), PATH).count() == 0


def test_examples(spark):
    draw = random.Random(3)
    items = [(i, draw.randint(0, 900), draw.randint(0, 500)) for i in range(800)] + [(900, None, None)]
    limits = Limits(512, 6, 300)
    got = pack_examples(spark.createDataFrame(items, "id int, n int, l int").repartition(2), "id", "n", "l", limits).collect()
    assert check_pieces([(r.id, r.start, r.length, r.sequence_id, r.offset) for r in got], limits, {i: n or 0 for i, n, _ in items}) == 0
    loss = defaultdict(int)
    for r in got:
        loss[r.sequence_id] += r.loss
    assert max(loss.values()) <= 300
    assert sum(r.loss for r in got) == sum(min(n or 0, l or 0) for _, n, l in items)
