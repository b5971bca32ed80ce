import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tallyfield.llm import language, pii, simhash
from tests.llm.test_decontaminate import split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    draw = random.Random(21)
    words = {"aa": [f"tala{i}" for i in range(80)], "bb": [f"gruft{i}o" for i in range(80)]}
    make = lambda g, n: " ".join(draw.choices(words[g], k=n)).replace("0", "x").replace("1", "y")
    items = [(1, " ".join(f"bench{chr(97 + i)}" for i in range(14))), (2, "single")]
    docs = [(i, make("aa" if i % 2 else "bb", draw.randint(30, 80)), "aa" if i % 2 else "bb") for i in range(40)]
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(5)]  # copies
    docs += [(200, docs[7][1] + " " + items[0][1], "aa"), (201, "---", None), (202, None, "aa"), (203, make("bb", 40) + " mail x.1@mail.example.com now", "bb")]
    return [(i, t, g, "s", None if t is None else len(t)) for i, t, g in docs], items


def test_stages_and_run(spark, tmp_path):
    docs, items = fixture()
    d = spark.createDataFrame(docs, SCHEMA)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = d
    expected = {i: t for i, t, *_ in docs}
    kept = []
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == d.columns and at.dtypes == d.dtypes
        rows = at.collect()
        kept.append({r.doc_id: r.text for r in rows})
        assert len(kept[-1]) == len(rows)
        at = spark.createDataFrame(rows, SCHEMA)
    for i in (201, 202):
        expected.pop(i)
    assert kept[0] == expected
    prints = {i: int.from_bytes(simhash.fingerprint(t), "big") for i, t in expected.items()}
    first = {i for i in prints if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE for j in prints)}
    assert kept[1] == {i: expected[i] for i in first} and not {100, 101} & first
    assert set(kept[2]) == {i for i in first if " ".join(split(items[0][1])[:10]) not in " ".join(split(expected[i])) or i != 200} and 200 not in kept[2]
    assert "[EMAIL]" in kept[3][203] and all(pii.base_spans(t) == [] for t in kept[3].values())

    out = P.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in kept[3].items()}
    assert {r.doc_id for r in out} == set(ids)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    assert language.UNKNOWN == "und"


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_verdicts_are_by_row_not_by_id(spark, tmp_path):
    draw = random.Random(3)
    make = lambda n: " ".join(draw.choice("tala bruno sedan kimo"[k : k + 4]).strip() + "".join(draw.choices("abcdefgh", k=5)) for k in draw.choices(range(16), k=n))
    first, second, bench = make(40), make(40), " ".join(f"bench{chr(97 + i)}" for i in range(14))
    alone = [make(40) for _ in range(20)]
    # (1, A), (1, B), (2, B): the second B goes, both rows of id 1 stay; of the null ids only the copy of B goes.
    rows = [(1, first), (1, second), (2, second), (None, second), *((None, t) for t in alone), (None, alone[0]), (3, "---"), (3, make(40)), (4, make(30) + " " + bench), (4, make(40))]
    d = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert held(P.identify_language(spark, d, str(tmp_path))) == sorted((r for r in rows if r[1] != "---"), key=str)
    kept = P.drop_near_duplicates(spark, d, str(tmp_path))
    assert kept.dtypes == d.dtypes
    assert held(kept) == sorted((r for k, r in enumerate(rows) if k not in (2, 3, 24)), key=str)
    assert held(P.drop_benchmark_passages(spark, d, str(tmp_path))) == sorted((r for r in rows if bench not in r[1]), key=str)


def test_extra_columns_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"tala{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, text), (1, text), (2, "bruno " * 9000 + "kimo"), (None, None), (None, "")]
    d = spark.createDataFrame([(i, t, "aa", "s", len(t or ""), 1, 2, 3, 4, 5) for i, t in rows], SCHEMA + ", gone int, row_key int, least int, key int, lang_pred int")
    spark.createDataFrame([(1, "unseen passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == list(P.COLUMNS)
        sizes.append(sorted(((r.doc_id, r.text) for r in out.collect()), key=str))
    lettered = [r for r in rows if r[1]]
    # Two equal rows are one; the null and the empty text form a component, of which the row with the lesser text hash stays.
    assert sizes[0] == sorted(lettered, key=str) and sizes[2] == sizes[3] == sorted(rows, key=str)
    assert len(sizes[1]) == 3 and {r for r in sizes[1] if r[0]} == set(lettered)
    assert {r.doc_id for r in P.pack_sequences(spark, d, str(tmp_path)).collect()} == {1, 2, None}
