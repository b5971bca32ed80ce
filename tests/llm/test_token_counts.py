import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm import token_counts
from tallyfield.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁x ▁", "line\nnext\n\n  x", "<s> </s> <unk>", "日本 語 テスト", "é ́x", "tab\tx", "a" * 3000, "x " * 5000, "\x00a  b"]


def want(texts):
    return [len(x) for x in MODEL.encode(texts)]


def test_units_add_up():
    assert Counter(PATH).count(ODD) == want(ODD)
    small = Counter(PATH, keep=3)
    assert [small.count([t])[0] for t in ODD * 2] == want(ODD * 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" ab▁\n.é<s>語\t")), max_size=30), max_size=5))
def test_any_text(texts):
    assert Counter(PATH, keep=10).count(texts) == want(texts)


def test_rows(spark):
    rows = [(i, t, "z") for i, t in enumerate(ODD)] + [(3, "a", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(count_tokens(df, PATH, limit=4).collect(), key=str)
    text = [t or "" for _, t, _ in rows]
    assert got == sorted([(r[0], len(t.encode()), n, n > 4) for r, t, n in zip(rows, text, want(text))], key=str)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_batches_are_balanced_by_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 30)
    texts = ["語" * 9, "a" * 20, "é" * 5, "x" * 100, "", "b" * 10]
    parts = list(token_counts._balanced(texts, [len(t.encode()) for t in texts]))
    assert [t for p in parts for t in p] == texts
    assert [sum(len(t.encode()) for t in p) for p in parts] == [27, 30, 100, 10]
