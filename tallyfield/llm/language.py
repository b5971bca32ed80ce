"""Language of texts and of spans within them.

A word's script narrows the candidate languages to those that use it. Each candidate scores the word by its character
n-grams, and a Viterbi pass over the words of a text, which pays a penalty for every switch, labels the spans. The
text's language is the one with most letters in its spans. Most texts are of one language from end to end, which sums
over their words can prove to be the best path; only the others are passed through word by word.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, id_bucket, only, settle, ship, tool

UNKNOWN = "und"
#: Longest character n-gram of a word with its ends marked.
ORDER = 3
#: Cost of changing the language between two words, in nats.
SWITCH = 12.0
#: A language is a candidate for a script in which it has at least this share of its training words.
SCRIPT_SHARE = 0.01
#: Score of a word in a language that is no candidate for its script.
FAR = -50.0
#: Training sample: about so many texts of each language (all, where there are fewer).
SAMPLE = 1500
#: Size of the model: n-grams of each language, the most frequent ones. Languages and scripts are all kept.
FEATURES = 100_000
#: Numbers that the scores of words are summed from at once.
CELLS = 1_000_000
#: What counts as equal in sums over words, for each of them.
NEAR = 1e-6
#: Words whose scores a worker keeps, and scores at most.
KEEP = 200_000
KEEP_SCORES = 20_000_000
#: Characters that are labelled together, fewer where there are more languages than FEW.
GROUP = 6_000_000
FEW = 4
#: Words of them that are held as strings at once (a text at least), and texts that are taken out of a batch at once.
STRINGS = 100_000
TEXTS = 500

_plain_words = re.compile(r"[^\W\d_]+")


def _ranges(keep) -> str:
    """The code points that satisfy keep, as ranges of a character class."""
    out: list[list[int]] = []
    for c in filter(keep, range(0x300, sys.maxunicode + 1)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


#: Combining marks (vowel signs, accents set apart) and the two joiners belong to the word whose letters they follow.
_marks = re.compile(f"[{_ranges(lambda c: unicodedata.category(chr(c))[0] == 'M' or c in (0x200C, 0x200D))}]")
_marked_words = re.compile(rf"[^\W\d_](?:[^\W\d_]|{_marks.pattern})*")


#: From here on there are marks; most texts have no character beyond.
_late = re.compile("[\u0300-\U0010ffff]")


def _pattern(text: str) -> re.Pattern:
    return _plain_words if text.isascii() or not _late.search(text) or not _marks.search(text) else _marked_words


def words_of(text: str) -> list[str]:
    """The words of a lower-cased text: runs of letters with the marks on them."""
    return _pattern(text).findall(text)

#: First code points of Unicode ranges and the script of the letters from there on.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_starts = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def script(word: str) -> str:
    """The script of the word's first letter."""
    return SCRIPTS[bisect.bisect_right(_starts, ord(word[0])) - 1][1]


def script_code(name: str) -> int:
    """A script as a number below 0, which no n-gram has."""
    return -1 - SCRIPT_NAMES.index(name)


def grams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for n in range(1, min(ORDER, len(marked)) + 1) for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """What an absent n-gram scores in each language (a row for each order), what each n-gram adds in the languages that have it, and candidates by script.

    The n-grams stand in order of their codes; those of n-gram i are languages[first[i] : first[i + 1]] of `has`, and
    `adds` of the same places. So the model's size is that of its counts, however many languages there are.
    """

    languages: list[str]
    absent: np.ndarray = field(default_factory=lambda: np.zeros((ORDER + 1, 0)))
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    has: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    adds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))
    candidates: dict[str, np.ndarray] = field(default_factory=dict)
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        """The words' scores in every language; the n-gram orders vote with equal weight."""
        total = np.zeros((len(words), len(self.languages)))
        if not self.languages:
            return total
        step = max(1, CELLS // len(self.languages) // 32)  # words of about ten letters have 32 n-grams
        for i in range(0, len(words), step):
            self._score(words[i : i + step], total[i : i + step])
        return total

    def _score(self, words: list[str], total: np.ndarray) -> None:
        marked = "".join([f"^{w}$" for w in words])
        c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(start + size, size) - np.arange(len(c))  # characters of the word from here on
        code = np.zeros(len(c), np.int64)
        width = len(self.languages)
        for n in range(1, ORDER + 1):
            code[: len(c) - n + 1] = (code[: len(c) - n + 1] << 21) | c[n - 1 :]
            total += np.maximum(size - n + 1, 0)[:, None] * self.absent[n]
            if not len(self.codes):
                continue
            asked, owner = code[left >= n], word[left >= n]
            at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
            known = self.codes[at] == asked
            at, owner = at[known], owner[known]
            many = self.first[at + 1] - self.first[at]
            place = np.arange(int(many.sum())) + np.repeat(self.first[at] - (np.cumsum(many) - many), many)
            cell = np.repeat(owner, many) * width + self.has[place]
            total += np.bincount(cell, weights=self.adds[place], minlength=total.size).reshape(total.shape)
        total /= ORDER
        kinds = np.searchsorted(_starts, c[start + 1], side="right") - 1
        for kind in np.unique(kinds):
            fit, mine = self.candidates.get(SCRIPTS[kind][1]), kinds == kind
            if fit is None:
                total[mine] = 0.0  # a script that was never seen tells nothing
            elif not fit.all():
                total[mine] += np.where(fit, 0.0, FAR)


def gram_code(gram: str) -> int:
    """An n-gram as a number: its code points, of 21 bits each, one after the other."""
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learn from a bounded sample: about per_language whole texts of each language, chosen by a hash of the id.

    Rows without text or language teach nothing; a language is learned however rare it is, unless its texts have no
    word. Each language has its own FEATURES n-grams and all its scripts, so that none starves for another. What reaches the
    driver are these counts as three columns, and the model holds no more: about 20 bytes for each n-gram of a language. Texts are
    taken whole, repeated rows count as often as they occur, rows with a null id as one id. Other columns are ignored
    whatever their names. Without training rows the model knows no language.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    # A row for each language; as a written table its size is known, so that Spark sends it out only where it is small.
    rates = settle(rows.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("rate")), "language-rates")
    sample = rows.join(rates, "lang").where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6) < F.col("rate")).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                words.setdefault(lang, Counter()).update(w for w in words_of(text.lower()) if _marks.sub("", w).isalpha())
            for lang, seen in words.items():
                got: Counter = Counter()
                for w, n in seen.items():
                    got[script_code(script(w))] += n
                    for g in grams(w):
                        got[g] += n
                codes = [g if isinstance(g, int) else gram_code(g) for g in got]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(codes, pa.int64()), pa.array(list(got.values()), pa.int64())], names=["lang", "code", "n"])

    summed = sample.mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", F.col("code") < 0).orderBy(F.desc("n"), "code"))
    with batches_of(docs.sparkSession, TEXTS):
        top = summed.withColumn("rank", rank).where((F.col("code") < 0) | (F.col("rank") <= features)).select("lang", "code", "n").toArrow()
    lang = top["lang"].combine_chunks().dictionary_encode()
    names, own = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], np.int32)
    return _model(languages, place[own] if names else own.astype(np.int32), top["code"].to_numpy(), top["n"].to_numpy())


def _model(languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """The model of counts n of codes in languages; codes below 0 are scripts."""
    is_script = code < 0
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    np.add.at(scripts, (-1 - code[is_script], lang[is_script]), n[is_script])
    code, lang, n = code[~is_script], lang[~is_script], n[~is_script]
    if not len(code):
        return Model([])
    order = np.lexsort((lang, code))
    code, lang, n = code[order], lang[order], n[order]
    codes, first = np.unique(code, return_index=True)
    length = np.searchsorted([1 << 21, 1 << 42], code, side="right") + 1
    total = np.zeros((ORDER + 1, len(languages)))
    np.add.at(total, (length, lang), n)
    kinds = 1 + np.bincount(length[first], minlength=ORDER + 1)
    some = 0.5
    absent = math.log(some) - np.log(total + some * kinds[:, None])
    words = scripts.sum(axis=0)
    fits = {name: own >= SCRIPT_SHARE * np.maximum(words, 1) for name, own in zip(SCRIPT_NAMES, scripts) if own.any()}
    return Model(languages, absent, codes, np.append(first, len(code)), lang.astype(np.int32), np.log((n + some) / some), {s: f for s, f in fits.items() if f.any()})


class Labeller:
    """Labels texts with one model; scores of recent words are kept in a bounded table."""

    def __init__(self, model: Model, keep: int = KEEP):
        self.model, self.keep = model, min(keep, KEEP_SCORES // max(1, len(model.languages)))
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.known = np.zeros(1024, np.int64)

    def _add(self, words: list[str]) -> None:
        start = len(self.rows)
        while start + len(words) > len(self.letters):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
            self.known = np.concatenate((self.known, np.zeros_like(self.known)))
        counts = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words]
        self.letters[start : start + len(words)] = counts
        self.known[start : start + len(words)] = [n if script(w) in self.model.candidates else 0 for n, w in zip(counts, words)]
        self.scores[start : start + len(words)] = self.model.words(words) * (np.array(counts)[:, None] > 0)
        self.rows.update(zip(words, range(start, start + len(words))))

    def _places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The places of the texts' words in the table, which gets those that it lacks."""
        rows = self.rows
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(texts)) if w not in rows]
        if new:
            self._add(new)
        return [np.fromiter(map(rows.__getitem__, words), np.int32, len(words)) for words in texts]

    def paths(self, texts: Iterable[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, given as words: the language of each word on the best path, the words' letters, and those of scripts that the model knows.

        Of all texts only the places of their words are held, as words take 20 times the memory.
        """
        if len(self.rows) > self.keep:
            self._clear()
        index: list[np.ndarray] = []
        for part in _groups(texts, STRINGS):
            index += self._places(part)
        labels = [self._constant(self.scores[i]) for i in index]
        order = sorted((i for i, path in enumerate(labels) if path is None), key=lambda i: -len(index[i]))
        for i, path in zip(order, self._viterbi([self.scores[index[i]] for i in order])):
            labels[i] = path
        return [(path, self.letters[i], self.known[i]) for path, i in zip(labels, index)]

    def _constant(self, scores: np.ndarray) -> np.ndarray | None:
        """The path that stays in one language, where that is sure to be the best one.

        Any other path leaves the language with the greatest sum for runs of words. Each run costs a switch, unless it is
        the whole text in one other language, whose sum is no greater. So if no run of words gains more than a switch
        costs, even with the best other language for every word, nothing is better. NEAR keeps rounding and ties out.
        """
        if len(scores) == 0 or scores.shape[1] == 0:
            return np.zeros(len(scores), np.int16)
        sums = scores.sum(axis=0, dtype=np.float64)
        top = int(sums.argmax())
        if scores.shape[1] > 1:
            others = np.delete(scores, top, axis=1)
            if sums[top] - np.delete(sums, top).max() < NEAR * len(scores):
                return None
            gain = np.cumsum(others.max(axis=1).astype(np.float64) - scores[:, top])
            before = np.minimum.accumulate(np.concatenate(([0.0], gain[:-1])))
            if (gain - before).max() > SWITCH - NEAR * len(scores):
                return None
        return np.full(len(scores), top, np.int16)

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths, all texts advancing together; scores are in falling order of length."""
        lengths = np.array([len(s) for s in scores], np.int64)
        width = len(self.model.languages)
        if not width:
            return [np.zeros(n, np.int16) for n in lengths]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.concatenate(scores) if len(scores) else np.zeros((0, width), np.float32)
        stay = np.zeros((len(flat), width), bool)
        best = np.zeros(len(flat), np.int16)
        longest = int(lengths.max(initial=0))
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
        at, lines = starts[:-1].copy(), np.arange(len(scores))
        value = np.zeros((len(scores), width))
        for t in range(longest):
            n = active[t]
            here = at[:n] + t
            now = value[:n]
            if t:
                top = now.argmax(axis=1)
                turn = now[lines[:n], top] - SWITCH
                keep = now >= turn[:, None]
                stay[here], best[here] = keep, top
                np.maximum(now, turn[:, None], out=now)
            now += flat[here]
        labels = np.zeros(len(flat), np.int16)
        state = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            here, mine = at[:n] + t, state[:n]
            labels[here] = mine
            if t:
                state[:n] = np.where(stay[here, mine], mine, best[here])
        return [labels[a:b] for a, b in zip(starts[:-1], starts[1:])]


def labeller(model: Model) -> Labeller:
    return tool(("labeller", model.token), lambda: Labeller(model))


def _groups(texts: Iterable, limit: int) -> Iterator[list]:
    """Texts, or their words, in lists that together reach the limit."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _verdict(model: Model, path: np.ndarray, letters: np.ndarray, known: np.ndarray) -> tuple[str, float]:
    total = int(letters.sum())
    if not total or not model.languages:
        return UNKNOWN, 0.0
    share = np.bincount(path, weights=known, minlength=len(model.languages))
    top = int(share.argmax())
    return model.languages[top], float(share[top]) / total


def _spans(model: Model, path: np.ndarray, places: list[tuple[int, int]]) -> list[dict]:
    edges = np.flatnonzero(np.diff(path)) + 1
    return [{"lang": model.languages[path[a]], "start": places[a][0], "end": places[b - 1][1]} for a, b in zip([0, *edges], [*edges, len(path)])] if len(path) and model.languages else []


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts of a batch, a null one as empty, TEXTS of them as strings at once."""
    for at in range(0, len(column), TEXTS):
        for text in column.slice(at, TEXTS).to_pylist():
            yield text or ""


def _verdicts(model: Model, column: pa.Array, spans: bool = False) -> Iterator[tuple[str, float, list[dict]]]:
    """Language, score and, on request, spans of every text."""
    known = labeller(model)
    for part in _groups(_texts(column), GROUP * FEW // max(FEW, len(model.languages))):
        places = [[m.span() for m in _pattern(t).finditer(t)] for t in part] if spans else []
        words = ([t[a:b].lower() for a, b in p] for t, p in zip(part, places)) if spans else (words_of(t.lower()) for t in part)
        for i, (path, letters, seen) in enumerate(known.paths(words)):
            yield *_verdict(model, path, letters, seen), _spans(model, path, places[i]) if spans else []


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, lang_pred, score[, spans]) of every whole text, however long.

    score is the share of the text's letters that lie in spans of lang_pred and in a script that training saw: 0 for a text
    wholly in other scripts, which gets the language that sorts first, as nothing tells one. A null text, a text without letters, and any text
    under a model without languages give `und` with score 0. Ties go to the language that sorts first. spans hold
    language, start and end (code points) of each run of words. Repeated rows and null ids give a row each; other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_verdicts(shared.value, batch.column(1), spans))
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            columns += [pa.array([x[2] for x in found], span_type)] if spans else []
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", *["spans"] * spans])

    return only(docs, id_col, text_col).mapInArrow(labelled, schema + ", spans array<struct<lang:string,start:int,end:int>>" * spans)


def with_known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language identify() can tell; the verdict stays beside the row, so nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [lang != UNKNOWN for lang, _, _ in _verdicts(shared.value, batch.column(place))]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def is_held_out(doc_id, folds: int = 5):
    return F.coalesce(id_bucket(doc_id, folds) == 0, F.lit(False))


def predict(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn outside the held-out fold and predict every document: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"), folds)))
    return identify(docs, model).withColumn("held_out", is_held_out(F.col("doc_id"), folds)).select("doc_id", "held_out", "lang_pred", "score")
