"""Language identification of mixed texts: script ranges, word scores and Viterbi spans.

A word is a run of letters. Its script, by Unicode ranges, narrows the languages to those that
use the script; each of them scores the word by its letter trigrams. Viterbi over the words of
a text, with a penalty for every switch of language, labels spans; the language of the text is
the one with the most letters in its spans, and its score is that share.

The model is fitted on a bounded sample of the labelled documents: about ``SAMPLE`` texts a
language, chosen by a hash of id and text, and at most ``GRAMS`` trigrams a language; so what is
broadcast has a fixed bound. Every document is labelled over its whole text, in one narrow pass;
the Viterbi steps of a batch run side by side.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled
text everything is; ties go to the language that sorts first; null languages are not learned;
null or repeated ids and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 3000
GRAMS = 20_000
SWITCH_PENALTY = 12.0
SCRIPT_SHARE = 0.01
CACHE_WORDS = 500_000
TEXTS = 1000
UNKNOWN = "und"



def _category(*kinds: str) -> str:
    """A pattern's class of the characters of some general categories, as ranges."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
    ends = [i for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(starts, ends, strict=True))


#: Words: a letter, then letters and the marks that belong to them. Signs that only count as letters, such as ½ or Ⅳ, are none.
_WORDS = re.compile(f"[{_category('L')}][{_category('L', 'M')}]*")

# First code points of Unicode ranges and the scripts they belong to.
RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = [a for a, _ in RANGES]


def script_of(word: str) -> str:
    return RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, kind, gram or script, n) of the partition's texts."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(_WORDS.findall(text.lower()))
    for lang, seen in words.items():
        grams, scripts = Counter(), Counter()
        for word, n in seen.items():
            scripts[script_of(word)] += n
            for g in grams_of(word):
                grams[g] += n
        rows = [("gram", g, n) for g, n in grams.items()] + [("script", s, n) for s, n in scripts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())],
            ["lang", "kind", "item", "n"],
        )


def fit(docs: DataFrame, learn: Column, lang: str = "lang", id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE, grams: int = GRAMS) -> DataFrame:
    """The model's rows (lang, kind, item, n), at most ``grams`` trigrams a language."""
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("t"), F.pmod(F.xxhash64(id_col, text), F.lit(1_000_000)).alias("u")
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    share = {r.lang: min(1.0, sample / r.total) for r in sizes.collect()}  # a row a language
    if not share:
        return known.select("lang", F.lit("").alias("kind"), F.lit("").alias("item"), F.lit(0).cast("long").alias("n")).limit(0)
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(v * 1_000_000))) for k, v in sorted(share.items())])
    counted = (
        known.filter(F.col("u") < limit)
        .select("lang", "t")
        .mapInArrow(_counts, "lang string, kind string, item string, n long")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n"))
    )
    ranked = counted.groupBy("lang", "kind").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "item")), asc=False), 1, grams).alias("top"), F.sum("n").alias("total")
    )  # distinct trigrams of a bounded sample
    return ranked.select("lang", "kind", F.explode("top").alias("x")).select("lang", "kind", "x.item", "x.n")


class Model:
    """Trigram scores and scripts of the learned languages, with a bounded cache of word scores."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        items = sorted({r[2] for r in rows if r[1] == "gram"})
        self.grams = {g: i for i, g in enumerate(items)}
        counts = np.zeros((len(items) + 1, len(self.langs)))
        scripts: dict[str, np.ndarray] = {}
        for lang, kind, item, n in rows:
            if kind == "gram":
                counts[self.grams[item], at[lang]] = n
            else:
                scripts.setdefault(item, np.zeros(len(self.langs)))[at[lang]] = n
        self.logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))).astype("f4")
        total = sum(scripts.values()) if scripts else 0
        self.allowed = {s: n >= SCRIPT_SHARE * total for s, n in scripts.items()}
        self._fresh()

    def _fresh(self):
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), "f4")

    def covering(self, texts: list[list[str]]) -> None:
        if len(self.index) > CACHE_WORDS:
            self._fresh()
        missing = list(set().union(*texts).difference(self.index))
        if not missing:
            return
        none = len(self.grams)
        ids = [[self.grams.get(g, none) for g in grams_of(w)] for w in missing]
        starts = np.cumsum([0] + [len(x) for x in ids[:-1]])
        flat = np.fromiter((i for x in ids for i in x), int)
        scores = np.add.reduceat(self.logs[flat], starts, axis=0)
        for k, word in enumerate(missing):
            allowed = self.allowed.get(script_of(word))
            if allowed is not None and allowed.any() and not allowed.all():
                scores[k] = np.where(allowed, scores[k], scores[k].min() - 1000)
        self.index.update(zip(missing, range(len(self.scores), len(self.scores) + len(missing)), strict=True))
        self.scores = np.concatenate([self.scores, scores])

    def spans(self, texts: list[list[str]], penalty: float) -> list[np.ndarray]:
        """The language number of every word of every text."""
        self.covering(texts)
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        get = self.index.__getitem__
        words = np.fromiter((get(w) for k in order for w in texts[k]), int, int(starts[-1]))
        n = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")  # texts longer than t
        now = np.zeros((len(texts), len(self.langs)), "f4")
        switched, source = np.zeros((len(words), len(self.langs)), bool), np.zeros(len(words), "i2")
        for t, a in enumerate(n):
            at = starts[:a] + t
            old = now[:a]
            best = old.argmax(1)
            jump = (old[np.arange(a), best] - (penalty if t else 0.0))[:, None]
            switched[at] = old < jump
            source[at] = best
            now[:a] = np.maximum(old, jump) + self.scores[words[at]]
            now[:a] -= now[:a].max(1, keepdims=True)
        state, label = now.argmax(1), np.zeros(len(words), "i2")
        for t in range(len(n) - 1, -1, -1):
            a = n[t]
            at, s = starts[:a] + t, state[:a]
            label[at] = s
            state[:a] = np.where(switched[at, s], source[at], s)
        out: list = [None] * len(texts)
        for k, doc in enumerate(order):
            out[doc] = label[starts[k] : starts[k + 1]]
        return out


_models: dict = {}


def _labels(key: str, rows, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(rows.value)
        model = _models[key]
        spans_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("behind", pa.int32())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            preds, shares, spans = [], [], []
            for begin in range(0, len(texts), TEXTS):
                words = [_WORDS.findall(t.lower()) if t and model.langs else [] for t in texts[begin : begin + TEXTS]]
                for own, label in zip(words, model.spans(words, penalty) if model.langs else words, strict=True):
                    if not own:
                        preds.append(UNKNOWN), shares.append(0.0), spans.append([])
                        continue
                    letters = np.bincount(label, [len(w) for w in own], len(model.langs))
                    best = int(letters.argmax())
                    preds.append(model.langs[best])
                    shares.append(float(letters[best] / letters.sum()))
                    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(own)]
                    spans.append([{"lang": model.langs[label[a]], "first": a, "behind": b} for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds), pa.array(shares, pa.float64()), pa.array(spans, spans_type)],
                ["row", "lang_pred", "score", "spans"],
            )

    return run


def identify(docs: DataFrame, model: DataFrame, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Per document row: ``row`` (the packed input without the text), lang_pred, score, spans of words."""
    spark = docs.sparkSession
    rows = spark.sparkContext.broadcast([(r.lang, r.kind, r.item, r.n) for r in model.collect()])  # bounded by fit()
    keep = F.struct(*[c for c in docs.columns if c != text]).alias("row")
    fields = docs.select(keep).schema["row"].dataType.simpleString()
    return docs.select(keep, F.col(text).alias("t")).mapInArrow(
        _labels(uuid.uuid4().hex, rows, penalty), f"row {fields}, lang_pred string, score double, spans array<struct<lang:string,first:int,behind:int>>"
    )
