"""Language of texts and of their stretches, word by word with backoff.

A known word scores the logarithm of its share of each language's words.  An unseen word falls back to its
character n-grams, from long to short, until some of a length are known.  A stretch (sentence, question or line)
scores the sum over its words; stretches that clearly speak against the language of the whole make a text mixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most; the driver holds them.
MAX_SAMPLES = 10_000
LONGEST_GRAM = 5
#: Score of a word or n-gram that a language has never shown (log10).
UNSEEN = -6.0
#: Words that a stretch needs at least to count as a sentence, and the evidence (log10 of the likelihood ratio, in all and by the
#: word) by which its own language must beat that of the whole text.
LEAST_WORDS, LEAST_MARGIN, LEAST_MARGIN_PER_WORD = 3, 4.0, 0.6
#: A text is in no language if its words score less than this on average, or fewer than KNOWN_SHARE of them are known.
LEAST_MEAN, KNOWN_SHARE = -5.0, 0.2
_CACHE = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")
# sentences and lines; what stands in quotation marks or brackets is a stretch of its own
_STRETCH = re.compile(r"[^\n.!?؟…\"„“”«»()]*(?:[.!?؟…]+|[\n\"„“”«»()]+|$)")

# Codes and names of languages, as ISO 639 and common use have them.
LABELS = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "ingles", "الإنجليزية", "انجليزي", "إنجليزي"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "الألمانية"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "الفرنسية"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "الإسبانية"],
    "ar": ["ar", "ara", "arabic", "arabisch", "arabe", "árabe", "العربية", "عربي", "عربية"],
}


def label_language(label: Column) -> Column:
    """en, de, fr, es or ar for any usual code or name of these, regional ones included; null for everything else.

    Case and surrounding space do not count; of ``en-US``, ``en_GB`` or ``English (US)`` the first part does.
    """
    plain = F.regexp_replace(F.lower(label), r"(?U)^[\s\p{Z}]+", "")
    head = F.regexp_extract(plain, r"^(\p{L}+)", 1)
    names = F.create_map(*[F.lit(x) for code, known in LABELS.items() for name in known for x in (name, code)])
    return names[head]


class WordFirst:
    """The model: word and n-gram shares by language."""

    def __init__(self, samples: Iterable[tuple[str, str]]) -> None:
        words: dict[str, Counter[str]] = {}
        for lang, text in samples:
            if lang and text:
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
        self.languages = sorted(words)
        grams = [{lang: Counter[str]() for lang in words} for _ in range(LONGEST_GRAM)]
        for lang, seen in words.items():
            for w, c in seen.items():
                padded = f" {w} "
                for n in range(1, LONGEST_GRAM + 1):
                    for i in range(len(padded) - n + 1):
                        grams[n - 1][lang][padded[i : i + n]] += c
        self.words = self._scores(words)
        self.grams = [self._scores(g) for g in grams]

    def _scores(self, counts: dict[str, Counter[str]]) -> dict[str, tuple[float, ...]]:
        totals = [max(1, sum(counts[lang].values())) for lang in self.languages]
        keys = set().union(*counts.values()) if counts else set()
        return {k: tuple(math.log10(counts[lang][k] / t) if counts[lang][k] else UNSEEN for lang, t in zip(self.languages, totals)) for k in keys}

    def word(self, w: str) -> tuple[float, ...]:
        """A score for each language, then 1 for a known word or 0."""
        if w in self.words:
            return (*self.words[w], 1.0)
        padded = f" {w} "
        for n in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            table = self.grams[n - 1]
            found = [table[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in table]
            if found:
                gaps = len(padded) - n + 1 - len(found)
                return (*((sum(col) + gaps * UNSEEN) / (len(found) + gaps) for col in zip(*found)), 0.0)
        return (*([UNSEEN] * len(self.languages)), 0.0)


class _Scorer:
    """Scores of all words of a batch, through a table of the words seen so far by this worker."""

    def __init__(self, model: WordFirst) -> None:
        self.model, self.number, self.rows = model, {}, []
        self.table = np.zeros((0, len(model.languages) + 1), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        number = self.number
        if len(number) > _CACHE:
            number.clear()
            self.rows, self.table = [], self.table[:0]
        try:
            ids = list(map(number.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in number:
                    number[w] = len(self.rows)
                    self.rows.append(self.model.word(w))
            fresh = np.array(self.rows[len(self.table) :], np.float32).reshape(-1, self.table.shape[1])
            self.table = np.concatenate([self.table, fresh])
            ids = list(map(number.__getitem__, words))
        return self.table[np.array(ids, np.int64)]


def _analyse(texts: list[str], scorer: _Scorer) -> list[list[tuple[int, int, int, float]]]:
    """For each text its stretches (start, end, language number, confidence); neighbours of one language are one stretch."""
    words: list[str] = []
    spans: list[tuple[int, int]] = []
    word_ends, text_ends = [0], [0]
    for t in texts:
        low = t.lower()
        same = len(low) == len(t)  # else positions would not fit; lower() of a few letters is longer
        for m in _STRETCH.finditer(low if same else t):
            a, b = m.span()
            if a < b:
                found = _LETTERS.findall(m.group().lower())
                if found:
                    words += found
                    word_ends.append(len(words))
                    spans.append((a, b))
        text_ends.append(len(spans))
    if not words:
        return [[] for _ in texts]
    scored = scorer.scores(words)
    sums = np.add.reduceat(scored, word_ends[:-1], axis=0)
    counts = np.diff(word_ends)
    out: list[list[tuple[int, int, int, float]]] = []
    langs = scored.shape[1] - 1
    ends = np.array(text_ends)
    some = np.flatnonzero(np.diff(ends))
    totals = np.zeros((len(texts), langs + 1), np.float32)
    sizes = np.zeros(len(texts), np.int64)
    totals[some] = np.add.reduceat(sums, ends[:-1][some], axis=0)
    sizes[some] = np.add.reduceat(counts, ends[:-1][some])
    main = totals[:, :langs].argmax(axis=1)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    best = sums[:, :langs].argmax(axis=1)
    rows = np.arange(len(sums))
    margin = sums[rows, best] - sums[rows, main[owner]]
    known = sums[:, langs] >= np.maximum(2, KNOWN_SHARE * counts)
    foreign = (counts >= LEAST_WORDS) & (margin >= LEAST_MARGIN) & (margin >= LEAST_MARGIN_PER_WORD * counts) & known & (sums[rows, best] >= LEAST_MEAN * counts)
    lang = np.where(foreign, best, main[owner])
    usable = (sizes > 0) & (totals[np.arange(len(texts)), main] >= LEAST_MEAN * np.maximum(sizes, 1)) & (totals[:, langs] >= KNOWN_SHARE * sizes)
    for i in range(len(texts)):
        a, b = text_ends[i], text_ends[i + 1]
        if not usable[i]:
            out.append([])
            continue
        stretches: list[tuple[int, int, int, float]] = []
        at = a
        while at < b:
            upto = at + 1
            while upto < b and lang[upto] == lang[at]:
                upto += 1
            s = sums[at:upto, :langs].sum(axis=0).astype(np.float64)
            p = np.exp((s - s.max()) * math.log(10))
            stretches.append((spans[at][0], spans[upto - 1][1], int(lang[at]), float(p[lang[at]] / p.sum())))
            at = upto
        out.append(stretches)
    return out


def fit(samples: DataFrame, lang: str = "lang", text: str = "text") -> WordFirst:
    """A model from at most MAX_SAMPLES labelled rows (the first by text hash); null labels and texts are skipped."""
    rows = samples.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    return WordFirst([(r.l, r.t) for r in rows.orderBy(F.xxhash64("t"), "t").limit(MAX_SAMPLES).collect()])


def language_stretches(df: DataFrame, text: str, keep: list[str], model: WordFirst) -> DataFrame:
    """One row per stretch of each text: the ``keep`` columns, stretch_no (from 1), start_at, end_at, lang, confidence.

    Offsets count characters from 0.  Null, blank and wordless texts, and texts in none of the model's languages, give
    no rows.  Repeated rows are answered each; columns not in ``keep`` are dropped.
    """
    source = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)], F.col(f"`{text}`").alias("_text")).where(F.length("_text") > 0)
    keys = [f"_k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                pdf = whole.iloc[at : at + 2000]
                rows, no, cols = [], [], []
                for r, stretches in enumerate(_analyse(pdf["_text"].tolist(), scorer)):
                    rows += [r] * len(stretches)
                    no += range(1, len(stretches) + 1)
                    cols += stretches
                if not rows:
                    continue
                out = pdf[keys].iloc[rows].reset_index(drop=True)
                begin, end, lang, sure = (list(x) for x in zip(*cols)) if cols else ([], [], [], [])
                yield out.assign(stretch_no=np.array(no, "int32"), start_at=np.array(begin, "int32"), end_at=np.array(end, "int32"), lang=[model.languages[x] for x in lang], confidence=np.array(sure, "float64"))

    found = source.mapInPandas(run, f"{kinds}, stretch_no int, start_at int, end_at int, lang string, confidence double")
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "stretch_no", "start_at", "end_at", "lang", "confidence")
