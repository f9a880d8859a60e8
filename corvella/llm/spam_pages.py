"""Pages of keywords, links and tags in place of sentences.

A page is cut into segments: its lines, long ones at sentence ends and then every forty words.  A hidden Markov model with the
states prose, link list, tag list and menu labels them: emissions are independent chances of what a segment shows
(links, separators, function words, repetition and so on), transitions and starts are chances of their own.  All of them, and the
function words, are in models/spam.npz, fitted by ``spam_training``.  A page is flagged when the words of its segments outside prose reach a share of all.

A batch of pages is read by one tokenisation; what its segments show is counted by sorting and summing over all its tokens at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.words import WORD, mix

STATES = ("prose", "link_list", "tag_list", "menu")
SEGMENT_WORDS, LINKS_APART = 40, 3
FLAG_SHARE = 0.5
MODEL = Path(__file__).parent / "models" / "spam.npz"
#: Pages and characters that are read at a time.
_SLICE, _SLICE_CHARS = 2_000, 4_000_000
_SEEN_LIMIT = 500_000

# one pattern finds all that is counted: words, ends of segments, separators, and signs before tags
_TOKEN = re.compile(r"[^\W_]+|\n|[,;|\t]|(?<=\s)[·•/–—>»-](?=\s)|[^\S\n]{3,}|(?<![^\s,|;])[#+@](?=\w)|\[")
_LINK = re.compile(r"<a\b[^>]*>.*?(?:</a>|$)|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+", re.IGNORECASE)
_SENTENCE = re.compile(r"([.!?؟…][\"'»”)]*)\s+")
_ENDS, _CLOSING = frozenset(".!?؟…"), "\"'»”)]"

#: What a segment may show.
TRAITS = ("link", "links_fill", "sentence_end", "some_function_words", "many_function_words", "separated", "tags", "numbers", "repeats", "repeats_page", "short", "very_short", "upper")
#: A segment of fewer words shows neither that it has function words nor that it has none.
TELLING_WORDS = 4
FUNCTION_TRAITS = [TRAITS.index("some_function_words"), TRAITS.index("many_function_words")]

def _has_link(text: str) -> bool:
    return "http" in text or "www." in text or "](" in text or "<a" in text


def segments(text: str) -> list[str]:
    """Lines, cut at sentence ends; what holds LINKS_APART links or more is cut after each, and what is still long every SEGMENT_WORDS words."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        for p in _SENTENCE.sub("\\1\n", line).split("\n") if len(line) > 60 else (line,):
            if _has_link(p) and len(cuts := [m.end() for m in _LINK.finditer(p)]) >= LINKS_APART:
                out += [x for a, b in zip([0, *cuts], [*cuts, len(p)]) if len(x := p[a:b].strip(" ,;|\t)")) > 1]
            elif p.count(" ") >= 2 * SEGMENT_WORDS:
                words = p.split(" ")
                size = math.ceil(len(words) / max(1, round(len(words) / SEGMENT_WORDS)))
                out += [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
            elif p:
                out.append(p)
    return out


class Tokens:
    """Numbers for tokens: 0 ends a segment, 1 separates, 2 opens a tag; words from 4 on, odd ones begin with a digit."""

    def __init__(self, function_words: Iterable[str]) -> None:
        self.function_words = sorted(function_words)
        self.ids: dict[str, int] = {}
        self._begin()

    def _begin(self) -> None:
        self.ids = {w: 4 + 2 * i for i, w in enumerate(self.function_words)}
        self.first_other = 4 + 2 * len(self.function_words)
        self.ids["\n"] = 0

    def numbers(self, tokens: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(self.ids) > _SEEN_LIMIT:
                self._begin()
            for t in dict.fromkeys(tokens):
                if t not in self.ids:
                    c = t[0]
                    self.ids[t] = 2 if c in "#+@[" else 4 + 2 * len(self.ids) + c.isdigit() if c.isalnum() else 1
            return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def traits(parts: list[str], page: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """A row of TRAITS (1, 0, or NaN where nothing can be told) for each segment, and its number of words.  Segments of a page lie together, ``page`` has its number."""
    count = len(parts)
    linked, filled, words_in_links = np.zeros(count, bool), np.zeros(count, bool), np.zeros(count, np.int64)
    texts = parts
    for k, p in enumerate(parts):
        if _has_link(p):
            found = [m.group() for m in _LINK.finditer(p)]
            if found:
                if texts is parts:
                    texts = list(parts)
                texts[k] = _LINK.sub(" ", p)
                linked[k], filled[k] = True, 2 * sum(map(len, found)) > len(p)
                words_in_links[k] = sum(len(WORD.findall(x)) for x in found)
    stops = np.fromiter((p.rstrip(_CLOSING)[-1:] in _ENDS for p in parts), bool, count)
    full = np.fromiter((p[-1:] == "." for p in parts), bool, count)
    upper = np.fromiter((p.isupper() and len(p) > 3 for p in texts), bool, count)
    ids = tokens.numbers(_TOKEN.findall("\n".join(texts).lower()))
    segment = np.cumsum(ids == 0)
    total = lambda where: np.bincount(segment[where], minlength=count)
    marks, signs = total(ids == 1), total(ids == 2)
    word = ids >= 4
    ids, segment = ids[word], segment[word]
    m = np.bincount(segment, minlength=count)
    # pairs of neighbouring words: how often in the segment, and how often in the page
    inside = np.flatnonzero(segment[1:] == segment[:-1])
    pair = mix(((ids[inside] << np.int64(32)) | ids[inside + 1]).astype(np.uint64)) ^ mix(page[segment[inside]].astype(np.uint64))
    order = np.argsort(pair, kind="stable")  # occurrences stay in the order of their segments
    key, where = pair[order], segment[inside[order]]
    one = _groups(key)
    in_page = np.repeat(np.diff(np.append(one, len(key))), np.diff(np.append(one, len(key))))
    runs = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])) if len(key) else one
    own = np.diff(np.append(runs, len(key)))
    different = np.bincount(where[runs], minlength=count)
    again = np.bincount(where, minlength=count) - different
    said = in_page[runs]
    shared = np.bincount(where[runs], weights=(said >= 4) & (said > np.maximum(2, own)), minlength=count)
    chant = np.zeros(len(ids), bool)
    told = inside[order[np.repeat((own > 1) | ((said >= 4) & (said > own)), own)]]
    chant[told], chant[told + 1] = True, True
    # function words inside a phrase that is said again and again show no sentence
    function = (ids < tokens.first_other) & (ids % 2 == 0)
    size = np.maximum(1, m)
    ended = stops & (m >= TELLING_WORDS) | full & (m >= 2)  # of few words only a full stop makes a sentence
    chanted = (again > 0.2 * size) | (~ended & (different > 0) & (shared > 0.6 * different))
    known = np.where(chanted, np.bincount(segment[function & ~chant], minlength=count), np.bincount(segment[function], minlength=count))
    cells = np.sort((segment[~function] << np.int64(32)) | ids[~function])
    first = _groups(cells)
    times = np.diff(np.append(first, len(cells)))
    same = np.bincount(cells[first] >> np.int64(32), weights=times * (times > 1), minlength=count)
    digits = np.bincount(segment[ids % 2 == 1], minlength=count)
    rows = np.stack(
        [
            linked, filled, ended, known >= np.maximum(1, 0.12 * size), (known >= 0.25 * size) & (m >= 4), (marks > 0) & (size < 4 * (marks + 1)), signs >= np.maximum(2, 0.3 * size),
            (digits > 0) & (m <= 14) & (known < 0.2 * size), (again > 0.2 * size) | (same > 0.5 * size), (different > 0) & (shared > 0.4 * different), (m > 3) & (m <= 6), m <= 3, upper,
        ],
        axis=1,
    ).astype(float)
    rows[np.ix_(m < TELLING_WORDS, FUNCTION_TRAITS)] = np.nan
    return rows, np.maximum(1, m + words_in_links)


class SpamModel:
    """Chances to start in a state, to move (states x states), that a state shows a trait (states x traits), and the function words."""

    def __init__(self, start: np.ndarray, move: np.ndarray, shows: np.ndarray, words: Iterable[str]) -> None:
        self.start, self.move, self.words = np.log(start), np.log(move), sorted(words)
        yes, no = np.log(shows), np.log(1 - shows)  # states x traits
        self.yes, self.no = yes.T, no.T

    @classmethod
    def load(cls, path: Path | str = MODEL) -> SpamModel:
        with np.load(path) as f:
            return cls(f["start"], f["move"], f["shows"], f["words"].tolist())

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        told = ~np.isnan(rows)
        shown = np.where(told, rows, 0)
        return shown @ self.yes + (told - shown) @ self.no

    def viterbi(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely states of the segments of pages laid end to end; ``lengths`` has each page's number of segments, none 0."""
        emit = self.emissions(rows)
        path = np.zeros(len(emit), np.int64)
        if not len(emit):
            return path
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], starts[order]
        steps = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]  # pages longer than t come first
        back = np.zeros((len(emit), len(STATES)), np.int8)
        best = self.start + emit[starts]
        for t, n in enumerate(steps):
            if t:
                at = starts[:n] + t
                step = best[:n, :, None] + self.move
                back[at] = step.argmax(axis=1)
                best[:n] = step.max(axis=1) + emit[at]
        state = best.argmax(axis=1)
        for t in range(len(steps) - 1, -1, -1):
            at = starts[: steps[t]] + t
            path[at] = state[: steps[t]]
            state[: steps[t]] = back[at, state[: steps[t]]]
        return path


def shares_of(texts: list[str], model: SpamModel, tokens: Tokens) -> np.ndarray:
    """Each page's share of words in each state; zeros for a page without words."""
    pages = [segments(t) for t in texts]
    lengths = np.array([len(p) for p in pages], np.int64)
    parts = list(chain.from_iterable(pages))
    out = np.zeros((len(texts), len(STATES)))
    if parts:
        page = np.repeat(np.arange(len(texts)), lengths)
        rows, sizes = traits(parts, page, tokens)
        np.add.at(out, (page, model.viterbi(rows, lengths[lengths > 0])), sizes)
        worded = np.fromiter((WORD.search(t) is not None for t in texts), bool, len(texts))
        out = np.where(worded[:, None], out / np.maximum(1, out.sum(axis=1, keepdims=True)), 0)
    return out


def page_shares(text: str, model: SpamModel | None = None) -> np.ndarray:
    model = model or SpamModel.load()
    return shares_of([text], model, Tokens(model.words))[0]


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch of at most _SLICE pages and about _SLICE_CHARS characters."""
    at, held = 0, 0
    for k, n in enumerate(pdf["text"].str.len()):
        if k - at >= _SLICE or (held + n > _SLICE_CHARS and k > at):
            yield pdf.iloc[at:k]
            at, held = k, 0
        held += n
    if at < len(pdf):
        yield pdf.iloc[at:]


def _run(batches: Iterator[pd.DataFrame], model: SpamModel) -> Iterator[pd.DataFrame]:
    tokens = Tokens(model.words)
    for pdf in batches:
        for part in _slices(pdf):
            shares = shares_of(part["text"].tolist(), model, tokens)
            yield pd.DataFrame({"key": part["key"].to_numpy(), **{s: shares[:, i] for i, s in enumerate(STATES)}})


def spam_shares(df: DataFrame, key: str, text: str, model: SpamModel | None = None) -> DataFrame:
    """key and the share of words in each state: prose, link_list, tag_list, menu.

    Null texts give no row; texts without words have zeros.  Pages of any length are labelled, those of a few words too.  Repeated rows are answered each.
    """
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    return source.mapInPandas(partial(_run, model=model or SpamModel.load()), f"key {source.schema['key'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATES))


def spam_pages(df: DataFrame, key: str, text: str, share: float = FLAG_SHARE, model: SpamModel | None = None) -> DataFrame:
    """The keys of pages whose words outside prose make up at least ``share``, each once."""
    rest = F.col("link_list") + F.col("tag_list") + F.col("menu")
    return spam_shares(df, key, text, model).where(rest >= share).select("key").distinct()
