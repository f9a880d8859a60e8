"""Fits the model of spam pages: ``python -m corvella.llm.spam_training TABLES_DIR [OUT]``.

Baum-Welch without labels on a bounded sample of documents (SAMPLE, the first by hash of the id; HELD_OUT more are kept apart).  FIRST and STAY only
say where it begins, so that each state keeps its meaning, and weigh as much as PRIOR_SEGMENTS segments of every state.  Function words are the short words
that many of a language's samples share.
"""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import xxhash

from corvella.llm.spam_pages import FLAG_SHARE, MODEL, STATES, TRAITS, SpamModel, Tokens, segments, shares_of, traits
from corvella.llm.words import WORD

SAMPLE, HELD_OUT = 6_000, 2_000
ROUNDS, PRIOR_SEGMENTS, STAY = 30, 10.0, 0.85
#: A function word has at most so many letters and is in this share of its language's samples.
LONGEST_FUNCTION_WORD, SAMPLE_SHARE = 5, 0.1
START = np.array([0.7, 0.1, 0.1, 0.1])
#: No trait by itself tells more than this: chances are kept away from 0 and 1.
LEAST_CHANCE = 0.02

#: How likely each state is taken to show a trait before any page is seen: (prose, link list, tag list, menu).
FIRST: dict[str, tuple[float, float, float, float]] = {
    "link": (0.06, 0.97, 0.04, 0.10),
    "links_fill": (0.004, 0.85, 0.005, 0.01),
    "sentence_end": (0.75, 0.03, 0.03, 0.02),
    "some_function_words": (0.96, 0.12, 0.20, 0.25),
    "many_function_words": (0.80, 0.02, 0.03, 0.05),
    "separated": (0.04, 0.40, 0.55, 0.70),
    "tags": (0.01, 0.10, 0.30, 0.02),
    "numbers": (0.03, 0.03, 0.30, 0.03),
    "repeats": (0.015, 0.10, 0.60, 0.05),
    "repeats_page": (0.06, 0.30, 0.75, 0.20),
    "short": (0.07, 0.30, 0.23, 0.25),
    "very_short": (0.03, 0.20, 0.12, 0.70),
    "upper": (0.01, 0.05, 0.20, 0.25),
}


def function_words(samples: list[tuple[str, str]]) -> set[str]:
    """Function words from (language, text) samples."""
    size, seen = Counter(lang for lang, _ in samples), Counter()
    for lang, text in samples:
        seen.update((lang, w) for w in set(WORD.findall(text.lower())))
    return {w for (lang, w), n in seen.items() if len(w) <= LONGEST_FUNCTION_WORD and not w[0].isdigit() and n >= SAMPLE_SHARE * size[lang]}


def first_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(STATES)
    return START, np.where(np.eye(n, dtype=bool), STAY, (1 - STAY) / (n - 1)), np.array([FIRST[t] for t in TRAITS]).T


def expected(model: SpamModel, rows: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, and the expected numbers of starts, moves and segments by state: forward and backward passes over pages in step."""
    emit = model.emissions(rows)
    top = emit.max(axis=1, keepdims=True)
    e = np.exp(emit - top)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]
    move = np.exp(model.move)
    forward, scale = np.zeros_like(e), np.zeros(len(e))
    for t, n in enumerate(active):
        at = starts[:n] + t
        a = (np.exp(model.start) if t == 0 else forward[at - 1] @ move) * e[at]
        scale[at] = a.sum(axis=1)
        forward[at] = a / scale[at, None]
    backward = np.ones_like(e)
    moves = np.zeros_like(move)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = e[at + 1] * backward[at + 1] / scale[at + 1, None]
        moves += forward[at].T @ ahead * move
        backward[at] = ahead @ move.T
    share = forward * backward
    return float(np.log(scale).sum() + top.sum()), share[starts].sum(axis=0), moves, share


def fit(rows: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start0, move0, shows0 = first_model()
    start, move, shows = start0, move0, shows0
    for r in range(rounds):
        likelihood, begun, moves, share = expected(SpamModel(start, move, shows, ()), rows, lengths)
        start = begun + PRIOR_SEGMENTS * start0
        start /= start.sum()
        move = moves + PRIOR_SEGMENTS * move0
        move /= move.sum(axis=1, keepdims=True)
        told = ~np.isnan(rows)
        shows = (share.T @ np.where(told, rows, 0) + PRIOR_SEGMENTS * shows0) / (share.T @ told + PRIOR_SEGMENTS)
        shows = np.clip(shows, LEAST_CHANCE, 1 - LEAST_CHANCE)
        if r % 5 == 0 or r == rounds - 1:
            print(f"round {r}: log-likelihood a segment {likelihood / len(rows):.4f}", flush=True)
    return start, move, shows


def observed(texts: list[str], words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    pages = [p for p in map(segments, texts) if p]
    lengths = np.array([len(p) for p in pages])
    return traits([s for p in pages for s in p], np.repeat(np.arange(len(pages)), lengths), Tokens(words))[0], lengths


def main(tables: str, out: str = str(MODEL)) -> None:
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{tables}/documents.parquet", columns=["doc_id", "text"]).to_pandas().dropna(subset=["text"]).drop_duplicates("doc_id")
    docs = docs.assign(h=[xxhash.xxh64_intdigest(str(i)) for i in docs.doc_id]).sort_values("h").head(SAMPLE + HELD_OUT)
    held, sample = docs.text[:HELD_OUT].tolist(), docs.text[HELD_OUT:].tolist()
    samples = pq.read_table(f"{tables}/lang_samples.parquet", columns=["lang", "text"]).to_pandas()
    words = function_words(list(zip(samples.lang, samples.text)))
    start, move, shows = fit(*observed(sample, words))
    Path(out).parent.mkdir(exist_ok=True)
    np.savez_compressed(out, start=start, move=move, shows=shows, words=np.array(sorted(words)))
    first, fitted = SpamModel(*first_model(), words), SpamModel.load(out)
    rows, lengths = observed(held, words)
    print(f"held out: log-likelihood a segment {expected(first, rows, lengths)[0] / len(rows):.4f} at first, {expected(fitted, rows, lengths)[0] / len(rows):.4f} fitted")
    flags = [1 - shares_of(held, m, Tokens(words))[:, 0] >= FLAG_SHARE for m in (first, fitted)]
    print(f"held out: {flags[0].sum()} pages flagged at first, {flags[1].sum()} fitted, {(flags[0] != flags[1]).sum()} differ")
    np.set_printoptions(precision=3, suppress=True)
    print(start, move, sep="\n")
    for t, row in zip(TRAITS, shows.T):
        print(f"{t:22}", row)


if __name__ == "__main__":
    main(*sys.argv[1:])
