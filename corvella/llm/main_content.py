"""Main content of pages: a bidirectional LSTM labels every block as article or boilerplate.

A page is a sequence of blocks, lines of text or leaves of an HTML tree.  A block's vector holds hashed parts of its
tag path, or for plain lines of the marks that took its place (bullets, separators, case, punctuation, length), and its
hashed words.  Two recurrent passes, down and up the page, let each block be judged by the whole page.  Weights are in
models/blocks.npz, made by ``block_training``; only numpy is needed to read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.words import WORD

PATH_SIZE, WORD_SIZE, HIDDEN = 64, 1024, 32
INPUT = PATH_SIZE + WORD_SIZE
MODEL = Path(__file__).parent / "models" / "blocks.npz"
_CACHE = 300_000
_SLICE = 1_000
#: Blocks whose vectors exist at a time; beyond them only what the network makes of them is kept.
_VECTORS = 4_096

_BULLET = re.compile(r"^(?:[-*•›»>·+–]|\d{1,3}[.)])\s")
_SEPARATED = re.compile(r"\s[|/·>»•–]\s|\s{2,}|\t")
_COUNTED = re.compile(r"\(\d+\)$")
_DATED = re.compile(r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}")


def block_path(line: str, blank_before: bool) -> list[str]:
    """What a plain line shows in place of a tag path."""
    s = line.strip()
    bullet = _BULLET.match(s)
    core = s[bullet.end() :] if bullet else s
    n = len(core.split())
    marks = len(_SEPARATED.findall(core))
    last = s[-1:]
    parts = [
        "len%d" % min(n, 6) if n <= 6 else "len7" if n <= 9 else "len10" if n <= 14 else "len15",
        "end" + (last if last in ".!?:,;\"'”“»)]^" else "digit" if last.isdigit() else "letter"),
        "case" + ("upper" if core.isupper() else "lower" if core[:1].islower() else "capital" if core[:1].isupper() else "digit" if core[:1].isdigit() else "other"),
    ]
    if bullet:
        parts += ["li", "li" + ("digit" if s[0].isdigit() else s[0]), "li" + parts[1]]
    if marks:
        parts += ["sep", "sep%d" % min(marks, 4), "sep" + parts[1], "sepfew" if n / (marks + 1) < 3 else "sepmany"]
    if _COUNTED.search(s):
        parts.append("counted")
    if _DATED.match(core):
        parts.append("dated")
    if blank_before:
        parts.append("gap")
    if "." in core[:-1]:
        parts.append("innerstop")
    parts.append(parts[0] + parts[1] + parts[2] + ("li" if bullet else ""))
    return parts


def html_path(tags: list[str]) -> list[str]:
    """Parts of a leaf's tag path: each tag, neighbouring pairs, and the last three."""
    return [*(f"<{t}>" for t in tags), *(f"<{a}><{b}>" for a, b in zip(tags, tags[1:])), "path:" + ">".join(tags[-3:])]


class Vectors:
    """Block vectors; hashes of words and path parts are remembered."""

    def __init__(self) -> None:
        self.word_slots: dict[str, tuple[int, float]] = {}
        self.path_slots: dict[str, tuple[int, float]] = {}

    @staticmethod
    def _slot(table: dict[str, tuple[int, float]], item: str, size: int, seed: int) -> tuple[int, float]:
        got = table.get(item)
        if got is None:
            if len(table) > _CACHE:
                table.clear()
            h = xxhash.xxh3_64_intdigest(item, seed)
            got = table[item] = ((h >> 8) % size, 1.0 if h & 1 else -1.0)
        return got

    def matrix(self, blocks: list[tuple[list[str], str]]) -> np.ndarray:
        """One row per block of (path parts, text)."""
        rows: list[int] = []
        slots: list[int] = []
        signs: list[float] = []
        for r, (path, text) in enumerate(blocks):
            for p in path:
                s, g = self._slot(self.path_slots, p, PATH_SIZE, 1)
                rows.append(r), slots.append(s), signs.append(g)
            words = WORD.findall(text.lower())
            if words:
                weight = (len(words) + 1) ** -0.5
                for w in [*words, "^" + words[0]]:
                    if w.isdigit():
                        w = "0"
                    s, g = self._slot(self.word_slots, w, WORD_SIZE, 2)
                    rows.append(r), slots.append(PATH_SIZE + s), signs.append(g * weight)
        flat = np.bincount(np.array(rows, np.int64) * INPUT + np.array(slots, np.int64), weights=signs, minlength=len(blocks) * INPUT) if rows else np.zeros(len(blocks) * INPUT)
        return flat.reshape(len(blocks), INPUT).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """The network.  Arrays: wx (two directions, INPUT x 4 HIDDEN), wh, b, and the output wo, bo."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.a = {k: np.asarray(v, np.float32) for k, v in arrays.items()}

    @classmethod
    def load(cls, path: Path | str = MODEL) -> BlockLabeller:
        with np.load(path) as f:
            return cls(dict(f))

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions take from blocks' vectors."""
        return np.stack([x @ self.a["wx"][d] + self.a["b"][d] for d in range(2)])

    def label(self, blocks: list[tuple[list[str], str]], sizes: list[int], vectors: Vectors) -> np.ndarray:
        parts = [self.projected(vectors.matrix(blocks[i : i + _VECTORS])) for i in range(0, len(blocks), _VECTORS)]
        return self.scores(np.concatenate(parts, axis=1) if parts else np.zeros((2, 0, 4 * HIDDEN), np.float32), sizes)

    def scores(self, inputs: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Probability of boilerplate for the projected blocks of pages laid end to end; ``sizes`` has each page's number of blocks."""
        count = inputs.shape[1]
        out = np.zeros(count, np.float32)
        if not count:
            return out
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        lengths = np.array(sizes, np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], starts[order]
        hidden = []
        for d in range(2):
            states = np.zeros((count, HIDDEN), np.float32)
            h = np.zeros((len(lengths), HIDDEN), np.float32)
            c = np.zeros_like(h)
            for t in range(int(lengths[0])):
                n = int(np.searchsorted(-lengths, -t, side="left"))  # pages longer than t come first
                at = starts[:n] + (t if d == 0 else lengths[:n] - 1 - t)
                z = inputs[d][at] + h[:n] @ self.a["wh"][d]
                i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                c[:n] = f * c[:n] + i * g
                h[:n] = o * np.tanh(c[:n])
                states[at] = h[:n]
            hidden.append(states)
        z = np.concatenate(hidden, axis=1) @ self.a["wo"] + self.a["bo"]
        return _sigmoid(z)


def text_blocks(text: str) -> tuple[list[int], list[tuple[list[str], str]]]:
    """Line numbers (from 1, blank lines counted) and blocks of a plain text's lines that are not blank."""
    numbers, blocks, gap = [], [], False
    for k, line in enumerate(text.split("\n"), 1):
        if line.strip():
            numbers.append(k)
            blocks.append((block_path(line, gap), line))
            gap = False
        else:
            gap = True
    return numbers, blocks


def _label(batches: Iterator[pd.DataFrame], labeller: BlockLabeller, keys: list[str]) -> Iterator[pd.DataFrame]:
    vectors = Vectors()
    for whole in batches:
        for at in range(0, len(whole), _SLICE):
            pdf = whole.iloc[at : at + _SLICE]
            pages = [text_blocks(t) for t in pdf["_text"]]
            sizes = [len(n) for n, _ in pages]
            p = labeller.label([b for _, blocks in pages for b in blocks], sizes, vectors)
            out = pdf[keys].iloc[np.repeat(np.arange(len(pdf)), sizes)].reset_index(drop=True)
            yield out.assign(line_no=np.array([k for n, _ in pages for k in n], "int32"), boilerplate=p.astype("float64"))


def label_lines(df: DataFrame, text: str, keep: list[str], labeller: BlockLabeller | None = None) -> DataFrame:
    """One row per line that is not blank: the ``keep`` columns, line_no (from 1, blank lines counted), boilerplate (a probability).

    Null, empty and blank texts give no rows; a text without line feeds is one line.  Repeated rows are labelled each.
    """
    labeller = labeller or BlockLabeller.load()
    source = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)], F.col(f"`{text}`").alias("_text")).where(F.length("_text") > 0)
    keys = [f"_k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)
    found = source.mapInPandas(partial(_label, labeller=labeller, keys=keys), f"{kinds}, line_no int, boilerplate double")
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "line_no", "boilerplate")


def main_text(df: DataFrame, text: str, keep: list[str], threshold: float = 0.5, labeller: BlockLabeller | None = None) -> DataFrame:
    """The ``keep`` columns and main_text: each text without its boilerplate lines, blank lines between kept ones as they were.

    A null text stays null; a text of boilerplate only becomes empty.
    """
    labeller = labeller or BlockLabeller.load()
    source = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    keys = [f"_k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for whole in batches:
            for at in range(0, len(whole), _SLICE):
                pdf = whole.iloc[at : at + _SLICE]
                pages = [text_blocks(t or "") for t in pdf["_text"]]
                sizes = [len(n) for n, _ in pages]
                drop = labeller.label([b for _, blocks in pages for b in blocks], sizes, vectors) >= threshold
                texts, k = [], 0
                for t, (numbers, _) in zip(pdf["_text"], pages):
                    bad = {n for n, d in zip(numbers, drop[k : k + len(numbers)]) if d}
                    k += len(numbers)
                    texts.append(None if t is None else re.sub(r"\n{3,}", "\n\n", "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in bad)).strip("\n"))
                yield pdf[keys].assign(main_text=texts)

    return source.mapInPandas(run, f"{kinds}, main_text string").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "main_text")
