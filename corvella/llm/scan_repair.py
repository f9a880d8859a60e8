"""Repair of text from scanned pages: cut words, misread letters, running headings, printed page numbers.

Words are decoded against a lexicon counted over the whole corpus, in a noisy channel: a reading costs the negative
logarithm of its words' shares, plus a fixed price for each confused character, each lost or added space and each removed
hyphen.  The characters of a line end and the next line's start are one stream, so a word cut there is decoded whole.
Readable paragraphs come from a dynamic program over the lines' break costs.
"""

from __future__ import annotations

import atexit
import math
import mmap
import re
import shutil
import tempfile
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import ExitStack
from functools import partial
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.runtime import materialise

#: The lexicon has the words seen in at least LEAST_SEEN places.  The driver and each worker hold the LEXICON_SIZE most frequent; where there are more, all lie in files (WordFiles).
LEAST_SEEN, LEXICON_SIZE = 5, 200_000
#: Prices in natural logarithms: a usual and an unusual confusion of letters, a confused sign inside a word, a space put in or left out, an unknown letter.
CONFUSED, SELDOM_CONFUSED, SIGN_CONFUSED, SPACE_PRICE, UNKNOWN_LETTER = 3.0, 6.0, 2.0, 3.0, 4.0
MOST_CONFUSED, LONGEST_WORD = 3, 32
_CACHE = 300_000
#: Lengths of the word beginnings that a reading is held against on its way.
HEADS = (3, 4, 6, 8, 11, 15, 20)

# What is read (left) for what was printed (right).
USUAL = [
    ("+", "t"), ("@", "a"), ("0", "o"), ("!", "i"), ("5", "s"), ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("$", "s"), ("|", "l"), ("|", "i"),
    ("c", "e"), ("b", "h"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("h", "li"),
]
SELDOM = [
    ("d", "cl"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("li", "h"), ("h", "b"), ("e", "c"), ("o", "c"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("f", "t"),
    ("in", "m"), ("nn", "m"), ("ri", "n"), ("n", "ri"), ("u", "v"), ("v", "u"), ("q", "g"), ("g", "q"),
]
_SIGNS = set("+@!|$0123456789")
_BY_FIRST: dict[str, list[tuple[str, str, float]]] = defaultdict(list)
for _table, _price in ((USUAL, CONFUSED), (SELDOM, SELDOM_CONFUSED)):
    for _seen, _true in _table:
        _BY_FIRST[_seen[0]].append((_seen, _true, SIGN_CONFUSED if _seen in _SIGNS else _price))
# Marks that stand for a hyphen at a line end.
HYPHENS = "-­¬‐‑"

_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CUT = re.compile(rf"\S*[^\W\d_][{HYPHENS}][ \t]*\r?\n[ \t]*\S+")
_EDGE = "\"'.,;:?!()[]{}<>«»„“”‘’‚*#|/\\–—-…،؛؟¿¡=&%"
_EDGE_SOFT = _EDGE.replace("!", "").replace("|", "")
_NUMBER = r"(?:\d{1,5}|(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_PAGE_NO = re.compile(rf"^(?:[-–—\[(|·•~]\s*)?(?:(?:page|p\.?|pg\.?|seite|s\.|página|pág\.?|pagina|blatt|صفحة|ص\.?)\s*)?{_NUMBER}(?:\s+(?:/|of|von|de|sur|من)\s+\d{{1,5}})?(?:\s*[-–—\])|·•~])?\.?$", re.IGNORECASE)
_BESIDE = re.compile(r"\s{2,}|\t|\s[|·•]\s")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[str] = Counter()
    for pdf in batches:
        for t in pdf["text"]:
            if any(c in t for c in HYPHENS):
                t = _CUT.sub(" ", t)
            seen.update(_WORDS.findall(t.lower()))
        if len(seen) > _CACHE:
            yield pd.DataFrame(seen.items(), columns=["word", "n"])
            seen.clear()
    yield pd.DataFrame(seen.items(), columns=["word", "n"])


class WordFiles:
    """Files on every node with all words' hashes (64 bits, sorted), their counts, and the hashes of all words' beginnings; a worker maps them into memory."""

    opened: dict[str, memoryview] = {}

    @classmethod
    def numbers(cls, file: str) -> memoryview:
        if file not in cls.opened:
            with open(SparkFiles.get(file), "rb") as f:
                cls.opened[file] = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("q")
        return cls.opened[file]

    @classmethod
    def place(cls, file: str, text: str) -> int | None:
        numbers, h = cls.numbers(file), xxhash.xxh64_intdigest(text, 42)  # as Spark's xxhash64
        h -= (h >> 63) << 64
        at = bisect_left(numbers, h)
        return at if at < len(numbers) and numbers[at] == h else None

    @staticmethod
    def spread(rows: DataFrame, name: str, *columns: str) -> None:
        """Send the 64-bit columns of the sorted rows to all nodes, a file each; the driver holds one partition at a time."""

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({c: [pdf[c].to_numpy("<i8").tobytes()] for c in columns})

        folder = tempfile.mkdtemp(prefix="corvella-words-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # nodes may fetch the files at any time until then
        with ExitStack() as stack:
            files = {c: stack.enter_context(open(f"{folder}/{name}-{c}", "wb")) for c in columns}
            for r in rows.mapInPandas(packed, ", ".join(f"{c} binary" for c in columns)).toLocalIterator():
                for c in columns:
                    files[c].write(r[c])
        for c in columns:
            rows.sparkSession.sparkContext.addFile(f"{folder}/{name}-{c}")


class Words(dict):
    """Counts of all words: the frequent ones are held (and listed), the others looked up in the files."""

    def __init__(self, head: dict[str, int], name: str, total: int) -> None:
        super().__init__(head)
        self.name, self.total = name, total

    def __missing__(self, word: str) -> int:
        at = WordFiles.place(f"{self.name}-word", word)
        if at is None:
            raise KeyError(word)
        return WordFiles.numbers(f"{self.name}-n")[at]

    def get(self, word: str, default: int | None = None) -> int | None:
        try:
            return self[word]
        except KeyError:
            return default

    def __contains__(self, word: object) -> bool:
        return self.get(word) is not None


class _Prices(Words):
    """Negative logarithms of the words' shares."""

    def __missing__(self, word: str) -> float:
        return -math.log(super().__missing__(word) / self.total)


class _Beginnings(set):
    """The beginnings of the frequent words, then those in the file."""

    def __init__(self, head: set[str], name: str) -> None:
        super().__init__(head)
        self.name = name

    def __contains__(self, text: object) -> bool:
        return super().__contains__(text) or WordFiles.place(f"{self.name}-head", text) is not None


def lexicon(df: DataFrame, text: str) -> dict[str, int]:
    """Counts of the corpus's words, compounds with their hyphens among them; words cut at line ends are left out.

    Beyond LEXICON_SIZE words the result is a ``Words``: it lists the most frequent and looks all others up.
    """
    source = df.select(F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    counts = source.mapInPandas(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)
    counts = materialise(counts, "words")
    rows = counts.orderBy(F.desc("n"), "word").limit(LEXICON_SIZE + 1).collect()
    head = {r.word: r.n for r in rows[:LEXICON_SIZE]}
    if len(rows) <= LEXICON_SIZE:
        return head
    name = f"words-{uuid.uuid4().hex}"
    WordFiles.spread(counts.groupBy(F.xxhash64("word").alias("word")).agg(F.sum("n").alias("n")).orderBy("word"), name, "word", "n")
    heads = counts.select(F.explode(F.array(*[F.substring("word", 1, k) for k in HEADS])).alias("head")).select(F.xxhash64("head").alias("head")).distinct()
    WordFiles.spread(heads.orderBy("head"), name, "head")
    return Words(head, name, counts.agg(F.sum("n")).first()[0])


class Decoder:
    """Most likely words for what was read."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        total = counts.total if isinstance(counts, Words) else sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unseen = -math.log(0.5 / total)
        self.memory: dict[str, tuple[str, int] | None] = {}
        self.heads = {w[:k] for k in HEADS for w in counts}  # readings that begin like no word are given up early
        if isinstance(counts, Words):
            self.cost, self.heads = _Prices(self.cost, counts.name, total), _Beginnings(self.heads, counts.name)

    def _variants(self, token: str) -> Iterator[tuple[str, float, int]]:
        """What may have been printed, the price, and the number of confusions (1 or more)."""
        stack = [("", 0, 0.0, 0)]
        while stack:
            done, at, price, n = stack.pop()
            if (len(done) >= 3 and done[:3] not in self.heads) or (len(done) >= 6 and done[:6] not in self.heads):
                continue
            if at == len(token):
                if n:
                    yield done, price, n
                continue
            stack.append((done + token[at], at + 1, price, n))
            if n < MOST_CONFUSED and (n < 2 or len(token) < 16):
                for seen, true, more in _BY_FIRST.get(token[at], ()):
                    if token.startswith(seen, at):
                        stack.append((done + true, at + len(seen), price + more * (1 + n * 0.5), n + 1))

    def corrected(self, token: str) -> str | None:
        """The word that ``token`` (lower case) misreads, or None if it is best left alone."""
        if token in self.memory:
            found = self.memory[token]
            return found[0] if found else None
        if len(self.memory) > _CACHE:
            self.memory.clear()
        own = self.cost.get(token, self.unseen)
        best: tuple[float, str, int] | None = None
        if 2 <= len(token) <= LONGEST_WORD and any(c.isalpha() for c in token):
            signs = sum(c in _SIGNS for c in token)
            # words that the corpus knows well are taken as they are, unless a far more frequent one explains them
            for word, price, n in self._variants(token) if signs <= MOST_CONFUSED else ():
                cost = self.cost.get(word)
                if cost is not None and len(word) >= (2 if signs else 3) and cost + price < own and (best is None or cost + price < best[0]):
                    best = (cost + price, word, n)
        self.memory[token] = best and (best[1], best[2])
        return best[1] if best else None

    def _readings(self, stream: str, at: int) -> Iterator[tuple[int, str, float, int]]:
        """Words that may begin at ``at``: the end of what was read, the word, its cost with the confusions' price, their number."""
        stack = [("", at, 0.0, 0)]
        while stack:
            done, i, price, n = stack.pop()
            own = self.cost.get(done)
            if own is not None and (not n or len(done) >= (2 if any(c in _SIGNS for c in stream[at:i]) else 3)):
                yield i, done, own + price, n
            if i == len(stream) or len(done) >= LONGEST_WORD:
                continue
            steps = [(stream[i], 1, 0.0, 0)]
            if n < MOST_CONFUSED and (n < 2 or i - at < 16):
                steps += [(true, len(seen), more * (1 + n * 0.5), 1) for seen, true, more in _BY_FIRST.get(stream[i], ()) if stream.startswith(seen, i)]
            for true, length, more, k in steps:
                word = done + true
                if all(word[:h] in self.heads for h in HEADS if len(done) < h <= len(word)):
                    stack.append((word, i + length, price + more, n + k))

    def decoded(self, tokens: tuple[str, ...]) -> list[tuple[int, int, str | None, int]]:
        """Cheapest reading of a stream of tokens (lower case): begin and end in the joined stream, the word (None: a token left as read), its confusions.

        A word may take in spaces that were read and may end where none was, each at SPACE_PRICE; a token may also stand as no known word.
        """
        stream, bounds = "".join(tokens), [0]
        for t in tokens:
            bounds.append(bounds[-1] + len(t))
        ends, n = dict(zip(bounds, bounds[1:])), len(stream)
        inner = [0] * (n + 1)  # spaces read before each place
        for x in bounds[1:-1]:
            inner[x] = 1
        spaces = list(accumulate(inner))
        best: list[tuple[float, int, str | None, int]] = [(0.0, 0, None, 0)] + [(math.inf, 0, None, 0)] * n
        for i in range(n):
            sofar = best[i][0]
            if sofar == math.inf:
                continue
            if i in ends:
                j = ends[i]
                price = sofar + self.unseen + (0 if _ROMAN.match(stream[i:j]) else UNKNOWN_LETTER * (j - i))
                if price < best[j][0]:
                    best[j] = (price, i, None, 0)
            for j, word, cost, k in self._readings(stream, i):
                price = sofar + cost + SPACE_PRICE * (spaces[j - 1] - spaces[i]) + (0 if inner[j] or j == n else SPACE_PRICE)
                if price < best[j][0]:
                    best[j] = (price, i, word, k)
        path, at = [], n
        while at:
            _, i, word, k = best[at]
            path.append((i, at, word, k))
            at = i
        return path[::-1]

    def segmented(self, stream: str) -> list[str] | None:
        """Words of a stream without spaces (lower case), each of the lexicon as read or with confusions; None if it is best left as read."""
        words = [word for _, _, word, _ in self.decoded((stream,))]
        return None if None in words else words


def _core(token: str) -> tuple[str, str, str]:
    """What comes before a token's word, the word, what comes after."""
    word = token.strip(_EDGE)
    at = token.find(word) if word else len(token)
    return token[:at], word, token[at + len(word) :]


_CODE = re.compile(r"^(?:[A-Z]{1,4}[-/]?\d+|\d[\d.,:/-]*|https?:.*|www\..*|\S+@\S+\.\S+)$")


def _as_case(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (letters and letters[0].isupper() and not like[0].isalpha()) else word


class PageReader:
    """What is wrong with a page, and its text put right."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.decoder = Decoder(counts)
        self.known = counts
        self.answers: dict[str, tuple[str, bool]] = {}
        self.kinds: dict[str, tuple[str, str, str, bool, bool]] = {}
        self.paths: dict[tuple[str, ...], list[tuple[int, int, str | None, int]]] = {}

    def token(self, token: str) -> tuple[str, bool]:
        """The token put right, and whether it had a misread character; answers are remembered."""
        found = self.answers.get(token)
        if found is None:
            if len(self.answers) > _CACHE:
                self.answers.clear()
            found = self.answers[token] = self._token(token)
        return found

    def _token(self, token: str) -> tuple[str, bool]:
        if len(token) > 3 * LONGEST_WORD:  # no text
            return token, False
        before, word, after = _core(token)
        if len(word) < 2 or _CODE.match(word):
            if not after and not before:
                return token, False
        low = word.lower()
        soft = token.strip(_EDGE_SOFT)
        if soft != word and low not in self.known:  # a sign at the word's edge may be a letter
            fixed = self.decoder.corrected(soft.lower())
            if fixed:
                at = token.find(soft)
                return token[:at] + _as_case(fixed, soft) + token[at + len(soft) :], True
        if len(word) < 2 or _CODE.match(word) or not any(c.isalpha() for c in word):
            return token, False
        if low in self.known or not ("-" in low or "'" in low or "’" in low or "/" in low):
            fixed = self.decoder.corrected(low)
            return (before + _as_case(fixed, word) + after, True) if fixed else (token, False)
        parts = re.split(r"([-'’/])", word)
        whole, wrong = "", False
        joined = self.decoder.corrected(low) if "/" not in low else None
        if joined:
            return before + _as_case(joined, word) + after, True
        for p in parts:
            fixed = self.decoder.corrected(p.lower()) if len(p) > 2 and not p.isdigit() and p.lower() not in self.known else None
            whole += _as_case(fixed, p) if fixed else p
            wrong |= fixed is not None
        return before + whole + after, wrong

    def joint(self, left: str, mark: str, right: str) -> tuple[str, bool]:
        """A word cut at a line end: the whole of it, and whether it was cut (not a compound at its own hyphen)."""
        a, b = _core(left)[1], _core(right)[1]
        tail = right[right.find(b) + len(b) :] if b else ""
        head = left[: left.find(a)] if a else left
        one, two = (a + b).lower(), f"{a}-{b}".lower()
        n1, n2 = self.known.get(one, 0), self.known.get(two, 0)
        cut = None
        if n1 or n2:
            cut = n1 >= n2
        else:
            f1, f2 = self.decoder.corrected(one), self.decoder.corrected(two)
            c1 = self.known[f1] if f1 else 0
            c2 = self.known[f2] if f2 else 0
            if c1 or c2:
                cut = c1 >= c2
            elif mark != "-":
                cut = True
            else:
                whole = [self.decoder.corrected(x.lower()) or (x.lower() if x.lower() in self.known else None) for x in (a, b)]
                cut = not (all(whole) and min(len(a), len(b)) >= 3 and b[:1].islower())
        return head + (a + b if cut else f"{a}-{b}") + tail, cut

    def edges(self, text: str) -> tuple[list[tuple[str, int]], bool]:
        """Keys of the lines that may be running headings, with their line numbers, and whether the page number is printed."""
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        heads, number = [], False
        for i in dict.fromkeys(full[:2] + full[-2:]):
            kind, key = edge_kind(lines[i])
            outer = i in (full[0], full[-1])
            if not outer:
                # the second line from the edge counts only beside a page number or heading at the edge
                near = full[0] if i == full[1] else full[-1]
                if i not in (full[1], full[-2]) or edge_kind(lines[near])[0] == "text":
                    continue
            if kind in ("number", "both"):
                number = True
            if kind in ("head", "both") and key:
                heads.append((key, i))
        return heads, number

    def defects(self, text: str) -> set[str]:
        """hyphen_break and misread, as far as they occur in the page's own lines."""
        found: set[str] = set()
        lines = text.split("\n")
        carried = False  # whether the line's first token belongs to a word cut in the line before
        streams: list[list[str]] = [[]]  # the page's tokens without its line ends, from one blank line to the next
        for line, following in zip(lines, [*lines[1:], ""]):
            tokens = line.split()
            if not tokens:
                streams.append([])
                continue
            last = tokens[-1]
            if carried:
                tokens = tokens[1:]
            carried = False
            if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalnum() | (last[-2] in _SIGNS) and following.strip() and tokens:
                right = following.split()[0]
                if (right[0].isalpha() or right[0] in _SIGNS) and any(c.isalpha() for c in last) and any(c.isalpha() for c in right) and not _CODE.match(last[:-1] + "-" + _core(right)[1]):
                    whole, cut = self.joint(last[:-1], last[-1], right)
                    if cut:
                        found.add("hyphen_break")
                    tokens = [*tokens[:-1], whole]
                    carried = True
            streams[-1] += tokens
        if any(wrong for stream in streams for _, wrong in self.decode(stream)):
            found.add("misread")
        return found

    def repaired(self, text: str, headings: set[str]) -> str:
        """The page as paragraphs: without headings and page numbers, cut words joined, misread letters put right."""
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        drop = {i for key, i in self.edges(text)[0] if key in headings}
        for i in full[:2] + full[-2:]:
            kind, key = edge_kind(lines[i])
            if kind == "number" or (kind == "both" and key in headings):
                drop.add(i)
        kept = ["" if i in drop else x.rstrip("\r") for i, x in enumerate(lines)]
        while kept and not kept[0].strip():
            kept.pop(0)
        while kept and not kept[-1].strip():
            kept.pop()
        breaks = paragraph_breaks(kept)
        out: list[list[str]] = [[]]
        held: tuple[str, str] | None = None
        for i, line in enumerate(kept):
            if i in breaks and held is None and out[-1]:
                out.append([])
            tokens = line.split()
            if held and tokens:
                out[-1].append(self.joint(held[0], held[1], tokens[0])[0])
                tokens = tokens[1:]
                held = None
            if tokens and len(tokens[-1]) > 1 and tokens[-1][-1] in HYPHENS and i + 1 < len(kept) and kept[i + 1].strip() and kept[i + 1].split()[0][0].isalnum():
                held = (tokens[-1][:-1], tokens[-1][-1])
                tokens = tokens[:-1]
            out[-1] += tokens
        rest = [held[0] + held[1]] if held else []
        paragraphs = [[t for t, _ in self.decode(p)] for p in out]
        paragraphs[-1] += rest
        return "\n\n".join(" ".join(p) for p in paragraphs if p)

    def _plain(self, token: str) -> tuple[str, str, str, bool, bool]:
        """What comes before the token's word, the word, what comes after, whether it can be part of a stream, and whether the corpus does not know it."""
        found = self.kinds.get(token)
        if found is None:
            if len(self.kinds) > _CACHE:
                self.kinds.clear()
            before, word, after = _core(token)
            fits = 0 < len(word) <= 3 * LONGEST_WORD and any(c.isalpha() for c in word) and all(c.isalpha() or c in _SIGNS for c in word) and not _CODE.match(word)
            strange = fits and word.lower() not in self.known
            soft = token.strip(_EDGE_SOFT)
            if strange and soft != word and self.decoder.corrected(soft.lower()):  # a sign at the word's edge is a letter: token() sees to it
                fits = strange = False
            found = self.kinds[token] = (before, word, after, fits, strange)
        return found

    def decode(self, tokens: list[str]) -> Iterator[tuple[str, bool]]:
        """A paragraph's tokens put right, and whether each had a misread character.

        Runs of unknown tokens are decoded as one stream with the known ones beside them; where the best path has words other than the tokens, its
        words come out, and elsewhere each token by itself.
        """
        kinds = [self._plain(t) for t in tokens]
        i = 0
        while i < len(tokens):
            # a known token opens a stream if an unknown one follows it directly
            j = i
            if kinds[i][3]:
                while j + 1 < len(tokens) and (kinds[j][4] or kinds[j + 1][4]) and kinds[j + 1][3] and not kinds[j][2] and not kinds[j + 1][0]:
                    j += 1
            if not any(k[4] for k in kinds[i : j + 1]):
                yield self.token(tokens[i])
                i += 1
                continue
            yield from self._decoded(tokens[i : j + 1], kinds[i : j + 1])
            i = j + 1

    def _decoded(self, tokens: list[str], kinds: list[tuple[str, str, str, bool, bool]]) -> Iterator[tuple[str, bool]]:
        words = [k[1] for k in kinds]
        key = tuple(w.lower() for w in words)
        path = self.paths.get(key)
        if path is None:
            if len(self.paths) > _CACHE:
                self.paths.clear()
            path = self.paths[key] = self.decoder.decoded(key)
        whole, bounds = "".join(words), {0: 0}
        for k, w in enumerate(words):
            bounds[max(bounds) + len(w)] = k + 1
        for at, end, word, confused in path:
            if at in bounds and bounds.get(end) == bounds[at] + 1:  # a token by itself
                yield self.token(tokens[bounds[at]])
            else:
                before = kinds[bounds[at]][0] if at in bounds else ""
                after = kinds[bounds[end] - 1][2] if end in bounds else ""
                yield before + _as_case(word or "", whole[at:end]) + after, confused > 0


def _folded(text: str) -> str:
    """A heading's key: the same for other case, other spacing and the usual misreadings."""
    t = re.sub(r"[^\w@+!|$]+", "", text.casefold())
    for seen, true in (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("!", "i"), ("+", "t"), ("@", "a"), ("b", "h"), ("c", "e"), ("|", "l")):
        t = t.replace(seen, true)
    return t


def edge_kind(line: str) -> tuple[str, str]:
    """(kind, key) of a line at a page's edge: number, head, both (heading with the number beside) or text."""
    line = line.strip()
    if _PAGE_NO.match(line):
        return "number", ""
    if len(line) > 80:
        return "text", ""
    parts = [p.strip() for p in _BESIDE.split(line) if p.strip()]
    rest = [p for p in parts if not _PAGE_NO.match(p)]
    if len(parts) > 1 and len(rest) < len(parts) and rest:
        return "both", _folded(" ".join(rest))
    if len(line.split()) > 9 or line[-1:] in ".,;:?!؟،" or line[-1:] in HYPHENS:
        return "text", ""
    return "head", _folded(line)


def paragraph_breaks(lines: list[str]) -> set[int]:
    """Line numbers that begin a paragraph, by the cheapest sequence of breaks and joins.

    A blank line before speaks for a break, as do a short line that ends a sentence and a list mark; a line that goes on in lower case or
    ends without a full stop speaks against.  Single-line paragraphs in a row cost extra, so that the decision at one line weighs on the next.
    """
    full = sorted(len(x) for x in lines if x.strip())
    usual = full[int(len(full) * 0.8)] if full else 0
    costs: list[tuple[int, float]] = []
    before, blank = "", True
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            blank = True
            continue
        gain = 3.0 if blank else -1.5
        if before:
            gain += 1.0 if before[-1] in ".:!?؟»”\"" else -2.5
            gain += 1.5 if len(before) < 0.7 * usual and before[-1] in ".:!?؟" else 0
            gain += -3.0 if s[0].islower() else 0
            gain += 4.0 if re.match(r"(?:[-*•]|\d{1,3}[.)])\s", s) else 0
        costs.append((i, -gain))
        before, blank = s, False
    # two states a line: it begins a paragraph or goes on
    go, begin = math.inf, 0.0
    back: list[tuple[bool, bool]] = []
    for k, (_, cost) in enumerate(costs):
        if k == 0:
            back.append((True, True))
            continue
        from_begin, from_go = begin, go
        to_begin = min(from_begin + 0.5, from_go) + cost
        to_go = min(from_begin, from_go)
        back.append((from_begin + 0.5 <= from_go, from_begin <= from_go))
        begin, go = to_begin, to_go
    out, state = set(), begin <= go
    for k in range(len(costs) - 1, -1, -1):
        if state:
            out.add(costs[k][0])
        state = back[k][0] if state else back[k][1]
    return out


def _scan(batches: Iterator[pd.DataFrame], counts: dict[str, int]) -> Iterator[pd.DataFrame]:
    reader = PageReader(counts)
    for pdf in batches:
        rows = []
        for key, owner, text in zip(pdf["key"], pdf["owner"], pdf["text"]):
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            rows += [(key, owner, d, None) for d in reader.defects(text)]
            heads, number = reader.edges(text)
            if number:
                rows.append((key, owner, "page_number", None))
            rows += [(key, owner, "heading", k) for k in {k for k, _ in heads}]
        yield pd.DataFrame(rows, columns=["key", "owner", "defect", "heading"])


def _source(pages: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    return pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{owner}`").alias("owner"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())


def scan_marks(pages: DataFrame, key: str, owner: str, text: str, counts: dict[str, int]) -> DataFrame:
    """key, owner, defect (hyphen_break, misread, page_number, heading), heading (its key): what each page shows by itself."""
    source = _source(pages, key, owner, text)
    k, o = (source.schema[c].dataType.simpleString() for c in ("key", "owner"))
    return source.mapInPandas(partial(_scan, counts=counts), f"key {k}, owner {o}, defect string, heading string")


def running_headings(marks: DataFrame) -> DataFrame:
    """key, owner, heading: lines at the edge of a page that another page of the same owner repeats at its own."""
    heads = marks.where("defect = 'heading' AND heading <> ''").select("key", "owner", "heading").distinct()
    again = heads.groupBy("owner", "heading").agg(F.count("*").alias("pages")).where("pages > 1").select("owner", "heading")
    return heads.join(again, ["owner", "heading"]).select("key", "owner", "heading")


def page_defects(marks: DataFrame) -> DataFrame:
    """key, owner, defect, one row per page and defect; a page given in several rows counts once."""
    own = marks.where("defect <> 'heading'").select("key", "owner", "defect")
    return own.unionByName(running_headings(marks).select("key", "owner", F.lit("running_header").alias("defect"))).distinct()


def repaired_pages(pages: DataFrame, key: str, owner: str, text: str, counts: dict[str, int], marks: DataFrame) -> DataFrame:
    """key, text: each page's continuous paragraphs.  Null texts give no row, empty ones an empty text; one row per key."""
    source = _source(pages, key, owner, text).dropDuplicates(["key"])
    heads = running_headings(marks).groupBy("key").agg(F.collect_set("heading").alias("headings"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = PageReader(counts)
        for pdf in batches:
            texts = [reader.repaired(t.replace("\r\n", "\n").replace("\r", "\n"), set(h) if h is not None else set()) for t, h in zip(pdf["text"], pdf["headings"])]
            yield pd.DataFrame({"key": pdf["key"], "text": texts})

    return source.select("key", "text").join(heads, "key", "left").mapInPandas(run, f"key {source.schema['key'].dataType.simpleString()}, text string")
