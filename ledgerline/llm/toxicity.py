"""Toxicity scores behind a noisy-channel deobfuscation.

Tokens that leetspeak, separators, spacing or repetition may have disguised become lattices: each character offers the
letters it can stand for, or nothing. Viterbi picks the path that is likeliest under a character trigram model (counted
over all documents) and the channel's costs. The restored text is scored by a logistic model over its distinct words and
their beginnings, learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _small
from .common import checkpoint, table, teaching, without

#: The model's letters: a to z and the small letters of Latin-1; number 0 is anything else, that is, a word's edge.
LETTERS = "".join(map(chr, range(ord("a"), ord("z") + 1))) + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
SIZE = len(LETTERS) + 1
NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a character can stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "?": ""}
SEPARATORS = set("._-*~^'`,:;/\\·•")
#: Costs of the channel, in nats: a substitution, a dropped separator, a dropped repetition.
SUBSTITUTED, DROPPED, COLLAPSED = 1.0, 0.5, 0.5
#: What it costs to take a space between single letters for a real one.
KEPT = 1.5
#: What it costs to drop a space beside a part of two or more signs, which mostly is a word of its own.
SPLIT = 6.0
EDGES = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()) + "«»¿¡“”‘’„…–—"
#: Marks of prose that may also stand for a letter: free to drop at a token's edge. The other leet signs among EDGES stay.
LOOSE = "!(¡"
SIGNS = "$@+|"
TRIMMED = "".join(c for c in EDGES if c not in SIGNS)
MARKS = "".join(c for c in TRIMMED if c not in LOOSE)
DOUBLED, TRIPLED, PLAIN = re.compile(f"([{LETTERS}])\\1"), re.compile(f"([{LETTERS}])\\1\\1"), re.compile(f"[{LETTERS}]+")
#: Two or more fragments of at most three characters each.
RUN = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3})+(?!\S)")
#: A fragment that the channel leaves one reading, if its letters differ; marks beside it drop at the same price anyway.
CERTAIN = re.compile(f"[{re.escape(''.join(sorted(SEPARATORS)))}]*([{LETTERS}]+)[{re.escape(''.join(sorted(SEPARATORS)))}]*")
#: Bytes of text that are restored together; of words a quarter, since each has up to seven features.
BATCH = 4 << 20
#: Longer tokens are decoded each time that they occur, so that caches stay small.
KEPT_LENGTH = 64
PREFIXES = (3, 4, 5, 6, 7, 8)


def _numbers() -> np.ndarray:
    of = np.zeros(0x110000, dtype=np.int64)
    for c, i in NUMBER.items():
        of[ord(c)] = i
        if len(c.upper()) == 1:
            of[ord(c.upper())] = i
    return of


def trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts, flat; tasks count for themselves and their counts are summed.

    At most ``SIZE`` ** 3 numbers, whatever the corpus, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _numbers(), np.zeros(SIZE**3, dtype=np.int64)
        for whole in batches:
            for batch in _small(whole, 4 << 20):
                joined = "  ".join(["", *batch.column(0).fill_null("").to_pylist(), ""])
                x = of[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
                x = x[(x > 0) | (np.roll(x, 1) > 0) | (np.roll(x, 2) > 0)]
                if len(x) > 2:
                    total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(SIZE**3, dtype=np.int64)
    found = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out[found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of the third letter after the first two, interpolated with lower orders."""
    c3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    c2 = c3.sum(axis=0)
    p1 = (c2.sum(axis=0) + 1) / (c2.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


@lru_cache(maxsize=8192)
def _options(c: str, repeated: bool, edge: bool) -> tuple[tuple[str, float, int], ...]:
    """(letter, cost, the letter's number) of what a character may be; an empty letter is a dropped character."""
    options = [(c, 0.0)] if c in NUMBER else [(x, SUBSTITUTED) for x in LEET.get(c, "")]
    if c == " ":
        options.append((" ", KEPT))
    if c in SEPARATORS or unicodedata.category(c) in ("Cf", "Mn") or c == " ":
        options.append(("", DROPPED))
    if repeated and options and c != " ":
        options.append(("", COLLAPSED))
    if edge:
        options.append(("", 0.0))
    return tuple((x, price, NUMBER.get(x, 0)) for x, price in options or [(c if c.isalpha() else " ", 0.0)])


def _steps(token: str) -> list[tuple[tuple[str, float, int], ...]]:
    first = len(token) - len(token.lstrip(TRIMMED + " "))
    last = len(token.rstrip(TRIMMED + " "))
    if " " not in token and not first and last == len(token):
        return [_options(c, c == before, False) for before, c in zip(" " + token, token, strict=False)]
    out, before, gap = [], "", 0
    whole = [len(f.strip(MARKS)) > 1 for f in token.split(" ")]
    for i, c in enumerate(token):
        if c == " ":
            gap += 1
        if c == " " and (whole[gap - 1] or whole[gap]):
            out.append(((" ", KEPT, 0), ("", SPLIT, 0)))
        else:
            out.append(_options(c, c == before, not first <= i < last))
        before = c
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character, what it may be and at what cost; an empty string is a dropped character.

    Marks at the edges drop free of cost; letters that the model doesn't know stand for themselves.
    """
    return [[(letter, price) for letter, price, _ in options] for options in _steps(token)]


def decode(token: str, cost: np.ndarray | list[float]) -> str:
    """The likeliest word behind a lower-case token of any length: Viterbi over the last two letters.

    After a space that stays a word begins as at the start. Paths are chains of back-pointers; states are bounded, so
    time and memory are linear. ``cost`` may be flat.
    """
    flat = cost if isinstance(cost, list) else cost.ravel().tolist()
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in _steps(token):
        if len(options) == 1 and len(best) == 1:
            letter, price, n = options[0]
            if letter:
                for ab, (paid, path) in best.items():
                    best = {ab % SIZE * SIZE + n if letter != " " else 0: (paid + price + flat[ab * SIZE + n], (path, letter))}
            continue
        following: dict[int, tuple[float, tuple | None]] = {}
        for ab, (paid, path) in best.items():
            row, shifted = ab * SIZE, ab % SIZE * SIZE
            for letter, price, n in options:
                if letter:
                    state, total, made = shifted + n if letter != " " else 0, paid + price + flat[row + n], (path, letter)
                else:
                    state, total, made = ab, paid + price, path
                old = following.get(state)
                if old is None or total < old[0]:
                    following[state] = (total, made)
        best = following
    path, least = None, float("inf")
    for ab, (paid, made) in best.items():
        if paid + flat[ab * SIZE] < least:
            path, least = made, paid + flat[ab * SIZE]
    out = []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


@dataclass
class Restorer:
    """Restores tokens of any length; what a token of up to ``KEPT_LENGTH`` characters becomes is kept, up to ``most`` of them.

    A word whose only doubt is which of its doubled letters to keep needs no search: between two letters that stay, the
    paths with and without the repetition end in the same state, so each is decided alone, by a table.
    """

    cost: np.ndarray
    most: int = 100_000

    def __post_init__(self) -> None:
        self.known: dict[str, str] = {}
        self.runs: dict[str, list[str]] = {}
        self.flat = self.cost.ravel().tolist()
        i = np.arange(SIZE)
        kept = self.cost[:, i, i][:, :, None] + self.cost[i, i, :][None]
        self.collapses = (COLLAPSED + self.cost < kept).ravel().tobytes()

    def word(self, token: str) -> str:
        """A white-space-delimited token in lower case, without the marks around it, decoded where it may be disguised."""
        return self.readings(token)[0]

    def readings(self, token: str) -> tuple[str, ...]:
        """The word, and for a token without letters, which may be a number, the word that it may spell besides."""
        core = token.strip(MARKS).lower()
        if not core:
            return ("",)
        if core.isalpha():
            if not DOUBLED.search(core):
                return (core,)
            if PLAIN.fullmatch(core) and not TRIPLED.search(core):
                return (self._collapsed(core),)
        if any(c.isalpha() for c in core):
            return (self._decoded(core),)
        lead = token.lstrip(EDGES)
        plain, before = lead.rstrip(EDGES), token[: len(token) - len(lead)][-1:]
        return (before + plain if plain and before in ("$", "@") else plain), self._decoded(core)

    def _collapsed(self, word: str) -> str:
        """What ``decode`` makes of a word of the model's letters, none of them three times running."""
        out, at, n = [], 0, len(word)
        for m in DOUBLED.finditer(word):
            i = m.start()
            before, after = NUMBER[word[i - 1]] if i else 0, NUMBER[word[i + 2]] if i + 2 < n else 0
            if self.collapses[(before * SIZE + NUMBER[word[i]]) * SIZE + after]:
                out.append(word[at : i + 1])
                at = i + 2
        return "".join([*out, word[at:]]) if out else word

    def _decoded(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = decode(token, self.flat)
            if len(token) <= KEPT_LENGTH:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = got
        return got

    def joined(self, run: str) -> list[str]:
        """Words that a run of fragments, with a space between them, spells where the model prefers them joined."""
        got = self.runs.get(run)
        if got is None:
            got = decode(run.lower(), self.flat).split()
            if got:
                own = {w for f in run.split() for w in self.readings(f)}
                got = [w for w in got if w not in own]
            if len(run) <= KEPT_LENGTH:
                if len(self.runs) >= self.most:
                    self.runs.clear()
                self.runs[run] = got
        return got

    def text(self, text: str) -> str:
        """The whole text restored; white space becomes single spaces."""
        text = RUN.sub(lambda m: self._decoded(" ".join(m[0].split()).lower()), text)
        return " ".join(filter(None, map(self.word, text.split())))


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def features(word: str) -> list[str]:
    """A word and its beginnings; ``^`` marks the latter."""
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)] if word else []


@dataclass
class Model:
    """The language model's costs, and the logistic model: a weight by feature, one for the text's length, the bias."""

    cost: np.ndarray
    weights: dict[str, float]
    length: float
    bias: float

    def scorer(self):
        """A function from texts to their scores."""
        tokens, weights = Tokens(self.cost), self.weights
        heads = {(f[1:] if f.startswith("^") else f)[:3] for f in weights}

        def of(texts: pa.Array | list[str | None]) -> np.ndarray:
            owner, word, names = tokens.words(texts)
            weight = np.fromiter((sum(weights.get(f, 0.0) for f in features(w)) if w[:3] in heads else 0.0 for w in names), np.float64, len(names))
            n = np.bincount(owner, minlength=len(texts))
            total = self.bias + np.bincount(owner, weights=weight[word], minlength=len(texts)) + self.length * np.log1p(n)
            return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

        return of


class Tokens:
    """Distinct restored words of texts. Texts come in batches: each token and each run of fragments of a batch is restored once."""

    def __init__(self, cost: np.ndarray):
        self.restorer = Restorer(cost)

    def words(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text's number, word's number) of each text's distinct words, by both numbers, and the words."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.utf8_split_whitespace(texts.fill_null(""))
        found = split.flatten().dictionary_encode()
        code, tokens = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
        owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        word: dict[str, int] = defaultdict()
        word.default_factory = word.__len__
        read, more = np.zeros(len(tokens), dtype=np.int64), []
        for i, token in enumerate(tokens):
            own = self.restorer.readings(token)
            read[i] = word[own[0]]
            if len(own) > 1:
                more.append((i, word[own[1]]))
        owners, words = [owner], [read[code]]
        if more:
            second = np.full(len(tokens), -1)
            second[[i for i, _ in more]] = [w for _, w in more]
            there = np.flatnonzero(second[code] >= 0)
            owners.append(owner[there])
            words.append(second[code[there]])
        for i, run in self._runs(code, owner, tokens):
            got = np.array([word[w] for w in run], dtype=np.int64)
            words.append(got)
            owners.append(np.full(len(got), owner[i]))
        size = max(1, len(word))
        pairs = _distinct(np.concatenate(owners) * size + np.concatenate(words))
        if "" in word:
            pairs = pairs[pairs % size != word[""]]
        return pairs // size, pairs % size, list(word)

    def _runs(self, code: np.ndarray, owner: np.ndarray, tokens: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(place of its first token, words that it spells joined) of each run of fragments that spells any.

        Runs end where the decoder surely keeps a space. Between two fragments of two or more certain letters that is
        seen at once: whether the space stays or goes, the letters before and after it are the same, and so is the state
        that both ways end in. A certain letter of its own between two such fragments has four ways to compare.
        """
        short = np.fromiter((0 < len(t) < 4 for t in tokens), bool, len(tokens))
        head, tail, lone = (np.full(len(tokens), -1) for _ in range(3))
        for u in np.flatnonzero(short).tolist():
            letters = CERTAIN.fullmatch(tokens[u].lower())
            if letters:
                n = [NUMBER[c] for c in letters[1]]
                if len(n) == 1:
                    lone[u] = n[0]
                elif not DOUBLED.search(letters[1]):
                    head[u], tail[u] = n[0] * SIZE + n[1], n[-2] * SIZE + n[-1]
        at = np.flatnonzero(short[code])
        if not len(at):
            return
        linked = (np.diff(at) == 1) & (owner[at[1:]] == owner[at[:-1]])
        head, tail, lone = head[code[at]], tail[code[at]], lone[code[at]]
        cost = self.restorer.cost.ravel()
        ends, begins = cost[tail * SIZE], cost[head // SIZE] + cost[head]

        def through(before: np.ndarray, after: np.ndarray) -> np.ndarray:
            """The two letters ``after``, straight after the two letters ``before``."""
            return cost[before * SIZE + after // SIZE] + cost[before % SIZE * SIZE * SIZE + after]

        sure = (tail[:-1] >= 0) & (head[1:] >= 0)
        sure &= KEPT + ends[:-1] + begins[1:] < SPLIT + through(tail[:-1], head[1:])
        cut = ~linked | sure
        if len(at) > 2:
            a, y, c = tail[:-2], lone[1:-1], head[2:]
            alone, joins = cost[y] + cost[y * SIZE], cost[a * SIZE + y]
            after = a % SIZE * SIZE + y
            apart = KEPT + ends[:-2] + alone + KEPT + begins[2:]
            others = [KEPT + ends[:-2] + cost[y] + SPLIT + through(y, c), SPLIT + joins + cost[after * SIZE] + KEPT + begins[2:], SPLIT + joins + SPLIT + through(after, c)]
            sure = (a >= 0) & (y >= 0) & (c >= 0) & linked[:-1] & linked[1:] & (apart < np.minimum.reduce(others))
            cut[:-1] |= sure
            cut[1:] |= sure
        first = np.flatnonzero(np.append(cut, True) & ~np.append(True, cut))  # ends of runs of two or more
        last = at[first]
        start = at[np.flatnonzero(np.append(True, cut) & ~np.append(cut, True))]
        found: dict[str, list[str]] = {}
        for i, j in zip(start.tolist(), last.tolist(), strict=True):
            run = " ".join([tokens[u] for u in code[i : j + 1].tolist()])
            got = found.get(run)
            if got is None:
                got = found[run] = self.restorer.joined(run)
            if got:
                yield i, got

    def distinct(self, text: str) -> set[str]:
        """The distinct restored words of one text."""
        _, word, names = self.words([text])
        return {names[i] for i in word.tolist()}


def regression(rows: np.ndarray, columns: np.ndarray, n_columns: int, length: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float, float]:
    """(weights, length's weight, bias) of a logistic model over counts of features, by full-batch adaptive gradients."""
    w, size, bias = np.zeros(n_columns), 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    squares = np.full(n_columns + 2, 1e-8)
    for _ in range(rounds):
        margin = bias + size * length + np.bincount(rows, weights=w[columns], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        gradient = np.concatenate([np.bincount(columns, weights=error[rows], minlength=n_columns) + ridge * w, [(error * length).sum(), error.sum()]])
        squares += gradient**2
        step = rate * gradient / np.sqrt(squares)
        w, size, bias = w - step[:-2], size - step[-2], bias - step[-1]
    return w, float(size), float(bias)


def worded(docs: DataFrame, cost: np.ndarray, text: str = "text", label: str = "__label") -> DataFrame:
    """``label`` and ``words``, the distinct restored words of each text."""
    schema = T.StructType([docs.schema[label], T.StructField("words", T.ArrayType(T.StringType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(cost)
        for whole in batches:
            for batch in _small(whole, BATCH):
                owner, word, names = tokens.words(batch.column(1))
                bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(names, pa.string()).take(pa.array(word)))], names=schema.names)

    return docs.select(label, text).mapInArrow(run, schema)


def _featured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, feature's number) of the distinct features of each row's words, and the features."""
    lists = batch.column(1)
    found = lists.flatten().dictionary_encode()
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    own = [[number[f] for f in features(w)] for w in found.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum()))
    code = found.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    starts, n = (np.cumsum(sizes) - sizes)[code], sizes[code]
    at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    size = max(1, len(number))
    pairs = _distinct(np.repeat(rows, n) * size + flat[at])
    return pairs // size, pairs % size, list(number)


def evidence_counts(taught: DataFrame) -> DataFrame:
    """feature, pos and neg: how many toxic and other rows of ``worded`` have it; batches count for themselves first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, BATCH // 4):
                row, feature, names = _featured(batch)
                toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)[row]
                pos, neg = (np.bincount(feature[x], minlength=len(names)) for x in (toxic, ~toxic))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos), pa.array(neg)], names=["feature", "pos", "neg"])

    return taught.select("__label", "words").mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", sample_rows: int = 50_000, least_rows: int = 3, sure: float = 3.0) -> Model:
    """Trigrams of all ``docs``, and a logistic model from at most ``sample_rows`` labelled rows (``common.teaching``).

    Rows without key or label do not teach. Features are words and beginnings that ``least_rows`` toxic rows have, and
    whose odds of being in a toxic row exceed twice the overall odds even at the lower end of a ``sure``-sigma interval.
    The sample bounds what is broadcast and what reaches the driver. Without toxic labels every score is the prior.
    """
    cost = language_model(trigrams(docs))
    taught = checkpoint(worded(teaching(docs, labels.where(F.col(label).isin(0, 1)), label, sample_rows, key), cost))
    rows, toxic = taught.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0.0))).first()
    if not toxic:
        return Model(cost, {}, 0.0, float(np.log(1 / (rows + 10))))
    n = F.col("pos") + F.col("neg")
    p, z = F.col("pos") / n, sure * sure
    low = (p + z / (2 * n) - sure * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
    strong = evidence_counts(taught).where((F.col("pos") >= least_rows) & (low > 2 * toxic / (rows + toxic))).orderBy("feature").select("feature").toPandas()
    names = {f: i for i, f in enumerate(strong["feature"])}
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for whole in batches:
            for batch in _small(whole, BATCH // 4):
                row, feature, own = _featured(batch)
                number = np.array([names.get(f, -1) for f in own], dtype=np.int32)[feature]
                bounds = np.searchsorted(row[number >= 0], np.arange(batch.num_rows + 1)).astype(np.int32)
                length = np.log1p(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.ListArray.from_arrays(pa.array(bounds), pa.array(number[number >= 0]))], names=["y", "length", "has"])

    got = taught.select("__label", "words").mapInArrow(held, "y double, length double, has array<int>").toPandas()
    counts = got["has"].map(len).to_numpy(dtype=np.int64)
    columns = np.concatenate([*map(np.asarray, got["has"]), np.zeros(0)]).astype(np.int64)
    w, length, bias = regression(np.repeat(np.arange(len(got)), counts), columns, len(names), got["length"].to_numpy(), got["y"].to_numpy(dtype=np.float64))
    return Model(cost, {f: float(w[i]) for f, i in names.items()}, length, bias)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All columns and ``into`` (0 to 1), from the whole text alone; null and empty texts have the bias alone.

    A column of ``df`` that has the name ``into`` already, in any case, is replaced.
    """
    df = without(df, into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())])
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for whole in batches:
            for batch in _small(whole, BATCH):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of(batch.column(at)))], names=schema.names)

    return df.mapInArrow(run, schema)


def restored(df: DataFrame, model: Model, text: str = "text", into: str = "restored") -> DataFrame:
    """All columns and ``into``, the whole text as the decoder reads it; null texts stay null. A column that has the name already is replaced."""
    df = without(df, into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model.cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for whole in batches:
            for batch in _small(whole, BATCH):
                made = [t if t is None else restorer.text(t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(key) -> F.Column:
    """Rows that never teach: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
