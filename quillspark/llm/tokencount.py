"""Token counts under a unigram model, with forward scores shared through a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, pick, small_batches

#: Cached runs and pre-tokens that a task holds before it starts anew; rows and bytes of one trie: bounds on memory, not on the work.
CACHED, ROWS, WIDTH = 800_000, 20_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Unigram:
    """Scores of byte strings: the log of Zipf's law over the vocabulary's ranks, as no counts come with it."""

    def __init__(self, path: str):
        pairs = [line.split() for line in open(path, "rb").read().splitlines() if line]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.score = {token: -math.log(rank + 1) - norm for token, rank in ranks.items()}
        self.longest = max(map(len, self.score))


class Vocabulary:
    """The tokens of each length as sorted numbers (up to eight bytes) or digests of them, with scores."""

    def __init__(self, model: Unigram):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        groups: dict[int, list[bytes]] = {}
        for token in model.score:
            groups.setdefault(len(token), []).append(token)
        for length, own in groups.items():
            letters = np.frombuffer(b"".join(own), np.uint8).reshape(-1, length)
            keys = packed(letters)
            order = np.argsort(keys, kind="stable")
            scores = np.array([model.score[t] for t in own])
            self.by_length[length] = keys[order], scores[order], letters[order]

    def scores(self, letters: np.ndarray) -> np.ndarray:
        """The score of each row's token, minus infinity where it is none."""
        out = np.full(len(letters), -np.inf)
        if letters.shape[1] in self.by_length:
            keys, scores, known = self.by_length[letters.shape[1]]
            own = packed(letters)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.nonzero(keys[at] == own)[0]
            if letters.shape[1] > 8:  # digests only: the bytes decide
                hit = hit[(known[at[hit]] == letters[hit]).all(axis=1)]
            out[hit] = scores[at[hit]]
        return out


def packed(letters: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, one to one up to eight bytes."""
    out = np.zeros(len(letters), np.uint64)
    for k in range(letters.shape[1]):
        out = out * np.uint64(256 if letters.shape[1] <= 8 else 0x9E3779B97F4A7C15) + letters[:, k]
    return out


class Trie:
    """Distinct pre-tokens share prefixes; a node keeps the best score of its prefix and the tokens it takes.

    The forward score of a node is the best, over vocabulary tokens that end there, of the score at the token's
    start plus the token's, computed once for all pre-tokens that begin alike. Pre-tokens are inserted in sorted
    order, so a row shares its nodes with the row above up to their common prefix, and the nodes of one depth are
    made together. Equal scores go to the longer last token. Single bytes are all in the vocabulary, so each node can
    be reached.
    """

    def __init__(self, model: Unigram):
        self.model, self.vocabulary = model, Vocabulary(model)

    def terminals(self, tokens: list[bytes]) -> np.ndarray:
        """(number of tokens, score) at the terminal node of each of these distinct, non-empty pre-tokens."""
        out = np.zeros((len(tokens), 2))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for k in np.nonzero(sizes > WIDTH)[0]:
            out[k] = self._alone(tokens[k])
        short = sorted(np.nonzero(sizes <= WIDTH)[0].tolist(), key=tokens.__getitem__)
        for at in range(0, len(short), ROWS):
            own = short[at : at + ROWS]
            out[own] = self._insert([tokens[k] for k in own])
        return out

    def _insert(self, tokens: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in tokens])
        wide = int(sizes.max())
        letters = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in tokens), np.uint8).reshape(-1, wide)
        common = np.zeros(len(tokens), np.int64)
        same = np.logical_and.accumulate(letters[1:] == letters[:-1], axis=1).sum(axis=1)
        common[1:] = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
        rows = np.arange(len(tokens))
        # node[i, e]: the row that made the node of row i's first e bytes
        made = np.arange(wide + 1)[None, :] > common[:, None]
        node = np.maximum.accumulate(np.where(made, rows[:, None], 0), axis=0)
        best, count = np.zeros((len(tokens), wide + 1)), np.zeros((len(tokens), wide + 1), np.int64)
        for end in range(1, wide + 1):
            new = np.nonzero(made[:, end] & (sizes >= end))[0]
            top, taken = np.full(len(new), -np.inf), np.zeros(len(new), np.int64)
            for start in range(end):
                score = self.vocabulary.scores(letters[new, start:end])
                hit = np.nonzero(score > -np.inf)[0]
                if len(hit):
                    before = node[new[hit], start]
                    total = best[before, start] + score[hit]
                    better = total > top[hit]
                    top[hit[better]] = total[better]
                    taken[hit[better]] = count[before[better], start] + 1
            best[new, end], count[new, end] = top, taken
        last = node[rows, sizes]
        return np.column_stack([count[last, sizes], best[last, sizes]])

    def _alone(self, token: bytes) -> tuple[int, float]:
        """The same along one path, for very long pre-tokens."""
        best, tokens = [0.0], [0]
        score, lengths = self.model.score, sorted(self.vocabulary.by_length, reverse=True)
        for end in range(1, len(token) + 1):
            top, count = -math.inf, 0
            for start in [end - n for n in lengths if n <= end]:
                s = score.get(token[start:end])
                if s is not None and best[start] + s > top:
                    top, count = best[start] + s, tokens[start] + 1
            best.append(top)
            tokens.append(count)
        return tokens[-1], best[-1]


class Numbers(dict):
    """Keys numbered from 0 in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        out = self[key] = len(self)
        return out


class Sums:
    """Numbers of keys, and rows of sums for them that grow."""

    def __init__(self, wide: int):
        self.at = Numbers()
        self.rows = np.zeros((1024, wide))

    def put(self, first: int, rows: np.ndarray) -> None:
        while first + len(rows) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(rows)] = rows


class Counter:
    """Counts whole texts; runs between single spaces are looked up, since most recur."""

    def __init__(self, path: str):
        import public_tokenizers

        self.trie = Trie(Unigram(path))
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.tokens, self.runs = Sums(2), Sums(3)

    def _split(self, run: str) -> list[str]:
        """The pre-tokens of a space and a run; letters alone, with a sign behind them perhaps, need no pattern."""
        if run.isalpha():
            return [" " + run]
        if run[-1] in ".,;:!?" and run[:-1].isalpha():
            return [" " + run[:-1], run[-1]]
        return self.pattern(" " + run)

    def _sums(self, split: list[list[str]]) -> np.ndarray:
        """(pre-tokens, tokens, score) of each list of pre-tokens."""
        at, held = self.tokens.at, len(self.tokens.at)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        places = np.fromiter(map(at.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        fresh = list(islice(at, held, None))
        self.tokens.put(held, self.trie.terminals([t.encode("utf-8", "surrogatepass") for t in fresh]))
        out = np.zeros((len(split), 3))
        out[:, 0] = sizes
        some = np.nonzero(sizes)[0]
        if len(some):
            first = (np.cumsum(sizes) - sizes)[some]
            out[some, 1:] = np.add.reduceat(self.tokens.rows[places], first, axis=0)
        return out

    def count_all(self, texts: list[str]) -> np.ndarray:
        """(pre-tokens, tokens, score) of each text.

        Pre-tokens never cross a single space between other characters, so the pieces of such a split are counted
        alone; a text with other white space around a space is counted whole.
        """
        if len(self.runs.at) > CACHED or len(self.tokens.at) > CACHED:
            self._clear()
        pieces = [t.split(" ") for t in texts]
        heads = [own.pop(0) for own in pieces]
        at, held = self.runs.at, len(self.runs.at)
        places = [np.fromiter(map(at.__getitem__, own), np.int64, len(own)) for own in pieces]
        fresh = list(islice(at, held, None))
        alone = [bool(r) and not r[0].isspace() and not r[-1].isspace() for r in fresh]
        rows = np.full((len(fresh), 3), np.nan)  # not a number where a run's neighbours matter
        rows[np.array(alone, bool)] = self._sums([self._split(r) for r, ok in zip(fresh, alone) if ok])
        self.runs.put(held, rows)
        rest = np.array([self.runs.rows[own].sum(axis=0) for own in places]).reshape(-1, 3)
        whole = np.isnan(rest[:, 0]) | np.array([bool(h) and h[-1].isspace() for h in heads], bool)
        rest[whole] = 0
        return rest + self._sums([self.pattern(t if w else h) for t, h, w in zip(texts, heads, whole.tolist())])


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, score (natural log).

    Every whole text is counted; null and empty texts count zero with score 0. Repeated rows and null ids are
    returned as they are. An empty table gives no rows. Nothing is shuffled; each task builds a bounded trie of the
    new pre-tokens of a batch and remembers terminal counts.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in by_bytes(batches, "text"):
            got = counter.count_all([t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array(got[:, k].astype(kind)) for k, kind in enumerate((np.int64, np.int64, np.float64))]
            columns = [batch.column("doc_id"), *counts]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens", "score"])

    small_batches(docs.sparkSession)
    return pick(docs, doc_id="doc_id:long", text="text:string").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("score", F.round("score", 6))
