"""Encoding of a corpus with a public byte-level BPE tokenizer.

Frequent words of the corpus are compiled, with their token ids, into a minimal acyclic automaton whose states share
suffixes; a path's number is the word's place in a table of ids. Tasks memory-map it. Words outside it are merged
exactly, so the lexicon changes the speed and never a result.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shared_dir, staged

TOKENIZERS = "/opt/tokenizers"
#: Words in the lexicon at most.
LEXICON_WORDS = 60_000
#: Words that a task keeps with their ids before it starts afresh.
CACHE_WORDS = 400_000

#: Characters split at once.
CHUNK = 1_000_000

# Unicode's White_Space, and the endings that the word pattern splits off after an apostrophe.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
_B, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    valid = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{WHITE_SPACE}]+")):
        for m in regex.finditer(pattern, valid):
            for run in regex.findall(r"[\x00-\ud7ff]+|[\ue000-\U0010ffff]+", m[0]):
                out[ord(run[0]) : ord(run[-1]) + 1] = kind
    return out


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start in texts laid end to end; first marks the first character of each text.

    The same as leftmost matching of: an apostrophe ending; letters, numbers or other characters with at most one blank
    before them; white space up to the last character before a word; white space.
    """
    n = len(codes)
    kind = char_classes()[codes]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    last = np.append(run[1:], True)
    ends_text = np.append(first[1:], True)
    space, blank = kind == SPACE, codes == 32
    starts = run & ~space
    # The last white space before a word goes with the word if it is a blank, and stands alone if it is not.
    before_word = space & last & ~ends_text
    glued = before_word & blank
    joined = np.zeros(n, bool)
    joined[1:] = glued[:-1]
    starts = (starts & ~joined) | (run & space) | before_word
    # Endings: a lone apostrophe that no blank precedes.
    i = np.flatnonzero((codes == 39) & run & last & ~joined & ~ends_text)
    if len(i):
        nxt = codes[i + 1]
        far = np.minimum(i + 2, n - 1)
        two = (i + 2 < n) & ~first[far]
        after = np.where(two, codes[far], 0)
        one = np.isin(nxt, [ord(c) for c in ENDINGS_1])
        pair = np.zeros(len(i), bool)
        for a, b in ENDINGS_2:
            pair |= (nxt == ord(a)) & (after == ord(b))
        for at, size in ((i[one], 2), (i[pair & ~one], 3)):
            starts[at + 1] = False
            rest = at + size
            rest = rest[rest < n]
            starts[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
    return np.flatnonzero(starts)


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, each word occurrence as an index into them, and the number of words of each text."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    if not len(codes):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    first = np.zeros(len(codes), bool)
    first[begin[sizes > 0]] = True
    at = word_starts(codes, first)
    end = np.append(at[1:], len(codes))
    top = 1 << max(10, (len(codes) - 1).bit_length())
    keys = []
    for base in (_B | 1, _B2 | 1):
        up, down = _powers(base, top)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
        keys.append((sums[end] - sums[at]) * down[at])
    _, rep, which = np.unique(keys[0], return_index=True, return_inverse=True)
    if (keys[1][rep][which] != keys[1]).any():  # two words with one hash
        words = [joined[a:b] for a, b in zip(at, end)]
        names = sorted(set(words))
        place = {w: k for k, w in enumerate(names)}
        which = np.fromiter((place[w] for w in words), np.int64, len(words))
    else:
        names = [joined[a:b] for a, b in zip(at[rep].tolist(), end[rep].tolist())]
    per_text = np.searchsorted(at, begin + sizes) - np.searchsorted(at, begin)
    return names, which, per_text


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranks_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
    parts: list[bytes] = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 40:
        return _merge_long(parts, rank)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def _merge_long(parts: list[bytes | None], rank: dict[bytes, int]) -> list[int]:
    n = len(parts)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := rank.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [rank[p] for p in parts if p is not None]


class Lexicon:
    """A minimal acyclic automaton over bytes; a word's number is the sum of the steps on its path."""

    FILES = ("edges", "target", "step", "final", "start", "ids")

    def __init__(self, edges, target, step, final, start, ids):
        """edges: state and label of every edge as one sorted number; the last state is the first one of every word."""
        self.edges, self.target, self.step, self.final, self.start, self.ids = edges, target, step, final, start, ids

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> "Lexicon":
        """From sorted words, suffix by suffix: states with equal edges and ends are one state."""
        known: dict[tuple, int] = {}
        made: list[tuple[bool, tuple]] = []
        ways: list[int] = []
        ordered = sorted(words)
        path: list[list] = [[False, []]]

        def close(down_to: int) -> None:
            while len(path) - 1 > down_to:
                end, edges = path.pop()
                key = (end, tuple(edges))
                if key not in known:
                    known[key] = len(made)
                    made.append(key)
                    ways.append(int(end) + sum(ways[t] for _, t in edges))
                path[-1][1][-1] = (path[-1][1][-1][0], known[key])

        last = b""
        for w in ordered:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            close(same)
            for c in w[same:]:
                path[-1][1].append((c, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        root = (path[0][0], tuple(path[0][1]))
        made.append(root)
        edge, target, step = array("q"), array("q"), array("q")
        for state, (end, edges) in enumerate(made):
            ahead = int(end)
            for c, t in edges:
                edge.append(state << 8 | c)
                target.append(t)
                step.append(ahead)
                ahead += ways[t]
        start = np.cumsum([0, *(len(words[w]) for w in ordered)]).astype(np.int64)
        ids = np.fromiter(chain.from_iterable(words[w] for w in ordered), np.int32)
        return Lexicon(np.array(edge, np.int64), np.array(target, np.int64), np.array(step, np.int64), np.array([end for end, _ in made]), start, ids)

    def save(self, path: str) -> None:
        os.makedirs(path)
        for name in self.FILES:
            np.save(os.path.join(path, name), getattr(self, name))

    @staticmethod
    def load(path: str) -> "Lexicon":
        return Lexicon(*(np.load(os.path.join(path, f"{name}.npy"), mmap_mode="r") for name in Lexicon.FILES))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon does not hold it; all words take their steps together, in the map itself."""
        edges, last = self.edges, len(self.edges) - 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state, number = np.full(len(words), len(self.final) - 1, np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero((sizes > 0) & (last >= 0))
        number[(sizes == 0) | (last < 0)] = -1
        depth = 0
        while len(alive):
            key = state[alive] << 8 | flat[begin[alive] + depth]
            at = np.minimum(edges.searchsorted(key), last)
            hit = edges[at] == key
            number[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            number[alive] += self.step[at]
            state[alive] = self.target[at]
            depth += 1
            done = sizes[alive] == depth
            over = alive[done]
            number[over[~self.final[state[over]]]] = -1
            alive = alive[~done]
        return number

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        n = self.numbers(words)
        begin, end = self.start[np.maximum(n, 0)].tolist(), self.start[np.maximum(n, 0) + (n >= 0)].tolist()
        return [None if k < 0 else self.ids[a:b].tolist() for k, a, b in zip(n.tolist(), begin, end)]


def most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """The rows (word, n) with the greatest n, `limit` at most: those above a count that a histogram of counts gives.

    The histogram's classes are 1/64 of an octave wide, so it has some 2 000 rows whatever the number of words, and no
    partition gives more rows than are kept in all. Words of one class are kept or left out together.
    """
    octave = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(((r["k"], r["count"]) for r in counted.groupBy(octave.alias("k")).count().collect()), reverse=True)
    least, left = None, limit
    for k, size in sizes:
        if size > left:
            break
        least, left = k, left - size
    return counted.where(octave >= least) if least is not None else counted.limit(0)


def frequent_words(texts: DataFrame, column: str, limit: int) -> list[str]:
    """The most frequent words of all texts; counted within each batch first, then over the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunks(batch[column].tolist()):
                words, which, _ = distinct_words(part)
                n = np.bincount(which, minlength=len(words))
                yield pd.DataFrame({"word": words, "n": n}, columns=["word", "n"])

    counted = staged(texts.select(column).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    return [r["word"] for r in most_frequent(counted, limit).select("word").collect()]


def publish_lexicon(spark: SparkSession, words: list[str], rank: dict[bytes, int]):
    """The lexicon of the words where tasks can reach it: mapped from the shared folder, or sent if that is no file system."""
    lexicon = Lexicon.build({b: merge(b, rank) for b in {w.encode() for w in words}})
    folder = shared_dir(spark)
    if folder.startswith("file:") or "://" not in folder:
        path = scratch(spark, "lexicon").removeprefix("file:").replace("///", "/")
        lexicon.save(path)
        return path
    return spark.sparkContext.broadcast(tuple(np.asarray(getattr(lexicon, n)) for n in Lexicon.FILES))


class Encoder:
    """One task's view of the lexicon, with the words it has met."""

    def __init__(self, lexicon, rank: dict[bytes, int]):
        self.lexicon = Lexicon.load(lexicon) if isinstance(lexicon, str) else Lexicon(*lexicon.value)
        self.rank, self.met = rank, {}

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.met]
        if len(self.met) + len(new) > CACHE_WORDS:
            self.met.clear()
            new = words
        coded = [w.encode() for w in new]
        for w, b, ids in zip(new, coded, self.lexicon.look_up(coded)):
            self.met[w] = merge(b, self.rank) if ids is None else ids

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each chunk of texts: the ids of all its texts one after the other, and how many each text has."""
        for part in chunks(texts):
            words, which, per_text = distinct_words(part)
            self.learn(words)
            found = [self.met[w] for w in words]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            begin = np.cumsum(size) - size
            of = size[which]
            total = np.concatenate([[0], np.cumsum(of)])
            out = flat[np.repeat(begin[which] - total[:-1], of) + np.arange(total[-1])]
            ends = np.cumsum(per_text)
            yield out, total[ends] - total[ends - per_text]


def encoder(docs: DataFrame, column: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, lexicon_words: int = LEXICON_WORDS):
    """A function that makes one task's Encoder, with the corpus's frequent words compiled."""
    path = ranks_path(tokenizer, folder)
    lexicon = publish_lexicon(docs.sparkSession, frequent_words(docs, column, lexicon_words), ranks(path))
    return lambda: Encoder(lexicon, ranks(path))


def token_ids(docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """key, ids: the token ids of each text; an empty list for empty and null texts. Rows and repeated texts are kept as they are."""
    make = encoder(docs, column, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for batch in batches:
            done = 0
            for flat, sizes in enc.encode_all(batch.column(1).to_pylist()):
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(sizes)), lists], names=[key, "ids"])
                done += len(sizes)

    return docs.select(key, column).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """key, n_tokens of each text."""
    make = encoder(docs, column, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = make()
        for batch in batches:
            sizes = [n for _, n in enc.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes), pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, column).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_tokens long")
