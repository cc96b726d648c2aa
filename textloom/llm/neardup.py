"""Near-duplicate records: all pairs whose sets of substrings of 4 characters are similar enough, and their groups.

Texts are normalised and equal ones become one representative. Candidates come from adaptive multi-match prefixes:

- A text's tokens are 44 bands of 4 values each, where a value is the least hash of one bin of its set of substrings of 4
  characters. A value is the same in two texts with their sets' similarity as probability, wherever the edits lie.
- Tokens are ordered by how many texts have them, counted in a table of fixed size. Two texts of similarity 0.7 or more have
  at least SHARED = 3 tokens in common (all but 0.0006 of those at 0.70, all but 0.0002 at 0.72), so in the rarest
  44 - SHARED + l of each they share at least l: that is a text's prefix, and l the number that a partner must share. The more
  candidates a text's prefix is estimated to bring, the longer the prefix and the larger l.
- Tokens meet by hash ranges, with a sketch of one bit a value that drops most chance meetings at once; a token with more
  texts than fit is split into blocks that meet pairwise.
- Pairs with enough shared tokens are held against each other by marks, 2 bits of each of 176 least hashes more, so that few
  texts move for pairs that are not similar. Those that are left are verified exactly on their sets of substrings of 4 characters.

The substrings themselves cannot be the prefix tokens: a prefix of single substrings must hold 0.3 of a text's set, and in
these tables the rarest 0.3 reach substrings that one text in 14 holds, so that candidates are near all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Entries of the table of token counts, and the texts of one token that meet in one block.
TABLE_BITS, BLOCK = 20, 4_000
SLICES = 16
#: Turns in which the ranges of tokens meet, so that the postings of one turn only are on disk at a time.
TURNS = 2
#: By number of substrings (any two similar texts lie in one of these): least, largest, bins of one round of hashing.
CLASSES = ((0, 130, 1), (90, 200, 22), (140, 400, 44), (280, 1 << 40, 88))
#: Bands of a text, values of each, and bands that two similar texts have in common at least.
BANDS, BAND, SHARED = 44, 4, 3
VALUES = BANDS * BAND
#: Bits of the sketch and how many may differ: in texts of similarity 0.7 it is 19.2, with a deviation of 4.
SKETCH, DIFFER = 128, 34
#: Least hashes of a text for its marks, and how many of their marks may differ: in texts of similarity 0.7 it is 39.6, with a
#: deviation of 5.5.
MARKS, MARKS_DIFFER = 176, 60
#: A text's prefix grows by one token, and what a partner must share with it, at each of these numbers of texts that hold one of its
#: tokens on average, beyond the table's noise.
DEAR = (2, 16)
#: Numbers that the texts of candidates are told by before they move; the table of those that occur is broadcast.
SLOTS = 1 << 20
#: Characters that a task handles at once.
CHUNK = 1_500_000
_BASE = 0x9E3779B97F4A7C15


def normalised(text: Column) -> Column:
    """Lower case; each run of characters that are not letters or numbers is one blank; ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def windows(units: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one text, and the text of each."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 : size - 1 + n])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = (h + units[at + k]) * np.uint64(_BASE)
        h ^= h >> np.uint64(29)
    return mix(h), owner[at]


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(ids, texts, salts) of so many texts at a time that their characters fit; each text once a task, however many its copies."""
    ids, texts, salts, size, seen = [], [], [], 0, set()
    for b in batches:
        for i, t, s in zip(*(c.to_pylist() for c in b.columns)):
            if i in seen:
                continue
            seen.add(i)
            ids.append(i)
            texts.append(t)
            salts.append(s)
            size += len(t)
            if size >= CHUNK or len(ids) >= 1 << 18:
                yield np.array(ids, np.int64), texts, np.array(salts, np.int64).astype(np.uint64)
                ids, texts, salts, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts, np.array(salts, np.int64).astype(np.uint64)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct substrings of 4 characters of all texts, the text of each, and how many each text has."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.fromiter(map(len, texts), np.int64, len(texts)))
    grams, of = windows(codes.astype(np.uint64), owner, 4)
    keyed = np.sort((of.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)))
    first = np.ones(len(keyed), bool)
    first[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[first]
    of = (keyed >> np.uint64(44)).astype(np.int64)
    return mix(keyed & np.uint64((1 << 44) - 1)), of, np.bincount(of, minlength=len(texts))


def binned(grams: np.ndarray, at: np.ndarray, bins: int, n: int, odd: np.uint64) -> np.ndarray:
    """Least hash of each of so many bins of each of n texts; an empty bin has the largest number. at: first bin of a substring's text."""
    out = np.full(n * bins, 0xFFFFFFFFFFFFFFFF, np.uint64)
    v = grams * odd
    v ^= v >> np.uint64(32)
    np.minimum.at(out, at + ((v & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), v)
    return out.reshape(n, bins)


def marks_of(grams: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """2 bits of each of MARKS least hashes of every text. Bins that are empty in both of two texts do not differ."""
    values = binned(grams, of * MARKS, MARKS, n, np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(13)
    two = np.stack([values & np.uint64(1), values >> np.uint64(1) & np.uint64(1)], 2).astype(np.uint8)
    return np.packbits(two.reshape(n, 2 * MARKS), axis=1)


def marks_differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many marks differ between the rows of two tables."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint8(1)) & np.uint8(0x55)).sum(axis=1, dtype=np.int64)


def least_hashes(grams: np.ndarray, of: np.ndarray, grams_n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Class, texts of it, and least hashes of each one's substrings of 4 characters."""
    for k, (low, high, bins) in enumerate(CLASSES):
        member = (grams_n >= max(low, 1)) & (grams_n <= high)
        if not member.any():
            continue
        mine = None if member.all() else np.flatnonzero(member[of])
        h = grams if mine is None else grams[mine]
        at = (np.cumsum(member) - 1)[of if mine is None else of[mine]] * bins
        odd = np.random.default_rng(k).integers(0, 1 << 64, VALUES // bins, np.uint64, False) | np.uint64(1)
        yield k, np.flatnonzero(member), np.concatenate([binned(h, at, bins, int(member.sum()), o) for o in odd], axis=1)


def signatures(reps: DataFrame) -> DataFrame:
    """id, and as bytes the tokens and the sketch of each text, once for each of its classes, and the marks, in the first of them only.

    Tokens are numbers of 32 bits; sources with different salts, classes and bands have different ones, and where two
    happen to be equal, sketches and verification tell texts apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, salts in text_chunks(batches):
            found = grams_of(texts)
            marks, done = marks_of(found[0], found[1], len(texts)), np.zeros(len(texts), bool)
            for k, at, values in least_hashes(*found):
                sketch = np.packbits((values[:, :SKETCH] >> np.uint64(12) & np.uint64(1)).astype(np.uint8), axis=1)
                key = mix(salts[at, None] * np.uint64(_BASE) + (np.arange(BANDS) * 4 + k + 1).astype(np.uint64))
                for j in range(BAND):
                    key = mix((key ^ values[:, j::BAND]) * np.uint64(_BASE))
                keys = (key >> np.uint64(32)).astype(np.uint32)
                shown = pc.if_else(pa.array(done[at]), pa.scalar(None, pa.binary()), rows_of(marks[at]))
                done[at] = True
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), rows_of(keys), rows_of(sketch), shown], names=["id", "keys", "sketch", "marks"])

    return staged(reps.select("id", "text", "salt").mapInArrow(run, "id long, keys binary, sketch binary, marks binary"), "signatures")


def rows_of(table: np.ndarray) -> pa.Array:
    """Each row of a table as bytes."""
    data = np.ascontiguousarray(table)
    width = data.shape[1] * data.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def table_of(column: pa.Array, kind) -> np.ndarray:
    """Bytes of equal length as the rows of a table."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def token_table(signed: DataFrame) -> np.ndarray:
    """How many texts have a token in each slot of a table of fixed size; summed in tasks, then by slices of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TABLE_BITS, np.int64)
        for b in batches:
            total += np.bincount(slot(table_of(b.column(0), np.uint32)).ravel(), minlength=len(total))
        parts = [p.astype(np.uint32).tobytes() for p in np.split(total, SLICES)]
        group = int(np.random.default_rng().integers(64))
        yield pa.RecordBatch.from_arrays([pa.array([group] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["team", "slice", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(sum(np.frombuffer(b, np.uint32).astype(np.int64) for b in pdf["n"]), 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"team": [0], "slice": [pdf["slice"].iat[0]], "n": [total.tobytes()]})

    schema = "team int, slice int, n binary"
    summed = signed.select("keys").mapInArrow(count, schema).groupBy("team", "slice").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    out = np.zeros(1 << TABLE_BITS, np.int64)
    for r in summed.collect():
        k = r["slice"] * (len(out) // SLICES)
        got = np.frombuffer(r["n"], np.uint32)
        out[k : k + len(got)] = got
    return out


def prefixes(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' tokens (one row a text): which are in their text's prefix, how many of them a partner must share, their counts."""
    count = table[slot(keys)]
    noise = table.sum() / len(table)
    order = np.lexsort((keys, count), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(keys.shape[1]), order.shape), axis=1)
    least = keys.shape[1] - SHARED
    cost = np.where(rank <= least, count, 0).sum(1) / (least + 1) - noise
    need = 1 + sum((cost > dear).astype(np.int64) for dear in DEAR)
    return rank < (least + need)[:, None], need, count


def in_blocks(key: np.ndarray, chance: np.ndarray, count: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which posting goes to which meeting, as its place, a number of token and pair of blocks, and its side of that pair.

    Texts of a token with more than `size` are dealt into blocks; every two blocks meet, and each block meets itself. Side 2
    meets all, sides 0 and 1 each other.
    """
    blocks = np.maximum(1, -(-count // (size or BLOCK)))
    own = (chance % blocks.astype(np.uint64)).astype(np.int64)
    rep = np.repeat(np.arange(len(key)), blocks)
    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low, high = np.minimum(own[rep], other), np.maximum(own[rep], other)
    wide = mix(key[rep].astype(np.uint64) + (low.astype(np.uint64) << np.uint64(32)) + high.astype(np.uint64) * np.uint64(_BASE))
    return rep, wide, np.where(low == high, 2, (own[rep] == high).astype(np.int64))


def postings(signed: DataFrame, table, parts: int, turn: int) -> DataFrame:
    """part, and as bytes the tokens, texts, sketches, and needs with blocks' sides of the prefix tokens that fall into it; of the parts of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, keys, sketch = np.asarray(b.column(0), np.int64), table_of(b.column(1), np.uint32), table_of(b.column(2), np.uint64)
            chosen, need, count = prefixes(keys, table.value)
            at, _ = np.nonzero(chosen)
            key = keys[chosen]
            rep, wide, across = in_blocks(key, mix(ids.astype(np.uint64))[at], count[chosen])
            part = (wide % np.uint64(parts)).astype(np.int64)
            now = np.flatnonzero(part % TURNS == turn)
            order = now[np.argsort(part[now], kind="stable")]
            cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])[: len(order)])
            stops, of = np.append(cuts[1:], len(order)), at[rep[order]]
            cols = ((wide[order] >> np.uint64(32)).astype(np.uint32), ids[of], sketch[of], (need[of] * 4 + across[order]).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order][cuts].astype(np.int32)), *(pa.array([c[i:j].tobytes() for i, j in zip(cuts, stops)], pa.binary()) for c in cols)],
                names=["part", "key", "id", "sketch", "need"],
            )

    return signed.select("id", "keys", "sketch").mapInArrow(run, "part int, key binary, id binary, sketch binary, need binary")


def meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of texts with similar sketches that share tokens of one part: a < b, tokens shared, tokens needed.

    Two prefixes guarantee the smaller of their needs.
    """
    key, ids, sketch, need = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("key", np.uint32), ("id", np.int64), ("sketch", np.uint64), ("need", np.uint8)))
    order = np.argsort(key)
    key = key[order]
    single = np.ones(len(key), bool)
    same = key[1:] == key[:-1]
    single[1:] &= ~same
    single[:-1] &= ~same
    order, key = order[~single], key[~single]
    ids, sketch, side, need = ids[order], sketch.reshape(-1, SKETCH // 64)[order], need[order] & 3, need[order] >> 2
    words = [np.ascontiguousarray(sketch[:, j]) for j in range(sketch.shape[1])]
    out, offset = [np.zeros((3, 0), np.int64)], 1
    alive = np.arange(len(key))
    while len(alive):
        alive = alive[alive < len(key) - offset]
        alive = alive[key[alive] == key[alive + offset]]
        differ = sum(np.bitwise_count(w[alive] ^ w[alive + offset]) for w in words)
        a = alive[differ <= DIFFER]
        b = a + offset
        good = (ids[a] != ids[b]) & ((side[a] == 2) | (side[a] != side[b]))
        a, b = a[good], b[good]
        out.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), np.minimum(need[a], need[b]).astype(np.int64)]))
        offset += 1
    a, b, need = np.concatenate(out, axis=1)
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    return pd.DataFrame({"a": a[begin], "b": b[begin], "n": np.diff(np.append(begin, len(a))), "need": np.minimum.reduceat(need, begin) if len(a) else need})


def substrings(text: str) -> set[str]:
    return {text[i : i + 4] for i in range(len(text) - 3)}


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """Jaccard similarity of the sets of substrings of 4 characters of each two texts; exact, by two sorts of all of them."""
    texts = [t for pair in zip(a, b) for t in pair]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < 4:
        return np.zeros(len(a))
    known = np.flatnonzero(np.bincount(codes))
    place = np.zeros(int(known[-1]) + 1, np.uint64)
    place[known] = np.arange(len(known), dtype=np.uint64)
    short, base = place[codes], np.uint64(len(known))
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    inside = np.flatnonzero(owner[:-3] == owner[3:])
    grams = ((short[inside] * base + short[inside + 1]) * base + short[inside + 2]) * base + short[inside + 3]
    if len(known) ** 4 * len(texts) >= 1 << 63:  # numbers of whole substrings instead of their characters
        grams = np.unique(grams if len(known) < 1 << 16 else np.stack([short[inside + k] for k in range(4)], 1), axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
    size = grams.max() + np.uint64(1) if len(grams) else np.uint64(1)
    keyed = owner[inside].astype(np.uint64) * size + grams
    keyed.sort()
    keyed = keyed[np.append(True, keyed[1:] != keyed[:-1])[: len(keyed)]]
    of = keyed // size
    each = np.bincount((of >> np.uint64(1)).astype(np.int64), minlength=len(a))
    keyed -= (of - (of >> np.uint64(1))) * size
    keyed.sort()
    both = np.bincount((keyed[1:][keyed[1:] == keyed[:-1]] // size).astype(np.int64), minlength=len(a))
    return both / np.maximum(1, each - both)


def similar_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """reps (id, text, salt), normalised texts, staged, copies under one id; salt keeps sources apart -> a, b, similarity of all similar pairs, a < b."""
    spark = reps.sparkSession
    signed = signatures(reps)
    table = token_table(signed)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(table.sum()) // 2_000_000)
    sent = spark.sparkContext.broadcast(table)
    found = None
    for turn in range(TURNS):
        part = staged(postings(signed, sent, parts, turn).repartition(parts, "part").groupBy("part").applyInPandas(meet, "a long, b long, n long, need long"), "meetings")
        found = part if found is None else found.unionByName(part)
    shared = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    marked = signed.where("marks is not null").groupBy("id").agg(F.first("marks").alias("marks"))
    pairs = shared.join(marked.withColumnRenamed("id", "a"), "a").join(marked.select(F.col("id").alias("b"), F.col("marks").alias("other")), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(marks_differ(table_of(b.column("marks"), np.uint8), table_of(b.column("other"), np.uint8)) <= MARKS_DIFFER)).select(["a", "b"])

    candidates = staged(pairs.select("a", "b", "marks", "other").mapInArrow(alike, "a long, b long"), "candidates")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chars = (pdf["text_a"].str.len() + pdf["text_b"].str.len()).cumsum()
            for _, part in pdf.groupby(chars // CHUNK):
                out = part[["a", "b"]].assign(similarity=similarities(part["text_a"].tolist(), part["text_b"].tolist()))
                yield out[out["similarity"] >= threshold]

    sides = candidates.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    # Most texts are in no candidate; a table of fixed size tells those that may be in one before any text is shuffled.
    slots = sides.select(F.pmod("id", F.lit(SLOTS)).alias("slot")).distinct()
    near = reps.withColumn("slot", F.pmod("id", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi")
    texts = near.join(sides.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    both = sides.join(texts, "id").groupBy("a", "b").agg(F.max(F.when(F.col("id") == F.col("a"), F.col("text"))).alias("text_a"), F.max(F.when(F.col("id") == F.col("b"), F.col("text"))).alias("text_b"))
    return staged(both.mapInPandas(verify, "a long, b long, similarity double"), "pairs")


def near_duplicates(records: DataFrame, threshold: float = 0.7, least_chars: int = 100) -> tuple[DataFrame, DataFrame]:
    """records (src, key, text) -> (members: src, key, id of its text), (pairs of ids: a, b, similarity).

    Null keys and texts that are shorter than least_chars when normalised are in neither. Repeated rows count once. Texts
    are told apart by a hash of 64 bits of source and text; records of different sources are never paired.
    """
    text = normalised(F.col("text"))
    ready = records.where("key is not null and text is not null").select("src", "key", text.alias("text")).where(F.length("text") >= least_chars)
    ready = staged(ready.withColumn("id", F.xxhash64("src", "text")), "texts")
    return ready.select("src", "key", "id").distinct(), similar_pairs(ready.select("id", "text", F.xxhash64("src").alias("salt")), threshold)


def key_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, key_a, key_b of all similar records, copies included, key_a < key_b.

    The number of rows is that of the pairs themselves. Copies are joined by their text's id, so a pair of texts with
    many copies is spread by the join over as many tasks as its rows need.
    """
    x = members.select("src", F.col("key").alias("x"), F.col("id").alias("a"))
    y = members.select(F.col("key").alias("y"), F.col("id").alias("b"))
    linked = pairs.select("a", "b").join(x, "a").join(y, "b").select("src", "x", "y")
    copies = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = members.join(copies, "id").select("src", "key", "id")
    same = again.select("src", F.col("key").alias("x"), "id").join(again.select(F.col("key").alias("y"), "id"), "id").where("x < y").select("src", "x", "y")
    every = linked.where("x <> y").unionByName(same)
    return every.select("src", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """id, root: connected texts have one root, the least id among them. Texts without a pair are not listed.

    Alternates between hooking every text and its larger neighbours onto the least, and its smaller ones likewise,
    until nothing changes; each round is written to the shared folder.
    """
    edges = staged(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def record_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, key, class_id (its text), group_id (its connected texts), links (similar other texts), copies: one row a record."""
    pairs = pairs.select("a", "b")
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"))
    size = members.groupBy("id").agg(F.count("*").alias("copies"))
    facts = size.join(links, "id", "left").join(components(pairs), "id", "left")
    return members.join(facts, "id").select("src", "key", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
