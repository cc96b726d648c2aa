"""Text quality statistics per document, their distance from the prose of its language, and the kind of text.

The statistics of all labelled prose give a robust mean and covariance per language, drawn towards those of all languages
the more, the fewer texts a language has. A document's Mahalanobis distance from them, and what each statistic adds to it or
takes from it, tell how unlike prose it is and in what; trees over the distance and these contributions alone, fitted on a
bounded sample of labelled documents, name the kind.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Labelled documents that the trees are fitted on, at most. Means and covariances are those of all labelled prose.
LABELLED = 8_000
#: So many texts of all languages a language's own prose is mixed with; so many of independent statistics those of all languages.
DRAWN, INDEPENDENT = 60, 5
#: Rounds of weighing; a text farther than REACH times the usual distance counts less.
ROUNDS, REACH = 2, 1.3
KINDS = ("prose", "list", "table", "junk")
LANGS = ("en", "zh", "de", "fr", "es")

STATS = (
    "log_chars", "log_words", "mean_word", "longest_word", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio", "cjk_ratio", "odd_ratio",
    "log_lines", "mean_line", "line_spread", "ended_lines", "sentences", "bullet_lines", "keyed_lines", "short_lines", "indent_lines",
    "common_words", "distinct_words", "distinct_lines", "top_char", "char_entropy", "packed_ratio",
    "column_lines", "column_count", "tag_ratio", "gap_ratio", "inline_items", "inline_length", "named_words", "word_lines", "stamp_lines", "code_ratio",
)

WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f¡-¾×÷ÂÃ\ue000-\uf8ff\ufffd\u2300-\u27ff]")
BULLET = re.compile(r"^[^\S\n]*(?:[-*+•·–~◦▪]|\d{1,3}[.)、]|[(（]?[a-zA-Z][)）.]|\[[ x]\])[^\S\n]+", re.M)
KEYED = re.compile(r"^[^\S\n]*[\w./-]+[^\S\n]*[:：=][^\S\n]*\S", re.M)
ENDED = re.compile(r"[.!?。！？][\"'”’»)）]*[^\S\n]*$", re.M)
SENTENCE = re.compile(r"[.!?](?=\s|$)|[。！？]")
STAMP = re.compile(r"^[^\S\n]*\[?(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|[0-9a-f]{8}\b|at |[{}\[\]<>])", re.M)
GAP = re.compile(r"\S {2,}\S.*$", re.M)
TAG = re.compile(r"</?[a-zA-Z][^>]{0,80}>")
COLUMN_MARKS = "|\t,;│¦"
CODE_MARKS = "{}()=;<>"
ITEM_MARKS = ("; ", " / ", " • ", ", ", " | ", "；", "、", " - ", " · ", "，")
SPACE, DIGIT, UPPER, CJK, SYMBOL, OTHER = range(6)


@lru_cache(maxsize=1 << 16)
def char_kind(c: str) -> tuple[int, bool]:
    if c.isspace():
        kind = SPACE
    elif c.isdigit():
        kind = DIGIT
    elif "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff":
        kind = CJK
    elif c.isupper():
        kind = UPPER
    else:
        kind = OTHER if c.isalnum() or c == "_" else SYMBOL
    return kind, bool(ODD.match(c))


def statistics(text: str, common: dict[str, frozenset[str]]) -> tuple[list[float], str | None]:
    """The statistics of a text that is not blank, and the language its common words vote for."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    n = len(text)
    words = Counter(WORD.findall(text.lower()))
    n_words = sum(words.values())
    counts = Counter(text)
    by, odd, top, entropy = [0] * 6, 0, 0, 0.0
    for c, k in counts.items():
        kind, strange = char_kind(c)
        by[kind] += k
        odd += strange and k
    n_solid = max(1, n - by[SPACE])
    for c, k in counts.items():
        if char_kind(c)[0] != SPACE:
            top = max(top, k)
            entropy -= k / n_solid * math.log2(k / n_solid)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    m = max(1, len(lines))
    sizes = [*map(len, lines)] or [0]
    mean_line = sum(sizes) / m
    lang, hits, share = None, 0, 0.0
    for name, known in common.items():
        if name == "zh":
            if by[CJK] > 0.1 * n_solid:
                share = min(1.0, 2 * sum(text.count(w) * len(w) for w in known) / by[CJK])
        else:
            got = sum(words[w] for w in known if w in words)
            if got > hits:
                lang, hits = name, got
    if by[CJK] > 0.15 * n_solid:
        lang = "zh"
    else:
        share, lang = hits / max(1, n_words), lang if hits >= 2 else None
    best, width = 0.0, 0
    for mark in COLUMN_MARKS:
        if counts.get(mark, 0) > 1:
            per = Counter(x.count(mark) for x in lines)
            k, times = max(((k, t) for k, t in per.items() if k), key=lambda v: v[1], default=(0, 0))
            if times > 1 and times / m > best and (k > 1 or mark in "|\t│"):
                best, width = times / m, k
    longest = max(lines, key=len, default="")
    items, item_len = 0, 0.0
    for mark in ITEM_MARKS:
        k = longest.count(mark) + 1
        if k >= 4 and k > items:
            items, item_len = k, (len(longest) - (k - 1) * len(mark)) / k
    raw = text.encode()
    values = [
        math.log1p(n), math.log1p(n_words), sum(len(w) * k for w, k in words.items()) / max(1, n_words), math.log1p(max(map(len, text.split()), default=0)),
        by[SYMBOL] / n, by[DIGIT] / n, by[UPPER] / n, by[SPACE] / n, by[CJK] / n_solid, odd / n,
        math.log1p(m), math.log1p(mean_line), (sum((s - mean_line) ** 2 for s in sizes) / m) ** 0.5 / max(1.0, mean_line), len(ENDED.findall(text)) / m, len(SENTENCE.findall(text)) * 100 / n,
        len(BULLET.findall(text)) / m, len(KEYED.findall(text)) / m, sum(s < 50 for s in sizes) / m, sum(x[0].isspace() for x in lines) / m,
        share, len(words) / max(1, n_words), len(set(lines)) / m, top / n_solid, entropy, len(zlib.compress(raw, 1)) / len(raw),
        best, math.log1p(width), sum(map(len, TAG.findall(text))) / n if "<" in counts else 0.0, len(GAP.findall(text)) / m if "  " in text else 0.0, math.log1p(items), math.log1p(item_len), (counts["_"] + counts["/"]) / n_solid,
        min(60.0, n_words / m), len(STAMP.findall(text)) / m, sum(counts[c] for c in CODE_MARKS) / n_solid,
    ]
    return [float(v) for v in values], lang


def clean_lang(lang: str | None) -> str | None:
    got = re.match(r"[a-z]{2}", lang.strip().lower()) if isinstance(lang, str) else None
    return got[0] if got and got[0] in LANGS else None


@dataclass
class Prose:
    """Robust centre and inverse covariance of one language's prose, on scaled statistics."""

    centre: np.ndarray
    scale: np.ndarray
    inverse: np.ndarray

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances, and what each statistic adds to their squares."""
        z = (x - self.centre) / self.scale
        parts = z * (z @ self.inverse)
        return np.sqrt(np.maximum(parts.sum(1), 0)), parts


def inverted(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(0.8 * cov + 0.2 * np.diag(np.maximum(np.diag(cov), 0.05)) + 0.02 * np.eye(len(cov)))


def prose_models(prose: DataFrame) -> dict[str, Prose]:
    """prose (x, lang) -> the model of each language and, under an empty name, of all; none without rows.

    Centres and scales are medians and quartiles, covariances are sums in which far texts weigh less; Spark adds up all rows,
    and only sums per language come to the driver.
    """
    p = len(STATS)
    each = prose.select("x", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit(""))))).alias("lang"))
    quartile = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(p)]
    spread_ = [F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(p)]
    facts = {r["lang"]: r for r in each.groupBy("lang").agg(F.count("*").alias("n"), *quartile, *spread_).collect()}
    if "" not in facts:
        return {}
    size, centre, scale = {}, {}, {}
    for name in sorted(facts):
        r = facts[name]
        q = np.array([r[f"q{i}"] for i in range(p)], float)
        wide = np.maximum((q[:, 2] - q[:, 0]) / 1.349, 0.25 * np.array([r[f"s{i}"] for i in range(p)]))
        n = size[name] = r["n"]
        if name:
            centre[name], scale[name] = (n * q[:, 1] + DRAWN * centre[""]) / (n + DRAWN), (n * wide + DRAWN * scale[""]) / (n + DRAWN)
        else:
            centre[name], scale[name] = q[:, 1], np.maximum(wide, 0.01)
    mean = {name: np.zeros(p) for name in facts}
    inverse = {name: np.eye(p) for name in facts}
    for _ in range(ROUNDS):
        sums = weighed_sums(each, centre, scale, mean, inverse)
        for name in sorted(facts):
            n, (w, wz, v, vz, vzz) = size[name], sums[name]
            mean[name] = wz / w * (n / (n + DRAWN) if name else 1)
            m = mean[name]
            cov = (vzz - np.outer(m, vz) - np.outer(vz, m)) / v + np.outer(m, m)
            if name:
                cov = (n * cov + DRAWN * every) / (n + DRAWN)  # noqa: F821
            else:
                every = cov = (n * cov + INDEPENDENT * np.eye(p)) / (n + INDEPENDENT)  # noqa: F841
            inverse[name] = inverted(cov)
    return {name: Prose(centre[name] + mean[name] * scale[name], scale[name], inverse[name]) for name in facts}


def weighed_sums(each: DataFrame, centre: dict, scale: dict, mean: dict, inverse: dict) -> dict[str, tuple]:
    """Per language: sum of weights, weighed scaled statistics, squared weights, those times statistics and their products."""
    p = len(STATS)
    cuts = np.cumsum([1, p, 1, p])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, rows in b.groupby("lang"):
                z = (np.stack(rows["x"].to_numpy()) - centre[name]) / scale[name]
                y = z - mean[name]
                d = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", y, inverse[name], y), 1e-18))
                w = np.minimum(1, REACH * np.sqrt(p) / d)
                v = w * w
                total[name] = total.get(name, 0) + np.concatenate([[w.sum()], w @ z, [v.sum()], v @ z, ((v[:, None] * z).T @ z).ravel()])
        yield pd.DataFrame({"lang": list(total), "sums": [t.tobytes() for t in total.values()]}, columns=["lang", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iat[0]], "sums": [sum(np.frombuffer(t) for t in group["sums"]).tobytes()]})

    found = each.mapInPandas(part, "lang string, sums binary").groupBy("lang").applyInPandas(add, "lang string, sums binary").collect()
    out = {}
    for r in found:
        w, wz, v, vz, vzz = np.split(np.frombuffer(r["sums"]), cuts)
        out[r["lang"]] = (w[0], wz, v[0], vz, vzz.reshape(p, p))
    return out


class Trees:
    """Randomised trees for classes."""

    def __init__(self, n: int = 80, least: int = 2, tries: int = 8, seed: int = 7):
        self.n, self.least, self.tries, self.rng, self.trees = n, least, tries, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray) -> "Trees":
        for _ in range(self.n):
            nodes: list[list] = []
            todo = [(np.arange(len(x)), -1, 0)]
            while todo:
                at, above, side = todo.pop()
                counts = np.bincount(y[at], weight[at], classes)
                if above >= 0:
                    nodes[above][2 + side] = len(nodes)
                nodes.append([-1, 0.0, -1, -1, counts / counts.sum()])
                if len(at) < 2 * self.least or (counts > 0).sum() < 2:
                    continue
                best = None
                for f in self.rng.choice(x.shape[1], self.tries, replace=False):
                    v = x[at, f]
                    lo, hi = v.min(), v.max()
                    if lo == hi:
                        continue
                    for cut in self.rng.uniform(lo, hi, 2):
                        left = v <= cut
                        if not left.any() or left.all():
                            continue
                        a = np.bincount(y[at[left]], weight[at[left]], classes)
                        b = counts - a
                        loss = a.sum() - (a * a).sum() / max(a.sum(), 1e-9) + b.sum() - (b * b).sum() / max(b.sum(), 1e-9)
                        if best is None or loss < best[0]:
                            best = (loss, f, cut, left)
                if best is None:
                    continue
                me = len(nodes) - 1
                nodes[me][0], nodes[me][1] = int(best[1]), float(best[2])
                todo += [(at[best[3]], me, 0), (at[~best[3]], me, 1)]
            self.trees.append((np.array([r[0] for r in nodes]), np.array([r[1] for r in nodes]), np.array([r[2:4] for r in nodes]), np.stack([r[4] for r in nodes])))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = 0
        for feature, cut, child, share in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = child[k, (x[inner, feature[k]] > cut[k]).astype(int)]
            out = out + share[at]
        return out / max(1, len(self.trees))


class Model:
    """Prose of every language, and trees for the kinds; without labels every text is prose at distance 0."""

    def __init__(self, prose: dict[str, Prose], x: np.ndarray, langs: list[str | None], kinds: list[str]):
        y = np.array([KINDS.index(k) for k in kinds], int)
        self.prose, self.trees = prose, None
        if len(set(y.tolist())) > 1 and prose:
            n = np.bincount(y, minlength=len(KINDS))
            self.trees = Trees().fit(self.inputs(*self.distance(x, langs)), y, len(KINDS), (len(y) / np.maximum(1, n) ** 0.7)[y])

    def distance(self, x: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        d, parts = np.zeros(len(x)), np.zeros_like(x)
        known = np.array([v if v in self.prose else "" for v in langs])
        for name in set(known.tolist()):
            if name in self.prose:
                d[known == name], parts[known == name] = self.prose[name].shares(x[known == name])
        return d, parts

    @staticmethod
    def inputs(d: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return np.hstack([np.log1p(d)[:, None], np.sign(parts) * np.log1p(np.abs(parts))])

    def kinds(self, d: np.ndarray, parts: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(d):
            return np.array(["prose"] * len(d))
        return np.array(KINDS)[self.trees.predict(self.inputs(d, parts)).argmax(1)]


def word_sets(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """The words of the small table of common words, by language."""
    out: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").where("lang is not null and word is not null").collect():
        out.setdefault(clean_lang(r["lang"]) or "", set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in out.items() if k}


def _measured(texts: pd.Series, langs: pd.Series, common) -> tuple[np.ndarray, list[str | None]]:
    found = [statistics(t, common) for t in texts]
    x = np.array([v for v, _ in found]).reshape(len(found), len(STATS))
    return x, [lang or clean_lang(own) for (_, lang), own in zip(found, langs)]


#: SQL: the text holds more than white space.
NOT_BLANK = r"text rlike r'[^\s\p{Z}\x{feff}\x{200b}]'"


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, chosen by the hash of their key in classes of 1/4096; all rows if they are no more."""
    place = F.pmod(F.xxhash64(key), F.lit(4096))
    last, left = -1, limit
    for k, n in sorted((r["k"], r["count"]) for r in rows.groupBy(place.alias("k")).count().collect()):
        if n > left:
            break
        last, left = k, left - n
    return rows.where(place <= last)


def fit_model(docs: DataFrame, labels: DataFrame, common: dict[str, frozenset[str]], limit: int = LABELLED) -> Model:
    """The model of all labelled documents, with trees of at most `limit` of them."""
    known = labels.where(F.col("kind").isin(*KINDS)).select("doc_id", "kind").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, langs = _measured(b["text"], b["lang"], common)
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": list(x), "lang": langs, "kind": b["kind"]}, columns=["doc_id", "x", "lang", "kind"])

    labelled = docs.where(NOT_BLANK).select("doc_id", "text", "lang").join(known, "doc_id")
    measured = staged(labelled.mapInPandas(run, "doc_id long, x array<double>, lang string, kind string"), "measured")
    rows = bounded_sample(measured, "doc_id", limit).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["kind"]))
    return Model(prose_models(measured.where("kind = 'prose'")), np.array([r["x"] for r in rows]).reshape(len(rows), len(STATS)), [r["lang"] for r in rows], [r["kind"] for r in rows])


def text_quality(docs: DataFrame, labels: DataFrame, common_words: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, lang_used, n_words, the statistics, distance, the statistic that adds most to it, contributions, kind.

    One row per row of docs with a text; null and blank texts give none. Texts of unknown language are held against
    the prose of all languages.
    """
    common = word_sets(common_words)
    model = fit_model(docs, labels, common, limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, langs = _measured(b["text"], b["lang"], common)
            d, parts = model.distance(x, langs)
            out = pd.DataFrame(x, columns=list(STATS))
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            out.insert(1, "lang_used", langs)
            out["distance"] = d
            out["contributions"] = list(parts)
            out["top_stat"] = np.array(STATS)[parts.argmax(1)] if len(parts) else []
            out["kind"] = model.kinds(d, parts)
            yield out

    schema = ", ".join(["doc_id long", "lang_used string", *(f"{s} double" for s in STATS), "distance double", "contributions array<double>", "top_stat string", "kind string"])
    return docs.where(NOT_BLANK).select("doc_id", "text", "lang").mapInPandas(run, schema)
