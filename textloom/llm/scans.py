"""Repair of text from scanned pages.

Running headers and page numbers are found per file; words that the typesetter broke are joined; misread characters are
corrected by a noisy channel: every word has the words it may stand for, by a table of confusable characters, and the
best line of words under word and word-pair counts of the whole corpus is decoded by Viterbi. How often each confusion
happens is estimated from the corpus itself, from rare words and the frequent words that they may stand for, by expectation
and maximisation. Chinese characters are decoded likewise, over pairs of neighbours.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Most frequent entries of each kind that are sent to all tasks: words, word pairs, pairs with a Chinese character, hyphenated
#: compounds. What a file needs beyond them, readings too, is joined to it, so the results are the same whatever is kept. Pairs
#: that can be what was printed and header words are all sent: by their least counts CORPUS["z"] / LEAST_PAIR pairs and
#: CORPUS["h"] / LEAST_HEADER words at most, however large the corpus is.
KEEP = {"w": 200_000, "b": 300_000, "z": 200_000, "c": 20_000}
#: Kinds of terms: those, and words of running lines.
KINDS = (*KEEP, "h")
#: Words, pairs with a Chinese character and words of running lines of a corpus up to which counts are judged as they are. In a
#: larger one misreadings come more often too, as their words do: a count n is judged as n / scale.
CORPUS = {"w": 1_000_000, "z": 150_000, "h": 4_000}
#: A word that is read n times is taken for a printed one with the probability REAL * n, 1 at most.
REAL = 0.004
#: The same while rates are estimated, where only words that clearly stand for others are wanted.
REAL_AT_FIRST = 0.05
#: Probability that a word with one misread place has another; misreadings come in bad patches.
AGAIN = 0.3
#: Rate of every confusion that the estimation starts from, its rounds, and the least rate.
FIRST_RATE, ROUNDS, LEAST_RATE = 0.005, 8, 1e-6
#: Probability that a Chinese character was misread, and the least count of a pair that can be what was printed.
MISREAD_CHARACTER, LEAST_PAIR = 0.001, 8
#: Least count of a word of running lines.
LEAST_HEADER = 2
#: Counts of terms that a file needs.
MORE = "array<struct<kind: string, term: string, n: bigint>>"

# What is read -> what was printed.
CONFUSIONS = (
    ("à", "a"), ("c", "e"), ("!", "i"), ("†", "t"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("ii", "u"), ("ii", "ü"), ("b", "h"), ("q", "g"), ("cl", "d"), ("vv", "w"), ("h", "li"), ("rn", "m"), ("m", "rn"),
    ("ri", "n"), ("¢", "c"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("8", "b"), ("9", "g"), ("6", "b"), ("|", "l"), ("$", "s"), ("@", "a"), ("i", "l"), ("l", "i"), ("nn", "m"), ("€", "e"), ("3", "e"), ("f", "t"), ("t", "f"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("e", "c"), ("o", "0"), ("i", "ü"), ("u", "ü"), ("ö", "o"), ("á", "a"), ("â", "a"), ("ä", "a"), ("è", "é"), ("é", "è"), ("6", "é"), ("o", "ö"), ("a", "ä"),
)
# Marks by which a typesetter breaks a word.
HYPHENS = "-‐\xad¬‑"
# Words before and after a page number.
PAGE_WORDS = r"(?:page|pages|p\.|pp\.|pg\.|seite|s\.|blatt|página|pagina|pág\.|folio|第)"

NUM = r"(?:[0-9lIiOoSsZB|]{1,5}|[ivxlcdmIVXLCDM]{1,9})"
PAGE_LINE = re.compile(rf"^[\s*_\[\](){{}}<>~·•\-–—=|.]*(?:{PAGE_WORDS}\s*)?[\[(\-–—*\s]*(?P<n>{NUM})(?:\s*(?:/|of|von|de|sur|\||共)\s*(?P<t>{NUM}))?\s*页?[\s*_\[\](){{}}<>~·•\-–—=|.]*$", re.I)
BARE = re.compile(r"^\d+$")
EDGE_NUMBER = re.compile(rf"^\s*(?:{PAGE_WORDS}\s*)?[\[(]?({NUM})[\])]?(?:\s{{2,}}|\s*[|·•–—/]\s+)(?=\S)|(?:\s{{2,}}|\s*[|·•–—/]\s*|,\s*)(?:{PAGE_WORDS}\s*)?[\[(]?({NUM})[\])]?\s*$", re.I)
RULE = re.compile(r"^\s*[-–—_=*~]{3,}\s*$")
HEADING, TABLE, ITEM = re.compile(r"^\s*#{1,6}\s"), re.compile(r"^\s*\|"), re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s")
ENDED = re.compile(r"[.:;,!?。：；，！？、]\s*$")
CJK = re.compile(r"[㐀-鿿]")
CJK_RUN = re.compile(r"[㐀-鿿]+")
LETTERS = re.compile(r"[^\W\d_]+")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
TRIM = ".,;:?()[]{}（）。，、：；！？\"'“”‘’«»*#|>"
HEX = re.compile(r"[0-9a-f]+")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
DIGITS = str.maketrans("lIiOoSsZB|", "1110055281")


def number(text: str) -> int | None:
    """The value of a page number, also of a misread or a roman one."""
    if re.fullmatch(r"[ivxlcdm]+", text.lower()) and not re.fullmatch(r"[lLiI]+", text):
        total, last = 0, 0
        for c in reversed(text.lower()):
            v = ROMAN[c]
            total, last = (total - v, last) if v < last else (total + v, v)
        return total
    plain = text.translate(DIGITS)
    return int(plain) if plain.isdigit() else None


@lru_cache(maxsize=1 << 16)
def skeleton(text: str) -> str:
    """A key that is the same for a text and its misreadings."""
    s = re.sub(r"[*_`]+", "", text).lower()
    for a, b in (("ﬁ", "fi"), ("ii", "u"), ("ü", "u"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ri", "n")):
        s = s.replace(a, b)
    s = s.translate(str.maketrans("àáâä¢e0ö!l1|5†qb9", "aaaaccooiiiistghg"))
    return re.sub(r"\s+", " ", re.sub(r"\d", "#", s)).strip()


def header_key(line: str) -> str:
    return skeleton(EDGE_NUMBER.sub("", line.strip().strip("*_ ")).strip("*_ |"))


class Page:
    """The lines of one file with what is known of each."""

    def __init__(self, text: str, pages: str | None):
        self.lines = text.split("\n")
        self.kind = ["body"] * len(self.lines)
        got = re.findall(r"\d+", pages or "")
        self.low, self.high = (int(got[0]), int(got[-1])) if got else (None, None)
        self._shape()

    def _shape(self) -> None:
        for i, raw in enumerate(self.lines):
            s = raw.strip()
            if not s:
                self.kind[i] = "blank"
            elif RULE.match(raw):
                self.kind[i] = "rule"
            elif HEADING.match(raw):
                self.kind[i] = "heading"
            elif TABLE.match(raw):
                self.kind[i] = "table"

    def before(self, i: int) -> int:
        i -= 1
        while i >= 0 and self.kind[i] in ("blank", "rule"):
            i -= 1
        return i

    def numbers(self) -> None:
        """Lines with only a page number: marked as such, or plain ones that follow the pages or each other."""
        plain: dict[int, int] = {}
        for i, raw in enumerate(self.lines):
            if self.kind[i] != "body":
                continue
            m = PAGE_LINE.match(raw)
            if not m or (v := number(m["n"])) is None:
                continue
            s = raw.strip()
            letters_only = not re.search(r"\d", s)
            if letters_only and not re.fullmatch(rf"(?:{PAGE_WORDS}\s*)?[\W_]*(?:[ivxlcdm]+|[lIO]{{1,3}})[\W_]*", s, re.I):
                continue
            j = self.before(i)
            if j >= 0 and re.search(r"[:：]\s*$", self.lines[j]) and BARE.match(s):
                continue
            dressed = not re.fullmatch(NUM, s) or letters_only
            inside = self.low is not None and self.low <= v <= self.high
            if inside or dressed and (self.low is None or m["t"] or abs(v - self.low) < 3000):
                self.kind[i] = "page_number"
            elif self.low is None:
                plain[i] = v
        values = set(plain.values())
        for i, v in plain.items():
            if v - 1 in values or v + 1 in values:
                self.kind[i] = "page_number"

    def candidates(self) -> dict[int, str]:
        """Lines that could be running ones, with their keys: short, or not between two lines of text, and without an end."""
        out = {}
        sizes = sorted(len(x.strip()) for x, k in zip(self.lines, self.kind) if k == "body")
        width = sizes[int(0.8 * len(sizes))] if sizes else 0
        for i, raw in enumerate(self.lines):
            s = raw.strip()
            apart = i == 0 or i + 1 == len(self.lines) or self.kind[i - 1] != "body" or self.kind[i + 1] != "body"
            if self.kind[i] == "body" and len(s) <= 70 and (apart or len(s) < 0.7 * width) and not re.search(r"[.:;!?。：；！？]$", s):
                key = header_key(s)
                if len(re.findall(r"[^\W\d_]", key)) >= 4:
                    out[i] = key
        return out

    def headers(self, known: dict[str, int]) -> None:
        """Running lines: those that come back at a distance, resemble one that does, or sit where one must and use its words."""
        found = self.candidates()
        places: dict[str, list[int]] = defaultdict(list)
        for i, k in found.items():
            places[k].append(i)
        apart = {i for i in found if any(not 0 <= j < len(self.lines) or self.kind[j] != "body" or j in found for j in (i - 1, i + 1))}
        running = {k for k, at in places.items() if len(at) > 1 and max(b - a for a, b in zip(at, at[1:])) >= 6 and 2 * sum(i in apart for i in at) > len(at)}
        self.running = running
        for i, key in found.items():
            if key in running or any(abs(len(key) - len(r)) <= 4 and difflib.SequenceMatcher(None, key, r).ratio() >= 0.85 for r in running):
                self.kind[i] = "header"
        solid = [i for i, k in enumerate(self.kind) if k not in ("blank", "rule")]
        for n, i in enumerate(solid):
            if self.kind[i] != "body" or i not in found:
                continue
            words = LETTERS.findall(found[i])
            named = sum(known.get(w, 0) > 0 for w in words)
            alone = (i == 0 or self.kind[i - 1] != "body") and (i + 1 == len(self.lines) or self.kind[i + 1] != "body")
            edge = n in (0, len(solid) - 1) or "page_number" in (self.kind[i - 1] if i else "", self.kind[i + 1] if i + 1 < len(self.kind) else "") or "rule" in self.kind[max(0, i - 2) : i + 3]
            cut = n > 0 and n + 1 < len(solid) and self.kind[solid[n - 1]] == "body" and not ENDED.search(self.lines[solid[n - 1]])
            into = n + 1 < len(solid) and self.lines[solid[n + 1]].strip()[:1].islower() and self.lines[i].strip()[:1].isupper()
            cut = cut and (alone or into)
            m = EDGE_NUMBER.search(self.lines[i].strip().strip("*_ "))
            v = number(next(g for g in m.groups() if g)) if m else None
            paged = v is not None and self.low is not None and self.low <= v <= self.high
            if words and named >= 0.5 * len(words) and (cut or alone and edge or edge and len(self.lines[i].strip()) < 45 or paged):
                self.kind[i] = "header"

    def body(self) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k == "body"]


def paged(text: str, pages: str | None, known: dict[str, int]) -> Page:
    page = Page(text, pages)
    page.numbers()
    page.headers(known)
    return page


def counts_of(page: Page, out: dict[str, Counter] | None = None) -> dict[str, Counter]:
    """What one file adds to the model: words as read, pairs of words, hyphenated compounds, Chinese pairs, words of running lines."""
    out = {k: Counter() for k in KINDS} if out is None else out
    at = page.body()
    for n, i in enumerate(at):
        line = page.lines[i].rstrip()
        words = [w.lower() for _, w in words_read(line)]
        if line and line[-1] in HYPHENS and words:
            words = words[:-1]
        if n and page.lines[at[n - 1]].rstrip()[-1:] in HYPHENS:
            words = words[1:]
        out["w"].update(words)
        out["b"].update(zip(words, words[1:]))
        if "-" in line:
            out["c"].update(c.lower() for c in COMPOUND.findall(line))
        if CJK.search(line):
            out["z"].update(chinese_pairs(line))
    for key in page.running:
        out["h"].update(set(LETTERS.findall(key)))
    return out


def scale(kind: str, total: float) -> float:
    """How many times a corpus with total entries of a kind is larger than the one that counts are meant for; 1 at least."""
    return max(1.0, total / CORPUS[kind])


def flat_class(c: str) -> str:
    return c if CJK.match(c) or not c.isalnum() and c != "_" else "A"


def chinese_pairs(line: str) -> list[str]:
    s = [flat_class(c) for c in line]
    return [a + b for a, b in zip(s, s[1:]) if CJK.match(a) or CJK.match(b)]


def one_misread(word: str, happen: list[int] | range = range(len(CONFUSIONS))) -> Iterator[tuple[str, int]]:
    """What may have been printed where a word is read with one misread place, with the number of the confusion."""
    for k in happen:
        a, b = CONFUSIONS[k]
        at = word.find(a)
        while at >= 0:
            yield word[:at] + b + word[at + len(a) :], k
            at = word.find(a, at + 1)


class Channel:
    """The corpus model and its decoder.

    counts: kind -> term -> count, of the most frequent terms; totals: kind -> sum of all counts; rates: of the confusions;
    longest: length of the longest word; from_left: count of each character before another in a pair. The last four are of all
    terms, and of those in counts where they are not given.
    more holds counts of other terms that one file needs, whole is false where there are such; asked collects the terms that were
    looked for in vain.
    """

    def __init__(self, counts: dict[str, dict[str, int]], totals: dict[str, int] | None = None, rates: list[float] | None = None, longest: int | None = None, from_left: dict[str, int] | None = None, whole: bool = True):
        self.counts = {k: counts.get(k, {}) for k in KINDS}
        self.word, self.zh = self.counts["w"], self.counts["z"]
        totals = totals or {k: sum(self.counts[k].values()) for k in KINDS}
        self.total = max(1, totals.get("w", 0))
        self.scale, self.zh_scale = scale("w", self.total), scale("z", totals.get("z", 0))
        self.header = {w: n for w, n in self.counts["h"].items() if n >= LEAST_HEADER * scale("h", totals.get("h", 0))}
        self.rates = [math.log(max(LEAST_RATE, r)) for r in rates or [FIRST_RATE] * len(CONFUSIONS)]
        # Confusions that the corpus shows no trace of do not happen.
        self.happen = [k for k, r in enumerate(self.rates) if r > math.log(LEAST_RATE) + 1]
        every = math.log(sum(map(math.exp, self.rates)))
        self.again = [math.log(AGAIN) + r - every for r in self.rates]
        self.longest = max(map(len, self.word), default=0) if longest is None else longest
        self.after: dict[str, list[str]] = defaultdict(list)
        self.from_left: Counter = Counter(from_left)
        for p, n in self.zh.items():
            if from_left is None:
                self.from_left[p[0]] += n
            if n >= LEAST_PAIR * self.zh_scale and CJK.match(p[1]):
                self.after[p[0]].append(p[1])
        self.whole = whole
        self.memo: dict[str, tuple] = {}
        self.of_file: dict[str, tuple] = {}
        self.more: dict[tuple[str, str], int] = {}
        self.asked: set[tuple[str, str]] | None = None

    def file(self, more, asked: set[tuple[str, str]] | None = None) -> None:
        """Turns to a file with the rows (kind, term, n) that were found for it."""
        self.more = {(x["kind"], x["term"]): x["n"] for x in more} if more is not None else {}
        self.of_file, self.asked = {}, asked

    def count(self, kind: str, term: str) -> int:
        n = self.counts[kind].get(term)
        if n is None:
            n = self.more.get((kind, term))
            if n is None:
                if self.asked is not None:
                    self.asked.add((kind, term))
                n = 0
        return n

    def known(self, w: str) -> int:
        """Count of a word, as far as it is here."""
        return self.word.get(w) or self.more.get(("w", w), 0)

    def readings(self, read: str) -> tuple[tuple[str, float], ...]:
        """Words that may have been printed where `read` is, with the log probability of the misreading; itself first.

        As where rates are estimated, what was printed is more frequent than what it was misread for. Words with two misread places are only looked for where no word with one is known.
        """
        # What a kept word may stand for is more frequent, so it is kept too; another word's readings are those found for the file.
        memo = self.memo if self.whole or read in self.word else self.of_file
        got = memo.get(read)
        if got is None:
            if len(memo) > 400_000:
                memo.clear()
            got = memo[read] = ((read, 0.0), *self.others(read, self.known(read), self.known).items())
        return got

    def others(self, read: str, own: int, known: Callable[[str], int]) -> dict[str, float]:
        """The same without itself, by a function that gives the count of a word; own: count of read."""
        best: dict[str, float] = {}
        if len(read) <= self.longest + 2:
            once: dict[str, float] = {}
            for w, k in one_misread(read, self.happen):
                once[w] = max(once.get(w, -math.inf), self.rates[k])
            best = {w: p for w, p in once.items() if known(w) > own}
            if not best and self.misread_twice(read, own):
                for w, p in once.items():
                    for v, k in one_misread(w, self.happen):
                        if known(v) > own:
                            best[v] = max(best.get(v, -math.inf), p + self.again[k])
        return best

    def misread_twice(self, read: str, own: int) -> bool:
        """Whether a word may have two misread places."""
        return len(read) >= 4 and own <= self.scale

    def likely(self, w: str, before: str | None, read: bool) -> float:
        """Log probability of a word after another. One that stands here as it is read counts as far as it may be a printed one,
        and so does its pair with the word before, without this place."""
        n = self.count("w", w)
        real = min(1.0, REAL * max(1, n / self.scale)) if read else 1.0
        p = real * max(n, read * self.scale) / self.total
        if before is not None:
            pair = self.count("b", f"{before} {w}")
            few = 5 * self.scale
            p = 0.5 * p + 0.5 * (real * max(0, pair - read * self.scale) + few * p) / (self.count("w", before) + few)
        return math.log(max(p, 1e-12))

    def decode(self, words: list[str]) -> list[str]:
        """The most probable printed words of a line, by Viterbi over the readings of each word."""
        memo = self.memo
        options = [memo.get(w) or self.readings(w) for w in words]
        if max(map(len, options), default=1) == 1:
            return words
        best: dict[str, tuple[float, tuple]] = {}
        for k, option in enumerate(options):
            now: dict[str, tuple[float, tuple]] = {}
            for w, channel in option:
                own = w == words[k]
                if k == 0:
                    now[w] = (self.likely(w, None, own) + channel, (w, None))
                else:
                    score, path = max(((s + self.likely(w, v, own), p) for v, (s, p) in best.items()), key=lambda x: x[0])
                    now[w] = (score + channel, (w, path))
            best = now
        _, path = max(best.values(), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    def next_character(self, a: str, y: str, read: bool) -> float:
        """Log probability of a character after another; a pair that stands here as it is read counts as far as it may be printed."""
        n = self.count("z", a + y)
        if read:
            n = max(0, n - self.zh_scale) * min(1.0, REAL * n / self.zh_scale)
        return math.log((n + 0.01 * self.zh_scale) / (self.from_left[a] + self.zh_scale))

    def chinese(self, text: str) -> list[tuple[int, str]]:
        """Places of misread Chinese characters and the characters printed there, by Viterbi over runs of Chinese characters.

        A character's readings are those that often follow the one before and are often followed by the one after.
        """
        s, out = [flat_class(c) for c in text], []
        for m in CJK_RUN.finditer("".join(s)):
            low, high = max(0, m.start() - 1), min(len(s), m.end() + 1)
            part = s[low:high]
            options: list[list[tuple[str, float]]] = []
            for i, x in enumerate(part):
                option = [(x, 0.0)]
                if 0 < i < len(part) - 1 and CJK.match(x):
                    after = part[i + 1]
                    option += [(y, math.log(MISREAD_CHARACTER)) for y in self.after.get(part[i - 1], ()) if y != x and self.zh.get(y + after, 0) >= LEAST_PAIR * self.zh_scale]
                options.append(option)
            if all(len(o) == 1 for o in options):
                continue
            best = {part[0]: (0.0, (part[0], None))}
            for i in range(1, len(part)):
                now = {}
                for y, channel in options[i]:
                    both = ((sc + self.next_character(a, y, a == part[i - 1] and y == part[i]), path) for a, (sc, path) in best.items())
                    score, path = max(both, key=lambda x: x[0])
                    now[y] = (score + channel, (y, path))
                best = now
            _, path = max(best.values(), key=lambda x: x[0])
            for i in range(len(part) - 1, -1, -1):
                if path[0] != part[i]:
                    out.append((low + i, path[0]))
                path = path[1]
        return out


# A word as it may have been read: letters, with confusable digits and signs among them.
READ = re.compile(r"(?:[^\W_\u3400-\u9fff\uf900-\ufaff]|[!†¢|$@€])+")


NO_WORD = re.compile(r"0x\w*|[A-Z]{1,4}\d*|\d*[lOISZB]+\d[\dlOISZB]*|\d+[lOISZB]+")
NUMBERED = re.compile(r"(.*?[^\d])(\d{1,3})")
DIGIT = re.compile(r"\d")


TOKENS = re.compile(r"\S+")


def words_read(line: str) -> list[tuple[int, str]]:
    """Place and text of what may be words; identifiers, codes, numbers and hexadecimal parts are left out."""
    out = []
    for m in TOKENS.finditer(line):
        found = words_of(m[0])
        if found:
            at = m.start()
            out += [(at + k, w) for k, w in found]
    return out


@lru_cache(maxsize=1 << 18)
def words_of(token: str) -> tuple[tuple[int, str], ...]:
    """The same of one token without blanks: what stands beside a word there decides what it is."""
    out = []
    for m in READ.finditer(token):
        w, at = m[0], m.start()
        before = token[at - 1] if at else " "
        if w.isalpha():
            if before == "-" and HEX.fullmatch(w) or len(w) <= 4 and w.isupper() and w.isascii():
                continue
            out.append((at, w))
            continue
        w = w.rstrip("!|")
        if not w or not LETTERS.search(w):
            continue
        if HEX.fullmatch(w) and (before == "-" or DIGIT.search(w)) or NO_WORD.fullmatch(w):
            continue
        after = token[at + len(w)] if at + len(w) < len(token) else " "
        if after == "-" or before in "-/":
            bare = NUMBERED.fullmatch(w)
            if bare and LETTERS.fullmatch(bare[1]):
                w = bare[1]
        out.append((at, w))
    return tuple(out)


MIXED_NUMBER = re.compile(r"(?<![\w.\-/])\d*[lOISZB]+\d[\dlOISZB]*(?![\w\-/])|(?<![\w.\-/])\d+[lOISZB]+(?![\w\-/])")
# What a mixed number holds at least; signs that are no print.
MIXED, SIGNS = re.compile(r"\d[lOISZB]|[lOISZB]\d"), re.compile(r"[†¢ﬁﬂ]")
BAD_HEX = re.compile(r"-[0-9a-f]*(?:[olsàq†!]|cl)[0-9a-fols]*(?![\w])")


def words_asked(page: Page, channel: Channel) -> set[str]:
    """Words of the lines, also of two lines put together at a hyphen, whose readings the channel does not know by itself."""
    out: set[str] = set()
    at = page.body()
    for i, j in zip(at, [*at[1:], None]):
        line = page.lines[i].rstrip()
        words = [w.lower() for _, w in words_read(line)]
        out.update(words)
        if line[-1:] and line[-1] in HYPHENS and words and j is not None:
            follow = words_read(page.lines[j].strip())
            if follow:
                out.add(words[-1] + follow[0][1].lower())
    return {w for w in out if w not in channel.word}


def repair(page: Page, channel: Channel) -> list[tuple[int, str, list[str], str]]:
    """(line number, kind, noise, repaired line) of every line; the repaired line of noise lines is empty."""
    noise: dict[int, set[str]] = defaultdict(set)
    text = {i: page.lines[i].rstrip() for i in range(len(page.lines))}
    at = page.body()
    for n, i in enumerate(at):
        line = text[i]
        found = words_read(line)
        lower = [w.lower() for _, w in found]
        head, tail = None, None
        if n and text[at[n - 1]][-1:] in HYPHENS and text[at[n - 1]]:
            head = 0 if found and found[0][0] == len(line) - len(line.lstrip()) else None
        if line[-1:] and line[-1] in HYPHENS:
            tail = len(found) - 1 if found and found[-1][0] + len(found[-1][1]) == len(line) - 1 else None
            j = at[n + 1] if n + 1 < len(at) else None
            follow = words_read(text[j].lstrip()) if j is not None else []
            if tail is not None and follow and follow[0][0] == 0:
                a, b = lower[tail], follow[0][1].lower()
                joined, own = channel.count("w", a + b), channel.count("c", f"{a}-{b}")
                if not joined and not own:
                    printed = channel.decode([a + b])[0]
                    joined = channel.count("w", printed) if printed != a + b else 0
                pieces = min(channel.count("w", a), channel.count("w", b))
                marked = line[-1] != "-"
                if LETTERS.fullmatch(a.replace("!", "i").replace("†", "t")) is None and not joined:
                    pass
                elif (marked and own <= joined + channel.scale) or joined > own or (not own and not joined and (marked or pieces < 5 * channel.scale) and LETTERS.fullmatch(b)):
                    noise[i].add("hyphen")
                    printed = channel.decode([a + b])[0]
                    if printed != a + b:
                        noise[i if not printed.startswith(a) else j].add("ocr")
        inner = [k for k in range(len(found)) if k not in (head, tail) and len(found[k][1]) > 1]
        if not line.isascii() and CJK.search(line):  # such lines are cut anywhere
            inner = [k for k in inner if line[: found[k][0]].strip() and line[found[k][0] + len(found[k][1]) :].strip()]
        printed = channel.decode([lower[k] for k in inner])
        for k, w in sorted(zip(inner, printed), reverse=True):
            if w != lower[k]:
                start, read = found[k]
                good = w.capitalize() if read[:1].isupper() else w
                text[i] = text[i][:start] + (good.upper() if read.isupper() and len(read) > 1 else good) + text[i][start + len(read) :]
                noise[i].add("ocr")
        plain = line.isascii()
        if MIXED.search(line) and MIXED_NUMBER.search(line) or "-" in line and BAD_HEX.search(line) or not plain and SIGNS.search(line):
            noise[i].add("ocr")
            text[i] = MIXED_NUMBER.sub(lambda m: m[0].translate(DIGITS), text[i])
        if not plain and CJK.search(line):
            for k, y in channel.chinese(line):
                if k < len(text[i]) and text[i][k] == line[k]:
                    text[i] = text[i][:k] + y + text[i][k + 1 :]
                noise[i].add("ocr")
    out = []
    for i, kind in enumerate(page.kind):
        if kind in ("header", "page_number"):
            out.append((i + 1, kind, [kind], ""))
        else:
            out.append((i + 1, kind, sorted(noise[i]), text[i]))
    return out


def paragraphs(lines: list[tuple[int, str, list[str], str]]) -> str:
    """Continuous text: noise lines dropped, broken words and broken lines joined, paragraphs apart."""
    out: list[str] = []
    glue, broken = False, False
    for _, kind, noise, text in lines:
        if kind in ("header", "page_number", "rule"):
            continue
        if kind == "blank":
            glue = glue and bool(out) and not ENDED.search(out[-1])
            continue
        if kind != "body":
            same = out and kind == "table" and out[-1].rstrip().endswith("|")
            out[-1:] = [f"{out[-1]}\n{text}"] if same else [*out[-1:], text]
            glue = broken = False
            continue
        s = text.strip()
        if glue and out:
            if broken:
                out[-1] = out[-1][:-1] + s
            else:
                out[-1] += ("" if CJK.match(out[-1][-1:]) or CJK.match(s[:1]) or out[-1][-1:] in HYPHENS + "。，；：_/" else " ") + s
        else:
            out.append(s)
        glue, broken = True, "hyphen" in noise
    return "\n\n".join(out)


def confusion_rates(words: DataFrame) -> list[float]:
    """How often each confusion happens at a place where it can, estimated from the words (term, n) that are read in the corpus.

    A word may stand for any more frequent word that it becomes by one confusion, or be a printed one. Expectation and maximisation over
    that: shares of the words by the present rates, rates by the shares. Only sums for each confusion come to the driver.
    """

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, w, n, k) for w, n in zip(b["term"], b["n"]) for v, k in set(one_misread(w)) if v != w]
            yield pd.DataFrame(rows, columns=["v", "w", "n", "k"])

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, int(sum(n * w.count(c) for w, n in zip(b["term"], b["n"]) if c in w))) for k, (_, c) in enumerate(CONFUSIONS)] + [(-1, int(b["n"].sum()))], columns=["k", "n"])

    known = words.select(F.col("term").alias("v"), F.col("n").alias("nv"))
    pairs = words.mapInPandas(variants, "v string, w string, n long, k int").join(known, "v").where("nv > n")
    aligned = staged(pairs.groupBy("w", "n").agg(F.collect_list(F.struct("k", "nv")).alias("to")), "aligned")
    every = dict(map(tuple, words.mapInPandas(places, "k int, n long").groupBy("k").agg(F.sum("n")).collect()))
    real = REAL_AT_FIRST / scale("w", every.pop(-1, None) or 0)
    rates = [FIRST_RATE] * len(CONFUSIONS)
    for _ in range(ROUNDS):
        rate = F.array(*map(F.lit, rates))
        weight = F.transform("to", lambda x: F.struct(x["k"].alias("k"), (x["nv"] * F.get(rate, x["k"])).alias("p")))
        weighed = aligned.select("n", weight.alias("to")).withColumn("all", F.aggregate("to", F.col("n") * F.least(F.lit(1.0), F.lit(real) * F.col("n")), lambda s, x: s + x["p"]))
        shares = weighed.select("n", "all", F.inline("to")).groupBy("k").agg(F.sum(F.col("n") * F.col("p") / F.col("all")).alias("n"))
        got = dict(map(tuple, shares.collect()))
        rates = [max(LEAST_RATE, got.get(k, 0.0) / max(1, every.get(k, 0))) for k in range(len(CONFUSIONS))]
    return rates


def fit_channel(files: DataFrame, keep: dict[str, int] = KEEP) -> tuple[Channel, DataFrame | None]:
    """The channel with the most frequent terms of each kind, and the table (kind, term, n) of all terms; None if the channel has them all.

    Counts of all files are summed within a batch first. The kept terms are those above a count that a histogram of
    counts gives, so that no partition gives more than are kept in all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = {k: Counter() for k in KINDS}
            for text, pages in zip(b["markdown_content"], b["pages"]):
                counts_of(paged(text, pages, {}), total)
            yield pd.DataFrame([(k, t if isinstance(t, str) else " ".join(t), n) for k, found in total.items() for t, n in found.items()], columns=["kind", "term", "n"])

    terms = staged(files.select("markdown_content", "pages").mapInPandas(run, "kind string, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")), "terms")
    octave = F.floor(F.log2("n") * 64).cast("int")
    classes = terms.groupBy("kind", octave.alias("k")).agg(F.count("*").alias("terms"), F.sum("n").alias("n"), F.max(F.length("term")).alias("longest")).collect()
    totals: Counter = Counter()
    for r in classes:
        totals[r["kind"]] += r["n"]
    kept = (F.col("kind") == "h") & (F.col("n") >= LEAST_HEADER * scale("h", totals["h"])) | (F.col("kind") == "z") & (F.col("n") >= LEAST_PAIR * scale("z", totals["z"]))
    cut = False
    for kind in KEEP:
        least, left = 1 << 30, keep[kind]
        for r in sorted((r for r in classes if r["kind"] == kind), key=lambda r: -r["k"]):
            if r["terms"] > left:
                cut = True
                break
            least, left = r["k"], left - r["terms"]
        kept = kept | ((F.col("kind") == kind) & (octave >= least))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in terms.where(kept).collect():
        counts[r["kind"]][r["term"]] = r["n"]
    longest = max((r["longest"] for r in classes if r["kind"] == "w"), default=0)
    from_left = dict(map(tuple, terms.where("kind = 'z'").groupBy(F.substring("term", 1, 1)).agg(F.sum("n")).collect()))  # a row for each character at most
    channel = Channel(counts, totals, confusion_rates(terms.where("kind = 'w'").select("term", "n")), longest, from_left, not cut)
    return channel, terms if cut else None


def with_rare_terms(files: DataFrame, channel, terms: DataFrame | None) -> DataFrame:
    """files with more, the counts of those terms that a file asks for and the channel does not hold.

    First the words that a file's rare words may stand for, then the words, pairs and compounds that are weighed with them.
    """
    if terms is None:
        return files.withColumn("more", F.lit(None).cast(MORE))
    words = terms.where("kind = 'w'").select(F.col("term").alias("v"), F.col("n").alias("nv"))

    def reads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = channel.value
        for b in batches:
            rows = [(key, w) for key, text, pages in zip(b["key"], b["markdown_content"], b["pages"]) for w in words_asked(paged(text, pages, own.header), own)]
            yield pd.DataFrame(rows, columns=["key", "term"])

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = channel.value
        for b in batches:
            rows = [(w, n, v) for w, n in zip(b["term"], b["n"]) for v in {w, *(v for v, _ in one_misread(w, own.happen) if len(w) <= own.longest + 2)}]
            yield pd.DataFrame(rows, columns=["term", "n", "v"])

    def twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = channel.value
        for b in batches:
            rows = []
            for w, n in zip(b["term"], b["n"]):
                if own.misread_twice(w, n) and len(w) <= own.longest + 2:
                    rows += [(w, n, x) for x in {x for v, _ in one_misread(w, own.happen) for x, _ in one_misread(v, own.happen)}]
                    if len(rows) > 100_000:
                        yield pd.DataFrame(rows, columns=["term", "n", "v"])
                        rows = []
            yield pd.DataFrame(rows, columns=["term", "n", "v"])

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = channel.value
        for b in batches:
            rows = []
            for key, text, pages, more in zip(b["key"], b["markdown_content"], b["pages"], b["more"]):
                own.file(more, set())
                repair(paged(text, pages, own.header), own)
                rows += [(key, kind, term) for kind, term in own.asked]
            own.file(None)
            yield pd.DataFrame(rows, columns=["key", "kind", "term"])

    keyed = staged(files.withColumn("key", F.xxhash64("file_id", "markdown_content", "pages")), "scans")
    texts = keyed.select("key", "markdown_content", "pages")
    read = staged(texts.mapInPandas(reads, "key long, term string"), "reads")
    counted = read.select("term").distinct().join(words.select(F.col("v").alias("term"), F.col("nv").alias("n")), "term", "left").fillna(0, ["n"])
    found = staged(counted.mapInPandas(once, "term string, n long, v string").join(words, "v").where("nv > n or v = term"), "once")
    without = counted.join(found.where("nv > n"), "term", "left_anti")
    again = without.mapInPandas(twice, "term string, n long, v string").join(words, "v").where("nv > n")
    stands = found.unionByName(again).groupBy("term").agg(F.collect_list(F.struct(F.lit("w").alias("kind"), F.col("v").alias("term"), F.col("nv").alias("n"))).alias("more"))
    first = read.join(stands, "term").groupBy("key").agg(F.flatten(F.collect_list("more")).alias("more"))
    half = staged(keyed.join(first, "key", "left"), "half")
    asked = half.select("key", "markdown_content", "pages", "more").mapInPandas(weighed, "key long, kind string, term string")
    second = asked.join(terms, ["kind", "term"]).groupBy("key").agg(F.collect_list(F.struct("kind", "term", "n")).alias("weighed"))
    none = F.array().cast(MORE)
    return half.join(second, "key", "left").withColumn("more", F.concat(F.coalesce("more", none), F.coalesce("weighed", none))).drop("key", "weighed")


def scanned(conversions: DataFrame) -> DataFrame:
    """Files with a text, each repeated row once; pages that is no string of page numbers counts as unknown."""
    return conversions.where("markdown_content is not null and trim(markdown_content) <> ''").select("file_id", "markdown_content", "pages").distinct()


def scan_lines(conversions: DataFrame, keep: dict[str, int] = KEEP) -> DataFrame:
    """file_id, line_no, kind, noise, repaired of every line. Null and blank texts have none."""
    files = scanned(conversions)
    fitted, terms = fit_channel(files, keep)
    channel = files.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *line) for f, found in repaired(b, channel.value) for line in found]
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "kind", "noise", "repaired"])

    return with_rare_terms(files, channel, terms).mapInPandas(run, "file_id string, line_no int, kind string, noise array<string>, repaired string")


def repaired(batch: pd.DataFrame, channel: Channel) -> Iterator[tuple[str, list[tuple[int, str, list[str], str]]]]:
    for f, text, pages, more in zip(batch["file_id"], batch["markdown_content"], batch["pages"], batch["more"]):
        channel.file(more)
        yield f, repair(paged(text, pages, channel.header), channel)


def repaired_texts(conversions: DataFrame, keep: dict[str, int] = KEEP) -> DataFrame:
    """file_id, text: readable paragraphs of each file."""
    files = scanned(conversions)
    fitted, terms = fit_channel(files, keep)
    channel = files.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, paragraphs(found)) for f, found in repaired(b, channel.value)], columns=["file_id", "text"])

    return with_rare_terms(files, channel, terms).mapInPandas(run, "file_id string, text string")
