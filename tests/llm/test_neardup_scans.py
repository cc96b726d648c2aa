"""Near-duplicates against brute force; scanned pages."""

import random

import numpy as np
import pandas as pd
import pytest

from textloom.llm import neardup as N
from textloom.llm import scans as S

WORDS = [f"{a}{b}" for a in ("ta", "co", "re", "mi", "lo", "pu", "xe") for b in ("ken", "ver", "dle", "sto", "bra", "nim", "qua", "zor")]


def brute(rows, threshold=0.7):
    import re

    texts = {}
    for src, key, text in rows:
        t = re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
        if key is not None and len(t) >= 100:
            texts[src, key] = N.substrings(t)
    out = set()
    items = sorted(texts.items())
    for i, ((s, a), x) in enumerate(items):
        for (u, b), y in items[i + 1 :]:
            if s == u and len(x & y) >= threshold * len(x | y):
                out.add((s, min(a, b), max(a, b)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rnd.choice(WORDS) + rnd.choice(["", str(rnd.randrange(999))]) for _ in range(rnd.choice([25, 40, 90, 200]))]
        for j in range(rnd.randrange(1, 5)):
            w = list(words)
            for _ in range(rnd.randrange(0, max(2, len(w) // 12))):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [w[k], "added"], [w[k][::-1]]])
            rows.append((rnd.choice(["kb", "kb", "docs"]), f"k{i}-{j}", rnd.choice([" ", "  ", "_"]).join(w).title()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = corpus(seed) + [("kb", "n1", None), ("kb", None, "x" * 200), ("kb", "n2", ""), ("kb", "n3", "短" * 150), ("kb", "n4", "短" * 160), ("kb", "n5", "😀a" * 80)]
    rows += [rows[0], ("kb", "copy", rows[1][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "src string, key string, text string, id string")
    members, pairs = N.near_duplicates(df)
    got = N.key_pairs(members, pairs).collect()
    assert len(got) == len({tuple(r) for r in got})
    found, want = {(r.src, r.key_a, r.key_b) for r in got}, brute(rows)
    assert found == want
    groups = {(r.src, r.key): r for r in N.record_groups(members, pairs).collect()}
    for s, a, b in found:
        assert groups[s, a].group_id == groups[s, b].group_id


@pytest.mark.parametrize("size", [110, 180, 330, 600])
def test_scattered_edits_against_brute_force(spark, size):
    """One character changed in every 22 or so, which leaves hardly a long window whole: all pairs are found, wherever the edits lie."""
    rnd = random.Random(size)
    rows = []
    for i in range(40):
        text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(size))
        step = rnd.choice([22, 23, 24, 26])
        at = range(step // 2, size, step) if i % 2 else rnd.sample(range(size), size // step)
        edited = "".join("ß" if k in set(at) else c for k, c in enumerate(text))
        rows += [("kb", f"a{i}", text), ("kb", f"b{i}", edited)]
    members, pairs = N.near_duplicates(spark.createDataFrame(rows, "src string, key string, text string"))
    want = brute(rows)
    assert len(want) >= 20 and {(r.src, r.key_a, r.key_b) for r in N.key_pairs(members, pairs).collect()} == want


def test_similarities_are_exact():
    rnd = random.Random(4)
    for chars in ("ab", "abcdefgh 0123", "".join(map(chr, range(0x4E00, 0x9F00))), "".join(map(chr, [*range(0x4E00, 0x9F00), *range(0x10000, 0x1F000), *range(0x20000, 0x2A000)]))):
        a = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(0, 60))) for _ in range(50)]
        a += ["".join(chars)] * 2
        b = [t[: len(t) // 2] + rnd.choice(chars) + t[len(t) // 2 :] for t in a]
        want = [len(N.substrings(x) & N.substrings(y)) / max(1, len(N.substrings(x) | N.substrings(y))) for x, y in zip(a, b)]
        assert N.similarities(a, b).tolist() == want
    assert N.similarities([], []).tolist() == []


def test_empty_table(spark):
    members, pairs = N.near_duplicates(spark.createDataFrame([], "src string, key string, text string"))
    assert N.key_pairs(members, pairs).count() == 0 and N.record_groups(members, pairs).count() == 0


def test_many_copies_and_a_hot_family(spark):
    base = " ".join(WORDS[:40])
    rows = [("kb", f"c{i}", base) for i in range(30)] + [("kb", f"v{i}", base + f" tail{i}") for i in range(10)]
    members, pairs = N.near_duplicates(spark.createDataFrame(rows, "src string, key string, text string"))
    assert N.key_pairs(members, pairs).count() == 40 * 39 // 2
    assert {r.copies for r in N.record_groups(members, pairs).where("key like 'c%'").collect()} == {30}


def test_components_are_connected_parts(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (102, 101)] + [(200, x) for x in range(201, 215)]
    got = {r.id: r.root for r in N.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 215)} == {200} and len(got) == 39


def test_blocks_meet_all_pairs():
    """Every two texts of a token meet once, however many blocks it is split into; other tokens' texts never do."""
    n = 50
    key, count = np.repeat(np.array([5, 6], np.uint32), n), np.repeat([n, 3], n)
    rep, wide, side = N.in_blocks(key, N.mix(np.arange(2 * n).astype(np.uint64)), count, 8)
    assert len(rep) == n * 7 + n
    sketch = np.zeros((len(rep), 2), np.uint64)
    part = {"key": (wide >> np.uint64(32)).astype(np.uint32), "id": rep.astype(np.int64), "sketch": sketch, "need": (4 + side).astype(np.uint8)}
    got = N.meet(pd.DataFrame({k: [v.tobytes()] for k, v in part.items()}))
    assert set(zip(got["a"], got["b"])) == {(i, j) for t in (0, n) for i in range(t, t + n) for j in range(i + 1, t + n)} and (got["n"] == 1).all()


@pytest.mark.parametrize("shared", [1, 2])
def test_prefixes_guarantee_the_smaller_need(shared):
    """Two texts that both need 2 tokens must share 2; if one needs 1, one is enough."""
    key = np.tile(np.arange(shared, dtype=np.uint32), 3)
    need = np.repeat([2, 2, 1], shared) * 4 + 2
    part = {"key": key, "id": np.repeat(np.array([7, 9, 11]), shared), "sketch": np.zeros((3 * shared, 2), np.uint64), "need": need.astype(np.uint8)}
    got = N.meet(pd.DataFrame({k: [v.tobytes()] for k, v in part.items()}))
    want = {(7, 11), (9, 11)} | ({(7, 9)} if shared == 2 else set())
    assert {(a, b) for a, b, n, m in got.itertuples(index=False) if n >= m} == want


def test_dear_texts_have_longer_prefixes():
    keys = np.random.default_rng(1).integers(0, 1 << 32, (3, N.BANDS), np.uint32, False)
    table = np.bincount(N.slot(keys[1]), minlength=1 << N.TABLE_BITS) * 500 + np.bincount(N.slot(keys[2]), minlength=1 << N.TABLE_BITS) * 8 + 1
    chosen, need, _ = N.prefixes(keys, table)
    assert need.tolist() == [1, 3, 2] and (chosen.sum(1) - need == N.BANDS - N.SHARED).all()


@pytest.mark.parametrize("size", [120, 160, 300, 600, 2000, 12000])
@pytest.mark.parametrize("step", [24, 28, 36, 50])
def test_evenly_spread_edits(size, step):
    """One substitution every so many characters, in texts of words: every pair of similarity 0.7 has enough tokens in common."""
    rnd = random.Random(size + step)
    texts = []
    for _ in range(30):
        text = "".join(rnd.choice(WORDS) + str(rnd.randrange(9999)) + " " for _ in range(size // 8 + 1))[:size]
        texts += [text, "".join("q" if k % step == step // 2 else c for k, c in enumerate(text))]
    tokens, found = {}, N.grams_of(texts)
    marks = N.marks_of(found[0], found[1], len(texts))
    for k, at, values in N.least_hashes(*found):
        for i, row in zip(at.tolist(), np.stack([values[:, j :: N.BAND] for j in range(N.BAND)], 2)):
            tokens.setdefault(i, {})[k] = row
    for i in range(0, len(texts), 2):
        a, b = N.substrings(texts[i]), N.substrings(texts[i + 1])
        if len(a & b) >= 0.7 * len(a | b):
            both = tokens[i].keys() & tokens[i + 1].keys()
            assert max((tokens[i][k] == tokens[i + 1][k]).all(1).sum() for k in both) >= N.SHARED
            assert N.marks_differ(marks[i : i + 1], marks[i + 1 : i + 2])[0] <= N.MARKS_DIFFER


def page(n, header, body):
    return "\n".join([header, "", *body, "", f"- {n} -"])


def test_scans(spark):
    body = ["The operator noticed that the table kept growing and that", "the value no longer matched. After the retention policy was", "restarted the summary task reported an error within minutes", "for every tenant."]
    files = []
    for i in range(30):
        text = "\n".join(page(7 + k, f"Manual {i}.2 Operations", [f"{WORDS[(i + k + j) % 50]} {x}" for j, x in enumerate(body)]) for k in range(3))
        for k, (a, b) in {5: ("policy", "p0licy"), 11: ("longer", "l0nger"), 17: ("restarted the", "restarted thc"), 23: ("growing", "gr0wing"), 29: ("error", "err0r")}.items():
            text = text.replace(a, b, 1) if i == k else text  # a confusion that leaves no trace but once is not believed
        files.append((f"f{i}", text, "7-9", "clash"))
    bad = "Manual 9.2 Operations\n\nThe operat0r noticed that the tab1e kept growing and that\nthe value no longer mat-\n\n- 7 -\n\nManual 9.2 Operations\n\nched. After the reten¬\ntion policy was restarted the summary task\nreported an error.\n\nRecommended value:\n\n128\n\n-----\n\n- 8 -"
    files += [("bad", bad, "7-8", None), ("bad", bad, "7-8", None), ("null", None, None, None), ("empty", "", "x", None), ("long", "gnat " * 20000, None, None)]
    df = spark.createDataFrame(files, "file_id string, markdown_content string, pages string, noise string")
    rows = {(r.line_no, n) for r in S.scan_lines(df).where("file_id = 'bad'").collect() for n in r.noise}
    assert rows == {(1, "header"), (3, "ocr"), (4, "hyphen"), (6, "page_number"), (8, "header"), (10, "hyphen"), (20, "page_number")}
    text = {r.file_id: r.text for r in S.repaired_texts(df).collect()}
    assert text["bad"].startswith("The operator noticed that the table kept growing and that the value no longer matched. After the retention policy was")
    assert "128" in text["bad"] and set(text) == {"bad", "long", *(f"f{i}" for i in range(30))}
    assert S.scan_lines(df.limit(0)).count() == 0
    few = S.scan_lines(df, {"w": 60, "b": 20, "z": 5, "c": 1, "h": 5_000}).where("file_id = 'bad'")
    assert {(r.line_no, n) for r in few.collect() for n in r.noise} == rows


def test_what_is_kept_does_not_decide(spark):
    """Rare words stand for rare words, once or twice misread, also across a hyphen; Chinese: the same lines whatever is sent to all tasks."""
    rnd = random.Random(5)
    words = [f"{w}{x}" for w in WORDS for x in ("el", "om", "ude", "fun", "fihub", "lote", "hesode")]
    swap = {"c": "e", "0": "o", "5": "s", "†": "t"}
    files = []
    for i in range(40):
        lines = []
        for _ in range(40):
            line = [rnd.choice(words) for _ in range(8)]
            for _ in range(rnd.randrange(3)):
                k = rnd.randrange(8)
                for _ in range(rnd.choice([1, 1, 2])):
                    a, b = rnd.choice(list(swap.items()))
                    line[k] = line[k].replace(b, a, 1)
            lines.append(" ".join(line))
            if rnd.random() < 0.2:
                lines[-1] += f" {line[0][:3]}-\n{line[0][3:]}"
        lines += ["系统重启，系统正常，服务重启。" * 3, "系充重启，系统正常，服务重启。" if i % 9 == 0 else "服务正常，系统重启。"]
        files.append((f"f{i}", "\n".join(lines), "1-2"))
    df = spark.createDataFrame(files, "file_id string, markdown_content string, pages string")
    want = {tuple(map(str, r)) for r in S.scan_lines(df).collect()}
    assert sum("ocr" in r[3] for r in want) > 300 and any("hyphen" in r[3] for r in want) and any("系统重启，系统正常，服务重启。" == r[4] for r in want)
    for keep in ({"w": 30, "b": 20, "z": 3, "c": 1, "h": 1}, {"w": 300, "b": 400, "z": 0, "c": 0, "h": 0}):
        assert {tuple(map(str, r)) for r in S.scan_lines(df, keep).collect()} == want


def test_confusion_rates_are_estimated(spark):
    """Words misread c for e at one place in 200 give that rate; pairs of words that are both printed give none."""
    rnd = random.Random(2)
    counts = {f"{w}{x}": 200 for w in WORDS for x in ("el", "om", "ude", "fun", "fihub")} | {"form": 900, "torm": 800}
    seen = {}
    for w, n in counts.items():
        for _ in range(n):
            r = "".join("c" if c == "e" and rnd.random() < 0.005 else c for c in w)
            seen[r] = seen.get(r, 0) + 1
    rates = dict(zip(S.CONFUSIONS, S.confusion_rates(spark.createDataFrame(list(seen.items()), "term string, n long"))))
    assert 0.003 < rates["c", "e"] < 0.007 and max(rates[k] for k in (("f", "t"), ("t", "f"), ("n", "u"), ("b", "h"))) < 0.0005


@pytest.mark.parametrize("times", [1, 300])
def test_larger_corpora_are_read_alike(spark, times):
    """A corpus with all counts many times as high has the same confusions, readings and header words."""
    words = {f"{w}{x}": 200 for w in WORDS for x in ("el", "om", "ude", "fun", "fihub")} | {"form": 900, "torm": 800, "a": 900_000}
    words |= {w.replace("e", "c", 1): 2 for w in list(words) if "e" in w and words[w] == 200}
    words = {w: n * times for w, n in words.items()}
    rates = S.confusion_rates(spark.createDataFrame(list(words.items()), "term string, n long"))
    assert 0.003 < rates[S.CONFUSIONS.index(("c", "e"))] < 0.02
    zh = {a + b: n * times for a, b, n in (("系", "统", 400), ("统", "重", 300), ("系", "充", 1), ("充", "重", 1), ("重", "启", 300), ("统", "，", 200))}
    channel = S.Channel({"w": words, "z": zh, "h": {"manual": 40 * times, "the": 1 * times}}, {"w": sum(words.values()), "z": 40_000 * times, "h": 3_000 * times}, rates)
    assert channel.decode(["takcnfun", "form", "torm", "takcnom"]) == ["takenfun", "form", "torm", "takenom"]
    assert channel.chinese("系充重启") == [(1, "统")]
    assert "manual" in channel.header and "the" not in channel.header


def test_pairs_of_words_decide():
    counts = {"w": {"the": 900, "main": 300, "mam": 1, "rnain": 2, "stem": 300, "stern": 300, "ship": 200, "cell": 200}, "b": {"stern ship": 190, "stem cell": 190, "the main": 290}}
    rates = [0.01] * len(S.CONFUSIONS)
    assert S.Channel(counts, None, rates).decode(["the", "rnain"]) == ["the", "main"]
    read = {**counts, "w": {**counts["w"], "stcm": 1}}
    assert S.Channel(read, None, rates).decode(["stcm", "cell"]) == ["stem", "cell"]
    stern = {**counts, "w": {**counts["w"], "stem": 41, "stern": 40}}
    with_pairs, without = S.Channel(stern, None, [0.05] * len(S.CONFUSIONS)), S.Channel({"w": stern["w"]}, None, [0.05] * len(S.CONFUSIONS))
    assert with_pairs.decode(["stern", "cell"]) != without.decode(["stern", "cell"])


def test_page_numbers():
    assert [S.number(x) for x in ("12", "l57", "xiv", "ll3", "S8")] == [12, 157, 14, 113, 58]
