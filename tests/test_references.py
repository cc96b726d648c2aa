"""Orphan references: against plain Python, and on nulls, blanks, ties, repeats, empty tables and clashing columns."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textloom.operators import references as R

NODES = "node_id string, ref_doc_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, src_key string, key string"
DOCS = "ref_doc_id string, node_ids string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, reason string"
T0 = datetime(2024, 1, 15)


def brute(nodes, docs):
    import json

    def n(k):
        k = k.strip().lower() if k else k
        return k or None

    states = [{}, {}]
    for which, rows in enumerate((nodes, docs)):
        for r in rows:
            if n(r[0]):
                states[which].setdefault(n(r[0]), []).append((r[2], r[3] is not None))
    refs = {}
    for r in nodes:
        if n(r[0]) and n(r[1]):
            refs.setdefault(("kb_nodes", n(r[0]), n(r[1])), []).append(r[2])
    for r in docs:
        for e in json.loads(r[1]) if r[1] else []:
            if n(r[0]) and n(e):
                refs.setdefault(("kb_docs", n(r[0]), n(e)), []).append(r[2])
    out = set()
    for (table, key, ref), at in refs.items():
        own, other = (states[0], states[1]) if table == "kb_nodes" else (states[1], states[0])
        if max(own[key])[1]:
            continue
        rows = other.get(ref)
        reason = "missing" if not rows else "deleted" if max(rows)[1] else "late" if min(rows)[0] > min(at) else None
        if reason:
            out.add((table, key, ref, reason, min(at).strftime("%Y-%m")))
    return out


def run(spark, nodes, docs):
    n = spark.createDataFrame([(*r, "x", "y") for r in nodes], NODES)
    d = spark.createDataFrame([(*r, "z") for r in docs], DOCS)
    rows = R.node_doc_orphans(n, d).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r[c] for c in ("src_table", "src_key", "ref_key", "reason", "ref_month")) for r in rows}


def test_random_tables(spark):
    rnd = random.Random(1)
    for _ in range(3):
        keys_n, keys_d = [f"N{i}" for i in range(12)], [f"D{i}" for i in range(8)]

        def at(i):
            return T0 + timedelta(days=rnd.randrange(90), seconds=i)

        def odd(k):
            return rnd.choice([k, k.lower(), f"  {k}\t", k])

        nodes = [(odd(rnd.choice(keys_n)), rnd.choice([None, " ", odd(rnd.choice(keys_d)), "gone"]), at(i), rnd.choice([None, None, T0])) for i in range(40)]
        docs = [(odd(rnd.choice(keys_d)), rnd.choice([None, "[]", '["n1", null, " N2 ", "n99", ""]', '["N3","n3"]']), at(i), rnd.choice([None, None, T0])) for i in range(20)]
        assert run(spark, nodes, docs) == brute(nodes, docs)


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", "d", T0, None)], []) == {("kb_nodes", "a", "d", "missing", "2024-01")}


def test_equal_times_are_on_time_and_unreadable_lists_are_none(spark):
    assert run(spark, [("a", "d", T0, None)], [("D ", "no json", T0, None)]) == set()


def test_codes_are_unique_and_bits_fit(spark):
    keys = spark.range(5000).select(F.lit("s").alias("space"), F.col("id").cast("string").alias("key"))
    codes = R.key_dictionary(keys, 3)
    assert codes.select("space", "block", "bit").distinct().count() == 5000
    assert codes.agg(F.max("bit")).first()[0] < 32768
