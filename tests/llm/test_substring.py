"""Operator 12 against a table of all windows, by broadcast and by shuffled shards."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.llm import substring

DOCS = "doc_id long, text string"


def brute(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def table(seed, n=70):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyzÄ")
    shared = [[word() for _ in range(rng.choice([9, 10, 14, 40]))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 3, 20, 60]))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        if rows and rng.random() < 0.3:  # a near copy
            w = re.split(r"\s+", rng.choice(rows)[1] or "") + w
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "edit"
        rows.append((rng.randrange(-50, 400) if seed % 2 else i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000, "a b " * 3000), (1001, "b a " * 100), (None, rows[3][1]), (None, None), (1002, None), (1003, ""), (1004, " \n "), (5, "p q r s t u v w x y z é"), (5, "p q r s t u v w x y z é"), (5, "q r s t u v w x y z é zz"), (7, " p q r s t u v w x y z é")]
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()), key=str)


@pytest.mark.parametrize("words", [10**6, 0])
def test_equals_all_windows(spark, monkeypatch, words):
    monkeypatch.setattr(substring, "BROADCAST_WORDS", words)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    for seed in (1, 2):
        rows = table(seed)
        docs = spark.createDataFrame(rows, DOCS).withColumn("starts", F.lit(1)).withColumn("tkey", F.lit("x")).repartition(3)
        assert collected(substring.remove_repeated_passages(docs, 10, 4)) == brute(rows, 10)


@pytest.mark.parametrize("rounds", [1, 3])
def test_hot_anchors(spark, monkeypatch, rounds):
    """A phrase of many different neighbours: other anchors are taken, and what stays hot is dealt to pairs of blocks."""
    monkeypatch.setattr(substring, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 40)
    monkeypatch.setattr(substring, "HOT", 6)
    monkeypatch.setattr(substring, "ROUNDS", rounds)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    tails = [[word() for _ in range(9)] for _ in range(12)]
    rows = [(i, " ".join([*rng.choice(tails), *"one two three four five six".split(), *rng.choice(tails)])) for i in range(80)]
    assert collected(substring.remove_repeated_passages(spark.createDataFrame(rows, DOCS), 10, 4)) == brute(rows, 10)


def test_production_window_and_empty_table(spark, monkeypatch):
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(99)}" for _ in range(70))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(6)] + [(9, "x " + " ".join(passage.split()[:49])), (10, "y " + " ".join(passage.split()[3:53]))]
    for words in (10**6, 0):
        monkeypatch.setattr(substring, "BROADCAST_WORDS", words)
        assert collected(substring.remove_repeated_passages(spark.createDataFrame(rows, DOCS))) == brute(rows, 50)
        assert collected(substring.remove_repeated_passages(spark.createDataFrame([], DOCS))) == []


def test_automaton_knows_the_first_document_of_every_run():
    rng = random.Random(8)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    automaton = substring.SuffixAutomaton()
    for i, t in enumerate(texts):
        automaton.add(t, 100 - i)
    automaton = substring.SuffixAutomaton.load(automaton.settle().dump())
    for window in (1, 2, 5, 9):
        for probe in [*texts, [rng.choice([b"a", b"b", b"d"]) for _ in range(200)]]:
            for end, first in enumerate(automaton.firsts(probe, window)):
                run = probe[end + 1 - window : end + 1] if end + 1 >= window else None
                known = [100 - i for i, t in enumerate(texts) if run and any(t[a : a + window] == run for a in range(len(t)))]
                assert first == min(known, default=substring.NONE)
