"""Near-duplicates by word shingles, and the pipeline's stage, against comparing all pairs of sets."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from factloom.llm import shingles, simhash
from tests.llm import brute


def jaccard_rows(rows, size=5, least=0.8):
    """(doc_id, component_id) of rows with different ids."""

    def own(text):
        w = brute.words(brute.lower_ascii(text or ""))
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    made = {k: own(t) for k, t in rows}
    low = brute.groups(made, lambda a, b: len(made[a] & made[b]) >= least * len(made[a] | made[b]))
    return sorted((k, low[k]) for k in made)


def planted():
    """Random texts with copies over and under the threshold, chains of copies, exact copies, odd texts."""
    rng = random.Random(11)
    draw = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five")]
    key = 10
    for length, changed in [(100, 1), (100, 2), (100, 5), (300, 1), (300, 6), (300, 20), (1000, 5), (1000, 20), (1000, 60)]:
        for _ in range(6):
            words = draw(length)
            rows.append((key, " ".join(words)))
            for copy in range(1, 3):
                for at in rng.sample(range(length), changed):
                    words[at] = f"x{key}-{copy}-{at}"
                rows.append((key + copy, " ".join(words)))
            key += 3
    base = draw(400)
    for copy in range(60):
        rows.append((key + copy, " ".join(base[:-1] + [f"end{copy}"])))
    return rows


def test_near_duplicates_of_planted_copies(spark):
    rows = planted()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.component_id) for r in shingles.near_duplicates(table).collect())
    assert got == jaccard_rows(rows)
    assert shingles.near_duplicates(table.limit(0)).count() == 0


def test_pipeline_stage_drops_copies_of_a_few_changed_words(spark):
    rows = planted()
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted({low for _, low in jaccard_rows(rows)})


def test_described_holds_simhash_fingerprints(spark):
    rows = [(k, t) for k, t in planted() if k < 40] + [(9999, "again and again and again and again and")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in shingles.described(table, 5, "doc_id", "text").collect()}
    assert got == {k: simhash.fingerprint(t, 5) for k, t in rows}


def test_leftover_groups_tell_a_forest(spark):
    rng = np.random.default_rng(3)
    base, made = rng.integers(0, 2**63, 120, dtype=np.uint64), []
    for n in range(900):
        own = base.copy()
        own[rng.choice(120, 2 + n % 25, replace=False)] = rng.integers(0, 2**63, 2 + n % 25, dtype=np.uint64)
        made.append((n.to_bytes(2), np.unique(own)))
    known = spark.createDataFrame([(k, bytearray(h.tobytes())) for k, h in made], "node binary, hashes binary")
    # All meet under each of three keys, in two blocks.
    members = spark.createDataFrame([(key, k, len(h), k) for key in (1, 2, 3) for k, h in made], "key long, node binary, size long, component binary")
    sets = dict(made)
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    links = [(bytes(r.a), bytes(r.b)) for r in shingles.linked_others(members, known, 0.8).collect()]
    assert all(both(a, b) >= 0.8 * (len(sets[a]) + len(sets[b]) - both(a, b)) for a, b in links)
    # A forest per pair of blocks, where there are some hundred thousand pairs.
    assert len(links) < 3 * len(made)
    terms = np.unique(np.concatenate(list(sets.values())))
    held = np.zeros((len(made), len(terms)), dtype=np.float32)
    for row, (_, own) in zip(held, made, strict=True):
        row[np.searchsorted(terms, own)] = 1
    shared, sizes = held @ held.T, held.sum(axis=1)
    near = shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared)
    assert partition(range(len(made)), np.argwhere(near).tolist()) == partition(range(len(made)), [(int.from_bytes(a), int.from_bytes(b)) for a, b in links])


def partition(nodes, edges):
    """The smallest node that each one reaches."""
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
