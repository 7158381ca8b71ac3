"""Collocations against plain counting, and the parts that mine shards."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import collocations
from tests.llm import brute

PARTS = ["New York City Hall", "new\tyork", "the old town, the new town", "état d'urgence", "a b c d e", "x; y! z? x\ry\x0bz\x0cw: x y"]
LONG = "alpha beta " * 9000 + "\n" + "gamma  delta\t" * 40
ROWS = [(i, " ".join(PARTS[j % 6] + " " for j in range(i % 7, i % 7 + 4)), ["en", "de", None][i % 3]) for i in range(400)] + [
    (500, None, "en"), (501, "", "fr"), (502, LONG, "en"), (502, LONG, "en"), (None, LONG, "de"), (503, " \t ", None), (504, "same same same same same " * 20, "es"), (505, "A\x00B a\x00b " * 40, "es"),
]


def plain(rows, support=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower_ascii(text or "")):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in known.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return plain.select("*", *[F.lit("mine").alias(n) for n in ("key", "phrase", "f", "rank", "n", "shard", "words")]).repartition(5)


def test_mine_equals_plain_counting(docs):
    got = sorted(tuple(r) for r in collocations.mine(docs).collect())
    assert len(got) > 30 and got == plain(ROWS)
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.where("doc_id = 501")).count() == 0


def test_small_blocks_and_slices_count_the_same(monkeypatch):
    import pyarrow as pa

    def counted():
        found = Counter()

        def flush(buffer):
            for lang, numbers, hashes in buffer.groups():
                for n, (places, _) in enumerate(collocations.phrases(hashes, collocations.seed_of(lang)), 1):
                    found.update((lang, b" ".join(buffer.words.words[i] for i in numbers[p : p + n])) for p in places)
                found[lang, b""] += int((numbers != 0).sum())
            yield len(buffer.parts)

        columns = [pa.array([0] * len(ROWS)), pa.array([r[2] or "und" for r in ROWS]), pa.array([(r[1] or "").encode() for r in ROWS])]
        batch = pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "text"])
        blocks = len(list(collocations._read([batch.slice(0, 300), batch.slice(300)], lambda _, lang: lang, flush)))
        return found, blocks

    whole, one = counted()
    for name, value in {"BLOCK": 300, "MEMORY": 30, "SLICE": 16}.items():
        monkeypatch.setattr(collocations, name, value)
    parts, many = counted()
    assert parts == whole and many > 30 > one


def test_full_and_small_bitmaps_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(collocations, "RANK_PARTS", 2)
    monkeypatch.setattr(collocations, "TOP", 5)
    monkeypatch.setattr(collocations, "bitmap", lambda _: collocations.Bitmap(1 << 16, {0: b"\xff" * (1 << 13)}))
    assert sorted(tuple(r) for r in collocations.mine(docs).collect()) == plain(ROWS, top=5)


def test_bitmap_holds_its_keys(spark):
    import numpy as np

    keys = [int(x) for x in np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20000)]
    held = collocations.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    others = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 20000)
    assert held.holds(np.array(keys)).all() and held.holds(others).mean() < 0.06
    assert not collocations.bitmap(spark.createDataFrame([], "key long")).holds(others).any()


def test_longer_phrases_are_asked_for_only_where_their_parts_are_held():
    import numpy as np

    buffer = collocations.Buffer()
    list(buffer.add("en", "a b c \udc80x a b c".encode("utf-8", "surrogateescape")))
    [(_, numbers, hashes)] = buffer.groups()
    levels = [set((found & ~np.uint64(collocations.SHARDS - 1)).tolist()) for _, found in collocations.phrases(hashes, 7)]

    class Held:
        def __init__(self, *levels):
            self.keys = set().union(*levels)

        def holds(self, keys):
            return np.array([k in self.keys for k in keys.tolist()], dtype=bool)

    import pyarrow as pa

    words = pa.array([w.decode("utf-8", "replace") for w in buffer.words.words])
    told = lambda *kept: [dict(zip(collocations._names(words, numbers, at, n).to_pylist(), c.tolist(), strict=True)) for n, at, c in collocations._known(hashes, 7, Held(*kept))]
    assert told(*levels) == [
        {"a": 2, "b": 2, "c": 2, "\ufffdx": 1}, {"a b": 2, "b c": 2, "c \ufffdx": 1, "\ufffdx a": 1}, {"a b c": 2, "b c \ufffdx": 1, "c \ufffdx a": 1, "\ufffdx a b": 1},
        {"a b c \ufffdx": 1, "b c \ufffdx a": 1, "c \ufffdx a b": 1, "\ufffdx a b c": 1},
    ]
    assert len(told(levels[0], levels[2])) == 1 and told(levels[1]) == []
