"""Phrase collocations by SON partitioning: frequent phrases of shards are the candidates, which are then counted exactly.

Documents are dealt over SHARDS by a hash of their ids.  A shard's local support is the global one in proportion to its
share of all bytes: a phrase below it in every shard is below the global support, in each language too, since its
counts add up.  So each shard is mined completely at that support, level by level (words and pairs first, then longer
phrases all pairs of which are frequent in the shard), the frequent phrases of all shards are united, and one more pass
counts these exactly.  A shard isn't a task: its phrases are counted by a shuffle of hashes, so that shards stay few and
their support high however large the table is.  What passes from one level to the next is a bitmap of hashes, sized by
their number up to MAP_BITS; where two hashes share a bit, or the bitmap is full, more is counted, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import bound_batches, checkpoint

SUPPORT, MOST_WORDS, TOP, SCALE, ABSORBED = 30, 4, 2000, 2_000_000, 80
SHARDS = 4
#: Bits of a bitmap for each hash, and of the largest one (64 MB); a segment is built by one task.
BITS_EACH, MAP_BITS, SEGMENT_BITS = 32, 1 << 29, 1 << 22
#: Words whose phrases are counted at once in a task, distinct words remembered at once, bytes of a text split at once.
BLOCK, MEMORY, SLICE = 1 << 21, 1 << 18, 1 << 20
#: Parts that a language's phrases are dealt over before its last ranking.
RANK_PARTS = 64

LOWER_AND_BREAK = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def mixed(values):
    """64-bit values spread evenly."""
    import numpy as np

    values = (values ^ (values >> np.uint64(31))) * np.uint64(ODD[1])
    return values ^ (values >> np.uint64(29))


class Words:
    """Words of texts as numbers, with their hashes and letters; number 0 ends a piece."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        class Numbers(dict):
            def __missing__(numbers, word):
                numbers[word] = number = len(self.words)
                self.words.append(word)
                self.hashes.append(xxh64_intdigest(word))
                return number

        self.numbers = Numbers()
        self.forget()

    def forget(self) -> None:
        self.words, self.hashes = [b"\n", b""], [0, 0]
        self.numbers.clear()
        self.numbers.update({b"\n": 0, b"": 1})

    def of(self, text: bytes) -> Iterator:
        """Arrays of the text's numbers, each ended by 0; only a piece longer than SLICE is taken in one."""
        import numpy as np

        text, at = text.translate(LOWER_AND_BREAK), 0
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE else text.find(b"\n", at + SLICE)
            end = len(text) if end < 0 else end
            tokens = text[at:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
            yield np.append(found[found != 1], np.int32(0))
            at = end + 1


def phrases(hashes, seed: int) -> Iterator:
    """For 1 to MOST_WORDS words, (places, hashes) of the phrases that start there; a hash of 0 ends a piece."""
    import numpy as np

    own = np.where(hashes == 0, np.uint64(0), mixed(hashes + np.uint64(seed)) | np.uint64(1))
    places = np.flatnonzero(own)
    value = own[places]
    for n in range(1, MOST_WORDS + 1):
        yield places, mixed(value * np.uint64(ODD[n - 1]) + np.uint64(n))
        going = places + n < len(own)
        places, value = places[going], value[going]
        going = own[places + n] != 0
        places, value = places[going], value[going]
        value = mixed(value * np.uint64(ODD[0]) + own[places + n])


def seed_of(lang: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode(), 1)


class Bitmap:
    """Which hashes may be among those that it was made of."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        import numpy as np

        self.bits, self.bytes = bits, np.zeros(bits // 8, dtype=np.uint8)
        for segment, content in segments.items():
            part = np.frombuffer(content, dtype=np.uint8)
            self.bytes[segment * (SEGMENT_BITS // 8) : segment * (SEGMENT_BITS // 8) + len(part)] = part

    def holds(self, keys):
        import numpy as np

        slot = keys.view(np.uint64) >> np.uint64(8) & np.uint64(self.bits - 1)
        return (self.bytes[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame) -> Bitmap:
    """The bitmap of (key); tasks build its segments, only these reach the driver, MAP_BITS at most."""
    count = keys.count()
    bits = min(MAP_BITS, max(1 << 16, 1 << (BITS_EACH * count).bit_length()))
    wide = min(bits, SEGMENT_BITS)

    def fill(rows):
        import numpy as np
        import pandas as pd

        flags = np.zeros(wide, dtype=np.uint8)
        flags[rows["slot"].to_numpy() % wide] = 1
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "content": [np.packbits(flags, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned("key", 8).bitwiseAND(bits - 1)
    slots = keys.select(slot.alias("slot")).distinct().withColumn("segment", F.floor(F.col("slot") / wide))
    made = slots.groupBy("segment").applyInPandas(fill, "segment long, content binary")
    return Bitmap(bits, {r.segment: bytes(r.content) for r in made.collect()})


class Buffer:
    """Numbers of words by group (a shard and a language, or a language) until a block is full."""

    def __init__(self):
        self.words = Words()
        self.clear()

    def clear(self) -> None:
        self.words.forget()
        self.parts, self.size = {}, 0

    def add(self, group, text: bytes) -> Iterator:
        """Take the text in, slice by slice, and say after each whether the block is full."""
        for found in self.words.of(text):
            self.parts.setdefault(group, []).append(found)
            self.size += len(found)
            yield self.full

    @property
    def full(self) -> bool:
        return self.size >= BLOCK or len(self.words.words) >= MEMORY

    def groups(self) -> Iterator:
        """(group, numbers, hashes) of what was gathered."""
        import numpy as np

        hashes = np.array(self.words.hashes, dtype=np.uint64)
        for group, parts in self.parts.items():
            numbers = np.concatenate(parts)
            yield group, numbers, hashes[numbers]


def _counted(groups, keep) -> Iterator:
    """(keys, counts) of the phrases of each (shard, lang): those of which ``keep`` tells the places."""
    import numpy as np

    for (shard, lang), _, hashes in groups:
        for keys in keep(phrases(hashes, seed_of(lang)), shard):
            if len(keys):
                yield np.unique(keys, return_counts=True)


def sharded(hashes, shard: int):
    """Keys of hashes within a shard: its number takes the place of the lowest bits."""
    import numpy as np

    return (hashes & ~np.uint64(SHARDS - 1) | np.uint64(shard)).view(np.int64)


def _short(levels, shard) -> Iterator:
    """Keys of words and pairs."""
    for n, (_, hashes) in enumerate(levels, 1):
        yield sharded(hashes, shard)
        if n == 2:
            return


def _long(known: Bitmap):
    """Keys of phrases of three words and more, all pairs of which ``known`` may hold."""
    import numpy as np

    def keep(levels, shard) -> Iterator:
        held = None
        for n, (places, hashes) in enumerate(levels, 1):
            if n == 2:
                size = int(places[-1]) + 1 if len(places) else 0
                held = np.zeros(size + MOST_WORDS, dtype=bool)
                held[places] = known.holds(sharded(hashes, shard))
            elif n > 2:
                good = np.logical_and.reduce([held[places + i] for i in range(n - 1)])
                yield sharded(hashes[good], shard)

    return keep


def _texts(docs: DataFrame) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SHARDS)).cast("int")
    return docs.select(shard.alias("shard"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _read(batches, group, flush) -> Iterator:
    """What ``flush`` makes of each full block of the rows (shard, lang, text)."""
    buffer = Buffer()
    for batch in batches:
        for shard, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for full in buffer.add(group(shard, lang), text):
                if full:
                    yield from flush(buffer)
                    buffer.clear()
    yield from flush(buffer)


def _mine(texts: DataFrame, shares: dict[int, int], keep) -> DataFrame:
    """(key) of the phrases that reach their shard's local support, of all that ``keep`` makes of a text."""

    def run(batches):
        import pyarrow as pa

        def flush(buffer):
            for keys, counts in _counted(buffer.groups(), keep):
                for at in range(0, len(keys), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)]), pa.array(counts[at : at + (1 << 18)].astype("int32"))], names=["key", "c"])

        yield from _read(batches, lambda shard, lang: (shard, lang), flush)

    total = sum(shares.values())
    # Dealt first: phrases were counted within blocks, so another count before the shuffle would find few to add.
    counted = texts.mapInArrow(run, "key long, c int").repartition("key").groupBy("key").agg(F.sum("c").alias("c"))
    wide = "decimal(38,0)"
    enough = F.lit(False)
    for shard, share in shares.items():
        enough = enough | ((F.col("key").bitwiseAND(SHARDS - 1) == shard) & (F.col("c").cast(wide) * F.lit(total).cast("decimal(18,0)") >= F.lit(SUPPORT * share).cast(wide)))
    return counted.where(enough).select("key")


def candidates(docs: DataFrame) -> DataFrame:
    """(key) of all phrases of 1 to MOST_WORDS words that are frequent in a shard, by hash, the shard's bits cleared."""
    texts = _texts(docs)
    shares = {r.shard: r.bytes for r in texts.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    short = checkpoint(_mine(texts, shares, _short))
    held = bitmap(short)
    spread = docs.sparkSession.sparkContext.broadcast(held)
    long = _mine(texts, shares, lambda levels, shard: _long(spread.value)(levels, shard))
    return checkpoint(short.unionByName(long).select(F.col("key").bitwiseAND(~(SHARDS - 1)).alias("key")).distinct())


def _known(hashes, seed: int, known: Bitmap) -> Iterator:
    """(n, starts, counts): one place of each phrase of n words that ``known`` may hold, and how often it stands there.

    All parts of a phrase that is frequent in a shard are, so only places whose shorter phrases are held are asked for longer ones.
    """
    import numpy as np

    held = None
    for n, (places, found) in enumerate(phrases(hashes, seed), 1):
        if held is not None:
            near = held[places] & held[places + 1]
            places, found = places[near], found[near]
        good = known.holds(found & ~np.uint64(SHARDS - 1))
        places, found = places[good], found[good]
        if not len(places):
            return
        held = np.zeros(len(hashes) + 1, dtype=bool)
        held[places] = True
        # Any place of a phrase names it, so the sort needn't be stable.
        order = np.argsort(found)
        found = found[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        yield n, places[order[first]], np.diff(np.append(first, len(found)))


def _names(words, numbers, starts, n: int):
    """The phrases of n words from ``starts``, as an Arrow array; ``words``: that of the numbers' words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*[words.take(pa.array(numbers[starts + i])) for i in range(n)], " ")


def _rows(lang: str, names, n: int, counts):
    """A batch of (lang, phrase, words, f)."""
    import pyarrow as pa

    size = len(counts)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), names, pa.repeat(pa.scalar(n, pa.int32()), size), pa.array(counts, type=pa.int64())], names=["lang", "phrase", "words", "f"])


def count_exactly(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(lang, phrase, words, f): occurrences in the whole table of all phrases of ``keys``; words 0: all words of a lang.

    ``keys`` hold the parts of their phrases, too.  Phrases whose hash only shares a bit with one of them may be counted as well, exactly.
    """
    known = docs.sparkSession.sparkContext.broadcast(bitmap(keys))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(buffer):
            words = pa.array([w.decode("utf-8", "replace") for w in buffer.words.words], type=pa.string())
            for lang, numbers, hashes in buffer.groups():
                yield _rows(lang, pa.array([""]), 0, np.array([np.count_nonzero(numbers)]))
                for n, starts, counts in _known(hashes, seed_of(lang), known.value):
                    for at in range(0, len(starts), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        yield _rows(lang, _names(words, numbers, starts[part], n), n, counts[part])

        yield from _read(batches, lambda _, lang: lang, flush)

    found = _texts(docs).mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _decimal(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def part_of(first: Column, count: Column) -> Column:
    """The phrase of ``count`` words from word ``first`` (from 1) of the array ``ws``."""
    return F.array_join(F.slice("ws", first, count), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates, each cut where it scores least."""
    f = frequent.select("lang", "phrase", "words", "f")
    cuts = f.where("words > 1").withColumn("ws", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", part_of(F.lit(1), F.col("k")).alias("first"), part_of(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    first, rest = f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumns({"_a": _decimal(F.col("a")), "_s": _decimal(F.col("l") + F.col("r"))})
    told = joined.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * _a DIV _s"))
    best = told.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def absorbed(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the most frequent longer candidate that holds each phrase of two words and more."""
    places = [(n, i, k) for n in range(3, MOST_WORDS + 1) for k in range(2, n) for i in range(1, n - k + 2)]
    parts = F.array(*[F.when(F.col("words") == n, part_of(F.lit(i), F.lit(k))) for n, i, k in places])
    long = frequent.where("words > 2").withColumn("ws", F.split("phrase", " ")).select("lang", "f", F.explode(parts).alias("phrase")).where("phrase IS NOT NULL")
    return long.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def mine(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the TOP collocations of each language.

    ``docs``: doc_id, text, lang; other columns are left alone.  Null texts are empty, a null lang is ``und``; a null
    id is like any other; repeated rows count each time.  Equal scores are ranked by count, then by the bytes of the
    phrase.  Languages without a phrase of SUPPORT occurrences, and an empty table, give no rows.  Texts are split in
    slices; only a text itself, and its longest piece, need to fit in a task's memory.
    """
    bound_batches(docs.sparkSession)
    counted = count_exactly(docs, candidates(docs))
    frequent = checkpoint(counted.where((F.col("words") == 0) | (F.col("f") >= SUPPORT)))
    several = frequent.where("words > 0")
    left = scored(several).join(absorbed(several), ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * _decimal(F.col("longest")) < ABSORBED * _decimal(F.col("a"))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    # The first of each part, then the first of these: a language's phrases are never sorted in one task.
    near = left.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= TOP)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TOP)
    total = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
