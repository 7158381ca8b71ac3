"""Stupid-backoff scores of documents under bigram counts of the whole corpus.

1. Words are counted.  Those with at least 1 / FREQUENT of all occurrences, of which there are FREQUENT at most, are
   known to every task by a small number and their count; other words are written as a negative 64-bit hash.
2. Bigrams of the TOP most frequent words are counted: at most TOP * TOP, known to every task as well.  They are
   scored where they are met, so that no bigram that a large share of the texts holds is ever shuffled.
3. All other bigrams become one row per document and bigram, which goes once to the partition of its key: the bigram
   itself if both words are frequent, else its infrequent word, whose count is the sum of its own rows there.  The
   counts are window sums over these rows; a bigram of two infrequent words goes to both words' partitions, to the
   second for backing off and to the first for its own count.
4. Values are summed per document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, checkpoint

#: A bigram seen less often backs off to its last word; a step back costs this factor.
LEAST_COUNT, BACKOFF = 2, 0.4
#: Words with at least 1 / FREQUENT of all occurrences are broadcast, with the counts of bigrams of the TOP first ones.
FREQUENT, TOP = 1 << 20, 2048
#: Bytes of texts that are hashed at once, up to the end of a word.
CHUNK = 1 << 19
#: Rows of an Arrow batch that a task returns.
ROWS = 1 << 16
#: Kinds of rows: a document, a bigram of frequent words, one keyed by its second word, one keyed by its first word.
DOCUMENT, PAIR, SECOND, FIRST = range(4)
START = 0
#: The other word of a FIRST row has this bit turned, so that it never agrees with that of a SECOND row.
TURNED = 1 << 62
#: Sums are made of integers in this unit, so that they don't depend on their order.
UNIT = 1 << 30
SPACES = re.compile(b"[\\x09-\\x0d\\x20]")


class Words:
    """Hashes of words, the stretches without white space, A-Z lower-cased; all words of a chunk at once.

    A word's hash is a polynomial of its bytes' random numbers, taken from sums over the whole chunk, and mixed.
    """

    def __init__(self):
        import numpy as np

        drawn = np.random.default_rng(3)
        self.number = drawn.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
        self.factor = int(drawn.integers(0, 2**64, dtype=np.uint64, endpoint=False)) | 1
        self.space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def reach(self, size: int) -> None:
        """Powers of the factor and of its inverse for chunks of ``size`` bytes."""
        import numpy as np

        if len(self.powers) <= size:
            for name, x in (("powers", self.factor), ("inverses", pow(self.factor, -1, 2**64))):
                setattr(self, name, np.r_[np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(size, CHUNK), x, dtype=np.uint64))])

    def chunk(self, raw: bytes):
        """(hashes as negative signed numbers, where each word begins)."""
        import numpy as np

        data = np.frombuffer(raw, dtype=np.uint8)
        space = self.space[data]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        self.reach(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.number[data] * self.powers[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.inverses[starts]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        return (value | np.uint64(1 << 63)).view(np.int64), starts

    def of(self, texts: list):
        """(hashes of all texts' words, words of each text).  Null has none."""
        import numpy as np

        raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]
        sizes, found = np.zeros(len(raws), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
        held, firsts, owners, length = [], [], [], 0

        def flush():
            nonlocal held, firsts, owners, length
            hashes, starts = self.chunk(b"\n".join(held))
            owner = np.array(owners)[np.searchsorted(np.array(firsts), starts, side="right") - 1]
            sizes[: len(raws)] += np.bincount(owner, minlength=len(raws))
            found.append(hashes)
            held, firsts, owners, length = [], [], [], 0

        for i, raw in enumerate(raws):
            for part in self.parts(raw):
                firsts.append(length)
                owners.append(i)
                held.append(part)
                length += len(part) + 1
                if length > CHUNK:
                    flush()
        if held:
            flush()
        return np.concatenate(found), sizes

    @staticmethod
    def parts(raw: bytes):
        """``raw`` in parts of about CHUNK bytes, none of which ends within a word."""
        at = 0
        while len(raw) - at > CHUNK:
            cut = SPACES.search(raw, at + CHUNK)
            end = cut.start() if cut else len(raw)
            yield raw[at:end]
            at = end
        yield raw[at:]


def before(words, sizes):
    """The word before each word of its text, START for the first."""
    import numpy as np

    out = np.r_[np.zeros(1, dtype=np.int64), words[:-1]] if len(words) else words
    first = np.cumsum(sizes) - sizes
    out[first[sizes > 0]] = START
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of every word of a column of texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = Words()
        for batch in batches:
            keys, n = np.unique(known.of(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Frequent:
    """Frequent words, numbered from 1 on by falling count, and counts of the bigrams of the first of them."""

    def __init__(self, hashes, counts):
        import numpy as np

        order = np.lexsort((hashes, -counts))
        self.count = np.r_[0, counts[order]].astype(np.int64)
        by_hash = np.argsort(hashes[order])
        self.hashes, self.number = hashes[order][by_hash], by_hash + 1
        self.pairs = None

    def code(self, hashes):
        """The word's number if it is frequent, else its hash."""
        import numpy as np

        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], hashes)

    def first_pairs(self, u, w):
        """Which bigrams (u, w) are of the TOP first words, and the places of those in ``pairs``."""
        known = (u > 0) & (w > 0) & (u <= TOP) & (w <= TOP)
        return known, (u[known] - 1) * TOP + w[known] - 1


def pair_counts(texts: DataFrame, shared) -> DataFrame:
    """(place, n) of the bigrams of the TOP first words: at most TOP * TOP rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        frequent, known, total = shared.value, Words(), np.zeros(TOP * TOP, dtype=np.int64)
        for batch in batches:
            words, sizes = known.of(batch.column(0).to_pylist())
            words = frequent.code(words)
            total += np.bincount(frequent.first_pairs(before(words, sizes), words)[1], minlength=len(total))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    return texts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def exploded(rows: DataFrame, shared, total: int, least: int, backoff: float) -> DataFrame:
    """(kind, key, other, row, times, doc_id, base): a DOCUMENT row of each text, and its bigrams.

    row numbers the texts, from the task and the place in it.  times: words of a document, or occurrences of a bigram
    in it.  base: what a document's bigrams of the TOP first words score, and its first word if that is frequent.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        frequent, known, row = shared.value, Words(), TaskContext.get().partitionId() << 32
        log_count = np.log(np.maximum(frequent.count, 1))
        step, log_total = np.log(backoff), np.log(max(total, 1))
        names = ["kind", "key", "other", "row", "times", "doc_id", "base"]
        for batch in batches:
            words, sizes = known.of(batch.column(1).to_pylist())
            w = frequent.code(words)
            u = before(w, sizes)
            text = np.repeat(np.arange(len(sizes)), sizes)
            top, place = frequent.first_pairs(u, w)
            times_met = frequent.pairs[place]
            hit = times_met >= least
            value = np.where(hit, np.log(np.maximum(times_met, 1)) - log_count[u[top]], step + log_count[w[top]] - log_total)
            begins = (u == START) & (w > 0)
            base = np.bincount(text[top], value, minlength=len(sizes)) + np.bincount(text[begins], log_count[w[begins]] - log_total, minlength=len(sizes))
            pair, second, first = (u > 0) & (w > 0) & ~top, w < 0, u < 0
            kind = np.repeat(np.array([PAIR, SECOND, FIRST], dtype=np.int32), [pair.sum(), second.sum(), first.sum()])
            key = np.concatenate([u[pair] * (2 * FREQUENT) + w[pair], w[second], u[first]])
            other = np.concatenate([np.zeros(pair.sum(), dtype=np.int64), u[second], w[first] ^ TURNED])
            text = np.concatenate([text[pair], text[second], text[first]])
            order = np.lexsort((other, key, text))
            kind, key, other, text = kind[order], key[order], other[order], text[order]
            fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1]) | (text[1:] != text[:-1])]) if len(key) else order
            times = np.diff(np.r_[fresh, len(key)])
            own = row + np.arange(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), DOCUMENT, dtype=np.int32)), pa.array(own), pa.array(np.full(len(own), -1)), pa.array(own), pa.array(sizes), batch.column(0), pa.array(base)], names=names
            )
            for at in range(0, len(fresh), ROWS):
                some = fresh[at : at + ROWS]
                nothing = [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(kind[some]), pa.array(key[some]), pa.array(other[some]), pa.array(row + text[some]), pa.array(times[at : at + ROWS]), *nothing], names=names)
            row += len(sizes)

    return rows.mapInArrow(run, "kind int, key long, other long, row long, times long, doc_id long, base double")


def valued(grams: DataFrame, counts: DataFrame, total: int, least: int, backoff: float) -> DataFrame:
    """``exploded`` rows with ``value``, from the counts of their bigram and their words."""
    # One shuffle, by key, and one sort: both sums are over rows that these bring together.
    ordered = Window.partitionBy("key").orderBy("other")
    c2 = F.sum("times").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    c1 = F.sum(F.when(F.col("kind") == SECOND, F.col("times"))).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counted = grams.repartition("key").select("*", c2.alias("c2"), c1.alias("c1"))
    kind = F.col("kind")
    other = F.when(kind == FIRST, F.col("other").bitwiseXOR(TURNED)).otherwise(F.col("other"))
    hit = (F.col("c2") >= least) & ~((kind == SECOND) & (other == START))
    # Of two infrequent words, the row at the first one scores a hit, and that at the second one backing off.
    elsewhere = ((kind == SECOND) & (other < 0) & hit) | ((kind == FIRST) & (other < 0) & ~hit)
    first, second = F.shiftright("key", FREQUENT.bit_length()), F.col("key").bitwiseAND(2 * FREQUENT - 1)
    # The frequent word whose count is needed besides: the first one's of a hit, else the second one's.
    needed: Column = (
        F.when(kind == PAIR, F.when(hit, first).otherwise(second))
        .when((kind == SECOND) & hit & (other > 0), other)
        .when((kind == FIRST) & ~hit & (other > 0), other)
    )
    known = counted.withColumns({"hit": hit, "elsewhere": elsewhere, "needed": needed}).join(F.broadcast(counts), F.col("needed") == F.col("number"), "left")
    x = F.ln(F.coalesce("n", "c1").cast("double"))
    step = F.when((kind == SECOND) & (other == START), 0.0).otherwise(F.log(F.lit(backoff)))
    score = F.when(F.col("hit"), F.ln(F.col("c2").cast("double")) - x).otherwise(step + x - F.log(F.lit(float(max(total, 1)))))
    return known.withColumn("value", F.when(kind == DOCUMENT, F.col("base")).when(F.col("elsewhere"), 0.0).otherwise(F.col("times") * score))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms) and score (its mean per word) of each row.

    With counts c over all of ``docs`` and N words in all, a word w after u scores c(u w) / c(u) if
    c(u w) >= ``least``, else ``backoff`` * c(w) / N; a text's first word scores c(w) / N.  A text without words
    has log_score 0 and a null score.  Repeated rows count each time and are scored alike; an empty table gives
    an empty result.  Words are told apart by 63 bits of a hash of all their bytes.
    """
    import numpy as np

    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = checkpoint(word_counts(rows.select("text")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * FREQUENT >= total).toArrow()
    frequent = Frequent(found.column("hash").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64))
    pairs = pair_counts(rows.select("text"), spark.sparkContext.broadcast(frequent)).toArrow()
    frequent.pairs = np.zeros(TOP * TOP, dtype=np.int64)
    frequent.pairs[pairs.column("place").to_numpy()] = pairs.column("n").to_numpy()
    numbers = spark.createDataFrame(_table(frequent.count))
    grams = exploded(rows, spark.sparkContext.broadcast(frequent), total, least, backoff)
    document = F.col("kind") == DOCUMENT
    summed = valued(grams, numbers, total, least, backoff).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(document, F.col("times"))).alias("n_words"), F.sum(F.round(F.col("value") * UNIT).cast("long")).alias("units")
    )
    log_score = F.col("units") / F.lit(float(UNIT))
    return summed.select("doc_id", "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("score"))


def _table(count):
    import numpy as np
    import pyarrow as pa

    return pa.table({"number": pa.array(np.arange(1, len(count)), type=pa.int64()), "n": pa.array(count[1:], type=pa.int64())})
