"""BPE encoding and decoding with content-defined chunks: what documents share is encoded once.

A rolling hash cuts every text before a space, so that equal passages give equal chunks wherever they stand.
A first scan counts the chunks' digests.  A bit map of fixed size tells the second scan which chunks may be
shared; texts without such a chunk are finished on the spot.  Of the others, each shared chunk goes once to one
task that encodes it, and the ids come back to be put together in order.  At every join the words on both sides
are encoded together, in growing windows, until they agree with the ids of the parts; chunks that never agree are
encoded as one.  Too many shared chunks for the bit map only send more texts the second way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, checkpoint
from factloom.llm.wordbpe import WordIds, word_ids

#: A cut after 2**CUT_BITS bytes on average.
CUT_BITS = 10
#: Bits of the map of shared chunks: 4 MB, whatever the number of chunks.
MAP_BITS = 25
#: Bytes that the rolling hash looks at.
ROLL = 32
DONE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def gear():
    """A 32-bit number for each byte, from a linear congruential generator."""
    import numpy as np

    out, x = [], 1
    for _ in range(256):
        x = (6364136223846793005 * x + 1442695040888963407) % 2**64
        out.append(x >> 32)
    return np.array(out, dtype=np.uint32)


def cuts(raw: bytes, gears) -> list[int]:
    """Where ``raw`` is cut: its start, the space after each place whose rolling hash ends in zeros, its end."""
    import numpy as np

    data = np.frombuffer(raw, dtype=np.uint8)
    rolled, width = gears[data], 1
    while width < ROLL:
        more = rolled.copy()
        more[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = more, 2 * width
    chosen = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0)
    spaces = np.flatnonzero((data == 32) | (data == 10) | (data == 9)) if len(chosen) else chosen
    at = np.searchsorted(spaces, chosen)
    inner = np.unique(spaces[at[at < len(spaces)]]).tolist()
    return [0, *[k for k in inner if k > 0], len(raw)]


def agree(memory: WordIds, left: str, right: str) -> bool:
    """Whether the ids of left + right are those of left, then right: windows around the join grow until so."""
    before, after, width = left.split(" "), right.split(" "), 1
    while True:
        # ``right`` begins with a space, so its first word is what follows that.
        a, b = " ".join(before[-width:]), " ".join(after[: width + 1])
        if memory.library(a + b) == memory.library(a) + memory.library(b):
            return True
        if width >= len(before) and width >= len(after):
            return False
        width *= 2


class Finish:
    """Digests of a document's ids and of the text that they decode to."""

    def __init__(self, vocabulary: str):
        tokenizer = word_ids(vocabulary).tokenizer
        size = max(tokenizer.get_vocab().values()) + 1
        # Without a decoder, decode() writes the tokens with a space between them.
        self.joined = tokenizer.decoder is None
        self.tokenizer, self.shown = tokenizer, [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def __call__(self, ids: bytes) -> tuple[int, str, str]:
        from hashlib import sha256

        import numpy as np

        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if self.joined:
            text = b" ".join(map(self.shown.__getitem__, numbers))
        else:
            text = self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return len(numbers), sha256(ids).hexdigest(), sha256(text).hexdigest()


def shared_map(docs: DataFrame, text_col: str = "text"):
    """The bit map of chunk digests that occur twice or more in all of ``docs``, as unsigned 64-bit words."""
    import numpy as np

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        gears, seen = gear(), Counter()

        def out():
            keys = np.fromiter(seen.keys(), dtype=np.uint64, count=len(seen)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(seen.values()), type=pa.int64())], names=["digest", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = text.encode("utf-8", "replace")
                at = cuts(raw, gears)
                seen.update(xxh3_64_intdigest(raw[a:b]) for a, b in zip(at, at[1:], strict=False))
            if len(seen) > 500_000:
                yield from out()
        if seen:
            yield from out()

    counted = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "digest long, n long")
    twice = counted.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    place = f"digest & {2**MAP_BITS - 1}"
    words = twice.selectExpr(f"({place}) >> 6 AS word", f"shiftleft(1L, cast(({place}) & 63 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2 ** (MAP_BITS - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's text, without special tokens added.

    A null text counts as empty: no tokens, and digests of nothing.  Repeated rows and ids stay apart.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(shared_map(rows))
    shape = f"{DONE}, row long, part int, digest binary, chunk string, ids binary"

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        memory, finish, gears, bits = word_ids(vocabulary), Finish(vocabulary), gear(), shared.value
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("row", pa.int64()), ("part", pa.int32()), ("digest", pa.binary()), ("chunk", pa.string()), ("ids", pa.binary())]
        )
        row, sent = TaskContext.get().partitionId() << 40, set()

        def is_shared(chunk: bytes) -> bool:
            at = xxh3_64_intdigest(chunk) & (2**MAP_BITS - 1)
            return bool(int(bits[at >> 6]) >> (at & 63) & 1)

        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, row = (text or "").encode("utf-8", "replace"), row + 1
                at = cuts(raw, gears)
                chunks = [(raw[a:b], is_shared(raw[a:b])) for a, b in zip(at, at[1:], strict=False)]
                if not any(s for _, s in chunks):
                    out.append((key, *finish(memory.encode(raw.decode())), None, None, None, None, None))
                    continue
                parts: list[tuple[str, bool]] = []
                for chunk, own in ((c.decode(), not s) for c, s in chunks):
                    # Chunks of the document's own are one part; so are two that don't agree at their join.
                    if parts and (own and parts[-1][1] or not agree(memory, parts[-1][0], chunk)):
                        parts[-1] = (parts[-1][0] + chunk, True)
                    else:
                        parts.append((chunk, own))
                for n, (chunk, own) in enumerate(parts):
                    if own:
                        ids = np.frombuffer(memory.encode(chunk), dtype="<u4")
                        small = ids.astype("<u2") if not len(ids) or ids.max() < 2**16 else ids
                        code = bytes([small.itemsize]) + small.tobytes()
                        out.append((key, None, None, None, row, n, None, None, code))
                    else:
                        digest = xxh3_128_digest(chunk.encode())
                        out.append((key, None, None, None, row, n, digest, None if digest in sent else chunk, None))
                        sent.add(digest)
                if len(sent) > 500_000:
                    sent.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        memory = word_ids(vocabulary)
        for batch in batches:
            codes = []
            for chunk in batch.column(1).to_pylist():
                ids = np.frombuffer(memory.encode(chunk), dtype="<u4")
                small = ids.astype("<u2") if not len(ids) or ids.max() < 2**16 else ids
                codes.append(bytes([small.itemsize]) + small.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, type=pa.binary())], names=["digest", "ids"])

    def assemble(batches):
        import numpy as np
        import pyarrow as pa

        finish, names = Finish(vocabulary), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        row, key, held = None, None, []

        def whole():
            return (key, *finish(b"".join(np.frombuffer(x, dtype=f"<u{x[0]}", offset=1).astype("<u4").tobytes() for x in held)))

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for number, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number != row and row is not None:
                    out.append(whole())
                    held = []
                row, key = number, doc
                held.append(ids)
            if out:
                yield table(out)
        if row is not None:
            yield table([whole()])

    found = checkpoint(rows.mapInArrow(scan, shape))
    chunks = found.where("chunk IS NOT NULL").groupBy("digest").agg(F.any_value("chunk").alias("chunk"))
    coded = chunks.mapInArrow(encode, "digest binary, ids binary")
    part = ["row", "doc_id", "ids", "part"]
    again = found.where("digest IS NOT NULL").select("row", "doc_id", "part", "digest").join(coded, "digest").select(part)
    parts = found.where("ids IS NOT NULL").select(part).unionByName(again)
    joined = parts.repartition("row").sortWithinPartitions("row", "part").mapInArrow(assemble, DONE)
    return found.where("row IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(joined)
