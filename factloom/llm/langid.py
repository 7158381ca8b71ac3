"""Language of whole texts by unigram pieces of a public vocabulary, summed over all segmentations of each word.

Training adds up expected piece counts of every training word (forward-backward from equal probabilities), task
by task, into one row per language and piece.  Scoring runs the forward algorithm with each language's piece
probabilities; a worker keeps the values of words it has met.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches

#: Steps after which sums are scaled, so that they don't underflow however long a run is.
SCALED = 16
#: Longest piece looked up, in characters.
LONGEST = 16
#: Words a worker remembers or counts before it starts anew; this changes time, not results.
MEMORY_WORDS = 200_000
#: Letters of runs whose substrings are looked up at once, if it is more than one run.
AT_ONCE = 1 << 17
#: Expected counts are added as integers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20
SMOOTHING = 0.5
UNDETERMINED = "und"


RUNS = re.compile(r"[^\W\d_]+")


def runs(text: str | None) -> list[str]:
    """The letter runs of a text, lower-cased; marks and numbers that count as letters are left out later."""
    return RUNS.findall((text or "").lower())


def stretches(run: str) -> list[str]:
    """The run's letters with the mark of a word's start, whole; none if it has no letter."""
    letters = run if run.isalpha() else "".join(filter(str.isalpha, run))
    return ["▁" + letters] if letters else []


def all_stretches(words) -> tuple[list[str], list[int]]:
    """The stretches of all words, and the place of each one's word."""
    texts, owner = [], []
    for i, w in enumerate(words):
        for t in stretches(w):
            texts.append(t)
            owner.append(i)
    return texts, owner


class Pieces:
    """The vocabulary's pieces, found for all substrings of many stretches at once by a rolling hash."""

    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = sorted({x for x in names if len(x) <= LONGEST})
        self.size = len(names)
        #: Place of what stands for a character without a piece, and of substrings that are no piece.
        self.unknown, self.nothing = self.size, self.size + 1
        keys = np.zeros(self.size, dtype=np.uint64)
        for length in {len(x) for x in names}:
            at = [i for i, x in enumerate(names) if len(x) == length]
            keys[at] = self._hash(self._codes([names[i] for i in at]))[length - 1][:, 0]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        assert len(np.unique(keys)) == self.size

    @staticmethod
    def _codes(texts: list[str]):
        import numpy as np

        return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").reshape(len(texts), -1).astype(np.uint64)

    @staticmethod
    def _hash(codes):
        """By length - 1, the hash of each substring of that length by its start."""
        import numpy as np

        base, out = np.uint64(0x9E3779B97F4A7C15), [codes + np.uint64(1)]
        for length in range(2, min(LONGEST, codes.shape[1]) + 1):
            out.append(out[-1][:, :-1] * base + codes[:, length - 1 :] + np.uint64(1))
        return out

    def found(self, texts: list[str]):
        """By length - 1, the piece at each start of ``texts``, which are equally long."""
        import numpy as np

        out = []
        for length, hashes in enumerate(self._hash(self._codes(texts)), 1):
            at = np.minimum(np.searchsorted(self.keys, hashes), self.size - 1)
            out.append(np.where(self.keys[at] == hashes, self.ids[at], self.unknown if length == 1 else self.nothing))
        return out


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def log_sums(found, weights):
    """Logarithms of the sums over all segmentations of whole texts: (texts, columns of ``weights``)."""
    import numpy as np

    n, length = found[0].shape
    most = len(found)
    # Sums of the last prefixes, the newest first; older ones aren't needed.
    last = np.zeros((most, n, weights.shape[1]))
    last[0] = 1
    scale = np.zeros((n, weights.shape[1]))
    for end in range(1, length + 1):
        new = last[0] * weights[found[0][:, end - 1]]
        for size in range(2, min(end, most) + 1):
            new += last[size - 1] * weights[found[size - 1][:, end - size]]
        last = np.concatenate([new[None], last[:-1]])
        if end % SCALED == 0:
            scale += np.log(new)
            last /= new
    return scale + np.log(last[0])


def prefix_sums(found, weight):
    """(sums, logarithms of their scales) over the segmentations of each prefix: (texts, length + 1), for one column of weights."""
    import numpy as np

    n, length = found[0].shape
    sums, scales = np.zeros((n, length + 1)), np.zeros((n, length + 1))
    sums[:, 0] = 1
    held = np.zeros(n)
    for end in range(1, length + 1):
        for size in range(1, min(end, len(found)) + 1):
            before = end - size
            sums[:, end] += sums[:, before] * np.exp(scales[:, before] - held) * weight[found[size - 1][:, before]]
        scales[:, end] = held
        if end % SCALED == 0:
            held = held + np.log(sums[:, end])
            scales[:, end], sums[:, end] = held, 1
    return sums, scales


def by_length(texts: list[str]):
    """(length, places) of texts of one length, of AT_ONCE letters at most if it is more than one, which bounds the arrays made of them."""
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(len(t), []).append(i)
    for length, at in groups.items():
        step = max(1, AT_ONCE // length)
        for begin in range(0, len(at), step):
            yield length, at[begin : begin + step]


def expected_counts(vocabulary: Pieces, texts: list[str], times):
    """Expected uses of each piece by ``texts``, each ``times`` over, from equal probabilities."""
    import numpy as np

    equal = np.full(vocabulary.size + 2, 1 / (vocabulary.size + 1))
    equal[vocabulary.nothing] = 0
    out = np.zeros(vocabulary.size + 2)
    for length, at in by_length(texts):
        found = vocabulary.found([texts[i] for i in at])
        ahead, ahead_scale = prefix_sums(found, equal)
        # Sums over suffixes are those over prefixes of the text read backwards.
        turned = [ids[:, ::-1] for ids in found]
        behind, behind_scale = (x[:, ::-1] for x in prefix_sums(turned, equal))
        whole = np.log(ahead[:, length]) + ahead_scale[:, length]
        for size, ids in enumerate(found, 1):
            scale = ahead_scale[:, : length - size + 1] + behind_scale[:, size:] - whole[:, None]
            uses = ahead[:, : length - size + 1] * behind[:, size:] * equal[ids] * np.exp(scale) * times[at][:, None]
            row, start = np.nonzero(uses)
            out += np.bincount(ids[row, start], uses[row, start], minlength=len(out))
    return out


def piece_counts(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(lang, piece, n) of training rows (lang, text), n in 1 / UNIT; at most one row per language and piece."""

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        have, seen = pieces(vocabulary), {}

        def flush():
            for lang, counter in seen.items():
                words = list(counter)
                texts, owner = all_stretches(words)
                if texts:
                    times = np.array([counter[w] for w in words], dtype=float)[owner]
                    total = np.rint(expected_counts(have, texts, times) * UNIT).astype(np.int64)
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "piece", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(runs(text))
            if sum(map(len, seen.values())) > MEMORY_WORDS:
                yield from flush()
        if seen:
            yield from flush()

    return rows.mapInArrow(run, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5.  False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, log-free piece probabilities: pieces x languages) from all rows that may be learned from.

    Their size is that of the vocabulary times the number of languages, whatever the number of documents.
    Rows with a null id, text or language teach nothing.
    """
    import numpy as np

    bound_batches(docs.sparkSession)
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = piece_counts(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), vocabulary).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    size = pieces(vocabulary).size
    total = np.zeros((size + 2, len(langs)))
    total[counts.column("piece").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy() / UNIT
    total[: size + 1] += SMOOTHING
    return langs, total / np.maximum(total.sum(axis=0), 1e-300)


def identify(docs: DataFrame, model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` but those of these names, with held_out, lang_pred and score.

    lang_pred: the language under which the text is likeliest, each being as likely beforehand; equal ones: the
    first by name.  score: its probability given the text.  ``und`` with score 0 if the text is null or has no
    letters, or if nothing was learned.  Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    place = kept.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        langs, weights = shared.value
        have, known = pieces(vocabulary), {}
        values = np.zeros((0, len(langs) + 1))

        def learn(words):
            """Each language's logarithm of the words' probability, and how many stretches they have."""
            nonlocal values
            texts, owner = all_stretches(words)
            rows = np.zeros((len(words), len(langs) + 1))
            owner = np.array(owner, dtype=np.int64)
            for length, at in by_length(texts):
                whole = log_sums(have.found([texts[i] for i in at]), weights)
                np.add.at(rows, owner[at], np.c_[whole, np.ones(len(at))])
            known.update(zip(words, range(len(values), len(values) + len(words)), strict=True))
            values = np.concatenate([values, rows])

        def score(at):
            total = values[at].sum(axis=0) if at else np.zeros(len(langs) + 1)
            if not langs or not total[-1]:
                return UNDETERMINED, 0.0
            best = int(np.argmax(total[:-1]))
            return langs[best], float(1 / np.exp(total[:-1] - total[best]).sum())

        for batch in batches:
            # The new words of a batch are learned together, which is far quicker than text by text.
            split = [runs(t) for t in batch.column(place).to_pylist()]
            if len(known) > MEMORY_WORDS:
                known, values = {}, values[:0]
            if fresh := {w for words in split for w in words if w not in known}:
                learn(sorted(fresh))
            judged = [score([known[w] for w in words]) for words in split]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], batch.column(len(kept)), pa.array([x for x, _ in judged], type=pa.string()), pa.array([s for _, s in judged], type=pa.float64())],
                names=[*kept, "held_out", "lang_pred", "score"],
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, held_out(id_col).alias("held_out")).mapInArrow(run, f"{fields}, held_out boolean, lang_pred string, score double")
