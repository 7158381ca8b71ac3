"""Plain Python versions of operators, to compare small results with."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

from factloom.llm import langid, licenses

SPACE = re.compile("[\x20\x09-\x0d]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def groups(nodes, linked) -> dict:
    """The smallest member of each node's component; ``linked`` tells of a pair whether it links."""
    nodes = sorted(set(nodes))
    low = {n: n for n in nodes}
    changed = True
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if linked(a, b)]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def license_row(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    low = lower_ascii(text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE if tuple(words[i : i + len(phrase)]) == phrase]
    hits = []
    if any(g in low for g in licenses.GATES):
        for number, (priority, keyword, pattern, label, score) in enumerate(licenses.rules()):
            if keyword in low:
                hits += [(m.start(), -m.end(), -priority, number, label, score) for m in re.finditer(pattern, low, re.ASCII)]
    hits.sort()
    alive = [
        h
        for i, h in enumerate(hits)
        if not any(g[0] <= h[0] and -g[1] >= -h[1] and -g[2] >= -h[2] for g in hits[:i])
    ]
    labels = sorted({x for _, x in base} | {h[4] for h in alive})
    score = max([h[5] for h in alive] + [licenses.BASE_SCORE] * bool(base) + [0.0])
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), score)


def quality_row(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def binomial_tail(k: int, n: int, p: float) -> float:
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit fingerprint, bit by bit."""
    from xxhash import xxh64_intdigest

    own = words(lower_ascii(text or ""))
    shingles = [" ".join(own[i : i + size]) for i in range(len(own) - size + 1)] if len(own) >= size else [" ".join(own)] * bool(own)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def bpe_row(tokenizer, text: str | None) -> tuple:
    """n_tokens, ids_sha256, decoded_sha256 by the library alone."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), sha256(raw).hexdigest(), sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def piece_rows(tokenizer, text: str | None, capacity: int = 2048) -> list[tuple]:
    """(piece, start, length, ids_crc32) of a text and the end id 0."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    out = []
    for n, at in enumerate(range(0, len(ids), capacity)):
        part = ids[at : at + capacity]
        out.append((n, at, len(part), crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out


def backoff_rows(texts: dict, least: int, backoff: float) -> dict:
    """id -> (n_words, log_score, score)."""
    split = {k: words(lower_ascii(t or "")) for k, t in texts.items()}
    one = Counter(w for ws in split.values() for w in ws)
    two = Counter(p for ws in split.values() for p in zip(ws, ws[1:], strict=False))
    total, out = sum(one.values()), {}
    for k, ws in split.items():
        score = 0.0
        for i, w in enumerate(ws):
            pair = (ws[i - 1], w) if i else None
            if pair and two[pair] >= least:
                score += math.log(two[pair] / one[pair[0]])
            else:
                score += math.log(one[w] / total) + (math.log(backoff) if pair else 0)
        out[k] = (len(ws), score, score / len(ws) if ws else None)
    return out


def language(text: str | None, model, names: dict[str, int], unknown: int) -> tuple[str, float]:
    """The likeliest language and its probability; every segmentation is summed by recursion on prefixes."""
    langs, weights = model
    total, seen = [0.0] * len(langs), False
    for run in langid.runs(text):
        for stretch in langid.stretches(run):
            seen = True
            for k in range(len(langs)):
                # Exact rational sums, so that nothing underflows.
                sums = [Fraction(1)]
                for end in range(1, len(stretch) + 1):
                    value = Fraction(0)
                    for start in range(max(0, end - langid.LONGEST), end):
                        piece = names.get(stretch[start:end], unknown if end - start == 1 else None)
                        if piece is not None:
                            value += sums[start] * Fraction(float(weights[piece][k]))
                    sums.append(value)
                total[k] += math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
    if not seen or not langs:
        return "und", 0.0
    best = max(range(len(langs)), key=lambda k: total[k])
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def embedding_rows(vectors: list[tuple], least: float = 0.98) -> list[tuple]:
    """(vec_id, n_links, component_id) of (vec_id, embedding, label) rows with different ids."""
    import numpy as np

    unit = {}
    for key, v, label in vectors:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float) / max(abs(y) for y in v)
            unit[key] = (label, x / np.linalg.norm(x))
    linked = lambda a, b: unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and float(unit[a][1] @ unit[b][1]) >= least
    low = groups(unit, linked)
    degree = Counter()
    for a in unit:
        degree[a] = sum(linked(a, b) for b in unit if a != b)
    return sorted((key, degree[key], low.get(key, key)) for key, _, _ in vectors)


def revisit_rows(captures: list[dict], strict_types=("response", "revisit")) -> dict:
    """record_id of each revisit -> record_id of the latest earlier full response of its URL, or None."""
    by_url = defaultdict(list)
    for c in captures:
        if c["kind"] == "response" and c["status"] == 200 and c["url_key"] is not None and c["date"] is not None:
            by_url[c["url_key"]].append((c["date"], c["record_id"]))
    out = {}
    for c in captures:
        if c["kind"] == "revisit":
            before = [x for x in by_url[c["url_key"]] if c["date"] is not None and x[0] < c["date"]]
            out[c["record_id"]] = max(before)[1] if before and c["url_key"] is not None else None
    return out
