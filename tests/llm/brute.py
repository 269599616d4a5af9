"""Plain restatements of the corpus operators for small fixtures."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, threshold=2):
    """Smallest id reachable from each row of ``[(id, fingerprint)]``."""
    out = []
    for i in range(len(prints)):
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in range(len(prints)):
                if b not in seen and (prints[a][1] ^ prints[b][1]).bit_count() <= threshold:
                    seen.add(b)
                    todo.append(b)
        out.append(min((prints[j][0] for j in seen if prints[j][0] is not None), default=None))
    return out


def without_repeats(texts, depth):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if count[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def winnow(text, k, span):
    """(position, gram) picks by window, rightmost of the smallest, with any order given by ``rank``."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shards(rows, count=8):
    """{(doc_id, crc, size): [(shard, slot), ...]} of ``[(doc_id, text)]``."""
    known = sorted(((d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, d) for d, t in rows)
    total, before, slots, out = sum(k[2] for k in known), 0, Counter(), []
    for _, crc, size, d in known:
        shard = min(count - 1, (2 * before + size) * count // (2 * total))
        out.append((d, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def word_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1 if words else 0)))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_classes(rows, least=0.8):
    """Smallest doc_id of the class of each (doc_id, text), all pairs compared."""
    sets = [word_shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= least:
                low[root(i)] = root(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[root(i)] = min(doc_id, best.get(root(i), doc_id))
    return [best.get(root(i)) for i in range(len(rows))]
