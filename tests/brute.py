"""Plain Python restatements used as oracles on small inputs."""


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(s):
    return min(s, rc(s))


def kmer_set(seqs, k, c, case_sensitive=False):
    out = set()
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w.upper()) <= set("ACGT") and (w[0].isupper() or not case_sensitive):
                out.add(canon(w.upper()) if c else w.upper())
    return out


def streaming(seqs, k, c):
    seen, out = set(), []
    for s in seqs:
        s = s.upper()
        new = []
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                w = canon(w) if c else w
                if w not in seen:
                    seen.add(w)
                    new.append(i)
        fresh = set(new)
        for p, b in enumerate(s):
            if any(q in fresh for q in range(p - k + 1, p + 1)):
                out.append(b if p in fresh else b.lower())
    return "".join(out)
