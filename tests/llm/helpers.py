"""Small inputs and plain restatements used by several tests."""

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice(WORDS)}{rnd.randint(0, 60)}" for _ in range(n))


def docs(spark, rows, extra=True):
    """Rows (doc_id, text, lang, source) as documents; with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("n", "h", "cls", "key", "node", "w", "part", "idx", "score", "item", "epoch", "tokens", "host", "text_key", "pos", "cut"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def shingles(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(texts, percent=75):
    """Least id reachable by links, by brute force over all pairs."""
    ids, sets = [i for i, _ in texts], [shingles(t) for _, t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(groups[find(i)])) for i, d in enumerate(ids)]
