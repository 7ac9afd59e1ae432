import random
import re
import zlib
from collections import Counter

from barloom.llm import variants


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}

    def one(u, v):
        if u == v or abs(len(u) - len(v)) > 1:
            return False
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v)) == 1
        s, l = sorted((u, v), key=len)
        return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))

    near = {w: [v for v in n if one(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def made(seed=5):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Straße", "größe", "x" * 30, "x" * 31, "naïve", "y×y÷yy"]
    words = []
    for w in base:
        words += [w] * r.randrange(1, 40)
        for _ in range(6):
            k, i = r.random(), r.randrange(len(w))
            words += [w[:i] + w[i + 1 :] if k < 0.3 else w[:i] + "b" + w[i:] if k < 0.6 else w[:i] + "É" + w[i + 1 :]] * r.randrange(1, 9)
    r.shuffle(words)
    docs = [(i, " ".join(words[i * 40 : i * 40 + 40]).replace(" ", r.choice([" ", "-", "\n", "1", "中", "«"]))) for i in range(len(words) // 40 + 1)]
    return docs + [(None, "Thenc thenc thenc"), (7, None), (8, ""), (9, "é" * 7 + " " + "É" * 7), (9, "é" * 7 + " " + "É" * 7), (10, "long" * 30000), (11, "long" * 30000), (12, "Long" * 30000)]


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_against_brute_force(spark):
    docs = made()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    want = brute(docs)
    assert len(want) > 150 and sum(r[1] is not None for r in want) > 30 and sum(r[2] not in (r[0], r[1]) for r in want) > 0
    for bound in (variants.BOUND, 20, 2):  # one part; parts and joins of hot prefixes; joins for nearly all
        assert rows(variants.variants(df, bound)) == want


def test_acceptor_is_minimal_and_accepts():
    words = sorted({"tops", "taps", "top", "tap", "stop"})
    states, start = variants.acceptor(words)
    assert len(states) == 8  # o and a share what follows
    seen = []

    def walk(q, s):
        if states[q][0]:
            seen.append(s)
        for a, p in states[q][1]:
            walk(p, s + a)

    walk(start, "")
    assert seen == words


def test_empty_table(spark):
    assert rows(variants.variants(spark.createDataFrame([], "doc_id long, text string"))) == []
