"""Plain-Python versions of the operators, and small documents with awkward cases."""

import math
import random
import re

import xxhash
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("score", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("fp", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("meta.url", T.StringType()),
        T.StructField("__gone", T.StringType()),
        T.StructField("__id", T.LongType()),
        T.StructField("__doc", T.MapType(T.StringType(), T.LongType())),
    ]
)
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w + ("." if i % 9 == 8 else "") + ("\n" if i % 27 == 26 else " "))
    return "".join(out).strip()


def rows(n: int = 60, seed: int = 3):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(3, 160)) for _ in range(n)]
    for i in range(12):  # a common line, in other case and with blanks
        texts[i] = texts[i] + "\n \tA Common LINE\x0b"
    texts[20] = texts[21] = texts[22]
    texts[23] = texts[22].replace(texts[22].split()[5], "changed", 1)
    texts[30] = ""
    texts[31] = "   \n\n \t "
    texts[32] = None
    texts[33] = "漢字 ½ É σΣ 🙂\x85 x " * 5
    texts[34] = prose(rng, 30_000)
    texts[35] = "a" * 5000
    texts[36] = "ends with a blank "
    out = [(i, t, ["en", "fr", None][i % 3], "src0" if i % 3 else None, len(t or ""), "x", i, "y", 7, f"u{i}", "g", -i, {"a": i}) for i, t in enumerate(texts)]
    out.append((5, texts[5], "en", "src0", 1, *[None] * 8))  # a repeated row
    out.append((6, "another text of the same id", *[None] * 11))
    out.append((None, texts[7], "fr", *[None] * 10))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def dedup(data, min_docs=10):
    strip = " \t\n\r\x0b\x0c"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    count = {}
    for r in data:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= min_docs)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Smallest id reachable, by union-find over all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(set(ids))
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def secrets(text):
    text = text or ""
    out = []
    for kind, p, ok in (
        ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(kind, m.start(), m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def toxicity(text, model, patterns):
    """Score of a text by a given model, each voter counted by itself."""
    tokens = re.findall(r"\w+", (text or "").lower())
    counts, kinds = [], set()
    for f in model.lexicon:
        hit = [t for t in tokens if (len(t) > len(f) - 1 and t.startswith(f[1:]) if f[0] == "^" else t == f)]
        counts.append(len(hit))
        kinds.update(hit)
    counts += [len(list(p.finditer((text or "").lower()))) for _, p in patterns]
    counts.append(len(kinds) if len(kinds) > 1 else 0)
    raw = model.bias + sum(w * math.log(1 + c) for w, c in zip(model.weights, counts) if c)
    return 1 / (1 + math.exp(-raw))


def language(text, model, dims, scale):
    """(language, probability) by a given model, n-gram by n-gram."""
    text = (text or "").lower().replace("\0", " ")
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    m = (1 << 32) - 1
    total, n = [0.0] * len(model.languages), 0
    for i in range(len(text)):
        for order in (1, 2, 3):
            if i + order > len(text):
                continue
            h = ord(text[i]) * 0x9E3779B1 & m
            for c in text[i + 1 : i + order]:
                h = ((h ^ (h >> 15)) * 0x85EBCA77 + ord(c) * 0x9E3779B1) & m
            row = model.values[((h ^ (h >> 13)) * 0xC2B2AE3D & m) >> 17]
            total = [t + float(r) for t, r in zip(total, row)]
            n += 1
    z = [(scale * t / n + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    p = [math.exp(x - max(z)) for x in z]
    best = p.index(max(p))
    return model.languages[best], p[best] / sum(p)


def walk(text, moves, symbols, classes, end, steps):
    """Symbols that a walk over the text emits at the given ascending steps, 0 past its end."""
    kinds, at, out, wanted = classes(text).tolist(), 0, {}, set(steps)
    for step in range(max(steps) + 1):
        now = kinds[at] if at < len(kinds) else end
        if step in wanted:
            out[step] = 0 if now == end else int(symbols[now])
        if now != end:
            at += int(moves[step % len(moves)][now])
    return [out[s] for s in steps]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def leaked(text, item, cover=0.7, least=0.5, answer_cover=0.8, short=6, brief=12, window=24):
    """Whether a place of the text holds the item, over all places."""
    a, b = (re.findall(r"\w+", (t or "").lower()) for t in (item, text))
    n = len(a)
    if not n:
        return False
    if n < short:
        return any(b[i : i + n] == a for i in range(len(b) - n + 1))
    answer = a[-min(n, max(3, n // 4)) :]
    for i in range(max(1, len(b))):
        place = b[i : i + n + min(n, window)]
        share = lcs(a, place) / n
        if share >= cover or n > brief and share >= least and lcs(answer, place) >= answer_cover * len(answer):
            return True
    return False
