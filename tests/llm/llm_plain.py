"""Plain versions of the operators, and documents with every edge case."""

import hashlib
import re
import zlib

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *(T.StructField(c, T.StringType()) for c in ("words", "code", "host", "text_key", "rid", "key", "block", "kept", "toxic", "_id")),
])
A = "the quick brown fox jumps over the lazy dog and runs far away into the dark woods at night"
B = "an entirely different sentence that shares nothing of note with any of the other ones here"
EDGE = [
    (1, A), (2, A), (2, A), (3, A + " again"), (4, ""), (5, None), (None, A), (None, None), (6, " \n\t "), (7, "one"), (8, "one two"),
    (9, B + "\n" + B), (10, "x" * 50_000), (11, (A + " ") * 400), (12, "a.b@c.d mail me at +1 (706) 555-6754, 10.0.0.1 or 4111 1111 1111 1111"),
    (13, "İ Ünïcode　words and spaces <|endoftext|> ▁▁ 😀  end "), (14, B), (15, "ONE"), (16, "\x1c\x85 one\x0b\x0ctwo"),
    (17, "1" * 3000 + "@" + "a." * 2000 + "+" * 500), (18, "one two three four five six seven eight nine ten " * 3),
]


def edge_docs(spark, rows=EDGE):
    full = [(d, t, "en", None if d is None else f"src{d % 2}", None if t is None else len(t), *["x"] * 10) for d, t in rows]
    return spark.createDataFrame(full, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def shingles(text, width):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width=4, percent=80):
    """Per row (doc_id, size, component) by comparing all pairs of different sets."""
    sets = [frozenset(shingles(t, width)) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(distinct):
        seen = {}
        for x in s:
            for j in where.get(x, ()):
                seen[j] = seen.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(distinct[j]) - both):
                root[find(i)] = find(j)
    place, least = {s: i for i, s in enumerate(distinct)}, {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            r = find(place[s])
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(find(place[s])) if s else d) for (d, _), s in zip(rows, sets, strict=True)]


def spans(text):
    """Base spans by the plain patterns."""
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def leaks(rows, items, width=10):
    """Per row (doc_id, n_words, n_hit, items as text)."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) if not isinstance(x, list) else (True, str(x)) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
