"""Personal data by candidate gradient boosting.

Generators propose spans with high recall; they may overlap. Four base kinds (email, ip, card,
phone) are decided by their format and stay. Candidates of the other kinds are described by format
and context features and scored by boosted trees; a span is selected if its calibrated
probability reaches the threshold of its kind, the more probable first where spans overlap. Base
spans rule out a candidate only if they cover all of it; else both stay. The trees are trained here, on a bounded table of labelled
examples made from a seed (``examples``), in which addresses of pages, paths, file names, times, digests, UUIDs and plain
numbers stand beside the spans that look like them. Thresholds are set on a part of it that the trees have not seen, so
that the wanted precision holds where false candidates are ten times as frequent as there.

Edge cases: a null or empty text has no spans; spans are in code points, end exclusive; every
generator reads a text of any length in linear time; repeated rows get a row each; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.llm import common

BASE_KINDS = ["email", "ip", "card", "phone"]
MORE_KINDS = ["secret", "national_phone", "national_id", "iban", "masked_email", "ipv6", "passport", "birth_date"]
KINDS = BASE_KINDS + MORE_KINDS

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{12,}={0,2}"),
    "national_phone": re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ ./-])[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "masked_email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{2,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z]{2,24})+(?![A-Za-z])"
    ),
    "ipv6": re.compile(
        r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"
    ),
    "passport": re.compile(r"(?<![A-Za-z0-9_/.-])[A-Z]{0,2}[0-9]{6,9}(?![A-Za-z0-9_/.-])"),
    "birth_date": re.compile(
        r"(?<![0-9A-Za-z/.:-])(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?![0-9A-Za-z/:-])"
    ),
}
#: A value that follows a word for a secret, whatever it looks like; the span is the group.
NAMED_SECRET = re.compile(r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key)[\x20\t]{0,4}(?:[:=]|\bis\b)[\x20\t]{0,4}[\"']?([^\s\"',;]{6,128})")
SECRET_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "api")
ROUGH = {"passport": re.compile(r"[0-9]{6,}"), "birth_date": re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")}
#: Fixed heads of keys of well-known services.
HEADS = ("AKIA", "ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "glpat-", "AIza", "eyJ")
SECRET_LEAD = re.compile(r"(?:key|token|secret|password|passwd|passphrase|pwd|auth|bearer|credentials?)[\"']?\s*(?:[:=]|\bis\b)?\s*[\"']?$")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:$|[T_-])|[0-9]{8}T")
SUFFIX = re.compile(r"\.[A-Za-z]{1,5}[0-9]?$")
PART = re.compile(r"[^/._+=-]+")
WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}|[a-z]{1,12}[0-9]{1,2}|v[0-9]+")
MASKS = ("(at)", "[at]", " dot ", "(dot)", "[dot]")
CUES = {
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "reach"),
    "identity": ("ssn", "social", "passport", "identity", "taxpayer"),
    "account": ("iban", "account", "bank", "transfer"),
    "mail": ("mail", "write", "contact", "reach"),
    "passport": ("passport", "travel"),
    "birth": ("born", "birth", "dob", "birthday"),
    "digest": ("commit", "revision", "sha", "md", "checksum", "digest", "hash", "uuid", "guid", "trace", "request", "blob", "id", "etag"),
    "other": ("version", "order", "ref", "invoice", "part", "isbn", "commit", "sha", "page", "item", "build", "serial", "sku"),
}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern; each ``@`` is looked at once, so long runs cost no retries."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor:  # the run before the sign, in bounded steps
            step = text[max(floor, start - 256) : start]
            rest = step.rstrip(LOCAL)
            start -= len(step) - len(rest)
            if rest:
                break
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of the other kinds."""
    out = []
    if re.search("[0-9]", text):
        for kind, rough in ROUGH.items():
            # the plain pattern finds places quickly, the full one looks at what stands around them
            for m in rough.finditer(text):
                start = m.start()
                if kind == "passport":
                    start -= len(text[max(0, start - 2) : start]) - len(text[max(0, start - 2) : start].rstrip(UPPER))
                if full := GENERATORS[kind].match(text, start):
                    out.append((kind, *full.span()))
        for kind in ("secret", "national_phone", "national_id", "iban"):
            for m in GENERATORS[kind].finditer(text):
                if kind != "secret" or re.search("[0-9]", m[0]):
                    out.append((kind, *m.span()))
    if ":" in text:
        out += [("ipv6", *m.span()) for m in GENERATORS["ipv6"].finditer(text) if len(m[0]) > 4]
    low = text.lower()
    if any(w in low for w in SECRET_WORDS):
        known = {(a, b) for k, a, b in out if k == "secret"}
        out += [("secret", *m.span(1)) for m in NAMED_SECRET.finditer(text) if m.span(1) not in known]
    if any(m in text for m in MASKS):
        out += [("masked_email", *m.span()) for m in GENERATORS["masked_email"].finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    n = len(span)
    digits, upper, lower = (sum(map(f, span)) for f in (str.isdigit, str.isupper, str.islower))
    shares = [span.count(c) / n for c in set(span)]
    entropy = -sum(p * math.log2(p) for p in shares)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    runs = max((len(x) for x in re.findall("[a-z]+", span)), default=0)
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 2]
    words = re.findall("[a-z]+", before)[-4:]
    numbers = [c for c in span if c.isdigit()]
    moved = span.replace(" ", "")
    check = 0
    if kind == "iban":
        check = int("".join(str(int(c, 36)) for c in (moved[4:] + moved[:4]).upper())) % 97 == 1
    area = int("".join(numbers[:3]) or 0)
    parts = PART.findall(span)
    wordlike = sum(len(p) for p in parts if WORDLIKE.fullmatch(p)) / n
    mixed = max((len(p) for p in parts if not WORDLIKE.fullmatch(p)), default=0)
    lead = text[max(0, start - 32) : start].lower()
    return [
        MORE_KINDS.index(kind), n, digits, upper, lower, n - digits - upper - lower, entropy, turns, runs, len(set(numbers)),
        sum(c in "0123456789abcdef" for c in span) / n, span.count("-"), span.count("/") + span.count("."), span.count(" "), check,
        area in (0, 666) or area >= 900, before[-1:] in ('"', "'", "=", ":"), "=" in before[-3:] or ":" in before[-3:], after[:1].isalnum(),
        len(parts), wordlike, mixed, max(map(len, parts), default=0), bool(UUID.fullmatch(span)), bool(TIME.match(span)), bool(SUFFIX.search(span)),
        span.startswith(HEADS), span.startswith(("/", "./", "../", "www.")), lead.endswith((":", "/", "~")) and span.startswith("/"),
        bool(SECRET_LEAD.search(lead)), "::" in span, sum(map(str.isalpha, span[:2])), span.count(":"),
        span.startswith("("), "(" in span or "[" in span, " dot " in span, span[:4].isupper(),
        *(any(w.startswith(c) for w in words for c in cues) for cues in CUES.values()),
    ]


class Trees:
    """Gradient boosted regression trees for the logistic loss, in arrays."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, least: float = 2.0, bins: int = 24):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = y.mean()
        self.start = math.log(rate / (1 - rate))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts)
            self.trees.append(tree)
            score += self._leaf(tree, x)
        return self

    def _grow(self, x, g, h, cuts):
        """A full tree: split features and cuts by level order, then the values of the leaves."""
        node, feature, cut = np.zeros(len(x), np.int64), [], []
        for level in range(self.depth):
            for n in range(1 << level):
                rows = node == n
                f, c = self._split(x[rows], g[rows], h[rows], cuts)
                feature.append(f)
                cut.append(c)
            first = (1 << level) - 1
            f, c = np.array(feature)[first + node], np.array(cut)[first + node]
            node = 2 * node + (x[np.arange(len(x)), f] > c)
        leaves = 1 << self.depth
        value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1.0)
        return np.array(feature), np.array(cut), self.rate * value

    def _split(self, x, g, h, cuts):
        best = (1e-9, 0, np.inf)
        total = g.sum() ** 2 / (h.sum() + 1)
        for f, c in enumerate(cuts):
            right = x[:, f][:, None] > c[None, :]
            gr, hr = g @ right, h @ right
            gl, hl = g.sum() - gr, h.sum() - hr
            gain = np.where((hr >= 0.5) & (hl >= 0.5), gr**2 / (hr + 1) + gl**2 / (hl + 1) - total, -1)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, c[gain.argmax()])
        return best[1:]

    def _leaf(self, tree, x):
        feature, cut, value = tree
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[np.arange(len(x)), feature[at]] > cut[at])
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._leaf(t, x) for t in self.trees)


def examples(n: int = 9600, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): ``n`` labelled candidates in made-up sentences."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda pool, k: "".join(pick(pool) for _ in range(k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: chars(low, int(rng.integers(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))

    hexes = lambda k: chars(num + "abcdef", k)
    uuid = lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12))
    cap = lambda: word().capitalize()
    date = lambda sep="-": sep.join([f"20{int(rng.integers(0, 30)):02d}", f"{int(rng.integers(1, 13)):02d}", f"{int(rng.integers(1, 29)):02d}"])
    named = ["token = \"", "password=", "api_key: ", "secret: ", "Bearer ", "apikey=", "auth token ", "access_key = ", "client_secret=\"", "the password is "]

    def secret(good):
        if good:
            return pick([
                lambda: (pick(named), hexes(pick([16, 24, 32, 40, 64]))), lambda: (pick(named), uuid()),
                lambda: (pick([*named, words(3) + " "]), "AKIA" + chars(up + num, 16)),
                lambda: (pick([*named, words(3) + " "]), pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + chars(low + up + num, int(rng.integers(20, 41)))),
                lambda: (pick([*named, words(3) + " "]), "eyJ" + chars(low + up + num, 17) + "." + chars(low + up + num, 30) + "." + chars(low + up + num + "_-", 43)),
                lambda: (pick([*named, words(3) + " "]), chars(low + up + num + "/+", int(rng.integers(24, 45)))),
                lambda: (pick(["password: ", "password=", "pwd=", "passphrase: ", "passwd: "]), pick([word() + pick("!#$%&*?") + cap(), cap() + word() + pick("!#$%&*?"), word() + cap() + chars(num, 2)])
                         + chars(low, 4)),
            ])()
        file = lambda: word() + pick(["_", "-", ""]) + word() + pick(["", chars(num, 2)]) + pick([".html", ".py", ".tar.gz", ".json", ".md", ".csv", ".h5"])
        site = lambda: pick(["www.", "docs.", "blog.", ""]) + word() + pick([".org", ".com", ".net", ".example.org"])
        slug = lambda: "-".join(word() for _ in range(int(rng.integers(2, 6))))
        return pick([
            lambda: (words(3) + " ", word() + "-" + word() + "-" + word() + "-" + chars(num, 4)),
            lambda: (pick(["build ", "tag ", words(2) + " "]), word() + "_" + word() + "_v" + chars(num, 2)),
            lambda: (words(2) + " ", word() + "/" + word() + "/" + file()),
            lambda: (pick(["https:", "http:", "see https:", "from http:"]), "//" + site() + "/" + pick([word() + "/", ""]) + pick(["20" + chars(num, 2) + "/", "v" + pick(num) + "/", ""]) + pick([slug(), file(), chars(num, 6)])),
            lambda: (words(2) + " ", "www." + word() + ".org/" + word() + "/20" + chars(num, 2) + "/0" + pick("123456789") + "/" + slug()),
            lambda: (pick(["at ", "in ", words(2) + " ", "File \""]), pick(["/usr/local/", "/home/", "/var/", "./", "../"]) + word() + "/" + pick(["python3.1" + pick(num), "node" + chars(num, 2), word()]) + "/" + pick([slug(), file()])),
            lambda: (pick(["on ", "at ", words(2) + " ", "[", ""]), date() + pick(["T", "_"]) + chars(num, 2)),
            lambda: (pick(["on ", "at ", words(2) + " "]), "20" + chars(num, 6) + "T" + chars(num, 6)),
            lambda: (pick(["commit ", "revision ", "sha ", "at commit ", "checksum ", "md5: ", "sha256:", "blob ", "digest: "]), hexes(pick([16, 32, 40, 64]))),
            lambda: (pick(["uuid ", "request ", "id ", "trace_id=", "id: ", words(3) + " "]), uuid()),
            lambda: (pick(["item ", "order ", words(2) + " "]), chars(num, int(rng.integers(12, 20)))),
            lambda: (words(2) + " ", word() + word() + word() + chars(num, 1)),
            lambda: (words(2) + " ", word() + "-" + pick(num) + "." + chars(num, 2) + "." + pick(num) + "-cp3" + pick(num) + "-" + word()),
            lambda: (words(2) + " ", cap() + cap() + cap() + chars(num, 2) + pick(["", "." + word() + cap()])),
            lambda: (words(2) + " ", up[int(rng.integers(26))] + chars(up, 3) + "_" + chars(up, 5) + "_" + chars(num, 3)),
            lambda: (pick(["the password is ", "the token is ", "the secret is ", "a password is "]), pick(["required", "expired", "invalid", "missing", "stored", word() + "ed"])),
            lambda: (pick(["password: ", "token: ", "secret: "]), pick(["string", "required", "optional", "please", "<hidden>", "********"])),
        ])()

    def phone(good):
        a, b, c = pick("23456789") + chars(num, 2), chars(num, 3), chars(num, 4)
        if good:
            return pick(["call ", "Tel: ", "phone ", "mobile: ", words(3) + " "]), pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
        return pick([
            lambda: ("order ", f"{a}-{b}-{c}"), lambda: ("part ", f"{chars(num, 2)}.{b}.{c[:3]}"),
            lambda: (words(2) + " ", f"{chars(num, 2)}/{b}{c[:3]}"), lambda: ("version ", f"{chars(num, 2)}.{b}.{c[:3]}"),
            lambda: (pick(["pages ", "years ", "between ", "lines "]), f"{chars(num, 3)} {b} {c}"), lambda: (words(2) + " ", f"{chars(num, 2)} {b} {chars(num, 3)}"),
        ])()

    def identity(good):
        a = f"{int(rng.integers(1, 900)):03d}" if good else pick(["000", "666", f"{int(rng.integers(900, 1000))}", f"{int(rng.integers(1, 900)):03d}"])
        lead = pick(["SSN ", "social security ", words(3) + " "]) if good else ("part " if a not in ("000", "666") and a < "900" else words(2) + " ")
        return lead, f"{a}-{chars(num, 2)}-{chars(num, 4)}"

    def iban(good):
        country, body = pick(["DE", "FR", "ES", "GB", "NL"]), chars(num, int(rng.integers(14, 19)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        if not good:
            check = (check + int(rng.integers(1, 90))) % 97 + 2
        whole = f"{country}{check:02d}{body}"
        return pick(["IBAN ", "account ", words(2) + " "]), pick([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    def masked(good):
        user, site, top = word() + pick(["", "." + word()]), word(), pick(["com", "org", "net", "example"])
        if good:
            return pick(["write to ", words(2) + " "]), pick([f"{user} at {site} dot {top}", f"{user} (at) {site} (dot) {top}", f"{user}[at]{site}.{top}"])
        return words(1) + " ", pick([f"{word()} at {word()}. {word()}", f"{word()} at {word()} . {word()}"])

    def ipv6(good):
        group = lambda: hexes(int(rng.integers(2, 5)))
        if good:
            short = pick(["2001:db8", "fe80", "2a02:" + group(), "fd" + hexes(2) + ":" + group()]) + "::" + pick([group(), pick(num), group() + ":" + group()])
            return pick([words(2) + " ", "host ", "from "]), pick([":".join(group() for _ in range(8)), short])
        return pick(["at ", "time ", words(2) + " "]), pick([":".join(chars(num, 2) for _ in range(4)), ":".join(hexes(2) for _ in range(6)), "a::" + pick(["b", "c", "d"]), "add::" + pick(["bad", "dad"])])

    def passport(good):
        if good:
            return pick(["passport ", "passport number ", "Passport No: ", "passport no. ", "travel document "]), pick([chars(up, 1) + chars(num, 8), chars(up, 2) + chars(num, 7), chars(num, 9)])
        return pick(["order ", "invoice ", "part ", "page ", "item ", "build ", "sum ", words(3) + " "]), pick([chars(up, 1) + chars(num, 8), chars(up, 2) + chars(num, 6), chars(num, int(rng.integers(6, 10)))])

    def birth(good):
        day = pick([date, lambda: date("/"), lambda: ".".join(reversed(date(".").split("."))), lambda: "/".join(reversed(date("/").split("/"))), lambda: "19" + date()[2:]])()
        return pick(["born ", "born on ", "date of birth: ", "DOB ", "dob: ", "birthday "]) if good else pick(["on ", "updated ", "version ", "date: ", "since ", words(3) + " "]), day

    makers = dict(zip(MORE_KINDS, (secret, phone, identity, iban, masked, ipv6, passport, birth), strict=True))
    out = []
    while len(out) < n:
        # every other candidate is a possible secret: it has the most forms
        kind, good = MORE_KINDS[len(out) // 2 % len(MORE_KINDS)] if len(out) % 2 else "secret", int(rng.random() < 0.5)
        lead, span = makers[kind](good)
        text = words(2) + " " + lead + span + pick([" ", ". ", ", ", '" ']) + words(2)
        start = text.index(lead + span) + len(lead)
        out.append((text, kind, start, start + len(span), good))
    return out


class Detector:
    """Trees, the calibration of their scores, and a threshold for each kind."""

    def __init__(self, n: int = 9600, seed: int = 11, precision: float = 0.97, odds: float = 10.0):
        rows = examples(n, seed)
        x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], np.float64)
        y = np.array([r[-1] for r in rows], np.float64)
        fit = np.arange(n) // (2 * len(MORE_KINDS)) % 3 != 2
        self.trees = Trees().fit(x[fit], y[fit])
        score, truth = self.trees.predict(x[~fit]), y[~fit]
        self.slope, self.shift = self._platt(score, truth)
        p = self.probability(x[~fit])
        kind = x[~fit][:, 0].astype(int)
        self.thresholds = np.array([self._threshold(p[kind == k], truth[kind == k], precision, odds) for k in range(len(MORE_KINDS))])

    @staticmethod
    def _platt(score, truth) -> tuple[float, float]:
        slope, shift = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -30, 30)))
            slope -= 0.05 * float(((p - truth) * score).mean())
            shift -= 0.05 * float((p - truth).mean())
        return slope, shift

    @staticmethod
    def _threshold(p, truth, precision, odds) -> float:
        """The lowest threshold from which on the wanted precision holds where a true span meets ``odds`` false candidates.

        It is put halfway to the next lower false candidate, and not below 0.3.
        """
        for t in np.sort(np.unique(p[truth == 1])):
            chosen = p >= t
            hits, misses = truth[chosen].sum(), (1 - truth[chosen]).sum()
            if hits >= precision * (hits + odds * misses):
                below = p[(truth == 0) & (p < t)]
                return max(0.3, float(t + (below.max() if len(below) else t)) / 2)
        return 0.99

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.predict(x) + self.shift, -30, 30)))

    def more_spans(self, texts: list[str], base: list[list[tuple]]) -> list[list[tuple]]:
        """Selected spans of the learned kinds, for many texts at once."""
        found = [[c for c in candidates(t) if not any(s <= c[1] and c[2] <= e for _, s, e in b)] for t, b in zip(texts, base, strict=True)]
        rows = [features(t, *c) for t, cs in zip(texts, found, strict=True) for c in cs]
        if not rows:
            return [[] for _ in texts]
        p = self.probability(np.array(rows, np.float64)).tolist()
        out, at = [], 0
        for cs in found:
            own = sorted(zip(p[at : at + len(cs)], cs, strict=True), key=lambda r: (-r[0], _order(r[1])))
            at += len(cs)
            chosen: list[tuple] = []
            for q, c in own:
                if q >= self.thresholds[MORE_KINDS.index(c[0])] and not any(c[1] < e and s < c[2] for _, s, e in chosen):
                    chosen.append(c)
            out.append(chosen)
        return out


@lru_cache(maxsize=1)
def detector() -> Detector:
    return Detector()


def _listed(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(batches: Iterator[pa.RecordBatch], model: Detector) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        texts = common.texts(batch, "text")
        base = [base_spans(t) for t in texts]
        more = model.more_spans(texts, base)
        every = [sorted(b + m, key=_order) for b, m in zip(base, more, strict=True)]
        counts = [[sum(s[0] == k for s in b) for b in base] for k in BASE_KINDS]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]), pa.array([_listed(s) for s in every]),
             pa.array([len(m) for m in more], pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_learned"],
        )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned), one row per input row."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key, model = docs.schema["doc_id"].dataType.simpleString(), detector()
    return docs.mapInArrow(
        lambda b: _found(b, model),
        f"doc_id {key}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_learned long",
    )


def redact_text(text: str, spans: list[tuple]) -> str:
    """Put ``[KIND]`` for each span; of overlapping spans the joint stretch is named after the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redacted(batches: Iterator[pa.RecordBatch], model: Detector, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, text_col):
        texts = common.texts(batch, text_col)
        base = [base_spans(t) for t in texts]
        clean = [redact_text(t, sorted(b + m, key=_order)) for t, b, m in zip(texts, base, model.more_spans(texts, base), strict=True)]
        missing = batch.column(text_col).is_null().to_pylist()
        at = batch.schema.get_field_index(text_col)
        yield batch.set_column(at, batch.schema.field(at), pa.array([None if m else c for m, c in zip(missing, clean, strict=True)], batch.schema.field(at).type))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their own columns, spans put out of the text."""
    common.ship(docs.sparkSession)
    model = detector()
    return docs.mapInArrow(lambda b: _redacted(b, model, text_col), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find(common.documents(spark, sf_dir))
