r"""Personal data: base patterns, and a semi-Markov conditional random field on top.

Base spans, leftmost and non-overlapping per kind, failing ones dropped:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)      parts at most 255
    card   [0-9]([\x20-]?[0-9])+                     12 to 19 digits that pass Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                9 to 15 digits

Each is written so that long unbroken texts take linear time and match alike.

The field scores whole candidate segments - shape, digits, checksum, parts,
what stands before - for each type, and dynamic programming picks boundaries
and types at once: best(j) is the larger of best(j - 1) (token j is ordinary)
and, over segments of at most ``LONGEST`` tokens that end at j and over types,
best(start) + score. Weights come from maximum likelihood on generated lines.
No segment begins or ends inside a run of letters and digits, and only runs of
characters around a digit, an @ or a spelled-out (at) can hold one, so the work
is linear in the text. Types: those above and ``ssn`` and
``iban``; field spans within a base span, or overlapping one of its type, are
not said twice.

Defined results: a null or empty text has no spans; repeated rows and ties give
their rows each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, texts

TYPES = ("email", "ip", "card", "phone", "ssn", "iban")
KINDS = ("email", "ip", "card", "phone", *(f"crf_{t}" for t in TYPES))
LONGEST, MOST_CHARS = 24, 64
#: Tokens for which candidates are made at a time.
STRETCH = 512
TRAINING_LINES, EPOCHS, SEED = 400, 25, 11

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out, at = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > at and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                at = m.end()
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() > 11:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# candidates

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\d")
SEED_AT = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
SPACE = re.compile(r"\s")
STEMS = ("mail", "contact", "tel", "phone", "fon", "call", "mobile", "fax", "card", "visa", "karte", "carte", "ssn", "social", "iban", "konto", "account", "ip", "host", "addr", "server", "order", "invoice", "isbn", "version", "date", "id", "no", "ref", "total", "price")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space around each seed, joined where a single space stands between two."""
    start = end = -1
    for m in SEED_AT.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        floor = max(end, 0)
        while a > floor and not text[a - 1].isspace():
            a -= 1
        stop = SPACE.search(text, m.end())
        b = stop.start() if stop else len(text)
        if end >= 0 and a - end == 1 and text[end] == " " and a > end:
            end = b
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def _shape(s: str) -> str:
    s = re.sub(r"[0-9]+", "9", s)
    return re.sub(r"[^\W\d_]+", "a", s)[:24]


def features(s: str, before: str, after: str) -> list[str]:
    """Of a whole segment: one value for each template."""
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    runs = re.findall(r"[0-9]+", s)
    shape = _shape(s)
    at = "@" if s.count("@") == 1 else "(at)" if re.search(r"[(\[]at[)\]]", s, re.I) else "@@" if "@" in s else ""
    dotted = len(runs) == 4 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s) is not None
    check = "luhn" if 12 <= n <= 19 and luhn(digits) else "no"
    letters = sum(c.isalpha() for c in s)
    stem = next((x for x in STEMS if before.lower().startswith(x)), "")
    return [
        "bias",
        f"shape={shape}",
        f"first={s[0] if not s[0].isalnum() else 'd' if s[0].isdigit() else 'a'}",
        f"digits={min(n, 20)}/{letters > 0}",
        f"runs={'-'.join(str(min(len(r), 9)) for r in runs[:6])}/{letters > 0}",
        f"at={at}/{'.' in s.partition('@')[2]}/{' ' in s}",
        f"dotted={dotted}/{dotted and all(map(_small, runs))}",
        f"check={check}/{letters > 0}/{'.' in s}",
        f"plus={s[0] == '+'}/{9 <= n <= 15}/{letters > 0}",
        f"stem={stem}",
        f"stem-digits={stem}/{n}/{letters > 0}",
        f"cut={len(after) == 2 and after[1].isalnum() and after[0] in '.-@/:'}/{before[-1:] in '.-@/:' and len(before) > 1}",
        f"joined={before[-1:] in '/-_.@=#$' and before != ''}/{after[:1] in ('/', '-', '_', '@', '%') and after != ''}",
        f"iban={bool(re.fullmatch(r'[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?', s))}",
    ]



def tokens(text: str, a: int, b: int) -> tuple[array, array, bytearray]:
    """Starts, ends and seeds of an island's tokens, some twenty bytes each."""
    starts, ends, seeds = array("q"), array("q"), bytearray()
    for m in TOKEN.finditer(text, a, b):
        starts.append(m.start())
        ends.append(m.end())
        seeds.append(SEED_AT.search(text, m.start(), m.end()) is not None or m[0].lower() == "at")
    return starts, ends, seeds


def lead_of(text: str, a: int) -> str:
    before = re.search(r"([^\s]+)\s?$", text[max(0, a - 40) : a])
    return before[1].strip(":.,#") if before else ""


def starting(text: str, a: int, b: int, starts: array, ends: array, seeds: bytearray, lead: str, i: int) -> Iterator[tuple[int, int, str, str]]:
    """Candidate segments that start with token i: first and last token, text before and after."""
    x = starts[i]
    c = text[x]
    if not (c.isalnum() or c in "+(") or (x > a and c.isalnum() and text[x - 1].isalnum()):
        return  # no start, or inside a run of letters and digits
    k = x
    while k > max(a, x - 24) and not text[k - 1].isspace():
        k -= 1
    before, held = text[k:x] or lead, 0
    for j in range(i, min(i + LONGEST, len(starts))):
        held |= seeds[j]
        y = ends[j]
        if y - x > MOST_CHARS:
            break
        if held and text[y - 1].isalnum() and not (y < b and text[y].isalnum()):
            yield i, j, before, text[y : min(y + 2, b)]


def segments(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, str]]]:
    """An island's tokens, and all its candidate segments, for training on short lines."""
    starts, ends, seeds = tokens(text, a, b)
    lead = lead_of(text, a)
    return list(zip(starts, ends)), [s for i in range(len(starts)) for s in starting(text, a, b, starts, ends, seeds, lead, i)]


def _generated(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines and their entities (start, type, end)."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(r.choice(["an", "the", "ti", "or", "is", "en", "ou", "re", "st", "da", "lo", "que", "mi", "ch"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        d = r.choice("3456") + dig(r.randint(11, 17))
        d += next(c for c in "0123456789" if luhn(d + c))
        if len(d) == 16 and r.random() < 0.5:
            d = r.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4))
        return d

    made = [
        lambda: f"{word()}{r.choice(['.', '_', '', '-'])}{r.choice([word(), dig(2)])}@{r.choice([word(), 'mail' + dig(1)])}.{r.choice(['example.com', 'org', 'co.uk'])}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        card,
        lambda: r.choice(["+1 ({0}) {1}-{2}", "+{3} {0} {1} {2}", "+{3}-{0}-{1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "+{3}{0}{1}{2}"]).format(dig(3), dig(3), dig(4), r.randint(1, 99)),
        lambda: f"{dig(3)}-{dig(2)}-{dig(4)}",
        lambda: (lambda s: s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4)))(r.choice(["DE", "FR", "GB", "ES"]) + dig(r.choice([18, 20, 22]))),
    ]
    spelled = lambda: f"{word()} {r.choice(['(at)', '[at]'])} {word()}.{r.choice(['com', 'org'])}" if r.random() < 0.5 else f"{word()}{r.choice(['(at)', '[at]'])}{word()}.com"
    harmless = [
        lambda: dig(r.randint(1, 11)),
        lambda: "1" + dig(r.randint(11, 24)),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
        lambda: f"{dig(2)}:{dig(2)}:{dig(2)}",
        lambda: f"{r.randint(0, 999)}.{dig(2)}",
        lambda: f"v{dig(1)}.{dig(1)}.{dig(2)}",
        lambda: f"{dig(1)}.{dig(1)}.{dig(1)}.{r.randint(256, 999)}",
        lambda: f"{word()}{dig(3)}",
        lambda: f"{dig(2)}-{dig(2)}",
        lambda: f"{dig(3)},{dig(3)},{dig(3)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 24, 40]))),
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}",
        lambda: f"{word()}@{word()}",
        lambda: f"({dig(4)})",
        lambda: f"{dig(2)} {dig(3)} {dig(1)}",
        lambda: f"https://{word()}.com/{dig(4)}",
        lambda: f"(c) {r.randint(1990, 2025)} {word()}",
    ]
    lines = []
    for _ in range(n):
        text, found = "", []

        def put(s: str, kind: int = -1) -> None:
            nonlocal text
            text += " " if text and r.random() < 0.97 or kind >= 0 and text else ""
            if kind >= 0:
                found.append((len(text), kind, len(text) + len(s)))
            text += s

        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 3)):
                put(word())
            roll = r.random()
            if roll < 0.5:
                k = r.randrange(len(made))
                if k in (4, 5) or r.random() < 0.25:
                    stem = ["email", "ip", "card", "tel", "ssn", "iban"][k]
                    put(stem + r.choice([":", "", " no"]))
                s = made[k]()
                if k == 0 and r.random() < 0.3:
                    s = spelled()
                if k == 3 and s[0] != "+" and r.random() < 0.8:
                    put("phone:")
                put(" ".join(s.split()), k)
            else:
                put(r.choice(harmless)())
                if r.random() < 0.3:
                    put(r.choice(harmless)())
            if r.random() < 0.4:
                text += r.choice(".,;")
        put(word())
        lines.append((text, found))
    return lines


def _lse(v: list[float]) -> float:
    m = max(v)
    return m + float(np.log(sum(np.exp(x - m) for x in v)))


@functools.lru_cache(2)
def train(lines: int = TRAINING_LINES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, list[float]]:
    """Weights of each feature for each type, by AdaGrad on the conditional likelihood of whole segmentations."""
    names: dict[str, int] = {}
    data = []
    for text, found in _generated(lines, seed):
        for a, b in islands(text):
            toks, segs = segments(text, a, b)
            if not segs:
                continue
            x = np.array([[names.setdefault(f, len(names)) for f in features(text[toks[i][0] : toks[j][1]], p, q)] for i, j, p, q in segs])
            gold = {(s, e): k for s, k, e in found}
            y = np.full(len(segs), -1)
            for s, (i, j, _, _) in enumerate(segs):
                y[s] = gold.get((toks[i][0], toks[j][1]), -1)
            ends: list[list[int]] = [[] for _ in toks]
            for s, (_, j, _, _) in enumerate(segs):
                ends[j].append(s)
            data.append((len(toks), np.array([s[0] for s in segs]), np.array([s[1] for s in segs]), ends, x, y))
    w = np.zeros((len(names), len(TYPES)))
    g2 = np.full_like(w, 1e-6)
    for _ in range(epochs):
        grad = -0.05 * w
        for n, first, last, ends, x, y in data:
            score = w[x].sum(1)
            top = score.max(1)
            whole = top + np.log(np.exp(score - top[:, None]).sum(1))  # over types
            f = np.zeros(n + 1)
            for j in range(n):
                s = ends[j]
                if s:
                    v = np.append(f[first[s]] + whole[s], f[j])
                    m = v.max()
                    f[j + 1] = m + np.log(np.exp(v - m).sum())
                else:
                    f[j + 1] = f[j]
            b = np.zeros(n + 1)
            parts: list[list[float]] = [[] for _ in range(n + 1)]
            for j in range(n - 1, -1, -1):
                # parts[i] gathers what starts at i
                for s in ends[j]:
                    parts[first[s]].append(whole[s] + b[j + 1])
                if parts[j]:
                    v = np.array([b[j + 1], *parts[j]])
                    m = v.max()
                    b[j] = m + np.log(np.exp(v - m).sum())
                else:
                    b[j] = b[j + 1]
            p = np.exp(f[first] + b[last + 1] - f[n])[:, None] * np.exp(score)
            d = -p
            gold_at = np.flatnonzero(y >= 0)
            d[gold_at, y[gold_at]] += 1
            for c in range(x.shape[1]):
                np.add.at(grad, x[:, c], d)
        g2 += grad * grad
        w += 0.4 * grad / np.sqrt(g2)
    return {n: w[k].tolist() for n, k in names.items()}


def field_spans(text: str, model: dict[str, list[float]]) -> list[tuple[int, int, int]]:
    """(start, type, end) of the best segmentation.

    An island of any length is walked in stretches of STRETCH tokens: candidates
    and their features are made for one stretch at a time, the last LONGEST
    places of the dynamic program are held, and of each token only where the
    best segment that ends there starts.
    """
    out = []
    none = [0.0] * len(TYPES)
    for a, b in islands(text):
        starts, ends, seeds = tokens(text, a, b)
        lead, n = lead_of(text, a), len(starts)
        back, kinds = array("q", [-1]) * (n + 1), bytearray(n + 1)
        ring: list[tuple[float, int, int]] = [NOTHING] * (LONGEST + 1)  # by place: score, first token, type
        best = 0.0
        for low in range(0, n, STRETCH):
            some = [s for i in range(low, min(low + STRETCH, n)) for s in starting(text, a, b, starts, ends, seeds, lead, i)]
            if some:
                each = [(text[starts[i] : ends[j]], p, q) for i, j, p, q in some]
                place: dict[tuple, int] = {}  # equal segments, as in long runs of one pattern, are scored once
                which = [place.setdefault(s, len(place)) for s in each]
                score = np.array([[model.get(f, none) for f in features(*s)] for s in place]).sum(1)
                kind, worth = score.argmax(1)[which].tolist(), score.max(1)[which].tolist()
            at = 0
            for i in range(low, min(low + STRETCH, n)):
                best = _arrive(i, best, ring, back, kinds)
                while at < len(some) and some[at][0] == i:
                    slot = (some[at][1] + 1) % (LONGEST + 1)
                    if worth[at] > 0 and best + worth[at] > ring[slot][0]:
                        ring[slot] = (best + worth[at], i, kind[at])
                    at += 1
        _arrive(n, best, ring, back, kinds)
        j = n
        while j > 0:
            i = back[j]
            if i >= 0:
                out.append((starts[i], kinds[j], ends[j - 1]))
            j = i if i >= 0 else j - 1
    return sorted(out)


NOTHING = (-1.0, -1, 0)


def _arrive(place: int, best: float, ring: list, back: array, kinds: bytearray) -> float:
    """The best score up to a place: the best segment that ends there, or the token before it left outside."""
    slot = place % (LONGEST + 1)
    value, first, kind = ring[slot]
    ring[slot] = NOTHING
    if value > best:
        back[place], kinds[place] = first, kind
        return value
    return best


def find(text: str, model: dict[str, list[float]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = []
    for a, k, b in field_spans(text, model):
        if not any((s <= a and b <= e) or (t == k and s < b and a < e) for s, t, e in base):
            more.append((a, 4 + k, b))
    return base, sorted(base + more)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans for each row of docs."""
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
        for keys, some in texts(batches):
            out: list[list] = [[] for _ in names]
            for k, t in zip(keys, some):
                base, every = find(t, model)
                n = Counter(x[1] for x in every)
                digest = hashlib.sha256(said(base).encode()).hexdigest()
                row = (k, n[0], n[1], n[2], n[3], digest, said(every), len(every) - len(base))
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return keyed_texts(docs, key, text).mapInArrow(run, SCHEMA)
