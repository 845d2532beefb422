r"""Secret scans: base patterns, and a linear-chain conditional random field on top.

Base spans, leftmost and non-overlapping per kind; a span is the whole match:

    assign  (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)
            letters of the name in either case, group 2 of 6 characters or more
    access  AKIA[A-Z0-9]+   20 characters or more
    hex     [0-9a-f]+       24 characters or more

The random field tags tokens B (a secret begins), I (inside) or O. Each token
has one feature per template: shape, length, entropy, alphabet, known prefix,
the words before and after it, and features of the whole text. Weights come
from maximum likelihood on generated lines (``TRAINING_LINES`` of them, made
from a seed: secrets of many makes, and what resembles them - dates, numbers,
addresses, identifiers, paths, hashes in prose).

Every token of a text may be B or I, and its neighbours are seen whole, however
far they are. What each token is worth beyond O is summed for all tokens at
once; where a token cannot pay for a label other than O the best path is O, and
the chain falls apart there exactly (``Field.runs``), so that Viterbi runs over
what is left and the work is linear in the text. Spans of the field that lie
within a base span are not said twice.

Defined results: a null or empty text has no spans; repeated rows and ties give
their rows each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, release, ship, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
TRAINING_LINES, EPOCHS, SEED = 700, 50, 7
#: Distinct tokens that a worker remembers.
WORDS = 150_000

TOKEN = re.compile(r"\w[\w+/.~-]*|[^\w\s]")
DIGIT = re.compile(r"[0-9]")
RISE = re.compile(r"[a-z][A-Z]")
MARK = re.compile(r"[0-9]|[a-z][A-Z]")
NAME = re.compile(r"pass(?:word|wd|phrase)?|secret|token|api_?key|apikey|key|credential|auth|bearer|pwd|private|client_secret|access", re.I)
PREFIX = re.compile(r"AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|sk_test_|pk_live_|xox[abp]-|eyJ|AIza|ya29\.|SG\.|npm_|hf_")
DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
NUMBER = re.compile(r"\d+(?:[.,]\d+)+")
UPPER = re.compile(r"[A-Z0-9]+")
WORD_NUMBER = re.compile(r"[a-z]+[0-9]{1,4}")
SUFFIX = re.compile(r"\.[a-z]{2,4}$")
LOWERS, CAPITALS, DIGITS = re.compile(r"[a-z]+"), re.compile(r"[A-Z]+"), re.compile(r"[0-9]+")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


# features


def _alphabet(t: str) -> str:
    if t.isalpha():
        return "hex" if not t.strip("abcdef") else "letters" if t.strip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") else "upper"
    if t[-1] == "." and t[:-1].isalpha():
        return "mixed"
    if t.isdigit():
        return "digits"
    if UUID.fullmatch(t):
        return "uuid"
    if DATE.fullmatch(t):
        return "date"
    if HEX.fullmatch(t):
        return "hex"
    if NUMBER.fullmatch(t):
        return "number"
    if UPPER.fullmatch(t):
        return "upper"
    if WORD_NUMBER.fullmatch(t):
        return "word-number"
    if "/" in t or ("." in t and SUFFIX.search(t)):
        return "path"
    return "mixed"


def _entropy(t: str) -> int:
    n = len(t)
    if n >= 64:
        total = sum(c * math.log2(c) for c in Counter(t).values())
    else:
        total = sum([C_LOG_C[t.count(x)] for x in dict.fromkeys(t)])
    return int(2 * (math.log2(n) - total / n))


C_LOG_C = [c * math.log2(c) if c else 0.0 for c in range(64)]


def _mixing(t: str) -> str:
    """How letters, capitals and digits alternate."""
    if t.isascii() and t.isalpha():
        if t.islower():
            return "1"
        if t[1:].islower():
            return "2"
    kinds = LOWERS.sub("a", CAPITALS.sub("A", t if t.isalpha() else DIGITS.sub("0", t)))
    return str(min(len(kinds), 9))


def _length(n: int) -> int:
    return n if n < 12 else 12 + min(n // 4, 16)


def _may_hold_name(t: str) -> bool:
    """Whether a part that every name has occurs, in any case; letters beyond ASCII may stand for others."""
    if not t.isascii():
        return True
    x = t.lower()
    return (
        "pass" in x or "key" in x or "auth" in x or "secret" in x or "token" in x or "credential" in x
        or "bearer" in x or "pwd" in x or "private" in x or "access" in x
    )


def _near(t: str) -> str:
    if not t:
        return "none"
    if len(t) <= 24 and _may_hold_name(t) and (m := NAME.search(t)):
        return "name" if len(m[0]) * 2 > len(t) else "holds-name"
    if not (t[0].isalnum() or t[0] == "_"):
        return t if t in "=:\"'@/,.()[]#<>-" else "symbol"
    return "number" if t[0].isdigit() else "word"


def text_features(text: str, candidates: int) -> str:
    return f"{min(candidates, 6)}/{min(len(text).bit_length(), 12) // 3}"


def own_kind(t: str) -> tuple[str, str, int, int, str]:
    p = PREFIX.match(t)
    return _alphabet(t), _mixing(t), _length(len(t)), _entropy(t), p[0] if p else ""


def own_features(a: str, mix: str, size: int, entropy: int, prefix: str) -> list[str]:
    """Templates that the token alone fills."""
    return [
        "bias",
        f"shape={a}",
        f"size={size}",
        f"entropy={entropy}",
        f"mix={mix}",
        f"shape-size={a}/{size // 3}",
        f"shape-mix={a}/{mix}",
        f"prefix={prefix}",
    ]


def features(before2: str, before: str, t: str, after: str, of_text: str) -> list[str]:
    """One value for each template."""
    kind = own_kind(t)
    a, b1, b2 = kind[0], _near(before), _near(before2)
    return [
        *own_features(*kind),
        f"before={b1}",
        f"before2={b2}/{b1}",
        f"before-shape={b2}/{b1}/{a}",
        f"after={_near(after)}",
        f"text={of_text}",
    ]


def may_be_secret(t: str) -> bool:
    """Whether a token counts for the text's feature; any token may be tagged."""
    if len(t) < 20 and t.isalpha():
        return False
    return DIGIT.search(t) is not None or len(t) >= 20 and len(RISE.findall(t)) > 1


# the field: labels 0 = O, 1 = B, 2 = I

ALLOWED = np.array([[0, 0, -np.inf], [0, 0, 0], [0, 0, 0]])  # from, to: I follows B or I alone


def viterbi(emission: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best labels of a run between two tokens that are O; emission: tokens x 3."""
    step = trans + ALLOWED
    v, back = step[0] + emission[0], []
    for e in emission[1:]:
        s = v[:, None] + step
        back.append(s.argmax(0))
        v = s.max(0) + e
    k = int((v + step[:, 0]).argmax())
    path = [k]
    for b in reversed(back):
        k = int(b[k])
        path.append(k)
    return path[::-1]


def _generated(n: int, seed: int) -> list[list[tuple[str, int]]]:
    """Lines as tokens with labels."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    rand = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    every = lower + upper + digits

    def word() -> str:
        w = "".join(r.choice(["an", "the", "ti", "or", "is", "en", "ou", "re", "st", "da", "lo", "que", "mi", "ch", "un"]) for _ in range(r.randint(1, 4)))
        if r.random() < 0.3:  # letters of other languages
            for _ in range(r.randint(1, 4)):
                at = r.randint(0, len(w))
                w = w[:at] + r.choice("áéíóñçèêüöäß한국어") + w[at:]
        return w.capitalize() if r.random() < 0.15 else w

    def written() -> str:
        return word() + r.choice(["", "", "", "", ".", ".", ",", "-" + word(), "_" + word(), "/" + word()])

    def phrase() -> str:
        return "-".join("".join(c for c in word() if c.isascii()) or "a" for _ in range(r.randint(4, 6)))

    def secret() -> str:
        return r.choice(
            [
                lambda: "AKIA" + rand(upper + digits, 16),
                lambda: "ghp_" + rand(every, 36),
                lambda: "sk-" + rand(every, r.randint(32, 48)),
                lambda: "xoxb-" + rand(digits, 11) + "-" + rand(every, 24),
                lambda: "AIza" + rand(every + "_-", 35),
                lambda: "eyJ" + rand(every, 20) + "." + "eyJ" + rand(every, 30) + "." + rand(every + "_-", 40),
                lambda: rand("0123456789abcdef", r.choice([24, 32, 40, 64])),
                lambda: rand(every + "+/", r.choice([24, 32, 40, 44])),
                lambda: rand(every, r.randint(20, 36)),
                lambda: rand(lower + upper, r.randint(20, 36)),
            ]
        )()

    def harmless() -> str:
        return r.choice(
            [
                lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
                lambda: rand(digits, r.randint(1, 19)),
                lambda: f"{r.randint(0, 999)}.{r.randint(0, 99)}",
                lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
                lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
                lambda: word() + rand(digits, r.randint(1, 3)),
                lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
                lambda: f"+{r.randint(1, 99)} ({rand(digits, 3)}) {rand(digits, 3)}-{rand(digits, 4)}",
                lambda: "https://" + word() + ".example.com/" + word() + "/" + rand(digits, 3),
                lambda: word() + "/" + word() + rand(digits, 2) + ".txt",
                lambda: "-".join(rand("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
                lambda: rand("0123456789abcdef", 7),
                lambda: "".join(word() for _ in range(r.randint(4, 7))),
                lambda: "-".join(word() for _ in range(r.randint(2, 4))),
                lambda: "ISBN " + rand(digits, 13),
                lambda: rand(upper, 2) + "-" + rand(digits, r.randint(3, 6)),
                lambda: "".join(r.choice("*$%&#") * 3 for _ in range(3)),
            ]
        )()

    lines = []
    for k in range(n):
        out: list[tuple[str, int]] = []

        def put(s: str, secret_: bool = False) -> None:
            for j, t in enumerate(TOKEN.findall(s)):
                out.append((t, (1 if j == 0 else 2) if secret_ else 0))

        for _ in range(r.randint(1, 5)):
            put(written())
        roll = r.random()
        if roll < 0.25:
            put(r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "auth_token", "private_key", "PASSWORD"]) + r.choice(["=", ": ", " = ", '="', "='", ' = "']))
            kind = r.random()
            put(rand(every, r.randint(8, 24)) if kind < 0.5 else phrase() if kind < 0.7 else secret(), True)
        elif roll < 0.45:
            if r.random() < 0.5:
                put(r.choice(["key", "bearer", "auth", "credential", "access"]) + r.choice([" ", ": "]))
            if r.random() < 0.15:
                put(r.choice(["passphrase", "password", "token", "secret"]) + r.choice([" ", ": "]))
                put(phrase(), True)
            else:
                put(secret(), True)
        else:
            if r.random() < 0.15:
                put(r.choice(["password", "token", "secret", "key"]))
                put(word())
            put(harmless())
        for _ in range(r.randint(0, 4)):
            put(harmless() if r.random() < 0.25 else written())
        lines.append(out[:40])
    return lines


def _files(lines: list[list[tuple[str, int]]], seed: int) -> list[list[list[tuple[str, int]]]]:
    """Lines dealt to files of one to twenty: settings, where most lines hold a secret, prose and logs, where few do."""
    r = random.Random(seed)
    held = [x for x in lines if any(label for _, label in x)]
    bare = [x for x in lines if not any(label for _, label in x)]
    out = []
    while held or bare:
        share, file = r.choice([0.1, 0.4, 0.9]), []
        for _ in range(r.choice([1, 1, 2, 4, 10, 20])):
            first, other = (held, bare) if r.random() < share else (bare, held)
            if first or other:
                file.append((first or other).pop())
        out.append(file)
    return out


@functools.lru_cache(2)
def train(lines: int = TRAINING_LINES, epochs: int = EPOCHS, seed: int = SEED) -> tuple[dict[str, tuple], list]:
    """Weights of each feature for O, B, I, and the 3 x 3 transitions, by AdaGrad on the conditional likelihood."""
    files = _files(_generated(lines, seed), seed + 1)
    data = [line for file in files for line in file]
    told = []  # each line's file feature, made as it is for a text
    for file in files:
        text = "\n".join(" ".join(t for t, _ in line) for line in file)
        told += [text_features(text, sum(may_be_secret(t) for line in file for t, _ in line))] * len(file)
    names: dict[str, int] = {"": 0}
    width, most = 13, max(map(len, data))
    x = np.zeros((len(data), most, width), dtype=np.int32)
    y = np.zeros((len(data), most), dtype=np.int64)
    real = np.zeros((len(data), most), dtype=bool)
    for k, line in enumerate(data):
        ts = ["", "", *[t for t, _ in line], ""]
        of_text = told[k]
        for j, (t, label) in enumerate(line):
            real[k, j], y[k, j] = True, label
            x[k, j] = [names.setdefault(f, len(names)) for f in features(ts[j], ts[j + 1], t, ts[j + 3], of_text)]
    w, trans = np.zeros((len(names), 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    hot = np.eye(3)[y] * real[..., None]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    big = np.where(np.isinf(ALLOWED), -1e3, 0.0)
    for _ in range(epochs):
        step = trans + big
        e = w[x].sum(2)
        f = np.zeros_like(e)
        b = np.zeros_like(e)
        f[:, 0] = step[0] + e[:, 0]
        for j in range(1, most):
            f[:, j] = np.where(real[:, j, None], lse(f[:, j - 1, :, None] + step, 1) + e[:, j], f[:, j - 1])
        last = np.broadcast_to(step[:, 0], b[:, 0].shape)
        b[:, most - 1] = last
        for j in range(most - 2, -1, -1):
            b[:, j] = np.where(real[:, j + 1, None], lse(step[None] + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), last)
        z = lse(f[:, most - 1] + last, 1)
        p = np.exp(f + b - z[:, None, None]) * real[..., None]
        grad = np.zeros_like(w)
        for c in range(width):
            np.add.at(grad, x[:, :, c].ravel(), (hot - p).reshape(-1, 3))
        pair = np.exp(f[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        both = real[:, 1:, None, None]
        gtr = (hot[:, :-1, :, None] * hot[:, 1:, None, :] * both - pair * both).sum((0, 1))
        grad -= 0.2 * w
        grad[0] = 0
        gw += grad * grad
        gt += gtr * gtr
        w += 0.5 * grad / np.sqrt(gw)
        trans += 0.5 * gtr / np.sqrt(gt)
    return {n: tuple(w[k].tolist()) for n, k in names.items() if n}, trans.tolist()


NEAR = ("none", "name", "holds-name", "symbol", "number", "word", *"=:\"'@/,.()[]#<>-")
NEAR_AT = {n: k for k, n in enumerate(NEAR)}
ALPHABETS = ("digits", "uuid", "date", "hex", "number", "upper", "letters", "word-number", "path", "mixed")


class Field(dict):
    """The trained field, ready to tag texts; as a dict, each token's kind (<< 6), what it is to its neighbours (<< 1) and may_be_secret.

    Scores are those of B and I less that of O. Each is a sum of what the token
    itself gives, what its neighbours' kinds give and what the text gives.
    """

    def __init__(self, model: tuple[dict, list]):
        weights, trans = model
        none = (0.0, 0.0, 0.0)
        self.weights = {f: (b - o, i - o) for f, (o, b, i) in weights.items()}
        w = lambda f: self.weights.get(f, none[:2])
        self.left = np.zeros((len(NEAR), len(NEAR), len(ALPHABETS), 2))  # by the second and the first token before, and the alphabet
        for i, b2 in enumerate(NEAR):
            for j, b1 in enumerate(NEAR):
                both = np.add(w(f"before={b1}"), w(f"before2={b2}/{b1}"))
                for k, a in enumerate(ALPHABETS):
                    self.left[i, j, k] = both + w(f"before-shape={b2}/{b1}/{a}")
        self.right = np.array([w(f"after={n}") for n in NEAR])
        self.step = np.array(trans)
        # what relabelling n tokens in a row as O can cost in transitions: enter + (n - 1) * within + leave, or
        # + leave_i where the next token, an I, becomes a B
        t = self.step + ALLOWED
        self.enter = float(max(t[p, x] - t[p, 0] for p in range(3) for x in (1, 2)))
        self.within = float((t[1:, 1:] - t[0, 0]).max())
        self.leave = float(max(t[x, q] - t[0, q] for x in (1, 2) for q in (0, 1)))
        self.leave_i = float(t[1:, 2].max() - t[0, 1] + (t[2] - t[1]).max())
        #: Tokens below it cannot pay for being anything but O, however many follow each other.
        self.weak = min(-(self.enter + self.leave), -self.within, 0.0) - 1e-6
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = 0
        self.kinds: dict[tuple, int] = {}
        self.own, self.alphabet = np.zeros((0, 2)), np.zeros(0, dtype=np.int64)  # by kind
        self.worth: list[tuple] = []

    def __missing__(self, t: str) -> int:
        kind = own_kind(t)
        k = self.kinds.get(kind)
        if k is None:
            k = self.kinds[kind] = len(self.worth)
            some = [self.weights.get(f, (0.0, 0.0)) for f in own_features(*kind)]
            self.worth.append((sum(x for x, _ in some), sum(x for _, x in some), ALPHABETS.index(kind[0])))
        self[t] = code = k << 6 | NEAR_AT[_near(t)] << 1 | may_be_secret(t)
        self.chars += len(t)
        return code

    def scores(self, text: str, tokens: list[str]) -> np.ndarray:
        """tokens x 2: what B and I are worth at each token, beyond O."""
        if len(self) > WORDS or self.chars > WORDS * 16:
            self.reset()
        codes = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if len(self.own) < len(self.worth):
            worth = np.array(self.worth)
            self.own, self.alphabet = worth[:, :2].copy(), worth[:, 2].astype(np.int64)
        kinds, near = codes >> 6, np.zeros(len(codes) + 3, dtype=np.int64)
        near[2:-1] = codes >> 1 & 31
        out = self.own[kinds] + self.left[near[:-3], near[1:-2], self.alphabet[kinds]] + self.right[near[3:]]
        return out + self.weights.get("text=" + text_features(text, int((codes & 1).sum())), (0.0, 0.0))

    def runs(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Runs (first, end) of tokens outside which the best path is O.

        A stretch of weak tokens that a path tags is worth less than it costs,
        so relabelling it as O gives a better path. Only where a tagged token
        that is not weak follows as I, which then must become B, can the last
        ones of the stretch pay; these belong to the run.
        """
        best = scores.max(1)
        out: list[list[int]] = []
        for x in np.flatnonzero(best >= self.weak).tolist():
            end = out[-1][1] if out else 0
            lo, cost = x, self.enter + self.leave_i - self.within + float(scores[x, 1] - scores[x, 0])
            while lo > end:
                cost += float(best[lo - 1]) + self.within
                if cost < -1e-6:
                    break
                lo -= 1
            if out and lo == end:
                out[-1][1] = x + 1
            else:
                out.append([lo, x + 1])
        return [(a, b) for a, b in out]


def field_spans(text: str, model: tuple[dict, list] | Field) -> list[tuple[int, int]]:
    """Spans (start, end) of the tokens that Viterbi tags, of all tokens of the text."""
    field = model if isinstance(model, Field) else Field(model)
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    scores = field.scores(text, tokens)
    labels = {}
    for a, b in field.runs(scores):
        emission = np.concatenate([np.zeros((b - a, 1)), scores[a:b]], axis=1)
        labels |= {a + k: x for k, x in enumerate(viterbi(emission, field.step)) if x}
    if not labels:
        return []
    out: list[tuple[int, int]] = []
    for k, m in enumerate(TOKEN.finditer(text)):
        x = labels.get(k)
        if x == 1:
            out.append(m.span())
        elif x == 2:
            out[-1] = (out[-1][0], m.end())
    return out


def find(text: str, model: tuple[dict, list] | Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: (start, kind, end)."""
    base = base_spans(text)
    more = []
    for a, b in field_spans(text, model):
        if not any(s <= a and b <= e for s, _, e in base):
            more.append((a, 3, b))
    return base, sorted(base + more)


def said(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans for each row of docs."""
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        field = Field(model)
        for keys, some in texts(batches):
            out: list[list] = [[] for _ in names]
            for k, t in zip(keys, some):
                base, every = find(t, field)
                n = Counter(x[1] for x in every)
                row = (k, n[0], n[1], n[2], hashlib.sha256(said(base).encode()).hexdigest(), said(every), n[3])
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return keyed_texts(docs, key, text).mapInArrow(run, SCHEMA)


def redact(text: str, model: tuple[dict, list] | Field, mark: str = "[SECRET]") -> str:
    """text with each secret replaced; of an assignment, its value alone."""
    cuts = []
    for a, kind, b in find(text, model)[1]:
        cuts.append((ASSIGN.match(text, a).start(2) if kind == 0 else a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets in their texts replaced; n_chars, where there is one, follows. Null texts stay null."""
    ship(docs.sparkSession)
    model = train()

    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = Field(model)
        for s in columns:
            yield s.map(lambda t: redact(t, field), na_action="ignore")
            del s
            release()

    clean = F.pandas_udf(clean, "string")

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
