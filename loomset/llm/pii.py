"""PII: patterns as a base, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans: texts of a bounded sample, whose spans the patterns label, and
spans in other spellings (emails with "at" and "dot", phones without a plus) and look-alikes without a label, set into
such texts. Whole texts are searched for places with a digit, an at sign or a spelled-out one, in any case and with or
without brackets, one of which every span must hold; overlapping windows over them are decoded by Viterbi, and those with an at sign and capitals once more in lower case. A span that touches an edge inside the text is left to the next window, or if that has
none there, to one more of twice the width, centred on it: spans of up to WINDOW characters are decoded whole wherever they
start, those of up to twice that in part of the places. A span inside another of its kind is a part of it and goes; of
spans that overlap after that, over the whole text, the one with the higher mean probability stays. A base span is never dropped,
and a new one must not touch it and must have the digits or signs of its kind.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
HIDDEN, WINDOW, STRIDE, BATCH = 32, 96, 48, 256
#: The training sample: so many texts at most, of so many characters at most, and so many windows.
SAMPLE, SAMPLE_CHARS, TRAIN_WINDOWS, TRAIN_WIDTH, EPOCHS, TRAIN_BATCH = 150, 8000, 4400, 56, 12, 40
#: Adam's rate, which falls to a twentieth, and the longest gradient.
RATE, CLIP = 0.02, 5.0
#: Mean probability of a span's tags from which it is added.
SURE = 0.7
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: What any span that _fits accepts must hold: a digit, an at sign or a spelled-out one, in any case.
_PLACE = re.compile(r"[0-9@]|[\s(\[]at[\s)\]]", re.IGNORECASE)
_AT = re.compile(r"@|[\s(\[]at[\s)\]]", re.IGNORECASE)
_LETTER, _DOT = re.compile(r"[a-z]"), re.compile(r"\.|[\s(\[]dot[\s)\]]")
_CAPITAL = re.compile(r"[A-Z]")
#: Where training looks for windows.
_SEEN_PLACE = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]| dot ")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: each at sign with the run of local characters before it, as far as no match has taken them.

    Runs of local characters are walked once, whatever their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
        last = host.end() if host else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind as listed, then by start."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Characters: a class for each lower-case letter and each sign that matters, one for all other letters, and so on.
_SIGNS = "@.-_%+()[] \n:/,#"
PAD, UPPER, DIGIT, OTHER, FOREIGN = 0, 27, 28, 29, 30
CLASSES = 31 + len(_SIGNS)
_CLASS = np.full(128, OTHER, np.int64)
for _k in range(26):
    _CLASS[97 + _k], _CLASS[65 + _k] = 1 + _k, UPPER
_CLASS[48:58] = DIGIT
for _k, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 31 + _k
_FOLDED = _CLASS.copy()
_FOLDED[65:91] = _CLASS[97:123]


def classes(text: str, fold: bool = False) -> np.ndarray:
    """fold: A-Z are taken as a-z."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, (_FOLDED if fold else _CLASS)[np.minimum(points, 127)], FOREIGN)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Tagger:
    """Weights of both directions, the second over the text reversed: `x` (2 x classes x 4H), `h` (2 x H x 4H); `out`
    (2H x tags), `bias`, `move` (tags x tags)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 0.3, (2, CLASSES, 4 * HIDDEN))
        x[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # forget gates start open
        move = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):  # an inside tag follows only its own kind
            inside = 2 + 2 * k
            move[:, inside] = -6.0
            move[[inside - 1, inside], inside] = 0.0
        w = {"x": x, "h": rng.normal(0, 1 / np.sqrt(HIDDEN), (2, HIDDEN, 4 * HIDDEN)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": move}
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    def emissions(self, ids: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tags (n x t x tags) and the states of both directions; keep gets what the gradient needs."""
        n, t = ids.shape
        gates = np.stack([self.w["x"][0][ids], self.w["x"][1][ids[:, ::-1]]])
        h = c = np.zeros((2, n, HIDDEN), gates.dtype)
        out = np.empty((2, n, t, HIDDEN), gates.dtype)
        for k in range(t):
            g = gates[:, :, k] + h @ self.w["h"]
            s = _sigmoid(g[:, :, : 3 * HIDDEN])
            i, f, o, z = s[:, :, :HIDDEN], s[:, :, HIDDEN : 2 * HIDDEN], s[:, :, 2 * HIDDEN :], np.tanh(g[:, :, 3 * HIDDEN :])
            before, last = h, c
            c = f * c + i * z
            y = np.tanh(c)
            h = o * y
            out[:, :, k] = h
            if keep is not None:
                keep.append((i, f, o, z, y, last, before))
        both = np.concatenate([out[0], out[1][:, ::-1]], 2)
        return both @ self.w["out"] + self.w["bias"], both

    def _alpha_beta(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        move = self.w["move"].astype(np.float64)
        alpha, beta = np.empty(e.shape), np.zeros(e.shape)
        alpha[:, 0] = e[:, 0]
        for t in range(1, e.shape[1]):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + move, 1)
        for t in range(e.shape[1] - 2, -1, -1):
            beta[:, t] = _lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[:, -1], 1)

    def viterbi(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window and, where any is not outside, the marginal probability of each."""
        e = self.emissions(ids)[0].astype(np.float64)
        move, back, v = self.w["move"], [], e[:, 0]
        for t in range(1, e.shape[1]):
            s = v[:, :, None] + move
            back.append(s.argmax(1))
            v = s.max(1) + e[:, t]
        tags = np.empty(ids.shape, np.int64)
        tags[:, -1] = v.argmax(1)
        rows = np.arange(len(ids))
        for t in range(e.shape[1] - 2, -1, -1):
            tags[:, t] = back[t][rows, tags[:, t + 1]]
        sure, some = np.ones(ids.shape), np.flatnonzero((tags > 0).any(1))
        if len(some):
            alpha, beta, z = self._alpha_beta(e[some])
            sure[some] = np.exp(np.take_along_axis(alpha + beta, tags[some][:, :, None], 2)[:, :, 0] - z[:, None])
        return tags, sure

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood."""
        kept: list = []
        e, both = self.emissions(ids, kept)
        e = e.astype(np.float64)
        alpha, beta, z = self._alpha_beta(e)
        n, t = ids.shape
        de = np.exp(alpha + beta - z[:, None, None])
        np.subtract.at(de, (np.arange(n)[:, None], np.arange(t)[None], tags), 1.0)
        pair = np.exp(alpha[:, :-1, :, None] + self.w["move"] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        de = (de / n).astype(both.dtype)
        dh = de @ self.w["out"].T
        part = np.stack([dh[:, :, :HIDDEN], dh[:, ::-1, HIDDEN:]])
        gates = np.empty((2, n, t, 4 * HIDDEN), both.dtype)
        gh = np.zeros_like(self.w["h"])
        later = dc = np.zeros((2, n, HIDDEN), both.dtype)
        turned = self.w["h"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            i, f, o, zz, y, last, before = kept[k]
            up = part[:, :, k] + later
            dc = dc + up * o * (1 - y * y)
            dg = np.concatenate([dc * zz * i * (1 - i), dc * last * f * (1 - f), up * y * o * (1 - o), dc * i * (1 - zz * zz)], 2)
            gates[:, :, k] = dg
            gh += before.transpose(0, 2, 1) @ dg
            later, dc = dg @ turned, dc * f
        gx = [np.eye(CLASSES, dtype=both.dtype)[x.ravel()].T @ d.reshape(n * t, -1) for x, d in zip((ids, ids[:, ::-1]), gates)]
        return {"x": np.stack(gx), "h": gh, "move": (pair / n).astype(both.dtype), "bias": de.sum((0, 1)), "out": both.reshape(n * t, -1).T @ de.reshape(n * t, -1)}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b], out[a] = 2 + 2 * k, 1 + 2 * k
    return out


def _made(rng: np.random.Generator) -> tuple[str | None, str]:
    """A span of some kind in some spelling, or a look-alike (None). Cards are labelled by their shape: whether digits
    pass Luhn's test can't be learned, and is asked of every span that the network finds (_fits)."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    kind = pick(*["email"] * 7, *["ip"] * 3, *["card"] * 3, *["phone"] * 3, *[None] * 3)
    if kind == "email":
        at = pick("@", "@", " at ", " at ", " at ", " at ", " (at) ", " [at] ", "(at)", "[at]")
        dot = pick(" dot ", " dot ", " [dot] ", " (dot) ") if at != "@" and rng.random() < 0.6 else "."
        local = pick(word(), word(), word(), word()[0])
        name, host, top = local + pick("", "." + word(), "_" + word(), dot + word(), num(2), "." + num(2)), word() + pick("", num(1), "-" + word()), pick("com", "org", "net", "example.com", "de")
        return kind, name + at + host + dot + top.replace(".", dot)
    if kind == "ip":
        return kind, ".".join(str(rng.integers(0, pick(10, 100, 256, 256))) for _ in range(4))
    if kind == "card":
        groups = pick((4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 3, 3, 3), (int(rng.integers(13, 20)),))
        return kind, pick("", " ", "-").join(num(n) for n in groups)
    if kind == "phone":
        a, b, c = str(rng.integers(200, 990)), num(3), num(4)
        return kind, pick(f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"0{a} {b} {c}", f"0{a}-{b}{c}", f"0{num(2)} {num(4)} {c}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"1-{a}-{b}-{c}", f"+{num(2)}-{a}-{b}-{c}")
    return None, pick(num(4), num(6), f"{rng.integers(1900, 2100)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", num(8), num(11), "%032x" % int(rng.integers(1, 2**62)), f"{num(3)} {num(3)}", "@" + word(), f"{num(2)}:{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(1)}.{num(1)}", f"{num(2)}/{num(2)}/{num(4)}", word() + " at " + word() + " " + word(), word() + " dot " + word())


def train(texts: list[str], seed: int = 5) -> Tagger:
    """Learns from windows of the texts (labelled by base_spans) with spans set into four of five of them."""
    rng, tagger = np.random.default_rng(seed), Tagger()
    texts = [t for t in texts if t] or ["the of and to in a is that for it"]
    ids, tags = np.zeros((TRAIN_WINDOWS, TRAIN_WIDTH), np.int64), np.zeros((TRAIN_WINDOWS, TRAIN_WIDTH), np.int64)
    for k in range(TRAIN_WINDOWS):
        text = texts[rng.integers(len(texts))]
        places = [m.start() for m in _SEEN_PLACE.finditer(text)]
        at = int(places[rng.integers(len(places))]) - int(rng.integers(0, TRAIN_WIDTH)) if places and rng.random() < 0.4 else int(rng.integers(0, max(1, len(text))))
        part = text[max(0, at) : max(0, at) + TRAIN_WIDTH]
        spans = base_spans(part)
        if rng.random() < 0.8:
            kind, made = _made(rng)
            cut = part.rfind(" ", 0, int(rng.integers(1, TRAIN_WIDTH))) + 1 if rng.random() < 0.9 else 0
            if not any(a <= cut <= b for _, a, b in spans):
                before, after = ("", " ") if rng.random() < 0.4 else [("", ". "), ("", ", "), ("(", ") "), ("", "\n"), (": ", "; "), ('"', '" '), ("<", "> "), ("", "? "), ("\n", "\n")][rng.integers(9)]
                rest = part[cut:] if rng.random() < 0.85 else ""  # a text may end here
                part = part[:cut] + before + made + (after + rest if rest else after.rstrip())
                cut += len(before)
                if kind and cut + len(made) <= TRAIN_WIDTH:
                    own = [(kind, cut, cut + len(made))]
                else:
                    own = []
                    part = part if not kind else part[: cut - len(before)]
                spans = [s for s in base_spans(part[:TRAIN_WIDTH]) if not any(a < s[2] and s[1] < b for _, a, b in own)] + own
        x = classes(part[:TRAIN_WIDTH])
        ids[k, : len(x)] = x
        tags[k, : len(x)] = _tags(len(x), spans)
    m, v, step, steps = {}, {}, 0, EPOCHS * max(1, TRAIN_WINDOWS // TRAIN_BATCH)
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(TRAIN_WINDOWS), max(1, TRAIN_WINDOWS // TRAIN_BATCH)):
            step += 1
            found = tagger.gradient(ids[rows], tags[rows])
            scale = min(1.0, CLIP / (1e-6 + float(np.sqrt(sum(float((g * g).sum()) for g in found.values())))))
            for key, g in found.items():
                g = g * np.float32(scale)
                m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                v[key] = 0.99 * v.get(key, 0) + 0.01 * g * g
                rate = RATE * (0.05 + 0.95 * (1 - step / steps))
                tagger.w[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


def places(text: str) -> list[tuple[int, int]]:
    """Overlapping windows (start, end) over every place: the two windows of the grid of STRIDE that hold it."""
    grid = {k for m in _PLACE.finditer(text) for k in range((m.start() - WINDOW) // STRIDE + 1, m.start() // STRIDE + 1) if k >= 0}
    return [(k * STRIDE, min(len(text), k * STRIDE + WINDOW)) for k in sorted(grid)]


def _fits(kind: str, text: str) -> bool:
    n = sum(c in "0123456789" for c in text)
    if kind == "email":
        parts = _AT.split(text.lower())
        return len(parts) == 2 and _LETTER.search(parts[0]) is not None and _DOT.search(parts[1]) is not None and len(text) >= 6
    if kind == "card":
        return 13 <= n <= 19 and luhn(_NOT_DIGIT.sub("", text))
    if kind == "phone":
        return 10 <= n <= 15 and re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", text) is not None and re.search(r"[ ().-]", text) is not None
    return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None


def _decoded(texts: list[str], jobs: list[tuple[int, int, int, bool]], width: int, tagger: Tagger, found: list[list[tuple[float, Span]]]) -> list[tuple[tuple[int, int, int, bool], tuple[int, int]]]:
    """Adds the sure spans in windows (text, start, end, in lower case) of at most width characters to found. Returns the
    windows and spans in them that touch an edge inside the text."""
    cut = []
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        ids = np.zeros((len(part), width), np.int64)
        for k, (i, a, b, fold) in enumerate(part):
            ids[k, : b - a] = classes(texts[i][a:b], fold)
        tags, sure = tagger.viterbi(ids)
        for k in np.flatnonzero((tags > 0).any(1)).tolist():
            i, a, b, _ = part[k]
            row = tags[k, : b - a]
            for start in np.flatnonzero(row % 2 == 1).tolist():
                end = start + 1
                while end < len(row) and row[end] == row[start] + 1:
                    end += 1
                if (start == 0 and a > 0) or (end == len(row) and b < len(texts[i])):
                    cut.append((part[k], (start, end)))
                    continue
                p, kind = float(sure[k, start:end].mean()), KINDS[(row[start] - 1) // 2]
                if p >= SURE and _fits(kind, texts[i][a + start : a + end]):
                    found[i].append((p, (kind, a + start, a + end)))
    return cut


class _Taken:
    """Characters that spans have taken, as disjoint stretches in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def holds(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.starts, a) - 1
        return k >= 0 and b <= self.ends[k]

    def take(self, a: int, b: int) -> None:
        """A stretch that meets no other."""
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def new_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """The network's spans of each text, reconciled over its windows and with its base spans."""
    owned = [_Taken(spans) for spans in base]
    jobs = [(i, a, b, False) for i, t in enumerate(texts) for a, b in places(t) if not owned[i].holds(a, b)]
    jobs += [(i, a, b, True) for i, a, b, _ in jobs if _AT.search(part := texts[i][a:b]) and _CAPITAL.search(part)]
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    again = set()
    for (i, a, b, fold), cut in _decoded(texts, jobs, WINDOW, tagger, found):
        around = (a + cut[0] + a + cut[1]) // 2 - WINDOW
        if not owned[i].meets(a + cut[0], a + cut[1]):
            again.add((i, max(0, around), min(len(texts[i]), around + 2 * WINDOW), fold))
    _decoded(texts, sorted(again), 2 * WINDOW, tagger, found)
    out = []
    for spans, own in zip(found, owned):
        kept: list[Span] = []
        free = [(p, s) for p, s in spans if not own.meets(s[1], s[2])]
        spans, reach = [], dict.fromkeys(KINDS, 0)
        for p, s in sorted(free, key=lambda x: (x[1][1], -x[1][2], -x[0])):
            if s[2] > reach[s[0]]:  # not part of another span of its kind
                spans.append((p, s))
                reach[s[0]] = s[2]
        for _, s in sorted(spans, key=lambda x: (-x[0], x[1][1], x[1])):
            if not own.meets(s[1], s[2]):
                kept.append(s)
                own.take(s[1], s[2])
        out.append(kept)
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def sample(docs: DataFrame) -> list[str]:
    rows = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    few = docs.where(draw < int(min(1.0, 2.0 * SAMPLE / max(1, rows)) * (1 << 30))).where(F.length("text").between(1, SAMPLE_CHARS))
    return [r["text"] for r in few.select("text", draw.alias("d"), "doc_id").orderBy("d", "doc_id", "text").limit(SAMPLE).collect()]


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """SCHEMA for each row of docs: counts and digest of the base spans, all spans as text, how many were added and how
    many there are.

    A null or empty text has none. A very long text is decoded window by window, whole. Repeated rows have equal results. An empty table gives an empty result. Other
    columns than doc_id and text are not read. The network is a broadcast of fixed size."""
    held = docs.sparkSession.sparkContext.broadcast((tagger or train(sample(docs))).w)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger()
        tagger.w = held.value
        for batch in batches:
            texts = [t or "" for t in batch]
            base = [base_spans(t) for t in texts]
            out = []
            for own, more in zip(base, new_spans(texts, base, tagger)):
                out.append((*(sum(s[0] == k for s in own) for k in KINDS), hashlib.sha256(_written(own).encode()).hexdigest(), _written(own + more), len(more), len(own) + len(more)))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select("doc_id", spans_of("text").alias("x")).select("doc_id", "x.*")
