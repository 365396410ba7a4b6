"""Secret scans: fixed patterns, and a character convolutional network over every long token.

The patterns give the base findings, which stay whatever the network says. Every run of
LEAST_CANDIDATE or more token characters is a candidate, whole and however long, the
values of base findings among them; the network scores each from its characters and
those around it. It is numpy throughout: an embedding of characters folded into a
convolution over five of them, maxima over the token, over the text before and over
the text after it, the token's mean embedding and its length, and a logistic output.
The convolution runs once over a text, by sums of table rows, and the tokens' pools
are ranges of it, so a token of any length is seen whole.

It starts from findings made by a seeded rule in formats that the patterns do not know,
then learns from all documents: every finding of the patterns, as it is and with the
words that lead to it masked, against every other token that the start leaves above a
margin (tokens beyond it lose nothing, as under a hinge loss). Tasks learn from parts of
these, dealt by a hash, and made findings, and their weights are averaged. Findings are
split by document (or rule draw); on all held-out ones a temperature calibrates the
scores, and the threshold is the largest that keeps the wanted recall on the documents'
findings as on the made ones.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import bounded, durable

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "model")

_QUICK_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
_QUICK_ASSIGN = ("passw", "secret", "token", "apikey", "api_key")

#: A candidate: a run of at least this many token characters.
LEAST_CANDIDATE = 8
#: Characters before and after a token that the network sees.
CONTEXT = 24
#: Tokens that no pattern finds are learned from where the start leaves their logit above -MARGIN.
MARGIN = 2.0
#: Examples that a task learns from, about; findings among them at least, by repetition.
PART = 40_000
FEW = 600
#: Steps of a logit that held-out findings are counted by.
STEPS = 64
#: Characters that are convolved at a time, and rows of a token that are pooled at a time.
STRETCH = 1 << 14

# The classes of characters that the network tells apart; 0 is none, the last any other.
_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
_TOKEN_MARKS = "+/_=.!#$%^&*~-"
_MARKS = _TOKEN_MARKS + "\"':,;()[]{}<>@?|\\` \n\t"
ALPHABET = _LOWER + _UPPER + _DIGITS + _MARKS
N_CODES = len(ALPHABET) + 2
_CODE = np.full(256, N_CODES - 1, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1
_IN_TOKEN = np.zeros(N_CODES, bool)
_IN_TOKEN[[ALPHABET.index(c) + 1 for c in _LOWER + _UPPER + _DIGITS + _TOKEN_MARKS]] = True
codecs.register_error("knotwork.other", lambda e: ("\x80" * (e.end - e.start), e.end))


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base findings, sorted; kind as an index into KINDS."""
    out = []
    low = text.lower()  # ASCII letters stay side by side, whatever becomes of others
    if any(x in low for x in _QUICK_ASSIGN):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in _QUICK_HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, sorted."""
    return [(s, k, e) for s, k, e, _ in base_findings(text)]


def codes_of(text: str) -> np.ndarray:
    """The class of every character."""
    return _CODE[np.frombuffer(text.encode("latin-1", "knotwork.other"), np.uint8)]


def tokens(codes: np.ndarray) -> np.ndarray:
    """(start, end) of every candidate, from the codes of a text."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _IN_TOKEN[codes]
    step = np.diff(inside)
    out = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)
    return out[out[:, 1] - out[:, 0] >= LEAST_CANDIDATE]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


WIDTH = 5
_HALF = WIDTH // 2


@dataclass
class CharNet:
    """Weights by (place in the window, character, filter); of the pools (token, before, after); of the mean embedding and the length."""

    conv: np.ndarray
    bias: np.ndarray
    pools: np.ndarray
    unigram: np.ndarray
    length: np.ndarray
    out_bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    #: Held-out figures of the fit.
    report: dict = field(default_factory=dict)

    LEARNED = ("conv", "bias", "pools", "unigram", "length", "out_bias")

    @classmethod
    def fresh(cls, rng: np.random.Generator, filters: int = 32) -> CharNet:
        conv = rng.normal(0, (2 / WIDTH) ** 0.5 / 2, (WIDTH, N_CODES, filters))
        conv[:, 0] = 0
        return cls(conv, np.zeros(filters), rng.normal(0, 0.1, (3, filters)), np.zeros(N_CODES), np.zeros(1), np.zeros(1))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows to sum for a window: of its first two, its next two and its last character."""
        c = self.conv.astype(np.float32)
        return ((c[0][:, None] + c[1][None]).reshape(N_CODES**2, -1), (c[2][:, None] + c[3][None]).reshape(N_CODES**2, -1), c[4] + self.bias.astype(np.float32))

    def logits(self, texts: list[np.ndarray], spans: list[np.ndarray], tables: tuple | None = None) -> list[np.ndarray]:
        """The network's output for spans (start, end) of every text, given as codes."""
        tables = tables or self.tables()
        where = [(t, lo, hi) for t, s in enumerate(spans) for lo, hi in _stretches(s)]
        out = [np.empty(len(s)) for s in spans]
        held: list[tuple[int, int, int]] = []
        size = 0
        for t, lo, hi in where:
            held.append((t, lo, hi))
            size += int(spans[t][hi - 1, 1] - spans[t][lo, 0]) + 2 * CONTEXT
            if size >= STRETCH:
                self._settle(texts, spans, held, out, tables)
                held, size = [], 0
        self._settle(texts, spans, held, out, tables)
        return out

    def _settle(self, texts: list, spans: list, held: list, out: list, tables: tuple) -> None:
        """Logits of the stretches (text, first span, end of spans) that are held."""
        if not held:
            return
        long = [(t, lo) for t, lo, hi in held if hi - lo == 1 and spans[t][lo, 1] - spans[t][lo, 0] > STRETCH]
        for t, lo in long:
            out[t][lo] = self._long(texts[t], *spans[t][lo].tolist(), tables)
        held = [x for x in held if x[:2] not in long]
        parts, cuts, at = [], [], 0
        for t, lo, hi in held:
            # A place without a character on either side stands for what is beyond the text, and separates texts.
            first, last = int(spans[t][lo, 0]) - CONTEXT - _HALF, int(spans[t][hi - 1, 1]) + CONTEXT + _HALF
            inner = texts[t][max(0, first) : last]
            parts += [np.zeros(WIDTH, np.uint8), inner, np.zeros(WIDTH, np.uint8)]
            begin = at + WIDTH - max(0, first)  # where the text's character 0 is
            s, e = spans[t][lo:hi, 0], spans[t][lo:hi, 1]
            before = np.maximum(s - CONTEXT, min(0, first) and -1)
            after = np.minimum(e + CONTEXT, len(texts[t]) + 1)
            cuts.append(np.stack([np.maximum(before, -1), s, e, after], 1) + begin)
            at += len(inner) + 2 * WIDTH
        if not held:
            return
        codes, cuts = np.concatenate(parts), np.concatenate(cuts)
        h = self._convolved(codes, tables)
        # Ranges (before, token, after) of one span follow each other.
        pooled = _range_max(h, (cuts[:, :3] - _HALF).ravel(), (cuts[:, 1:] - _HALF).ravel()).reshape(len(cuts), 3, -1)
        mean = np.add.reduceat(self.unigram[codes], cuts[:, 1:3].ravel())[::2]
        logit = self._output(pooled[:, [1, 0, 2]], mean, cuts[:, 2] - cuts[:, 1])
        at = 0
        for t, lo, hi in held:
            out[t][lo:hi] = logit[at : at + hi - lo]
            at += hi - lo

    def _long(self, codes: np.ndarray, start: int, end: int, tables: tuple) -> float:
        """The logit of a token of more than STRETCH characters, whose pools are taken piece by piece."""
        padded = np.concatenate([np.zeros(WIDTH, np.uint8), codes, np.zeros(WIDTH, np.uint8)])

        def most(lo: int, hi: int) -> np.ndarray:
            pieces = [self._convolved(padded[a + WIDTH - _HALF : min(a + STRETCH, hi) + WIDTH + _HALF], tables).max(0) for a in range(lo, hi, STRETCH)]
            return np.max(pieces, axis=0)

        pooled = np.stack([most(start, end), most(max(start - CONTEXT, -1), start), most(end, min(end + CONTEXT, len(codes) + 1))])
        return float(self._output(pooled[None], np.array([self.unigram[codes[start:end]].sum()]), np.array([end - start]))[0])

    def _convolved(self, codes: np.ndarray, tables: tuple) -> np.ndarray:
        """Filters at every place that has a whole window: the first is the window around place _HALF."""
        a, b, c = tables
        wide = codes.astype(np.int32)
        pair = wide[:-1] * N_CODES + wide[1:]
        n = len(codes) - WIDTH + 1
        h = a[pair[:n]]
        h += b[pair[2 : n + 2]]
        h += c[wide[4:]]
        return h

    def _output(self, pooled: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        """pooled: (spans, pools in the order token, before, after; filters)."""
        return (np.maximum(pooled, 0) * self.pools).sum((1, 2)) + total / size + np.log(size) * self.length[0] + self.out_bias[0]

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -50, 50)))

    def gradients(self, x: Examples, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss of examples and its derivatives; long ones apart, so that short ones need no more places than they have."""
        end = x.masks.shape[2] - x.masks[2][:, ::-1].argmax(1)  # beyond, an example has no character that counts
        short = end <= 3 * CONTEXT
        parts = [self._slopes(x.part(k), y[k], int(end[k].max()), len(y)) for k in (np.flatnonzero(short), np.flatnonzero(~short)) if len(k)]
        return sum(p[0] for p in parts), {k: sum(p[1][k] for p in parts) for k in self.LEARNED}

    def _slopes(self, x: Examples, y: np.ndarray, end: int, n: int) -> tuple[float, dict[str, np.ndarray]]:
        """What examples of at most `end` places add to the mean over n."""
        h = np.take(self.conv[0], x.codes[:, :end], 0)
        for o in range(1, WIDTH):
            h += np.take(self.conv[o], x.codes[:, o : o + end], 0)
        h += self.bias
        rows, filters = np.arange(len(y))[:, None], np.arange(h.shape[2])
        places = ((CONTEXT, end), (0, CONTEXT), (CONTEXT, end))  # of the pools
        best = np.stack([a + np.where(m[:, a:b, None], h[:, a:b], -np.inf).argmax(1) for m, (a, b) in zip(x.masks, places, strict=True)])
        value = h[rows, best, filters]
        live = np.maximum(value, 0)
        logit = (live * self.pools[:, None]).sum((0, 2)) + x.share @ self.unigram + x.log_size * self.length[0] + self.out_bias[0]
        d = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / n
        back = d[:, None] * self.pools[:, None] * (value > 0)
        window = np.arange(WIDTH)
        seen = x.codes[rows[..., None], best[..., None] + window]
        at = ((window * N_CODES + seen) * len(filters) + filters[:, None]).ravel()
        conv = np.bincount(at, np.broadcast_to(back[..., None], seen.shape).ravel(), self.conv.size).reshape(self.conv.shape)
        conv[:, 0] = 0
        loss = float(np.logaddexp(0, -np.where(y > 0, 1, -1) * logit).sum() / n)
        return loss, {"conv": conv, "bias": back.sum((0, 1)), "pools": np.einsum("b,rbf->rf", d, live), "unigram": x.share.T @ d, "length": np.array([x.log_size @ d]), "out_bias": np.array([d.sum()])}


def _range_max(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The maxima of rows start to end (exclusive, not empty): two windows of a power of two cover a range of up to 32 rows."""
    size = end - start
    out = np.empty((len(start), h.shape[1]), h.dtype)
    window = 1
    while True:
        mine = np.flatnonzero((size >= window) & (size < 2 * window))
        out[mine] = np.maximum(h[start[mine]], h[end[mine] - window])
        if window == 16:
            break
        h, window = np.maximum(h[:-window], h[window:]), 2 * window
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = np.maximum(h[start[i] : end[i] - 15].max(0), h[end[i] - 16])
    return out


def _stretches(spans: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of a text's spans that lie within about STRETCH characters."""
    lo = 0
    while lo < len(spans):
        hi = max(lo + 1, int(np.searchsorted(spans[:, 1], spans[lo, 0] + STRETCH, side="right")))
        yield lo, hi
        lo = hi


@dataclass
class Examples:
    """Findings in rows of one length: context, token (its first LONGEST characters) and context, as the network sees them."""

    codes: np.ndarray
    masks: np.ndarray
    share: np.ndarray
    log_size: np.ndarray

    LONGEST = 96

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, int, int]]) -> Examples:
        """found: (codes of a text, start, end)."""
        room = CONTEXT + cls.LONGEST + CONTEXT
        codes = np.zeros((len(found), room + 2 * _HALF), np.uint8)
        masks = np.zeros((3, len(found), room), bool)
        share, log_size = np.zeros((len(found), N_CODES)), np.zeros(len(found))
        for i, (text, s, e) in enumerate(found):
            size = min(e - s, cls.LONGEST)
            before = text[max(0, s - CONTEXT - _HALF) : s]
            inside, after = text[s : s + size], text[e : e + CONTEXT + _HALF]
            at = CONTEXT + _HALF
            codes[i, at - len(before) : at] = before
            codes[i, at : at + size] = inside
            codes[i, at + size : at + size + len(after)] = after
            masks[0, i, CONTEXT : CONTEXT + size] = True
            masks[1, i, CONTEXT - min(CONTEXT, s + 1) : CONTEXT] = True
            masks[2, i, CONTEXT + size : CONTEXT + size + min(CONTEXT, len(text) + 1 - e)] = True
            share[i] = np.bincount(inside, minlength=N_CODES) / size
            log_size[i] = np.log(e - s)
        return cls(codes, masks, share, log_size)

    def part(self, rows: np.ndarray) -> Examples:
        return Examples(self.codes[rows], self.masks[:, rows], self.share[rows], self.log_size[rows])


# What made findings are made of.
_SYLLABLES = ("an", "er", "on", "st", "th", "re", "in", "ti", "le", "que", "ou", "ment", "sch", "ung", "ado", "os", "ci", "ba", "mo", "ka")
_PREFIXES = ("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "rk_live_", "pk_live_", "npm_", "hf_")
_SECRET_LEADS = ("key = ", "auth: ", "Authorization: Bearer ", "credential=", "export KEY=", 'client_key: "', "pwd=", "pass: ", "private_key = '", "https://host/?sig=", "access ", "login admin / ")
_DULL_LEADS = ("see ", "id ", "file: ", "name=", "version = ", "https://host", "(")
_NUMBER_LEADS = ("etag ", "commit ", "order ", "checksum: ", "session log ", "build-", "ISBN ", "doi:", "trace id ", "sha256:", "integrity: ")


def made_findings(rng: np.random.Generator, n: int) -> list[tuple[np.ndarray, int, int, float]]:
    """n findings (codes of a text, start, end, label) by rule, and a token beside most secrets."""
    b64, alnum, hexa = string.ascii_letters + _DIGITS + "+/", string.ascii_letters + _DIGITS, _DIGITS + "abcdef"

    def draw(chars: str, k: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), k))

    def word(k: int) -> str:
        return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), k))

    def prose() -> str:
        return " ".join(word(int(k)) for k in rng.integers(1, 4, 6))

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def mixed(k: int) -> str:
        """Characters of a chosen password: letters of both cases, digits, a mark or none."""
        x = draw(string.ascii_letters, k - 3) + draw(_DIGITS, 2) + pick(["!", "#", "$", "7", "Q"])
        return "".join(x[i] for i in rng.permutation(len(x)))

    out = []
    for _ in range(n):
        secret = rng.random() < 0.5
        tail = pick(["", '"', "'", "\n", " ", ";", ")"]) + pick(["", " " + prose()])
        if secret:
            lead = pick([*_SECRET_LEADS, prose() + " "])
            token = pick([
                lambda: draw(alnum, int(rng.integers(20, 64))),
                lambda: draw(b64, int(rng.integers(24, 88))) + pick(["", "=", "=="]),
                lambda: pick(_PREFIXES) + draw(alnum, int(rng.integers(20, 40))),
                lambda: "eyJ" + draw(alnum + "_-", int(rng.integers(40, 90))),
                lambda: "AIza" + draw(alnum + "_-", 35),
                lambda: mixed(int(rng.integers(10, 24))),
            ])()
            if rng.random() < 0.2:
                lead = pick(["postgres", "mysql", "amqp", "redis", "https", "ftp"]) + "://" + word(2) + ":"
                token, tail = mixed(int(rng.integers(10, 24))), "@" + word(2) + pick([":5432/", ".example/", "/"]) + word(1)
        else:
            lead = pick([*_DULL_LEADS, prose() + " ", prose() + " "])
            token = pick([
                lambda: "-".join(word(int(rng.integers(1, 4))) for _ in range(int(rng.integers(3, 6)))) + str(int(rng.integers(0, 99))),
                lambda: word(int(rng.integers(4, 10))) + pick(["", ".", str(int(rng.integers(0, 2030)))]),
                lambda: word(int(rng.integers(4, 8))).upper(),
                lambda: "_".join(word(2) for _ in range(3)) + "_v" + str(int(rng.integers(1, 9))),
                lambda: "/" + "/".join(word(2) for _ in range(4)) + "/" + str(int(rng.integers(1, 9999))),
                lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)),
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-{rng.integers(10, 60)}",
                lambda: word(3).upper() + "-" + str(int(rng.integers(10**6, 10**9))) + "-" + word(2).upper(),
                lambda: draw(_DIGITS, int(rng.integers(8, 20))),
                lambda: word(1) * int(rng.integers(7, 14)) + str(int(rng.integers(1, 9))),
                lambda: pick(["x", "=", "-", "_", "*"]) * int(rng.integers(14, 30)) + "a1",
            ])()
            if rng.random() < 0.3:  # random characters that the text around shows to be no secret
                token, lead = draw(pick([alnum, hexa, _UPPER + _DIGITS]), int(rng.integers(16, 44))), pick(_NUMBER_LEADS)
            elif rng.random() < 0.1:  # a public key
                kind = pick(["ssh-rsa ", "ssh-ed25519 ", "ecdsa-sha2-nistp256 "])
                token, lead, tail = "AAAA" + draw(b64, int(rng.integers(60, 200))) + pick(["", "="]), kind, " " + word(2) + "@" + word(2)
        before = prose() + pick([" ", "\n", ". "]) + lead
        codes, start, end = codes_of(before + token + tail), len(before), len(before) + len(token)
        out.append((codes, start, end, float(secret)))
        # What stands beside a secret is none.
        beside = [x for x in tokens(codes).tolist() if x[1] <= start or end <= x[0]] if secret else []
        if beside:
            out.append((codes, *pick(beside), 0.0))
    return out


def masked(codes: np.ndarray, start: int, value: int, rng: np.random.Generator) -> np.ndarray:
    """The text with what leads from a finding's start to its value masked."""
    out = codes.copy()
    out[start:value] = rng.choice([0, ALPHABET.index(" ") + 1, N_CODES - 1])
    return out


def learn(net: CharNet, found: list[tuple[np.ndarray, int, int, float]], rng: np.random.Generator, epochs: int, fastest: float, sizes: list[int] | None = None) -> None:
    """Adam on findings; sizes: the tokens' whole lengths where the codes are cut."""
    x, y = Examples.of([f[:3] for f in found]), np.array([f[3] for f in found])
    if sizes is not None:
        x.log_size = np.log(np.array(sizes, np.float64))
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in CharNet.LEARNED}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            step += 1
            batch = order[at : at + 64]
            for k, g in net.gradients(x.part(batch), y[batch])[1].items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[k] = m, v
                rate = fastest * (1 - epoch / epochs)
                setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))


def started(seed: int, made: int, epochs: int) -> CharNet:
    """The network after learning from made findings alone."""
    rng = np.random.default_rng(seed)
    found = made_findings(rng, made)
    net = CharNet.fresh(rng)
    learn(net, found, rng, epochs, 4e-3)
    return net


_WEIGHTS = "n long, weights array<binary>"


def _weights(net: CharNet, n: int) -> pa.RecordBatch:
    w = [getattr(net, k).astype(np.float64).tobytes() for k in CharNet.LEARNED]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w], pa.list_(pa.binary()))], ["n", "weights"])


def _network(weights: list[bytes]) -> CharNet:
    filters = len(weights[1]) // 8
    shapes = ((WIDTH, N_CODES, filters), (filters,), (3, filters), (N_CODES,), (1,), (1,))
    return CharNet(*(np.frombuffer(bytes(w), np.float64).reshape(s).copy() for w, s in zip(weights, shapes, strict=True)))


_LESSON = ("codes", "start", "end", "size", "label", "held")


def lessons(docs: DataFrame, net: CharNet, seed: int) -> DataFrame:
    """What all texts of docs teach: (codes, start, end, whole size of the token, label, held out), with no more text than the network sees.

    Label 1: every finding of the patterns, and again masked where it is not held out;
    0: every other token whose logit net leaves above -MARGIN; -1: a row a slice of the
    table with the number of all other tokens as size. A third of the texts, by their
    CRC, is held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    near = CONTEXT + _HALF

    def cut(codes: np.ndarray, s: int, e: int, label: int, held: bool) -> tuple:
        first = max(0, s - near - 1)
        shown = e if held else min(e, s + Examples.LONGEST)  # all that is learned from
        return np.concatenate([codes[first:shown], codes[e : e + near + 1]]).tobytes(), s - first, shown - first, e - s, label, held

    def taught(texts: list[str], net: CharNet, tables: tuple) -> list[tuple]:
        codes = [codes_of(t) for t in texts]
        spans = [tokens(c) for c in codes]
        out, others = [], [0, 0]
        for text, c, s, logit in zip(texts, codes, spans, net.logits(codes, spans, tables), strict=True):
            crc, base = zlib.crc32(text.encode("utf-8", "surrogatepass")), base_findings(text)
            held = crc % 3 == 0
            free = np.ones(len(s), bool)
            for start, _, end, value in base:
                free &= (s[:, 1] <= start) | (end <= s[:, 0])
                out.append(cut(c, value, end, 1, held))
                if not held:
                    out.append(cut(masked(c, start, value, np.random.default_rng([seed, crc, start])), value, end, 1, held))
            others[held] += int(free.sum())
            out += [cut(c, a, b, 0, held) for a, b in s[free & (logit > -MARGIN)].tolist()]
        return out + [(b"", 0, 0, n, -1, bool(held)) for held, n in enumerate(others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            rows = taught([t for t in batch.column("text").to_pylist() if t], sent.value, tables)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_LESSON))

    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return texts.mapInArrow(bounded(run), "codes binary, start long, end long, size long, label long, held boolean")


def _found(rows: pa.Table | pa.RecordBatch) -> list[tuple[np.ndarray, int, int, float]]:
    codes, start, end, label = (rows.column(c).to_pylist() for c in ("codes", "start", "end", "label"))
    return [(np.frombuffer(c, np.uint8), s, e, float(y)) for c, s, e, y in zip(codes, start, end, label, strict=True)]


def _averaged(taught: DataFrame, net: CharNet, seed: int, made: int, epochs: int) -> CharNet:
    """The network after tasks learn from all that is not held out, a part each, and the mean of their weights by examples."""
    rows = taught.filter("not held")
    n = rows.count()
    parts = max(1, n // PART)
    sent = taught.sparkSession.sparkContext.broadcast(net)

    def study(key: tuple, rows: pa.Table) -> pa.Table:
        mine = _network([getattr(sent.value, k).tobytes() for k in CharNet.LEARNED])
        rows = rows.sort_by([(c, "ascending") for c in ("codes", "start", "end", "size", "label")])
        own = list(zip(_found(rows), rows.column("size").to_pylist(), strict=True))
        good = [x for x in own if x[0][3]]
        own += good * (max(1, FEW // len(good)) - 1) if good else []
        rng = np.random.default_rng([seed, key[0].as_py()])
        own += [(f, f[2] - f[1]) for f in made_findings(rng, made // 2)]
        learn(mine, [f for f, _ in own], rng, epochs, 4e-3, [n for _, n in own])
        return pa.Table.from_batches([_weights(mine, rows.num_rows)])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for k, weights in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                w = [np.frombuffer(x, np.float64) * k for x in weights]
                total, n = w if total is None else [a + b for a, b in zip(total, w, strict=True)], n + k
        if total is not None:
            yield _weights(_network([(x / n).tobytes() for x in total]), n)

    part = F.pmod(F.xxhash64(F.lit(seed), *_LESSON[:5]), F.lit(parts))
    learned = durable(rows.withColumn("part", part).repartition(parts, "part").groupBy("part").applyInArrow(study, _WEIGHTS))
    row = learned.repartition(1).sortWithinPartitions("n", F.xxhash64("weights")).mapInArrow(mean, _WEIGHTS).first()
    net = net if row is None else _network(row.weights)
    net.report = {"trained": n}
    return net


def _calibrate(net: CharNet, taught: DataFrame, others: int, made: list[tuple], recall: float) -> None:
    """Temperature, threshold and report from all that is held out, counted by steps of the logit."""
    sent = taught.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            found = _found(batch)
            step = np.floor(np.concatenate([[], *sent.value.logits([f[0] for f in found], [np.array([f[1:3]]) for f in found], tables)]) * STEPS)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(step.astype(np.int64)), batch.column("n")], ["label", "step", "n"])

    steps = taught.filter("held").select("codes", "start", "end", "label", "n").mapInArrow(bounded(run), "label long, step long, n long")
    own = steps.groupBy("label", "step").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()  # a row a step that there is
    logit = np.concatenate(net.logits([f[0] for f in made], [np.array([f[1:3]]) for f in made]))
    step = np.array([r.step for r in own] + np.floor(logit * STEPS).astype(int).tolist())
    rows = np.array([r.rows for r in own] + [1] * len(made))
    y = np.array([r.label for r in own] + [f[3] for f in made])
    mine = np.arange(len(y)) < len(own)
    grid = np.geomspace(0.25, 4, 33)
    loss = [(rows * np.logaddexp(0, -np.where(y > 0, 1, -1) * (step + 0.5) / STEPS / t)).sum() for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])

    def lowest(k: np.ndarray) -> int:
        """The step that the wanted share of the findings reaches."""
        order = np.argsort(step[k], kind="stable")
        return int(step[k][order][np.searchsorted(np.cumsum(rows[k][order]), int((1 - recall) * rows[k].sum()), side="right")])

    # The largest threshold that keeps the recall on the made findings, and on the documents' where they are enough to tell.
    least = min(lowest(k) for k in ((y > 0) & mine, (y > 0) & ~mine) if rows[k].sum() * (1 - recall) >= 1)
    net.threshold = float(net.probability(np.array(least / STEPS)))
    said = step >= least
    share = lambda a, of: round(float(a / of), 6) if of else None
    good = mine & (y > 0)
    net.report |= {
        "held_out": int(rows.sum()), "recall": share(rows[said & (y > 0)].sum(), rows[y > 0].sum()), "precision": share(rows[said & (y > 0)].sum(), rows[said].sum()),
        "corpus_findings": int(rows[good].sum()), "corpus_recall": share(rows[said & good].sum(), rows[good].sum()),
        "corpus_others": others, "corpus_false": share(sum(r.n for r in own if r.label == 0 and r.step >= least), others),
    }


def fit(docs: DataFrame, seed: int = 11, sample_texts: int | None = None, made: int = 5_000, epochs: int = 8, recall: float = 0.95) -> CharNet:
    """The network after learning from all texts of docs, in as many tasks as they need.

    One task learns from made findings; then every text is read for what it teaches, and
    the rows of that are learned from in parts of about PART and counted for the threshold.
    Equal ones count once. Without texts the network knows made findings alone. No text
    is left out: sample_texts is there for callers that still name it, and has no effect.
    """
    spark = docs.sparkSession

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _weights(started(seed, made, epochs), 1)

    net = _network(spark.range(1).coalesce(1).mapInArrow(begin, _WEIGHTS).first().weights)
    told = durable(lessons(docs, net, seed))
    taught = durable(told.filter("label >= 0").groupBy(*_LESSON).agg(F.count(F.lit(1)).alias("n")))
    others = told.filter("label < 0 and held").agg(F.sum("size")).first()[0] or 0
    net = _averaged(taught, net, seed, made, epochs)
    _calibrate(net, taught, others, made_findings(np.random.default_rng([seed, made]), made // 3), recall)
    return net


def scan_texts(texts: list[str | None], net: CharNet, tables: tuple | None = None) -> list[tuple[list, list, int, int]]:
    """(base findings, findings of the network, tokens scored, findings of the network outside base ones) of each text."""
    texts = [t or "" for t in texts]
    codes = [codes_of(t) for t in texts]
    base = [base_findings(t) for t in texts]
    spans = []
    for c, b in zip(codes, base, strict=True):
        found = tokens(c)
        spans.append(np.unique(np.concatenate([found, [(v, e) for _, _, e, v in b]]), axis=0) if b else found)
    out = []
    for b, s, logit in zip(base, spans, net.logits(codes, spans, tables), strict=True):
        said = s[net.probability(logit) >= net.threshold].tolist()
        new = sum(not any(x <= s and e <= y for x, _, y, _ in b) for s, e in said)
        out.append(([x[:3] for x in b], [(s, 3, e) for s, e in said], len(s), new))
    return out


def scan(docs: DataFrame, extra: tuple = (), net: CharNet | None = None) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base findings, their digest, all spans, and the network's counts.

    Spans are kind:start:end in code points, end exclusive, of whole matches, by start
    and then kind; the network's own are of kind model, also where it agrees with a
    base finding. n_model counts them, n_new those that no base finding covers, and
    n_scored the tokens and values that the network scored. Without `net` one is
    trained on docs, all of them.

    A null text counts as empty, and has no spans; the digest of none is that of the
    empty string. A null doc_id stays null; repeated rows each give a row; a text of
    any length is scanned whole, a stretch at a time; an empty table gives an empty
    result. Columns not in `extra` are ignored; `extra` cannot name a column of the result.
    """
    net = net or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            rows = scan_texts(batch.column("text").to_pylist(), sent.value, tables)
            count = [[sum(k == kind for _, k, _ in r[0]) for r in rows] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in count),
                    pa.array([hashlib.sha256(joined(r[0]).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([joined(r[0] + r[1]) for r in rows], pa.string()),
                    *(pa.array(c, pa.int64()) for c in zip(*((len(m), new, n) for _, m, n, new in rows), strict=True)),
                    *(batch.column(c) for c in extra),
                ],
                [*_COLUMNS, *extra],
            )

    if set(extra) & set(_COLUMNS):
        raise ValueError("extra columns cannot be named as those of the result")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    schema = ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in _COLUMNS)
    for c in extra:
        schema += f", `{c}` {picked.schema[c].dataType.simpleString()}"
    return picked.mapInArrow(bounded(run), schema)


_COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_new", "n_scored")


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with every span replaced."""
    out, at = [], 0
    for s, e in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans.split(",") if x)):
        if e > at:
            out += [text[at : max(s, at)], mark if s >= at else ""]
            at = e
    return "".join(out) + text[at:]
