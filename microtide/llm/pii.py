"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF, in numpy.

The tagger is trained from labelled spans: those of the patterns in a bounded sample of texts,
and variants written from them that no pattern matches (addresses spelt out, defanged hosts,
numbers with other separators, phone numbers without a plus sign). It reads texts in
overlapping windows; the emissions of all windows are averaged per character, weighted by the
distance from the window's edge. Where O leads by more than LEAD it stands; every stretch
between is decoded by the CRF at once, over the windows it lies in. What has the form of a
pattern was judged by that pattern, and isn't added. Every text is searched whole for the at
signs and digits without which a span isn't plausible; only the windows that these and the
stretches around them lie in are read, which gives what reading all windows gives.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: No match begins inside a run of digits: what fails at the run's start fails there too.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]+")

TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: Windows of texts and of training pieces.
WINDOW, STRIDE, PIECE = 256, 224, 96
EMBED, HIDDEN = 10, 12
#: Distinct texts trained on (at most twice as many), spans of a text that are used, steps, pieces a step, learning rate.
SAMPLE, SPANS, STEPS, BATCH, RATE = 3000, 4, 320, 64, 0.01
#: Lead of O that needs no decoding, characters around others that are decoded, and the least mean probability of a span.
LEAD, AROUND, SURE = 0.5, 8, 0.3
_CLASSES = "@.-+()_% ,:/=\"'*#$&|\n"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the at signs in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and non-overlapping per kind."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    if ANCHOR.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def classes(text: str) -> np.ndarray:
    """Per character: digit 1, lower 2, upper 3, other letter or sign 4, then one class per mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.full(128, 4, np.int8)
    of[48:58], of[97:123], of[65:91] = 1, 2, 3
    for i, c in enumerate(_CLASSES):
        of[ord(c)] = 5 + i
    return of[np.minimum(codes, 127)] * (codes < 127) + 4 * (codes >= 127).astype(np.int8)


N_CLASSES = 5 + len(_CLASSES)


def windows(length: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of the windows that cover a text."""
    return list(range(0, max(1, length - window + stride), stride))


def _cut(x: np.ndarray, start: int, window: int = PIECE) -> np.ndarray:
    out = np.zeros(window, np.int8)
    part = x[start : start + window]
    out[: len(part)] = part
    return out


class Tagger:
    """Embedding, two LSTM directions, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        s = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": s(N_CLASSES, EMBED)}
        for d in "fb":
            self.p["w" + d] = s(EMBED + HIDDEN, 4 * HIDDEN)
            self.p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"], self.p["ob"], self.p["t"] = s(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) of one direction over embedded input (T, B, E)."""
        w, bias, h_n = self.p["w" + d], self.p["c" + d], HIDDEN
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], h_n), np.float32)
        out, tape = np.empty((len(x), x.shape[1], h_n), np.float32), []
        xs = x @ w[:EMBED] + bias
        for t in steps:
            g = xs[t] + h @ w[EMBED:]
            i, f, o = self._sig(g[:, :h_n]), self._sig(g[:, h_n : 2 * h_n]), self._sig(g[:, 2 * h_n : 3 * h_n])
            u = np.tanh(g[:, 3 * h_n :])
            c0, h0 = c, h
            c = f * c0 + i * u
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((t, i, f, o, u, c0, h0, tc))
        return out, tape

    def emit(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (T, B, TAGS) of windows (B, T)."""
        x = self.p["e"][ids.T]
        f, ft = self._run(x, "f", keep)
        b, bt = self._run(x, "b", keep)
        h = np.concatenate([f, b], 2)
        return h @ self.p["o"] + self.p["ob"], (x, h, ft, bt)

    def _crf(self, em: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood per window and its gradients, by forward and backward sums."""
        n_t, n_b, _ = em.shape
        tr = self.p["t"]
        a, b = np.empty_like(em), np.zeros_like(em)
        a[0] = em[0]
        lse = lambda z, axis: (m := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis))
        for t in range(1, n_t):
            a[t] = em[t] + lse(a[t - 1][:, :, None] + tr, 1)
        for t in range(n_t - 2, -1, -1):
            b[t] = lse(tr[None] + (em[t + 1] + b[t + 1])[:, None, :], 2)
        z = lse(a[-1], 1)
        d_em = np.exp(a + b - z[None, :, None])
        d_tr = np.zeros_like(tr)
        for t in range(1, n_t):
            d_tr += np.exp(a[t - 1][:, :, None] + tr + (em[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n_b)
        gold = np.zeros(n_b)
        for t in range(n_t):
            gold += em[t, rows, y[:, t]]
            d_em[t, rows, y[:, t]] -= 1
            if t:
                gold += tr[y[:, t - 1], y[:, t]]
                np.add.at(d_tr, (y[:, t - 1], y[:, t]), -1)
        return float((z - gold).mean()), d_em / n_b, d_tr / n_b

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        em, (x, h, ft, bt) = self.emit(ids, keep=True)
        loss, d_em, d_tr = self._crf(em, y)
        g = {"t": d_tr, "o": np.einsum("tbh,tbk->hk", h, d_em), "ob": d_em.sum((0, 1))}
        dh_all = d_em @ self.p["o"].T
        dx = np.zeros_like(x)
        for d, tape, dh_out in (("f", ft, dh_all[..., :HIDDEN]), ("b", bt, dh_all[..., HIDDEN:])):
            w = self.p["w" + d]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p["c" + d])
            dh_next = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, u, c0, h0, tc in reversed(tape):
                dh = dh_out[t] + dh_next
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
                gw[:EMBED] += x[t].T @ dg
                gw[EMBED:] += h0.T @ dg
                gb += dg.sum(0)
                dx[t] += dg @ w[:EMBED].T
                dh_next, dc = dg @ w[EMBED:].T, dc * f
            g["w" + d], g["c" + d] = gw, gb
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], ids.T, dx)
        return loss, g

    def fit(self, ids: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> list[float]:
        """Adam on random batches; the losses are returned."""
        r, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for k in range(1, steps + 1):
            at = r.integers(0, len(ids), batch)
            loss, g = self.gradients(ids[at], y[at])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * min(1.0, 2 * (1 - k / (steps + 1)))
            for n, x in g.items():
                x = x * min(1.0, 5 / max(norm, 1e-9))
                m[n] = 0.9 * m.get(n, 0) + 0.1 * x
                v[n] = 0.99 * v.get(n, 0) + 0.01 * x * x
                self.p[n] -= (rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def decode(self, em: np.ndarray) -> np.ndarray:
        """The best tag sequence of (T, TAGS) scores."""
        score, back = em[0], np.zeros(em.shape, np.int8)
        for t in range(1, len(em)):
            z = score[:, None] + self.p["t"]
            back[t] = z.argmax(0)
            score = z.max(0) + em[t]
        tags = np.empty(len(em), np.int8)
        tags[-1] = score.argmax()
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


_EDGE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


class Reader:
    """A trained tagger's emissions, fast: embeddings are folded into a table of gate inputs, and all gates are one tanh."""

    def __init__(self, tagger: Tagger):
        half = np.concatenate([np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        self.tagger, p = tagger, tagger.p
        self.table = {d: ((p["e"] @ p["w" + d][:EMBED] + p["c" + d]) * half).astype(np.float32) for d in "fb"}
        self.inner = {d: np.ascontiguousarray((p["w" + d][EMBED:] * half).astype(np.float32)) for d in "fb"}

    def emit(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (T, B, TAGS) of windows (T, B)."""
        n_t, n_b = ids.shape
        out = np.empty((n_t, n_b, 2 * HIDDEN), np.float32)
        for at, d in enumerate("fb"):
            table, inner = self.table[d], self.inner[d]
            h, c = np.zeros((n_b, HIDDEN), np.float32), np.zeros((n_b, HIDDEN), np.float32)
            for t in range(n_t) if d == "f" else range(n_t - 1, -1, -1):
                g = h @ inner
                g += table[ids[t]]
                np.tanh(g, out=g)
                s = g[:, : 3 * HIDDEN]
                s *= 0.5
                s += 0.5
                c *= g[:, HIDDEN : 2 * HIDDEN]
                c += g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
                h = np.tanh(c)
                h *= g[:, 2 * HIDDEN : 3 * HIDDEN]
                out[t, :, at * HIDDEN : (at + 1) * HIDDEN] = h
        return out @ self.tagger.p["o"] + self.tagger.p["ob"]

    @staticmethod
    def stretches(total: np.ndarray, weight: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
        """First and last character of the stretches where O doesn't lead, among the ``known`` characters."""
        by_tag = np.ascontiguousarray(total.T)
        is_open = by_tag[1:].max(0) - by_tag[0] > -LEAD * weight[:, 0]
        open_ = np.flatnonzero(is_open if known is None else is_open & known)
        if not len(open_):
            return []
        cuts = np.flatnonzero(np.diff(open_) > 2 * AROUND)
        return list(zip(open_[np.concatenate([[0], cuts + 1])].tolist(), open_[np.concatenate([cuts, [len(open_) - 1]])].tolist(), strict=True))

    def spans(self, total: np.ndarray, weight: np.ndarray, among: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, sureness) from a text's weighted sums of emissions (T, TAGS) and weights (T, 1), in all stretches or those of ``among``."""
        found = []
        for a, b in self.stretches(total, weight) if among is None else among:
            a, b = max(0, int(a) - AROUND), min(len(total), int(b) + 1 + AROUND)
            part = total[a:b] / weight[a:b]
            tags = self.tagger.decode(part)
            p = np.exp(part - part.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            i = 0
            while i < len(tags):
                j = i + 1
                if tags[i] % 2 == 1:
                    while j < len(tags) and tags[j] == tags[i] + 1:
                        j += 1
                    found.append(((int(tags[i]) - 1) // 2, a + i, a + j, float(p[np.arange(i, j), tags[i:j]].mean())))
                i = j
        return found


def _seeded(stretch: tuple[int, int], seeds: np.ndarray) -> bool:
    at = np.searchsorted(seeds, stretch[0] - AROUND)
    return at < len(seeds) and seeds[at] <= stretch[1] + AROUND


def tag_texts(tagger: Tagger, texts: list[str], batch: int = 1024, seeds: list[np.ndarray] | None = None) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, sureness) of the tagged spans of each text, read as a whole.

    With sorted ``seeds`` (positions per text), of the stretches that hold a seed: the windows
    around the seeds are read, then those that such a stretch reaches, until all of it is known.
    What is found is what the whole reading finds there.
    """
    reader = Reader(tagger)
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    jobs: list[tuple[int, int]] = []
    ids: dict[int, np.ndarray] = {}
    held: dict[int, list] = {}  # text: summed emissions, weights, windows to come, starts of unread windows

    def ask(k: int, wanted: np.ndarray) -> None:
        """Reads the windows that hold a wanted character."""
        before = np.concatenate([[0], np.cumsum(wanted)])
        unread = held[k][3]
        now = [s for s in unread if before[min(len(wanted), s + WINDOW)] > before[s]]
        held[k][2], held[k][3] = len(now), [s for s in unread if s not in set(now)] if len(now) < len(unread) else []
        jobs.extend((k, s) for s in now)

    def settle(k: int) -> None:
        """All windows asked for are read: the text is done, or its stretches reach further."""
        total, weight, _, unread = held[k]
        among = None
        if seeds is not None:
            known = np.ones(len(total), bool)
            for s in unread:
                known[s : s + WINDOW] = False
            among = [x for x in reader.stretches(total, weight, known) if _seeded(x, seeds[k])]
            wanted = np.zeros(len(total), bool)
            for a, b in among:
                wanted[max(0, a - 2 * AROUND) : b + 2 * AROUND + 1] = True
            if (wanted & ~known).any():
                return ask(k, wanted & ~known)
        found[k] = reader.spans(total, weight, among)
        del held[k], ids[k]

    def flush(size: int) -> None:
        now, jobs[:size] = jobs[:size], []
        em = reader.emit(np.array([_cut(ids[k], s, WINDOW) for k, s in now]).T)
        for n, (k, s) in enumerate(now):
            size = min(WINDOW, len(ids[k]) - s)
            total, weight = held[k][:2]
            total[s : s + size] += em[:size, n] * _EDGE[:size]
            weight[s : s + size] += _EDGE[:size]
            held[k][2] -= 1
            if not held[k][2]:
                settle(k)

    for k, t in enumerate(texts):
        if not t or seeds is not None and not len(seeds[k]):
            continue
        ids[k] = classes(t)
        held[k] = [np.zeros((len(t), TAGS), np.float32), np.zeros((len(t), 1), np.float32), 0, windows(len(t))]
        wanted = np.ones(len(t), bool)
        if seeds is not None:
            wanted[:] = False
            for at in seeds[k]:
                wanted[max(0, at - AROUND) : at + AROUND + 1] = True
        ask(k, wanted)
        while len(jobs) >= batch:
            flush(batch)
    while jobs:
        flush(batch)
    return found


#: Spans that the patterns themselves decide on.
FORMS = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), CARD, PHONE)


#: What stands for the at sign, and a name's parts around what stands for the dot, in an address written otherwise.
AT_SIGN = re.compile(r"@|[(\[ ]at[)\] ]", re.I)
HOST = re.compile(r"[A-Za-z0-9-]\s*(?:\.|[(\[ ]+dot[)\] ]+)\s*[A-Za-z]", re.I)


def plausible(kind: int, span: str) -> bool:
    """Whether a span that the tagger found has the parts of its kind: name, at and dotted host; four numbers up to 255; 13 to 19 digits passing Luhn; 9 to 15 digits."""
    numbers = re.findall(r"[0-9]+", span)
    digits = "".join(numbers)
    if kind == 0:
        m = AT_SIGN.search(span)
        return bool(m and re.search(r"[A-Za-z0-9]", span[: m.start()]) and HOST.search(span[m.end() :]))
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


#: Every place where AT_SIGN matches, also where matches overlap.
AT_PLACES = re.compile(f"(?={AT_SIGN.pattern})", re.I)


def seeds_of(text: str, own: list[tuple[int, int, int]]) -> np.ndarray:
    """Sorted positions of which every span that is ``plausible`` and overlaps none of ``own`` holds one.

    Such a span has an at sign or what stands for it, or 9 digits on end but for what is between them, or
    parts of 4 numbers on end: so one of every 9th digit of the text, or an end of every 4th number.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digits = np.flatnonzero((codes >= 48) & (codes <= 57))
    first = digits[np.diff(digits, prepend=-2) > 1]
    last = digits[np.diff(digits, append=len(codes) + 1) > 1]
    out = np.unique(np.concatenate([digits[8::9], first[3::4], last[3::4], [m.start() for m in AT_PLACES.finditer(text)]]).astype(np.int64))
    for _, s, e in own:
        out = out[(out < s) | (out >= e)]
    return out


def variants(kind: int, span: str) -> list[str]:
    """Writings of a span that no pattern matches."""
    if kind == 0:
        name, _, host = span.partition("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host}", f"{name} @ {host}"]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", "(.)")]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [x.join(groups) for x in ("_", ".", "/", " - ")]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}"]


def labelled(text: str, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled pieces of a text, drawn by the seed from all of it: around spans, the same with variants, around other digits, and plain ones."""
    r, spans, out = random.Random(seed), base_spans(text), []

    def piece(s: int, e: int) -> tuple[int, int] | None:
        a, b = max(0, s - r.randint(2, 45)), min(len(text), e + r.randint(2, 45))
        return None if any(x < a < y or x < b < y for _, x, y in spans) else (a, b)

    for k, s, e in r.sample(spans, min(SPANS, len(spans))):
        at = piece(s, e)
        if at is None:
            continue
        a, b = at
        own = [(i, x - a, y - a) for i, x, y in spans if a <= x and y <= b]
        out.append((text[a:b], own))
        for v in r.sample(variants(k, text[s:e]), 2):
            moved = len(v) - (e - s)
            out.append((text[a:s] + v + text[e:b], [(i, x + moved * (x >= e - a), y + moved * (y >= e - a)) for i, x, y in own]))
    # Long numbers and at signs that no pattern matches may be personal data written otherwise: no counter-examples.
    few = lambda at: sum("0" <= c <= "9" for c in text[max(0, at - 16) : at + 16]) <= 5
    marks = [m.start() for m in ANCHOR.finditer(text) if "@" not in m[0] and few(m.start())]
    for s in [*r.sample(marks, min(1, len(marks))), r.randrange(len(text))]:
        at = piece(s, s)
        if at:
            a, b = at
            out.append((text[a:b], [(i, x - a, y - a) for i, x, y in spans if a <= x and y <= b]))
    return out


def _tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int8)
    for k, s, e in spans:
        if not y[s:e].any():
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
    return y


def _examples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for order, text in zip(frame["order"], frame["text"], strict=True):
            for i, (piece, spans) in enumerate(labelled(text, order)):
                x, y = classes(piece), _tags(len(piece), spans)
                for start in windows(len(piece), PIECE, PIECE - 32):
                    rows.append((order, i, start, _cut(x, start).tobytes(), _cut(y, start).tobytes()))
        if rows:
            yield pd.DataFrame(rows, columns=["order", "i", "start", "x", "y"])


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["order", "i", "start"])
    read = lambda c: np.array([np.frombuffer(v, np.int8) for v in frame[c]])
    tagger = Tagger()
    tagger.fit(read("x"), read("y"))
    names = sorted(tagger.p)
    return pd.DataFrame({"name": names, "shape": [list(tagger.p[n].shape) for n in names], "value": [tagger.p[n].astype(np.float32).tobytes() for n in names]})


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger from about ``sample`` distinct texts that hold a digit or an at sign, twice as many at most; None without any."""
    texts = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    n = texts.count()
    if not n:
        return None
    order = F.xxhash64("text")
    chosen = texts.where(F.pmod(order, F.lit(1 << 30)) < F.lit(min(1.0, sample / n) * (1 << 30))).select(order.alias("order"), "text")
    # Copies of a text count once in the sample, however many there are.
    chosen = chosen.groupBy("order").agg(F.min("text").alias("text")).orderBy("order").limit(2 * sample)
    examples = chosen.mapInPandas(_examples, "order long, i int, start int, x binary, y binary").withColumn("all", F.lit("all"))
    rows = examples.groupBy("all").applyInPandas(_fit, "name string, shape array<int>, value binary").collect()
    if not rows:
        return None
    tagger = Tagger()
    tagger.p = {r["name"]: np.frombuffer(r["value"], np.float32).reshape(r["shape"]).copy() for r in rows}
    return tagger


def _find(model) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = model.value
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            base = [base_spans(t) for t in texts]
            extra = tag_texts(tagger, texts, seeds=[seeds_of(t, own) for t, own in zip(texts, base, strict=True)]) if tagger else [[] for _ in texts]
            listed, counts, shas = [], [], []
            for text, own, more in zip(texts, base, extra, strict=True):
                add = [(k, s, e) for k, s, e, sure in more if sure >= SURE and not FORMS[k].fullmatch(text[s:e]) and plausible(k, text[s:e]) and not any(s < y and x < e for _, x, y in own)]
                listed.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(own + add)))
                shas.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(own)))
                counts.append([sum(k == x for k, _, _ in own) for x in range(len(KINDS))])
            made = {"doc_id": frame["doc_id"], "base": shas, "spans": listed}
            made |= {f"n_{k}": np.array([c[i] for c in counts], np.int64) for i, k in enumerate(KINDS)}
            yield pd.DataFrame(made)

    return run


def find(docs: DataFrame, sample: int = SAMPLE, learn: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the patterns' spans; ``spans`` has the tagger's as well, where they
    are plausible for their kind and don't overlap one of those. The tagger learns from the texts of ``learn``, by default
    ``docs``. Null and empty texts have no spans and the digest of the empty string; repeated
    rows are reported each; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs if learn is None else learn, sample))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)
    out = docs.select("doc_id", "text").mapInPandas(_find(model), schema)
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
