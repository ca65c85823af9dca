"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The model is trained in numpy from labelled spans: at most 800 windows of the corpus (``CORPUS_WINDOWS``)
labelled by the shapes of the patterns, and windows with invented items written into them, many side by
side, where a greedy pattern swallows its neighbour and then drops the match, and many in layouts that no
pattern here has (``joe [at] host (dot) org``, ``10 . 0 . 0 . 1``, ``4532/1234/...``, ``0044 20 ...``). It tags characters
with B/I of four kinds or O.

A text is covered by windows of ``WINDOW`` characters that advance by half of it. Every window with a
digit, ``@`` or spelled-out signs of an address is decoded by Viterbi's algorithm; the others can't hold an
item of any kind, so leaving them out changes nothing. Spans of all windows are reconciled over the whole text: spans cut by a
window's edge yield to whole ones, better scored ones come first, overlaps go, and so does what overlaps a
base span or fails its kind's check (check digit, number ranges, digit counts).

Texts never leave their rows: one pass over the documents without a shuffle. All patterns are written
so that their time is linear in the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolloom.llm import common

KINDS = ("email", "ip", "card", "phone")
WINDOW = 128
SAMPLE, EPOCHS, BATCH = 20_000, 10, 64
#: Corpus windows and windows with invented items that the model is trained on, at most.
CORPUS_WINDOWS, INVENTED_WINDOWS = 800, 2000
#: Windows decoded together.
DECODE = 512

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile("[0-9@]")
#: What a window is decoded for: a digit, ``@``, or an address that spells them out.
_SIGN = re.compile(r"[0-9@]|[\[({] ?(?:at|AT) ?[\])}]|\s(?:at|AT)\s\S+\s(?:dot|DOT)\s")
#: Spelled-out or spaced-out signs of an address, and what stands between the numbers of other kinds.
_AT = re.compile(r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) | @ ?|@ ")
_DOT = re.compile(r" ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) | \. ")
_LOOSE_IP = re.compile(r"[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}")
_LOOSE_CARD = re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9])+")
_LOOSE_PHONE = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,3}[0-9])+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in linear time from one ``@`` to the next."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        begin = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str, checked: bool = True) -> list[tuple[str, int, int]]:
    """(kind, begin, end) by begin, then kind; ``checked``: without matches that fail their kind's check."""
    if not _ANCHOR.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if not checked or all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and (not checked or luhn(digits)):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def passes(kind: str, item: str) -> bool:
    """Whether a span that the model proposes is an item of its kind: its parts, ranges, digits and check digit, not its layout."""
    if kind == "email":
        if emails(item) == [(0, len(item))]:
            return True
        local, at, domain = _AT.sub("@", item).partition("@")
        spelled = f"{local}@{_DOT.sub('.', domain)}"
        return bool(at) and spelled.count("@") == 1 and emails(spelled) == [(0, len(spelled))]
    digits = _digits(item)
    if kind == "ip":
        return bool(_LOOSE_IP.fullmatch(item)) and all(int(p) <= 255 for p in re.findall("[0-9]+", item))
    if kind == "card":
        return bool(_LOOSE_CARD.fullmatch(item)) and 14 <= len(digits) <= 19 and luhn(digits)
    marked = item[0] == "+" or item[:2] == "00" or len(re.findall("[ ()./-]+", item)) >= 2
    return bool(_LOOSE_PHONE.fullmatch(item)) and 10 <= len(digits) <= 15 and marked and item.count("(") == item.count(")") and not _LOOSE_IP.fullmatch(item)


def trimmed(kind: str, text: str, begin: int, end: int) -> int:
    """Begin of a proposed span without what an address can't hold: words before its local part."""
    m = _AT.search(text, begin, end) if kind == "email" else None
    at = m.start() if m else text.find("@", begin, end) if kind == "email" else -1
    return begin if at < 0 else begin + len(re.match(r"(?s)(?:.*\s)?", text[begin:at])[0])


def apart(kind: str, text: str, begin: int, end: int) -> bool:
    """Whether a span is not a piece of a longer number or name."""
    inner = (lambda c: c.isalnum()) if kind == "email" else (lambda c: "0" <= c <= "9")
    return not (begin > 0 and inner(text[begin - 1]) and inner(text[begin])) and not (end < len(text) and inner(text[end]) and inner(text[end - 1]))


_CLASS = np.full(0x110000, 1, np.uint8)
for _k, _chars in enumerate(["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "-", "+", "(", ")", " ", "\n", "_%", ",;:!?", "\"'=/<>[]"]):
    _CLASS[[ord(c) for c in _chars]] = _k + 2
CLASSES, TAGS = 16, 1 + 2 * len(KINDS)
_ALLOWED = np.array([[not (t and t % 2 == 0) or s in (t - 1, t) for t in range(TAGS)] for s in range(TAGS)])
_BARRED = np.where(_ALLOWED, 0, -1e4).astype(np.float32)


def classes(text: str) -> np.ndarray:
    """Class of each character; 0 is left for places beyond the text."""
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, begin, end in spans:
        out[begin:end] = 2 * KINDS.index(kind) + 2
        out[begin] -= 1
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for begin in np.flatnonzero(tags % 2 == 1).tolist():
        if begin < at:
            continue
        at = begin + 1
        while at < len(tags) and tags[at] == tags[begin] + 1:
            at += 1
        out.append((KINDS[(int(tags[begin]) - 1) // 2], begin, at))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    """Bidirectional LSTM over character classes, linear layer, CRF."""

    def __init__(self, embed: int = 8, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

        self.hidden = hidden
        self.p = {"emb": draw(CLASSES, embed), "wx": draw(2, embed, 4 * hidden), "wh": draw(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32), "wo": draw(2 * hidden, TAGS), "bo": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        self.p["b"][:, :, hidden : 2 * hidden] = 1  # forget gates start open

    def _forward(self, x: np.ndarray, keep: bool = False):
        """Emissions (windows, places, tags) of classes (windows, places); both directions in one loop."""
        p, h = self.p, self.hidden
        both = np.stack((x.T, x.T[::-1]))  # direction, place, window
        e = p["emb"][both]
        zx = np.einsum("dtbe,dek->dtbk", e, p["wx"], optimize=True) + p["b"][:, None]
        state = np.zeros((2, x.shape[0], h), np.float32)
        cell = np.zeros_like(state)
        steps, out = [], np.empty((2, x.shape[1], x.shape[0], h), np.float32)
        for t in range(x.shape[1]):
            z = zx[:, t] + state @ p["wh"]
            gates = _sigmoid(z[..., : 3 * h])
            g = np.tanh(z[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            old, before = cell, state
            cell = f * old + i * g
            tc = np.tanh(cell)
            # places beyond the text leave no trace, so a short text is read like a long one
            live = (both[:, t] != 0)[..., None].astype(np.float32)
            state, cell = o * tc * live, cell * live
            out[:, t] = state
            if keep:
                steps.append((i, f, o, g, old, tc, before, live))
        joined = np.concatenate((out[0], out[1, ::-1]), axis=2)  # place, window, 2 hidden
        return (joined @ p["wo"] + p["bo"]).transpose(1, 0, 2), (both, e, steps, joined)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags, and its gradients."""
        p, h = self.p, self.hidden
        em, (both, e, steps, joined) = self._forward(x, keep=True)
        n, places, _ = em.shape
        trans = p["trans"] + _BARRED
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = p["first"] + em[:, 0]
        for t in range(1, places):
            alpha[:, t] = _sum_exp(alpha[:, t - 1, :, None] + trans, 1) + em[:, t]
        for t in range(places - 2, -1, -1):
            beta[:, t] = _sum_exp(trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _sum_exp(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = p["first"][y[:, 0]] + em[rows, np.arange(places), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        d_em = np.exp(alpha + beta - total[:, None, None])
        d = {"first": d_em[:, 0].sum(0)}
        np.subtract.at(d["first"], y[:, 0], 1)
        pair = np.exp(alpha[:, :-1, :, None] + trans + (em + beta)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d["trans"] = np.where(_ALLOWED, pair, 0)
        d_em[rows, np.arange(places), y] -= 1
        d_em = d_em.transpose(1, 0, 2) / n
        d["first"], d["trans"] = d["first"] / n, d["trans"] / n
        d["bo"] = d_em.sum((0, 1))
        d["wo"] = joined.reshape(-1, 2 * h).T @ d_em.reshape(-1, TAGS)
        d_joined = d_em @ p["wo"].T
        d_out = np.stack((d_joined[..., :h], d_joined[::-1, :, h:]))
        d_zx = np.empty((2, places, n, 4 * h), np.float32)
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        d["wh"] = np.zeros_like(p["wh"])
        for t in range(places - 1, -1, -1):
            i, f, o, g, old, tc, before, live = steps[t]
            ds = (d_out[:, t] + d_state) * live
            dc = ds * o * (1 - tc * tc) + d_cell * live
            z = np.concatenate((dc * g * i * (1 - i), dc * old * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)), axis=2)
            d_zx[:, t] = z
            d["wh"] += before.transpose(0, 2, 1) @ z
            d_state, d_cell = z @ p["wh"].transpose(0, 2, 1), dc * f
        d["b"] = d_zx.sum((1, 2))[:, None]
        d["wx"] = np.einsum("dtbe,dtbk->dek", e, d_zx, optimize=True)
        d_e = np.einsum("dtbk,dek->dtbe", d_zx, p["wx"], optimize=True)
        d["emb"] = np.zeros_like(p["emb"])
        np.add.at(d["emb"], both, d_e)
        return float((total - gold).mean()), d

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for epoch in range(epochs):
            order, loss = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                now, d = self._gradients(x[rows], y[rows])
                loss += now * len(rows)
                norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
                scale, step = min(1.0, 5.0 / max(norm, 1e-9)), step + 1
                speed = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
                for k, g in d.items():
                    g = (g * scale).astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(loss / len(x))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and how far each place's tag is ahead of O."""
        em, _ = self._forward(x)
        n, places, _ = em.shape
        trans, score = self.p["trans"] + _BARRED, self.p["first"] + em[:, 0]
        back = np.zeros((places, n, TAGS), np.int8)
        for t in range(1, places):
            options = score[:, :, None] + trans
            back[t] = options.argmax(1)
            score = options.max(1) + em[:, t]
        tags = np.empty((n, places), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(places - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
        margin = np.take_along_axis(em, tags[..., None], 2)[..., 0] - em[..., 0]
        return tags, margin


def windows(text: str) -> Iterator[int]:
    """Begins of the windows of a text in which a sign of an item begins."""
    step, last = WINDOW // 2, -1
    for m in _SIGN.finditer(text):
        for k in (m.start() // step - 1, m.start() // step):
            if k >= 0 and k > last:
                last = k
                yield k * step


def reconcile(text: str, proposed: list[tuple[str, int, int, float, bool]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed (kind, begin, end, score, cut) that pass and overlap neither a base span nor a better one."""
    taken: list[tuple[int, int]] = sorted((a, b) for _, a, b in base)
    out = []
    for kind, a, b, _, _ in sorted(set(proposed), key=lambda s: (s[4], -round(s[3], 3), s[1], s[2], s[0])):
        a = trimmed(kind, text, a, b)
        if apart(kind, text, a, b) and passes(kind, text[a:b]) and not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda s: s[1])


def find(texts: list[str], model: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, added spans) of whole texts."""
    found = [base_spans(t) for t in texts]
    proposed: dict[int, list[tuple[str, int, int, float, bool]]] = {}
    pending: list[tuple[int, int]] = []

    def flush():
        if not pending:
            return
        x = np.zeros((len(pending), WINDOW), np.uint8)
        for row, (i, begin) in enumerate(pending):
            part = classes(texts[i][begin : begin + WINDOW])
            x[row, : len(part)] = part
        tags, margin = model.decode(x)
        for row, (i, begin) in enumerate(pending):
            size = min(WINDOW, len(texts[i]) - begin)
            for kind, a, b in spans_of(tags[row, :size]):
                cut = (a == 0 and begin > 0) or (b == size and begin + size < len(texts[i]))
                proposed.setdefault(i, []).append((kind, begin + a, begin + b, float(margin[row, a:b].mean()), cut))
        pending.clear()

    for i, text in enumerate(texts):
        for begin in windows(text):
            pending.append((i, begin))
            if len(pending) == DECODE:
                flush()
    flush()
    return [(base, reconcile_blocks(texts[i], proposed[i], base) if i in proposed else []) for i, base in enumerate(found)]


def reconcile_blocks(text: str, proposed: list[tuple[str, int, int, float, bool]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``reconcile`` for each run of spans that overlap one another, so that time follows the number of spans."""
    items = sorted([*((a, b, s) for s in proposed for _, a, b, _, _ in [s]), *((a, b, None) for _, a, b in base)], key=lambda s: s[:2])
    out, run, low, end = [], [], [], -1
    for a, b, s in [*items, (1 << 62, 1 << 62, None)]:
        if a >= end and (run or low):
            out += reconcile(text, run, [("", x, y) for x, y in low]) if run else []
            run, low = [], []
        run, low = (run + [s], low) if s else (run, low + [(a, b)])
        end = max(end, b)
    return out


def _invented(rng: np.random.Generator) -> tuple[str, str]:
    """An item and its kind."""

    def number(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def name(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))

    kind, broken = KINDS[rng.integers(len(KINDS))], rng.random() < 0.4
    if kind == "email":
        local = name(rng.integers(2, 9)) + rng.choice(["", "." + name(rng.integers(1, 6)), "_" + name(3), "-" + number(2), number(2)])
        host, end = name(rng.integers(3, 8)) + rng.choice(["", number(1)]), rng.choice(["com", "org", "example.com", "net", "co.uk", "de"])
        at, dot = rng.choice(["[at]", "(at)", " [at] ", " (at) ", " @ ", "@ "]) if broken else "@", "."
        if broken and rng.random() < 0.5:
            at = rng.choice([" at ", "(at)", "[at]", " [at] ", " (at) "])
            dot = " dot " if at == " at " else rng.choice(["(dot)", "[dot]", " [dot] ", " (dot) "])
            end = end.replace(".", str(dot))
        return kind, f"{local}{at}{host}{dot}{end}"
    if kind == "ip":
        return kind, str(rng.choice([" . ", "[.]", "(.)", " .", ". "]) if broken else ".").join(map(str, rng.integers(0, rng.choice([10, 256], 4))))
    if kind == "card":
        sign = str(rng.choice([".", "/", "  ", "_", " - "])) if broken else str(rng.choice(["", "-", " "]))
        return kind, number(15) if not broken and rng.random() < 0.2 else sign.join(number(4) for _ in range(4))
    if broken:
        return kind, str(rng.choice([f"00{rng.integers(1, 99)} {number(3)} {number(3)} {number(4)}", f"+{rng.integers(1, 99)} (0) {number(3)}/{number(3)}-{number(4)}", f"({number(3)})/{number(3)}/{number(4)}", f"+{rng.integers(1, 99)}/{number(3)}/{number(7)}"]))
    return kind, str(rng.choice([f"+{rng.integers(1, 99)} ({number(3)}) {number(3)}-{number(4)}", f"+{rng.integers(1, 99)} {number(3)} {number(3)} {number(4)}", f"+{number(11)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+1.{number(3)}.{number(3)}.{number(4)}"]))


def training_set(snippets: list[str], invented: int = INVENTED_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of windows: snippets labelled by shape, and snippets with invented items."""
    rng, rows = np.random.default_rng(seed), []
    for text in snippets[:CORPUS_WINDOWS]:
        spans, end = [], 0
        for kind, a, b in base_spans(text, checked=False):
            if a >= end:
                spans.append((kind, a, b))
                end = b
        rows.append((text, spans))
    plain = [re.sub("[0-9@+]", "", s) for s in snippets] or ["And then it was there, as ever, in the old house of the town.\nSo it went"]
    for _ in range(invented):
        text = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, max(1, min(len(text), WINDOW - 60))))
        head, tail, spans = text[:at], text[at:], []
        if head and head[-1].isalnum():
            head += " "
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            kind, item = _invented(rng)
            spans.append((kind, len(head), len(head) + len(item)))
            head += item + str(rng.choice([" ", " ", " ", ", ", "; ", "\n", ". "]))
        if rng.random() < 0.3:  # numbers that are nothing of the kind
            head += rng.choice(["3.", "version 2.0 ", f"{rng.integers(1900, 2100)} ", f"{rng.integers(1, 99999)} ", f"{rng.integers(1, 99)},{rng.integers(100, 999)}.5 ", f"v{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)} "])
        rows.append((head + tail, spans))
    x, y = np.zeros((len(rows), WINDOW), np.uint8), np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(rows):
        part = classes(text[:WINDOW])
        x[k, : len(part)] = part
        y[k] = tags_of(max(WINDOW, len(text) + 1), spans)[:WINDOW]
    return x, y


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger trained on ``CORPUS_WINDOWS`` windows at most, and ``INVENTED_WINDOWS`` with invented items.

    Windows are drawn by hash among those of about ``sample`` documents, each around the first digit or @ of its text.
    """
    share = max(1, docs.count() // sample)
    drawn = docs.select(F.col("text")).where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(share)) == 0).where(F.col("text").rlike("[0-9@]"))
    snippet = F.regexp_extract("text", "(?s).{0,60}[0-9@].{0,67}", 0).alias("snippet")
    snippets = [r["snippet"] for r in drawn.select(snippet).distinct().orderBy(F.xxhash64("snippet"), "snippet").limit(CORPUS_WINDOWS).collect()]
    model = Tagger()
    model.train(*training_set(snippets))
    return model


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def report(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for each row of ``docs(doc_id, text, ...)``.

    Counts and digest are of the base spans; ``spans`` holds base and added ones. Null text counts as empty;
    null or repeated doc_ids stay rows of their own; an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # some kilobytes
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def search(batches):
        common.own_cache("pii")
        for batch in batches:
            found = find([x or "" for x in batch.column("text").to_pylist()], held.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([_joined(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) for base, more in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, spans, pa.array([len(more) for _, more in found], pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by their kinds; overlapping spans are one, of the first's kind."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in reversed(merged):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data masked, same columns and rows; ``n_chars``, where there is one, follows the text.

    Null texts stay null, empty ones empty; null or repeated doc_ids stay rows of their own; an empty table gives no
    rows; other columns stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def cut(batches):
        common.own_cache("pii")
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            texts = columns["text"].to_pylist()
            found = find([x or "" for x in texts], held.value)
            columns["text"] = pa.array([mask(x, base + more) if base or more else x for x, (base, more) in zip(texts, found, strict=True)], columns["text"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = docs.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
