"""Personal data: patterns with checks, and a character model that adds spans.

The base spans come from four patterns over the whole text. The model is a
bidirectional LSTM over character kinds with CRF transitions between tags (outside;
begin and inside of each kind), trained in numpy on the base spans of a bounded
sample (``max_windows`` windows, picked by a hash of the row). What it is to add are
the forms that the patterns do not know, so windows with a base span are learnt
``COPIES`` times more with their spans written in such a form (``rewritten``). Every span of the
four kinds holds a digit or an @, so only windows around those characters are decoded:
runs closer than ``MARGIN`` are one stretch, stretches longer than ``WINDOW`` are
overlapping windows moved by half of it. Windows are decoded together by Viterbi,
and reconciled over the whole text: every position takes its tag from the window
whose middle is nearest, and spans are read off the joined tags.

A model span is added where it meets no base span, is no failed match of its own
kind's pattern and no piece of a failed one of 13 digits or more, cuts no run of digits, and holds what its kind needs (digits; Luhn for
cards; four numbers up to 255 for ip). Positions are code points, end exclusive. A null text counts as empty; rows without ``doc_id`` and rows that repeat
one are scanned each. Without any base span to learn from there is no model and
nothing is added. Only the two named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL_CHAR = np.zeros(128, bool)
LOCAL_CHAR[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
LOCAL_CHAR = LOCAL_CHAR.tolist()
TRIGGER = re.compile(r"[0-9@]")
MARGIN, WINDOW = 20, 64
COPIES, STEPS, BATCH = 3, 600, 64
LOOSE = re.compile(r"@|([0-9][^0-9A-Za-z\n]{0,3}){8}[0-9]|([0-9]+[^0-9A-Za-z\n]{0,2}\.[^0-9A-Za-z\n]{0,2}){3}[0-9]")
TAGS = 1 + 2 * len(KINDS)
_PLAIN = 15
CHAR_KIND = np.full(128, _PLAIN, np.uint8)
for _k, _chars in enumerate((
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " ", "\n\t\r", ".", "@", "+", "-", "(", ")", "_%", ",;:!?", "=\"'", "/\\",
)):
    CHAR_KIND[[ord(c) for c in _chars]] = _k
CHAR_KINDS = 18  # 16: not ASCII, 17: past the end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def passes(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = re.sub(r"[^0-9]", "", match)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, found from each @, so that plain text costs one search."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and LOCAL_CHAR[min(ord(text[begin - 1]), 127)]:
            begin -= 1
        match = PATTERNS["email"].match(text, begin) if begin < at else None
        if match:
            yield match.span()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(kind, start, end)`` of the matches that pass, by kind and start; and of those that fail."""
    found, failed = [], []
    for k, kind in enumerate(KINDS):
        spans = _emails(text) if kind == "email" else (m.span() for m in PATTERNS[kind].finditer(text))
        for a, b in spans:
            if passes(kind, text[a:b]):
                found.append((k, a, b))
            else:
                failed.append((k, a, b))
    return found, failed


def windows(text: str) -> list[tuple[int, int]]:
    """The windows to decode: all that is within ``MARGIN`` of a digit or @."""
    out: list[tuple[int, int]] = []
    begin = end = None
    for match in TRIGGER.finditer(text):
        at = match.start()
        if end is not None and at - MARGIN <= end:
            end = at + MARGIN + 1
            continue
        if end is not None:
            out.append((begin, min(end, len(text))))
        begin, end = max(0, at - MARGIN), at + MARGIN + 1
    if end is not None:
        out.append((begin, min(end, len(text))))
    cut = []
    for a, b in out:
        while b - a > WINDOW:
            cut.append((a, a + WINDOW))
            a += WINDOW // 2
        cut.append((a, b))
    return cut


def char_kinds(texts: list[str]) -> np.ndarray:
    """``len(texts)`` rows of ``WINDOW`` character kinds."""
    out = np.full((len(texts), WINDOW), CHAR_KINDS - 1, np.uint8)
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[row, : len(codes)] = np.where(codes < 128, CHAR_KIND[np.minimum(codes, 127)], CHAR_KINDS - 2)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    """Embedding, one LSTM in either direction, a linear layer to tags, CRF transitions."""

    def __init__(self, hidden: int = 20, embed: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"embed": rng.normal(0, 0.5, (CHAR_KINDS, embed)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 0.25, (embed + hidden, 4 * hidden))
            self.p[f"v{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States of one direction; ``x`` is (time, rows, embed)."""
        w, v, n = self.p[f"w{side}"], self.p[f"v{side}"], self.hidden
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, kept = np.empty((*x.shape[:2], n), np.float32), [None] * len(x)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = np.concatenate([x[t], h], 1)
            g = z @ w + v
            gates, new = _sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
            before = c
            c = gates[:, n : 2 * n] * c + gates[:, :n] * new
            squashed = np.tanh(c)
            h = gates[:, 2 * n :] * squashed
            out[t], kept[t] = h, (z, gates, new, before, squashed)
        return out, kept

    def _back(self, d_out: np.ndarray, kept: list, side: str, grads: dict) -> np.ndarray:
        w, n = self.p[f"w{side}"], self.hidden
        dh = dc = np.zeros(d_out.shape[1:], np.float32)
        dx = np.empty((*d_out.shape[:2], w.shape[0] - n), np.float32)
        for t in range(len(d_out) - 1, -1, -1) if side == "f" else range(len(d_out)):
            z, gates, new, before, squashed = kept[t]
            dh = dh + d_out[t]
            dc = dc + dh * gates[:, 2 * n :] * (1 - squashed**2)
            d_gates = np.concatenate([dc * new, dc * before, dh * squashed], 1) * gates * (1 - gates)
            dg = np.concatenate([d_gates, dc * gates[:, :n] * (1 - new**2)], 1)
            grads[f"w{side}"] += z.T @ dg
            grads[f"v{side}"] += dg.sum(0)
            dz = dg @ w.T
            dx[t], dh, dc = dz[:, :-n], dz[:, -n:], dc * gates[:, n : 2 * n]
        return dx

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of tags, (time, rows, tags), of windows of character kinds."""
        e = self.p["embed"][x.T]
        (f, kf), (b, kb) = self._run(e, "f"), self._run(e, "b")
        h = np.concatenate([f, b], 2)
        return h @ self.p["out"] + self.p["bias"], (h, kf, kb)

    def step(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of a batch and its gradient."""
        s, (h, kf, kb) = self.emissions(x)
        s = s.astype(np.float64)
        length, rows = s.shape[:2]
        trans, y = self.p["trans"].astype(np.float64), tags.T
        forward, backward = np.empty_like(s), np.zeros_like(s)
        forward[0] = s[0]
        for t in range(1, length):
            forward[t] = s[t] + _log_sum(forward[t - 1][:, :, None] + trans, 1)
        for t in range(length - 2, -1, -1):
            backward[t] = _log_sum(trans + (s[t + 1] + backward[t + 1])[:, None, :], 2)
        total = _log_sum(forward[-1], 1)
        d = np.exp(forward + backward - total[:, None])
        at = np.arange(rows)
        true = s[np.arange(length)[:, None], at, y].sum() + trans[y[:-1], y[1:]].sum()
        d_trans = np.zeros_like(trans)
        for t in range(1, length):
            d_trans += np.exp(forward[t - 1][:, :, None] + trans + (s[t] + backward[t] - total[:, None])[:, None, :]).sum(0)
        np.subtract.at(d_trans, (y[:-1], y[1:]), 1)
        d[np.arange(length)[:, None], at, y] -= 1
        d = (d / rows).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["trans"] = (d_trans / rows).astype(np.float32)
        grads["out"], grads["bias"] = np.einsum("trh,trk->hk", h, d), d.sum((0, 1))
        dh = d @ self.p["out"].T
        n = self.hidden
        de = self._back(dh[:, :, :n], kf, "f", grads) + self._back(dh[:, :, n:], kb, "b", grads)
        np.add.at(grads["embed"], x.T, de)
        return float(total.sum() - true) / rows, grads

    def fit(self, x: np.ndarray, tags: np.ndarray, *, rounds: int = 5, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> "Tagger":
        rng, first, second, n = np.random.default_rng(seed), {}, {}, 0
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                grads, n = self.step(x[rows], tags[rows])[1], n + 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window by Viterbi."""
        s = self.emissions(x)[0]
        best, came = s[0], np.empty(s.shape, np.uint8)
        for t in range(1, len(s)):
            through = best[:, :, None] + self.p["trans"]
            came[t] = through.argmax(1)
            best = through.max(1) + s[t]
        out = np.empty(x.shape, np.uint8)
        out[:, -1] = best.argmax(1)
        for t in range(len(s) - 1, 0, -1):
            out[:, t - 1] = came[t][np.arange(len(x)), out[:, t]]
        return out


def tags_of(begin: int, end: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of one window; positions past its end are outside. Of spans that overlap, the first kind holds."""
    out = np.zeros(WINDOW, np.uint8)
    for kind, a, b in reversed(spans):
        lo, hi = max(a, begin), min(b, end)
        if lo < hi:
            out[lo - begin : hi - begin] = 2 + 2 * kind
            if a >= begin:
                out[a - begin] = 1 + 2 * kind
    return out


def reconcile(wins: list[tuple[int, int]], tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans over the whole text: where windows overlap, the one whose middle is nearer has the say."""
    spans, at = [], 0
    while at < len(wins):
        last = at
        while last + 1 < len(wins) and wins[last + 1][0] < wins[last][1]:
            last += 1
        begin, joined = wins[at][0], []
        for k in range(at, last + 1):
            a, b = wins[k]
            lo = a if k == at else (wins[k - 1][1] + a) // 2
            hi = b if k == last else (b + wins[k + 1][0]) // 2
            joined.append(tags[k][lo - a : hi - a])
        joined = np.concatenate(joined).tolist()
        k = 0
        while k < len(joined):
            if joined[k] and joined[k] % 2:
                end = k + 1
                while end < len(joined) and joined[end] == joined[k] + 1:
                    end += 1
                spans.append((joined[k] // 2, begin + k, begin + end))
                k = end
            else:
                k += 1
        at = last + 1
    return spans


def plausible(kind: int, text: str) -> bool:
    if KINDS[kind] == "email":
        return "@" in text[1:-1]
    numbers = re.findall(r"[0-9]+", text)
    if KINDS[kind] == "ip":
        return text.count(".") == 3 and len(numbers) == 4 and passes("ip", ".".join(numbers))
    return passes(KINDS[kind], text)


class Stretches:
    """The text that a row's windows hold, each stretch once, found by position."""

    def __init__(self, wins: list[tuple[int, int]], texts: list[str]):
        self.starts, self.ends, pieces = [], [], []
        for (a, b), text in zip(wins, texts):
            if self.ends and a <= self.ends[-1]:
                pieces[-1].append(text[self.ends[-1] - a :])
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)
                pieces.append([text])
        self.texts = ["".join(p) for p in pieces]

    def cover(self, a: int, b: int) -> str:
        """The characters from ``a`` to ``b`` that lie in a stretch."""
        out, k = [], max(0, bisect_right(self.starts, a) - 1)
        while k < len(self.starts) and self.starts[k] < b:
            out.append(self.texts[k][max(0, a - self.starts[k]) : max(0, b - self.starts[k])])
            k += 1
        return "".join(out)


class Intervals:
    """Intervals that do not overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    @classmethod
    def union(cls, spans: list[tuple[int, int]]) -> "Intervals":
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return cls(merged)

    def meet(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def hold(self, a: int, b: int) -> bool:
        """Whether one is longer than ``a`` to ``b`` and holds it."""
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b and self.ends[k] - self.starts[k] > b - a


def add_spans(base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]], wins: list[tuple[int, int]], texts: list[str], tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, refused = list(base), set(failed)
    taken, held = Intervals.union([(a, b) for _, a, b in base]), Stretches(wins, texts)
    # Matches of one kind do not overlap.
    long = [Intervals([(a, b) for k, a, b in failed if k == kind and b - a >= 13 and sum(c in "0123456789" for c in held.cover(a, b)) >= 13]) for kind in range(len(KINDS))]
    for kind, a, b in reconcile(wins, tags):
        if (kind, a, b) in refused or taken.meet(a, b) or any(x.hold(a, b) for x in long):
            continue
        begin, inner, end = held.cover(a - 1, a), held.cover(a, b), held.cover(b, b + 1)
        cut = re.match("[0-9]{2}", begin + inner[:1]) or re.fullmatch("[0-9]{2}", inner[-1:] + end)
        if not cut and plausible(kind, inner):
            out.append((kind, a, b))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def other_form(kind: int, match: str, rng: np.random.Generator) -> str:
    """A base span as people write it where the patterns do not look."""
    pick = lambda *x: x[rng.integers(len(x))]
    if KINDS[kind] == "email":
        local, host = match.split("@")
        if rng.random() < 0.5:
            names = re.findall(r"[A-Za-z]+", local) or [local]
            local = pick(".", "_", "-").join(names) + pick("", str(rng.integers(1, 3000)))
            labels = re.findall(r"[A-Za-z]+", host)[-int(rng.integers(2, 4)) :]
            host = ".".join(labels[:-1] + [pick("com", "org", "net", "edu", "de", "info")])
        return local + pick(" @ ", " @ ", "@ ", " @", "[@]", "(@)") + host
    if KINDS[kind] == "ip":
        return match.replace(".", pick(". ", " .", " . ", "[.]", "(.)"))
    digits = re.sub(r"[^0-9]", "", match)
    if KINDS[kind] == "card":
        by = pick("_", ".", "/", " - ", "  ")
        return by.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    own, code, by = digits[-10:], str(rng.integers(1, 100)), pick(" ", ".", "-", "/")
    area, rest = own[:3], own[3:]
    cut = pick(0, *range(2, len(rest) - 1))
    rest = f"{rest[:cut]}{by}{rest[cut:]}" if cut else rest
    return pick(f"({area}) ", f"(0{area[1:]}) ", f"({code}) {area} ", f"{area}{by}", f"0{area[1:]}{by}", f"00{code}{by}{area}{by}", f"00 {code} {area} ") + rest


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window with its spans in other forms, and where they are now; no spans if they do not fit or the patterns find them.

    Of spans that overlap the first kind is written anew. What grows beyond the window loses the end behind its last span.
    """
    free, out, found, at = [], "", [], 0
    for span in spans:
        if all(span[1] >= b or span[2] <= a for _, a, b in free):
            free.append(span)
    for kind, a, b in sorted(free, key=lambda x: x[1]):
        form = other_form(kind, text[a:b], rng)
        out += text[at:a]
        found.append((kind, len(out), len(out) + len(form)))
        out, at = out + form, b
    out += text[at:]
    new = {(kind, out[a:b]) for kind, a, b in found}
    known = any(a < y and x < b for _, a, b in found for _, x, y in base_spans(out)[0])
    if not new or known or found[-1][2] > WINDOW or not all(plausible(*x) for x in new):
        return text, []
    return out[:WINDOW], found


_SPAN = "array<struct<kind:int,start:int,stop:int>>"
_SCANNED = f"doc_id long, base {_SPAN}, failed {_SPAN}, wins array<struct<start:int,stop:int,text:string,base:{_SPAN}>>"


def _within(kinds: list[list[tuple[int, int, int]]], a: int, b: int) -> list[tuple[int, int, int]]:
    """The spans that meet a window, by kind; those of one kind are in order and do not overlap."""
    out = []
    for spans in kinds:
        k = bisect_right(spans, a, key=lambda s: s[2])
        while k < len(spans) and spans[k][1] < b:
            out.append(spans[k])
            k += 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    win = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string()), ("base", pa.list_(span))])
    struct = lambda spans: [dict(kind=k, start=a, stop=b) for k, a, b in spans]
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            base, failed, wins = [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                found, bad = base_spans(text)
                base.append(struct(found))
                failed.append(struct(bad))
                kinds = [[s for s in found if s[0] == k] for k in range(len(KINDS))]
                wins.append([dict(start=a, stop=b, text=text[a:b], base=struct(_within(kinds, a, b))) for a, b in windows(text)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(base, pa.list_(span)), pa.array(failed, pa.list_(span)), pa.array(wins, pa.list_(win))],
                names=["doc_id", "base", "failed", "wins"],
            )


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The base spans and the windows of every row, written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(_scan, _SCANNED))


def train(table: DataFrame, max_windows: int = 3000) -> Tagger | None:
    """The tagger of about ``max_windows`` windows, half of them with a span where there are so many.

    They are picked by a hash of their row's id, place and text, so the same rows give
    the same tagger however they are dealt.
    """
    wins = table.where(F.size("wins") > 0).select("doc_id", F.explode("wins").alias("win"))
    wins = wins.withColumn("labelled", F.size("win.base") > 0)
    count = {r["labelled"]: r["count"] for r in wins.groupBy("labelled").count().collect()}
    if not count.get(True):
        return None
    half = F.when(F.col("labelled"), F.lit(count[True])).otherwise(F.lit(count.get(False, 1)))
    key = F.xxhash64("doc_id", "win.start", "win.text")
    picked = F.pmod(key, half) < max_windows // 2
    rows = wins.where(picked).select("win", key.alias("key")).orderBy("key", "win").collect()
    # What no pattern finds may still be a span in another form: such windows are no examples of plain text.
    rows = [r["win"] for r in rows if r["win"]["base"] or not LOOSE.search(r["win"]["text"])]
    texts = [w["text"] for w in rows]
    tags = [tags_of(w["start"], w["stop"], [tuple(s) for s in w["base"]]) for w in rows]
    rng = np.random.default_rng(7)
    for w in rows:
        at = w["start"]
        inside = [(k, a - at, b - at) for k, a, b in w["base"] if a >= at and b <= w["stop"]]
        for _ in range(COPIES if inside else 0):
            text, spans = rewritten(w["text"], inside, rng)
            if spans:
                texts.append(text)
                tags.append(tags_of(0, len(text), spans))
    rounds = min(15, max(5, -(-STEPS * BATCH // len(texts))))
    return Tagger(hidden=28).fit(char_kinds(texts), np.stack(tags), rounds=rounds, rate=0.015)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_windows: int = 3000) -> DataFrame:
    """``doc_id, base, spans`` of every row; spans are arrays of ``kind, start, stop``."""
    table = scanned(docs, id_col, text_col)
    tagger = train(table, max_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
        triples = lambda x: [(s["kind"], s["start"], s["stop"]) for s in x]
        for batch in batches:
            base = batch.column(1).to_pylist()
            failed, wins = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [w["text"] for row in wins for w in row]
            tags = [tagger.decode(char_kinds(texts[at : at + 512])) for at in range(0, len(texts), 512)] if tagger else []
            tags = np.concatenate(tags) if tags else np.zeros((len(texts), WINDOW), np.uint8)
            at, spans = 0, []
            for b, bad, row in zip(base, failed, wins):
                places = [(w["start"], w["stop"]) for w in row]
                found = add_spans(triples(b), triples(bad), places, [w["text"] for w in row], tags[at : at + len(row)])
                at += len(row)
                spans.append([dict(kind=k, start=a, stop=z) for k, a, z in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span))], names=["doc_id", "base", "spans"])

    return table.select("doc_id", "base", "failed", "wins").mapInArrow(run, f"doc_id long, base {_SPAN}, spans {_SPAN}")


def report(found: DataFrame) -> DataFrame:
    """``doc_id``, the base spans' counts and digest, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.stop)), ",")
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
