"""Personal data: rules, and a character BiLSTM with CRF transitions trained in numpy.

The rules give the base spans.  The network reads every text whole, in windows
that overlap: each character takes its tag from the window in which it lies
furthest from an edge, and spans are read off the tags of the whole text, so a
span may run over any number of windows.  What the network finds is added where
it touches no base span.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_sample_ids, slices, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: if it could, it would have started with the run
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Where training windows are drawn besides random places; detection reads every place.
HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def ip_parts(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from the at signs (linear in the text)."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (tail := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, tail.end()
                end = tail.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    found: list[Span] = []
    if not HINT.search(text):  # every kind holds a digit or an at sign
        return found
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if ip_parts(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# ---------------------------------------------------------------- network

#: Characters of a window, and how many two neighbours share; TRAINED is a training window's length.
WINDOW, OVERLAP, TRAINED = 384, 48, 96
PADDED = 32
#: Windows that are tagged at a time.
BATCH = 512
EMBED, HIDDEN = 12, 12
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k continues it
SYMBOLS = 100
#: At most so many documents, and places of each, are drawn from for training; steps of training.
SAMPLE_DOCS, SAMPLE_PLACES, STEPS = 2000, 2, 450


def _codes() -> np.ndarray:
    """Symbol of each Latin-1 code; others are 99 (letters beyond) by `encode`."""
    codes = np.full(256, 97, np.uint8)
    for c in range(32, 127):
        codes[c] = c - 31
    codes[[9, 10, 13]] = 96
    return codes


_CODES = _codes()


def encode(text: str) -> np.ndarray:
    """0 pads; 1 to 95 printable ASCII; 96 line ends; 97 other Latin-1; 99 beyond."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 256, _CODES[np.minimum(points, 255)], 99).astype(np.uint8)


def _soft(z: np.ndarray) -> np.ndarray:
    """z / (1 + |z|) in place: the network's bounded function, a few times quicker than tanh."""
    d = np.abs(z)
    d += 1
    z /= d
    return z


@dataclass
class Tagger:
    """Rows of `wx`, `wh` and `bias` are the gates input, forget, output, new; a gate opens by (1 + soft(z)) / 2."""

    p: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: windows, places.  Scores by place, tag, window; what training needs is put in `keep`."""
        p, (n, length) = self.p, x.shape
        h = HIDDEN
        both = np.empty((length, 2 * h, n), np.float32)
        inputs = np.ascontiguousarray(p["emb"].take(x.T, axis=0).transpose(0, 2, 1))  # place, unit, window
        for k, side in enumerate("fb"):
            # what a step reads: the last output, the character, and a one for the bias
            weights = np.concatenate([p[f"wh{side}"], p[f"wx{side}"], p[f"bias{side}"][:, None]], axis=1)
            state = np.zeros((h + EMBED + 1, n), np.float32)
            state[-1] = 1
            hidden, cell = state[:h], np.zeros((h, n), np.float32)
            trace = []
            for t in range(length) if side == "f" else range(length - 1, -1, -1):
                state[h : h + EMBED] = inputs[t]
                z = _soft(weights @ state)
                open_, new = z[: 3 * h], z[3 * h :]
                if keep is not None:
                    trace.append((z.copy(), cell, hidden.copy()))
                open_ += 1
                cell = cell * open_[h : 2 * h]
                new *= open_[:h]
                cell += new
                cell *= 0.5
                np.multiply(_soft(cell.copy()), open_[2 * h :], out=hidden)
                both[t, k * h : (k + 1) * h] = hidden
                if keep is not None:
                    trace[-1] += (cell,)
            if keep is not None:
                keep.append(trace)
        if keep is not None:
            keep.append(both)
        return np.matmul(np.ascontiguousarray(p["out"].T), both) + p["ob"][:, None]

    def tags(self, x: np.ndarray) -> np.ndarray:
        """Viterbi paths, by window and place."""
        e, trans = self.emissions(x), self.p["trans"] + FORBIDDEN
        length, _, n = e.shape
        first, later = FIRST_TAGS, FIRST_TAGS[1:] + 1
        into = trans[:, first, None]  # what may stand before these: any tag
        begun, went_on = trans[later - 1, later, None], trans[later, later, None]  # before a continuing tag: its own kind's two
        score = np.empty_like(e)
        score[0] = e[0] + START[:, None]
        outside = score[0, 0].copy()
        for t in range(1, length):
            was, now = score[t - 1], score[t]
            now[first] = (was[:, None] + into).max(axis=0)
            now[later] = np.maximum(was[later - 1] + begun, was[later] + went_on)
            now += e[t]
            outside += trans[0, 0]
            outside += e[t, 0]
        path = np.zeros(x.shape, np.int8)
        # the same sums in the same order: equal where staying outside is a best path
        some = np.flatnonzero(score[-1].max(axis=0) > outside)
        if len(some):
            score = np.ascontiguousarray(score[:, :, some].transpose(0, 2, 1))
            best, step = np.empty((len(some), length), np.int8), trans.T
            best[:, -1] = score[-1].argmax(axis=1)
            for t in range(length - 1, 0, -1):
                best[:, t - 1] = (score[t - 1] + step[best[:, t]]).argmax(axis=1)
            path[some] = best
        return path


#: A kind continues only after it began.
FIRST_TAGS = np.array([0, *range(1, TAGS, 2)])
FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
START = np.zeros(TAGS, np.float32)
for _k in range(len(KINDS)):
    START[2 + 2 * _k] = -1e4
    for _t in range(TAGS):
        if _t not in (1 + 2 * _k, 2 + 2 * _k):
            FORBIDDEN[_t, 2 + 2 * _k] = -1e4


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradients(model: Tagger, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of the tag paths."""
    p, h, (n, length) = model.p, HIDDEN, x.shape
    kept: list = []
    e = model.emissions(x, kept).transpose(0, 2, 1)
    trans = p["trans"] + FORBIDDEN
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + START
    for t in range(1, length):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(length - 2, -1, -1):
        beta[t] = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[-1], 1)
    de = np.exp(alpha + beta - total[None, :, None])
    dtrans = np.zeros_like(p["trans"])
    for t in range(1, length):
        dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
    np.subtract.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    de[np.arange(length)[:, None], np.arange(n)[None], y.T] -= 1
    de /= n
    both = kept[2]  # place, unit, window
    de = np.ascontiguousarray(de.transpose(0, 2, 1))  # place, tag, window
    g = {"trans": dtrans / n, "out": np.matmul(both, de.transpose(0, 2, 1)).sum(axis=0), "ob": de.sum(axis=(0, 2)), "emb": np.zeros_like(p["emb"])}
    dboth = np.matmul(p["out"], de)
    for k, side in enumerate("fb"):
        trace = kept[k]
        order = list(range(length) if side == "f" else range(length - 1, -1, -1))
        dh, dc = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        dz, lasts = np.empty((length, 4 * h, n), np.float32), np.empty((length, h, n), np.float32)
        for (z, before, last, cell), t in zip(reversed(trace), reversed(order), strict=True):
            lasts[t] = last
            slope = (1 - np.abs(z)) ** 2
            i, f, o, new = 1 + z[:h], 1 + z[h : 2 * h], 1 + z[2 * h : 3 * h], z[3 * h :]
            bounded = cell / (1 + np.abs(cell))
            dh = dh + dboth[t, k * h : (k + 1) * h]
            dc = (dc + dh * o * (1 - np.abs(bounded)) ** 2) * 0.5
            dz[t, :h], dz[t, h : 2 * h], dz[t, 2 * h : 3 * h], dz[t, 3 * h :] = dc * new, dc * before, dh * bounded, dc * i
            dz[t] *= slope
            dh = p[f"wh{side}"].T @ dz[t]
            dc = dc * f
        by_place = dz.transpose(1, 0, 2).reshape(4 * h, -1)
        g[f"wh{side}"] = by_place @ lasts.transpose(1, 0, 2).reshape(h, -1).T
        dgates = by_place @ np.eye(SYMBOLS, dtype=np.float32)[x.T.ravel()]
        g[f"wx{side}"] = dgates @ p["emb"]
        g[f"bias{side}"] = dgates.sum(axis=1)
        g["emb"] += dgates.T @ p[f"wx{side}"]
    return g


def train(windows: list[tuple[str, list[Span]]], steps: int = STEPS, size: int = 64, seed: int = 5, rate: float = 0.03) -> Tagger:
    """Adam over windows with labelled spans."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    p = {"emb": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "ob": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for side in "fb":
        p[f"wx{side}"] = rng.normal(0, 0.3, (4 * h, EMBED))
        p[f"wh{side}"] = rng.normal(0, 0.2, (4 * h, h))
        p[f"bias{side}"] = np.concatenate([np.zeros(h), np.full(h, 3.0), np.zeros(2 * h)])
    model = Tagger({k: v.astype(np.float32) for k, v in p.items()})
    x = np.zeros((len(windows), TRAINED), np.uint8)
    y = np.zeros((len(windows), TRAINED), np.int8)
    for k, (text, spans) in enumerate(windows):
        codes = encode(text[:TRAINED])
        x[k, : len(codes)] = codes
        for kind, a, b in spans:
            if a < TRAINED:
                y[k, a:b] = 2 + 2 * KINDS.index(kind)
                y[k, a] = 1 + 2 * KINDS.index(kind)
    p = model.p
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        take = rng.integers(0, len(x), size)
        g = _gradients(model, x[take], y[take])
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        for k in p:
            d = g[k] * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def drawn(text: str, seed: int, places: int = SAMPLE_PLACES) -> list[tuple[str, list[Span]]]:
    """Training windows from anywhere in a whole text, with the base spans in them: around digits and signs, and anywhere."""
    rng = np.random.default_rng(seed)
    hints = [m.start() for m in HINT.finditer(text)]
    starts = [max(0, hints[i] - int(rng.integers(5, 60))) for i in rng.integers(0, len(hints), places)] if hints else []
    starts += rng.integers(0, max(1, len(text) - TRAINED + 1), places).tolist()
    base = base_spans(text) if hints else []
    out = []
    for a in dict.fromkeys(starts):
        b = min(a + TRAINED, len(text))
        if not any(s < a < e for _, s, e in base):
            out.append((text[a:b], [(k, s - a, min(e, b) - a) for k, s, e in base if a <= s < b]))
    return out


def examples(found: list[tuple[str, list[Span]]], n: int = 4000, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled windows: a part of `found` as it is, and written spans of all kinds put into the words of others.

    The written ones cover spellings that the rules miss (bracketed signs,
    numbers without a plus, other separators), and numbers that are none of the
    kinds: dates, times, prices, versions, sums, page ranges, hashes, orders.
    """
    rng = np.random.default_rng(seed)

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def one(*choices: str) -> str:
        return choices[rng.integers(len(choices))]

    def card() -> str:
        s = one("4", "5", "37", "6011") + digits(15)
        s = s[:15]
        s += next(c for c in "0123456789" if luhn(s + c))
        return one("", " ", "-", ".").join(s[i : i + 4] for i in range(0, 16, 4))

    def word(least: int = 2, most: int = 9) -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(least, most)))

    def email() -> str:
        at, dot = ((" [at] ", " [dot] "), ("@", "."), ("(at)", "(dot)"), ("[at]", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("@", "."))[rng.integers(7)]
        name = word() + one("", "." + word(), digits(2), "_" + word(), "+" + word(2, 5))
        return f"{name}{at}{word()}{one('', digits(1), '-' + word())}{dot}{one('com', 'org', 'net', 'example', 'de', 'fr', 'es', 'io', 'edu')}"

    def ip() -> str:
        return one(".", ".", "[.]", " . ", "(.)").join(str(k) for k in rng.integers(0, 256, 4))

    def phone() -> str:
        a, b, c, d = digits(3), digits(3), digits(4), str(rng.integers(1, 99))
        return one(f"+{d} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{d} {a} {b} {c}", f"+{d} {a} {b} {c}", f"+{d}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d}{a}{b}{c}")

    def other() -> str:
        y, m, d = one("19", "20") + digits(2), f"{rng.integers(1, 13):02}", f"{rng.integers(1, 29):02}"
        return one(
            digits(int(rng.integers(1, 8))), f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{rng.integers(0, 24):02}:{digits(2)}", f"{y}-{m}-{d}T{digits(2)}:{digits(2)}:{digits(2)}Z", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(2)}",
            hashlib.sha1(digits(8).encode()).hexdigest(), hashlib.sha1(digits(8).encode()).hexdigest()[:12], f"{digits(1)},{digits(3)},{digits(3)}", f"${digits(2)}.{digits(2)}", f"{digits(2)}%", f"pp. {digits(3)}-{digits(3)}", f"#{digits(6)}", f"@{word()}", f"{word()}@{word()}", f"at {word()} dot", f"AKIA{digits(4)}XY{digits(6)}QRST{digits(2)}", f"{word()}{digits(2)}", f"({y})", f"{y}-{str(int(y) + 1)[2:]}", f"ISBN {digits(3)}-{digits(1)}-{digits(4)}", f"{word()}.{word(2, 4)}", f"{digits(9)}", f"{digits(4)} {digits(4)}", "-" * int(rng.integers(3, 30)), "=" * int(rng.integers(3, 30)), f"{digits(1)} + {digits(1)} = {digits(2)}",
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    bare = [t for t, spans in found if not spans and len(t) > 40] or ["some words stand here, and others there. " * 3]
    out = [found[i] for i in rng.permutation(len(found))[: n // 3]]
    while len(out) < n:
        t, more = bare[rng.integers(len(bare))], bare[rng.integers(len(bare))]
        cut = int(rng.integers(0, 60))
        text, spans = t[max(0, len(t) - cut) :], []
        for _ in range(int(rng.integers(1, 4))):
            text += one(" ", " ", ": ", ", ", "\n", " (", "; ", ". ")
            if rng.random() < 0.45:
                text += other()
            else:
                kind = KINDS[rng.integers(4)]
                what = make[kind]()
                if len(text) + len(what) > TRAINED:
                    break
                spans.append((kind, len(text), len(text) + len(what)))
                text += what
            text += one("", "", ".", ",", "!!", ")", ";") + " " + more[: int(rng.integers(0, 40))]
        out.append(((text + " " + more)[:TRAINED], spans))
    return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> Tagger:
    """Trains on labelled spans in and around places of at most `sample_docs` texts, chosen by hash of doc_id.

    Executors draw the places from whole texts; only those windows come to the
    driver, of repeated rows once.
    """
    ids = bounded_sample_ids(docs, "doc_id", sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[tuple[int, str, str]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(doc, part, json.dumps(spans)) for part, spans in drawn(text or "", doc & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "part", "spans"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select(F.col("doc_id").cast("long").alias("doc_id"))), "doc_id")
    windows = chosen.mapInArrow(run, "doc_id long, part string, spans string").distinct()
    # texts that differ under one doc_id: the first windows by hash, as many as one text gives
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("part"), "part", "spans"))
    kept = windows.withColumn("_rank", rank).where(F.col("_rank") <= 2 * SAMPLE_PLACES).drop("_rank").collect()
    return train(examples([(r.part, [tuple(x) for x in json.loads(r.spans)]) for r in sorted(kept)]), steps)


def starts_of(size: int) -> np.ndarray:
    """Where the windows of a text of `size` characters start: every place lies in one, and neighbours share OVERLAP."""
    return np.arange(0, max(size - OVERLAP, 1), WINDOW - OVERLAP)


def spans_of(tags: np.ndarray) -> list[Span]:
    """Spans of a whole text's tags: a kind's tags in a row; a beginning tag opens another."""
    kind = np.where(tags > 0, (tags + 1) >> 1, 0)
    begin = np.flatnonzero((kind > 0) & ((tags & 1 == 1) | (np.diff(kind, prepend=0) != 0)))
    edges = np.flatnonzero(np.diff(kind, append=0) != 0) + 1
    ends = edges[np.searchsorted(edges, begin, side="right")] if len(begin) else begin
    ends = np.minimum(ends, np.append(begin[1:], len(tags))) if len(begin) else ends
    return [(KINDS[int(kind[a]) - 1], a, b) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]


def model_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans of each whole text, from the tags of its windows put together.

    A text's last window is filled up to the next multiple of PADDED, so its tags
    depend on the text alone, not on what is tagged along with it.
    """
    codes = [encode(t) for t in texts]
    by_size: dict[int, list[tuple[int, int]]] = {}
    for k, c in enumerate(codes):
        for s in starts_of(len(c)).tolist() if len(c) else []:
            by_size.setdefault(-(-min(WINDOW, len(c) - s) // PADDED) * PADDED, []).append((k, s))
    whole: dict[int, np.ndarray] = {}
    for size, where in by_size.items():
        for i in range(0, len(where), BATCH):
            part = where[i : i + BATCH]
            x = np.zeros((len(part), size), np.uint8)
            for j, (k, s) in enumerate(part):
                row = codes[k][s : s + size]
                x[j, : len(row)] = row
            path = model.tags(x)
            for j in np.flatnonzero(path.any(axis=1)).tolist():
                k, s = part[j]
                tags = whole.setdefault(k, np.zeros(len(codes[k]), np.int8))
                a = s + OVERLAP // 2 if s else 0  # before it, the window on the left has the place further inside
                b = s + WINDOW - OVERLAP // 2 if s + WINDOW < len(tags) else len(tags)
                tags[a:b] = path[j, a - s : b - s]
    return [spans_of(whole[k]) if k in whole else [] for k in range(len(texts))]


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of base: of what starts before a span's end, the furthest end decides."""
    by_start = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in by_start]
    reach = list(accumulate((b for _, b in by_start), max))
    kept = []
    for s in spans:
        k = bisect_left(starts, s[2])
        if not k or reach[k - 1] <= s[1]:
            kept.append(s)
    return kept


def find(model: Tagger | None, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text, by kind as listed, then start; null texts have none."""
    held = [t or "" for t in texts]
    found = model_spans(model, held) if model else [[]] * len(held)
    result = []
    for text, extra in zip(held, found, strict=True):
        base = base_spans(text)
        added = apart(extra, base)
        result.append((base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))))
    return result


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Null texts count as empty; texts without a span have zeros and an empty list.
    A null doc_id stays null, and repeated rows each give a row.  An empty table
    gives no rows.  Only doc_id and text are read, so other columns may have any
    name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = find(shared.value, batch.column(1).to_pylist())
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes its first span's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by what `learn` draws from them.  See `detect` for nulls, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return detect(docs, learn(docs.select("doc_id", "text")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in text is replaced by its kind; n_chars follows where it is a column.

    Every row stays, null and empty texts as they are; an empty table gives no rows.
    """
    names, schema = docs.columns, docs.schema
    shared = spark.sparkContext.broadcast(learn(docs.select("doc_id", "text")))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            new = [t if t is None or not s else mask(t, s) for t, (_, s) in zip(texts, find(shared.value, texts), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
