"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained in numpy from labelled spans: those of the patterns in a bounded sample of documents
(sample_rows), and rewritings of them that the patterns miss. A span is accepted only in its kind's make-up (plausible()),
of which a digit, "@", "(at)" or "[at]" is a part. So tagged are all parts of a text within MARGIN characters of any of
these, drawn out to whole tokens; no acceptable span lies elsewhere. They are cut into overlapping windows, whose emissions
are averaged, weighted towards each window's middle, and one path is decoded over the whole stretch. Its spans are drawn out
to whole tokens.

Defined cases: a null or empty text has no spans. Spans of the tagger that touch a pattern's span, or don't have their
kind's make-up, are dropped. Repeated rows give repeated rows; empty tables give empty tables; other columns are ignored
by find_pii() and carried by redact().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .labelled import least_hashed

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base rule.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: IP's matches in linear time: they start and end with whole runs of digits, so a run is tried once and kept whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")

WINDOW, STRIDE, MARGIN = 96, 48, 40
_CHARS = "@.+-_%()/:;,=\"'#$*&|!<>[] \n"
_OTHER, _DIGIT, _LOWER, _UPPER = (len(_CHARS) + k for k in range(1, 5))
_TABLE = np.full(128, _OTHER, dtype=np.int64)
for _k, _c in enumerate(_CHARS):
    _TABLE[ord(_c)] = _k + 1
_TABLE[48:58], _TABLE[97:123], _TABLE[65:91] = _DIGIT, _LOWER, _UPPER
SYMBOLS, TAGS = _UPPER + 1, 1 + 2 * len(KINDS)
#: "@" and its written forms; every acceptable span holds one of these or a digit.
_AT = r"(?:@|\(at\)|\[at\])"
_TRIGGER = re.compile(rf"[0-9]|{_AT}")


_SPACE = re.compile(r"\s")
_LETTERS = str.maketrans("0123456789", "abcdefghij")


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """EMAIL's leftmost matches, looked for only around each "@": a match holds exactly one, after its first part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    if not text or not _TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in _email_spans(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], _OTHER)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """in, rec, bias: both directions' LSTM; out, out_bias: emissions; move: CRF transitions."""

    p: dict[str, np.ndarray]
    hidden: int = 16

    @classmethod
    def fresh(cls, hidden: int = 16, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {
            "in": rng.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)),
            "rec": rng.normal(0, 0.2, (2, hidden, 4 * hidden)),
            "bias": np.zeros((2, 1, 4 * hidden)),
            "out": rng.normal(0, 0.2, (2 * hidden, TAGS)),
            "out_bias": np.zeros(TAGS),
            "move": np.zeros((TAGS, TAGS)),
        }
        p["bias"][:, :, hidden : 2 * hidden] = 1.0
        return cls(p, hidden)

    def lstm(self, ids: np.ndarray, keep: bool = False):
        """States of both directions, (windows, length, 2 * hidden); ids: (windows, length)."""
        n, length = ids.shape
        h = self.hidden
        both = np.stack([ids, ids[:, ::-1]])
        table = self.p["in"] + self.p["bias"]
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        states, kept = np.empty((2, n, length, h)), []
        for t in range(length):
            a = np.stack([table[0][both[0, :, t]], table[1][both[1, :, t]]]) + state @ self.p["rec"]
            s = 1 / (1 + np.exp(-a[:, :, : 3 * h]))
            g = np.tanh(a[:, :, 3 * h :])
            i, f, o = s[:, :, :h], s[:, :, h : 2 * h], s[:, :, 2 * h :]
            before, last = cell, state
            cell = f * before + i * g
            tc = np.tanh(cell)
            state = o * tc
            states[:, :, t] = state
            if keep:
                kept.append((i, f, o, g, before, last, tc))
        out = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        return (out, both, kept) if keep else out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.lstm(ids) @ self.p["out"] + self.p["out_bias"]

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths, and its gradient."""
        states, both, kept = self.lstm(ids, keep=True)
        e, move = states @ self.p["out"] + self.p["out_bias"], self.p["move"]
        n, length, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = _lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        rows, steps = np.arange(n)[:, None], np.arange(length)[None, :]
        gold = e[rows, steps, tags].sum() + move[tags[:, :-1], tags[:, 1:]].sum()
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, steps, tags] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        dmove = pair.sum((0, 1))
        np.subtract.at(dmove, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g = {"move": dmove, "out": states.reshape(-1, states.shape[2]).T @ de.reshape(-1, TAGS), "out_bias": de.sum((0, 1))}
        h = self.hidden
        ds = de @ self.p["out"].T
        ds = np.stack([ds[:, :, :h], ds[:, ::-1, h:]])
        dh, dc = np.zeros((2, n, h)), np.zeros((2, n, h))
        da_all, drec = np.empty((2, n, length, 4 * h)), np.zeros_like(self.p["rec"])
        for t in range(length - 1, -1, -1):
            i, f, o, gg, before, last, tc = kept[t]
            dh = dh + ds[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=2)
            da_all[:, :, t] = da
            drec += last.transpose(0, 2, 1) @ da
            dh, dc = da @ self.p["rec"].transpose(0, 2, 1), dc * f
        g["rec"] = drec
        g["bias"] = da_all.sum((1, 2))[:, None, :]
        hot = [np.eye(SYMBOLS)[b.ravel()] for b in both]
        g["in"] = np.stack([hot[d].T @ da_all[d].reshape(-1, 4 * h) for d in range(2)])
        return float(z.sum() - gold) / n, {k: v / n for k, v in g.items()}


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 12, batch: int = 48, rate: float = 0.02, seed: int = 5, enough: float = 0.1) -> Tagger | None:
    """Adam over labelled windows (text, spans as start, kind, end), until an epoch's mean loss of a window is below `enough`."""
    if not any(spans for _, spans in windows):
        return None
    ids, tags = np.zeros((len(windows), WINDOW), dtype=np.int64), np.zeros((len(windows), WINDOW), dtype=np.int64)
    for k, (text, spans) in enumerate(windows):
        ids[k, : min(len(text), WINDOW)] = encode(text[:WINDOW])
        for a, kind, b in spans:
            tags[k, a:b] = 2 + 2 * kind
            if a < WINDOW:
                tags[k, a] = 1 + 2 * kind
    model, rng = Tagger.fresh(seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        order, loss = rng.permutation(len(windows)), 0.0
        for k in range(0, len(order), batch):
            t += 1
            part, g = model.gradient(ids[order[k : k + batch]], tags[order[k : k + batch]])
            norm = np.sqrt(sum((x * x).sum() for x in g.values()))
            pace = rate * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
            for key, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[key], v[key] = 0.9 * m[key] + 0.1 * x, 0.999 * v[key] + 0.001 * x * x
                model.p[key] = model.p[key] - pace * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-8)
            loss += part * len(order[k : k + batch])
        if loss < enough * len(windows):
            break
    return model


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text within MARGIN of a digit or a form of "@", drawn out to white space on both sides."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() + MARGIN <= out[-1][1]:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            a = out[-1][0]
        else:
            low = out[-1][1] if out else 0
            while a > low and not text[a - 1].isspace():
                a -= 1
        if space := _SPACE.search(text, b):
            b = space.start()
        else:
            b = len(text)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decode(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tag paths; e: (stretches, length, tags)."""
    n, length, _ = e.shape
    best, back = e[:, 0], np.zeros((n, length, TAGS), dtype=np.int8)
    for t in range(1, length):
        through = best[:, :, None] + move
        back[:, t] = through.argmax(1)
        best = through.max(1) + e[:, t]
    path = np.empty((n, length), dtype=np.int64)
    path[:, -1] = best.argmax(1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


_WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])[:, None]


def tag(model: Tagger, texts: list[str], most: int = 512) -> list[np.ndarray]:
    """Tag paths of stretches: overlapping windows in batches, emissions averaged, one path for each stretch."""
    paths: list[np.ndarray | None] = [None] * len(texts)
    by_size: dict[int, list[int]] = {}
    for k, text in enumerate(texts):
        by_size.setdefault(max(1, -(-max(0, len(text) - WINDOW) // STRIDE) + 1), []).append(k)
    for count, members in sorted(by_size.items()):
        step = max(1, most // count)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            full = WINDOW + (count - 1) * STRIDE
            ids = np.zeros((len(some), full), dtype=np.int64)
            for row, k in enumerate(some):
                ids[row, : len(texts[k])] = encode(texts[k])
            total, weight = np.zeros((len(some), full, TAGS)), np.zeros((full, 1))
            starts = range(0, full - WINDOW + 1, STRIDE)
            for low in range(0, len(starts), most):
                part = starts[low : low + most]
                e = model.emissions(np.concatenate([ids[:, s : s + WINDOW] for s in part])).reshape(len(part), len(some), WINDOW, TAGS)
                for w, s in enumerate(part):
                    total[:, s : s + WINDOW] += e[w] * _WEIGHT
                    weight[s : s + WINDOW] += _WEIGHT
            for k, path in zip(some, decode(total / weight, model.p["move"])):
                paths[k] = path[: len(texts[k])]
    return paths


def path_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for k in np.flatnonzero(path):
        kind = (int(path[k]) - 1) // 2
        if path[k] % 2 == 0 and out and out[-1][2] == k and out[-1][1] == kind:
            out[-1][2] = int(k) + 1
        else:
            out.append([int(k), kind, int(k) + 1])
    return [tuple(x) for x in out]


def plausible(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a tagged span is a whole token of its kind's make-up."""
    s = text[start:end]
    if s != s.strip() or start and text[start - 1].isalnum() and s[0].isalnum() or end < len(text) and text[end].isalnum() and s[-1].isalnum():
        return False
    n = len(_digits(s))
    if kind == 0:
        return bool(re.search(rf"[^\W_]\s?{_AT}\s?[^\W_]", s)) and "." in s and len(s) >= 6
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}([.:-][0-9]{1,3}){3}", s)) and all(int(x) <= 255 for x in re.split("[.:-]", s))
    if kind == 2:
        return 12 <= n <= 19 and bool(re.fullmatch(r"[0-9 ./_-]+", s)) and luhn(_digits(s))
    return 9 <= n <= 15 and bool(re.fullmatch(r"\+?[0-9() ./-]+", s)) and bool(re.search(r"[() ./-]", s)) and not re.fullmatch(r"[0-9]+(\.[0-9]+)+", s)


#: What a span of each kind may be drawn out over: before its start (and one sign more for a phone), and after its end.
_LETTER_OR_SIGN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_BEFORE = (_LETTER_OR_SIGN, frozenset("0123456789"), frozenset("0123456789"), frozenset("0123456789"))
_AFTER = (re.compile(r"(?:[A-Za-z0-9]|[.-](?=[A-Za-z0-9]))*"), re.compile(r"[0-9]*"), re.compile(r"[0-9]*"), re.compile(r"[0-9]*"))


def drawn_out(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """A tagged span drawn out to whole tokens of its kind, however long they are."""
    while start and text[start - 1] in _BEFORE[kind]:
        start -= 1
    if kind == 3 and start and text[start - 1] in "+(":
        start -= 1
    return start, _AFTER[kind].match(text, end).end()


def all_spans(texts: list[str | None], model: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    extra: list[list] = [[] for _ in texts]
    if model:
        where = [(k, a, b) for k, t in enumerate(texts) if t for a, b in stretches(t)]
        last: dict = {}  # by text and kind, so that a long token with many tagged pieces is walked once
        for (k, a, b), path in zip(where, tag(model, [texts[k][a:b] for k, a, b in where])):
            for s, kind, e in path_spans(path):
                s, e = a + s, a + e
                if e <= last.get((k, kind), (0, 0))[1]:
                    continue
                s, e = last[k, kind] = drawn_out(texts[k], s, kind, e)
                if plausible(texts[k], s, kind, e) and not any(x[0] < e and s < x[2] for x in base[k] + extra[k][-1:]):
                    extra[k].append((s, kind, e))
    return [(b, sorted(b + x)) for b, x in zip(base, extra)]


#: Forms that the patterns miss, by kind: fixed as training cases.
FORMS = (("(at)", " @ ", "[at]"), (":", "-"), (".", "_", "/"), ("{}-{}-{}", "({}) {}-{}", "{} {} {}"))


def _digits_anew(digits: str, rng: np.random.Generator, checked: bool) -> str:
    """Other digits in their place; checked: the last one makes the number pass Luhn."""
    out = "".join(str(rng.integers(1 if k == 0 else 0, 10)) for k in range(len(digits)))
    return next(x for x in (out[:-1] + str(d) for d in range(10)) if luhn(x)) if checked else out


def _rewritten(text: str, spans: list[tuple[int, int, int]], form: int, rng: np.random.Generator, letters: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """The window with its spans in a form that the patterns miss, with other digits; letters: e-mail digits become letters."""
    out, new, at = "", [], 0
    for a, kind, b in spans:
        s, way = text[a:b], FORMS[kind][form % len(FORMS[kind])]
        if kind == 0:
            s = s.replace("@", way).translate(_LETTERS if letters else {})
        elif kind == 1:
            s = way.join(str(rng.integers(0, 256)) for _ in range(4))
        elif kind == 2:
            d = _digits_anew(_digits(s), rng, True)
            s = way.join(d[i : i + 4] for i in range(0, len(d), 4))
        else:
            d = _digits_anew(_digits(s)[-10:].rjust(10, "5"), rng, False)
            s = way.format(d[:3], d[3:6], d[6:])
        out += text[at:a]
        new.append((len(out), kind, len(out) + len(s)))
        out, at = out + s, b
    return out + text[at:], new


def labelled_windows(docs: DataFrame, sample_rows: int, most_windows: int) -> list[tuple[str, list]]:
    """At most most_windows windows around digits, half of them with spans of the patterns, from sample_rows documents by least hash.

    Each class is drawn by hash; where one has too few windows, the other doesn't fill its place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                spans = base_spans(text)
                for a, b in stretches(text):
                    # A long stretch gives one window for each start, so spans deep inside it are learned too.
                    for low in sorted({a, *(max(a, min(s - WINDOW // 4, b - WINDOW)) for s, _, _ in spans if a <= s < b)}):
                        if not any(s < low < e or s < low + WINDOW < e for s, _, e in spans):
                            inside = [(s - low, kind, e - low) for s, kind, e in spans if low <= s and e <= low + WINDOW]
                            found.append((doc_id, low, text[low : min(b, low + WINDOW)], ",".join(f"{s}:{kind}:{e}" for s, kind, e in inside)))
            yield pd.DataFrame(found, columns=["doc_id", "at", "window", "spans"])

    keys = docs.select("doc_id").where("doc_id is not null")
    ids = sorted(set(least_hashed(keys, "spans", sample_rows, keys.count())))
    if not ids:
        return []
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).mapInPandas(run, "doc_id long, at long, window string, spans string")
    rows = materialise(rows.withColumn("spot", F.xxhash64("doc_id", "at")))
    drawn = [r for empty in (False, True) for r in rows.where((F.col("spans") == "") == empty).orderBy("spot", "doc_id", "at", "window").limit(most_windows // 2).collect()]
    return [(r.window, [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]) for r in drawn]


def fit(docs: DataFrame, sample_rows: int = 6000, most_windows: int = 800, most_rewritten: int = 1400, seed: int = 3) -> Tagger | None:
    """A tagger trained on sampled windows and on most_rewritten windows in other forms, all forms equally often.

    Few windows with spans are rewritten more often, each time with other digits, so small corpora teach all forms too.
    """
    windows, rng = labelled_windows(docs, sample_rows, most_windows), np.random.default_rng(seed)
    held = [x for x in windows if x[1]]
    more = []
    for k in range(most_rewritten if held else 0):
        text, spans = held[k % len(held)]
        # Forms advance with the window and with every round over the windows; half the addresses have no digits.
        text, spans = _rewritten(text, spans, k % len(held) + k // len(held), rng, letters=(k // 2) % 2 == 0)
        more.append((text, [x for x in spans if x[2] <= WINDOW]))
    return train(windows + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_pii(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, counts and digest of the patterns' spans, and all spans, of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = all_spans([t if isinstance(t, str) else None for t in batch["text"]], model)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64")}
                | {f"n_{name}": [sum(s[1] == k for s in base) for base, _ in found] for k, name in enumerate(KINDS)}
                | {"base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], "spans": [written(spans) for _, spans in found]}
            )

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """The same rows and columns with spans replaced in text; n_chars, where there is one, follows the text."""
    lengths = "n_chars" in docs.columns

    def with_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            batch["text"] = [redact_text(t, s) if t is not None else None for t, (_, s) in zip(texts, all_spans(texts, model))]
            yield batch

    ship_package(docs.sparkSession)
    nested = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in ("text",)]).alias("rest"), "text")
    found = nested.mapInPandas(with_rest, nested.schema)
    out = found.select(*[F.col("text") if c == "text" else F.col(f"rest.{c}").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if lengths else out
