"""License notices by fuzzy short-notice search.

Every notice may occur with a bounded number of edits k, by its length. It is split into k + 1 pieces, one of which must
occur exactly; an automaton finds the pieces in one pass over the whole text, and the regex library verifies the edits
around each. A notice's words of up to TELLING letters must stand in the match unchanged: an edit there is another word.

Defined cases: a null or empty text has no words and no labels, score 0. Long texts are searched whole, row by row.
Repeated rows give repeated rows, empty tables empty tables. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import ship_package

#: The phrases of the base rule and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices for the fuzzy search.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license": "apache",
    "mit license": "mit",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause license": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Edits count only in words longer than this.
TELLING = 4
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:int,end:int,word:long,edits:int>>"


def edits_allowed(notice: str) -> int:
    return min(3, len(notice) // 10)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces that cover the notice."""
    parts = edits_allowed(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def _searcher(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, (notice, _) in enumerate(notices):
        for at, piece in pieces(notice):
            seeds.setdefault(piece, []).append((n, at))
        patterns.append(regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice)}){{e<={edits_allowed(notice)}}}(?![^ ])"))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, patterns


def normal(text: str | None) -> str:
    """Words in lower case (A-Z only), joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()).decode("utf-8", "replace")


def tells(notice: str, match: str) -> bool:
    """Whether the notice's short words stand in the match, in order."""
    words = iter(match.split(" "))
    return all(w in words for w in notice.split(" ") if len(w) <= TELLING)


def fuzzy_matches(words: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """(notice number, start, end, edits) in the joined words; overlapping hits of one notice are found once."""
    automaton, patterns = _searcher(notices)
    found: set[tuple[int, int, int, int]] = set()
    done: dict[int, int] = {}
    for end, (size, uses) in automaton.iter(words):
        for n, offset in uses:
            notice, k = notices[n][0], edits_allowed(notices[n][0])
            start = end - size + 1 - offset
            if start + len(notice) // 2 < done.get(n, -1):
                continue
            # The piece places the notice but for k characters, and k more may be put in. One character before shows
            # whether a word starts; after a cut come characters that no notice holds, more than k, so that a cut word
            # doesn't look whole.
            low, high = max(0, start - k - 1), start + len(notice) + 2 * k + 2
            near = words[low:high] + ("\0" * (k + 2) if high < len(words) else "")
            m = patterns[n].search(near, 1 if low else 0)
            if m and tells(notice, m[0]):
                found.add((n, low + m.start(), low + m.end(), sum(m.fuzzy_counts)))
                done[n] = low + m.end()
    return sorted(found, key=lambda x: (x[1], x[0]))


def base_places(words: str) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    padded, out = f" {words} ", []
    for phrase, label in BASE.items():
        at, before, counted = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            before, counted = before + padded.count(" ", counted, at), at
            out.append((before, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]


def scan(text: str | None, notices: tuple[tuple[str, str], ...]) -> tuple:
    words = normal(text)
    base, fuzzy = base_places(words), fuzzy_matches(words, notices)
    matches = []
    if fuzzy:
        spans, gaps = word_spans(text or ""), [m.start() for m in re.finditer(" ", words)]
        for n, start, end, edits in fuzzy:
            first, last = bisect_left(gaps, start), bisect_left(gaps, end)
            matches.append((notices[n][1], spans[first][0], spans[last][1], first, edits))
    own = {x[1] for x in base}
    score = max([1.0 if base else 0.0, *(1 - edits / len(notices[n][0]) for n, _, _, edits in fuzzy)])
    at = [x[0] for x in base]
    return (words.count(" ") + 1 if words else 0, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {m[0] for m in matches})), score, matches)


def find_licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """Words, base places, labels, score and fuzzy matches (spans in code points) of every document."""
    known = tuple((notices or NOTICES).items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan(t if isinstance(t, str) else None, known) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["matches"] = [[dict(zip(("label", "start", "end", "word", "edits"), m)) for m in x] for x in out["matches"]]
            yield out

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
