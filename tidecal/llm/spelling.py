"""Spelling variants: words one edit apart, found by an index of grams of varying length, and the form each word belongs to.

A word is set between two marks and cut, at each position, into the shortest gram that is rare, or the longest allowed:
the dictionary holds the frequent grams, and a gram grows by one character while it is among them. What gram stands at a
position depends on its own characters alone, so one edit touches just the grams that cover the edited place. The largest
number that cover one place is the word's bound: of any bound + 1 grams one at least is left as it was. Words are listed
under their bound + 1 rarest grams, lists are merged where gram and place agree, and what meets there is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, ship_package
from .exact_dedup import LOWER

#: Fixed: runs of letters once A-Z are lower-cased, of at least the shortest word's code points.
LEAST_LETTERS = 5
RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
LEAST_TIMES = 3
#: A run is damaged where this divides the CRC-32 of its document's id and itself.
DAMAGED = 97
#: A form is at least this often as frequent as the word it is the form of.
FORM_TIMES = 2
#: Grams have 2 to MOST_GRAM characters; the marks before and after a word count.
MOST_GRAM = 5
#: The dictionary holds fewer than this many grams of each length: those that are more than this part of all grams.
DICTIONARY = 65_536
#: A gram is never frequent if it stands this seldom.
RARE = 8
#: Different words that a task counts before it hands on its counts.
HELD_WORDS = 300_000


def _count_words(damaged: int):
    """Task: the words of each text, damaged where the rule says, and how often the task met them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], ["word", "n"])

        met: Counter = Counter()
        for got in batches:
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
                    h = zlib.crc32(run.encode(), before)
                    if h % damaged == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    met[run] += n
                if len(met) >= HELD_WORDS:
                    yield out()
                    met = Counter()
        if met:
            yield out()

    return task


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """word, n: words of at least LEAST_LETTERS code points that occur at least LEAST_TIMES in all texts.

    A null text has none; a null id counts as the empty string in the rule of damage.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    counts = rows.mapInArrow(_count_words(damaged), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counts.where(F.col("n") >= LEAST_TIMES))


def cut(word: str, frequent: dict[str, int], most: int = MOST_GRAM) -> list[tuple[int, str]]:
    """(place, gram) for each place of the word between its marks: the shortest gram that isn't frequent, at most `most` long."""
    marked, out = f"^{word}$", []
    for p in range(len(marked) - 1):
        end = p + 2
        while end - p < most and end < len(marked) and marked[p:end] in frequent:
            end += 1
        out.append((p, marked[p:end]))
    return out


def affected(grams: list[tuple[int, str]], letters: int) -> int:
    """The most grams that one inserted, deleted or replaced character can touch: those that cover one place."""
    change = [0] * (letters + 3)
    for p, gram in grams:
        change[p] += 1
        change[p + len(gram)] -= 1
    most = now = 0
    for p in range(letters + 1):
        now += change[p]
        most = max(most, now if p else 0)
    return most


def _grow(frequent: dict[str, int], length: int):
    """Task: counts of the grams of this length whose beginning is frequent (all, at length 2)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], ["gram", "n"])

        met: Counter = Counter()
        for got in batches:
            for word in got.column(0).to_pylist():
                marked = f"^{word}$"
                grams = [marked[p : p + length] for p in range(len(marked) - length + 1)]
                met.update(grams if length == 2 else [g for g in grams if g[:-1] in frequent])
                if len(met) >= HELD_WORDS:
                    yield out()
                    met = Counter()
        if met:
            yield out()

    return task


def gram_dictionary(words: DataFrame, most: int = MOST_GRAM, size: int = DICTIONARY) -> dict[str, int]:
    """Frequent grams and their numbers, grown length by length from frequent beginnings; under `size` for each length."""
    letters = words.agg(F.sum(F.char_length("word") + F.lit(1))).first()[0] or 0
    frequent: dict[str, int] = {}
    for length in range(2, most + 1):
        counts = words.select("word").mapInArrow(_grow(frequent, length), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        # The numbers of one length add up to `letters` at most, so fewer than `size` are above this bound.
        found = counts.where(F.col("n") > max(RARE, letters // size)).collect()
        if not found:
            break
        frequent |= {r.gram: r.n for r in found}
    return frequent


def rarity(gram: str, frequent: dict[str, int]) -> tuple[float, str]:
    """Order of grams, rarest first, from the dictionary alone: its number, or what its beginning and end let expect."""
    if gram in frequent:
        return float(frequent[gram]), gram
    rare = float(RARE)
    return min(frequent.get(gram[:-1], rare), frequent.get(gram[1:], rare), frequent.get(gram[:-1], rare) * frequent.get(gram[1:], rare) / frequent.get(gram[1:-1], 10 * rare)), gram


#: How two words that share a gram can differ: equal lengths (the gram stands at the same place), or one letter less and
#: one more, with the edit behind the gram (same place from the start) or before it (same place from the end).
_EQUAL, _BEHIND, _BEFORE = range(3)
SHORTER, LONGER, EITHER = 0, 1, 2


def lists_of(word: str, frequent: dict[str, int], most: int = MOST_GRAM) -> list[tuple[int, int]]:
    """(list, role) under which a word is found: one list for each of its bound + 1 rarest grams, kind of edit and place."""
    grams, letters = cut(word, frequent, most), len(word)
    grams.sort(key=lambda x: (rarity(x[1], frequent), x[0]))
    out = []
    for p, gram in grams[: affected(grams, letters) + 1]:
        from_end = letters + 2 - p - len(gram)
        keys = [(_EQUAL, p, letters, EITHER)]
        if from_end:  # what ends with the mark has no room for an edit behind it
            keys += [(_BEHIND, p, letters + 1, SHORTER), (_BEHIND, p, letters, LONGER)]
        if p:
            keys += [(_BEFORE, from_end, letters + 1, SHORTER), (_BEFORE, from_end, letters, LONGER)]
        out += [(xxhash.xxh64_intdigest(f"{kind}:{place}:{longer}:{gram}".encode()) - (1 << 63), role) for kind, place, longer, role in keys]
    return out


def _list(frequent: dict[str, int], most: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            words, numbers = got.column(0).to_pylist(), got.column(1).to_pylist()
            for start in range(0, len(words), 2000):
                rows = [(key, role, w, n) for w, n in zip(words[start : start + 2000], numbers[start : start + 2000], strict=True) for key, role in lists_of(w, frequent, most)]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int8(), pa.string(), pa.int64()), strict=True)], ["list", "role", "word", "n"])

    return task


def near_words(words: DataFrame, most: int = MOST_GRAM, size: int = DICTIONARY) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of words (word, n; each word once) that differ by exactly one edit."""
    spark = words.sparkSession
    ship_package(spark)
    frequent = gram_dictionary(words, most, size)
    lists = materialise(words.select("word", "n").mapInArrow(_list(frequent, most), "list long, role byte, word string, n long"))
    first = lists.where(F.col("role") != LONGER).select("list", "role", "word", "n")
    second = lists.where(F.col("role") != SHORTER).select("list", F.col("role").alias("other_role"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # Lists of equal lengths hold both roles in one: each pair is met once in them, by the words' order.
    meet = first.join(second, "list").where((F.col("role") == EITHER) == (F.col("other_role") == EITHER)).where((F.col("role") != EITHER) | (F.col("word") < F.col("other")))
    found = meet.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    return materialise(found.unionAll(found.select("other", "other_n", "word", "n")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): each form's own form is followed to the last.

    A form is at least FORM_TIMES as frequent as its word, so a chain has fewer than 64 steps; each round doubles the
    steps that are behind.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = materialise(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_table(now)
        if following.where("moved").isEmpty():
            return following.select("word", "root")
        now = following


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of vocabulary(docs).

    form is the near word of largest n (ties: smallest in code-point order) if that n is at least FORM_TIMES the word's.
    Repeated rows count each; an empty table gives an empty result.
    """
    words = vocabulary(docs, id_col, text_col, damaged)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("first"))
    near = words.join(best, "word", "left").withColumn("holds", F.coalesce(-F.col("first.less") >= FORM_TIMES * F.col("n"), F.lit(False)))
    rows = materialise(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("holds"), F.col("first.other")).alias("form"), F.when(F.col("holds"), -F.col("first.less")).alias("form_n"))
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
