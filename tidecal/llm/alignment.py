"""Cross-tokenizer alignment: which tokens of two public tokenizers share bytes of a text, and how often in a corpus.

Every text is tokenised whole by both. Where a token of each ends at the same byte and the next of each starts with a
space, the text is cut into windows of token ids. The same windows come again and again, so a window's alignment is
worked out once and remembered by its pair of id tuples. Links are written as counted pairs of ids for each document;
corpus counts are sums over these, and come back to the documents by a join.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package, spread_join

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed: how the byte-level tokenizer cuts a text before it merges bytes (the published pattern of its family).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pair of ids is one number: the first id shifted by so many bits, and the second.
SHIFT = 20
#: A text with so long a stretch of (or without) ASCII white space goes to the library whose merging is not quadratic.
STRETCH = 1000
#: Windows of up to so many tokens are remembered, and so many of them at a time.
REMEMBERED_TOKENS, REMEMBERED = 64, 200_000
#: Characters of text that are aligned at a time; a longer text is aligned alone.
AT_ONCE = 2_000_000
#: Fewer than 2 ** (63 - 2 * SHIFT).
MOST_TEXTS = 1 << 20
#: Counted pairs are broadcast up to this number (at 40 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000


def byte_table() -> dict[str, int]:
    """Characters of byte-level vocabularies and the bytes they stand for: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Side:
    """One tokenizer: texts to arrays of ids, each id's bytes, and two arrays by id: length, and whether a space starts it."""

    encode: Callable[[list[str]], list[np.ndarray]]
    pieces: list[bytes]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.spaced = np.array([p[:1] == b" " for p in self.pieces])
        self.flat, self.starts = np.frombuffer(b"".join(self.pieces), dtype=np.uint8), np.cumsum(self.lengths) - self.lengths
        self.names = [str(k) for k in range(len(self.pieces))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        lengths = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def long_stretch(text: str) -> bool:
    if len(text) < STRETCH:
        return False
    blank = np.frombuffer(text.encode(), dtype=np.uint8) <= 32
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return bool(np.diff(turns, prepend=-1, append=len(blank)).max() >= STRETCH)


def byte_level_side(path: str) -> Side:
    """The tokenizer of a tokenizers JSON file, with a space set before each text; special tokens' strings are plain text.

    Where its merges run in the order of their ids, the same merging is done by tiktoken, which is several times faster;
    texts with very long stretches, and other files, go to the tokenizers library. Both give the same ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    spec = json.loads(open(path, encoding="utf-8").read())
    to_byte, special = byte_table(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
    for token, k in vocab.items():
        pieces[k] = token.encode() if token in special else bytes(to_byte[c] for c in token)
    for t in spec.get("added_tokens", []):
        pieces[t["id"]] = t["content"].encode()

    def by_library(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
    before, ranks = spec.get("pre_tokenizer") or {}, {pieces[k]: k for t, k in vocab.items() if t not in special}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("ignore_merges")
    if not plain or merged != sorted(merged) or len(ranks) < 256 + len(merged):
        return Side(lambda texts: by_library([f" {t}" for t in texts]), pieces)
    fast = tiktoken.Encoding("from_json", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [by_library([f" {t}"])[0] if long_stretch(t) else fast.encode_to_numpy(f" {t}", disallowed_special=()).astype(np.int32) for t in texts]

    return Side(encode, pieces)


def piece_side(path: str) -> Side:
    """The tokenizer of a sentencepiece model, which sets a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in ids]
    return Side(lambda texts: [np.array(ids, dtype=np.int32) for ids in model.encode(texts, num_threads=1)], pieces)


class Memo:
    """Alignments of windows by their two id tuples, written as bytes; links lie one after the other in one array."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups, self.starts, self.flat = array("q"), array("q", [0]), array("q")

    def add(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> None:
        """Align windows that lie one after the other in a and b; a window ends before each of a_ends and b_ends."""
        bytes_a, bytes_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        in_a, in_b = np.zeros(bytes_a[-1] + 1, dtype=bool), np.zeros(bytes_a[-1] + 1, dtype=bool)
        in_a[bytes_a], in_b[bytes_b] = True, True
        # Between two neighbouring ends of either there is one token of each: a link.
        ends = np.flatnonzero(in_a | in_b)
        shared = in_a[ends] & in_b[ends]
        links = a[np.searchsorted(bytes_a, ends)].astype(np.int64) << SHIFT | b[np.searchsorted(bytes_b, ends)]
        last = np.searchsorted(ends, bytes_a[a_ends - 1]) + 1  # links up to each window's end
        met = np.cumsum(shared)[last - 1]
        self.starts.frombytes((last + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(links.tobytes())
        self.groups.frombytes(np.diff(met, prepend=0).astype(np.int64).tobytes())
        names_a, names_b = [self.a.names[k] for k in a.tolist()], [self.b.names[k] for k in b.tolist()]
        cuts_a, cuts_b = (np.searchsorted(x, ends[shared]) + 1 for x in (bytes_a, bytes_b))
        groups, i, j = [], 0, 0
        for x, y in zip(cuts_a.tolist(), cuts_b.tolist(), strict=True):
            groups.append(f"{','.join(names_a[i:x])}|{','.join(names_b[j:y])}" if x - i + y - j > 2 else f"{names_a[i]}|{names_b[j]}")
            i, j = x, y
        low = 0
        for high in met.tolist():
            self.texts.append(";".join(groups[low:high]))
            low = high


def align_texts(texts: list[str], a: Side, b: Side, memo: Memo) -> list[tuple]:
    """For each text (n_a, n_b, n_groups, n_links, groups' SHA-256, distinct links, how often each); zeros where bytes differ."""
    found: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    want = [f" {text}".encode() for text in texts]
    ids, usable = (a.encode(texts), b.encode(texts)), np.full(len(texts), bool(texts))
    for side, own in zip((a, b), ids):
        sizes = np.array([len(x) for x in own])
        every = np.concatenate([*own, np.zeros(0, dtype=np.int32)])
        joined, sums = side.joined(every).tobytes(), np.concatenate([[0], np.cumsum(side.lengths[every])])
        last = np.cumsum(sizes)
        for k, (low, high) in enumerate(zip(sums[last - sizes].tolist(), sums[last].tolist(), strict=True)):
            usable[k] &= joined[low:high] == want[k]
    rows = np.flatnonzero(usable).tolist()
    if not rows:
        return found
    # The texts' bytes run on from one text to the next, the same for both tokenizers.
    all_a, all_b = (np.concatenate([own[k] for k in rows]) for own in ids)
    ends_a, ends_b = np.cumsum(a.lengths[all_a]), np.cumsum(b.lengths[all_b])
    in_a, in_b = np.zeros(ends_a[-1] + 1, dtype=bool), np.zeros(ends_a[-1] + 1, dtype=bool)
    in_a[ends_a], in_b[ends_b] = True, True
    next_a, next_b = 1 + np.flatnonzero(in_b[ends_a]), 1 + np.flatnonzero(in_a[ends_b])
    text_ends = np.cumsum([len(ids[0][k]) for k in rows])
    anchor = np.zeros(len(all_a) + 1, dtype=bool)
    anchor[text_ends] = True
    anchor = anchor[next_a]
    inner = np.flatnonzero(~anchor)
    anchor[inner] = a.spaced[all_a[next_a[inner]]] & b.spaced[all_b[next_b[inner]]]
    cut_a, cut_b = next_a[anchor], next_b[anchor]
    # All windows as bytes in one buffer: the ids of the first tokenizer, a mark, those of the second.
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    stops = np.cumsum(n_a + n_b + 1)
    buffer = np.full(stops[-1], -1, dtype=np.int32)
    buffer[np.arange(len(all_a)) + np.repeat(stops - n_a - n_b - 1 - (cut_a - n_a), n_a)] = all_a
    buffer[np.arange(len(all_b)) + np.repeat(stops - n_b - (cut_b - n_b), n_b)] = all_b
    keys, known, windows, at = buffer.tobytes(), memo.known, [], 0
    fresh: list[int] = []
    for k, stop in enumerate((4 * stops).tolist()):
        key = keys[at:stop]
        w = known.get(key)
        if w is None:
            w = len(memo.texts) + len(fresh)
            fresh.append(k)
            if stop - at <= 4 * REMEMBERED_TOKENS + 4:
                known[key] = w
        windows.append(w)
        at = stop
    if fresh:
        new = np.array(fresh)
        parts = [np.repeat(cut[new] - n[new] - (np.cumsum(n[new]) - n[new]), n[new]) + np.arange(n[new].sum()) for cut, n in ((cut_a, n_a), (cut_b, n_b))]
        memo.add(all_a[parts[0]], all_b[parts[1]], np.cumsum(n_a[new]), np.cumsum(n_b[new]))
    of, starts, groups = np.array(windows), np.frombuffer(memo.starts, np.int64), np.frombuffer(memo.groups, np.int64)
    first_window = np.concatenate([[0], 1 + np.searchsorted(cut_a, text_ends)])  # each text's, and one past the last
    n_links = starts[of + 1] - starts[of]
    links_to = np.cumsum(n_links)
    links = np.frombuffer(memo.flat, np.int64)[np.repeat(starts[of] - (links_to - n_links), n_links) + np.arange(links_to[-1])]
    # One number for text and link: a link has 2 * SHIFT bits, and a batch fewer than 2 ** 20 texts.
    order = np.sort(np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], links_to])[first_window])) << 2 * SHIFT | links)
    fresh_at = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    times, pairs = np.diff(np.append(fresh_at, len(order))), order[fresh_at] & (1 << 2 * SHIFT) - 1
    bounds = np.searchsorted(order[fresh_at], np.arange(len(rows) + 1) << 2 * SHIFT)
    sums = np.add.reduceat(np.stack([n_links, groups[of]]), first_window[:-1], axis=1).tolist()
    for t, k in enumerate(rows):
        text = ";".join([memo.texts[w] for w in windows[first_window[t] : first_window[t + 1]]])
        here = slice(bounds[t], bounds[t + 1])
        found[k] = (len(ids[0][k]), len(ids[1][k]), sums[1][t], sums[0][t], hashlib.sha256(text.encode()).hexdigest(), pairs[here], times[here])
    return found


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}

_ROWS = "doc_id long, pos long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:long>>"


def _align_batches(a_path: str, b_path: str):
    """Task: one row for each document, its links as distinct pairs with their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _sides:  # once for each worker
            _sides[a_path, b_path] = (byte_level_side(a_path), piece_side(b_path))
        a, b = _sides[a_path, b_path]
        memo, pos = Memo(a, b), TaskContext.get().partitionId() << 33
        for got in batches:
            ids, texts = got.column(0).to_pylist(), got.column(1).to_pylist()
            start = 0
            while start < len(ids):
                end, size = start, 0
                while end < len(ids) and (end == start or end - start < MOST_TEXTS and size + len(texts[end] or "") <= AT_ONCE):
                    size += len(texts[end] or "")
                    end += 1
                if len(memo.known) > REMEMBERED or len(memo.flat) > 20 * REMEMBERED:
                    memo.clear()
                some = [k for k in range(start, end) if texts[k]]
                found = dict(zip(some, align_texts([texts[k] for k in some], a, b, memo), strict=True))
                rows = [found.get(k, (0, 0, 0, 0, "", [], [])) for k in range(start, end)]
                numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]), pa.int32())
                pairs, times = (pa.array(np.concatenate([np.asarray(r[c], np.int64) for r in rows])) for c in (5, 6))
                links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pairs, times], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[start:end], pa.int64()), pa.array(np.arange(pos, pos + end - start)), *numbers, pa.array([r[4] for r in rows], pa.string()), links],
                    ["doc_id", "pos", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
                )
                pos += end - start
                start = end

    return task


def aligned_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """One row for each document: token numbers, groups, links (distinct pairs `first << SHIFT | second` and their number).

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens. The files
    must be at the same paths on all machines. pos tells rows apart.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(_align_batches(byte_level, pieces), _ROWS), compression="zstd")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (links that hold it in all documents), n (documents with it), best (count is its second id's highest)."""
    counts = rows.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("second", F.col("pair").bitwiseAND((1 << SHIFT) - 1)))
    highest = counts.groupBy("second").agg(F.max("count").alias("highest"))
    return materialise(counts.join(highest, "second").select("pair", "count", "n", (F.col("count") == F.col("highest")).alias("best")))


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document; see aligned_rows().

    The counted pairs are broadcast up to `broadcast_pairs` rows. Beyond that they are joined by a shuffle, in which pairs
    that very many documents hold are dealt over several tasks. Repeated rows and ids are rows of their own. An empty table
    gives an empty result.
    """
    rows = aligned_rows(docs, id_col, text_col, byte_level, pieces)
    counts, links = pair_counts(rows), rows.select("pos", F.inline("links"))
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("links")).first()
    if size.pairs <= broadcast_pairs:
        held = links.join(F.broadcast(counts.drop("n")), "pair")
    else:
        held = spread_join(links, counts, "pair", size.links)
    sums = held.groupBy("pos").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("links").join(sums, "pos", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
