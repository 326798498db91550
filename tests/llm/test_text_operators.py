"""Spelling variants, exact duplicates and token alignment: brute force, edge rows, and the bounds of their indexes."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidecal.llm import alignment, exact_dedup, spelling

SCHEMA = "doc_id long, text string, n long, h long, word string, pair long, norm string, bucket int"
ODD = [None, "", " \n\t ", "One two", "oNE TWO", "É é", "<|endoftext|> <s> </s> <unk>", "x" * 5000, "word " * 30_000, "a\x00b", "é́ ñ 你好 мир 🙂‍🙂", "▁ under", "  two  spaces ", "﻿mark", "ﬁ ½ Å"]


def table(spark, texts=ODD):
    rows = [(k, t, 1, 2, "w", 3, "n", 4) for k, t in enumerate(texts)] + [(None, "no id", *[None] * 6), (None, "NO ID", *[None] * 6)]
    return spark.createDataFrame(rows + rows[3:5] + rows[3:4], SCHEMA)


# exact duplicates


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_exact(docs, out):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lowered(r.text)].append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    rows = out.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    kept = Counter((r.text_sha256, r.doc_id, r.keep_id) for r in rows if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) <= {1} and all(i == k for _, i, k in kept)


@pytest.mark.parametrize("sizes", [{}, {"room": 200, "most_depth": 6, "held": 500}])
def test_exact_duplicates_of_odd_rows(spark, sizes):
    docs = table(spark).repartition(3)
    out = exact_dedup.exact_duplicates(docs, **sizes)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket"]
    check_exact(docs, out)
    assert exact_dedup.exact_duplicates(docs.limit(0), **sizes).count() == 0


def test_exact_duplicates_of_a_table_with_a_hot_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(spark.range(5000, 5400).selectExpr("id", "'The Same' as text")).repartition(5)
    check_exact(docs, exact_dedup.exact_duplicates(docs, room=20_000))


def test_rows_added_to_an_index_give_what_all_rows_give(spark):
    docs = table(spark)
    more = table(spark, ["one two", "NEW", None, "x" * 5000])
    index = exact_dedup.build_index(more, onto=exact_dedup.build_index(docs), room=300)
    check_exact(docs.unionAll(more), exact_dedup.members(index))


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(3)
    load = [rng.choice([0, 0, 1, 5, 40, 300]) for _ in range(64)]
    buckets = exact_dedup.split_directory(load, 100)
    at = 0
    for first, depth, size in sorted(buckets):
        assert first == at and size == sum(load[first : first + (64 >> depth)]) and (size <= 100 or depth == 6)
        assert depth == 0 or sum(load[first // (128 >> depth) * (128 >> depth) :][: 128 >> depth]) > 100  # else it would not have been split
        at += 64 >> depth
    assert at == 64 and exact_dedup.split_directory([0] * 64, 100) == [(0, 0, 0)]
    assert exact_dedup.split_directory([500] + [0] * 63, 100)[0] == (0, 6, 500)


def test_texts_of_one_hash_are_chained_and_told_apart_by_bytes():
    import pyarrow as pa

    digest = lambda t: hashlib.sha256(t).digest()
    rows = [(0, 7, digest(t), t, n, i, p) for t, n, i, p in ((b"a", 2, 5, 1), (b"b", 1, None, 2), (b"a", 3, 9, 3), (b"c", 1, 4, 4), (b"b", 1, None, 0))] + [(1, 7, digest(b"a"), b"a", 1, 1, 6)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*part)], ["bucket", "h", "digest", "norm", "n", "keep_id", "keep_pos"]) for part in (rows[:2], rows[2:])]
    found = [tuple(c) for b in exact_dedup._own(iter(batches)) for c in zip(*(x.to_pylist() for x in b.columns))]
    assert found == [(0, 7, 0, digest(b"a"), 5, 9, 3), (0, 7, 1, digest(b"b"), 2, None, 0), (0, 7, 2, digest(b"c"), 1, 4, 4), (1, 7, 0, digest(b"a"), 1, 1, 6)]
    same = [(0, 7, b"x", t, 1, 1, 1) for t in (b"a", b"b")]
    with pytest.raises(RuntimeError):
        list(exact_dedup._own(iter([pa.record_batch([pa.array(c) for c in zip(*same)], ["bucket", "h", "digest", "norm", "n", "keep_id", "keep_pos"])])))


# spelling variants


def plain_words(rows, damaged=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damaged == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_forms(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def written(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_forms_by_brute_force(spark):
    rng = random.Random(8)
    stems = ["tether", "tethers", "spelling", "ananas", "banana", "aaaaaa", "éclair", "größe", "station"]
    words = []
    for _ in range(500):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice("aesé") + w[k:], w[: k - 1] + w[k:] if k else w, w[:k] + rng.choice("aesé") + w[k + 1 :]])
        words += [w] * rng.choice([1, 2, 3, 7, 20])
    words += ["levels"] * 3 + ["level"] * 20 + ["levell"] * 6 + ["leve"] * 99 + ["zzzzzz" * 500] * 5 + ["zzzzzz" * 500 + "z"] * 2 + ["y" + "zzzzzz" * 500] * 12
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40])) for k in range(40)] + [(None, "Levels, LEVELS; levels"), (3, None), (3, ""), (7, "÷××÷÷ " * 4)]
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    got = written(spelling.spelling_forms(docs, damaged=5).collect())
    assert got == plain_forms(plain_words(rows, damaged=5))
    assert len(got) > 150 and got["levels"][1] != "levels" and any(f and f != r for f, r, *_ in got.values())
    assert spelling.spelling_forms(docs.limit(0)).count() == 0


def test_forms_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert written(spelling.spelling_forms(docs).collect()) == plain_forms(plain_words(rows))


def test_affected_grams_and_shared_lists():
    """Whatever the dictionary: an edit leaves all but the bound's number of grams, and the two words share a list."""
    rng = random.Random(4)
    for _ in range(400):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(5, 12)))
        k = rng.randrange(len(w))
        v = rng.choice([w[:k] + "x" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice("abx") + w[k:], w + "a"])
        grams = {g: 9 for n in (2, 3, 4) for g in map("".join, itertools.product("^abé$x", repeat=n)) if rng.random() < 0.5}
        frequent = {g: n for g, n in grams.items() if len(g) == 2 or g[:-1] in grams}
        a, b = spelling.cut(w, frequent), spelling.cut(v, frequent)
        shared = sum((Counter(g for _, g in a) & Counter(g for _, g in b)).values())
        assert shared >= max(len(a) - spelling.affected(a, len(w)), len(b) - spelling.affected(b, len(v))) >= 1
        if w == v or len(v) < 5:
            continue
        one, two = spelling.lists_of(w, frequent), spelling.lists_of(v, frequent)
        roles = {spelling.EITHER: spelling.EITHER, spelling.SHORTER: spelling.LONGER, spelling.LONGER: spelling.SHORTER}
        assert {(key, roles[role]) for key, role in one} & set(two)


def test_dictionary_holds_frequent_grams_only(spark):
    words = spark.createDataFrame([(f"station{chr(97 + k % 26)}{chr(97 + k // 26)}", 3) for k in range(200)], "word string, n long")
    found = spelling.gram_dictionary(words)
    assert found["stati"] == 200 and found["^sta"] == 200 and all(n > spelling.RARE and len(g) <= spelling.MOST_GRAM for g, n in found.items())
    assert all(len(g) == 2 or g[:-1] in found for g in found)


# token alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    whole, model = Tokenizer.from_file(alignment.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    whole.encode_special_tokens = True
    # Byte-level characters: printable Latin-1 bytes are themselves, the other 68 follow from U+0100 on.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    to_byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
    piece = lambda k: bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
    texts, counts = [], Counter()
    for doc_id, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        in_a, in_b = ([bytes(to_byte[c] for c in whole.id_to_token(k)) for k in a], [piece(k) for k in b])
        if not text or not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
            texts.append((doc_id, [], [], 0, [], ""))
            continue
        # Every byte belongs to one token of each: links are the pairs of neighbours in the two lists of owners.
        own_a, own_b = ([k for k, t in enumerate(side) for _ in t] for side in (in_a, in_b))
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(own_a, own_b))]
        ends = [k for k in range(1, len(own_a) + 1) if k == len(own_a) or own_a[k] != own_a[k - 1] and own_b[k] != own_b[k - 1]]
        groups = []
        for x, y in zip([0, *ends], ends):
            groups.append(",".join(str(a[i]) for i in dict.fromkeys(own_a[x:y])) + "|" + ",".join(str(b[j]) for j in dict.fromkeys(own_b[x:y])))
        counts.update(links)
        texts.append((doc_id, a, b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return Counter((i, len(a), len(b), g, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, a, b, g, links, sha in texts)


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_by_brute_force(spark, sf, broadcast_pairs):
    odd = table(spark).select("doc_id", "text", "n", "pair")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "n_chars as n", "doc_id as pair")
    both = docs.unionAll(odd).repartition(3)
    out = alignment.align_corpus(both, broadcast_pairs=broadcast_pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter(tuple(r) for r in out.collect())
    assert got == plain_alignment([(r.doc_id, r.text) for r in both.collect()])
    assert alignment.align_corpus(both.limit(0), broadcast_pairs=broadcast_pairs).count() == 0


def test_windows_are_remembered_and_a_full_memory_changes_nothing(monkeypatch):
    a, b = alignment.byte_level_side(alignment.BYTE_LEVEL), alignment.piece_side(alignment.PIECES)
    texts = ["the house and the house and the tree", "the tree", "x" * 3000 + " the house", "no\tspaces\there " * 40]
    memo = alignment.Memo(a, b)
    first = alignment.align_texts(texts, a, b, memo)
    assert 0 < len(memo.known) < len(memo.texts) + 1 and all(len(x) <= 4 * alignment.REMEMBERED_TOKENS + 4 for x in memo.known)
    again = alignment.align_texts(texts, a, b, memo)
    monkeypatch.setattr(alignment, "REMEMBERED_TOKENS", -1)
    none = alignment.align_texts(texts, a, b, alignment.Memo(a, b))
    for x, y, z in zip(first, again, none):
        assert x[:5] == y[:5] == z[:5] and list(x[5]) == list(y[5]) == list(z[5]) and list(x[6]) == list(y[6]) == list(z[6])


def test_long_stretches_and_fast_path_give_the_library_s_ids():
    from tokenizers import Tokenizer

    side, whole = alignment.byte_level_side(alignment.BYTE_LEVEL), Tokenizer.from_file(alignment.BYTE_LEVEL)
    whole.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t'stlé1２.,<|你🙂 　") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += [t for t in ODD if t] + ["q" * 100_000, " " * 5000 + "x", "\n" * 3000, "ab" * 50_000]
    assert [alignment.long_stretch(t) for t in texts[-4:]] == [True] * 4 and not any(map(alignment.long_stretch, ["word " * 9999, "x" * 999]))
    assert [x.tolist() for x in side.encode(texts)] == [whole.encode(" " + t, add_special_tokens=False).ids for t in texts]
