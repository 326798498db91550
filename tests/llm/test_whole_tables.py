"""Registered queries and the pipeline against plain loops over whole tables, for what SQL doesn't express."""

import hashlib
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tidecal.llm import licenses, mixing, pii, quality_model, quality_rules, queries, simhash


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated(found):
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    return len({j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)})


def test_op1(spark, sf, documents):
    rows = queries.op1_quality_rules(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(documents))
    rules = set()
    for r in rows:
        text = documents[r.doc_id].text or ""
        found, lines = words(text), [x for x in text.split("\n") if words(x)]
        n = len(found)
        assert (r.n_words, r.word_chars, r.n_symbols) == (n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated(found))
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n)
        assert r.kept == (not r.base_failed and r.rule is None)
        rules.add(r.rule)
        most = max(n, 1)
        have = {
            "symbol_rate": r.n_symbols / most, "repeat_rate": r.n_repeat_words / most, "distinct_rate": len(set(found)) / most, "shout_rate": text.count("!") / most,
            "mean_word": r.word_chars / most, "dup_line_rate": r.n_dup_lines / max(len(lines), 1), "n_words": n,
        }
        for condition in r.rule.split(" and ") if r.rule else ():
            name, sign, cut = condition.split()
            assert (have[name] > float(cut) - 6e-4) if sign == ">" else (have[name] <= float(cut) + 6e-4)
    assert set(quality_rules.FEATURES) >= {c.split()[0] for rule in rules if rule for c in rule.split(" and ")}


def keeps_short_words(notice, found):
    """Words of up to four letters stand unchanged in what was found, in their order."""
    at, have = 0, found.split(" ")
    for word in notice.split(" "):
        if len(word) <= 4:
            while at < len(have) and have[at] != word:
                at += 1
            if at == len(have):
                return False
            at += 1
    return True


def test_op5(spark, sf, documents):
    for r in queries.op5_license_scans(spark, sf).collect():
        text = documents[r.doc_id].text or ""
        found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(found), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        joined, fuzzy = " ".join(found), set()
        for notice, label in licenses.NOTICES.items():
            m = regex.search(rf"(?b)(?<![^ ])(?:{notice}){{e<={min(3, len(notice) // 10)}}}(?![^ ])", joined)
            if m and keeps_short_words(notice, m[0]):
                fuzzy.add(label)
        assert set(filter(None, r.labels.split(","))) == {x for _, x in places} | fuzzy
        for span in filter(None, r.spans.split(",")):
            label, start, end, _ = span.split(":")
            assert label in r.labels.split(",") and licenses.word_spans(text[int(start) : int(end)])
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted((m.start(), pii.KINDS.index(kind), kind, m.end()) for kind, m in out)


def made_up(kind, s):
    """The make-up of a span that the tagger adds, stated anew: kind by kind."""
    digits = re.sub("[^0-9]", "", s)
    if s != s.strip():
        return False
    if kind == "email":
        return bool(re.search(r"\w\s?(@|\(at\)|\[at\])\s?\w", s)) and "." in s
    if kind == "ip":
        return bool(re.fullmatch(r"\d{1,3}(?:[.:-]\d{1,3}){3}", s)) and all(int(x) < 256 for x in re.findall(r"\d+", s))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return 9 <= len(digits) <= 15 and set(s) <= set("+0123456789() ./-")


def luhn_number(rng):
    d = [rng.randint(1, 9)] + [rng.randint(0, 9) for _ in range(14)]
    return "".join(map(str, d)) + next(str(c) for c in range(10) if sum(x - 9 * (x > 9) for x in [v * (1 + k % 2) for k, v in enumerate(reversed([*d, c]))]) % 10 == 0)


def test_op6(spark):
    """The whole table with planted documents: base spans as the patterns, planted forms found, nothing else made up."""
    rng = random.Random(5)
    planted = {}
    for k in range(80):
        form, name, card = k % 4, f"{rng.choice(['anna', 'jo', 'max'])}.{rng.choice(['berg', 'lee', 'rossi'])}{rng.choice(['', 7, 42])}", luhn_number(rng)
        n = [str(rng.randint(0, 9)) for _ in range(10)]
        kind, span = (
            ("email", f"{name}{rng.choice(['(at)', ' @ ', '[at]'])}mail{k}.org"), ("ip", rng.choice(":-").join(str(rng.randint(0, 255)) for _ in range(4))),
            ("card", rng.choice("._/").join(card[i : i + 4] for i in range(0, 16, 4))), ("phone", rng.choice(["{}-{}-{}", "({}) {}-{}", "{} {} {}"]).format("5" + "".join(n[:2]), "".join(n[2:5]), "".join(n[5:9]))),
        )[form]
        text = "the note that we found says only this much, " + span + " and then goes on for a while"
        planted[1_000_000 + k] = (text, f"{kind}:44:{44 + len(span)}")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, (t, _) in planted.items()], docs.schema))
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    added, hit = 0, 0
    # As the query does it, but that the tagger isn't fitted on the planted texts, whose spans the patterns miss.
    for r in pii.find_pii(both, pii.fit(docs)).collect():
        text = texts[r.doc_id]
        base = plain_spans(text)
        assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        written = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(written) <= set(spans) and [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
        for kind, a, b in (x.split(":") for x in set(spans) - set(written)):
            assert made_up(kind, text[int(a) : int(b)])
            added += r.doc_id not in planted
        hit += r.doc_id in planted and planted[r.doc_id][1] in spans
    assert hit >= 64 and added <= 10, (hit, added)


def test_pipeline_by_plain_loops(spark, sf, documents):
    """Every stage on its own input: models are fitted as the stages do, all decisions are taken row by row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {i: r for i, r in documents.items() if model.score([r.text])[0] >= 0.5}
    assert 0 < len(kept) < len(documents)
    good = corpus_pipeline.quality_stage(spark, docs, sf)
    assert {r.doc_id for r in good.select("doc_id").collect()} == set(kept)

    prints = {i: simhash.fingerprint(r.text) & (2**64 - 1) for i, r in kept.items()}
    root = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            low = min(root[j] for j in kept if (prints[i] ^ prints[j]).bit_count() <= 4)
            changed |= low != root[i]
            root[i] = min(root[i], low)
    single = {i for i in kept if root[i] == i}
    assert len(single) < len(kept)
    one = docs.where(F.col("doc_id").isin(list(kept)))
    assert Counter(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, one, sf).select("doc_id").collect()) == Counter(single)

    some = docs.where(F.col("doc_id").isin(list(single)))
    tagger = pii.fit(some)
    clean = {i: pii.redact_text(kept[i].text, pii.all_spans([kept[i].text], tagger)[0][1]) if kept[i].text is not None else None for i in single}
    cleaned = corpus_pipeline.personal_data_stage(spark, some, sf)
    assert {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()} == {i: (t, None if t is None else len(t)) for i, t in clean.items()}

    rows = spark.createDataFrame([(i, t, kept[i].lang, kept[i].source, 0) for i, t in clean.items()], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(rows).collect()}
    mixed = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, rows, sf).select("doc_id").collect())
    assert mixed == Counter({i: n for i, n in copies.items() if n})

    last = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in last) == Counter({(i, len(words(clean[i]))): n for i, n in mixed.items()})
    for bucket in {r.bucket for r in last}:
        inside = [r for r in last if r.bucket == bucket]
        assert all(n <= inside[0].batch_rows for n in Counter(r.batch for r in inside).values()) and max(r.n_tokens for r in inside) == max(r.bucket_len for r in inside)
