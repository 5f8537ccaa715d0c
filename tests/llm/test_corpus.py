"""Operators on documents against brute force, with awkward rows, empty tables and clashing columns."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

import brute
from gaugeflow.llm import bpe, langid, mixing, neardup, pii, quality
from gaugeflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], DOCS).repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    texts = brute.awkward_texts()
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def test_bpe_equals_the_library(spark, awkward):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", " \n", "1", "'s", "'ll", "é", "漢", "🙂", "՘", " ", "　", "\x1c", "<|endoftext|>", "!", "...", "\r\n", "́"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 15))) for _ in range(400)]
    texts += ["a" * 3000, " " * 999, "=-" * 700, "abcé" * 500]
    rows = awkward + [(10_000 + k, t) for k, t in enumerate(texts)]
    found = by_id(bpe.round_trip(docs(spark, rows).select("doc_id", "text"), tokenizer_path()))
    for i, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text
        assert found[i].decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_encode_then_decode(spark, awkward):
    df = docs(spark, awkward).withColumn("ids_before", F.lit(1))
    coded = bpe.encode(df.select("doc_id", "text", "ids_before"), tokenizer_path())
    back = by_id(bpe.decode(coded, tokenizer_path()))
    assert all(back[i].decoded == (t or "") for i, t in awkward)
    assert dict(bpe.encode(df.withColumn("ids", F.lit(1)), tokenizer_path()).dtypes)["ids"] == "array<int>"
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == 0


def test_bpe_gathers_a_batch_at_once():
    """Texts with and without special tokens and odd spaces in one batch; ids come as arrays, with their digits and bytes."""
    from tokenizers import Tokenizer

    whole, vocab = Tokenizer.from_file(tokenizer_path()), bpe.Vocabulary(tokenizer_path())
    rnd = random.Random(16)
    parts = ["the", " word", " the", "  ", "\n", " \n", "<|endoftext|>", "é", "🙂", "\0", " 12", "!", " " + "x" * 60]
    for _ in range(8):
        texts = [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(80)), "<|endoftext|>" * 2]
        for text, ids in zip(texts, vocab.encode_batch(texts), strict=True):
            want = whole.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want, text
            assert vocab.decimals(ids) == ",".join(map(str, want)).encode() and vocab.decode(ids) == (text or "")
    assert vocab.encode_batch([]) == []
    # The merges that an array of ranks yields are those of the vocabulary.
    assert all(vocab._made[rank] == made for rank, made in vocab.merge.values())
    with pytest.raises((KeyError, IndexError, TypeError)):
        vocab.decode([-1])


def test_scan_and_heap_agree():
    vocab = bpe.vocabulary(tokenizer_path())
    rnd = random.Random(3)
    for n in (2, 3, 7, 20, 63, 64):
        words = ["".join(rnd.choice("etaoinshr") for _ in range(n)).encode() for _ in range(50)]
        assert [list(x) for x in vocab._scan(words)] == [vocab._heap(w) for w in words]


def test_quality_counts(spark, awkward):
    ratios = quality.fit(docs(spark, awkward), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    found = by_id(quality.judge(docs(spark, awkward).select("doc_id", "text", "source"), ratios))
    for i, text in awkward:
        want = brute.quality_counts(text)
        assert tuple(found[i][c] for c in quality.COUNTS) == want, text
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert found[i].base_failed == failed and (not failed or not found[i].kept)


def test_quality_verdict_by_likelihood_ratio(spark):
    rnd = random.Random(4)
    text = lambda words: " ".join(rnd.choice(words) for _ in range(80))
    good, junk = [f"good{k}" for k in range(30)], [f"junk{k}&&" for k in range(30)]
    rows = [(k, text(good if k % 5 else junk)) for k in range(400)]
    labels = spark.createDataFrame([(k, 1) for k in range(400) if k % 5 and k % 2], "doc_id long, quality int")
    df = docs(spark, rows)
    found = by_id(quality.judge(df.select("doc_id", "text"), quality.fit(df, labels, smoothing=0.2)))
    assert all(r.base_failed or r.kept == bool(i % 5) for i, r in found.items())
    ratios = quality.fit(df.limit(0), labels)  # nothing counted: only base rules decide
    assert not ratios.any()


def test_languages(spark):
    rnd = random.Random(5)
    words = {lang: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(9)) for _ in range(100)] for lang in ("aa", "bb", "cc")}
    text = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(60))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    df = docs(spark, rows)
    learned = langid.dictionaries(langid.language_samples(df.filter(~langid.held_out())))
    assert sorted(learned) == ["aa", "bb", "cc"] and all(len(d) <= langid.DICTIONARY_BYTES for d in learned.values())
    test = rows + [(900, None, None), (901, "", None), (902, "12 !?", None), (903, text("aa") * 300, None)]
    found = by_id(langid.predict(docs(spark, test).select("doc_id", "text"), learned))
    assert all(found[i].lang_pred == lang for i, _, lang in rows)
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in found.values())
    none = langid.dictionaries(langid.language_samples(df.filter("lang is null")))
    assert {r.lang_pred for r in langid.predict(df.select("doc_id", "text"), none).collect()} == {"und"}


def test_pii_base_spans(spark, awkward):
    texts = [
        "mail a.b@c.de and x@y, a@b@c.com_d@e.f-g.h é@ü.de", "ip 1.2.3.4.5.6.7.8 300.1.1.1 0255.001.2.3", "card 4111 1111 1111 1111, 4111111111111112 4111-1111-1111-1111x",
        "+1 (017) 555-7713 and +49 30 1234 and +1234567890123456 ++12345678 + 1234567", "🙂🙂 +1 (017) 555-7713 🙂 a@b.co", "1234567@x.com 4111 1111 1111 1111+1 234 567 890",
        "7" * 400, "1.2." * 300 + "+1 222 333 44", "9" * 16 + "@" + "a.b" * 50, "(" * 50 + "+4" + " " * 60, "no 9807915762804490 here",
    ]
    rnd = random.Random(6)
    texts += ["".join(rnd.choice(["1", "22", "345", "4111111111111111", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "\n"]) for _ in range(30)) for _ in range(300)]
    rows = awkward + [(50_000 + k, t) for k, t in enumerate(texts)]
    df = docs(spark, rows)
    selector = pii.fit(df)
    found = by_id(pii.spans(df.select("doc_id", "text", "lang"), selector))
    clean = by_id(pii.redacted(df, selector))
    for i, text in rows:
        want = brute.base_spans(text)
        assert {k: [tuple(s) for s in found[i][k]] for k in want} == want, text
        if text is None:
            assert clean[i].text is None
        elif not any(want.values()) and not found[i].number and not found[i].address:
            assert clean[i].text == text
        elif i < 50_004:  # a few that do not run into each other
            assert not any(brute.base_spans(clean[i].text).values())
    assert pii.spans(df.limit(0), selector).count() == 0


def redact_plainly(text, found):
    """Spans merged where they overlap; the mark is that of the first, longest one."""
    kinds = ["email", "ip", "card", "phone", "number", "address"]
    out, end = "", 0
    merged = []
    for start, back, _, kind in sorted((s[0], -s[1], n, k) for n, k in enumerate(kinds) for s in found[k]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -back)
        else:
            merged.append([start, -back, kind])
    for start, stop, kind in merged:
        out, end = out + text[end:start] + f"[{kind.upper()}]", stop
    return out + text[end:]


def test_pii_redacts_every_span_of_the_original_text(spark):
    texts = [
        "ask jane+4915112345678@example.com now", "root@10.20.30.40", "x 4111 1111 1111 1 111.2.3.4 y", "1.2.3.4+49 151 12345678", "1234567@x.com 4111 1111 1111 1111+1 234 567 890",
        "🙂" * 5000 + " a@b.co " + "é" * 9000 + "+1 (017) 555-7713", "1.2.3.4 " * 300, "a@b.c" * 200, "none", "", "4111111111111111" + "x" * 4096 + "a@b.c",
    ]
    rnd = random.Random(11)
    texts += ["".join(rnd.choice(["1", "22", "345", "4111111111111111", "1.2.3.4", "+49151123", ".", " ", "-", "+", "(", "@", "a", "b.c", "é", "\n"]) for _ in range(30)) for _ in range(300)]
    df = docs(spark, list(enumerate(texts)))
    for selector in (pii.fit(df), pii.fit(df.limit(0))):
        found, clean = by_id(pii.spans(df.select("doc_id", "text"), selector)), by_id(pii.redacted(df, selector))
        assert all(clean[k].text == redact_plainly(t, found[k]) for k, t in enumerate(texts))
        assert all(found[k][kind] == brute.base_spans(t)[kind] for k, t in enumerate(texts) for kind in pii.KINDS)
        assert [clean[k].text for k in range(4)] == ["ask [EMAIL] now", "[EMAIL]", "x [CARD] y", "[IP][PHONE]"]


def test_pii_selects_what_looks_like_the_fixed_formats(spark):
    rnd = random.Random(7)

    def card(passes):
        while True:
            number = "".join(rnd.choice("0123456789") for _ in range(16))
            if brute.luhn(number) == passes:
                return number

    rows = [(k, f"some words {card(k % 3 == 0)} then others") for k in range(120)] + [(k, f"in the years 2003-2004 or part x12345678y of {k}") for k in range(200, 300)]
    df = docs(spark, rows)
    found = by_id(pii.spans(df.select("doc_id", "text"), pii.fit(df)))
    assert all(len(found[k].card) + len(found[k].number) == 1 for k in range(120))
    assert not any(found[k].number for k in range(200, 300))


def test_pii_selects_numbers_in_formats_without_a_fixed_one(spark):
    """Formats that no fixed span has, two in a run, and one beside a fixed span; long runs and codes teach what is none."""
    rnd = random.Random(12)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    bad = lambda: next(c for c in iter(lambda: digits(16), None) if not brute.luhn(c))
    rows = [(k, f"some words 4111 1111 1111 1111 and 4111111111111111 or +49 30 {digits(3)} {digits(4)} or +1 (017) 555-{digits(4)} or 10.20.30.{k} x") for k in range(100)]
    rows += [(100 + k, f"sum {' '.join(digits(24))} y token a{digits(8)}b") for k in range(100)]
    a, b = bad(), bad()
    asked = {
        "call (555) 123-4567 now": ["555) 123-4567"], "nr 078-05-1120 is": ["078-05-1120"], "from 0171 5557713 on": ["0171 5557713"], f"both {a} {b} there": [a, b],
        f"by 10.20.30.40 {a} there": [a], "token a12345678b": [],
    }
    found = by_id(pii.spans(docs(spark, list(enumerate(asked))).select("doc_id", "text"), pii.fit(docs(spark, rows))))
    assert {t: [t[s.start : s.end] for s in found[k].number] for k, t in enumerate(asked)} == asked


def test_pii_learns_from_every_proposal(spark):
    """More proposals than any bound on them; copies of a text count once."""
    rnd = random.Random(15)
    runs = [[str(rnd.randrange(10 ** rnd.randint(1, 3))) for _ in range(30)] for _ in range(250)]
    texts = [f"sum {' '.join(run)} of 4111 1111 1111 1111" for run in runs]
    proposed = sum(len(" ".join(run[i : i + k])) >= pii.SHORTEST for run in runs for i in range(30) for k in range(1, min(20, 30 - i) + 1)) + len(runs)
    assert proposed > 50_000
    df = docs(spark, [(k, t) for k, t in enumerate(texts + texts[:40])])
    found = {r.label: r.n for r in pii.training_rows(df).groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    assert found == {0: proposed, 1: len(texts)}


def test_pii_overlaps_and_places_equal_plain_versions(spark):
    rnd = random.Random(15)
    cases = []
    for _ in range(200):
        spans = list({(a, a + rnd.randint(1, 9)) for a in (rnd.randrange(60) for _ in range(rnd.randint(1, 40)))})
        rnd.shuffle(spans)
        cases.append((sorted(rnd.sample(range(70), 20)), [(7 + a, 7 + b) for a, b in spans]))
    df = spark.createDataFrame(cases, "places array<int>, spans array<struct<start:int,end:int>>")
    got = df.select("places", "spans", pii.best_first(F.col("spans")).alias("best"), pii.inside_spans(F.col("places"), F.col("spans")).alias("inside")).collect()
    assert len(got) == 200
    for r in got:
        taken = []
        for a, b in r.spans:
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
        assert [tuple(x) for x in r.best] == sorted(taken)
        assert r.inside == [any(a <= p < b for a, b in r.spans) for p in r.places]


def test_pii_of_very_long_lists_of_numbers(spark):
    rnd = random.Random(16)
    ips = " ".join(f"10.{rnd.randrange(256)}.{rnd.randrange(256)}.7" for _ in range(85_000))
    numbers = " ".join(str(rnd.randrange(10**6, 10**7)) for _ in range(16_000))
    selector = pii.fit(docs(spark, [(k, f"call +49 30 12{k:06} or 10.2.3.{k} or 12 {k}") for k in range(200)]))
    selector.thresholds[False] = -1.0  # every proposal counts
    start = time.time()
    found = by_id(pii.spans(docs(spark, [(1, ips), (2, numbers)]).select("doc_id", "text"), selector))
    assert len(ips) > 1_000_000 and len(found[1].ip) == 85_000 and not found[1].number
    covered = sum(s.end - s.start for s in found[2].number)
    # Each number is in a span, joined to others or alone.
    assert covered >= 7 * 16_000 and time.time() - start < 120


def test_near_duplicates(spark, awkward):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    rows = list(awkward)
    for group in range(12):
        first = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for copy in range(8):
            other = list(first)
            for _ in range(copy // 2 * len(first) // 60):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            rows.append((1000 + 10 * group + copy, " ".join(other)))
    want, sizes = brute.components(rows)
    found = neardup.near_duplicates(docs(spark, rows + [(None, "null id"), (None, "one")])).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {i: r.component_id for i, r in by.items()} == want
    assert {i: r.n_shingles for i, r in by.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in by.values())
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)] * 2
    kept = neardup.kept_documents(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_one_of_a_group_stays_with_repeated_and_missing_ids(spark):
    rows = [(5, "one and the same text"), (1, "one and the same text"), (1, "one and the same text"), (None, "one and the same text"), (None, "one and the same text")]
    rows += [(1, "quite another text here"), (None, "alone without any id"), (None, "twice without an id"), (None, "twice without an id"), (8, None), (8, ""), (None, None)]
    df = docs(spark, rows).withColumns({c: F.lit(c) for c in ("_row", "_document", "node", "_id", "component_id")})
    kept = neardup.kept_documents(df)
    assert kept.columns == df.columns and {r._row for r in kept.collect()} == {"_row"}
    want = [(1, "one and the same text"), (1, "quite another text here"), (None, "alone without any id"), (None, "twice without an id"), (8, None), (8, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert neardup.kept_documents(df.limit(0)).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_pairs_across_components_are_found(spark):
    """Links that the first round leaves out: neither document is near the head of its bands."""
    common = [f"c{k}" for k in range(40)]
    a = common + [f"a{k}" for k in range(6)]
    b = common + [f"a{k}" for k in range(5)] + ["z"]
    head = common[:36] + [f"h{k}" for k in range(8)]
    rows = [(1, " ".join(head)), (2, " ".join(a)), (3, " ".join(b))]
    want, _ = brute.components(rows)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()} == want == {1: 1, 2: 2, 3: 2}


def test_connected(spark):
    rnd = random.Random(9)
    edges = [(k + 1, k) for k in range(100, 160)] + [(500 + k, 500) for k in range(1, 40)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(80)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {r.node: r.component for r in neardup.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: find(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s], left = most * sizes[s], left - most * sizes[s]
            free.discard(s)
    return target


def test_mixing(spark):
    rnd = random.Random(10)
    rows = [(k, " ".join("w" for _ in range(rnd.choice([0, 1, 30, 700]))), None, rnd.choice(["a", "B", "é", "é", "é", "é", None, "z"])) for k in range(400)]
    rows += [(900, None, None, "empty"), (901, "x " * 9000, None, "long"), (7, rows[7][1], None, rows[7][3]), (None, "no id", None, "z")]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    found = mixing.mixed_documents(df, block_words=64).collect()
    again = mixing.mixed_documents(df.repartition(7), block_words=64).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    sizes, of = {}, {}
    for i, text, _, source in rows:
        n = len(brute.WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        of.setdefault((i, n), source)
    target, taken = brute_targets(sizes), {}
    assert len(found) == len(rows)
    for r in sorted(found, key=key):
        source = of[(r.doc_id, r.size)]
        assert r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - t) < 1 for s, t in target.items())
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixed_documents(docs(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_mixed_texts_with_clashing_names(spark):
    rows = [(k, " ".join(f"w{k}" for _ in range(30)), None, "ab"[k % 2]) for k in range(40)]
    plain = docs(spark, rows)
    clashing = plain.withColumns({c: F.lit(c) for c in ("_row", "_size", "_taken", "_copy", "_words", "_document", "row", "size")})
    want = sorted((r.doc_id, r.text) for r in mixing.mixed_texts(plain).collect())
    found = mixing.mixed_texts(clashing)
    assert found.columns == clashing.columns and sorted((r.doc_id, r.text) for r in found.collect()) == want and len(want) > 40
    assert {tuple(r[c] for c in ("_row", "_size", "_words", "size")) for r in found.collect()} == {("_row", "_size", "_words", "size")}


def test_schedule_is_even_in_every_stretch(spark):
    sources = spark.createDataFrame([(0, 500), (1, 300), (2, 199), (3, 1), (4, 0)], "source_no int, slots long")
    order = [r.source_no for r in mixing.slot_schedule(sources, 1000).orderBy("slot").collect()]
    assert [order.count(k) for k in range(5)] == [500, 300, 199, 1, 0]
    assert all(abs(order[k : k + 100].count(0) - 50) <= 3 for k in range(0, 900, 37))
