"""Fill-in-the-middle, SimHash and ranked lexical search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import brute
from gaugeflow.llm import bpe, fim, langid, lexical, packing, simhash
from gaugeflow.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def awkward():
    return [(k * 3 + 1, t) for k, t in enumerate(brute.awkward_texts())]


# --- fill in the middle


def test_wavelet_matrix_counts_and_locates():
    draw = np.random.RandomState(1)
    for size in (0, 1, 63, 64, 65, 1000):
        codes = draw.randint(0, 6, size).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(codes), np.arange(size + 1)
        for code in range(8):
            assert matrix.rank(code, at).tolist() == [int((codes[:i] == code).sum()) for i in at]
        wanted = np.flatnonzero(np.isin(codes, [1, 4])) + 1
        nth = np.arange(1, len(wanted) + 1)
        assert matrix.locate([1, 4], nth, np.zeros_like(nth), np.full_like(nth, size)).tolist() == wanted.tolist()


UNIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^ \t\r\v\f\n]*[ \t\r\v\f\n]|[^ \t\r\v\f\n]+", "character": r"(?s:.)"}


def plain_cut(doc_id, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_equal_a_plain_version(spark, awkward):
    rnd = random.Random(3)
    piece = ["a", "é", "漢", "🙂", "\n", "\n", " ", ". ", "! ", "<", ">", "S", "<P", "P>", "1,5"]
    rows = awkward + [(1000 + k, "".join(rnd.choice(piece) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    rows += [(None, "no id\nhere"), (5000, "has <M> mark\nline"), (5001, "same\n"), (5001, "same\n"), (5002, "x\n" * 50_000), (5003, "\n" * 300 + "end")]
    df = docs(spark, rows).withColumns({"_text": F.lit("kept"), "form": F.lit("replaced")})
    for unit in UNIT:
        made = fim.transform(df, unit=unit, rate=80).withColumn("back", fim.restored("output", "form"))
        assert made.columns == ["doc_id", "lang", "source", "n_chars", "_text", *(f.name for f in fim.FIELDS), "back"]
        found = Counter((r.doc_id, r.units, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
        assert found == Counter((i, *plain_cut(i, t, unit, rate=80), t or "") for i, t in rows), unit
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_marks_that_cannot_be_told_apart():
    fim.check_marks(("<P>", "<S>", "<M>"))
    for marks in (("a", "a", "b"), ("", "a", "b"), ("<a", "a>", "x"), ("aa", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.check_marks(marks)


# --- written matrices


def test_matrices_are_written_and_read_back(spark, awkward, tmp_path):
    rows = awkward + [(None, "null id"), (9000, "again and again"), (9000, "again and again")]
    df = docs(spark, rows).withColumns({"ids": F.lit("clash"), "pack": F.lit(-1), "n_tokens": F.lit("x")})
    path = str(tmp_path / "matrices")
    packing.write_matrices(df, path, context=128, group_tokens=5000)
    found = packing.read_matrices(spark, path).collect()
    assert len({r.pack for r in found}) == len(found)
    parts = Counter()
    for r in found:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == 128 and r.n_tokens == r.cu_seqlens[-1] <= 128 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.position_resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
        for doc_id, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[doc_id, offset, ids[a:b].tobytes()] += 1
    want = Counter((i, k, packing.byte_ids(t)[k : k + 128].tobytes()) for i, t in rows for k in range(0, len(packing.byte_ids(t)), 128))
    assert parts == want


def test_wide_ids_and_ids_outside_the_vocabulary(spark):
    wide = [(1, np.array([70000, 5, 2**31])), (2, np.array([], np.int64))]
    ((segments, row),) = packing.pack_rows(wide, 8, vocabulary=2**32)
    assert row.dtype == np.uint32 and row.tolist() == [70000, 5, 2**31, 0, 0, 0, 0, 0] and segments == [(1, 0, 3)]
    for ids, vocabulary in (([70000], 65536), ([-1], 65536), ([300], 259)):
        with pytest.raises(OverflowError):
            list(packing.pack_rows([(1, np.array(ids))], 8, vocabulary))
    with pytest.raises(OverflowError):
        packing.id_type(2**33)
    path, text = tokenizer_path(), docs(spark, [(1, "the cat sat on the mat"), (2, None)])
    made = packing.packed(text, 16, encode=lambda t: np.array(bpe.vocabulary(path).encode(t), np.int64), vocabulary=50304).first()
    assert bpe.vocabulary(path).decode(np.frombuffer(made.ids, np.uint16)[: made.cu_seqlens[-1]].tolist()) == "the cat sat on the mat"


# --- languages


def test_dictionaries_of_headed_texts(spark):
    """Texts that all open alike, far longer than what a prefix would take; a language of copies; few long texts."""
    rnd = random.Random(9)
    words = {lang: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)] for lang in ("aa", "bb", "cc")}
    header = " ".join("".join(rnd.choice("xyzw") for _ in range(6)) for _ in range(800))
    text = lambda lang, n: header + " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang, 300), lang, "s") for k, lang in enumerate(["aa", "bb"] * 300)]
    rows += [(1000 + k, rows[0][1], "aa", "s") for k in range(3000)]  # copies
    rows += [(5000 + k, " ".join(rnd.choice(words["cc"]) for _ in range(20_000)), "cc", "s") for k in range(3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS).repartition(4)
    learned = langid.dictionaries(langid.language_samples(df))
    assert list(learned) == ["aa", "bb", "cc"] and all(len(d) == langid.DICTIONARY_BYTES for d in learned.values())
    test = [(k, header * (lang != "cc") + " ".join(rnd.choice(words[lang]) for _ in range(60)), lang, "s", 1) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    found = langid.predict(spark.createDataFrame(test, DOCS), learned).collect()
    assert sum(r.lang == r.lang_pred and not r.rejected for r in found) > 0.95 * len(test)
    # The choice is the dictionary that makes the blocks of a text smallest.
    for _, value, _, _, _ in test[:20]:
        sizes = {}
        for lang, data in learned.items():
            book = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=book, write_content_size=False, write_dict_id=False)
            raw = value.encode()
            sizes[lang] = sum(len(packer.compress(raw[k : k + langid.BLOCK_BYTES])) for k in range(0, len(raw), langid.BLOCK_BYTES))
        low, second = sorted(sizes.values())[:2]
        got = langid.compressors(tuple(learned.items())).predict(value)
        assert sizes[got[0]] <= low * 1.001 and got[1] == pytest.approx(1 - low / second, abs=2e-3)


def test_languages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "abc def", "aa", "s", 1), (1, "abc def", "aa", "s", 1), (2, None, "bb", "s", 1), (3, "...", None, "s", 1)], DOCS)
    learned = langid.dictionaries(langid.language_samples(df))
    assert list(learned) == ["aa"]
    clash = df.withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "draw": F.lit(0)})
    found = langid.predict(clash, learned)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "draw", "lang_pred", "score", "rejected"]
    assert Counter((r.doc_id, r.lang_pred) for r in found.collect()) == Counter([(1, "aa"), (1, "aa"), (2, "und"), (3, "und")])
    empty = langid.dictionaries(langid.language_samples(df.limit(0)))
    assert empty == {} and langid.predict(df.limit(0), empty).count() == 0
    same = {"first": b"abcdefgh " * 20, "second": b"abcdefgh " * 20}  # equal sizes
    assert {r.lang_pred for r in langid.predict(df.filter("doc_id = 1"), same).collect()} == {"first"}


# --- SimHash


def plain_fingerprint(text):
    words = brute.WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints, radius=4):
    """doc_id -> smallest doc_id reachable, for (doc_id, fingerprint)."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_equal_a_plain_version(spark, awkward):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    base = [rnd.choice(words) for _ in range(400)]
    rows = awkward + [(1000 + k, " ".join(base[: 400 - k] + [f"new{k}"] * (k % 4))) for k in range(40)] + [(2000, "")]
    df = docs(spark, rows + [(None, "null id"), (1, None)]).withColumns({"fingerprint": F.lit(1), "node": F.lit("x")})
    found = simhash.near_duplicates(df).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(prints)
    assert len(found) == len(rows) + 2
    assert Counter(r for r in found if r.doc_id is not None) == Counter([(i, f"{prints[i]:016x}", want[i]) for i in prints] + [(1, "0" * 16, 1)])
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert len(set(want.values())) < len(rows) - 10  # there are links to find
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dense_and_chained_fingerprints(spark, monkeypatch):
    """Links of every distance, dense balls and chains, with cells of several finenesses."""
    rnd = random.Random(5)
    flip = lambda fp, bits: fp ^ sum(1 << b for b in rnd.sample(range(64), bits))
    prints = [rnd.getrandbits(64) for _ in range(150)]
    prints += [flip(rnd.choice(prints), rnd.randint(0, 6)) for _ in range(400)]
    ball = rnd.getrandbits(64)
    prints += [flip(ball, rnd.randint(0, 4)) for _ in range(300)]
    chain = [rnd.getrandbits(64)]
    for _ in range(60):
        chain.append(flip(chain[-1], 4))
    prints = dict(enumerate(rnd.sample(prints + chain, len(prints) + len(chain))))
    want = plain_components(prints)
    rows = spark.createDataFrame([(i, simhash.signed(fp)) for i, fp in prints.items()], "doc_id long, fingerprint long").repartition(3)
    monkeypatch.setattr(simhash, "fingerprints", lambda documents, words: documents)
    for meetings in (1000, 50, 2):
        monkeypatch.setattr(simhash, "MEETINGS", meetings)
        found = simhash.near_duplicates(rows).collect()
        assert {r.doc_id: r.component_id for r in found} == want, meetings


def test_embedding_is_a_lower_bound(spark):
    rnd = random.Random(6)
    pairs = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(300)]
    ones = lambda fp: [(fp >> 2 * s & 3).bit_count() for s in range(32)]
    df = spark.createDataFrame([tuple(map(simhash.signed, p)) for p in pairs], "a long, b long")
    found = df.select(simhash.distance(simhash.unary(F.col("a")), simhash.unary(F.col("b"))).alias("l1"), simhash.distance(F.col("a"), F.col("b")).alias("h")).collect()
    assert [r.l1 for r in found] == [sum(abs(x - y) for x, y in zip(ones(a), ones(b))) for a, b in pairs]
    assert all(r.l1 <= r.h for r in found)
    for k in range(1, 29):
        masks = simhash.block_masks(k + 4)
        assert sum(masks) == 2**64 - 1 and len(simhash.choices(k)) == math.comb(k + 4, k) if k < 5 else sum(masks) == 2**64 - 1


# --- ranked search


def plain_search(rows, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    docs_n, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * docs_n) // total
            weigh = lambda t: math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1)))
            score = sum(weigh(t) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in cut(text))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def corpus(rnd, n):
    words = [f"t{int(rnd.paretovariate(0.7)) % 400}" for _ in range(2000)] + ["Ünï", "漢字", "x-y", "A1"]
    text = lambda size: " ".join(rnd.choice(words) for _ in range(size))
    return [(k, text(rnd.choice([0, 1, 3, 20, 60, 300]))) for k in range(n)], text


def test_search_equals_a_plain_version(spark, awkward, monkeypatch):
    rnd = random.Random(7)
    rows, text = corpus(rnd, 400)
    rows += [(1000 + i, t) for i, t in awkward] + [(7, "t1 t2"), (7, "t1 t2"), (None, "t1 t2"), (None, "t1 t2"), (2000, "t3 " * 30_000)]
    rows += [(3000 + k, "same words here t5") for k in range(40)]
    items = [(k, text(rnd.randint(1, 30))) for k in range(30)] + [(99, None), (98, ""), (97, "never seen"), (96, "Same WORDS same"), (96, "Same WORDS same"), (None, "t1")]
    df = docs(spark, rows).withColumns({"score": F.lit(1), "item": F.lit("x"), "rank": F.lit(0)})
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    want = plain_search(rows, items)
    found = lambda: Counter(map(tuple, lexical.top_documents(df, asked).collect()))
    assert found() == want
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 500)  # several blocks of items
    monkeypatch.setattr(lexical, "BUCKETS", 16)  # loose bounds
    assert found() == want
    assert lexical.top_documents(df.limit(0), asked).count() == 0
    assert lexical.top_documents(df, asked.limit(0)).count() == 0


def test_bounds_hold_and_spare_documents():
    rnd = random.Random(8)
    rows, text = corpus(rnd, 600)
    items = lexical.Items([text(12) for _ in range(10)])
    texts = [t for _, t in rows]
    words = [lexical.terms(t) for t in texts]
    n_docs, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(items.vocabulary[t] for w in words for t in set(w) if t in items.vocabulary)
    weighed = items.weigh(n_docs, df)
    sketcher = lexical.Sketcher(weighed)
    for w in words[:100]:
        counts, norm = Counter(w), lexical.length_norm(len(w), n_docs, total)
        if w:
            bounds = sketcher.bounds(sketcher.sketch(counts, norm)[None])[0]
            assert all(b >= lexical.exact(item, counts, norm) for b, item in zip(bounds, weighed))
    best = [lexical.Best(5) for _ in weighed]
    scored = lexical.search_batch(sketcher, weighed, best, list(range(600)), texts, n_docs, total)
    assert scored < 0.2 * 10 * n_docs


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_near_fingerprints", "op13_ranked_search"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 200
