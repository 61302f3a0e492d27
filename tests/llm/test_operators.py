"""The text operators on small tables: nulls, empty and long texts, repeats, extra columns, empty tables, and brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratalog.llm import op1_chosen_path, op2_token_files, op3_mixing, op4_quality, op5_licenses, op6_passages, op7_fingerprints, op8_pitman_yor, op9_packing, op10_sharding, words
from stratalog.llm.tokens import PATTERNS, Encoder, encoder, vocabulary_path

COLUMNS = "doc_id long, text string, lang string, component long, rank long"
random.seed(1)
WORDS = ["".join(random.choice("abcdeé") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


PASSAGE, COPY = prose(60), prose(120)
NEAR = COPY.split()
NEAR[60] = "changed"
TEXTS = [None, "", "one two", COPY, COPY, " ".join(NEAR), prose(90) + "\n" + PASSAGE, PASSAGE + "\n" + prose(80), "word " * 30000, prose(70) + " Released under the MIT License.", prose(5000), "日本 " + prose(60), " \n\t"]
ROWS = [(i, t, "en", 7, 9) for i, t in enumerate(TEXTS)] + [(3, COPY, "en", 7, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 1, 0), (8, 0, 0), (99, 1, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def test_join_equals_brute_force(docs, none):
    shingled = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").lower().split() for _, t, *_ in ROWS)]
    links = [sum(bool(a) and i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(shingled)) for i, a in enumerate(shingled)]
    got = op1_chosen_path.join(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r[0], n) for r, n in zip(ROWS, links))
    assert {r.class_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert op1_chosen_path.join(none).count() == 0


def test_join_of_large_groups_equals_brute_force(spark, monkeypatch):
    """Groups over a node's size, so that pivots, deeper levels and the comparison in blocks all take part."""
    monkeypatch.setattr(op1_chosen_path, "BLOCK", 16)
    rows = []
    for group in range(2):
        words = prose(100).split()
        for i in range(90):
            own = list(words)
            for at in random.sample(range(100), i % 4):
                own[at] = f"new{i}"
            rows.append((len(rows), " ".join(own), "en", 1, 1))
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (t.split() for _, t, *_ in rows)]
    near = [[j for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    first = list(range(len(rows)))
    for _ in rows:
        first = [min([first[i], *(first[j] for j in near[i])]) for i in range(len(rows))]
    got = op1_chosen_path.join(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (first[i], len(near[i])) for i in range(len(rows))}


def test_pieces_are_the_librarys(tmp_path):
    odd = ["a  b\n\n c'll 12 ''s !'s\x85x\xa0\xa0y", "İstanbul ſ ß ǅ", "<|endoftext|> x", "\x1c\x1d a\tb", "日本 語"] + ["".join(random.choice("ab'sS \n\t!|.09é\xa0\x1c\x85İß") for _ in range(40)) for _ in range(300)]
    for name in PATTERNS:
        encoder, library = Encoder(vocabulary_path(name), 7), Tokenizer.from_file(vocabulary_path(name))
        library.encode_special_tokens = True
        for text in odd:
            assert encoder.encode(text) == np.array([*library.encode(text, add_special_tokens=False).ids, 7], np.uint32).tobytes()


def test_special_tokens_in_texts_are_the_librarys():
    for name in PATTERNS:
        library = Tokenizer.from_file(vocabulary_path(name))
        contents = [t.content for t in library.get_added_tokens_decoder().values()]
        assert contents
        for text in [x for c in contents for x in (f"a{c} x", f"A {c.upper()}{c}b", c)] + ["a<|endoftext|> x", "plain"]:
            assert encoder(vocabulary_path(name), 7).encode(text) == np.array([*library.encode(text, add_special_tokens=False).ids, 7], np.uint32).tobytes()


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint32), np.array([2**32 - 1], np.uint32), rng.integers(0, 2**32, 1000, np.uint32), rng.integers(0, 50000, 777).astype(np.uint32), np.where(rng.random(5000) < 0.05, 2**31, 3).astype(np.uint32)):
        image = op2_token_files.pack(values)
        assert (op2_token_files.unpack(image) == values).all()
        if len(values) > 256:
            assert (op2_token_files.unpack(image, range(1, 2)) == values[128:256]).all()


def test_token_files(docs, none):
    path = vocabulary_path("byte_bpe_50k.json")
    library, at, want = Tokenizer.from_file(path), 0, []
    for doc, text, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op2_token_files.read(op2_token_files.write(docs, path)).collect())) == sorted(want)
    assert op2_token_files.read(op2_token_files.write(none, path)).count() == 0


def test_rates_reach_their_targets(spark, docs, none, labels):
    clean = [(i, prose(80), "en", 1, 1) for i in range(200)]
    toxic = [(i, prose(40) + " zzbad zzworse " + prose(40), "en", 1, 1) for i in range(200, 260)]
    low = [(i, "junk$$ " * 90, "en", 1, 1) for i in range(260, 320)]
    marked = spark.createDataFrame([(i, 0 if i >= 260 else 1, int(200 <= i < 260)) for i in range(320)], "doc_id long, quality int, toxic int")
    weights = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    got = op3_mixing.rates(spark.createDataFrame(clean + toxic + low, COLUMNS), marked, weights).toPandas()
    assert (got.rate >= 0).all() and got.loc[got.doc_id.between(200, 259), "p_toxic"].mean() > 0.8
    tokens = {d: (got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in weights}
    assert all(abs(tokens[d] / sum(tokens.values()) - w) < 0.01 for d, w in weights.items())
    assert op3_mixing.rates(docs, labels).count() == len(ROWS) and op3_mixing.rates(none, labels).count() == 0


def test_quality_counts_and_bounds(spark, docs, none, labels):
    got = {r.doc_id: r for r in op4_quality.judged(docs, labels).collect()}
    assert (got[8].n_words, got[8].n_repeat_words, got[8].base_failed, got[8].kept) == (30000, 30000, True, False)
    assert (got[0].n_words, got[0].base_failed) == (0, True) and got[10].kept
    for i, text, *_ in ROWS:
        words = (text or "").split(" ") if i != 8 else []
        windows = Counter(zip(words, words[1:], words[2:]))
        if i in (3, 10):
            assert got[i].n_repeat_words == len({p for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for p in (j, j + 1, j + 2)})
    assert op4_quality.judged(none, labels).count() == 0
    # 2000 good documents, of which 3 are over a cutoff: certified at 1 %; of 100 never
    import math

    from pyspark.sql import functions as F

    cdf = lambda n, k: sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
    cases = [(2000, 3), (2000, 9), (100, 0), (1200, 1), (5000, 30)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", op4_quality._certified(F.col("k"), F.col("n"), F.lit(0.001), 0.01).alias("ok"))
    assert {(r.n, r.k): r.ok for r in df.collect()} == {(n, k): cdf(n, k) <= 0.001 for n, k in cases}


def test_licenses(spark, none):
    texts = [prose(60) for _ in range(60)] + [None, "", "MIT License", "mit-license MIT\nLicense", "x GNU General Public License y general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "general permission is free"]
    got = {r.doc_id: r for r in op5_licenses.scan(spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)).collect()}
    assert (got[62].n_base, got[62].base_labels, got[62].first_word) == (1, "mit", 0)
    assert (got[63].n_base, got[63].first_word, got[63].last_word) == (2, 0, 2)
    assert (got[64].n_base, got[64].base_labels, got[64].last_word) == (2, "gpl", 6)
    assert (got[65].base_labels, got[65].labels) == ("", "mit") and got[65].score > 0.9
    assert got[66].labels == "" and got[60].n_words == 0 and got[0].first_word is None
    assert op5_licenses.scan(none).count() == 0


def test_licenses_that_many_documents_carry(spark):
    """A notice in a third of all rows, and tables of few rows."""
    for label in ("bsd", "isc", "mpl", "cc-by", "unlicense"):
        notice = op5_licenses.TEMPLATES[label][0][0]
        for n in (1, 3, 60):
            texts = [f"{prose(30)} {notice} {prose(30)}" if i % 3 == 0 else prose(60) for i in range(n)]
            got = {r.doc_id: r for r in op5_licenses.scan(spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)).collect()}
            assert {i: r.labels for i, r in got.items()} == {i: label if i % 3 == 0 else "" for i in range(n)}
            assert all((r.score >= 0.5) == (i % 3 == 0) for i, r in got.items())


def test_licenses_of_one_text_with_several_notices(spark):
    notices = {x: op5_licenses.TEMPLATES[x][-1][0] for x in ("mit", "bsd", "mpl", "unlicense")}
    texts = [prose(60) for _ in range(40)] + [f" {prose(20)} ".join(notices.values()), notices["mit"] + " " + notices["bsd"], *notices.values(), " ".join(notices["bsd"].split()[:9] + ["other"] * 12)]
    got = {r.doc_id: r for r in op5_licenses.scan(spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)).collect()}
    assert (got[40].labels, got[41].labels) == ("bsd,mit,mpl,unlicense", "bsd,mit") and all(got[i].score == 1 for i in range(40, 46))
    assert [got[42 + i].labels for i in range(4)] == list(notices) and got[46].labels == "" and got[0].labels == ""


def test_licenses_of_long_texts_and_odd_letters(spark):
    texts = ["MIT license " * 100_000, "M\u0130T license", "M\u0131T license mit \u212Ait", None]
    got = {r.doc_id: r for r in op5_licenses.scan(spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word) == (200_000, 100_000, 0, 199_998)
    assert [got[i].n_base for i in (1, 2, 3)] == [0, 0, 0] and [got[i].n_words for i in (1, 2, 3)] == [2, 4, 0]


def test_passages_and_their_cut(docs, none):
    found = op6_passages.passages(docs)
    got = {(r.doc_id, r.source_doc_id): r for r in found.collect()}
    assert (4, 3) in got and got[(4, 3)].length == 120 and got[(4, 3)].identity == 1
    assert (7, 6) in got and 55 <= got[(7, 6)].length <= 65 and (5, 3) in got
    assert not {a for a, _ in got} & {6, 9, 10, 11}
    left = {r.doc_id: r.text for r in op6_passages.cut(docs, found).collect()}
    assert 4 not in left and PASSAGE not in left[7] and left[6] == TEXTS[6]
    assert op6_passages.passages(none).count() == 0


def test_passages_whose_parts_stand_elsewhere(spark):
    """A passage of documents 3 and 4 of which earlier and later documents have parts; it is whole in document 3 only."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for between in (False, True):
        rows, want = [], set()
        for case in range(15):
            at, passage = case * 10, words(60)
            texts = {1: passage[:30], 2: passage[30:], 3: passage, 9: passage} | ({5: passage[:30], 6: passage[30:]} if between else {})
            rows += [(at + i, " ".join(words(40) + t + words(40)), "en", 1, 1) for i, t in texts.items()]
            want.add((at + 9, at + 3, 40, 60))
        got = op6_passages.passages(spark.createDataFrame(rows, COLUMNS)).collect()
        assert {(r.doc_id, r.source_doc_id, r.start, r.length) for r in got} == want and len(got) == 15


def test_near_passages_of_few_equal_words_in_a_row(spark):
    """Passages of which every word may be another one, at identities of 0.81 and more."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    found = {}
    for n in (50, 60, 80):
        for share in (0.1, 0.15, 0.18):
            rows = []
            for case in range(60):
                passage = words(n)
                near = list(passage)
                for i in rng.sample(range(1, n - 1), int(n * share)):
                    near[i] = f"x{rng.randrange(10**6)}"
                rows += [(2 * case, " ".join(words(60) + passage + words(60)), "en", 1, 1), (2 * case + 1, " ".join(words(60) + near + words(60)), "en", 1, 1)]
            pairs = op6_passages.passages(spark.createDataFrame(rows, COLUMNS), least=n * 3 // 5).collect()
            found[n, share] = len({r.doc_id for r in pairs if r.source_doc_id == r.doc_id - 1}) / 60
    assert min(found.values()) >= 0.9


def test_chain_skips_what_is_out_of_order():
    p, a = np.array([[0, 100], [10, 110], [15, 5], [20, 120], [30, 131]]).T
    parts = op6_passages.segments(np.zeros(5, int), p, a)
    assert op6_passages.chains([tuple(x[1:]) for x in parts.tolist()])[0] == [(0, 100), (20, 120), (30, 131), (30, 131)]


def test_passages_have_all_runs_that_brute_force_finds(spark):
    """Every word in a run of 50 words that an earlier document has lies in a passage."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = op6_passages.passages(docs).collect()
    covered = {(r.doc_id, i) for r in got for i in range(r.start, r.start + r.length)}
    first, want = {}, set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        words = (r.text or "").lower().split()
        for i in range(len(words) - 49):
            if first.setdefault(tuple(words[i : i + 50]), r.doc_id) < r.doc_id:
                want |= {(r.doc_id, j) for j in range(i, i + 50)}
    assert want and want <= covered


def test_passages_of_rows_without_or_with_equal_ids(spark):
    passage = prose(80)
    rows = [(None, passage, "en", 1, 1), (1, passage, "en", 1, 1), (2, "a b " + passage, "en", 1, 1), (2, "c d " + passage, "en", 1, 1), (3, None, "en", 1, 1), (4, "", "en", 1, 1), (5, "x " * 3000, "en", 1, 1), (6, "x " * 3000, "en", 1, 1)]
    got = op6_passages.passages(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(2, 1), (6, 5)} and [(r.start, r.length) for r in got if r.doc_id == 2] == [(2, 80)]
    assert {i for r in got if r.doc_id == 6 for i in range(r.start, r.start + r.length)} == set(range(3000))


def test_words_of_many_texts_are_those_of_one_at_a_lower_cost():
    """hashing each word as an object took most of the CPU time of op6_substring_dedup."""
    rng = random.Random(8)
    long = "".join(rng.choice("ab\u00e9\u03a3 \n\u2003") for _ in range(5 * words.PIECE))
    giant = "g" * (3 * words.PIECE)
    spaces = "".join(f"w{i}{chr(i)}" for i in range(0x3100) if not 0xD800 <= i < 0xE000)
    texts = [None, "", " \n", "a", "\u039f\u03a3 \u03a3\u039f\u03a3", "\u0130 i\u0307 \ud800", "ab ba a b", long, "", f"x {giant} y {giant}z {giant}", "\0 \0\0 a\0", spaces, *(f"a{i} b" for i in range(50))]
    got, want = list(words.hashed(texts)), [words.word_hashes(x) for x in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    pairs = set(zip(np.concatenate(got).tolist(), np.concatenate(want).tolist()))
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}) > 5_000
    prose_ = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(400)) for _ in range(600)]

    def took(f):
        times = []
        for _ in range(3):
            start = time.process_time()
            f()
            times.append(time.process_time() - start)
        return min(times)

    assert took(lambda: list(words.hashed(prose_))) < 0.7 * took(lambda: [words.word_hashes(x) for x in prose_])


def test_passages_of_slices_that_end_in_the_midst_of_texts(spark):
    """Many passages of one long text, each with words replaced around it, and a copy of a text that is longer than what is hashed at once."""
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    source, other = word(30_000), word(200)
    rows = [(1, " ".join(source), "en", 1, 1), (2, " ".join(other), "en", 1, 1)]
    for i in range(600):
        rows.append((10 + i, " ".join([*word(5), *source[i * 50 : i * 50 + 60 + i % 40], *word(5)]), "en", 1, 1))
    rows.append((1000, " ".join(source), "en", 1, 1))
    got = {(r.doc_id, r.source_doc_id, r.start, r.length, r.source_start) for r in op6_passages.passages(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {(10 + i, 1, 5, min(60 + i % 40, 30_000 - i * 50), i * 50) for i in range(600)} | {(1000, 1, 0, 30_000, 0)} <= got


def test_fingerprints(spark, none):
    from pyspark.sql import functions as F

    texts = ["a\nb\nc", "c\na\nb", None, "", "a\nb\nd", "x" * 200_000]
    rows = op7_fingerprints.fingerprints(spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)).orderBy("doc_id").collect()
    assert rows[0].fingerprint == rows[1].fingerprint != rows[4].fingerprint and rows[2].fingerprint == rows[3].fingerprint
    assert rows[0].near_next == 1.0 and rows[3].near_next == 0.0
    edited = "a\nb" + "c\n"
    assert rows[0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[5].edited_sha256 == hashlib.sha256(("x" * 100_000 + "a\nb\nc").encode()).hexdigest()
    both = spark.createDataFrame([("a\nb", "c", "a\nb\nc")], "a string, b string, ab string")
    one = both.select(op7_fingerprints.added(op7_fingerprints.lanes(F.col("a")), op7_fingerprints.lanes(F.col("b"))) == op7_fingerprints.lanes(F.col("ab")))
    assert one.first()[0]
    assert op7_fingerprints.fingerprints(none).count() == 0


def brute_fingerprint(text):
    lanes = [0] * (op7_fingerprints.EQUAL + op7_fingerprints.ALIKE)
    for p in text.split("\n"):
        if p.strip(" \t\x0b\x0c\r"):
            wide = hashlib.sha512(p.encode()).hexdigest()
            signs = hashlib.sha256(wide.encode()).hexdigest()
            for i in range(16):
                lanes[i] = (lanes[i] + int(wide[8 * i : 8 * i + 8], 16)) % 2**32
            for i in range(128):
                lanes[16 + i] += 1 - 2 * (int(signs[8 * (i // 32) : 8 * (i // 32) + 8], 16) >> i % 32 & 1)
    return lanes


def test_fingerprints_equal_brute_force(spark):
    texts = ["\n".join(prose(random.randint(1, 9)) for _ in range(random.randint(1, 30))) + random.choice(["", "\n \t\n", "\r"]) for _ in range(30)] + ["", "é\n日本"]
    texts += texts[:2]
    rows = sorted(op7_fingerprints.fingerprints(spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)).collect(), key=lambda r: r.doc_id)

    def near(a, b):
        x, y = a[16:], b[16:]
        return 1.0 if a == b else max(0.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y)) / max(1, sum(i * i for i in x) + sum(j * j for j in y)))

    for i, (t, r) in enumerate(zip(texts, rows)):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed = brute_fingerprint(t), brute_fingerprint(edited)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in own[:16]).upper() + "".join(f"{x % 65536:04x}" for x in own[16:]).upper()
        assert abs(r.near_edited - near(own, changed)) < 1e-9 and abs(r.near_next - near(own, brute_fingerprint(after))) < 1e-9


def test_scores(docs, none):
    got = op8_pitman_yor.score(docs).collect()
    texts = [(i, [w.lower() for w in (t or "").encode().split()] + [b""]) for i, t, *_ in ROWS]
    counts = Counter(w for i, ws in texts if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total = sum(counts.values())
    want = sorted((i, len(ws), sum(w in counts for w in ws), round(sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws), 3)) for i, ws in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert op8_pitman_yor.score(none).count() == 0


def test_model_sums_to_one_and_is_the_samplers(spark):
    """The probabilities after each word sum to 1 over the words and the unknown one; tables are as many as a sampler finds that seats one customer after the other."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, [2.0 ** -(k % 7) for k in range(12)], k=rng.randint(5, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", 1, 1) for i, t in enumerate(texts)], COLUMNS)
    *_, vocabulary, census, total, n_words, blocks, buckets = op8_pitman_yor.counted(docs, 300)
    assert op8_pitman_yor.counted(docs, 300)[0].count() > 5
    model = op8_pitman_yor.Model(vocabulary, census, blocks, n_words, 2, 12)
    singles = op8_pitman_yor.unpacked
    keys = {r["to"]: (op8_pitman_yor.unpacked_sorted(r.a), singles(r.b)) for r in op8_pitman_yor.sent(census, op8_pitman_yor.PARTIES).collect()}
    tables = []
    for parties, state, s in model.samples:
        assert blocks == buckets == 1
        block, t = state.first(), op8_pitman_yor.unpacked(parties.first().a)
        count, one_u, one_w, of_u, customers, top = (op8_pitman_yor.unpacked(block[c]) for c in "abcdef")
        assert count.sum() == total and customers.sum() == s.customers and top.sum() == s.tables
        above = s.top(customers, top)[count > 0].sum() + s.top(np.zeros(1), np.zeros(1))[0]
        assert abs(above - 1) < 1e-9
        (pair, n), = keys.values()
        for u in range(len(count)):
            mine = pair >> 32 == u
            own = (n[mine] - s.discount * t[mine]).sum() + one_u[u] * (1 - s.discount)
            assert t[mine].sum() + one_u[u] == of_u[u] and abs(own / (s.strength + count[u]) + s.back(of_u[u], count[u]) - 1) < 1e-9
        tables.append(customers.sum())
    # seating one after the other, with the model's strengths and discounts
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            row = ["", *t.split(), ""]
            counts.update(zip(row, row[1:]))
    pure = np.random.default_rng(1)
    seats, upper = {k: [] for k in counts}, {w: [] for _, w in counts}
    base = 1 / (n_words + 1)

    def seat(at, d, new):
        p = np.array([x - d for x in at] + [new])
        k = int(pure.choice(len(p), p=p / p.sum()))
        at.append(1) if k == len(at) else at.__setitem__(k, at[k] + 1)
        return k == len(at) - 1 and at[k] == 1

    def leave(at):
        k = int(pure.choice(len(at), p=np.array(at) / sum(at)))
        at[k] -= 1
        if not at[k]:
            del at[k]
            return True
        return False

    def word(w):
        return (sum(upper[w]) - s.above * len(upper[w]) + (s.strength_above + s.above * sum(map(len, upper.values()))) * base) / (s.strength_above + sum(map(sum, upper.values())))

    means = []
    for sweep in range(60):
        for u, w in counts:
            for _ in range(counts[u, w]):
                at = seats[u, w]
                if sweep and leave(at):
                    leave(upper[w])
                own = sum(len(x) for k, x in seats.items() if k[0] == u)
                if seat(at, s.discount, (s.strength + s.discount * own) * word(w)):
                    seat(upper[w], s.above, (s.strength_above + s.above * sum(map(len, upper.values()))) * base)
        if sweep >= 20:
            means.append(sum(map(len, seats.values())))
    assert abs(np.mean(tables) - np.mean(means)) < 0.15 * np.mean(means)


def test_long_texts_are_cut_between_words(spark, docs):
    whole, cut = ({(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in op8_pitman_yor.score(docs, size, 1, 1).collect()} for size in (1 << 23, 2000))
    assert whole == cut
    rows = op8_pitman_yor.score(spark.createDataFrame([(None, "a b", "en", 1, 1), (1, "a b", "en", 1, 1)], COLUMNS), burn_in=1, samples=1).collect()
    assert {(r.doc_id, r.held_out, r.train_tokens) for r in rows} == {(None, True, 3), (1, False, 3)}


def test_plan_fills_sequences_without_gaps():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        lengths = Counter(rng.integers(1, 101, 400).tolist())
        placed = defaultdict(list)
        done = Counter()
        for length, low, high, first, each, offset in op9_packing.plan(lengths, 100):
            assert low == done[length]
            done[length] = high
            for i in range(high - low):
                placed[first + i // each].append((offset + i % each * length, length))
        assert done == lengths
        for items in placed.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 100 and sum(3 * length > 100 for _, length in items) <= 2
        assert len(placed) <= sum(k * n for k, n in lengths.items()) / 100 * 1.05 + 2


def test_packing(docs, none):
    path = vocabulary_path("word_bpe_49k.json")
    got = op9_packing.pack(docs, path).toPandas()
    library = Tokenizer.from_file(path)
    assert got.length.sum() == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert op9_packing.pack(none, path).count() == 0


def test_shards(spark, docs, none):
    many = spark.createDataFrame([(i, prose(random.randint(5, 60)) if i % 3 else COPY, "en", 1, 1) for i in range(600)], COLUMNS)
    got = op10_sharding.shard(many).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.02 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(not r.split for r in got.itertuples() if r.doc_id % 3) and got[got.doc_id % 3 != 0].groupby("text_crc32").shard.nunique().max() == 1
    texts = {r.doc_id: r.text for r in many.collect()}
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and len(texts[r.doc_id].encode()) + 1 == r.size for r in got.itertuples())
    few = op10_sharding.shard(docs).toPandas()
    assert len(few) == len(ROWS) and few.loc[few.doc_id == 0, "size"].item() == 1
    assert op10_sharding.shard(none).count() == 0
