"""The pipeline's stages on rows without ids, with repeated ids, and on empty tables."""

import random

import pytest

import corpus_pipeline
from stratalog.llm import op1_chosen_path, op4_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(4)
WORDS = ["".join(random.choice("abcdefghijklm") for _ in range(random.randint(2, 7))) for _ in range(600)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    copy = prose(120)
    texts = [(None, prose(90)), (None, prose(90)), (1, copy), (1, prose(100)), (2, copy), (3, "short"), (None, copy), (4, prose(200)), (4, None), (5, ""), (6, prose(80)), (6, None)]
    return [(i, t, "en", "web", len(t or "")) for i, t in texts]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality_keeps_rows_not_ids(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    got = stage("quality rules")(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if len((r[1] or "").split()) >= 50), key=str)


def test_one_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame([*rows, rows[7]], COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in stage("n-gram Jaccard join")(spark, docs, "/root/testdata/sf0.001").collect()), key=str)
    assert got == sorted(((i, t) for k, (i, t, *_) in enumerate(rows) if k not in (4, 6)), key=str)


def test_passages_are_cut_from_their_own_text(spark):
    passage = prose(70)
    rows = [(1, passage, "en", "web", 1), (2, "a b " + passage + " c", "en", "web", 1), (None, passage, "en", "web", 1), (3, None, "en", "web", None)]
    got = {(r.doc_id, r.text, r.n_chars) for r in stage("substring dedup")(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert got == {(1, passage, 1), (2, "a b c", 5), (None, passage, 1), (3, None, None)}


def test_empty_tables_pass_all_stages(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Of the first two stages' documents: quality by verdicts, and classes by all pairs."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in op4_quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    good = stage("quality rules")(spark, docs, sf)
    texts = {r.doc_id: r.text for r in good.collect()}
    assert set(texts) == kept
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := t.lower().split())}
    root = {i: i for i in texts}
    for _ in range(4):
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id for r in stage("n-gram Jaccard join")(spark, good, sf).collect()} == {i for i in texts if root[i] == i}
    assert {r.doc_id for r in op1_chosen_path.join(good).where("stays").collect()} == {i for i in texts if root[i] == i}


def test_token_files_of_rows_without_ids(spark):
    from tokenizers import Tokenizer

    from stratalog.llm import op2_token_files
    from stratalog.llm.tokens import vocabulary_path

    rows = [(None, "a b", "en", "web", 3), (None, None, "en", "web", 0), (7, "c <|endoftext|> d", "en", "web", 3), (7, "", "en", "web", 0)]
    got = op2_token_files.read(op2_token_files.write(spark.createDataFrame(rows, COLUMNS), vocabulary_path("byte_bpe_50k.json"))).collect()
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = [(str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(want)
    assert max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id)
