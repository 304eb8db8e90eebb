"""Each pipeline stage on its own input against brute force; clean documents stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm.inputs import table
from ledgerline.llm.shared import staged

from .test_dedup import brute as near
from .test_dedup import runs
from .test_filters import brute as contaminated
from .test_tokens import crc, library

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, FOLDER, "documents").withColumn("score", F.lit("clash"))
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, "ok", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], FOLDER), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_odd_rows(stages):
    for df in stages[1:5]:
        assert df.columns == corpus_pipeline.COLUMNS
        assert {9001, 9002, 9003} <= set(texts(df))


def test_toxic_documents_go(spark, stages):
    from ledgerline.llm.toxicity import fit, score

    scores = {r.doc_id: r.score for r in score(stages[0], fit(stages[0], table(spark, FOLDER, "labels"))).collect()}
    assert set(texts(stages[1])) == {i for i, s in scores.items() if s < 0.7}


def test_repeated_passages_go_and_documents_stay(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(before) == set(after)
    seen = set()
    for i in sorted(after):
        own = runs(after[i], 51)
        assert not own & seen
        seen |= own
        if not runs(before[i], 50) & {r for j in before if j < i for r in runs(before[j], 50)}:
            assert after[i] == before[i]
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text and r.doc_id < 9000)


def test_one_of_each_near_duplicate_group_stays(stages):
    before = texts(stages[2])
    assert set(texts(stages[3])) == {i for i, (_, root) in near(before).items() if i == root}


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    before = texts(stages[3])
    assert set(texts(stages[4])) == {i for i, t in before.items() if not contaminated(t, items)[4]}


def test_packed_pieces_hold_all_tokens(stages):
    tok, want = library("word_bpe_49k.json"), []
    for i, t in texts(stages[4]).items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, at // 4096, crc(ids[at : at + 4096])) for at in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect()) == sorted(want)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_toxic_stage_against_the_labels(spark):
    """Held-out labels, not the stage's own scores: toxic documents go even with few labels, clean ones stay."""
    for folder, least, clean_gone in ((FOLDER, 1, 0), ("/root/testdata/sf0.01", 13, 1)):
        docs = table(spark, folder, "documents").select(*corpus_pipeline.COLUMNS)
        held = {r.doc_id: r.toxic for r in table(spark, folder, "labels").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1").collect()}
        left = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, folder).select("doc_id").collect()}
        assert sum(y == 1 and i not in left for i, y in held.items()) >= least
        assert sum(y == 0 and i not in left for i, y in held.items()) <= clean_gone


def test_stages_with_odd_rows_and_none(spark):
    """Null ids and texts, repeated rows, ids with several texts, columns that clash, and no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, uid string, id string, blocks string"
    item = table(spark, FOLDER, "benchmark").first().text
    one, two = " ".join(f"one{i}" for i in range(80)), " ".join(f"two{i}" for i in range(80))
    rows = [(None, one), (None, None), (1, one), (1, one), (2, two), (2, "short"), (3, f"{one} more"), (4, item), (4, "clean words only"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "u", "i", "b") for i, t in rows], kind)
    want = {
        "toxicity": rows,
        "line_dedup": [(i, "more" if i == 3 else t) for i, t in rows],
        "near_dedup": [r for r in rows if r[0] != 3],
        "decontamination": [r for r in rows if r != (4, item)],
    }
    key = lambda r: (str(r[0]), str(r[1]))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        if name == "packing":
            assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _ in rows)
        else:
            assert got.columns == corpus_pipeline.COLUMNS
            assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want[name], key=key)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
