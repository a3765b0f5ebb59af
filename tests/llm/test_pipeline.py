import random
import re

import corpus_pipeline
import pytest
from txscore.llm._common import materialize


def tables(spark, folder, seed=1):
    r = random.Random(seed)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, question = text(60), text(40)
    rows, labels = [], []
    for k in range(300):
        t = "\n".join(text(r.randrange(10, 30)) for _ in range(5))
        if k % 5 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        labels.append((k, int(k % 5 != 0), 0))
        rows.append([k, t, "en", f"s{k % 4}", len(t)])
    for k in (101, 102, 103):
        rows[k][1] += "\n" + passage
    rows[202][1] = rows[201][1].replace("\n", " ")
    rows[203][1] = rows[201][1].replace("\n", " ") + " end"
    rows[204][1] += "\n" + question
    rows[206][1] = rows[207][1] = "the very same " + rows[206][1]
    rows[208][1] = None
    docs = spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, passage = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, folder))
        assert out.columns == docs.columns
        docs, kept[name] = out, {r.doc_id: r for r in out.collect()}
    first, second, third, fourth = kept.values()
    good = {k for k in range(300) if k % 5 and k != 208}
    assert len(good - set(first)) <= 3 and len(set(first) - good - {208}) <= 3
    assert [k for k in (101, 102, 103) if passage in second[k].text] == [101]
    assert len(second[102].text) == second[102].n_chars == len(rows[102][1]) - len(passage) - 1
    assert 206 in second and 207 not in second  # all its lines are later copies
    assert 201 in third and 202 not in third and 203 not in third and 204 in third
    assert set(third) - set(fourth) == {204}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in mixed} == set(fourth)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, mixed))
    assert all(re.fullmatch(r"s\d", r.source) for r in mixed)


@pytest.mark.parametrize("stage", range(5))
def test_stages_defined_cases(spark, tmp_path, stage):
    """Empty tables, null ids and texts, repeated rows, a long text, and columns that other code might use."""
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    names = ["doc_id", "text", "lang", "source", "n_chars", "gone", "_doc", "label", "item_id", "grade", "a.b", "component_id", "size", "rate"]
    schema = ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names)
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    rows = [(k, t, "en", s, 1, *"abcdefghi") for k, t, s in [(1, text(90), "a"), (1, text(90), None), (2, None, "a"), (3, "", None), (None, text(50), "b"), (None, None, None), (4, text(200_000), "b"), (5, "\n\n", "c")]]
    rows += [rows[0]] * 3 + [(8, rows[6][1], *rows[6][2:]), (9, None, None, None, None, *[None] * 9)]
    function = corpus_pipeline.STAGES[stage][1]
    out = function(spark, spark.createDataFrame(rows, schema), folder)
    got = out.collect()
    if stage in (1, 3):  # the others' empty tables are in their own tests
        assert function(spark, spark.createDataFrame([], schema), folder).count() == 0
    if stage == 4:
        assert len(got) == len(rows)
        return
    assert out.columns == names
    whole = {tuple(x) for x in rows}
    if stage == 1:
        assert len([x for x in got if x.doc_id == 4 and x.text == rows[6][1]]) == 1
        assert not [x for x in got if x.doc_id == 8]
    else:
        assert {tuple(x) for x in got} <= whole
    if stage == 2:
        assert [x.doc_id for x in got if x.doc_id in (4, 8)] == [4] and len([x for x in got if x.doc_id is None]) == 2
    if stage == 3:
        assert len(got) == len(rows)


def test_stages_with_empty_side_tables(spark, tmp_path):
    """Without labels and benchmark items nothing is dropped for them."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "some words", "en", "a", 10), (2, "more words", "en", "b", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {1, 2}
