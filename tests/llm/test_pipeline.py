"""The pipeline's stages in order, each judged on its own input."""

import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flightlake.llm import pii
from flightlake.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def documents():
    rng = np.random.default_rng(5)
    words = {"en": "river stone light garden window paper season mirror with from that".split(), "de": "fluss stein licht garten fenster nicht über zeit spiegel und der".split()}
    rows = [(i, " ".join(rng.choice(words[g], 80)), g) for i in range(60) for g in [("en", "de")[i % 2]]]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1].replace(" ", "\n"), "de"), (102, rows[2][1] + " end", "en"), (103, "1234 !!", "en"), (104, None, "en"), (105, "mail a@b.example.org " + rows[5][1][::-1], "en")]
    return [(i, t, g, "src", len(t or "")) for i, t, g in rows]


def test_stages_names_and_columns(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = set(range(60)) | {100, 101, 102, 103, 104, 105}
    expected = [kept - {103, 104}, kept - {100, 103, 104} - {101}, None, None]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == docs.columns, name
        rows = out.collect()
        if expected[k] is not None:
            assert {r["doc_id"] for r in rows} == expected[k], name
        docs = spark.createDataFrame(rows, SCHEMA)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(range(60)) <= set(text) | {0, 1} and "<EMAIL>" in text[105] and not pii.base_spans(text[105])
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in out.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(ids.encode(t, add_special_tokens=False).ids) + 1 for i, t in text.items()}


def test_run_reads_the_table(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {103, 104, 100}.isdisjoint(found) and len(found) >= 60


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_over_repeated_rows_null_ids_and_further_columns(spark, tmp_path):
    rows = [(*r, "k", 1.0) for r in documents()]
    rows += [rows[7], rows[7], (None, "no id at all but " + rows[8][1][::-1], "en", None, None, None, None), (5, "another text of id five " + rows[9][1][::-1], "en", None, None, None, None), (None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA + ", key string, language double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = [i for i, _ in found]
    assert ids.count(7) == 1 and ids.count(5) == 2 and ids.count(None) == 1 and {103, 104, 100}.isdisjoint(ids)


def test_stages_leave_their_decisions(spark, tmp_path):
    home = f"{shared_dir(spark)}/flightlake".removeprefix("file://")
    before = set(os.listdir(home)) if os.path.isdir(home) else set()
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = [stage(spark, docs, "").count() for _, stage in corpus_pipeline.STAGES[:3]]
    new = sorted(set(os.listdir(home)) - before)
    read = lambda name: spark.read.parquet(f"file://{home}/{next(n for n in new if n.startswith(name))}")
    assert kept[0] == len(documents()) - 2 and {r["language"]["lang_pred"] for r in read("languages").filter("doc_id IN (103, 104)").collect()} == {"und"}
    classes = {r["doc_id"]: r["keep_id"] for r in read("exact_classes").collect()}
    assert len(classes) == len(documents()) and classes[100] == 0 and classes[101] == 1 and len(set(classes.values())) == kept[1]
    near = {r["doc_id"]: r["keep_id"] for r in read("near_classes").collect()}
    assert len(near) == len(documents()) and near[100] == 0 and len(set(near.values())) == kept[2]
