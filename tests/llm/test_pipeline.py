"""The pipeline, stage by stage, by other means than the operators."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers

from test_classifiers import brute_rules
from test_pairs import brute_components
from witspark.llm import bpe, leaks


def stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
    return out


def test_stages(spark, sf_dir, tmp_path):
    tables = stages(spark, sf_dir, tmp_path)
    for table in tables[:-1]:
        assert table.columns == tables[0].columns
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables]
    texts = [{d: r["text"] or "" for d, r in own.items()} for own in rows[:-1]]
    assert all(rows[k + 1].keys() <= rows[k].keys() for k in range(5))
    failed = {d for d, t in texts[0].items() if brute_rules(t)[-1]}
    assert not failed & rows[1].keys()
    assert len(rows[1]) >= 0.95 * (len(rows[0]) - len(failed))
    groups = brute_components(texts[2])
    assert rows[3].keys() == {d for d, (_, c) in groups.items() if c == d}
    items = [leaks.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, t in texts[3].items() if not any(i in leaks.normal(t) for i in items)}
    assert rows[4].keys() <= clean and len(rows[4]) >= 0.98 * len(clean)
    vocabulary = bpe.Vocabulary(
        open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN
    )
    for d, row in rows[5].items():
        assert vocabulary.decode(np.array(row["ids"], "<u4").tobytes()).decode() == texts[4][d]


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {len(r["ids"]) for r in rows} == {r["n_tokens"] for r in rows}


def test_no_stage_swallows_import_errors():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except\s+(ImportError|ModuleNotFoundError|Exception)", source)
