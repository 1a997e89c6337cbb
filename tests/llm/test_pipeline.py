"""The pipeline's rows against its stages done plainly, and each query over a small table."""

from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gaugewright.llm import packing, quality_rules, queries, secret_scan, toxicity
from gaugewright.llm.common import tokenizer_file

from . import samples
from .test_simhash import brute_components


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{samples.SF}/documents.parquet")
    labels = spark.read.parquet(f"{samples.SF}/labels.parquet")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [(d, t) for d, t in rows if model.scores(pa.array([t], pa.string()), {})[0] < 0.5]
    names = quality_rules.MEASURES

    def good(text):
        v = dict(zip(names, quality_rules.measure(text), strict=True))
        return not (
            v["n_words"] < 50 or 100 * v["n_repeat_words"] > 50 * v["n_words"] or 10 * v["n_symbols"] > v["n_words"] or 100 * v["n_dup_lines"] > 50 * v["n_lines"]
            or (v["n_letters"] and 10 * v["n_upper"] > 3 * v["n_letters"]) or v["word_chars"] > 25 * v["n_words"] or 2 * v["n_digits"] > v["word_chars"]
        )

    rows = [(d, t) for d, t in rows if good(t)]
    rows = [r for r, (d, _, c) in zip(rows, brute_components(rows), strict=True) if d == c]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    field = secret_scan.learn(kept)
    rows = [(d, secret_scan.masked(t, secret_scan.scan(t, field)[1])) for d, t in rows]
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, samples.SF).collect():
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] += r.length
    assert got == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{samples.SF}/documents.parquet")
    odd = samples.odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, samples.SF).columns == docs.columns, name
        assert stage(spark, odd, samples.SF).columns == odd.columns
        stage(spark, odd, samples.SF).count()
        assert stage(spark, samples.empty(spark), samples.SF).count() == 0
    assert corpus_pipeline.packing_stage(spark, samples.empty(spark), samples.SF).count() == 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{samples.SF}/{t}.parquet'")
    df = queries.queries()[name](spark, samples.SF)
    want = con.sql(queries.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_all_queries_run(spark):
    made = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in made if n.startswith("op")) == list(range(1, 14))
    assert made["op8_packing"](spark, samples.SF).agg({"length": "sum"}).first()[0] > 0
    assert made["op6_sentencepiece"](spark, samples.SF).where("NOT same_text").count() == 0
    assert packing.CAPACITY == 2048 and np.log2(packing.CAPACITY) == 11
