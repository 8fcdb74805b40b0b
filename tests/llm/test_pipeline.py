"""The pipeline against a brute-force version of every stage, and the SQL queries against DuckDB."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from myospark.llm import language_id, queries
from myospark.llm.common import materialize
from myospark.llm.decontaminate import budget, normalize

from .test_dedup import FOLD, brute_components, brute_sets
from .test_mix_and_urls import brute_count
from .test_models import plain_language
from .test_text_ops import edit_distance_within


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    said = {r["doc_id"]: plain_language(model, r["text"]) for r in docs.collect()}
    rows = [r for r in docs.collect() if said[r["doc_id"]][0] != "und" and said[r["doc_id"]][2] >= model.least]
    best = {}
    for r in rows:
        key = (r["text"] or "").translate(FOLD)
        best[key] = max(best.get(key, -1), r["doc_id"])
    rows = [r for r in rows if best[(r["text"] or "").translate(FOLD)] == r["doc_id"]]
    comps = brute_components([r["doc_id"] for r in rows], brute_sets([r["text"] for r in rows]))
    rows = [r for r in rows if comps[r["doc_id"]] == r["doc_id"]]
    items = [normalize(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def dirty(text):
        clean = normalize(text)
        return any(p in clean or (any(clean.find(p[a : a + 19]) >= 0 for a in range(0, len(p) - 19, 10)) and edit_distance_within(p, clean) <= budget(len(p))) for p in items)

    rows = [r for r in rows if not dirty(r["text"])]
    sizes = Counter(r["source"] for r in rows)
    total = sum(n**0.5 for n in sizes.values())
    want = {r["doc_id"]: brute_count(13, r["doc_id"], len(rows) * sizes[r["source"]] ** 0.5 / total / sizes[r["source"]]) for r in rows}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({k: v for k, v in want.items() if v})


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() == 0


def test_stages_take_odd_rows(make, spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns pass through every stage."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(60_000))
    texts = ["the thing and that other thing with them " * 3, None, "", long, long, "le chose et la autre chose avec eux pour nous " * 3, "½ ²", "the thing and that other thing with them " * 3]
    docs = make(texts, ["en", None, None, "en", "en", "fr", None, "en"], [None, "s", "s", "s", "s", None, "s", "s"], [1, 2, None, 4, 4, 6, 7, None])
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = materialize(stage(spark, docs, sf))
        assert [c for c in docs.columns if c in before] == before, name
        assert docs.count() == {"language_id": 5, "exact_dedup": 4, "near_dedup": 4, "decontaminate": 4}.get(name, docs.count()), name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for given in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {given} AS SELECT * FROM '{sf}/{given}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    rows = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)


def test_all_operators_are_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))


def test_a_run_keeps_two_tables_at_most(spark, sf, monkeypatch):
    made, gone = [], []
    keep = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df: made.append(keep(df)) or made[-1])
    drop = corpus_pipeline.release
    monkeypatch.setattr(corpus_pipeline, "release", lambda df: (gone.append(df.scratch_path), drop(df)))
    corpus_pipeline.run(spark, sf).count()
    assert gone == [df.scratch_path for df in made[:-1]]
