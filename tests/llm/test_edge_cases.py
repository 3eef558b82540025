"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from meridian.llm.best_fit_packing import best_fit_packing
from meridian.llm.exact_dedup import exact_dedup
from meridian.llm.jaccard_join import jaccard_components
from meridian.llm.line_crf import crf_filter, crf_quality
from meridian.llm.merkle_manifest import merkle_manifest
from meridian.llm.ngram_quality import ngram_quality
from meridian.llm.pii import personal_data, redacted, written
from meridian.llm.pu_toxicity import pu_toxicity
from meridian.llm.queries import PIECE_MODEL, TOKENIZER, URL_RULES
from meridian.llm.sentencepiece_sampling import sampled_encodings
from meridian.llm.substring_dedup import substring_dedup
from meridian.llm.token_files import read_tokens, write_tokens
from meridian.llm.url_filter import rule_table, url_filter
from meridian.session import shared_folder

CLASH = ["fate_id", "fate_mark", "gone_id", "_clean", "mark", "gone", "part", "hash", "rep", "hot", "cold", "step", "x", "z", "row", "base", "candidates", "spans", "keep_id", "kept", "group_size", "key", "n", "id", "sha", "bucket", "chunk", "score", "label", "shard", "cluster", "total", "component", "digest", "salt"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"w{i % 7919} x{i % 104729}" for i in range(60_000))
    rows = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, "a b c d e f g", None, None), (None, "a b c d e f g", "en", "s"), (None, None, None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, " \t\n ", "en", "s"), (6, long_text, "en", "s"), (7, "x" * 200_000, "fr", "s"), (8, "é ß 日本 😀 \x0b\x0c", "de", "t"), (9, "1" * 50_000, "en", "t")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def pages_of(df):
    return df.withColumnRenamed("doc_id", "page_id").withColumn("url", F.when(F.col("text").isNotNull(), F.concat(F.lit("http://Www.Example.ORG/es/"), F.col("text"))))


def written_and_read(spark, df):
    folder = shared_folder(spark, "tokens")
    write_tokens(df, folder, TOKENIZER)
    return read_tokens(spark, folder)


RUN = {
    "packing": lambda s, d, y: best_fit_packing(d, capacity=64), "rules": lambda s, d, y: ngram_quality(d), "toxicity": lambda s, d, y: pu_toxicity(d, y), "join": lambda s, d, y: jaccard_components(d),
    "urls": lambda s, d, y: url_filter(pages_of(d), rule_table(s, URL_RULES)), "pii": lambda s, d, y: personal_data(d).withColumn("text", redacted(F.col("text"), F.col("spans"))), "pieces": lambda s, d, y: sampled_encodings(d, PIECE_MODEL, k=2),
    "exact": lambda s, d, y: exact_dedup(d), "crf": lambda s, d, y: crf_quality(d, y), "crf_filter": lambda s, d, y: crf_filter(d, y), "substrings": lambda s, d, y: substring_dedup(d, window=5),
    "manifest": lambda s, d, y: merkle_manifest(d), "tokens": lambda s, d, y: written_and_read(s, d),
}
ROW_FOR_ROW = ["rules", "toxicity", "join", "urls", "pii", "exact", "crf", "substrings", "manifest", "tokens"]


@pytest.mark.parametrize("name", list(RUN))
def test_empty_table(spark, odd, labels, name):
    assert RUN[name](spark, odd.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_one_row_for_each_row(spark, odd, labels, name):
    rows = RUN[name](spark, odd, labels).collect()
    key = "page_id" if name == "urls" else "doc_id"
    assert sorted((r[key] for r in rows), key=lambda x: (x is None, x)) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None]


def test_exact_copies(spark, odd):
    got = {r.doc_id: r for r in exact_dedup(odd, keep="largest").collect() if r.doc_id is not None}
    assert (got[1].keep_id, got[1].group_size, got[1].kept, got[2].kept) == (2, 4, False, True)
    assert (got[3].keep_id, got[3].group_size, got[4].kept) == (4, 3, True)
    small = [r for r in exact_dedup(odd).collect() if r.doc_id is None]
    assert [r.kept for r in small] == [True, True] and [r.keep_id for r in small] == [None, None]


def test_surface_counts(spark, odd):
    got = {r.doc_id: r for r in ngram_quality(odd).collect() if r.doc_id is not None}
    assert (got[3].n_words, got[3].kept, got[3].base_failed) == (0, False, True)
    assert (got[8].n_words, got[8].word_chars) == (4, 5) and got[6].n_words == 120_000


def test_components(spark, odd):
    got = {r.doc_id: r for r in jaccard_components(odd).collect() if r.doc_id is not None}
    assert (got[2].component_id, got[2].n_shingles) == (1, 3) and (got[4].component_id, got[4].n_shingles) == (4, 0)
    assert got[8].n_shingles == 1


def test_substrings(spark, odd):
    got = {r.doc_id: r for r in substring_dedup(odd, window=5).collect() if r.doc_id is not None}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept_text, got[3].n_words) == (0, 7, "", 0)


def test_packing_keeps_every_token(spark, odd):
    rows = best_fit_packing(odd, capacity=64).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total[6] == 120_000 and total[3] == total[4] == 0 and total[1] == 14
    assert all(r.bin_id is None for r in rows if r.doc_id in (3, 4, 5))
    bins = {}
    for r in rows:
        if r.bin_id:
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert max(bins.values()) <= 64


def test_spans_and_pieces(spark, odd):
    got = {r.doc_id: r.w for r in personal_data(odd).select("doc_id", written(F.col("spans")).alias("w")).collect()}
    assert got[9] == got[7] == got[3] == ""
    pieces = [(r.doc_id, r.rank, r.n_pieces) for r in sampled_encodings(odd.where("doc_id in (3, 4)"), PIECE_MODEL, k=2).collect()]
    assert sorted(pieces) == [(3, 1, 0), (4, 1, 0)]


def test_urls(spark, odd):
    got = {r.page_id: r for r in RUN["urls"](spark, odd, None).collect() if r.page_id is not None}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("", "", None, "allow")
    assert (got[8].host, got[8].rule, got[8].verdict) == ("www.example.org", "example.org/es/", "block")


def test_long_and_repeated_texts_in_pieces(spark, odd):
    rows = [r for r in sampled_encodings(odd, PIECE_MODEL, k=2).collect()]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.rank, bytes(r.ids)))
    assert len(by[6]) == 2 and len(by[7]) == 2 and by[6][0][1] != by[6][1][1]
    assert len(by[1]) == 4 and len(set(by[1])) == 2  # repeated rows: the same samples
    assert len(by[None]) == 3  # a text with two, and one without words


# the pipeline's stages -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def sf(spark, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, odd, sf, name, stage):
    assert stage(spark, odd.limit(0), sf).collect() == []


def kept(df):
    """(id, digest of the text) of the rows."""
    return sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()[:8] if r.text is not None else None) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, odd, sf, name, stage):
    out = stage(spark, odd, sf)
    assert out.columns == odd.columns and out.count() > 0


def test_quality_stage_drops_what_has_no_line(spark, odd, sf):
    ids = [r.doc_id for r in corpus_pipeline.quality(spark, odd, sf).select("doc_id").collect()]
    assert not {3, 4, 5} & set(ids)


def test_exact_copies_stage(spark, odd, sf):
    rows = corpus_pipeline.exact_copies(spark, odd, sf).select("doc_id", "text").collect()
    ids = sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))
    assert ids == [2, 4, 5, 6, 7, 8, 9]  # null, null-id and repeated rows are copies of others
    twice = odd.unionByName(odd)
    assert kept(corpus_pipeline.exact_copies(spark, twice, sf)) == kept(corpus_pipeline.exact_copies(spark, odd, sf))


def test_near_copies_stage(spark, odd, sf):
    rows = corpus_pipeline.near_copies(spark, odd, sf).select("doc_id", "text").collect()
    ids = sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, None] and [r.text for r in rows if r.doc_id is None] == [None]
    text = " ".join(f"w{i}" for i in range(60))
    null_only = spark.createDataFrame([(None, text), (None, text), (None, text + " x"), (None, "other words stand here alone now")], "doc_id long, text string")
    assert corpus_pipeline.near_copies(spark, null_only, sf).count() == 2


def test_later_stages_keep_all_rows(spark, odd, sf):
    assert corpus_pipeline.personal(spark, odd, sf).count() == odd.count()
    packed = corpus_pipeline.packing(spark, odd, sf).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((r.text or "").split()) for r in odd.select("text").collect())


def test_all_stages_in_a_row(spark, sf_dir, sf):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = {0: docs, 1: docs.unionByName(docs)}
    for _, stage in corpus_pipeline.STAGES[1:3]:  # a table given twice comes out as if given once
        now = {k: stage(spark, df, sf_dir) for k, df in now.items()}
    assert kept(now[0]) == kept(now[1])
