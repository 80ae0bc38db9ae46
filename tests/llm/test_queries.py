"""The registered queries on the small tables: contract columns, check SQL, and the pipeline against brute force."""

import hashlib
from collections import Counter

import pytest

import __spark_entry__ as entry_module
import check
import corpus_pipeline
from corpuslens.llm import common, pieces
from corpuslens.llm.queries import ORACLE_SQL, QUERIES
from test_lines_mixing_shards import expected_lines
from test_texts import brute_groups

SF_DIR = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                     "slot": "bigint", "grown_shard": "int"},
    "op3_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                           "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint",
                               "kept": "boolean"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint",
                          "codebooks_sha256": "string"},
    "op12_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint",
                             "loss_sha256": "string", "formatted_chars": "bigint"},
    "op13_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string",
                             "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
}


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_module.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_has_its_columns(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert COLUMNS.get(name, {}).items() <= dict(df.dtypes).items()
    if name in ("op5_exact_top_k", "op8_mixing", "op12_chat_formatting"):
        assert df.count() > 0
    else:
        assert df.count() == (500 if name in ("op6_embedding_near_dedup", "op11_vector_codes") else 200)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    ok, message, _ = check.compare(spark, check.connect(SF_DIR), name, SF_DIR)
    assert ok, message


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_pipeline_stages(spark):
    docs = common.documents(spark, SF_DIR)
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good, lined, single, mixed, coded = stages.values()

    kept = corpus_pipeline.write_table(good(spark, docs, SF_DIR), "kept")
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns
    assert all((i in ids) == bool(q) for i, q in labels.items())

    plain = corpus_pipeline.write_table(lined(spark, kept, SF_DIR), "lined")
    want = expected_lines(rows_of(kept), 10, True)
    assert plain.columns == columns
    assert Counter(rows_of(plain)) == Counter((i, "\n".join(x)) for i, (x, _) in want.items())
    assert all(r.n_chars == len(r.text) for r in plain.collect())

    one = corpus_pipeline.write_table(single(spark, plain, SF_DIR), "single")
    root, _ = brute_groups(rows_of(plain), 5, 80)
    assert one.columns == columns
    assert sorted(i for i, _ in rows_of(one)) == sorted({root[i] for i in root})

    mix = corpus_pipeline.write_table(mixed(spark, one, SF_DIR), "mixed")
    copies = Counter(rows_of(mix))
    assert mix.columns == columns
    assert set(copies) == set(rows_of(one)) and max(copies.values()) <= 2

    ids_of = pieces.decode(coded(spark, mix, SF_DIR), pieces.Vocabulary.read(pieces.MODEL)).collect()
    assert Counter((r.doc_id, r.text) for r in ids_of) == copies
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in ids_of)


def test_pipeline_keeps_one_copy_of_a_long_line_in_two_documents(spark):
    def words(tag, n):
        return " ".join(f"{tag}{k}" for k in range(n))

    passage, short = words("passage", 60), words("short", 49)
    rows = [(i, f"{words(f'own{i}x', 200)}\n{passage}\n{short}") for i in (1, 2, 3)]
    rows += [(4, rows[0][1] + " end"), (5, words("other", 80))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    got = corpus_pipeline.write_table(docs, "passages")
    for name in ("line dedup", "minhash near-dedup"):
        got = corpus_pipeline.write_table(dict(corpus_pipeline.STAGES)[name](spark, got, ""), "passages")
    texts = {r.doc_id: r.text for r in got.collect()}
    assert got.columns == docs.columns and sorted(texts) == [1, 2, 3, 5]
    assert [i for i, t in sorted(texts.items()) if passage in t] == [1]
    assert [i for i, t in sorted(texts.items()) if short in t] == [1, 2, 3]
    assert texts[2] == f"{words('own2x', 200)}\n{short}" and all(r.n_chars == len(r.text) for r in got.collect())
