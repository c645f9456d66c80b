import corpus_pipeline
from tripgrid.llm import queries


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "mix sources", "pack sequences"]


def test_digest_columns(spark, sf):
    want = {
        "op1_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op2_simhash": {"doc_id", "fingerprint", "component_id"},
        "op3_links": {"page_id", "host", "path", "rule", "verdict"},
        "op4_ann": {"query_id", "rank", "vec_id", "score"},
        "op6_credentials": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op7_sanitise": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op8_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op9_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op10_records": {"doc_id", "start", "n_tokens", "ids_crc32"},
    }
    for name in ("op6_credentials", "op8_packing", "op9_quality", "op10_records"):
        assert set(queries.QUERIES[name](spark, sf).columns) == want[name]
