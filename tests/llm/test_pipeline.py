"""The pipeline against a plain version, and the registered queries' columns."""

import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from paperloom.llm import language_id, pii, simhash

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_quality": "doc_id held_out expected_grade score tail_2 predicted",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_embedding_dedup": "vec_id n_links component_id kept",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_line_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lost kept",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = {"xx": [a + b for a in ("mor", "tal", "vin") for b in ("an", "el", "ik")], "yy": [a + b for a in ("qua", "zeb", "jux") for b in ("o", "um", "ye")]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(i, text("xx" if i % 2 else "yy", rnd.randint(20, 60)), "xx" if i % 2 else "yy") for i in range(80)]
    long = text("xx", 3000)
    rows += [(100, rows[0][1], "yy"), (101, rows[0][1].upper(), "yy"), (102, rows[1][1] + " call +49 30 1234567 or mail a.b@c.de", "xx"), (103, None, "xx"), (104, "", "xx"), (105, "123 456 !!", "xx"), (106, long, "xx"), (107, long.replace("moran", "morel", 1), "xx")]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(*r, "src0", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    return rows, str(path)


def test_pipeline_equals_a_plain_version(spark, tables):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rows, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    groups = defaultdict(list)
    for i, t in kept.items():
        groups[t.lower()].append(i)
    kept = {i: t for i, t in kept.items() if i == max(groups[t.lower()])}
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    component = {i: i for i in kept}
    for _ in kept:
        for i in kept:
            for j in kept:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    component[i] = component[j] = min(component[i], component[j])
    kept = {i: t for i, t in kept.items() if component[i] == i}
    assert 0 not in kept and 101 in kept and 106 in kept and 107 not in kept
    for i, t in kept.items():
        for s, e, kind in sorted(pii.base_spans(t), reverse=True):
            t = f"{t[:s]}<{kind}>{t[e:]}"
        kept[i] = t
    tokenizer = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for i, t in kept.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want |= {(i, a): (len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, path).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept


def test_language_stage_keeps_clean_documents(spark, tables):
    rows, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs, model, "doc_id").collect()}
    assert all(got[i] == lang for i, t, lang in rows if t and i != 105) and got[103] == got[104] == got[105] == "und"


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    frame = __spark_entry__.queries()[name](spark, DATA)
    assert frame.columns == COLUMNS[name].split()
    key = COLUMNS[name].split()[0]
    table = spark.read.parquet(f"{DATA}/{ {'vec_id': 'embeddings', 'conv_id': 'conversations'}.get(key, 'documents')}.parquet")
    rows = frame.collect()
    ids = {r[key] for r in table.select(key).collect()}
    assert {r[key] for r in rows} == ids if key != "conv_id" else {r[key] for r in rows} <= ids
    if name not in ("op1_packing", "op11_prefix_trie"):
        assert len(rows) == table.count()
    if "score" in frame.columns:
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name in __spark_entry__.oracle_sql():
        con = duckdb.connect()
        for view in ("documents", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
        found = con.execute(__spark_entry__.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(found.fetchall(), key=str)


def test_pipeline_is_registered():
    assert "pipeline" in __spark_entry__.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "personal_data", "packing"]
