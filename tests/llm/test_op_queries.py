"""The registered queries themselves, over whole tables, against SQL, brute force or held-out labels."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lapwing.llm import packing
from lapwing.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"select * from '{SF}/{t}.parquet'").df() for t in TABLES}


def run(spark, name):
    return queries()[name](spark, SF).toPandas()


def null(x):
    return x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_oracle(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = c.sql(oracle_sql()[name]).df(), run(spark, name)
    key = [k for k in ("doc_id", "vec_id") if k in got]
    want, got = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_secrets(spark):
    def base(text):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
        found += [(m.start(), k, m.end()) for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)) for m in re.finditer(pattern, text) if len(m[0]) >= least]
        return sorted(found)

    sf = SF.replace("0.001", "0.01")  # the smallest table has none
    docs = duckdb.sql(f"select * from '{sf}/documents.parquet'").df()
    got = queries()["op1_structural_secrets"](spark, sf).toPandas().set_index("doc_id")
    kinds = ("assign", "access", "hex")
    some = 0
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        want = base("" if null(text) else text)
        row = got.loc[doc_id]
        joined = [f"{kinds[k]}:{a}:{b}" for a, k, b in want]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert row.base_sha256 == sha(",".join(joined)) and set(joined) <= set(row.spans.split(",")) | {""}
        some += bool(want)
    assert some and len(got) == len(docs)


def test_token_ids(spark, tables):
    got = run(spark, "op3_packed_token_ids").set_index("doc_id")
    t, start = Tokenizer.from_file(packing.vocabulary()), 0
    for doc_id, text in sorted(zip(tables["documents"].doc_id, tables["documents"].text, strict=True)):
        ids = [*t.encode("" if null(text) else text, add_special_tokens=False).ids, 2]
        row = got.loc[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language(spark, tables):
    got = run(spark, "op7_byte_cnn_langid").set_index("doc_id")
    docs = tables["documents"].set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.index]).all()
    for doc_id, row in got.iterrows():
        text = docs.text[doc_id]
        assert (row.lang_pred == "und") == (null(text) or not re.search(r"[^\W\d_]", text))
    held = [k for k in got.index[got.held_out] if not null(docs.lang[k]) and got.lang_pred[k] != "und"]
    assert np.mean([got.lang_pred[k] == docs.lang[k] for k in held]) >= 0.95


def test_chat(spark, tables):
    got = run(spark, "op9_incremental_chat").set_index("conv_id")
    rows = tables["conversations"].sort_values(["conv_id", "turn"])
    own = {k: [("" if null(r) else r, "" if null(t) else t) for r, t in zip(x.role, x.text, strict=True)] for k, x in rows.groupby("conv_id")}
    own[-1] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    assert set(got.index) == set(own)
    for k, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got.loc[k]
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert row.formatted_chars >= sum(len(t) for _, t in turns)


def test_quality(spark, tables):
    got = run(spark, "op2_cotrained_quality").set_index("doc_id")
    assert len(got) == len(tables["documents"]) and all(got[c].between(0, 1).all() for c in ("text_score", "meta_score", "score"))
    own = tables["labels"].set_index("doc_id").quality.dropna()
    own = own[own.index.isin(got.index)]
    assert ((got.loc[own.index].score >= 0.5) == (own == 1)).mean() > max(own.mean(), 1 - own.mean())


def test_licenses(spark, tables):
    got = run(spark, "op8_compression_licenses").set_index("doc_id")
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    for doc_id, text in zip(tables["documents"].doc_id, tables["documents"].text, strict=True):
        want = {v for k, v in lines.items() if not null(text) and k in text}
        assert want <= set(got.licenses[doc_id].split(","))
        if null(text) or not re.search("(?i)licen|warrant|copyright|spdx|redistribut", text):
            assert got.n_licenses[doc_id] == 0


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    body = "the cat sat on the mat and looked at the dog " * 3
    rows = [(1, body, "en", "a", 9, "x"), (1, body, "en", "a", 9, "x"), (2, body, "en", "a", 9, "x"), (None, body, "en", None, None, "x"), (None, "other words that nobody else has", None, None, None, "x"), (3, None, "en", "a", 9, "x"), (4, "", "en", "b", 0, "x"), (5, "le chat est sur le tapis et regarde " * 900, "fr", "b", 1, "x")]
    table = spark.createDataFrame(rows, schema)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    spoken = pipeline.language(spark, table, SF)
    assert spoken.columns == list(pipeline.COLUMNS) and ids(spoken) == [1, 1, 2, 5, None, None]
    assert ids(pipeline.near_duplicates(spark, table, SF)) == [1, 3, 4, 5, None, None]
    assert ids(pipeline.decontamination(spark, table, SF)) == ids(table)
    mixed = pipeline.mix(spark, table, SF)
    assert mixed.columns == list(pipeline.COLUMNS) and 0 < mixed.where("doc_id is null").count() <= 4
    packed = pipeline.pack(spark, table, SF).orderBy("start").collect()
    assert len(packed) == len(rows) and all(a.start + a.n_tokens == b.start for a, b in zip(packed, packed[1:], strict=False))
    none = table.limit(0)
    assert [f(spark, none, SF).count() for _, f in pipeline.STAGES] == [0] * 5
