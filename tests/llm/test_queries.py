"""The registered queries over whole small tables: against SQL, brute force and libraries."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quernstone.llm import bpe, quality
from quernstone.llm.common import is_held_out
from quernstone.llm.queries import QUERIES, SQL
from test_decontam import brute
from test_dedup import brute_components
from test_secrets import base
from test_secrets import brute as brute_spans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{DATA}/documents.parquet' order by doc_id").fetchall()


def rows(df):
    order = sorted(df.columns)
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    expected = con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows(QUERIES[name](spark, str(DATA))) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=str)


def test_tokens(spark, docs):
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want3, want6 = [], []
    for i, t, *_ in docs:
        ids = plain.encode_ordinary(t or "")
        want3.append((hashlib.sha256((t or "").encode()).hexdigest(), i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)))
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want6.append((i, len((t or "").encode()), n, n > 1024))
    assert rows(QUERIES["op3_byte_bpe"](spark, str(DATA))) == sorted(want3, key=str)
    assert rows(QUERIES["op6_token_counts"](spark, str(DATA))) == sorted(want6, key=str)


def test_secrets(spark, docs):
    out = QUERIES["op7_secret_scan"](spark, str(DATA)).collect()
    assert sorted((r.doc_id, r.spans) for r in out) == sorted(brute_spans([(i, t, source) for i, t, _, source, _ in docs]))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out}
    for i, t, *_ in docs:
        b = base(t)
        assert got[i] == (*[sum(k == x[0] for x in b) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest())


def test_models_on_the_held_out_fold(spark, docs):
    lang = {i: x for i, _, x, *_ in docs}
    out = QUERIES["op10_language_id"](spark, str(DATA)).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out) and len(out) == len(docs)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert len({r.lang_pred for r in held}) == len(set(lang.values()))


def test_quality_on_the_held_out_fold(spark):
    """The mean of both classes' shares that are right: a constant has one half."""
    data = DATA.parent / "sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{data}/labels.parquet'").fetchall())
    scored = {r.doc_id: r for r in QUERIES["op2_compression_quality"](spark, str(data)).collect()}
    assert sorted(scored) == [r[0] for r in duckdb.sql(f"select doc_id from '{data}/documents.parquet' order by 1").fetchall()]
    right = {y: [scored[i].predicted == y for i, v in labels.items() if v == y and scored[i].held_out] for y in (0, 1)}
    assert min(map(len, right.values())) >= 10
    assert (np.mean(right[0]) + np.mean(right[1])) / 2 >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.values())


def test_pipeline_equals_brute_force(spark, docs):
    df = spark.read.parquet(str(DATA / "documents.parquet"))
    labels = spark.read.parquet(str(DATA / "labels.parquet")).filter(~is_held_out("doc_id"))
    good = {r.doc_id for r in quality.score(df, quality.fit(df, labels)).filter(F.col("predicted") == 1).collect()}
    left = [(i, t) for i, t, *_ in docs if i in good]
    first = {}
    for i, t in left:
        first.setdefault(t or "", i)
    left = [(i, t) for i, t in left if first[t or ""] == i]
    groups = brute_components(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    clean = {i for i, v in brute(left, items).items() if not v[4]}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, len(plain.encode_ordinary(t or "")), True) for i, t in left if i in clean)
    out = corpus_pipeline.run(spark, str(DATA))
    assert sorted((r.doc_id, r.n_tokens, r.round_trip) for r in out.collect()) == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns_of_documents(spark):
    clash = ["score", "good", "contaminated", "clean", "id", "no_id", "spot", "c0", "__id", "__text", "gone"]
    say = lambda i, t: (i, t, "en", "s", 22, *[f"{c} of {i}" for c in clash], {"tag": 1})
    rows = [say(1, "Some text of one kind."), say(2, None), say(2, ""), say(None, "Another text of that kind."), say(3, "long text " * 20_000), say(3, "long text " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash) + ", tags map<string,int>")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(DATA))
        assert stage(spark, df.limit(0), str(DATA)).count() == 0
        if name == "byte_bpe":
            assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
            assert sorted((r.doc_id or 0, r.n_tokens > 0, r.round_trip) for r in out.collect()) == [(0, True, True), (1, True, True), (2, False, True), (2, False, True), (3, True, True), (3, True, True)]
            continue
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r["good"] == f"good of {r.doc_id}" and r.tags == {"tag": 1} for r in got), name
        assert name == "quality" or len(got) == {"exact_dedup": 4, "near_dedup": 6, "decontamination": 6}[name], name
