"""The queries of the subpackage: those that SQL can express against it, the pipeline against a plain version."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import pytest
import tiktoken

from tagloom.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, db, name):
    df, want = QUERIES[name](spark, DATA), db.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def texts_of(db):
    return db.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_suffix_query(spark, db):
    from tests.llm.test_operators import plain_suffix

    rows = texts_of(db)
    want = {i: (n, gone, spans, sha(kept)) for (i, _), (n, gone, spans, kept) in zip(rows, plain_suffix([t for _, t in rows]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, DATA).collect()} == want
    assert sum(w[1] for w in want.values())


def test_pii_query(spark, db):
    from tagloom.llm.pii import KINDS
    from tests.llm.test_operators import plain_base

    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, DATA).collect()}
    rows = texts_of(db)
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        base, r = plain_base(t), got[i]
        named = [f"{KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for j, _, _ in base) for k in range(4)]
        assert r.base_sha256 == sha(",".join(named))
        spans = r.spans.split(",") if r.spans else []
        assert set(named) <= set(spans) and len(spans) == r.n_spans
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2])))


def test_bpe_query(spark, db):
    from tagloom.llm import byte_bpe

    path, pattern = byte_bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_byte_bpe"](spark, DATA).collect()}
    ids = {i: library.encode_ordinary(t or "") for i, t in texts_of(db)}
    assert got == {i: (len(ids[i]), sha(" ".join(map(str, ids[i]))), sha(t or "")) for i, t in texts_of(db)}


def test_learnt_queries(spark, db):
    """Held-out accuracy, and that a score takes nothing but the text."""
    more = DATA.replace("sf0.001", "sf0.01")  # at 0.001 there are a few dozen labels
    if not os.path.isdir(more):
        pytest.skip("no tables")
    docs, labels = f"'{more}/documents.parquet'", f"'{more}/labels.parquet'"
    langs = dict(db.sql(f"SELECT doc_id, lang FROM {docs} WHERE lang IS NOT NULL").fetchall())
    texts = dict(db.sql(f"SELECT doc_id, text FROM {docs}").fetchall())
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, more).collect()}
    held = [i for i in langs if got[i].held_out and got[i].lang_pred != "und"]
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held) > 0
    toxic = dict(db.sql(f"SELECT doc_id, toxic FROM {labels} WHERE toxic IS NOT NULL").fetchall())
    marks = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, more).collect()}
    held = [i for i in toxic if i in marks and marks[i].held_out]
    assert set(marks) == set(texts) and sum(marks[i].predicted == toxic[i] for i in held) >= 0.9 * len(held) > 0
    for found, column in ((got, "lang_pred"), (marks, "score")):
        by_text = {}
        for i, t in texts.items():
            assert by_text.setdefault(t, found[i][column]) == found[i][column]


def test_pipeline_with_odd_rows(spark, db, tmp_path):
    """Nulls, repeats, ids that several texts share, empty texts and columns with names that operators use inside."""
    import corpus_pipeline

    shared = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a copy"), (2, "a copy"), (2, "unique text here"), (3, "same"), (3, "same"), (None, "no id"), (None, None), (4, ""), (5, shared), (5, shared + " x"), (6, "far " * 5000)]
    for t in ("labels", "benchmark"):
        db.sql(f"SELECT * FROM {t}").df().to_parquet(tmp_path / f"{t}.parquet")
    names = "doc_id long, text string, lang string, source string, n_chars long, base string, candidates string, fold int, ids string, id long, own long, key long, digest string, at int"
    docs = spark.createDataFrame([(i, t, "xx", "s", 1, "b", "c", 0, "i", 7, 8, 9, "d", 3) for i, t in rows], names)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = [(1, "a copy"), (2, "unique text here"), (3, "same"), (4, ""), (5, shared), (6, "far " * 5000), (None, "no id")]
    # of near copies under one id, either may stay; of the empty texts, the one with an id, and one without id beside it
    assert [x[:2] for x in left] == sorted((i is None, i or 0) for i, _ in kept) + [(True, 0)]
    docs.where("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, db):
    import corpus_pipeline
    from tests.llm.test_operators import plain_components, plain_sets, plain_words

    from tagloom.llm import byte_bpe, toxicity

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rows = [(i, t) for i, t in db.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i not in toxic]
    best: dict[str, tuple] = {}
    for i, t in rows:
        k = "".join((t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))))
        best[k] = min(best.get(k, (0, 1 << 60, "")), (-len(t or ""), i, t))
    rows = sorted((i, t) for _, i, t in best.values())
    comp = plain_components(plain_sets([t for _, t in rows]))
    rows = [r for k, r in enumerate(rows) if comp[k] == k]
    windows = {tuple(w[k : k + min(10, len(w))]) for (t,) in db.sql("SELECT text FROM benchmark").fetchall() if (w := plain_words(t)) for k in range(max(1, len(w) - 9))}
    clean = {i for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [plain_words(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == clean
    library = tiktoken.Encoding("own", pat_str=byte_bpe.public_vocabulary()[1], mergeable_ranks=byte_bpe.read_ranks(byte_bpe.public_vocabulary()[0]), special_tokens={})
    texts = dict(rows)
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_decodes_its_tokens(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b\u00e9 \U0001f600"), (2, ""), (3, None), (4, "the cat  sat\n")], "doc_id long, text string")
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()} == want
