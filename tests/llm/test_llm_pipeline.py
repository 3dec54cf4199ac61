import hashlib

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from corpuskit.llm import bpe, decontam, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]


def test_pipeline_against_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.5").collect()}
    words = {i: simhash.fingerprint(rows[i].encode(), 3) for i in good}
    parent = {}

    def find(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i
    for i in sorted(good):
        for j in sorted(good):
            if i < j and bin(words[i] ^ words[j]).count("1") <= 2 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    first = {i for i in good if find(i) == i}
    items = [" ".join(decontam.words_of(r.text)) for r in bench.collect()]
    # By brute force: a document goes if a substring is within a fifth of an item's length.
    clean = {i for i in first if not any(decontam.substring_distance(x, " ".join(decontam.words_of(rows[i]))) <= len(x) / 5 for x in items if x)}
    encode, split = bpe.word_encoder(), bpe.splitter()
    want = {}
    for i in clean:
        text = secrets.redact_text(rows[i], secrets.scan_text(rows[i], secrets.RULES))
        want[i] = [x for w in split(text) for x in encode(w.encode())], hashlib.sha256(text.encode()).hexdigest()
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(clean) < len(first) < len(good) < len(rows)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text", "en", "s", 9), (3, "a b c d", "en", "s", 7), (3, "a b c d", "en", "s", 7)], schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_sql_oracles_match(spark):
    from corpuskit.llm import queries
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, SF)
        rel = con.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(got.columns) == sorted(cols)
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(rel.fetchall(), key=str), name
