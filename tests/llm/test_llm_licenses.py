import re

from corpuskit.llm import licenses

SCHEMA = "doc_id bigint, text string, label string, at int, n int, matches string"
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
NOTICE = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
          "and associated documentation files (the \"Software\")")
TEXTS = [None, "", "plain", "MIT License", "mit-LICENSE mit license", "xmit license mit licenses mitélicense é mit license", "the GNU General Public License",
         "general public mit license", "license " * 500 + "mit license", "mit\x00license\x7fapache_license", "w " * 100_000 + "Apache License", NOTICE,
         NOTICE.replace("charge", "cost"), NOTICE.replace("hereby", "now"), "Licensed under CC BY-NC 4.0.", "license of mit"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), sorted((i, l) for p, l in PHRASES.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p)


def test_base_places_match_brute_force(spark):
    rows = [(i, t, "l", 1, 2, "m") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, *rows[3][1:])]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, sorted((m.start, m.label) for m in r.matches if m.base)) for r in got), key=str) == \
        sorted(((r[0], *base(r[1])) for r in rows), key=str)


def test_notices_need_their_key_phrases(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: {(m.label, round(m.share, 2)) for m in r.matches if not m.base} for r in licenses.scan(df).collect()}
    assert got[11] == {("mit", 1.0)} and got[12] == {("mit", 0.95)} and got[13] == set() and got[14] == {("cc-by-nc", 1.0)}


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
