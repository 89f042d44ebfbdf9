"""NULLs, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seasonlens.llm import decontaminate, html_text, jaccard, language, licences, lines, mixing, neighbours, secrets, substrings

LONG = " ".join(f"w{i % 977}x{i % 131}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, None, "en", "a", 1), (3, "", None, None, None), (4, "x", "en", None, 1),
    (None, "alpha beta gamma delta epsilon zeta", None, "b", 1), (5, LONG, "en", "b", 9), (6, LONG, "en", "b", 9), (6, LONG, "en", "b", 9),
    (7, "??? 123 ...", "de", "c", 1), (8, " \n\t \n", "de", "c", 1), (8, "same key other text here now", "de", "c", 1), (9, "y" * 5000, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "source_size", "target", "draws", "_src", "_h", "_block", "n_lines", "n_dropped", "lines", "_host", "_salt", "n_words", "hit_spans",
         "items", "lang_pred", "score", "secrets", "licence_ids", "licences", "key", "rep", "t1", "tile")
BENCH = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "same key other text here now"), (3, "")]
ADDS = {
    "mix": mixing.mix_documents, "lines": lines.drop_boilerplate, "secrets": secrets.find_secrets, "licences": licences.find_licences,
    "language": lambda d: language.identify(d, language.fit(d, rounds=1)),
    "benchmark": lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame(BENCH, "item_id long, text string")),
}
DIGESTS = {"substrings": substrings.repeated_spans, "jaccard": lambda d: jaccard.near_duplicates(d, runs=3)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", [*ADDS, *DIGESTS])
def test_every_row_is_kept_and_empty_tables_work(spark, docs, name):
    op = {**ADDS, **DIGESTS}[name]
    assert op(docs).count() == len(ROWS)
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ADDS)
def test_clashing_columns_are_kept_under_another_name(docs, name):
    clash = docs.withColumns({c: F.lit(7) for c in CLASH})
    out = ADDS[name](clash)
    got = out.collect()
    assert len(got) == len(ROWS) and len(set(out.columns)) == len(out.columns)
    kept = [c for c in CLASH if c in out.columns and all(r[c] == 7 for r in got) or f"{c}_in" in out.columns and all(r[f"{c}_in"] == 7 for r in got)]
    assert kept == list(CLASH)


def test_defined_results_of_null_and_empty_texts(docs):
    mixed = {(r.doc_id, r.size): r for r in ADDS["mix"](docs).collect()}
    assert mixed[2, 0].draws == [] and mixed[3, 0].draws == []
    clean = {(r.doc_id, r.text): r.n_lines for r in ADDS["lines"](docs).collect()}
    assert clean[2, None] == 0 and clean[3, ""] == 1
    lang = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in ADDS["language"](docs).collect()}
    assert lang[2, None] == lang[3, ""] == lang[7, "??? 123 ..."] == ("und", 0.0)
    hit = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontaminate.with_verdict(ADDS["benchmark"](docs)).collect()}
    assert hit[1, 6] == (6, [1]) and hit[None, 6] == (6, [1]) and hit[8, 6] == (6, []) and hit[2, 0] == (0, [])
    dup = sorted(((r.doc_id or -1), r.class_id or -1, r.n_links) for r in DIGESTS["jaccard"](docs).collect())
    assert (5, 5, 2) in dup and dup.count((6, 5, 2)) == 2 and (-1, -1, 0) in dup and (2, 2, 0) in dup and (3, 3, 0) in dup
    cut = sorted(((r.doc_id or -1), r.n_words, r.n_removed) for r in DIGESTS["substrings"](docs).collect())
    assert (5, 60_000, cut[[c[0] for c in cut].index(5)][2]) in cut and cut.count((6, 60_000, 60_000)) == 2 and (2, 0, 0) in cut
    assert (5, 60_000, 0) in cut, "a document is not repeated by itself"


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a/x", None), (1, None, ""), (None, "bad url", "<p>some text"), (2, "http://a/y", "<article>" + "z " * 50_000)],
                                  "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in html_text.extract(pages).collect()}
    assert got[1, "http://a/x"] == got[1, None] == "" and got[None, "bad url"] == "some text" and len(got[2, "http://a/y"]) == 99_999
    assert html_text.extract(pages.limit(0)).count() == 0
    nan, inf = float("nan"), float("inf")
    vec = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]),
           (7, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0]), (40, [0.0, 2.0])]
    rows = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(rows, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 7, 1.0), (20, 3, 40, 0.0), (40, 1, 1, 0.0), (40, 2, 7, 0.0), (40, 3, 8, 0.0)]
    assert neighbours.nearest(rows.limit(0)).count() == 0 and neighbours.nearest(rows.filter("vec_id = 2")).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_documents(spark, docs, stage):
    sf = "/root/testdata/sf0.001"
    wide = docs.withColumns({c: F.lit(7) for c in ("size", "Items", "score", "n_hit", "contaminated", "lines", "rep", "t1")})
    out = stage(spark, wide, sf)
    assert set(docs.columns) <= set(out.columns) and out.count() > 0
    if stage is not corpus_pipeline.mix_sources:
        assert out.columns == wide.columns and all(r.Items == r.score == r.contaminated == r.lines == 7 for r in out.collect())
    assert stage(spark, docs.limit(0), sf).count() == 0
