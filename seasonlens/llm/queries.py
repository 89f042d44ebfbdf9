"""Thin queries over the operators, on the supplied tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from seasonlens.llm import audit, centroids, decontaminate, html_text, jaccard, language, licences, lines, mixing, neighbours, personal, secrets, substrings
from seasonlens.llm.registry import ORACLE, QUERIES, query  # noqa: F401


def table(spark, sf: str, name: str, *columns: str):
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*(columns or "*"))


@query("op4_mix_sources")
def op4(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", "source")
    mixed = mixing.mix_documents(docs)
    shards = F.transform("draws", lambda g: g["shard"])
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"), shards.alias("shards"))


@query("op8_line_dedup", """
WITH pages AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls, text FROM documents),
lines AS (SELECT doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM pages),
keyed AS (SELECT *, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS k FROM lines),
hot AS (SELECT source, k FROM (SELECT DISTINCT source, doc_id, k FROM keyed WHERE k <> '')
        JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)
        GROUP BY source, k, n HAVING count(*) >= 5 AND count(*) > 0.05 * n)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL) AS n_dropped
FROM keyed LEFT JOIN hot h USING (source, k) GROUP BY doc_id
""")
def op8(spark, sf):
    return lines.drop_boilerplate(table(spark, sf, "documents", "doc_id", "text", "source")).drop("source")


@query("op6_decontaminate", r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT n FROM bl),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM pos JOIN win USING (n, s)),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op6(spark, sf):
    found = decontaminate.find_contamination(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark"))
    return decontaminate.with_verdict(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_language_id")
def op9(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.drop("lang"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_substring_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN (SELECT h, min(doc_id) AS m FROM win GROUP BY h) USING (h) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(c.j) AS n_removed,
       sha256(coalesce(string_agg(x, ' ' ORDER BY o.j) FILTER (WHERE c.j IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words o USING (doc_id) LEFT JOIN cov c ON c.doc_id = o.doc_id AND c.j = o.j GROUP BY d.doc_id
""")
def op3(spark, sf):
    return substrings.repeated_spans(table(spark, sf, "documents", "doc_id", "text")).drop("spans")


@query("op10_ngram_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 10 * c >= 8 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT doc_id, min(o) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.doc_id) AS n_links FROM r GROUP BY doc_id
""")
def op10(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents", "doc_id", "text"))


@query("op1_nearest_neighbours")
def op1(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings", "vec_id", "embedding"))


@query("op5_secret_scan")
def op5(spark, sf):
    found = secrets.find_secrets(table(spark, sf, "documents", "doc_id", "text")).drop("text")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(told(of(*secrets.BASE)).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


@query("op7_html_extraction")
def op7(spark, sf):
    found = html_text.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_licence_scan", licences.oracle_sql())
def op2(spark, sf):
    found = licences.find_licences(table(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", F.length("licence_ids").alias("n_sentences"), F.size("licences").alias("n_licences"),
                        F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"))


@query("op11_filter_audit", r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
low AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > low, false)] AS fails FROM w JOIN low USING (t)),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE instr(o, x) = 0),
s AS (SELECT o AS filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(o) = 5),
r AS (SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS own,
             len(list_filter(range(1, 6), lambda i: fails[i] AND instr(substr(filter_order, 1, step - 1), substr('ABCDE', i, 1)) > 0)) AS earlier,
             fails[ascii(substr(filter_order, step, 1)) - 64] AS here, len(list_filter(fails, lambda x: x)) AS many FROM c, s),
q AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT here AND earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN here AND earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN here AND earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN here AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN here AND earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN here AND earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM q
""")
def op11(spark, sf):
    docs, labels = table(spark, sf, "documents", "doc_id", "text", "source"), table(spark, sf, "labels")
    return audit.audit_filters(docs, labels)


def _clusters_sql() -> str:
    """The rounds are written out one after another: each is a scan of the centroids before it."""
    one = r"""a{i} AS MATERIALIZED (SELECT key, v, min(list_sum(list_transform(range(1, 65), lambda p: (v[p] - c[p]) * (v[p] - c[p]))) * 64 + k) AS m FROM t, c{i} GROUP BY key, v),"""
    two = r"""
s{i} AS (SELECT (m % 64)::INT AS k, p, sum(v[p]) AS s, count(*) AS n FROM (SELECT m, v, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY ALL),
c{j} AS MATERIALIZED (SELECT c.k, coalesce(x.c, c.c) AS c FROM c{i} c LEFT JOIN
      (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{i} GROUP BY k) x USING (k)),
"""
    rounds = "".join((one + two).format(i=i, j=i + 1) for i in range(centroids.ROUNDS))
    return r"""
WITH e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = 64),
t AS MATERIALIZED (SELECT key, list_transform(x, lambda y: floor(256 * y)::BIGINT) AS v FROM e WHERE len(list_filter(x, lambda y: coalesce(isfinite(y), false))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS k, v AS c FROM (SELECT sha256('2:' || key) AS h, v FROM t ORDER BY h LIMIT 40)),
""" + rounds + one.format(i=centroids.ROUNDS) + r"""
f AS (SELECT key, (m % 64)::INT AS k, (m // 64)::BIGINT AS d FROM a{i})
SELECT key AS vec_id, f.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{i} c ON c.k = f.k
""".format(i=centroids.ROUNDS)


@query("op12_centroid_clusters", _clusters_sql())
def op12(spark, sf):
    found = centroids.cluster(table(spark, sf, "embeddings", "vec_id", "embedding"))
    per = found.members.groupBy("cluster").agg(F.sum("distance").cast("long").alias("cluster_inertia"))  # a row per centroid
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    texts = [(i, ",".join(map(str, c))) for i, c in enumerate(found.centroids)]
    text = spark.createDataFrame(texts, "cluster int, components string")
    shown = per.join(F.broadcast(text), "cluster").withColumn("inertia", F.lit(total.first()[0]).cast("long"))
    return found.members.join(F.broadcast(shown), "cluster").select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))


@query("op13_personal_data")
def op13(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    found = personal.find_personal(docs, personal.fit(docs)).drop("text")
    base = F.filter("personal", lambda s: s["base"])
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in personal.KINDS],
                        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("personal")).alias("spans"))
