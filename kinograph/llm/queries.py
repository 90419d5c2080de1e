"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm import ann, bpe, langid, licenses, line_dedup, media, packing, periodic, quality, sharding, simhash, url_filter, whitening
from kinograph.llm.common import table


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file; read by the driver, sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text"), model).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, vocabulary("byte_bpe_50k.json").decode(), capacity=1024, end_id=0)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.resample(docs, labels, carry=["doc_id"]).select("doc_id", "log_weight", "key")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0, k=10)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_frequent_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.dated_pages(spark, sf_dir)
    out = url_filter.judge(pages, url_filter.sample_entries(pages), "page_id", "url", "fetch_day")
    return out.select("page_id", "fetch_day", "host", "n_active", "lists", "matched", "blocked")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(table(spark, sf_dir, "documents").select("doc_id", "text"), distance=2, words=3)
    return grouped.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), n_shards=40, seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", periodic.find(periodic.with_planted_runs(F.col("doc_id"), F.col("text"))).alias("found")).select("doc_id", "found.*")
    top = periodic.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("top.length * 1000 div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32, scale=64, shift=1_000_000)


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an interleaved sequence, its media stored, read back and resolved: a row per item, in place."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    stored = media.store_media(media.payload(F.col("src")), media.page_payloads(pages, "html"))
    whole = media.interleave(pages, media.read_media(stored), "page_id", "html")
    rows = whole.select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")
    return rows.select("page_id", "position", "kind", "text", "caption", "src", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_media": op10_media,
    "op11_licenses": op11_licenses,
    "op12_periodic": op12_periodic,
    "op13_whitening": op13_whitening,
    "media_pages": media_pages,
}

OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.i, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, CAST((page_id * 37) % 365 AS INT) AS fetch_day,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS h FROM p WHERE host IS NOT NULL),
s AS (SELECT host, h, (['adult', 'malware', 'spam'])[CAST((h // 4) % 3 + 1 AS INT)] AS list, CAST((h // 16) % 300 AS INT) AS day FROM h WHERE h % 4 = 0),
e AS (SELECT list, host, 'add' AS action, day AS since FROM s
  UNION ALL SELECT list, host, 'remove', day + 60 FROM s WHERE (h // 4) % 2 = 0
  UNION ALL SELECT list, host, 'add', day + 120 FROM s WHERE (h // 4) % 5 = 0
  UNION ALL SELECT 'spam', 'example.org', 'add', 100 UNION ALL SELECT 'spam', 'example.org', 'remove', 130),
g AS (SELECT list, host, since, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS gone FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY list, host ORDER BY since) AS til FROM g),
a AS (SELECT p.page_id, v.list, v.host FROM p JOIN v ON v.gone = 0 AND (p.host = v.host OR ends_with(p.host, '.' || v.host))
  AND p.fetch_day >= v.since AND (v.til IS NULL OR p.fetch_day < v.til)),
b AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(host, length(host)) AS matched FROM a GROUP BY page_id)
SELECT p.page_id, p.fetch_day, p.host, coalesce(b.n, 0) AS n_active, coalesce(b.lists, '') AS lists, b.matched, b.n IS NOT NULL AS blocked
FROM p LEFT JOIN b USING (page_id)
"""


def op11_sql(similarity: float = 0.8, shift: int = 3) -> str:
    """The same scan as joins of word rows: grams by equality of their words, diagonals, bands, words that stand on them."""
    held = licenses.templates()
    quoted = lambda text: "'" + text + "'"
    values = ", ".join(f"({n}, {quoted(t.label)}, {t.phrase}, {t.k}, {t.votes_needed(similarity)}, string_split({quoted(' '.join(t.words))}, ' '))" for n, t in enumerate(held))
    return rf"""
WITH t(template, label, phrase, k, needed, ws) AS (VALUES {values}),
g AS (SELECT template, k, i - 1 AS place, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM t)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
l AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, 2 AS k, w || ' ' || w1 AS gram FROM l UNION ALL SELECT doc_id, i, 4, w || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM l),
v AS (SELECT doc_id, template, i - place AS diagonal, count(DISTINCT place) AS votes FROM r JOIN g USING (k, gram) GROUP BY ALL),
o AS (SELECT v.*, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN phrase THEN 0 ELSE {shift} END AS INT), 1) AS opens FROM v JOIN t USING (template)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM o),
b AS (SELECT doc_id, template, band FROM n JOIN t USING (template) GROUP BY ALL HAVING sum(votes) >= any_value(needed)),
s AS (SELECT b.doc_id, b.template, b.band, p.i AS place, min(p.i - 1 + n.diagonal) AS word FROM b JOIN n USING (doc_id, template, band)
  JOIN (SELECT template, ws[i] AS tw, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)) p ON p.template = b.template
  JOIN w ON w.doc_id = b.doc_id AND w.i = p.i - 1 + n.diagonal AND w.w = p.tw GROUP BY ALL),
f AS (SELECT doc_id, template, label, phrase, min(word) AS start, count(*) / len(ws) AS similarity FROM s JOIN t USING (template)
  GROUP BY doc_id, template, band, label, phrase, ws HAVING count(*) / len(ws) >= CASE WHEN phrase THEN 1 ELSE {similarity} END)
SELECT d.doc_id, len(d.ws) AS n_words, count(f.doc_id) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(similarity), 0.0) AS score
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id, d.ws
"""


ORACLES: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op6_url_filter": OP6_SQL, "op11_licenses": op11_sql()}
