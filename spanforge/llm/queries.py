"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.byte_bpe import decode_ids, encode_documents
from spanforge.llm.common import discard, materialize, table
from spanforge.llm.hnsw import THRESHOLD, embedding_links
from spanforge.llm.html_consensus import extract_main_text
from spanforge.llm.language_mixture import held_out, learn, with_language
from spanforge.llm.line_frequency import MAX_RATIO, MIN_PAGES, drop_site_boilerplate
from spanforge.llm.periodic_runs import with_runs
from spanforge.llm.pii import KINDS, personal_spans, span_text
from spanforge.llm.poisson_mix import SEED, TEMPERATURE, mix_sources
from spanforge.llm.progressive_jpeg import with_media, with_pictures
from spanforge.llm.simhash import simhash_components
from spanforge.llm.spelling import count_words, letter_runs, spelling_variants
from spanforge.llm.toxicity import learn_toxicity, with_toxicity
from spanforge.llm.warc_archive import MIN_REVISIT_BYTES, read_archive, write_archive


#: Parts in which op1's tensors are stored, read back and released: all at once are three times the input's files.
TENSOR_PARTS = 12


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        (F.monotonically_increasing_id() % TENSOR_PARTS).cast("int").alias("part"),
    )
    stored = materialize(with_media(docs).select("doc_id", "n_bytes", "media", "part"), "media", by="part")
    for k in range(TENSOR_PARTS):
        read = _features(stored.where(F.col("part") == k))
        features = read if k == 0 else features.unionByName(read)
    return features


def _features(stored: DataFrame) -> DataFrame:
    """The digests of stored files, and a feature of their tensors: these are a table too, until the feature is computed from what is read back."""
    read = with_pictures(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "height",
        "width",
        "rgb",
    )
    tensors = materialize(read, "rgb-tensors")
    feature = F.concat("height", F.lit("x"), "width", F.lit("x3:"), F.lpad(F.lower(F.hex(F.crc32("rgb"))), 8, "0"))
    features = materialize(tensors.withColumn("feature", feature).drop("height", "width", "rgb"), "picture-features")
    discard(tensors)
    return features


def op2_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(table(spark, sf_dir, "pages"))
    return read_archive(spark, archive).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def _number_of(kind: int) -> Column:
    """Base spans of a kind. The lambda has one parameter only: Spark gives a second one, also one with a default, the place in the array."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    counts = [_number_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    terms = F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", terms)).alias("spans"),
        F.coalesce(F.sha2("sanitised", 256), "text_sha256").alias("sanitised_sha256"),
    )


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return with_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


def op5_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_line_site_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_in", "lines_dropped")


def op7_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Stored in between: a task that encoded and decoded would hold two Python workers.
    encoded = materialize(encode_documents(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids"), "bpe-ids")
    return decode_ids(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), letter_runs(F.col("text")).alias("runs"))
    # One run in 199 of each document loses a letter: planted misspellings.
    deleted = F.expr("transform(runs, w -> IF(crc32(concat(id, ':', w)) % 199 > 0, w, overlay(w PLACING '' FROM CAST(crc32(concat(id, ':', w)) % char_length(w) AS INT) + 1 FOR 1)))")
    return spelling_variants(count_words(docs, deleted, least_length=6, least=5))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, _words(F.col("text"))).alias("words"), F.floor(h / 10).alias("g"))
    # Rows with planted runs: from word a on, the text goes on with words a to a + p - 1 over and over.
    a = F.expr("g % size(words)")
    p = F.expr("1 + (size(words) - a) div (3 + g % 8)")
    planted = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)])), ' ')")
    docs = docs.withColumn("a", a).withColumn("p", p).withColumn("text", F.when(F.size("words") > 0, planted).otherwise(F.col("text")))
    found = with_runs(docs.select("doc_id", "text")).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    found = found.withColumn("longest", F.struct((-longest["col1"]).alias("length"), longest["start"].alias("start"), longest["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op13_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn_toxicity(docs.where(~held), table(spark, sf_dir, "labels"))
    return with_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_progressive_jpeg,
        op2_warc_content_addressed,
        op3_pii_disclosure,
        op4_language_mixture,
        op5_html_consensus,
        op6_line_site_frequency,
        op7_simhash_covering,
        op8_embedding_hnsw,
        op9_poisson_mix,
        op10_byte_bpe,
        op11_spelling_variants,
        op12_periodic_runs,
        op13_compression_toxicity,
    )
}

ORACLE_SQL = {
    "op2_warc_content_addressed": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
             o AS (SELECT html, max(page_id) AS owner FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY html)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN o.owner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN o.owner <> p.page_id THEN o.owner END AS refers_to
        FROM p LEFT JOIN o ON p.html = o.html""",
    "op6_line_site_frequency": f"""
        WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
             t AS (SELECT source, count(*) AS n_pages FROM d WHERE text IS NOT NULL GROUP BY source),
             l AS (SELECT DISTINCT doc_id, source, trim(line) AS line FROM (SELECT doc_id, source, unnest(lines) AS line FROM d)),
             c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
             b AS (SELECT c.source, list(c.line) AS found FROM c JOIN t ON c.source = t.source
                   WHERE c.n >= {MIN_PAGES} AND c.n > {MAX_RATIO} * t.n_pages GROUP BY c.source),
             k AS (SELECT d.*, CASE WHEN b.found IS NULL THEN lines
                   ELSE list_filter(lines, lambda x: NOT list_contains(b.found, trim(x))) END AS kept
                   FROM d LEFT JOIN b ON d.source = b.source)
        SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(len(lines) AS BIGINT) AS lines_in,
               CAST(len(lines) - len(kept) AS BIGINT) AS lines_dropped FROM k""",
    "op8_embedding_hnsw": f"""
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL),
             u AS (SELECT * FROM n WHERE isfinite(norm) AND norm > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
                   WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
             r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
             k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN k ON c.vec_id = k.vec_id""",
    "op9_poisson_mix": f"""
        WITH s AS (SELECT source, count(*) AS n_docs, pow(count(*), {TEMPERATURE}) AS weight FROM documents GROUP BY source),
             r AS (SELECT source, weight / (SELECT sum(weight) FROM s) * (SELECT sum(n_docs) FROM s) / n_docs AS rate FROM s),
             k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 25) AS BIGINT) + 1)) AS k FROM r),
             c AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
             u AS (SELECT *, (CAST('0x' || substr(md5('count:{SEED}:' || doc_id), 1, 13) AS BIGINT) + 0.5) / pow(2, 52) AS u FROM documents),
             n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source = c.source WHERE c.cdf < u.u GROUP BY u.doc_id),
             x AS (SELECT d.*, unnest(range(0, n.n)) AS copy FROM documents d JOIN n ON d.doc_id = n.doc_id)
        SELECT *, md5('order:{SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM x""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE
             t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
             u AS (SELECT id, w, count(*) AS n FROM t WHERE length(w) >= 6 GROUP BY id, w),
             b AS (SELECT *, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)) AS bytes FROM u),
             h AS (SELECT *, xor(4294967295, list_reduce(bytes, lambda s, x: list_reduce(range(8), lambda y, k: xor(y >> 1, (y & 1) * 3988292384), xor(s, x)), CAST(4294967295 AS BIGINT))) AS h FROM b),
             m AS (SELECT CASE WHEN h % 199 > 0 THEN w ELSE substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) END AS word, n FROM h),
             v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
             i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
             k AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INT)) AS a, substr(word, CAST(i + 1 AS INT)) AS z FROM i),
             g AS (SELECT DISTINCT k.word AS longer, k.n AS longer_n, v.word AS shorter, v.n AS shorter_n FROM k JOIN v ON v.word = k.a || k.z),
             p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
                   UNION ALL SELECT longer, shorter, shorter_n FROM g UNION ALL SELECT shorter, longer, longer_n FROM g),
             c AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p),
             f AS (SELECT v.word, v.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.near_n >= 5 * v.n THEN c.near END AS form, CASE WHEN c.near_n >= 5 * v.n THEN c.near_n END AS form_n
                   FROM v LEFT JOIN c ON v.word = c.word AND c.place = 1),
             r AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT r.word, f.form, r.depth + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
             e AS (SELECT word, arg_max(root, depth) AS root FROM r GROUP BY word)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON f.word = e.word""",
    "op12_periodic_runs": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda s, x: list_reduce(range(8), lambda y, k: xor(y >> 1, (y & 1) * 3988292384), xor(s, x)), CAST(4294967295 AS BIGINT))) AS h FROM documents),
             g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS b FROM t),
             d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // b) + 1] END) ELSE w END AS w FROM g),
             x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
             p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
             e AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
             c AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM e GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
             r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.q < c.q AND o.s <= c.s AND o.s + o.l >= c.s + c.l)),
             k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) AS place FROM r),
             m AS (SELECT doc_id, count(*) AS n_runs, min(s) FILTER (place = 1) AS s, min(l) FILTER (place = 1) AS l, min(q) FILTER (place = 1) AS q, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM k GROUP BY doc_id),
             o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
             f AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS collapsed FROM x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = x.doc_id AND o.i = x.i) GROUP BY x.doc_id)
        SELECT d.doc_id, coalesce(m.n_runs, 0) AS n_runs, m.s AS start, m.l AS length, m.q AS period, 1000 * m.l // m.q AS exponent_milli, sha256(coalesce(m.listed, '')) AS runs_sha256, sha256(coalesce(f.collapsed, '')) AS collapsed_sha256
        FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id""",
}
