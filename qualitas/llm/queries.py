"""The registered queries of the thirteen operators, and DuckDB SQL where it can express them."""
from __future__ import annotations

import functools
import hashlib

import numpy as np
from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitas.llm import (
    best_fit_packing, bpe_tree, hamming_topk, imatch, importance_resampling, license_rules, mil_quality, pii_weak,
    ranked_search, superminhash, token_files, url_filter, warc,
)
from qualitas.llm.bpe import ID, encoder
from qualitas.session import work_folder
from qualitas.sources.tables import table

BYTE_BPE = tokenizer_file("byte_bpe_50k.json")
WORD_BPE = tokenizer_file("word_bpe_49k.json")


#: A document is good from this score on.
ACCEPT = 0.7


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from; the others are held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op1_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = mil_quality.train(docs, learnable(table(spark, sf_dir, "labels")))
    scored = mil_quality.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    items = best_fit_packing.pieces(table(spark, sf_dir, "documents"), BYTE_BPE, separator=0, capacity=2048)
    return best_fit_packing.pack(best_fit_packing.with_crc32(items), capacity=2048)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii_weak.find(docs, pii_weak.train(pii_weak.vote_counts(docs)))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii_weak.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives; digests and lengths of the payloads that are there."""
    folder = work_folder(spark, "warc")
    warc.register(spark)
    warc.deduplicated(table(spark, sf_dir, "pages"), min_bytes=0).write.format("warc").mode("append").save(folder)
    there = F.col("record_type") == "response"
    return spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit")).select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(there, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(there, warc.base32_column(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op5_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes for every vector whose id is divisible by 100, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return hamming_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP5_SQL = """
WITH codes AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, hamming(q.code, r.code)::INTEGER AS distance
  FROM codes q, codes r WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id))::INTEGER AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, by 2-word shingles at a similarity of 0.8."""
    found = superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS node FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN either e ON r.node = e.a),
least AS (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN sizes s ON l.doc_id = s.doc_id
"""


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = imatch.lexicon(docs)
    printed = docs.withColumn("fingerprint", imatch.fingerprint(F.col("text"), buckets))
    changed = (imatch.with_next(printed, ["text", "fingerprint"])
               .withColumn("edited", imatch.edited(F.col("text"), F.col("next_text")))
               .withColumn("edited_fingerprint", imatch.fingerprint(F.col("edited"), buckets)))
    return changed.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


OP7_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS next_text
  FROM documents),
versions AS (
  SELECT doc_id, 'own' AS kind, text FROM docs
  UNION ALL
  SELECT doc_id, 'edited', substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2)
  FROM docs),
terms AS (
  SELECT doc_id, kind, term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS hash
  FROM (SELECT DISTINCT doc_id, kind, unnest(string_split_regex(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{imatch.NOT_TERMS}')) AS term
        FROM versions)
  WHERE term <> ''),
lexicon AS (
  SELECT term FROM (SELECT term, count(*) AS df FROM terms WHERE kind = 'own' GROUP BY term)
  WHERE df * {imatch.MOST} >= (SELECT count(*) FROM terms WHERE kind = 'own')
    AND df <= pow((SELECT count(*) FROM documents), {1 - imatch.LOW})),
subsets(subset, first, mask, value) AS (VALUES {", ".join(
    f"({i}, {first}, {(1 << width) - 1}, {value})" for i, (first, width, value) in enumerate(imatch.SUBSETS))}),
parts AS (
  SELECT doc_id, kind, subset, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {imatch.DIGITS}) AS part
  FROM terms JOIN lexicon USING (term)
  JOIN subsets ON (hash >> first) & mask = value
  GROUP BY ALL),
known AS (SELECT DISTINCT doc_id, kind FROM terms JOIN lexicon USING (term)),
printed AS (
  SELECT v.doc_id, v.kind, CASE WHEN any_value(k.doc_id) IS NULL THEN '=' || md5(any_value(v.text))
         ELSE string_agg(coalesce(p.part, ''), '-' ORDER BY s.subset) END AS print
  FROM versions v CROSS JOIN subsets s
  LEFT JOIN parts p ON p.doc_id = v.doc_id AND p.kind = v.kind AND p.subset = s.subset
  LEFT JOIN known k ON k.doc_id = v.doc_id AND k.kind = v.kind
  GROUP BY v.doc_id, v.kind),
rows AS (
  SELECT o.doc_id, length(d.text) AS n_chars, sha256(v.text) AS edited_sha256, o.print AS fingerprint,
         e.print AS edited_fingerprint,
         coalesce(lead(o.print) OVER (ORDER BY o.doc_id), first_value(o.print) OVER (ORDER BY o.doc_id)) AS next_print
  FROM printed o JOIN printed e ON o.doc_id = e.doc_id AND o.kind = 'own' AND e.kind = 'edited'
  JOIN docs d ON d.doc_id = o.doc_id JOIN versions v ON v.doc_id = o.doc_id AND v.kind = 'edited'),
near AS (
  SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
         list_zip(string_split(fingerprint, '-'), string_split(edited_fingerprint, '-')) AS e,
         list_zip(string_split(fingerprint, '-'), string_split(next_print, '-')) AS n, next_print
  FROM rows)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE
         len(list_filter(e, lambda x: x[1] = x[2] AND x[1] <> ''))::DOUBLE
         / len(list_filter(e, lambda x: coalesce(x[1], '') <> '' OR coalesce(x[2], '') <> '')) END AS near_edited,
       CASE WHEN fingerprint = next_print THEN 1.0::DOUBLE ELSE
         len(list_filter(n, lambda x: x[1] = x[2] AND x[1] <> ''))::DOUBLE
         / len(list_filter(n, lambda x: coalesce(x[1], '') <> '' OR coalesce(x[2], '') <> '')) END AS near_next
FROM near
"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {ten + 1}, 10))::BIGINT >> {shift}) & 31) + 1, 1)"
    for ten in (0, 10, 20, 30) for shift in range(35, -1, -5))

OP4_SQL = f"""
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM payloads)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


#: The rules that op8 applies.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's URL."""
    folder = work_folder(spark, "url-rules")
    url_filter.build(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), folder)
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(urls, folder, default="allow").drop("url")


_URL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP8_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, says) AS (VALUES {_URL_RULES}),
fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, says,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, coalesce(says, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id AND place = 1
"""


@functools.cache
def _decimal(tokenizer: str) -> list[str]:
    return [str(i) for i in range(encoder(tokenizer).size)]


def _digests(ids: bytes, text: str) -> tuple[int, str, str]:
    decimal, numbers = _decimal(BYTE_BPE), np.frombuffer(ids, ID).tolist()
    return (len(numbers), hashlib.sha256(",".join([decimal[i] for i in numbers]).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe_tree.decode(bpe_tree.encode(table(spark, sf_dir, "documents"), BYTE_BPE), BYTE_BPE, _digests,
                           "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the written token files give it back."""
    folder = work_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, WORD_BPE, end_id=2)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document: the base phrases' places, and the labels of all detections that stay."""
    found = license_rules.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda d: d["start"])
    every = F.concat("base", "detections")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(license_rules.labels(F.col("base")), ",").alias("base_labels"),
        F.array_join(license_rules.labels(every), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda d: d["weight"])), F.lit(0.0)).alias("score"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"

OP11_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, trim(regexp_replace({_LOWER}, '{_SEPARATORS}', '  ', 'g'), ' ') AS w
  FROM documents),
sized AS (
  SELECT row, doc_id, ' ' || w || ' ' AS t, CASE WHEN w = '' THEN 0 ELSE {_blanks("w")} // 2 + 1 END AS n_words FROM words),
rules(rule, label, keyword, pattern, weight, base) AS (VALUES {", ".join(
    f"({i}, '{r.label}', '{license_rules.literal(r.keyword)}', '{license_rules.spaced(r.pattern)}', "
    f"{r.weight}::DOUBLE, {r.base})" for i, r in enumerate(license_rules.signature_rules()))}),
hits AS (
  SELECT row, rule, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS p
  FROM sized JOIN rules ON contains(t, keyword)),
places AS (
  SELECT row, rule, m[i] AS m, list_sum(list_transform(p[1:i] || m[1:i - 1], lambda x: {_blanks("x")}))::BIGINT AS before
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)),
found AS (SELECT row, rule, before // 2 AS s, (before + {_blanks("m")}) // 2 AS e FROM places),
reached AS (
  SELECT *, max(e) OVER (PARTITION BY row ORDER BY s, e DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM found),
opened AS (
  SELECT row, rule, s, e, row_number() OVER (PARTITION BY row ORDER BY s, e DESC, rule) AS n
  FROM reached WHERE r IS NULL OR e > r),
sweep AS (
  SELECT row, n, rule, e, NULL::INTEGER AS closed FROM opened WHERE n = 1
  UNION ALL
  SELECT o.row, o.n, CASE WHEN o.s >= w.e OR o.rule < w.rule THEN o.rule ELSE w.rule END,
         CASE WHEN o.s >= w.e OR o.rule < w.rule THEN o.e ELSE w.e END, CASE WHEN o.s >= w.e THEN w.rule END
  FROM sweep w JOIN opened o ON o.row = w.row AND o.n = w.n + 1),
stays AS (
  SELECT row, closed AS rule FROM sweep WHERE closed IS NOT NULL
  UNION ALL
  SELECT row, arg_max(rule, n) FROM sweep GROUP BY row
  UNION ALL
  SELECT row, rule FROM found JOIN rules USING (rule) WHERE base),
marks AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
  FROM stays JOIN rules USING (rule) GROUP BY row),
bases AS (
  SELECT row, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM found JOIN rules USING (rule) WHERE base GROUP BY row)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM sized LEFT JOIN bases USING (row) LEFT JOIN marks USING (row)
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's n-grams."""
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                           percent=5, min_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_CRC_TABLE = "[" + ", ".join(map(str, importance_resampling._STEP.tolist())) + "]"

OP12_SQL = rf"""
WITH texts AS (
  SELECT 'raw' AS side, doc_id AS id, {_LOWER} AS t FROM documents
  UNION ALL
  SELECT 'target', item_id, {_LOWER} FROM benchmark),
words AS (
  SELECT side, id, row_number() OVER () AS row,
         list_filter(string_split_regex(t, '{_SEPARATORS}'), lambda x: x <> '') AS w
  FROM texts),
grams AS (
  SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                  || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram
  FROM words),
counted AS (SELECT side, row, gram, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted)),
crcs AS (
  SELECT gram, xor(list_reduce(list_transform(range(0, length(h) // 2),
      lambda i: ('0x' || substr(h, 2 * i::INTEGER + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, ({_CRC_TABLE}::BIGINT[])[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM hexed),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'raw'), 0) AS s, coalesce(sum(n) FILTER (side = 'target'), 0) AS t
  FROM counted JOIN crcs USING (gram) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * ((SELECT sum(s) FROM buckets)::DOUBLE + 10000)
                            / ((s::DOUBLE + 1) * ((SELECT sum(t) FROM buckets)::DOUBLE + 10000))))::BIGINT AS gain
  FROM buckets),
weighed AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM counted JOIN crcs USING (gram) JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY row),
scored AS (
  SELECT id AS doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE side = 'raw'),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= 5 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = rf"""
WITH doc_terms AS (
  SELECT doc_id, row, term, count(*) AS tf
  FROM (SELECT doc_id, row_number() OVER () AS row, unnest(string_split_regex({_LOWER}, '{_SEPARATORS}')) AS term
        FROM documents)
  WHERE term <> '' GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(string_split_regex({_LOWER}, '{_SEPARATORS}')) AS term FROM benchmark)
  WHERE term <> '' GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM doc_terms, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN doc_terms USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
  GROUP BY item_id, doc_id, row),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES = {
    "op1_mil_quality": op1_mil_quality,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_hamming_topk": op5_hamming_topk,
    "op6_superminhash": op6_superminhash,
    "op7_imatch": op7_imatch,
    "op8_url_filter": op8_url_filter,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_token_files": op10_token_files,
    "op11_license_rules": op11_license_rules,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op5_hamming_topk": OP5_SQL, "op6_superminhash": OP6_SQL,
                      "op7_imatch": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_license_rules": OP11_SQL,
                      "op12_importance_resampling": OP12_SQL, "op13_ranked_search": OP13_SQL}
