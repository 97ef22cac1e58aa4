"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import alignment, langid, leakage, maxscore, packing, phrases, pieces, repeats, secrets, simhash, toxicity, vectors, warc
from tallyforge.llm.common import crc_fold, stage, table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, limit=3)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs, length=50)
    n_bytes = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    return found.select(
        "row.doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, read on the driver; about 1.5 MB."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query
def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenised_pieces(docs, tokenizer_json(), size=1024, end_id=2)
    return packing.pack(stage(pieces, "pieces"), size=1024)


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in secrets.BASE_RULES)))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "row.doc_id",
        *(number(rule.kind) for rule in secrets.BASE_RULES),
        F.sha2(secrets.joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
    )


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "row.doc_id",
        (crc_fold("row.doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.fit(langid.training_rows(docs))
    return langid.identify(docs.select("doc_id", "text"), filters).select(
        "row.doc_id", (crc_fold("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op6_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maxscore.whole_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


ORACLE["op6_maxscore_topk"] = """
WITH usable AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS whole
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, r.vec_id,
           CAST(list_inner_product(CAST(q.whole AS DOUBLE[]), CAST(r.whole AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable r ON len(q.whole) = len(r.whole) AND q.vec_id <> r.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.classify(table(spark, sf_dir, "pages")))
    records = warc.read_records(warc.normalise(archives))
    revisit = F.col("record_type") == "revisit"
    # A response is judged by what was read back, a revisit by what its headers say.
    return records.select(
        warc.page_number("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


ORACLE["op3_warc_normaliser"] = """
WITH sized AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), records AS (
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest
    FROM sized
), latest AS (
    SELECT payload_digest, max(page_id) AS latest FROM records WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
       CASE WHEN r.payload_bytes >= 1000 AND r.page_id <> l.latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r.payload_bytes >= 1000 AND r.page_id <> l.latest THEN l.latest END AS refers_to
FROM records r LEFT JOIN latest l USING (payload_digest)
"""


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A public SentencePiece model, read on the driver; about 0.5 MB."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query
def op4_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    found = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    text = F.coalesce("row.text", F.lit(""))
    return pieces.decode(found, model).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        (F.col("decoded") == text).alias("round_trip"),
    )


ORACLE["op2_embedding_dedup"] = """
WITH RECURSIVE good AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
    SELECT a.vec_id AS x, b.vec_id AS y
    FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings
    UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
)
SELECT e.vec_id, (SELECT count(*) FROM pairs WHERE x = e.vec_id) AS n_links,
       r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = e.vec_id
"""

# A text as hexadecimal digits: byte p (from 0) is the two digits from 2 * p + 1 on.
ORACLE["op8_suffix_dedup"] = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
    SELECT doc_id, h, unnest(range(len(h) // 2)) AS p FROM texts
), strings AS (
    SELECT doc_id, p, CASE WHEN p + 50 <= len(h) // 2 THEN md5(substr(h, 2 * p + 1, 100)) END AS s,
           substr(h, 2 * p + 1, 2) AS b
    FROM bytes
), marked AS (
    SELECT doc_id, p, b, s IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY s) AS hit FROM strings
), covered AS (
    SELECT doc_id, p, b,
           bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
    FROM marked
), edges AS (
    SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM covered
), cut AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
           coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), '') AS kept
    FROM edges GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts t LEFT JOIN cut c USING (doc_id)
"""


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_json(), piece_model()).drop("groups")


@query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leakage.find_leaks(docs, table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE["op12_benchmark_decontamination"] = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, p, p + least(len(w), 10) - 1) AS v
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item_words WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT size FROM windows
), places AS (
    SELECT doc_id, p, size, list_slice(w, p, p + size - 1) AS v
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc_words, sizes WHERE len(w) >= size)
), hits AS (
    SELECT DISTINCT doc_id, item_id, p, p + size - 1 AS q FROM places JOIN windows USING (size, v)
), hit_words AS (
    SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, q + 1)) AS x FROM hits) GROUP BY 1
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.mine(docs, least=10, top=2000, share=50)


ORACLE["op11_phrase_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), sequences AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counts AS (
    SELECT lang, k, list_slice(w, p, p + k - 1) AS v, CAST(count(*) AS HUGEINT) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM sequences, range(1, 4) AS t(k) WHERE len(w) >= k)
    GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY 1
), cuts AS (
    SELECT c.lang, c.v, c.k, c.f AS a, l.f AS l, r.f AS r, l.k AS cut, 1000000 * c.f * c.f // (l.f * r.f) AS score
    FROM counts c, range(1, 3) AS t(j), counts l, counts r
    WHERE c.k >= 2 AND c.f >= 10 AND j < c.k
      AND l.lang = c.lang AND l.v = list_slice(c.v, 1, j) AND r.lang = c.lang AND r.v = list_slice(c.v, j + 1, c.k)
), candidates AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, v ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, v, max(a) AS a FROM (
        SELECT lang, list_slice(v, 1, 2) AS v, a FROM candidates WHERE k = 3
        UNION ALL SELECT lang, list_slice(v, 2, 3), a FROM candidates WHERE k = 3)
    GROUP BY ALL
), kept AS (
    SELECT c.lang, array_to_string(c.v, ' ') AS phrase, c.a, c.l, c.r, c.score
    FROM candidates c LEFT JOIN longer o ON o.lang = c.lang AND o.v = c.v
    WHERE o.a IS NULL OR 100 * o.a < 50 * c.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
