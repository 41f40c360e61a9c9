"""The queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import bpe, exact_dedup, interleave, langid, line_dedup, mixing, near_dedup, quality, token_store, warc
from lattiq.llm.common import Scratch, held_out, table


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in LATTIQ_TOKENIZERS, or of the public_tokenizers package."""
    if folder := os.environ.get("LATTIQ_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), tokenizer_path("word_bpe_49k.json"))
    return token_store.read_tokens(manifest)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), any_number=True)


def op3_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "op3"), table(spark, sf_dir, "documents")
    media = scratch.cut(interleave.describe_media(interleave.store_texts(docs, scratch)), "described")
    found = interleave.parse_sequences(interleave.pages_of(docs), "doc_id", "page", carry=("n_bytes",))
    # The texts of a sequence in order, told by count and digest; only these go through the join.
    texts = F.filter("sequence", lambda x: x["kind"] == "text")
    found = found.withColumns({"n_items": F.size("sequence").cast("long"), "texts_sha256": F.sha2(F.encode(F.array_join(F.transform(texts, lambda x: x["text"]), "\n"), "UTF-8"), 256)})
    found = interleave.resolve(found, "doc_id", media)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "texts_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn_profiles(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "op6")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return found.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_mixing, op3_interleaved_media, op4_near_dedup, op5_language_id, op6_warc, op7_bpe, op8_exact_dedup, op9_quality, op10_line_dedup)}

#: Characters that count as blank, as DuckDB's regular expressions name them.
_BLANK = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op4_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d),
        n AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a),
        c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op8_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op2_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1) // 16 AS block, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS rank FROM d),
        s AS (SELECT source, count(*) AS n, (count(*) + 15) // 16 AS blocks FROM d GROUP BY 1),
        q AS (SELECT source, blocks, greatest(1, CAST(floor(round(1000 * sqrt(n) / sum(sqrt(n)) OVER (), 6) + 0.5) AS BIGINT)) AS quota, row_number() OVER (ORDER BY source) - 1 AS i FROM s),
        f AS (SELECT DISTINCT unnest([0, blocks // quota, (blocks + quota - 1) // quota]) AS first_frame FROM q),
        g AS (SELECT first_frame, list(greatest(0, least(quota, blocks - first_frame * quota)) ORDER BY i) AS q FROM f, q GROUP BY 1),
        sched AS (
            SELECT first_frame, q, CAST(list_sum(q) AS BIGINT) AS len, CAST(0 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS used, CAST(NULL AS BIGINT) AS pick FROM g WHERE list_sum(q) > 0
            UNION ALL
            SELECT first_frame, q, len, t + 1, list_transform(used, lambda u, i: u + CAST(i - 1 = p AS BIGINT)), p
            FROM (SELECT *, list_min(list_filter(list_transform(used, lambda u, i: CASE WHEN u < q[i] AND (u * len) // q[i] <= t THEN (((u + 1) * len + q[i] - 1) // q[i]) * 100000 + i - 1 END), lambda x: x IS NOT NULL)) % 100000 AS p FROM sched WHERE t < len)),
        pattern AS (SELECT first_frame, pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY first_frame, pick ORDER BY t) - 1 AS k FROM sched WHERE pick IS NOT NULL),
        placed AS (SELECT r.*, q.i, q.quota, r.block // q.quota AS frame, r.block % q.quota AS k, (SELECT max(first_frame) FROM f WHERE first_frame <= r.block // q.quota) AS first_frame FROM r JOIN q USING (source))
        SELECT doc_id, source, block, frame, CAST(slot AS INTEGER) AS slot, row_number() OVER (ORDER BY frame, slot, rank) - 1 AS position
        FROM placed JOIN pattern USING (first_frame, i, k)""",
    "op10_line_dedup": rf"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d WHERE text IS NOT NULL),
        p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, lead(i) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL AS pair,
                     len(list_filter(regexp_split_to_array(line, '{_BLANK}+'), lambda w: w <> '')) >= 50 AS long FROM l),
        w AS (SELECT doc_id, i, i + 2 AS reach, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS later FROM p WHERE pair
              UNION ALL
              SELECT doc_id, i, i + 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 FROM p WHERE long),
        r AS (SELECT doc_id, i, max(reach) AS reach FROM w WHERE later GROUP BY ALL),
        f AS (SELECT *, CASE WHEN i < max(reach) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
        c AS (SELECT l.doc_id, l.i, l.line, coalesce(max(f.reach) OVER (PARTITION BY l.doc_id ORDER BY l.i) > l.i, false) AS gone, coalesce(f.fresh, 0) AS fresh FROM l LEFT JOIN f USING (doc_id, i)),
        t AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_deleted, CAST(sum(fresh) AS BIGINT) AS n_runs, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean FROM c GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, sha256(clean) AS text_sha256
        FROM d LEFT JOIN t USING (doc_id)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
        h AS (SELECT *, sha1(html) AS hex FROM p),
        b AS (SELECT *, list_transform(range(32), lambda i: list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INT) * (16 >> CAST(j AS INT))))) AS fives
              FROM (SELECT *, string_agg_bits AS bits FROM (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right(bin(strpos('0123456789abcdef', substr(hex, CAST(i AS BIGINT), 1)) - 1 + 16), 4)), 'string_agg', '') AS string_agg_bits FROM h)))
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, list_aggregate(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, url
        FROM b""",
}
