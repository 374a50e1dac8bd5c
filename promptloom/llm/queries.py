"""The registered query of each training-data operator, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat_format, divergence, exact_dedup, lang_id, merkle, packing, quality, segment_bpe, simhash,
               topk_search, toxicity, warc)
from .common import fold, label_split, read_docs

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
#: A conversation whose texts hold control strings of the template.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame(TRICKY, turns.schema))
    path, pattern = vocabulary()
    ready = chat_format.assemble(chat_format.format_turns(turns, path, pattern))
    return chat_format.read_back(ready, path, pattern).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(spark, read_docs(spark, sf_dir, "pages"))
    return out.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    ids = byte_bpe.encode(read_docs(spark, sf_dir).select("doc_id", "text"), path, pattern, keep=["doc_id"])
    back = byte_bpe.decode(ids, path, pattern)
    return back.select("doc_id", F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    model = lang_id.fit(docs, label_split("doc_id", 4) != 2)
    out = lang_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (label_split("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, label_split("_id", 4) != 2)
    out = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (label_split("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, label_split("_id", 5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (label_split("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_docs(spark, sf_dir), words=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of byte tokens: the UTF-8 bytes of a text and one end token (none if it is empty)."""
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return packing.pack(read_docs(spark, sf_dir), F.when(n > 0, n + 1).otherwise(0))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read_docs(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk_search.search(rows, F.col("id") % 20 == 0, 20)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_docs(spark, sf_dir), min_docs=3, top=200)


def op12_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path(TOKENIZER)
    ids = segment_bpe.encode(read_docs(spark, sf_dir).select("doc_id", "text"), path, keep=["doc_id"])
    back = segment_bpe.decode(ids, path)
    return back.select("doc_id", F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and a check of every proof against it with a text changed in a fifth of the rows."""
    docs = read_docs(spark, sf_dir)
    *rest, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    changed = F.when(text.isNotNull(), fold(text))
    tampered = F.when(F.col("doc_id").isNotNull() & (label_split("doc_id", 5) == 0), merkle.leaf_digest([*rest, changed]))
    out = merkle.manifest(docs, merkle.leaf_digest([*rest, text]), carry={"tampered": tampered})
    leaf, subroot, root = (F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root"))
    out = out.select("doc_id", leaf, subroot, root, merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
                     merkle.folded(F.lower(F.hex(F.coalesce("tampered", "leaf"))), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_format, op2_warc, op3_byte_bpe, op4_lang_id, op5_quality, op6_toxicity, op7_simhash, op8_best_fit,
    op9_exact_dedup, op10_topk_search, op11_divergence, op12_segment_bpe, op13_merkle)}

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (
            SELECT *, regexp_replace(text,
                '(<<)(\\*(?:/?SYS>>|/?ROLE>>|/TURN>>))|(\[)(\\*/?INST\])|(<)(\\*/?s>)', '\1\3\5\\\2\4\6', 'g') AS escaped,
                CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                    ELSE 26 + length(role) END AS marks
            FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(escaped) + marks)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
                max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM p)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)),
                'string_agg', '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM d""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        o AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
        g AS (
            SELECT lang, source, coalesce(sum(n), 0) AS total, (SELECT count(*) FROM k WHERE k.lang = x.lang) AS kept
            FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1)::HUGEINT // (total + kept)::HUGEINT AS p
            FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1)::HUGEINT
                // (any_value(kept) + (SELECT sum(total) FROM g WHERE g.lang = c.lang))::HUGEINT AS q
            FROM c JOIN (SELECT DISTINCT lang, kept FROM g) USING (lang) GROUP BY lang, term),
        v AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
            ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM v QUALIFY part = 'pair' OR rank <= 200""",
    "op13_merkle": """
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY i) AS tab FROM (
                SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                    i) AS v FROM range(256) r(i))),
        d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN doc_id IS NOT NULL AND xor(4294967295, list_reduce(
                        list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295)) % 5 = 0
                    THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
            FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
                FROM documents), crc),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY k) AS n FROM d),
        t AS (
            SELECT k, 0 AS lvl, pos, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT k, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1
            GROUP BY k, lvl, n, pos // 16),
        subroots AS (
            SELECT k, digest, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
            SELECT 'top' AS k, 0 AS lvl, pos, n, digest FROM subroots
            UNION ALL
            SELECT k, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1
            GROUP BY k, lvl, n, pos // 16),
        runs AS (
            SELECT k, lvl, pos // 16 AS run, n, list(digest ORDER BY pos) AS l
            FROM (SELECT * FROM t UNION ALL SELECT * FROM u) WHERE n > 1 GROUP BY ALL),
        climb AS (
            SELECT r, CASE WHEN leaves.n = 1 THEN 'top' ELSE leaves.k END AS k, 0 AS lvl,
                CASE WHEN leaves.n = 1 THEN s.pos ELSE leaves.pos END AS pos, s.pos AS tree, coalesce(tampered, leaf) AS x, '' AS proof
            FROM leaves JOIN subroots s ON s.k = leaves.k
            UNION ALL
            SELECT r, CASE WHEN n <= 16 THEN 'top' ELSE k END, CASE WHEN n <= 16 AND k <> 'top' THEN 0 ELSE lvl + 1 END,
                CASE WHEN n <= 16 AND k <> 'top' THEN tree ELSE pos // 16 END, tree,
                sha256(array_to_string(l[:pos % 16], '') || x || array_to_string(l[pos % 16 + 2:], '')),
                proof || array_to_string(l[:pos % 16], '') || array_to_string(l[pos % 16 + 2:], '')
            FROM (SELECT climb.*, runs.n, runs.l FROM climb JOIN runs ON runs.k = climb.k AND runs.lvl = climb.lvl AND runs.run = climb.pos // 16)),
        ends AS (SELECT r, arg_max(x, length(proof)) AS folded_root, max_by(proof, length(proof)) AS proof FROM climb GROUP BY r)
        SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
            folded_root, folded_root = (SELECT digest FROM u WHERE n = 1) AS verified
        FROM leaves JOIN subroots s ON s.k = leaves.k JOIN ends USING (r)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
