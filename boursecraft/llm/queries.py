"""The registered queries: each applies one operator to a whole table and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from boursecraft.llm import bpe, chat, embeddings, exact_dedup, merkle, near_dedup, packing, prefix_trie, secret_scan, simple8b, token_counts, toxicity, warc
from boursecraft.llm.registry import query, table


@query(
    "op3_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"), keep="largest")


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packing.pack(parts, capacity=2048).withColumnRenamed("id", "doc_id")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    both = F.array_sort(F.concat("base", "markov"))
    return found.select(
        "doc_id",
        *[secret_scan.counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.size("markov").cast("long").alias("n_markov"),
        F.sha2(secret_scan.described(F.col("base")), 256).alias("base_sha256"),
        secret_scan.described(both).alias("spans"),
    )


def held_out(doc_id: str = "doc_id"):
    """The fifth of the documents whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(~held_out()))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "words")


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op10_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    fine AS (
        SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
    link AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
    SELECT vec_id, (SELECT count(*) FROM link WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = vec_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (
        SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
               array_to_string(list_transform(string_split(sha1(html), ''), lambda h: lpad(bin(strpos('0123456789abcdef', h) - 1), 4, '0')), '') AS bits
        FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS BIGINT) * CAST(pow(2, 4 - j) AS BIGINT))) AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
    FROM d
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder, revisit_from=0)
    found = warc.read(spark, folder)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_SAYS = "</s>[INST] ok [/INST]"


@query(
    "op4_chat_format",
    f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{_SAYS}'), (-1, 1, 'assistant', '{_SAYS}')),
    c AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
               coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
               CAST(sum(length(text) + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 13 ELSE 6 END
                   + len(regexp_extract_all(text, '<s>|</s>|\\[/?INST\\]|\\[/?SYS\\]|\\[TURN:[^\\]\\s]*\\]|\\[/TURN\\]'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _SAYS), (-1, 1, "assistant", _SAYS)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def _crc32(value: str) -> str:
    """SQL for the unsigned CRC-32 of a number's decimal text, bit by bit."""
    letters = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([4294967295] || {letters}, {step}), 4294967295)"


@query(
    "op11_prefix_trie",
    f"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {_crc32('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    head AS (SELECT c.conv_id, pos AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE pos <= h),
    own AS (
        SELECT conv_id, pos - h + coalesce(n, 0) AS d, role, text FROM c JOIN t USING (conv_id)
        LEFT JOIN (SELECT conv_id, count(*) AS n FROM head GROUP BY conv_id) USING (conv_id) WHERE pos > h),
    r AS (FROM head UNION ALL FROM own UNION ALL SELECT conv_id, 0, '', '' FROM c),
    k AS (
        SELECT conv_id, d, length(text) AS chars, max(d) OVER (PARTITION BY conv_id) AS len,
               d || ':' || sha256(string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key
        FROM r),
    node AS (
        SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own_saved,
               coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len), '') AS ends
        FROM k GROUP BY key, d),
    up AS (SELECT node.key, p.key AS parent FROM node JOIN k AS p ON p.conv_id = node.conv_id AND p.d = node.depth - 1),
    kids AS (SELECT parent AS key, count(*) AS n FROM up GROUP BY parent),
    total AS (
        SELECT a.key, sum(own_saved) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
        FROM node LEFT JOIN kids USING (key) JOIN k AS a ON a.conv_id = node.conv_id AND a.d <= node.depth GROUP BY a.key)
    SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, total.leaves AS n_leaves,
           CAST(total.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
    FROM node JOIN total USING (key) LEFT JOIN kids USING (key) LEFT JOIN up USING (key) LEFT JOIN node AS p ON p.key = up.parent
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.build(prefix_trie.rebuild(seqs))


@query("op12_simple8b_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = simple8b.new_folder(spark)
    simple8b.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return simple8b.read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


_ENCODED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))


def _tree_sql(name: str, start: str) -> str:
    """CTEs ``name`` (nodes of all levels) and ``name_beside`` (siblings of each) over (tree, pos, digest, total)."""
    return f"""
    {name} AS (
        SELECT tree, 0 AS level, pos, digest, total FROM {start}
        UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (max(total) + 7) // 8 FROM {name} WHERE total > 1 GROUP BY tree, level, pos // 8),
    {name}_beside AS (
        SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
               coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
        FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.total > 1 GROUP BY a.tree, a.level, a.pos)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    """CTE ``name``: proofs and folded digests, a level at a time; the last level of a row is its result."""
    return f"""
    {name} AS (
        SELECT rid, tree, 0 AS level, pos, proof, folded FROM {start}
        UNION ALL SELECT w.rid, w.tree, w.level + 1, w.pos // 8, w.proof || b.l || b.r, sha256(b.l || w.folded || b.r)
        FROM {name} w JOIN {tree}_beside b ON b.tree = w.tree AND b.level = w.level AND b.pos = w.pos)"""


@query(
    "op13_merkle",
    f"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {_ENCODED} AS head, text,
               CASE WHEN {_crc32('doc_id')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS said
        FROM documents),
    e AS (
        SELECT rid, doc_id, tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
               sha256(head || CASE WHEN said IS NULL THEN '-' ELSE octet_length(encode(said)) || ':' || said END) AS claimed
        FROM d),
    leaves AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM e),
    {_tree_sql('inner_tree', 'leaves')},
    subroots AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM inner_tree WHERE total = 1),
    {_tree_sql('outer_tree', 'subroots')},
    begin1 AS (SELECT rid, tree, pos, '' AS proof, claimed AS folded FROM leaves),
    {_walk_sql('walk1', 'inner_tree', 'begin1')},
    begin2 AS (
        SELECT w.rid, '' AS tree, s.pos, w.proof, w.folded FROM walk1 w JOIN subroots s ON s.name = w.tree
        WHERE w.level = (SELECT max(level) FROM inner_tree i WHERE i.tree = w.tree)),
    {_walk_sql('walk2', 'outer_tree', 'begin2')}
    SELECT doc_id, leaf, s.digest AS subroot, o.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = o.digest AS verified
    FROM leaves JOIN walk2 USING (rid) JOIN subroots s ON s.name = leaves.tree, (SELECT digest FROM outer_tree WHERE total = 1) o
    WHERE walk2.level = (SELECT max(level) FROM outer_tree)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))
    leaves = merkle.manifest(table(spark, sf_dir, "documents"), fields, tree_col="lang", key_col="doc_id", claimed={"text": tampered})
    return merkle.prove(leaves, key_col="doc_id").drop("tree", "position")
