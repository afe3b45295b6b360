"""One query per corpus operator over its whole table, and DuckDB SQL where SQL can say it."""

import os

from pyspark.sql import functions as F

from depweave.llm import class_model, langid, manifest, mixture, ngram_join, packing, personal, pieces, prefix_trie, quality, repeats, syncmers, topk
from depweave.llm.common import fold, table


# The vocabulary files lie outside the repository.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_VOCABULARY = os.environ.get("BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


def op1_pivot_search(spark, sf_dir):
    """The 20 highest inner products of every twentieth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0)


def op2_quality(spark, sf_dir):
    """Quality score of every document, learned from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    return quality.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"),
    )


def op3_syncmers(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return syncmers.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_class_model(spark, sf_dir):
    """Log probability of every document under a class bigram model of six folds of seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = class_model.ClassLanguageModel(docs.where(fold("doc_id", 7) != 2).select("text"))
    held_out = (fold("doc_id", 7) == 2).alias("held_out")
    return model.score(docs).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark, sf_dir):
    """Words that a mix of all documents by source weights 1, 2, 3 takes from each document."""
    return mixture.Mix(table(spark, sf_dir, "documents")).taken()


def op6_personal(spark, sf_dir):
    """Base and added personal data spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal.find(docs, personal.learn(docs))


def op7_repeats(spark, sf_dir):
    """Words of every document that repeat a window of 50 words of an earlier document."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_pieces(spark, sf_dir):
    """The four best segmentations of every document into pieces, decoded again."""
    return pieces.round_trips(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_ngram_join(spark, sf_dir):
    """Groups of documents linked by 85 per cent Jaccard similarity of their four-word shingles."""
    return ngram_join.NgramJoin(table(spark, sf_dir, "documents")).grouped()


def op10_language_id(spark, sf_dir):
    """Language of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.LanguageModel.fit(docs.where(fold("doc_id", 5) != 0).select("lang", "text"))
    return langid.identify(docs, model, keep=("doc_id",)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "languages", "shares"
    )


def op11_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op12_manifest(spark, sf_dir):
    """Digest of every document, its proof, and whether the tree still has its root once line breaks are removed."""
    return manifest.Manifest(manifest.line_breaks_removed(table(spark, sf_dir, "documents"))).verify()


def op13_prefix_trie(spark, sf_dir):
    """Every distinct prefix of the rebuilt conversations."""
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return prefix_trie.trie_of(table(spark, sf_dir, "conversations")).nodes().select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


QUERIES = {
    "op1_pivot_search": op1_pivot_search,
    "op2_quality": op2_quality,
    "op3_syncmers": op3_syncmers,
    "op4_class_model": op4_class_model,
    "op5_mixing": op5_mixing,
    "op6_personal": op6_personal,
    "op7_repeats": op7_repeats,
    "op8_pieces": op8_pieces,
    "op9_ngram_join": op9_ngram_join,
    "op10_language_id": op10_language_id,
    "op11_packing": op11_packing,
    "op12_manifest": op12_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

# crc32 of the decimal digits of an id, a bit at a time.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""


ORACLES = {
    "op1_pivot_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_repeats": """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), words AS (
  SELECT row_no, coalesce(doc_id, 9223372036854775807) AS key, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), sequences AS (
  SELECT *, CASE WHEN pos + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS seq
  FROM words
), firsts AS (
  SELECT seq, min(key) AS first FROM sequences WHERE seq IS NOT NULL GROUP BY seq
), judged AS (
  SELECT row_no, pos, word, coalesce(bool_or(key > first) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM sequences LEFT JOIN firsts USING (seq)
), kept AS (
  SELECT row_no, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_no)
""",
    "op9_ngram_join": """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), words AS (
  SELECT row_no, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), grams AS (
  SELECT row_no, n, pos, string_agg(word, ' ') OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS gram FROM words
), shingles AS MATERIALIZED (
  SELECT DISTINCT row_no, gram FROM grams WHERE pos + 3 <= n OR pos = 1
), sizes AS MATERIALIZED (
  SELECT row_no, count(*) AS n_shingles FROM shingles GROUP BY row_no
), shared AS (
  SELECT a.row_no AS x, b.row_no AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.row_no < b.row_no GROUP BY ALL
), links AS MATERIALIZED (
  SELECT unnest([x, y]) AS x, unnest([y, x]) AS y
  FROM shared s JOIN sizes a ON a.row_no = s.x JOIN sizes b ON b.row_no = s.y
  WHERE 100 * n >= 85 * (a.n_shingles + b.n_shingles - n)
), reached AS (
  SELECT row_no, row_no AS met FROM d
  UNION
  SELECT r.row_no, l.y FROM reached r JOIN links l ON l.x = r.met
), components AS (
  SELECT r.row_no, min(m.doc_id) AS component_id FROM reached r JOIN d m ON m.row_no = r.met GROUP BY r.row_no
)
SELECT doc_id, CAST(coalesce(n_shingles, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN components USING (row_no) LEFT JOIN sizes USING (row_no)
""",
    "op12_manifest": """
WITH RECURSIVE parts AS (
  SELECT doc_id, source, text, replace(text, chr(10), '') AS cut,
    concat_ws('', """
    + ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    + """) AS front, """
    + CRC32.format("doc_id")
    + """ AS crc
  FROM documents
), l AS (
  SELECT doc_id, source, leaf, CASE WHEN crc % 2 = 0 THEN sha256(front || coalesce(strlen(cut) || ':' || cut, '-')) ELSE leaf END AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM (SELECT *, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM parts)
), nodes AS (
  SELECT 0 AS lv, source, idx, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT lv + 1, source, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY lv, source, idx // 3
), sub AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS slot FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lv, slot AS idx, subroot AS d, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lv + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + 2) // 3) FROM tops WHERE n > 1 GROUP BY lv, idx // 3
), above AS (
  SELECT source, idx AS leaf_idx, lv, idx AS slot FROM nodes WHERE lv = 0 AND n > 1
  UNION ALL
  SELECT a.source, leaf_idx, a.lv + 1, slot // 3 FROM above a JOIN nodes m ON m.lv = a.lv + 1 AND m.source IS NOT DISTINCT FROM a.source AND m.idx = a.slot // 3 AND m.n > 1
), outside AS (
  SELECT source, lv, slot FROM sub JOIN tops ON lv = 0 AND idx = slot AND n > 1
  UNION ALL
  SELECT o.source, o.lv + 1, slot // 3 FROM outside o JOIN tops t ON t.lv = o.lv + 1 AND t.idx = o.slot // 3 AND t.n > 1
), steps AS (
  SELECT a.source, leaf_idx, a.lv AS step, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx < slot), '') AS lft, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx > slot), '') AS rgt
  FROM above a JOIN nodes m ON m.lv = a.lv AND m.source IS NOT DISTINCT FROM a.source AND m.idx // 3 = slot // 3 GROUP BY ALL
), top_steps AS (
  SELECT source, o.lv AS step, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx < slot), '') AS lft, coalesce(string_agg(d, '' ORDER BY idx) FILTER (idx > slot), '') AS rgt
  FROM outside o JOIN tops t ON t.lv = o.lv AND t.idx // 3 = slot // 3 GROUP BY ALL
), paths AS (
  SELECT source, idx, list(s ORDER BY step) AS p FROM (
    SELECT l.source, l.idx, s.step, {'l': lft, 'r': rgt} AS s FROM l JOIN steps s ON s.source IS NOT DISTINCT FROM l.source AND s.leaf_idx = l.idx
    UNION ALL
    SELECT l.source, l.idx, 1000 + s.step, {'l': lft, 'r': rgt} FROM l JOIN top_steps s ON s.source IS NOT DISTINCT FROM l.source
  ) GROUP BY source, idx
), folded AS (
  SELECT l.*, subroot, coalesce(p, []) AS p, list_reduce(list_prepend({'l': now, 'r': ''}, coalesce(p, [])), lambda x, y: {'l': sha256(y.l || x.l || y.r), 'r': ''}).l AS folded_root
  FROM l JOIN sub ON sub.source IS NOT DISTINCT FROM l.source LEFT JOIN paths ON paths.source IS NOT DISTINCT FROM l.source AND paths.idx = l.idx
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded, (SELECT d AS root FROM tops WHERE n = 1)
""",
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, """
    + CRC32.format("conv_id")
    + """ % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos > h
), paths AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY own, pos) AS p FROM rebuilt GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(p, []) AS p FROM convs LEFT JOIN paths USING (conv_id)
), members AS (
  SELECT conv_id, CAST(d AS BIGINT) AS depth, len(p) AS length, p[:d] AS prefix FROM whole, LATERAL (SELECT unnest(range(len(p) + 1)) AS d)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
  FROM members GROUP BY depth, prefix
), counted AS (
  SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.prefix = n.prefix[:n.depth - 1]
  LEFT JOIN (SELECT depth - 1 AS depth, prefix[:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) k ON k.depth = n.depth AND k.prefix = n.prefix
)
SELECT a.conv_id, a.depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
  CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM counted a JOIN counted b ON b.depth >= a.depth AND b.prefix[:a.depth] = a.prefix
GROUP BY a.conv_id, a.depth
""",
}
