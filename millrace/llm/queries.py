"""The queries of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, flac, language_id, merkle, mixing, packing, secret_scan, simhash_dedup, sstable, substring_dedup, token_counts, vector_codes
from .common import table, written


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text; null and empty texts have none, repeated rows each have their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"), limit=4096).drop("text")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in token shards, read back; null and empty texts are the end id alone."""
    docs = table(spark, sf_dir, "documents")
    return sstable.read_shards(sstable.encode_to_shards(docs, tokenizer("byte_bpe_50k.json"), end_id=0))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as FLAC media, stored, read back and decoded; null texts are empty ones, of 64 zero bytes, and equal texts give equal rows."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    stored = written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), flac.text_to_flac(text).alias("media")), "media", **flac.STORED)
    return stored.select("doc_id", "n_bytes", flac.media_features(F.col("media")).alias("f")).select("doc_id", "n_bytes", "f.*")


def language_model(docs: DataFrame) -> language_id.Model:
    """The model that op3 and the pipeline use: learned from the documents that are not held out."""
    return language_id.fit(docs.where(~language_id.held_out()), tokenizer("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text by a model of the documents that are not held out; texts without letters are und with score 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item, with the item and the similarity; null and empty texts hold none."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates for secrets in all texts, with the forest's score and verdict; null and empty texts have none."""
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents"), forest)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of 13 words of earlier documents cover; null texts have no words."""
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component that it is linked into; texts without a word have fingerprint zero."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), radius=4)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and copies of every document, by source, language and topic; documents without tokens get none."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe, formatted and read back; null texts are empty ones."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.render(chat.fold(chat.messages_as_events(rows))))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens: one row a piece, null and empty texts as the end id alone."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024, with_ids=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root that its (for about half: tampered) leaf folds into."""
    docs = table(spark, sf_dir, "documents")
    return merkle.verify(docs, leaf=merkle.document_leaf(), other=merkle.tampered_leaf())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product codes of all vectors with finite components only."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


OP10_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', ''))
    + length(role) + 17 + CASE WHEN role = 'assistant' THEN 17 ELSE 0 END AS shown
  FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


#: The crc32 of a text by its definition, bit by bit; the levels of all trees by one recursion, then proofs and folds.
OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)) AS b FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS crc FROM bytes
), parts AS (
  SELECT d.doc_id, d.source, d.text, c.crc % 2 = 0 AS chosen,
    concat(coalesce(concat(strlen(CAST(d.doc_id AS VARCHAR)), ':', d.doc_id), '-'), coalesce(concat(strlen(d.source), ':', d.source), '-'),
      coalesce(concat(strlen(d.lang), ':', d.lang), '-'), coalesce(concat(strlen(CAST(d.n_chars AS VARCHAR)), ':', d.n_chars), '-')) AS head
  FROM documents d LEFT JOIN crc c ON c.doc_id = d.doc_id
), leaves AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(head, CASE WHEN chosen THEN coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-') ELSE coalesce(concat(strlen(text), ':', text), '-') END)) AS given
  FROM parts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), low AS (
  SELECT 0 AS level, source, place, leaf AS hash, n FROM placed
  UNION ALL
  SELECT level + 1, source, place // 3, sha256(string_agg(hash, '' ORDER BY place)), CAST(ceil(n / 3) AS BIGINT) FROM low WHERE n > 1 GROUP BY level, source, place // 3, n
), subroots AS (
  SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), top AS (
  SELECT 0 AS level, place, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), CAST(ceil(n / 3) AS BIGINT) FROM top WHERE n > 1 GROUP BY level, place // 3, n
), low_beside AS (
  SELECT a.level, a.source, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM low a JOIN low b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY a.level, a.source, a.place
), top_beside AS (
  SELECT a.level, a.place, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY a.level, a.place
), up AS (
  SELECT p.doc_id, p.leaf, p.source, 0 AS level, p.place, '' AS proof, p.given AS folded FROM placed p
  UNION ALL
  SELECT u.doc_id, u.leaf, u.source, u.level + 1, u.place // 3, concat(u.proof, b.l, b.r), sha256(concat(b.l, u.folded, b.r))
  FROM up u JOIN low_beside b ON b.level = u.level AND b.source IS NOT DISTINCT FROM u.source AND b.place = u.place
), arrived AS (
  SELECT u.doc_id, u.leaf, s.hash AS subroot, s.place, u.proof, u.folded FROM up u JOIN subroots s ON u.source IS NOT DISTINCT FROM s.source
  JOIN (SELECT source, max(level) AS last FROM low GROUP BY source) m ON m.source IS NOT DISTINCT FROM u.source AND m.last = u.level
), on_top AS (
  SELECT doc_id, leaf, subroot, 0 AS level, place, proof, folded FROM arrived
  UNION ALL
  SELECT o.doc_id, o.leaf, o.subroot, o.level + 1, o.place // 3, concat(o.proof, b.l, b.r), sha256(concat(b.l, o.folded, b.r))
  FROM on_top o JOIN top_beside b ON b.level = o.level AND b.place = o.place
), root AS (SELECT level, hash FROM top WHERE n = 1)
SELECT o.doc_id, o.leaf, o.subroot, r.hash AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.hash AS verified
FROM on_top o JOIN root r ON r.level = o.level
"""


def op13_sql(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other; p has a part's components, c a codebook entry's."""

    def assign(books: str) -> str:
        return f"""SELECT vec_id, label, part, entry, p, d FROM (
            SELECT v.*, b.entry, list_sum(list_transform(list_zip(v.p, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
              row_number() OVER (PARTITION BY v.vec_id, v.part ORDER BY d, b.entry) AS k FROM parts v JOIN {books} b ON b.part = v.part) WHERE k = 1"""

    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS ({assign(f'b{k - 1}')})")
        steps.append(f"""m{k} AS (SELECT part, entry, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM a{k}) GROUP BY part, entry, j)""")
        steps.append(f"""b{k} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k - 1} b LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS c FROM m{k} GROUP BY part, entry) n USING (part, entry))""")
    steps.append(f"last AS ({assign(f'b{rounds}')})")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS p FROM kept, (SELECT unnest(range(8)) AS part)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
), {", ".join(steps)},
told AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM told
"""


def queries() -> dict:
    return {
        "op1_token_shards": op1_token_shards,
        "op2_flac_media": op2_flac_media,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_decontamination": op5_decontamination,
        "op6_secret_scan": op6_secret_scan,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_source_mixing": op9_source_mixing,
        "op10_chat_format": op10_chat_format,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_vector_codes": op13_sql()}
