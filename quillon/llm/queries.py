"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.llm import embedding_dedup, language_id, masked_lm, media, minhash_dedup, mixing, packing, pii, secret_scan, sharding
from quillon.session import table


def joined_spans(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def span_digest(found, base: tuple[str, ...]) -> list:
    """The contract's columns for spans in their order: counts of base kinds, digest, all spans and their number."""
    of = lambda kinds: F.filter(found, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of((kind,))).cast("long").alias(f"n_{kind}") for kind in base]
    return [*counts, F.sha2(joined_spans(of(base)), 256).alias("base_sha256"), joined_spans(found).alias("spans"), F.size(found).cast("long").alias("n_spans")]


def op1_pack_along_curve(spark, sf_dir):
    """Sequences of at most 1024 ids along the curve, as pieces of documents."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secret_scan(spark, sf_dir):
    """Secrets in every whole text."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *span_digest(F.col("found"), ("assign", "access", "hex")))


def op3_mix_sources(spark, sf_dir):
    """Mixed words of each document under capped water-filling."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op4_private_spans(spark, sf_dir):
    """Personal data in every whole text."""
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *span_digest(F.col("found"), pii.KINDS))


def op5_shard_documents(spark, sf_dir):
    """Sixteen contiguous shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op6_language_id(spark, sf_dir):
    """The language of every whole text, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    named = language_id.classify(docs, language_id.learn(docs))
    return named.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_embedding_dedup(spark, sf_dir):
    """Links of at least 0.98 between vectors of one label, and their components."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"), 0.98)


def op8_media_columns(spark, sf_dir):
    """Each text as an ISO media file, read back by its boxes."""
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op9_masked_scores(spark, sf_dir):
    """Pseudo-log-likelihood of every whole text under a network trained on the corpus."""
    return masked_lm.score_words(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark, sf_dir):
    """Documents that share 85 of 100 word shingles, directly or through others."""
    return minhash_dedup.link(table(spark, sf_dir, "documents"), 85, 5)


QUERIES = {f.__name__: f for f in (op1_pack_along_curve, op2_secret_scan, op3_mix_sources, op4_private_spans, op5_shard_documents, op6_language_id, op7_embedding_dedup, op8_media_columns, op9_masked_scores, op10_minhash_dedup)}

#: Words as runs of anything but space and tab to carriage return.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

#: The mixing by the same steps: water-filling over sources ordered by cap over weight, bins of the
#: seeded hash, three passes over the bin that the fraction ends in, and the nearest document.
_OP3 = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS.format(text="text")}) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17:' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS draw
  FROM documents),
bits AS (SELECT CASE WHEN count(*) < 5000 THEN 0 ELSE CAST(floor(log2(count(*) // 5000)) AS INTEGER) + 1 END AS bits FROM sized),
placed AS (SELECT sized.*, draw >> (52 - bits) AS bin FROM sized, bits),
held AS (SELECT source, bin, sum(size)::BIGINT AS bin_size FROM placed GROUP BY source, bin),
sources AS (SELECT source, sum(bin_size)::BIGINT AS source_size FROM held GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
filled AS (SELECT *,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed),
levelled AS (SELECT *, max(CASE WHEN own_level * weight <= cap THEN own_level END) OVER () AS level FROM filled),
aimed AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM levelled),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aimed),
cut AS (
  SELECT held.source, bin, source_size, target, whole, target - whole * source_size AS rest, bin_size,
    coalesce(sum(bin_size) OVER (PARTITION BY held.source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bin_before
  FROM held JOIN goal ON held.source IS NOT DISTINCT FROM goal.source),
rows AS (
  SELECT doc_id, p.source, p.bin, size, draw, source_size, target, whole, (rest - bin_before)::DOUBLE AS short0,
    CASE WHEN bin_before + bin_size <= rest THEN 1 WHEN bin_before >= rest THEN 0 ELSE 2 END AS state
  FROM placed p JOIN cut ON p.source IS NOT DISTINCT FROM cut.source AND p.bin = cut.bin),
up1 AS (SELECT *, CASE WHEN size <= short0 THEN sum(CASE WHEN size <= short0 THEN size END) OVER drawn END AS up FROM rows WHERE state = 2 WINDOW drawn AS (PARTITION BY source, bin ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
pass1 AS (SELECT * EXCLUDE (up), coalesce(up <= short0, false) AS fits1, short0 - coalesce(max(CASE WHEN up <= short0 THEN up END) OVER (PARTITION BY source, bin), 0) AS short1 FROM up1),
up2 AS (SELECT *, CASE WHEN NOT fits1 AND size <= short1 THEN sum(CASE WHEN NOT fits1 AND size <= short1 THEN size END) OVER drawn END AS up FROM pass1 WINDOW drawn AS (PARTITION BY source, bin ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
pass2 AS (SELECT * EXCLUDE (up), fits1 OR coalesce(up <= short1, false) AS fits2, short1 - coalesce(max(CASE WHEN up <= short1 THEN up END) OVER (PARTITION BY source, bin), 0) AS short2 FROM up2),
up3 AS (SELECT *, CASE WHEN NOT fits2 AND size <= short2 THEN sum(CASE WHEN NOT fits2 AND size <= short2 THEN size END) OVER drawn END AS up FROM pass2 WINDOW drawn AS (PARTITION BY source, bin ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
pass3 AS (SELECT * EXCLUDE (up), fits2 OR coalesce(up <= short2, false) AS fits, short2 - coalesce(max(CASE WHEN up <= short2 THEN up END) OVER (PARTITION BY source, bin), 0) AS short FROM up3),
topped AS (SELECT *, NOT fits AND abs(size - short) < short AND row_number() OVER (PARTITION BY source, bin ORDER BY fits, abs(size - short), draw, doc_id NULLS FIRST, size) = 1 AS top FROM pass3),
every AS (
  SELECT doc_id, size, source_size, target, whole + state AS repeats FROM rows WHERE state < 2
  UNION ALL SELECT doc_id, size, source_size, target, whole + CASE WHEN fits OR top THEN 1 ELSE 0 END FROM topped)
SELECT doc_id, size, source_size, target, size * repeats AS taken, CASE WHEN size > 0 THEN repeats ELSE 0 END::BIGINT AS repeats FROM every"""

#: The table of CRC-32 from its polynomial, and the checksum as a fold over a text's bytes.
_CRC = """bits(i, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""
_OP5 = f"""
WITH RECURSIVE {_CRC},
raw AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents),
sized AS (SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM raw, crc),
laid AS (
  SELECT *, row_number() OVER o - 1 AS place, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
cut AS (SELECT *, least(15, ((before * 2 + size) * 16) // (2 * total))::INTEGER AS shard FROM laid)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""

_OP7 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT n, b FROM reach JOIN links ON m = a),
least_of AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_of ON n = vec_id LEFT JOIN many ON a = vec_id"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OP10 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=f"translate(text, '{_LETTERS}', '{_LETTERS.lower()}')")} AS w FROM documents),
sets AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
reach(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT n, b FROM reach JOIN links ON m = a),
least_of AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of l ON l.n = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""

#: Networks, trees, token ids and encoded payloads are beyond SQL: op1, op2, op4, op6, op8 and op9 have none.
ORACLES: dict[str, str] = {"op3_mix_sources": _OP3, "op5_shard_documents": _OP5, "op7_embedding_dedup": _OP7, "op10_minhash_dedup": _OP10}
