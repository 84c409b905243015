"""The registered queries of the operators, over the given ``documents``, and their equal SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from emberlog.llm.bpe import bpe_encode
from emberlog.llm.exact import exact_duplicates
from emberlog.llm.inputs import documents
from emberlog.llm.langid import identify, train
from emberlog.llm.licenses import scan_licenses
from emberlog.llm.merkle import folded, leaf_digest, merkle_manifest, sibling_digests
from emberlog.llm.mixing import mix_sources
from emberlog.llm.negatives import hard_negatives
from emberlog.llm.setjoin import jaccard_components
from emberlog.llm.simhash import simhash_groups
from emberlog.llm.sketch import neighbour_fingerprints
from emberlog.llm.suffixes import remove_repeated_bytes
from emberlog.llm.tokenfiles import read_tokens, write_tokens
from emberlog.llm.windows import remove_repeated_windows
from emberlog.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_round_trip(spark, folder):
    decoded = bpe_encode(documents(spark, folder), VOCABULARY, decoded="decoded")
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark, folder):
    return exact_duplicates(documents(spark, folder), keep="largest")


def op3_simhash_near_dedup(spark, folder):
    return simhash_groups(documents(spark, folder), words=3, max_bits=2)


def op4_language_id(spark, folder):
    docs = documents(spark, folder)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    filters = train(docs.filter(~held_out))
    return identify(docs, filters, keep=held_out).withColumnRenamed("keep", "held_out")


def op5_document_fingerprints(spark, folder):
    return neighbour_fingerprints(documents(spark, folder))


def op6_license_scan(spark, folder):
    return scan_licenses(documents(spark, folder))


def op7_suffix_dedup(spark, folder):
    return remove_repeated_bytes(documents(spark, folder), size=200).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark, folder):
    made = scratch_path(spark, "tokens")
    write_tokens(documents(spark, folder), made, VOCABULARY, end_id=0)
    return read_tokens(spark, made).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_substring_dedup(spark, folder):
    return remove_repeated_windows(documents(spark, folder), size=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def five_two_one(names: list) -> list[float]:
    """Weights by code point order of the sources: 5, 2, 1, repeating."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]


def op10_mixture(spark, folder):
    mix, taken = mix_sources(documents(spark, folder), five_two_one)
    sources = spark.createDataFrame(mix.sources or [], "source string, source_size long, target double")
    source = taken.withColumn("source", F.element_at("sources", 1))
    joined = source.join(F.broadcast(sources), source["source"].eqNullSafe(sources["source"]))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(F.lit(256) * x.cast("double"))))
    return hard_negatives(given, "vec_id", label, whole, F.col("vec_id") % 50 == 0)


def op12_ngram_jaccard_join(spark, folder):
    return jaccard_components(documents(spark, folder), words=5, similarity=0.8)


def op13_merkle_manifest(spark, folder):
    docs = documents(spark, folder)

    def leaf(n_chars):
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    carry = {"doc_id": F.col("doc_id"), "changed": F.when(tampered, leaf(F.col("n_chars") + 1)).otherwise(leaf(F.col("n_chars")))}
    made = merkle_manifest(docs, leaf(F.col("n_chars")), F.col("lang"), F.col("doc_id"), carry)
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(sibling_digests(F.col("proof")), 256).alias("proof_sha256"), folded(F.col("changed"), F.col("proof")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_exact_dedup, op3_simhash_near_dedup, op4_language_id, op5_document_fingerprints, op6_license_scan, op7_suffix_dedup, op8_token_files, op9_substring_dedup, op10_mixture, op11_hard_negatives, op12_ngram_jaccard_join, op13_merkle_manifest)}

_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

ORACLES = {
    # crc32 has no DuckDB function: eight shifts a byte of the identifier's digits.
    "op13_merkle_manifest": f"""WITH RECURSIVE crc AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::UBIGINT AS c FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT doc_id, s, i + 1, list_reduce(list_concat([xor(c, ord(substr(s, i + 1, 1))::UBIGINT)], [0::UBIGINT FOR k IN range(8)]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) FROM crc WHERE i < length(s)),
 odd AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295::UBIGINT) % 7 = 0),
 leaves AS (SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM odd) THEN {_LEAF.format(n_chars="(n_chars + 1)")} ELSE {_LEAF.format(n_chars="n_chars")} END AS changed FROM documents),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
 tree AS (SELECT lang, 0 AS k, i, n, leaf AS h FROM placed
 UNION ALL SELECT lang, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, k, i // 2, n),
 subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
 top AS (SELECT 0 AS k, i, n, subroot AS h FROM subroots
 UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 2, n),
 top_path AS (SELECT s.lang, string_agg(coalesce(b.h, ''), '' ORDER BY a.k) AS p, list({{'left': s.i >> a.k & 1, 'h': coalesce(b.h, '')}} ORDER BY a.k) AS steps
 FROM subroots s JOIN top a ON a.i = s.i >> a.k AND a.n > 1 LEFT JOIN top b ON b.k = a.k AND b.i = xor(a.i, 1) GROUP BY s.lang),
 own_path AS (SELECT p.lang, p.i, string_agg(coalesce(b.h, ''), '' ORDER BY a.k) AS p, list({{'left': p.i >> a.k & 1, 'h': coalesce(b.h, '')}} ORDER BY a.k) AS steps
 FROM placed p JOIN tree a ON a.lang IS NOT DISTINCT FROM p.lang AND a.i = p.i >> a.k AND a.n > 1
 LEFT JOIN tree b ON b.lang IS NOT DISTINCT FROM p.lang AND b.k = a.k AND b.i = xor(a.i, 1) GROUP BY p.lang, p.i),
 proven AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(o.p, '') || coalesce(t.p, '') AS p, p.changed,
 list_concat(coalesce(o.steps, []), coalesce(t.steps, [])) AS steps
 FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN own_path o ON o.lang IS NOT DISTINCT FROM p.lang AND o.i = p.i LEFT JOIN top_path t ON t.lang IS NOT DISTINCT FROM p.lang),
 climbed AS (SELECT *, list_reduce(list_concat([{{'left': 0, 'h': changed}}], steps), lambda a, x: {{'left': 0, 'h': CASE WHEN x.left = 1 THEN sha256(x.h || a.h) ELSE sha256(a.h || x.h) END}}).h AS folded_root FROM proven)
 SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, folded_root, folded_root = root AS verified FROM climbed""",
    "op9_substring_dedup": r"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS words FROM documents),
 places AS (SELECT rid, unnest(range(1, greatest(len(words) - 33, 1))) AS i FROM d),
 windows AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS gram FROM places JOIN d USING (rid)),
 again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY gram) AS n FROM windows) WHERE n > 1),
 gone AS (SELECT rid, list(DISTINCT j) AS js FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM again) GROUP BY rid),
 kept AS (SELECT doc_id, len(words) AS n, CASE WHEN js IS NULL THEN words ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(js, j)] END AS k FROM d LEFT JOIN gone USING (rid))
 SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
 SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3""",
    "op12_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS words FROM documents),
 s AS (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS g FROM w),
 n AS (SELECT w.rid, w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (rid) GROUP BY w.rid, w.doc_id),
 links AS (SELECT a.rid AS u, b.rid AS v FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
 GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
 reached AS (SELECT rid AS u, rid AS v FROM n UNION SELECT reached.u, links.v FROM reached JOIN links ON links.u = reached.v)
 SELECT n.doc_id, any_value(n.n) AS n_shingles, min(m.doc_id) AS component_id FROM n JOIN reached ON reached.u = n.rid JOIN n m ON m.rid = reached.v GROUP BY n.rid, n.doc_id""",
    "op2_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
 FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
