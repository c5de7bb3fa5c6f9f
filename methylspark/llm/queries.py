"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversations, decontam, exactdedup, langid, licenses, merkle, minhash, mixing, preference, sharding, simhash, tokencount, warc
from .common import scratch_path, staged, table

SHARDS = [f"shard-{i:02d}" for i in range(64)]
SLOTS = 8209


def op1_warc(spark, sf_dir):
    """All ``pages`` written as archives and read back; null html is empty, null ids are last among copies. See ``warc``."""
    read = warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), lambda x: staged(x, "warc-index"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark, sf_dir):
    """``documents`` repeated by their sources' rates; a null source is one, null texts count nothing. See ``mixing``."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, seed=7, temperature=0.5, epochs=1.0)


def op3_sharding(spark, sf_dir):
    """``documents`` with slot and shard; null ids share one. See ``sharding``."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS, ("doc_id",), SLOTS)


def op4_decontamination(spark, sf_dir):
    """A row for each document and benchmark item that it holds; null and empty ones hold nothing. See ``decontam``."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_preference(spark, sf_dir):
    """A row for each pair of ``conversations`` 2n and 2n + 1, masks as text; turns without an id are one side of the null pair. See ``preference``."""
    pairs = preference.preference_pairs(preference.neighbours(table(spark, sf_dir, "conversations")))
    text = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias(m)
    return pairs.select("pair_id", "piece", "prompt", "chosen", text("chosen_mask"), "rejected", text("rejected_mask"))


def op6_token_counts(spark, sf_dir):
    """Tokens of every row of ``documents`` before and after redaction; null texts have none. See ``tokencount``."""
    docs = table(spark, sf_dir, "documents")
    trees = staged(tokencount.build_trees(docs), "token-trees")
    edits = staged(tokencount.find_redactions(docs), "redactions")
    edited = tokencount.apply_edits(docs, trees, edits).select("doc_id", "version", "n_edits", "n_tokens_after", "n_anew")
    return tokencount.count_with_edits(docs, trees, edited)


def op7_language_id(spark, sf_dir):
    """Languages of all ``documents``, learnt from those not held out; texts without a letter are ``und``. See ``langid``."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op8_exact_dedup(spark, sf_dir):
    """Groups of equal ``documents``, a row for each; null texts are empty. See ``exactdedup``."""
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    """Fingerprints and components of ``documents``, a row for each; null texts have fingerprint zero. See ``simhash``."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    """What is found in each of ``documents``; null texts are empty. See ``licenses``."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_minhash(spark, sf_dir):
    """Near copies among ``documents`` at five words and 0.85, a row for each; null texts are linked with nothing. See ``minhash``."""
    return minhash.minhash_groups(table(spark, sf_dir, "documents"), n=5, percent=85)


def op12_conversation_repair(spark, sf_dir):
    """``conversations`` with faults planted, repaired, a row for each; rows of a null id are one. See ``conversations``."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.audit_conversations(conversations.damage(rows), rows)


def op13_merkle_manifest(spark, sf_dir):
    """Every row of ``documents`` as a leaf, with its proof, and what it folds to where line ends have been deleted; null ids are never tampered with. See ``merkle``."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_mixing, op3_sharding, op4_decontamination, op5_preference,
        op6_token_counts, op7_language_id, op8_exact_dedup, op9_simhash, op10_licenses, op11_minhash, op12_conversation_repair,
        op13_merkle_manifest,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OWNERS = ",".join(map(str, sharding.fill_table(SHARDS, SLOTS)))


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"


def _then(state: str, cost: object, letter: str) -> str:
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}'}}"


def _best(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _when(condition: str, state: str) -> str:
    """The state if the condition holds, else one that is never the best."""
    return f"CASE WHEN {condition} THEN {state} ELSE {{'cost': 1000000000000, 'audit': ''}} END"


_STAYS, _MORE = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_KEEP = lambda x, role: _when(f"{_STAYS} AND c = '{role}'", _then(x, _MORE, "K"))
_REROLE = lambda x: _when(_STAYS, _then(x, f"1 + {_MORE}", "R"))

def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _tree(name: str, leaves: str, key: str) -> str:
    """SQL for the nodes of ternary trees, what lies beside each node, and the roots."""
    run = f"OVER (PARTITION BY level, {key}, idx // 3 ORDER BY idx ROWS BETWEEN"
    return f"""
        {name}_nodes AS (SELECT 0 AS level, {key}, idx, h, n FROM {leaves} UNION ALL
            SELECT level + 1, {key}, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM {name}_nodes WHERE n > 1 GROUP BY level, {key}, idx // 3),
        {name}_beside AS (SELECT level, {key}, idx, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lower, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS upper
            FROM {name}_nodes WHERE n > 1),
        {name}_roots AS (SELECT {key}, h FROM {name}_nodes WHERE n = 1)"""


def _fold(name: str, tree: str, start: str, key: str) -> str:
    """SQL that carries ``row, at, h, path`` of ``start`` up a tree, and what each row ends as."""
    return f"""
        {name}_steps AS (SELECT row, 0 AS level, {key}, idx, h, path FROM {start} UNION ALL
            SELECT row, s.level + 1, s.{key}, s.idx // 3, sha256(lower || s.h || upper), path || lower || upper
            FROM {name}_steps AS s JOIN {tree}_beside AS b ON s.level = b.level AND s.idx = b.idx AND s.{key} IS NOT DISTINCT FROM b.{key}),
        {name} AS (SELECT row, {key}, h, path FROM {name}_steps QUALIFY level = max(level) OVER (PARTITION BY row))"""


ORACLES = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, t, list_transform(range(32), lambda i: substr('{_BASE32}',
                ((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31)::INT + 1, 1)) AS c FROM p)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, array_to_string(c, '') AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op2_mixing": """
        WITH s AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM documents GROUP BY source),
        r AS (SELECT source, coalesce(sqrt(chars) / nullif(sum(sqrt(chars)) OVER (), 0) * sum(chars) OVER () / nullif(chars, 0), 1) AS rate FROM s),
        k AS (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r WHERE rate > 0),
        l AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k) AS f FROM k),
        p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - f)) OVER (PARTITION BY source ORDER BY k) AS c FROM l),
        a AS (SELECT source, list(c ORDER BY k) AS cdf FROM p GROUP BY source),
        u AS (SELECT *, ('0x' || substr(md5(concat('7|', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
        n AS (SELECT u.*, len(list_filter(cdf, lambda c: c <= u)) AS n FROM u JOIN a ON u.source IS NOT DISTINCT FROM a.source),
        x AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM n WHERE n > 0)
        SELECT *, md5(concat('7|order|', coalesce(doc_id::VARCHAR, ''), '|', copy)) AS shuffle_key FROM x
    """,
    "op3_sharding": f"""
        WITH t AS (SELECT string_split('{_OWNERS}', ',') AS owner),
        s AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents)
        SELECT s.*, 'shard-' || lpad(owner[slot + 1], 2, '0') AS shard FROM s, t
    """,
    "op5_preference": """
        WITH r AS (SELECT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
                          coalesce(turn, 9223372036854775807) AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        q AS (SELECT *, dense_rank() OVER (PARTITION BY pair_id, side ORDER BY t) AS place FROM r),
        b AS (SELECT pair_id, place, role, text, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS j FROM q GROUP BY ALL),
        u AS (SELECT pair_id, min(place) FILTER (c <> j) AS cut FROM b GROUP BY pair_id),
        m AS (SELECT q.*, cut IS NULL OR place < cut AS common FROM q JOIN u ON q.pair_id IS NOT DISTINCT FROM u.pair_id),
        s AS (SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE side END AS part, place, role,
                     concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) AS segment, NOT common AND role = 'assistant' AS counts FROM m WHERE NOT common OR side = 'chosen'),
        o AS (SELECT *, row_number() OVER w AS i, coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
              FROM s WINDOW w AS (PARTITION BY pair_id, part ORDER BY place, role, md5(segment)))
        SELECT pair_id, CAST(0 AS BIGINT) AS piece, coalesce(string_agg(segment, '' ORDER BY i) FILTER (part = 'prompt'), '') AS prompt,
               coalesce(string_agg(segment, '' ORDER BY i) FILTER (part = 'chosen'), '') AS chosen,
               coalesce(string_agg(concat((n + 13 + length(role))::BIGINT, '-', (n + length(segment) - 1)::BIGINT), ',' ORDER BY i) FILTER (part = 'chosen' AND counts), '') AS chosen_mask,
               coalesce(string_agg(segment, '' ORDER BY i) FILTER (part = 'rejected'), '') AS rejected,
               coalesce(string_agg(concat((n + 13 + length(role))::BIGINT, '-', (n + length(segment) - 1)::BIGINT), ',' ORDER BY i) FILTER (part = 'rejected' AND counts), '') AS rejected_mask
        FROM o GROUP BY pair_id
    """,
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op11_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        k AS (SELECT doc_id, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS rep, s FROM s),
        d AS (SELECT rep, n, unnest(s) AS x FROM k WHERE rep = doc_id),
        p AS (SELECT a.rep AS a, b.rep AS b FROM d AS a JOIN d AS b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT DISTINCT a AS rep, a AS c FROM e UNION SELECT r.rep, e.b FROM r JOIN e ON r.c = e.a),
        m AS (SELECT rep, min(c) AS c FROM r GROUP BY rep)
        SELECT doc_id, n AS n_shingles, coalesce(c, k.rep) AS component_id, doc_id = coalesce(c, k.rep) AS kept FROM k LEFT JOIN m ON k.rep = m.rep
    """,
    "op12_conversation_repair": rf"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS id FROM conversations),
        l AS (SELECT *, {_crc32("id")} % 20 AS k FROM k),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM l WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
        f AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                     regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM o),
        g AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
        v AS (SELECT conv_id, 0::BIGINT AS i, {{'cost': 0::BIGINT, 'audit': ''}} AS e, {{'cost': 1000000000000, 'audit': ''}} AS s, {{'cost': 1000000000000, 'audit': ''}} AS u, {{'cost': 1000000000000, 'audit': ''}} AS a
              FROM (SELECT DISTINCT conv_id FROM g)
              UNION ALL
              SELECT conv_id, i, {_then("e", 2, "D")}, {_best(_then("s", 2, "D"), _KEEP("e", "s"))},
                     {_best(_then("u", 2, "D"), *(_KEEP(x, "u") for x in "esa"), *(_REROLE(x) for x in "esa"))}, {_best(_then("a", 2, "D"), _KEEP("u", "a"), _REROLE("u"))}
              FROM (SELECT conv_id, i, c, fault, e, s, u, {_best("a", _then("u", 5, "I"))} AS a
                    FROM (SELECT v.conv_id, g.i, c, fault, e, s, a, {_best("u", *(_then(x, 5, "I") for x in "esa"))} AS u FROM v JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = v.i + 1))),
        b AS (SELECT conv_id, {_best("e", "a", _then("u", 5, "I"), _then("s", 10, "II"))} AS best FROM v QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
        y AS (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS j FROM b),
        x AS (SELECT *, audit[j] AS edit, len(replace(audit[:j], 'I', '')) AS i, len(replace(audit[:j], 'D', '')) AS m FROM y),
        t AS (SELECT x.*, g.role, g.text, max((edit = 'K' AND g.c = 's')::INT) OVER (PARTITION BY x.conv_id) AS led FROM x LEFT JOIN g ON edit <> 'I' AND x.i = g.i AND x.conv_id IS NOT DISTINCT FROM g.conv_id),
        h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS repaired FROM t WHERE edit <> 'D' GROUP BY conv_id),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
        SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS q LEFT JOIN b ON q.conv_id IS NOT DISTINCT FROM b.conv_id
        LEFT JOIN h ON q.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN n ON q.conv_id IS NOT DISTINCT FROM n.conv_id
    """,
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS h, {_leaf("CASE WHEN " + _crc32("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS given FROM documents),
        l AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
        {_tree("own", "l", "source")},
        s AS (SELECT source, 0 AS one, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM own_roots),
        {_tree("top", "s", "one")},
        a AS (SELECT row, source, idx, given AS h, '' AS path FROM l),
        {_fold("below", "own", "a", "source")},
        b AS (SELECT row, 0 AS one, s.idx, below.h, path FROM below JOIN s ON below.source IS NOT DISTINCT FROM s.source),
        {_fold("above", "top", "b", "one")}
        SELECT doc_id, l.h AS leaf, s.h AS subroot, top_roots.h AS root, sha256(path) AS proof_sha256, above.h AS folded_root, above.h = top_roots.h AS verified
        FROM l JOIN above ON l.row = above.row JOIN s ON l.source IS NOT DISTINCT FROM s.source, top_roots
    """,
}
