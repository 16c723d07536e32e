"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, flac, language_id, license_scan, minhash, mixing, pii, quality_classifier, quality_rules, source_audit, spelling, suffix_dedup, warc
from .common import small_batches

QUERIES = {f.__name__: small_batches(f) for f in (
    warc.op1_warc_index,
    minhash.op2_hyperminhash,
    bpe.op3_byte_bpe,
    flac.op4_flac_media,
    quality_classifier.op5_rule_ensemble,
    mixing.op6_temperature_mix,
    suffix_dedup.op7_suffix_repeats,
    language_id.op8_byte_cnn,
    license_scan.op9_license_rules,
    quality_rules.op10_quality_divergence,
    quality_rules.relative_quality_divergence,
    source_audit.op11_source_divergence,
    pii.op12_personal_data,
    spelling.op13_spelling_variants,
)}


def _code_points(first: int, last: int) -> str:
    """Characters whose UTF-8 code begins with bytes ``first`` to ``last``."""
    at = lambda b: (b & 0x1F) << 6 if b < 0xE0 else max((b & 0x0F) << 12, 0x800) if b < 0xF0 else max((b & 7) << 18, 0x10000)
    return rf"[\x{{{at(first):x}}}-\x{{{0x10FFFF if last == 0xFF else at(last + 1) - 1:x}}}]"


_CLASSES = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x09-\x0D\x20]", "symbol": r"[#*$%&|<>]", "other": r"[\x00-\x08\x0E-\x1F\x7F]",
} | {name: _code_points(*ends) for name, ends in quality_rules.WIDE.items()}
_IN_CLASS = {c: f"length(regexp_replace(t, '[^{r[1:]}', '', 'g'))" for c, r in _CLASSES.items()}
_POINT = f"length(t) - ({' + '.join(_IN_CLASS.values())})"
_LIMIT = quality_rules.LIMITS


def _divergence(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"


ORACLES: dict[str, str] = {
    "op10_quality_divergence": rf"""
        WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        runs AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM texts WHERE len(w) >= 8)),
        twice AS (SELECT doc_id, r FROM runs GROUP BY ALL HAVING count(*) > 1),
        inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT runs.doc_id, unnest(range(k, k + 8)) AS p FROM runs JOIN twice USING (doc_id, r)) GROUP BY doc_id),
        chars AS (SELECT doc_id, lang, unnest([{", ".join(f"'{c}'" for c in _CLASSES)}, 'point']) AS bin, unnest([{", ".join(_IN_CLASS.values())}, {_POINT}])::DOUBLE AS n FROM texts),
        words AS (SELECT doc_id, lang, v AS bin, count(*)::DOUBLE AS n FROM (SELECT doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS v FROM texts) GROUP BY ALL),
        totals AS (SELECT lang, sum(n) AS z FROM words WHERE lang IS NOT NULL GROUP BY lang),
        large AS (SELECT lang, z FROM totals WHERE z >= {quality_rules.LEAST_WORDS}),
        -- references: shares of character classes, and of the common words of each language
        c_refs AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM chars JOIN large USING (lang) GROUP BY lang, bin),
        w_refs AS (SELECT lang, bin, sum(n) / any_value(z) AS q FROM words JOIN large USING (lang) GROUP BY lang, bin HAVING sum(n) * {quality_rules.COMMON_SHARE} >= any_value(z)),
        mass AS (SELECT l.lang, coalesce(sum(q), 0) AS m FROM large l LEFT JOIN w_refs r ON r.lang = l.lang GROUP BY l.lang),
        c_share AS (SELECT doc_id, lang, bin, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM chars QUALIFY sum(n) OVER (PARTITION BY doc_id) > 0),
        c_best AS (SELECT doc_id, sqrt(greatest(sum({_divergence("p", "q")}), 0) / 2) AS d FROM c_share JOIN c_refs USING (lang, bin) GROUP BY doc_id),
        w_share AS (SELECT doc_id, lang, bin, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM words),
        -- a common word that a text lacks counts in full: q * log2(2)
        w_found AS (SELECT doc_id, sum({_divergence("p", "q")} - q) AS d, sum(p) AS p FROM w_share JOIN w_refs USING (lang, bin) GROUP BY doc_id),
        w_parts AS (SELECT t.doc_id, coalesce(f.d, 0) + m.m AS d, greatest(1 - coalesce(f.p, 0), 0) AS p, greatest(1 - m.m, 0) AS q, {_LIMIT["word_share"]} * sqrt(greatest(m + {_divergence("1.0", "(1 - m)")}, 0) / 2) AS word_limit FROM texts t JOIN mass m ON m.lang = t.lang AND m.m >= {quality_rules.LEAST_MASS} LEFT JOIN w_found f ON f.doc_id = t.doc_id),
        w_best AS (SELECT doc_id, sqrt(greatest(d + {_divergence("p", "q")}, 0) / 2) AS d, word_limit FROM w_parts),
        counted AS (
            SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {_IN_CLASS["symbol"]}::BIGINT AS n_symbols,
                coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words,
                CASE WHEN length(t) >= {_LIMIT["min_chars"]} THEN c.d END AS char_distance, CASE WHEN len(w) >= {_LIMIT["min_words"]} THEN v.d END AS word_distance, v.word_limit
            FROM texts t LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id) LEFT JOIN c_best c USING (doc_id) LEFT JOIN w_best v USING (doc_id)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(char_distance, 0) <= {_LIMIT["max_char_distance"]} AND coalesce(word_distance, 0) <= coalesce(word_limit, 1) AS kept,
            coalesce(round(char_distance, 6), -1) AS char_distance, coalesce(round(word_distance, 6), -1) AS word_distance
        FROM judged""",
    "op1_warc_index": """
        WITH held AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        named AS (
            SELECT page_id, url, strlen(payload)::BIGINT AS payload_bytes,
                array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda c:
                    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * g)::INT, 5))::BIGINT >> (15 - 5 * c)::BIGINT) & 31)::INT, 1)), '')), '') AS payload_digest
            FROM held),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM named)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
        FROM firsts""",
    # all pairs that share a shingle: for small tables
    "op2_hyperminhash": """
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM worded WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
    # every window of every text: for small tables
    "op7_suffix_repeats": """
        WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
        windows AS (SELECT doc_id, p, hash(substr(h, (2 * p + 1)::INT, 400)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM bytes WHERE n >= 200)),
        repeated AS (SELECT doc_id, p FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
        marked AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS apart FROM repeated),
        numbered AS (SELECT doc_id, p, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
        spans AS (SELECT doc_id, k, min(p) AS b, max(p) + 200 AS e FROM numbered GROUP BY ALL),
        gaps AS (SELECT doc_id, e AS b, lead(b) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM spans UNION ALL SELECT doc_id, 0, min(b) FROM spans GROUP BY doc_id),
        kept AS (SELECT g.doc_id, string_agg(substr(h, (2 * g.b + 1)::INT, (2 * (coalesce(g.e, n) - g.b))::INT), '' ORDER BY g.b) AS k FROM gaps g JOIN bytes x ON x.doc_id = g.doc_id GROUP BY g.doc_id),
        counted AS (SELECT doc_id, sum(e - b)::BIGINT AS r, count(*) AS s FROM spans GROUP BY doc_id)
        SELECT x.doc_id, x.n::BIGINT AS n_bytes, coalesce(c.r, 0) AS n_removed, coalesce(c.s, 0) AS n_spans, sha256(unhex(coalesce(k.k, x.h))) AS kept_sha256
        FROM bytes x LEFT JOIN kept k ON k.doc_id = x.doc_id LEFT JOIN counted c ON c.doc_id = x.doc_id""",
    "op11_source_divergence": r"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
        per_doc AS (SELECT row_number() OVER () AS d, lang, source, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM texts),
        uses AS (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(w) AS term FROM per_doc) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS n FROM uses GROUP BY lang, term HAVING count(*) >= 30),
        sizes AS (SELECT lang, count(*) AS v, sum(n) AS z FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM texts),
        found AS (SELECT lang, source, term, sum(n) AS n FROM uses WHERE (lang, term) IN (SELECT lang, term FROM kept) GROUP BY ALL),
        full_counts AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS n_lang FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
        shares AS (
            SELECT c.lang, source, term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)::HUGEINT) // (sum(c.n) OVER (PARTITION BY c.lang, source) + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)::HUGEINT) // (z + 5 * v)::HUGEINT AS q
            FROM full_counts c JOIN sizes s ON s.lang = c.lang),
        distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
        UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 50""",
    # the checksum bit by bit, and words by what is left without one letter: for small tables
    "op13_spelling_variants": r"""
        WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        each_run AS (SELECT k, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
        hexed AS (SELECT k, w, n, hex(encode(k || ':' || w)) AS h FROM each_run),
        bytes AS (SELECT k, w, n, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS b FROM hexed),
        bits AS (SELECT k, w, n, flatten(list_transform(b, lambda x: [x & 1, (x >> 1) & 1, (x >> 2) & 1, (x >> 3) & 1, (x >> 4) & 1, (x >> 5) & 1, (x >> 6) & 1, x >> 7])) AS b FROM bytes),
        sums AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295), 4294967295) AS h FROM bits),
        changed AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS w FROM sums),
        words AS (SELECT w, sum(n)::BIGINT AS n FROM changed WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
        gaps AS (SELECT w, i, left(w, i::INT) || substr(w, (i + 2)::INT) AS g FROM (SELECT w, unnest(range(0, length(w))) AS i FROM words)),
        near AS (
            SELECT DISTINCT x.w AS a, y.w AS b FROM gaps x JOIN gaps y ON x.i = y.i AND x.g = y.g AND x.w <> y.w
            UNION SELECT g.w, x.w FROM gaps g JOIN words x ON x.w = g.g UNION SELECT x.w, g.w FROM gaps g JOIN words x ON x.w = g.g),
        best AS (SELECT a AS w, count(*) AS n_near, arg_min(b, {'less': -y.n, 'w': b}) AS f, max(y.n) AS fn FROM near JOIN words y ON y.w = b GROUP BY a),
        told AS (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 5 * n THEN f END AS form, CASE WHEN fn >= 5 * n THEN fn END AS form_n FROM words LEFT JOIN best ON best.w = words.w),
        up(w, top) AS (SELECT w, w FROM told UNION ALL SELECT up.w, told.form FROM up JOIN told ON told.w = up.top WHERE told.form IS NOT NULL)
        SELECT told.w AS word, told.form, up.top AS root, told.n, told.n_near, told.form_n FROM told JOIN up ON up.w = told.w JOIN told z ON z.w = up.top AND z.form IS NULL""",
}
ORACLES["relative_quality_divergence"] = f"SELECT doc_id, base_failed, kept, char_distance, word_distance FROM ({ORACLES['op10_quality_divergence']})"
