"""Checking SQL of the corpus queries that SQL can express.

The quality classifier and the secret scan are trained models, the fuzzy search needs an edit distance
on words, the mix and the fingerprints a hash that the checking engine lacks; tests compare those with
brute force.
"""

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '')"

#: CRC-32 of the decimal digits of doc_id, four bits at a time.
_CRC_STEP = "xor(({x}) >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(({x}) & 15) + 1])"
_CRC32 = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: "
          + _CRC_STEP.format(x=_CRC_STEP.format(x="xor(c, b)")) + "), 4294967295)")

_BASE32 = " || ".join(
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || substr(h, {5 * group + 1}, 5))::INT >> {shift}) % 32 + 1]"
    for group in range(8) for shift in (15, 10, 5, 0)
)

#: Windows of p_len letters that also start earlier; ``letters`` is one row per document with its list of letters.
_REPEATED = """
    w AS (SELECT doc_id, p, hash_of AS h FROM windows),
    f AS (SELECT h, min(doc_id) AS d FROM w GROUP BY h),
    g AS (SELECT w.h, f.d, min(w.p) AS p FROM w JOIN f ON f.h = w.h AND f.d = w.doc_id GROUP BY w.h, f.d),
    later AS (SELECT w.doc_id, w.p FROM w JOIN g ON g.h = w.h WHERE (w.doc_id, w.p) <> (g.d, g.p)),
    isl AS (SELECT doc_id, min(p) AS a, max(p) + {length} AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS fresh FROM later) x) y GROUP BY doc_id, run),
    cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM isl)"""

ORACLES: dict[str, str] = {
    "op1_warc_chunks": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, upper(sha1(encode(coalesce(html, '')))) AS h FROM pages),
        m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
        SELECT page_id, octet_length(b) AS payload_bytes, {_BASE32} AS payload_digest,
          CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM p JOIN m USING (h)""",
    "op3_phrase_automata": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        windows AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + 20], ' ') AS hash_of FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS p FROM d WHERE len(ws) >= 20) x),
        {_REPEATED.format(length=20)},
        k AS (SELECT doc_id, sum(b - a) AS n_removed, max(b) AS b, flatten(list(ws[before + 1 : a] ORDER BY a)) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
          sha256(array_to_string(list_concat(coalesce(head, []), ws[coalesce(b, 0) + 1 :]), ' ')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op4_line_frequency": f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        ln AS (SELECT doc_id, source, text, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '{_SPACES}', ' ', 'g'), ' ') AS line
          FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) x),
        fr AS (SELECT source, line FROM ln WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT text) > 100),
        lw AS (SELECT doc_id, sum(len(string_split(ln.line, ' '))) AS line_words, coalesce(sum(len(string_split(ln.line, ' '))) FILTER (fr.line IS NOT NULL), 0) AS frequent
          FROM ln LEFT JOIN fr ON fr.source IS NOT DISTINCT FROM ln.source AND fr.line = ln.line WHERE ln.line <> '' GROUP BY doc_id),
        dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) x
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        w3 AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS w FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM d WHERE len(ws) > 2) x),
        twice AS (SELECT doc_id, w FROM w3 GROUP BY doc_id, w HAVING count(*) > 1),
        rw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT w3.doc_id, unnest([i, i + 1, i + 2]) AS q FROM w3 JOIN twice USING (doc_id, w)) x GROUP BY doc_id),
        s AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
          coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(line_words, 0) AS line_words, coalesce(frequent, 0) AS frequent
          FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN lw USING (doc_id)),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, line_words - frequent < 0.3 * line_words AS depleted FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, depleted,
          CASE WHEN line_words > 0 THEN CAST(floor(n_words * frequent / line_words) AS BIGINT) ELSE 0 END AS n_frequent_words FROM v""",
    "op5_prefix_doubling": f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        windows AS (SELECT doc_id, p, array_slice(x, p + 1, p + 100) AS hash_of FROM (SELECT doc_id, x, unnest(range(n - 99)) AS p FROM d WHERE n >= 100) y),
        {_REPEATED.format(length=100)},
        k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN a > before THEN hex(array_slice(x, before + 1, a)) ELSE '' END, '' ORDER BY a) AS head, max(b) AS b
          FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
          sha256(unhex(coalesce(head, '') || CASE WHEN coalesce(b, 0) < d.n THEN hex(array_slice(x, coalesce(b, 0) + 1, d.n)) ELSE '' END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_snapshot_collapse": """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t),
        x AS (SELECT conv_id, i, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
          md5(concat(role IS NULL, '/', role, '/', text IS NULL, '/', length(text), '/', text)) AS h FROM o),
        p AS (SELECT conv_id, i, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix, count(*) OVER (PARTITION BY conv_id) AS turns FROM x),
        whole AS (SELECT prefix, max(turns) AS turns, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE i = turns GROUP BY prefix),
        kept AS (SELECT * FROM whole ANTI JOIN (SELECT DISTINCT prefix FROM p WHERE i < turns) inside USING (prefix))
        SELECT x.conv_id, CAST((x.i - 1) // 256 AS INT) AS part, max(turns) AS turns, max(copies) AS copies, string_agg(line, '' ORDER BY x.i) AS rendered
          FROM x JOIN kept USING (conv_id) GROUP BY x.conv_id, (x.i - 1) // 256""",
    "op12_diagonal_runs": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws, {_CRC32} AS h FROM documents),
        t AS (SELECT *, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts FROM d),
        w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM t) x),
        same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        isl AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q - min(i) AS l FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) x GROUP BY doc_id, q, g HAVING max(i) + 1 + q - min(i) >= greatest(24, 3 * q)),
        r AS (SELECT * FROM isl ANTI JOIN isl AS z ON z.doc_id = isl.doc_id AND z.q < isl.q AND z.s <= isl.s AND z.s + z.l >= isl.s + isl.l),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
        e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM t LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op11_tree_bound_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_dot_product(a.q, e.q) AS BIGINT) AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank, n.vec_id AS negative_id,
          p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score QUALIFY rank <= 10""",
}
