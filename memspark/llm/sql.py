"""DuckDB SQL with the same rows as the queries that SQL can express.

It follows the definition of each result, not the way the operators work: whole sequences instead of
hashes, running sums over whole sources, all pairs that share a shingle. The other queries (token
counts, fingerprints, byte-level BPE, token files, the pipeline) rest on tokenizers or hashes
that SQL has not; tests hold them against plain versions.
"""

from __future__ import annotations

from memspark.llm import licenses, mixing, quality
from memspark.llm.chat import CLOSE, MIDDLE, OPEN

WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    """A string literal; line breaks by chr()."""
    return "('" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _sentences(text: str) -> str:
    lowered = f"regexp_replace(translate({text}, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.LEAD}', '\\1.', 'g')"
    split = f"regexp_replace({lowered}, '{licenses.STOP}({licenses.SPACE})', chr(10) || '\\1', 'g')"
    plain = f"regexp_replace({split}, '[^a-z0-9\\n]+', ' ', 'g')"
    return f"string_split(trim(regexp_replace({plain}, ' ?\\n[ \\n]*', chr(10), 'g')), chr(10))"


def _license_scan() -> str:
    known = {licenses.normalised(s): i for s, i in licenses.SENTENCES.items()}
    table = "MAP {" + ", ".join(f"{_text(s)}: {_text(i)}" for s, i in known.items()) + "}"
    joined = f"regexp_replace(text, '{licenses.PARAGRAPH}', '.' || chr(1), 'g')"
    joined = f"replace(regexp_replace({joined}, '{licenses.WRAP}', ' ', 'g'), chr(1), chr(10))"

    def ids(sentences: str) -> str:
        one = f"coalesce(known[s], CASE WHEN regexp_matches(s, '{licenses.HOLDER}') THEN 'AllRights' END)"
        return f"list_filter(list_transform({sentences}, lambda s: {one}), lambda i: i IS NOT NULL)"

    def matched(column: str) -> str:
        text = f"coalesce(array_to_string(list_transform({column}, lambda i: '|' || i || '|'), ''), '')"
        for sequence, licence in licenses.RULES:
            text = f"replace({text}, {_text(''.join(f'|{i}|' for i in sequence))}, {_text(f'<{licence}>')})"
        return text

    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, {table} AS known FROM documents),
    found AS (SELECT doc_id, {ids(_sentences("text"))} AS lines, {ids(_sentences(joined))} AS wrapped FROM texts),
    runs AS (SELECT doc_id, lines, {matched("lines")} AS a, {matched("wrapped")} AS b FROM found)
    SELECT doc_id,
        coalesce(array_to_string(lines, ','), '') AS sentence_ids,
        coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(a || b, '<([^>]*)>', 1))), ','), '') AS licences,
        coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(a, '\\|([^|]*)\\|', 1))), ','), '') AS unmatched
    FROM runs"""


NGRAM_JACCARD = rf"""
    WITH RECURSIVE texts AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{WORD}') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM texts),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT x, y FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x)
    SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id
    FROM sets"""


def _chat_format() -> str:
    piece = f"{_text(OPEN)} || split_part(t, chr(1), 1) || {_text(MIDDLE)} || substr(t, instr(t, chr(1)) + 1) || {_text(CLOSE)}"
    return f"""
    WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') || chr(1) || coalesce(text, '') AS t
        FROM conversations WHERE conv_id IS NOT NULL),
    chats AS (SELECT conv_id, list(t ORDER BY turn, t) AS s FROM turns GROUP BY conv_id),
    single AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, s FROM chats GROUP BY s)
    SELECT conv_id, len(s) AS turns, copies, array_to_string(list_transform(s, lambda t: {piece}), '') AS text
    FROM single WHERE NOT EXISTS (
        SELECT 1 FROM chats longer WHERE len(longer.s) > len(single.s) AND longer.s[1:len(single.s)] = single.s)"""


# The markup of the given pages: one article, with headings and paragraphs only; three character references.
HTML_TEXT = r"""
    WITH bodies AS (
        SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
    parts AS (
        SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1|h2|h3|ul|li|div)>'), lambda b:
            trim(regexp_replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
                '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '[ \t\n\r]+', ' ', 'g'))) AS blocks
        FROM bodies)
    SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) AS text, length(text) AS n_chars
    FROM parts"""


def _mix_sources() -> str:
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(
        f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(mixing.WEIGHTS)
    ) + " END"
    return rf"""
    WITH sizes AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
            ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS key
        FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
    weighed AS (SELECT *, {weight} AS weight, {mixing.CAP} * source_size AS most FROM sources),
    levels AS (
        SELECT *, row_number() OVER o AS place, ((sum(source_size) OVER ()) - (sum(most) OVER o - most))
            / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
        FROM weighed WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    settled AS (SELECT level AS common FROM levels WHERE level <= most / weight ORDER BY place LIMIT 1),
    targets AS (SELECT source, source_size, least(most::DOUBLE, weight * common) AS target FROM levels, settled),
    placed AS (
        SELECT doc_id, size, source_size, target,
            CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
            coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM sizes JOIN targets USING (source))
    SELECT doc_id, size, source_size, target,
        epochs * size + least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - before)) AS taken
    FROM placed"""


def _quality_rules() -> str:
    a, b, c = quality.MULTIPLIERS
    code = "unicode(chars[{}])"
    value = f"({code.format('i')} * {a} + {code.format('i + 1')} * {b} + {code.format('i + 2')} * {c})"
    symbols = "[#*$%&|<>]"
    log = "ln(({} + 1) / ({} + " + str(quality.BUCKETS) + "))"
    raw, trusted = log.format("raw", "sum(raw) OVER ()"), log.format("trusted", "sum(trusted) OVER ()")
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM texts),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
    base AS (
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            len(regexp_extract_all(text, '{symbols}')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
        FROM words LEFT JOIN repeated USING (doc_id)),
    ruled AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
    labelled AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
        ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {quality.LABELLED}),
    split AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS chars FROM texts),
    grams AS (SELECT doc_id, ({value} % 4294967296) // 65536 AS bucket
        FROM (SELECT doc_id, chars, unnest(range(1, len(chars) - 1)) AS i FROM split)),
    counted AS (SELECT bucket, count(*) AS raw, count(*) FILTER (good = 1) AS trusted
        FROM grams LEFT JOIN labelled USING (doc_id) GROUP BY bucket),
    weights AS (SELECT bucket, CASE WHEN sum(trusted) OVER () = 0 THEN 0
        ELSE floor(({trusted} - {raw}) * {quality.SCALE} + 0.5)::BIGINT END AS weight FROM counted),
    scores AS (SELECT doc_id, count(*) AS n_grams, sum(weight)::BIGINT AS score FROM grams JOIN weights USING (bucket) GROUP BY doc_id),
    scored AS (SELECT ruled.*, coalesce(n_grams, 0) AS n_grams, coalesce(score, 0) AS score,
        coalesce(score, 0) / greatest(coalesce(n_grams, 0), 1) AS mean FROM ruled LEFT JOIN scores USING (doc_id)),
    steps AS (SELECT mean, sum(good) AS good, count(*) - sum(good) AS bad
        FROM scored JOIN labelled USING (doc_id) WHERE NOT base_failed GROUP BY mean),
    sums AS (SELECT *, lag(mean) OVER o AS lower, sum(good) OVER o - good AS good_below, sum(bad) OVER o - bad AS bad_below,
        sum(good) OVER () AS goods, sum(bad) OVER () AS bads FROM steps WINDOW o AS (ORDER BY mean)),
    cuts AS (SELECT CASE WHEN lower IS NULL THEN mean ELSE (mean + lower) / 2 END AS cut,
        (goods - good_below) / goods + CASE WHEN bads > 0 THEN bad_below / bads ELSE 0 END AS value, mean FROM sums WHERE goods > 0),
    threshold AS (SELECT coalesce((SELECT cut FROM cuts ORDER BY value DESC, mean LIMIT 1), '-infinity'::DOUBLE) AS cut)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams, score, base_failed,
        NOT base_failed AND mean >= cut AS kept
    FROM scored, threshold"""


SUBSTRING_DEDUP = rf"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
    earliest AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN earliest USING (g) WHERE first_id < doc_id),
    placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
    kept AS (
      SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS t
      FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)"""

FILL_IN_MIDDLE = r"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
      FROM documents),
    drawn AS (
      SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM texts),
    formed AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM drawn),
    cut AS (
      SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(units[b + 1:n], ''), '') AS s
      FROM formed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM cut"""

HARD_NEGATIVES = """
    WITH taken AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""

ORACLE: dict[str, str] = {
    "op1_license_scan": _license_scan(),
    "op3_ngram_jaccard": NGRAM_JACCARD,
    "op5_chat_format": _chat_format(),
    "op6_html_text": HTML_TEXT,
    "op9_mix_sources": _mix_sources(),
    "op10_quality_rules": _quality_rules(),
    "op11_substring_dedup": SUBSTRING_DEDUP,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_hard_negatives": HARD_NEGATIVES,
}
