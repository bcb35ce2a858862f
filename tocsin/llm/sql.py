"""DuckDB SQL for the operators that SQL can express, over the views documents, embeddings and conversations."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A conversation whose texts hold the control strings of chat formatting.
CONTROL_TURNS = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
#: Connected components of `nodes(id)` under `links(a, b)`, as found(id, component).
_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
found AS (SELECT n.id, least(n.id, coalesce(min(r.other), n.id)) AS component FROM nodes n LEFT JOIN reach r ON r.id = n.id GROUP BY n.id)"""


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def substring_dedup_sql(length: int = 13) -> str:
    return f"""
    WITH docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
    word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word, len(w) AS n FROM docs),
    win AS (SELECT doc_id, pos, word, n, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS key FROM word),
    first AS (SELECT key, min(doc_id) AS first FROM win WHERE pos + {length - 1} <= n GROUP BY key),
    hit AS (SELECT win.doc_id, pos, word, coalesce(pos + {length - 1} <= n AND first < win.doc_id, false) AS gone FROM win LEFT JOIN first ON first.key = win.key AND pos + {length - 1} <= n),
    covered AS (SELECT doc_id, pos, word, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM hit),
    kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)"""


def near_dup_sql(shingle: int = 4, percent: int = 80) -> str:
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
    word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word, len(w) AS n FROM docs),
    runs AS (SELECT doc_id, pos, n, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {shingle - 1} FOLLOWING) AS item FROM word),
    items AS (SELECT DISTINCT doc_id, item FROM runs WHERE pos + {shingle - 1} <= n OR (n < {shingle} AND pos = 1)),
    sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= {percent} * (s.n + t.n - k)),
    nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, doc_id = component AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) JOIN found ON found.id = doc_id"""


def near_vectors_sql(least: float = 0.98) -> str:
    return f"""
    WITH RECURSIVE vectors AS (
      SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.id < y.id AND len(x.v) = len(y.v)
      WHERE list_cosine_similarity(x.v, y.v) >= CAST({least} AS DOUBLE)),
    nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
    counts AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
    FROM embeddings JOIN found ON found.id = vec_id LEFT JOIN counts ON counts.id = vec_id"""


def chat_sql() -> str:
    control = " ".join(f"UNION ALL SELECT {conv}, {turn}, '{role}', '{text}'" for conv, turn, role, text in CONTROL_TURNS)
    marks = len("<|im_start|>") + len("\n") + len("<|im_end|>") + len("\n")
    return rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations {control})),
    written AS (
      SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head,
        regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS content FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({marks} + length(head) + length(content)) AS BIGINT) AS formatted_chars
    FROM written GROUP BY conv_id"""


def spelling_sql(least_letters: int = 7, ratio: int = 10) -> str:
    """crc32 is taken of the UTF-8 bytes of characters up to U+00FF, with its table made from its polynomial."""
    return rf"""
    WITH RECURSIVE remainders AS (
      SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
    runs AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{least_letters},}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
    codes AS (SELECT id, run, list_transform(string_split(id || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS codes FROM (SELECT DISTINCT id, run FROM runs)),
    bytes AS (SELECT id, run, flatten(list_transform(codes, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END)) AS bytes FROM codes),
    crcs AS (SELECT id, run, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, remainders),
    spelt AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM runs JOIN crcs USING (id, run)),
    words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= {least_letters} GROUP BY word HAVING count(*) >= 2),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words),
    rests AS (SELECT word, n, place, word[1 : place - 1] || word[place + 1 :] AS rest FROM places),
    inserted AS (SELECT DISTINCT r.word AS x, r.n AS x_n, w.word AS y, w.n AS y_n FROM rests r JOIN words w ON r.rest = w.word),
    near AS (
      SELECT a.word AS word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
      UNION ALL SELECT x, y, y_n FROM inserted UNION ALL SELECT y, x, x_n FROM inserted),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, struct_pack(a := -other_n, b := other)) AS other FROM near GROUP BY word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {ratio} * w.n THEN other END AS form, CASE WHEN most >= {ratio} * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
    follow(word, target, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT f.word, g.word, g.form FROM follow f JOIN forms g ON g.word = f.form)
    SELECT forms.word, forms.form, follow.target AS root, n, n_near, form_n FROM forms JOIN follow ON follow.word = forms.word AND follow.form IS NULL"""
