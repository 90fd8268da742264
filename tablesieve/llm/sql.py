"""SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

# White space that separates words; the polynomial of CRC-32.
WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
POLYNOMIAL = 0xEDB88320


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, by the table in column ``t`` of ``crc_table``."""
    digits = f"string_split(regexp_replace(hex(encode({text})), '(..)', '\\1,', 'g'), ',')"
    values = f"list_transform(list_filter({digits}, lambda h: h <> ''), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), {step}), 4294967295::BIGINT)"


CRC_TABLE = f"""crc_table AS (SELECT list_transform(range(256), lambda n:
    list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor({POLYNOMIAL}, c >> 1) ELSE c >> 1 END)) AS t)"""


def unit(seed: int, *parts: str) -> str:
    """The seeded number in [0, 1) of some values."""
    values = ", ".join(f"coalesce({p}::VARCHAR, '~')" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {values})), 1, 12))::BIGINT / {float(1 << 48)}::DOUBLE"


def sharding(shards: int, seed: int, row_bytes: int) -> str:
    return f"""WITH {CRC_TABLE},
    d AS (SELECT doc_id, coalesce('s' || source, '') AS stratum, coalesce(strlen(text), 0)::BIGINT + {row_bytes} AS size,
                 {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
    u AS (SELECT *, {unit(seed, 'doc_id', 'text_crc32')} AS u FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, doc_id NULLS FIRST, text_crc32, size) - 1 AS place,
                 count(*) OVER (PARTITION BY stratum) AS total FROM u),
    f AS (SELECT *, (place + {unit(seed, 'stratum')}) / total AS fraction FROM p),
    o AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, u, doc_id NULLS FIRST, text_crc32, size) - 1 AS position, count(*) OVER () AS n FROM f),
    z AS (SELECT *, (position * {shards}) // n AS shard FROM o)
    SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, position - (shard * n + {shards - 1}) // {shards} AS slot,
           NULL::INTEGER AS grown_shard FROM z"""


def near_duplicates(width: int, percent: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS t
          FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {width - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)"""


def merkle(levels: int, top_levels: int) -> str:
    """All leaves, proofs and folded roots of trees of at most 8^levels leaves and 8^top_levels languages."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")

    def leaf(**changed: str) -> str:
        parts = [changed.get(f, f) for f in fields]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({p}::VARCHAR)::VARCHAR || ':' || {p}::VARCHAR, '-')" for p in parts) + "))"

    lower = "CASE WHEN tampers THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    steps = [
        f"d AS (SELECT *, coalesce('l' || lang, '-') AS tree, coalesce({crc32('doc_id::VARCHAR')} % 3 = 0, false) AS tampers FROM documents, crc_table)",
        f"""b0 AS MATERIALIZED (SELECT tree, doc_id, {leaf()} AS leaf, {leaf(text=f"({lower})")} AS folded, '' AS proof,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, {leaf()}) - 1 AS pos FROM d)""",
        "n0 AS MATERIALIZED (SELECT tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM b0)",
    ]

    def grow(level: int, name: str) -> None:
        """Runs of a level, the nodes above it, and every leaf's proof and folded digest one level up."""
        i, j = f"{name}{level}", f"{name}{level + 1}"
        rows, above = ("b", "c")[name == "t"], f"{('b', 'c')[name == 't']}{level + 1}"
        own = f"(b.pos % 8)::INTEGER"
        left, right = f"array_to_string(r.hs[1:{own}], '')", f"array_to_string(r.hs[{own} + 2:], '')"
        steps.extend([
            f"r{i} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, n, list(h ORDER BY pos) AS hs FROM {i} GROUP BY tree, pos // 8, n)",
            f"{j} AS MATERIALIZED (SELECT tree, pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM r{i})",
            f"""{above} AS MATERIALIZED (SELECT b.* EXCLUDE (folded, proof, pos), b.pos // 8 AS pos,
                CASE WHEN r.n = 1 THEN b.folded ELSE sha256(concat({left}, b.folded, {right})) END AS folded, concat(b.proof, {left}, {right}) AS proof
                FROM {rows}{level} b JOIN r{i} r ON r.tree = b.tree AND r.pos = b.pos // 8)""",
        ])

    for level in range(levels):
        grow(level, "n")
    steps.append(f"t0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS lang_tree FROM n{levels})")
    steps.append(f"""c0 AS MATERIALIZED (SELECT '' AS tree, b.doc_id, b.leaf, t.h AS subroot, b.folded, b.proof, t.pos
                     FROM b{levels} b JOIN t0 t ON t.lang_tree = b.tree)""")
    for level in range(top_levels):
        grow(level, "t")
    return f"""WITH {CRC_TABLE}, {", ".join(steps)}
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
    FROM c{top_levels} c JOIN t{top_levels} t ON t.tree = c.tree"""


def divergence(least: int, scale: int, added: int, reported: int) -> str:
    def share(count: str, total: str) -> str:
        return f"(1 + ({scale}::HUGEINT * ({count} + {added})) // ({total} + {added} * v))"

    return f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    i AS MATERIALIZED (SELECT row_number() OVER () AS i, lang, source,
          regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM d),
    t AS MATERIALIZED (SELECT lang, source, i, term, count(*) AS n FROM (SELECT lang, source, i, unnest(w) AS term FROM i) GROUP BY ALL),
    k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(*) >= {least}),
    z AS MATERIALIZED (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    c AS MATERIALIZED (SELECT t.lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    s AS MATERIALIZED (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'coalesce(s.total, 0)')} AS p, {share('k.n', 'z.total')} AS q
          FROM g JOIN k USING (lang) JOIN z USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
          LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
    x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM y)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {reported}"""


def chat(planted: list[tuple[int, int, str, str]]) -> str:
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in planted)
    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES {rows})),
    e AS (SELECT *, '<turn:' || replace(replace(role, '\', '\\'), '>', '\>') || chr(62) || chr(10)
          || replace(replace(replace(text, '\', '\\'), '<turn:', '\<turn:'), '</turn>', '\</turn>') || '</turn>' || chr(10) AS formatted FROM c),
    o AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
          coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
          sum(length(formatted))::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM o"""
