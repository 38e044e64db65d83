"""The queries that SQL can express, in DuckDB's dialect."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



#: crc32 of a number as text, bit by bit: DuckDB has no function for it.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                               lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""


def framed(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def merkle_sql() -> str:
    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", n_chars, "text"))) + ")"

    def levels(name: str, start: str) -> str:
        return f"""{name} AS (
            SELECT tree, 0 AS level, pos, h, size FROM {start}
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(size) + 1) // 2
            FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 2)"""

    def way(name: str, start: str, nodes: str) -> str:
        folded = "CASE WHEN s.h IS NULL THEN sha256(w.folded) WHEN w.pos % 2 = 1 THEN sha256(s.h || w.folded) " \
                 "ELSE sha256(w.folded || s.h) END"
        return f"""{name} AS (
            SELECT row, tree, 0 AS level, pos, size, folded, proof FROM {start}
            UNION ALL
            SELECT w.row, w.tree, w.level + 1, w.pos // 2, (w.size + 1) // 2, {folded}, w.proof || coalesce(s.h, '')
            FROM {name} w LEFT JOIN {nodes} s
              ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)
            WHERE w.size > 1)"""

    return f"""
        WITH RECURSIVE leaf AS (
            SELECT doc_id, lang, {leaf('n_chars')} AS h,
                   CASE WHEN {CRC32} % 7 = 0 THEN {leaf('n_chars::HUGEINT + 1')} ELSE {leaf('n_chars')} END AS forged
            FROM documents),
        start AS (
            SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS size, forged AS folded, '' AS proof
            FROM leaf),
        {levels('nodes', 'start')},
        tops AS (SELECT -1 AS tree, tree AS pos, h, (SELECT max(tree) + 1 FROM start) AS size FROM nodes WHERE size = 1),
        {levels('upper_nodes', 'tops')},
        {way('climb', 'start', 'nodes')},
        at_top AS (SELECT row, -1 AS tree, tree AS pos, (SELECT max(tree) + 1 FROM start) AS size, folded, proof
                   FROM climb WHERE size = 1),
        {way('upper_climb', 'at_top', 'upper_nodes')}
        SELECT s.doc_id, s.h AS leaf, t.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256,
               u.folded AS folded_root, u.folded = r.h AS verified
        FROM start s JOIN tops t ON s.tree = t.pos JOIN upper_climb u ON u.row = s.row AND u.size = 1
        JOIN (SELECT h FROM upper_nodes WHERE size = 1) r ON TRUE"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": merkle_sql(),
        "op12_line_dedup": f"""
            WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
                           FROM documents),
            keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \\x09-\\x0D]+', ''),
                                                         '[ \\x09-\\x0D]+$', ''), '{UPPER}', '{LOWER}') AS key
                      FROM split),
            repeated AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
                         GROUP BY key HAVING count(DISTINCT doc_id) > 1)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner < doc_id) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no)
                                   FILTER (owner IS NULL OR owner >= doc_id), '')) AS kept_sha256
            FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id""",
        "op10_exact_dedup": f"""
            WITH plain AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t
                           FROM documents),
            own AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
            FROM plain JOIN own USING (t)""",
    }
