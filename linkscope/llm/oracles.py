"""SQL of operators that work level by level or round by round."""

from __future__ import annotations


def codebook_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codes by comparing every part with every entry in each round."""

    def assigned(n: int) -> str:
        gap = "list_transform(list_zip(x.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
        return f"""a{n} AS MATERIALIZED (
    SELECT row_id, part, place % {entries} AS entry, place // {entries} AS distance, w FROM (
        SELECT row_id, x.part, min(list_sum({gap})::BIGINT * {entries} + c.entry) AS place, any_value(x.w) AS w
        FROM x JOIN c{n} c ON c.part = x.part GROUP BY row_id, x.part))"""

    def moved(n: int) -> str:
        return f"""m{n} AS (
    SELECT part, entry, list(mean ORDER BY i) AS w FROM (
        SELECT part, entry, i, floor(sum(w[i])::DOUBLE / count(*))::BIGINT AS mean
        FROM a{n - 1}, (SELECT unnest(range(1, (SELECT any_value(len(w)) FROM x) + 1)) AS i) GROUP BY part, entry, i)
    GROUP BY part, entry
), c{n} AS MATERIALIZED (
    SELECT c.part, c.entry, coalesce(m.w, c.w) AS w
    FROM c{n - 1} c LEFT JOIN m{n} m ON m.part = c.part AND m.entry = c.entry)"""

    steps = [assigned(0)]
    for n in range(1, rounds + 1):
        steps += [moved(n), assigned(n)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row_id,
           list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (
    SELECT row_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS w
    FROM kept, (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (SELECT part, row_id AS entry, w FROM x WHERE row_id < {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds}),
coded AS (
    SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
    FROM a{rounds} GROUP BY row_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT digest FROM books) AS codebooks_sha256
FROM kept JOIN coded USING (row_id)
"""


# CRC-32 of a text of one-byte characters, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""


def manifest_sql(fanout: int = 16, source_levels: int = 6, root_levels: int = 3) -> str:
    """Levels written out, for up to ``fanout ** source_levels`` rows a source and ``fanout ** root_levels`` sources."""
    around = "OVER (PARTITION BY tree, place // {0} ORDER BY place ROWS BETWEEN {1})"
    before = around.format(fanout, "UNBOUNDED PRECEDING AND 1 PRECEDING")
    after = around.format(fanout, "1 FOLLOWING AND UNBOUNDED FOLLOWING")

    def level(name: str, n: int) -> str:
        """Nodes with their siblings, and the nodes of the next level."""
        return f"""{name}{n}s AS MATERIALIZED (
    SELECT *, count(*) OVER (PARTITION BY tree) AS width,
           coalesce(string_agg(hash, '') {before}, '') AS lefts, coalesce(string_agg(hash, '') {after}, '') AS rights
    FROM {name}{n}
), {name}{n + 1} AS MATERIALIZED (
    SELECT tree, place // {fanout} AS place,
           CASE WHEN width = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash
    FROM {name}{n}s GROUP BY tree, place // {fanout}, width)"""

    def text(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"

    def climb(name: str, n: int, source: str, start: str) -> str:
        """The proof and the folded hash with one more level."""
        return f"""{name}{n}p AS (
    SELECT p.* EXCLUDE (proof, folded), proof || s.lefts || s.rights AS proof,
           CASE WHEN s.width = 1 THEN folded ELSE sha256(s.lefts || folded || s.rights) END AS folded
    FROM {source} p JOIN {name}{n}s s ON s.tree = {"p.tree" if name == "t" else "0"}
     AND s.place = p.{start} // {fanout**n})"""

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(text(column) for column in ("doc_id", "source", "lang", "n_chars"))
    tree = [level("t", n) for n in range(source_levels)]
    forest = [level("f", n) for n in range(root_levels)]
    climbs = [climb("t", n, f"t{n - 1}p" if n else "leaves", "place") for n in range(source_levels)]
    last = f"t{source_levels - 1}p"
    climbs += [climb("f", n, f"f{n - 1}p" if n else last, "tree") for n in range(root_levels)]
    return f"""
WITH leaves AS MATERIALIZED (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf, '' AS proof,
           CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 5 = 0 THEN changed ELSE leaf END AS folded
    FROM (SELECT doc_id, source, sha256({head} || {text("text")}) AS leaf,
                 sha256({head} || coalesce(strlen(text)::VARCHAR || ':' || {lowered}, '-')) AS changed FROM documents)
), t0 AS (SELECT tree, place, leaf AS hash FROM leaves),
{", ".join(tree)},
f0 AS (SELECT 0 AS tree, tree AS place, hash FROM t{source_levels}),
{", ".join(forest)},
{", ".join(climbs)}
SELECT doc_id, leaf, sub.hash AS subroot, top.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = top.hash AS verified
FROM f{root_levels - 1}p p JOIN t{source_levels} sub ON sub.tree = p.tree JOIN f{root_levels} top ON true
"""
