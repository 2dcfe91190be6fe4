"""DuckDB SQL of the pN_ queries that SQL can express on whole tables."""

_RANKED = r"""
SELECT row_id, lower(regexp_replace(author.id, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g')) AS author_id,
       greatest(coalesce(voteup_count, 0), 0) AS votes,
       row_number() OVER (PARTITION BY lower(regexp_replace(author.id, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g'))
                          ORDER BY greatest(coalesce(voteup_count, 0), 0) DESC, row_id) AS place
FROM zhihu_content
WHERE regexp_replace(coalesce(author.id, ''), '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g') <> ''
"""

ORACLES = {
    "p3_found": f"SELECT row_id FROM ({_RANKED}) WHERE place > 12",
    "p3_kept": f"""SELECT author_id, count(*) AS n_kept, max(votes) AS best_votes, min(votes) AS cutoff_votes
FROM ({_RANKED}) WHERE place <= 12 GROUP BY author_id""",
}
