"""The few functions that Spark and DuckDB spell differently."""

from __future__ import annotations

import re

#: Spellings that differ: pattern, Spark's, DuckDB's.
DIALECT = (
    (r"octet_length\(encode\(content\)\)", "octet_length(content)", "octet_length(encode(content))"),
    (r"sentences\((\w+)\)", r"split(\1, '(?<=[.!?])[ \n\t]+')", r"split(regexp_replace(\1, '([.!?])[ \n\t]+', '\\1|', 'g'), '|')"),
    (r"rest\(split\((\w+), ' '\)\)", r"slice(split(\1, ' '), 2, size(split(\1, ' ')))", r"(split(\1, ' '))[2:]"),
    (r"squeeze\((regexp_extract\(m, '[^']*', 2\))\)", r"trim(regexp_replace(\1, '[ \n\t]+', ' '))", r"trim(regexp_replace(\1, '[ \n\t]+', ' ', 'g'))"),
    (r"\bexplode\(", "explode(", "unnest("),
    (r"\bbtrim\(", "btrim(", "trim("),
    (r"\bsha2\((.+?), 256\)", r"sha2(\1, 256)", r"sha256(\1)"),
    (r"\blistagg\((.+?)\) WITHIN GROUP \(ORDER BY ([^)]*)\)", r"listagg(\1) WITHIN GROUP (ORDER BY \2)", r"string_agg(\1 ORDER BY \2)"),
)


def spelled(sql: str, engine: int) -> str:
    """A query of the books as Spark (1) or DuckDB (2) spells it."""
    for forms in DIALECT:
        sql = re.sub(forms[0], forms[engine], sql)
    return sql
