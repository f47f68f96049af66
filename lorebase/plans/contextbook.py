"""SQL queries on context packs, deltas, delivery caches, skills and hand-offs; same dialect as ``textbook``."""

from __future__ import annotations

_latest = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders"
_current = f"SELECT o.o_custkey AS task_id, l.l_linenumber AS place, l.l_partkey AS item FROM ({_latest}) o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.k = 1"
_before = f"SELECT o.o_custkey AS task_id, l.l_linenumber AS place, l.l_partkey AS item FROM ({_latest}) o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.k = 2"

BOOK: dict[str, str] = {
    # Context packs
    "fts_probe": "SELECT p.id, p.token, count(n.id) AS found FROM (SELECT id, lower(regexp_extract(note, '[A-Za-z0-9]{4,}', 0)) AS token FROM notes WHERE id = (SELECT max(id) FROM notes)) p LEFT JOIN notes n ON lower(n.note) LIKE concat('%', p.token, '%') GROUP BY p.id, p.token",
    "attach_entities": "SELECT l_orderkey AS memory_id, listagg(DISTINCT name, ',') WITHIN GROUP (ORDER BY name) AS entities FROM (SELECT l_orderkey, concat('p', CAST(l_partkey AS VARCHAR(20))) AS name FROM lineitem) t GROUP BY l_orderkey",
    "fingerprint": "SELECT l_orderkey AS pack_id, concat('sha256:', sha2(listagg(item, ',') WITHIN GROUP (ORDER BY item), 256)) AS fingerprint FROM (SELECT l_orderkey, concat(CAST(l_linenumber AS VARCHAR(9)), ':', CAST(l_partkey AS VARCHAR(20)), ':', l_returnflag) AS item FROM lineitem) t GROUP BY l_orderkey",
    # Sessions, tasks and checkpoints
    "checkpoint_build": f"SELECT o.o_custkey AS task_id, n.n_name AS repository, o.o_orderkey AS checkpoint FROM ({_latest}) o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.k = 1",
    "list_delta": f"SELECT DISTINCT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.item, b.item) AS item, CASE WHEN b.item IS NULL THEN 'added' ELSE 'removed' END AS change FROM ({_current}) a FULL JOIN ({_before}) b ON a.task_id = b.task_id AND a.item = b.item WHERE a.item IS NULL OR b.item IS NULL",
    "checkpoint_delta": f"SELECT a.task_id, a.place, a.item FROM ({_current}) a WHERE NOT EXISTS (SELECT 1 FROM ({_before}) b WHERE b.task_id = a.task_id AND b.item = a.item)",
    # Delivery cache
    "salvage_chunks": "SELECT conv_id, min(turn) AS first_turn, listagg(chunk, concat(chr(10), chr(10))) WITHIN GROUP (ORDER BY chunk) AS text FROM (SELECT conv_id, turn, concat(CASE WHEN turn < 10 THEN '0' ELSE '' END, CAST(turn AS VARCHAR(9)), ' ', role, ': ', text) AS chunk FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) t GROUP BY conv_id",
    # Skills and hand-offs
}
