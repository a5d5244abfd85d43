"""Queries on messages whose entities are known: the events write them piece by piece, so SQL tells places and texts without a pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import spans
from .registry import query
from .testlog import logs_of

SRC = ", src AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS clock FROM lg) "

# Pieces are SQL that both engines read, over k, user_id, pid, seq and clock (the time as text); a tuple holds the text of an entity.


def joined(pieces) -> str:
    texts = [p if isinstance(p, str) else p[0] for p in pieces]
    return "(" + " || ".join(texts) + ")" if texts else "''"


def hexed(value: str) -> str:
    return f"lpad(hex({value}), 8, '0')"


def known(name: str, entity: str, *pieces) -> None:
    rows = [f"SELECT seq, CAST(length({joined(pieces[:i])}) AS INT) AS start, {p[0]} AS text FROM src" for i, p in enumerate(pieces) if not isinstance(p, str)]

    @query(name, SRC + " UNION ALL ".join(rows))
    def _(spark, d):
        return spans.texts_of(logs_of(spark, d, joined(pieces)), entity).select("seq", "start", "text")


def words(name: str, entity: str, names: list[str], kind: str = "NULL") -> None:
    """Every word in turn, once by itself and once where it touches other letters, which is no match."""
    listed = ", ".join(f"'{n}'" for n in names)
    # At one place the shortest name wins.
    short = ", ".join(f"'{min((m for m in names if n == m or n.startswith(m + ' ')), key=len)}'" for n in names)
    place = f"CAST(seq % {len(names)} + 1 AS INT)"
    sql = f", src AS (SELECT seq, list_extract([{short}], {place}) AS text FROM lg) SELECT seq, 6 AS start, text, CAST({kind} AS VARCHAR) AS class FROM src"

    @query(name, sql)
    def _(spark, d):
        word = f"element_at(array({listed}), {place})"
        made = f"'seen: ' || {word} || ', x' || replace({word}, ' ', 'x') || 'x'"
        return spans.texts_of(logs_of(spark, d, made), entity).select("seq", "start", "text", "class")


def in_parts(name: str, entity: str, pieces, parts) -> None:
    """parts: name, what stands before it in the message, and its text ('' where it is missing)."""
    rows = [f"SELECT seq, '{entity}.{n}' AS entity, CAST(length({before}) AS INT) AS start, {text} AS text FROM src WHERE {text} <> ''" for n, before, text in parts]

    @query(name, SRC + " UNION ALL ".join(rows))
    def _(spark, d):
        found = spans.texts_of(logs_of(spark, d, joined(pieces)), entity).withColumn("entity", F.lit(entity))
        return spans.parts(found).select("seq", "entity", "start", "text")


ZONE = "CASE seq % 4 WHEN 0 THEN ' UTC' WHEN 1 THEN '+02:00' WHEN 2 THEN ' -0530' ELSE '' END"
LABEL = "CASE seq % 6 WHEN 0 THEN 'DETAIL:' WHEN 1 THEN 'HINT:' WHEN 2 THEN 'CONTEXT:' WHEN 3 THEN 'STATEMENT:' WHEN 4 THEN 'QUERY:' ELSE 'LOCATION:' END"
SIZE = "k || CASE seq % 5 WHEN 0 THEN ' bytes' WHEN 1 THEN ' kB' WHEN 2 THEN '.5 MB' WHEN 3 THEN 'GB' ELSE ' tb' END"
WAIT = "CASE seq % 3 WHEN 0 THEN 'waiting for' WHEN 1 THEN 'acquired' ELSE 'Lock timeout' END"
SELECT = "'duration: 1.0 ms  statement: SELECT a, '"

known("x2_timestamp", "timestamp", "'from '", (f"clock || {ZONE}",), "' to '", ("replace(substr(clock, 1, 19), ' ', 'T')",), "'; not '", "substr(clock, 1, 10)", "', nor 1:2'")
known("x3_pid", "pid", "'process '", ("'[' || pid || ']'",), "' and '", ("'[' || pid || '-' || k || ']'",), "', not [x'", "k", "'] nor '", "pid")
known("x4_context", "context", "'a '", (LABEL,), "' key '", "k", "' hint: QUERY '", "k", "'.'")
known("x8_memory", "memory", "'used '", (SIZE,), "' of '", ("user_id || ' kB'",), "', not '", "k", "' MBs'")
known("x13_lsn", "lsn", "'redo at '", (f"hex(k) || '/' || {hexed('seq')}",), "' up to '", ("hex(user_id) || '/' || hex(k)",), "', not 123456789/0'")
known("x14_wal_segment", "wal_segment", "'file '", (f"'00000001' || {hexed('seq')} || {hexed('k')}",), "' after 00000001'", hexed("seq"), "'.'")
known("x15_txid", "txid", "'xid '", ("CAST(seq AS STRING)",), "' Transaction: '", ("CAST(k AS STRING)",), "' xmin'", ("CAST(user_id AS STRING)",), "', xmaxed '", "k")
known("x19_sql_param", "sql_param", SELECT, ("'$' || k",), "' FROM t WHERE b = '", ("'$' || user_id",), "' AND c = 1'")
known("x21_sql_string", "sql_string", SELECT, ("'''it''''s ' || k || ''''",), "' FROM t WHERE b = '", ("'$q$' || user_id || '$q$'",), "' AND c = 1'")
known("x22_sql_number", "sql_number", SELECT, ("CAST(k AS STRING)",), "', '", ("k || '.25'",), "' FROM t'", "k", "' WHERE b = '", ("user_id || 'e-3'",), "' AND c < '", (f"'0x' || {hexed('k')}",))
known("x23_sql_operator", "sql_operator", SELECT, "'b'", "k", "' '", ("CASE seq % 4 WHEN 0 THEN '<>' WHEN 1 THEN '||' WHEN 2 THEN '>=' ELSE '::' END",), "' c FROM t WHERE d '", ("'='",), "' e'")
known("x25_lock_wait", "lock_wait", "'process 1 '", (WAIT,), "' lock '", "k", "'; '", ("'deadlock detected'",), "'; '", ("'process ' || k || ' still waiting'",), "'.'")
known("x29_null", "null", "'column a'", "k", "' is '", ("'NULL'",), "', was '", ("'null'",), "', nullable'")
known("x30_oid", "oid", "'type '", ("'OID ' || k",), "', '", ("'regclass=' || user_id",), "', '", ("'regproc: ' || k",), "', oid x'", "k")
known("x31_path", "path", "'file \"'", ("'/var/lib/pg' || k || '/base.1/' || user_id",), "'\", not /tmp'", "k", "' nor a/b/c'")

words("x6_error_name", "error_name", spans.ERROR_NAMES)
words("x18_backend", "backend", spans.BACKENDS)
words("x24_lock_type", "lock_type", spans.SHARED_LOCKS + spans.EXCLUSIVE_LOCKS, "CASE WHEN text IN ('RowExclusiveLock', 'ExclusiveLock', 'AccessExclusiveLock') THEN 'exclusive' ELSE 'share' END")
words("x26_checkpoint_words", "checkpoint", spans.CHECKPOINT)
words("x27_recovery", "recovery", spans.RECOVERY)

in_parts(
    "x2_timestamp_parts", "timestamp", ("'from '", f"clock || {ZONE}", "'.'"),
    [("date", "'from '", "substr(clock, 1, 10)"), ("time", "'from ' || substr(clock, 1, 11)", "substr(clock, 12, 8)"), ("ms", "'from ' || substr(clock, 1, 20)", "substr(clock, 21, 3)"),
     ("tz", "'from ' || clock || CASE WHEN seq % 2 = 0 THEN ' ' ELSE '' END", f"trim({ZONE})")],
)
in_parts("x8_memory_parts", "memory", ("'used '", "k", "'.5 '", "'MB.'"), [("value", "'used '", "k || '.5'"), ("unit", "'used ' || k || '.5 '", "'MB'")])
in_parts("x13_lsn_parts", "lsn", ("'redo at '", "hex(k)", "'/'", "hex(k)", "'.'"), [("segment", "'redo at '", "hex(k)"), ("offset", "'redo at ' || hex(k) || '/'", "hex(k)")])
