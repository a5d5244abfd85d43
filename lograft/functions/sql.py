"""SQL inside log messages: where it stands, and its tokens."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A statement as a server logs it: how long it took, if that is logged, then what was done, the name of a prepared one, a colon.
TOOK = r"duration:\s*\d[\d.]*\s*ms\s+"
DONE = r"(?:statement|(?:execute|parse|bind)(?:\s+\S+?)?)\s*:\s*"
#: All that stands before the SQL of a message, and before that of one that begins with it.
BEFORE = rf"(?is)^(?:.*?\b{DONE}|DETAIL:\s*)"
AT_START = rf"(?is)^(?:{TOOK})?{DONE}"


#: Kinds of tokens in the order in which they are tried.
TOKENS = (
    ("whitespace", r"\s+"), ("comment", r"/\*.*?\*/|--[^\n]*"), ("string", r"\$\$.*?\$\$|\$(?<tag>[a-zA-Z_][a-zA-Z0-9_]*)\$.*?\$\k<tag>\$|'(?:[^']|'')*'"),
    ("quoted_identifier", r'"(?:[^"]|"")*"'), ("number", r"[0-9]+(?:\.[0-9]+)?"), ("word", r"[a-zA-Z_][a-zA-Z0-9_]*"),
    ("operator", r"<>|!=|<=|>=|\|\||::|[=<>+\-*/%!|:&^~]"), ("punctuation", r"[(),;.\[\]]"), ("unknown", r"."),
)


def region(message: Column) -> Column:
    """struct<prefix, sql, suffix> of the SQL in a message, null without any; the suffix is the white space at the end."""
    prefix = F.regexp_substr(message, F.lit(BEFORE))
    rest = F.substring(message, F.length(prefix) + 1, F.length(message))
    sql = F.regexp_replace(rest, r"\s+$", "")
    here = F.struct(prefix.alias("prefix"), sql.alias("sql"), F.substring(rest, F.length(sql) + 1, F.length(rest)).alias("suffix"))
    return F.when(prefix.isNotNull() & (sql != ""), here)


def probe(message: Column) -> Column:
    """struct<found, start>: whether a message begins like SQL, and where that SQL starts."""
    prefix = F.regexp_substr(message, F.lit(AT_START))
    return F.struct(prefix.isNotNull().alias("found"), F.coalesce(F.length(prefix), F.lit(0)).alias("start"))


#: Words that the server knows besides those of Spark's own table; fixed values.
SERVER_WORDS = (
    "ABSOLUTE", "ACCESS", "ACTION", "ATTACH", "BACKWARD", "CLOSE", "COALESCE", "COMMITTED", "CONCURRENTLY", "CONFLICT", "CONNECT", "CONVERSION",
    "COPY", "CURSOR", "DEALLOCATE", "DEFERRABLE", "DEFERRED", "DETACH", "DIAGNOSTICS", "DISABLE", "DISCARD", "DOMAIN", "ELSIF", "ENABLE", "EXCEPTION",
    "EXCLUSIVE", "EXTENSION", "FORCE", "FOREACH", "FORWARD", "GET", "GREATEST", "GROUPS", "INHERITS", "INITIALLY", "ISNULL", "ISOLATION", "LABEL",
    "LEAST", "LISTEN", "LOCKED", "MOVE", "NEXT", "NOTHING", "NOTIFY", "NOTNULL", "NOWAIT", "NULLIF", "OPERATOR", "OVERRIDING", "OWNER", "PERFORM",
    "POLICY", "PREPARE", "PRIOR", "PRIVILEGES", "PUBLICATION", "RAISE", "READ", "REINDEX", "RELATIVE", "RELEASE", "REPLICA", "RETURNING", "RULE",
    "SAVEPOINT", "SEQUENCE", "SERIALIZABLE", "SESSION", "SHARE", "SIMILAR", "SKIP", "SUBSCRIPTION", "SYSTEM", "TABLESPACE", "TEMP", "TEMPORARY",
    "TIES", "TRIGGER", "UNCOMMITTED", "UNLISTEN", "UPSERT", "USAGE", "VACUUM", "VALID", "VIRTUAL", "WORK",
)


def keywords(spark: SparkSession, more: tuple[str, ...] = SERVER_WORDS) -> list[str]:
    """Spark's own table of SQL keywords and the server's further ones."""
    return sorted({r[0].upper() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect()} | set(more))


def tokens(sql: Column, words: list[str]) -> Column:
    """array<struct<type, text, start, end>> that covers the text; words: the keywords, of which one before ( is a function."""
    whole = "(?s)" + "|".join(f"(?:{p})" for _, p in TOKENS)
    parts = F.regexp_extract_all(sql, F.lit(whole), F.lit(0))
    known = F.array(*[F.lit(w) for w in words])

    def kind(t, after):
        word = F.when(after == "(", "function").when(F.array_contains(known, F.upper(t)), "keyword").otherwise("identifier")
        # The first characters tell the kind, as the patterns are tried in order.
        return (
            F.when(t.rlike(r"^\s"), "whitespace").when(t.rlike(r"^(?:/\*.|--)"), "comment").when(t.rlike(r"(?s)^(?:\$.+\$|'.*')$"), "string")
            .when(t.rlike('(?s)^".*"$'), "quoted_identifier").when(t.rlike("^[0-9]"), "number").when(t.rlike("^[a-zA-Z_]"), word)
            .when(t.rlike(r"^(?:[=<>+\-*/%!|:&^~]{1,2})$"), "operator").when(t.rlike(r"^[(),;.\[\]]$"), "punctuation").otherwise("unknown")
        )

    none = F.array().cast("array<struct<type:string,text:string,start:int,end:int>>")
    pairs = F.arrays_zip(parts.alias("t"), F.concat(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array(F.lit(""))).alias("next"))

    def step(a, x):
        end = a["at"] + F.length(x["t"])
        one = F.struct(kind(x["t"], F.coalesce(x["next"], F.lit(""))).alias("type"), x["t"].alias("text"), a["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.filter(found, lambda x: x["text"].isNotNull())
