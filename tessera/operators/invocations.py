"""Script calls in the shell blocks of texts, and flags that their scripts do not declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What opens and closes a shell block, how a call starts, its script and its flags.
OPENS, CLOSES = "```bash", "```"
CALL = "py "
SCRIPT = r"([\w-]+\.py)"
FLAG = r"(?<![\w-])(--?[a-zA-Z][\w-]*)"


def flags_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FLAG), F.lit(1))


def shell_blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, body): what lies in the shell blocks of a text, with the number of its first line.

    A line that ends with OPENS opens a block when none is open; the next CLOSES ends
    it. A row is taken by itself: nothing is shuffled, sorted or kept for others.
    """
    whole = rf"(?s)\G(.*?){OPENS}\n(.*?){CLOSES}"
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    # lines of a block: those before it, and one for the line that opens it
    pairs = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(whole), F.lit(k)).alias(name) for k, name in ((1, "before"), (2, "body"))])
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<line_no:int,body:string>>").alias("found"))

    def add(seen: Column, x: Column) -> Column:
        at = seen["at"] + feeds(x["before"]) + 1
        return F.struct((at + feeds(x["body"])).alias("at"), F.concat(seen["found"], F.array(F.struct(at.alias("line_no"), x["body"].alias("body")))).alias("found"))

    return docs.select(key, F.inline(F.aggregate(pairs, none, add, lambda seen: seen["found"])))


def invocations(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, script, flags): the script calls of a document's shell blocks, lines that end with a backslash joined to the next."""
    lines = F.split("body", "\n", -1)
    # a backslash at the end of a block's last line joins nothing
    heads = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | ~F.endswith(F.get("_lines", i - 1), F.lit("\\")))
    commands = F.split("body", r"(?<!\\)\n", -1)
    split = shell_blocks(docs, key, text).withColumn("_lines", lines)
    each = split.select(key, "line_no", F.inline(F.arrays_zip(heads.alias("_head"), commands.alias("_c"))))
    command = F.btrim(F.replace("_c", F.lit("\\\n"), F.lit(" ")), F.lit(" \t\r\f\x0b"))
    called = each.select(key, (F.col("line_no") + F.col("_head")).alias("line_no"), command.alias("_c")).where(F.startswith("_c", F.lit(CALL)) & F.col("_c").rlike(SCRIPT))
    return called.select(key, "line_no", F.regexp_extract("_c", SCRIPT, 1).alias("script"), flags_of(F.col("_c")).alias("flags"))


def declared_flags(helps: DataFrame, script: str, text: str) -> DataFrame:
    """(script, flag) of the scripts' help texts; a script without flags has one row with none."""
    return helps.select(F.col(script).alias("script"), F.explode_outer(flags_of(F.col(text))).alias("flag")).distinct()


def undeclared(calls: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, line_no, script, flag): flags that the script does not declare; a null flag says that there is no such script."""
    scripts = declared.select("script").distinct()
    unknown = calls.join(scripts, "script", "left_anti").select(key, "line_no", "script", F.lit(None).cast("string").alias("flag"))
    used = calls.join(scripts, "script", "left_semi").select(key, "line_no", "script", F.explode(F.array_distinct("flags")).alias("flag"))
    return unknown.unionByName(used.join(declared, ["script", "flag"], "left_anti").select(key, "line_no", "script", "flag"))
