"""Many patterns against many paths, as equi-joins.

A glob meets only paths that share its literal ends: whole folders before the first
wildcard, and up to four characters after the last one. A glob without either
shares its whole longest literal run: a path's parts of the lengths that such runs
have are looked up among them by hash. What meets is confirmed by the glob itself. A glob without any literal is one of few shapes, looked at by itself.

Defined cases: slashes are turned forward and dropped at both ends; `*` and `?` pass
slashes, `[...]` is a set and `[!...]` its complement, a bracket that is not closed
is literal; case counts; empty or null paths and patterns match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TAIL = 4
#: Distinct runs up to which their hashes go to every task; more of them are shuffled.
BROADCAST_RUNS = 1_000_000
#: Distinct globs of wildcards only that are looked at; more of them are an error, not a cut.
FREE_SHAPES = 1000
_SET = r"\[[^\]]+\]"


def glob_expression(glob: Column) -> Column:
    """Anchored regular expression of each row's glob."""
    parts = F.regexp_extract_all(glob, F.lit(rf"(?s){_SET}|."), F.lit(0))
    inner = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([\\&~\[])(?!$)", r"\\$1"), r"^\\\[", "["), r"^\[!", "[^")
    one = lambda p: F.when(p == "*", ".*").when(p == "?", ".").when(F.length(p) > 1, inner(p)).otherwise(F.regexp_replace(p, r"([\\.^$+(){}|\[\]])", r"\\$1"))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(parts, one), ""), F.lit(r"\z"))


def _folders(path: Column) -> Column:
    """The path's leading folders, the empty one first; each ends with a slash."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))


def _parts(text: Column, lengths: list[int]) -> Column:
    """Hashes of the text's parts of the given lengths."""
    none = F.array().cast("array<long>")
    each = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(F.substr(text, i, F.lit(n))))).otherwise(none)
    return F.array_distinct(F.concat(none, *[each(n) for n in lengths]))


def _patterns(patterns: DataFrame, pattern: str) -> DataFrame:
    own = patterns.select(F.col(pattern).alias("pattern")).distinct().withColumn("_glob", T.normal_path(F.col("pattern"))).where("_glob <> ''")
    wild = F.regexp_replace("_glob", _SET, "?")
    before, after = F.regexp_extract(wild, r"(?s)^([^*?]*)", 1), F.regexp_extract(wild, r"(?s)([^*?]*)$", 1)
    runs = F.array_sort(F.split(wild, "[*?]"), lambda a, b: F.length(b) - F.length(a))
    own = own.select("pattern", "_glob", glob_expression(F.col("_glob")).alias("_regex"), wild.alias("_wild"), F.regexp_extract(before, r"(?s)^(.*/)", 1).alias("_head"), F.when(wild == before, F.lit("")).otherwise(F.right(after, F.lit(TAIL))).alias("_tail"), F.get(runs, F.lit(0)).alias("_run"))
    # a glob without wildcards is a path: its folder and its last characters
    own = own.withColumn("_tail", F.when(F.col("_wild").rlike("[*?]"), F.col("_tail")).otherwise(F.right("_glob", F.lit(TAIL))))
    kind = F.when((F.col("_head") != "") | (F.col("_tail") != ""), "ends").when(F.col("_run") != "", "run").otherwise("free")
    return own.withColumn("_kind", kind).withColumn("_key", F.xxhash64("_run"))


def glob_pairs(paths: DataFrame, path: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, path): each distinct path with every pattern that matches it, both as they were given."""
    own = paths.select(F.col(path).alias("path")).distinct().withColumn("_path", T.normal_path(F.col("path"))).where("_path <> ''")
    globs = _patterns(patterns, pattern)
    tails = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.least(F.lit(TAIL), F.length("_path"))), lambda n: F.right(F.col("_path"), n)))
    keys = own.withColumn("_head", F.explode(_folders(F.col("_path")))).withColumn("_tail", F.explode(tails))
    by_ends = globs.where("_kind = 'ends'").join(keys, ["_head", "_tail"])
    runs = globs.where("_kind = 'run'")
    sizes = runs.groupBy(F.length("_run").alias("n")).agg(F.count_distinct("_key").alias("runs")).collect()
    keys_of = lambda df: df.withColumn("_key", F.explode(_parts(F.col("_path"), sorted(r.n for r in sizes))))
    known = runs.select("_key").distinct()
    # most parts are no glob's run and go before anything is shuffled
    few = keys_of(own).join(F.broadcast(known) if sum(r.runs for r in sizes) <= BROADCAST_RUNS else known, "_key", "left_semi")
    by_run = runs.join(few, "_key")
    out = [x.where(F.expr("_path rlike _regex")).select("pattern", "path") for x in (by_ends, by_run)]
    free = globs.where("_kind = 'free'")
    shapes = [(r.pattern, r._regex) for r in free.select("pattern", "_regex").limit(FREE_SHAPES + 1).collect()]
    if len(shapes) > FREE_SHAPES:
        raise ValueError(f"more than {FREE_SHAPES} globs hold nothing but wildcards")
    pairs = out[0].unionByName(out[1])
    if shapes:
        fits = F.filter(F.array(*[F.when(F.col("_path").rlike(regex), F.lit(p)) for p, regex in shapes]), lambda p: p.isNotNull())
        pairs = pairs.unionByName(own.select(F.explode(fits).alias("pattern"), "path"))
    return pairs


def controls_in_scope(controls: DataFrame, key: str, protects: str, entry_points: str, scope: DataFrame, path: str) -> DataFrame:
    """The keys of controls that a scope path touches: a glob of `protects` matches it, or an entry point is it or lies below it."""
    own = scope.select(T.normal_path(F.col(path)).alias("_path")).where("_path <> ''").distinct()
    globs = controls.select(key, F.explode(protects).alias("pattern"))
    hit = globs.join(glob_pairs(own, "_path", globs, "pattern").select("pattern").distinct(), "pattern", "left_semi").select(key)
    points = controls.select(key, F.explode(entry_points).alias("_point")).withColumn("_point", T.normal_path(F.col("_point"))).where("_point <> ''")
    above = points.select(key, F.explode(_folders(F.col("_point"))).alias("_path")).select(key, F.rtrim("_path", F.lit("/")).alias("_path")).where("_path <> ''")
    return hit.unionByName(above.join(own, "_path", "left_semi").select(key)).distinct()


#: Characters by which a probe meets the places of a text.
PROBE_KEY = 6


def contained_in(texts: DataFrame, text: str, probes: DataFrame, probe: str) -> DataFrame:
    """(text, probe): each distinct text with every distinct probe that it contains.

    A probe meets the places of a text by its first PROBE_KEY characters (or all of
    fewer) and is compared with what stands there. Work grows with the texts times
    the number of key lengths, six at most, however many lengths the probes have;
    texts are paths and lines, so they travel with their places.
    """
    own = probes.select(F.col(probe).alias("probe")).where(F.length(probe) > 0).distinct().withColumn("_key", F.substring("probe", 1, PROBE_KEY))
    lengths = sorted(r[0] for r in own.select(F.length("_key")).distinct().collect())
    known = texts.select(F.col(text).alias("text")).where(F.length(text) > 0).distinct()
    none = F.array().cast("array<string>")
    at = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substr(F.col("text"), i, F.lit(n)))).otherwise(none)
    places = known.select("text", F.explode(F.array_distinct(F.concat(none, *[at(n) for n in lengths]))).alias("_key"))
    return places.join(own, "_key").where(F.expr("contains(text, probe)")).select("text", "probe")


def contained(texts: DataFrame, text: str, probes: DataFrame, probe: str) -> DataFrame:
    """The distinct probes that some text contains, as one column `probe`."""
    return contained_in(texts, text, probes, probe).select("probe").distinct()
