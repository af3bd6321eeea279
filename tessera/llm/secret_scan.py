"""Secret scan in DataFrame functions only: fixed patterns and a randomness test battery.

Three patterns (assignments, access keys, hex runs) give the base spans. The
battery then tests every longest run of 20 or more characters of one alphabet,
so that KEY=VALUE is two runs and a run of mixed alphabets is tested in each: the
encoding is inferred (hex, base32, base64, base64url), and under "drawn uniformly from the
encoding's alphabet" three tests must not reject: chi-squared of the symbol
counts, a runs test on the upper and lower half of the alphabet, and the lag-1
serial correlation of the code values. What passes is compared with ordinary
text of the same length: the number of equal pairs of symbols, whose mean and
spread under a text's letter frequencies depend on the length, gives a p-value.
Benjamini-Hochberg at level `fdr` over all tested runs of the corpus, in strata
of encoding and length, decides; it needs a histogram of p-values only.

Defined cases: a null text is empty and has no spans; positions are code points;
equal rows give equal results; the characters U+E000 and U+E001 in a text count
as any other character outside the patterns; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import row_key, staged

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A failing shorter match of these two lies in a run that holds no other match, so the length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Trailing padding; an = before more key characters ends a run.
_PADDING = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Longest runs of one alphabet: base64 ones (with letters and digits alone), and base64url ones that hold - or _.
CANDIDATES = (
    r"(?<![A-Za-z0-9+/])(?:(?=[A-Za-z0-9]*[+/])[A-Za-z0-9+/]{20,}+|(?<![_-])[A-Za-z0-9]{20,}+(?![_-]))" + _PADDING,
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{20,}+" + _PADDING,
)
KINDS = ("assign", "access", "hex", "random")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "base32": _UPPER + "234567",
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Of running text in European languages: the chance that two letters agree, and that three do.
TEXT_PAIR, TEXT_TRIPLE = 0.066, 0.0055
BATTERY_LEVEL = 0.001
FDR = 0.05
BINS_PER_DECADE = 20
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ufffd"
_CHUNK = 256


def spans_of(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds `out`: array<struct<start,stop,value>> of the pattern's leftmost non-overlapping matches.

    Matches are marked, the text is split at the marks, and starts are running
    sums of the parts' lengths, in chunks so that many matches stay cheap.
    """
    clean = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    marked = F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}")
    df = df.withColumn("_parts", F.when(F.col(text).rlike(pattern), F.split(marked, f"[{_OPEN}{_CLOSE}]")))
    df = df.withColumn("_lengths", F.expr("transform(_parts, p -> length(p))"))
    df = df.withColumn("_chunks", F.expr(f"transform(sequence(0, (size(_lengths) - 1) div {_CHUNK}), c -> slice(_lengths, c * {_CHUNK} + 1, {_CHUNK}))"))
    df = df.withColumn("_sums", F.expr("transform(_chunks, c -> aggregate(c, 0, (a, x) -> a + x))"))
    df = df.withColumn("_bases", F.expr("transform(_sums, (s, i) -> aggregate(slice(_sums, 1, i), 0, (a, x) -> a + x))"))
    df = df.withColumn("_starts", F.expr("flatten(zip_with(_chunks, _bases, (c, b) -> transform(c, (x, j) -> b + aggregate(slice(c, 1, j), 0, (a, y) -> a + y))))"))
    found = "transform(sequence(2, size(_parts) - 1, 2), i -> struct(_starts[i - 1] AS start, _starts[i - 1] + _lengths[i - 1] AS stop, _parts[i - 1] AS value))"
    empty = "cast(array() AS array<struct<start:int,stop:int,value:string>>)"
    df = df.withColumn(out, F.expr(f"CASE WHEN size(_parts) >= 3 THEN {found} ELSE {empty} END"))
    return df.drop("_parts", "_lengths", "_chunks", "_sums", "_bases", "_starts")


def scan_patterns(docs: DataFrame) -> DataFrame:
    """Base spans and candidates per row, without the text; staged, since two passes follow."""
    rows = docs.select("doc_id", row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    for out, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("base64", CANDIDATES[0]), ("base64url", CANDIDATES[1])):
        rows = spans_of(rows, "text", pattern, out)
    long_enough = F.filter("assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8)
    keep = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))
    return staged(rows.select("doc_id", "row_key", keep(long_enough).alias("assign"), keep("access").alias("access"), keep("hex").alias("hex"), F.concat("base64", "base64url").alias("candidates")), "secret-spans")


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the logistic approximation 1 / (1 + exp(1.5976 z + 0.07056 z^3))."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, n, the three tests' p-values, and the p-value against text; drops what has no encoding."""
    token = F.col("token")
    encoding = (
        F.when(token.rlike("^[0-9]+$"), F.lit(None))  # decimal numbers are counts and account numbers
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    df = candidates.withColumn("token", F.rtrim(F.col("token"), F.lit("="))).withColumn("encoding", encoding).where("encoding IS NOT NULL")
    df = df.withColumn("token", F.when(F.col("encoding") == "hex", F.lower("token")).otherwise(F.col("token"))).withColumn("alphabet", alphabets[F.col("encoding")])
    df = df.withColumn("n", F.length("token").cast("double")).where("n >= 16").withColumn("k", F.length("alphabet").cast("double"))
    df = df.withColumn("counts", F.expr("transform(filter(split(alphabet, ''), a -> a <> ''), a -> cast(length(token) - length(replace(token, a, '')) AS double))"))
    df = df.withColumn("codes", F.expr("transform(filter(split(token, ''), c -> c <> ''), c -> cast(locate(c, alphabet) - 1 AS double))"))
    df = df.withColumn("squares", F.expr("aggregate(counts, 0D, (a, c) -> a + c * c)")).withColumn("mean", F.expr("aggregate(codes, 0D, (a, v) -> a + v) / n"))
    df = df.withColumn("centred", F.expr("transform(codes, v -> v - mean)")).withColumn("high", F.expr("transform(codes, v -> v >= k / 2)"))
    df = df.withColumn("runs", F.expr("1 + aggregate(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high) - 1), (a, b) -> a <> b), 0, (s, x) -> s + cast(x AS int))"))
    df = df.withColumn("spread", F.expr("aggregate(centred, 0D, (a, v) -> a + v * v)"))
    df = df.withColumn("lagged", F.expr("aggregate(zip_with(slice(centred, 1, size(centred) - 1), slice(centred, 2, size(centred) - 1), (a, b) -> a * b), 0D, (s, x) -> s + x)"))
    n, k = F.col("n"), F.col("k")
    z_chi = (k / n * F.col("squares") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    z_runs = (F.col("runs") - (n + 1) / 2) / F.sqrt((n - 1) / 4)
    z_serial = F.when(F.col("spread") > 0, F.col("lagged") / F.col("spread") * F.sqrt(n)).otherwise(F.lit(99.0))
    pairs, equal = n * (n - 1) / 2, (F.col("squares") - n) / 2
    sd = F.sqrt(pairs * TEXT_PAIR * (1 - TEXT_PAIR) + n * (n - 1) * (n - 2) * (TEXT_TRIPLE - TEXT_PAIR**2))
    return (
        df.withColumn("p_chi", normal_tail(z_chi))
        .withColumn("p_runs", 2 * normal_tail(F.abs(z_runs)))
        .withColumn("p_serial", 2 * normal_tail(F.abs(z_serial)))
        .withColumn("looks_random", F.least("p_chi", "p_runs", "p_serial") * 3 > BATTERY_LEVEL)
        .withColumn("p_text", normal_tail((pairs * TEXT_PAIR - equal) / sd))
        .drop("alphabet", "counts", "codes", "centred", "high", "squares", "mean", "runs", "spread", "lagged", "k")
    )


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """Benjamini-Hochberg in strata of encoding and length (powers of two).

    The histogram has at most (encodings) x (31 lengths) x (bins) rows whatever
    the input, so its running counts and the broadcast of the cuts are small.
    """
    binned = (
        tested.withColumn("length_class", F.floor(F.log2("n")))
        .withColumn("p", F.when(F.col("looks_random"), F.col("p_text")).otherwise(F.lit(1.0)))
        .withColumn("bin", F.least(F.lit(20 * BINS_PER_DECADE), F.floor(-F.log10("p") * BINS_PER_DECADE)))
    )
    stratum = ["encoding", "length_class"]
    counts = binned.groupBy(*stratum, "bin").count()
    whole, below = Window.partitionBy(*stratum), Window.partitionBy(*stratum).orderBy(F.desc("bin"))
    level = F.sum("count").over(whole) * F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    cuts = counts.withColumn("found", level <= fdr * F.sum("count").over(below)).where("found").groupBy(*stratum).agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cuts), stratum).where(F.col("looks_random") & (F.col("bin") >= F.col("cut")))


def find_secrets(docs: DataFrame, *, fdr: float = FDR) -> DataFrame:
    """doc_id and the spans of each kind as array<struct<start,stop>>, in text order."""
    spans = scan_patterns(docs)
    candidates = spans.select("doc_id", "row_key", F.explode("candidates").alias("c")).select("doc_id", "row_key", F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.col("c.value").alias("token"))
    found = discoveries(battery(candidates), fdr).groupBy("row_key", F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("random"))
    both = spans.drop("candidates").join(found, (spans["row_key"] == found["row_key"]) & spans["doc_id"].eqNullSafe(found["_id"]), "left").drop(found["row_key"]).drop("_id")
    known = F.concat("assign", "access", "hex")
    new = F.filter(F.coalesce("random", F.array().cast("array<struct<start:int,stop:int>>")), lambda r: ~F.exists(known, lambda b: (b["start"] <= r["start"]) & (b["stop"] >= r["stop"])))
    return both.select("doc_id", "assign", "access", "hex", new.alias("random"))


def listed(*kinds: str) -> Column:
    """kind:start:end of the kinds' spans, by start, then kind as listed, comma-joined."""
    tagged = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), s["stop"].alias("stop")))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat(*[tagged(k) for k in kinds]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
