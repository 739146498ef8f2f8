"""Secret scans: fixed patterns, and a randomness test battery over long tokens; DataFrame functions only.

Patterns. assign, access and hex as the constants below say, leftmost and not overlapping for each kind; matches that
are too short are dropped after matching. Positions are code points, found from the lengths of what lies between the
matches (split by the same pattern), so every text is read whole and in time linear in it.

Battery. Candidates are runs of 20 and more characters of ``[A-Za-z0-9+/_=-]``. The encoding is inferred from the
characters that occur (lower-case, letters, decimal, hex, base32, alphanumeric, base64). Against that alphabet:
- chi-squared uniformity, as a normal deviate;
- runs above and below the alphabet's middle;
- serial correlation at lag 1.
A token that any test finds not random (two-sided, Bonferroni over the three) has no evidence. For the others, the
evidence is the probability that a text-like token of this length and encoding would be as uniform by chance: its
chi-squared exceeds the random one's by an amount that grows with the length. Benjamini-Hochberg control at rate
``RATE`` runs within classes of length, on a histogram of these probabilities (``CLASSES`` x ``LEVELS`` rows whatever
the data; probabilities are rounded up to the bin's edge). Tokens found are spans of kind ``random``, added to the
patterns' own.

Null text counts as empty: no spans, "" as digest input and span list. Repeated rows count as often as they occur in
the control. An empty table gives an empty result. Extra columns are kept but for those named like an output
(``assign``, ``access``, ``hex``, ``random``, ``candidates``, ``rid__``). No SQL stands beside the query, since its span
list has the battery's tokens too; tests hold patterns, battery and control against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, written

# The patterns of the three kinds; least characters (of group 2 for assign, else of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order they are tried: alphabet (its characters by rank), and the sum of squared shares of text-like tokens.
ENCODINGS = {
    "decimal": (DIGITS, 0.125),
    "hex": (DIGITS + "abcdef", 0.1),
    "hex_upper": (DIGITS + "ABCDEF", 0.1),
    "lower": (LOWER, 0.07),
    "base32": (UPPER + "234567", 0.065),
    "letters": (UPPER + LOWER, 0.06),
    "alphanumeric": (UPPER + LOWER + DIGITS, 0.055),
    "base64": (UPPER + LOWER + DIGITS + "+/", 0.05),
    "base64url": (UPPER + LOWER + DIGITS + "-_", 0.05),
    "mixed": (UPPER + LOWER + DIGITS + "+/-_", 0.05),
}
REJECT, RATE = 0.001, 0.05
CLASSES, LEVELS, STEP = (20, 28, 40, 64, 128), 400, 20.0
#: Sizes that ``running`` sums in one piece.
BLOCK = 64


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(sizes: Column, levels: int = 3) -> Column:
    """The sum of all sizes before each. Sums run within blocks of ``BLOCK`` and then over the blocks' totals, so up to ``BLOCK ** levels`` sizes take linear time."""
    none = F.expr("cast(array() as array<int>)")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    summed = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    if levels == 1:
        return summed(sizes)["out"]
    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    shifted = lambda blocks: F.zip_with(blocks, running(F.transform(blocks, lambda x: x["at"]), levels - 1), lambda x, by: F.transform(x["out"], lambda y: y + by))
    return F.when(F.size(sizes) > 0, F.flatten(_let(F.transform(starts, lambda i: summed(F.slice(sizes, i * BLOCK + 1, BLOCK))), shifted))).otherwise(none)


def _matches(text: Column, pattern: str, worth: Column, least: int, group: int = 0, token: bool = False) -> Column:
    """Spans start, end (and token) of a pattern's matches whose ``group`` has ``least`` characters; ``worth``: a cheap test that there may be any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None)
    read = F.struct(found.alias("m"), value.alias("v"), F.transform(F.split(text, pattern, -1), F.length).alias("between"))
    fields = "start:int,end:int,ok:boolean" + (",token:string" if token else "")

    def spans(x):
        def span(start_of):
            def one(m, i):
                start = F.get(start_of, i) + F.get(x["between"], i)
                parts = [start.alias("start"), (start + F.length(m)).alias("end"), (F.length(F.get(x["v"], i) if group else m) >= least).alias("ok")]
                return F.struct(*parts, *([m.alias("token")] if token else []))

            return F.filter(F.transform(x["m"], one), lambda s: s["ok"])

        sizes = F.transform(x["m"], lambda m, i: F.length(m) + F.get(x["between"], i))
        return _let(_let(sizes, lambda s: running(s)), span)

    return F.when(worth, _let(read, spans)).otherwise(F.expr(f"cast(array() as array<struct<{fields}>>)"))


def patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds assign, access, hex and candidates: arrays of spans (candidates with their tokens)."""
    text = F.col("text__")
    out = docs.withColumn("text__", whole_text(text_col))
    return out.select(
        *docs.columns,
        _matches(text, ASSIGN, text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), LEAST["assign"], 2).alias("assign"),
        _matches(text, ACCESS, text.contains("AKIA"), LEAST["access"]).alias("access"),
        _matches(text, HEX, text.rlike("[0-9a-f]{24}"), LEAST["hex"]).alias("hex"),
        _matches(text, CANDIDATE, text.rlike("[A-Za-z0-9+/_=-]{20}"), 20, 0, True).alias("candidates"),
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the normal law, for z of either sign; far tails by their asymptote."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    density = F.exp(-x * x / 2) * 0.3989422804014327
    series = density * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    tail = F.when(x > 4, density / x).otherwise(series)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, z_chi, z_runs, z_serial and level (hundredths of -log10 of the evidence by STEP) to rows with ``token``."""
    out = tokens.withColumn("body", F.regexp_replace("token", "=", ""))
    body = F.col("body")
    kind = None
    for name, (alphabet, _) in ENCODINGS.items():
        fits = body.rlike("^[" + alphabet.replace("-", r"\-") + "]+$")
        kind = F.when(fits, name) if kind is None else kind.when(fits, name)
    out = out.withColumn("encoding", kind)
    pick = lambda f: F.coalesce(*[F.when(F.col("encoding") == n, F.lit(f(*e))) for n, e in ENCODINGS.items()])
    out = out.withColumns({"alphabet": pick(lambda a, s: a), "k": pick(lambda a, s: float(len(a))), "squares": pick(lambda a, s: s), "n": F.length(body).cast("double")})
    out = out.where("n >= 2")
    counts = F.transform(F.split("alphabet", ""), lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"))
    out = out.withColumn("chi", F.col("k") / F.col("n") * F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) - F.col("n"))
    v = F.transform(F.split("body", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double") - (F.col("k") - 1) / 2)
    out = out.withColumn("v", v)
    after = F.slice("v", 2, F.size("v"))
    steps = F.zip_with(F.slice("v", 1, F.size("v") - 1), after, lambda a, b: F.struct((a * b).alias("product"), F.when((a >= 0) != (b >= 0), 1.0).otherwise(0.0).alias("turn")))
    out = out.withColumn("steps", steps)
    total = lambda col, f: F.aggregate(col, F.lit(0.0), lambda a, x: a + f(x))
    out = out.withColumns({"above": total("v", lambda x: F.when(x >= 0, 1.0).otherwise(0.0)), "turns": total("steps", lambda x: x["turn"]), "lag": total("steps", lambda x: x["product"]), "power": total("v", lambda x: x * x)})
    df, n, above, below = F.col("k") - 1, F.col("n"), F.col("above"), F.col("n") - F.col("above")
    out = out.withColumn("z_chi", (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    mean = 2 * above * below / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    out = out.withColumn("z_runs", F.when(variance > 0, (F.col("turns") + 1 - mean) / F.sqrt(variance)).otherwise(F.sqrt(n)))
    out = out.withColumn("z_serial", F.when(F.col("power") > 0, F.col("lag") / F.col("power") * F.sqrt(n)).otherwise(F.sqrt(n)))
    worst = F.greatest(F.abs("z_chi"), F.abs("z_runs"), F.abs("z_serial"))
    random = 3 * 2 * normal_tail(worst) > REJECT
    excess = (F.col("k") * F.col("squares") - 1) * n
    text_like = (F.col("chi") - (df + excess)) / F.sqrt(2 * (df + 2 * excess))
    evidence = -F.log10(F.greatest(normal_tail(-text_like), F.lit(1e-300)))
    level = F.when(random, F.least(F.floor(evidence * STEP), F.lit(LEVELS)).cast("int")).otherwise(0)
    return out.withColumn("level", level)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def discoveries(tested: DataFrame) -> DataFrame:
    """class, least: the level from which a length class's tokens are taken, by Benjamini-Hochberg; classes without discoveries are missing."""
    histogram = tested.groupBy(length_class(F.length("token")).alias("class"), "level").agg(F.count(F.lit(1)).alias("n"))
    bins = histogram.groupBy("class").agg(F.collect_list(F.struct("level", "n")).alias("bins"), F.sum("n").alias("m"))  # LEVELS + 1 bins at most
    reached = lambda b: F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + F.when(x["level"] >= b["level"], x["n"]).otherwise(0))
    passing = F.filter("bins", lambda b: (b["level"] > 0) & (F.pow(F.lit(10.0), -b["level"] / STEP) <= RATE * reached(b) / F.col("m")))
    return bins.select("class", F.array_min(F.transform(passing, lambda b: b["level"])).alias("least")).where("least is not null")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (without the text) with assign, access, hex and random: arrays of spans start, end."""
    outputs = ("assign", "access", "hex", "random", "candidates", "rid__")
    kept = [c for c in docs.columns if c.lower() not in outputs and c != text_col]
    found = patterns(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("scanned__")), "scanned__").drop("scanned__")
    found = written(found.withColumn("rid__", F.monotonically_increasing_id()), "matches")
    tokens = found.select("rid__", F.explode("candidates").alias("c")).select("rid__", "c.start", "c.end", "c.token")
    tested = written(battery(tokens).select("rid__", "start", "end", "token", "level"), "tested")
    least = discoveries(tested)
    taken = tested.withColumn("class", length_class(F.length("token"))).join(F.broadcast(least), "class").where("level >= least")  # a row for each length class
    random = taken.groupBy("rid__").agg(F.collect_list(F.struct("start", "end")).alias("random"))  # spans of one text
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(c)
    out = found.join(random, "rid__", "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], plain("assign"), plain("access"), plain("hex"), F.coalesce("random", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("random"))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans, by start, then by kind in the order of ``KINDS``."""
    ordered = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"))
    spans = F.concat(*[F.transform(k, ordered(KINDS.index(k))) for k in kinds])
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
