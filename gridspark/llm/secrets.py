"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests singles out.

Everything is DataFrame functions. One scan splits every whole text at the patterns; from the lengths
of the parts, spans follow as running sums. Long tokens are candidates of the battery. Each is read
in the smallest alphabet that holds its characters, and tested there:

* chi-squared uniformity of the alphabet, runs above and below the alphabet's middle, and lag-one
  serial correlation; a token that any of them (Bonferroni over the three) finds non-random at
  ``RANDOM_LEVEL`` is none;
* the chance that written language would look as uniform at this length. Language repeats characters
  at least ``REPETITION`` times as often as chance, which sets the chi-squared mean it would have; a
  short token can't stand out, a long one does. These chances are controlled for false discoveries at
  ``DISCOVERY_RATE`` by Benjamini-Hochberg within each class of lengths. The step-up needs only counts
  of chances per quarter power of two, so classes of any size meet as a small histogram.

Defined results: a null text is empty; repeated rows are scanned each; an empty table gives no rows.
Spans are code points, end exclusive. Extra columns are ignored (or kept by :func:`redact`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import table
from gridspark.session import materialize, release

# The patterns of the base kinds, in their order. Runs of at least the wanted length are the longest
# runs of the open pattern that reach it, so the bound stands in the pattern for two of them.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE = 6

RANDOM_LEVEL = 0.001
DISCOVERY_RATE = 0.01
REPETITION = 1.8
LANGUAGE_COINCIDENCE = 0.066
BINS = 400

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets of the encodings, smallest first.
ENCODINGS = (
    ("digits", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("any", _UPPER + _LOWER + _DIGITS + "+/-_="),
)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the classic polynomial in 1 / (1 + 0.2316419 z)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = poly * F.exp(-a * a / 2) * 0.3989422804014327
    return F.when(z >= 0, q).otherwise(1 - q)


def _pieces(pattern: str, group: int) -> Column:
    """Lengths of the text before each match and of the match, and the chosen group of it."""
    text = F.col("_text")
    before = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    rest = F.regexp_extract_all(text, F.lit(f"({pattern})"), group)
    zipped = F.arrays_zip(before.alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("size"), rest.alias("value"))
    return F.when(text.rlike(pattern), F.filter(zipped, lambda z: z["size"].isNotNull()))


def scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, a row number and the matched parts of every text, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(*keep, F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    found = rows.select(
        *keep,
        "_row",
        _pieces(ASSIGN, 2).alias("assign"),
        _pieces(ACCESS, 1).alias("access"),
        _pieces(HEX, 1).alias("hex"),
        _pieces(CANDIDATE, 1).alias("random"),
    )
    return materialize(found, "secret-parts")


def _spans(found: DataFrame, kind: str) -> DataFrame:
    """_row, start, end and value of every match of one kind."""
    rows = found.where(F.col(kind).isNotNull()).select("_row", F.posexplode(kind).alias("pos", "m"))
    so_far = Window.partitionBy("_row").orderBy("pos")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(so_far)
    rows = rows.select("_row", end.alias("end"), F.col("m.size").alias("size"), F.col("m.value").alias("value"))
    return rows.select("_row", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (a column ``value``) with encoding, length and the chances of the tests.

    p_random: the least of the three randomness tests' chances times three; p_language: the chance
    that language of this length would look as uniform.
    """
    token = F.regexp_replace("value", "=+$", "")
    rows = tokens.withColumn("_t", token)
    name, alphabet = F.lit("any"), F.lit(ENCODINGS[-1][1])
    for n, letters in reversed(ENCODINGS[:-1]):
        fits = F.col("_t").rlike("^[" + letters.replace("-", r"\-") + "]+$")
        name, alphabet = F.when(fits, F.lit(n)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumn("encoding", name).withColumn("_a", alphabet)
    rows = rows.withColumn("_k", F.length("_a").cast("double")).withColumn("n", F.length("_t").cast("double"))
    squares = F.aggregate(
        F.split("_a", ""),
        F.lit(0.0),
        lambda s, c: s + F.pow(F.col("n") - F.length(F.replace(F.col("_t"), c, F.lit(""))), F.lit(2.0)),
    )
    half = F.floor(F.col("_k") / 2).cast("int")
    mask = F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), F.col("_k").cast("int") - half))
    rows = rows.withColumn("_x2", F.col("_k") / F.col("n") * squares - F.col("n")).withColumn("_mask", mask)
    rows = rows.withColumn("_b", F.expr("translate(_t, _a, _mask)"))
    turns = (2 * F.length("_b") - F.length(F.replace("_b", F.lit("01"), F.lit(""))) - F.length(F.replace("_b", F.lit("10"), F.lit("")))) / 2
    rows = rows.withColumn("_runs", 1 + turns).withColumn("_ones", F.length(F.replace("_b", F.lit("0"), F.lit(""))).cast("double"))
    index = F.transform(F.split("_t", ""), lambda c: F.instr(F.col("_a"), c).cast("double"))
    rows = rows.withColumn("_i", index)
    total = F.aggregate("_i", F.lit(0.0), lambda s, v: s + v)
    second = F.aggregate("_i", F.lit(0.0), lambda s, v: s + v * v)
    paired = F.zip_with("_i", F.expr("slice(_i, 2, greatest(size(_i) - 1, 0))"), lambda a, b: a * F.coalesce(b, F.lit(0.0)))
    products = F.aggregate(paired, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumns({"_s": total, "_s2": second, "_p": products})

    n, df = F.col("n"), F.col("_k") - 1
    cube = F.cbrt(F.greatest(F.col("_x2"), F.lit(0.0)) / df)
    uniform = upper_tail((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    ones, zeros = F.col("_ones"), n - F.col("_ones")
    mean = 2 * ones * zeros / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    runs = F.when((ones == 0) | (zeros == 0), F.pow(F.lit(0.5), n - 1)).otherwise(
        2 * upper_tail(F.abs(F.col("_runs") - mean) / spread)
    )
    centre = F.col("_s") / n
    variance = F.col("_s2") - n * centre * centre
    serial = (F.col("_p") - n * centre * centre) / F.greatest(variance, F.lit(1e-9))
    serial_p = F.when(variance <= 0, F.lit(0.0)).otherwise(2 * upper_tail(F.abs(serial + 1 / n) * F.sqrt(n)))
    excess = F.greatest(F.col("_k") * LANGUAGE_COINCIDENCE, F.lit(REPETITION)) - 1
    away = (n - 1) * excess
    language = upper_tail(-(F.col("_x2") - df - away) / F.sqrt(2 * df + 4 * away))
    out = rows.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial_p)))
    out = out.withColumn("p_language", F.greatest(language, F.lit(1e-30)))
    # Nothing but padding: neither test applies.
    empty = F.col("n") < 2
    out = out.withColumn("p_random", F.when(empty, 0.0).otherwise(F.col("p_random")))
    out = out.withColumn("p_language", F.when(empty, 1.0).otherwise(F.col("p_language")))
    return out.drop("_t", "_a", "_k", "_x2", "_mask", "_b", "_runs", "_ones", "_i", "_s", "_s2", "_p")


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-4 * F.log2(p))).cast("int")


def discoveries(tested: DataFrame, rate: float = DISCOVERY_RATE) -> Column:
    """Which rows of ``tested`` (n, p_language) are discoveries at this rate within their length class.

    Chances are rounded up to quarter powers of two, so the rate holds. The histogram has at most
    ``BINS`` + 1 rows per class, and classes double in length.
    """
    rows = tested.select(F.floor(F.log2("n")).cast("int").alias("c"), _bin(F.col("p_language")).alias("b"))
    counts = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("m"))
    above = Window.partitionBy("c").orderBy(F.col("b").desc())
    counts = counts.withColumn("found", F.sum("m").over(above)).withColumn("all", F.sum("m").over(Window.partitionBy("c")))
    passing = counts.where(F.pow(F.lit(2.0), -F.col("b") / 4) <= rate * F.col("found") / F.col("all"))
    least = passing.groupBy("c").agg(F.min("b").alias("b")).collect()  # one row per class
    limit = F.lit(BINS + 1)
    for r in least:
        limit = F.when(F.floor(F.log2("n")) == r["c"], F.lit(r["b"])).otherwise(limit)
    return _bin(F.col("p_language")) >= limit


def secret_spans(found: DataFrame) -> DataFrame:
    """_row, kind (its position in ``KINDS``), start, end of every secret of scanned texts."""
    parts = []
    for k, kind in enumerate(KINDS[:3]):
        spans = _spans(found, kind)
        if kind == "assign":
            spans = spans.where(F.length("value") >= ASSIGN_VALUE)
        parts.append(spans.select("_row", F.lit(k).alias("kind"), "start", "end"))
    tested = materialize(
        battery(_spans(found, "random")).select("_row", "start", "end", "n", "p_random", "p_language"), "secret-tests"
    )
    random = tested.where(discoveries(tested) & (F.col("p_random") >= RANDOM_LEVEL))
    parts.append(random.select("_row", F.lit(3).alias("kind"), "start", "end"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(
        spans,
        lambda s: F.concat(
            F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
        ),
    )
    return F.array_join(text, ",")


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, spans (array of start, kind, end in order) of every row of ``documents``."""
    found = scan(documents, ["doc_id"])
    spans = secret_spans(found).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    )
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("doc_id", "_row").join(spans, "_row", "left").select(
        "doc_id", F.coalesce("spans", empty).alias("spans")
    )


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret replaced by ``mark`` (spans that touch become one)."""
    # Rows of one id and one text have the same secrets, so these two are the key to join on.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text)
    found = scan(documents.select("doc_id", key.alias("_h"), "text"), ["doc_id", "_h"])
    spans = secret_spans(found).select(F.col("_row").alias("_key"), "start", "end")
    earlier = Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(earlier)
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = spans.withColumn("opens", opens)
    upto = Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = marked.withColumn("g", F.sum("opens").over(upto)).groupBy("_key", "g").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    lists = merged.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    rows = found.select(F.col("_row").alias("_key"), F.col("doc_id").alias("_d"), F.col("_h").alias("_g"))
    lists = materialize(rows.join(lists, "_key").drop("_key").dropDuplicates(["_d", "_g"]), "secret-cuts")
    release(found)
    cut = "_".join(["", *documents.columns])  # longer than any column's name
    lists = lists.withColumnRenamed("_cut", cut)
    on = documents["doc_id"].eqNullSafe(lists["_d"]) & (key == lists["_g"])
    joined = documents.join(lists, on, "left")
    end = f"if(i = 1, 0, element_at(`{cut}`, greatest(i - 1, 1)).end)"
    kept = F.expr(
        f"transform(sequence(1, size(`{cut}`)), i -> substring(text, {end} + 1, element_at(`{cut}`, i).start - {end}))"
    )
    tail = F.expr(f"substring(text, element_at(`{cut}`, -1).end + 1)")
    clean = F.when(lists[cut].isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), tail))
    return joined.select(*[clean.alias(c) if c == "text" else documents[c] for c in documents.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, counted and listed."""
    rows = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
