"""Secret scans: fixed patterns, and a battery of randomness tests, with DataFrame operations only.

Runs of 20 or more key characters are candidates; where fixed patterns cover part of a run, each other piece of 20 or more is
one. Each is read in the narrowest encoding that holds its characters, and
tested for being drawn at random from that alphabet: chi-squared uniformity of its characters, number of runs above
and below the middle, serial correlation of neighbours. A candidate is a secret if no test rejects randomness, at a level shared
among the three, and if prose is rejected: the surprisal of its characters, by their frequencies in the long words of the
whole corpus, has a mean and a variance in proportion to the length under prose. Prose is rejected with false discoveries
controlled (Benjamini and Hochberg) within each class of lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.session import pin

# The kinds in order, with their patterns (Java syntax). A run of hex digits, or of capitals and digits
# after AKIA, is matched whole or not at all, so its least length stands in the pattern; a failing assignment still uses
# up its text, so its value's length is checked after matching.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LONG_WORD = r"[A-Za-z0-9+/_-]{12,}"
LEAST_CANDIDATE = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
# Encodings from narrow to wide: name, alphabet in value order, pattern.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", "^[0-9a-f]+$"),
    ("HEX", _DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    ("base32", _UPPER + "234567", "^[A-Z2-7]+$"),
    ("lower", _LOWER, "^[a-z]+$"),
    ("upper", _UPPER + _DIGITS, "^[A-Z0-9]+$"),
    ("base36", _DIGITS + _LOWER, "^[0-9a-z]+$"),
    ("base62", _DIGITS + _UPPER + _LOWER, "^[0-9A-Za-z]+$"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/-_", "."),
)
RANDOM_LEVEL = 0.003
DISCOVERY_RATE = 0.01
PROSE_FLOOR = 0.01
LENGTH_CLASSES = (32, 48, 80)
P_BINS = 400
# Tasks that share the copies of one text.
SALTS = 16


def _positions(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, in code points; null where there is none.

    Only a text that matches is split; the lengths of what lies between the matches give their places.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        found = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))
        return F.struct(end.alias("at"), F.concat(state["out"], found).alias("out"))

    pairs = F.transform(whole, lambda match, i: F.struct(F.get(gaps, i).alias("gap"), match.alias("match")))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pairs, start, step)["out"])


def _of_kind(kind: int):
    """Names the kind of a match; a function of one argument, as a second would be taken for the index."""
    return lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")
    )


def _spans(text: Column) -> Column:
    """All base spans and candidates of a text, as (start, end, kind, match)."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    assign = F.filter(_positions(text, ASSIGN), lambda s, i: F.length(F.get(value, i)) >= LEAST_VALUE)
    found = [assign, *[_positions(text, pattern) for pattern in (ACCESS, HEX, CANDIDATE)]]
    none = F.array().cast("array<struct<start:int,end:int,kind:int,match:string>>")
    return F.concat(*[F.coalesce(F.transform(spans, _of_kind(kind)), none) for kind, spans in enumerate(found)])


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (rational approximation, absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (
        t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    )
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _choose(of: Column, values: list[Column]) -> Column:
    out = F.when(of == 0, values[0])
    for k, value in enumerate(values[1:], 1):
        out = out.when(of == k, value)
    return out


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, statistics and ``p_random`` to rows with a string column ``match``."""
    match = F.col("match")
    found = F.when(F.rlike(match, F.lit(ENCODINGS[0][2])), 0)
    for k, (_, _, pattern) in enumerate(ENCODINGS[1:], 1):
        found = found.when(F.rlike(match, F.lit(pattern)), k)
    # padding belongs to no alphabet
    out = candidates.withColumn("match", F.regexp_replace(match, "=", "")).withColumn("encoding", found).withColumns({
        "n": F.length("match").cast("double"),
        "letters": _choose(F.col("encoding"), [F.lit(alphabet) for _, alphabet, _ in ENCODINGS]),
    })
    out = out.filter("n >= 2").withColumn("size", F.length("letters").cast("double"))
    codes = F.transform(F.split("match", ""), lambda c: (F.instr(F.col("letters"), c) - 1).cast("double"))
    counted = F.transform(F.split("letters", ""), lambda c: F.pow(F.length("match") - F.length(F.replace(F.col("match"), c, F.lit(""))), F.lit(2.0)))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    n, size = F.col("n"), F.col("size")
    out = out.withColumn("codes", F.filter(codes, lambda x: x >= 0)).withColumn("chi", total(counted) * size / n - n)
    next_codes = F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0)))
    middle = (size - 1) / 2
    mean = total(F.col("codes")) / n
    out = out.withColumns({
        "runs": 1 + total(F.zip_with(F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))), next_codes, lambda a, b: ((a > middle) != (b > middle)).cast("double"))),
        "high": total(F.transform("codes", lambda x: (x > middle).cast("double"))),
        "spread": total(F.transform("codes", lambda x: F.pow(x - mean, F.lit(2.0)))),
        "lagged": total(F.zip_with(F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))), next_codes, lambda a, b: (a - mean) * (b - mean))),
    })
    high, low = F.col("high"), n - F.col("high")
    expected = 1 + 2 * high * low / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    free = size - 1
    z_chi = (F.pow(F.col("chi") / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    z_runs = F.when(variance > 0, (F.col("runs") - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("spread") > 0, (F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    two_sided = lambda z: 2 * (1 - normal_cdf(F.abs(z)))
    return out.withColumns({"p_chi": 1 - normal_cdf(z_chi), "p_runs": two_sided(z_runs), "p_serial": two_sided(z_serial)}).withColumn(
        "p_random", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))
    ).drop("codes", "letters", "spread", "lagged", "high", "runs")


def prose_model(texts: DataFrame) -> DataFrame:
    """One row: the surprisal of each key character in the long words of all texts, and its mean and variance there.

    No character surprises more than one with a share of ``PROSE_FLOOR``, so a few digits or marks in a word don't tell.
    """
    characters = sorted(set("".join(alphabet for _, alphabet, _ in ENCODINGS)))
    long_words = texts.select(F.array_join(F.regexp_extract_all("text", F.lit(LONG_WORD), F.lit(0)), "").alias("w"))
    counts = long_words.agg(*[
        F.coalesce(F.sum(F.length("w") - F.length(F.replace("w", F.lit(c), F.lit("")))), F.lit(0)).alias(f"c{ord(c)}")
        for c in characters
    ])
    add = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    counted = counts.select(F.array(*[F.col(f"c{ord(c)}") + 1.0 for c in characters]).alias("k"))
    shares = counted.select(F.transform("k", lambda x: x / add(F.col("k"))).alias("q"))
    told = shares.select("q", F.transform("q", lambda x: -F.log(F.greatest(x, F.lit(PROSE_FLOOR)))).alias("s"))
    mean = add(F.zip_with("q", "s", lambda q, x: q * x))
    square = add(F.zip_with("q", "s", lambda q, x: q * x * x))
    return told.select(
        F.map_from_arrays(F.array(*[F.lit(c) for c in characters]), "s").alias("surprisal"), mean.alias("mean"),
        F.greatest(square - mean * mean, F.lit(1e-3)).alias("variance"),
    )


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """Adds ``secret``. p-values of prose are rounded up to ``P_BINS`` bins of their logarithm, so the step-up rule needs
    counts per bin and length class only, and is conservative."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(P_BINS), F.floor(-10 * F.log("p_prose")))).cast("int")
    length = F.lit(0)
    for bound in LENGTH_CLASSES:
        length = length + (F.col("n") > bound).cast("int")
    binned = tested.withColumns({"_bin": bin_, "_class": length})
    by_class = Window.partitionBy("_class")
    counts = binned.groupBy("_class", "_bin").agg(F.count("*").alias("k")).select(
        "_class", "_bin", F.sum("k").over(by_class).alias("m"),
        F.sum("k").over(by_class.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)).alias("at_most"),
    )
    cuts = counts.filter(F.exp(-F.col("_bin") / 10) <= rate * F.col("at_most") / F.col("m")).groupBy("_class").agg(
        F.min("_bin").alias("_cut")
    )
    # at most one row per length class is broadcast
    return binned.join(F.broadcast(cuts), "_class", "left").withColumn(
        "secret", F.coalesce((F.col("_bin") >= F.col("_cut")) & (F.col("p_random") > RANDOM_LEVEL), F.lit(False))
    )


def _pieces(run: Column, base: Column) -> Column:
    """What base spans, ordered by their start, leave of a run of key characters, in pieces as long as a candidate."""
    def piece(begin: Column, end: Column) -> Column:
        match = F.substring(run["match"], begin - run["start"] + 1, end - begin)
        whole = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(3).alias("kind"), match.alias("match")))
        none = F.array().cast("array<struct<start:int,end:int,kind:int,match:string>>")
        return F.when(end - begin >= LEAST_CANDIDATE, whole).otherwise(none)

    def step(state: Column, b: Column) -> Column:
        fresh = F.concat(state["out"], piece(state["at"], b["start"]))
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), fresh.alias("out"))

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,match:string>>")
    start = F.struct(run["start"].alias("at"), none.alias("out"))
    return F.aggregate(touching, start, step, lambda state: F.concat(state["out"], piece(state["at"], run["end"])))


def find_spans(found: DataFrame, texts: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """``_key, spans`` for each distinct text that holds any: its digest, and (start, kind, end) in order.

    ``found`` has ``_key, found``, base spans and candidates of each text with any; ``texts`` has the ``text`` of all, which tell
    what prose looks like. Copies of a text count once, so that each is a candidate of its own.
    """
    spans = pin(found.groupBy("_key").agg(F.any_value("found").alias("found")), "secrets")
    base = F.filter("found", lambda s: s["kind"] < 3)
    ordered = F.array_sort(base)
    loose = F.flatten(F.transform(F.filter("found", lambda s: s["kind"] == 3), lambda run: _pieces(run, ordered)))
    tested = battery(spans.select("_key", F.inline(loose)))
    tested = tested.crossJoin(F.broadcast(prose_model(texts)))  # one row
    surprise = F.aggregate(F.split("match", ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at("surprisal", c), F.lit(0.0)))
    z = (surprise - F.col("n") * F.col("mean")) / F.sqrt(F.col("n") * F.col("variance"))
    tested = tested.withColumn("p_prose", F.greatest(normal_cdf(-z), F.lit(1e-16))).drop("surprisal")
    tested = pin(tested, "secret-candidates")
    added = discoveries(tested, rate).filter("secret").select("_key", "start", F.lit(3).alias("kind"), "end")
    known = spans.select("_key", F.inline(F.transform(base, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")
    ))))
    return known.unionByName(added).groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    )


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scan_secrets(documents: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for every row of ``documents``.

    A null text is empty and has no spans; ids may be null or repeated, repeated rows give repeated rows, an empty table
    gives none and other columns are ignored. Spans are code points of the whole text, their ends exclusive.
    """
    rows = pin(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(_text()).alias("_key"), _spans(_text()).alias("found")
    ), "secret-rows")
    some = F.size("found") > 0
    spans = find_spans(rows.filter(some).select("_key", "found"), documents.select(_text().alias("text")), rate)
    name = F.array(*[F.lit(k) for k in KINDS])
    line = lambda array: F.array_join(F.transform(
        array, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = spans.select(
        "_key", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        line(F.filter("spans", lambda s: s["kind"] < 3)).alias("base"), line(F.col("spans")).alias("spans"),
    )
    columns = ["doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
               F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
    # rows without a possible span meet nothing; copies of one text are dealt to SALTS tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    dealt = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = rows.filter(some).select("doc_id", "_key", salt.alias("_salt")).join(dealt, ["_key", "_salt"], "left").select(*columns)
    empty = rows.filter(~some).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in told.dtypes if c != "_key"])
    return held.unionByName(empty.select(*columns))


def redact(documents: DataFrame, mark: str = "[SECRET]", rate: float = DISCOVERY_RATE) -> DataFrame:
    """``documents`` with every span of its texts replaced by ``mark``; overlapping spans become one mark.

    Columns and rows stay as they are but for ``text``, and ``n_chars`` where there is such a column. Only texts with a
    possible span are joined with their spans; the others are passed on without a shuffle.
    """
    possible = F.size(_spans(_text())) > 0
    found = documents.select(F.md5(_text()).alias("_key"), _spans(_text()).alias("found")).filter(F.size("found") > 0)
    spans = find_spans(found, documents.select(_text().alias("text")), rate)
    held = documents.filter(possible).withColumn("_llm_key", F.md5(_text())).join(
        spans.select(F.col("_key").alias("_llm_key"), F.col("spans").alias("_llm_spans")), "_llm_key", "left"
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, piece).otherwise(state["out"]).alias("out"))

    masked = F.aggregate("_llm_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    held = held.withColumn("text", F.when(F.col("_llm_spans").isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        held = held.withColumn("n_chars", F.when(F.col("_llm_spans").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return documents.filter(~possible).unionByName(held.select(*documents.columns))
