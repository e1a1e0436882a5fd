"""Find secrets by patterns and by a battery of randomness tests, with DataFrame functions alone.

Three patterns make the base. Beyond them, each run of 16 or more code-like characters is a candidate: its
encoding is inferred (digits, hex, base 32, base 36, base 64), and three statistics tell it from text in
that encoding: chi-squared of the characters against a uniform alphabet, the number of runs of
digits, capitals, small letters and others, and the correlation of neighbours. Each is in units of its standard
deviation under text, and their sum over the root of 3 gives a p-value under that hypothesis. The candidates of the whole corpus go
through a Benjamini-Hochberg step within classes of length, as short strings tell less. That step needs counts by
class and level only, a few hundred rows whatever the input. Shorter runs are left to the patterns: under 16 characters
the tests can't tell a random string from a rare word. Nor can they tell random digits from ordinary numbers, so digits alone are no finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Kind, pattern, group whose length counts, least length, in this order.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the longest runs: those of [0-9a-f]+ that are long enough
]
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
_EDGE = "|".join(f"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])" for c in ("0-9", "a-z", "A-Z"))
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_="
#: False discoveries allowed among the candidates reported; levels of -log10 p are an eighth apart; the last takes all from 31.9 on, far beyond any threshold.
FALSE_DISCOVERY, LEVELS = 0.001, 256
#: Under text: chance that two characters are equal, and that a character changes class.
TEXT_COLLISION, TEXT_CHANGE = 0.066, 0.2
#: Mean and standard deviation of the absolute value of a standard normal variable.
HALF_MEAN, HALF_SD = 0.7979, 0.6028


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "struct<start:int,kind:int,stop:int>"


def _spans(kind: int, pattern: str, group: int, least: int, text: str = "text") -> str:
    """SQL for the spans of a pattern's leftmost matches that don't overlap, in code points."""
    p = _sql(pattern)
    counted = f"regexp_extract_all({text}, {p}, {group})" if group else f"regexp_extract_all({text}, {p}, 0)"
    return f"""case when not {text} rlike {p} then cast(array() as array<{SPAN}>) else
        aggregate(arrays_zip(regexp_extract_all({text}, {p}, 0) as m, {counted} as g, split({text}, {p}, -1) as s),
        named_struct('at', 0, 'o', cast(array() as array<{SPAN}>)),
        (a, x) -> if(x['0'] is null, a, named_struct('at', a.at + length(x['2']) + length(x['0']), 'o', if(length(x['1']) < {least}, a.o,
            concat(a.o, array(named_struct('start', a.at + length(x['2']), 'kind', {kind}, 'stop', a.at + length(x['2']) + length(x['0']))))))),
        a -> a.o) end""".replace(" as m", "").replace(" as g", "").replace(" as s", "")


def _level(c: str) -> str:
    """SQL for the level of a candidate: eighths of -log10 of its p-value under text."""
    letters = f"filter(split({c}, ''), y -> y <> '')"
    k = f"""case when {c} rlike '^[0-9]+$' then 10 when {c} rlike '^([0-9a-f]+|[0-9A-F]+)$' then 16 when {c} rlike '^[A-Z2-7]+=*$' then 32
        when {c} rlike '^([0-9a-z]+|[0-9A-Z]+)$' then 36 else 64 end"""
    squares = f"aggregate(transform(array_distinct({letters}), y -> power(length({c}) - length(replace({c}, y, '')), 2)), 0.0D, (a, y) -> a + y)"
    runs = f"size(split({c}, '{_EDGE}', -1))"
    values = f"transform({letters}, y -> cast(instr('{ALPHABET}', y) as double))"
    return f"""aggregate(array(named_struct('n', cast(length({c}) as double), 'k', cast({k} as double), 'q', {squares}, 'r', cast({runs} as double), 'v', {values})), 0,
        (z, s) -> case when s.k = 10 then 0 else
            aggregate(array(named_struct(
                'u', (s.k + s.k * (s.n - 1) * {TEXT_COLLISION} - s.n - (s.k * s.q / s.n - s.n)) / sqrt(2 * (s.k - 1)),
                'r', (s.r - 1 - (s.n - 1) * {TEXT_CHANGE}) / sqrt((s.n - 1) * {TEXT_CHANGE} * {1 - TEXT_CHANGE}),
                'c', ({HALF_MEAN} - abs({_correlation('s.v')} + 1 / s.n) * sqrt(s.n)) / {HALF_SD})), 0,
                (y, t) -> cast({_eighths('(t.u + t.r + t.c) / sqrt(3D)')} as int)) end)"""


def _correlation(v: str) -> str:
    """Of neighbours in an array of doubles; 0 where it is constant."""
    mean = f"(aggregate({v}, 0.0D, (a, x) -> a + x) / size({v}))"
    return f"""aggregate(array({mean}), 0.0D, (o, m) -> coalesce(try_divide(
        aggregate(zip_with(slice({v}, 1, size({v}) - 1), slice({v}, 2, size({v}) - 1), (x, y) -> (x - m) * (y - m)), 0.0D, (a, x) -> a + x),
        aggregate({v}, 0.0D, (a, x) -> a + (x - m) * (x - m))), 0.0D))"""


def _eighths(z: str) -> str:
    """Eighths of -log10 of the upper tail of the normal law, by its asymptotic form from 1 on (exact to a few hundredths there), 0 below."""
    return f"""aggregate(array({z}), 0.0D, (o, z) -> if(z < 1, 0.0D, least({LEVELS - 1}.0D, floor(8 * (z * z / 2 + ln(sqrt(2 * pi()) * (z + 1 / (z + 2 / (z + 3 / (z + 4 / z)))))) / ln(10D)))))"""


#: Classes of length: under 20, 24, 32, 40, 64 characters, and beyond.
def _stratum(c: str) -> str:
    return f"case when length({c}) < 20 then 0 when length({c}) < 24 then 1 when length({c}) < 32 then 2 when length({c}) < 40 then 3 when length({c}) < 64 then 4 else 5 end"


def thresholds(documents: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """stratum and least level that Benjamini-Hochberg lets pass, over all candidates of the corpus."""
    from pyspark.sql import Window

    candidates = texts(documents).select(F.explode(F.expr(f"regexp_extract_all(text, {_sql(CANDIDATE)}, 0)")).alias("c"))
    counts = candidates.selectExpr(f"{_stratum('c')} stratum", f"{_level('c')} level").groupBy("stratum", "level").agg(F.count("*").alias("n"))
    per_class = Window.partitionBy("stratum")
    ranked = counts.withColumn("rank", F.sum("n").over(per_class.orderBy(F.desc("level")))).withColumn("all", F.sum("n").over(per_class))
    # every p-value of a level is at most 10^(-level / 8)
    passed = ranked.where((F.col("level") > 0) & (F.pow(F.lit(10.0), -F.col("level") / 8) <= F.col("rank") / F.col("all") * false_discovery))
    return passed.groupBy("stratum").agg(F.min("level").alias("level"))


def find(documents: DataFrame, false_discovery: float = FALSE_DISCOVERY, *keep: str) -> DataFrame:
    """doc_id, text, the named further columns, ``base`` and ``spans``: arrays of (start, kind, stop) by start, then kind; kind 3 is a random string outside the base."""
    least = thresholds(documents, false_discovery).select(F.map_from_entries(F.collect_list(F.struct("stratum", "level")))).scalar()
    d = texts(documents, *keep)
    base = "array_sort(concat(" + ", ".join(_spans(i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)) + "))"
    d = d.withColumn("base", F.expr(base)).withColumn("least", least)
    p = _sql(CANDIDATE)
    more = f"""case when not text rlike {p} then cast(array() as array<{SPAN}>) else
        aggregate(arrays_zip(regexp_extract_all(text, {p}, 0), split(text, {p}, -1)),
        named_struct('at', 0, 'o', cast(array() as array<{SPAN}>)),
        (a, x) -> if(x['0'] is null, a, named_struct('at', a.at + length(x['1']) + length(x['0']),
            'o', if({_level("x['0']")} < coalesce(try_element_at(least, {_stratum("x['0']")}), {LEVELS}), a.o,
                concat(a.o, array(named_struct('start', a.at + length(x['1']), 'kind', 3, 'stop', a.at + length(x['1']) + length(x['0']))))))),
        a -> a.o) end"""
    d = d.withColumn("more", F.expr(more))
    # A random string goes if a base span that starts no later reaches its end.
    spans = f"""case when size(more) = 0 then base else aggregate(array_sort(concat(base, more)), named_struct('reach', -1, 'o', cast(array() as array<{SPAN}>)),
        (a, x) -> if(x.kind = 3 and x.stop <= a.reach, a, named_struct('reach', if(x.kind < 3, greatest(a.reach, x.stop), a.reach), 'o', concat(a.o, array(x)))), a -> a.o) end"""
    return d.withColumn("spans", F.expr(spans)).drop("least", "more")


_NAMES = ", ".join(f"'{k}'" for k, *_ in KINDS) + ", 'random'"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({_NAMES}), x.kind + 1), x.start, x.stop)), ',')"


def scan(documents: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """Counts of base spans by kind, digest of the base spans, and all spans, for each row.

    Null or empty text has none (the digest is that of the empty string). A null doc_id stays null, repeated
    rows are scanned each, further columns are ignored, an empty table gives no rows. The base stays whatever
    the randomness tests say.
    """
    counts = [f"cast(size(filter(base, x -> x.kind = {i})) as long) n_{k}" for i, (k, *_) in enumerate(KINDS)]
    return find(documents, false_discovery).selectExpr("doc_id", *counts, f"sha2({_joined('base')}, 256) base_sha256", f"{_joined('spans')} spans", "cast(size(spans) - size(base) as long) n_random")


def redact(documents: DataFrame, mark: str = "[secret]", false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """The documents, their columns and order of columns, with each stretch of overlapping spans replaced by ``mark``; n_chars follows the text. Null text stays null."""
    names = documents.columns
    kept = documents.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c) for c in names]).alias("__row"))
    d = find(kept, false_discovery, "__row")
    cut = f"""aggregate(spans, named_struct('at', 0, 'o', cast(array() as array<string>)),
        (a, x) -> if(x.start < a.at, named_struct('at', greatest(a.at, x.stop), 'o', a.o),
            named_struct('at', x.stop, 'o', concat(a.o, array(substring(text, a.at + 1, x.start - a.at), {_sql(mark)})))),
        a -> concat(array_join(a.o, ''), substring(text, a.at + 1)))"""
    d = d.withColumn("__text", F.expr(f"case when __row.text is null then null when size(spans) = 0 then text else {cut} end"))
    new = {"text": F.col("__text")} | ({"n_chars": F.when(F.expr("size(spans) = 0"), F.col("__row.n_chars")).otherwise(F.length("__text").cast(documents.schema["n_chars"].dataType))} if "n_chars" in names else {})
    return d.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names])
