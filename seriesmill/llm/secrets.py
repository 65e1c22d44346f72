"""Secret scans with DataFrame functions only: fixed kinds, and a battery of randomness tests for all else.

Fixed kinds are found leftmost and without overlap, each kind for itself: `assign` (a name like password or token, a sign, and a value of at least 8 characters), `access` (AKIA and capitals or digits, at least 16 characters in all) and `hex` (at least 32 lower-case hexadecimal digits).

The battery looks at every other run of at least 16 characters of base64 (also its url form). The encoding is inferred as the smallest of hexadecimal, base32, base36 and base64 that has all its characters; so a run of digits only is taken for hexadecimal, for which it lacks six digits: plain numbers are not findings. With its characters as numbers in that alphabet, three tests of randomness are made: a chi-squared test of uniformity (by equal pairs, to which chi-squared is linear and which is closer to normal for short runs), a runs test about the middle of the alphabet, and a test of serial correlation. The three are combined by Fisher's method; a run stays a candidate if that does not reject randomness at `REJECT`.

Short runs pass such tests whatever they are, so a finding also needs evidence against structure: the probability that structured text, in which two characters are equal twice as often as in random ones of the alphabet and at least as often as in prose, has so few equal pairs. It falls with the length of the run. Within each class of lengths (powers of two), of alphabets and of what a run is made of (letters, digits or both, so that the words of prose do not stand for the keys among mixed runs), over all candidates of the corpus, the findings are those that the Benjamini-Hochberg rule admits at a false-discovery rate of `RATE`. The rule works on counts of probabilities in steps of a quarter of a decade, taken at the step's upper end, so it needs one small table and no sorting.

Spans are code points, the end exclusive. A found run that overlaps a fixed one is left out; fixed ones stay whatever else is found. Null texts count as empty, and have no spans. Texts of any length are scanned whole, in time about linear in their length and spans: running sums are made in blocks (`SPAN_BLOCK`), overlaps are found by binary search, and texts are cut from pieces of `TEXT_BLOCK` characters. Repeated rows are each scanned and counted. An empty table gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "random"]
#: Fixed values.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
HEX_DIGITS, BASE32, BASE36 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: How often two characters of prose are equal.
PROSE_PAIRS = 0.065
REJECT, RATE = 0.01, 0.05
MARK = "[SECRET]"
SPAN_BLOCK, TEXT_BLOCK = 64, 4096


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, together: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array what those before it make together (a sum or a maximum, of numbers from 0 on; 0 for the first). Each block is run through by itself, then the blocks."""

    def running(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda s, x: F.struct(together(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def carried(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,out:array<int>>>").alias("out"))
        return F.aggregate(blocks, zero, lambda s, b: F.struct(together(s["at"], b["at"]).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), b["out"].alias("out")))).alias("out")), lambda s: s["out"])

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / SPAN_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: running(F.slice(v, k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK))))
        return F.flatten(F.transform(carried(blocks), lambda c: F.transform(c["out"], lambda x: together(x, c["at"]))))

    return _named(values, cut)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches; value is the pattern's second group for assign, else the match."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = [F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value")] if pattern == ASSIGN else []
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), matches.alias("match"), *values)

    def placed(parts: Column) -> Column:
        before = _before(F.transform(parts, lambda p: p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0))), _sum)
        full = F.zip_with(parts, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["match"])).alias("end"), p["value" if values else "match"].alias("value")))
        return F.filter(full, lambda p: p["end"].isNotNull())

    return F.when(text.rlike(pattern), _named(parts, placed)).otherwise(none)


def _spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end), in order; kind by its place in KINDS."""
    assign = F.filter(_places(text, ASSIGN), lambda p: F.length(p["value"]) >= 8)
    return F.array_sort(F.concat(_spans(assign, "assign"), _spans(_places(text, ACCESS), "access"), _spans(_places(text, HEX), "hex")))


def _reaches(spans: Column) -> Column:
    """The spans, which are in order, with the largest end of those before each (before) and of these and itself (reach)."""

    def reached(spans: Column) -> Column:
        before = _before(F.transform(spans, lambda b: b["end"]), F.greatest)
        return F.zip_with(spans, before, lambda b, at: F.struct(b["start"].alias("start"), b["end"].alias("end"), at.alias("before"), F.greatest(at, b["end"]).alias("reach")))

    return _named(spans, reached)


def _met(reaches: Column, p: Column) -> Column:
    """Whether any span overlaps p: whether the largest end of the spans that start before p's end lies beyond p's start."""
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(reaches) + 1)).cast("int") + 1)

    def halve(s: Column, _: Column) -> Column:
        return _named(F.floor((s["low"] + s["high"]) / 2).cast("int"), lambda m: F.when(s["low"] >= s["high"], s).when(F.get(reaches, m)["start"] < p["end"], F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high"))))

    last = F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(reaches).alias("high")), halve, lambda s: s["low"] - 1)
    return F.coalesce(F.get(reaches, F.greatest(last, F.lit(0)))["reach"] > p["start"], F.lit(False)) & (last >= 0)


def _upper_tail(z: Column) -> Column:
    """Probability that a standard normal value exceeds z (a usual polynomial, fixed values)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(z) * 0.2316419)
    poly = t * (t * (t * (t * (t * 1.330274429 - 1.821255978) + 1.781477937) - 0.356563782) + 0.319381530)
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, class, step, random) of the runs that the battery looks at: their class, the step of the probability of structure, and the combined probability of the three tests."""
    apart = lambda places: F.when(F.size(base) == 0, places).otherwise(_named(_reaches(base), lambda reaches: F.filter(places, lambda p: ~_met(reaches, p))))
    kept = _named(_places(text, RUN), apart)

    def encoding(p: Column) -> Column:
        value = F.translate(F.rtrim(p["value"], F.lit("=")), "-_", "+/")
        upper_hex = value.rlike("^[0-9A-F]+$")
        alphabet = F.when(value.rlike("^[0-9a-f]+$") | upper_hex, F.lit(HEX_DIGITS)).when(value.rlike("^[A-Z2-7]+$"), F.lit(BASE32)).when(value.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), F.lit(BASE36)).otherwise(F.lit(BASE64))
        folded = F.when(upper_hex | (~value.rlike("^[A-Z2-7]+$") & value.rlike("^[0-9A-Z]+$")), F.lower(value)).otherwise(value)
        made_of = F.when(~value.rlike("[0-9]"), 1).when(~value.rlike("[A-Za-z]"), 2).otherwise(0)
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), F.length(alphabet).cast("double").alias("k"), made_of.alias("made_of"), F.transform(F.split(folded, ""), lambda c: F.instr(alphabet, c).cast("double") - 1).alias("v"))

    def sums(p: Column) -> Column:
        n = F.size(p["v"])
        pairs = F.aggregate(F.transform(F.array_distinct(p["v"]), lambda c: F.size(F.filter(p["v"], lambda x: x == c)).cast("double")), F.lit(0.0), lambda total, c: total + c * (c - 1) / 2)
        follow = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(p["v"], i - 1).alias("a"), F.get(p["v"], i).alias("b")))
        mean = F.aggregate(p["v"], F.lit(0.0), lambda total, x: total + x) / n
        high = F.size(F.filter(p["v"], lambda x: x >= p["k"] / 2)).cast("double")
        return F.struct(*[p[c].alias(c) for c in ("start", "end", "k", "made_of", "v")], n.cast("double").alias("n"), pairs.alias("pairs"), follow.alias("follow"), mean.alias("mean"), high.alias("high"))

    # Each step names what the next one uses more than once, so the expression stays small.
    def moments(p: Column) -> Column:
        n = p["n"]
        runs = F.size(F.filter(p["follow"], lambda f: (f["a"] >= p["k"] / 2) != (f["b"] >= p["k"] / 2))).cast("double") + 1
        expected = p["high"] * (n - p["high"]) * 2 / n + 1
        square = F.aggregate(p["v"], F.lit(0.0), lambda total, x: total + (x - p["mean"]) * (x - p["mean"]))
        product = F.aggregate(p["follow"], F.lit(0.0), lambda total, f: total + (f["a"] - p["mean"]) * (f["b"] - p["mean"]))
        share = F.greatest(F.lit(2.0) / p["k"], F.lit(PROSE_PAIRS))
        named = {"all": n * (n - 1) / 2, "runs": runs, "expected": expected, "square": square, "product": product, "share": share}
        return F.struct(*[p[c].alias(c) for c in ("start", "end", "k", "made_of", "n", "pairs")], *[c.alias(name) for name, c in named.items()])

    def deviations(p: Column) -> Column:
        n, chance, common = p["n"], p["all"] / p["k"], p["all"] * p["share"]
        equal = (p["pairs"] - chance) / F.sqrt(chance * (F.lit(1.0) - F.lit(1.0) / p["k"]))
        spread = (p["expected"] - 1) * (p["expected"] - 2) / (n - 1)
        by_runs = F.when(spread > 0, F.try_divide(p["runs"] - p["expected"], F.sqrt(spread))).otherwise(F.lit(9.0))
        serial = F.when(p["square"] > 0, (F.try_divide(p["product"], p["square"]) + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        structure = (common - p["pairs"]) / F.sqrt(common * (F.lit(1.0) - p["share"]))
        group = (F.floor(F.log2(n)) * 1000 + p["k"] * 10 + p["made_of"]).cast("int")
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), group.alias("class"), F.array(equal, F.abs(by_runs), F.abs(serial), structure).alias("z"))

    def tails(p: Column) -> Column:
        return F.struct(*[p[c].alias(c) for c in ("start", "end", "class")], F.transform(p["z"], _upper_tail).alias("t"))

    def judged(p: Column) -> Column:
        least = F.lit(1e-300)
        equal, by_runs, serial, structure = (F.get(p["t"], F.lit(k)) for k in range(4))
        half = -(F.log(F.greatest(equal, least)) + F.log(F.least(F.greatest(by_runs * 2, least), F.lit(1.0))) + F.log(F.least(F.greatest(serial * 2, least), F.lit(1.0))))
        random = F.exp(-half) * (half * half / 2 + half + 1)
        step = F.floor(-F.log10(F.greatest(structure, least)) * 4).cast("int")
        return F.struct(*[p[c].alias(c) for c in ("start", "end", "class")], step.alias("step"), random.alias("random"))

    found = F.transform(F.transform(kept, encoding), sums)
    return F.transform(F.transform(F.transform(F.transform(found, moments), deviations), tails), judged)


def admitted_steps(scanned: DataFrame) -> DataFrame:
    """One row with a map from the class to the lowest step that the Benjamini-Hochberg rule admits. At most some 30 lengths times 9 alphabets and kinds, of 1,200 steps each, are counted."""
    steps = scanned.select(F.explode("runs").alias("r")).select("r.class", F.when(F.col("r.random") >= REJECT, F.col("r.step")).otherwise(0).alias("step")).groupBy("class", "step").count()
    rows = steps.groupBy("class").agg(F.collect_list(F.struct("step", "count")).alias("s"), F.sum("count").alias("m"))
    at_least = lambda step: F.aggregate(F.filter("s", lambda y: y["step"] >= step["step"]), F.lit(0).cast("bigint"), lambda total, y: total + y["count"])
    passing = F.filter("s", lambda x: F.pow(F.lit(10.0), -x["step"] / 4.0) * F.col("m") <= at_least(x) * RATE)
    lowest = rows.select("class", F.array_min(F.transform(passing, lambda x: x["step"])).alias("step")).where("step is not null")
    return lowest.agg(F.map_from_entries(F.collect_list(F.struct("class", "step"))).alias("admitted"))


def _scan(docs: DataFrame, columns: list[Column], text: Column) -> DataFrame:
    found = docs.select(*columns, F.coalesce(text, F.lit("")).alias("__text"))
    found = found.withColumn("__base", base_spans(F.col("__text")))
    return found.withColumn("__runs", candidates(F.col("__text"), F.col("__base")))


def _all_spans(base: Column, runs: Column, admitted: Column) -> Column:
    found = F.filter(runs, lambda r: (r["random"] >= REJECT) & (r["step"] >= F.element_at(admitted, r["class"])))
    return F.array_sort(F.concat(base, F.transform(found, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, base, spans): arrays of (start, kind, end) of the fixed kinds, and of these and the findings of the battery."""
    scanned = _scan(docs, [F.col(id_column).alias("id")], F.col(text_column)).select("id", F.col("__base").alias("base"), F.col("__runs").alias("runs"))
    scanned = materialize(scanned, "secrets")
    admitted = F.broadcast(admitted_steps(scanned))
    return scanned.join(admitted).select("id", "base", _all_spans(F.col("base"), F.col("runs"), F.col("admitted")).alias("spans"))


def describe(found: DataFrame) -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, base_sha256, spans) of find_secrets' rows: counts and listings of spans."""

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS[:3]]
    return found.select("id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _cut_out(blocks: Column, spans: Column) -> Column:
    """The text, which comes in blocks, with a mark in place of the spans, one for those that overlap."""

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / TEXT_BLOCK).cast("int")
        those = F.array_join(F.slice(blocks, first + 1, F.floor(end / TEXT_BLOCK).cast("int") - first + 1), "")
        return F.substring(those, start % TEXT_BLOCK + 1, end - start)

    kept = F.filter(spans, lambda b: b["start"] >= b["before"])
    until = F.get(spans, F.size(spans) - 1)["reach"]
    return F.concat(F.array_join(F.transform(kept, lambda b: F.concat(piece(b["before"], b["start"]), F.lit(MARK))), ""), piece(until, F.size(blocks) * TEXT_BLOCK))


def redact(docs: DataFrame, text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by a mark, and the size column, if there is one, brought up to date. Texts without spans stay as they are, nulls too. The rates need all texts before any is judged, so these are scanned for a small table of rates first, and once more to be changed; no copy of the texts is written."""
    row = docs.select(F.struct("*").alias("row"))
    scanned = _scan(row, [F.col("row")], F.col("row").getField(text_column)).select("row", F.col("__base").alias("base"), F.col("__runs").alias("runs"))
    found = scanned.join(F.broadcast(materialize(admitted_steps(scanned), "secrets")))
    found = found.select("row", F.coalesce(F.col("row").getField(text_column), F.lit("")).alias("text"), _all_spans(F.col("base"), F.col("runs"), F.col("admitted")).alias("spans"))
    cut = _named(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), lambda blocks: _named(_reaches(F.col("spans")), lambda spans: _cut_out(blocks, spans)))
    found = found.select("row", F.when(F.size("spans") > 0, cut).alias("cut"))
    changed = F.col("cut").isNotNull()
    out = F.col("row").withField(text_column, F.when(changed, F.col("cut")).otherwise(F.col("row").getField(text_column)))
    if size_column in docs.columns:
        size = F.length("cut").cast(docs.schema[size_column].dataType)
        out = out.withField(size_column, F.when(changed, size).otherwise(F.col("row").getField(size_column)))
    return found.select(out.alias("row")).select("row.*")
