"""Column profiles of loads: standard aggregates, induced expressions, and what has changed between loads.

A column's expression is a set of alternatives, chosen by minimum description length over the distinct values of all loads together. An alternative
belongs to a shape: a value with every run of digits written as 9, of letters as A, of white space as a blank (e or E inside a number as e), other characters standing for
themselves. For every run of a shape the cheapest of four candidates is taken: its literal text, the class with a fixed length, the class with least and greatest length, the class with
any length. The alternative belongs to the expression if stating it once and its values by it takes fewer bits than spelling these out. Two alternatives that differ by
one or two runs become one with an optional part where that is shorter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmerframe.functions.quantiles import exact_quantile

NUMBERS = {"digits": r"^[0-9]+\z", "number": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"}
RUNS = r"(\p{L}+|[0-9]+|[\t\n\f\r ]+|[^\p{L}0-9\t\n\f\r ])"
# Bits: of a spelled character and of marking an alternative; of a character whose class is known; of the kind of a run's candidate and of a length.
BITS_CHARACTER, BITS_ALTERNATIVE, BITS_DIGIT, BITS_LETTER, BITS_BLANK, BITS_LENGTH = 8.0, 16.0, math.log2(10), 6.0, 1.0, 5.0


def marked(text: Column) -> Column:
    """text with the exponent mark of a number as a character of its own."""
    return F.regexp_replace(F.translate(text, "\u0001", "\u0002"), r"([0-9.])[eE]([+-]?[0-9])", "$1\u0001$2")


def shape(marked: Column) -> Column:
    """Runs of digits become 9, of letters A, of white space a blank, the exponent mark e."""
    s = F.regexp_replace(F.regexp_replace(marked, r"\p{L}+", "A"), r"[0-9]+", "9")
    return F.translate(F.regexp_replace(s, r"[\t\n\f\r ]+", " "), "\u0001", "e")


def values(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(column_name, load_id, value, rows) of the non-null values of text columns: repeats are gone before anything else, whichever load or value holds most rows."""
    texts = F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("column_name", "value")
    return rows.select(F.col(load).alias("load_id"), texts).filter(F.col("value").isNotNull()).groupBy("column_name", "load_id", "value").agg(F.count("*").alias("rows"))


def _runs(known: DataFrame) -> DataFrame:
    """(column_name, shape, place, kind, n, chars, lo, hi, first, last, any_bits): figures of each run of each shape over the distinct values of all loads."""
    whole = known.select("column_name", "value").distinct().select("column_name", marked(F.col("value")).alias("m"))
    runs = whole.select("column_name", shape(F.col("m")).alias("shape"), F.posexplode_outer(F.regexp_extract_all("m", F.lit(RUNS), 1)).alias("place", "run"))
    size = F.length("run")
    return runs.groupBy("column_name", "shape", "place").agg(
        F.count("*").alias("n"), F.sum(size).alias("chars"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.min("run").alias("first"), F.max("run").alias("last"), F.sum(2 * F.log2(size) + 1).alias("any_bits"),
    ).withColumn("kind", F.expr("substring(shape, place + 1, 1)"))


def _items(runs: DataFrame) -> DataFrame:
    """runs with the cheapest candidate of each: its bits in the model (model), for the values (data), its lengths (a, b; b null: any) and its regular expression."""
    n, chars, kind = F.col("n"), F.col("chars"), F.col("kind")
    each = F.when(kind == "9", BITS_DIGIT).when(kind == "A", BITS_LETTER).otherwise(BITS_BLANK)
    flexible = kind.isin("9", "A", " ")
    same, fixed = F.col("first") == F.col("last"), F.col("lo") == F.col("hi")
    cls = F.when(kind == "9", F.lit("[0-9]")).when(kind == "A", F.lit(r"\p{L}")).otherwise(F.lit(r"\s"))
    quoted = F.regexp_replace("first", r"([\\^$.|?*+(){}\[\]])", r"\\$1")

    def candidate(model: Column, data: Column, rank: int, a: Column, b: Column, regex: Column) -> Column:
        return F.struct((model + data).alias("bits"), F.lit(rank).alias("rank"), model.cast("double").alias("model"), data.cast("double").alias("data"), a.cast("int").alias("a"), b.cast("int").alias("b"), regex.alias("regex"))

    lo, hi, mark = F.col("lo"), F.col("hi"), F.lit(BITS_CHARACTER)
    times = F.when(lo == 1, F.lit("")).otherwise(F.concat(F.lit("{"), lo.cast("string"), F.lit("}")))
    choices = F.array(
        F.when(flexible & same, candidate(BITS_CHARACTER * lo, F.lit(0.0), 0, lo, hi, quoted)),
        F.when(flexible & fixed, candidate(mark + BITS_LENGTH, chars * each, 1, lo, hi, F.concat(cls, times))),
        F.when(flexible, candidate(mark + 2 * BITS_LENGTH, chars * each + n * F.log2(hi - lo + 1), 2, lo, hi, F.concat(cls, F.lit("{"), lo.cast("string"), F.lit(","), hi.cast("string"), F.lit("}")))),
        F.when(flexible, candidate(mark + 1, chars * each + F.col("any_bits"), 3, lo, F.lit(None), F.concat(cls, F.lit("+")))),
        F.when(kind == "e", candidate(mark, n.cast("double"), 4, lo, hi, F.lit("[eE]"))),
        F.when(~flexible & (kind != "e") & F.col("first").isNotNull(), candidate(mark, F.lit(0.0), 5, lo, hi, quoted)),
    )
    best = F.array_min(F.filter(choices, lambda c: c.isNotNull()))
    return runs.withColumn("each", F.when(flexible, each).otherwise(F.lit(0.0))).withColumn("__c", best).select("*", *[F.col(f"__c.{x}").alias(x) for x in ("rank", "model", "data", "a", "b", "regex")]).drop("__c")


def alternatives(known: DataFrame) -> DataFrame:
    """(column_name, shape, n, bits, spelled, in_expression, items) of every shape: n distinct values over all loads, their bits by the shape's alternative and spelled out."""
    kept = ("place", "kind", "n", "chars", "each", "any_bits", "rank", "model", "data", "a", "b", "regex")
    one = _items(_runs(known)).groupBy("column_name", "shape").agg(
        F.max("n").alias("n"), F.coalesce(F.sum("model"), F.lit(0.0)).alias("model"), F.coalesce(F.sum("data"), F.lit(0.0)).alias("data"), F.coalesce(F.sum("chars"), F.lit(0)).alias("__c"),
        F.array_sort(F.collect_list(F.struct(*kept))).alias("items"))
    bits, spelled = BITS_ALTERNATIVE + F.col("model") + F.col("data"), BITS_CHARACTER * (F.col("__c") + F.col("n"))
    return one.select("column_name", "shape", "n", bits.alias("bits"), spelled.alias("spelled"), (bits < spelled).alias("in_expression"), "model", "items")


def induced(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(column_name, regex, shapes, distinct_values, bits): the expression of each text column, one row per alternative.

    An alternative B becomes part of A, which has one or two runs more, if A's other runs hold all of B's values and that saves bits: B needs no alternative of its own, only the
    mark of an optional part. A takes part in no further merging of its own; it has one optional part, the one that saves most.
    """
    alts = alternatives(values(rows, load, columns)).filter("in_expression")
    long = alts.select("column_name", F.col("shape").alias("host"), F.col("items").alias("wide"), F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.length("shape") - 1), lambda i: F.array(F.struct(i.alias("at"), F.lit(1).alias("w")), F.struct(i.alias("at"), F.lit(2).alias("w")))))).alias("cut"))
    at, w = F.col("cut.at"), F.col("cut.w")
    long = long.filter(at + w <= F.length("host")).withColumn("shape", F.concat(F.substring("host", F.lit(1), at), F.expr("substring(host, cut.at + cut.w + 1)")))
    long = long.filter(F.col("shape") != F.col("host")).withColumn("rest", F.concat(F.slice("wide", F.lit(1), at), F.expr("slice(wide, cut.at + cut.w + 1, length(host))")))
    both = long.join(alts.select("column_name", "shape", "n", F.col("model").alias("own_model"), "items"), ["column_name", "shape"])

    def more(b: Column, a: Column) -> Column:
        """Bits by which a run costs more under the longer alternative; null where that does not hold it."""
        holds = a["rank"].isin(1, 2, 3) & (a["kind"] == b["kind"]) & (a["rank"].eqNullSafe(F.lit(3)) | ((a["a"] <= b["a"]) & (F.coalesce(b["b"], F.lit(1 << 30)) <= a["b"])))
        cost = b["chars"] * b["each"] + F.when(a["rank"] == 2, b["n"] * F.log2(a["b"] - a["a"] + 1)).when(a["rank"] == 3, b["any_bits"]).otherwise(F.lit(0.0))
        return F.when(a["regex"] == b["regex"], F.lit(0.0)).when(holds, cost - b["data"])

    extra = F.aggregate(F.zip_with("items", "rest", more), F.lit(0.0), lambda s, x: s + x)
    saved = both.withColumn("saves", F.col("own_model") + BITS_ALTERNATIVE - BITS_CHARACTER - extra).filter(F.col("saves") > 0)
    hosted = saved.select("column_name", F.col("shape").alias("host")).distinct()  # what can be part of another takes in nothing
    saved = saved.join(hosted, ["column_name", "host"], "left_anti")
    choice = saved.groupBy("column_name", "shape").agg(F.max_by(F.struct("host", "cut", "saves"), F.struct(F.col("saves"), "host", "cut")).alias("m"))
    spans = choice.groupBy("column_name", F.col("m.host").alias("host"), F.col("m.cut").alias("cut")).agg(F.sum("m.saves").alias("saves"), F.collect_list("shape").alias("parts"))
    top = spans.groupBy("column_name", "host").agg(F.max_by(F.struct("cut", "parts", "saves"), F.struct(F.col("saves"), "cut")).alias("o"))
    gone = top.select("column_name", F.explode("o.parts").alias("shape"))
    left = alts.join(gone, ["column_name", "shape"], "left_anti").join(top.withColumnRenamed("host", "shape"), ["column_name", "shape"], "left")
    n = alts.select("column_name", F.col("shape").alias("part"), F.col("n").alias("part_n"), F.col("bits").alias("part_bits"))
    added = top.select("column_name", F.col("host").alias("shape"), F.explode("o.parts").alias("part")).join(n, ["column_name", "part"]).groupBy("column_name", "shape").agg(F.sum("part_n").alias("added"), F.sum("part_bits").alias("added_bits"))
    opened = F.transform("items", lambda i: F.concat(F.when(i["place"] == F.col("o.cut.at"), F.lit("(?:")).otherwise(F.lit("")), i["regex"], F.when(i["place"] == F.col("o.cut.at") + F.col("o.cut.w") - 1, F.lit(")?")).otherwise(F.lit(""))))
    regex = F.when(F.col("o").isNotNull(), F.array_join(opened, "")).otherwise(F.array_join(F.transform("items", lambda i: i["regex"]), ""))
    shapes = F.array_sort(F.concat(F.array("shape"), F.coalesce("o.parts", F.array().cast("array<string>"))))
    return left.join(added, ["column_name", "shape"], "left").select("column_name", F.concat(F.lit("^"), regex, F.lit("$")).alias("regex"), shapes.alias("shapes"), (F.col("n") + F.coalesce("added", F.lit(0))).alias("distinct_values"), (F.col("bits") + F.coalesce("added_bits", F.lit(0.0)) - F.coalesce("o.saves", F.lit(0.0))).alias("bits"))


def _moved(parts: DataFrame) -> DataFrame:
    """(column_name, load_id, change) of (column_name, load_id, part, n): half the summed differences between the load's shares of parts and those of the other loads (0 same, 1 disjoint); null without others."""
    total = lambda *by: F.sum("n").over(Window.partitionBy("column_name", *by))
    s = parts.withColumn("__own", total("load_id")).withColumn("__others", total() - F.col("__own"))
    s = s.withColumn("__mine", F.col("n") / F.col("__own")).withColumn("__theirs", F.try_divide(total("part") - F.col("n"), F.col("__others")))
    # a part that a load lacks adds its whole share of the other loads: that is one minus the shares of those it has
    change = (F.sum(F.abs(F.col("__mine") - F.col("__theirs"))) + 1 - F.sum("__theirs")) / 2
    return s.groupBy("column_name", "load_id").agg(change.alias("change")).withColumn("change", F.when(F.col("change").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "change"))))


def text_profile(rows: DataFrame, load: str, columns: dict[str, str | None]) -> DataFrame:
    """(column_name, load_id, filled, distinct_values, nonconforming, malformed, coverage, coverage_change, change): per load and text column.

    nonconforming: rows outside the induced expression; coverage: the share of rows inside it, coverage_change: that less the share of the other loads together; change: see _moved,
    over the alternatives, all nonconforming rows being one part. columns: name -> the regular expression of the column's type, if it has one. malformed: rows of alternatives
    that lie outside the type, and of the nonconforming rows those whose value does not match it; without a type all nonconforming rows. All values of one shape match a type or none
    does, if the type treats all digits and all letters alike, so an alternative is judged by one value.
    """
    known = values(rows, load, list(columns))
    well = F.lit(None).cast("boolean")
    for name, pattern in columns.items():
        if pattern is not None:
            well = F.when(F.col("column_name") == name, F.col("value").rlike(pattern)).otherwise(well)
    by_load = known.withColumn("__w", well).groupBy("column_name", "load_id", shape(marked(F.col("value"))).alias("shape")).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("distinct_values"), F.sum(F.when(~F.col("__w"), F.col("rows")).otherwise(0)).alias("misfit"), F.max("__w").alias("typed"))
    s = by_load.join(alternatives(known).select("column_name", "shape", "in_expression"), ["column_name", "shape"])
    inside = F.col("in_expression")
    bad = F.when(F.col("typed").isNull(), F.when(inside, 0).otherwise(F.col("rows"))).when(inside, F.when(F.col("typed"), 0).otherwise(F.col("rows"))).otherwise(F.col("misfit"))
    moved = _moved(s.groupBy("column_name", "load_id", F.when(inside, F.col("shape")).alias("part")).agg(F.sum("rows").alias("n")))
    one = s.groupBy("column_name", "load_id").agg(F.sum("rows").alias("filled"), F.sum("distinct_values").alias("distinct_values"), F.sum(F.when(inside, 0).otherwise(F.col("rows"))).alias("nonconforming"), F.sum(bad).alias("malformed"))
    column = Window.partitionBy("column_name")
    held = F.col("filled") - F.col("nonconforming")
    theirs = F.try_divide(F.sum(held).over(column) - held, F.sum("filled").over(column) - F.col("filled"))
    one = one.select("*", (held / F.col("filled")).alias("coverage"), (held / F.col("filled") - theirs).alias("coverage_change"))
    moved = moved.withColumnsRenamed({"column_name": "__n", "load_id": "__l"})
    return one.join(moved, (F.col("column_name") == F.col("__n")) & F.col("load_id").eqNullSafe(F.col("__l"))).drop("__n", "__l")


def standard_profile(rows: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """(column_name, load_id, rows, nulls, null_rate, bad_numbers, lowest, highest, mean, least_text, greatest_text): every column of every load in one scan.

    Map-side partial aggregation only; a load with a third of all rows costs one more partial row per task. bad_numbers counts not-a-number and
    infinite values, which lowest, highest and mean leave out; lowest and highest are numbers, of times seconds since 1970, null for text, whose least and greatest are least_text and
    greatest_text. An empty table gives an empty result; the null load is a load of its own.
    """
    kinds = dict(rows.dtypes)
    columns = [c for c in (columns or rows.columns) if not kinds[c].startswith(("array", "map", "struct"))]
    aggregates, none = [F.count("*").alias("__rows")], F.lit(None).cast("double")
    for i, c in enumerate(columns):
        v, number = F.col(f"`{c}`"), _number(f"`{c}`", kinds[c])
        text = v if kinds[c] == "string" else F.lit(None).cast("string")
        mean = F.avg(number) if isinstance(rows.schema[c].dataType, T.NumericType) else none
        bad = F.count(v) - F.count(number) if kinds[c] in ("double", "float") else F.lit(0)
        aggregates += [F.count(v).alias(f"__f{i}"), F.min(number).alias(f"__a{i}"), F.max(number).alias(f"__z{i}"), mean.alias(f"__m{i}"), bad.cast("long").alias(f"__b{i}"), F.min(text).alias(f"__s{i}"), F.max(text).alias(f"__t{i}")]
    one = rows.groupBy(F.col(load).alias("__load")).agg(*aggregates)
    names = (("filled", "f"), ("bad_numbers", "b"), ("lowest", "a"), ("highest", "z"), ("mean", "m"), ("least_text", "s"), ("greatest_text", "t"))
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"__{x}{i}").alias(n) for n, x in names]) for i, c in enumerate(columns)])
    flat = one.select("__load", "__rows", F.explode(parts).alias("p"))
    nulls = F.col("__rows") - F.col("p.filled")
    return flat.select("p.column_name", F.col("__load").alias("load_id"), F.col("__rows").alias("rows"), nulls.alias("nulls"), (nulls / F.col("__rows")).alias("null_rate"), *[f"p.{n}" for n, _ in names[1:]])


def _number(name: str, kind: str) -> Column:
    """A column as a finite double, times as seconds; null for text and what is not finite."""
    v = F.col(name)
    if kind.startswith("timestamp"):
        return F.unix_micros(v.cast("timestamp")) / 1e6
    if kind == "date":
        return F.unix_date(v) * 86400.0
    if kind in ("double", "float"):
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v.cast("double"))
    return F.lit(None).cast("double") if kind in ("string", "binary") else v.cast("double")


def typed_profile(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(column_name, load_id, distinct_values, change) of columns that are no text, in one shuffle.

    distinct_values is exact for columns of up to eight bytes a value, as xxhash64 maps no two of these values of one type to one hash. change: see _moved, over finite values, by
    minute for times and by size for numbers (ranges of equal sign whose ends are in proportion e^(1/3)).
    """
    kinds = dict(rows.dtypes)
    names = F.array(*map(F.lit, columns))
    fields = []
    for i, c in enumerate(columns):
        v, number = F.col(f"`{c}`"), _number(f"`{c}`", kinds[c])
        size = F.floor(F.ln(F.abs(number)) * 3) + 10_000
        part = F.floor(number / 60) if kinds[c].startswith(("timestamp", "date")) else F.when(number > 0, size).when(number < 0, -size).when(number == 0, F.lit(0))
        same = v + F.lit(0.0) if kinds[c] in ("double", "float") else v  # the two zeros are one value
        fields += [F.lit(i), F.when(v.isNotNull(), F.xxhash64(same)), part.cast("long")]
    one = rows.select(F.col(load).alias("load_id"), F.stack(F.lit(len(columns)), *fields).alias("i", "h", "part")).filter(F.col("h").isNotNull()).groupBy("load_id", "i", "h").agg(F.count("*").alias("n"), F.max("part").alias("part"))
    parts = one.groupBy("load_id", "i", "part").agg(F.sum("n").alias("n"), F.count("*").alias("d")).withColumn("column_name", F.get(names, F.col("i")))
    counts = parts.groupBy("column_name", "load_id").agg(F.sum("d").alias("distinct_values"))
    moved = _moved(parts.filter(F.col("part").isNotNull())).withColumnsRenamed({"column_name": "__n", "load_id": "__l"})
    return counts.join(moved, (F.col("column_name") == F.col("__n")) & F.col("load_id").eqNullSafe(F.col("__l")), "left").select("column_name", "load_id", "distinct_values", "change")


def load_profile(rows: DataFrame, load: str, patterns: dict[str, str]) -> DataFrame:
    """standard_profile with distinct_values, nonconforming_rate, malformed_rate, null_rate_change, coverage, coverage_change and change: every column of every load.

    Rates are of the load's non-null values. See text_profile for text, whose type is in patterns if it has one, and typed_profile for the rest. A number is malformed if
    it is not-a-number or infinite; other kinds have no malformed values. null_rate_change: the null rate less that of the other loads together; all changes are
    null where there are no others.
    """
    kinds = {c: kind for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))}
    texts = {c: patterns.get(c) for c, kind in kinds.items() if kind == "string"}
    typed = [c for c in kinds if c not in texts]
    base = standard_profile(rows, load)
    parts, kept = [base], [c for c in base.columns if c not in ("column_name", "load_id")]
    if texts:
        parts.append(text_profile(rows, load, texts).drop("filled"))
    if typed:
        parts.append(typed_profile(rows, load, typed))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    for name, kind in (("distinct_values", "long"), ("nonconforming", "long"), ("malformed", "long"), ("coverage", "double"), ("coverage_change", "double"), ("change", "double")):
        whole = whole if name in whole.columns else whole.withColumn(name, F.lit(None).cast(kind))
    extra = ["distinct_values", "nonconforming", "malformed", "coverage", "coverage_change", "change"]
    one = whole.groupBy("column_name", "load_id").agg(*[F.max(c).alias(c) for c in kept + extra])  # of each pair one row of each part
    text, filled = F.col("column_name").isin(list(texts)), F.col("rows") - F.col("nulls")
    column = Window.partitionBy("column_name")
    others = F.try_divide(F.sum("nulls").over(column) - F.col("nulls"), F.sum("rows").over(column) - F.col("rows"))
    return one.select(
        "column_name", "load_id", *kept, F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        F.when(text, F.try_divide("nonconforming", filled)).alias("nonconforming_rate"), F.try_divide(F.when(text, F.col("malformed")).otherwise(F.col("bad_numbers")), filled).alias("malformed_rate"),
        (F.col("null_rate") - others).alias("null_rate_change"), "coverage", "coverage_change", "change")


def medians(rows: DataFrame, load: str, column: str) -> DataFrame:
    """(load_id, median, usual, ratio): the exact median of a load's finite values against the median of all loads' medians."""
    by_load = exact_quantile(rows.select(F.col(load).alias("load_id"), F.col(column)), ["load_id"], column, name="median")
    usual = by_load.agg(F.median("median").alias("usual"))  # one row per load comes together here
    return by_load.crossJoin(F.broadcast(usual)).select("load_id", "median", "usual", (F.try_divide(F.col("median"), F.col("usual"))).alias("ratio"))


def findings(
    frames: DataFrame, records: DataFrame, load: str = "load_id", most_null: float = 0.1, most_out_of_range: float = 0.02, lowest: int = 1, highest: int = 1_000_000_000,
    shift: float = 1.8, most_malformed: float = 0.1, least_distinct: float = 0.4,
) -> DataFrame:
    """(table_name, column_name, load_id, finding): the loads of raw_df (frames) and raw_records (records) that fall out, and why.

    null_rate: Time or Cell_1 null in more than most_null of a load's rows; range: Time outside lowest..highest in more than most_out_of_range of its
    rows; shift: the median of finite Cell_1 more than shift times, or less than 1/shift of, the usual one; pattern: more than
    most_malformed of the non-null texts malformed, that is outside those alternatives of the induced expression that belong to the column's type and, being outside the expression
    altogether, not of the type by themselves (see text_profile); distinct: fewer than least_distinct distinct texts per non-null one. All rows count. Rows of null
    load are left out; loads without a non-null value have no pattern, distinct or shift finding; empty tables give an empty result.
    """
    frames, records = (t.select(load, "Time", "Cell_1").filter(F.col(load).isNotNull()) for t in (frames, records))
    out = (F.col("Time") < lowest) | (F.col("Time") > highest)
    rates = frames.groupBy(F.col(load).alias("load_id")).agg(F.avg(F.col("Time").isNull().cast("int")).alias("t"), F.avg(F.col("Cell_1").isNull().cast("int")).alias("c"), F.avg(F.coalesce(out, F.lit(False)).cast("int")).alias("o"))
    name = lambda column, finding: F.struct(F.lit("raw_df").alias("table_name"), F.lit(column).alias("column_name"), F.lit(finding).alias("finding"))
    hits = F.filter(F.array(F.when(F.col("t") > most_null, name("Time", "null_rate")), F.when(F.col("c") > most_null, name("Cell_1", "null_rate")), F.when(F.col("o") > most_out_of_range, name("Time", "range"))), lambda x: x.isNotNull())
    aggregates = rates.select("load_id", F.explode(hits).alias("h")).select("h.table_name", "h.column_name", "load_id", "h.finding")
    m = medians(frames, load, "Cell_1")
    shifted = m.filter((F.col("median") > shift * F.col("usual")) | (F.col("median") < F.col("usual") / shift)).select(F.lit("raw_df").alias("table_name"), F.lit("Cell_1").alias("column_name"), "load_id", F.lit("shift").alias("finding"))
    p = text_profile(records, load, {"Time": NUMBERS["digits"], "Cell_1": NUMBERS["number"]})
    named = F.filter(F.array(F.when(F.col("malformed") > most_malformed * F.col("filled"), F.lit("pattern")), F.when((F.col("column_name") == "Cell_1") & (F.col("distinct_values") < least_distinct * F.col("filled")), F.lit("distinct"))), lambda x: x.isNotNull())
    texts = p.select(F.lit("raw_records").alias("table_name"), "column_name", "load_id", F.explode(named).alias("finding"))
    return aggregates.unionByName(shifted).unionByName(texts)
