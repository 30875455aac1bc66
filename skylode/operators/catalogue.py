"""File names, products, observing sequences and nights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylode.functions.observations import base_name
from skylode.operators.islands import island_starts

# Resolution products and their other names; gaps, in seconds; files of a sequence.
PRODUCTS = {"fine": "0000", "time": "0001", "mid": "0002"}
PRODUCT_END = r"(?i)\.(000[012]|fine|time|mid)\.(h5|hdf5|fil)$"
SEQUENCE_GAP, NIGHT_GAP, SEQUENCE_FILES = 700, 43_200, 6


def parsed_names(files: DataFrame, file: str = "file") -> DataFrame:
    """base, node, backend, mjd_day, mjd_sec, abs_time_s, target, scan_num, product and parse_error of each file name.

    A name needs `.rawspec.` and `.h5`, or else a numeric product between its last two dots; six fields at least; whole
    numbers for day and second. What fails leaves all but base null and says why in parse_error.
    """
    base = F.col("base")
    at = F.instr(base, ".rawspec.")
    standard = (at > 0) & base.endswith(".h5")
    plain = base.rlike(r"^.*\.\d+\.h5$")
    core = F.when(standard, F.expr("substring(base, 1, instr(base, '.rawspec.') - 1)")).when(plain & ~standard, F.regexp_replace(base, r"\.\d+\.h5$", ""))
    product = F.when(standard, F.expr("substring(base, instr(base, '.rawspec.') + 9, length(base) - instr(base, '.rawspec.') - 8 - 3)")).when(plain, F.regexp_extract(base, r"\.(\d+)\.h5$", 1))
    out = files.select(base_name(F.col(file)).alias("base")).where("base IS NOT NULL").withColumns({"core": core, "product": product}).withColumn("f", F.split("core", "_"))
    out = out.withColumns({"day": F.get("f", F.lit(2)).try_cast("long"), "sec": F.get("f", F.lit(3)).try_cast("long"), "n": F.size("f")})
    error = (
        F.when(F.col("core").isNull(), F.concat(F.lit("unrecognised filename: "), base))
        .when(F.col("n") < 6, F.concat(F.lit("too few fields ("), F.col("n").cast("string"), F.lit("): "), F.col("core")))
        .when(F.col("day").isNull() | F.col("sec").isNull(), F.concat(F.lit("non-numeric MJD: "), base))
    )
    good = F.col("parse_error").isNull()
    return out.withColumn("parse_error", error).select(
        "base", F.when(good, F.get("f", F.lit(0))).alias("node"), F.when(good, F.col("day")).alias("mjd_day"), F.when(good, F.col("sec")).alias("mjd_sec"),
        F.when(good, F.col("day") * 86400 + F.col("sec")).alias("abs_time_s"), F.when(good, F.array_join(F.slice("f", 5, F.greatest(F.col("n") - 5, F.lit(0))), "_")).alias("target"),
        F.when(good, F.element_at("f", -1)).alias("scan_num"), F.when(good, F.col("product")).alias("product"), "parse_error",
    )


def product_of(base: Column) -> Column:
    """The product a name ends in, aliases resolved; null for other names."""
    end = F.lower(F.regexp_extract(base, PRODUCT_END, 1))
    alias = F.create_map(*[F.lit(x) for kv in PRODUCTS.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, end), F.nullif(end, F.lit("")))


def node_scan_key(base: Column) -> Column:
    """The name without product and ending, node kept; null where no product is recognized."""
    core = F.regexp_replace(F.regexp_replace(base, PRODUCT_END, ""), r"\.rawspec$", "")
    return F.when(product_of(base).isNotNull(), F.nullif(F.lower(core), F.lit("")))


def scan_key(base: Column) -> Column:
    """The name without product, ending and node."""
    return F.nullif(F.regexp_replace(node_scan_key(base), "^blc[0-9a-z]+_", ""), F.lit(""))


def sequences_of_six(observations: DataFrame) -> DataFrame:
    """rows with run, seq and place: runs of each product and node cut by the gap, and cut into sixes in order of time.

    observations: product, node, time, base. The rows of a run are those of one continuous stay at a node.
    """
    runs = island_starts(observations, ["product", "node"], "time", SEQUENCE_GAP, 86_400).withColumnRenamed("island", "run")
    place = F.row_number().over(W.partitionBy("product", "node", "run").orderBy("time", "base")) - 1
    return runs.withColumn("_k", place).withColumns({"seq": F.expr(f"_k div {SEQUENCE_FILES}"), "place": (F.col("_k") % SEQUENCE_FILES).cast("int")}).drop("_k")


def nights_of(times: DataFrame) -> DataFrame:
    """time and night, the first time of its night: all distinct times, cut where nothing starts for twelve hours."""
    one = times.select("time").where("time IS NOT NULL").distinct().withColumn("k", F.lit(0))
    return island_starts(one, ["k"], "time", NIGHT_GAP, 10 * 86_400).select("time", F.col("island").alias("night"))


def on_off(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, on_target, n_on, n_off, off_targets: the target seen most often is ON (the first in time on ties); if none is
    seen twice there is no ON target. OFF targets stand in order of time. files: keys, time, target; few for each key."""
    per = files.groupBy(*keys, "target").agg(F.count("*").alias("n"), F.min(F.struct("time", "place")).alias("at"))
    ordered = per.groupBy(*keys).agg(
        F.max(F.struct("n", (-F.col("at.time")).alias("t"), (-F.col("at.place")).alias("p"), "target")).alias("top"), F.sum("n").alias("total"),
        F.sort_array(F.collect_list(F.struct("at", "target"))).alias("all"),
    )
    on = F.when(F.col("top.n") > 1, F.col("top.target"))
    n_on = F.when(F.col("top.n") > 1, F.col("top.n")).otherwise(0)
    off = F.filter(F.transform("all", lambda x: x["target"]), lambda t: F.col("on_target").isNull() | (t != F.col("on_target")))
    return ordered.withColumn("on_target", on).select(*keys, "on_target", n_on.alias("n_on"), (F.col("total") - n_on).alias("n_off"), F.array_join(off, ",").alias("off_targets"))


def shape_flags(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and flags, a comma list: files_N unless six, pattern unless ON,a,ON,b,ON,c, mixed_band, ragged_ntime."""
    got = files.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("t"),
        F.count_distinct("f_start_mhz", "f_stop_mhz").alias("bands"), F.count_distinct("ntime").alias("ntimes"), F.count("*").alias("n"),
    )
    t = [F.get("t", F.lit(k)) for k in range(6)]
    abacad = (t[0] == t[2]) & (t[2] == t[4]) & (F.size(F.array_distinct(F.array(t[0], t[1], t[3], t[5]))) == 4)
    flags = F.array_compact(F.array(
        F.when(F.col("n") != 6, F.concat(F.lit("files_"), F.col("n").cast("string"))), F.when((F.col("n") == 6) & ~F.coalesce(abacad, F.lit(False)), F.lit("pattern")),
        F.when(F.col("bands") > 1, F.lit("mixed_band")), F.when(F.col("ntimes") > 1, F.lit("ragged_ntime")),
    ))
    return got.select(*keys, F.array_join(flags, ",").alias("flags"))
