"""One query per operator, over the whole test tables.

Every callable takes (spark, folder of parquet tables) and returns a DataFrame.
Floating results go through ``stable`` so that the last bits of a sum, which
depend on the order of addition, do not decide a comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import (
    BOUNDS,
    FILE_IN_FOLDER,
    LANDED_REGIMES,
    LAYOUT,
    PAGE_BOUNDS,
    REGIMES,
    landed_folder,
    landed_listing,
    landed_pages,
    landed_series,
    landed_texts,
    landed_work,
    supplier_attributes,
    supplier_points,
    table,
)
from series_rank.config import FEATURES, Params, default_weights, feature_columns
from series_rank.functions import arrays, stats, text
from series_rank.operators import factor, gate, models, points, pool, rankers, ranking, wide
from series_rank.operators.wide import split_tagged
from series_rank.plans import pipeline
from series_rank.plans.ingest import Landed
from series_rank.session import materialize, scratch_path
from series_rank.sources import landing, tables
from series_rank.sources.stages import Stages
from series_rank.streaming.landing import ingest_stream

COLUMNS = feature_columns(REGIMES)
PARAMS = Params(regimes=REGIMES)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def stable(c: str | Column) -> Column:
    """A double at single precision."""
    column = F.col(c) if isinstance(c, str) else c
    return column.cast("float").cast("double") + F.lit(0.0)


def floats(*names: str) -> list[Column]:
    return [F.expr(f"cast(cast(`{n}` as float) as double) + 0.0D as `{n}`") for n in names]


def series(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey", **kwargs) -> DataFrame:
    return points.series_features(supplier_points(spark, sf_dir, entity, **kwargs))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.entity_table(series(spark, sf_dir), REGIMES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(wide.complete_features(entities(spark, sf_dir), REGIMES), "features")


# ---- sources, sinks, ingest -------------------------------------------------


@query
def scan_series(spark, sf_dir):
    return supplier_points(spark, sf_dir).select("entity", "regime", *floats("x", "y", "d", "m"))


@query
def stage_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "stage")
    written = tables.write_stage(wide.to_wide(series(spark, sf_dir), REGIMES), path)
    return tables.read_stage(spark, path).select("entity", *floats(*written.columns[1:]))


def _series_store(spark, sf_dir) -> tuple[str, DataFrame, DataFrame]:
    rows = materialize(series(spark, sf_dir).withColumn("entity", F.col("entity").cast("string")), "series")
    work = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("entity"), "s_nationkey")
    return scratch_path(spark, "store"), rows, work


@query
def incremental_append(spark, sf_dir):
    root, rows, work = _series_store(spark, sf_dir)
    first, second = work.where("s_nationkey < 12"), work.where("s_nationkey >= 12")
    tables.append_batch(rows.join(first, "entity", "left_semi"), first, root, "b1")
    tables.append_batch(rows.join(second, "entity", "left_semi"), second, root, "b2")
    tables.append_batch(rows.join(second, "entity", "left_semi"), second, root, "b2")  # retried: replaces itself
    rows.join(first, "entity", "left_semi").write.parquet(f"{root}/series/batch=b3")  # never published
    return tables.saved_series(spark, root).select("entity", "regime", "n_points", *floats("yMax"))


@query
def ingest_modes(spark, sf_dir):
    root, rows, work = _series_store(spark, sf_dir)

    def rows_of(todo):
        return rows.join(todo, "entity", "left_semi")

    out = []
    for step, mode, listed in (
        (1, "fresh", work.where("s_nationkey < 12")),
        (2, "resume", work),
        (3, "reuse", work),
        (4, "fresh", work.where("s_nationkey >= 20")),
    ):
        saved = tables.ingest(rows_of, listed, root, mode, batch=f"b{step}")
        counted = saved.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities"))
        out.append(materialize(counted.select(F.lit(step).cast("long").alias("step"), F.lit(mode).alias("mode"), "*"), "mode"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def resume_todo(spark, sf_dir):
    work = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_name")
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return tables.resume(work, done.select(F.col("o_custkey").alias("entity")))


def _orders_by_customer(spark, sf_dir):
    work = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("regime"), "o_orderkey"
    )
    return work, rows


@query
def marker_rows(spark, sf_dir):
    work, rows = _orders_by_customer(spark, sf_dir)
    marked = tables.with_markers(work, rows)
    return marked.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("regime").isNull()).alias("n_markers")
    )


@query
def without_markers(spark, sf_dir):
    return tables.without_markers(tables.with_markers(*_orders_by_customer(spark, sf_dir)))


@query
def ingest_progress(spark, sf_dir):
    return tables.progress(*_orders_by_customer(spark, sf_dir))


@query
def page_links(spark, sf_dir):
    return text.page_links(table(spark, sf_dir, "pages"), "html", ["page_id"], "nav")


@query
def page_worklist(spark, sf_dir):
    links = text.page_links(table(spark, sf_dir, "pages"), "html", ["page_id"], "nav")
    return landing.worklist(links, text.extract_key(F.col("href"), r"^/(.+)$")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_links")
    )


@query
def parse_series_text(spark, sf_dir):
    parsed = text.parse_series(landed_texts(spark, sf_dir), layout=LAYOUT)
    cells = F.arrays_zip("x", "y", "d", "dp", "m", "top", "bottom")
    exploded = parsed.select("entity", "regime", "ratioMax", "ratioMaxX", F.posexplode(cells))
    return exploded.select(
        "entity", "regime", "ratioMax", "ratioMaxX", F.col("pos").cast("long").alias("pos"), "col.*"
    )


@query
def parse_header_map(spark, sf_dir):
    header = text.header_map(F.col("raw"), LAYOUT.header_lines)
    return landed_texts(spark, sf_dir).select("entity", "regime", F.explode(header).alias("k", "v"))


@query
def malformed_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("all_lines", text.lines(F.col("text")))
    docs = docs.withColumn("kept", text.well_formed(F.col("all_lines"), F.lit(3)))
    return docs.select(
        "doc_id",
        F.size("all_lines").cast("long").alias("n_lines"),
        F.size("kept").cast("long").alias("n_kept"),
        F.md5(F.array_join("kept", "|")).alias("kept_md5"),
    )


@query
def coerce_numeric(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("cells", F.split("text", "[ \n]+"))
    docs = docs.withColumn("numbers", F.filter(F.transform("cells", text.to_number), lambda v: v.isNotNull()))
    return docs.select(
        "doc_id",
        F.size("cells").cast("long").alias("n_cells"),
        F.size("numbers").cast("long").alias("n_numbers"),
        stable(F.array_max("numbers")).alias("largest"),
        stable(F.array_min("numbers")).alias("smallest"),
    )


@query
def page_metrics(spark, sf_dir):
    """Two measures in a paragraph that Spark adds to every page from its own columns."""
    measures = F.concat(
        F.lit("</p><p>Max thickness <b>"),
        (F.col("page_id") % 23).cast("string"),
        F.lit(".5%</b>\n at "),
        (F.length("url") % 41).cast("string"),
        F.when(F.col("page_id") % 7 == 3, F.lit("&nbsp;% of chord")).otherwise(F.lit("% chord")),
        F.lit("</p><!-- Max camber 1% at 2% chord --><div>Max camber "),
        F.when(F.col("page_id") % 5 == 1, F.lit("1.2.3")).otherwise((F.length("url") % 13).cast("string")),
        F.lit("% at 30.25% chord</div>"),
    )
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", measures))
    return landing.attributes_of_pages(pages, "page_id", "html")


@query
def page_text(spark, sf_dir):
    t = text.page_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


@query
def enumerate_series(spark, sf_dir):
    parsed = text.parse_series(landed_texts(spark, sf_dir), layout=LAYOUT)
    attributes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("entity"), F.col("quality").cast("long").alias("attr_a")
    )
    rows = landing.enumerate_series(landed_work(spark, sf_dir), parsed, LANDED_REGIMES[:2], attributes)
    return rows.select("entity", "regime", "desc", "attr_a", F.size("x").cast("long").alias("n_points"))


@query
def restart_from_stage(spark, sf_dir):
    """A whole run, then its last two stages again from the saved tables."""
    root = scratch_path(spark, "run")
    params = Params(regimes=REGIMES, methods=("cv",))
    pipeline.run(spark, root, params, series(spark, sf_dir), supplier_attributes(spark, sf_dir), pipeline.STAGES[:2])
    again = pipeline.run(spark, root, params, stages=pipeline.STAGES[2:])
    return again.final.select("entity", *floats("score_final"), "rank_final", "source_methods")


@query
def stage_metrics(spark, sf_dir):
    root = scratch_path(spark, "run")
    params = Params(regimes=REGIMES, bounds=BOUNDS, required_attributes=["attr_a"])
    pipeline.run(spark, root, params, series(spark, sf_dir), supplier_attributes(spark, sf_dir), pipeline.STAGES[:2])
    return pipeline.stage_metrics(spark, root)


@query
def stream_ingest(spark, sf_dir):
    """Landed texts taken up by a stream, some spoiled at first and landed again: the last one counts."""
    landed_at, root = scratch_path(spark, "landed"), scratch_path(spark, "stream-store")
    texts = landed_texts(spark, sf_dir)
    hit = F.pmod(F.xxhash64("entity"), F.lit(3)) == 0
    spoiled = texts.withColumn("raw", F.when(hit, F.expr("concat(raw, '99,1e9,1,1,1,1,1\n98,n/a,1,1,1,1,1\n')")).otherwise(F.col("raw")))
    for landing_of in (spoiled, texts.where(hit)):
        landing_of.write.mode("append").parquet(landed_at)
        ingest_stream(spark.readStream.schema(texts.schema).parquet(landed_at), root, LAYOUT).awaitTermination()
    saved = tables.saved_series(spark, root)
    return arrays.array_features(saved).select("entity", "regime", "n_points", "n_bad", "peak_pos")


LANDED_PARAMS = Params(regimes=LANDED_REGIMES, bounds=PAGE_BOUNDS)


def _landed_run(spark, sf_dir) -> str:
    """Listing pages and files on disk through every stage, the first time with a part of the listing only."""
    folder, root = scratch_path(spark, "landed"), scratch_path(spark, "run")
    landed_folder(spark, landed_texts(spark, sf_dir), folder)
    listing = landed_listing(spark, sf_dir)
    whole = Landed(listing, folder, landed_pages(spark, sf_dir), occurrence=2, name_pattern=FILE_IN_FOLDER, layout=LAYOUT)
    pipeline.run(spark, root, LANDED_PARAMS, stages=("ingest",), landed=replace(whole, listing=listing.where("page < 4")))
    pipeline.run(spark, root, LANDED_PARAMS, landed=whole)  # goes on where the first stopped
    return root


@query
def landed_to_summary(spark, sf_dir):
    root = _landed_run(spark, sf_dir)
    # The store is complete now: its rows are taken as they are, and nothing more is ingested.
    summary = pipeline.run(spark, root, LANDED_PARAMS, stages=pipeline.STAGES[3:]).summary
    return summary.select(
        "entity", *floats("score_final"), "rank_final", "source_methods", "rank_factor", "rank_cv", "rank_cv_factor"
    )


@query
def landed_rejects(spark, sf_dir):
    """Why entities of the landed run were rejected, the attributes of their pages included."""
    return split_tagged(Stages(spark, _landed_run(spark, sf_dir)).read("tagged"))[1]


# ---- projections, filters, strings -------------------------------------------


@query
def split_label(spark, sf_dir):
    label = F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(
        F.concat_ws(" - ", "p_brand", "p_name", "p_type")
    )
    name, desc = text.split_label(F.col("label"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).select(
        "p_partkey", name.alias("name"), desc.alias("desc")
    )


@query
def extract_key(spark, sf_dir):
    key = text.extract_key(F.col("url"), r"\?(?:.*&)?ref=(.+)$")
    return table(spark, sf_dir, "pages").select(
        "page_id", key.alias("key"), F.concat(F.lit("/landed?key="), key, F.lit("-"), F.lit("A")).alias("address")
    )


@query
def feature_projection(spark, sf_dir):
    joined = wide.attach_attributes(wide.complete_features(entities(spark, sf_dir), REGIMES), supplier_attributes(spark, sf_dir))
    return joined.select(*floats(*wide.feature_projection(joined, ["entity", "attr_a", "attr_b"])))


@query
def direction_split(spark, sf_dir):
    all_rows = entities(spark, sf_dir)
    lower, _ = wide.direction_split([c for c in all_rows.columns if c not in ("entity", "gate")])
    values = stats.long_values(all_rows, COLUMNS).select(
        F.element_at(F.array(*(F.lit(c) for c in COLUMNS)), F.col("i") + 1).alias("feature"), "v"
    )
    return values.groupBy(
        "feature", F.when(F.col("feature").isin(lower), "lower").otherwise("higher").alias("direction")
    ).agg(F.count("v").alias("n_values"))


@query
def complete_cases(spark, sf_dir):
    as_text = wide.to_wide(series(spark, sf_dir), REGIMES).withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in COLUMNS[:2]}
    )
    return wide.complete_cases(as_text, COLUMNS).select("entity", *floats(*COLUMNS))


@query
def drop_incomplete(spark, sf_dir):
    kept, failed = wide.drop_incomplete(wide.to_wide(series(spark, sf_dir), REGIMES), COLUMNS)
    return kept.select("entity", F.lit("").alias("stage"), F.lit("").alias("reason")).unionByName(failed)


@query
def attr_required(spark, sf_dir):
    joined = wide.attach_attributes(wide.complete_features(entities(spark, sf_dir), REGIMES), supplier_attributes(spark, sf_dir))
    return joined.dropna(subset=["attr_a", "attr_b"]).select("entity", *floats("attr_a"), "attr_b")


@query
def range_filter(spark, sf_dir):
    return wide.range_filter(supplier_attributes(spark, sf_dir), BOUNDS).select("entity", *floats("attr_a"), "attr_b")


@query
def range_reject_reason(spark, sf_dir):
    reason = wide.range_reason(BOUNDS)
    return supplier_attributes(spark, sf_dir).select("entity", reason.alias("reason")).where(F.col("reason").isNotNull())


@query
def missing_attr_report(spark, sf_dir):
    report = wide.missing_attribute_report(supplier_attributes(spark, sf_dir), "attr_a")
    return report.select("n_missing", F.array_join("first_entities", ",").alias("first_entities"))


@query
def filter_attributes(spark, sf_dir):
    tagged = wide.tag_attributes(
        wide.complete_features(entities(spark, sf_dir), REGIMES), supplier_attributes(spark, sf_dir), ["attr_a"], BOUNDS
    )
    return tagged.select("entity", F.coalesce("stage", F.lit("kept")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason"))


# ---- validation ----------------------------------------------------------------


@query
def validate_min_regimes(spark, sf_dir):
    checked = gate.validate(series(spark, sf_dir, "l_orderkey"), REGIMES)
    return checked.select("entity", "n_series", F.col("reason").startswith("fewer").alias("too_few"))


@query
def validate_numeric(spark, sf_dir):
    damaged = series(spark, sf_dir, d=F.when(F.col("l_tax") * F.col("l_quantity") < 3.9, F.lit(100.0)).otherwise(F.lit(float("nan"))))
    return damaged.select("entity", "regime", "n_points", "n_bad", gate.series_reason().alias("reason")).where("n_bad > 0")


@query
def validate_fall_region(spark, sf_dir):
    return series(spark, sf_dir, "l_partkey").select(
        "entity", "regime", "n_points", "peak_pos", "n_fall", gate.series_reason().alias("reason")
    )


@query
def reject_reasons(spark, sf_dir):
    return gate.rejects(gate.validate(series(spark, sf_dir, "l_partkey"), REGIMES))


@query
def all_rejects(spark, sf_dir):
    return wide.entity_rejects(entities(spark, sf_dir), REGIMES)


@query
def valid_entities(spark, sf_dir):
    return gate.valid_entities(gate.validate(series(spark, sf_dir), REGIMES))


# ---- series features -------------------------------------------------------------


@query
def series_peak(spark, sf_dir):
    tied = series(spark, sf_dir, y=F.col("l_quantity"))  # whole numbers: the first of many equal peaks counts
    return tied.select("entity", "regime", "n_points", "peak_pos", *floats("yMax"))


@query
def filtered_diff(spark, sf_dir):
    kept = supplier_points(spark, sf_dir).where("y > 0 and x >= 0").select("*", *(F.col("y").alias(s) for s in points.SEGMENTS))
    return points.segment_steps(kept, points.SERIES).select("entity", "regime", *floats("x", "y", "rise_step"))


def _feature_query(name: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: series(spark, sf_dir).select("entity", "regime", *floats(*columns))


_feature_query("feat_y_max", "yMax")
_feature_query("feat_rise_rate", "yStdRate", "yMeanRate")
_feature_query("feat_fall_rate", "yStdFallRate", "yMeanFallRate")
_feature_query("feat_cost", "dMax", "dStdRate", "dMeanRate")
_feature_query("feat_first_crossing", "mAtZero")
_feature_query("feat_ratio_peak", "ratioMax", "ratioMaxX")


def _all_features(df: DataFrame) -> DataFrame:
    return df.select("entity", "regime", "n_points", "n_bad", "peak_pos", "n_fall", *floats(*FEATURES))


@query
def series_features(spark, sf_dir):
    return _all_features(series(spark, sf_dir))


@query
def series_features_split(spark, sf_dir):
    """The same with every series of more than 210 points cut into pieces."""
    return _all_features(points.series_features(supplier_points(spark, sf_dir), hot_rows=210))


@query
def series_features_parts(spark, sf_dir):
    return _all_features(series(spark, sf_dir, "l_partkey"))


@query
def series_features_arrays(spark, sf_dir):
    return _all_features(arrays.array_features(landed_series(spark, sf_dir)))


@query
def wide_features(spark, sf_dir):
    """Every series twice, the first time with spoiled features: the later row wins."""
    good = series(spark, sf_dir)
    spoiled = good.withColumns({f: F.lit(-1.0) for f in FEATURES}).withColumn("seq", F.lit(0))
    both = good.withColumn("seq", F.lit(1)).unionByName(spoiled)
    return wide.to_wide(both, REGIMES).select("entity", *floats(*COLUMNS))


@query
def regime_subset(spark, sf_dir):
    """Two of the five event types as regimes, four series enough."""
    ev = table(spark, sf_dir, "events")
    pts = points.as_points(
        ev,
        entity=F.col("user_id"),
        regime=F.col("event_type"),
        order=[F.col("event_id")],
        x=F.col("event_id") - 500,
        y=F.col("value") - 5,
        d=F.col("value") + 1,
        m=F.get_json_object("props", "$.k").try_cast("double"),
    )
    chosen = ["click", "error"]
    table_ = wide.entity_table(points.series_features(pts), chosen, min_series=4, min_fall_points=2)
    return table_.select("entity", "gate", *floats(*feature_columns(chosen)))


# ---- joins -----------------------------------------------------------------------


@query
def attach_attributes(spark, sf_dir):
    joined = wide.attach_attributes(wide.complete_features(entities(spark, sf_dir), REGIMES), supplier_attributes(spark, sf_dir))
    return joined.select("entity", *floats(COLUMNS[2], "attr_a"), "attr_b")


@query
def first_per_key(spark, sf_dir):
    return wide.first_per_key(
        table(spark, sf_dir, "orders"),
        "o_custkey",
        ["o_orderkey", "o_orderstatus", "o_totalprice"],
        [F.col("o_orderdate"), F.col("o_orderkey")],
    )


@query
def series_attributes(spark, sf_dir):
    rows = series(spark, sf_dir, "l_partkey").select("entity", "regime", F.col("n_points").alias("attr_a"))
    return wide.series_attributes(rows, ["R", "A"], ["attr_a", "regime"])


# ---- column statistics -----------------------------------------------------------


@query
def column_stats(spark, sf_dir):
    df = features(spark, sf_dir)
    found = stats.column_stats(df, COLUMNS)
    rows = [(c, s.n, s.mean, s.std, s.low, s.high, s.total) for c, s in found.items()]
    out = spark.createDataFrame(rows, "feature string, n long, mean double, std double, low double, high double, total double")
    return out.select("feature", "n", *floats("mean", "std", "low", "high", "total"))


def _per_column(spark, sf_dir, expression: Callable[[str, stats.ColumnStats], Column]) -> DataFrame:
    df = features(spark, sf_dir)
    found = stats.column_stats(df, COLUMNS)
    return df.select("entity", *(stable(expression(c, found[c])).alias(c) for c in COLUMNS))


@query
def zscore_eps(spark, sf_dir):
    return _per_column(spark, sf_dir, lambda c, s: stats.zscore(c, s, stats.EPSILON))


@query
def zscore_sample(spark, sf_dir):
    return _per_column(spark, sf_dir, stats.zscore)


@query
def minmax_scale(spark, sf_dir):
    return _per_column(spark, sf_dir, stats.minmax)


@query
def column_share(spark, sf_dir):
    return _per_column(spark, sf_dir, stats.share)


def _zero_replaced(spark, sf_dir) -> DataFrame:
    df = features(spark, sf_dir)
    found = stats.column_stats(df, COLUMNS)
    scaled = df.select("entity", *(stats.minmax(c, found[c]).alias(c) for c in COLUMNS))
    small = stats.smallest_nonzero(scaled, COLUMNS)
    return scaled.select("entity", *(stats.zero_replace(c, small[c]).alias(c) for c in COLUMNS))


@query
def zero_replace(spark, sf_dir):
    return _zero_replaced(spark, sf_dir).select("entity", *floats(*COLUMNS))


@query
def invert_lower(spark, sf_dir):
    lower = set(wide.direction_split(COLUMNS)[0])
    df = _zero_replaced(spark, sf_dir)
    return df.select("entity", *(stable(stats.invert(c) if c in lower else c).alias(c) for c in COLUMNS))


@query
def cv_weights(spark, sf_dir):
    lower, _ = wide.direction_split(COLUMNS)
    weights = stats.fit_scaled(features(spark, sf_dir), COLUMNS, lower).weights
    return spark.createDataFrame(list(weights.items()), "feature string, weight double").select("feature", *floats("weight"))


# ---- factor analysis -------------------------------------------------------------


@query
def correlation_matrix(spark, sf_dir):
    matrix = factor.correlation_matrix(features(spark, sf_dir), COLUMNS)
    return factor.matrix_table(spark, COLUMNS, matrix).select("a", "b", *floats("r"))


def _joint_model(spark, sf_dir) -> tuple[DataFrame, factor.FactorModel]:
    df = features(spark, sf_dir)
    return df, factor.fit_factors(df, COLUMNS, PARAMS.max_factors_joint)


@query
def factor_eigen(spark, sf_dir):
    _, model = _joint_model(spark, sf_dir)
    rows = [
        (j + 1, float(model.eigenvalues[j]), c, float(model.vectors[i, j]))
        for j in range(model.kept)
        for i, c in enumerate(model.columns)
    ]
    out = spark.createDataFrame(rows, "factor long, eigenvalue double, feature string, component double")
    return out.select("factor", "feature", *floats("eigenvalue", "component"))


@query
def factor_reconstruction(spark, sf_dir):
    """Eigenvalues and vectors multiplied back together: the correlation matrix again."""
    _, model = _joint_model(spark, sf_dir)
    matrix = (model.vectors * model.eigenvalues) @ model.vectors.T
    return factor.matrix_table(spark, COLUMNS, matrix).select("a", "b", *floats("r"))


@query
def factor_count(spark, sf_dir):
    df = features(spark, sf_dir)
    lower, higher = wide.direction_split(COLUMNS)
    rows = []
    for group, columns, cap in (("lower", lower, 8), ("higher", higher, 3), ("joint", COLUMNS, 10)):
        model = factor.fit_factors(df, columns, cap)
        rows.append((group, int((model.eigenvalues > 1).sum()), model.kept, float(model.shares.sum())))
    out = spark.createDataFrame(rows, "columns string, above_one long, kept long, explained double")
    return out.select("columns", "above_one", "kept", *floats("explained"))


@query
def factor_loadings(spark, sf_dir):
    _, model = _joint_model(spark, sf_dir)
    return model.loadings_table(spark).select("feature", "factor", *floats("loading"))


@query
def variance_table(spark, sf_dir):
    _, model = _joint_model(spark, sf_dir)
    return model.variance_table(spark).select("factor", *floats("eigenvalue", "variance", "cumulative"))


@query
def factor_scores(spark, sf_dir):
    df, model = _joint_model(spark, sf_dir)
    scores = model.scores()
    wide_scores = df.select("entity", *(c.alias(n) for n, c in scores.items()))
    pairs = wide_scores.select("entity", F.posexplode(F.array(*scores)).alias("i", "score"))
    return pairs.select("entity", (F.col("i") + 1).cast("long").alias("factor"), *floats("score"))


# ---- rankings ----------------------------------------------------------------------


@query
def rank_factor(spark, sf_dir):
    ranked = rankers.rank_factor(features(spark, sf_dir), PARAMS)
    return ranked.select("entity", *floats("score_L", "score_G"), "rank_L", "rank_G", "rank_sum")


@query
def rank_cv(spark, sf_dir):
    return rankers.rank_cv(features(spark, sf_dir), PARAMS).select("entity", *floats("score_cv"), "rank_cv")


@query
def rank_cv_factor(spark, sf_dir):
    ranked = rankers.rank_cv_factor(features(spark, sf_dir), PARAMS)
    return ranked.select("entity", *floats("score_cv_factor"), "rank_cv_factor")


def _by_column(column: str, ascending: bool, out: str):
    def ranker(df: DataFrame, params: Params) -> DataFrame:
        scored = df.select("entity", F.col(column).alias(f"score_{out}"))
        return ranking.global_rank(scored, f"score_{out}", f"rank_{out}", ascending)

    return ranker


rankers.register("peak", _by_column("R_yMax", False, "peak"), "rank_peak")
rankers.register("steady", _by_column("A_yStdFallRate", True, "steady"), "rank_steady")
SIMPLE = ("peak", "cv", "steady")


def _simple_rankings(spark, sf_dir) -> tuple[DataFrame, list[tuple[str, DataFrame, str]]]:
    df = features(spark, sf_dir)
    chosen = [rankers.method(n) for n in SIMPLE]
    return df, [(m.label, materialize(m.ranker(df, PARAMS), m.label), m.rank) for m in chosen]


@query
def candidate_pool(spark, sf_dir):
    df, nominators = _simple_rankings(spark, sf_dir)
    return pool.candidate_pool(df, nominators, 5).select("entity", *floats(COLUMNS[2]), "source_methods")


@query
def rank_zscore_weighted(spark, sf_dir):
    """The weighted score over every complete entity, not over a shortlist."""
    ranked = pool.rank_zscore_weighted(features(spark, sf_dir), default_weights(REGIMES), COLUMNS)
    return ranked.select("entity", *floats("score_final"), "rank_final")


@query
def custom_ranker(spark, sf_dir):
    """A run with user-registered methods only, through every stage."""
    root = scratch_path(spark, "run")
    params = Params(regimes=REGIMES, methods=SIMPLE)
    result = pipeline.run(spark, root, params, series(spark, sf_dir), supplier_attributes(spark, sf_dir))
    return pipeline.report(result.final).select("rank_final", "entity", *floats("score_final"), "source_methods")


@query
def summary_join(spark, sf_dir):
    df, nominators = _simple_rankings(spark, sf_dir)
    shortlist = materialize(pool.candidate_pool(df, nominators, 5), "pool")
    final = pool.final_ranking(shortlist, default_weights(REGIMES), COLUMNS)
    summary = pool.final_summary(final, [(rank, df_, rank) for _, df_, rank in nominators])
    return summary.select("entity", *floats("score_final"), "rank_final", "source_methods", *(r for _, _, r in nominators))


def _full_run(spark, sf_dir) -> pipeline.Result:
    root = scratch_path(spark, "run")
    return pipeline.run(spark, root, PARAMS, series(spark, sf_dir), supplier_attributes(spark, sf_dir))


@query
def final_ranking(spark, sf_dir):
    final = _full_run(spark, sf_dir).final
    return final.select("entity", *floats("score_final"), "rank_final", "source_methods")


@query
def final_summary(spark, sf_dir):
    summary = _full_run(spark, sf_dir).summary
    return summary.select(
        "entity", *floats("score_final"), "rank_final", "source_methods", "rank_factor", "rank_cv", "rank_cv_factor"
    )


def _ranked_run(spark, sf_dir) -> str:
    root = scratch_path(spark, "run")
    pipeline.run(spark, root, PARAMS, series(spark, sf_dir), stages=pipeline.STAGES[:3])
    return root


@query
def saved_models(spark, sf_dir):
    """What the factors of a run explain, from the models it saved."""
    found = models.explained(Stages(spark, _ranked_run(spark, sf_dir)).read("factor_models"))
    return found.select(F.col("fit").alias("columns"), "above_one", "kept", *floats("explained"))


@query
def saved_scores(spark, sf_dir):
    """Rows scored by the models that a run saved, which is how new rows get scores comparable with the old."""
    root = _ranked_run(spark, sf_dir)
    rows = split_tagged(Stages(spark, root).read("tagged"))[0]
    found = pipeline.saved_scores(spark, root, rows)
    return found.select("entity", *floats("score_L", "score_G", "score_cv", "score_cv_factor"))


@query
def topn_report(spark, sf_dir):
    _, nominators = _simple_rankings(spark, sf_dir)
    return ranking.topn_report(nominators, 5)


@query
def global_rank(spark, sf_dir):
    """Shipments by quantity: fifty values over the whole table, so almost every row ties."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ranking.global_rank(li, "l_quantity", "rank_quantity", key="l_orderkey", rows_per_task=5_000)


@query
def global_rank_ascending(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    orders = orders.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 2000, F.col("o_totalprice")))
    return ranking.global_rank(orders, "o_totalprice", "rank_price", True, "o_orderkey", rows_per_task=1_000).select(
        "o_orderkey", *floats("o_totalprice"), "rank_price"
    )


@query
def topk(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    ranked = ranking.global_rank(part, "p_retailprice", "rank_price", key="p_partkey")
    return ranking.topk(ranked, "rank_price", 25, "p_partkey").select("p_partkey", "p_size", "rank_price")


@query
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name")
    )
    return a.unionByName(b, allowMissingColumns=True).select("name", "balance", "segment")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers rank best on their shipment series?"""
    return rank_cv(spark, sf_dir)
