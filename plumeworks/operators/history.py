"""The read model: scoped lookups, history filters, pages and the nested detail."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES
from ..functions.text import contains_literal

# Vocabularies of the read model.
STATUSES = ("pending", "queued", "running", "done", "failed")
ACTIVE = ("pending", "queued", "running")
VEHICLE_TYPES = ("car", "motorcycle", "bus", "truck")
SORT_KEYS = ("created_at", "avg_confidence", "total_vehicles", "total_smoke", "status", "overall_severity")
PAGE_SIZE, MAX_PAGE_SIZE = 10, 100


def owned(df: DataFrame, user_id: int, widen: bool = False) -> DataFrame:
    """Rows of one account; an administrator's list may widen to all."""
    return df if widen else df.where(F.col("user_id") == user_id)


def one(df: DataFrame, key: str, value, user_id: int | None = None) -> DataFrame:
    """A row by key, and by owner where one is given; what is not owned is not found."""
    found = df.where(F.col(key) == value)
    return (found if user_id is None else found.where(F.col("user_id") == user_id)).limit(1)


@dataclass(frozen=True)
class HistoryFilter:
    """Optional filters, joined by AND. An unknown choice is an error."""

    status: str | None = None
    severity: str | None = None
    vehicle_type: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    search: str | None = None
    ordering: str = "-created_at"

    def __post_init__(self):
        for name, value, known in (("status", self.status, STATUSES), ("severity", self.severity, SEVERITIES), ("vehicle_type", self.vehicle_type, VEHICLE_TYPES), ("ordering", self.ordering.lstrip("-"), SORT_KEYS)):
            if value is not None and value not in known:
                raise ValueError(f"unknown {name}: {value!r}")

    def predicates(self) -> list[Column]:
        found = []
        if self.status:
            found.append(F.col("status") == self.status)
        if self.severity:
            found.append(F.col("overall_severity") == self.severity)
        # on the raw column, where a day's range reaches the scan
        if self.date_from:
            found.append(F.to_date("created_at") >= F.lit(self.date_from))
        if self.date_to:
            found.append(F.to_date("created_at") <= F.lit(self.date_to))
        return found

    def apply(self, runs: DataFrame, media: DataFrame, vehicles: DataFrame) -> DataFrame:
        for p in self.predicates():
            runs = runs.where(p)
        if self.vehicle_type:
            runs = runs.join(vehicles.where(F.col("vehicle_type") == self.vehicle_type).select("analysis_id"), "analysis_id", "left_semi")
        rows = runs.join(media.select("media_id", "filename", "media_type"), "media_id")
        return rows.where(contains_literal(F.col("filename"), self.search)) if self.search else rows

    def order(self) -> list[Column]:
        """The chosen key, then the primary key, so that pages do not overlap."""
        key = F.col(self.ordering.lstrip("-"))
        return [key.desc_nulls_last() if self.ordering.startswith("-") else key.asc_nulls_first(), F.col("analysis_id").asc()]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of rows; the size is kept within its bound.

    What stands before the page passes the driver too, so deep pages are better reached by page_after().
    """
    size = max(1, min(MAX_PAGE_SIZE, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, ordering: str, last: tuple | None, size: int = PAGE_SIZE) -> DataFrame:
    """The page behind the row `last` (its sort key and analysis_id; None for the first page), in the order of HistoryFilter.

    Its cost does not grow with the number of the page: the key filters the scan, and one page of rows goes to the driver.
    """
    name, down = ordering.lstrip("-"), ordering.startswith("-")
    if name not in SORT_KEYS:
        raise ValueError(f"unknown ordering: {ordering!r}")
    key = F.col(name)
    if last is not None:
        value, at = last
        behind = F.col("analysis_id") > at
        if value is None:  # nulls come last when the order falls and first when it rises
            df = df.where((key.isNull() & behind) if down else (key.isNotNull() | behind))
        elif down:
            df = df.where((key < F.lit(value)) | key.isNull() | ((key == F.lit(value)) & behind))
        else:
            df = df.where((key > F.lit(value)) | ((key == F.lit(value)) & behind))
    order = [key.desc_nulls_last() if down else key.asc_nulls_first(), F.col("analysis_id").asc()]
    return df.orderBy(*order).limit(max(1, min(MAX_PAGE_SIZE, size)))


def page_envelope(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Count, pages, and the numbers of the pages before and behind."""
    size = max(1, min(MAX_PAGE_SIZE, size))
    pages = F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("bigint")
    rows = df.agg(F.count("*").alias("count")).select("count", F.lit(number).alias("page"), pages.alias("pages"), F.lit(size).alias("page_size"))
    return rows.select("*", F.when(F.col("page") < F.col("pages"), F.col("page") + 1).alias("next_page"), F.when(F.col("page") > 1, F.col("page") - 1).alias("previous_page"))


def with_report(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs with their report, if there is one, and the reconciled report status."""
    joined = runs.join(reports.select("analysis_id", "report_id", "generated_at", "page_count"), "analysis_id", "left")
    status = F.when((F.col("report_status") == "pending") & F.col("report_id").isNotNull(), "ready").otherwise(F.col("report_status"))
    return joined.withColumn("report_state", status)


# What a client that waits for a run is told, and the media types that lists may be narrowed to.
STATUS_FIELDS = ("analysis_id", "status", "progress", "stage", "start_time", "end_time", "error_message", "total_vehicles", "total_smoke", "overall_severity", "report_id")
MEDIA_TYPES = ("image", "video")
#: Key of a run's snapshot under which facts of its running stand, which are not settings.
RUNTIME = "_runtime"


def status_poll(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Exactly the columns of a status, from a scan that reads no others."""
    return runs.join(reports.select("analysis_id", "report_id"), "analysis_id", "left").select(*STATUS_FIELDS)


def media_list(media: DataFrame, user_id: int, media_type: str | None = None) -> DataFrame:
    """An account's media, narrowed to a type; a type that there isn't is ignored."""
    rows = owned(media, user_id)
    return rows.where(F.col("media_type") == media_type) if media_type in MEDIA_TYPES else rows


def media_url(path: Column) -> Column:
    """Where clients find a stored file, null for none."""
    return F.when(F.length(path) > 0, F.concat(F.lit("/media/"), F.ltrim(path, F.lit("/"))))


def public_detail(runs: DataFrame) -> DataFrame:
    """Runs with their settings as frozen, without the facts of the running, and those facts on their own.

    runs: analysis_id and settings_snapshot, a JSON object, which may be null or broken.
    """
    snapshot = F.coalesce(F.try_parse_json("settings_snapshot").cast("map<string,variant>"), F.expr("map()").cast("map<string,variant>"))
    fact = lambda name: F.get_json_object("settings_snapshot", f"$.{RUNTIME}.{name}")
    frames = F.filter(F.transform(F.coalesce(F.from_json(fact("annotated_frames"), "array<string>"), F.array().cast("array<string>")), media_url), lambda u: u.isNotNull())
    return runs.select("analysis_id", F.map_filter(snapshot, lambda k, _: k != RUNTIME).alias("settings"), frames.alias("annotated_frames"), *(F.coalesce(fact(n), F.lit("")).alias(n) for n in ("segmenter_mode", "device")))


def public_box(box: Column) -> Column:
    """A stored box, a JSON object, as four whole numbers, 0 for what is missing or no number."""
    side = lambda c: F.coalesce(F.get_json_object(box, f"$.{c}").try_cast("int"), F.lit(0)).alias(c)
    return F.struct(*(side(c) for c in "xywh"))


def public(runs: DataFrame) -> DataFrame:
    """The API's projection: no empty strings, a URL for a preview."""
    return runs.select("analysis_id", "status", F.nullif("overall_severity", F.lit("")).alias("overall_severity"), F.concat(F.lit("/media/previews/"), F.col("analysis_id"), F.lit(".jpg")).alias("preview_url"))


def detail_tree(runs: DataFrame, vehicles: DataFrame, regions: DataFrame) -> DataFrame:
    """Runs with their vehicles in frame order, each with its regions, the worst first.

    Vehicles and regions both name their run, so they are dealt by it once and both levels are built there.
    Of several rows of a vehicle the least one by type, frame and confidence counts.
    """
    car = F.struct("vehicle_type", "frame_number", "confidence")
    region = F.struct("intensity", "confidence", "area_ratio", "opacity")
    none = lambda of: F.lit(None).cast(of)
    cars = vehicles.select("analysis_id", "vehicle_id", car.alias("car"))
    found = regions.select("analysis_id", "vehicle_id", region.alias("region"))
    kinds = {"car": cars.schema["car"].dataType, "region": found.schema["region"].dataType}
    both = cars.withColumn("region", none(kinds["region"])).unionByName(found.withColumn("car", none(kinds["car"]))).repartition("analysis_id")
    each = both.groupBy("analysis_id", "vehicle_id").agg(F.min("car").alias("car"), F.sort_array(F.collect_list("region"), asc=False).alias("regions")).where("car is not null")
    nested = F.struct(F.coalesce("car.frame_number", F.lit(-1)).alias("frame"), (-F.col("car.confidence")).alias("order"), "vehicle_id", "car.vehicle_type", "car.confidence", "regions")
    return runs.join(each.groupBy("analysis_id").agg(F.array_sort(F.collect_list(nested)).alias("vehicles")), "analysis_id", "left")


def latest_child(parents: DataFrame, children: DataFrame, key: str, at: str, columns: list[str], tie: str) -> DataFrame:
    """Each parent with its newest child, or nulls."""
    newest = children.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("child"))
    return parents.join(newest, key, "left").select(*parents.columns, *(F.col(f"child.{c}").alias(c) for c in columns))


def exists(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is gone."""
    return children.join(parents.select(key), key, "left_anti")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", rank).where(F.col("place") <= k)
