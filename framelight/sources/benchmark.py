"""Benchmark inputs: manifests, case lists and policy observations as JSON texts, one file a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CASE = "struct<case_id:string,variant:string,source:string,expected_video_ref:string,duration_ms:bigint,timestamp_ms:bigint,query_image_path:string>"
_OBSERVATION = "struct<case_id:string,predicted_video_ref:string,predicted_timestamp_ms:bigint,ranked_video_refs:array<string>,ranked_videos:array<string>,frame_count:int>"


def manifest_cases(files: DataFrame) -> DataFrame:
    """Cases of manifests {"cases": [...]}, with relative query paths below the manifest's folder. files: folder, content."""
    rows = files.select("folder", F.posexplode(F.from_json("content", f"struct<cases:array<{_CASE}>>")["cases"]).alias("position", "c")).select("folder", "position", "c.*")
    path = F.when(F.col("query_image_path").startswith("/"), F.col("query_image_path")).otherwise(F.concat("folder", F.lit("/"), "query_image_path"))
    return rows.withColumn("query_image_path", path)


def with_defaults(cases: DataFrame) -> DataFrame:
    """Cases with a missing id, variant, source or path filled in: case-NNNNNN by position, exact, local, sidecar/id. cases: position and the fields of a case."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    case = F.coalesce(blank("case_id"), F.format_string("case-%06d", "position"))
    return cases.withColumns({
        "case_id": case, "variant": F.coalesce(blank("variant"), F.lit("exact")), "source": F.coalesce(F.lower(blank("source")), F.lit("local")),
        "query_image_path": F.coalesce(blank("query_image_path"), F.concat(F.lit("sidecar/"), case)),
    })


def observations(files: DataFrame) -> DataFrame:
    """Observations of files that hold a list, or an object with observations or results. files: policy, content.

    ranked_videos is another name of ranked_video_refs; without both, the predicted item is the whole ranking. Rows without case_id, and
    negative times or frame counts, are faults: ``fault`` names the field.
    """
    wrapped = F.from_json("content", f"struct<observations:array<{_OBSERVATION}>,results:array<{_OBSERVATION}>>")
    bare = F.from_json("content", f"array<{_OBSERVATION}>")
    rows = F.when(F.ltrim("content").startswith("["), bare).otherwise(F.coalesce(wrapped["observations"], wrapped["results"]))
    o = files.select("policy", F.posexplode(rows).alias("position", "o")).select("policy", "position", "o.*")
    given = F.coalesce(F.when(F.size("ranked_video_refs") > 0, F.col("ranked_video_refs")), F.when(F.size("ranked_videos") > 0, F.col("ranked_videos")))
    ranked = F.coalesce(given, F.when(F.col("predicted_video_ref").isNotNull(), F.array("predicted_video_ref")), F.expr("cast(array() as array<string>)"))
    fault = (
        F.when(F.trim(F.coalesce("case_id", F.lit(""))) == "", "case_id").when(F.col("predicted_timestamp_ms") < 0, "predicted_timestamp_ms").when(F.col("frame_count") < 0, "frame_count")
    )
    return o.select("policy", "position", "case_id", F.col("predicted_video_ref").alias("predicted"), "predicted_timestamp_ms", ranked.alias("ranked"), F.coalesce("frame_count", F.lit(0)).alias("frame_count"), fault.alias("fault"))
