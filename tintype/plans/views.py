"""The input tables seen as the dataset's own tables.

Each view is one SELECT that Spark and DuckDB both read; ``sha256_of`` names the one function that
they call differently. ``view`` runs it in Spark, ``sql`` gives it for an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tintype.schemas import DAMAGE_LABELS

_FORMAT = "case doc_id % 6 when 0 then 'JPEG' when 1 then 'PNG' when 2 then 'TIFF' when 3 then 'WEBP' when 4 then 'GIF' end"
_QUALITY = "case doc_id % 9 when 0 then 'clean_target_ok' when 1 then 'existing_damage' when 2 then 'blurred' when 3 then 'watermark' when 4 then 'compression_artifact' when 5 then 'low_resolution' when 6 then 'bad_crop' when 7 then 'duplicate' else 'bad_value' end"
_CONTENT = "case when doc_id % 23 = 0 then '' else case doc_id % 7 when 0 then 'single_portrait' when 1 then 'group_portrait' when 2 then 'indoor_scene' when 3 then 'outdoor_scene' when 4 then 'architecture' when 5 then 'document' else 'other' end end"


def _severity(k: int, other: bool) -> str:
    v = f"(doc_id * {k + 3} + n_chars" + (" + (doc_id % 2) * 3" if other else "") + ")"
    return f"case when {v} % 400 = 399 then '' when {v} % 10 < 6 then '0' when {v} % 10 < 8 then '1' when {v} % 10 = 8 then '2' else '3' end as {DAMAGE_LABELS[k - 1]}"


def _annotations(other: bool) -> str:
    return f"""select doc_id as pos, 'src_' || cast(doc_id as string) as source_id, {", ".join(_severity(k, other) for k in range(1, 15))},
        case doc_id % 5 when 0 then 'PENDING_MANUAL' when 1 then 'REVIEWED' when 2 then 'REVIEWED' else 'ANNOTATED' end as status,
        case when doc_id % 17 = 0 then '' else 'ann_' || cast(doc_id % 4 as string) end as annotator,
        case when doc_id % 10 = 0 then '1' else '0' end as uncertain, case when doc_id % 20 = 0 then '' else 'note' end as notes
        from documents"""


VIEWS = {
    "manifest": f"""select doc_id as pos, 'doc_' || cast(doc_id as string) as id, 'src_' || cast(cast(floor(doc_id / 3) as bigint) as string) as source_id,
        source as provider, lang as language,
        case doc_id % 8 when 0 then 'Public Domain' when 1 then 'CC0' when 2 then 'CC-BY-4.0' when 3 then '  cc0   1.0 ' when 4 then 'CC BY-SA 4.0' when 5 then '' when 7 then 'CC BY 3.0' end as license,
        256 + (n_chars * 7) % 1800 as width, 256 + (n_chars * 13) % 1500 as height, n_chars >= 20 as decode_ok, sha256_of(text) as sha256,
        'img_' || cast(doc_id as string) || case when doc_id % 19 = 0 then ' 1.jpg' else '.jpg' end as filename,
        {_FORMAT} as format, {_QUALITY} as quality_label, {_CONTENT} as content_type, n_chars
        from documents""",
    "annotations": _annotations(False),
    "annotations_b": _annotations(True),
    "clean_files": "select 'p_' || cast(p_partkey as string) || '.jpg' as filename, p_partkey from part",
    "damaged_files": "select 'p_' || cast(p_partkey as string) || '.jpg' as filename, p_partkey from part where p_partkey % 10 <> 0",
    "degraded_files": """select 'p_' || cast(p_partkey as string) || '_(Noise_JPEG_Blur).jpg' as filename, p_partkey from part where p_partkey % 3 <> 0
        union all select 'p_' || cast(p_partkey as string) || '_(Complex_All).jpg' as filename, p_partkey from part where p_partkey % 4 <> 0""",
    "catalog_items": """select page_id as pos, url, page_id,
        case when page_id % 2 = 0 then 'One, ' || cast(page_id as string) else '["A ' || cast(page_id as string) || '","B"]' end as contributor,
        case when page_id % 7 = 0 then true when page_id % 7 in (1, 2) then null else false end as access_restricted,
        case when page_id % 7 = 1 then false when page_id % 7 = 3 then null else true end as unrestricted,
        case page_id % 8 when 0 then 'Public Domain' when 1 then 'CC0' when 2 then 'CC-BY-4.0' when 3 then '  cc0   1.0 ' when 4 then 'CC BY-SA 4.0' when 5 then '' when 7 then 'CC BY 3.0' end as license,
        length(html) as size, sha256_of(html) as sha256 from pages""",
    "task_events": """select cast(user_id as string) as task_id, ts, event_id,
        case event_type when 'signup' then 'pending' when 'view' then 'detecting' when 'click' then 'processing' when 'purchase' then 'completed' else 'error' end as status,
        case event_id % 3 when 0 then 'quick' when 1 then 'fine' else 'custom' end as mode, value / 100 as strength,
        'photo_' || cast(user_id as string) || case when user_id % 2 = 0 then '.JPG' else '.png' end as filename,
        case when event_id % 5 = 0 then null else 'r_' || cast(event_id as string) end as restored_url, 'u_' || cast(event_id as string) as result_url
        from events""",
    "status_log": """select cast(user_id as string) as source_id, ts, event_id,
        case event_type when 'signup' then 'NEW' when 'view' then 'RIGHTS_OK' when 'click' then 'CLEANED' when 'purchase' then 'ANNOTATED' else 'QA_PASS' end as status
        from events""",
    "ratings": "select conv_id as rater, turn % 3 as dim, length(text) % 10 + 1 as score from conversations",
}


def sql(name: str) -> str:
    """The view as DuckDB reads it, for a WITH clause."""
    return f"{name} as ({VIEWS[name].replace('sha256_of', 'sha256')})"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in ``sf_dir``."""
    text = VIEWS[name]
    tables = [t for t in ("documents", "pages", "events", "part", "conversations", "embeddings") if f"from {t}" in text]
    while (at := text.find("sha256_of(")) >= 0:
        end = text.index(")", at)
        text = f"{text[:at]}sha2({text[at + 10 : end]}, 256){text[end + 1 :]}"
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
