"""Fixed names, lists and row types of the dataset tables."""

from pyspark.sql import types as T

# Licences that pass, labels, states and columns, as the dataset rules name them.
LICENSES = ["public domain", "cc0", "cc0 1.0", "cc0 1.0 universal", "cc by 3.0", "cc by 4.0"]
DAMAGE_LABELS = ["scratch", "crack", "fold", "dust", "stain", "mold", "tear", "missing_region", "fading", "color_cast", "blur", "noise", "jpeg_artifact", "uneven_exposure"]
CONTENT_LABELS = ["single_portrait", "group_portrait", "indoor_scene", "outdoor_scene", "architecture", "document", "other"]
QUALITY_LABELS = ["clean_target_ok", "existing_damage", "blurred", "watermark", "compression_artifact", "low_resolution", "bad_crop", "duplicate"]
STATUS_ORDER = ["NEW", "RIGHTS_OK", "CLEANED", "ANNOTATED", "QA_PASS"]
SPLITS = ["train", "validation", "test"]
TASK_STATES = ["idle", "pending", "detecting", "processing", "completed", "error"]
MANIFEST_FIELDS = ["id", "source_id", "filename", "status", "dataset_kind", "provider", "source_url", "author", "license", "rights_url", "downloaded_at", "sha256", "width", "height", "content_type", "color_mode", "quality_label", "split", "annotator", "reviewer", "notes"]
ANNOTATION_FIELDS = ["source_id", *DAMAGE_LABELS, "mask_path", "uncertain", "annotator", "reviewer", "status", "notes"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp"]


def _strings(names: list[str], **other: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, other.get(n, T.StringType())) for n in names])


MANIFEST = _strings(MANIFEST_FIELDS, width=T.IntegerType(), height=T.IntegerType(), downloaded_at=T.TimestampType())
ANNOTATION = _strings(ANNOTATION_FIELDS)
_LIST = T.ArrayType(T.StringType())
RAW_RECORD = _strings(
    ["id", "filename", "provider", "collection", "title", "date", "contributors", "subjects", "description", "item_url", "image_url", "license", "rights_statement", "rights_url", "width", "height", "mode", "sha256", "dhash", "downloaded_at", "content_type", "_corrupt_record"],
    contributors=_LIST,
    subjects=_LIST,
    description=_LIST,
    width=T.IntegerType(),
    height=T.IntegerType(),
)
TASK = _strings(["id", "filename", "original_url", "mode", "status", "progress", "created_at", "completed_at", "result_url", "restored_url", "mask_url", "error", "_corrupt_record"], progress=T.IntegerType())
