"""What is known of a photo and what work it still needs, as predicates on the columns of the photos table.

Whether a file is there is a column too (``present``, ``preview_present``): a listing joined by path, not a look at the disk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mutations import LOCAL_ONLY, SYNCED, SYNCING

#: The neutral settings of edits.
CROP = {"user_crop_x": 0.0, "user_crop_y": 0.0, "user_crop_w": 1.0, "user_crop_h": 1.0}
ROTATION = {"user_angle": 0.0, "user_rotation90": 0}
PERSPECTIVE = {"user_persp_v": 0.0, "user_persp_h": 0.0, "user_shear": 0.0}
DEVELOP = {f"dev_{name}": 0.0 for name in ("exposure", "temperature", "tint", "contrast", "highlights", "shadows", "whites", "blacks", "vibrance", "saturation")}


def differs(neutral: dict[str, object]) -> Column:
    """Some column is not at its neutral value; null counts as neutral."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c) != v, F.lit(False)) for c, v in neutral.items()))


def has_crop() -> Column:
    return differs(CROP)


def has_rotation() -> Column:
    return differs(ROTATION)


def has_perspective() -> Column:
    return differs(PERSPECTIVE)


def has_edits() -> Column:
    return differs(CROP | ROTATION | PERSPECTIVE | DEVELOP)


def loaded_state(state: Column) -> Column:
    """A state as it is read: an upload that was under way is local again."""
    return F.when(state == SYNCING, LOCAL_ONLY).otherwise(state)


def pending_upload() -> Column:
    return (F.col("sync_state") == LOCAL_ONLY) & (F.col("local_path") != "")


def _has_file() -> Column:
    return (F.col("local_path") != "") & F.col("present")


def needs_exif() -> Column:
    """With a file: no lens data, exposure, orientation or focal length was ever read, or a side is 0, or a raw file has no lens data."""
    no_lens = F.col("lens_correction_params") == ""
    never = no_lens & (F.col("exposure_time") == "") & (F.col("orientation") == 1) & (F.col("focal_length_35mm") == 0)
    return _has_file() & (never | (F.col("width") == 0) | (F.col("height") == 0) | (F.col("is_raw") & no_lens))


def _has_preview() -> Column:
    return (F.col("preview_path") != "") & F.col("preview_present")


def needs_preview() -> Column:
    return ~F.col("is_video") & ~_has_preview() & _has_file()


def needs_faces() -> Column:
    return ~F.col("is_video") & ~F.col("face_scanned") & _has_preview()


def needs_white_balance() -> Column:
    return F.col("is_raw") & (F.col("as_shot_temp") <= 0) & _has_file()


def state_after_upload(state: Column, ok: Column) -> Column:
    """A row whose upload was under way is synced or local again by its result; others, and those without a result (null), stay."""
    return F.when((state == SYNCING) & ok.isNotNull(), F.when(ok, SYNCED).otherwise(LOCAL_ONLY)).otherwise(state)
