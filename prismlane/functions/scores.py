"""Technical quality, ratings and the gates built on them; a null score fails a gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LONG_EDGE, MIN_PIXELS, MIN_SHARPNESS, MIN_TECH = 320, 200_000, 80.0, 70.0


def _up_to_one(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def tech_score(sharp: Column, noise: Column, shadows: Column, highlights: Column, luma: Column, cast: Column) -> Column:
    exposure = F.when(luma < 0.2, luma / 0.2).when(luma > 0.8, (1.0 - luma) / 0.2).otherwise(1.0)
    exposure = F.greatest(F.lit(0.0), _up_to_one(exposure))
    parts = [_up_to_one(sharp / 100.0), 1.0 - _up_to_one(noise / 0.08), 1.0 - _up_to_one(shadows / 0.01), 1.0 - _up_to_one(highlights / 0.01), exposure, 1.0 - _up_to_one(cast / 10.0)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return 100.0 * (total / 6.0)


def black_slate(bright_share: Column, mean: Column, top: Column, threshold: float = 0.05, least: float = 0.05) -> Column:
    """Few bright pixels and a dark mean, or nearly black with one bright spot."""
    return ((bright_share < least) & (mean < threshold)) | ((mean < 0.05) & (top - mean > 0.5))


def overall(clip: Column, nima: Column, piq: Column) -> Column:
    return (clip + nima) * piq


def selection_gate(clip: Column, nima: Column, piq: Column) -> Column:
    return F.coalesce((clip >= 5.0) & (nima >= 4.75) & (piq >= 0.7) & (overall(clip, nima, piq) >= 8.0), F.lit(False))


def image_gate(clip: Column, nima: Column, piq: Column) -> Column:
    return F.coalesce((clip >= 5.0) & (nima >= 5.0) & (piq >= 0.8) & (overall(clip, nima, piq) >= 9.0), F.lit(False))


def image_rules_ordered(clip: Column, nima: Column, piq: Column, brisque: Column, without_brisque: bool = False) -> Column:
    """The ordered list: a low product rejects, one strong score accepts, else all floors must hold."""
    product = overall(clip, nima, piq)
    known = clip.isNotNull() & nima.isNotNull() & piq.isNotNull()
    spread_ok = F.when(brisque.isNotNull(), brisque <= 40.0).otherwise(F.lit(without_brisque))
    return (
        F.when(product <= 5.5, False).when(clip >= 6.0, True).when(nima >= 5.5, True).when(clip + nima >= 10.5, True).when(piq >= 0.85, True)
        .when(product >= 8.0, True).when(~known, False).otherwise((clip >= 5.0) & (nima >= 5.0) & (piq >= 0.65) & spread_ok)
    )


def image_rules_all(clip: Column, nima: Column, piq: Column, brisque: Column) -> Column:
    return F.coalesce((clip >= 5.0) & (nima >= 5.0) & (piq >= 0.4) & (brisque <= 40.0), F.lit(False))


def linear_quality(variance: Column, spread: Column, aesthetic: Column, a: float = 1.0, b: float = 0.0, c: float = 0.5) -> Column:
    return a * variance + b * spread + c * aesthetic


def early_gate(sharp: Column, noise: Column, shadows: Column, highlights: Column, tech: Column, face_sharpness: Column | None = None) -> Column:
    """The first reason of the older cascade, or null; a sharp face excuses a blurred frame."""
    blurry = sharp < MIN_SHARPNESS
    if face_sharpness is not None:
        blurry = blurry & ~(face_sharpness >= 0.5 * MIN_SHARPNESS)
    return F.when(blurry, "too_blurry").when(noise > 0.12, "too_noisy").when((shadows > 0.05) | (highlights > 0.05), "heavy_clipping").when(tech < MIN_TECH, "low_tech_score")


def framing_gate(face_w: Column, face_h: Column, width: Column, height: Column) -> Column:
    return F.when(F.least(face_w, face_h) / F.least(width, height) < 0.12, "face_too_small").when(~(face_w / face_h).between(0.6, 1.8), "face_aspect_weird")


def original_gate(c: dict[str, Column], person: bool = True, face: bool = False, indoor_face: bool = True, scenery: bool = True, either: bool = True, min_person: float = 0.05, min_face: float = 0.02, min_sharpness: float = 50.0, min_aesthetic: float = 0.0) -> Column:
    """The first cascade: person, face, scene or subject, text, blur with the subject's own sharpness, aesthetic; null if all pass.

    c: outdoor, scenic (booleans), person_areas, face_areas, roi_sharpness (arrays), sharpness_var, aesthetic, plain_aesthetic and, if text
    is a test, text_prominent.
    """
    none = lambda a: F.size(a) == 0
    outdoor = c["outdoor"]
    must = F.lit(face) | (F.lit(indoor_face) & ~outdoor)
    person_on = F.lit(person) & ~(F.lit(scenery) & outdoor)
    label = F.when(F.lit(indoor_face) & ~outdoor, "indoor_no_face").otherwise("no_face")
    sharp = sharp_enough(c["roi_sharpness"], c["sharpness_var"], min_sharpness)
    excused = F.lit(scenery) & outdoor & c["scenic"] & (c["plain_aesthetic"] >= min_aesthetic)
    return (
        F.when(person_on & none(c["person_areas"]), "no_person").when(person_on & (F.array_max(c["person_areas"]) < min_person), "person_small")
        .when(must & none(c["face_areas"]), label).when(must & (F.array_max(c["face_areas"]) < min_face), "face_small")
        .when(F.lit(either) & none(c["person_areas"]) & none(c["face_areas"]) & ~c["scenic"], "no_scene_no_person")
        .when(c.get("text_prominent", F.lit(False)), "text")
        .when(~sharp & ~excused, "blur").when(c["aesthetic"] < min_aesthetic, "low_aesthetic")
    )


def sharp_enough(roi_sharpness: Column, sharpness_var: Column, least: float) -> Column:
    """Whether a subject or else the frame is sharp; the test of the cascade and of the prune after de-duplication. No frame is sharp without a measure."""
    subject = F.coalesce((F.size(roi_sharpness) > 0) & (F.array_max(roi_sharpness) >= least), F.lit(False))
    return subject | F.coalesce(sharpness_var >= least, F.lit(False))


def scenic(outdoor: Column, brightness: Column, edges: Column, saturation: Column, least_edges: float = 0.015) -> Column:
    return outdoor | ((brightness >= 0.12) & (edges >= least_edges) & (saturation >= 0.12))


def outdoors(sky: Column, green: Column) -> Column:
    return (sky > 0.06) | (green > 0.12)


def capped_size(width: Column, height: Column, cap: int) -> dict[str, Column]:
    """The size with the long edge capped, the scale, and the resolution floors at that scale."""
    long_edge = F.greatest(width, height)
    scale = F.when(long_edge > cap, cap / long_edge).otherwise(1.0)
    size = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    return {"scale": scale, "new_w": size(width), "new_h": size(height), "min_edge": F.greatest(F.lit(1.0), MIN_LONG_EDGE * scale), "min_pixels": F.greatest(F.lit(10.0), MIN_PIXELS * scale * scale)}


def decision(c: dict[str, Column], require_face: bool = True, faceless: bool = True, scenic_only: bool = True, min_area: float = 0.02, min_y: float = 0.05, min_aesthetic: float = 0.0, min_tech: float = MIN_TECH) -> Column:
    """Why a frame is dropped, or 'kept'; the tests stand in the order in which they run. A column overlay_card, where there is one, is a test.

    A face below the confidence floor makes the frame a faceless candidate with its own aesthetic floor, and still goes through
    the face tests. Every drop has a reason, also the two that used to leave no trace (no_face, low_aesthetic).
    """
    run_face = c["skin"] >= 0.05
    has = run_face & (c["num_faces"] > 0)
    sure = has & (c["face_conf"] >= 0.3)
    if "secondary_face" in c:  # a second detector vouches for a face
        sure, has = sure | c["secondary_face"], has | (c["secondary_face"] & F.lit(require_face))
    empty = F.lit(require_face) & ~sure
    no_face = empty & F.lit(not faceless)
    busy = empty & F.lit(scenic_only) & (((c["skin"] > 0.05) & (c["motion"] > 2.0)) | (c["person_ratio"] > 0.05))
    floor = F.when(empty, 5.0).otherwise(min_aesthetic)
    return (
        F.when((F.greatest(c["width"], c["height"]) < MIN_LONG_EDGE) | (c["width"] * c["height"] < MIN_PIXELS), "low_resolution")
        .when(c["tech"] < min_tech, "low_tech_score").when(black_slate(c["bright_share"], c["mean_luma"], c["max_luma"]), "black_frame")
        .when(no_face, "no_face").when(busy, "faceless_not_scenic").when(has & (c["face_sharpness"] < 60.0), "face_too_blurry")
        .when(has & (F.abs(c["tilt"]) > 35.0), "face_tilted").when(has & (c["face_rel_area"] < min_area), "face_too_small")
        .when(has & (c["subject_y"] < min_y), "face_too_low").when(c.get("overlay_card", F.lit(False)), "overlay_card").when((c["sharpness_var"] < MIN_SHARPNESS) & run_face & ~(has & (c["face_sharpness"] >= 0.5 * MIN_SHARPNESS)), "global_blur")
        .when(c["aesthetic"] < floor, "low_aesthetic").when(~selection_gate(c["aesthetic"], c["nima"], c["piq"]), "score").otherwise("kept")
    )


def text_number(c: Column, digits: int = 2, missing: str = "NA") -> Column:
    """c with a fixed number of decimals. Its shortest decimal counts to 12 places, halves go away from zero: a sum that misses an exact half by a last bit prints as the half. From 1e12 to 2^63, where that decimal may lack digits, the exact value counts. What no decimal holds (NaN, infinity) prints as it is."""
    x = c.cast("double")
    whole = x.try_cast("long")
    large = F.when(F.abs(x) >= 1e12, whole.cast("decimal(20,0)") + (x - whole).cast("decimal(13,12)"))  # both parts are short, hence exact
    exact = F.round(F.coalesce(large, x.try_cast("decimal(38,12)")), digits)
    return F.when(c.isNull(), missing).otherwise(F.coalesce(exact.cast("string"), F.format_string(f"%.{digits}f", x)))
